"""Rule files: YAML or JSON -> normalised rules."""

from __future__ import annotations

import json

from ..operators.rules import Rule


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:  # the YAML reader is optional
        raise RuntimeError("reading YAML rule files needs the yaml package; JSON works without it") from exc
    return yaml.safe_load(text)


def read_rules(path: str) -> list[Rule]:
    """Rules of one file; layer and severity are filled from each other.  Configuration, hence driver-side."""
    out = []
    for r in _load(path).get("rules") or []:
        d, f = r.get("detection") or {}, r.get("on_fail") or {}
        out.append(Rule(
            str(r.get("id", "")), str(r.get("name", "")), str(r.get("severity", "")), str(r.get("layer", "")), float(r.get("weight", 0) or 0), str(d.get("type", "")),
            str(d.get("function", "")), tuple(d.get("patterns") or ()), float(d.get("threshold_low", 0) or 0), float(d.get("threshold_high", 0) or 0),
            str(f.get("action", "")), str(f.get("reason", ""))).normalized())
    return out


def read_matrix(path: str) -> list[tuple[str, str, str, str, str]]:
    """Coverage items: (id, name, mode, mapping type, mapping id)."""
    return [tuple(str(i.get(k, "") or "") for k in ("id", "name", "evaluation_mode", "mapping_type", "mapping_id")) for i in _load(path).get("items") or []]
