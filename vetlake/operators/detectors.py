"""Registered detectors: line packs and own DataFrame transforms, chosen by enable and disable sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs as P
from .scan import scan_packs

HIT_COLS = ["skill_id", "path", "line_no", "pack", "rule_id", "severity", "label"]
Detector = Callable[[DataFrame], DataFrame]


class Detectors:
    """A set of named detectors; starts with the built-in line packs unless told otherwise."""

    def __init__(self, builtin: bool = True):
        self._known: dict[str, P.Pack | Detector] = dict(P.LINE_PACKS) if builtin else {}

    def register_rule_pack(self, name: str, pack: P.Pack | Detector) -> None:
        """Add a pack, or a transform from files to skill_id, path, line_no, rule_id, severity, label."""
        if not name or name in self._known:
            raise ValueError(f"detector name {name!r} is empty or taken")
        self._known[name] = pack

    def names(self, enabled: Iterable[str] = (), disabled: Iterable[str] = ()) -> list[str]:
        """Enabled detectors (none named: all) without the disabled ones; a name nobody registered is an error."""
        on, off = set(enabled), set(disabled)
        if unknown := (on | off) - self._known.keys():
            raise ValueError(f"unknown detectors: {sorted(unknown)}")
        return [n for n in self._known if (not on or n in on) and n not in off]

    def run(self, files: DataFrame, enabled: Iterable[str] = (), disabled: Iterable[str] = ()) -> DataFrame | None:
        """Hits of the chosen detectors; all line packs share one pass over the lines.  None chosen: None."""
        chosen = {n: self._known[n] for n in self.names(enabled, disabled)}
        lines = [p for p in chosen.values() if isinstance(p, P.Pack)]
        out = scan_packs(files, lines).select(*HIT_COLS) if lines else None
        for name, fn in chosen.items():
            if not isinstance(fn, P.Pack):
                part = fn(files).withColumn("pack", F.lit(name)).select(*HIT_COLS)
                out = part if out is None else out.unionByName(part)
        return out
