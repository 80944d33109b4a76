"""Queries: corpus shaping and line scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode as DE
from ..functions import paths as FP
from ..functions import text as FT
from ..operators.detectors import Detectors
from ..operators import flow, scan
from ..operators import packs as P
from ..operators import rules as R
from ..operators import signatures as SG
from . import corpus as C
from . import sqltext as S
from .registry import query

HIT = "skill_id:str path:str line_no:int rule_id:str severity:str label:str"


# --- scans and filters -----------------------------------------------------------------------

@query("artifact_table", "skill_id:str path:str n_bytes:int sha256:str",
       "SELECT source AS skill_id, 'scripts/doc_' || doc_id AS path, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents")
def artifact_table(spark, d):
    return C.document_files(spark, d)


@query("line_table", "skill_id:str path:str line_no:int n_chars:int is_comment:bool", f"WITH {S.DOC_LINES} SELECT skill_id, path, line_no, length(line) AS n_chars, {S.rx('line', f'^[{FT.WS}]*(?:#|//|/[*]|[*]|--)')} AS is_comment FROM doc_l")
def line_table(spark, d):
    return scan.explode_lines(C.document_files(spark, d)).select("*", F.length("line").alias("n_chars"), FT.is_comment_line(F.col("line")).alias("is_comment"))


@query("path_classes", "path:str low_signal:bool production:bool signal:bool declaration:bool script:bool excluded:bool manifest:bool language:str",
       f"""WITH {S.SEED_LINES} SELECT DISTINCT path, {S.low_signal('path')} AS low_signal, {S.production('path')} AS production, {S.signal_file('path')} AS signal, {S.declaration('path')} AS declaration,
       {S.script('path')} AS script, {S.any_raw('path', FP.EXCLUDED_FILE_PARTS)} AS excluded, lower({S.base('path')}) IN ({', '.join(S.s(m) for m in FP.MANIFEST_NAMES)}) AS manifest,
       CASE WHEN {S.base('path')} = 'go.mod' THEN 'gomod' WHEN {S.base('path')} = 'package.json' THEN 'json' ELSE
         (MAP {{{', '.join(S.s(k) + ': ' + S.s(v) for k, v in FP.LANGUAGE_BY_EXT.items())}}})[CASE WHEN {S.ext('path')} = '.md' AND NOT {S.declaration('path')} THEN '-' ELSE {S.ext('path')} END] END AS language FROM f""")
def path_classes(spark, d):
    p = F.col("path")
    return C.seeded_files(spark, d).select("path", FP.is_low_signal_path(p).alias("low_signal"), FP.is_production_source(p).alias("production"), FP.is_signal_file(p).alias("signal"), FP.is_declaration(p).alias("declaration"),
                                           FP.is_script(p).alias("script"), FP.is_excluded_file(p).alias("excluded"), FP.is_manifest(p).alias("manifest"), FP.language_of(p).alias("language")).distinct()


@query("line_gates", "skill_id:str code:int log_only:int notices:int license_config:int overrides:int", f"""WITH {S.SEED_LINES} SELECT skill_id, count(*) FILTER ({S.code_line('line')}) AS code, count(*) FILTER ({S.log_only('line')}) AS log_only,
  count(*) FILTER ({S.any_in('lower(line)', FT.LICENSE_NOTICE)} AND NOT {S.any_in('lower(line)', FT.LICENSE_NOTICE_BLOCKERS)}) AS notices,
  count(*) FILTER ({S.code_line('line')} AND NOT ({S.any_in('lower(line)', FT.LICENSE_NOTICE)} AND NOT {S.any_in('lower(line)', FT.LICENSE_NOTICE_BLOCKERS)}) AND {S.any_in('lower(line)', FT.LICENSE_WORDS)} AND {S.any_in('lower(line)', FT.LICENSE_SIGNALS)}) AS license_config,
  count(*) FILTER ({S.any_in('lower(line)', FT.PROMPT_OVERRIDE)}) AS overrides FROM l GROUP BY 1""")
def line_gates(spark, d):
    c = F.col("line")
    return scan.explode_lines(C.seeded_files(spark, d)).groupBy("skill_id").agg(
        F.count_if(FT.is_code_line(c)).alias("code"), F.count_if(FT.is_log_only_line(c)).alias("log_only"), F.count_if(FT.is_license_notice(c)).alias("notices"),
        F.count_if(FT.is_license_config(c)).alias("license_config"), F.count_if(FT.prompt_override(c)).alias("overrides"))


@query("scan_license_notices", "skill_id:str path:str line_no:int", f"WITH {S.DOC_LINES} SELECT skill_id, path, line_no FROM doc_l WHERE {S.any_in('lower(line)', FT.LICENSE_NOTICE)} AND NOT {S.any_in('lower(line)', FT.LICENSE_NOTICE_BLOCKERS)}")
def scan_license_notices(spark, d):
    return scan.explode_lines(C.document_files(spark, d)).where(FT.is_license_notice(F.col("line")))


@query("split_id_lists", "path:str n_ids:int ids:str", rf"""SELECT 'scripts/doc_' || doc_id AS path, len(ids) AS n_ids, array_to_string(ids, '|') AS ids FROM (
  SELECT doc_id, list_distinct_ordered AS ids FROM (SELECT doc_id, list(x ORDER BY p) AS list_distinct_ordered FROM (
    SELECT doc_id, x, min(p) AS p FROM (SELECT doc_id, {S.trim('part')} AS x, p FROM (SELECT doc_id, unnest(string_split(text, ',')) AS part, generate_subscripts(string_split(text, ','), 1) AS p FROM documents))
    WHERE x <> '' GROUP BY doc_id, x) GROUP BY doc_id))""")
def split_id_lists(spark, d):
    ids = FT.split_ids(F.col("content"))
    return C.document_files(spark, d).select("path", ids.alias("_i")).select("path", F.size("_i").alias("n_ids"), F.array_join("_i", "|").alias("ids")).where("n_ids > 0")


@query("severity_spellings", "severity:str n:int", """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'low' ELSE 'low' END AS severity FROM orders) GROUP BY 1""")
def severity_spellings(spark, d):
    raw = F.substring_index(F.col("o_orderpriority"), "-", -1)
    spelled = F.when(raw == "URGENT", F.lit(" 严重 ")).when(raw == "NOT SPECIFIED", F.lit("  ")).otherwise(raw)
    return C.table(spark, d, "orders").select(FT.normalize_severity(spelled).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


# --- line packs ----------------------------------------------------------------------------------

def _pack_sql(p: P.Pack, lines: str = "l") -> str:
    col = S.trim("line") if p.code_only else "line"
    gate = ["TRUE"]
    if p.code_only:
        gate.append(S.code_line("line"))
    if p.skip_low_signal:
        gate.append(f"NOT {S.low_signal('path')}")
    if p.exclude:
        gate.append(f"NOT {S.any_in('lower(line)', p.exclude)}")
    label = "CASE " + " ".join(f"WHEN {S.rx(col, r)} THEN {S.s(lab)}" for r, lab in p.patterns) + " END"
    return f"SELECT * FROM (SELECT skill_id, path, line_no, {S.s(p.rule_id)} AS rule_id, {S.s(p.severity)} AS severity, {label} AS label FROM {lines} WHERE {' AND '.join(gate)}) WHERE label IS NOT NULL"


def _register_pack(p: P.Pack) -> None:
    @query("scan_" + p.key, HIT, f"WITH {S.SEED_LINES} {_pack_sql(p)}")
    def run(spark, d):
        return scan.scan_pack(C.seeded_files(spark, d), p)


for _p in P.LINE_PACKS.values():
    _register_pack(_p)


@query("scan_all_packs", "pack:str severity:str n_hits:int n_files:int", f"WITH {S.SEED_LINES}, h AS (" + " UNION ALL ".join(
    f"SELECT {S.s(p.key)} AS pack, * FROM ({_pack_sql(p)})" for p in P.LINE_PACKS.values()) + ") SELECT pack, severity, count(*) AS n_hits, count(DISTINCT path || chr(1) || skill_id) AS n_files FROM h GROUP BY 1, 2")
def scan_all_packs(spark, d):
    """All packs in one pass over the lines."""
    hits = scan.scan_packs(C.seeded_files(spark, d), list(P.LINE_PACKS.values()))
    per_file = hits.groupBy("pack", "severity", "skill_id", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("pack", "severity").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_files"))


_OFF = sorted(P.LINE_PACKS)[:2]


def _reminders(files):
    """A detector of one's own: lines with a to-do mark."""
    lines = scan.explode_lines(files).where(F.lower("line").contains("manual approval"))
    return lines.select("skill_id", "path", "line_no", F.lit("OWN-1").alias("rule_id"), F.lit("low").alias("severity"), F.lit("manual approval").alias("label"))


@query("registered_packs", "pack:str rule_id:str n_hits:int", f"WITH {S.SEED_LINES}, h AS (" + " UNION ALL ".join(
    f"SELECT {S.s(p.key)} AS pack, rule_id FROM ({_pack_sql(p)})" for p in P.LINE_PACKS.values() if p.key not in _OFF)
    + " UNION ALL SELECT 'reminders', 'OWN-1' FROM l WHERE contains(lower(line), 'manual approval')) SELECT pack, rule_id, count(*) AS n_hits FROM h GROUP BY 1, 2")
def registered_packs(spark, d):
    """Built-in packs but two, and a registered one."""
    known = Detectors()
    known.register_rule_pack("reminders", _reminders)
    return known.run(C.seeded_files(spark, d), disabled=_OFF).groupBy("pack", "rule_id").agg(F.count("*").alias("n_hits"))


@query("scan_secrets", HIT, f"WITH {S.DOC_LINES} {_pack_sql(P.HARDCODED_CREDENTIALS, 'doc_l')}")
def scan_secrets(spark, d):
    """Hard-coded credentials in the documents as they are."""
    return scan.scan_pack(C.document_files(spark, d), P.HARDCODED_CREDENTIALS)


@query("scan_page_tls", HIT, f"WITH {S.PAGE_FILES} {_pack_sql(P.TLS, 'page_l')}")
def scan_page_tls(spark, d):
    return scan.scan_pack(C.page_files(spark, d), P.TLS)


_PATTERN_RULES = [r for r in R.default_rules() if r.dtype == "pattern"]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT skill_id, path, line_no, {S.s(r.rule_id)} AS rule_id, {S.s(r.severity)} AS severity, {S.s(r.action)} AS action FROM l WHERE " + "(" + " OR ".join(S.rx("line", p) for p in r.patterns) + ")" for r in _PATTERN_RULES)


@query("scan_pattern_rules", "skill_id:str path:str line_no:int rule_id:str severity:str action:str", f"WITH {S.SEED_LINES} {_RULE_SQL}")
def scan_pattern_rules(spark, d):
    return scan.scan_patterns(C.seeded_files(spark, d), R.default_rules())


_ISLANDS = f"""WITH {S.SEED_LINES}, h AS ({_RULE_SQL}), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY skill_id, path, rule_id ORDER BY line_no) AS grp FROM h),
  g AS (SELECT skill_id, path, rule_id, min(line_no) AS line_start, max(line_no) AS line_end FROM i GROUP BY skill_id, path, rule_id, grp)"""


@query("hit_intervals", "skill_id:str path:str rule_id:str severity:str line_start:int line_end:int code_snippet:str", _ISLANDS + """
  SELECT g.skill_id, g.path, g.rule_id, 'high' AS severity, line_start, line_end, string_agg(CASE WHEN l.line_no BETWEEN line_start AND line_end THEN '> ' ELSE '  ' END || lpad(l.line_no::VARCHAR, greatest(4, len(l.line_no::VARCHAR))::INT, ' ') || ' | ' || l.line || chr(10), '' ORDER BY l.line_no) AS code_snippet
  FROM g JOIN l ON g.skill_id = l.skill_id AND g.path = l.path AND l.line_no BETWEEN line_start - 2 AND line_end + 2 GROUP BY g.skill_id, g.path, g.rule_id, line_start, line_end""")
def hit_intervals(spark, d):
    return scan.hit_intervals(C.seeded_files(spark, d), R.default_rules())


_HEX_TOKEN = r"""(?i)token\s*=\s*"([0-9a-f]{40})\""""


@query("signed_tokens", "skill_id:str path:str line_no:int token:str", f"WITH {S.DOC_LINES} SELECT skill_id, path, line_no, regexp_extract(line, {S.s(_HEX_TOKEN)}, 1) AS token FROM doc_l WHERE regexp_matches(line, {S.s(_HEX_TOKEN)})")
def signed_tokens(spark, d):
    """Assigned tokens of all documents: written in blocks with their signatures, then read only where a token can stand."""
    files = C.document_files(spark, d).select("skill_id", "path", "content")
    signed = SG.sign(files, SG.block_count(files.count()))
    lines = scan.explode_lines(SG.may_hold(signed, [_HEX_TOKEN]))
    return lines.where(FT.matches(F.col("line"), _HEX_TOKEN)).withColumn("token", F.regexp_extract("line", FT.jrx(_HEX_TOKEN), 1))


@query("code_context", "skill_id:str path:str line_no:int code_snippet:str", f"""WITH {S.DOC_LINES}, h AS ({_pack_sql(P.HARDCODED_CREDENTIALS, 'doc_l')})
  SELECT h.skill_id, h.path, h.line_no, string_agg(CASE WHEN l.line_no = h.line_no THEN '> ' ELSE '  ' END || lpad(l.line_no::VARCHAR, greatest(4, len(l.line_no::VARCHAR))::INT, ' ') || ' | ' || l.line || chr(10), '' ORDER BY l.line_no) AS code_snippet
  FROM h JOIN doc_l l ON h.skill_id = l.skill_id AND h.path = l.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY 1, 2, 3""")
def code_context(spark, d):
    return scan.pack_context(C.document_files(spark, d), P.HARDCODED_CREDENTIALS, 2)


_CUSTOM = '[{"name": "frequent words", "severity": "medium", "patterns": ["(?i)^the\\\\b", "(?i)\\\\btoken\\\\b"], "reason": "word rule"}, {"name": "questions", "severity": "low", "patterns": ["\\\\?$"]}, {"name": "", "severity": "high", "patterns": ["x"]}]'


@query("scan_custom_rules", "skill_id:str path:str line_no:int rule_id:str severity:str", f"""WITH {S.DOC_LINES} SELECT skill_id, path, line_no, 'CUSTOM-1' AS rule_id, 'medium' AS severity FROM doc_l WHERE {S.rx('line', r'(?i)^the\b')} OR {S.rx('line', r'(?i)\btoken\b')}
  UNION ALL SELECT skill_id, path, line_no, 'CUSTOM-2', 'low' FROM doc_l WHERE {S.rx('line', '[?]$')}""")
def scan_custom_rules(spark, d):
    """User rules over the documents; the nameless one is dropped by validation."""
    return scan.custom_patterns(C.document_files(spark, d), R.select_rules([], None, R.parse_custom_rules(_CUSTOM)))


@query("preset_hits", "preset:str n_hits:int", f"""WITH {S.SEED_LINES}, h AS ({_RULE_SQL}) SELECT preset, count(*) AS n_hits FROM h CROSS JOIN (VALUES ('default-all'), ('strict-admission'), ('fast-review'), ('high-risk-gate')) v(preset) GROUP BY 1""")
def preset_hits(spark, d):
    """Hits of the pattern rules each preset selects."""
    out = None
    for key in R.PRESETS:
        p = scan.scan_patterns(C.seeded_files(spark, d), R.preset_rules(key)).groupBy(F.lit(key).alias("preset")).agg(F.count("*").alias("n_hits"))
        out = p if out is None else out.unionByName(p)
    return out


# --- credentials, entropy, risky calls ----------------------------------------------------------------

_CRED_SQL = " UNION ALL ".join(
    f"SELECT skill_id, path, line_no, {S.s(k)} AS kind, regexp_extract(line, {S.s(r)}, 0) AS match FROM L WHERE {S.rx('line', r)}"
    + ("" if ex is None else f" AND NOT {S.any_raw('line', ex)} AND NOT {S.any_in(f'lower(regexp_extract(line, {S.s(r)}, 0))', P.PLACEHOLDER_WORDS)}") for r, k, ex in P.CREDENTIAL_FORMATS)


@query("scan_credential_formats", "skill_id:str path:str line_no:int kind:str match:str", f"WITH {S.DOC_LINES} {_CRED_SQL.replace('FROM L', 'FROM doc_l')}")
def scan_credential_formats(spark, d):
    return scan.credential_formats(scan.explode_lines(C.document_files(spark, d)))


@query("credential_formats_seeded", "skill_id:str path:str line_no:int kind:str match:str", f"WITH {S.SEED_LINES} {_CRED_SQL.replace('FROM L', 'FROM l')}")
def credential_formats_seeded(spark, d):
    return scan.credential_formats(scan.explode_lines(C.seeded_files(spark, d)))


@query("learned_exclusions", "skill_id:str path:str line_no:int kind:str match:str", f"""WITH {S.SEED_LINES}, c AS ({_CRED_SQL.replace('FROM L', 'FROM l')}), tok AS (SELECT DISTINCT lower(substr(trim(p_name), 1, 3)) AS token FROM part UNION SELECT DISTINCT lower(p_type[1:2]) FROM part)
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM tok WHERE contains(lower(c.match), tok.token))""")
def learned_exclusions(spark, d):
    """Credential hits minus those containing a learned token; part names and types stand in for the token list."""
    part = C.table(spark, d, "part")
    fb = part.select(F.lit("V7-004").alias("rule_id"), F.substring(F.trim("p_name"), 1, 3).alias("token")).union(part.select(F.lit("SEC-001"), F.substring("p_type", 1, 2)))
    hits = scan.credential_formats(scan.explode_lines(C.seeded_files(spark, d))).withColumn("rule_id", F.lit("V7-004"))
    return scan.learned_exclusions(hits, fb)


def _entropy_sql(col: str, total: str) -> str:
    return f"(SELECT coalesce(-sum((c / t) * log2(c / t)), 0) + 0.0 FROM (SELECT count(*)::DOUBLE AS c, any_value({total})::DOUBLE AS t FROM (SELECT unnest(string_split({col}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"


@query("entropy_lines", "path:str line_no:int n_chars:int char_h:float byte_h:float", f"""WITH {S.DOC_LINES}, c AS (SELECT path, line_no, line, unnest(string_split(line, '')) AS ch FROM doc_l WHERE length(line) > 0),
  n AS (SELECT path, line_no, any_value(length(line))::DOUBLE AS t, any_value(strlen(line))::DOUBLE AS b, ch, count(*)::DOUBLE AS k FROM c WHERE ch <> '' GROUP BY path, line_no, ch)
  SELECT path, line_no, any_value(t) AS n_chars, -sum((k / t) * log2(k / t)) + 0.0 AS char_h, -sum((k / b) * log2(k / b)) + 0.0 AS byte_h FROM n GROUP BY path, line_no""")
def entropy_lines(spark, d):
    c = F.col("line")
    return scan.explode_lines(C.document_files(spark, d)).where(F.length(c) > 0).select("path", "line_no", F.length(c).alias("n_chars"), FT.char_entropy(c).alias("char_h"), FT.byte_entropy(c).alias("byte_h"))


@query("high_entropy_literals", "path:str line_no:int literal:str entropy:float", f"""WITH {S.SEED_LINES}, c0 AS (SELECT skill_id, path, line_no, line, regexp_replace(line, '^["'' ]+|["'' ]+$', '', 'g') AS literal FROM l),
  c AS (SELECT *, unnest(string_split(literal, '')) AS ch FROM c0 WHERE strlen(literal) > 16 AND NOT {S.any_raw('line', P.PLACEHOLDER_WORDS)} AND NOT {S.any_in('lower(literal)', P.PLACEHOLDER_WORDS)}),
  n AS (SELECT skill_id, path, line_no, literal, strlen(literal)::DOUBLE AS b, ch, count(*)::DOUBLE AS k FROM c WHERE ch <> '' GROUP BY ALL)
  SELECT path, line_no, literal, -sum((k / b) * log2(k / b)) AS entropy FROM n GROUP BY skill_id, path, line_no, literal HAVING entropy > 4.5""")
def high_entropy_literals(spark, d):
    return scan.high_entropy_literals(scan.explode_lines(C.seeded_files(spark, d)))


@query("obfuscated_files", "skill_id:str path:str n_lines:int", f"WITH {S.SEED_LINES} SELECT skill_id, path, count(*) AS n_lines FROM l WHERE NOT {S.any_raw('path', FP.EXCLUDED_FILE_PARTS)} AND contains(line, 'base64') AND contains(line, 'decode') GROUP BY 1, 2")
def obfuscated_files(spark, d):
    """No prose line reaches entropy 6, so the base64-decode test alone decides here; the entropy branch has its own test."""
    return scan.obfuscated_files(C.seeded_files(spark, d))


_CALL_SQL = " UNION ALL ".join(f"SELECT skill_id, path, line_no, {S.s(c)} AS category, {S.s(r)} AS function, {S.s(v)} AS severity FROM l WHERE {S.rx('line', r)}" for c, items in P.DANGEROUS_CALLS.items() for r, v in items)


@query("dangerous_calls", "skill_id:str path:str line_no:int category:str function:str severity:str", f"WITH {S.SEED_LINES} {_CALL_SQL}")
def dangerous_calls(spark, d):
    return scan.dangerous_calls(scan.explode_lines(C.seeded_files(spark, d)))


_INJ_SQL = " UNION ALL ".join(f"SELECT skill_id, path, line_no, {S.s(c)} AS category, {S.s(r)} AS function, {S.s(v)} AS severity FROM l WHERE {S.rx('lower(line)', r)}" for c in ("prompt_injection", "agent_context") for r, v in P.DANGEROUS_CALLS[c])


@query("injection_lines", "skill_id:str path:str line_no:int category:str function:str severity:str", f"WITH {S.SEED_LINES} {_INJ_SQL}")
def injection_lines(spark, d):
    return scan.injection_lines(scan.explode_lines(C.seeded_files(spark, d)))


_TURN_WORDS = ["the ", "que ", "der ", "para "]


@query("prompt_override_turns", "path:str line_no:int role:str hit:str", f"""SELECT conv_id::VARCHAR AS path, turn AS line_no, role, CASE WHEN {S.any_in('lower(text)', FT.PROMPT_OVERRIDE)} THEN 'override' ELSE 'watched word' END AS hit FROM conversations
  WHERE {S.any_in('lower(text)', FT.PROMPT_OVERRIDE)} OR {S.any_in('lower(text)', _TURN_WORDS)}""")
def prompt_override_turns(spark, d):
    """Turns with an override phrase (plain or encoded) or a watched word; the corpus has only the latter."""
    c = F.col("line")
    over = DE.any_prompt_override(c)
    return C.conversation_lines(spark, d).where(over | FT.contains_any(c, _TURN_WORDS)).withColumn("hit", F.when(over, F.lit("override")).otherwise(F.lit("watched word")))


_CLS = {
    "secrets": f"({S.any_in('lower(line)', P.SENSITIVE_MARKERS)} OR ({S.rx('line', P.ENV_READ_RX)} AND {S.rx('line', P.ENV_SECRET_RX)}) OR ({S.rx('line', P.FILE_READ_RX)} AND {S.rx('line', P.FILE_SECRET_RX)}))",
    "network": f"({S.rx('line', P.NETWORK_CALL_RX)} AND {S.code_line('line')})",
    "command": f"({S.rx('line', P.COMMAND_CALL_RX)} AND {S.code_line('line')})",
    "destructive": f"((CASE WHEN {S.rx('line', P.DELETE_CALL_RX)} THEN TRUE WHEN {S.rx('line', P.RM_RF_RX)} THEN {S.rx(S.trim('line'), P.RM_CONTEXT_RX)} WHEN {S.rx('line', P.SQL_DELETE_RX)} THEN {S.rx('line', P.SQL_CONTEXT_RX)} ELSE FALSE END) AND {S.code_line('line')})",
    "c2": f"(({S.rx('line', P.C2_RX)} OR ({S.rx('line', P.PERSIST_TARGET_RX)} AND {S.rx('line', P.PERSIST_WRITE_RX)})) AND {S.code_line('line')})",
}


@query("line_classes", "skill_id:str path:str line_no:int secrets:bool network:bool command:bool destructive:bool c2:bool",
       f"WITH {S.SEED_LINES} SELECT * FROM (SELECT skill_id, path, line_no, {', '.join(f'{v} AS {k}' for k, v in _CLS.items())} FROM l) WHERE {' OR '.join(_CLS)}")
def line_classes(spark, d):
    c = F.col("line")
    df = scan.explode_lines(C.seeded_files(spark, d)).select("skill_id", "path", "line_no", scan.touches_secrets(c).alias("secrets"), scan.calls_network(c).alias("network"), scan.runs_command(c).alias("command"),
                                                            scan.destroys_data(c).alias("destructive"), scan.persists_or_beacons(c).alias("c2"))
    return df.where("secrets or network or command or destructive or c2")


# --- rules with file and skill logic --------------------------------------------------------------------

_B64 = r"[A-Za-z0-9+/]{20,}={0,2}"
# decoded override text of one string: base64 tokens of whole groups; hex tokens
_DEC_OVER = f"""(list_bool_or(list_transform(regexp_extract_all(X, '{_B64}'), lambda t: coalesce({S.any_in("lower(try(decode(from_base64(t))))", FT.PROMPT_OVERRIDE)}, FALSE))))"""
_OVER = f"({S.any_in('lower(X)', FT.PROMPT_OVERRIDE)} OR coalesce({_DEC_OVER}, FALSE))"


_DENSE = """en AS (SELECT skill_id, path, -sum((k / b) * log2(k / b)) > 5.0 AS dense FROM (SELECT skill_id, path, any_value(strlen(content))::DOUBLE AS b, ch, count(*)::DOUBLE AS k FROM (SELECT skill_id, path, content, unnest(string_split(content, '')) AS ch FROM f) WHERE ch <> '' GROUP BY skill_id, path, ch) GROUP BY 1, 2)"""


@query("hidden_content", HIT, f"""WITH {S.SEED_LINES}, {_DENSE}, s AS (SELECT f.skill_id, f.path, {S.rx('content', FT.HIDDEN_CHARS)} AS ctl, {_OVER.replace('X', 'content')} AS ov, (contains(content, 'btoa')::INT + contains(content, 'atob')::INT) AS b64, coalesce(dense, FALSE) AS dense
    FROM f LEFT JOIN en ON f.skill_id = en.skill_id AND f.path = en.path WHERE NOT {S.low_signal('f.path')}),
  sc AS (SELECT skill_id, min(path) FILTER (dense) AS dense_path FROM s GROUP BY 1 HAVING bool_or(ctl) OR 5 - 4 * count(*) FILTER (ov) - CASE WHEN sum(b64) >= 2 THEN 3 ELSE 0 END - CASE WHEN bool_or(dense) THEN 2 ELSE 0 END < 5),
  h AS (SELECT skill_id, path, line_no, {S.rx('line', FT.HIDDEN_CHARS)} AS ctl, {_OVER.replace('X', 'line')} AS ov, contains(line, 'btoa') AS b, contains(line, 'atob') AS a FROM l WHERE NOT {S.low_signal('path')} AND skill_id IN (SELECT skill_id FROM sc))
  SELECT skill_id, path, line_no, 'V7-029' AS rule_id, v.severity, v.label FROM h, LATERAL (SELECT 'low' AS severity, 'hidden control character' AS label WHERE ctl UNION ALL SELECT 'medium', 'prompt override' WHERE ov UNION ALL SELECT 'low', 'btoa encoding' WHERE b UNION ALL SELECT 'low', 'atob decoding' WHERE a) v
  UNION ALL SELECT skill_id, dense_path, 0, 'V7-029', 'low', 'high file entropy' FROM sc WHERE dense_path IS NOT NULL""")
def hidden_content(spark, d):
    return scan.hidden_content(C.seeded_files(spark, d))


_INJ_LINE = f"CASE WHEN {_OVER.replace('X', 'line')} THEN 'prompt override' WHEN (contains(line, 'exec.Command') AND contains(line, 'input')) OR (contains(line, 'os.system') AND contains(line, 'input')) OR contains(line, 'eval(') THEN 'command injection' END"


@query("injection_risk", HIT, f"""WITH {S.SEED_LINES}, s AS (SELECT DISTINCT skill_id FROM f WHERE NOT {S.low_signal('path')} AND ({_OVER.replace('X', 'content')} OR (contains(content, 'exec.Command') AND contains(content, 'input'))
    OR (contains(content, 'llm.Output') AND contains(content, 'exec')) OR (contains(content, 'args') AND NOT contains(content, 'whitelist')))),
  h AS (SELECT skill_id, path, line_no, {_INJ_LINE} AS label FROM l WHERE NOT {S.low_signal('path')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY path, line_no) AS rn FROM h WHERE label IS NOT NULL AND skill_id IN (SELECT skill_id FROM s))
  SELECT skill_id, path, line_no, 'V7-011' AS rule_id, 'medium' AS severity, label FROM r WHERE rn = 1
  UNION ALL SELECT skill_id, min(path), 0, 'V7-011', 'medium', 'command injection' FROM f WHERE skill_id IN (SELECT skill_id FROM s) AND skill_id NOT IN (SELECT skill_id FROM r) GROUP BY 1""")
def injection_risk(spark, d):
    return scan.injection_risk(C.seeded_files(spark, d))


@query("resource_exhaustion", HIT, f"""WITH {S.SEED_LINES}, c AS (SELECT *, {S.rx(S.trim('line'), P.LOOP_RX)} AS lp, {S.any_in('lower(line)', ['http.get(', 'requests.get('])} AS gt, contains(lower(line), 'timeout') AS tm FROM l WHERE {S.code_line('line')}),
  p AS (SELECT skill_id, path, min(line_no) FILTER (lp) AS lp, max(line_no) FILTER (gt) AS gt, bool_or(tm) AS tm FROM c GROUP BY 1, 2),
  h AS (SELECT skill_id, path, CASE WHEN lp IS NOT NULL THEN lp WHEN gt IS NOT NULL AND NOT tm THEN gt END AS line_no, CASE WHEN lp IS NOT NULL THEN 'endless loop' ELSE 'no timeout' END AS label FROM p)
  SELECT skill_id, path, line_no, 'V7-026' AS rule_id, 'low' AS severity, label FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY path) AS rn FROM h WHERE line_no IS NOT NULL) WHERE rn = 1""")
def resource_exhaustion(spark, d):
    return scan.resource_exhaustion(C.seeded_files(spark, d))


@query("soft_dependencies", HIT, f"""WITH {S.SEED_LINES}, s AS (SELECT DISTINCT skill_id FROM f WHERE contains(content, 'http.Get') AND ((contains(content, '.js') AND NOT contains(content, 'hash')) OR NOT contains(content, 'https://'))),
  h AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY path, line_no) AS rn FROM l WHERE contains(line, 'http.Get') AND NOT contains(line, 'hash') AND skill_id IN (SELECT skill_id FROM s))
  SELECT skill_id, path, line_no, 'V7-018' AS rule_id, 'medium' AS severity, 'unchecked remote script' AS label FROM h WHERE rn = 1
  UNION ALL SELECT skill_id, min(path), 0, 'V7-018', 'medium', 'soft dependency' FROM f WHERE skill_id IN (SELECT skill_id FROM s) AND skill_id NOT IN (SELECT skill_id FROM h) GROUP BY 1""")
def soft_dependencies(spark, d):
    return scan.soft_dependencies(C.seeded_files(spark, d))


def _uncertain(v: str) -> str:
    t = f"lower({S.trim(v)})"
    return f"({t} IN ('', '*', 'latest') OR {S.any_raw(t, ['>=', '<=', '~=', '^'])} OR {S.rx(t, P.LOOSE_VERSION_RX)})"


@query("version_locking", HIT, f"""WITH {S.SEED_LINES} SELECT skill_id, path, line_no, 'V7-022' AS rule_id, 'medium' AS severity, 'unlocked version' AS label FROM l WHERE lower({S.base('path')}) IN ({', '.join(S.s(m) for m in FP.MANIFEST_NAMES)})
  AND {S.code_line('line')} AND ({S.any_raw('lower(line)', ['git+https://', 'http://', 'https://'])} OR {_uncertain('line')})""")
def version_locking(spark, d):
    return scan.version_locking(C.seeded_files(spark, d))


@query("tool_abuse", HIT, f"""WITH {S.SEED_LINES} SELECT skill_id, path, min(line_no) AS line_no, 'V7-007' AS rule_id, 'high' AS severity, 'tool call' AS label FROM l JOIN (SELECT skill_id AS s, path AS p FROM f WHERE contains(content, 'mcp__') OR contains(content, 'call_tool')) ON skill_id = s AND path = p
  WHERE contains(line, 'delete_all') OR contains(line, 'system.exec') GROUP BY 1, 2""")
def tool_abuse(spark, d):
    return scan.tool_abuse(C.seeded_files(spark, d), C.seeded_skills(spark, d))


@query("file_cooccurrence", "skill_id:str path:str variant:str", f"WITH {S.SEED_LINES} " + " UNION ALL ".join(
    f"SELECT skill_id, path, {S.s(n)} AS variant FROM f WHERE " + " AND ".join(S.any_raw("content", g) for g in groups) for n, groups in P.COOCCURRENCE.items()))
def file_cooccurrence(spark, d):
    return scan.cooccurs(C.seeded_files(spark, d))


# --- decoding -----------------------------------------------------------------------------------------------

@query("encoded_tokens", "path:str kind:str token:str is_long:bool", rf"""SELECT DISTINCT 'scripts/doc_' || doc_id AS path, kind, token, length(token) >= 48 AS is_long FROM (SELECT doc_id, 'base64' AS kind, unnest(regexp_extract_all(text, '{_B64}')) AS token FROM documents
  UNION ALL SELECT doc_id, 'hex', unnest(regexp_extract_all(text, '(?i)\b[0-9a-f]{{24,}}\b')) FROM documents)""")
def encoded_tokens(spark, d):
    return flow.encoded_tokens(C.document_files(spark, d))


def _layer(col: str) -> str:
    ok = lambda t: f"(CASE WHEN octet_length({t}) >= 8 AND strlen({S.trim(f'try(decode({t}))')}) BETWEEN 8 AND 400 AND length(regexp_replace({S.trim(f'try(decode({t}))')}, '[^\\n\\r\\t -~]', '', 'g')) * 100 >= length({S.trim(f'try(decode({t}))')}) * 85 THEN {S.trim(f'try(decode({t}))')} END)"
    b = f"(CASE WHEN length({col}) % 4 = 0 AND regexp_matches({col}, '^[A-Za-z0-9+/]*={{0,2}}$') THEN {ok(f'try(from_base64({col}))')} END)"
    h = f"(CASE WHEN length({col}) % 2 = 0 AND regexp_matches({col}, '^[0-9A-Fa-f]+$') THEN {ok(f'try(unhex({col}))')} END)"
    return f"CASE WHEN {b} IS NOT NULL THEN 'base64' WHEN {h} IS NOT NULL THEN 'hex' END AS k, coalesce({b}, {h}) AS t"


_INTERESTING = f"({S.any_in('lower(t)', DE.INTERESTING_WORDS)} OR regexp_matches(t, '[/\\\\(){{}}\\[\\]:=;.]'))"


@query("decoded_tokens", "token:str n_uses:int layers:str", rf"""WITH {S.SEED_LINES}, tk0 AS (SELECT DISTINCT skill_id, path, kind, token FROM (SELECT skill_id, path, 'base64' AS kind, unnest(regexp_extract_all(content, '{_B64}')) AS token FROM f
    UNION ALL SELECT skill_id, path, 'hex', unnest(regexp_extract_all(content, '(?i)\b[0-9a-f]{{24,}}\b')) FROM f)),
  tk AS (SELECT token, count(*) AS n_uses FROM tk0 GROUP BY 1),
  a1 AS (SELECT token, n_uses, {_layer('token')} FROM tk), b1 AS (SELECT *, CASE WHEN t IS NOT NULL AND {_INTERESTING} THEN k || '[1]: ' || t END AS e1 FROM a1),
  a2 AS (SELECT token, n_uses, e1, {_layer('cur')} FROM (SELECT token, n_uses, e1, t AS cur FROM b1)), b2 AS (SELECT *, k || '[2]: ' || t AS e2 FROM a2),
  a3 AS (SELECT token, n_uses, e1, e2, {_layer('cur')} FROM (SELECT token, n_uses, e1, e2, t AS cur FROM b2)), b3 AS (SELECT *, k || '[3]: ' || t AS e3 FROM a3)
  SELECT token, n_uses, concat_ws('|', e1, e2, e3) AS layers FROM b3 WHERE e1 IS NOT NULL OR e2 IS NOT NULL OR e3 IS NOT NULL""")
def decoded_tokens(spark, d):
    return flow.decode_tokens(flow.encoded_tokens(C.seeded_files(spark, d))).withColumn("layers", F.array_join("layers", "|"))


@query("decoded_sections", "skill_id:str path:str n_sections:int sections:str")
def decoded_sections(spark, d):
    """All recovery techniques; the variable resolution has no plain SQL form, so it is tested on fixtures."""
    return flow.decoded_sections(C.seeded_files(spark, d)).select("skill_id", "path", F.size("sections").alias("n_sections"), F.array_join("sections", "\n").alias("sections"))


@query("scan_decoded_text", HIT)
def scan_decoded_text(spark, d):
    """Packs and pattern rules over raw plus decoded text, as the full scan runs them."""
    files, packs = C.seeded_files(spark, d), list(P.LINE_PACKS.values())
    # packs of the raw text read files that nothing decodes; the others and the rules share one pass, so a text is decoded once
    raw = scan.scan_packs(files, [p for p in packs if not p.analysis])
    decoded = scan.scan_packs(flow.with_analysis(files), [p for p in packs if p.analysis], R.default_rules())
    return raw.unionByName(decoded).select("skill_id", "path", "line_no", "rule_id", "severity", "label")
