"""Queries: context-window rules and declared-versus-observed comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import LICENSE_NOTICE, LICENSE_NOTICE_BLOCKERS, LICENSE_SIGNALS, LICENSE_WORDS
from ..functions import paths as FP
from ..operators import behavior as B
from ..operators import context, scan, sets
from ..operators import packs as P
from ..sources import artifacts
from . import corpus as C
from . import sqltext as S
from .q_scan import _CLS, _uncertain
from .registry import query
from .stage import observed_of

HIT = "skill_id:str path:str line_no:int rule_id:str severity:str label:str"


def _window(radius: int) -> str:
    """Lower-cased text of line_no ± radius from the file's line list."""
    return f"lower(array_to_string(ls[greatest(line_no - {radius}, 1) : least(line_no + {radius}, len(ls))], chr(10)))"


def _context_sql(r: P.ContextRule, lines: str = "l", files: str = "f") -> str:
    gate = [S.code_line("line")] + [S.any_in("lower(line)", g) for g in r.action]
    if r.skip_log_only:
        gate.append("NOT " + S.log_only("line"))
    need = S.any_in("w", r.window_required) if r.window_required else "TRUE"
    scope = S.any_in("w" if r.scope_in_window else "lower(line)", r.scope)
    return f"""c0 AS (SELECT {lines}.skill_id, {lines}.path, line_no, line, {_window(r.radius)} AS w FROM {lines} JOIN {files} ON {lines}.skill_id = {files}.skill_id AND {lines}.path = {files}.path WHERE {' AND '.join(gate)}),
  c1 AS (SELECT skill_id, path, line_no, {S.any_in('w', r.control)} AS guarded, {scope} AS scoped FROM c0 WHERE {need}),
  c2 AS (SELECT *, bool_or(guarded) OVER (PARTITION BY skill_id) AS g, bool_or(scoped) OVER (PARTITION BY skill_id) AS any_scoped,
    bool_or(scoped) OVER (PARTITION BY skill_id ORDER BY path, line_no ROWS UNBOUNDED PRECEDING) AS sticky FROM c1)
  SELECT skill_id, path, line_no, {S.s(r.rule_id)} AS rule_id, {f"CASE WHEN sticky THEN {S.s(r.scoped_severity)} ELSE {S.s(r.severity)} END" if r.scoped_severity else S.s(r.severity)} AS severity, {S.s(r.key)} AS label,
    CASE WHEN any_scoped THEN {r.factor_scoped} ELSE {r.factor_plain} END AS score_factor FROM c2 WHERE NOT g"""


def _register(r: P.ContextRule) -> None:
    @query("context_" + r.key, HIT + " score_factor:float", f"WITH {S.SEED_LINES}, {_context_sql(r)}")
    def run(spark, d):
        return context.scan_context(C.seeded_files(spark, d), r)


for _r in P.CONTEXT_RULES.values():
    _register(_r)

# the leak rule over the real texts with words they hold
_WORD_RULE = P.ContextRule("watched_context", "V7-017", "medium", 1, (("token", "license", "data"), (" the ", " de ", " der ", "of ")), ("hash", "copyright"), ("http", "src"), 0.35, 0.6)
_DOC_F = "doc_f AS (SELECT source AS skill_id, 'scripts/doc_' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents)"


@query("context_rule_leak", HIT + " score_factor:float", f"WITH {S.DOC_LINES}, {_DOC_F}, {_context_sql(_WORD_RULE, 'doc_l', 'doc_f')}")
def context_rule_leak(spark, d):
    return context.scan_context(C.document_files(spark, d), _WORD_RULE)


_PAGE_RULE = P.ContextRule("watched_pages", "V7-014", "medium", 3, (("<a href", "<script"),), ("allowlist", "zz-none"), ("track(", "10."), 0.25, 0.55, window_required=("<title", "nav"), scope_in_window=True, scoped_severity="high")


@query("context_rule_ssrf", HIT + " score_factor:float", f"WITH {S.PAGE_FILES}, page_ff AS (SELECT skill_id, path, string_split(content, chr(10)) AS ls FROM page_f), {_context_sql(_PAGE_RULE, 'page_l', 'page_ff')}")
def context_rule_ssrf(spark, d):
    """The request rule's shape (window words, sticky scope) over the pages."""
    return context.scan_context(C.page_files(spark, d), _PAGE_RULE)


_CAND = f"({S.code_line('w')} AND NOT ({S.any_in('w', LICENSE_NOTICE)} AND NOT {S.any_in('w', LICENSE_NOTICE_BLOCKERS)}) AND {S.any_in('w', LICENSE_WORDS)} AND {S.any_in('w', LICENSE_SIGNALS)})"


def _license_sql(lines: str, files: str) -> str:
    return f"""c0 AS (SELECT {lines}.skill_id, {lines}.path, line_no, {_window(2)} AS w FROM {lines} JOIN {files} ON {lines}.skill_id = {files}.skill_id AND {lines}.path = {files}.path WHERE {S.code_line('line')} AND NOT {S.low_signal(lines + '.path')})
  SELECT * FROM (SELECT skill_id, path, line_no, 'V7-005' AS rule_id, 'high' AS severity, CASE WHEN {_CAND} AND {S.rx('w', P.LICENSE_LOCAL_RX)} THEN 'local or plain license server' WHEN {_CAND} AND {S.rx('w', P.LICENSE_BYPASS_RX)} THEN 'license failure bypass'
    WHEN {S.rx('w', P.LICENSE_FIXED_RX)} THEN 'license check fixed to success' END AS label FROM c0) WHERE label IS NOT NULL"""


@query("license_config", HIT, f"WITH {S.SEED_LINES}, {_license_sql('l', 'f')}")
def license_config(spark, d):
    return context.license_config(C.seeded_files(spark, d))


@query("license_config_documents", HIT, f"WITH {S.DOC_LINES}, {_DOC_F}, {_license_sql('doc_l', 'doc_f')}")
def license_config_documents(spark, d):
    return context.license_config(C.document_files(spark, d))


@query("cors_wildcard", HIT, f"""WITH {S.SEED_LINES}, c0 AS (SELECT l.skill_id, l.path, line_no, array_to_string(ls[greatest(line_no - 4, 1) : least(line_no + 4, len(ls))], chr(10)) AS w FROM l JOIN f ON l.skill_id = f.skill_id AND l.path = f.path WHERE {S.code_line('line')} AND NOT {S.low_signal('l.path')})
  SELECT skill_id, path, min(line_no) AS line_no, 'V7-023' AS rule_id, 'medium' AS severity, 'cors wildcard with credentials' AS label FROM c0 WHERE {S.rx('w', P.CORS_WILDCARD_RX)} AND {S.rx('w', P.CORS_CREDENTIALS_RX)} AND NOT {S.rx('w', P.CORS_GUARD_RX)} GROUP BY 1, 2""")
def cors_wildcard(spark, d):
    return context.cors_wildcard(C.seeded_files(spark, d))


# --- set comparison ------------------------------------------------------------------------------

def _declared_sql(decl: str, flags: dict[str, list[str]]) -> str:
    return f"""dc AS (SELECT skill_id, {', '.join(f'bool_or({S.any_in("t", k)}) AS {n}' for n, k in flags.items())} FROM (SELECT skill_id, lower(content) AS t FROM f WHERE {decl} UNION ALL SELECT skill_id, lower(name || chr(10) || description) FROM sk) GROUP BY 1)"""


@query("intent_alignment", HIT, f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_declared_sql(f"(lower({S.base('path')}) = 'skill.md' OR starts_with(lower({S.base('path')}), 'readme'))", {'command': P.DECLARES['command'], 'network': P.DECLARES['network'], 'sensitive': P.DECLARES['sensitive_alignment']})},
  h AS (SELECT l.skill_id, l.path, l.line_no, unnest([CASE WHEN {_CLS['command']} AND NOT coalesce(dc.command, FALSE) THEN 0 END, CASE WHEN {_CLS['network']} AND NOT coalesce(dc.network, FALSE) THEN 1 END,
    CASE WHEN {_CLS['secrets']} AND {S.code_line('line')} AND NOT coalesce(dc.sensitive, FALSE) THEN 2 END]) AS cap FROM l LEFT JOIN dc ON l.skill_id = dc.skill_id WHERE {S.production('l.path')})
  SELECT skill_id, path, line_no, 'V7-006' AS rule_id, 'high' AS severity, 'undeclared ' || (['command', 'network', 'sensitive'])[cap + 1] AS label FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY path, line_no, cap) AS rn FROM h WHERE cap IS NOT NULL) WHERE rn = 1""")
def intent_alignment(spark, d):
    return sets.intent_alignment(C.seeded_files(spark, d), C.seeded_skills(spark, d))


_AUDIT_FLAGS = {"d_sensitive": P.DECLARES["sensitive_audit"], "d_network": P.DECLARES["network"], "d_command": P.DECLARES["command"], "d_destructive": P.DECLARES["destructive"]}
_AUDIT_TESTS = [
    ("reverse_shell", "FALSE", "high", f"sc AND {S.code_line('line')} AND {S.rx('line', P.REVERSE_SHELL_RX)}"), ("persistence_or_c2", "FALSE", "high", f"sc AND {_CLS['c2']}"),
    ("undeclared_sensitive_access", "d_sensitive", "high", f"sc AND {S.code_line('line')} AND {_CLS['secrets']}"), ("undeclared_network", "d_network", "high", f"sc AND {_CLS['network']}"),
    ("undeclared_command", "d_command", "high", f"sc AND {_CLS['command']}"), ("undeclared_destructive", "d_destructive", "high", f"sc AND {_CLS['destructive']}"),
    ("declared_override", "FALSE", "medium", f"de AND {S.rx('line', P.DECLARED_OVERRIDE_RX)}"),
]


@query("skill_audit", HIT, f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_declared_sql(S.declaration('path'), _AUDIT_FLAGS)}, m AS (SELECT DISTINCT skill_id FROM f WHERE lower({S.base('path')}) = 'skill.md'),
  x AS (SELECT l.*, {S.script('path')} AS sc, {S.declaration('path')} AS de FROM l WHERE skill_id IN (SELECT skill_id FROM m)),
  h AS (SELECT x.*, dc.* EXCLUDE (skill_id) FROM x LEFT JOIN dc ON x.skill_id = dc.skill_id WHERE sc OR de) """ + " UNION ALL ".join(
    f"SELECT skill_id, path, line_no, 'V7-006' AS rule_id, '{sev}' AS severity, '{lab}' AS label FROM h WHERE {t} AND NOT coalesce({f}, FALSE)" for lab, f, sev, t in _AUDIT_TESTS))
def skill_audit(spark, d):
    return sets.skill_audit(C.seeded_files(spark, d), C.seeded_skills(spark, d))


_PLUG_MUTE = {"undeclared_sensitive_access": "d_sensitive", "undeclared_network": "d_network", "undeclared_command": "d_command", "undeclared_destructive": "d_destructive"}


@query("plugin_audit", HIT, f"""WITH {S.SEED_LINES}, dc AS (SELECT skill_id, {', '.join(f'bool_or({S.any_in("lower(content)", k)}) AS {n}' for n, k in _AUDIT_FLAGS.items())} FROM f WHERE path = 'SKILL.md' GROUP BY 1),
  h AS (SELECT l.*, dc.* EXCLUDE (skill_id) FROM l JOIN dc ON l.skill_id = dc.skill_id WHERE starts_with(lower(path), 'scripts/') AND {S.ext('path')} IN ({', '.join(S.s(x) for x in FP.PLUGIN_SCRIPT_EXT)})
    AND {S.trim('line')} <> '' AND NOT starts_with({S.trim('line')}, '#') AND NOT starts_with({S.trim('line')}, '//')) """ + " UNION ALL ".join(
    f"SELECT skill_id, path, line_no, 'V7-006' AS rule_id, 'high' AS severity, '{k}' AS label FROM h WHERE {S.rx('line', r)} AND NOT coalesce({_PLUG_MUTE.get(k, 'FALSE')}, FALSE)" for k, r in P.PLUGIN_AUDIT_RX.items()))
def plugin_audit(spark, d):
    return sets.plugin_audit(C.seeded_files(spark, d))


def _pd_cells(low: str) -> str:
    at = lambda k: f"CASE WHEN contains({low}, {S.s(k)}) THEN len(substr({low}, 1, instr({low}, {S.s(k)}) - 1)) - len(replace(substr({low}, 1, instr({low}, {S.s(k)}) - 1), chr(10), '')) + 1 END"
    return "[" + ", ".join("{'label': %s, 'line_no': coalesce(%s)}" % (S.s(lab), ", ".join(at(k) for k in keys)) for lab, keys in P.PERSONAL_DATA.items()) + "]"


@query("scan_personal_data", "skill_id:str path:str label:str line_no:int", f"""WITH {S.SEED_LINES}, c AS (SELECT skill_id, path, unnest({_pd_cells('lower(content)')}) AS u FROM f) SELECT skill_id, path, u.label AS label, u.line_no AS line_no FROM c WHERE u.line_no IS NOT NULL""")
def scan_personal_data(spark, d):
    return sets.personal_data(C.seeded_files(spark, d))


_DM = f"""pd AS (SELECT skill_id, path, unnest({_pd_cells('lower(content)')}) AS u FROM f), ob AS (SELECT skill_id, label, path, line_no FROM (SELECT skill_id, u.label AS label, path, u.line_no AS line_no, row_number() OVER (PARTITION BY skill_id, u.label ORDER BY path, u.line_no) AS rn FROM pd WHERE u.line_no IS NOT NULL) WHERE rn = 1),
  de AS (SELECT skill_id, unnest([{', '.join(f"CASE WHEN {S.any_in('lower(description)', k)} THEN {S.s(n)} END" for n, k in P.PERSONAL_DATA.items())}]) AS label FROM sk),
  dm AS (SELECT coalesce(ob.skill_id, de.skill_id) AS skill_id, coalesce(ob.label, de.label) AS label, de.label IS NOT NULL AS declared, ob.label IS NOT NULL AS observed, ob.label IS NOT NULL AND de.label IS NULL AS extra, path, line_no
    FROM ob FULL JOIN (SELECT * FROM de WHERE label IS NOT NULL) de ON ob.skill_id = de.skill_id AND ob.label = de.label)"""


@query("data_minimization", "skill_id:str label:str declared:bool observed:bool extra:bool path:str line_no:int", f"WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_DM} SELECT * FROM dm")
def data_minimization(spark, d):
    return sets.data_minimization(C.seeded_files(spark, d), C.seeded_skills(spark, d))


@query("data_minimization_summary", "skill_id:str declared:str observed:str extra:str severity:str score_factor:float", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_DM} SELECT *, CASE WHEN extra <> '' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN extra <> '' THEN 0.4 ELSE 1.0 END AS score_factor FROM (
  SELECT skill_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (declared), '') AS declared, coalesce(string_agg(label, ',' ORDER BY label) FILTER (observed), '') AS observed, coalesce(string_agg(label, ',' ORDER BY label) FILTER (extra), '') AS extra FROM dm GROUP BY 1)""")
def data_minimization_summary(spark, d):
    return sets.data_minimization_summary(sets.data_minimization(C.seeded_files(spark, d), C.seeded_skills(spark, d)))


_IRR = " UNION ALL ".join(f"SELECT skill_id, path, line_no, {S.s(n)} AS op, {c} AS conf, {S.rx('lower(line)', P.IRREVERSIBLE_SCOPE_RX)} AS ls FROM l WHERE {S.code_line('line')} AND NOT {S.log_only('line')} AND {S.rx('lower(line)', r)}" for n, c, r in P.IRREVERSIBLE_ACTIONS)


@query("irreversible_ops", "skill_id:str ops:str n_effective:int has_scope:bool path:str line_no:int rule_id:str severity:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, h AS ({_IRR}),
  ap AS (SELECT skill_id FROM sk WHERE {S.any_in('lower(description)', P.APPROVAL_MARKERS)} UNION SELECT skill_id FROM l WHERE {S.code_line('line')} AND {S.any_in('lower(line)', P.APPROVAL_MARKERS)}),
  e AS (SELECT h.*, ls OR {S.rx('lower(description)', P.IRREVERSIBLE_SCOPE_RX)} AS scoped FROM h JOIN sk ON h.skill_id = sk.skill_id WHERE h.skill_id NOT IN (SELECT skill_id FROM ap)),
  g AS (SELECT skill_id, string_agg(DISTINCT op, ',' ORDER BY op) AS ops, count(*) FILTER (conf >= 2 OR scoped) AS n_effective, bool_or((conf >= 2 OR scoped) AND scoped) AS has_scope, min({{'p': path, 'n': line_no}}) FILTER (conf >= 2 OR scoped) AS loc FROM e GROUP BY 1)
  SELECT skill_id, ops, n_effective, has_scope, loc.p AS path, loc.n AS line_no, 'V7-019' AS rule_id, 'high' AS severity FROM g WHERE n_effective > 0""")
def irreversible_ops(spark, d):
    return sets.irreversible_ops(C.seeded_files(spark, d), C.seeded_skills(spark, d))


_PEN = "CASE p " + " ".join(f"WHEN {S.s(k)} THEN {v}" for k, v in P.PERMISSION_PENALTY.items()) + " ELSE 0 END"


@query("permission_excess", "skill_id:str score:int excessive:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, p AS (SELECT skill_id, unnest(permissions) AS p FROM sk)
  SELECT skill_id, greatest(20 - sum({_PEN}), 0) AS score, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (p IN ('root', 'administrator', '/**', '0.0.0.0')), '') AS excessive FROM p GROUP BY 1""")
def permission_excess(spark, d):
    return sets.permission_excess(C.seeded_skills(spark, d).select("skill_id", F.explode("permissions").alias("permission")))


_DEPS = r"""dep AS (SELECT DISTINCT skill_id, name, version FROM (
  SELECT skill_id, unnest(json_keys(content, '$.dependencies')) AS name, unnest(json_extract_string(content, '$.dependencies.*')) AS version FROM man_f WHERE path = 'package.json'
  UNION ALL SELECT skill_id, regexp_extract(t, '^(?:require\s+)?(\S+)\s+v\S+', 1), regexp_extract(t, '\s(v\S+)$', 1) FROM (SELECT skill_id, trim(regexp_replace(line, '//.*$', ''), chr(9) || ' ') AS t FROM man_l WHERE path = 'go.mod') WHERE regexp_matches(t, '^(?:require\s+)?\S+\s+v\S+$')))"""


@query("dependencies", "skill_id:str name:str version:str", f"WITH {S.SEED_LINES}, {_DEPS} SELECT * FROM dep")
def dependencies(spark, d):
    return artifacts.extract_dependencies(C.seeded_files(spark, d))


@query("dependency_risk", "skill_id:str score:int n_risky:int", f"""WITH {S.SEED_LINES}, {_DEPS}, c AS (SELECT skill_id, CASE WHEN version = '' OR starts_with(version, '0.0.0') OR contains(name, 'malicious') THEN 20 WHEN contains(name, 'typo') THEN 15 ELSE 0 END AS c FROM dep)
  SELECT skill_id, greatest(20 - sum(c), 0) AS score, count(*) FILTER (c > 0) AS n_risky FROM c GROUP BY 1""")
def dependency_risk(spark, d):
    return sets.dependency_risk(artifacts.extract_dependencies(C.seeded_files(spark, d)))


@query("version_locking_deps", "skill_id:str name:str version:str", f"WITH {S.SEED_LINES}, {_DEPS} SELECT * FROM dep WHERE {_uncertain('version')}")
def version_locking_deps(spark, d):
    return scan.version_locking_deps(artifacts.extract_dependencies(C.seeded_files(spark, d)))


_SENT = rf"""st AS (SELECT skill_id, x FROM (SELECT skill_id, {S.trim("regexp_replace(" + S.trim("p") + ", '^[#>*\\- `\\t]+', '')")} AS x FROM (SELECT skill_id, unnest(regexp_split_to_array(replace(description, chr(13) || chr(10), chr(10)), '[\n。；;]+')) AS p FROM sk)) WHERE x <> ''),
  itx AS (SELECT skill_id, lower(x) AS x, {S.any_in('lower(x)', P.INTENT_INJECTION)} AS bad, TRUE AS sent FROM st UNION ALL SELECT skill_id, lower(p), FALSE, FALSE FROM (SELECT skill_id, unnest(permissions) AS p FROM sk)),
  di AS (SELECT sk.skill_id, sk.description, sk.permissions, coalesce(bool_or(bad), FALSE) AS unsafe, {', '.join(f'coalesce(bool_or(NOT bad AND {S.any_in("x", k)}), FALSE) AS {n}' for n, k in P.INTENT_SIGNALS.items())} FROM sk LEFT JOIN itx ON sk.skill_id = itx.skill_id GROUP BY ALL)"""


@query("declared_intent", "skill_id:str unsafe:bool network:bool file:bool exec:bool data:bool external_deps:bool", f"WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_SENT} SELECT * EXCLUDE (description, permissions) FROM di")
def declared_intent(spark, d):
    return sets.declared_intent(C.seeded_skills(spark, d))


def observed_flags(spark, d):
    """Behaviour flags per skill from one pass over the seeded corpus."""
    return observed_of(B.behavior_facts(C.seeded_files(spark, d)))


_SIGL = f"sl AS (SELECT * FROM l WHERE {S.signal_file('path')} AND {S.code_line('line')})"
_OBS = f"""{_SIGL}, ob AS (SELECT skill_id, bool_or({S.rx('line', P.URL_RX)} OR {S.rx('line', P.IPV4_RX)}) AS network_targets, bool_or(contains(line, 'open(') OR contains(line, 'os.ReadFile') OR contains(line, 'os.WriteFile')) AS file_targets,
  bool_or({S.rx('line', P.PROCESS_START_RX)}) AS exec_targets, bool_or({S.rx('line', P.BEHAVIOR_RX['collection'])}) AS collection, bool_or({S.rx('line', P.BEHAVIOR_RX['download'])}) AS download,
  bool_or({S.rx('line', P.BEHAVIOR_RX['outbound'])} OR {S.rx('line', P.URL_RX)} OR {S.rx('line', P.IPV4_RX)}) AS outbound, bool_or({S.rx('line', P.PROCESS_START_RX)}) AS execute,
  bool_or({S.rx('line', P.CREDENTIAL_PATH_RX)} OR ({S.rx('line', P.CREDENTIAL_ACCESS_RX)} AND {S.rx('line', P.CREDENTIAL_SECRET_RX)})) AS credential FROM sl GROUP BY 1)"""
_DIFF = """dj AS (SELECT di.*, coalesce(network_targets, FALSE) AS nt, coalesce(file_targets, FALSE) AS ft, coalesce(exec_targets, FALSE) AS et, coalesce(collection, FALSE) AS co, coalesce(download, FALSE) AS dl FROM di LEFT JOIN ob ON di.skill_id = ob.skill_id
    WHERE NOT (trim(description) = '' AND len(permissions) = 0)),
  df AS (SELECT skill_id, 'unsafe_declaration_prompt' AS diff, 20 AS penalty FROM dj WHERE unsafe UNION ALL SELECT skill_id, 'unexpected_network', 25 FROM dj WHERE nt AND NOT network UNION ALL SELECT skill_id, 'unexpected_file', 20 FROM dj WHERE ft AND NOT file
    UNION ALL SELECT skill_id, 'unexpected_exec', 30 FROM dj WHERE et AND NOT exec UNION ALL SELECT skill_id, 'unexpected_data_collection', 25 FROM dj WHERE co AND NOT data UNION ALL SELECT skill_id, 'unexpected_external_dependency', 25 FROM dj WHERE dl AND NOT external_deps)"""


@query("intent_diffs", "skill_id:str diff:str penalty:int", f"WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_SENT}, {_OBS}, {_DIFF} SELECT * FROM df")
def intent_diffs(spark, d):
    return sets.intent_diffs(C.seeded_skills(spark, d), observed_flags(spark, d))


@query("intent_score", "skill_id:str intent_score:int n_diffs:int high_risk_diff:bool", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_SENT}, {_OBS}, {_DIFF} SELECT sk.skill_id, greatest(100 - coalesce(sum(penalty), 0), 0) AS intent_score, count(diff) AS n_diffs,
  coalesce(bool_or(diff IN ({', '.join(S.s(x) for x in P.HIGH_RISK_DIFFS)})), FALSE) AS high_risk_diff FROM sk LEFT JOIN df ON sk.skill_id = df.skill_id GROUP BY 1""")
def intent_score(spark, d):
    return sets.intent_score(C.seeded_skills(spark, d), observed_flags(spark, d))


@query("capability_signals", "skill_id:str signal:str", f"WITH {S.SEED_LINES} " + " UNION ".join(f"SELECT DISTINCT skill_id, {S.s(n)} AS signal FROM f WHERE {S.any_in('lower(content)', t)}" for n, t in P.CAPABILITY_SIGNALS.items()))
def capability_signals(spark, d):
    return sets.capability_signals(C.seeded_files(spark, d))


@query("declared_capabilities", "skill_id:str capabilities:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS} SELECT skill_id, concat_ws(',', CASE WHEN {S.any_in('lower(description)', ['网络', 'http', 'api'])} THEN 'network_access' END,
  CASE WHEN {S.any_in('lower(description)', ['文件', '上传', '解析'])} THEN 'file_read' END, CASE WHEN {S.any_in('lower(description)', ['命令', 'shell', '执行'])} THEN 'command_exec' END) AS capabilities FROM sk""")
def declared_capabilities(spark, d):
    return C.seeded_skills(spark, d).select("skill_id", F.array_join(sets.declared_capabilities(F.col("description")), ",").alias("capabilities"))


@query("skill_profile", "skill_id:str file_count:int declaration_count:int dependency_count:int language_summary:str", f"""WITH {S.SEED_LINES}, {_DEPS},
  lg AS (SELECT skill_id, {S.declaration('path')} AS d, CASE WHEN {S.base('path')} = 'go.mod' THEN 'gomod' WHEN {S.base('path')} = 'package.json' THEN 'json' ELSE (MAP {{{', '.join(S.s(k) + ': ' + S.s(v) for k, v in FP.LANGUAGE_BY_EXT.items())}}})[CASE WHEN {S.ext('path')} = '.md' AND NOT {S.declaration('path')} THEN '-' ELSE {S.ext('path')} END] END AS lang FROM f),
  c AS (SELECT skill_id, lang, count(*) AS n, count(*) FILTER (d) AS d FROM lg GROUP BY 1, 2)
  SELECT c.skill_id, sum(n) AS file_count, sum(d) AS declaration_count, coalesce(any_value(k), 0) AS dependency_count, string_agg(lang || ':' || n, ',' ORDER BY lang || ':' || n) AS language_summary FROM c LEFT JOIN (SELECT skill_id, count(*) AS k FROM dep GROUP BY 1) x ON c.skill_id = x.skill_id GROUP BY 1""")
def skill_profile(spark, d):
    files = C.seeded_files(spark, d)
    return sets.skill_profile(files, artifacts.extract_dependencies(files))


@query("skill_description", "skill_id:str description:str", f"""WITH {S.SEED_LINES}, md AS (SELECT skill_id, path, {S.trim('content')} AS body, CASE lower({S.base('path')}) WHEN 'skill.md' THEN 0 WHEN 'readme.md' THEN 1 WHEN 'description.md' THEN 2 WHEN 'manifest.md' THEN 2 ELSE 3 END AS prio FROM f WHERE {S.ext('path')} = '.md'),
  r AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY prio, path) AS rn FROM md WHERE body <> '') SELECT skill_id, string_agg({S.base('path')} || ':' || chr(10) || body, chr(10) || chr(10) ORDER BY rn) AS description FROM r GROUP BY 1""")
def skill_description(spark, d):
    return sets.skill_description(C.seeded_files(spark, d))
