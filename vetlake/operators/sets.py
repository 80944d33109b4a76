"""Declared-versus-observed comparisons at skill level.

Declarations and observations are reduced to one small row per skill (or per skill and
capability) by partial aggregation before any join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name, file_ext, is_declaration, is_low_signal_path, is_plugin_script, is_production_source, is_script
from ..functions.text import any_of, contains_any, has_any, is_code_line, is_log_only_line, matches, ws_trim
from . import packs as P
from .scan import analysis_text, calls_network, destroys_data, explode_lines, explode_tests, pattern_lines, persists_or_beacons, runs_command, touches_secrets


def _declared(files: DataFrame, skills: DataFrame | None, is_decl: Column, flags: dict[str, list[str]]) -> DataFrame:
    """One row per skill with a boolean per capability declared in its name, description or declaration files."""
    low = F.lower(analysis_text(files))
    parts = files.where(is_decl).select("skill_id", *[has_any(low, keys).alias(k) for k, keys in flags.items()])
    if skills is not None:
        text = F.lower(F.concat_ws("\n", "name", "description"))
        parts = parts.unionByName(skills.select("skill_id", *[has_any(text, keys).alias(k) for k, keys in flags.items()]))
    return parts.groupBy("skill_id").agg(*[F.bool_or(k).alias(k) for k in flags])


ALIGNMENT = ["command", "network", "sensitive"]  # order in which a line is tested


def intent_alignment(files: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """First production line showing an undeclared capability; one high finding per skill."""
    base = F.lower(base_name(F.col("path")))
    flags = {"command": P.DECLARES["command"], "network": P.DECLARES["network"], "sensitive": P.DECLARES["sensitive_alignment"]}
    declared = _declared(files, skills, (base == "skill.md") | base.startswith("readme"), flags)
    src = files.where(is_production_source(F.col("path")))
    line = F.col("line")
    tests = {"command": runs_command(line), "network": calls_network(line), "sensitive": touches_secrets(line) & is_code_line(line)}
    seen = (
        explode_tests(explode_lines(src, analysis_text(src)), [(tests[k], F.lit(i)) for i, k in enumerate(ALIGNMENT)], ["skill_id", "path", "line_no"], "cap")
        .groupBy("skill_id", "cap").agg(F.min(F.struct("path", "line_no")).alias("at"))
    )
    undeclared = any_of((F.col("cap") == i) & ~F.coalesce(F.col(k), F.lit(False)) for i, k in enumerate(ALIGNMENT))
    return (
        seen.join(declared, "skill_id", "left").where(undeclared)
        .groupBy("skill_id").agg(F.min(F.struct("at.path", "at.line_no", "cap")).alias("m"))
        .select("skill_id", F.col("m.path").alias("path"), F.col("m.line_no").alias("line_no"), F.lit("V7-006").alias("rule_id"),
                F.lit("high").alias("severity"),
                F.concat(F.lit("undeclared "), F.element_at(F.array(*[F.lit(k) for k in ALIGNMENT]), F.col("m.cap") + 1)).alias("label"))
    )


def _manifested(files: DataFrame, skills: DataFrame | None) -> DataFrame:
    has = files.where(F.lower(base_name(F.col("path"))) == "skill.md").select("skill_id")
    if skills is not None:
        has = has.union(skills.where(F.lower("description").contains("skill.md:")).select("skill_id"))
    return has.distinct()


def skill_audit(files: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """All audit hits of skills with a manifest; capabilities the declaration names are muted."""
    flags = {k: P.DECLARES[v] for k, v in
             {"d_sensitive": "sensitive_audit", "d_network": "network", "d_command": "command", "d_destructive": "destructive"}.items()}
    declared = _declared(files, skills, is_declaration(F.col("path")), flags)
    src = files.select("skill_id", "path", analysis_text(files).alias("_text"), is_script(F.col("path")).alias("script"), is_declaration(F.col("path")).alias("decl"),
                       is_low_signal_path(F.col("path")).alias("low")).where((F.col("script") | F.col("decl")) & (F.col("decl") | ~F.col("low")))
    lines = explode_lines(src, F.col("_text"), ["skill_id", "path", "script", "decl"])
    line, script = F.col("line"), F.col("script")
    code = is_code_line(line)
    tests = [  # label, mute flag, severity, test
        ("reverse_shell", None, "high", script & code & matches(line, P.REVERSE_SHELL_RX)),
        ("persistence_or_c2", None, "high", script & persists_or_beacons(line)),
        ("undeclared_sensitive_access", "d_sensitive", "high", script & code & touches_secrets(line)),
        ("undeclared_network", "d_network", "high", script & calls_network(line)),
        ("undeclared_command", "d_command", "high", script & runs_command(line)),
        ("undeclared_destructive", "d_destructive", "high", script & destroys_data(line)),
        ("declared_override", None, "medium", F.col("decl") & (~script | code) & matches(line, P.DECLARED_OVERRIDE_RX)),
    ]
    return _audit(lines, tests, declared, _manifested(files, skills))


def plugin_audit(files: DataFrame) -> DataFrame:
    """Package-plugin variant: top-level ``scripts/`` of the narrow extension list, declaration = SKILL.md only."""
    base = F.lower(base_name(F.col("path")))
    flags = {k: P.DECLARES[v] for k, v in
             {"d_sensitive": "sensitive_audit", "d_network": "network", "d_command": "command", "d_destructive": "destructive"}.items()}
    manifest = F.col("path") == "SKILL.md"
    declared = _declared(files.select("skill_id", "path", "content"), None, manifest, flags)
    src = files.where(is_plugin_script(F.col("path")) & (base != "skill.md"))
    lines = explode_lines(src)
    t = ws_trim(F.col("line"))
    code = (t != "") & ~t.startswith("#") & ~t.startswith("//")
    mute = {"undeclared_sensitive_access": "d_sensitive", "undeclared_network": "d_network", "undeclared_command": "d_command",
            "undeclared_destructive": "d_destructive"}
    tests = [(k, mute.get(k), "high", matches(F.col("line"), rx) & code) for k, rx in P.PLUGIN_AUDIT_RX.items()]
    return _audit(lines, tests, declared, files.where(manifest).select("skill_id").distinct())


def _audit(lines: DataFrame, tests: list, declared: DataFrame, eligible: DataFrame) -> DataFrame:
    values = [(test, F.struct(F.lit(label).alias("label"), F.lit(sev).alias("severity"))) for label, _, sev, test in tests]
    hits = explode_tests(lines, values, ["skill_id", "path", "line_no"]).select("skill_id", "path", "line_no", "h.label", "h.severity")
    muted = any_of((F.col("label") == label) & F.coalesce(F.col(flag), F.lit(False)) for label, flag, _, _ in tests if flag)
    return (
        hits.join(eligible, "skill_id", "left_semi").join(declared, "skill_id", "left").where(~muted)
        .select("skill_id", "path", "line_no", F.lit("V7-006").alias("rule_id"), "severity", "label")
    )


def _line_of(low: Column, key: str) -> Column:
    """Line number of the first occurrence of ``key`` in the text."""
    head = F.substring(low, F.lit(1), F.locate(key, low) - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def personal_data(files: DataFrame) -> DataFrame:
    """Per file and label: the line of the label's first matching keyword."""
    low = F.lower(F.col("_t"))
    cells = []
    for label, keys in P.PERSONAL_DATA.items():
        at = F.when(low.contains(keys[0]), _line_of(low, keys[0]))
        for k in keys[1:]:
            at = at.when(low.contains(k), _line_of(low, k))
        cells.append(F.struct(F.lit(label).alias("label"), at.alias("line_no")))
    src = files.select("skill_id", "path", analysis_text(files).alias("_t"))
    return src.select("skill_id", "path", F.explode(F.filter(F.array(*cells), lambda s: s["line_no"].isNotNull())).alias("s")).select(
        "skill_id", "path", "s.label", "s.line_no")


def data_minimization(files: DataFrame, skills: DataFrame) -> DataFrame:
    """Observed personal-data labels per skill with first evidence; undeclared ones are extra."""
    observed = personal_data(files).groupBy("skill_id", "label").agg(F.min(F.struct("path", "line_no")).alias("at"))
    low = F.lower("description")
    declared = skills.select("skill_id", F.explode(F.array_compact(F.array(*[F.when(has_any(low, keys), F.lit(k)) for k, keys in P.PERSONAL_DATA.items()]))).alias("label")).distinct()
    declared = declared.withColumn("declared", F.lit(True))
    both = observed.join(declared, ["skill_id", "label"], "full_outer")
    return both.select(
        "skill_id", "label", F.coalesce("declared", F.lit(False)).alias("declared"), F.col("at").isNotNull().alias("observed"),
        (F.col("at").isNotNull() & F.col("declared").isNull()).alias("extra"), F.col("at.path").alias("path"), F.col("at.line_no").alias("line_no"))


def data_minimization_summary(compared: DataFrame) -> DataFrame:
    """One finding per skill: medium with extra labels (score × 0.4), else low."""
    return compared.groupBy("skill_id").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("declared"), F.col("label"))))).alias("declared"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("observed"), F.col("label"))))).alias("observed"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("extra"), F.col("label"))))).alias("extra"),
    ).withColumn("severity", F.when(F.col("extra") != "", F.lit("medium")).otherwise(F.lit("low"))).withColumn(
        "score_factor", F.when(F.col("extra") != "", F.lit(0.4)).otherwise(F.lit(1.0)))


def irreversible_ops(files: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills with irreversible actions and no approval marker anywhere: one finding each.

    Confidence-1 actions count only with an affected scope on the line or in the description.
    """
    desc = skills.select("skill_id", matches(F.lower("description"), P.IRREVERSIBLE_SCOPE_RX).alias("desc_scope"),
                         contains_any(F.col("description"), P.APPROVAL_MARKERS).alias("approved"))
    low = F.lower(ws_trim(F.col("line")))
    tests = [(matches(low, rx), F.struct(F.lit(label).alias("op"), F.lit(conf).alias("conf"))) for label, conf, rx in P.IRREVERSIBLE_ACTIONS]
    lines = pattern_lines(files, [rx for _, _, rx in P.IRREVERSIBLE_ACTIONS])
    hits = explode_tests(lines, tests, ["skill_id", "path", "line_no", "line"], "c").where(is_code_line(F.col("line")) & ~is_log_only_line(F.col("line")))
    hits = hits.withColumn("line_scope", matches(low, P.IRREVERSIBLE_SCOPE_RX))
    # reduced to at most (actions x scope) rows per skill before the join with descriptions
    per_op = hits.groupBy("skill_id", "c.op", "c.conf", "line_scope").agg(F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("at"))
    text = analysis_text(files)
    marked = pattern_lines(files, [f"(?i){re.escape(w)}" for w in P.APPROVAL_MARKERS], text, ["skill_id"]).where(
        contains_any(F.col("line"), P.APPROVAL_MARKERS) & is_code_line(F.col("line"))).select("skill_id").distinct()
    scoped = F.col("line_scope") | F.coalesce("desc_scope", F.lit(False))
    eff = F.when((F.col("conf") >= 2) | scoped, F.lit(True)).otherwise(F.lit(False))
    return (
        per_op.join(desc, "skill_id", "left").where(~F.coalesce("approved", F.lit(False))).join(marked, "skill_id", "left_anti")
        .withColumn("eff", eff).withColumn("scoped", scoped)
        .groupBy("skill_id").agg(
            F.concat_ws(",", F.sort_array(F.collect_set("op"))).alias("ops"),
            F.sum(F.when(F.col("eff"), F.col("n")).otherwise(0)).alias("n_effective"),
            F.bool_or(F.col("eff") & F.col("scoped")).alias("has_scope"),
            F.min(F.when(F.col("eff"), F.col("at"))).alias("at"),
        ).where("n_effective > 0")
        .select("skill_id", "ops", "n_effective", "has_scope", F.col("at.path").alias("path"), F.col("at.line_no").alias("line_no"),
                F.lit("V7-019").alias("rule_id"), F.lit("high").alias("severity"))
    )


def permission_excess(perms: DataFrame) -> DataFrame:
    """Score 20 minus the penalty of each permission row (floor 0) and the excessive ones.

    ``perms``: skill_id, permission.
    """
    table = F.create_map(*[F.lit(x) for kv in P.PERMISSION_PENALTY.items() for x in kv])
    return perms.groupBy("skill_id").agg(
        F.greatest(20 - F.sum(F.coalesce(F.element_at(table, F.col("permission")), F.lit(0))), F.lit(0)).alias("score"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("permission").isin(P.EXCESSIVE_PERMISSIONS), F.col("permission"))))).alias("excessive"),
    )


def dependency_risk(deps: DataFrame) -> DataFrame:
    """Score 20 minus 20 (no version, 0.0.0*, malicious) or 15 (typo) per dependency, floor 0."""
    v, n = F.coalesce("version", F.lit("")), F.col("name")
    cost = F.when((v == "") | v.startswith("0.0.0") | n.contains("malicious"), 20).when(n.contains("typo"), 15).otherwise(0)
    return deps.groupBy("skill_id").agg(F.greatest(20 - F.sum(cost), F.lit(0)).alias("score"), F.count_if(cost > 0).alias("n_risky"))


# --- declared intent ---------------------------------------------------------------------------

def declaration_parts(text: Column) -> Column:
    """Sentences of a declaration: split, markdown controls stripped."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[\n。；;]+", -1)
    strip = lambda p: ws_trim(F.regexp_replace(ws_trim(p), r"^[#>*\- `\t]+", ""))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _mentions(keys: list[str]):
    return lambda text: has_any(text, keys)


def declared_intent(skills: DataFrame) -> DataFrame:
    """Five declared flags and ``unsafe``; injection-like sentences are set aside and declare nothing.

    ``skills``: skill_id, description, permissions array<string>.
    """
    parts = F.transform(declaration_parts(F.coalesce("description", F.lit(""))), F.lower)
    safe = F.filter(parts, lambda p: ~has_any(p, P.INTENT_INJECTION))
    texts = F.concat(safe, F.transform(F.coalesce("permissions", F.array().cast("array<string>")), F.lower))
    df = skills.select("skill_id", "description", "permissions", texts.alias("_t"), F.exists(parts, lambda p: has_any(p, P.INTENT_INJECTION)).alias("unsafe"))
    return df.select("skill_id", "description", "permissions", "unsafe",
                     *[F.exists("_t", _mentions(keys)).alias(k) for k, keys in P.INTENT_SIGNALS.items()])


DIFF_RULES = [  # diff, observed column, declared column
    ("unexpected_network", "network_targets", "network"), ("unexpected_file", "file_targets", "file"),
    ("unexpected_exec", "exec_targets", "exec"), ("unexpected_data_collection", "collection", "data"),
    ("unexpected_external_dependency", "download", "external_deps"),
]


def intent_diffs(skills: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared-versus-observed differences: skill_id, diff, penalty.

    ``observed``: skill_id and the boolean columns named in ``DIFF_RULES``.
    """
    j = declared_intent(skills).join(observed, "skill_id", "left")
    silent = (ws_trim(F.coalesce("description", F.lit(""))) == "") & (F.size(F.coalesce("permissions", F.array())) == 0)
    cells = [F.when(F.col("unsafe"), F.lit("unsafe_declaration_prompt"))]
    cells += [F.when(F.coalesce(F.col(o), F.lit(False)) & ~F.col(d), F.lit(name)) for name, o, d in DIFF_RULES]
    table = F.create_map(*[F.lit(x) for kv in P.INTENT_PENALTY.items() for x in kv])
    return j.where(~silent).select("skill_id", F.explode(F.array_compact(F.array(*cells))).alias("diff")).withColumn("penalty", F.element_at(table, F.col("diff")))


def intent_score(skills: DataFrame, observed: DataFrame) -> DataFrame:
    """100 minus the penalties, floor 0; skills declaring nothing at all keep 100."""
    cost = intent_diffs(skills, observed).groupBy("skill_id").agg(F.sum("penalty").alias("p"), F.count("*").alias("n_diffs"),
                                                                 F.bool_or(F.col("diff").isin(P.HIGH_RISK_DIFFS)).alias("high_risk_diff"))
    return skills.select("skill_id").join(cost, "skill_id", "left").select(
        "skill_id", F.greatest(100 - F.coalesce("p", F.lit(0)), F.lit(0)).alias("intent_score"),
        F.coalesce("n_diffs", F.lit(0)).alias("n_diffs"), F.coalesce("high_risk_diff", F.lit(False)).alias("high_risk_diff"))


def capability_signals(files: DataFrame) -> DataFrame:
    """Distinct capability labels per skill by file keyword."""
    low = F.lower("content")
    cells = [F.when(has_any(low, terms), F.lit(label)) for label, terms in P.CAPABILITY_SIGNALS.items()]
    return files.select("skill_id", F.explode(F.array_compact(F.array(*cells))).alias("signal")).distinct()


def declared_capabilities(desc: Column) -> Column:
    """Capabilities named in a description, in fixed order."""
    low = F.lower(ws_trim(desc))
    return F.array_compact(F.array(
        F.when(has_any(low, ["网络", "http", "api"]), F.lit("network_access")),
        F.when(has_any(low, ["文件", "上传", "解析"]), F.lit("file_read")),
        F.when(has_any(low, ["命令", "shell", "执行"]), F.lit("command_exec")),
    ))


# Words by which a static finding implies a capability.
CROSS_CHECK = {
    "external": ["外联", "network", "http", "url", "c2", "远程"],
    "exec": ["执行", "command", "shell", "exec"],
    "credential": ["凭据", "credential", "token", "secret", "key"],
}


def cross_check(findings: DataFrame, observed: DataFrame) -> DataFrame:
    """Warnings where static findings imply behaviour that was not observed.

    ``findings``: skill_id, rule_id, title, description, code_snippet;
    ``observed``: skill_id, outbound, network_targets, execute, credential (booleans).
    """
    text = F.lower(F.concat_ws(" ", "rule_id", "title", "description", "code_snippet"))
    implied = findings.groupBy("skill_id").agg(*[F.bool_or(has_any(text, keys)).alias(k) for k, keys in CROSS_CHECK.items()])
    obs = observed.select("skill_id", (F.col("outbound") | F.col("network_targets")).alias("o_external"), F.col("execute").alias("o_exec"), F.col("credential").alias("o_credential"))
    cells = [F.when(F.col(k) & ~F.coalesce(F.col("o_" + k), F.lit(False)), F.lit(f"static {k} not observed")) for k in CROSS_CHECK]
    return implied.join(obs, "skill_id", "left").select("skill_id", F.explode(F.array_compact(F.array(*cells))).alias("warning"))


def skill_profile(files: DataFrame, deps: DataFrame) -> DataFrame:
    """File, declaration and dependency counts with the ``language:count`` summary per skill."""
    by_lang = files.groupBy("skill_id", "language").agg(F.count("*").alias("n"), F.count_if(is_declaration(F.col("path"))).alias("d"))
    label = F.when(ws_trim(F.coalesce("language", F.lit(""))) != "", F.concat("language", F.lit(":"), F.col("n").cast("string")))
    prof = by_lang.groupBy("skill_id").agg(F.sum("n").alias("file_count"), F.sum("d").alias("declaration_count"),
                                           F.concat_ws(",", F.sort_array(F.collect_set(label))).alias("language_summary"))
    n_deps = deps.groupBy("skill_id").agg(F.count("*").alias("dependency_count"))
    return prof.join(n_deps, "skill_id", "left").withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0)))


def skill_description(files: DataFrame, top: int | None = None) -> DataFrame:
    """The whole markdown declarations of a skill by priority then path; ``top`` keeps the first ones as a view."""
    base = F.lower(base_name(F.col("path")))
    prio = F.when(base == "skill.md", 0).when(base == "readme.md", 1).when(base.isin("description.md", "manifest.md"), 2).otherwise(3)
    body = ws_trim(F.col("content"))
    md = files.where(file_ext(F.col("path")) == ".md").select("skill_id", prio.alias("prio"), "path", body.alias("body")).where("body != ''")
    w = Window.partitionBy("skill_id").orderBy("prio", "path")
    ranked = md.withColumn("rn", F.row_number().over(w))
    ranked = ranked if top is None else ranked.where(F.col("rn") <= top)
    return (
        ranked.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("rn", "path", "body"))).alias("docs"))
        .select("skill_id", F.array_join(F.transform("docs", lambda d: F.concat(base_name(d["path"]), F.lit(":\n"), d["body"])), "\n\n").alias("description"))
    )
