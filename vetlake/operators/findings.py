"""Finding consolidation: building, grouping, categories, confidence, evidence windows, rule logs.

``findings``: skill_id, source, rule_id, severity, title, description, path, line_start,
line_end, code_snippet (``path`` empty for findings without a place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_any, hit_lines, is_license_notice, let, normalize_severity, ws_trim
from .packs import HIGH_RISK_DIFFS, Pack
from .review import evidence_facts, seen_struct
from .rules import RULES, Rule
from .scan import hit_files, line_test

FINDING_COLS = ["skill_id", "source", "rule_id", "severity", "title", "description", "path", "line_start", "line_end", "code_snippet"]
ENGINE, ANALYZER, BEHAVIOR = "SecurityEngine", "StaticAnalyzer", "BehaviorGuard"
SUMMARY_PLACE, SUMMARY_MARK = "行为证据采集", "行为证据摘要:"
LICENSE_TITLE = "许可证验证配置缺陷"
POLICY_TITLE = "公司策略禁止的加密资产或预测市场目标"


def as_findings(hits: DataFrame, source: str = ENGINE) -> DataFrame:
    """Rule hits (skill_id, path, line_no, rule_id, severity, label) -> the findings schema.

    Titles and reasons come from the catalogue as a literal map, not a join.
    """
    name = F.create_map(*[F.lit(x) for r in RULES.values() for x in (r.rule_id, r.name)])
    snippet = F.col("line") if "line" in hits.columns else F.lit("")
    return hits.select(
        "skill_id", F.lit(source).alias("source"), "rule_id", "severity", F.coalesce(F.element_at(name, F.col("rule_id")), F.col("rule_id")).alias("title"),
        F.col("label").alias("description"), "path", F.col("line_no").cast("int").alias("line_start"), F.col("line_no").cast("int").alias("line_end"), snippet.alias("code_snippet"))


def findings_from_results(details: DataFrame, reasons: DataFrame, calls: DataFrame, hardcoded: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Details, then blocking reasons not covered by rule or description, risky calls and the hard-coded flag.

    ``reasons``: skill_id, reason; ``calls``: skill_id, path, line_no, function, category; ``hardcoded``: skill_id.
    """
    catalogue = rules if rules is not None else list(RULES.values())
    rid, title = F.lit("V7-HIGH-RISK-BLOCK"), F.lit("高风险阻断项")
    reason = ws_trim(F.col("reason"))
    for r in reversed(catalogue):  # the first catalogue entry wins
        hit = (reason != "") & ((reason == r.reason) | (reason == F.lit(r.name + " 无补偿且未通过")) | reason.startswith(r.name + " "))
        rid, title = F.when(hit, F.lit(r.rule_id)).otherwise(rid), F.when(hit, F.lit(r.name)).otherwise(title)
    extra = (
        reasons.where(~F.col("reason").startswith("LLM深度检测:")).dropDuplicates(["skill_id", "reason"])
        .select("skill_id", rid.alias("rule_id"), title.alias("title"), F.col("reason").alias("description"))
        .join(details.select("skill_id", "rule_id").distinct(), ["skill_id", "rule_id"], "left_anti")
        .join(details.select("skill_id", "description").distinct(), ["skill_id", "description"], "left_anti")
        .select("skill_id", F.lit(ENGINE).alias("source"), "rule_id", F.lit("high").alias("severity"), "title", "description",
                F.lit("").alias("path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.concat(F.lit("关键证据: "), "description").alias("code_snippet"))
    )
    risky = calls.select(
        "skill_id", F.lit(ANALYZER).alias("source"), F.lit("DAN-001").alias("rule_id"), F.lit("medium").alias("severity"),
        F.concat(F.lit("危险函数调用: "), "function").alias("title"), F.concat(F.lit("类别: "), "category").alias("description"), "path",
        F.col("line_no").cast("int").alias("line_start"), F.col("line_no").cast("int").alias("line_end"), F.lit("").alias("code_snippet"))
    hard = hardcoded.select("skill_id").distinct().select(
        "skill_id", F.lit(ANALYZER).alias("source"), F.lit("SEC-001").alias("rule_id"), F.lit("high").alias("severity"), F.lit("发现硬编码凭证").alias("title"),
        F.lit("代码中包含硬编码的密钥、密码等敏感信息").alias("description"), F.lit("").alias("path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("").alias("code_snippet"))
    return details.select(*FINDING_COLS).unionByName(extra).unionByName(risky).unionByName(hard)


# Ordered keyword lists naming a finding's category.
CATEGORY_WORDS = [
    ("credential", ["凭据", "credential", "token", "secret"]),
    ("outbound", ["外联", "外发", "隐蔽通道", "network", "http", "c2", "情报"]),
    ("execution", ["执行", "command", "shell", "命令"]),
    ("persistence", ["持久化", "persistence", "cron"]),
    ("priv_esc", ["提权", "privilege", "sudo"]),
    ("evasion", ["逃逸", "规避", "evasion", "sandbox"]),
    ("intent", ["声明", "意图", "一致"]),
    ("coverage", ["覆盖", "coverage"]),
]


def finding_category(rule_id: Column, title: Column, description: Column) -> Column:
    """Category by the first keyword list hit over rule, title and description."""
    text = F.lower(F.concat_ws(" ", rule_id, title, description))
    out = F.when(has_any(text, CATEGORY_WORDS[0][1]), F.lit(CATEGORY_WORDS[0][0]))
    for name, words in CATEGORY_WORDS[1:]:
        out = out.when(has_any(text, words), F.lit(name))
    return out.otherwise(F.lit("static"))


def is_concrete(df: DataFrame) -> Column:
    """The finding names a place, or carries a multi-line excerpt that is not a summary."""
    code = ws_trim(F.coalesce("code_snippet", F.lit("")))
    marks = ["行为证据摘要:", "一致性证据:", "目标证据:"]
    excerpt = code.contains("\n")
    for m in marks:
        excerpt = excerpt & ~code.startswith(m)
    return (F.col("line_start") > 0) | excerpt


def drop_summary_findings(findings: DataFrame) -> DataFrame:
    """Remove behaviour summaries when a concrete finding of the same rule exists in the skill."""
    guard = F.lower(ws_trim(F.col("source"))) == BEHAVIOR.lower()
    summary = guard & (F.col("path") == SUMMARY_PLACE) & F.col("code_snippet").contains(SUMMARY_MARK)
    concrete = findings.where(~guard & is_concrete(findings) & (ws_trim(F.col("rule_id")) != "")).select("skill_id", "rule_id").distinct().withColumn("_concrete", F.lit(True))
    return findings.join(concrete, ["skill_id", "rule_id"], "left").where(~(summary & F.coalesce("_concrete", F.lit(False)))).select(*findings.columns)


ORDER = ["path", "line_start", "rule_id", "description"]


def group_findings(findings: DataFrame, order: list[str] | None = None, max_evidence: int = 6) -> DataFrame:
    """Group by (rule, severity, title) per skill; license-config findings merge across rules.

    Ids SF-001… follow first appearance.  ``seen`` says what all places of the group have in common
    or name (see ``review.evidence_facts``); verdicts are judged on it.  ``evidence`` is a view for
    reading: the first ``max_evidence`` places, ranked before they are collected.
    """
    order = order or ORDER
    title = ws_trim(F.col("title"))
    keyed = findings.select("*", F.when(title == LICENSE_TITLE, F.lit("license-config")).otherwise(ws_trim(F.col("rule_id"))).alias("g_rule"),
                            ws_trim(F.col("severity")).alias("g_sev"), title.alias("g_title"))
    g = ["skill_id", "g_rule", "g_sev", "g_title"]
    first = F.min(F.struct(*dict.fromkeys([*order, "rule_id", "severity", "title", "description", "source"])))
    item = F.when(F.col("path") == "", F.col("description")).otherwise(F.concat("path", F.lit(":"), F.col("line_start").cast("string"), F.lit(" "), F.coalesce("code_snippet", F.lit(""))))
    facts = keyed.select("*", F.lower(item).alias("_item")).groupBy(*g).agg(F.count("*").alias("n"), first.alias("m"), *evidence_facts(F.col("_item")))
    groups = facts.select(*g, "n", "m", seen_struct().alias("seen"))
    w = Window.partitionBy(*g).orderBy(*order)
    ev = keyed.select(*g, *[c for c in order if c not in g], item.alias("item")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_evidence)
    ev = ev.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("rn", "item"))).alias("_e")).select(*g, F.array_distinct(F.transform("_e", lambda e: e["item"])).alias("evidence"))
    ranked = groups.join(ev, g)
    wid = Window.partitionBy("skill_id").orderBy(*[F.col(f"m.{c}") for c in order], "g_rule", "g_sev", "g_title")
    num = F.row_number().over(wid).cast("string")
    return ranked.select(
        "skill_id", F.concat(F.lit("SF-"), F.when(F.length(num) < 3, F.lpad(num, 3, "0")).otherwise(num)).alias("finding_id"),
        F.col("m.rule_id").alias("rule_id"), F.col("m.severity").alias("severity"), F.col("m.title").alias("title"), F.col("m.description").alias("description"),
        F.col("m.source").alias("source"), finding_category(F.col("m.rule_id"), F.col("m.title"), F.col("m.description")).alias("category"), "n", "evidence", "seen")


# --- behaviour support ------------------------------------------------------------------------

# Finding category -> behaviour categories / alerts that support it.
SUPPORT_CATEGORIES = {
    "execution": ["execute"], "outbound": ["outbound", "c2_beacon", "collection", "credential", "lateral_move"],
    "credential": ["credential", "outbound", "collection"], "persistence": ["persistence"], "priv_esc": ["priv_esc"],
    "evasion": ["defense_evasion", "execute"],
}
SUPPORT_ALERTS = {
    "execution": ["download then execute", "evasion then execute", "lateral then control"],
    "outbound": ["collection then outbound", "credential then outbound", "lateral then control"],
    "credential": ["credential then outbound"], "evasion": ["evasion then execute"],
}
HIGH_SIGNAL_ALERTS = ["download then execute", "collection then outbound", "credential then outbound"]
THREAT_ALERTS = ["download then execute", "credential then outbound"]


def _inverse(table: dict[str, list[str]]) -> Column:
    inv: dict[str, list[str]] = {}
    for cat, items in table.items():
        for i in items:
            inv.setdefault(i, []).append(cat)
    return F.create_map(*[x for k, v in inv.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])


def behavior_support(chains: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per skill and finding category: relevant chain, alert, high-signal alert, threat-like alert."""
    ch = (
        chains.select("skill_id", F.explode(F.map_keys("cats")).alias("b")).select("skill_id", F.explode(F.element_at(_inverse(SUPPORT_CATEGORIES), F.col("b"))).alias("category"))
        .distinct().select("skill_id", "category", F.lit(True).alias("has_chain"), F.lit(False).alias("has_alert"), F.lit(False).alias("high_signal"), F.lit(False).alias("threat_alert"))
    )
    al = alerts.select("skill_id", "alert", F.explode(F.element_at(_inverse(SUPPORT_ALERTS), F.col("alert"))).alias("category")).select(
        "skill_id", "category", F.lit(False).alias("has_chain"), F.lit(True).alias("has_alert"), F.col("alert").isin(HIGH_SIGNAL_ALERTS).alias("high_signal"), F.col("alert").isin(THREAT_ALERTS).alias("threat_alert"))
    return ch.unionByName(al).groupBy("skill_id", "category").agg(*[F.bool_or(c).alias(c) for c in ("has_chain", "has_alert", "high_signal", "threat_alert")])


def with_support(groups: DataFrame, support: DataFrame, skill_flags: DataFrame | None = None) -> DataFrame:
    """Attach behaviour support and skill flags (has_ti, n_diffs, evasion) to grouped findings."""
    out = groups.join(support, ["skill_id", "category"], "left")
    flags = ["has_chain", "has_alert", "high_signal", "threat_alert"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
    if skill_flags is not None:
        out = out.join(skill_flags.select("skill_id", "has_ti", "n_diffs", "evasion"), "skill_id", "left")
        return out.withColumns({"has_ti": F.coalesce("has_ti", F.lit(False)), "n_diffs": F.coalesce("n_diffs", F.lit(0)), "evasion": F.coalesce("evasion", F.lit(False))})
    return out.withColumns({"has_ti": F.lit(False), "n_diffs": F.lit(0), "evasion": F.lit(False)})


def finding_confidence(df: DataFrame) -> DataFrame:
    """Confidence and its basis: 1, +1 repeated, +2 chain, +2 alert, +1 reputation, +1 differences, +2 evasion."""
    parts = [
        (F.col("n") > 1, 1, "repeated"), (F.col("has_chain"), 2, "behavior chain"), (F.col("has_alert"), 2, "sequence alert"),
        ((F.col("category") == "outbound") & F.col("has_ti"), 1, "reputation"), ((F.col("category") == "intent") & (F.col("n_diffs") > 0), 1, "intent difference"),
        ((F.col("category") == "evasion") & F.col("evasion"), 2, "evasion signal"),
    ]
    score = F.lit(1)
    for cond, pts, _ in parts:
        score = score + F.when(cond, pts).otherwise(0)
    basis = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, _, name in parts]))
    out = df.withColumns({"confidence_score": score, "basis": F.when(F.size(basis) > 0, basis).otherwise(F.array(F.lit("rule hit only")))})
    return out.withColumn("confidence", F.when(F.col("confidence_score") >= 4, F.lit("high")).when(F.col("confidence_score") >= 2, F.lit("medium")).otherwise(F.lit("review")))


# Technique identifiers per rule, then per category.
RULE_TECHNIQUES = {
    "V7-001": ["TA0002 Execution", "T1059 Command and Scripting Interpreter"], "V7-002": ["TA0003 Persistence", "T1546 Event Triggered Execution"],
    "V7-003": ["TA0011 Command and Control", "T1071 Application Layer Protocol"], "V7-004": ["TA0006 Credential Access", "T1552 Unsecured Credentials"],
    "V7-008": ["TA0004 Privilege Escalation", "T1068 Exploitation for Privilege Escalation"], "V7-009": ["TA0002 Execution", "T1105 Ingress Tool Transfer"],
}
CATEGORY_TECHNIQUES = {
    "outbound": ["TA0011 Command and Control", "T1071 Application Layer Protocol"], "credential": ["TA0006 Credential Access", "T1552 Unsecured Credentials"],
    "execution": ["TA0002 Execution", "T1059 Command and Scripting Interpreter"],
}


def _array_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def mitre_techniques(rule_id: Column, category: Column) -> Column:
    """Techniques of the rule, else of the category, else none."""
    return F.coalesce(F.element_at(_array_map(RULE_TECHNIQUES), ws_trim(rule_id)), F.element_at(_array_map(CATEGORY_TECHNIQUES), ws_trim(category)), F.array().cast("array<string>"))


def mitre_summary(groups: DataFrame) -> DataFrame:
    """Distinct techniques with the number of skills and findings showing them."""
    t = groups.select("skill_id", F.explode(mitre_techniques(F.col("rule_id"), F.col("category"))).alias("technique"))
    per_skill = t.groupBy("technique", "skill_id").agg(F.count("*").alias("n"))  # hot techniques are combined per skill first
    return per_skill.groupBy("technique").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_skills"))


# --- evidence windows -----------------------------------------------------------------------------

def _merged_windows(lines: Column, h: Column, radius: int) -> Column:
    """± radius windows around the lines ``h`` (sorted, distinct), one where they touch, with marked text."""
    reach = 2 * radius + 1

    def window(a: Column, b: Column) -> Column:
        s, e = F.greatest(a - radius, F.lit(1)), F.least(b + radius, F.size(lines))
        own = F.filter(h, lambda x: (x >= a) & (x <= b))  # a window is as long as its own hits allow
        number = lambda i: F.when(i < 10000, F.lpad(i.cast("string"), 4, " ")).otherwise(i.cast("string"))
        text = lambda hits: F.struct(
            s.alias("win_start"), e.alias("win_end"), F.size(hits).alias("n_hits"),
            F.array_join(F.transform(F.sequence(s, e), lambda i: F.concat(F.when(F.array_contains(hits, i), F.lit("> ")).otherwise(F.lit("  ")), number(i), F.lit(" | "), F.get(lines, i - 1))), "\n").alias("body"))
        return let(own, text)

    starts = F.filter(h, lambda x, i: (i == 0) | (x - F.get(h, i - 1) > reach))
    ends = F.filter(h, lambda x, i: (i == F.size(h) - 1) | (F.get(h, i + 1) - x > reach))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: window(g["a"], g["b"]))


def _plain_lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def pack_windows(files: DataFrame, pack: Pack, radius: int = 3) -> DataFrame:
    """Merged windows around the hits of a pack: skill_id, path, win_start, win_end, n_hits, body.

    Hits are found and windows cut in the row that is scanned: one read of the text, no join.
    """
    src, text = hit_files(files, pack)
    hits = let(F.split(text, "\n", -1), lambda lines: hit_lines(lines, lambda l: line_test(pack, l)))
    cells = let(_plain_lines(F.col("content")), lambda lines: let(F.filter(hits, lambda x: x <= F.size(lines)), lambda h: _merged_windows(lines, h, radius)))
    return src.select("skill_id", "path", F.inline(cells))


def merge_evidence_windows(hits: DataFrame, files: DataFrame, radius: int = 3) -> DataFrame:
    """The same for hits from elsewhere, gathered per file (bounded by its lines) and joined to their files."""
    per_file = hits.groupBy("skill_id", "path").agg(F.sort_array(F.collect_set("line_no")).alias("_h"))
    src = per_file.join(files.select("skill_id", "path", "content"), ["skill_id", "path"])
    # lines and hit numbers are bound once per file, see ``let``
    cells = let(_plain_lines(F.col("content")), lambda lines: let(F.filter("_h", lambda x: (x > 0) & (x <= F.size(lines))), lambda h: _merged_windows(lines, h, radius)))
    return src.select("skill_id", "path", F.inline(cells))


def dedupe_evidence(windows: DataFrame) -> DataFrame:
    """One row per path and white-space-collapsed body (first by start)."""
    key = ws_trim(F.regexp_replace("body", r"\s+", " "))
    cols = windows.columns
    return windows.withColumn("_k", F.sha2(key, 256)).groupBy("skill_id", "path", "_k").agg(F.min(F.struct("win_start", *[c for c in cols if c not in ("skill_id", "path", "win_start")])).alias("m")).select(
        "skill_id", "path", *[F.col(f"m.{c}").alias(c) for c in cols if c not in ("skill_id", "path")])


# --- synthesized findings -----------------------------------------------------------------------------

# Behaviour summaries (rule, severity, counted inputs).
BEHAVIOR_SUMMARIES = [
    ("V7-001", "high", ["chains", "persistence", "defense_evasion", "lateral_move", "c2_beacon", "alerts"]), ("V7-003", "high", ["outbound", "collection"]),
    ("V7-008", "high", ["priv_esc", "evasion"]), ("V7-009", "high", ["download", "execute"]), ("V7-016", "medium", ["credential"]),
]


def _plain(df: DataFrame, source: str, rule_id: str | Column, severity: str | Column, title: str | Column, description: Column, place: Column, snippet: Column) -> DataFrame:
    c = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select("skill_id", F.lit(source).alias("source"), c(rule_id).alias("rule_id"), c(severity).alias("severity"), c(title).alias("title"), description.alias("description"),
                     place.alias("path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), snippet.alias("code_snippet"))


def synthesize_intent(diffs: DataFrame) -> DataFrame:
    sev = F.when(F.col("diff").isin(HIGH_RISK_DIFFS), F.lit("high")).otherwise(F.lit("medium"))
    return _plain(diffs, "IntentEngine", "V7-006", sev, RULES["V7-006"].name, F.col("diff"), F.lit("行为一致性分析"), F.concat(F.lit("一致性证据: "), "diff"))


def synthesize_ti(reputations: DataFrame) -> DataFrame:
    """Threat and policy targets become findings; harmless and unknown ones do not.  Needs skill_id, target, reputation."""
    rep, low = F.lower(ws_trim(F.col("reputation"))), F.lower("target")
    policy = (rep == "policy") | has_any(low, ["加密资产", "预测市场", "polymarket", "usdc"])
    kept = reputations.where(~rep.isin("internal", "trusted", "benign", "unknown"))
    return _plain(kept, "ThreatIntel", "V7-003", F.when(policy, F.lit("medium")).otherwise(F.lit("high")), F.when(policy, F.lit(POLICY_TITLE)).otherwise(F.lit(RULES["V7-003"].name)),
                  F.concat(F.lit("reputation "), "reputation"), F.col("target"), F.concat(F.lit("目标证据: "), "target"))


def synthesize_evasion(signals: DataFrame) -> DataFrame:
    return _plain(signals, "EvasionGuard", "V7-008", "high", RULES["V7-008"].name, F.col("signal"), F.lit("差分执行与行为审计"), F.concat(F.lit("逃逸信号: "), "signal"))


def synthesize_behavior(counts: DataFrame) -> DataFrame:
    """One summary finding per rule with a non-zero count (``counts``: behaviour counts, optional ``evasion``)."""
    have = lambda c: F.col(c) if c in counts.columns else F.lit(0)
    cells = []
    for rid, sev, inputs in BEHAVIOR_SUMMARIES:
        n = have(inputs[0])
        for c in inputs[1:]:
            n = n + have(c)
        cells.append(F.when(n > 0, F.struct(F.lit(rid).alias("rule_id"), F.lit(sev).alias("sev"), F.lit(RULES[rid].name).alias("t"), n.cast("long").alias("n"))))
    rows = counts.select("skill_id", F.explode(F.array_compact(F.array(*cells))).alias("s"))
    desc = F.concat(F.lit("behavior evidence "), F.col("s.n").cast("string"))
    return _plain(rows, BEHAVIOR, F.col("s.rule_id"), F.col("s.sev"), F.col("s.t"), desc, F.lit(SUMMARY_PLACE), F.concat(F.lit(SUMMARY_MARK + " "), desc))


def synthesize_coverage(coverage: DataFrame) -> DataFrame:
    """Uncovered automatic items become one high finding per skill (``coverage``: skill_id, auto_total, uncovered)."""
    gap = coverage.where((F.col("auto_total") > 0) & (F.col("uncovered") != ""))
    desc = F.concat(F.lit("未覆盖项: "), "uncovered")
    return _plain(gap, "V7Coverage", "V7-AUTO-COVERAGE", "high", "V7 可自动评估项覆盖不足", desc, F.lit("评估规则配置"), desc)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*FINDING_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FINDING_COLS))
    return out


# --- rule logs, coverage --------------------------------------------------------------------------------

def rule_eval_log(skills: DataFrame, findings: DataFrame, rules: list[Rule], evaluated: DataFrame | None = None) -> DataFrame:
    """Every rule per skill: evaluated?, severity of its first finding, up to two places.

    The rule list is unrolled as a literal array; findings are reduced to one row per
    (skill, rule) before the join.
    """
    grid = skills.select("skill_id", F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.dtype).alias("dtype")) for r in rules])).alias("r")).select("skill_id", "r.*")
    first = findings.where(ws_trim(F.col("rule_id")) != "").groupBy("skill_id", "rule_id").agg(F.min(F.struct(*ORDER, "severity")).alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy("skill_id", "rule_id").orderBy(*ORDER)
    place = F.concat("path", F.lit(":"), F.col("line_start").cast("string"))
    top = findings.select("skill_id", *ORDER, place.alias("place")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    top = top.groupBy("skill_id", "rule_id").agg(F.array_sort(F.collect_list(F.struct("rn", "place"))).alias("_p")).select(
        "skill_id", "rule_id", F.array_join(F.array_distinct(F.transform("_p", lambda p: p["place"])), ";").alias("places"))
    out = grid.join(first.select("skill_id", "rule_id", F.col("m.severity").alias("sev"), "n"), ["skill_id", "rule_id"], "left").join(top, ["skill_id", "rule_id"], "left")
    if evaluated is not None:
        out = out.join(evaluated.select("skill_id", "rule_id").distinct().withColumn("_ev", F.lit(True)), ["skill_id", "rule_id"], "left")
        out = out.withColumn("evaluated", F.coalesce("_ev", F.lit(False)))
    else:
        out = out.withColumn("evaluated", F.lit(True))
    label = F.when(~F.col("evaluated"), F.lit("not evaluated")).when(F.col("sev").isin("high", "medium", "low"), F.col("sev")).otherwise(F.lit("none"))
    shown = label.isin("high", "medium", "low")
    return out.select("skill_id", "rule_id", "layer", "dtype", "evaluated", label.alias("risk_label"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.when(shown, F.coalesce("places", F.lit(""))).otherwise(F.lit("")).alias("places"))


def rule_set_profile(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rule and finding counts by layer, severity and detection type in one GROUPING SETS pass."""
    n = findings.groupBy("rule_id").agg(F.count("*").alias("hits"))
    j = rules.select("rule_id", "layer", normalize_severity(F.col("severity")).alias("severity"), F.col("detection.type").alias("dtype"), F.col("on_fail.action").alias("action")).join(n, "rule_id", "left")
    g = j.groupingSets([[F.col("layer")], [F.col("severity")], [F.col("dtype")], [F.col("action")]], F.col("layer"), F.col("severity"), F.col("dtype"), F.col("action")).agg(
        F.count("*").alias("n_rules"), F.sum(F.coalesce("hits", F.lit(0))).alias("n_hits"))
    dim = F.when(F.col("layer").isNotNull(), F.lit("layer")).when(F.col("severity").isNotNull(), F.lit("severity")).when(F.col("dtype").isNotNull(), F.lit("detection")).otherwise(F.lit("action"))
    return g.select(dim.alias("dimension"), F.coalesce("layer", "severity", "dtype", "action").alias("value"), "n_rules", "n_hits")


def coverage(matrix: list[tuple[str, str, str, str, str]], rules: list[Rule], evaluated: DataFrame, skills: DataFrame) -> DataFrame:
    """Automatic items covered per skill, uncovered names, manual items (first 12 names).

    ``matrix``: (id, name, mode, mapping type, mapping id); V7 ids default to automatic rule items.
    ``evaluated``: skill_id, rule_id.  Without any evaluated rule a known rule counts as covered.
    """
    known = {r.rule_id for r in rules}
    items = []
    for iid, name, mode, mtype, mid in matrix:
        v7 = iid.strip().upper().startswith("V7-")
        mode = mode.strip().lower() or ("auto" if v7 else "")
        mtype = mtype.strip().lower() or ("rule" if v7 else "")
        mid = mid.strip() or (iid.strip() if v7 else "")
        items.append((name.strip() or iid.strip(), mode == "auto", mtype, mid))
    auto = [(n, t, m) for n, a, t, m in items if a]
    manual = [n for n, a, _, _ in items if not a]
    ev = evaluated.groupBy("skill_id").agg(F.collect_set("rule_id").alias("_ev"))  # at most one entry per catalogue rule
    j = skills.select("skill_id").join(ev, "skill_id", "left").withColumn("_ev", F.coalesce("_ev", F.array().cast("array<string>")))
    cells = []
    for name, mtype, mid in auto:
        if mtype == "runtime":
            cov = F.lit(True)
        elif mtype == "rule" and mid in known:
            cov = (F.size("_ev") == 0) | F.array_contains("_ev", mid)
        else:
            cov = F.lit(False)
        cells.append(F.when(~cov, F.lit(name)))
    unc = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<string>")
    return j.select("skill_id", F.lit(len(auto)).alias("auto_total"), (F.lit(len(auto)) - F.size(unc)).alias("auto_covered"), F.array_join(unc, ";").alias("uncovered"),
                    F.lit(len(manual)).alias("manual_total"), F.lit(";".join(manual)).alias("manual_items"))


# --- external analyses -------------------------------------------------------------------------------------

# Ordered keyword lists mapping free-text risks to rules.
RISK_WORDS = [
    ("V7-001", ["malicious", "恶意代码", "ransom", "miner", "反弹 shell", "reverse shell", "rm -rf", "c2", "beacon"]),
    ("V7-002", ["backdoor", "后门", "条件触发", "隐藏触发"]),
    ("V7-003", ["exfiltration", "外发", "隐蔽通道", "dns tunnel", "敏感数据外传", "威胁情报"]),
    ("V7-004", ["credential", "password", "secret", "token", "api key", "apikey", "private key", "密钥", "凭证", "令牌"]),
    ("V7-006", ["意图", "声明", "不一致", "deception", "intent"]),
    ("V7-007", ["mcp", "tool abuse", "工具滥用", "工具权限"]),
    ("V7-008", ["sandbox", "沙箱", "escape", "提权", "privilege", "setuid", "capset", "反虚拟机"]),
    ("V7-009", ["auto update", "self update", "download exec", "自更新", "下载执行"]),
    ("V7-010", ["dependency", "依赖", "malicious package", "漏洞", "cve"]),
    ("V7-011", ["prompt injection", "指令注入", "动态指令", "可执行上下文", "注入"]),
    ("V7-013", ["path traversal", "路径遍历", "../", "文件越权"]),
    ("V7-014", ["ssrf", "内网探测", "169.254", "metadata"]),
    ("V7-015", ["tool response", "工具响应", "poison", "投毒"]),
    ("V7-016", ["credential cache", "凭据缓存", "跨任务"]),
    ("V7-017", ["context leak", "上下文泄露", "敏感上下文", "错误信息泄露"]),
    ("V7-019", ["irreversible", "不可逆", "审批", "二次确认"]),
    ("V7-020", ["schema", "输入校验", "参数校验"]),
    ("V7-023", ["tls", "ssl", "证书", "insecureskipverify", "verify false", "http明文"]),
    ("V7-024", ["file upload", "文件上传", "文件解析", "zip slip"]),
    ("V7-026", ["resource", "资源耗尽", "dos", "拒绝服务"]),
    ("V7-027", ["memory", "记忆", "上下文污染"]),
    ("V7-028", ["pickle", "torch.load", "模型文件", "deserialize", "反序列化"]),
    ("V7-029", ["hidden", "隐藏", "base64", "混淆"]),
    ("V7-030", ["debug", "调试", "测试后门"]),
]
CRYPTO_WORDS = ["polymarket", "clob", "usdc", "0x2791bca1f2de4661ed88a30c99a7a9449aa84174", "erc-20", "erc20", "crypto asset", "prediction market", "加密资产", "预测市场"]
LICENSE_CHECK = ["verify", "validate", "activation", "activate", "entitlement", "subscription", "校验", "验证", "激活", "授权", "订阅"]
LICENSE_WEAK = ["localhost", "127.0.0.1", "http://", "license_server", "license server", "endpoint", "server", "url", "env", "mock", "验证失败", "fail open",
                "fail_open", "bypass", "绕过", "skip", "continue", "ignore"]


def risk_to_rule(text: Column, rules: list[Rule] | None = None, risk_words: list[tuple[str, list[str]]] | None = None) -> Column:
    """Rule of a free-text risk: license check, policy target, rule name, then the first keyword list; null if none."""
    known = {r.rule_id: r for r in (rules if rules is not None else RULES.values())}

    def body(low: Column) -> Column:
        lic = (low.contains("license") | low.contains("许可证")) & ~is_license_notice(low) & has_any(low, LICENSE_CHECK) & has_any(low, LICENSE_WEAK)
        out = F.when(lic, F.lit("V7-005" if "V7-005" in known else None)).when(has_any(low, CRYPTO_WORDS), F.lit("V7-003" if "V7-003" in known else None))
        for r in sorted(known.values(), key=lambda r: r.rule_id):
            if r.name.strip():
                out = out.when(low.contains(r.name.strip().lower()), F.lit(r.rule_id))
        for rid, words in risk_words or RISK_WORDS:
            if rid in known:
                out = out.when(has_any(low, words), F.lit(rid))
        return out

    return let(F.lower(ws_trim(text)), body)  # trimmed and lower-cased once for all lists


def intent_level(level: Column) -> Column:
    """External risk level -> high / medium / low / none; anything else is empty."""
    v = F.lower(ws_trim(F.coalesce(level, F.lit(""))))
    return (F.when(v.isin("高风险", "high", "critical", "block"), F.lit("high")).when(v.isin("中风险", "medium", "review"), F.lit("medium"))
            .when(v.isin("低风险", "low"), F.lit("low")).when(v.isin("无风险", "none", "pass", ""), F.lit("none")).otherwise(F.lit("")))


def external_intent_findings(analyses: DataFrame) -> DataFrame:
    """Model verdicts on intent: anything but none becomes one finding, high blocks.

    ``analyses``: skill_id, intent_risk_level, intent_mismatch.
    """
    lvl = intent_level(F.col("intent_risk_level"))
    return analyses.withColumn("severity", lvl).where(F.col("severity").isin("high", "medium", "low")).select(
        "skill_id", F.lit("V7-006").alias("rule_id"), "severity", (F.col("severity") == "high").alias("blocked"),
        F.when(ws_trim(F.coalesce("intent_mismatch", F.lit(""))) == "", F.lit("stated intent and behaviour differ")).otherwise(ws_trim(F.col("intent_mismatch"))).alias("description"))


def audit_events(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of trace, pipeline, result and warning rows (skill_id, step_id, status, detail) with their type."""
    out = None
    for kind, df in parts.items():
        p = df.select("skill_id", F.lit(kind).alias("type"), "step_id", "status", "detail")
        out = p if out is None else out.unionByName(p)
    return out


