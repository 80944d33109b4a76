"""Evidence strength, false-positive review, verdicts, consensus, reviewed counts and the capability matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, clean_array, has_any, ws_trim
from .intel import semantics

# Words that place evidence in documentation or on the local machine.
DOC_WORDS = ["readme", "skill.md", "docs/", "examples/", "testdata/", "示例", "文档"]
LOCAL_WORDS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]
THREAT_WORDS = ["命令执行", "下载后执行", "隐蔽通道", "凭据", "c2", "提权", "持久化", "外发", "exfil", "shell", "dropper", "subprocess", "os.system", "exec.command"]
FEEDBACK_TOKENS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "readme.md", "skill.md", "docs/", "examples/", "testdata/"]
# Default attack path text per category (its words count as threat signals).
ATTACK_PATHS = {
    "execution": "源码或运行时证据显示技能可能调用 shell、解释器或系统命令，需要确认入口参数是否可控。",
    "credential": "技能存在访问 token、密钥、环境变量或认证文件的证据，需要确认是否为声明用途必要行为。",
    "outbound": "技能存在网络访问或可疑目标信誉证据，需要确认请求目标、数据内容和授权范围。",
    "intent": "技能声明与实际行为存在偏差，需要将声明、权限和源码行为放在同一证据链中复核。",
}


def _all_mention(evidence: Column, words: list[str]) -> Column:
    return (F.size(evidence) > 0) & F.forall(evidence, lambda e: has_any(F.lower(e), words))


def docs_only(evidence: Column) -> Column:
    """There is evidence and every item points at documentation."""
    return _all_mention(evidence, DOC_WORDS)


def internal_only(evidence: Column) -> Column:
    return _all_mention(evidence, LOCAL_WORDS)


RUNTIME_WORDS = ["sandbox", "runtime"]


def evidence_facts(item: Column) -> list[Column]:
    """Aggregates over all (lower-cased) evidence of a finding; each combines before the shuffle."""
    return [
        F.bool_and(has_any(item, DOC_WORDS)).alias("_docs"), F.bool_and(has_any(item, LOCAL_WORDS)).alias("_local"), F.bool_or(has_any(item, THREAT_WORDS)).alias("_threat"),
        F.bool_or(has_any(item, RUNTIME_WORDS)).alias("_runtime"), *[F.bool_or(item.contains(t)).alias(f"_token{i}") for i, t in enumerate(FEEDBACK_TOKENS)],
    ]


def seen_struct() -> Column:
    """The aggregates of ``evidence_facts`` as one column: docs, local, threat, runtime, tokens."""
    tokens = F.array_compact(F.array(*[F.when(F.col(f"_token{i}"), F.lit(t)) for i, t in enumerate(FEEDBACK_TOKENS)]))
    return F.struct(F.col("_docs").alias("docs"), F.col("_local").alias("local"), F.col("_threat").alias("threat"), F.col("_runtime").alias("runtime"), tokens.alias("tokens"))


def with_seen(df: DataFrame) -> DataFrame:
    """``df`` with ``seen``; findings that come with their whole evidence as a list get it from that."""
    if "seen" in df.columns:
        return df
    text = F.lower(F.array_join("evidence", "\n"))
    tokens = F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in FEEDBACK_TOKENS]))
    return df.withColumn("seen", F.struct(
        docs_only(F.col("evidence")).alias("docs"), internal_only(F.col("evidence")).alias("local"), has_any(text, THREAT_WORDS).alias("threat"), has_any(text, RUNTIME_WORDS).alias("runtime"), tokens.alias("tokens")))


def attack_path(category: Column, description: Column) -> Column:
    out = F.when(category == "execution", F.lit(ATTACK_PATHS["execution"]))
    for c in ("credential", "outbound", "intent"):
        out = out.when(category == c, F.lit(ATTACK_PATHS[c]))
    return out.otherwise(description)


def assess(df: DataFrame) -> DataFrame:
    """Add the review inputs to grouped findings that carry confidence and support columns.

    Adds has_behavior, ti (semantics), docs_only, internal_only, threat_like, strength_score,
    strength, exploitability, impact, fp_verdict.  ``reputation`` is optional.
    """
    df = with_seen(df)
    rep = F.coalesce("reputation", F.lit("")) if "reputation" in df.columns else F.lit("")
    out = df.withColumns({
        "has_behavior": F.col("has_chain") | F.col("has_alert"), "ti": semantics(rep), "docs_only": F.col("seen.docs"), "internal_only": F.col("seen.local"),
        # a chain text names every category and so always reads as a threat
        "threat_like": F.col("has_chain") | F.col("threat_alert") | F.col("seen.threat") | has_any(
            F.lower(F.concat_ws(" ", "title", F.when(F.col("has_alert"), F.lit("")).otherwise(attack_path(F.col("category"), F.col("description"))))), THREAT_WORDS),
    })
    i = lambda c: c.cast("int")
    score = (i(F.size("evidence") > 0) + i(F.size("basis") > 0) + i(F.col("n") > 1) + 2 * i(F.col("has_behavior")) + i(F.col("high_signal")) + i(F.col("ti") == "policy") - i(F.col("docs_only")))
    out = out.withColumn("strength_score", score)
    out = out.withColumn("strength", F.when(F.col("strength_score") >= 4, F.lit("strong")).when(F.col("strength_score") >= 2, F.lit("medium")).otherwise(F.lit("weak")))
    exploit = (F.when(F.col("ti") == "policy", F.lit("moderate")).when(F.col("has_behavior"), F.lit("elevated")).when(F.col("confidence") == "high", F.lit("medium_high")).otherwise(F.lit("pending")))
    impact = F.when(F.col("category").isin("execution", "outbound", "credential", "persistence", "evasion", "intent"), F.col("category")).otherwise(F.lit("depends"))
    out = out.withColumns({"exploitability": exploit, "impact": impact})
    verdict = (
        F.when(F.col("internal_only") & ~F.col("threat_like"), F.lit("likely_false_positive"))
        .when((F.col("strength") == "strong") & (F.col("exploitability") == "elevated") & ~F.col("docs_only"), F.lit("likely_real"))
        .when(F.col("docs_only") & ~F.col("threat_like"), F.lit("likely_false_positive")).otherwise(F.lit("manual"))
    )
    return out.withColumn("fp_verdict", verdict)


def fp_review(assessed: DataFrame) -> DataFrame:
    """False-positive review classes per finding."""
    return assessed.select("skill_id", "finding_id", "exploitability", "impact", "strength", "fp_verdict")


def evidence_tier(verdict: Column) -> Column:
    """strong / moderate / weak after the verdict; a documented-only false positive loses one step."""
    return (
        F.when(F.col("strength") == "strong", F.when((verdict == "likely_false_positive") & F.col("docs_only"), F.lit("moderate")).otherwise(F.lit("strong")))
        .when(F.col("strength") == "medium", F.when((F.col("confidence") == "high") & F.col("has_behavior"), F.lit("strong")).otherwise(F.lit("moderate")))
        .otherwise(F.lit("weak"))
    )


# Names of missing evidence.
MISSING = ["no concrete evidence", "no multi-source support", "no release path for documentation", "no production path for local target"]


def deterministic_verdict(assessed: DataFrame) -> DataFrame:
    """Ordered rules -> confirmed / needs_manual_review / likely_false_positive, confidence and missing list."""
    t, b, d, il = F.col("threat_like"), F.col("has_behavior"), F.col("docs_only"), F.col("internal_only")
    strong, has_ev, policy = F.col("strength") == "strong", F.size("evidence") > 0, F.col("ti") == "policy"
    missing = F.array_compact(F.array(
        F.when(~has_ev, F.lit(MISSING[0])), F.when(~policy & ~strong & ~b, F.lit(MISSING[1])),
        F.when(d & ~t, F.lit(MISSING[2])), F.when(il & ~t, F.lit(MISSING[3])),
    ))
    out = assessed.withColumn("missing", missing)
    n = F.size("missing")
    rule = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("verdict_confidence"))
    r = (
        F.when((d | il) & ~t & ~b, rule("likely_false_positive", "medium_high"))
        .when((F.col("fp_verdict") == "likely_false_positive") & (n > 0) & ~strong & ~b, rule("likely_false_positive", "medium_high"))
        .when(policy & has_ev, rule("confirmed", "medium_high"))
        .when(has_ev & (F.size("basis") > 0) & b & ~d & ~il, rule("confirmed", "medium_high"))
        .when((n == 0) & ((F.col("fp_verdict") == "likely_real") | strong | (F.col("confidence") == "high")), rule("confirmed", "high"))
        .when(n >= 3, rule("needs_manual_review", "low")).otherwise(rule("needs_manual_review", "medium"))
    )
    return out.withColumn("_r", r).select("skill_id", "finding_id", F.col("_r.verdict").alias("verdict"), F.col("_r.verdict_confidence").alias("confidence"),
                                          F.lit("deterministic-vuln-reviewer").alias("reviewer"), "missing")


VERDICTS = ["confirmed", "needs_manual_review", "likely_false_positive"]
# Confidence order.
CONFIDENCE_RANK = {"high": 4, "medium_high": 3, "medium": 2, "medium_low": 1, "low": 0}


def _confidence_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv])
    return F.coalesce(F.element_at(table, ws_trim(F.coalesce(c, F.lit("")))), F.lit(-1))


def _reviewer_rank(c: Column) -> Column:
    r = F.lower(F.coalesce(c, F.lit("")))
    return F.when(r.contains("deterministic"), 2).when(r.contains("llm"), 1).otherwise(0)


def verdict_consensus(verdicts: DataFrame, keys: tuple[str, ...] = ("skill_id", "finding_id")) -> DataFrame:
    """Unanimous -> strongest verdict; conflict -> manual review with low confidence and merged reviewers.

    ``verdicts``: keys, seq, verdict, confidence, reviewer, missing array<string>.  A max of a
    struct and set aggregates combine map-side, so a much-reviewed finding is no hot task.
    """
    v = F.lower(ws_trim(F.coalesce("verdict", F.lit(""))))
    norm = F.when(v.isin(VERDICTS), v).otherwise(F.lit("needs_manual_review"))
    best = F.max(F.struct(_confidence_rank(F.col("confidence")), _reviewer_rank(F.col("reviewer")), (-F.col("seq")).alias("s"), "verdict", "confidence", "reviewer", "missing"))
    rev = ws_trim(F.coalesce("reviewer", F.lit("")))
    g = verdicts.groupBy(*keys).agg(
        best.alias("b"), F.min(norm).alias("v_lo"), F.max(norm).alias("v_hi"), F.count("*").alias("n_verdicts"),
        F.sort_array(F.collect_set(F.when(rev != "", rev))).alias("revs"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("all_missing"))
    same = F.col("v_lo") == F.col("v_hi")
    joined = F.when(F.size("revs") > 0, F.array_join("revs", "+")).otherwise(F.lit("multi-review"))
    return g.select(
        *keys, F.when(same, F.col("b.verdict")).otherwise(F.lit("needs_manual_review")).alias("verdict"), F.when(same, F.col("b.confidence")).otherwise(F.lit("low")).alias("confidence"),
        F.when(same, F.col("b.reviewer")).otherwise(joined).alias("reviewer"), F.when(same, F.col("b.missing")).otherwise(clean_array(F.concat("b.missing", "all_missing"))).alias("missing"), "n_verdicts")


def union_verdicts(external: DataFrame, deterministic: DataFrame) -> DataFrame:
    """External verdicts first, deterministic ones after."""
    cols = ["skill_id", "finding_id", "verdict", "confidence", "reviewer", "missing"]
    return external.select(*cols, F.lit(0).alias("seq")).unionByName(deterministic.select(*cols, F.lit(1).alias("seq")))


def external_verdicts(analyses: DataFrame) -> DataFrame:
    """Model analyses as verdicts.

    ``analyses``: skill_id, finding_id, risk_severities array<string>, intent_risk_level, intent_consistency.
    """
    sev = F.transform(F.coalesce("risk_severities", F.array().cast("array<string>")), lambda s: F.lower(ws_trim(s)))
    lvl = F.lower(ws_trim(F.coalesce("intent_risk_level", F.lit(""))))
    confirmed = F.exists(sev, lambda s: s.isin("high", "高风险")) | lvl.isin("high", "medium")
    clean = (F.size(sev) == 0) & (lvl.isin("none", "low") | (F.col("intent_consistency") >= 80))
    return analyses.select(
        "skill_id", "finding_id", F.when(confirmed, F.lit("confirmed")).when(clean, F.lit("likely_false_positive")).otherwise(F.lit("needs_manual_review")).alias("verdict"),
        F.when(confirmed, F.lit("high")).when(clean, F.lit("medium_high")).otherwise(F.lit("medium")).alias("confidence"),
        F.lit("llm-vuln-reviewer").alias("reviewer"),
        F.when(~confirmed & clean, F.array(F.lit("external reviewer found too little risk evidence"))).otherwise(F.array().cast("array<string>")).alias("missing"))


def reviewed(assessed: DataFrame, consensus: DataFrame) -> DataFrame:
    """Assessed findings with their consensus verdict and tier."""
    v = consensus.select("skill_id", "finding_id", F.col("verdict").alias("final_verdict"))
    return assessed.join(v, ["skill_id", "finding_id"], "left").withColumn("tier", evidence_tier(F.coalesce("final_verdict", F.lit(""))))


def _reviewed_class() -> Column:
    s, v, t = F.col("severity"), F.col("final_verdict"), F.col("tier")
    none = v.isNull()
    return (
        F.when(~none & (v == "likely_false_positive") & (t != "strong"), F.lit("low"))
        .when((s == "high") & (t == "strong") & (none | (v == "confirmed")), F.lit("high"))
        .when(~none & (v == "needs_manual_review") & (s == "high"), F.lit("medium"))
        .when((s == "medium") & (t == "weak"), F.lit("low")).when(s.isin("high", "medium"), F.lit("medium")).otherwise(F.lit("low"))
    )


def reviewed_counts(rev: DataFrame, key: str = "skill_id") -> DataFrame:
    """High / medium / low counts after verdict and tier adjustments."""
    c = _reviewed_class()
    return rev.groupBy(key).agg(F.count_if(c == "high").alias("high"), F.count_if(c == "medium").alias("medium"), F.count_if(c == "low").alias("low"))


def reviewed_decision(rev: DataFrame, skill_state: DataFrame) -> DataFrame:
    """Final level per skill: blocked or evasion -> high; strong confirmed high -> high; else the weaker rules.

    ``skill_state``: skill_id, blocked, evasion, high, medium (counts of the run summary).
    """
    s, v, t = F.col("severity"), F.coalesce("final_verdict", F.lit("")), F.col("tier")
    fp = (v == "likely_false_positive") & (t != "strong")
    hi = ~fp & (s == "high") & (t == "strong") & (F.col("final_verdict").isNull() | (v == "confirmed"))
    med = ~fp & ~hi & ((s == "high") | ((s == "medium") & t.isin("strong", "moderate")))
    sig = rev.groupBy("skill_id").agg(F.count("*").alias("n"), F.bool_or(hi).alias("hi"), F.bool_or(med).alias("med"))
    j = skill_state.join(sig, "skill_id", "left")
    by_counts = F.when(F.col("high") > 0, F.lit("high")).when(F.col("medium") > 0, F.lit("medium")).otherwise(F.lit("low"))
    level = (
        F.when(F.col("blocked") | F.col("evasion"), F.lit("high")).when(F.col("n").isNull(), by_counts).when(F.col("hi"), F.lit("high")).when(F.col("med"), F.lit("medium"))
        .when((F.col("high") > 0) | (F.col("medium") > 1), F.lit("medium")).otherwise(F.lit("low"))
    )
    return j.select("skill_id", level.alias("decision"))


def learn_feedback(rev: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New (rule_id, token) pairs from the evidence of likely false positives."""
    out = with_seen(rev.where(F.col("final_verdict") == "likely_false_positive")).select("rule_id", F.explode("seen.tokens").alias("token")).distinct()
    return out.join(existing, ["rule_id", "token"], "left_anti") if existing is not None else out


VERDICT_RANK = {"confirmed": 0, "needs_manual_review": 1, "likely_false_positive": 3}


def order_findings(rev: DataFrame) -> DataFrame:
    """Sort by verdict rank, severity rank, id within each skill (range-partitioned global sort)."""
    vr = F.when(F.col("final_verdict") == "confirmed", 0).when(F.col("final_verdict") == "needs_manual_review", 1).when(F.col("final_verdict") == "likely_false_positive", 3).otherwise(2)
    sr = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return rev.withColumns({"review_rank": vr, "severity_rank": sr}).orderBy("skill_id", "review_rank", "severity_rank", "finding_id")


# --- capability matrix ---------------------------------------------------------------------------------

# Capability -> words that show it in text, and its behaviour inputs.
CAPABILITY_WORDS = {
    "network": ["外联", "网络", "network", "http", "url", "fetch", "requests", "axios", "c2", "远程"],
    "command": ["命令", "执行", "command", "shell", "exec", "subprocess", "child_process"],
    "file": ["文件", "落地", "写入", "读取", "file", "write", "read", "drop"],
    "credential": ["凭据", "密钥", "token", "secret", "password", "credential", "authorization"],
    "persistence": ["持久", "启动", "cron", "startup", "autorun", "systemctl"],
    "escape": ["提权", "逃逸", "sandbox", "evasion", "sudo", "setuid", "privilege"],
    "collection": ["收集", "打包", "archive", "zip", "tar", "dump", "collection"],
}
CAPABILITY_BEHAVIOR = {
    "network": ["outbound", "network_targets"], "command": ["execute", "exec_targets"], "file": ["drop", "file_targets"], "credential": ["credential"],
    "persistence": ["persistence"], "escape": ["priv_esc", "evasion_signals"], "collection": ["collection"],
}
# Capability -> finding categories it speaks to.
CAPABILITY_AFFINITY = {"network": ["outbound"], "command": ["execution"], "credential": ["credential"], "persistence": ["persistence"], "escape": ["priv_esc", "evasion"]}


def capability_status(declared: Column, static: Column, model: Column, behavior: Column) -> Column:
    seen = static | model | behavior
    return (
        F.when(declared & seen & behavior, F.lit("declared, verified")).when(declared & seen, F.lit("declared, not run-verified")).when(~declared & seen & behavior, F.lit("undeclared, observed"))
        .when(~declared & seen, F.lit("undeclared, static only")).when(declared, F.lit("declared, not seen")).otherwise(F.lit("not observed"))
    )


def capability_matrix(skills: DataFrame, static_text: DataFrame, observed: DataFrame) -> DataFrame:
    """Seven capabilities per skill × declared / static / model / behaviour / reputation with a status.

    ``skills``: skill_id, declared_text, model_text; ``static_text``: skill_id, text (one row per
    finding); ``observed``: skill_id, category (behaviour inputs of ``CAPABILITY_BEHAVIOR``, plus
    ``reputation``).  Text tests are reduced to flags before joining.
    """
    low = F.lower("text")
    static = static_text.groupBy("skill_id").agg(*[F.bool_or(has_any(low, w)).alias("s_" + c) for c, w in CAPABILITY_WORDS.items()])
    obs = observed.groupBy("skill_id").agg(*[F.bool_or(F.col("category").isin(b)).alias("b_" + c) for c, b in CAPABILITY_BEHAVIOR.items()], F.bool_or(F.col("category") == "reputation").alias("ti"))
    j = skills.join(static, "skill_id", "left").join(obs, "skill_id", "left")
    decl, model = F.lower(F.coalesce("declared_text", F.lit(""))), F.lower(F.coalesce("model_text", F.lit("")))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = F.array(*[F.struct(F.lit(c).alias("capability"), has_any(decl, w).alias("declared"), no("s_" + c).alias("static_seen"), has_any(model, w).alias("model_seen"),
                              no("b_" + c).alias("behavior_seen"), (no("ti") & F.lit(c == "network")).alias("ti_seen")) for c, w in CAPABILITY_WORDS.items()])
    out = j.select("skill_id", F.explode(rows).alias("r")).select("skill_id", "r.*")
    return out.withColumn("status", capability_status(F.col("declared"), F.col("static_seen"), F.col("model_seen"), F.col("behavior_seen")))


def capability_affinity(matrix: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in CAPABILITY_AFFINITY.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return matrix.select("*", F.explode_outer(F.element_at(table, F.col("capability"))).alias("category"))


def finding_capability_join(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Capability items of each finding by category affinity (equi join on skill and category)."""
    return groups.select("skill_id", "finding_id", "category").join(capability_affinity(matrix).where("category is not null"), ["skill_id", "category"]).select(
        "skill_id", "finding_id", "category", "capability", "status")


def unmatched_capabilities(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Capability items no finding of the skill speaks to."""
    hit = finding_capability_join(matrix, groups).select("skill_id", "capability").distinct()
    return matrix.join(hit, ["skill_id", "capability"], "left_anti")


# --- labels ------------------------------------------------------------------------------------------------

def source_labels(source: Column, basis: Column, runtime: Column, final_verdict: Column, depth: Column) -> Column:
    """Origin labels of a finding from its source, basis and evidence (``runtime``: some of it names a run), then its review status."""
    s, b = F.lower(ws_trim(F.coalesce(source, F.lit("")))), F.lower(F.array_join(basis, " "))
    rule = (s == "") | any_of(s.contains(w) for w in ("static", "securityengine", "rule", "coverage"))
    semantic = s.contains("intent") | s.contains("semantic") | b.contains("intent difference")
    model = s.contains("intent") | s.contains("llm") | b.contains("llm")
    dynamic = any_of(s.contains(w) for w in ("behaviorguard", "sandbox", "runtime")) | runtime
    ti = s.contains("threatintel") | b.contains("reputation")
    origin = F.array_compact(F.array(F.when(rule, F.lit("rule")), F.when(semantic, F.lit("semantic")), F.when(model, F.lit("model")), F.when(dynamic, F.lit("dynamic")), F.when(ti, F.lit("reputation"))))
    origin = F.when(F.size(origin) > 0, origin).otherwise(F.array(F.lit("rule")))
    v = F.lower(ws_trim(F.coalesce(final_verdict, F.lit(""))))
    status = F.array_compact(F.array(
        F.when(v == "", F.lit("unverified")).when(v.contains("confirmed"), F.lit("verified")).when(v.contains("false"), F.lit("suspected false positive")).otherwise(F.lit("unverified")),
        F.when(v.contains("manual"), F.lit("needs manual review")), F.when((v != "") & (depth > 1), F.lit("double checked"))))
    return F.array_distinct(F.concat(origin, status))


