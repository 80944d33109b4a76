"""Queries: finding consolidation, evidence, review, scores and rule logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import LICENSE_NOTICE, LICENSE_NOTICE_BLOCKERS
from ..operators import behavior as B
from ..operators import findings as FD
from ..operators import intel as I
from ..operators import packs as P
from ..operators import review as R
from ..operators import rules as RU
from ..operators import scan, scoring, sets
from ..sources import sinks
from . import corpus as C
from . import sqltext as S
from .q_behavior import _ALERT, _CHAIN, _DED, _SIG, _TI_CTE, _VETO, _local_sql, BEHAVIOR_CTE, FILE_SEG, page_and_seed_targets
from .q_rules import _DIFF, _OBS, _SENT
from .q_scan import _CALL_SQL, _pack_sql
from .registry import query
from .stage import Stage

_NAMES = "CASE rule_id " + " ".join(f"WHEN {S.s(r.rule_id)} THEN {S.s(r.name)}" for r in RU.RULES.values()) + " ELSE rule_id END"
FIND_CTE = "fd AS (SELECT x.skill_id, x.path, x.line_no AS line_start, rule_id, severity, " + _NAMES + " AS title, label AS description, l.line AS code FROM (" + " UNION ALL ".join(
    _pack_sql(p) for p in P.LINE_PACKS.values()) + ") x JOIN l ON x.skill_id = l.skill_id AND x.path = l.path AND x.line_no = l.line_no)"


def seeded_findings(spark, d):
    return FD.as_findings(scan.scan_packs(C.seeded_files(spark, d), list(P.LINE_PACKS.values())))


def _category_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {S.any_in(text, w)} THEN {S.s(n)}" for n, w in FD.CATEGORY_WORDS) + " ELSE 'static' END"


GROUP_CTE = f"""g0 AS (SELECT skill_id, rule_id, severity, title, count(*) AS n, min({{'p': path, 'l': line_start, 'r': rule_id, 'd': description}}) AS m,
    bool_and({S.any_in("lower(path || ':' || line_start || ' ' || code)", R.DOC_WORDS)}) AS all_docs, bool_and({S.any_in("lower(path || ':' || line_start || ' ' || code)", R.LOCAL_WORDS)}) AS all_local,
    string_agg(lower(path || ':' || line_start || ' ' || code), chr(10)) AS all_items FROM fd GROUP BY 1, 2, 3, 4),
  ge AS (SELECT skill_id, rule_id, severity, title, list(item ORDER BY rn) AS evidence FROM (SELECT *, path || ':' || line_start || ' ' || code AS item, row_number() OVER (PARTITION BY skill_id, rule_id, severity, title ORDER BY path, line_start, rule_id, description) AS rn FROM fd) WHERE rn <= 6 GROUP BY 1, 2, 3, 4),
  gr AS (SELECT g0.*, m.d AS description, 'SecurityEngine' AS source, {_category_sql("lower(g0.rule_id || ' ' || g0.title || ' ' || m.d)")} AS category, evidence,
    'SF-' || lpad((row_number() OVER (PARTITION BY g0.skill_id ORDER BY m.p, m.l, m.r, m.d, g0.rule_id, g0.severity, g0.title))::VARCHAR, 3, '0') AS finding_id
    FROM g0 JOIN ge ON g0.skill_id = ge.skill_id AND g0.rule_id = ge.rule_id AND g0.severity = ge.severity AND g0.title = ge.title)"""


def groups(spark, d):
    return FD.group_findings(Stage(spark, d).findings)


@query("finding_groups", "skill_id:str finding_id:str rule_id:str severity:str title:str category:str n:int evidence:str",
       f"WITH {S.SEED_LINES}, {FIND_CTE}, {GROUP_CTE} SELECT skill_id, finding_id, rule_id, severity, title, category, n, array_to_string(evidence, chr(10)) AS evidence FROM gr")
def finding_groups(spark, d):
    return groups(spark, d).withColumn("evidence", F.array_join("evidence", "\n"))


@query("severity_counts", "skill_id:str high:int medium:int low:int", f"WITH {S.SEED_LINES}, {FIND_CTE} SELECT skill_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM fd GROUP BY 1")
def severity_counts(spark, d):
    return scoring.count_risks(seeded_findings(spark, d))


_CLAMP = "greatest(least({x}, {hi}), {lo})"


def _risk_sql(src: str) -> str:
    return f"""r1 AS (SELECT *, {_CLAMP.format(x='high * 3.0 + medium * 1.2 + 1.0', lo=0, hi=10)} AS exploitability, {_CLAMP.format(x='high * 2.5 + medium * 1.0 + low * 0.2 + 1.0', lo=0, hi=10)} AS impact FROM {src}),
  r2 AS (SELECT * REPLACE (CASE WHEN veto AND high = 0 THEN 1 ELSE high END AS high), {_CLAMP.format(x='exploitability * 0.6 + impact * 0.4', lo=0, hi=10)} AS risk_score FROM r1),
  r3 AS (SELECT *, CASE WHEN risk_score >= 8.5 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS risk_level FROM r2)
  SELECT *, CASE WHEN risk_level IN ('critical', 'high') THEN 'Block' WHEN risk_level = 'medium' THEN 'Review' ELSE 'Pass' END AS admission FROM r3"""


RISK_COLS = "high:int medium:int low:int exploitability:float impact:float risk_score:float risk_level:str admission:str"


_HIGH, _LOW = "l_returnflag = 'R' AND l_quantity >= 40", "l_returnflag <> 'R' AND l_quantity < 40"


@query("risk_by_counts", "l_suppkey:int " + RISK_COLS, f"""WITH c AS (SELECT l_suppkey, count(*) FILTER ({_HIGH}) AS high, count(*) FILTER (NOT ({_HIGH}) AND NOT ({_LOW})) AS medium, count(*) FILTER ({_LOW}) AS low,
  bool_or(l_discount >= 0.1 AND l_quantity >= 50) AS veto FROM lineitem GROUP BY 1), {_risk_sql('c')}""")
def risk_by_counts(spark, d):
    """Every line item as a finding of its supplier, graded by return flag and quantity."""
    returned, large = F.col("l_returnflag") == "R", F.col("l_quantity") >= 40
    counts = {"high": returned & large, "medium": returned != large, "low": ~returned & ~large}
    veto = F.bool_or((F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 50)).alias("veto")
    return scoring.risk_by_counts(C.table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], veto))


@query("trust_scores", "l_suppkey:int trust:float exploitability:float impact:float risk_score:float risk_level:str admission:str", """WITH c AS (SELECT l_suppkey, 100 - avg(l_quantity) AS base, count(*) FILTER (l_returnflag = 'R') / 10.0 AS p1, 100 - 200 * avg(l_tax) AS ics, -30 * avg(l_discount) * 10 AS ti, min(l_quantity) > 1 AS veto FROM lineitem GROUP BY 1),
  t AS (SELECT *, CASE WHEN veto THEN 0 ELSE greatest(least((base - p1) * 0.6 + ics * 0.3 + (100 + ti) * 0.1, 100), 0) END AS trust, greatest(least(2.0 + CASE WHEN veto THEN 4.0 ELSE 0 END + greatest(least(p1 / 20.0, 2.5), 0) + greatest(least(ics / 100.0 * 1.5, 1.5), 0), 10), 0) AS exploitability,
    greatest(least(1.5 + greatest(least((100 - base) / 20.0, 3.0), 0) + CASE WHEN ti < 0 THEN greatest(least(-ti / 20.0, 2.0), 0) ELSE 0 END, 10), 0) AS impact FROM c),
  r AS (SELECT *, greatest(least(exploitability * 0.6 + impact * 0.4, 10), 0) AS risk_score FROM t), v AS (SELECT *, CASE WHEN veto THEN 'high' WHEN risk_score >= 8.5 THEN 'critical' WHEN risk_score >= 7 THEN 'high' WHEN risk_score >= 4 THEN 'medium' ELSE 'low' END AS risk_level FROM r)
  SELECT *, CASE WHEN risk_level IN ('critical', 'high') THEN 'Block' WHEN risk_level = 'medium' THEN 'Review' ELSE 'Pass' END AS admission FROM v""")
def trust_scores(spark, d):
    li = C.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (100 - F.avg("l_quantity")).alias("base"), (F.count_if(F.col("l_returnflag") == "R") / 10.0).alias("p1"), (100 - 200 * F.avg("l_tax")).alias("ics"), (-30 * F.avg("l_discount") * 10).alias("ti"), (F.min("l_quantity") > 1).alias("veto"))
    return scoring.trust_score(li)


@query("aggregate_risk", "skill_id:str blocked:bool risk_level:str", f"""WITH {S.SEED_LINES}, {FIND_CTE} SELECT skill_id, bool_or(rule_id = 'V7-003') AS blocked, CASE WHEN bool_or(rule_id = 'V7-003') OR bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS risk_level FROM fd GROUP BY 1""")
def aggregate_risk(spark, d):
    return scoring.aggregate_risk(seeded_findings(spark, d).withColumn("blocked", F.col("rule_id") == "V7-003"))


@query("mitre_summary", "technique:str n_findings:int n_skills:int", f"""WITH {S.SEED_LINES}, {FIND_CTE}, {GROUP_CTE}, t AS (SELECT skill_id, unnest(CASE rule_id {' '.join(f"WHEN {S.s(k)} THEN {S.lst(v)}" for k, v in FD.RULE_TECHNIQUES.items())} ELSE CASE category {' '.join(f"WHEN {S.s(k)} THEN {S.lst(v)}" for k, v in FD.CATEGORY_TECHNIQUES.items())} END END) AS technique FROM gr)
  SELECT technique, count(*) AS n_findings, count(DISTINCT skill_id) AS n_skills FROM t GROUP BY 1""")
def mitre_summary(spark, d):
    return FD.mitre_summary(groups(spark, d))


# --- support, confidence, review ----------------------------------------------------------------------

def _values(pairs) -> str:
    return ", ".join(f"({', '.join(S.s(x) for x in p)})" for p in pairs)


_SUP = f"""sp AS (SELECT skill_id, category, bool_or(c) AS has_chain, bool_or(a) AS has_alert, bool_or(h) AS high_signal, bool_or(t) AS threat_alert FROM (
  SELECT DISTINCT sc.skill_id, m.fc AS category, TRUE AS c, FALSE AS a, FALSE AS h, FALSE AS t FROM sc JOIN ch ON sc.skill_id = ch.skill_id AND sc.path = ch.path AND sc.seg = ch.seg JOIN (VALUES {_values((b, c) for c, bs in FD.SUPPORT_CATEGORIES.items() for b in bs)}) m(b, fc) ON sc.category = m.b
  UNION ALL SELECT skill_id, m.fc, FALSE, TRUE, alert IN ({', '.join(S.s(x) for x in FD.HIGH_SIGNAL_ALERTS)}), alert IN ({', '.join(S.s(x) for x in FD.THREAT_ALERTS)}) FROM al JOIN (VALUES {_values((b, c) for c, bs in FD.SUPPORT_ALERTS.items() for b in bs)}) m(b, fc) ON al.alert = m.b) GROUP BY 1, 2)"""
_FLAGS = f"""{_DIFF}, {_SIG}, sf AS (SELECT sk.skill_id, coalesce(network_targets, FALSE) AS has_ti, (SELECT count(*) FROM df WHERE df.skill_id = sk.skill_id) AS n_diffs, sk.skill_id IN (SELECT skill_id FROM sgn) AS evasion FROM sk LEFT JOIN ob ON sk.skill_id = ob.skill_id)"""
_BASE = f"{S.SEED_LINES}, {S.SEED_SKILLS}, {FIND_CTE}, {GROUP_CTE}, {BEHAVIOR_CTE}, {FILE_SEG}, {_CHAIN}, {_ALERT}, {_SUP}, {_SENT}, {_OBS[_OBS.index('ob AS'):]}, {_FLAGS}"
_BASIS = "list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN has_chain THEN 'behavior chain' END, CASE WHEN has_alert THEN 'sequence alert' END, CASE WHEN category = 'outbound' AND has_ti THEN 'reputation' END, CASE WHEN category = 'intent' AND n_diffs > 0 THEN 'intent difference' END, CASE WHEN category = 'evasion' AND evasion THEN 'evasion signal' END], lambda x: x IS NOT NULL)"
CONF_CTE = f"""cf0 AS (SELECT gr.*, coalesce(has_chain, FALSE) AS has_chain, coalesce(has_alert, FALSE) AS has_alert, coalesce(high_signal, FALSE) AS high_signal, coalesce(threat_alert, FALSE) AS threat_alert, coalesce(has_ti, FALSE) AS has_ti, coalesce(n_diffs, 0) AS n_diffs, coalesce(evasion, FALSE) AS evasion
    FROM gr LEFT JOIN sp ON gr.skill_id = sp.skill_id AND gr.category = sp.category LEFT JOIN sf ON gr.skill_id = sf.skill_id),
  cf AS (SELECT *, 1 + (n > 1)::INT + 2 * has_chain::INT + 2 * has_alert::INT + (category = 'outbound' AND has_ti)::INT + (category = 'intent' AND n_diffs > 0)::INT + 2 * (category = 'evasion' AND evasion)::INT AS confidence_score,
    CASE WHEN len({_BASIS}) > 0 THEN {_BASIS} ELSE ['rule hit only'] END AS basis FROM cf0),
  cg AS (SELECT *, CASE WHEN confidence_score >= 4 THEN 'high' WHEN confidence_score >= 2 THEN 'medium' ELSE 'review' END AS confidence FROM cf)"""






@query("finding_confidence", "skill_id:str finding_id:str category:str confidence_score:int confidence:str basis:str", f"WITH {_BASE}, {CONF_CTE} SELECT skill_id, finding_id, category, confidence_score, confidence, array_to_string(basis, ';') AS basis FROM cg")
def finding_confidence(spark, d):
    return Stage(spark, d).confident.withColumn("basis", F.array_join("basis", ";"))


_AP = "CASE category " + " ".join(f"WHEN {S.s(k)} THEN {S.s(v)}" for k, v in R.ATTACK_PATHS.items()) + " ELSE description END"
ASSESS_CTE = f"""{CONF_CTE}, as0 AS (SELECT *, has_chain OR has_alert AS has_behavior, all_docs AS docs_only, all_local AS internal_only,
    has_chain OR threat_alert OR {S.any_in("lower(title || ' ' || CASE WHEN has_alert THEN '' ELSE " + _AP + " END || ' ' || all_items)", R.THREAT_WORDS)} AS threat_like FROM cg),
  as1 AS (SELECT *, (len(evidence) > 0)::INT + (len(basis) > 0)::INT + (n > 1)::INT + 2 * has_behavior::INT + high_signal::INT - docs_only::INT AS strength_score FROM as0),
  as2 AS (SELECT *, CASE WHEN strength_score >= 4 THEN 'strong' WHEN strength_score >= 2 THEN 'medium' ELSE 'weak' END AS strength, CASE WHEN has_behavior THEN 'elevated' WHEN confidence = 'high' THEN 'medium_high' ELSE 'pending' END AS exploitability,
    CASE WHEN category IN ('execution', 'outbound', 'credential', 'persistence', 'evasion', 'intent') THEN category ELSE 'depends' END AS impact FROM as1),
  asd AS (SELECT *, CASE WHEN internal_only AND NOT threat_like THEN 'likely_false_positive' WHEN strength = 'strong' AND exploitability = 'elevated' AND NOT docs_only THEN 'likely_real' WHEN docs_only AND NOT threat_like THEN 'likely_false_positive' ELSE 'manual' END AS fp_verdict FROM as2)"""




@query("fp_review", "skill_id:str finding_id:str exploitability:str impact:str strength:str fp_verdict:str", f"WITH {_BASE}, {ASSESS_CTE} SELECT * FROM asd")
def fp_review(spark, d):
    return R.fp_review(Stage(spark, d).assessed)


_MISS = f"list_filter([CASE WHEN len(evidence) = 0 THEN {S.s(R.MISSING[0])} END, CASE WHEN strength <> 'strong' AND NOT has_behavior THEN {S.s(R.MISSING[1])} END, CASE WHEN docs_only AND NOT threat_like THEN {S.s(R.MISSING[2])} END, CASE WHEN internal_only AND NOT threat_like THEN {S.s(R.MISSING[3])} END], lambda x: x IS NOT NULL)"
VERDICT_CTE = f"""{ASSESS_CTE}, vm AS (SELECT *, {_MISS} AS missing FROM asd), dv AS (SELECT *, CASE WHEN (docs_only OR internal_only) AND NOT threat_like AND NOT has_behavior THEN 'likely_false_positive|medium_high'
  WHEN fp_verdict = 'likely_false_positive' AND len(missing) > 0 AND strength <> 'strong' AND NOT has_behavior THEN 'likely_false_positive|medium_high'
  WHEN len(evidence) > 0 AND len(basis) > 0 AND has_behavior AND NOT docs_only AND NOT internal_only THEN 'confirmed|medium_high' WHEN len(missing) = 0 AND (fp_verdict = 'likely_real' OR strength = 'strong' OR confidence = 'high') THEN 'confirmed|high'
  WHEN len(missing) >= 3 THEN 'needs_manual_review|low' ELSE 'needs_manual_review|medium' END AS v FROM vm)"""


@query("deterministic_verdict", "skill_id:str finding_id:str verdict:str confidence:str missing:str", f"WITH {_BASE}, {VERDICT_CTE} SELECT skill_id, finding_id, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS confidence, array_to_string(missing, ';') AS missing FROM dv")
def deterministic_verdict(spark, d):
    return R.deterministic_verdict(Stage(spark, d).assessed).withColumn("missing", F.array_join("missing", ";"))




EXT_CTE = """ex AS (SELECT skill_id, finding_id, CASE WHEN n > 3 THEN 'confirmed' WHEN n <= 1 AND (category = 'static' OR n * 30 + 40 >= 80) THEN 'likely_false_positive' ELSE 'needs_manual_review' END AS verdict,
  CASE WHEN n > 3 THEN 'high' WHEN n <= 1 AND (category = 'static' OR n * 30 + 40 >= 80) THEN 'medium_high' ELSE 'medium' END AS confidence, 'llm-vuln-reviewer' AS reviewer FROM gr)"""


@query("external_verdicts", "skill_id:str finding_id:str verdict:str confidence:str reviewer:str", f"WITH {S.SEED_LINES}, {FIND_CTE}, {GROUP_CTE}, {EXT_CTE} SELECT * FROM ex")
def external_verdicts(spark, d):
    return R.external_verdicts(Stage(spark, d).analyses)


# consensus of the two reviewers of a finding: rank by confidence, then the rule-based reviewer
_CR = "CASE confidence WHEN 'high' THEN 4 WHEN 'medium_high' THEN 3 WHEN 'medium' THEN 2 WHEN 'medium_low' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"
CONS_CTE = f"""{VERDICT_CTE}, {EXT_CTE}, uv AS (SELECT skill_id, finding_id, verdict, confidence, 1 AS rr, reviewer FROM ex UNION ALL SELECT skill_id, finding_id, split_part(v, '|', 1), split_part(v, '|', 2), 2, 'deterministic-vuln-reviewer' FROM dv),
  cn AS (SELECT skill_id, finding_id, CASE WHEN count(DISTINCT verdict) = 1 THEN any_value(verdict) ELSE 'needs_manual_review' END AS final_verdict, CASE WHEN count(DISTINCT verdict) = 1 THEN arg_max(confidence, {_CR} * 10 + rr) ELSE 'low' END AS final_confidence,
    CASE WHEN count(DISTINCT verdict) = 1 THEN arg_max(reviewer, {_CR} * 10 + rr) ELSE string_agg(DISTINCT reviewer, '+' ORDER BY reviewer) END AS final_reviewer FROM uv GROUP BY 1, 2)"""
REV_CTE = f"""{CONS_CTE}, rv AS (SELECT asd.*, final_verdict, CASE WHEN strength = 'strong' THEN CASE WHEN final_verdict = 'likely_false_positive' AND docs_only THEN 'moderate' ELSE 'strong' END WHEN strength = 'medium' THEN CASE WHEN confidence = 'high' AND has_behavior THEN 'strong' ELSE 'moderate' END ELSE 'weak' END AS tier
  FROM asd JOIN cn ON asd.skill_id = cn.skill_id AND asd.finding_id = cn.finding_id)"""






@query("finding_consensus", "skill_id:str finding_id:str verdict:str confidence:str reviewer:str", f"WITH {_BASE}, {CONS_CTE} SELECT skill_id, finding_id, final_verdict AS verdict, final_confidence AS confidence, final_reviewer AS reviewer FROM cn")
def finding_consensus(spark, d):
    return Stage(spark, d).consensus


_CLASS = """CASE WHEN final_verdict = 'likely_false_positive' AND tier <> 'strong' THEN 'low' WHEN severity = 'high' AND tier = 'strong' AND final_verdict = 'confirmed' THEN 'high' WHEN final_verdict = 'needs_manual_review' AND severity = 'high' THEN 'medium'
  WHEN severity = 'medium' AND tier = 'weak' THEN 'low' WHEN severity IN ('high', 'medium') THEN 'medium' ELSE 'low' END"""


@query("reviewed_counts", "skill_id:str high:int medium:int low:int", f"WITH {_BASE}, {REV_CTE} SELECT skill_id, count(*) FILTER (c = 'high') AS high, count(*) FILTER (c = 'medium') AS medium, count(*) FILTER (c = 'low') AS low FROM (SELECT skill_id, {_CLASS} AS c FROM rv) GROUP BY 1")
def reviewed_counts(spark, d):
    return R.reviewed_counts(Stage(spark, d).reviewed)


@query("ordered_findings", "skill_id:str review_rank:int severity_rank:int finding_id:str tier:str", f"""WITH {_BASE}, {REV_CTE} SELECT skill_id, CASE final_verdict WHEN 'confirmed' THEN 0 WHEN 'needs_manual_review' THEN 1 ELSE 3 END AS review_rank, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank, finding_id, tier FROM rv""")
def ordered_findings(spark, d):
    return R.order_findings(Stage(spark, d).reviewed)


@query("source_labels", "skill_id:str finding_id:str labels:str", f"""WITH {_BASE}, {REV_CTE} SELECT skill_id, finding_id, array_to_string(list_filter(['rule', CASE WHEN contains(lower(array_to_string(basis, ' ')), 'intent difference') THEN 'semantic' END, CASE WHEN contains(all_items, 'sandbox') OR contains(all_items, 'runtime') THEN 'dynamic' END,
  CASE WHEN contains(array_to_string(basis, ' '), 'reputation') THEN 'reputation' END, CASE final_verdict WHEN 'confirmed' THEN 'verified' WHEN 'likely_false_positive' THEN 'suspected false positive' ELSE 'unverified' END, CASE WHEN final_verdict = 'needs_manual_review' THEN 'needs manual review' END, 'double checked'], lambda x: x IS NOT NULL), ',') AS labels FROM rv""")
def source_labels(spark, d):
    return Stage(spark, d).reviewed.select("skill_id", "finding_id", F.array_join(R.source_labels(F.col("source"), F.col("basis"), F.col("seen.runtime"), F.col("final_verdict"), F.lit(2)), ",").alias("labels"))


@query("learned_feedback", "rule_id:str token:str", f"WITH {_BASE}, {REV_CTE}, t AS (SELECT rule_id, all_items AS e FROM rv WHERE final_verdict = 'likely_false_positive') " + " UNION ".join(f"SELECT DISTINCT rule_id, {S.s(t)} AS token FROM t WHERE contains(e, {S.s(t)})" for t in R.FEEDBACK_TOKENS))
def learned_feedback(spark, d):
    return R.learn_feedback(Stage(spark, d).reviewed)


_STATE = """ss AS (SELECT sk.skill_id, count(fd.rule_id) FILTER (fd.rule_id = 'V7-003') > 0 AS blocked, sk.skill_id IN (SELECT skill_id FROM sgn) AND sk.name LIKE '%7' AS evasion, count(*) FILTER (fd.severity = 'high') AS high, count(*) FILTER (fd.severity = 'medium') AS medium FROM sk LEFT JOIN fd ON sk.skill_id = fd.skill_id GROUP BY ALL)"""


@query("reviewed_decision", "skill_id:str decision:str", f"""WITH {_BASE}, {REV_CTE}, {_STATE}, k AS (SELECT *, final_verdict = 'likely_false_positive' AND tier <> 'strong' AS fp, severity = 'high' AND tier = 'strong' AND final_verdict = 'confirmed' AS hi0 FROM rv),
  sg2 AS (SELECT skill_id, bool_or(NOT fp AND hi0) AS hi, bool_or(NOT fp AND NOT hi0 AND (severity = 'high' OR (severity = 'medium' AND tier IN ('strong', 'moderate')))) AS med FROM k GROUP BY 1)
  SELECT ss.skill_id, CASE WHEN blocked OR evasion THEN 'high' WHEN sg2.skill_id IS NULL THEN CASE WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END WHEN hi THEN 'high' WHEN med THEN 'medium' WHEN high > 0 OR medium > 1 THEN 'medium' ELSE 'low' END AS decision FROM ss LEFT JOIN sg2 ON ss.skill_id = sg2.skill_id""")
def reviewed_decision(spark, d):
    st = Stage(spark, d)
    f = st.findings.groupBy("skill_id").agg(F.bool_or(F.col("rule_id") == "V7-003").alias("blocked"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    ev = st.signals.select("skill_id").distinct().withColumn("_e", F.lit(True))
    state = st.skills.select("skill_id", "name").join(f, "skill_id", "left").join(ev, "skill_id", "left").select(
        "skill_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), (F.coalesce("_e", F.lit(False)) & F.col("name").endswith("7")).alias("evasion"), F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("medium", F.lit(0)).alias("medium"))
    return R.reviewed_decision(st.reviewed, state)


# --- consensus over the label table -------------------------------------------------------------------------

@query("verdict_consensus", "finding_id:str verdict:str confidence:str reviewer:str missing:str", f"""WITH {S.LABELS}, a AS (SELECT finding_id, count(DISTINCT verdict) = 1 AS same, any_value(verdict) AS v, arg_max(confidence, cr * 10 + rr) AS c, arg_max(reviewer, cr * 10 + rr) AS r, arg_max(coalesce(missing, ''), cr * 10 + rr) AS m,
    string_agg(DISTINCT missing, ';' ORDER BY missing) AS all_m, string_agg(DISTINCT reviewer, '+' ORDER BY reviewer) AS revs FROM vd GROUP BY 1)
  SELECT finding_id, CASE WHEN same THEN v ELSE 'needs_manual_review' END AS verdict, CASE WHEN same THEN c ELSE 'low' END AS confidence, CASE WHEN same THEN r ELSE revs END AS reviewer, CASE WHEN same THEN m ELSE coalesce(all_m, '') END AS missing FROM a""")
def verdict_consensus(spark, d):
    return R.verdict_consensus(C.label_verdicts(spark, d), ("finding_id",)).withColumn("missing", F.array_join("missing", ";"))


# --- evidence windows -------------------------------------------------------------------------------------------

@query("evidence_windows", "skill_id:str path:str win_start:int win_end:int n_hits:int body:str", f"""WITH {S.SEED_LINES}, h AS ({_pack_sql(P.ENVIRONMENT_EVASION)}), n AS (SELECT skill_id, path, max(line_no) AS n FROM l GROUP BY 1, 2),
  w AS (SELECT DISTINCT h.skill_id, h.path, line_no, greatest(line_no - 3, 1) AS s, least(line_no + 3, n) AS e FROM h JOIN n ON h.skill_id = n.skill_id AND h.path = n.path),
  m AS (SELECT *, max(e) OVER (PARTITION BY skill_id, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY skill_id, path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
  g AS (SELECT skill_id, path, k, min(s) AS win_start, max(e) AS win_end, count(*) AS n_hits, list(line_no) AS hs FROM i GROUP BY 1, 2, 3)
  SELECT g.skill_id, g.path, win_start, win_end, n_hits, string_agg(CASE WHEN list_contains(hs, l.line_no) THEN '> ' ELSE '  ' END || lpad(l.line_no::VARCHAR, 4, ' ') || ' | ' || l.line, chr(10) ORDER BY l.line_no) AS body FROM g JOIN l ON g.skill_id = l.skill_id AND g.path = l.path AND l.line_no BETWEEN win_start AND win_end GROUP BY 1, 2, 3, 4, 5""")
def evidence_windows(spark, d):
    return FD.pack_windows(C.seeded_files(spark, d), P.ENVIRONMENT_EVASION)


@query("deduped_evidence", "skill_id:str path:str win_start:int body:str", f"""WITH {S.DOC_LINES}, w AS (SELECT skill_id, path, line_no AS win_start, line AS body, {S.trim("regexp_replace(line, '\\s+', ' ', 'g')")} AS k FROM doc_l) SELECT skill_id, path, win_start, body FROM (SELECT *, row_number() OVER (PARTITION BY skill_id, path, k ORDER BY win_start) AS rn FROM w) WHERE rn = 1""")
def deduped_evidence(spark, d):
    """Document lines as evidence bodies; repeated lines collapse."""
    w = scan.explode_lines(C.document_files(spark, d)).select("skill_id", "path", F.col("line_no").alias("win_start"), F.col("line").alias("body"))
    return FD.dedupe_evidence(w)


# --- calibration, synthesized findings --------------------------------------------------------------------------------



_BC = f"""bc AS (SELECT p.skill_id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in P.BEHAVIOR_CATEGORIES)}, (SELECT count(*) FROM ch WHERE ch.skill_id = p.skill_id) AS chains, (SELECT count(*) FROM al WHERE al.skill_id = p.skill_id) AS alerts,
  (SELECT count(*) FROM al WHERE al.skill_id = p.skill_id AND alert IN ({', '.join(S.s(a) for a in B.VETO_ALERTS)})) AS veto_alerts, 0 AS warnings FROM bp p GROUP BY 1)"""
_MOD = "(alerts > 0 OR chains > 0 OR credential > 0 OR priv_esc > 0 OR c2_beacon > 0 OR collection > 0)"


@query("calibrated_risk", "skill_id:str ics:int " + RISK_COLS, f"""WITH {_BASE}, {_BC}, q AS (SELECT sk.skill_id, CASE WHEN bc.skill_id IS NULL THEN 100 ELSE 100 - least({_DED}, 100) END AS ics, coalesce({_VETO}, FALSE) AS veto0, coalesce({_MOD}, FALSE) AS moderate,
    (SELECT count(*) FROM df WHERE df.skill_id = sk.skill_id) AS nd, coalesce((SELECT bool_or(diff IN ({', '.join(S.s(x) for x in P.HIGH_RISK_DIFFS)})) FROM df WHERE df.skill_id = sk.skill_id), FALSE) AS hd, sk.skill_id IN (SELECT skill_id FROM sgn) AS ev,
    (SELECT count(*) FROM fd WHERE fd.skill_id = sk.skill_id AND severity = 'high') AS h, (SELECT count(*) FROM fd WHERE fd.skill_id = sk.skill_id AND severity = 'medium') AS m, (SELECT count(*) FROM fd WHERE fd.skill_id = sk.skill_id AND severity = 'low') AS low FROM sk LEFT JOIN bc ON sk.skill_id = bc.skill_id),
  c AS (SELECT skill_id, ics, h + hd::INT + (veto0 OR ev)::INT AS high, m + (NOT hd AND nd > 0)::INT + moderate::INT AS medium, low, veto0 OR ev AS veto FROM q), {_risk_sql('c')}""")
def calibrated_risk(spark, d):
    """Findings, intent differences, behaviour and evasion combined to one level per skill."""
    st = Stage(spark, d)
    counts = st.counts
    risk = B.behavior_risk(counts).select("skill_id", "ics", F.col("veto").alias("bveto"), B.moderate_signals(counts).alias("moderate"))
    score = sets.intent_score(st.skills, st.observed)
    ev = st.signals.select("skill_id").distinct().withColumn("evasion", F.lit(True))
    j = score.join(risk, "skill_id", "left").join(ev, "skill_id", "left").join(scoring.count_risks(st.findings), "skill_id", "left").fillna(
        {"ics": 100, "bveto": False, "moderate": False, "evasion": False, "high": 0, "medium": 0, "low": 0})
    j = j.withColumns({"veto": F.col("bveto") | F.col("evasion"), "malicious": F.col("bveto") | F.col("evasion"), "suspicious": F.lit(False)})
    return scoring.risk_by_counts(scoring.calibrated_counts(j))


_SYN = "skill_id:str source:str rule_id:str severity:str title:str description:str"


@query("synthesized_findings", _SYN, f"""WITH {_BASE}, {_BC} SELECT skill_id, 'IntentEngine' AS source, 'V7-006' AS rule_id, CASE WHEN diff IN ({', '.join(S.s(x) for x in P.HIGH_RISK_DIFFS)}) THEN 'high' ELSE 'medium' END AS severity, {S.s(RU.RULES['V7-006'].name)} AS title, diff AS description FROM df
  UNION ALL SELECT skill_id, 'EvasionGuard', 'V7-008', 'high', {S.s(RU.RULES['V7-008'].name)}, signal FROM sgn """ + " ".join(
    f"UNION ALL SELECT skill_id, 'BehaviorGuard', '{rid}', '{sev}', {S.s(RU.RULES[rid].name)}, 'behavior evidence ' || ({' + '.join(c if c != 'evasion' else '0' for c in ins)}) FROM bc WHERE ({' + '.join(c if c != 'evasion' else '0' for c in ins)}) > 0" for rid, sev, ins in FD.BEHAVIOR_SUMMARIES))
def synthesized_findings(spark, d):
    st = Stage(spark, d)
    return FD.union_findings([FD.synthesize_intent(st.diffs), FD.synthesize_evasion(st.signals), FD.synthesize_behavior(st.counts)])


@query("synthesized_ti", _SYN, f"""WITH {_TI_CTE}, {_local_sql('pt')}, z AS (SELECT skill_id, pt.target, reputation, reputation = 'policy' OR {S.any_in('lower(pt.target)', ['polymarket', 'usdc'])} AS pol FROM pt JOIN lr ON pt.target = lr.target WHERE reputation IN ('suspicious', 'policy'))
  SELECT skill_id, 'ThreatIntel' AS source, 'V7-003' AS rule_id, CASE WHEN pol THEN 'medium' ELSE 'high' END AS severity, CASE WHEN pol THEN {S.s(FD.POLICY_TITLE)} ELSE {S.s(RU.RULES['V7-003'].name)} END AS title, 'reputation ' || reputation AS description FROM z""")
def synthesized_ti(spark, d):
    t = page_and_seed_targets(spark, d)
    return FD.synthesize_ti(t.join(I.local_reputation(t.select("target").distinct()), "target"))


@query("synthesized_coverage", _SYN, f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {FIND_CTE}, u AS (SELECT sk.skill_id, i, name AS n FROM (SELECT skill_id FROM sk) sk CROSS JOIN (VALUES {', '.join(f"({i}, {S.s(r.rule_id)}, {S.s(r.name)})" for i, r in enumerate(RU.default_rules()))}) v(i, rule_id, name)
    WHERE sk.skill_id IN (SELECT skill_id FROM fd) AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.skill_id = sk.skill_id AND fd.rule_id = v.rule_id) UNION ALL SELECT skill_id, 999, 'unknown rule' FROM sk)
  SELECT skill_id, 'V7Coverage' AS source, 'V7-AUTO-COVERAGE' AS rule_id, 'high' AS severity, 'V7 可自动评估项覆盖不足' AS title, '未覆盖项: ' || string_agg(n, ';' ORDER BY i) AS description FROM u GROUP BY 1""")
def synthesized_coverage(spark, d):
    return FD.synthesize_coverage(FD.coverage(_MATRIX, RU.default_rules(), seeded_findings(spark, d).select("skill_id", "rule_id"), C.seeded_skills(spark, d)))


@query("concrete_findings", "skill_id:str source:str rule_id:str n:int", f"""WITH {_BASE}, {_BC}, sy AS (""" + " UNION ALL ".join(f"SELECT skill_id, '{rid}' AS rule_id FROM bc WHERE ({' + '.join(c if c != 'evasion' else '0' for c in ins)}) > 0" for rid, _, ins in FD.BEHAVIOR_SUMMARIES) + """)
  SELECT skill_id, 'SecurityEngine' AS source, rule_id, count(*) AS n FROM fd GROUP BY ALL UNION ALL SELECT skill_id, 'BehaviorGuard', rule_id, count(*) FROM sy WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.skill_id = sy.skill_id AND fd.rule_id = sy.rule_id) GROUP BY ALL""")
def concrete_findings(spark, d):
    """Behaviour summaries disappear where a concrete finding of the rule exists."""
    st = Stage(spark, d)
    f = FD.union_findings([st.findings, FD.synthesize_behavior(st.counts)])
    return FD.drop_summary_findings(f).groupBy("skill_id", "source", "rule_id").agg(F.count("*").alias("n"))


@query("result_findings", "skill_id:str source:str rule_id:str title:str n:int", f"""WITH {S.SEED_LINES}, {FIND_CTE}, rs AS (SELECT DISTINCT skill_id, CASE WHEN rule_id IN ('V7-003', 'V7-013') THEN CASE rule_id WHEN 'V7-003' THEN {S.s(RU.RULES['V7-009'].reason)} ELSE {S.s(RU.RULES['V7-013'].reason)} END ELSE 'unlisted reason' END AS reason FROM fd WHERE severity = 'high'),
  rr AS (SELECT skill_id, CASE WHEN reason = 'unlisted reason' THEN 'V7-HIGH-RISK-BLOCK' WHEN reason = {S.s(RU.RULES['V7-013'].reason)} THEN 'V7-013' ELSE 'V7-009' END AS rule_id, CASE WHEN reason = 'unlisted reason' THEN '高风险阻断项' WHEN reason = {S.s(RU.RULES['V7-013'].reason)} THEN {S.s(RU.RULES['V7-013'].name)} ELSE {S.s(RU.RULES['V7-009'].name)} END AS title FROM rs)
  SELECT skill_id, 'SecurityEngine' AS source, rule_id, title, count(*) AS n FROM fd GROUP BY ALL UNION ALL SELECT skill_id, 'SecurityEngine', rule_id, title, 1 FROM rr WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.skill_id = rr.skill_id AND fd.rule_id = rr.rule_id)
  UNION ALL SELECT skill_id, 'StaticAnalyzer', 'DAN-001', '危险函数调用: ' || function, count(*) FROM (""" + _CALL_SQL + f""") GROUP BY ALL
  UNION ALL SELECT DISTINCT skill_id, 'StaticAnalyzer', 'SEC-001', '发现硬编码凭证', 1 FROM fd WHERE rule_id = 'V7-004'""")
def result_findings(spark, d):
    st = Stage(spark, d)
    f = st.findings
    reason = F.when(F.col("rule_id") == "V7-003", F.lit(RU.RULES["V7-009"].reason)).when(F.col("rule_id") == "V7-013", F.lit(RU.RULES["V7-013"].reason)).otherwise(F.lit("unlisted reason"))
    reasons = f.where("severity = 'high'").select("skill_id", reason.alias("reason"))
    out = FD.findings_from_results(f, reasons, scan.dangerous_calls(scan.explode_lines(st.files)), f.where("rule_id = 'V7-004'").select("skill_id"))
    return out.groupBy("skill_id", "source", "rule_id", "title").agg(F.count("*").alias("n"))


@query("cross_check", "skill_id:str warning:str", f"""WITH {S.SEED_LINES}, {FIND_CTE}, {_OBS}, t AS (SELECT skill_id, lower(rule_id || ' ' || title || ' ' || description || ' ' || code) AS t FROM fd), i AS (SELECT skill_id, {', '.join(f"bool_or({S.any_in('t', w)}) AS {k}" for k, w in sets.CROSS_CHECK.items())} FROM t GROUP BY 1),
  j AS (SELECT i.skill_id, i.external, i.exec, i.credential AS cred, coalesce(outbound OR network_targets, FALSE) AS oe, coalesce(execute, FALSE) AS ox, coalesce(ob.credential, FALSE) AS oc FROM i LEFT JOIN ob ON i.skill_id = ob.skill_id)
  SELECT skill_id, 'static external not observed' AS warning FROM j WHERE external AND NOT oe UNION ALL SELECT skill_id, 'static exec not observed' FROM j WHERE exec AND NOT ox UNION ALL SELECT skill_id, 'static credential not observed' FROM j WHERE cred AND NOT oc""")
def cross_check(spark, d):
    st = Stage(spark, d)
    return sets.cross_check(st.findings, st.observed)


# --- rules, coverage --------------------------------------------------------------------------------------------------------

_RULE_VALUES = ", ".join(f"({S.s(r.rule_id)}, {S.s(r.layer)}, {S.s(r.dtype)}, {S.s(r.severity)}, {S.s(r.action)})" for r in RU.default_rules())


@query("rule_eval_log", "skill_id:str rule_id:str layer:str dtype:str evaluated:bool risk_label:str n_findings:int places:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {FIND_CTE}, rl AS (SELECT * FROM (VALUES {_RULE_VALUES}) v(rule_id, layer, dtype, severity, action)),
  a AS (SELECT *, row_number() OVER (PARTITION BY skill_id, rule_id ORDER BY path, line_start, rule_id, description) AS rn FROM fd), b AS (SELECT skill_id, rule_id, count(*) AS n, max(severity) FILTER (rn = 1) AS sev, list_distinct(list(path || ':' || line_start ORDER BY rn) FILTER (rn <= 2)) AS pl, string_agg(path || ':' || line_start, ';' ORDER BY rn) FILTER (rn <= 2) AS places FROM a GROUP BY 1, 2)
  SELECT sk.skill_id, rl.rule_id, layer, dtype, TRUE AS evaluated, coalesce(sev, 'none') AS risk_label, coalesce(n, 0) AS n_findings, CASE WHEN len(pl) = 1 THEN pl[1] ELSE coalesce(places, '') END AS places FROM sk CROSS JOIN rl LEFT JOIN b ON sk.skill_id = b.skill_id AND rl.rule_id = b.rule_id""")
def rule_eval_log(spark, d):
    return FD.rule_eval_log(C.seeded_skills(spark, d), seeded_findings(spark, d), RU.default_rules())


@query("rule_set_profile", "dimension:str value:str n_rules:int n_hits:int", f"""WITH {S.SEED_LINES}, {FIND_CTE}, rl AS (SELECT v.*, coalesce(h, 0) AS h FROM (VALUES {_RULE_VALUES}) v(rule_id, layer, dtype, severity, action) LEFT JOIN (SELECT rule_id AS r, count(*) AS h FROM fd GROUP BY 1) ON rule_id = r)
  SELECT 'layer' AS dimension, layer AS value, count(*) AS n_rules, sum(h) AS n_hits FROM rl GROUP BY layer UNION ALL SELECT 'severity', severity, count(*), sum(h) FROM rl GROUP BY severity UNION ALL SELECT 'detection', dtype, count(*), sum(h) FROM rl GROUP BY dtype UNION ALL SELECT 'action', action, count(*), sum(h) FROM rl GROUP BY action""")
def rule_set_profile(spark, d):
    return FD.rule_set_profile(RU.rules_df(spark), seeded_findings(spark, d))


_MATRIX = [(r.rule_id, r.name, "", "", "") for r in RU.default_rules()] + [("M-1", "runtime probe", "auto", "runtime", ""), ("M-2", "manual interview", "manual", "", ""), ("M-3", "unknown rule", "auto", "rule", "V9-1")]


@query("coverage", "skill_id:str auto_total:int auto_covered:int uncovered:str manual_total:int manual_items:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {FIND_CTE}, mx AS (SELECT * FROM (VALUES {', '.join(f"({i}, {S.s(r.rule_id)}, {S.s(r.name)})" for i, r in enumerate(RU.default_rules()))}) v(i, rule_id, name)),
  ev AS (SELECT DISTINCT skill_id, rule_id FROM fd), u AS (SELECT sk.skill_id, i, mx.name FROM sk CROSS JOIN mx WHERE EXISTS (SELECT 1 FROM ev WHERE ev.skill_id = sk.skill_id) AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.skill_id = sk.skill_id AND ev.rule_id = mx.rule_id) UNION ALL SELECT skill_id, 999, 'unknown rule' FROM sk)
  SELECT skill_id, 32 AS auto_total, 32 - count(*) AS auto_covered, string_agg(name, ';' ORDER BY i) AS uncovered, 1 AS manual_total, 'manual interview' AS manual_items FROM u GROUP BY 1""")
def coverage(spark, d):
    return FD.coverage(_MATRIX, RU.default_rules(), seeded_findings(spark, d).select("skill_id", "rule_id"), C.seeded_skills(spark, d))


@query("unchecked_rules", "skill_id:str rule_id:str", f"WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {FIND_CTE} SELECT sk.skill_id, rule_id FROM sk CROSS JOIN (VALUES {_RULE_VALUES}) v(rule_id, layer, dtype, severity, action) EXCEPT SELECT skill_id, rule_id FROM fd")
def unchecked_rules(spark, d):
    return scoring.unchecked_rules([r.rule_id for r in RU.default_rules()], seeded_findings(spark, d).select("skill_id", "rule_id"), C.seeded_skills(spark, d))


@query("item_scores", "skill_id:str scores:str", f"""WITH {S.SEED_LINES}, {FIND_CTE}, g AS (SELECT skill_id, rule_id, greatest(10 - count(*), 0) AS sc FROM fd GROUP BY 1, 2) SELECT skill_id, string_agg(rule_id || '=' || sc, ',' ORDER BY rule_id) AS scores FROM g GROUP BY 1""")
def item_scores(spark, d):
    ev = seeded_findings(spark, d).groupBy("skill_id", "rule_id").agg(F.greatest(10 - F.count("*"), F.lit(0)).alias("score"))
    return scoring.item_scores(ev).select("skill_id", F.array_join(F.transform(F.map_entries("item_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("scores"))


_R2R = "CASE WHEN ({lic}) THEN 'V7-005' WHEN {cry} THEN 'V7-003' {names} {words} END".format(
    lic=f"(contains(t, 'license') OR contains(t, '许可证')) AND NOT ({S.any_in('t', LICENSE_NOTICE)} AND NOT {S.any_in('t', LICENSE_NOTICE_BLOCKERS)}) AND {S.any_in('t', FD.LICENSE_CHECK)} AND {S.any_in('t', FD.LICENSE_WEAK)}",
    cry=S.any_in("t", FD.CRYPTO_WORDS), names=" ".join(f"WHEN contains(t, {S.s(r.name.lower())}) THEN {S.s(r.rule_id)}" for r in sorted(RU.default_rules(), key=lambda r: r.rule_id)),
    words=" ".join(f"WHEN {S.any_in('t', w)} THEN {S.s(k)}" for k, w in FD.RISK_WORDS))


@query("risk_to_rule", "skill_id:str path:str line_no:int rule_id:str", f"WITH {S.SEED_LINES}, x AS (SELECT skill_id, path, line_no, lower(line) AS t FROM l) SELECT * FROM (SELECT skill_id, path, line_no, {_R2R} AS rule_id FROM x) WHERE rule_id IS NOT NULL")
def risk_to_rule(spark, d):
    """Free text mapped to rules: the corpus lines stand in for model risk texts."""
    return scan.explode_lines(C.seeded_files(spark, d)).withColumn("rule_id", FD.risk_to_rule(F.col("line"))).where("rule_id is not null")


@query("external_intent_findings", "skill_id:str rule_id:str severity:str blocked:bool description:str", f"""WITH {S.SEED_LINES}, {FIND_CTE}, {GROUP_CTE}, a AS (SELECT skill_id, CASE WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' END AS s FROM gr GROUP BY 1) SELECT skill_id, 'V7-006' AS rule_id, s AS severity, s = 'high' AS blocked, 'stated intent and behaviour differ' AS description FROM a WHERE s IS NOT NULL""")
def external_intent_findings(spark, d):
    g = groups(spark, d).groupBy("skill_id").agg(F.bool_or(F.col("severity") == "high").alias("h"), F.bool_or(F.col("severity") == "medium").alias("m"))
    a = g.select("skill_id", F.when(F.col("h"), F.lit("高风险")).when(F.col("m"), F.lit("Review")).otherwise(F.lit("pass")).alias("intent_risk_level"), F.lit(" ").alias("intent_mismatch"))
    return FD.external_intent_findings(a)


@query("audit_events", "skill_id:str type:str step_id:str status:str detail:str", f"""WITH {_BASE} SELECT skill_id, 'resultUpdate' AS type, 'result-structured-findings' AS step_id, 'completed' AS status, count(*)::VARCHAR AS detail FROM gr GROUP BY 1 UNION ALL SELECT skill_id, 'statusUpdate', 'pipeline-intent', 'completed', count(*)::VARCHAR FROM df GROUP BY skill_id
  UNION ALL SELECT skill_id, 'error', 'probe-warning', 'completed', signal FROM sgn""")
def audit_events(spark, d):
    st = Stage(spark, d)
    row = lambda df, step, detail: df.select("skill_id", F.lit(step).alias("step_id"), F.lit("completed").alias("status"), detail.cast("string").alias("detail"))
    per_skill = lambda df: df.groupBy("skill_id").agg(F.count("*").alias("n"))
    return FD.audit_events({"resultUpdate": row(per_skill(st.groups), "result-structured-findings", F.col("n")), "statusUpdate": row(per_skill(st.diffs), "pipeline-intent", F.col("n")),
                            "error": row(st.signals, "probe-warning", F.col("signal"))})


# --- capability matrix ----------------------------------------------------------------------------------------------------------

_CAPSRC = f"""dx AS (SELECT skill_id, lower(description || ' ' || array_to_string(permissions, ' ')) AS t FROM sk), stx AS (SELECT skill_id, lower(rule_id || ' ' || title || ' ' || description || ' ' || code) AS t FROM fd),
  oc AS (SELECT skill_id, category FROM bp UNION ALL SELECT skill_id, 'evasion_signals' FROM sgn)"""
_CAPM = f"{_CAPSRC}, cm AS (" + " UNION ALL ".join(
    f"""SELECT dx.skill_id, '{c}' AS capability, {S.any_in('dx.t', w)} AS declared, EXISTS (SELECT 1 FROM stx WHERE stx.skill_id = dx.skill_id AND {S.any_in('stx.t', w)}) AS static_seen,
    EXISTS (SELECT 1 FROM oc WHERE oc.skill_id = dx.skill_id AND oc.category IN ({', '.join(S.s(b) for b in R.CAPABILITY_BEHAVIOR[c])})) AS behavior_seen FROM dx""" for c, w in R.CAPABILITY_WORDS.items()) + """),
  cs AS (SELECT *, CASE WHEN declared AND behavior_seen THEN 'declared, verified' WHEN declared AND static_seen THEN 'declared, not run-verified' WHEN behavior_seen THEN 'undeclared, observed' WHEN static_seen THEN 'undeclared, static only' WHEN declared THEN 'declared, not seen' ELSE 'not observed' END AS status FROM cm)"""


def matrix(st):
    skills = st.skills.select("skill_id", F.concat_ws(" ", "description", F.array_join("permissions", " ")).alias("declared_text"), F.lit("").alias("model_text"))
    text = st.findings.select("skill_id", F.concat_ws(" ", "rule_id", "title", "description", "code_snippet").alias("text"))
    return R.capability_matrix(skills, text, st.facts.where("category not in ('network_targets', 'exec_targets', 'file_targets')").select("skill_id", "category"))


@query("capability_matrix", "skill_id:str capability:str declared:bool static_seen:bool behavior_seen:bool status:str", f"WITH {_BASE}, {_CAPM} SELECT * FROM cs")
def capability_matrix(spark, d):
    return matrix(Stage(spark, d))


_AFF = f"af AS (SELECT * FROM (VALUES {_values((k, c) for k, v in R.CAPABILITY_AFFINITY.items() for c in v)}) v(capability, category))"


@query("finding_capabilities", "skill_id:str finding_id:str category:str capability:str status:str", f"WITH {_BASE}, {_CAPM}, {_AFF} SELECT gr.skill_id, finding_id, gr.category, cs.capability, status FROM gr JOIN af ON gr.category = af.category JOIN cs ON cs.skill_id = gr.skill_id AND cs.capability = af.capability")
def finding_capabilities(spark, d):
    st = Stage(spark, d)
    return R.finding_capability_join(matrix(st), st.groups)


@query("unmatched_capabilities", "skill_id:str capability:str status:str", f"WITH {_BASE}, {_CAPM}, {_AFF} SELECT skill_id, capability, status FROM cs WHERE NOT EXISTS (SELECT 1 FROM gr JOIN af ON gr.category = af.category WHERE gr.skill_id = cs.skill_id AND af.capability = cs.capability)")
def unmatched_capabilities(spark, d):
    st = Stage(spark, d)
    return R.unmatched_capabilities(matrix(st), st.groups)


@query("findings_payload", "skill_id:str n_fields:int rule_id:str", f"WITH {S.SEED_LINES}, {FIND_CTE} SELECT skill_id, 9 AS n_fields, rule_id FROM fd")
def findings_payload(spark, d):
    """JSON payload of every finding, read back to its rule and field count."""
    p = sinks.findings_payload(seeded_findings(spark, d))
    return p.select("skill_id", F.size(F.json_object_keys("payload")).alias("n_fields"), F.get_json_object("payload", "$.rule_id").alias("rule_id"))

