"""Queries: behaviour evidence, segments, sequences, targets and reputations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behavior as B
from ..operators import intel as I
from ..operators import packs as P
from ..operators.scan import explode_lines
from ..session import stage_table
from . import corpus as C
from . import sqltext as S
from .q_rules import _SIGL
from .registry import query

_EVID = "{t}"
_LINE_EV = _EVID.format(t=S.trim("line"))
_CATS = {c: (f"({S.rx('line', P.CREDENTIAL_PATH_RX)} OR ({S.rx('line', P.CREDENTIAL_ACCESS_RX)} AND {S.rx('line', P.CREDENTIAL_SECRET_RX)}))" if c == "credential" else S.rx("line", P.BEHAVIOR_RX[c])) for c in P.BEHAVIOR_CATEGORIES}
_TGT = f"unnest(list_concat(regexp_extract_all(line, {S.s(P.URL_RX)}), regexp_extract_all(line, {S.s(P.IPV4_RX)})))"
BEHAVIOR_CTE = f"{_SIGL}, bp AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT skill_id, path, line_no, {S.s(c)} AS category, {_LINE_EV} AS evidence FROM sl WHERE {t}" for c, t in _CATS.items()) + \
    f" UNION ALL SELECT skill_id, path, line_no, 'outbound', t FROM (SELECT skill_id, path, line_no, {_TGT} AS t FROM sl)))"


@query("behavior_points", "skill_id:str path:str line_no:int category:str evidence:str", f"WITH {S.SEED_LINES}, {BEHAVIOR_CTE} SELECT * FROM bp")
def behavior_points(spark, d):
    return B.behavior_points(C.seeded_files(spark, d))


@query("file_targets", "skill_id:str path:str n_lines:int", f"WITH {S.SEED_LINES}, {_SIGL} SELECT skill_id, path, count(*) AS n_lines FROM sl WHERE contains(line, 'open(') OR contains(line, 'os.ReadFile') OR contains(line, 'os.WriteFile') GROUP BY 1, 2")
def file_targets(spark, d):
    return B.file_targets(C.seeded_files(spark, d))


@query("exec_targets", "skill_id:str path:str line_no:int line:str", f"WITH {S.SEED_LINES}, {_SIGL} SELECT skill_id, path, line_no, line FROM sl WHERE {S.rx('line', P.PROCESS_START_RX)}")
def exec_targets(spark, d):
    return B.exec_targets(C.seeded_files(spark, d))


_SIG = f"""sgn AS (""" + " UNION ".join(f"SELECT DISTINCT skill_id, 'fingerprint {k}' AS signal FROM sl WHERE {S.rx('line', r)}" for k, r in P.EVASION_FINGERPRINTS.items()) + f"""
  UNION SELECT DISTINCT skill_id, 'delay 300 hit ' || n FROM (SELECT skill_id, list_filter(list_transform(regexp_extract_all(line, {S.s(P.SLEEP_RX)}, 1), lambda x: try_cast(x AS BIGINT)), lambda x: x >= 300)[1] AS n FROM sl) WHERE n IS NOT NULL
  UNION SELECT DISTINCT skill_id, 'environment guarded execution' FROM sl WHERE {S.any_in('lower(line)', ['if', 'switch'])} AND {S.any_in('lower(line)', ['docker', 'vm', 'sandbox'])} AND {S.any_in('lower(line)', ['exec', 'powershell', 'curl', 'wget'])})"""


@query("evasion_signals", "skill_id:str signal:str", f"WITH {S.SEED_LINES}, {_SIGL}, {_SIG} SELECT * FROM sgn")
def evasion_signals(spark, d):
    return B.evasion_signals(C.seeded_files(spark, d))


@query("evasion_assessment", "skill_id:str n_signals:int detected:bool severity:str", f"""WITH {S.SEED_LINES}, {S.SEED_SKILLS}, {_SIGL}, {_SIG} SELECT sk.skill_id, count(signal) AS n_signals, count(signal) > 0 AS detected, CASE WHEN count(signal) > 0 THEN 'critical' ELSE 'low' END AS severity FROM sk LEFT JOIN sgn ON sk.skill_id = sgn.skill_id GROUP BY 1""")
def evasion_assessment(spark, d):
    return B.evasion_assessment(C.seeded_skills(spark, d), B.evasion_signals(C.seeded_files(spark, d)))


@query("differential_probes", "skill_id:str scenario:str triggered:bool n_indicators:int dangerous_exec:bool", f"""WITH {S.SEED_LINES}, {_SIGL}, {_SIG}, x AS (SELECT skill_id, bool_or({S.any_in('lower(line)', ['curl', 'wget', 'powershell', 'bash -i'])}) AS dangerous_exec FROM sl WHERE {S.rx('line', P.PROCESS_START_RX)} GROUP BY 1),
  c AS (SELECT skill_id, count(*) FILTER (contains(lower(signal), 'docker')) AS c, count(*) FILTER ({S.any_in('lower(signal)', ['vm', 'hypervisor'])}) AS v, count(*) FILTER ({S.any_in('lower(signal)', ['debug', 'delay'])}) AS b FROM sgn GROUP BY 1),
  j AS (SELECT coalesce(c.skill_id, x.skill_id) AS skill_id, coalesce(dangerous_exec, FALSE) AS dangerous_exec, unnest([{{'s': 'container', 'n': coalesce(c, 0)}}, {{'s': 'virtual machine', 'n': coalesce(v, 0)}}, {{'s': 'baseline', 'n': coalesce(b, 0)}}]) AS u FROM c FULL JOIN x ON c.skill_id = x.skill_id)
  SELECT skill_id, u.s AS scenario, u.n > 0 AS triggered, u.n AS n_indicators, dangerous_exec FROM j""")
def differential_probes(spark, d):
    files = C.seeded_files(spark, d)
    return B.differential_probes(B.evasion_signals(files), B.exec_targets(files))


@query("evidence_inventory", "skill_id:str category:str n:int examples:str", f"""WITH {S.SEED_LINES}, {BEHAVIOR_CTE}, i AS (SELECT DISTINCT skill_id, category, evidence AS item FROM bp WHERE evidence <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY skill_id, category ORDER BY item) AS rn FROM i)
  SELECT skill_id, category, count(*) AS n, string_agg(item, chr(10) ORDER BY item) FILTER (rn <= 5) AS examples FROM r GROUP BY 1, 2""")
def evidence_inventory(spark, d):
    items = B.behavior_points(C.seeded_files(spark, d)).withColumnRenamed("evidence", "item")
    return B.evidence_inventory(items).withColumn("examples", F.array_join("examples", "\n"))


# --- segments over events -----------------------------------------------------------------------

def event_segments(spark, d):
    return B.segments(C.event_points(spark, d), C.EVENT_GAP)


@query("behavior_segments", "skill_id:str path:str range_start:int range_end:int n_categories:int total:int", f"WITH {S.EVENT_POINTS} SELECT * FROM sg")
def behavior_segments(spark, d):
    return event_segments(spark, d)


_COUNTS = " || ', ' || ".join(f"'{c}=' || coalesce(max(n) FILTER (category = '{c}'), 0)" for c in P.BEHAVIOR_CATEGORIES)
_RANGE = "CASE WHEN range_start = range_end THEN ':' || range_start ELSE ':' || range_start || '-' || range_end END"
_CHAIN = f"""tx AS (SELECT skill_id, path, seg, {_COUNTS} AS counts FROM sc GROUP BY 1, 2, 3),
  ch AS (SELECT sg.*, n_categories * 100 + total AS score, sg.path || {_RANGE} || ' | ' || counts AS chain, row_number() OVER (PARTITION BY sg.skill_id ORDER BY n_categories * 100 + total DESC, sg.path, range_start) AS rank
    FROM sg JOIN tx ON sg.skill_id = tx.skill_id AND sg.path = tx.path AND sg.seg = tx.seg WHERE n_categories >= 2)"""


@query("behavior_chains", "skill_id:str rank:int score:int chain:str", f"WITH {S.EVENT_POINTS}, {_CHAIN} SELECT * FROM ch")
def behavior_chains(spark, d):
    return B.chains(event_segments(spark, d))


@query("behavior_timelines", "skill_id:str rank:int timeline:str", f"""WITH {S.EVENT_POINTS}, st AS (SELECT skill_id, path, seg, string_agg(category || '(L' || first || ',x' || n || ')', ' -> ' ORDER BY first, category) AS t FROM sc GROUP BY 1, 2, 3),
  tl AS (SELECT sg.skill_id, sg.path || {_RANGE} || ' | ' || t AS timeline FROM sg JOIN st ON sg.skill_id = st.skill_id AND sg.path = st.path AND sg.seg = st.seg WHERE n_categories >= 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY timeline) AS rank FROM tl)""")
def behavior_timelines(spark, d):
    return B.timelines(event_segments(spark, d))


_ALERT = "al AS (" + " UNION ALL ".join(
    f"SELECT skill_id, {S.s(n)} AS alert, count(*) AS n_segments FROM (SELECT DISTINCT a.skill_id, a.path, a.seg FROM sc a JOIN sc b ON a.skill_id = b.skill_id AND a.path = b.path AND a.seg = b.seg AND a.first < b.last WHERE "
    + " OR ".join(f"(a.category = '{x}' AND b.category = '{y}')" for x, y in combos) + ") GROUP BY 1" for n, combos in B.ALERT_PAIRS.items()) + ")"


@query("sequence_alerts", "skill_id:str alert:str n_segments:int", f"WITH {S.EVENT_POINTS}, {_ALERT} SELECT * FROM al")
def sequence_alerts(spark, d):
    return B.sequence_alerts(event_segments(spark, d))


_RISK_IN = f"""rc AS (SELECT p.skill_id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in P.BEHAVIOR_CATEGORIES)}, (SELECT count(*) FROM ch WHERE ch.skill_id = p.skill_id) AS chains,
  (SELECT count(*) FROM al WHERE al.skill_id = p.skill_id) AS alerts, (SELECT count(*) FROM al WHERE al.skill_id = p.skill_id AND alert IN ({', '.join(S.s(a) for a in B.VETO_ALERTS)})) AS veto_alerts, 0 AS warnings FROM pts p GROUP BY 1)"""
_DED = " + ".join(f"least({c} * {per}, {cap})" for c, (per, cap) in B.DEDUCTIONS.items())
_VETO = """((priv_esc > 0 AND (execute > 0 OR chains > 0)) OR (credential > 0 AND outbound > 0) OR (defense_evasion > 0 AND execute > 0) OR (lateral_move > 0 AND (c2_beacon > 0 OR execute > 0))
  OR (collection > 0 AND outbound > 0) OR (c2_beacon > 0 AND execute > 0) OR veto_alerts > 0)"""


@query("behavior_risk", "skill_id:str chains:int alerts:int deduction:int veto:bool ics:int", f"WITH {S.EVENT_POINTS}, {_CHAIN}, {_ALERT}, {_RISK_IN} SELECT skill_id, chains, alerts, {_DED} AS deduction, {_VETO} AS veto, 100 - least({_DED}, 100) AS ics FROM rc")
def behavior_risk(spark, d):
    return B.behavior_risk(B.behavior_counts(event_segments(spark, d)))


# --- segments over files --------------------------------------------------------------------------

FILE_SEG = f"""q1 AS (SELECT skill_id, path, line_no, category, count(*) AS k FROM bp GROUP BY ALL), q2 AS (SELECT *, lag(line_no) OVER (PARTITION BY skill_id, path ORDER BY line_no, category) AS prev FROM q1),
  q3 AS (SELECT *, sum(CASE WHEN prev IS NULL OR line_no - prev > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY skill_id, path ORDER BY line_no, category ROWS UNBOUNDED PRECEDING) AS seg FROM q2),
  sc AS (SELECT skill_id, path, seg, category, sum(k)::BIGINT AS n, min(line_no) AS first, max(line_no) AS last FROM q3 GROUP BY ALL), sg AS (SELECT skill_id, path, seg, min(first) AS range_start, max(last) AS range_end, count(*) AS n_categories, sum(n)::BIGINT AS total FROM sc GROUP BY ALL)"""


def file_segments(spark, d):
    return B.segments(B.behavior_points(C.seeded_files(spark, d)))


@query("file_chains", "skill_id:str rank:int score:int chain:str", f"WITH {S.SEED_LINES}, {BEHAVIOR_CTE}, {FILE_SEG}, {_CHAIN} SELECT * FROM ch")
def file_chains(spark, d):
    return B.chains(file_segments(spark, d))


@query("file_alerts", "skill_id:str alert:str n_segments:int", f"WITH {S.SEED_LINES}, {BEHAVIOR_CTE}, {FILE_SEG}, {_ALERT} SELECT * FROM al")
def file_alerts(spark, d):
    return B.sequence_alerts(file_segments(spark, d))


# --- targets and reputations --------------------------------------------------------------------------

_PT = f"""pt AS (SELECT DISTINCT skill_id, target FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS skill_id, url AS target FROM pages UNION ALL SELECT skill_id, t FROM (SELECT skill_id, {_TGT} AS t FROM page_l WHERE {S.code_line('line')})
  UNION ALL SELECT skill_id, t FROM (SELECT skill_id, {_TGT} AS t FROM l WHERE {S.signal_file('path')} AND {S.code_line('line')})))"""
_TI_CTE = f"{S.PAGE_FILES}, {S.SEED_LINES}, {_PT}"


def page_and_seed_targets(spark, d):
    """Page addresses, targets named in pages and targets named in the seeded files: distinct (skill_id, target)."""
    addr = C.table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("skill_id"), F.col("url").alias("target"))
    named = B.extract_targets(C.page_files(spark, d)).select("skill_id", "target")
    seeded = B.extract_targets(C.seeded_files(spark, d)).select("skill_id", "target")
    return addr.unionByName(named).unionByName(seeded).distinct()


@query("page_targets", "skill_id:str path:str line_no:int target:str", f"WITH {S.PAGE_FILES} SELECT DISTINCT skill_id, path, line_no, t AS target FROM (SELECT skill_id, path, line_no, {_TGT} AS t FROM page_l WHERE {S.code_line('line')})")
def page_targets(spark, d):
    return B.extract_targets(C.page_files(spark, d))


@query("document_targets", "skill_id:str path:str line_no:int target:str", f"WITH {S.DOC_LINES} SELECT DISTINCT skill_id, path, line_no, t AS target FROM (SELECT skill_id, path, line_no, {_TGT} AS t FROM doc_l WHERE {S.code_line('line')})")
def document_targets(spark, d):
    return B.extract_targets(C.document_files(spark, d))


_HOST = "lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"
_PATH0 = "regexp_replace(regexp_replace(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '(.)/$', '\\1')"
_PATH = f"lower(CASE WHEN {_PATH0} = '' THEN '/' ELSE {_PATH0} END)"


def _local_sql(src: str) -> str:
    return f"""lr AS (SELECT target, split_part(r, '|', 1) AS reputation, split_part(r, '|', 2)::DOUBLE AS confidence FROM (SELECT target, CASE WHEN {S.any_raw('lower(target)', I.POLICY_TARGETS)} THEN 'policy|0.9' WHEN {S.any_raw('lower(target)', I.PASTE_HOSTS)} THEN 'suspicious|0.8'
  WHEN {S.any_raw('lower(target)', I.LOOPBACK)} THEN 'internal|0.9' WHEN h = 'raw.githubusercontent.com' THEN 'suspicious|0.8'
  WHEN h = 'github.com' AND (contains(p, '/releases/download/') OR ends_with(p, '.zip') OR ends_with(p, '.tar.gz') OR ends_with(p, '.tgz')) THEN 'suspicious|0.78'
  WHEN h = 'github.com' AND (len(string_split(trim(p, '/'), '/')) <= 2 OR string_split(trim(p, '/'), '/')[3] IN ('tree', 'blob')) THEN 'trusted|0.6' WHEN h = 'github.com' THEN 'unknown|0.55'
  WHEN contains(lower(target), 'http://') THEN 'benign|0.6' ELSE 'unknown|0.5' END AS r FROM (SELECT DISTINCT target, {_HOST} AS h, {_PATH} AS p FROM {src})))"""


def _distinct_targets(spark, d):
    return page_and_seed_targets(spark, d).select("target").distinct()


def _staged_targets(spark, d):
    """Distinct (skill_id, target), written once: every provider reads this table and none the texts."""
    return stage_table(page_and_seed_targets(spark, d), "targets")


@query("reputation_local", "target:str reputation:str confidence:float", f"WITH {_TI_CTE}, {_local_sql('pt')} SELECT * FROM lr")
def reputation_local(spark, d):
    return I.local_reputation(_distinct_targets(spark, d))


# Feeds made of page addresses: pages in the first listing are known to one feed, those with a fragment to the other.
def _feed(spark, d, token):
    return C.table(spark, d, "pages").where(F.col("url").contains(token)).select(F.col("url").alias("indicator"))


def _providers(spark, d, targets):
    t = targets.select("target").distinct()
    return [I.feed_reputation(t, _feed(spark, d, "#"), "feed1"), I.feed_reputation(t, _feed(spark, d, "?"), "feed2"), I.local_reputation(t)]


_FEEDS = """dt AS (SELECT DISTINCT target FROM pt), fd AS (
  SELECT target, CASE WHEN target IN (SELECT url FROM pages WHERE contains(url, '#')) THEN 'suspicious' ELSE 'unknown' END AS reputation, CASE WHEN target IN (SELECT url FROM pages WHERE contains(url, '#')) THEN 0.9 ELSE 0.6 END AS confidence, 1 AS o FROM dt
  UNION ALL SELECT target, CASE WHEN target IN (SELECT url FROM pages WHERE contains(url, '?')) THEN 'suspicious' ELSE 'unknown' END, CASE WHEN target IN (SELECT url FROM pages WHERE contains(url, '?')) THEN 0.85 ELSE 0.6 END, 2 FROM dt
  UNION ALL SELECT target, reputation, confidence, 3 FROM lr)"""
_RANKC = "CASE reputation " + " ".join(f"WHEN {S.s(k)} THEN {v}" for k, v in I.RANK.items()) + " ELSE 0 END"
_MERGED = f"mr AS (SELECT target, reputation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_RANKC} DESC, confidence DESC, o) AS rn FROM fd) WHERE rn = 1)"
MERGED_CTE = f"{_TI_CTE}, {_local_sql('pt')}, {_FEEDS}, {_MERGED}"


@query("reputation_feeds", "target:str reputation:str confidence:float", f"WITH {_TI_CTE}, {_local_sql('pt')}, {_FEEDS} SELECT target, reputation, confidence FROM fd WHERE o = 1")
def reputation_feeds(spark, d):
    return _providers(spark, d, page_and_seed_targets(spark, d))[0]


@query("reputation_merged", "target:str reputation:str confidence:float", f"WITH {MERGED_CTE} SELECT * FROM mr")
def reputation_merged(spark, d):
    return I.merge_reputations(_providers(spark, d, _staged_targets(spark, d)))


_ADJ = "CASE r WHEN 'malicious' THEN -10 * c WHEN 'high-risk' THEN -10 * c WHEN 'suspicious' THEN -8 * c WHEN 'policy' THEN -3 * c WHEN 'unknown' THEN -1 WHEN 'trusted' THEN 2 * c WHEN 'internal' THEN 2 * c WHEN 'benign' THEN 2 * c ELSE 0 END"


@query("ti_adjustment", "skill_id:str n_targets:int adjustment:float malicious:bool suspicious:bool", f"""WITH {MERGED_CTE}, j AS (SELECT skill_id, coalesce(reputation, 'unknown') AS r, coalesce(confidence, 0.4) AS c FROM pt LEFT JOIN mr ON pt.target = mr.target)
  SELECT skill_id, count(*) AS n_targets, greatest(least(sum({_ADJ}), 10), -30) AS adjustment, bool_or(r IN ('malicious', 'high-risk', 'suspicious') AND c >= 0.85) AS malicious, bool_or(r IN ('malicious', 'high-risk', 'suspicious')) AS suspicious FROM j GROUP BY 1""")
def ti_adjustment(spark, d):
    targets = _staged_targets(spark, d)
    return I.ti_adjustment(targets, I.merge_reputations(_providers(spark, d, targets)))


@query("finding_reputation", "finding_id:str reputation:str", f"""WITH {S.PAGE_FILES}, {S.SEED_LINES}, {_PT}, {_local_sql('pt')}, ev AS (SELECT skill_id || '/' || path || ':' || line_no AS finding_id, {_TGT} AS t FROM l)
  SELECT finding_id, arg_min(reputation, lower(target)) AS reputation FROM ev JOIN lr ON lower(ev.t) = lower(lr.target) GROUP BY 1""")
def finding_reputation(spark, d):
    ev = explode_lines(C.seeded_files(spark, d)).select(F.concat("skill_id", F.lit("/"), "path", F.lit(":"), F.col("line_no").cast("string")).alias("finding_id"), F.col("line").alias("evidence"))
    return I.finding_reputation(ev, I.local_reputation(_distinct_targets(spark, d)))
