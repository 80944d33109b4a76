"""Queries: admission registry, combination analysis, vectors, incremental scan, sinks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import admission as A
from ..operators import asof as AO
from ..operators import combination as CB
from ..operators import flow
from ..operators import incremental as INC
from ..operators import packs as P
from ..operators import scoring, similarity
from ..session import cut_lineage, shared_dir, stage_table
from ..sources import registry as RG
from ..sources import sinks
from ..sources.artifacts import extract_dependencies
from ..sources import file_tree
from ..sources.merge_table import MergeTable
from ..streaming import jobs as ST
from ..streaming import keyed_sessions as KS
from . import corpus as C
from . import sqltext as S
from .q_scan import _pack_sql
from .registry import ORACLES, query

# --- profiles ------------------------------------------------------------------------------------

_FLAGS = ", ".join(f"bool_or(category IN ({', '.join(S.s(x) for x in v)})) AS {k}" for k, v in A.CAPABILITY_INPUTS.items())
_LIST_RANK = "CASE category " + " ".join(f"WHEN {S.s(c)} THEN {i}" for i, c in enumerate(A.EVIDENCE_LISTS)) + " END"
_CAPS = f"list_filter([{', '.join(f'CASE WHEN {c} THEN {S.s(c)} END' for c in A.CAPABILITIES)}], lambda x: x IS NOT NULL)"
PROFILE_CTE = f"""{S.SUPPLIER}, pf AS (SELECT skill_id, {_FLAGS} FROM bh GROUP BY 1),
  pe0 AS (SELECT skill_id, {_LIST_RANK} AS o, item, row_number() OVER (PARTITION BY skill_id, category ORDER BY item) AS rn FROM (SELECT DISTINCT * FROM bh) WHERE category IN ({', '.join(S.s(c) for c in A.EVIDENCE_LISTS)})),
  pe1 AS (SELECT skill_id, item, min(o * 10 + rn) AS p FROM pe0 WHERE rn <= 2 GROUP BY 1, 2), pe AS (SELECT skill_id, list(item ORDER BY p) AS evidence FROM pe1 GROUP BY 1),
  pr AS (SELECT pf.*, coalesce(evidence, []::VARCHAR[]) AS evidence, {_CAPS} AS tags FROM pf LEFT JOIN pe ON pf.skill_id = pe.skill_id)"""
_PROFILE_COLS = "skill_id:str " + " ".join(f"{c}:bool" for c in A.CAPABILITIES)


def shown(spark, d):
    """What suppliers show, each once, written once: profiles and evidence are both taken from it."""
    return cut_lineage(C.supplier_behavior(spark, d).distinct())


def profiles(spark, d):
    return A.capability_profiles(C.supplier_behavior(spark, d))


def staged_profiles(spark, d):
    """Profiles written once: combination steps read them several times (one row per skill)."""
    return cut_lineage(profiles(spark, d))


@query("capability_profiles", _PROFILE_COLS + " tags:str evidence:str", f"WITH {PROFILE_CTE} SELECT * REPLACE (array_to_string(tags, ',') AS tags, array_to_string(evidence, chr(10)) AS evidence) FROM pr")
def capability_profiles(spark, d):
    return profiles(spark, d).withColumns({"tags": F.array_join("tags", ","), "evidence": F.array_join("evidence", "\n")})


@query("capability_unpivot", "skill_id:str capability:str", f"WITH {PROFILE_CTE} SELECT skill_id, unnest(tags) AS capability FROM pr")
def capability_unpivot(spark, d):
    return A.capability_unpivot(profiles(spark, d))


_BF = "bf AS (SELECT skill_id, bool_or(category = 'behavior_chains') AS has_chains, bool_or(category = 'sequence_alerts') AS has_alerts FROM bh GROUP BY 1)"
RISK_CTE = f"{PROFILE_CTE}, {_BF}, rk AS (" + " UNION ALL ".join(f"SELECT pr.skill_id, {S.s(i)} AS risk_id, {S.s(c)} AS category, {S.s(lv)} AS level, {S.s(t)} AS title FROM pr JOIN bf ON pr.skill_id = bf.skill_id WHERE {f}" for i, c, lv, t, f in A.RESIDUAL) + ")"


def risks(spark, d, p=None):
    b = C.supplier_behavior(spark, d)
    flags = b.groupBy("skill_id").agg(F.bool_or(F.col("category") == "behavior_chains").alias("has_chains"), F.bool_or(F.col("category") == "sequence_alerts").alias("has_alerts"))
    return A.residual_risks(p if p is not None else profiles(spark, d), flags)


@query("residual_risks", "skill_id:str risk_id:str category:str level:str title:str", f"WITH {RISK_CTE} SELECT * FROM rk")
def residual_risks(spark, d):
    return risks(spark, d)


@query("risk_tags", "skill_id:str tags:str", f"""WITH {RISK_CTE}, t AS (SELECT skill_id, x, min(o) AS o FROM (SELECT skill_id, 'outbound_network' AS x, '0' AS o FROM pr WHERE network_access UNION ALL SELECT skill_id, 'command_execution', '1' FROM pr WHERE command_exec UNION ALL SELECT skill_id, 'sensitive_access', '2' FROM pr WHERE sensitive_data_access UNION ALL SELECT skill_id, lower(category), '3' || lower(category) FROM rk) GROUP BY 1, 2)
  SELECT pr.skill_id, coalesce(string_agg(x, ',' ORDER BY o), '') AS tags FROM pr LEFT JOIN t ON pr.skill_id = t.skill_id GROUP BY 1""")
def risk_tags(spark, d):
    return A.risk_tags(profiles(spark, d), risks(spark, d)).select("skill_id", F.array_join("risk_tags", ",").alias("tags"))


@query("purpose_summary", "skill_id:str purpose:str", f"""WITH {PROFILE_CTE} SELECT skill_id, CASE WHEN ends_with(skill_id, '7') THEN 'declared ' || skill_id ELSE coalesce(nullif(concat_ws('，', CASE WHEN network_access THEN '具备网络访问能力' END, CASE WHEN file_read OR file_write THEN '涉及文件处理' END, CASE WHEN command_exec THEN '涉及命令执行' END), ''), {S.s(A.PURPOSE_DEFAULT)}) END AS purpose FROM pr""")
def purpose_summary(spark, d):
    p = profiles(spark, d)
    desc = F.when(F.col("skill_id").endswith("7"), F.concat(F.lit(" declared "), "skill_id"))
    return p.select("skill_id", A.purpose_summary(desc).alias("purpose"))


# --- combination ---------------------------------------------------------------------------------------

def selected(spark, d, p=None):
    return cut_lineage(CB.selected_profiles(C.supplier_selection(spark, d), p if p is not None else profiles(spark, d)))


def selected_with_evidence(spark, d):
    """Selected profiles and all evidence items."""
    b = shown(spark, d)
    return selected(spark, d, A.capability_profiles(b)), A.evidence_items(b)


_EV_LISTS = f"category IN ({', '.join(S.s(c) for c in A.EVIDENCE_LISTS)})"
_MERGED = f"mg AS (SELECT selection_id, {', '.join(f'bool_or({c}) AS {c}' for c in A.CAPABILITIES)}, count(*) AS n_skills, (SELECT count(DISTINCT item) FROM sel s2 JOIN bh ON s2.skill_id = bh.skill_id WHERE {_EV_LISTS} AND s2.selection_id = sel.selection_id) AS n_evidence FROM sel JOIN pr ON sel.skill_id = pr.skill_id GROUP BY 1)"


@query("merge_profiles", "selection_id:str " + " ".join(f"{c}:bool" for c in A.CAPABILITIES) + " n_skills:int n_evidence:int tags:str", f"WITH {PROFILE_CTE}, {_MERGED} SELECT *, array_to_string({_CAPS}, ',') AS tags FROM mg")
def merge_profiles(spark, d):
    return CB.merge_profiles(*selected_with_evidence(spark, d)).withColumn("tags", F.array_join("tags", ","))


_MR = "mr AS (SELECT selection_id, risk_id, title, arg_min(level, rk.skill_id) AS level, count(DISTINCT rk.skill_id) AS n_sources, min(rk.skill_id) AS first_source FROM sel JOIN rk ON sel.skill_id = rk.skill_id GROUP BY 1, 2, 3)"


@query("merge_risks", "selection_id:str risk_id:str title:str level:str n_sources:int first_source:str", f"WITH {RISK_CTE}, {_MR} SELECT * FROM mr")
def merge_risks(spark, d):
    return CB.merge_risks(C.supplier_selection(spark, d), risks(spark, d))


_CE = f"it AS (SELECT DISTINCT selection_id, sel.skill_id, item AS e FROM sel JOIN bh ON sel.skill_id = bh.skill_id WHERE {_EV_LISTS}), ce AS (" + " UNION ".join(
    f"SELECT DISTINCT selection_id, skill_id, {S.s(r)} AS chain_id, e AS evidence FROM it WHERE {S.any_in('lower(e)', [w for c in caps for w in CB.EVIDENCE_WORDS[c]])}" for r, (caps, *_) in CB.CHAIN_RULES.items()) + ")"


@query("chain_evidence", "selection_id:str chain_id:str skill_id:str evidence:str", f"WITH {PROFILE_CTE}, {_CE} SELECT * FROM ce")
def chain_evidence(spark, d):
    return CB.chain_evidence(*selected_with_evidence(spark, d))


_IC = f"""{_MERGED}, {_CE}, ic AS (""" + " UNION ALL ".join(f"""SELECT mg.selection_id, {S.s(r)} AS chain_id, {S.s(lvl)} AS level, {pri} AS priority, n_skills, (SELECT count(DISTINCT evidence) FROM ce WHERE ce.selection_id = mg.selection_id AND chain_id = {S.s(r)}) AS n_evidence FROM mg
  WHERE {' AND '.join(caps)} AND n_skills >= 2 AND ((SELECT count(DISTINCT skill_id) FROM ce WHERE ce.selection_id = mg.selection_id AND chain_id = {S.s(r)}) >= 2
    OR EXISTS (SELECT 1 FROM (SELECT ce.skill_id AS s, count(*) AS k FROM ce WHERE ce.selection_id = mg.selection_id AND chain_id = {S.s(r)} GROUP BY 1) q JOIN pr ON pr.skill_id = q.s WHERE k >= 2 AND {' + '.join(c + '::INT' for c in caps)} >= 2))""" for r, (caps, lvl, pri, _) in CB.CHAIN_RULES.items()) + ")"
_FOLD = "fc AS (SELECT * FROM ic WHERE NOT (chain_id IN ('sensitive-exfiltration', 'remote-command-chain') AND EXISTS (SELECT 1 FROM ic i2 WHERE i2.selection_id = ic.selection_id AND i2.chain_id = 'full-attack-chain')))"
_CHAINC = "selection_id:str chain_id:str level:str priority:int n_skills:int n_evidence:int"


@query("infer_chains", _CHAINC, f"WITH {PROFILE_CTE}, {_IC} SELECT * FROM ic")
def infer_chains(spark, d):
    return CB.infer_chains(*selected_with_evidence(spark, d))


_PATHS = "CASE chain_id " + " ".join(f"WHEN {S.s(r)} THEN {S.s(' > '.join(CB.ATTACK_STEPS[c] for c in caps))}" for r, (caps, *_) in CB.CHAIN_RULES.items()) + " END"
_TECH = "CASE chain_id " + " ".join(f"WHEN {S.s(r)} THEN {S.s(','.join(dict.fromkeys(x for c in caps for x in CB.STEP_TECHNIQUES[c])))}" for r, (caps, *_) in CB.CHAIN_RULES.items()) + " END"


@query("fold_chains", _CHAINC + " attack_path:str techniques:str", f"WITH {PROFILE_CTE}, {_IC}, {_FOLD} SELECT *, {_PATHS} AS attack_path, {_TECH} AS techniques FROM fc")
def fold_chains(spark, d):
    return CB.fold_chains(cut_lineage(CB.infer_chains(*selected_with_evidence(spark, d)))).withColumns({"attack_path": F.array_join(CB.attack_path(F.col("chain_id")), " > "), "techniques": F.array_join(CB.chain_techniques(F.col("chain_id")), ",")})


@query("conclusion", "selection_id:str n_skills:int n_capabilities:int n_sensitive:int high_risks:int medium_risks:int low_risks:int n_chains:int confident_chains:int risk_level:str", f"""WITH {RISK_CTE}, {_MR}, {_IC}, {_FOLD}, q AS (SELECT s.selection_id, coalesce(n_skills, 0) AS n_skills, coalesce({' + '.join(f'{c}::INT' for c in A.CAPABILITIES)}, 0) AS n_capabilities, coalesce(network_access::INT + command_exec::INT + sensitive_data_access::INT + privilege_use::INT, 0) AS n_sensitive,
    (SELECT count(*) FROM mr WHERE mr.selection_id = s.selection_id AND level = 'high') AS high_risks, (SELECT count(*) FROM mr WHERE mr.selection_id = s.selection_id AND level = 'medium') AS medium_risks, 0 AS low_risks,
    (SELECT count(*) FROM fc WHERE fc.selection_id = s.selection_id) AS n_chains, (SELECT count(*) FROM fc WHERE fc.selection_id = s.selection_id AND n_skills >= 2 AND n_evidence >= 2) AS confident_chains FROM (SELECT DISTINCT selection_id FROM sel) s LEFT JOIN mg ON s.selection_id = mg.selection_id)
  SELECT *, CASE WHEN high_risks > 0 OR confident_chains > 0 THEN 'high' WHEN medium_risks > 0 OR n_sensitive >= 3 OR (n_sensitive >= 2 AND n_chains > 0) THEN 'medium' ELSE 'low' END AS risk_level FROM q""")
def conclusion(spark, d):
    sel, b = C.supplier_selection(spark, d), shown(spark, d)
    p, ev = cut_lineage(A.capability_profiles(b)), cut_lineage(A.evidence_items(b))
    s = selected(spark, d, p)
    return CB.conclusion(sel, CB.merge_profiles(s, ev), CB.merge_risks(sel, risks(spark, d, p)), CB.fold_chains(cut_lineage(CB.infer_chains(s, ev))))


@query("selection_keys", "o_custkey:int key:str", "SELECT o_custkey, sha1(string_agg(k, ',' ORDER BY k)) AS key FROM (SELECT DISTINCT o_custkey, 'R' || o_orderkey AS k FROM orders) GROUP BY 1")
def selection_keys(spark, d):
    """Key of every customer's set of orders; repeats and order do not matter."""
    o = C.table(spark, d, "orders").select("o_custkey", F.concat(F.lit(" R"), F.col("o_orderkey").cast("string")).alias("id"))
    return CB.selection_keys(o, "o_custkey", "id")


_PAIRS = " UNION ALL ".join(f"SELECT '{a}+{b}' AS pair, count(*) FILTER ({a}) AS n_a, count(*) FILTER ({b}) AS n_b, count(*) FILTER ({a} AND {b}) AS n_ab, (SELECT count(*) FROM pr x JOIN pr y ON x.skill_id < y.skill_id WHERE (x.{a} AND y.{b}) OR (x.{b} AND y.{a})) AS n_pairs FROM pr" for a, b in CB.COMPLEMENT)


@query("pair_summary", "pair:str n_a:int n_b:int n_ab:int n_pairs:int", f"WITH {PROFILE_CTE} {_PAIRS}")
def pair_summary(spark, d):
    return CB.pairwise_summary(profiles(spark, d))


_PP = " UNION ALL ".join(f"SELECT x.nk, x.skill_id, '{a}+{b}' AS pair, count(*) AS n_partners FROM pn x JOIN pn y ON x.nk = y.nk AND x.skill_id <> y.skill_id WHERE (x.{a} AND y.{b}) OR (x.{b} AND y.{a}) GROUP BY ALL" for a, b in CB.COMPLEMENT)


@query("pair_combinations", "nk:int skill_id:str pair:str n_partners:int", f"WITH {PROFILE_CTE}, pn AS (SELECT pr.*, s_nationkey AS nk FROM pr JOIN supplier ON pr.skill_id = 'supp_' || s_suppkey) {_PP}")
def pair_combinations(spark, d):
    nk = C.table(spark, d, "supplier").select(F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("skill_id"), F.col("s_nationkey").alias("nk"))
    return CB.pairwise_combinations(profiles(spark, d).join(nk, "skill_id"), "nk")


def runs(spark, d):
    """Orders as saved runs: selection key of customer and status, suppliers not joined."""
    o = C.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("key_"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderstatus").alias("selection_key"),
        F.array(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")), F.concat(F.lit("ghost_"), "o_orderstatus")).alias("selected"), F.array(F.lower("o_orderpriority")).alias("capabilities"), F.array(F.lit("orders")).alias("tags"),
        F.when(F.col("o_totalprice") > 400000, F.lit("high")).when(F.col("o_totalprice") > 200000, F.lit("medium")).otherwise(F.lit("low")).alias("risk_level"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("updated_at"))


RUNS_CTE = """rn AS (SELECT 'run_' || o_orderkey AS run_id, 'key_' || o_custkey || '_' || o_orderstatus AS selection_key, ['cust_' || o_custkey, 'ghost_' || o_orderstatus] AS selected, lower(o_orderpriority) AS cap, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'low' END AS risk_level,
  epoch(o_orderdate)::BIGINT AS created_at, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS updated_at FROM orders)"""


@query("runs_in_range", "run_id:str risk_level:str updated_at:int", f"WITH {RUNS_CTE} SELECT * FROM rn WHERE updated_at >= epoch(TIMESTAMP '1996-01-01')::BIGINT AND updated_at < epoch(TIMESTAMP '1998-03-31')::BIGINT + 86400 AND risk_level = 'high' AND (contains(run_id, 'urgent') OR contains(cap, 'urgent') OR contains('orders', 'urgent') OR contains(lower(array_to_string(selected, ' ')), 'urgent'))")
def runs_in_range(spark, d):
    return CB.list_runs(runs(spark, d), "1996-01-01", "1998-03-31", "high", "URGENT")


@query("export_runs", "run_id:str n_refs:int first_name:str second_name:str second_status:str", f"WITH {S.REPORTS}, {RUNS_CTE} SELECT run_id, 2 AS n_refs, coalesce(display_name, selected[1]) AS first_name, selected[2] AS second_name, '' AS second_status FROM rn LEFT JOIN reg ON reg.skill_id = rn.selected[1]")
def export_runs(spark, d):
    e = sinks.export_runs(runs(spark, d), C.customer_registry(spark, d))
    doc = sinks.export_json(e)
    g = lambda p: F.get_json_object("document", p)
    return doc.select("run_id", F.json_array_length(g("$.skill_details")).alias("n_refs"), g("$.skill_details[0].display_name").alias("first_name"), g("$.skill_details[1].display_name").alias("second_name"), g("$.skill_details[1].admission_status").alias("second_status"))


@query("upsert_runs", "selection_key:str run_id:str created_at:int updated_at:int", f"""WITH {RUNS_CTE}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_key ORDER BY updated_at DESC, created_at DESC, run_id DESC) AS r FROM rn WHERE risk_level <> 'high') WHERE r = 1),
  nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_key ORDER BY updated_at DESC, run_id DESC) AS r FROM rn WHERE risk_level = 'high') WHERE r = 1)
  SELECT nw.selection_key, nw.run_id, coalesce(old.created_at, nw.created_at) AS created_at, nw.updated_at FROM nw LEFT JOIN old ON nw.selection_key = old.selection_key UNION ALL SELECT selection_key, run_id, created_at, updated_at FROM old WHERE selection_key NOT IN (SELECT selection_key FROM nw)""")
def upsert_runs(spark, d):
    r = runs(spark, d).select("selection_key", "run_id", "created_at", "updated_at", "risk_level")
    keep = ["selection_key", "run_id", "created_at", "updated_at"]
    old = r.where("risk_level <> 'high'").groupBy("selection_key").agg(F.max(F.struct("updated_at", "created_at", "run_id")).alias("m")).select("selection_key", "m.run_id", "m.created_at", "m.updated_at")
    return sinks.upsert_runs(r.where("risk_level = 'high'").select("selection_key", "run_id", "created_at", "updated_at"), old).select(*keep)


def _fresh_path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("merged_runs", "selection_key:str run_id:str created_at:int updated_at:int", ORACLES["upsert_runs"])
def merged_runs(spark, d):
    """The runs written as a keyed table, high-risk runs merged in by key, and read back."""
    r = runs(spark, d).select("selection_key", "run_id", "created_at", "updated_at", "risk_level")
    keep = ["selection_key", "run_id", "created_at", "updated_at"]
    old = r.where("risk_level <> 'high'").groupBy("selection_key").agg(F.max(F.struct("updated_at", "created_at", "run_id")).alias("m")).select("selection_key", "m.run_id", "m.created_at", "m.updated_at")
    t = MergeTable(spark, _fresh_path(spark, "runs"), ["selection_key"], 16).create(old)
    t.merge(r.where("risk_level = 'high'").select(*keep), matched={"created_at": F.col("old.created_at")}, order="updated_at")
    return t.read()


@query("merged_registry", "skill_id:str review_summary:str admission_status:str", f"""WITH {S.REPORTS}, u AS (SELECT skill_id, count(*) || ' reports' AS review_summary, max(report_id) AS last FROM rep WHERE status = 'F' GROUP BY 1)
  SELECT reg.skill_id, coalesce(u.review_summary, reg.review_summary) AS review_summary, CASE WHEN u.skill_id IS NOT NULL THEN 'approved' ELSE admission_status END AS admission_status FROM reg LEFT JOIN u ON reg.skill_id = u.skill_id""")
def merged_registry(spark, d):
    """The registry written as a keyed table; review results update the skills that are there and add none."""
    reg = C.customer_registry(spark, d).select("skill_id", "review_summary", "admission_status")
    t = MergeTable(spark, _fresh_path(spark, "registry"), ["skill_id"], 16).create(reg)
    u = C.order_reports(spark, d).where("status = 'F'").groupBy("skill_id").agg(F.concat(F.count("*").cast("string"), F.lit(" reports")).alias("review_summary"))
    t.merge(u.withColumn("admission_status", F.lit("approved")), insert=False)
    return t.read()


# --- registry -----------------------------------------------------------------------------------------------

@query("insert_registry", "skill_id:str report_id:str seq:int", f"""WITH {S.REPORTS}, free AS (SELECT skill_id, report_id, seq FROM rep WHERE skill_id NOT IN (SELECT skill_id FROM reg WHERE admission_status = 'approved') AND report_id NOT IN (SELECT report_id FROM reg WHERE admission_status = 'approved')),
  a AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY seq) AS r FROM free) SELECT skill_id, report_id, seq FROM a WHERE r = 1""")
def insert_registry(spark, d):
    new = C.order_reports(spark, d).select("skill_id", "report_id", "seq")
    return sinks.insert_registry(new, C.customer_registry(spark, d).where("admission_status = 'approved'"))


@query("update_registry", "skill_id:str review_summary:str admission_status:str", f"WITH {S.REPORTS}, u AS (SELECT skill_id, count(*) || ' reports' AS review_summary FROM rep WHERE status = 'F' GROUP BY 1) SELECT reg.skill_id, coalesce(u.review_summary, reg.review_summary) AS review_summary, CASE WHEN u.skill_id IS NOT NULL AND contains(u.review_summary, '1') THEN 'approved' ELSE admission_status END AS admission_status FROM reg LEFT JOIN u ON reg.skill_id = u.skill_id")
def update_registry(spark, d):
    u = C.order_reports(spark, d).where("status = 'F'").groupBy("skill_id").agg(F.concat(F.count("*").cast("string"), F.lit(" reports")).alias("review_summary"))
    u = u.withColumn("admission_status", F.when(F.col("review_summary").contains("1"), F.lit("approved")))
    return sinks.update_registry(u, C.customer_registry(spark, d))


@query("save_profiles", "skill_id:str tags:str", f"WITH {PROFILE_CTE} SELECT skill_id, CASE WHEN network_access THEN 'refreshed' ELSE array_to_string(tags, ',') END AS tags FROM pr")
def save_profiles(spark, d):
    p = profiles(spark, d)
    return sinks.save_profile(p.where("network_access").withColumn("tags", F.array(F.lit("refreshed"))), p).withColumn("tags", F.array_join("tags", ","))


@query("import_reports", "skill_id:str report_id:str name:str display_name:str description:str declared:str created_at:int", f"""WITH {S.REPORTS}, fr AS (SELECT * FROM rep WHERE report_id NOT IN (SELECT report_id FROM reg WHERE admission_status = 'approved') AND skill_id NOT IN (SELECT skill_id FROM reg WHERE admission_status = 'approved')),
  a AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY created_at, report_id) AS r FROM fr) SELECT skill_id, report_id, 'order_' || seq AS name, 'order_' || seq AS display_name, CASE WHEN status = 'F' THEN 'calls the http api' ELSE file_name || ' 审查导入' END AS description, CASE WHEN status = 'F' THEN 'network_access' ELSE '' END AS declared, created_at FROM a WHERE r = 1""")
def import_reports(spark, d):
    rep = C.order_reports(spark, d).select("report_id", "skill_id", "file_name", F.when(F.col("status") == "F", F.lit("calls the http api")).alias("description"), F.lit(" ").alias("display_name"), F.col("username").alias("operator"), "created_at")
    p = staged_profiles(spark, d)
    out = A.import_reports(rep, p, A.risk_tags(p, risks(spark, d, p)), C.customer_registry(spark, d).where("admission_status = 'approved'"))
    return out.withColumn("declared", F.array_join("declared_capabilities", ","))


@query("skill_detail", "skill_id:str capabilities:str n_risks:int worst_risk:int n_records:int", f"""WITH {RISK_CTE}, rc AS (SELECT 'supp_' || l_suppkey AS skill_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT 'supp_' || s_suppkey AS skill_id, (SELECT array_to_string(tags, ',') FROM pr WHERE pr.skill_id = 'supp_' || s_suppkey) AS capabilities,
  (SELECT nullif(count(*), 0) FROM rk WHERE rk.skill_id = 'supp_' || s_suppkey) AS n_risks, (SELECT max(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FROM rk WHERE rk.skill_id = 'supp_' || s_suppkey) AS worst_risk, (SELECT n FROM rc WHERE rc.skill_id = 'supp_' || s_suppkey) AS n_records FROM supplier""")
def skill_detail(spark, d):
    reg = C.table(spark, d, "supplier").select(F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("skill_id"))
    rec = C.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("skill_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created_at"))
    return A.skill_detail(reg, profiles(spark, d), risks(spark, d), rec)


@query("skill_records", "skill_id:str name:str record_id:str report_id:str decision:str created_at:int n_records:int is_last:bool", """WITH rc AS (SELECT 'supp_' || l_suppkey AS skill_id, l_orderkey || '-' || l_linenumber AS record_id, 'R' || l_orderkey AS report_id, CASE WHEN l_linestatus = 'O' THEN 'review' ELSE 'pass' END AS decision, epoch(l_shipdate)::BIGINT AS created_at FROM lineitem WHERE l_returnflag = 'R')
  SELECT sp.skill_id, sp.name, record_id, report_id, decision, created_at, count(record_id) OVER w AS n_records, created_at = max(created_at) OVER w AS is_last FROM (SELECT 'supp_' || s_suppkey AS skill_id, s_name AS name FROM supplier) sp LEFT JOIN rc ON rc.skill_id = sp.skill_id WINDOW w AS (PARTITION BY sp.skill_id)""")
def skill_records(spark, d):
    """The records behind ``skill_detail``: returned order lines of each supplier."""
    key = lambda c: F.concat(F.lit("supp_"), F.col(c).cast("string")).alias("skill_id")
    reg = C.table(spark, d, "supplier").select(key("s_suppkey"), F.col("s_name").alias("name"))
    rec = C.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        key("l_suppkey"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("report_id"),
        F.when(F.col("l_linestatus") == "O", "review").otherwise("pass").alias("decision"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created_at"))
    return A.skill_records(reg, rec)


@query("search_registry", "skill_id:str name:str seq:int", f"WITH {S.REPORTS} SELECT skill_id, name, seq FROM reg WHERE contains(lower(concat_ws(' ', skill_id, name, display_name, version, description, review_summary)), 'machinery') ORDER BY seq LIMIT 20")
def search_registry(spark, d):
    """Top-k report: the first 20 matches in insertion order."""
    return A.search_skills(C.customer_registry(spark, d), " MACHINERY ")


@query("list_skills", "skill_id:str updated_at:int", f"WITH {S.REPORTS} SELECT skill_id, updated_at FROM reg WHERE admission_status = 'approved' AND review_decision = 'pass' AND risk_tag = 'furniture'")
def list_skills(spark, d):
    return A.list_skills(C.customer_registry(spark, d), "approved", "pass", "furniture")


@query("valid_rows", "valid:bool n:int", "SELECT c_mktsegment <> 'BUILDING' AS valid, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def valid_rows(spark, d):
    reg = C.customer_registry(spark, d).withColumn("report_id", F.when(F.array_contains("risk_tags", "building"), F.lit("  ")).otherwise(F.col("report_id")))
    return A.validate_rows(reg, "skill").groupBy("valid").agg(F.count("*").alias("n"))


_VIEWER = "Customer#000000002"
_VIS = f"vs AS (SELECT rep.*, (v.role = 'admin' OR rep.username = v.username) AS can_delete FROM rep, (SELECT * FROM usr WHERE username = '{_VIEWER}') v WHERE v.role = 'admin' OR rep.username = v.username OR (v.team <> '' AND rep.team = v.team))"


def visible(spark, d):
    return A.visible_reports(C.order_reports(spark, d), C.customer_users(spark, d), _VIEWER)


@query("visible_reports", "report_id:str username:str team:str can_delete:bool", f"WITH {S.REPORTS}, {_VIS} SELECT * FROM vs")
def visible_reports(spark, d):
    return visible(spark, d)


@query("report_listing", "report_id:str created_at:int imported:bool imported_skill_id:str can_delete:bool", f"WITH {S.REPORTS}, {_VIS} SELECT vs.report_id, vs.created_at, reg.skill_id IS NOT NULL AS imported, reg.skill_id AS imported_skill_id, can_delete FROM vs LEFT JOIN reg ON vs.report_id = reg.report_id")
def report_listing(spark, d):
    return A.report_listing(visible(spark, d), C.customer_registry(spark, d).select("report_id", "skill_id"))


@query("latest_reports", "report_id:str created_at:int", f"WITH {S.REPORTS}, {_VIS} SELECT report_id, created_at FROM vs ORDER BY created_at DESC, report_id LIMIT 10")
def latest_reports(spark, d):
    """Top-k report: the dashboard's ten newest rows."""
    return A.latest_reports(visible(spark, d))


@query("result_payloads", "skill_id:str category:str n:int", f"WITH {S.SUPPLIER} SELECT skill_id, category, count(*) AS n FROM bh WHERE category IN ('network_targets', 'outbound', 'credential', 'behavior_chains') GROUP BY 1, 2")
def result_payloads(spark, d):
    """Nested report payloads written as JSON and read back into rows."""
    b = C.supplier_behavior(spark, d)
    names = {"network_targets": "network_targets", "outbound": "outbound_iocs", "credential": "credential_iocs", "behavior_chains": "behavior_chains"}
    # one payload per row, as one report holds its own lists
    fields = [F.when(F.col("category") == c, F.array("item")).alias(n) for c, n in names.items()]
    pay = b.where(F.col("category").isin(list(names))).select("skill_id", F.to_json(F.struct(F.struct(F.struct(*fields).alias("behavior")).alias("result"))).alias("payload"))
    return RG.explode_results(pay).groupBy("skill_id", "category").agg(F.count("*").alias("n"))


@query("normalized_registry", "skill_id:str name:str admission_status:str", f"WITH {S.REPORTS} SELECT skill_id, name, CASE WHEN admission_status = 'rejected' THEN 'pending' ELSE admission_status END AS admission_status FROM reg")
def normalized_registry(spark, d):
    r = C.customer_registry(spark, d)
    messy = r.withColumns({"name": F.concat(F.lit("\t "), "name", F.lit(" \n")), "admission_status": F.when(F.col("admission_status") == "rejected", F.lit(" ")).otherwise(F.col("admission_status"))})
    return RG.normalize(messy)


# --- vectors ------------------------------------------------------------------------------------------------------

_EMB = "em AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), ct0 AS (SELECT label, i, avg(v[i]) AS m FROM em, range(1, 65) r(i) GROUP BY 1, 2), ct AS (SELECT label, list(m ORDER BY i) AS c FROM ct0 GROUP BY 1)"
_COS = "list_cosine_similarity(v, c)"


def vector_pairs(spark, d):
    """Every vector with the centroid of its label (equi join on label)."""
    e = C.table(spark, d, "embeddings")
    return e.join(similarity.centroids(e), "label")


@query("cosine_pairs", "vec_id:int label:int cosine:float dot:float distance:float", f"WITH {_EMB} SELECT vec_id, em.label, {_COS} AS cosine, list_inner_product(v, c) AS dot, list_distance(v, c) AS distance FROM em JOIN ct ON em.label = ct.label")
def cosine_pairs(spark, d):
    a, b = F.col("embedding"), F.col("centroid")
    return vector_pairs(spark, d).select("vec_id", "label", V.cosine(a, b).alias("cosine"), V.dot(a, b).alias("dot"), V.euclidean(a, b).alias("distance"))


@query("alignment_bands", "vec_id:int band:str score:float", f"WITH {_EMB}, s AS (SELECT vec_id, {_COS} AS x FROM em JOIN ct ON em.label = ct.label) SELECT vec_id, CASE WHEN x < 0.5 THEN 'fail' WHEN x < 0.75 THEN 'half' ELSE 'full' END AS band, CASE WHEN x < 0.5 THEN 0 WHEN x < 0.75 THEN 5 ELSE 10 END AS score FROM s")
def alignment_bands(spark, d):
    p = vector_pairs(spark, d).select("vec_id", F.col("embedding").alias("a"), F.col("centroid").alias("b"))
    return scoring.semantic_alignment(p, weight=10.0)


@query("similar_vectors", "query_id:int rank:int vec_id:int cosine:float", """WITH em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.v, x.v), 9) AS cosine FROM em q JOIN em x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank, vec_id, cosine FROM s QUALIFY rank <= 5""")
def similar_vectors(spark, d):
    """For every vector whose id is divisible by 50 the five most similar of all others, found through coarse cells."""
    e = C.table(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.similar_vectors(e, e.where("vec_id % 50 = 0"))


@query("topk_similar", "label:int rank:int vec_id:int", f"WITH {_EMB}, s AS (SELECT em.label, vec_id, row_number() OVER (PARTITION BY em.label ORDER BY round({_COS}, 9) DESC, vec_id) AS rank FROM em JOIN ct ON em.label = ct.label) SELECT * FROM s WHERE rank <= 5")
def topk_similar(spark, d):
    """Five vectors nearest to each label's centroid (a top-k report, exact)."""
    s = vector_pairs(spark, d).select("label", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 9).alias("c"))
    w = Window.partitionBy("label").orderBy(F.desc("c"), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query("unit_vectors", "label:int n:int total:float", "SELECT label, count(*) AS n, sum(sqrt(list_inner_product(u, u))) AS total FROM (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings) GROUP BY 1")
def unit_vectors(spark, d):
    u = similarity.unit(C.table(spark, d, "embeddings"))
    return u.groupBy("label").agg(F.count("*").alias("n"), F.sum(V.norm(F.col("embedding"))).alias("total"))


@query("code_summary", "skill_id:str path:str summary:str")
def code_summary(spark, d):
    """Order-sensitive text assembly; checked on fixtures."""
    return similarity.code_summary(C.seeded_files(spark, d))


_TREE_PATH = "CASE doc_id % 3 WHEN 0 THEN 'notes/doc_' || doc_id || '.bin' WHEN 1 THEN 'src/doc_' || doc_id || '.py' ELSE 'src/doc_' || doc_id || '.JSON.js' END"


@query("tree_files", "skill_id:str path:str language:str n_bytes:int sha256:str", f"""SELECT 'src_' || source AS skill_id, {_TREE_PATH} AS path, CASE doc_id % 3 WHEN 1 THEN 'python' ELSE 'javascript' END AS language, strlen(text) AS n_bytes, sha256(text) AS sha256
  FROM documents WHERE doc_id % 3 <> 0""")
def tree_files(spark, d):
    """All documents written as a tree of files, a third of them of a kind that is dropped, and read back."""
    path = F.expr(_TREE_PATH)
    docs = C.table(spark, d, "documents").select(F.concat(F.lit("src_"), "source").alias("skill_id"), path.alias("path"), F.col("text").alias("content"))
    root = _fresh_path(spark, "tree")
    file_tree.write_tree(docs, root)
    return file_tree.read_tree(spark, root)


# --- incremental ------------------------------------------------------------------------------------------------------

def snapshot(spark, d):
    """Yesterday's fingerprints of all sizes: by a number from the document's id some are altered and some are missing."""
    f = INC.fingerprints(C.document_files(spark, d))
    turn = F.regexp_extract("rel_path", "([0-9]+)$", 1).cast("long") * 7919 % 10
    return f.where(turn < 9).withColumn("sha256", F.when(turn < 6, F.col("sha256")).otherwise(F.reverse("sha256")))


_CMP = "cp AS (SELECT source AS skill_id, 'scripts/doc_' || doc_id AS rel_path, CASE WHEN doc_id * 7919 % 10 < 6 OR (doc_id * 7919 % 10 < 9 AND reverse(sha256(text)) = sha256(text)) THEN 'hit' ELSE 'miss' END AS status FROM documents)"


@query("changed_files", "skill_id:str rel_path:str", f"WITH {_CMP} SELECT skill_id, rel_path FROM cp WHERE status = 'miss'")
def changed_files(spark, d):
    return INC.changed_files(INC.fingerprints(C.document_files(spark, d)), snapshot(spark, d))


@query("changed_files_bucketed", "skill_id:str rel_path:str", f"WITH {_CMP} SELECT skill_id, rel_path FROM cp WHERE status = 'miss'")
def changed_files_bucketed(spark, d):
    """The same from two tables that lie bucketed by file, which are compared without a shuffle."""
    now = INC.bucketed(INC.fingerprints(C.document_files(spark, d)), "vetlake_current_files", 16)
    return INC.changed_files(now, INC.bucketed(snapshot(spark, d), "vetlake_snapshot_files", 16))


@query("scan_stats", "skill_id:str candidate:int hit:int miss:int hit_rate:float", f"WITH {_CMP} SELECT skill_id, count(*) AS candidate, count(*) FILTER (status = 'hit') AS hit, count(*) FILTER (status = 'miss') AS miss, 100.0 * count(*) FILTER (status = 'hit') / count(*) AS hit_rate FROM cp GROUP BY 1")
def scan_stats(spark, d):
    return INC.scan_stats(INC.compare_files(INC.fingerprints(C.document_files(spark, d)), snapshot(spark, d)))


@query("evict_snapshot", "rel_path:str seq:int", "SELECT 'scripts/doc_' || doc_id AS rel_path, n_chars * 1000000 + doc_id AS seq FROM documents ORDER BY seq DESC LIMIT 500")
def evict_snapshot(spark, d):
    """The snapshot's size limit (here 500 entries) is the feature."""
    t = C.table(spark, d, "documents").select(F.col("source").alias("skill_id"), F.concat(F.lit("scripts/doc_"), F.col("doc_id").cast("string")).alias("rel_path"), (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("seq"), "lang")
    return INC.evict_snapshot(t, 500)


@query("content_cache", "cache_key:str cached:bool level:str", "SELECT sha256(text) AS cache_key, coalesce(bool_or(l.quality = 1), FALSE) AS cached, max(CASE WHEN l.quality = 1 THEN 'reviewed' END) AS level FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id, text")
def content_cache(spark, d):
    """Documents whose labelled result has not expired reuse it."""
    docs, labels = C.table(spark, d, "documents"), C.table(spark, d, "labels")
    req = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("cache_key"))
    res = docs.join(labels, "doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("cache_key"), (F.col("quality") * 100).alias("expire_at"), F.lit("reviewed").alias("level"))
    out = INC.content_cache(req, res, 50)
    return out.withColumn("cache_key", F.substring_index("cache_key", ":", -1))


_TTL = 36 * 3600


@query("asof_reuse", "event_id:int result_at:int result_id:int cached:bool", f"""WITH rq AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type = 'click'),
  rs AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT rq.event_id, rs.at AS result_at, rs.event_id AS result_id, coalesce(rq.at - rs.at < {_TTL}, FALSE) AS cached FROM rq ASOF LEFT JOIN rs ON rq.user_id = rs.user_id AND rq.at >= rs.at""")
def asof_reuse(spark, d):
    """Every click meets its user's latest purchase at or before it, and reuses it while it is fresh at that time."""
    e = C.table(spark, d, "events").select("event_id", F.col("user_id").alias("cache_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    out = AO.reusable(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), _TTL)
    return out.select("event_id", F.col("result.at").alias("result_at"), F.col("result.event_id").alias("result_id"), "cached")


@query("cache_keys", "skill_id:str key_len:int n_distinct:int", f"WITH {S.SEED_LINES} SELECT 'skill_' || g AS skill_id, 324 AS key_len, 1 AS n_distinct FROM man0")
def cache_keys(spark, d):
    files = C.seeded_files(spark, d)
    k = INC.content_key(files, C.seeded_skills(spark, d), extract_dependencies(files))
    return k.groupBy("skill_id").agg(F.max(F.length("cache_key")).alias("key_len"), F.count_distinct("cache_key").alias("n_distinct"))


# --- data flow ---------------------------------------------------------------------------------------------------------------

@query("reachability", "skill_id:str name:str hop:int", """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || (l_orderkey // 100) AS skill_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_quantity >= 25 UNION SELECT DISTINCT 'c' || (l_orderkey // 100), 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity < 25),
  r AS (SELECT DISTINCT 'c' || (l_orderkey // 100) AS skill_id, 'p' || l_partkey AS name, 0 AS hop FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 UNION SELECT e.skill_id, e.dst, r.hop + 1 FROM r JOIN e ON r.skill_id = e.skill_id AND r.name = e.src WHERE r.hop < 60)
  SELECT skill_id, name, min(hop) AS hop FROM r GROUP BY 1, 2""")
def reachability(spark, d):
    """Reachability over part/supplier edges of order groups, to the end."""
    li = C.table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.floor(F.col("l_orderkey") / 100).cast("string")).alias("skill_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), "l_quantity", "l_discount")
    edges = li.where("l_quantity >= 25").select("skill_id", F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(li.where("l_quantity < 25").select("skill_id", F.col("s").alias("src"), F.col("p").alias("dst")))
    seeds = li.where("l_quantity >= 50 and l_discount >= 0.1").select("skill_id", F.col("p").alias("name"))
    return flow.propagate(edges, seeds, keys=("skill_id",))


@query("assignment_edges", "skill_id:str path:str dst:str src:str kind:str")
def assignment_edges(spark, d):
    return flow.assignment_edges(C.seeded_files(spark, d))


def analysed_files(spark, d):
    """The seeded files with their assignments and decoded text, and the variables that hold such text: found once, written, then read by every step."""
    done = flow.with_analysis(flow.with_variables(flow.with_assignments(C.seeded_files(spark, d))))
    files = stage_table(done.select("skill_id", "path", "content", "_assignments", "_variables", "preprocessed"), "analysed")
    return files, stage_table(flow.decoded_variables(files), "decoded-variables")


@query("flow_signals", "skill_id:str path:str signal:str")
def flow_signals(spark, d):
    """Row-dependent patterns have no plain SQL form; checked on fixtures."""
    files, seeds = analysed_files(spark, d)
    return flow.flow_signals(files, seeds, flow.propagate(flow.assignment_edges(files), seeds))


@query("flow_chains", "skill_id:str path:str kind:str category:str")
def flow_chains(spark, d):
    files, seeds = analysed_files(spark, d)
    return flow.flow_chains(flow.flow_signals(files, seeds, flow.propagate(flow.assignment_edges(files), seeds)))


@query("obfuscation_evidence", "skill_id:str path:str techniques:str n_sections:int signals:str")
def obfuscation_evidence(spark, d):
    files, seeds = analysed_files(spark, d)
    return flow.obfuscation_evidence(files, flow.flow_signals(files, seeds, flow.propagate(flow.assignment_edges(files), seeds)))


# --- streams (batch twins) ----------------------------------------------------------------------------------------------------------

_PAIRS_EV = {"view then purchase": ("view", "purchase"), "click then error": ("click", "error")}


@query("session_alerts_stream", "user_id:int session_start:int n_events:int alert:str", f"""WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a),
  c AS (SELECT user_id, s, epoch_us(min(ts)) AS session_start, count(*) AS n_events, min(ts) FILTER (event_type = 'view') AS fv, max(ts) FILTER (event_type = 'purchase') AS lp, min(ts) FILTER (event_type = 'click') AS fc, max(ts) FILTER (event_type = 'error') AS le FROM b GROUP BY 1, 2)
  SELECT user_id, session_start, n_events, 'view then purchase' AS alert FROM c WHERE fv < lp UNION ALL SELECT user_id, session_start, n_events, 'click then error' FROM c WHERE fc < le""")
def session_alerts_stream(spark, d):
    ev = C.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.session_alerts(ev, _PAIRS_EV).withColumn("session_start", F.unix_micros("session_start"))


_GAP = 6 * 3600


@query("user_sessions", "user_id:int range_start:int range_end:int n_categories:int total:int", f"""WITH e AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events), a AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM e),
  b AS (SELECT *, sum(CASE WHEN p IS NULL OR pos - p > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM a)
  SELECT user_id, min(pos) AS range_start, max(pos) AS range_end, count(DISTINCT event_type) AS n_categories, count(*) AS total FROM b GROUP BY user_id, s""")
def user_sessions(spark, d):
    """Batch twin of the keyed session stream: local sessions per user and bucket, stitched at the borders."""
    ev = C.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return KS.stitched(KS.local_sessions(ev, _GAP), _GAP).withColumn("user_id", F.col("key").cast("long"))


@query("login_counts", "window_start:int result:str n:int", "SELECT epoch_us(date_trunc('day', ts)) AS window_start, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS result, count(*) AS n FROM events GROUP BY 1, 2")
def login_counts(spark, d):
    ev = C.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", F.lit("fail")).otherwise(F.lit("success")).alias("result"))
    return ST.login_counts(ev).withColumn("window_start", F.unix_micros("window_start"))


@query("arrival_scan", "skill_id:str path:str line_no:int label:str", f"WITH {S.DOC_LINES} SELECT skill_id, path, line_no, label FROM ({_pack_sql(P.HARDCODED_CREDENTIALS, 'doc_l')})")
def arrival_scan(spark, d):
    """Batch twin of the arriving-artifact scan; repeated deliveries are scanned once."""
    f = C.document_files(spark, d).select("skill_id", "path", "content", F.lit("2024-01-01").cast("timestamp").alias("arrived"))
    return ST.scan_arrivals(f.unionByName(f), [P.HARDCODED_CREDENTIALS])
