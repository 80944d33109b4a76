"""Admission registry: capability profiles, residual risks, imports, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, clean_array, has_text, ws_trim
from ..sources.sinks import first_come
from .sets import declared_capabilities

# Capability -> behaviour inputs that prove it, in listing order.
CAPABILITY_INPUTS = {
    "network_access": ["network_targets", "outbound", "c2_beacon"], "file_read": ["file_targets", "credential"], "file_write": ["drop", "persistence"],
    "command_exec": ["exec_targets", "execute"], "sensitive_data_access": ["credential"], "external_fetch": ["download", "outbound"], "data_collection": ["collection"],
    "persistence": ["persistence"], "privilege_use": ["priv_esc"], "tool_invocation": ["exec_targets", "execute"],
}
CAPABILITIES = list(CAPABILITY_INPUTS)
# Evidence lists, in order; a profile shows the first two items of each.
EVIDENCE_LISTS = ["network_targets", "outbound", "file_targets", "credential", "exec_targets", "execute", "persistence", "behavior_chains", "sequence_alerts"]
EVIDENCE_PER_LIST = 2


def behavior_rows(**lists: DataFrame) -> DataFrame:
    """Long behaviour table (skill_id, category, item) from named frames holding skill_id and item."""
    out = None
    for name, df in lists.items():
        p = df.select("skill_id", F.lit(name).alias("category"), F.col("item").cast("string").alias("item"))
        out = p if out is None else out.unionByName(p)
    return out


def detected_capabilities() -> Column:
    """Ordered names of the true capability columns."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CAPABILITIES]))


def capability_profiles(behavior: DataFrame) -> DataFrame:
    """Ten booleans, tags and up to two examples from each of nine evidence lists.

    ``behavior``: skill_id, category, item.  Examples are ranked before they are gathered, so at
    most two rows per list and task reach the final group.
    """
    flags = behavior.groupBy("skill_id").agg(*[F.bool_or(F.col("category").isin(v)).alias(k) for k, v in CAPABILITY_INPUTS.items()])
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(EVIDENCE_LISTS) for x in (c, i)])
    w = Window.partitionBy("skill_id", "category").orderBy("item")
    ex = behavior.where(F.col("category").isin(EVIDENCE_LISTS) & (ws_trim(F.col("item")) != "")).select("skill_id", "category", "item").distinct()
    ex = ex.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= EVIDENCE_PER_LIST)
    ex = ex.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct(F.element_at(rank, F.col("category")).alias("o"), "rn", "item"))).alias("_e"))
    ev = ex.select("skill_id", clean_array(F.transform("_e", lambda e: e["item"])).alias("evidence"))
    out = flags.join(ev, "skill_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return out.withColumn("tags", detected_capabilities())


def evidence_items(behavior: DataFrame) -> DataFrame:
    """``skill_id, item``: every item of the nine evidence lists, which chains are inferred from (profiles show examples)."""
    return behavior.where(F.col("category").isin(EVIDENCE_LISTS) & has_text(F.col("item"))).select("skill_id", "item").distinct()


def capability_unpivot(profiles: DataFrame) -> DataFrame:
    """One row per skill and detected capability."""
    return profiles.select("skill_id", F.explode(detected_capabilities()).alias("capability"))


# Derived risks (id, category, level, title) and their triggers.
RESIDUAL = [
    ("network-access", "网络访问", "medium", "存在外联能力", "network_access"), ("command-exec", "命令执行", "high", "存在命令执行能力", "command_exec"),
    ("sensitive-access", "敏感数据访问", "high", "存在敏感数据访问能力", "sensitive_data_access"), ("behavior-chain", "行为链", "high", "存在高风险行为链摘要", "has_chains"),
    ("sequence-alert", "时序告警", "medium", "存在高风险时序告警", "has_alerts"),
]


def residual_risks(profiles: DataFrame, behavior_flags: DataFrame | None = None) -> DataFrame:
    """Up to five derived risks per skill (``behavior_flags``: skill_id, has_chains, has_alerts)."""
    j = profiles.join(behavior_flags, "skill_id", "left") if behavior_flags is not None else profiles.withColumns({"has_chains": F.lit(False), "has_alerts": F.lit(False)})
    cells = [F.when(F.coalesce(F.col(t), F.lit(False)), F.struct(F.lit(i).alias("risk_id"), F.lit(c).alias("category"), F.lit(l).alias("level"), F.lit(n).alias("title"))) for i, c, l, n, t in RESIDUAL]
    # ids are unique per trigger, so the id:title dedupe of the source never removes a row here
    return j.select("skill_id", F.explode(F.array_compact(F.array(*cells))).alias("r")).select("skill_id", "r.*")


def risk_tags(profiles: DataFrame, risks: DataFrame) -> DataFrame:
    """Three flag tags plus normalised risk categories, distinct."""
    cats = risks.groupBy("skill_id").agg(F.sort_array(F.collect_set(F.lower(F.replace(ws_trim(F.col("category")), F.lit(" "), F.lit("_"))))).alias("_c"))
    flags = F.array_compact(F.array(F.when(F.col("network_access"), F.lit("outbound_network")), F.when(F.col("command_exec"), F.lit("command_execution")), F.when(F.col("sensitive_data_access"), F.lit("sensitive_access"))))
    return profiles.join(cats, "skill_id", "left").select("skill_id", clean_array(F.concat(flags, F.coalesce("_c", F.array().cast("array<string>")))).alias("risk_tags"))


# Purpose phrases.
PURPOSE_DEFAULT = "基于扫描报告导入的准入技能"


def purpose_summary(description: Column) -> Column:
    """The description, or a phrase built from the profile flags."""
    d = ws_trim(F.coalesce(description, F.lit("")))
    phrase = F.concat_ws("，", F.when(F.col("network_access"), F.lit("具备网络访问能力")), F.when(F.col("file_read") | F.col("file_write"), F.lit("涉及文件处理")), F.when(F.col("command_exec"), F.lit("涉及命令执行")))
    return F.when(d != "", d).when(phrase != "", phrase).otherwise(F.lit(PURPOSE_DEFAULT))


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.when(stem == "", name).otherwise(stem)


def import_reports(reports: DataFrame, profiles: DataFrame, tags: DataFrame, registry: DataFrame) -> DataFrame:
    """Reports -> registry rows, rejecting reports already imported and repeats inside the batch.

    ``reports``: report_id, skill_id, file_name, description, display_name, operator, created_at.
    """
    fresh = reports.where(ws_trim(F.col("report_id")) != "").join(registry.select("report_id").distinct(), "report_id", "left_anti")
    fresh = fresh.join(registry.select("skill_id").distinct(), "skill_id", "left_anti")
    # one report per skill and one skill per report, first come first served
    fresh = first_come(fresh.withColumn("_order", F.struct("created_at", "report_id", "skill_id", "file_name", "description", "display_name", "operator")).dropDuplicates(["_order"]), "_order").drop("_order")
    j = fresh.join(profiles, "skill_id", "left").join(tags, "skill_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    j = j.withColumns({c: flag(c) for c in CAPABILITIES})
    name = file_stem(F.col("file_name"))
    disp, desc = ws_trim(F.coalesce("display_name", F.lit(""))), ws_trim(F.coalesce("description", F.lit("")))
    return j.select(
        "skill_id", "report_id", name.alias("name"), F.when(disp == "", name).otherwise(disp).alias("display_name"), "file_name",
        F.when(desc == "", F.concat("file_name", F.lit(" 审查导入"))).otherwise(desc).alias("description"), purpose_summary(F.col("description")).alias("purpose_summary"),
        declared_capabilities(F.coalesce("description", F.lit(""))).alias("declared_capabilities"), detected_capabilities().alias("detected_capabilities"),
        F.coalesce("risk_tags", F.array().cast("array<string>")).alias("risk_tags"), F.lit("pending").alias("admission_status"), F.lit("review").alias("review_decision"),
        F.lit("").alias("review_summary"), F.lit("").alias("version"), F.lit("report_import").alias("source_type"), F.col("operator").alias("created_by"), F.col("created_at"), F.col("created_at").alias("updated_at"))


def skill_detail(registry: DataFrame, profiles: DataFrame, risks: DataFrame, records: DataFrame) -> DataFrame:
    """Registry rows with profile capabilities, number and worst level of risks, number and last time of records.

    Children are aggregated before the join; nested lists of a skill's whole history are not built.
    """
    lvl = F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).otherwise(1)
    r = risks.groupBy("skill_id").agg(F.count("*").alias("n_risks"), F.max(lvl).alias("worst_risk"))
    rec = records.groupBy("skill_id").agg(F.count("*").alias("n_records"), F.max("created_at").alias("last_review"))
    p = profiles.select("skill_id", F.array_join(detected_capabilities(), ",").alias("capabilities"))
    return registry.join(p, "skill_id", "left").join(r, "skill_id", "left").join(rec, "skill_id", "left")


def skill_records(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Every review record of the registered skills, one row each: the record, ``name``, ``n_records`` and ``is_last``.

    A history is rows, not one nested list, so a skill with a third of all records is no hot row; the join with the records is
    an inner one, whose record side may be split.  Several records of the last moment are all last.  A skill without records is
    one row of nulls with ``n_records`` 0, and records of skills that are not registered are left out.
    """
    last = records.groupBy("skill_id").agg(F.count("*").alias("n_records"), F.max("created_at").alias("_last"))
    known = registry.select("skill_id", "name").join(last, "skill_id", "left")
    listed = records.join(known.where("n_records is not null"), "skill_id").withColumn("is_last", F.col("created_at") == F.col("_last")).drop("_last")
    none = known.where("n_records is null").select("skill_id", "name", F.lit(0).cast("long").alias("n_records"))
    return listed.unionByName(none, allowMissingColumns=True)


SEARCH_FIELDS = ["skill_id", "name", "display_name", "version", "description", "review_summary"]


def search_skills(registry: DataFrame, query: str, limit: int = 20, order: str = "seq") -> DataFrame:
    """First ``limit`` rows in insertion order whose joined fields contain the query (a top-k report)."""
    q = (query or "").strip().lower()
    hit = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in SEARCH_FIELDS])).contains(q)
    return registry.where(hit if q else F.lit(True)).orderBy(order).limit(limit if limit > 0 else 20)


def list_skills(registry: DataFrame, status: str | None = None, decision: str | None = None, risk_tag: str | None = None) -> DataFrame:
    """Filtered by status, decision, tag; newest update first."""
    out = registry
    if status:
        out = out.where(F.lower(ws_trim(F.col("admission_status"))) == status.lower())
    if decision:
        out = out.where(F.lower(ws_trim(F.col("review_decision"))) == decision.lower())
    if risk_tag:
        out = out.where(F.exists("risk_tags", lambda t: F.lower(ws_trim(t)) == risk_tag.lower()))
    return out.orderBy(F.desc("updated_at"), F.desc("created_at"), "skill_id")


# Required fields per record type; each group needs one non-empty member.
REQUIRED = {
    "skill": [["skill_id"], ["report_id"], ["name", "display_name"]], "review_record": [["record_id"], ["skill_id"], ["report_id"]], "residual_risk": [["title"]],
}


def validate_rows(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``valid``: every required field group has a non-empty member."""
    filled = lambda c: ws_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    ok = F.lit(True)
    for group in REQUIRED[kind]:
        ok = ok & any_of(filled(c) for c in group)
    return df.withColumn("valid", ok)


# --- reports -----------------------------------------------------------------------------------------

def visible_reports(reports: DataFrame, users: DataFrame, viewer: str) -> DataFrame:
    """Rows the viewer may see: admins all, others their own and their (non-empty) team's; with delete rights.

    ``reports``: report_id, username, team, ...; ``users``: username (unique), team, role.  The
    viewer's role and team are scalar subqueries, so the whole test is one filter on the reports:
    no join.  An unknown viewer still sees reports under that name but may delete none.
    """
    row = users.where(F.col("username") == viewer)
    role, own_team = row.select(F.max("role")).scalar(), row.select(F.max("team")).scalar()
    admin = F.coalesce(role == "admin", F.lit(False))
    own = F.col("username") == viewer
    mates = F.coalesce((own_team != "") & (own_team == F.col("team")), F.lit(False))
    return reports.where(admin | own | mates).withColumn("can_delete", role.isNotNull() & (admin | own))


def report_listing(visible: DataFrame, registry: DataFrame) -> DataFrame:
    """Visible rows with the imported skill id, newest first."""
    reg = registry.select("report_id", F.col("skill_id").alias("imported_skill_id"))
    return visible.join(reg, "report_id", "left").withColumn("imported", F.col("imported_skill_id").isNotNull()).orderBy(F.desc("created_at"), "report_id")


def latest_reports(visible: DataFrame, k: int = 10) -> DataFrame:
    """Dashboard: newest ``k`` rows (TakeOrdered, no global sort)."""
    return visible.orderBy(F.desc("created_at"), "report_id").limit(k)
