"""Sinks: findings, upserts, inserts, appends and exports on plain parquet and JSON.

Upserts are DataFrame merges; the caller writes the result to a new location (plain parquet
has no in-place merge, and overwriting a path that the plan still reads loses data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..session import cut_lineage


def findings_payload(findings: DataFrame, key: str = "skill_id") -> DataFrame:
    """One JSON object per finding with its key: the row form of a report payload."""
    cols = [c for c in findings.columns if c != key]
    return findings.select(key, F.to_json(F.struct(*cols)).alias("payload"))


def write_findings(findings: DataFrame, path: str, partition: str = "severity", fmt: str = "parquet") -> None:
    """Partitioned findings; a hot partition value is spread over many files by the task layout."""
    findings.write.mode("append").partitionBy(partition).format(fmt).save(path)


def _later(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key by ``order`` (max of a struct: partial aggregation)."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *rest)])


def upsert_runs(new: DataFrame, existing: DataFrame, key: str = "selection_key", order: str = "updated_at") -> DataFrame:
    """Insert or replace by key, keeping the original ``created_at``; rows without a key are dropped."""
    fresh = _later(new.where(ws_trim(F.coalesce(key, F.lit(""))) != ""), key, order)
    old = existing.select(key, F.col("created_at").alias("_created"))
    merged = fresh.join(old, key, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(merged.select(*existing.columns))


def first_come(rows: DataFrame, order: str, keys: tuple[str, str] = ("skill_id", "report_id")) -> DataFrame:
    """Rows that insertion one by one in ``order`` accepts, when both keys must still be unused.

    A row that is the first open one of both its keys is accepted; all other rows with one of its
    keys are then refused, and the next round looks at what is left.  Rows are shuffled as keys and
    order only; ``order`` must tell rows apart.  Most batches end after one or two rounds.
    """
    open_rows = cut_lineage(rows.select(*keys, order))
    taken = None
    while True:
        low = open_rows
        for key in keys:
            low = low.join(open_rows.groupBy(key).agg(F.min(order).alias(f"_{key}")), key)
        accepted = low.where(" and ".join(f"{order} = _{key}" for key in keys)).select(*keys, order)
        accepted = cut_lineage(accepted)
        if accepted.isEmpty():
            return rows.limit(0) if taken is None else rows.join(taken.select(order), order, "left_semi").select(*rows.columns)
        taken = accepted if taken is None else taken.unionByName(accepted)
        for key in keys:
            open_rows = open_rows.join(accepted.select(key), key, "left_anti")
        open_rows = cut_lineage(open_rows)


def insert_registry(new: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """Rows of ``new`` that insertion in ``order`` accepts: skill_id and report_id both unused so far."""
    free = new.join(existing.select("skill_id").distinct(), "skill_id", "left_anti").join(existing.select("report_id").distinct(), "report_id", "left_anti")
    return first_come(free, order).select(*new.columns)


def _last_of_each(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the last by ``order``, or the largest row where there is no order."""
    if order:
        return _later(df, key, order)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def update_registry(updates: DataFrame, existing: DataFrame, key: str = "skill_id", order: str | None = None) -> DataFrame:
    """Replace known keys field by field (null keeps the old value); unknown keys are skipped.

    Of several updates for a key the last by ``order`` counts.
    """
    updates = _last_of_each(updates, key, order)
    u = updates.select(F.col(key), *[F.col(c).alias("_n_" + c) for c in updates.columns if c not in (key, order)])
    changed = [c for c in updates.columns if c not in (key, order) and c in existing.columns]
    return existing.join(u, key, "left").select(*[F.coalesce("_n_" + c, c).alias(c) if c in changed else F.col(c) for c in existing.columns])


def save_profile(new: DataFrame, existing: DataFrame, key: str = "skill_id", order: str | None = None) -> DataFrame:
    """Replace by key or insert; of several new rows for a key the last by ``order`` counts."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(_last_of_each(new, key, order).select(*existing.columns))


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only tables: login log, review records."""
    df.write.mode("append").format(fmt).save(path)


def export_runs(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs with references to their selected skills; unknown ids fall back to the id as name.

    ``runs``: run_id, selection_key, selected array<string>, ...; each run is one row, so its
    references are gathered back in selection order.
    """
    ref = registry.select("skill_id", "name", "display_name", "version", "admission_status", "review_decision")
    ids = runs.select("run_id", F.posexplode("selected").alias("pos", "sid")).withColumn("skill_id", ws_trim(F.col("sid"))).where("skill_id <> ''")
    j = ids.join(ref.withColumn("_known", F.lit(True)), "skill_id", "left")
    filled = lambda c: F.when(ws_trim(F.coalesce(c, F.lit(""))) == "", None).otherwise(F.col(c))
    name: Column = F.when(F.col("_known"), F.coalesce(filled("display_name"), filled("name"), F.col("skill_id"))).otherwise(F.col("skill_id"))
    version = F.when(F.col("_known"), F.coalesce(filled("version"), F.lit("-"))).otherwise(F.lit(""))
    refs = j.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "skill_id", name.alias("display_name"), version.alias("version"), F.coalesce("admission_status", F.lit("")).alias("admission_status"),
        F.coalesce("review_decision", F.lit("")).alias("review_decision")))).alias("_r"))
    out = runs.join(refs, "run_id", "left")
    return out.withColumn("skill_details", F.transform("_r", lambda r: r.dropFields("pos"))).drop("_r")


def export_json(exported: DataFrame) -> DataFrame:
    """One JSON document per run."""
    return exported.select("run_id", F.to_json(F.struct(*exported.columns)).alias("document"))
