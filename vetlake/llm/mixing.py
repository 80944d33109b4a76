"""Mixing sources to target weights.

Tokens are summed per source, targets are shares of the whole by weight with a ceiling of
``MAX_RATE`` times the source, and the excess goes to the other sources by weight.  The repetition
rate of a source is ``target / size``.  Each document is emitted ``floor(rate)`` times, plus once more
with probability ``rate - floor(rate)``, decided by a seeded hash of its id: the same in every rerun,
on every partition, and independent of all other rows.

The documents are read for their sizes and again for the copies; only one row per source is shuffled,
and a source that holds most rows is summed before the shuffle.  The table of rates has one row per
source and meets the documents in a join whose strategy Spark picks by the table's written size.

Defined cases.  Null text: size 0.  Null source: one more source, after all others.  Null ``doc_id``: the
coin is drawn from the source and text instead.  Repeated rows: equal rows share one coin.  Sources
without words have target 0.  Empty table: empty result.  Other columns are kept by ``mix`` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetlake.session import stage_table

from .common import ROW, WORD, pack_row, unpack_row, whole_text

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = 20_240_601


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    Filling by weight under ceilings: ordered by ``ceiling / weight`` the sources that hit their
    ceiling are the first ones, so the level of the others follows from running sums.  The windows
    run over one row per source, not over documents.
    """
    sums = docs.groupBy("source").agg(F.sum(size_of(whole_text())).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sums.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * max_rate).alias("ceiling"))
    order = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rest = total - F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    level = rest / F.sum("w").over(onward)
    filled = ranked.select("source", "source_size", "w", "ceiling", level.alias("level")).withColumn("free", F.col("ceiling") > F.col("level") * F.col("w"))
    # the first source below its ceiling sets the level of all after it
    common = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything)
    target = F.when(F.coalesce(F.col("ceiling") > common * F.col("w"), F.lit(False)), common * F.col("w")).otherwise(F.col("ceiling").cast("double"))
    out = filled.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _coin(doc_id: Column, source: Column, text: Column) -> Column:
    """A number in [0, 1) with 52 random bits that only depends on the row."""
    key = F.concat(F.lit(f"{SEED}|"), F.coalesce(doc_id.cast("string"), F.concat(F.coalesce(source, F.lit("")), F.lit("|"), text)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _copies(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, the sizes and targets, and ``copies``: how often the mix takes the row."""
    rates = stage_table(source_rates(docs), "mix-rates").withColumnRenamed("source", "__source")
    rows = docs.select(*keep, F.col("source").alias("__of"), size_of(whole_text()).alias("size"), _coin(F.col("doc_id"), F.col("source"), whole_text()).alias("__u"))
    rows = rows.join(rates, F.col("__of").eqNullSafe(F.col("__source")), "left")
    whole = F.floor("rate")
    return rows.withColumn("copies", (whole + (F.col("__u") < F.col("rate") - whole).cast("long")).cast("int"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and the number of copies."""
    rows = _copies(docs, F.col("doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, repeats included, with the columns of ``docs``."""
    rows = _copies(docs.select(pack_row(docs), "doc_id", "source", "text"), F.col(ROW))
    return unpack_row(rows.where("copies > 0").select(ROW, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__copy")))


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS ceiling FROM s),
lv AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling::DOUBLE / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY ceiling::DOUBLE / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM r),
c AS (SELECT level FROM lv WHERE ceiling > level * w ORDER BY ceiling::DOUBLE / w, encode(source) NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN coalesce(ceiling > (SELECT level FROM c) * w, false) THEN (SELECT level FROM c) * w ELSE ceiling::DOUBLE END AS target FROM lv),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  size * (floor(rate) + (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, coalesce(d.source, '') || '|' || text)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT)::BIGINT AS taken,
  (floor(rate) + (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, coalesce(d.source, '') || '|' || text)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT)::INT AS copies
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
