"""Importance resampling towards a target distribution over hashed n-gram features.

A feature is a run of consecutive words; its bucket is a hash of its bytes.  One pass over the raw corpus
and one over the target texts count the buckets (each task sends at most one row per bucket).  The log
ratio of a bucket's smoothed shares is its gain, a whole number, so the gains are one array of
``buckets`` numbers, which is all that the driver holds.  A second pass adds up the gains over each
document's features and draws a Gumbel variate from a hash of the id: the documents with the highest sums
are a sample without replacement in proportion to the ratio of target and raw probability.

Nothing is sorted to find them.  Scores are written once; exact counts of the written rows bisect the
score range (``SECTIONS`` thresholds a job, as many halvings at once) until one score is the cutoff, and
then, among the rows tied there, the id range.  The drawn rows alone are range-partitioned by score and
id; a rank is the row's place in its partition plus the rows of the partitions before.

Defined cases.  Null or empty text: no features, weight 0, never drawn.  Null ``doc_id``: hashed like an
empty id; after all others among ties (with the largest possible id).  Repeated rows: each has its own
rank if drawn; equal rows are interchangeable, and where the cutoff falls among them the right number is
drawn.  Very long texts: whole, in memory in proportion.  Empty tables: no rows, or gains from the
smoothing alone.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetlake.session import stage_table

from .common import whole_text

BUCKETS = 10_000
GRAMS = (1, 1)
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
SECTIONS = 15  # thresholds a job: four halvings
MEMO = 500_000  # features a worker remembers
_NO_ID = (1 << 63) - 1

# small letters, digits and all bytes beyond ASCII are word bytes; A-Z become small, the rest ends a word
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Buckets(dict):
    """feature (bytes) -> bucket, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        got = zlib.crc32(feature) % self.buckets
        if len(self) < MEMO:
            self[feature] = got
        return got


def features(text: str, grams: tuple[int, int] = GRAMS) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of ``grams[0]`` to ``grams[1]`` words."""
    words = text.encode().translate(_FOLD).split()
    if grams == (1, 1):
        return len(words), words
    return len(words), [b" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]


def _bucketed(text: str, memo: Buckets, grams: tuple[int, int]) -> tuple[int, np.ndarray]:
    n, found = features(text, grams)
    return n, np.fromiter(map(memo.__getitem__, found), np.int64, len(found))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: tuple[int, int] = GRAMS) -> np.ndarray:
    """Features of all texts by bucket; every task sends its non-empty buckets once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.target_resample import Buckets, _bucketed

        memo, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(_bucketed(x.as_py(), memo, grams)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(whole_text().alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` by bucket, in doubles."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + b) / ((float(s) + 1) * (float(t_all) + b)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: tuple[int, int] = GRAMS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` per document."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.target_resample import Buckets, _bucketed

        memo = Buckets(len(gain))
        for batch in batches:
            out = []
            for x in batch.column("text"):
                n, at = _bucketed(x.as_py(), memo, grams)
                out.append((n, len(at), int(gain[at].sum())))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel variate from the hash of an id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _bisect(rows: DataFrame, column: str, need: int, low: int, high: int, upward: bool) -> int:
    """The value c in [low, high] nearest to the wanted end with at least ``need`` rows on its side.

    ``upward``: the largest c with ``need`` rows >= c; else the smallest c with ``need`` rows <= c.
    Each job counts all rows against ``SECTIONS`` thresholds.
    """
    while low < high:
        cuts = sorted({low + (high - low) * k // (SECTIONS + 1) for k in range(1, SECTIONS + 1)} | {(low + high) // 2})
        cuts = [c + 1 for c in cuts] if upward else cuts  # every threshold makes the range smaller
        side = (lambda c: F.col(column) >= c) if upward else (lambda c: F.col(column) <= c)
        counts = rows.agg(*[F.count(F.when(side(F.lit(c).cast("long")), 1)).alias(f"n{k}") for k, c in enumerate(cuts)]).first()
        enough = [counts[f"n{k}"] >= need for k in range(len(cuts))]
        if upward:
            low, high = max([low, *[c for c, e in zip(cuts, enough) if e]]), min([high, *[c - 1 for c, e in zip(cuts, enough) if not e]])
        else:
            low, high = max([low, *[c + 1 for c, e in zip(cuts, enough) if not e]]), min([high, *[c for c, e in zip(cuts, enough) if e]])
    return low


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Drawn and other rows of ``scored`` (staged; ``doc_id, n_words, n_features, weight, score``)."""
    rows = scored.withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID)))
    fits = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    able = rows.where(fits)
    seen = able.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    need = percent * seen["n"] // 100
    if not need:
        return rows.where(F.lit(False)), rows
    cut = _bisect(able, "score", need, seen["low"], seen["high"], True)
    tied = able.where(F.col("score") == F.lit(cut).cast("long"))
    above, ids = able.where(F.col("score") > F.lit(cut).cast("long")).count(), tied.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    need -= above
    key = _bisect(tied, "key", need, ids["low"], ids["high"], False) if need < ids["n"] else ids["high"]
    at_key = F.col("key") == F.lit(key).cast("long")
    before = fits & ((F.col("score") > F.lit(cut).cast("long")) | (F.col("score") == F.lit(cut).cast("long")) & (F.col("key") < F.lit(key).cast("long")))
    at = fits & (F.col("score") == F.lit(cut).cast("long")) & at_key
    need -= tied.where(F.col("key") < F.lit(key).cast("long")).count()
    if need >= tied.where(at_key).count():
        return rows.where(before | at), rows.where(~(before | at))
    # the cutoff falls among rows of one score and id: equal rows are counted, and so many of each are drawn
    kinds = rows.where(at).groupBy(*rows.columns).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("n_features", "n_words"))
    kinds = kinds.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("n", F.lit(need).cast("long") - (upto - F.col("n")))))
    copies = lambda n: kinds.where(n > 0).select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("col")
    return rows.where(before).unionByName(copies(F.col("taken"))), rows.where(~(before | at)).unionByName(copies(F.col("n") - F.col("taken")))


def ranked(drawn: DataFrame) -> DataFrame:
    """``drawn`` with ``rank``: 1, 2, 3 ... by falling score and rising id."""
    # equal rows are told apart by where they were read, so that many of them are not one range
    sorted_ = drawn.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(F.desc("score"), F.asc("key"), F.asc("place")).sortWithinPartitions(F.desc("score"), "key", "place")
    numbered = stage_table(sorted_.withColumn("at", F.monotonically_increasing_id()), "resample-drawn")
    part = F.shiftright("at", 33).alias("part")
    sizes = numbered.groupBy(part).agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", rank)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: tuple[int, int] = GRAMS, seed: str = SEED
) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank`` (null: not drawn)."""
    gain = gains(bucket_counts(docs, buckets, grams), bucket_counts(target, buckets, grams))
    scored = stage_table(weights(docs, gain, grams).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    drawn, rest = draw(scored, percent, least_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked(drawn).select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


# crc32 in SQL, one byte at a time without a table: eight halvings of the low byte
def _crc_sql(word: str) -> str:
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    of_byte = f"list_reduce(list_prepend(xor(a, b) & 255, range(8)), {step})"
    bytes_ = f"list_transform(range(CAST(octet_length(encode({word})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({word})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: xor({of_byte}, a >> 8)), 4294967295)"


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HASH_SQL = f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)"
RESAMPLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS words FROM documents),
w AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
f AS (SELECT w, CAST({_crc_sql('w')} % {BUCKETS} AS BIGINT) AS bucket FROM (SELECT w FROM w UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS n FROM w JOIN f USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN f USING (w) GROUP BY bucket),
g AS (SELECT b AS bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM w) + {BUCKETS}.0::DOUBLE) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM bw) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN f USING (w) JOIN g USING (bucket) GROUP BY r),
y AS (SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_HASH_SQL} + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM y WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank FROM y LEFT JOIN z USING (r)
"""
