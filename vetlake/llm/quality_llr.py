"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Trusted target text and the raw corpus are two multinomials over ``BUCKETS`` hashed word unigrams
and bigrams.  A document's score is the mean over its n-grams of ``ln(p_target / p_raw)``, hence
independent of its length.  The target is smoothed towards the raw corpus with as much weight as it
has counts itself, so a bucket it never saw costs ``ln 2`` and no more.

The target is fitted on every trusted row and the raw counts cover every document.  A fifth of the
trusted rows, by the hash of their id, is kept out of the counts: the threshold is ``THRESHOLD``, or lower
if more than 1 in 200 of those documents would fall below it, less a margin.

Trusted ids meet the texts in one join: a row can only be held out or counted, as the hash of its id
says, so each text that may be counted is shuffled once, whatever the number of ids, and none is for the threshold:
held-out documents are scored where they lie and their scores meet the ids.  Beyond that there is one
count per bucket, at most ``BUCKETS`` rows a task, and the threshold is found by counting written
scores, whatever the size of a source or the length of a text.  Only DataFrame functions are used.

Defined cases.  Null text: no words, score 0, fails the base rule.  Null ``doc_id``: never trusted,
scored like any other.  Repeated rows: each is scored.  Ids labelled both ways are not trusted.  No
trusted row: every score is 0.  Empty tables: empty result.  Further columns, whatever their names,
are ignored by ``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetlake.functions.text import bound, let
from vetlake.session import stage_table

from .common import BLANKS, ROW, WORD, pack_row, unpack_row, whole_text

BUCKETS = 1 << 14
THRESHOLD = -0.015
MARGIN = 0.005
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# One in this many trusted rows is held out; bins a round of the threshold's search.
HELD_OUT = 5
BINS = 1024


def _hashes(text: Column) -> Column:
    """One 64-bit hash per word."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _ngrams(h: Column) -> Column:
    """Buckets of the unigrams and bigrams of an array of word hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.concat(h, bigrams)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def _hashed(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns, the text and its word hashes, the hashes computed once."""
    return docs.select(*keep, whole_text().alias("__text")).select("*", bound(_hashes(F.col("__text"))).alias("__h"))


def _id_hash(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(HELD_OUT))


def trusted_sample(labels: DataFrame) -> DataFrame:
    """Every trusted id with its part: 0 is held out for the threshold, 1 is counted."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select(F.col("doc_id").alias("__id"), (_id_hash(F.col("doc_id")) != 0).cast("int").alias("__part"))


def _held_out(docs: DataFrame, trusted: DataFrame) -> Column:
    """Whether a document's id belongs to the part that is held out; null where no trusted id can equal it."""
    own, other = docs.schema["doc_id"].dataType, trusted.schema["__id"].dataType
    same = F.col("doc_id") if own == other else F.col("doc_id").try_cast(other)
    return F.when(same.isNotNull(), _id_hash(same) == 0)


def fit(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row per bucket: its weight ``ln(p_target / p_raw)``.  ``trusted``: ids with their part."""
    spark = docs.sparkSession
    held = F.coalesce(_held_out(docs, trusted), F.lit(True))
    texts = docs.select("doc_id", "text", held.alias("__held"))
    # held-out documents only add to the raw counts and need no join
    free = texts.where("__held").select("text", F.lit(None).cast("int").alias("__part"))
    met = texts.where("not __held").join(trusted.where("__part = 1").hint("merge"), F.col("doc_id") == F.col("__id"), "left").select("text", "__part")
    part = _hashed(met, F.col("__part")).unionByName(_hashed(free, F.col("__part")))
    grams = part.select("__part", F.explode(_ngrams(F.col("__h"))).alias("g"))
    seen = grams.groupBy(_bucket(F.col("g")).alias("bucket")).agg(F.count("*").alias("raw"), F.count(F.when(F.col("__part") == 1, 1)).alias("target"))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    counts = stage_table(seen.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "quality-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    p_raw = (F.col("raw") + 1) / F.lit(float(total["raw"] + BUCKETS))
    weight = F.log((F.col("target") / F.lit(float(total["target"])) / p_raw + 1) / 2) if total["target"] else F.lit(0.0)
    return counts.select("bucket", weight.alias("weight"))


def _as_array(weights: DataFrame) -> Column:
    """The ``BUCKETS`` weights in order, as a scalar subquery that each task receives once."""
    return weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"])).scalar()


def _score(weights: Column, grams: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(weights, _bucket(g).cast("int")))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def _at_rank(scores: DataFrame, rank: int) -> tuple[float, float]:
    """The score ``s`` at a place of the ascending order (from 0) and the one after it.

    Rounds of counts per bin, at most ``BINS`` rows each, close in on the one value; no task holds the scores.
    """
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    after = high
    while low < high:
        place = F.least(F.floor((F.col("s") - low) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        bins = scores.where(F.col("s").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("b").collect()
        for i, r in enumerate(bins):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high, last = r["low"], r["high"], rank == r["n"] - 1
        after = bins[i + 1]["low"] if last and i + 1 < len(bins) else after if last else high
    same = scores.where(F.col("s") == low).count()
    return low, low if rank + 1 < same else after


def _percentile(scores: DataFrame, share: float) -> float | None:
    """The interpolated percentile of ``s``, as ``F.percentile`` gives it; None without rows."""
    n = scores.count()
    if not n:
        return None
    place = (n - 1) * share
    low, after = _at_rank(scores, int(place))
    return low if place == int(place) else low + (place - int(place)) * (after - low)


def threshold(docs: DataFrame, trusted: DataFrame, weights: DataFrame) -> float:
    """``THRESHOLD``, lowered until at most 1 in 200 held-out trusted documents falls below it."""
    held = docs.select("doc_id", "text").where(_held_out(docs, trusted))
    # short documents are left to the base rule
    grams = _hashed(held, F.col("doc_id")).where(F.size("__h") >= MIN_WORDS).select("doc_id", bound(_ngrams(F.col("__h"))).alias("__g"), _as_array(weights).alias("__w"))
    # scored where they lie: ids and scores meet the trusted ids, not texts
    scores = grams.select("doc_id", bound(_score(F.col("__w"), F.col("__g"))).alias("s"))
    scored = stage_table(scores.join(trusted.where("__part = 0").hint("merge"), F.col("doc_id") == F.col("__id"), "left_semi").select("s"), "quality-held")
    low = _percentile(scored, 0.005)
    return THRESHOLD if low is None else min(THRESHOLD, low - MARGIN)


def _repeated_words(h: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = F.greatest(F.size(h) - 2, F.lit(0))
    windows = F.transform(F.slice(h, 1, n), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))

    def count(s: Column) -> Column:
        same = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"]))
        return let(F.sort_array(F.filter(same, lambda p: p.isNotNull())), covered)

    def covered(p: Column) -> Column:
        m = F.greatest(F.size(p) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(p, 1, m), F.slice(p, 2, m), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)

    def repeats(w: Column) -> Column:
        # most texts repeat no window and need no sort
        places = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(places, count))

    return let(windows, repeats).cast("long")


def _duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def repeats(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    def count(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.trim(x, F.lit(BLANKS)) != "")
        return F.when(repeats(lines) == 0, 0).otherwise(let(worded, repeats))

    return let(F.split(text, "\n"), count).cast("long")


def _measured(docs: DataFrame, weights: DataFrame, cut: float, *keep: Column) -> DataFrame:
    t = F.col("__text")
    hashed = _hashed(docs, *keep)
    rows = hashed.select(
        "*",
        F.size("__h").cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(_repeated_words(F.col("__h"))).alias("n_repeat_words"),
    )
    rows = rows.select("*", bound(_ngrams(F.col("__h"))).alias("__g"), _as_array(weights).alias("__w"))
    rows = rows.select("*", _duplicate_lines(t).alias("n_dup_lines"), _score(F.col("__w"), F.col("__g")).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"))
    return rows.select("*", (~F.col("base_failed") & (F.col("score") >= F.lit(cut))).alias("kept"))


def _model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    trusted = stage_table(trusted_sample(labels), "quality-trusted")
    weights = stage_table(fit(docs, trusted), "quality-weights")
    return weights, threshold(docs, trusted, weights)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: base counts, the ratio ``score``, ``base_failed`` and ``kept``."""
    weights, cut = _model(docs, labels)
    rows = _measured(docs, weights, cut, F.col("doc_id"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with exactly their columns."""
    weights, cut = _model(docs, labels)
    rows = docs.select(pack_row(docs), "doc_id", "text")
    return unpack_row(_measured(rows, weights, cut, F.col(ROW)).where("kept"))
