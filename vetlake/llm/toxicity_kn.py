"""Toxicity by class-conditional Kneser-Ney models.

Words are lower-cased runs without white space, spelled between a start and an end mark.  Two models give
the next character from up to ``ORDER - 1`` characters before it in its word, one learned from toxic and
one from ordinary training documents.  Few words of a toxic document are toxic, so its words come from the
toxic model with probability ``SHARE`` and from the ordinary one otherwise: a word counts
``ln(1 - SHARE + SHARE * p_toxic / p_ordinary)``, little if it is merely rare among toxic documents (another
language, another topic).  A document's ratio is the mean over its words and does not depend on length.

*Shared backoff.*  Both classes discount their counts by ``CLASS_DISCOUNT`` (so that what a few documents of a
class happen to contain is not evidence) and give what that frees to one pooled interpolated Kneser-Ney
model of the same order (raw counts at the top, numbers of different left neighbours below, ``DISCOUNT``).  A spelling that one class has hardly seen thus costs no more than the two classes'
backoff weights tell.  After a context that a class never saw, its model is the pooled one.

*Training.*  Every labelled row outside the held-out fold is counted.  Rows that a bitmap of fixed size shows
to be unlabelled stay out of the join with the labels, which therefore moves hardly any other text.  Word and n-gram counts are tables that
grow with the input and are combined before each shuffle.  The pooled model is a chain of joins over
n-gram types, one per order.

*Scoring.*  For a seen n-gram the ratio is a number; for an unseen one the pooled probability cancels and
the ratio only depends on its context.  If these numbers are at most ``MODEL_ROWS`` (12 bytes each) they are
sent to the tasks, which score each text where it is read.  A larger model stays a table: the
words of the texts are joined with it.  Both ways give the same ratios.

*Decision.*  Where training rows are split best (rate of false alarms, at twice the cost, plus rate of misses), the score is 0.5; it is a
logistic function of the ratio around that point.

Defined cases.  Null or empty text: ratio 0, an ordinary document's score.  Null ``doc_id``: scored, never a
training row, not held out.  Repeated rows: each is scored, and counted in training.  An id labelled both
ways is toxic.  No training rows of a class: the ratio is 0 everywhere or the default split holds.  Empty
table: empty result.  Other columns are not inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetlake.session import stage_table

from .common import whole_text

ORDER = 5
DISCOUNT = 0.75
CLASS_DISCOUNT = 3.0
SHARE = 0.02
MODEL_ROWS = 1 << 22
FOLDS = 5
FILTER_BITS = 1 << 23
FALSE_ALARM_COST = 2
DEFAULT_SPLIT, DEFAULT_SCALE = 0.01, 0.005
START, END = "\x02", "\x03"
_CACHE_WORDS = 600_000
_STEP_TEXTS, _STEP_WORDS = 500, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _label(labels: DataFrame) -> DataFrame:
    """One row per labelled training id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))


def _likely_labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows whose id may be in ``marks``, so that the join shuffles few other texts.

    A bitmap of ``FILTER_BITS`` bits, whatever the number of ids: one bit per id hash, built by a
    grouped OR of at most ``FILTER_BITS / 64`` rows.  A full bitmap lets every row through.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    cells = marks.select(bit(F.col("__id").cast("string")).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in cells.collect():
        bitmap[r["w"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy().astype(np.uint64)
            hit = sent.value[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"), bit(F.col("doc_id").cast("string")).alias("b"))
    return rows.mapInArrow(keep, T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())]))


def count_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``word, t, o``: how often toxic and ordinary training documents have a word."""
    marks = stage_table(_label(labels), "kn-labels")
    rows = _likely_labelled(docs, marks).join(marks, F.col("doc_id") == F.col("__id")).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic == 1].update(words_of(text.as_py()))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "t", "o"])

    return rows.mapInArrow(count, "word string, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _grams(word: Column, order: int) -> Column:
    """The n-gram that ends at each character of a word after the start mark."""
    spelled = F.concat(F.lit(START), word, F.lit(END))
    return F.transform(F.sequence(F.lit(2), F.length(spelled)), lambda i: F.substring(spelled, F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, context, ratio``: of n-grams seen in training and, for unseen ones, of their contexts."""
    words = stage_table(count_words(docs, labels), "kn-words")
    grams = words.select(F.explode(_grams(F.col("word"), order)).alias("g"), "t", "o").groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    grams = stage_table(grams, "kn-grams")
    size, d = F.length("g"), F.lit(DISCOUNT)
    # lower orders: numbers of different characters to the left
    ends = grams.select(F.explode(F.sequence(F.lit(1), F.least(size - 1, F.lit(order - 1)))).alias("n"), "g")
    pairs = ends.select(F.expr("right(g, n)").alias("g"), F.expr("right(g, n + 1)").alias("longer")).distinct()
    lower = pairs.groupBy("g").agg(F.count("*").alias("c"))
    counts = stage_table(grams.select("g", (F.col("t") + F.col("o")).alias("c")).unionByName(lower), "kn-counts").withColumn("h", F.expr("left(g, length(g) - 1)"))
    contexts = stage_table(counts.groupBy("h").agg(F.sum("c").alias("total"), F.count("*").alias("types")), "kn-contexts")
    letters = counts.where(size == 1).count() + 1
    pooled = None
    for n in range(1, order + 1):
        here = counts.where(size == n).join(contexts, "h")
        if pooled is None:
            less = F.lit(1.0 / letters)
        else:
            here = here.join(pooled.withColumnRenamed("g", "s").withColumnRenamed("p", "less"), F.expr("right(g, length(g) - 1)") == F.col("s"))
            less = F.col("less")
        p = (F.greatest(F.col("c") - d, F.lit(0.0)) + d * F.col("types") * less) / F.col("total")
        pooled = stage_table(here.select("g", p.alias("p")), "kn-pooled")
        top = pooled if n == 1 else top.unionByName(pooled)
    mine = grams.withColumn("h", F.expr("left(g, length(g) - 1)"))
    sums = mine.groupBy("h").agg(*[f(c).alias(f"{k}{c}") for c in "to" for k, f in (("all_", F.sum), ("off_", lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(CLASS_DISCOUNT)))))])
    sums = stage_table(sums, "kn-class-contexts")

    def share(c: str) -> Column:
        """What a class hands to the pooled model after a context."""
        return F.when(F.col(f"all_{c}") > 0, F.col(f"off_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    def p_class(c: str) -> Column:
        own = F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - F.lit(CLASS_DISCOUNT), F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0)
        return own + share(c) * F.col("p")

    seen = mine.join(sums, "h").join(top, "g").select(F.col("g").alias("gram"), F.lit(False).alias("context"), F.log(p_class("t") / p_class("o")).alias("ratio"))
    unseen = sums.select(F.col("h").alias("gram"), F.lit(True), F.log(share("t") / share("o")))
    return stage_table(seen.union(unseen), "kn-model")


def _window_hashes(chars: np.ndarray, start: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the context and of the n-gram at each position; ``start`` is where the word of a position begins."""
    with np.errstate(over="ignore"):
        at = np.arange(len(chars))
        context = np.zeros(len(chars), np.uint64)
        for back in range(order - 1, 0, -1):
            inside = at - back >= start
            context = np.where(inside, context * _BASE + chars[np.maximum(at - back, 0)] + np.uint64(1), context)
        gram = context * _BASE + chars + np.uint64(1)
        return (context ^ (context >> np.uint64(31))) * _BASE + np.uint64(7), (gram ^ (gram >> np.uint64(31))) * _BASE


def _codes(spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings in a row, and their lengths."""
    return np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, spelled), np.int64, len(spelled))


class RatioTable:
    """The model as sorted hashes; scores words."""

    def __init__(self, grams: list[str], context: np.ndarray, ratio: np.ndarray, order: int):
        self.order = order
        keys = np.zeros(len(grams), np.uint64)
        for flag in (False, True):
            which = np.flatnonzero(context == flag)
            if not len(which):
                continue
            # a context is hashed as the characters before one more
            chars, size = _codes([grams[i] + ("x" if flag else "") for i in which])
            last = np.cumsum(size) - 1
            hashes = _window_hashes(chars, np.repeat(last + 1 - size, size), order)
            keys[which] = hashes[0 if flag else 1][last]
        by = np.argsort(keys)
        self.keys, self.ratio = keys[by], np.asarray(ratio, np.float64)[by]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.ratio[at]

    def score(self, words: list[str]) -> np.ndarray:
        if not len(self.keys) or not words:
            return np.zeros(len(words))
        chars, size = _codes([START + w + END for w in words])
        begin = np.cumsum(size) - size
        context, gram = _window_hashes(chars, np.repeat(begin, size), self.order)
        known, value = self._find(gram)
        rest = np.flatnonzero(~known)
        backed, back = self._find(context[rest])
        value[rest] = np.where(backed, back, 0.0)
        value[begin] = 0.0  # the start mark is given
        return np.log1p(SHARE * np.expm1(np.minimum(np.add.reduceat(value, begin), 50.0)))


_SCORES: dict[int, dict[str, float]] = {}


def _known_scores(model: int) -> dict[str, float]:
    """Word scores this worker process remembers for a model; those of other models go."""
    if model not in _SCORES:
        _SCORES.clear()
        _SCORES[model] = {}
    return _SCORES[model]


def _ratios_in_tasks(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    table = model.toArrow()
    index = RatioTable(table.column("gram").to_pylist(), table.column("context").to_numpy(), table.column("ratio").to_numpy(), order)
    sent, name = docs.sparkSession.sparkContext.broadcast(index), int.from_bytes(np.random.default_rng().bytes(8), "big")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.toxicity_kn import _known_scores

        index, known = sent.value, _known_scores(name)

        def means(texts: list[list[str]]) -> list[float]:
            new = list(set().union(*texts) - known.keys())
            if len(known) + len(new) > _CACHE_WORDS:
                known.clear()
                new = list(set().union(*texts))
            known.update(zip(new, index.score(new).tolist()))
            return [sum(map(known.__getitem__, words)) / len(words) if words else 0.0 for words in texts]

        for batch in batches:
            out: list[float] = []
            step: list[list[str]] = []
            for text in batch.column("text"):
                step.append(words_of(text.as_py()))
                if len(step) >= _STEP_TEXTS or len(step[-1]) >= _STEP_WORDS:
                    out += means(step)
                    step = []
            out += means(step)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "ratio"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ratio", T.DoubleType())])
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(score, schema)


def _ratios_by_join(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same ratios with the model as a table: words meet it by n-gram, texts their words."""
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("k1"), F.xxhash64(F.lit(1), whole_text()).alias("k2"), whole_text().alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k1, k2, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for word, n in Counter(words_of(text)).items():
                    for column, value in zip(out, (k1, k2, word, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["k1", "k2", "word", "n"])

    uses = stage_table(keyed.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text").mapInArrow(split, "k1 long, k2 long, word string, n long"), "kn-uses")
    grams = uses.select("word").distinct().select("word", F.explode(_grams(F.col("word"), order)).alias("g"))
    grams = grams.join(model.where("not context").select(F.col("gram").alias("g"), F.col("ratio").alias("own")), "g", "left").withColumn("h", F.expr("left(g, length(g) - 1)"))
    grams = grams.join(model.where("context").select(F.col("gram").alias("h"), F.col("ratio").alias("back")), "h", "left")
    words = grams.groupBy("word").agg(F.sum(F.coalesce("own", "back", F.lit(0.0))).alias("s"))
    words = words.select("word", F.log1p(SHARE * F.expm1(F.least("s", F.lit(50.0)))).alias("s"))
    texts = uses.join(words, "word").groupBy("k1", "k2").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("ratio"))
    return keyed.select("doc_id", "k1", "k2").join(texts, ["k1", "k2"], "left").select("doc_id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def ratios(docs: DataFrame, model: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc_id, ratio`` of every row of ``docs``."""
    return (_ratios_in_tasks if model.count() <= model_rows else _ratios_by_join)(docs, model, order)


def split_point(scored: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Where training rows are split with the fewest false alarms and misses (as rates), and the scale around it."""
    rows = scored.join(_label(labels), F.col("doc_id") == F.col("__id"))
    q = [k / 1000 for k in range(1001)]
    found = {r["toxic"]: r["q"] for r in rows.groupBy("toxic").agg(F.percentile_approx("ratio", q, 100_000).alias("q")).collect()}  # two rows
    clean, toxic = np.array(found.get(0) or []), np.array(found.get(1) or [])
    if not len(clean) or not len(toxic):
        return DEFAULT_SPLIT, DEFAULT_SCALE
    points = np.unique(np.concatenate([clean, toxic]))
    middles = (points[1:] + points[:-1]) / 2 if len(points) > 1 else points
    loss = FALSE_ALARM_COST * (clean[:, None] > middles).mean(axis=0) + (toxic[:, None] <= middles).mean(axis=0)
    best = middles[loss <= loss.min() + 1e-12]
    split = float((best[0] + best[-1]) / 2)
    return split, max(1e-6, float(np.median(toxic) - split) / 4)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, ratio``."""
    scored = stage_table(ratios(docs, train(docs, labels)), "kn-ratios")
    split, scale = split_point(scored, labels)
    score = 1 / (1 + F.exp(-(F.col("ratio") - F.lit(split)) / F.lit(scale)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "ratio")
