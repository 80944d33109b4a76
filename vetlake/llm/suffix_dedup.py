"""Repeated passages by a Burrows-Wheeler transform and threshold-bounded interval expansion.

Every byte covered by a ``WIDTH``-byte string that also starts elsewhere is removed, in all places.

*Meeting places.*  A window of ``WIDTH`` bytes is assigned to its anchor, the smallest hash of a
``GRAM``-byte string inside it: equal windows have equal anchors.  Consecutive windows with one anchor are a
segment (their bytes overlap the neighbours' by ``WIDTH - 1``).  Only the hashes of segments are dealt by
anchor; an anchor that occurs once, and once in its segment, cannot hold a repeat and ends there.  Equal segments are one from here on,
with the number of their places as weight.  The bytes of one copy of each are then fetched.

*Search.*  A task takes the segments of many anchors in blocks of at most ``BLOCK`` bytes, sorts the block's suffixes
to a depth over ``WIDTH``, and finds the common prefix lengths of neighbours by increasing value: from the
intervals of as many bytes as the first sort key holds, breadth first, each interval is extended backwards by every character of the
transform in it, and an extended interval is followed only if the place after its end is still open, whose
value is then the length at hand.  The expansion stops at ``WIDTH``: places still open separate suffixes
that share ``WIDTH`` bytes or more.  A window whose class has weight 2 or more is repeated.

An anchor with more than ``BLOCK`` bytes of different segments (a passage in very many contexts) is dealt
again window by window, by the hash of the whole window, through the same search.  Equal windows are summed to
one row before they are dealt, and the repeated ones are joined back to the segments that hold them, so no task
holds more than a block and the list of a window's places is never gathered.

*Copies.*  A task cuts a text at most twice (twice says that it is repeated; ``SEEN`` texts are remembered, and a
forgotten one is cut again), and bytes are cut out of one copy a task, so a text that is a third of all rows costs
two rows a segment and task.

*Cutting.*  Repeated windows go back to the places of their segment, and the spans of a text to the text.
Texts are known by 128 hash bits, so copies share one set of spans and null or repeated ids do no harm.

Defined cases.  Null text: empty.  Texts under ``WIDTH`` bytes: never cut.  Null ``doc_id``: treated
like any.  Repeated rows: copies of each other.  Empty table: empty result.  ``cut_documents`` keeps all
columns whatever their names; a character of which a byte stays is kept whole there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetlake.session import stage_table

from .common import ROW, pack_row, unpack_row, whole_text

WIDTH = 200
GRAM = 48
LONGEST_RUN = 512
BLOCK = 2 << 20
PLACES_OUT = 1 << 16
TEXTS_OUT = 500
SEEN = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_GAP = 0xFF  # never a byte of UTF-8


def _gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width``-byte string, by doubling; ``width`` is at most 255."""
    with np.errstate(over="ignore"):
        h, size, power = b.astype(np.uint64) + np.uint64(1), 1, _BASE
        done, out, place = 0, None, None
        while True:
            if width & size:
                if out is None:
                    out, done = h, size
                else:
                    # what is there so far comes first; its length is done
                    n = len(h) - done
                    out = out[:n] * power + h[done:] if n > 0 else out[:0]
                    done += size
            if size * 2 > width:
                break
            h = h[: len(h) - size] * power + h[size:] if len(h) > size else h[:0]
            power = power * power
            size *= 2
        out = out[: max(0, len(b) - width + 1)]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring values."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _window_maxima(m: np.ndarray, width: int) -> np.ndarray:
    """The maximum of the up to ``width`` values that end at each place, and of the last ones on their own."""
    pad = np.zeros(width - 1, np.uint64)
    return ~_window_minima(~np.concatenate([pad, m, pad]), width)


def segments(b: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of a text, and whether it holds its anchor twice.

    Only a segment that does (in periodic text) can repeat one of its own windows.
    """
    if len(b) < width:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    h = _gram_hashes(b, gram)
    m = _window_minima(h, width - gram + 1)
    start = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    count = np.diff(np.append(start, len(m)))
    chosen = h[h == _window_maxima(m, width - gram + 1)]  # hashes that are the minimum of some window, in order of place
    twins = chosen[1:][chosen[1:] == chosen[:-1]]
    if count.max() > LONGEST_RUN:  # periodic text
        parts = -(-count // LONGEST_RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        base, left = np.repeat(start, parts), np.repeat(count, parts)
        start, count = base + k * LONGEST_RUN, np.minimum(left - k * LONGEST_RUN, LONGEST_RUN)
    anchor = m[start]
    return anchor, start, count, np.isin(anchor, twins) if len(twins) else np.zeros(len(anchor), bool)


def _sort_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``key`` (of at most ``bits`` bits) in ascending order, and the places where its values stood."""
    n = len(key)
    low = max(1, (n - 1).bit_length())
    if bits + low > 63:
        places = np.argsort(key)
        return key[places], places.astype(np.int32)
    # values are sorted with their place behind them, which takes a fifth of the time of sorting places by value
    key <<= low
    key |= np.arange(n, dtype=np.int32)
    key.sort()
    places = (key & ((1 << low) - 1)).astype(np.int32)
    key >>= low
    return key, places


def _sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Order of the rotations of ``text`` by their first ``depth`` bytes or more, and its inverse.

    Also the places in the order where the first ``lead`` bytes change, those where the first ``lead - 1`` do, and ``lead``
    (less than ``depth``).  Each doubling sorts only what is still tied.
    """
    n = len(text)  # a block: 32 bits hold a place, and 64 a pair of ranks
    used = np.bincount(text, minlength=256) > 0
    letter = max(1, int(used.sum() - 1).bit_length())
    size = lead = max(1, min((63 - (n - 1).bit_length()) // letter, depth - 1))
    code = (np.cumsum(used) - 1).astype(np.uint8)[text]
    code = np.concatenate([code, np.resize(code, lead - 1)])
    key = np.zeros(n, np.int64)
    for k in range(lead):
        key <<= letter
        key |= code[k : k + n]
    del code
    key, order = _sort_places(key, lead * letter)
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[1:] != key[:-1]
    key >>= letter
    change = np.flatnonzero(new).astype(np.int32)
    early = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1).astype(np.int32)
    del key
    rank = np.empty(n, np.int32)  # the place where those like it begin
    rank[order] = np.repeat(change, np.diff(np.append(change, n)))
    bits = max(1, (n - 1).bit_length())
    tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    del new
    while size < depth and len(tied):
        some = order[tied]
        key = rank[some].astype(np.int64)
        key <<= bits
        after = some + np.int32(size % n)
        after %= np.int32(n)
        key |= rank[after]
        del after
        key, by = _sort_places(key, 2 * bits)
        some = some[by]
        del by
        order[tied] = some
        new = np.empty(len(tied), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        del key
        begin = np.flatnonzero(new).astype(np.int32)
        rank[some] = np.repeat(tied[begin], np.diff(np.append(begin, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        size *= 2
    del rank
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    return order, inverse, change, early, lead


def repeat_classes(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` and, for each place in it, whether it opens a new class.

    Neighbours of one class share ``width`` bytes or more.
    """
    n = len(text)
    order, inverse, change, early, lead = _sorted_suffixes(text, width + 1)
    back = inverse[order - 1]  # where the suffix one byte longer stands; before the first place stands the last
    del inverse
    first = text[order]
    opens = np.zeros(n + 1, bool)
    # the intervals of ``lead`` bytes are known from the sort: those whose end is not open a byte earlier are followed
    opens[early] = opens[n] = True
    low, high = change, np.append(change[1:], n) - 1
    new = ~opens[high + 1]
    low, high = low[new], high[new]
    opens[change] = True
    del change, early
    owner = np.zeros(n, np.int32)
    for _ in range(width - lead):
        size = high - low + 1
        total = int(size.sum())
        if not total:
            break
        rows = np.repeat((low - np.cumsum(size) + size).astype(np.int32), size)
        rows += np.arange(total, dtype=np.int32)
        to = back[rows]
        del rows
        owner[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        if total > n >> 4:
            mark = np.zeros(n, bool)
            mark[to] = True
            to = np.flatnonzero(mark).astype(np.int32)
        else:
            to = np.sort(to)
        # a run of neighbours with one first byte and one owner is one extended interval
        cut = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]])
        ends = np.append(np.flatnonzero(cut), total - 1)
        high = to[ends]
        low = to[np.concatenate(([0], ends[:-1] + 1))]
        new = ~opens[high + 1]
        low, high = low[new], high[new]
        opens[high + 1] = True
    return order, opens[:n]


def repeated_windows(parts: list[bytes], weights: list[int], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: index of the part, first and last start within it."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    order, opens = repeat_classes(text, width)
    windows = np.maximum(sizes - width, 0)  # starts of windows that end within their part
    weight = np.zeros(len(text) + 1, np.int8)  # of the one part that a place is in
    w = np.minimum(np.asarray(weights, np.int64), 2).astype(np.int8)
    np.add.at(weight, begin, np.where(windows > 0, w, 0))
    np.add.at(weight, begin + windows, np.where(windows > 0, -w, 0))
    weight = np.cumsum(weight[:-1], dtype=np.int8)
    twice = np.add.reduceat(weight[order], np.flatnonzero(opens), dtype=np.int64) >= 2
    hit = np.zeros(len(text) + 1, bool)
    hit[order] = twice[np.cumsum(opens, dtype=np.int32) - 1]
    hit[:-1] &= weight > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    part = np.searchsorted(begin, starts, side="right") - 1
    return part, starts - begin[part], stops - 1 - begin[part]


_PLACE = "anchor long, seg long, k1 long, k2 long, at long, windows int, twin boolean"


def _places(docs: DataFrame) -> DataFrame:
    """One row per segment place: its anchor and hash, the text it is in, its first window and their number.

    A text with copies in its task is cut twice there, which is enough to call all of it repeated.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen: dict[tuple[int, int], int] = {}
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        held = 0

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor", "seg", "k1", "k2", "at", "windows", "twin"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                times = seen.get((k1, k2), 0)
                if times == 2:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[k1, k2] = times + 1
                raw = text.as_py().encode()
                anchor, start, count, twin = segments(np.frombuffer(raw, np.uint8))
                if not len(start):
                    continue
                seg = [xxh3_64_intdigest(raw[a : a + n + WIDTH - 1]) for a, n in zip(start.tolist(), count.tolist())]
                row = (anchor.view(np.int64), np.array(seg, np.uint64).view(np.int64), np.full(len(seg), k1), np.full(len(seg), k2), start, count.astype(np.int32), twin)
                for column, values in zip(out, row):
                    column.append(values)
                held += len(seg)
                if held >= PLACES_OUT:
                    yield emit()
                    held = 0
        if held:
            yield emit()

    return docs.select("k1", "k2", "text").mapInArrow(cut, _PLACE)


def _shared(places: DataFrame) -> DataFrame:
    """Places whose anchor occurs more than once; ``weight`` is 1 or 2 at the first place of a segment, else 0.

    A task reads its places in order of anchor and segment and holds one batch: a row passes if a
    neighbour has its anchor.  Places of copies of one text are one row.
    """
    dealt = places.repartition("anchor").sortWithinPartitions("anchor", "seg", "k1", "k2", "at")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(c: dict[str, np.ndarray], before: dict | None, after: dict | None) -> pa.RecordBatch:
            wide = {k: np.concatenate([before[k][-1:] if before else v[:0], v, after[k][:1] if after else v[:0]]) for k, v in c.items()}
            same_anchor = wide["anchor"][1:] == wide["anchor"][:-1]
            same_seg = same_anchor & (wide["seg"][1:] == wide["seg"][:-1])
            same_place = same_seg & (wide["k1"][1:] == wide["k1"][:-1]) & (wide["k2"][1:] == wide["k2"][:-1]) & (wide["at"][1:] == wide["at"][:-1])
            n = len(c["anchor"])
            up = lambda x: x[:n] if before else np.append(False, x)[:n]  # noqa: E731  like the row above
            down = lambda x: x[-n:] if after else np.append(x, False)[-n:]  # noqa: E731  like the row below
            take = (up(same_anchor) | down(same_anchor) | c["twin"]) & ~up(same_place)
            weight = np.where(up(same_seg), 0, np.where(down(same_seg), 2, 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([*[pa.array(v[take]) for v in c.values()], pa.array(weight[take])], names=[*c, "weight"])

        before, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            after = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            if now is not None:
                yield judged(now, before, after)
            before, now = now, after
        if now is not None:
            yield judged(now, before, None)

    return dealt.mapInArrow(keep, _PLACE + ", weight int")


def _fetched(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The bytes of each shared segment, from one copy of its text: ``anchor, seg, weight, part``.

    A task remembers ``SEEN`` texts; copies in other tasks, or forgotten ones, give equal parts, which the search drops.
    """
    wanted = shared.where("weight > 0").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "at", "windows", "weight")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        out: list[list] = [[], [], [], []]
        held = 0

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["anchor", "seg", "weight", "part"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for k1, k2, text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (k1, k2) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((k1, k2))
                raw = text.as_py().encode()
                for x in wants.as_py():
                    for column, v in zip(out, (x["anchor"], x["seg"], x["weight"], raw[x["at"] : x["at"] + x["windows"] + WIDTH - 1])):
                        column.append(v)
                    held += len(out[3][-1])
                    if held >= BLOCK:
                        yield emit()
                        held = 0
        if out[0]:
            yield emit()

    return docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(cut, "anchor long, seg long, weight int, part binary")


def _searched(parts: DataFrame, limit: int) -> DataFrame:
    """Runs of repeated windows ``anchor, seg, a, b`` of ``parts(key, anchor, seg, weight, part)``.

    Rows of an over-full key have ``a`` null.  Equal parts of a key are one segment with one weight, told again by a copy of its text.
    """
    dealt = parts.repartition("key").sortWithinPartitions("key", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes, int]] = []  # anchor, segment, bytes, weight
        held, key, at, over, size = 0, None, 0, False, 0  # block[at:] is the open key, of size bytes

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "seg", "a", "b"])

        def solved(ready: list) -> list[tuple]:
            part, a, b = repeated_windows([x[2] for x in ready], [x[3] for x in ready])
            return [(*ready[k][:2], i, j) for k, i, j in zip(part.tolist(), a.tolist(), b.tolist())]

        for batch in batches:
            rows: list[tuple] = []
            for key_, anchor, seg, weight, part in zip(*[batch.column(n).to_pylist() for n in ("key", "anchor", "seg", "weight", "part")]):
                if key_ != key:
                    key, at, over, size = key_, len(block), False, 0
                if over:
                    rows.append((anchor, seg, None, None))
                    continue
                if len(block) > at and block[-1][2] == part:
                    continue
                if at and held + len(part) >= BLOCK:  # the open key goes on to the next block
                    rows += solved(block[:at])
                    del block[:at]
                    held, at = size, 0
                block.append((anchor, seg, part, weight))
                held += len(part) + 1
                size += len(part) + 1
                if limit and size > limit:
                    rows += [(*x[:2], None, None) for x in block[at:]]
                    held -= size
                    del block[at:]
                    over = True
            yield emit(rows)
        if block:
            yield emit(solved(block))

    return dealt.mapInArrow(search, "anchor long, seg long, a long, b long")


def _by_window(parts: DataFrame) -> DataFrame:
    """Each window of ``parts`` by itself, keyed by its hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, weight, part in zip(*[batch.column(n).to_pylist() for n in ("anchor", "seg", "weight", "part")]):
                keys = _gram_hashes(np.frombuffer(part, np.uint8), WIDTH).view(np.int64)
                n = len(keys)
                columns = [keys, np.full(n, anchor), np.full(n, seg), np.arange(n), np.full(n, weight, np.int32), [part[i : i + WIDTH] for i in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:5]] + [pa.array(columns[5], pa.binary())], names=["key", "anchor", "seg", "shift", "weight", "part"])

    return parts.mapInArrow(cut, "key long, anchor long, seg long, shift long, weight int, part binary")


def _window_runs(parts: DataFrame) -> DataFrame:
    """Repeated windows ``anchor, seg, a, b`` of over-full anchors.

    The search sees each different window once, with the weight of all its places (2 stands for more); its result,
    hashes alone, finds the places by a join that leaves no row of a window's places waiting for another.
    """
    windows = _by_window(parts)
    name = F.xxhash64("part").alias("seg")
    different = windows.groupBy("key", "part").agg(F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"))
    found = _searched(different.select("key", F.col("key").alias("anchor"), name, "weight", "part"), 0)
    repeated = stage_table(found.select(F.col("anchor").alias("key"), F.col("seg").alias("window")), "repeat-windows")
    places = windows.select("key", F.xxhash64("part").alias("window"), "anchor", "seg", "shift")
    return places.join(repeated, ["key", "window"], "left_semi").select("anchor", "seg", F.col("shift").alias("a"), F.col("shift").alias("b"))


def repeated_spans(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """``k1, k2, spans``: the byte spans to remove from the texts with these hash bits, sorted; they may touch or overlap."""
    keyed = docs.select(*text_key(whole_text()), whole_text().alias("text"))
    shared = stage_table(_shared(_places(keyed)), "repeat-places")
    parts = stage_table(_fetched(keyed, shared), "repeat-parts")
    first = parts.select(F.col("anchor").alias("key"), "anchor", "seg", "weight", "part")
    found = stage_table(_searched(first, limit), "repeat-runs")
    runs = found.where("a is not null")
    over = found.where("a is null").select("anchor", "seg").distinct()
    if not over.isEmpty():
        again = parts.dropDuplicates(["anchor", "seg"]).join(over, ["anchor", "seg"], "left_semi")
        runs = runs.unionByName(stage_table(_window_runs(again), "repeat-window-places"))
    spans = shared.join(runs, ["anchor", "seg"]).select("k1", "k2", F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + WIDTH).alias("b")).alias("s"))
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans if spans is not None else ():
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[0::2], edges[1::2])])


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = docs.select("doc_id", *text_key(whole_text()), whole_text().alias("text")).join(repeated_spans(docs), ["k1", "k2"], "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw, runs = text.as_py().encode(), _merged(spans.as_py())
                for column, v in zip(out, (len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(judge, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields]))


def _cut_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def one(x: str, s: list | None) -> str:
        raw, runs = x.encode(), []
        for a, b in _merged(s):
            # a character stays whole if one of its bytes does
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            if a < b:
                runs.append((a, b))
        return _kept(raw, runs).decode()

    for text, spans in batches:
        for at in range(0, len(text), TEXTS_OUT):  # a batch of texts is not held a second time
            yield pa.array([one(x.as_py(), s.as_py()) for x, s in zip(text[at : at + TEXTS_OUT], spans[at : at + TEXTS_OUT])], pa.string())


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without their repeated passages; ``n_chars``, where there is one, follows the text."""
    rows = docs.select(pack_row(docs), *text_key(whole_text()), whole_text().alias("__text")).join(repeated_spans(docs), ["k1", "k2"], "left")
    cut = F.when(F.col("spans").isNull(), F.col(f"{ROW}.text")).otherwise(F.arrow_udf(_cut_text, T.StringType())("__text", "spans"))
    rows = rows.select(ROW, cut.alias("__cut"))
    new = {"text": F.col("__cut"), "n_chars": F.when(F.col(f"{ROW}.text").isNull(), F.col(f"{ROW}.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("__cut"))}
    fields = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*fields)
