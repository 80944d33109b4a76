"""Line rule scans.

Files are one row each, so everything up to a finding is row-local: a scan adds no
shuffle.  Patterns are unrolled to literals (compiled once per task, inside codegen);
a join of lines with a pattern table would be a nested loop.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import any_prompt_override, has_hidden_chars
from ..functions.literals import guarded_match, line_searches, word_search
from ..functions.paths import base_name, is_excluded_file, is_low_signal_path, is_manifest
from ..functions.text import (
    PROMPT_OVERRIDE, all_of, any_of, byte_entropy, code_snippet, contains_any, has_any, hit_islands, hit_lines, is_code_line,
    jrx, let, matches, matches_any, ws_trim,
)
from . import packs as P
from .rules import Rule


def analysis_text(df: DataFrame) -> Column:
    """Raw + decoded text when the decoder has run, else the raw content."""
    return F.coalesce(F.col("analysis_content"), F.col("content")) if "analysis_content" in df.columns else F.col("content")


def explode_lines(files: DataFrame, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per line, 1-based, split on newline only, trailing empty lines kept."""
    cols = keep if keep is not None else [c for c in ("skill_id", "path") if c in files.columns]
    body = text if text is not None else F.col("content")
    return files.select(*cols, F.posexplode(F.split(body, "\n", -1)).alias("_pos", "line")).select(
        *cols, (F.col("_pos") + 1).alias("line_no"), "line"
    )


# Files that are split into lines at a time.
FILES_AT_ONCE = 256


def _searched(files: DataFrame, cols: list[str], text: Column, search: str, patterns: list[str], shapes: list[str], fields: list[T.StructField], form) -> DataFrame:
    """Lines of files that a pattern or shape may match, found by RE2 on Arrow batches and put into columns by ``form``."""
    wanted, exact = "|".join([search, *shapes]), [*line_searches(patterns), *shapes]
    src = files.select(*cols, text.cast("string").alias("_text"))

    def found(lines: pa.Array) -> pa.Array:
        """Places of the lines that are kept, in order."""
        left, kept = pc.indices_nonzero(pc.match_substring_regex(lines, wanted, ignore_case=True)), []
        for rx in exact:
            some = pc.match_substring_regex(lines.take(left), rx)
            kept.append(left.filter(some))
            left = left.filter(pc.invert(some))
        out = pa.concat_arrays(kept)
        return out.take(pc.sort_indices(out))

    def search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FILES_AT_ONCE):
                batch = whole.slice(at, FILES_AT_ONCE)
                # a file without a word is not split
                batch = batch.filter(pc.match_substring_regex(batch.column(len(cols)), wanted, ignore_case=True))
                if not batch.num_rows:
                    continue
                split = pc.split_pattern(batch.column(len(cols)), "\n")
                lines = split.flatten()
                hits = found(lines)
                owner = pc.list_parent_indices(split).take(hits)
                first = pc.subtract(split.offsets, split.offsets[0]).take(owner)
                number = pc.add(pc.subtract(hits.cast(pa.int64()), first.cast(pa.int64())), 1).cast(pa.int32())
                rows, values = form(owner, number, lines.take(hits))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(cols))], *values], names=[*cols, *[f.name for f in fields]])

    return src.mapInArrow(search_batches, T.StructType([*[src.schema[c] for c in cols], *fields]))


def pattern_lines(files: DataFrame, patterns: Iterable[str], text: Column | None = None, keep: list[str] | None = None, shapes: Iterable[str] = ()) -> DataFrame:
    """``explode_lines`` of the lines that one of the patterns may match; no line that a pattern matches is left out.

    A pack has a hundred words.  Looked for one after the other they cost as many passes over the text; here RE2 finds
    them in one pass, inside the tasks, and only lines with a word meet the patterns.  Java judges the
    lines that are left.  ``shapes``: further RE2 patterns whose lines are kept, for tests without words.  All
    lines are given where a pattern has no word.
    """
    patterns = list(patterns)
    cols = keep if keep is not None else [c for c in ("skill_id", "path") if c in files.columns]
    search = word_search(patterns)
    if search is None:
        return explode_lines(files, text, cols)
    fields = [T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())]
    return _searched(files, cols, text if text is not None else F.col("content"), search, patterns, list(shapes), fields, lambda owner, number, lines: (owner, [number, lines]))


def pattern_texts(files: DataFrame, patterns: Iterable[str], text: Column | None = None, keep: list[str] | None = None, shapes: Iterable[str] = ()) -> DataFrame:
    """One row per file that has lines of ``pattern_lines``: ``keep`` and ``text``, these lines in order.

    Whole-text tests that look for nothing longer than a line come out alike on it.
    """
    patterns = list(patterns)
    cols = keep if keep is not None else [c for c in ("skill_id", "path") if c in files.columns]
    body, search = text if text is not None else F.col("content"), word_search(patterns)
    if search is None:
        return files.select(*cols, body.alias("text"))

    def joined(owner: pa.Array, number: pa.Array, lines: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
        ends = pc.run_end_encode(owner)
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.run_ends])
        return ends.values, [pc.binary_join(pa.ListArray.from_arrays(starts, lines), "\n")]

    return _searched(files, cols, body, search, patterns, list(shapes), [T.StructField("text", T.StringType())], joined)


def explode_tests(df: DataFrame, tests: list[tuple[Column, Column]], keep: list[str], alias: str = "h", guard: Column | None = None) -> DataFrame:
    """One row per (row, passing test) carrying the test's value.

    ``guard`` (default: the OR of the tests) filters first inside generated code; only the few
    rows that pass build the array of values, which is interpreted.
    """
    cells = F.array_compact(F.array(*[F.when(cond, value) for cond, value in tests]))
    return df.where(guard if guard is not None else any_of(cond for cond, _ in tests)).select(*keep, F.explode(cells).alias(alias))


def first_label(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first matching pattern, else null; later patterns are not evaluated."""
    out = F.when(matches(c, patterns[0][0]), F.lit(patterns[0][1]))
    for rx, label in patterns[1:]:
        out = out.when(matches(c, rx), F.lit(label))
    return out


def scan_pack(files: DataFrame, pack: P.Pack) -> DataFrame:
    """Hits of one pack: skill_id, path, line_no, rule_id, severity, label, line."""
    return scan_packs(files, [pack])


def line_test(pack: P.Pack, line: Column) -> Column:
    """Whether a line is a hit of the pack, but for the test of the path.

    Pattern first: lines without a hit skip the gate regexes.  No pack pattern is anchored, so the
    untrimmed line gives the same answer as the trimmed one.
    """
    cond = [matches_any(line, [rx for rx, _ in pack.patterns])]
    if pack.code_only:
        cond.append(is_code_line(line))
    if pack.exclude:
        cond.append(~has_any(F.lower(line), pack.exclude))
    return all_of(cond)


def hit_files(files: DataFrame, pack: P.Pack) -> tuple[DataFrame, Column]:
    """Files that can have a hit of the pack, and the text it is looked for in."""
    text = analysis_text(files) if pack.analysis else F.col("content")
    src = files.where(~is_low_signal_path(F.col("path"))) if pack.skip_low_signal else files
    return src.where(may_match(text, [rx for rx, _ in pack.patterns])), text


def pack_context(files: DataFrame, pack: P.Pack, radius: int = 2) -> DataFrame:
    """Hits of a pack with their numbered context block: skill_id, path, line_no, code_snippet.

    The block is cut in the row that is scanned, so the text is read once and joined to nothing.
    """
    src, text = hit_files(files, pack)
    blocks = lambda lines: F.transform(hit_lines(lines, lambda l: line_test(pack, l)), lambda n: F.struct(n.alias("line_no"), code_snippet(lines, n, n, radius).alias("code_snippet")))
    return src.select("skill_id", "path", F.inline(let(F.split(text, "\n", -1), blocks)))


def _pack_test(p: P.Pack) -> tuple[Column, Column]:
    cond = [line_test(p, F.col("line"))]
    if p.skip_low_signal:
        cond.append(~F.col("_low"))
    return all_of(cond), F.struct(F.lit(p.key).alias("pack"), F.lit(p.rule_id).alias("rule_id"), F.lit(p.severity).alias("severity"),
                                  first_label(F.col("line"), list(p.patterns)).alias("label"))


def _rule_test(r: Rule) -> tuple[Column, Column]:
    return matches_any(F.col("line"), r.patterns), F.struct(F.lit(None).cast("string").alias("pack"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("label"))


def scan_packs(files: DataFrame, chosen: list[P.Pack], rules: Iterable[Rule] = ()) -> DataFrame:
    """Several packs over one pass of the lines per text variant.

    Pattern rules given as ``rules`` join the pass over the decoded text, with their name as label and no pack.
    """
    out = None
    decoded = "analysis_content" in files.columns  # without decoded text both variants are the same pass
    own = [r for r in rules if r.dtype == "pattern" and r.patterns]
    for analysis in (False, True):
        group = [p for p in chosen if (p.analysis and decoded) == analysis]
        here = own if analysis == decoded else []
        if not group and not here:
            continue
        src = files.select("skill_id", "path", (analysis_text(files) if analysis else F.col("content")).alias("_text"))
        need_low = any(p.skip_low_signal for p in group)
        src = src.withColumn("_low", is_low_signal_path(F.col("path")) if need_low else F.lit(False))
        if not here and all(p.skip_low_signal for p in group):
            src = src.where(~F.col("_low"))
        patterns = [rx for p in group for rx, _ in p.patterns] + [rx for r in here for rx in r.patterns]
        lines = pattern_lines(src, patterns, F.col("_text"), ["skill_id", "path", "_low"])
        tests = [*map(_pack_test, group), *map(_rule_test, here)]
        hits = explode_tests(lines, tests, ["skill_id", "path", "line_no", "line"], guard=guarded_match(F.col("line"), patterns))
        part = hits.select("skill_id", "path", "line_no", "h.pack", "h.rule_id", "h.severity", "h.label", "line")
        out = part if out is None else out.unionByName(part)
    return out


def scan_patterns(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pattern rules of every layer: one row per (rule, line), first pattern wins."""
    chosen = [r for r in rules if r.dtype == "pattern" and r.patterns]
    patterns = [p for r in chosen for p in r.patterns]
    lines = pattern_lines(files, patterns, analysis_text(files))
    tests = [
        (matches_any(F.col("line"), r.patterns),
         F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("title"),
                  F.lit(r.action).alias("action"), F.lit(r.reason).alias("description")))
        for r in chosen
    ]
    return explode_tests(lines, tests, ["*"], "r", guarded_match(F.col("line"), patterns)).select(
        "skill_id", "path", "line_no", "r.rule_id", "r.severity", "r.title", "r.action", "r.description", "line"
    )


def hit_intervals(files: DataFrame, rules: list[Rule], radius: int = 2) -> DataFrame:
    """Pattern-rule findings with consecutive hit lines merged and a numbered context block.

    Islands are formed inside the file's own row, so no window and no shuffle is needed.
    Blocking-layer rules always report severity high; custom rules of other layers keep theirs.
    """
    chosen = [r for r in rules if r.dtype == "pattern" and r.patterns]
    text = F.col("_text")
    src = files.select("skill_id", "path", analysis_text(files).alias("_text")).where(may_match(text, [p for r in chosen for p in r.patterns]))

    def intervals(r: Rule):
        def body(lines: Column) -> Column:
            islands = let(hit_lines(lines, lambda l: matches_any(l, r.patterns)), hit_islands)
            return F.transform(islands, lambda g: F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit("high" if r.layer == "P0" else r.severity).alias("severity"), F.lit(r.name).alias("title"),
                F.lit(r.reason).alias("description"), F.lit(r.action).alias("action"), g["line_start"].alias("line_start"), g["line_end"].alias("line_end"),
                code_snippet(lines, g["line_start"], g["line_end"], radius).alias("code_snippet")))

        return body

    # lines are split once per file and bound; a rule without a match in the file skips its lambda
    per_rule = lambda lines: F.array_compact(F.array(*[F.when(may_match(text, r.patterns), intervals(r)(lines)) for r in chosen]))
    return src.select("skill_id", "path", F.inline(let(F.split(text, "\n", -1), lambda lines: F.flatten(per_rule(lines)))))


def may_match(text: Column, patterns) -> Column:
    """Whole-content test that is true whenever some line matches.

    Anchors are given their line meaning, so this only ever lets too much through; most
    files have no hit and never reach the per-line lambda.
    """
    if any(r"\A" in p or r"\z" in p for p in patterns):
        return F.lit(True)
    return guarded_match(text, patterns, "(?m)")


def location(path: Column, start: Column, end: Column | None = None) -> Column:
    """``base:line`` or ``base:start-end``."""
    head = F.concat(base_name(path), F.lit(":"), start.cast("string"))
    if end is None:
        return head
    return F.when(end > start, F.concat(head, F.lit("-"), end.cast("string"))).otherwise(head)


def code_context(findings: DataFrame, files: DataFrame, radius: int = 2) -> DataFrame:
    """Add ``code_snippet`` to findings (skill_id, path, line_no, ...).

    For findings from elsewhere; hits of a pack get their block in ``pack_context``.  The wanted line numbers are
    gathered per file first (bounded by the file), so the content is joined once per file instead of once per finding.
    """
    wanted = findings.groupBy("skill_id", "path").agg(F.collect_set("line_no").alias("_nos"))
    snippets = (
        wanted.join(files.select("skill_id", "path", "content"), ["skill_id", "path"])
        .withColumn("_lines", F.split("content", "\n", -1))
        .select("skill_id", "path", "_lines", F.explode("_nos").alias("line_no"))
        .where(F.col("line_no") <= F.size("_lines"))
        .select("skill_id", "path", "line_no",
                code_snippet(F.col("_lines"), F.col("line_no"), F.col("line_no"), radius).alias("code_snippet"))
    )
    return findings.join(snippets, ["skill_id", "path", "line_no"], "left")


# --- credentials -----------------------------------------------------------------------

def credential_formats(lines: DataFrame, learned: list[str] | None = None) -> DataFrame:
    """Typed credential formats; exclusions look at the line, placeholders at the match.

    ``learned`` holds false-positive tokens pooled over all rules (a reviewer's list).
    """
    tests = []
    for rx, kind, exclusions in P.CREDENTIAL_FORMATS:
        m = F.regexp_extract("line", jrx(rx), 0)
        muted = []
        if exclusions is not None:
            muted += [any_of(F.col("line").contains(e) for e in exclusions), contains_any(m, P.PLACEHOLDER_WORDS)]
        if learned:
            muted.append(has_any(F.lower(m), learned))
        ok = matches(F.col("line"), rx)
        if muted:
            ok = ok & ~any_of(muted)
        tests.append((ok, F.struct(F.lit(kind).alias("kind"), m.alias("match"))))
    keep = [c for c in lines.columns if c != "line"]
    return explode_tests(lines, tests, keep, "c", guarded_match(F.col("line"), [rx for rx, _, _ in P.CREDENTIAL_FORMATS])).select(*keep, "c.kind", "c.match")


def learned_exclusions(hits: DataFrame, feedback: DataFrame, per_rule: bool = False) -> DataFrame:
    """Drop a hit whose lower-cased match contains a learned token.

    Tokens are pooled over all rule ids as in the reference; ``per_rule`` limits them to their
    own rule.  Substring matching is made an equi join: distinct matches are exploded to their
    short grams, joined with each token's leading gram, and verified; the hits then meet the
    muted matches by key.  ``hits``: rule_id, match, ...; ``feedback``: rule_id, token.
    """
    tok = feedback.select(F.upper(ws_trim(F.col("rule_id"))).alias("t_rule"), F.lower(ws_trim(F.col("token"))).alias("token")).where("token <> '' and t_rule <> ''")
    scope = ["t_rule"] if per_rule else []
    tok = tok.select(*scope, "token", F.substring("token", 1, 3).alias("gram")).distinct()
    m = hits.select(*([F.upper("rule_id").alias("t_rule")] if per_rule else []), F.lower("match").alias("m")).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("m"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("m"), i, F.lit(n)) for n in (1, 2, 3)]))))
    muted = (
        m.select(*scope, "m", F.explode(grams).alias("gram")).join(tok, [*scope, "gram"]).where(F.col("m").contains(F.col("token"))).select(*scope, "m").distinct()
    )
    keyed = hits.withColumn("m", F.lower("match"))
    if per_rule:
        keyed = keyed.withColumn("t_rule", F.upper("rule_id"))
    return keyed.join(muted, [*scope, "m"], "left_anti").select(*hits.columns)


def high_entropy_literals(lines: DataFrame, threshold: float = 4.5) -> DataFrame:
    """Literals longer than 16 bytes after quote trimming, without placeholder words, above the entropy limit.

    Entropy above 4.5 needs at least 23 distinct characters, so shorter texts skip the computation.
    """
    clean = F.regexp_replace("line", "^[\"' ]+|[\"' ]+$", "")
    min_len = int(2**threshold) + 1
    df = lines.withColumn("literal", clean).where(
        (F.octet_length("literal") > 16) & (F.length("literal") >= min_len)
        & ~any_of(F.col("line").contains(w) for w in P.PLACEHOLDER_WORDS)
        & ~contains_any(F.col("literal"), P.PLACEHOLDER_WORDS)
    )
    return df.withColumn("entropy", byte_entropy(F.col("literal"))).where(F.col("entropy") > threshold).drop("line")


def obfuscated_files(files: DataFrame, threshold: float = 6.0) -> DataFrame:
    """Per file: any very high-entropy line, or a line naming both base64 and decode."""
    clean = ws_trim(F.col("line"))
    heavy = F.when((F.octet_length(clean) > 32) & (F.length(clean) > int(2**threshold)), byte_entropy(clean) > threshold).otherwise(F.lit(False))
    named = F.col("line").contains("base64") & F.col("line").contains("decode")
    src = files.where(~is_excluded_file(F.col("path")))
    return explode_lines(src, analysis_text(src)).where(heavy | named).groupBy("skill_id", "path").agg(F.count("*").alias("n_lines"))


def dangerous_calls(lines: DataFrame) -> DataFrame:
    """Risky calls by category; one row per (pattern, category, line)."""
    guard = guarded_match(F.col("line"), [rx for items in P.DANGEROUS_CALLS.values() for rx, _ in items])
    tests = [
        (matches(F.col("line"), rx), F.struct(F.lit(cat).alias("category"), F.lit(rx).alias("function"), F.lit(sev).alias("severity")))
        for cat, items in P.DANGEROUS_CALLS.items() for rx, sev in items
    ]
    keep = [c for c in lines.columns if c != "line"]
    return explode_tests(lines, tests, keep, "d", guard).select(*keep, "d.category", "d.function", "d.severity")


def injection_lines(lines: DataFrame) -> DataFrame:
    """prompt_injection and agent_context patterns on the lower-cased line.

    Patterns with capital letters can therefore never match; kept as the reference behaves.
    """
    low = F.lower("line")
    guard = matches_any(low, [rx for cat in ("prompt_injection", "agent_context") for rx, _ in P.DANGEROUS_CALLS[cat]])
    tests = [
        (matches(low, rx), F.struct(F.lit(cat).alias("category"), F.lit(rx).alias("function"), F.lit(sev).alias("severity")))
        for cat in ("prompt_injection", "agent_context") for rx, sev in P.DANGEROUS_CALLS[cat]
    ]
    keep = [c for c in lines.columns if c != "line"]
    return explode_tests(lines, tests, keep, "d", guard).select(*keep, "d.category", "d.function", "d.severity")


# --- line classifiers --------------------------------------------------------------------

def touches_secrets(line: Column) -> Column:
    return (
        has_any(F.lower(line), P.SENSITIVE_MARKERS)
        | (matches(line, P.ENV_READ_RX) & matches(line, P.ENV_SECRET_RX))
        | (matches(line, P.FILE_READ_RX) & matches(line, P.FILE_SECRET_RX))
    )


def calls_network(line: Column) -> Column:
    return matches(line, P.NETWORK_CALL_RX) & is_code_line(line)


def runs_command(line: Column) -> Column:
    return matches(line, P.COMMAND_CALL_RX) & is_code_line(line)


def destroys_data(line: Column) -> Column:
    """``rm -rf`` and SQL deletion count only with an executor on the line."""
    t = ws_trim(line)
    hit = (
        F.when(matches(line, P.DELETE_CALL_RX), F.lit(True))
        .when(matches(line, P.RM_RF_RX), matches(t, P.RM_CONTEXT_RX))
        .when(matches(line, P.SQL_DELETE_RX), matches(line, P.SQL_CONTEXT_RX))
        .otherwise(F.lit(False))
    )
    return hit & is_code_line(line)


def persists_or_beacons(line: Column) -> Column:
    return (matches(line, P.C2_RX) | (matches(line, P.PERSIST_TARGET_RX) & matches(line, P.PERSIST_WRITE_RX))) & is_code_line(line)


# --- rules with file- or skill-level logic -------------------------------------------------

def _finding(df: DataFrame, rule_id: str, severity: Column | str, label: Column | str) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    lab = F.lit(label) if isinstance(label, str) else label
    return df.select("skill_id", "path", F.col("line_no").cast("int").alias("line_no"), F.lit(rule_id).alias("rule_id"),
                     sev.alias("severity"), lab.alias("label"))


def first_in_skill(df: DataFrame, *payload: str) -> DataFrame:
    """First row per skill by (path, line_no), as a partial-aggregable min instead of a window."""
    cols = ["path", "line_no", *payload]
    return df.groupBy("skill_id").agg(F.min(F.struct(*cols)).alias("m")).select("skill_id", *[F.col("m")[c].alias(c) for c in cols])


def hidden_content_scores(files: DataFrame) -> DataFrame:
    """Skill score 0..5: control characters zero it, override text costs 4 per file,
    two base64 helper mentions 3, a high-entropy file 2."""
    t = analysis_text(files)
    src = files.where(~is_low_signal_path(F.col("path"))).select(
        "skill_id", "path",
        has_hidden_chars(t).alias("control"), any_prompt_override(t).alias("override"),
        (t.contains("btoa").cast("int") + t.contains("atob").cast("int")).alias("b64"),
        # ≥ 33 distinct characters are needed for entropy above 5.0
        F.when(F.length(t) > 32, byte_entropy(t) > 5.0).otherwise(F.lit(False)).alias("dense"),
    )
    agg = src.groupBy("skill_id").agg(
        F.bool_or("control").alias("control"), F.count_if("override").alias("n_override"),
        F.sum("b64").alias("n_b64"), F.bool_or("dense").alias("dense"), F.min(F.when(F.col("dense"), F.col("path"))).alias("dense_path"),
    )
    raw = 5 - 4 * F.col("n_override") - F.when(F.col("n_b64") >= 2, 3).otherwise(0) - F.when(F.col("dense"), 2).otherwise(0)
    return agg.select("skill_id", F.when(F.col("control"), F.lit(0)).otherwise(F.greatest(raw, F.lit(0))).cast("int").alias("score"), "dense_path")


def hidden_content(files: DataFrame) -> DataFrame:
    """Findings of skills whose hidden-content score dropped."""
    scores = hidden_content_scores(files).where("score < 5")
    lines = explode_lines(files.where(~is_low_signal_path(F.col("path"))))
    line = F.col("line")
    value = lambda sev, label: F.struct(F.lit(sev).alias("severity"), F.lit(label).alias("label"))
    tests = [
        (line.contains("btoa"), value("low", "btoa encoding")), (line.contains("atob"), value("low", "atob decoding")),
        (has_hidden_chars(line), value("low", "hidden control character")), (any_prompt_override(line), value("medium", "prompt override")),
    ]
    hits = explode_tests(lines, tests, ["skill_id", "path", "line_no"])
    per_line = _finding(hits.join(scores.select("skill_id"), "skill_id", "left_semi"), "V7-029", F.col("h.severity"), F.col("h.label"))
    dense = _finding(scores.where("dense_path is not null").select("skill_id", F.col("dense_path").alias("path"), F.lit(0).alias("line_no")),
                     "V7-029", "low", "high file entropy")
    return per_line.unionByName(dense)


# Lines that can hold an override phrase, plain or encoded.
OVERRIDE_PATTERNS = [f"(?i){re.escape(w)}" for w in PROMPT_OVERRIDE]
ENCODED_SHAPES = [r"[A-Za-z0-9+/]{20}", r"(?i:(?:\\x[0-9a-f]{2}){8})"]


def injection_scores(files: DataFrame) -> DataFrame:
    """Skill score 15 minus the first failing file's penalty (files in path order)."""
    t = F.col("text")  # every test looks for something within a line
    cost = (
        F.when(any_prompt_override(t), 15)
        .when(t.contains("exec.Command") & t.contains("input"), 15)
        .when(t.contains("llm.Output") & t.contains("exec"), 12)
        .when(t.contains("args") & ~t.contains("whitelist"), 8)
    )
    words = [re.escape(w) for w in ("exec", "input", "llm.Output", "args", "whitelist")]
    held = pattern_texts(files.where(~is_low_signal_path(F.col("path"))), [*OVERRIDE_PATTERNS, *words], analysis_text(files), shapes=ENCODED_SHAPES)
    src = held.select("skill_id", "path", cost.alias("cost")).where("cost is not null")
    return src.groupBy("skill_id").agg(F.min(F.struct("path", "cost")).alias("m")).select(
        "skill_id", (15 - F.col("m.cost")).alias("score"), F.col("m.path").alias("path"))


def injection_risk(files: DataFrame) -> DataFrame:
    """First injection line per failing skill; a skill without a concrete line points at its first file."""
    failing = injection_scores(files).select("skill_id")
    src = files.where(~is_low_signal_path(F.col("path")))
    line = F.col("line")
    over = any_prompt_override(line)
    call = (line.contains("exec.Command") & line.contains("input")) | (line.contains("os.system") & line.contains("input")) | line.contains("eval(")
    label = F.when(over, F.lit("prompt override")).when(call, F.lit("command injection"))
    calls = [re.escape(w) for w in ("exec.Command", "os.system", "eval(")]
    lines = pattern_lines(src, [*OVERRIDE_PATTERNS, *calls], analysis_text(src), shapes=ENCODED_SHAPES)
    hits = lines.withColumn("label", label).where("label is not null")
    first = first_in_skill(hits.select("skill_id", "path", "line_no", "label"), "label").join(failing, "skill_id", "left_semi")
    # files of any kind count for the fallback location
    fallback = (
        files.groupBy("skill_id").agg(F.min("path").alias("path")).join(failing, "skill_id", "left_semi")
        .join(first, "skill_id", "left_anti").withColumn("line_no", F.lit(0))
    )
    return _finding(first, "V7-011", "medium", F.col("label")).unionByName(_finding(fallback, "V7-011", "medium", "command injection"))


def resource_exhaustion(files: DataFrame) -> DataFrame:
    """First endless loop, or a file issuing GET calls with no timeout anywhere; one finding per skill.

    A loop ends its file's scan, so timeouts after it are not seen; the GET branch needs a
    file without a loop.  Score: 5 minus 5 (loop) or 2 (no timeout).
    """
    lines = F.split(analysis_text(files), "\n", -1)
    loops = hit_lines(lines, lambda l: matches(ws_trim(l), P.LOOP_RX) & is_code_line(l))
    gets = hit_lines(lines, lambda l: has_any(F.lower(l), ["http.get(", "requests.get("]) & is_code_line(l))
    waits = F.exists(lines, lambda l: F.lower(l).contains("timeout") & is_code_line(l))
    per_file = files.select("skill_id", "path", loops.alias("loops"), gets.alias("gets"), waits.alias("waits")).select(
        "skill_id", "path",
        F.when(F.size("loops") > 0, F.element_at("loops", 1)).when((F.size("gets") > 0) & ~F.col("waits"), F.element_at("gets", -1)).alias("line_no"),
        F.when(F.size("loops") > 0, F.lit("endless loop")).otherwise(F.lit("no timeout")).alias("label"),
    ).where("line_no is not null")
    return _finding(first_in_skill(per_file, "label"), "V7-026", "low", F.col("label"))


def soft_dependencies(files: DataFrame) -> DataFrame:
    """Remote script fetched without hash (−10) or over plain http (−5): first such line per skill."""
    t = analysis_text(files)
    cost = F.when(t.contains("http.Get") & t.contains(".js") & ~t.contains("hash"), 10).when(t.contains("http.Get") & ~t.contains("https://"), 5)
    failing = files.where(cost.isNotNull()).select("skill_id").distinct()
    hits = explode_lines(files, t).where(F.col("line").contains("http.Get") & ~F.col("line").contains("hash"))
    first = first_in_skill(hits).join(failing, "skill_id", "left_semi")
    fallback = (
        files.groupBy("skill_id").agg(F.min("path").alias("path")).join(failing, "skill_id", "left_semi")
        .join(first, "skill_id", "left_anti").withColumn("line_no", F.lit(0))
    )
    return _finding(first, "V7-018", "medium", "unchecked remote script").unionByName(_finding(fallback, "V7-018", "medium", "soft dependency"))


def version_uncertain(version: Column) -> Column:
    v = F.lower(ws_trim(F.coalesce(version, F.lit(""))))
    return v.isin("", "*", "latest") | any_of(v.contains(x) for x in (">=", "<=", "~=", "^")) | matches(v, P.LOOSE_VERSION_RX)


def version_locking(files: DataFrame) -> DataFrame:
    """Manifest lines with an external source or a loose version."""
    src = files.where(is_manifest(F.col("path")))
    low = F.lower("line")
    loose = any_of(low.contains(x) for x in ("git+https://", "http://", "https://")) | version_uncertain(F.col("line"))
    hits = explode_lines(src, analysis_text(src)).where(is_code_line(F.col("line")) & loose)
    return _finding(hits, "V7-022", "medium", "unlocked version")


def version_locking_deps(deps: DataFrame) -> DataFrame:
    """Dependency rows with a loose version."""
    return deps.where(version_uncertain(F.col("version"))).select("skill_id", "name", "version")


def tool_abuse(files: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """Destructive tool named in a description that never mentions files, or on the first such line
    of a file holding a tool-call marker.  The marker test runs on whole content before the explode."""
    t = analysis_text(files)
    marked = files.where(t.contains("mcp__") | t.contains("call_tool"))
    lines = F.split(analysis_text(marked), "\n", -1)
    hits = hit_lines(lines, lambda l: l.contains("delete_all") | l.contains("system.exec"))
    per_file = marked.select("skill_id", "path", F.try_element_at(hits, F.lit(1)).alias("line_no")).where("line_no is not null")
    out = _finding(per_file, "V7-007", "high", "tool call")
    if skills is not None:
        d = F.col("description")
        named = d.contains("调用 file_system.delete_all") | d.contains("调用 system.exec")
        vague = ~F.lower(F.coalesce("name", F.lit(""))).contains("file") & ~F.lower(d).contains("file")
        desc = skills.where(named & vague).select("skill_id", F.lit("").alias("path"), F.lit(0).alias("line_no"))
        out = out.unionByName(_finding(desc, "V7-007", "high", "tool description"))
    return out


def cooccurs(files: DataFrame, variants: dict[str, tuple[tuple[str, ...], ...]] | None = None) -> DataFrame:
    """Files in which every word group of a variant occurs; words may be on different lines."""
    t = analysis_text(files)
    cells = [
        F.when(all_of(any_of(t.contains(w) for w in group) for group in groups), F.lit(name))
        for name, groups in (variants or P.COOCCURRENCE).items()
    ]
    return files.select("skill_id", "path", F.explode(F.array_compact(F.array(*cells))).alias("variant"))


def custom_patterns(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """User-supplied pattern rules, scanned like the built-in ones."""
    return scan_patterns(files, rules)


