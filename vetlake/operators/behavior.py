"""Behaviour evidence, gap segments, chains, timelines, ordered alerts and behaviour risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import guarded_match
from ..functions.paths import is_signal_file
from ..functions.text import any_of, has_any, is_code_line, jrx, matches, ws_trim
from . import packs as P
from .scan import explode_lines, explode_tests, pattern_lines

GAP = 12


# Part of every address that ``IPV4_RX`` finds.
IPV4_SHAPE = r"[0-9]\.[0-9]"


def _signal_lines(files: DataFrame, patterns: list[str] | None = None, shapes: list[str] | None = None) -> DataFrame:
    """Lines of the behaviour scan: signal files, neither blank nor comment.  With patterns, only lines that can match one or hold a shape."""
    src = files.where(is_signal_file(F.col("path")))
    lines = explode_lines(src) if patterns is None else pattern_lines(src, patterns, shapes=shapes or [])
    return lines.where(is_code_line(F.col("line")))


def _evidence(c: Column) -> Column:
    """The whole line or target: two that differ late stay two, and a target meets its reputation."""
    return ws_trim(c)


def line_targets(line: Column) -> Column:
    """All URLs, then all IPv4 addresses of a line."""
    return F.concat(F.regexp_extract_all(line, F.lit(jrx(P.URL_RX)), F.lit(0)), F.regexp_extract_all(line, F.lit(jrx(P.IPV4_RX)), F.lit(0)))


def touches_credentials(line: Column) -> Column:
    return matches(line, P.CREDENTIAL_PATH_RX) | (matches(line, P.CREDENTIAL_ACCESS_RX) & matches(line, P.CREDENTIAL_SECRET_RX))


def behavior_facts(files: DataFrame, delay_secs: int = 300) -> DataFrame:
    """Everything the behaviour scan sees, in one pass over the lines: skill_id, path, line_no, category, evidence.

    Categories: the eleven of ``BEHAVIOR_CATEGORIES`` plus network_targets, file_targets,
    exec_targets and evasion_signals.  Target hits also count as outbound evidence.  A line is
    one row, so duplicates can only arise inside its own array: distinctness needs no shuffle.
    """
    line, low = F.col("line"), F.lower("line")
    item = lambda cat, ev: F.struct(F.lit(cat).alias("category"), ev.alias("evidence"))
    tests = {cat: touches_credentials(line) if cat == "credential" else matches(line, P.BEHAVIOR_RX[cat]) for cat in P.BEHAVIOR_CATEGORIES}
    cells = [F.when(test, item(cat, _evidence(line))) for cat, test in tests.items()]
    cells.append(F.when(tests["execute"], item("exec_targets", line)))
    cells.append(F.when(_opens_file(line), item("file_targets", F.col("path"))))
    cells += [F.when(cond, item("evasion_signals", value)) for cond, value in _evasion_tests(line, low, delay_secs)]
    urls = line_targets(line)
    as_item = lambda cat: lambda t: item(cat, _evidence(t))
    facts = F.array_distinct(F.concat(F.array_compact(F.array(*cells)), F.transform(urls, as_item("outbound")), F.transform(urls, as_item("network_targets"))))
    # one alternation first, in generated code; the arrays are built for the few lines that pass
    patterns = [*P.BEHAVIOR_RX.values(), P.CREDENTIAL_PATH_RX, P.CREDENTIAL_ACCESS_RX, P.URL_RX, *P.EVASION_FINGERPRINTS.values(), P.SLEEP_RX,
                r"open\(|os\.ReadFile|os\.WriteFile", r"(?i)docker|vm|sandbox"]
    some = guarded_match(line, patterns) | matches(line, P.IPV4_RX)
    return _signal_lines(files, patterns, [IPV4_SHAPE]).where(some).select("skill_id", "path", "line_no", F.explode(facts).alias("p")).select(
        "skill_id", "path", "line_no", "p.category", "p.evidence")


def behavior_points(files: DataFrame) -> DataFrame:
    """Distinct evidence points of the eleven behaviour categories."""
    return points_of(behavior_facts(files))


def points_of(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("category").isin(P.BEHAVIOR_CATEGORIES))


def signals_of(facts: DataFrame) -> DataFrame:
    return facts.where("category = 'evasion_signals'").select("skill_id", F.col("evidence").alias("signal")).distinct()


def _opens_file(line: Column) -> Column:
    return line.contains("open(") | line.contains("os.ReadFile") | line.contains("os.WriteFile")


def _evasion_tests(line: Column, low: Column, delay_secs: int) -> list[tuple[Column, Column]]:
    secs = F.transform(F.regexp_extract_all(line, F.lit(jrx(P.SLEEP_RX)), F.lit(1)), lambda s: s.try_cast("long"))
    first_long = F.try_element_at(F.filter(secs, lambda s: s >= delay_secs), F.lit(1))
    tests = [(matches(line, rx), F.lit(f"fingerprint {k}")) for k, rx in P.EVASION_FINGERPRINTS.items()]
    tests.append((low.contains("sleep(") & first_long.isNotNull(), F.concat(F.lit(f"delay {delay_secs} hit "), first_long.cast("string"))))
    tests.append((has_any(low, ["docker", "vm", "sandbox"]) & has_any(low, ["if", "switch"]) & has_any(low, ["exec", "powershell", "curl", "wget"]), F.lit("environment guarded execution")))
    return tests


def extract_targets(files: DataFrame) -> DataFrame:
    """Network targets with their lines: skill_id, path, line_no, target."""
    some = F.col("line").contains("http") | matches(F.col("line"), P.IPV4_RX)
    return _signal_lines(files).where(some).select("skill_id", "path", "line_no", F.explode(F.array_distinct(line_targets(F.col("line")))).alias("target"))


def distinct_targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("skill_id", "target").agg(F.count("*").alias("n"))


def file_targets(files: DataFrame) -> DataFrame:
    """Files with open or read/write calls: skill_id, path, n_lines."""
    return _signal_lines(files).where(_opens_file(F.col("line"))).groupBy("skill_id", "path").agg(F.count("*").alias("n_lines"))


def exec_targets(files: DataFrame) -> DataFrame:
    """Lines with process-start calls: skill_id, path, line_no, line."""
    return _signal_lines(files).where(matches(F.col("line"), P.PROCESS_START_RX))


def evasion_signals(files: DataFrame, delay_secs: int = 300) -> DataFrame:
    """Distinct evasion signals per skill: fingerprints, long sleeps, environment-guarded execution."""
    tests = _evasion_tests(F.col("line"), F.lower("line"), delay_secs)
    return explode_tests(_signal_lines(files), tests, ["skill_id"], "signal").distinct()


# --- segments ------------------------------------------------------------------------------------

def segment_points(points: DataFrame, gap: int = GAP, keys: tuple[str, ...] = ("skill_id", "path"), pos: str = "line_no",
                   bucket: int | None = None) -> DataFrame:
    """Gap clustering: a new segment starts where ``pos`` is more than ``gap`` after its predecessor.

    Returns keys, seg_start, seg_end and one row per (segment, category): n, first, last.

    Safe for a key holding a third of all rows.  Points are first combined per (key, bucket,
    pos, category), then clustered inside buckets of ``bucket`` positions, so a window group
    holds at most ``bucket`` × categories rows.  Segments crossing bucket borders are stitched
    from one summary row per non-empty bucket.
    """
    width = bucket or max(gap * 8, 4096)
    k = list(keys)
    combined = points.groupBy(*k, F.floor(F.col(pos) / width).alias("_b"), F.col(pos).alias("pos"), "category").agg(F.count("*").alias("n"))
    in_bucket = Window.partitionBy(*k, "_b").orderBy("pos")
    prev = F.max("pos").over(in_bucket.rangeBetween(Window.unboundedPreceding, -1))
    marked = combined.withColumn("_new", F.when(prev.isNull() | (F.col("pos") - prev > gap), F.col("pos")))
    # local segment start: the latest marked position at or before this one
    local = marked.withColumn("_start", F.max("_new").over(in_bucket.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    local = local.groupBy(*k, "_b", "_start", "category").agg(
        F.sum("n").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))

    edges = local.groupBy(*k, "_b").agg(F.min("_start").alias("b_first"), F.max("_start").alias("b_tail"), F.max("last").alias("b_last"))
    by_bucket = Window.partitionBy(*k).orderBy("_b")  # at most one row per non-empty bucket
    joined = F.coalesce(F.col("b_first") - F.lag("b_last").over(by_bucket) <= gap, F.lit(False))
    edges = edges.withColumn("_joined", joined)
    # start of the segment still open at the end of a bucket; a bucket that is one segment joined
    # to its predecessor has no start of its own and inherits the previous one
    own = F.when(~F.col("_joined") | (F.col("b_tail") > F.col("b_first")), F.col("b_tail"))
    edges = edges.withColumn("_open", F.last(own, ignorenulls=True).over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = edges.withColumn("_carry", F.when(F.col("_joined"), F.lag("_open").over(by_bucket)))
    stitched = local.join(edges.select(*k, "_b", "b_first", "_carry").where("_carry is not null"), [*k, "_b"], "left")
    seg = F.when(F.col("_start") == F.col("b_first"), F.col("_carry"))
    return (
        stitched.withColumn("seg_start", F.coalesce(seg, F.col("_start")))
        .groupBy(*k, "seg_start", "category").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    )


def segments(points: DataFrame, gap: int = GAP, keys: tuple[str, ...] = ("skill_id", "path"), pos: str = "line_no",
             bucket: int | None = None) -> DataFrame:
    """One row per segment: range, category count, total and ``cats`` (category -> n, first, last)."""
    rows = segment_points(points, gap, keys, pos, bucket)
    return rows.groupBy(*keys, F.col("seg_start").alias("range_start")).agg(
        F.max("last").alias("range_end"), F.count("*").alias("n_categories"), F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "first", "last")))).alias("cats"),
    )


def _range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit(":"), start.cast("string"))).otherwise(
        F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def correlated(segs: DataFrame) -> DataFrame:
    """Segments in which at least two categories meet: what counts and support are taken from."""
    return segs.where("n_categories >= 2")


def chains(segs: DataFrame, k: int | None = None, owner: str = "skill_id", source: str = "path", categories: list[str] | None = None) -> DataFrame:
    """Segments with at least two categories, ranked per owner, with their text form; ``k`` keeps the strongest as a view."""
    cats = categories or P.BEHAVIOR_CATEGORIES
    counts = F.concat_ws(", ", *[F.concat(F.lit(c + "="), F.coalesce(F.col("cats")[c]["n"], F.lit(0)).cast("string")) for c in cats])
    w = Window.partitionBy(owner).orderBy(F.desc("score"), source, "range_start")
    ranked = correlated(segs).withColumn("score", F.col("n_categories") * 100 + F.col("total")).withColumn("rank", F.row_number().over(w))
    # row_number <= k becomes a group limit below the shuffle: at most k rows per owner and task travel
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return (
        ranked.withColumn("chain", F.concat(F.col(source), _range(F.col("range_start"), F.col("range_end")), F.lit(" | "), counts))
        .select(owner, *([source] if source != owner else []), "range_start", "range_end", "n_categories", "total", "score", "rank", "chain", "cats")
    )


def timelines(segs: DataFrame, k: int | None = None, owner: str = "skill_id", source: str = "path") -> DataFrame:
    """Category steps by first position then name; texts ranked per owner in text order, all or the first ``k``."""
    steps = F.array_sort(F.transform(F.map_entries("cats"), lambda e: F.struct(e["value"]["first"].alias("first"), e["key"].alias("name"), e["value"]["n"].alias("n"))))
    text = F.array_join(F.transform(steps, lambda s: F.concat(s["name"], F.lit("(L"), s["first"].cast("string"), F.lit(",x"), s["n"].cast("string"), F.lit(")"))), " -> ")
    df = segs.where("n_categories >= 2").select(
        owner, F.concat(F.col(source), _range(F.col("range_start"), F.col("range_end")), F.lit(" | "), text).alias("timeline"))
    w = Window.partitionBy(owner).orderBy("timeline")
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# Alert -> ordered category pairs.
ALERT_PAIRS = {
    "download then execute": [("download", "execute")],
    "collection then outbound": [("collection", "outbound")],
    "credential then outbound": [("credential", "outbound")],
    "evasion then execute": [("defense_evasion", "execute")],
    "lateral then control": [("lateral_move", "execute"), ("lateral_move", "c2_beacon")],
}
VETO_ALERTS = ["credential then outbound", "evasion then execute", "lateral then control"]


def _alert_tests(pairs: dict[str, list[tuple[str, str]]]) -> dict[str, Column]:
    """Per alert: an A stands before the last B of the segment, for any of its pairs."""
    met = lambda a, b: F.coalesce(F.col("cats")[a]["first"] < F.col("cats")[b]["last"], F.lit(False))
    return {name: any_of(met(a, b) for a, b in combos) for name, combos in pairs.items()}


def sequence_alerts(segs: DataFrame, pairs: dict[str, list[tuple[str, str]]] | None = None, owner: str = "skill_id") -> DataFrame:
    """Alerts whose first A precedes the last B inside one segment; segments counted per (owner, alert)."""
    cells = [F.when(cond, F.lit(name)) for name, cond in _alert_tests(pairs or ALERT_PAIRS).items()]
    return segs.select(owner, F.explode(F.array_compact(F.array(*cells))).alias("alert")).groupBy(owner, "alert").agg(F.count("*").alias("n_segments"))


# --- assessments -----------------------------------------------------------------------------------

def differential_probes(signals: DataFrame, execs: DataFrame) -> DataFrame:
    """Container / VM / baseline scenario per skill, triggered by its signals."""
    low = F.lower("signal")
    scenarios = {"container": low.contains("docker"), "virtual machine": has_any(low, ["vm", "hypervisor"]), "baseline": has_any(low, ["debug", "delay"])}
    flags = {"container": "_c", "virtual machine": "_v", "baseline": "_b"}
    sig = signals.groupBy("skill_id").agg(*[F.count_if(test).alias(flags[s]) for s, test in scenarios.items()])
    danger = execs.groupBy("skill_id").agg(F.bool_or(has_any(F.lower("line"), ["curl", "wget", "powershell", "bash -i"])).alias("dangerous_exec"))
    j = sig.join(danger, "skill_id", "full_outer")
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.coalesce(F.col(c), F.lit(0)).alias("n_indicators")) for s, c in flags.items()])
    return j.select("skill_id", F.coalesce("dangerous_exec", F.lit(False)).alias("dangerous_exec"), F.explode(rows).alias("r")).select(
        "skill_id", "r.scenario", (F.col("r.n_indicators") > 0).alias("triggered"), "r.n_indicators", "dangerous_exec")


def evidence_inventory(items: DataFrame, k: int = 5) -> DataFrame:
    """Distinct count and first ``k`` examples (in text order) per skill and category.

    ``items``: skill_id, category, item.  The examples are ranked, not collected and cut.
    """
    distinct = items.where(F.col("item") != "").dropDuplicates(["skill_id", "category", "item"])
    counts = distinct.groupBy("skill_id", "category").agg(F.count("*").alias("n"))
    w = Window.partitionBy("skill_id", "category").orderBy("item")
    ex = distinct.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("skill_id", "category").agg(
        F.array_sort(F.collect_list("item")).alias("examples"))
    return counts.join(ex, ["skill_id", "category"])


# Inventory category -> behaviour categories counted in it.
INVENTORY_SOURCES = {"outbound": ["outbound", "network_targets"], "defense_evasion": ["defense_evasion", "evasion_signals"]}

# Points per item and cap of each deduction.
DEDUCTIONS = {
    "chains": (3, 18), "persistence": (2, 10), "priv_esc": (3, 12), "credential": (3, 12), "defense_evasion": (2, 10),
    "lateral_move": (2, 10), "collection": (2, 8), "c2_beacon": (3, 12), "alerts": (3, 12), "warnings": (1, 6),
}
RISK_INPUTS = ["download", "drop", "execute", "outbound", "persistence", "priv_esc", "credential", "defense_evasion",
               "lateral_move", "collection", "c2_beacon", "chains", "alerts", "veto_alerts", "warnings"]


def behavior_counts(segs: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Counts per skill that the risk assessment needs.

    Every point lies in one segment, so points, chains and alerts are one aggregate over the segments,
    which combines before its only shuffle.
    """
    alerts = _alert_tests(ALERT_PAIRS)
    seen = {name: F.coalesce(F.bool_or(cond), F.lit(False)).cast("long") for name, cond in alerts.items()}
    total = lambda names: sum((seen[n] for n in names), F.lit(0).cast("long"))
    out = segs.groupBy("skill_id").agg(
        *[F.coalesce(F.sum(F.col("cats")[c]["n"]), F.lit(0)).alias(c) for c in P.BEHAVIOR_CATEGORIES],
        F.count_if(F.col("n_categories") >= 2).alias("chains"), total(alerts).alias("alerts"), total(VETO_ALERTS).alias("veto_alerts"))
    if warnings is None:
        return out.select("skill_id", *[F.lit(0).cast("long").alias(c) if c == "warnings" else c for c in RISK_INPUTS])
    out = out.unionByName(warnings.groupBy("skill_id").agg(F.count_distinct("warning").alias("warnings")), allowMissingColumns=True)
    return out.groupBy("skill_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in RISK_INPUTS])


def behavior_risk(counts: DataFrame) -> DataFrame:
    """Capped deductions and the veto from category pairs or high-signal alerts."""
    ded = None
    for c, (per, cap) in DEDUCTIONS.items():
        term = F.least(F.col(c) * per, F.lit(cap))
        ded = term if ded is None else ded + term
    has = lambda c: F.col(c) > 0
    veto = (
        (has("priv_esc") & (has("execute") | has("chains"))) | (has("credential") & has("outbound"))
        | (has("defense_evasion") & has("execute")) | (has("lateral_move") & (has("c2_beacon") | has("execute")))
        | (has("collection") & has("outbound")) | (has("c2_beacon") & has("execute")) | has("veto_alerts")
    )
    return counts.select("*", ded.alias("deduction"), veto.alias("veto"), (100 - F.least(ded, F.lit(100))).alias("ics"))


def moderate_signals(counts: DataFrame) -> Column:
    """Alerts, chains, warnings next to real evidence, or any of four sensitive categories."""
    c = lambda n: counts[n] > 0
    return (c("alerts") | c("chains") | (c("warnings") & (c("execute") | c("outbound") | c("credential")))
            | c("credential") | c("priv_esc") | c("c2_beacon") | c("collection"))


def evasion_assessment(skills: DataFrame, signals: DataFrame) -> DataFrame:
    """Any signal -> detected, critical; otherwise low."""
    n = signals.groupBy("skill_id").agg(F.count("*").alias("n_signals"))
    return skills.select("skill_id").join(n, "skill_id", "left").select(
        "skill_id", F.coalesce("n_signals", F.lit(0)).alias("n_signals"), F.col("n_signals").isNotNull().alias("detected"),
        F.when(F.col("n_signals").isNotNull(), F.lit("critical")).otherwise(F.lit("low")).alias("severity"))
