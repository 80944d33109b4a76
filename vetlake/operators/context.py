"""Context-window rules: action words on a line, control words within ± radius lines.

Windows are sliced from the file's own line array, so a huge file is the only unit that
must fit one task (it is one row already) and no window shuffle is planned.  Decisions at
skill level are partial aggregates joined back, never a window over a whole skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_low_signal_path
from ..functions.text import LICENSE_WORDS, all_of, code_window, has_any, is_code_line, is_license_config, is_log_only_line, let, matches
from . import packs as P
from .scan import analysis_text


def _actions(rule: P.ContextRule, low: Column) -> Column:
    return all_of(has_any(low, group) for group in rule.action)


def _over_lines(text: Column, code, keep) -> Column:
    """Array of verdict structs for the 1-based line numbers that pass ``code``.

    The split lines are bound once (``let``): referring to a column would let the optimizer
    copy the split into every step of the lambda.
    """
    def body(lines: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: code(lines, i))
        return F.transform(numbers, lambda i: keep(lines, i))

    return let(F.split(text, "\n", -1), body)


def context_hits(files: DataFrame, rule: P.ContextRule) -> DataFrame:
    """Action lines with their window verdicts: skill_id, path, line_no, guarded, scoped."""
    text = analysis_text(files) if rule.analysis else F.col("content")
    # whole-content guard: each word group must occur somewhere in the file
    src = files.select("skill_id", "path", text.alias("_text")).where(_actions(rule, F.lower("_text")))

    def is_action(lines: Column, i: Column) -> Column:
        line = F.get(lines, i - 1)
        ok = _actions(rule, F.lower(line)) & is_code_line(line)
        if rule.skip_log_only:
            ok = ok & ~is_log_only_line(line)
        if rule.window_required:
            ok = ok & has_any(F.lower(code_window(lines, i, rule.radius)), rule.window_required)
        return ok

    def verdict(lines: Column, i: Column) -> Column:
        window = F.lower(code_window(lines, i, rule.radius))
        scope_text = window if rule.scope_in_window else F.lower(F.get(lines, i - 1))
        return F.struct(i.alias("line_no"), has_any(window, rule.control).alias("guarded"), has_any(scope_text, rule.scope).alias("scoped"))

    return src.select("skill_id", "path", F.inline(_over_lines(F.col("_text"), is_action, verdict)))


def scan_context(files: DataFrame, rule: P.ContextRule) -> DataFrame:
    """Findings of one three-stage rule.

    One guarded action line clears the whole skill; otherwise every action line is a
    finding.  Where the rule has a scoped severity, it applies from the first scoped line
    (path, line order) onwards.
    """
    # The hits are shuffled once under a common key; both uses below read that exchange.
    hits = context_hits(files, rule).repartition("skill_id", "path")
    verdicts = hits.groupBy("skill_id").agg(
        F.bool_or("guarded").alias("skill_guarded"),
        F.min(F.when(F.col("scoped"), F.struct("path", "line_no"))).alias("first_scoped"),
    )
    j = hits.join(verdicts, "skill_id").where(~(F.col("guarded") | F.col("skill_guarded")))
    # scoped severity is sticky: this line or an earlier one was scoped
    sticky = F.coalesce(F.struct("path", "line_no") >= F.col("first_scoped"), F.lit(False))
    sev = F.when(sticky, F.lit(rule.scoped_severity)).otherwise(F.lit(rule.severity)) if rule.scoped_severity else F.lit(rule.severity)
    factor = F.when(F.col("first_scoped").isNotNull(), F.lit(rule.factor_scoped)).otherwise(F.lit(rule.factor_plain))
    return j.select("skill_id", "path", "line_no", F.lit(rule.rule_id).alias("rule_id"), sev.alias("severity"),
                    F.lit(rule.key).alias("label"), factor.alias("score_factor"))


def license_config(files: DataFrame) -> DataFrame:
    """License checks with a local server, a bypass branch or a fixed result (first case wins)."""
    text = F.col("content")
    src = files.where(~is_low_signal_path(F.col("path")))
    src = src.where(has_any(F.lower(text), LICENSE_WORDS) | matches(text, P.LICENSE_FIXED_RX))

    def case(lines: Column, i: Column) -> Column:
        w = F.lower(code_window(lines, i, 2))
        candidate = is_license_config(w)
        label = (
            F.when(candidate & matches(w, P.LICENSE_LOCAL_RX), F.lit("local or plain license server"))
            .when(candidate & matches(w, P.LICENSE_BYPASS_RX), F.lit("license failure bypass"))
            .when(matches(w, P.LICENSE_FIXED_RX), F.lit("license check fixed to success"))
        )
        return F.struct(i.alias("line_no"), label.alias("label"))

    cells = _over_lines(text, lambda lines, i: is_code_line(F.get(lines, i - 1)), case)
    hits = F.filter(cells, lambda s: s["label"].isNotNull())
    return src.select("skill_id", "path", F.inline(hits)).select(
        "skill_id", "path", "line_no", F.lit("V7-005").alias("rule_id"), F.lit("high").alias("severity"), "label")


def cors_wildcard(files: DataFrame) -> DataFrame:
    """First window per file allowing any origin together with credentials and no allow list."""
    text = analysis_text(files)
    src = files.where(~is_low_signal_path(F.col("path"))).select("skill_id", "path", text.alias("_text"))
    src = src.where(matches(F.col("_text"), P.CORS_CREDENTIALS_RX) & matches(F.col("_text"), P.CORS_WILDCARD_RX))

    def risky(lines: Column, i: Column) -> Column:
        w = code_window(lines, i, 4)
        return (is_code_line(F.get(lines, i - 1)) & matches(w, P.CORS_WILDCARD_RX) & matches(w, P.CORS_CREDENTIALS_RX)
                & ~matches(w, P.CORS_GUARD_RX))

    hits = _over_lines(F.col("_text"), risky, lambda _, i: i)
    return src.select("skill_id", "path", F.try_element_at(hits, F.lit(1)).alias("line_no")).where("line_no is not null").select(
        "skill_id", "path", "line_no", F.lit("V7-023").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("cors wildcard with credentials").alias("label"))
