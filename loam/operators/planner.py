"""Signals to decisions to a plan. One row of signals, a handful of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.health import agent_status

AUTO_SAFE = ("delete_duplicates", "delete_empty_chunks", "enrich_metadata", "normalize_paths", "no_action")
SEVERITIES = ("critical", "high", "medium", "low")
SIGNALS = "health_score double, quality_score double, quality_issues long, total_chunks long, duplicate_count long, duplicate_ratio double, validation_errors long, validation_pass_rate double, stale_count long, expired_count long, freshness_score double"


def signals(health: DataFrame, quality: DataFrame, dedup: DataFrame, validation: DataFrame, freshness: DataFrame) -> DataFrame:
    """The one row that decisions rest on, from one-row frames; each signal is computed once."""
    row = health.select(F.col("overall").alias("health_score"))
    row = row.crossJoin(quality.select(F.col("overall").alias("quality_score"), F.col("issues").cast("long").alias("quality_issues"), F.col("total").alias("total_chunks")))
    row = row.crossJoin(dedup.select("duplicate_count", "duplicate_ratio"))
    row = row.crossJoin(validation.select(F.col("errors").alias("validation_errors"), F.col("pass_rate").alias("validation_pass_rate")))
    return row.crossJoin(freshness.select("stale_count", "expired_count", F.col("avg_freshness").alias("freshness_score")))


def decisions(signal: DataFrame) -> DataFrame:
    """(seq, decision_type, severity, confidence, trigger) of the rules that fire; no_action if none does."""
    dup, issues, quality = F.col("duplicate_count"), F.col("quality_issues"), F.col("quality_score")
    expired, stale, errors = F.col("expired_count"), F.col("stale_count"), F.col("validation_errors")
    make = lambda seq, kind, severity, confidence, trigger: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("decision_type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(confidence).alias("confidence"), trigger.alias("trigger"))
    high = lambda n: F.when(n > 10, "high").otherwise("medium")
    fired = F.array_compact(
        F.array(
            F.when(dup > 0, make(1, "delete_duplicates", high(dup), 0.99, F.format_string("%d exact duplicates", dup))),
            F.when((issues > 0) & (quality < 0.7), make(2, "delete_empty_chunks", "high", 0.95, F.format_string("%d quality issues", issues))),
            F.when(expired > 0, make(3, "delete_expired", "medium", 0.90, F.format_string("%d expired assets", expired))),
            F.when(stale > 5, make(4, "schedule_review", "low", 0.80, F.format_string("%d stale assets", stale))),
            F.when(errors > 0, make(5, "quarantine", high(errors), 0.85, F.format_string("%d validation errors", errors))),
        )
    )
    idle = F.array(make(6, "no_action", "low", 1.0, F.lit("Nothing to do")))
    return signal.select(F.inline(F.when(F.size(fired) > 0, fired).otherwise(idle)))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1, F.lit(3))


def ordered(decided: DataFrame) -> DataFrame:
    """Most severe first, then most confident."""
    return decided.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "seq")


def auto_safe(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision_type").isin(*AUTO_SAFE))


def needs_approval(decided: DataFrame) -> DataFrame:
    return decided.where(~F.col("decision_type").isin(*AUTO_SAFE))


def critical(decided: DataFrame) -> DataFrame:
    return decided.where("severity = 'critical'")


def messages(decided: DataFrame) -> DataFrame:
    return decided.withColumn("message", F.format_string("[%s] %s (confidence %d%%): %s", F.upper("severity"), "decision_type", F.round(F.col("confidence") * 100).cast("int"), "trigger"))


def action_plan(decided: DataFrame, signal: DataFrame) -> DataFrame:
    """One row: how many decisions by severity and kind, the estimated improvement, whether to execute at once (health below 0.5), and an id made from the content."""
    level = lambda s: F.count_if(F.col("severity") == s).alias(s)
    acts = F.count_if(F.col("decision_type") != "no_action")
    plan = decided.agg(
        F.count(F.lit(1)).alias("decisions"),
        *(level(s) for s in SEVERITIES),
        F.count_if(F.col("decision_type").isin(*AUTO_SAFE)).alias("auto_executable"),
        F.count_if(~F.col("decision_type").isin(*AUTO_SAFE)).alias("needs_approval"),
        F.least(F.lit(0.3), acts * 0.05).alias("estimated_improvement"),
        F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "trigger")))).cast("binary")).alias("_key"),
    )
    return plan.crossJoin(signal.select("health_score")).select(F.concat(F.lit("plan_"), F.substring("_key", 1, 8)).alias("plan_id"), "decisions", *SEVERITIES, "auto_executable", "needs_approval", "estimated_improvement", (F.col("health_score") < 0.5).alias("auto_execute"))


def governance_state(signal: DataFrame, trend: DataFrame) -> DataFrame:
    """One row for other programs: health, its trend, the scores and what needs doing."""
    return signal.crossJoin(trend).select(
        "health_score",
        agent_status(F.col("health_score")).alias("status"),
        "trend",
        "quality_score",
        (1 - F.col("duplicate_ratio")).alias("uniqueness"),
        "freshness_score",
        "validation_pass_rate",
        (F.col("duplicate_count") > 0).alias("needs_dedup"),
        (F.col("expired_count") > 0).alias("needs_cleanup"),
        (F.col("stale_count") > 5).alias("needs_review"),
        (F.col("validation_errors") > 0).alias("needs_repair"),
    )


def should_run(cycles: DataFrame, as_of: Column) -> DataFrame:
    """(run): without a cycle yet, 6 hours after the last, or 1 hour after one of health below 0.6."""
    last = cycles.agg(F.max("ts").alias("ts"), F.max_by("health_score", "ts").alias("health"))
    hours = F.timestamp_diff("SECOND", F.col("ts"), as_of) / 3600
    return last.select((F.col("ts").isNull() | (hours >= 6) | ((F.col("health") < 0.6) & (hours >= 1))).alias("run"))
