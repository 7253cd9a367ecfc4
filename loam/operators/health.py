"""Weighted health scores, alerts and trends. Frames here have a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import clamp

WEIGHTS = {"Data Quality": 0.35, "Validation": 0.25, "Uniqueness": 0.20, "Freshness": 0.20}


def health_components(quality: DataFrame | None = None, validation: DataFrame | None = None, dedup: DataFrame | None = None, freshness: DataFrame | None = None) -> DataFrame:
    """(name, score, weight): one row for each given one-row frame.

    quality: overall; validation: total, passed (without results absent); dedup:
    duplicate_ratio; freshness: avg_freshness. At least one must be given.
    """
    parts = []
    row = lambda df, name, score: df.select(F.lit(name).alias("name"), score.cast("double").alias("score"), F.lit(WEIGHTS[name]).alias("weight"))
    if quality is not None:
        parts.append(row(quality, "Data Quality", F.col("overall")))
    if validation is not None:
        parts.append(row(validation.where("total > 0"), "Validation", F.col("passed") / F.col("total")))
    if dedup is not None:
        parts.append(row(dedup, "Uniqueness", 1 - F.col("duplicate_ratio")))
    if freshness is not None:
        parts.append(row(freshness, "Freshness", F.col("avg_freshness")))
    if not parts:
        raise ValueError("give at least one component")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("score", clamp(F.col("score")))


def status(x: Column) -> Column:
    return F.when(x >= 0.8, "healthy").when(x >= 0.6, "warning").otherwise("critical")


def agent_status(x: Column) -> Column:
    """The four-step scale of the planner."""
    return F.when(x >= 0.8, "healthy").when(x >= 0.6, "degraded").when(x >= 0.4, "unhealthy").otherwise("critical")


def health_score(components: DataFrame) -> DataFrame:
    """(overall, status): weights are shared out among the components that are there; without any 0 and 'unknown'."""
    return components.agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("o")).select(F.coalesce("o", F.lit(0.0)).alias("overall"), F.when(F.col("o").isNull(), "unknown").otherwise(status(F.col("o"))).alias("status"))


ALERT = ("kind", "level", "title", "message", "source")


def _alerts(df: DataFrame, *alerts: Column) -> DataFrame:
    """Long rows from conditional structs, with an id made of what and when: the same check at the same time alerts once."""
    rows = df.select("as_of", F.inline(F.array_compact(F.array(*alerts))))
    return rows.select(F.concat("kind", F.lit("_"), F.substring(F.md5(F.concat_ws("|", "kind", F.col("as_of").cast("string")).cast("binary")), 1, 12)).alias("id"), *ALERT, "as_of")


def _alert(test: Column, kind: Column | str, level: Column | str, title: Column | str, message: Column, source: str) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(test, F.struct(as_column(kind).alias("kind"), as_column(level).alias("level"), as_column(title).alias("title"), message.alias("message"), F.lit(source).alias("source")))


def health_alerts(score: DataFrame, components: DataFrame, as_of: Column, threshold: float = 0.6) -> DataFrame:
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    whole = _alerts(score.withColumn("as_of", as_of), _alert(F.col("overall") < threshold, "health", F.when(F.col("overall") < 0.4, "critical").otherwise("warning"), "Health below the threshold", F.concat(F.lit("Health is "), percent(F.col("overall")), F.lit(f", the threshold {threshold:.1%}")), "health"))
    each = _alerts(components.withColumn("as_of", as_of), _alert(F.col("score") < 0.5, F.concat(F.lit("component_"), "name"), "warning", F.concat(F.lit("Low score: "), "name"), F.concat("name", F.lit(" is at "), percent(F.col("score"))), "health"))
    return whole.unionByName(each)


def freshness_alerts(summary: DataFrame, as_of: Column) -> DataFrame:
    """summary: total, stale_count, expired_count."""
    return _alerts(
        summary.withColumn("as_of", as_of),
        _alert(F.col("expired_count") > 0, "freshness_expired", "warning", "Expired data", F.format_string("%d of %d assets have expired", "expired_count", "total"), "freshness"),
        _alert(F.col("stale_count") > F.col("total") * 0.3, "freshness_stale", "warning", "Many stale assets", F.format_string("%d of %d assets are stale", "stale_count", "total"), "freshness"),
    )


def dedup_alerts(stats: DataFrame, as_of: Column) -> DataFrame:
    return _alerts(stats.withColumn("as_of", as_of), _alert((F.col("total_items") > 0) & (F.col("duplicate_ratio") > 0.1), "dedup", "warning", "Many duplicates", F.format_string("%d of %d items are duplicates", "duplicate_count", "total_items"), "dedup"))


def with_state(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({"acknowledged": F.lit(False), "resolved": F.lit(False)})


def active(alerts: DataFrame) -> DataFrame:
    """Alerts that aren't resolved, acknowledged ones among them."""
    return alerts.where("NOT resolved")


def update_alert(alerts: DataFrame, alert_id: str, acknowledged: bool | None = None, resolved: bool | None = None) -> DataFrame:
    """A new snapshot with the alert's state changed."""
    here = F.col("id") == alert_id
    changed = {k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in (("acknowledged", acknowledged), ("resolved", resolved)) if v is not None}
    return alerts.withColumns(changed) if changed else alerts


def alert_summary(alerts: DataFrame) -> DataFrame:
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    return active(alerts).agg(F.count(F.lit(1)).alias("total"), level("critical"), level("warning"), level("info"))


def trend(cycles: DataFrame, last: int = 5) -> DataFrame:
    """(trend) from the newest cycles (ts, health_score): a change beyond 0.05 over them; fewer than two: unknown."""
    newest = cycles.orderBy(F.desc("ts")).limit(last)
    return newest.agg(F.count(F.lit(1)).alias("n"), (F.max_by("health_score", "ts") - F.min_by("health_score", "ts")).alias("change")).select(F.when(F.col("n") < 2, "unknown").when(F.col("change") > 0.05, "improving").when(F.col("change") < -0.05, "degrading").otherwise("stable").alias("trend"))
