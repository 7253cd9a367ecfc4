"""Time-to-live policies and freshness scores. The clock is an argument everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as T

POLICY = "category string, ttl_days int, stale_days int, action string"


def default_policies(config: Config = DEFAULT) -> list[tuple[str, int | None, int | None, str]]:
    short, web = config.short_term_ttl_days, config.web_cache_ttl_days
    return [
        ("short_term", short, short // 2, "archive"),
        ("web_cache", web, web // 2, "delete"),
        ("long_term", None, config.long_term_review_days, "review"),
        ("chat_history", 180, config.stale_threshold_days // 2, "archive"),
        ("memory", None, config.stale_threshold_days, "review"),
    ]


def policies(spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    return spark.createDataFrame(default_policies(config), POLICY)


def exceeded(age: Column, days: Column) -> Column:
    """Strictly older; a NULL age or limit never is."""
    return F.coalesce(age > days, F.lit(False))


def freshness_records(assets: DataFrame, policy: DataFrame, as_of: Column, expires: bool = True) -> DataFrame:
    """assets (asset_id, category, updated_at, ...) with age_days, the policy's columns, is_stale, is_expired and freshness_score.

    The policy table has a row per category and is joined by broadcast. Without a policy or
    an update time an asset is fresh. Times in the future score above 1.
    """
    joined = assets.join(F.broadcast(policy), "category", "left")
    age = T.age_days(F.col("updated_at"), as_of)
    span = F.when(F.col("ttl_days") > 0, F.col("ttl_days")).when(F.col("stale_days") > 0, F.col("stale_days") * 2) if expires else F.when(F.col("stale_days") > 0, F.col("stale_days") * 2)
    return joined.withColumns(
        {
            "age_days": age,
            "is_stale": exceeded(age, F.col("stale_days")),
            "is_expired": exceeded(age, F.col("ttl_days")) if expires else F.lit(False),
            "freshness_score": F.when(age.isNull() | span.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / span)),
        }
    )


def memory_records(assets: DataFrame, policy: DataFrame, as_of: Column) -> DataFrame:
    """Notes go stale but never expire."""
    return freshness_records(assets.withColumn("category", F.lit("memory")), policy, as_of, expires=False)


def freshness_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_stale").alias("stale_count"), F.count_if("is_expired").alias("expired_count"), F.coalesce(F.avg("freshness_score"), F.lit(0.0)).alias("avg_freshness"))


def freshness_text(records: DataFrame, as_of: Column, limit: int = 1000) -> str:
    """The report as text: the summary, then stale and expired assets by id, at most `limit` of each listed."""
    top = freshness_summary(records).select("*", F.date_format(as_of, "yyyy-MM-dd HH:mm").alias("at")).first()
    parts = [f"Freshness Report ({top.at})\nTotal assets: {top.total}\nAverage freshness: {top.avg_freshness:.1%}\nStale: {top.stale_count} | Expired: {top.expired_count}"]
    for title, test in (("Stale", "is_stale"), ("Expired", "is_expired")):
        listed = records.where(test).orderBy("asset_id").limit(limit).collect()
        lines = [f"  - {r.asset_id} (age: {r.age_days:.0f}d" + (f", score: {r.freshness_score:.1%})" if title == "Stale" else ")") for r in listed]
        parts += ["\n".join([f"\n{title} assets:", *lines])] if lines else []
    return "\n".join(parts)


def stale_only(records: DataFrame) -> DataFrame:
    return records.where("is_stale AND NOT is_expired")


def expired(records: DataFrame) -> DataFrame:
    return records.where("is_expired")
