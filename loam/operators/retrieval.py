"""Quality in chunk metadata, and retrieval that heeds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as T


def embed_quality(chunks: DataFrame, as_of: Column, files: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Chunks with typed columns quality_score, gibberish_score, char_count, content_hash, is_quarantined, freshness_score, governance_ts.

    Scores are rounded to 3 digits; what is quarantined is decided before rounding. Blank
    chunks have score 0, are quarantined and have NULL in the others. Freshness is that of
    the source's file (files: path, mtime), 0.5 where it is missing and NULL without a
    source. Typed columns, not map entries, so that filters reach the Parquet scan. Each text
    is measured once, in a projection of its own.
    """
    x = T.text("content")
    measured = chunks.withColumns({"_gibberish": T.gibberish_score(x), "_stripped": F.length(T.strip(x)), "_density": T.char_density(x)})
    blank, gibberish = F.col("_stripped") == 0, F.col("_gibberish")
    measured = measured.withColumn("_quality", T.quality_of(blank, gibberish, F.col("_stripped"), F.col("_density"), config.min_chunk_length))
    quality = F.col("_quality")
    out = measured.withColumns(
        {
            "quality_score": F.round(quality, 3),
            "gibberish_score": F.when(~blank, F.round(gibberish, 3)),
            "char_count": F.when(~blank, F.length(x)),
            "content_hash": F.when(~blank, F.md5(x.cast("binary"))),
            "is_quarantined": blank | (quality < config.quarantine_below),
            "governance_ts": as_of,
        }
    ).drop("_gibberish", "_stripped", "_density", "_quality")
    source = F.col("metadata")["source"]
    if files is None:
        return out.withColumn("freshness_score", F.when(F.coalesce(source, F.lit("")) != "", F.lit(0.5)))
    times = files.groupBy(F.col("path").alias("_path")).agg(F.max("mtime").alias("_mtime"))
    out = out.join(times, source == F.col("_path"), "left")
    fresh = F.coalesce(F.round(T.freshness_score(T.age_days(F.col("_mtime"), as_of), config.stale_threshold_days), 3), F.lit(0.5))
    return out.withColumn("freshness_score", F.when(F.coalesce(source, F.lit("")) != "", fresh)).drop("_path", "_mtime")


def quality_summary(chunks: DataFrame) -> DataFrame:
    """One row over embedded chunks: coverage, average, least and most, quarantine rate and four buckets of scores."""
    q, n = F.col("quality_score"), F.count(F.lit(1))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), n), F.lit(0.0))
    return chunks.agg(
        n.alias("total"),
        share(F.col("governance_ts").isNotNull()).alias("coverage"),
        F.avg(q).alias("avg_quality"),
        F.min(q).alias("min_quality"),
        F.max(q).alias("max_quality"),
        share(F.coalesce("is_quarantined", F.lit(False))).alias("quarantine_rate"),
        F.count_if(q >= 0.8).alias("excellent"),
        F.count_if((q >= 0.6) & (q < 0.8)).alias("good"),
        F.count_if((q >= 0.3) & (q < 0.6)).alias("fair"),
        F.count_if(q < 0.3).alias("poor"),
    )


def retrieval_filter(results: DataFrame, min_quality: float = 0.3, exclude_quarantined: bool = True) -> DataFrame:
    """Results of enough quality; a missing score passes."""
    ok = F.coalesce(F.col("quality_score"), F.lit(1.0)) >= min_quality
    if exclude_quarantined:
        ok = ok & ~F.coalesce(F.col("is_quarantined"), F.lit(False))
    return results.where(ok)


def search_gate(results: DataFrame, min_quality: float = 0.3, exclude_quarantined: bool = True) -> DataFrame:
    """(query_id, original, kept, removed) of each query's results."""
    ok = F.coalesce(F.col("quality_score"), F.lit(1.0)) >= min_quality
    if exclude_quarantined:
        ok = ok & ~F.coalesce(F.col("is_quarantined"), F.lit(False))
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("original"), F.count_if(ok).alias("kept")).withColumn("removed", F.col("original") - F.col("kept"))


def noise_chunks(chunks: DataFrame, min_length: int = 10) -> DataFrame:
    return chunks.where(F.length(T.strip(F.col("content"))) < min_length)


def quarantine_set(chunks: DataFrame, above: float = 0.3) -> DataFrame:
    """Blank and gibberish chunks, tagged with the reason; deleting them is up to the caller."""
    x = T.text("content")
    tagged = chunks.withColumn("reason", F.when(T.is_blank(x), "empty").when(T.gibberish_score(x) > above, "gibberish"))
    return tagged.where("reason IS NOT NULL")


def ingest_gate(profiles: DataFrame, at_least: float = 0.3) -> DataFrame:
    return profiles.withColumn("verdict", F.when(F.col("overall") >= at_least, "ingest").otherwise("reject"))
