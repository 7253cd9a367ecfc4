"""Data passports: one row per asset with its scores, trust level and audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

RANKS = {"quarantined": 0, "suspect": 1, "unverified": 2, "trusted": 3, "verified": 4}
SCORES = ("quality_score", "freshness_score", "completeness_score", "validity_score", "uniqueness_score")


def trust_level(quality: Column, freshness: Column) -> Column:
    return F.when((quality >= 0.8) & (freshness >= 0.5), "verified").when(quality >= 0.6, "trusted").when(quality >= 0.3, "suspect").otherwise("quarantined")


def create_passports(assets: DataFrame, as_of: Column) -> DataFrame:
    """assets (seq, asset_id, content, source_type, source_path): one passport each; of an asset's several the last."""
    made = assets.groupBy("asset_id").agg(F.max_by(F.struct("content", "source_type", "source_path"), "seq").alias("a"))
    sha = T.short_sha256(F.col("a.content"))
    none = {s: F.lit(0.0) for s in SCORES}
    return made.select("asset_id", F.concat(F.lit("pp_"), sha).alias("passport_id"), sha.alias("content_hash"), F.col("a.source_type").alias("source_type"), F.col("a.source_path").alias("source_path"), as_of.alias("created_at")).withColumns(
        {**none, "trust_level": F.lit("unverified"), "assessment_count": F.lit(0), "last_assessed": F.lit(None).cast("timestamp_ntz"), "actions": F.array().cast("array<struct<action:string,agent_id:string,ts:timestamp_ntz,details:string>>")}
    )


def assess(passports: DataFrame, assessments: DataFrame, as_of: Column) -> DataFrame:
    """Passports with the given scores (asset_id and any of SCORES, one row each); assets without a passport are ignored.

    A score that is missing or NULL stays as it was. Unknown columns are an error before any row changes.
    """
    given = [c for c in assessments.columns if c != "asset_id"]
    if unknown := set(given) - set(SCORES):
        raise ValueError(f"unknown scores: {sorted(unknown)}")
    new = assessments.select("asset_id", F.lit(True).alias("_hit"), *(F.col(c).cast("double").alias(f"_{c}") for c in given))
    joined = passports.join(new, "asset_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given})
    out = out.withColumns({"trust_level": F.when(hit, trust_level(F.col("quality_score"), F.col("freshness_score"))).otherwise(F.col("trust_level")), "assessment_count": F.col("assessment_count") + F.when(hit, 1).otherwise(0), "last_assessed": F.when(hit, as_of).otherwise(F.col("last_assessed"))})
    return out.drop("_hit", *(f"_{c}" for c in given))


def record_action(passports: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (asset_id, action, agent_id, ts, details) appended to the audit trails, in order of time."""
    new = actions.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "action", "agent_id", "details"))), lambda x: F.struct(x["action"].alias("action"), x["agent_id"].alias("agent_id"), x["ts"].alias("ts"), x["details"].alias("details"))).alias("_new"))
    return passports.join(new, "asset_id", "left").withColumn("actions", F.concat("actions", F.coalesce("_new", F.array().cast("array<struct<action:string,agent_id:string,ts:timestamp_ntz,details:string>>")))).drop("_new")


def rank(level: Column) -> Column:
    return F.create_map(*(x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))))[level]


def trusted(passports: DataFrame, at_least: str = "trusted") -> DataFrame:
    return passports.where(rank(F.col("trust_level")) >= RANKS[at_least])


def quarantined(passports: DataFrame) -> DataFrame:
    return passports.where("trust_level = 'quarantined'")


def passport_of(passports: DataFrame, asset_id: str) -> DataFrame:
    return passports.where(F.col("asset_id") == asset_id)


def trust_histogram(passports: DataFrame) -> DataFrame:
    return passports.groupBy("trust_level").agg(F.count(F.lit(1)).alias("n"))


def passport_stats(passports: DataFrame) -> DataFrame:
    return passports.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.count_if(F.col("trust_level") == "quarantined").alias("quarantined"), F.count_if(F.col("trust_level") == "verified").alias("verified"), F.count_if(F.col("assessment_count") > 0).alias("assessed"))


def as_metadata(passports: DataFrame) -> DataFrame:
    """(asset_id, metadata): a flat map for storing with a chunk."""
    pairs = [x for c in ("passport_id", "trust_level", "quality_score", "freshness_score", "source_type", "assessment_count") for x in (F.lit(c), F.col(c).cast("string"))]
    return passports.select("asset_id", F.create_map(*pairs).alias("metadata"))


def as_context(passports: DataFrame) -> DataFrame:
    """(asset_id, line): one line of text for a prompt."""
    return passports.select("asset_id", F.format_string("[%s] trust=%s quality=%.2f freshness=%.2f source=%s", "asset_id", "trust_level", "quality_score", "freshness_score", F.coalesce("source_path", F.lit("unknown"))).alias("line"))
