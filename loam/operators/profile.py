"""Quality profiles of chunks, documents and whole knowledge bases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as T


def null_ratio(value: Column, is_string: bool = True) -> Column:
    """The share of NULL and empty values; 1 for no rows at all. An aggregate."""
    bad = value.isNull() | (value == "") if is_string else value.isNull()
    return F.coalesce(F.try_divide(F.count_if(bad).cast("double"), F.count(F.lit(1))), F.lit(1.0))


def duplicate_ratio(value: Column) -> Column:
    """1 - distinct / all, NULL being a value; 0 for no rows. An aggregate."""
    return F.coalesce(1 - F.try_divide(F.count_distinct(F.struct(value)).cast("double"), F.count(F.lit(1))), F.lit(0.0))


def chunk_features(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One projection of what the profile, the problems, validation and health need of each chunk."""
    x = T.text("content")
    return chunks.withColumns(
        {
            "length": F.length(x),
            "strip_length": F.length(T.strip(x)),
            "gibberish": T.gibberish_score(x),
            "raw_hash": F.md5(x.cast("binary")),
        }
    )


def chunk_profile(chunks: DataFrame, by: Sequence[str] = (), config: Config = DEFAULT, how: str = "groupBy") -> DataFrame:
    """The scores of a set of chunks, per group: completeness, uniqueness, validity, consistency, their mean and what they rest on.

    One aggregation of a narrow projection: texts stay in the scan's tasks, and what is
    shuffled are the distinct hashes and sources, combined before. how: groupBy, cube or
    rollup. No rows and no grouping give one row of zeros.
    """
    f = chunk_features(chunks, config).withColumn("source_", F.coalesce(F.col("metadata")["source"], F.lit("unknown")))
    grouped = getattr(f, how)(*by) if by else f.groupBy()
    n = F.count(F.lit(1))
    filled = F.when(F.col("length") > 0, F.col("length"))
    # population variance from whole sums, which are exact in any order
    total, squares, k = F.sum(filled), F.sum(filled.cast("decimal(20,0)") * filled), F.count(filled)
    sums = grouped.agg(
        n.alias("total"),
        F.count_if(F.col("strip_length") == 0).alias("empty_count"),
        F.count_if((F.col("length") > 0) & (F.col("strip_length") < config.min_chunk_length)).alias("short_count"),
        F.count_distinct("raw_hash").alias("unique_count"),
        F.avg("gibberish").alias("avg_gibberish"),
        F.max("gibberish").alias("max_gibberish"),
        k.alias("_k"),
        total.alias("_sum"),
        squares.cast("double").alias("_squares"),
        F.min(filled).alias("min_length"),
        F.max(filled).alias("max_length"),
        F.count_distinct("source_").alias("unique_sources"),
    )
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("_k"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_squares"), F.col("_k")) - mean * mean))
    rows = F.col("total")
    scored = sums.select(
        *by,
        "total",
        "empty_count",
        "short_count",
        "unique_count",
        (rows - F.col("unique_count")).alias("duplicate_count"),
        F.coalesce("avg_gibberish", F.lit(0.0)).alias("avg_gibberish"),
        F.coalesce("max_gibberish", F.lit(0.0)).alias("max_gibberish"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_length"),
        F.coalesce(std, F.lit(0.0)).alias("std_length"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"),
        "unique_sources",
        F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.col("empty_count") + F.col("short_count") * 0.5, rows), F.lit(0.0))).alias("completeness"),
        F.coalesce(F.try_divide(F.col("unique_count").cast("double"), rows), F.lit(0.0)).alias("uniqueness"),
        F.coalesce(1 - F.col("avg_gibberish"), F.lit(0.0)).alias("validity"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - std / mean), F.lit(0.0)).alias("consistency"),
    )
    dims = [F.col(c) for c in ("completeness", "uniqueness", "validity", "consistency")]
    issues = sum((F.when(d < 0.8, 1).otherwise(0) for d in dims), F.lit(0))
    return scored.withColumns({"overall": sum(dims, F.lit(0.0)) / 4, "issues": F.when(rows > 0, issues).otherwise(0)})


def chunk_recommendations(profile: DataFrame) -> DataFrame:
    """The profile with advice that follows from its numbers."""
    advice = [
        F.when(F.col("total") == 0, F.lit("Nothing to profile")),
        F.when(F.col("empty_count") > 0, F.format_string("Drop %d empty chunks", "empty_count")),
        F.when(F.col("duplicate_count") > 0, F.format_string("Drop %d duplicate chunks", "duplicate_count")),
        F.when((F.col("total") > 0) & (F.col("validity") < 0.7), F.lit("Look for encoding damage")),
        F.when((F.col("total") > 0) & (F.col("consistency") < 0.6), F.lit("Even out chunk sizes")),
    ]
    return profile.withColumn("recommendations", F.array_compact(F.array(*advice)))


def chunk_problems(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ordinal, chunk_id, problem, length, score, duplicate_of), one row for each problem of a chunk.

    Blank chunks are 'empty' and nothing else. The first chunk with a text is the one that
    later ones duplicate.
    """
    f = chunk_features(chunks, config)
    full = F.col("strip_length") > 0
    first = F.first("chunk_id").over(Window.partitionBy("raw_hash").orderBy("ordinal"))
    rank = F.row_number().over(Window.partitionBy("raw_hash").orderBy("ordinal"))
    f = f.select("ordinal", "chunk_id", "strip_length", "gibberish", F.when(full & (rank > 1), first).alias("first_id"))
    kind = lambda test, name, **values: F.when(test, F.struct(F.lit(name).alias("problem"), *(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("length", "int"), ("score", "double"), ("duplicate_of", "string")))))
    found = F.array_compact(
        F.array(
            kind(~full, "empty"),
            kind(full & (F.col("strip_length") < config.min_chunk_length), "too_short", length=F.col("strip_length")),
            kind(full & (F.col("strip_length") > config.max_chunk_length), "too_long", length=F.col("strip_length")),
            kind(full & (F.col("gibberish") > config.gibberish_above), "gibberish", score=F.col("gibberish")),
            kind(F.col("first_id").isNotNull(), "duplicate", duplicate_of=F.col("first_id")),
        )
    )
    return f.select("ordinal", "chunk_id", F.inline(found))


def document_profile(docs: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """(path, completeness, validity, timeliness, overall, issues, ...) of each document. docs: path, content, mtime.

    An unknown mtime has timeliness 0.5.
    """
    x = T.text("content")
    timeliness = F.coalesce(T.freshness_score(T.age_days(F.col("mtime"), as_of), config.stale_threshold_days), F.lit(0.5))
    scored = docs.select(
        "path",
        F.length(x).alias("length"),
        T.word_count(x).alias("word_count"),
        T.is_blank(x).alias("blank"),
        T.completeness_score(x, config.min_chunk_length).alias("completeness"),
        (1 - T.gibberish_score(x)).alias("validity"),
        timeliness.alias("timeliness"),
    )
    dims = [F.col(c) for c in ("completeness", "validity", "timeliness")]
    advice = [
        F.when(F.col("completeness") < 0.5, F.lit("Too short or empty")),
        F.when(F.col("validity") < 0.7, F.lit("Encoding damage likely")),
        F.when(F.col("timeliness") < 0.3, F.lit("Stale")),
        F.when(F.col("blank"), F.lit("Without content")),
    ]
    return scored.withColumns(
        {"overall": sum(dims, F.lit(0.0)) / 3, "issues": sum((F.when(d < 0.8, 1).otherwise(0) for d in dims), F.lit(0)), "recommendations": F.array_compact(F.array(*advice))}
    ).drop("blank")


def name_consistency(names: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: how far the base names of files and of the store's sources agree (Jaccard; both empty: 1)."""
    a = names.select(T.basename(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("in_files", F.lit(True))
    b = sources.select(T.basename(F.col("source")).alias("name")).where("name <> ''").distinct().withColumn("in_store", F.lit(True))
    both = a.join(b, "name", "full_outer")
    return both.agg(
        F.count_if(F.col("in_files") & F.col("in_store")).alias("overlap"),
        F.count_if(F.col("in_store").isNull()).alias("orphan_files"),
        F.count_if(F.col("in_files").isNull()).alias("orphan_sources"),
        F.count(F.lit(1)).alias("names"),
    ).select("overlap", "orphan_files", "orphan_sources", F.coalesce(F.try_divide(F.col("overlap").cast("double"), F.col("names")), F.lit(1.0)).alias("score"))


def orphans(left: DataFrame, right: DataFrame, key: str = "name", limit: int | None = 20) -> DataFrame:
    """Names of the left side that the right side lacks, in order; limit caps a report."""
    only = left.select(T.basename(F.col(key)).alias("name")).distinct().join(right.select(T.basename(F.col(key)).alias("name")).distinct(), "name", "left_anti").orderBy("name")
    return only.limit(limit) if limit else only


def knowledge_base_profile(docs: DataFrame, chunks: DataFrame | None, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """(dimension, score) rows and the items, issues and mean over them, of documents and, if given, their chunks in the store."""
    profiles = document_profile(docs, as_of, config)
    one = profiles.agg(F.count(F.lit(1)).alias("n"), F.avg("overall").alias("d_overall"), F.avg("timeliness").alias("d_timeliness"), F.coalesce(F.sum("issues"), F.lit(0)).alias("d_issues"))
    row = lambda name, score, items=0, issues=0: F.struct(F.lit(name).alias("dimension"), score.alias("score"), *((v if isinstance(v, Column) else F.lit(v)).cast("long").alias(k) for k, v in (("items", items), ("issues", issues))))
    some = F.col("n") > 0
    rows = [row("completeness", F.coalesce("d_overall", F.lit(0.0)), F.col("n"), F.col("d_issues"))]
    if chunks is not None:
        c = chunk_profile(chunks, config=config).select("uniqueness", "validity", F.col("total").alias("c_total"), F.col("issues").alias("c_issues"))
        same = name_consistency(docs.select(F.col("path").alias("name")), chunks.select(F.col("metadata")["source"].alias("source"))).select(F.col("score").alias("same"))
        one = one.crossJoin(c).crossJoin(same)
        rows += [row("uniqueness", F.col("uniqueness"), F.col("c_total"), F.col("c_issues")), row("validity", F.col("validity")), F.when(some, row("consistency", F.col("same"), 0, F.when(F.col("same") < 0.8, 1).otherwise(0)))]
    rows.append(F.when(some, row("timeliness", F.col("d_timeliness"))))
    return one.select(F.inline(F.array_compact(F.array(*rows))))  # one row of sums: texts are scanned once for documents and once for chunks


def merged_recommendations(profiles: DataFrame, order: str = "path") -> DataFrame:
    """(recommendation, first, n): each text once, in the order of its first row and its place there."""
    each = profiles.select(order, F.posexplode("recommendations").alias("at", "recommendation"))
    merged = each.groupBy("recommendation").agg(F.min(F.struct(order, "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    return merged.orderBy("first").select("recommendation", F.col(f"first.{order}").alias("first"), "n")


def overall_of(dimensions: DataFrame) -> DataFrame:
    return dimensions.agg(F.avg("score").alias("overall"), F.sum("items").alias("items"), F.sum("issues").alias("issues"))
