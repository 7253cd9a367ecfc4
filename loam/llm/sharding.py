"""Operator 1: proportional stratified interleaving into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import pick, written

#: Rows of a range partition hold this number at its 33 low bits, as monotonically_increasing_id() makes it.
_LOCAL = 2**33


def _ranked(df: DataFrame, within: list[str], order: list[Column | str], to: str) -> DataFrame:
    """df with the rank from 0 of each row within its group, in the given order.

    A range sort numbers the rows of each partition, and a small table of the groups' counts
    by partition gives the offsets: no group has to fit one task, however large it is.
    """
    by = [*within, *order]
    numbered = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.floor(F.col("_at") / _LOCAL).cast("int"))
    parts = numbered.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part")
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*within))})
    same = F.col("l._part") == F.col("r._part")
    for c in within:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = numbered.alias("l").join(parts.alias("r"), same)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("_at") - F.col("_first") + F.col("_before")).alias(to), F.col("_total").alias(f"{to}_of"))


def interleave_shards(docs: DataFrame, shards: int = 64, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, position, shard) of every row: each shard has the corpus's mixture of sources.

    Within each source, rows are shuffled by md5 of seed and id and ranked; row r of n gets
    the fraction (2 r + 1) / 2 n. All rows are sorted by fraction (ties: by source, then the
    shuffle's order), and position p of N goes to shard p * shards / N, rounded down. A
    shard's share of a source differs from the corpus's by less than a row or so per source.

    A NULL source is a source of its own and NULL ids are shuffled as if empty. Equal rows
    take neighbouring ranks; which one is first makes no difference to the result. With
    fewer rows than shards some shards are empty; an empty table gives an empty one. Other
    columns are left out.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = pick(docs, doc_id=id_col, source=source_col).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    ranked = _ranked(rows, ["source"], ["_key", "doc_id"], "_rank")
    fraction = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_rank_of")).cast("double")
    placed = _ranked(ranked.select("doc_id", "source", "_key", fraction.alias("_fraction")), [], ["_fraction", "source", "_key", "doc_id"], "position")
    return placed.select("doc_id", "source", "position", F.floor(F.col("position") * shards / F.col("position_of")).cast("int").alias("shard"))
