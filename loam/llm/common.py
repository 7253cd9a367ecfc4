"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.storage import shared_dir, written

TOKENIZERS = "/opt/tokenizers"
WORD_VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> None:
    """Makes Arrow batches 1000 rows long where the session leaves Spark's 10,000, which are meant for numbers: of texts they take tens of MB, several times over, in the JVM and in Python."""
    if df.sparkSession.conf.get(ARROW_ROWS) == "10000":
        df.sparkSession.conf.set(ARROW_ROWS, "1000")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: no other column can clash."""
    text_batches(df)
    return df.select([quoted(name).alias(own) for own, name in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run) -> DataFrame:
    """df.mapInArrow(run) to df's own columns, whatever their names."""
    text_batches(df)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def small(table: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of few narrow columns with the hint to broadcast it, if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


__all__ = ["TOKENIZERS", "WORD_VOCABULARY", "map_rows", "pick", "quoted", "shared_dir", "small", "written"]
