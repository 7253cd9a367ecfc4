"""Operator 10: token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import runs, sliced, steady_memory, utf8
from loam.llm.bpe import AT_ONCE, held_pieces
from loam.llm.common import WORD_VOCABULARY, pick


def token_count(text: Column, vocabulary: str = WORD_VOCABULARY) -> Column:
    """How many tokens of a byte-level BPE vocabulary (a file of ranks) a text has.

    NULL gives NULL and "" gives 0. Special tokens' strings are ordinary text. Whole texts
    count, however long.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        steady_memory("bpe")
        pieces = held_pieces(vocabulary)
        for batch in batches:
            data, offsets = utf8(batch)
            found = [pieces.counts(*sliced(data, offsets, a, b)) for a, b in runs(offsets, AT_ONCE)]
            yield pa.array(np.concatenate([np.empty(0, np.int64), *found]), mask=np.asarray(batch.is_null()))

    return count(text)


def count_tokens(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of docs.

    Rows with equal ids stay apart, each with its own count; NULL texts have NULL counts,
    empty texts 0. An empty table gives an empty table. Other columns are left out, so
    that none can clash.
    """
    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens"))
