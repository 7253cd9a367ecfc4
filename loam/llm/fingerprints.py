"""Operator 6: SimHash fingerprints and all pairs within a Hamming radius.

Terms are pairs of neighbouring words, weighted by how often a text has them; each term's
64-bit hash votes with its weight on every bit. Candidates come from permuted block tables:
the 64 bits are cut into b blocks, and for each choice of b - radius blocks there is a table
keyed by them. Fingerprints that differ in at most `radius` bits agree on all blocks of at
least one choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import ngram_hashes, runs, sliced, utf8, word_hashes
from loam.llm.common import pick, quoted, written

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(data: np.ndarray, offsets: np.ndarray, terms: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text (int64) and how many terms it has. A bit is set by more than half of the votes."""
    n = len(offsets) - 1
    term, have = ngram_hashes(*word_hashes(data, offsets), terms)
    doc = np.repeat(np.arange(n), have) * 256
    octets = term.view(np.uint8).reshape(-1, 8)
    out = np.zeros((n, 8), np.uint8)
    for w in range(8):
        votes = np.bincount(doc + octets[:, w], minlength=n * 256).reshape(n, 256) @ _BITS
        out[:, w] = np.packbits(2 * votes > have[:, None], axis=1, bitorder="little").ravel()
    return out.view(np.int64).ravel(), have


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: int = 2) -> DataFrame:
    """(doc_id, fingerprint, n_terms) of every row; NULL where a text is NULL or has no words. Other columns are left out."""
    kind = docs.select(quoted(id_col)).dtypes[0][1]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1), lower=True)
            marks, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for first, end in runs(offsets):
                mark, have = simhash(*sliced(data, offsets, first, end), terms)
                marks.append(mark)
                counts.append(have)
            count = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(marks), mask=count == 0), pa.array(count)], ["doc_id", "fingerprint", "n_terms"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, fingerprint long, n_terms long")


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys are so wide that n fingerprints seldom share one by chance; if that takes more than 400 tables, the number with the least work."""
    fits = next((b for b in range(radius + 1, 65) if n <= 2 ** (64 * (b - radius) / b)), 64)
    if comb(fits, radius) <= 400:
        return fits
    # in each table a fingerprint is sorted, which takes as long as 6 comparisons, and compared with half of those that share its key
    return min(range(radius + 1, fits + 1), key=lambda b: comb(b, radius) * (6 + n / 2 ** (64 * (b - radius) / b) / 2))


def table_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def _within(radius: int, blocks: int):
    """Pairs of the fingerprints of one group, all alike in block `at`, whose first common block that is.

    A pair comes from one table only, that of its first common blocks: those before the
    table's last block that aren't in its key all differ. So nothing has to be kept to tell
    which pairs were found before, and pairs leave in batches.
    """
    masks = np.array(table_masks(blocks, radius), np.int64).view(np.uint64)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = np.array([((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])], np.uint64)

    def near(x: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some fingerprints, and the bits in which others differ from them."""
        low = np.uint64((1 << edges[at]) - 1)
        for mask in masks[((masks & low) == 0) & ((masks & block[at]) != 0)]:
            differ = block[((block & mask) == 0) & (block < mask)]
            key = x & mask
            order = np.argsort(key)
            key, y = key[order], x[order]
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(y))
            later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(y)) - 1
            total = np.concatenate([[0], np.cumsum(later)])
            shift = np.arange(1, len(y) + 1) - total[:-1]
            first = 0
            while total[first] < total[-1]:  # some 50,000 pairs at a time, which stay in the CPU's cache
                end = max(first + 1, int(np.searchsorted(total, total[first] + 50_000, "right")) - 1)
                right = np.repeat(shift[first:end], later[first:end])
                right += np.arange(total[first], total[end])
                left = np.repeat(y[first:end], later[first:end])
                bits = y[right]
                bits ^= left
                found = np.flatnonzero(np.bitwise_count(bits) <= radius)
                for m in differ:
                    found = found[(bits[found] & m) != 0]
                if len(found):
                    yield left[found], bits[found]
                first = end

    def batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        left, bits = (np.concatenate(c) for c in zip(*found))
        pair = np.sort(np.stack([left, left ^ bits]).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.bitwise_count(bits).astype(np.int32))], ["a", "b", "distance"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        x = group.column("fingerprint").to_numpy().view(np.uint64)
        kept, rows = [], 0
        for found in near(x, group.column("at")[0].as_py()) if len(x) > 1 else ():
            kept.append(found)
            rows += len(found[0])
            if rows >= 10_000:
                yield batch(kept)
                kept, rows = [], 0
        if kept:
            yield batch(kept)

    return pairs


def near_fingerprints(marks: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance) of all distinct fingerprints a < b that differ in 1 to `radius` bits. marks: distinct fingerprints.

    All tables whose key begins with the same block are made in one task for each value of
    that block, so that a fingerprint is sent once for each first block, not for each table.
    """
    blocks = blocks_for(marks.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    firsts = F.array(*(F.struct(F.lit(i).alias("at"), F.shiftrightunsigned("fingerprint", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1).cast("long")).alias("value")) for i in range(radius + 1)))
    return marks.select("fingerprint", F.inline(firsts)).groupBy("at", "value").applyInArrow(_within(radius, blocks), "a long, b long, distance int")


def simhash_neighbours(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", terms: int = 2, wide: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, first_doc_id, near) of every row.

    first_doc_id is the lowest id with the same fingerprint. On that document's row, near
    lists the first_doc_id of every other fingerprint within the radius, ascending; on rows
    of other documents it is NULL, so that copies don't repeat the list. A text without
    words has no fingerprint: all three are NULL, and it is near nothing. Rows that repeat an
    id stay apart, each with its own fingerprint. Rows with a NULL id get a fingerprint and
    a first_doc_id, but are never first unless all of the fingerprint's ids are NULL; such
    a fingerprint is in no list. Empty tables give empty results.

    A changed word changes two terms, so most near copies differ in more than 3 bits. With
    `wide`, a column near_copies lists those within that larger radius in the same way.
    """
    marks = written(fingerprint(docs, id_col, text_col, terms).select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint"))
    first = written(marks.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc_id")))
    pairs = written(near_fingerprints(first.select("fingerprint"), max(radius, wide or 0)))
    lists = {"near": radius} | ({} if wide is None else {"near_copies": wide})
    both = pairs.select(F.col("a").alias("fingerprint"), F.col("b").alias("other"), "distance").unionByName(pairs.select(F.col("b").alias("fingerprint"), F.col("a").alias("other"), "distance"))
    near = both.join(first.select(F.col("fingerprint").alias("other"), F.col("first_doc_id").alias("id")), "other").groupBy("fingerprint").agg(*(F.array_sort(F.collect_list(F.when(F.col("distance") <= r, F.col("id")))).alias(c) for c, r in lists.items()))
    groups = first.join(near, "fingerprint", "left").select("fingerprint", "first_doc_id", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in lists))
    return marks.join(groups, "fingerprint", "left").select("doc_id", "fingerprint", "first_doc_id", *(F.when(F.col("doc_id") == F.col("first_doc_id"), F.col(c)).alias(c) for c in lists))
