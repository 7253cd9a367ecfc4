"""Exact and semantic duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.graph import connected_components
from loam.storage import written


def exact_duplicates(chunks: DataFrame, normalized: bool = True) -> DataFrame:
    """(ordinal, chunk_id, hash, group_size, is_keep) of every chunk: equal after white space is normalised.

    Kept is the chunk with the most metadata keys, of equals the first; ordinals are unique. Ids, hashes and key
    counts are written once; groups are made with partial aggregation and joined back, so that
    no task sorts all copies of a text.
    """
    content = F.col("content")
    rows = written(chunks.select("ordinal", "chunk_id", (T.split_hash(content) if normalized else T.normalized_hash(content, False)).alias("hash"), F.coalesce(F.size("metadata"), F.lit(0)).alias("keys")))
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max_by("ordinal", F.struct("keys", -F.col("ordinal"))).alias("first")).where("n > 1")
    joined = rows.join(groups, "hash", "left")
    return joined.select("ordinal", "chunk_id", "hash", F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | F.col("ordinal").eqNullSafe(F.col("first"))).alias("is_keep"))


def duplicate_groups(chunks: DataFrame, normalized: bool = True) -> DataFrame:
    """(hash, keep_id, remove_ids) of each group of two or more; ids in order."""
    rows = chunks.select("ordinal", "chunk_id", T.normalized_hash(F.col("content"), normalized).alias("hash"), F.coalesce(F.size("metadata"), F.lit(0)).alias("keys"))
    grouped = rows.groupBy("hash").agg(F.max_by("chunk_id", F.struct("keys", -F.col("ordinal"))).alias("keep_id"), F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("all"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").select("hash", "keep_id", F.filter(F.transform("all", lambda x: x["chunk_id"]), lambda x: x != F.col("keep_id")).alias("remove_ids"))


def duplicate_stats(chunks: DataFrame, normalized: bool = True) -> DataFrame:
    """One row: total, unique, duplicates, groups of two or more, and the duplicates' share."""
    sizes = chunks.groupBy(T.normalized_hash(F.col("content"), normalized).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), F.count(F.lit(1)).alias("unique_items"), F.count_if(F.col("n") > 1).alias("duplicate_groups")).select(
        "total_items",
        "unique_items",
        (F.col("total_items") - F.col("unique_items")).alias("duplicate_count"),
        "duplicate_groups",
        F.coalesce(F.try_divide((F.col("total_items") - F.col("unique_items")).cast("double"), F.col("total_items")), F.lit(0.0)).alias("duplicate_ratio"),
    )


def survivors(chunks: DataFrame, normalized: bool = True) -> DataFrame:
    """The chunks without removed duplicates."""
    gone = exact_duplicates(chunks, normalized).where("NOT is_keep").select("ordinal")
    return chunks.join(gone, "ordinal", "left_anti")


_PAIRS, _LINKS = "a long, b long, similarity double", "a long, b long"
#: Numbers in a block of vectors; rows in a block and blocks of small tables, so that all cores have work; rows of a matrix product.
BLOCK_VALUES, LEAST_ROWS, LEAST_BLOCKS, ROWS, COLUMNS = 1 << 22, 4096, 8, 512, 4096
#: A pair that is joined, made distinct and sent with its vectors takes about as long as so many cosines of a matrix product.
JOINED_PAIR = 500


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; a zero vector stays zero and is similar to nothing."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes != sizes[:1]).any():
        raise ValueError("vectors must have one length")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(row, table, byte): the sides of the hyperplanes on which each row is."""
    return np.concatenate([np.packbits((x[i : i + LEAST_ROWS] @ planes > 0).reshape(-1, planes.shape[1] // bits, bits), axis=2, bitorder="little") for i in range(0, len(x), LEAST_ROWS)])


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")


def _placed(rows: DataFrame, n: int, width: int, rows_per_block: int | None) -> DataFrame:
    """(task, side, id, vector): a task and a partition for each pair of blocks, sorted; a block with itself has side 0 alone."""
    blocks = max(1, -(-n // (rows_per_block or max(1, BLOCK_VALUES // width))))
    if rows_per_block is None:
        blocks = max(blocks, min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    placed = placed.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "vector")
    return placed.repartitionById(min(blocks * (blocks + 1) // 2, 10_000), "task").sortWithinPartitions("task", "side", "id")


def _tasks(batches):
    """(task, the ids and unit rows of its one or two blocks)."""

    def blocks(held):
        table = pa.Table.from_batches(held)
        sides = [table.filter(pc.equal(table.column("side"), side)).combine_chunks() for side in (0, 1)]
        return [(t.column("id").chunk(0).to_numpy(), _matrix(t.column("vector").chunk(0))) for t in sides if t.num_rows]

    held, at = [], None
    for batch in batches:
        tasks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1), len(tasks)] if len(tasks) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and tasks[a] != at:
                yield at, blocks(held)
                held = []
            at = int(tasks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield at, blocks(held)


def _own(task: int) -> bool:
    """Whether the task is that of a block with itself."""
    high = int(((8 * task + 1) ** 0.5 - 1) / 2)
    return task == high * (high + 3) // 2


def _near(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x and of y whose product is at least so much."""
    return np.divmod(np.flatnonzero(x @ y.T >= least), max(1, len(y)))


def _least(threshold: float, width: int) -> np.float32:
    """What a cosine in single precision is at least, where it is at least the threshold in double precision."""
    return np.float32(threshold - (width + 8) * 1.2e-7)


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 20) // x.shape[1])
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step))])


def _cuts(ids: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Ranges of about step rows of sorted ids that divide no id."""
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    ends = np.unique([*first[np.minimum(np.searchsorted(first, np.arange(0, len(ids), step)), len(first) - 1)], len(ids)])
    return [*zip(ends[:-1].tolist(), ends[1:].tolist())]


def _pairs_of(threshold: float, planes: np.ndarray | None = None, bits: int = 1):
    """All pairs of each task, some 100,000 at a time; with planes those that share a bucket of a table."""

    def found(a, x, b, y, own):
        x32, y32, least = x.astype(np.float32), y.astype(np.float32), _least(threshold, x.shape[1])
        codes = None if planes is None else [_codes(z, planes, bits) for z in ((x,) if own else (x, y))]
        repeated = any((z[1:] == z[:-1]).any() for z in (a, b))
        for r0, r1 in _cuts(a, ROWS):
            for c0, c1 in _cuts(b, COLUMNS):
                out = []
                for r in range(r0, r1, ROWS):
                    for c in range(c0, c1, COLUMNS):
                        if own and min(c + COLUMNS, c1) <= r:
                            continue
                        i, j = _near(x32[r : min(r + ROWS, r1)], y32[c : min(c + COLUMNS, c1)], least)
                        i, j = i + r, j + c
                        keep = (a[i] != b[j]) & ((i < j) | (not own))
                        i, j = i[keep], j[keep]
                        cos = _cosines(x, y, i, j)
                        keep = cos >= threshold
                        if codes is not None and keep.any():
                            step = max(1, (1 << 22) // codes[0][0].size)
                            at = np.flatnonzero(keep)
                            for k in range(0, len(at), step):
                                some = at[k : k + step]
                                keep[some] = (codes[0][i[some]] == codes[-1][j[some]]).all(axis=2).any(axis=1)
                        if keep.any():
                            p, q = a[i[keep]], b[j[keep]]
                            out.append((np.minimum(p, q), np.maximum(p, q), cos[keep]))
                if out:
                    p, q, cos = (np.concatenate(o) for o in zip(*out))
                    if repeated:
                        order = np.lexsort((-cos, q, p))
                        p, q, cos = p[order], q[order], cos[order]
                        new = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
                        p, q, cos = p[new], q[new], cos[new]
                    yield p, q, cos

    def pairs(batches):
        held, n = [], 0
        for task, blocks in _tasks(batches):
            if own := _own(task):
                blocks *= 2
            if len(blocks) < 2:
                continue
            for some in found(*blocks[0], *blocks[1], own):
                held.append(some)
                n += len(some[0])
                if n >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*held)], ["a", "b", "similarity"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*held)], ["a", "b", "similarity"])

    return pairs


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after each i is joined with its j. The label of a group is its lowest row."""
    while (apart := label[i] != label[j]).any():
        i, j = i[apart], j[apart]
        top = np.arange(len(label))
        np.minimum.at(top, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (top[top] != top).any():
            top = top[top]
        label = top[label]
    return label


def _links_of(threshold: float):
    """Fewer pairs than rows of each task that connect what all its pairs connect.

    Rows that are in the task's largest group already aren't compared with each other.
    """

    def joined(x, y, own):
        x32, y32, least = x.astype(np.float32), y.astype(np.float32), _least(threshold, x.shape[1])
        beyond = 0 if own else len(x)
        label = np.arange(beyond + len(y))
        for r in range(0, len(x), ROWS):
            largest = np.bincount(label).argmax()
            for c in range(r if own else 0, len(y), COLUMNS):
                rows, columns = np.arange(r, min(r + ROWS, len(x))), np.arange(c, min(c + COLUMNS, len(y)))
                for out in (True, False):
                    some = rows[(label[rows] != largest) == out]
                    others = columns if out else columns[label[columns + beyond] != largest]
                    if len(some) and len(others):
                        i, j = _near(x32[some], y32[others], least)
                        i, j = some[i], others[j]
                        apart = label[i] != label[j + beyond]
                        i, j = i[apart], j[apart]
                        near = _cosines(x, y, i, j) >= threshold
                        label = _joined(label, i[near], j[near] + beyond)
                        largest = label[largest]
        return label

    def links(batches):
        for task, blocks in _tasks(batches):
            if own := _own(task):
                blocks *= 2
            if len(blocks) == 2:
                label = joined(blocks[0][1], blocks[1][1], own)
                ids = blocks[0][0] if own else np.concatenate([blocks[0][0], blocks[1][0]])
                a, b = ids, ids[label]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    return links


def _measured(rows: DataFrame) -> tuple[int, int]:
    """Number of vectors and the longest one's length."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return n, width or 1


def similar_pairs(vectors: DataFrame, threshold: float = 0.95, id_col: str = "ordinal", vector_col: str = "embedding", rows_per_block: int | None = None) -> DataFrame:
    """(a, b, similarity): all pairs a < b whose cosine is at least the threshold. Exact.

    Rows are hashed into blocks of about rows_per_block, else of some 4 million numbers (65,536 vectors
    of 64); each pair of blocks is one task, which makes matrix products of parts of them, so that no task and
    no driver ever holds all vectors or all pairs. Products in single precision leave out what is certainly below the
    threshold; the rest is computed in double precision. A vector goes to as many tasks as there
    are blocks: quadratic, as an exact search is. Of rows that repeat an id the most similar count.
    """
    rows = _rows(vectors, id_col, vector_col)
    return _placed(rows, *_measured(rows), rows_per_block).mapInArrow(_pairs_of(threshold), _PAIRS)


def similar_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "ordinal", vector_col: str = "embedding", rows_per_block: int | None = None) -> DataFrame:
    """(a, b), a < b: links with the same connected components as similar_pairs, some of which are no pairs themselves. Exact.

    Each task gives fewer links than it has vectors, where pairs grow with their square, and leaves out
    comparisons within a group that is connected already.
    """
    rows = _rows(vectors, id_col, vector_col)
    return _placed(rows, *_measured(rows), rows_per_block).mapInArrow(_links_of(threshold), _LINKS)


def similar_pairs_lsh(vectors: DataFrame, threshold: float = 0.95, bits: int = 16, recall: float = 0.98, id_col: str = "ordinal", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """Like similar_pairs, by random hyperplanes: as many tables of `bits` bits as find a pair at the threshold with the given chance.

    Where the buckets are few or uneven, so that joining all pairs of a bucket takes longer than the cosines of
    all pairs of rows, these are computed as in similar_pairs, and those that share a bucket
    are kept: the same pairs either way.
    """
    rows = _rows(vectors, id_col, vector_col)
    n, width = _measured(rows)
    alike = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - alike))) if alike < 1 else 1
    planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(width, tables * bits))

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                code = _codes(_matrix(batch.column(1)), planes, bits)
                wide = np.zeros((*code.shape[:2], 8), np.uint8)
                wide[:, :, : code.shape[2]] = code
                key = wide.view(np.int64)[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(code))), pa.array(key.ravel())], ["id", "at", "key"])

    keyed = rows.mapInArrow(keys, "id long, at int, key long")
    all_pairs = n * (n - 1) / 2
    if tables / 2**bits * JOINED_PAIR <= 1:  # even buckets have the fewest pairs
        shared = keyed.groupBy("at", "key").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
        if shared * JOINED_PAIR <= all_pairs:
            return _joined_buckets(rows, keyed, threshold)
    return _placed(rows, n, width, None).mapInArrow(_pairs_of(threshold, planes, bits), _PAIRS)


def _joined_buckets(rows: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    pairs = keyed.alias("x").join(keyed.alias("y"), ["at", "key"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    found = pairs.join(rows.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a").join(rows.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")

    def verify(batches):
        for batch in batches:
            if batch.num_rows:
                cos = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1)
                keep = cos >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(cos[keep])], ["a", "b", "similarity"])

    return found.select("a", "b", "va", "vb").mapInArrow(verify, _PAIRS).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def semantic_groups(pairs: DataFrame) -> DataFrame:
    """(group, ordinal, is_keep): connected components of similar pairs or links; the lowest ordinal names and represents its group."""
    return connected_components(pairs).select(F.col("component").alias("group"), F.col("node").alias("ordinal"), (F.col("node") == F.col("component")).alias("is_keep"))


def two_phase(chunks: DataFrame, threshold: float = 0.95, normalized: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """(ordinal, removed_by) of every chunk that goes: 'hash' for exact duplicates, then 'semantic' among those left.

    vectors: (ordinal, embedding) where they are a table of their own, so that texts needn't be joined with
    them; those of no chunk count for nothing. Else the chunks have them.
    """
    gone = written(exact_duplicates(chunks, normalized).where("NOT is_keep").select("ordinal"))
    left = chunks.select("ordinal", "embedding") if vectors is None else vectors.select("ordinal", "embedding").join(chunks.select("ordinal"), "ordinal", "left_semi")
    left = written(left.where("embedding IS NOT NULL").join(gone, "ordinal", "left_anti"))
    semantic = semantic_groups(similar_links(left, threshold)).where("NOT is_keep").select("ordinal", F.lit("semantic").alias("removed_by"))
    return gone.withColumn("removed_by", F.lit("hash")).unionByName(semantic)
