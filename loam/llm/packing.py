"""Operator 3: packing documents into training windows by the online sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import mix, steady_memory
from loam.llm.bpe import load_ranks
from loam.llm.common import WORD_VOCABULARY, pick, quoted, written
from loam.llm.huffman import id_kind, token_bytes

_IDS_PER_GROUP = 1 << 32
#: A task packs one group; beyond so many tasks, several groups one after another.
MOST_TASKS = 20_000


class SumOfSquares:
    """Windows of `capacity` that are filled online.

    level[h] counts the partially filled windows with fill h. An item goes to the level at
    which the sum of squared counts of partially filled windows becomes the least; of equal
    choices the fullest level. Among the windows of a level the one that reached it last.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        """The window and the offset in it of an item of 1 to capacity - 1."""
        level, last = self.level, self.capacity - size
        at = np.flatnonzero(level[1 : last + 1]) + 1
        best, fewest = 0, 2 * int(level[size]) + 1  # a new window: N(size) becomes N(size) + 1
        if len(at):
            change = 2 * (level[at + size] - level[at]) + 2  # N(h) and N(h + size) change by one each
            if at[-1] == last:
                change[-1] -= 1  # a full window is counted no more
            i = len(at) - 1 - int(change[::-1].argmin())
            if change[i] <= fewest:
                best = int(at[i])
        if best:
            window = self.open[best].pop()
            level[best] -= 1
        else:
            window = self.windows
            self.windows += 1
        if best < last:
            self.open[best + size].append(window)
            level[best + size] += 1
        return window, best


_COLUMNS = ["doc_id", "start", "length", "window_id", "window_offset", "ids"]
_ROWS_AT_ONCE = 1_000_000  # ids in a batch of results, about


def _pack(capacity: int, kind: str, end_id: int):
    """Rows sorted by group to the segments of their documents."""

    def out(docs: list, rows: list[tuple], ids: list[np.ndarray] | None) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)]
        if ids is None:
            lists = pa.nulls(len(rows), pa.list_(pa.int32()))
        else:
            ends = np.append(0, np.cumsum([len(x) for x in ids]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([docs, *columns, lists], _COLUMNS)

    def run(batches):
        steady_memory()
        now, packer = None, None
        for batch in batches:
            groups, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            contents = batch.column(3).to_pylist() if end_id >= 0 else None
            which: list[int] = []
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            held = 0
            for i, (g, n) in enumerate(zip(groups, sizes)):
                if g != now:
                    now, packer = g, SumOfSquares(capacity)
                base = g * _IDS_PER_GROUP
                content = None
                if contents is not None:
                    content = np.append(np.frombuffer(contents[i] or b"", kind).astype(np.int32), np.int32(end_id))
                start = 0
                while start < n:
                    if n - start >= capacity:
                        length, window, offset = capacity, packer.windows, 0
                        packer.windows += 1
                    else:
                        length = n - start
                        window, offset = packer.place(length)
                    which.append(i)
                    rows.append((start, length, base + window, offset))
                    if content is not None:
                        ids.append(content[start : start + length])
                    start += length
                    held += length
                if held >= _ROWS_AT_ONCE and contents is not None:
                    yield out(batch.column(1).take(pa.array(which, pa.int32())), rows, ids)
                    which, rows, ids, held = [], [], [], 0
            yield out(batch.column(1).take(pa.array(which, pa.int32())), rows, ids if contents is not None else None)

    return run


def _keyed(groups: int, vocabulary: str | None, kind: str):
    """The tokens of each row, unless there is no vocabulary, and its group: by its key, but for rows that repeat a key in a partition, each of which gets a key of its own."""

    def run(batches):
        steady_memory("bpe")
        seen: dict[int, int] = {}
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(np.unique(key)) < len(key) or seen.keys() & set(key.tolist()):
                for i, k in enumerate(key.tolist()):
                    n = seen.get(k, 0)
                    seen[k] = n + 1
                    if n:
                        key[i] = mix(np.array([k], np.int64).view(np.uint64) + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0]
            else:
                seen.update(dict.fromkeys(key.tolist(), 1))
            if vocabulary is None:
                size, ids = batch.column(2), pa.nulls(batch.num_rows, pa.binary())
            else:
                ids = token_bytes(batch.column(2), vocabulary, kind)
                size = pa.array(pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.mod(key, groups)), pa.array(key), batch.column(1), size, ids], ["group", "key", "doc_id", "size", "ids"])

    return run


def pack_windows(docs: DataFrame, capacity: int = 2048, docs_per_group: int = 20_000, seed: int = 42, size: Column | None = None, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, window_id, window_offset, ids): which units of each document lie where in which window.

    The units are the tokens of a text in the vocabulary and one more that ends it (the id
    after the vocabulary's last); ids holds those of the segment, so that a window's contents
    are its segments' ids by window_offset. With `size`, an expression over docs, units are
    only counted and ids is NULL. A document of `capacity` units or more fills whole windows
    of its own and only the rest is placed.

    Rows are divided by a hash of their ids into groups of about docs_per_group, which are
    packed on their own and in a shuffled order; groups grow in number with the rows, and a
    group is streamed through one task that holds only its open windows. Rows that repeat an
    id, NULL ids among them, are spread over the groups: each of a partition's gets a hash of
    its own.

    A NULL text counts as empty and has one unit, its end; a NULL size, 0 and negative sizes
    take no room: such a row isn't in the result. Very long texts are packed whole. Rows that
    repeat are placed each. An empty table gives an empty result; other columns are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if size is None:
        ranks = load_ranks(vocabulary)
        end_id, kind = max(ranks.values()) + 1, id_kind(vocabulary)
        rows, last, total = pick(docs, doc_id=id_col, text=text_col), "text", docs.count()
    else:
        end_id, kind = -1, "<u2"
        rows = written(docs.select(quoted(id_col).alias("doc_id"), size.cast("long").alias("size")).where("size > 0"))
        last, total = "size", rows.count()
    groups = max(1, -(-total // docs_per_group))
    doc = rows.dtypes[0][1]
    keyed = rows.select(F.xxhash64(F.lit(seed), "doc_id").alias("key"), "doc_id", last).mapInArrow(_keyed(groups, vocabulary if size is None else None, kind), f"group long, key long, doc_id {doc}, size long, ids binary")
    tasks = min(groups, MOST_TASKS)
    ordered = keyed.repartitionById(tasks, (F.col("group") % tasks).cast("int")).sortWithinPartitions("group", "key", "doc_id", "size").select("group", "doc_id", "size", "ids")
    return ordered.mapInArrow(_pack(capacity, kind, end_id), f"doc_id {doc}, start long, length long, window_id long, window_offset long, ids array<int>")
