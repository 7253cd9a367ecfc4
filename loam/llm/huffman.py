"""Operator 8: token ids as canonical length-limited Huffman code in independent blocks.

Ids are counted over the whole corpus; package-merge gives code lengths of at most
`max_length` bits and the lengths alone fix the canonical code. A block holds whole
documents and decodes on its own: every `every` ids its bit offset is written down, and the
runs between these checkpoints are decoded side by side by table lookup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import runs, sliced, steady_memory, utf8
from loam.llm.bpe import AT_ONCE, held_pieces, load_ranks
from loam.llm.common import WORD_VOCABULARY, pick, quoted, written

_BLOCKS = "block_id long, doc_ids array<{}>, doc_counts array<int>, n_ids long, payload binary, checkpoints array<long>, round_trip boolean"


def code_lengths(counts: np.ndarray, max_length: int = 16) -> np.ndarray:
    """The best code length of each id under the limit (package-merge); 0 where the count is 0. A limit too short for so many ids is an error."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_length:
        raise ValueError(f"{n} ids have no code of at most {max_length} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_length - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    take = 2 * n - 2
    length = np.zeros(n, np.uint8)
    for flags in reversed(leaf):
        own = int(flags[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[used] = length
    return out


@dataclass(frozen=True)
class Code:
    """A canonical code: shorter codes first, ids ascending within a length."""

    lengths: np.ndarray
    held: list = field(default_factory=list, compare=False, repr=False)  # the table, once made

    @property
    def width(self) -> int:
        return max(1, int(self.lengths.max(initial=0)))

    def codes(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.uint64)
        code, before = 0, 0
        for length in range(1, self.width + 1):
            code <<= length - before
            before = length
            ids = np.flatnonzero(self.lengths == length)
            out[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
            code += len(ids)
        return out

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each `width` bits that may come next the id and its length; length 0: no code begins so."""
        if self.held:
            return self.held[0]
        ids, size = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int64)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        span = 1 << (self.width - self.lengths[used].astype(np.int64))
        total = int(span.sum())
        ids[:total], size[:total] = np.repeat(used, span), np.repeat(self.lengths[used], span)
        self.held.append((ids, size))
        return ids, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The codes of the ids one after another, highest bit first, and the bit offset of every `every`-th id."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    size = lengths[ids].astype(np.int64)
    code = codes[ids]
    end = np.cumsum(size)
    at = end - size
    word, free = at >> 6, 64 - (at & 63) - size
    words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    head = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(free < 0)  # at most one code a word runs over its end
    words[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(end[-1] + 7) // 8], at[::every].copy()


def decode_bits(payload: bytes, n: int, checkpoints: np.ndarray, every: int, code: Code) -> np.ndarray:
    """The ids of a block. Bits that no code begins with are an error."""
    if not n:
        return np.empty(0, np.int32)
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)])
    four = np.ndarray(len(data) - 3, ">u4", data, 0, (1,)).astype(np.uint32)  # the next four bytes of each byte
    ids, size = code.table()
    at = np.array(checkpoints, np.int64)
    out = np.empty((min(every, n), len(at)), np.int32)
    width = code.width
    low, mask = 32 - width, (1 << width) - 1
    for step in range(min(every, n)):
        live = len(at) if step < n - (len(at) - 1) * every else len(at) - 1
        place = at[:live]
        look = four[place >> 3] >> (low - (place & 7)).astype(np.uint32) & mask
        found = size[look]
        if not found.all():
            raise ValueError("the bits are no code")
        out[step, :live] = ids[look]
        place += found
    out = out.T
    return out.ravel()[:n]


def tokenized(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids of each text as little-endian numbers of 2 bytes, or 4 if the vocabulary is larger; NULL for NULL."""
    wide = id_kind(vocabulary)
    kind = docs.select(quoted(id_col)).dtypes[0][1]

    def run(batches):
        steady_memory("bpe")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), token_bytes(batch.column(1), vocabulary, wide)], ["doc_id", "ids"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, ids binary")


def token_bytes(texts: pa.Array, vocabulary: str, wide: str) -> pa.Array:
    """The ids of each text as bytes; NULL for NULL."""
    pieces = held_pieces(vocabulary)
    data, offsets = utf8(texts)
    parts = [pieces.ids(*sliced(data, offsets, a, b)) for a, b in runs(offsets, AT_ONCE)]
    raw = np.concatenate([np.empty(0, wide), *(ids.astype(wide) for ids, _ in parts)])
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(n for _, n in parts)])) * raw.itemsize
    return binaries(raw, ends, texts.is_null())


def binaries(values: np.ndarray, ends: np.ndarray, null: pa.Array) -> pa.Array:
    """The bytes of values, cut at ends (from 0), as an Arrow column."""
    valid = pa.compute.invert(null)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid.buffers()[1] if valid.offset == 0 else pa.array(valid.to_pylist()).buffers()[1], pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def id_kind(vocabulary: str) -> str:
    return "<u2" if len(load_ranks(vocabulary)) <= 65536 else "<u4"


def id_counts(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often the corpus has each id. What comes to the driver is as long as the vocabulary, however large the corpus."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), kind))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    got = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 0, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def huffman_blocks(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, block_ids: int = 65_536, every: int = 256, max_length: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus's token ids as coded blocks: (block_id, doc_ids, doc_counts, n_ids, payload, checkpoints, round_trip).

    Block -1 is the code: its payload is one byte with the code length of each id, its n_ids
    the number of ids between checkpoints. All others hold whole documents: a block is
    closed once it has block_ids ids or more, so that a very long document ends one. Each
    block is decoded again from its payload and checkpoints; round_trip says whether that
    gave its ids. A NULL text has a NULL count and no ids, an empty one 0. Rows with equal
    ids are kept each, NULL ids too; ids may be of any type. An empty table gives the code
    block alone, with no lengths. A max_length that has no code for all the ids that occur is
    an error. Other columns are left out.
    """
    kind = id_kind(vocabulary)
    encoded = written(tokenized(docs, vocabulary, id_col, text_col))
    code = Code(code_lengths(id_counts(encoded, kind), max_length))
    lengths, codes, width = code.lengths, code.codes(), np.dtype(kind).itemsize
    blocks = _BLOCKS.format(encoded.dtypes[0][1])

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, tokens = (pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
        counts = pa.compute.divide(pa.compute.binary_length(tokens), pa.scalar(width, pa.int32()))
        flat = np.frombuffer(b"".join(x for x in tokens.to_pylist() if x), kind)
        payload, marks = encode_bits(flat, codes, lengths, every)
        back = decode_bits(payload, len(flat), marks, every, code)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [pa.array([number], pa.int64()), whole(ids), whole(counts), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary()), whole(pa.array(marks)), pa.array([bool((back == flat).all())])]
        return pa.RecordBatch.from_arrays(columns, ["block_id", "doc_ids", "doc_counts", "n_ids", "payload", "checkpoints", "round_trip"])

    def run(batches):
        steady_memory()
        number = TaskContext.get().partitionId() << 32
        parts, held = [], 0
        for batch in batches:
            sums = held + np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // width)
            first = base = 0
            while first < len(sums):
                end = int(np.searchsorted(sums, base + block_ids)) + 1
                parts.append(batch.slice(first, end - first))
                if end > len(sums):
                    break
                yield block(number, parts)
                number, parts, first, base = number + 1, [], end, int(sums[end - 1])
            held = int(sums[-1]) - base if len(sums) else held
        if parts:
            yield block(number, parts)

    book = docs.sparkSession.createDataFrame([(-1, [], [], every, bytearray(lengths.tobytes()), [], True)], blocks)
    return encoded.mapInArrow(run, blocks).unionByName(book)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document in the blocks; ids is NULL where the text was, and empty where it was empty. Repeated and NULL ids come back each."""
    book = blocks.where("block_id = -1").first()
    code, every = Code(np.frombuffer(bytes(book.payload), np.uint8)), int(book.n_ids)
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, marks = (batch.column(c)[i].values for c in (0, 1, 4))
                ids = decode_bits(batch.column(3)[i].as_py(), batch.column(2)[i].as_py(), marks.to_numpy(zero_copy_only=False), every, code)
                ends = np.append(0, np.cumsum(counts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=counts.is_null())], ["doc_id", "ids"])

    return blocks.where("block_id >= 0").select("doc_ids", "doc_counts", "n_ids", "payload", "checkpoints").mapInArrow(run, f"doc_id {kind}, ids array<int>")
