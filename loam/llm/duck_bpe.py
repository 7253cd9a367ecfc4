"""Operator 7: byte-level BPE encoding and decoding by DuckDB, within each partition.

Encoding: token-position rows of words join the merge table; a recursive query contracts
each word's leftmost pair of the lowest rank until no pair merges. Decoding: id-position
rows join the vocabulary, and an ordered aggregation puts the texts together.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.arrays import held_between_tasks, runs, sliced, steady_memory, utf8
from loam.llm.bpe import LONG, Merges, Pieces, load_ranks
from loam.llm.common import WORD_VOCABULARY, pick, quoted

#: k: 256 times the word plus the token's first byte in it; n: the same of the next token.
_CONTRACT = """
WITH RECURSIVE s(i, k, n, t) AS (
  SELECT 0, k, n, t FROM seed
  UNION ALL
  SELECT i + 1, s.k, CASE WHEN s.k = best & 1099511627775 THEN n2 ELSE s.n END, CASE WHEN s.k = best & 1099511627775 THEN (best >> 40)::INTEGER ELSE t END
  FROM s JOIN (
    SELECT a.k >> 8 AS w, min(m.r::BIGINT << 40 | a.k) AS best, arg_min(a.n, m.r::BIGINT << 40 | a.k) AS n1, arg_min(b.n, m.r::BIGINT << 40 | a.k) AS n2
    FROM s a JOIN s b ON a.n = b.k JOIN merges m ON m.a = a.t AND m.b = b.t GROUP BY 1) c ON s.k >> 8 = c.w
  WHERE s.k <> n1
)
SELECT s.k >> 8 AS w, s.t FROM s JOIN (SELECT k >> 8 AS w, max(i) AS i FROM s GROUP BY 1) f ON s.k >> 8 = f.w AND s.i = f.i ORDER BY s.k
"""

_DECODE = "SELECT d, string_agg(v.s, '' ORDER BY p) AS s FROM ids JOIN vocabulary v USING (t) GROUP BY d ORDER BY d"


class DuckBpe:
    """A vocabulary in an in-memory DuckDB of one thread."""

    def __init__(self, path: str, words_at_once: int = 60_000):
        self.table = Merges(load_ranks(path))
        self.words_at_once = words_at_once
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        there = self.table.keys >= 0
        pairs = self.table.keys[there]
        merges = pa.table({"a": (pairs >> 32).astype(np.int32), "b": (pairs & (2**32 - 1)).astype(np.int32), "r": self.table.values[there]})
        ids = sorted(self.table.bytes_of)
        vocabulary = pa.table({"t": pa.array(ids, pa.int32()), "s": [self.table.bytes_of[i].decode("latin-1") for i in ids]})  # a character for each byte
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        del merges, vocabulary
        self.known = np.zeros(max(ids) + 1, bool)
        self.known[ids] = True
        self.pieces = Pieces(self.table.ranks, self.merge)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (their bytes in a row) in a row, and where each word's begin (one more at the end).

        A recursion over a word of LONG bytes or more would take as many rounds over as many rows:
        those are merged rank by rank on arrays instead, with the same result.
        """
        begins = np.append(0, np.cumsum(sizes))
        found, counts = [], np.zeros(len(sizes), np.int64)
        for a in range(0, len(sizes), self.words_at_once):
            some = np.arange(a, min(len(sizes), a + self.words_at_once))
            long = some[sizes[some] >= LONG]
            short = some[sizes[some] < LONG]
            merged = [self.table.by_ranks(data[begins[i] : begins[i + 1]]) for i in long]
            w = [np.repeat(long, np.array(list(map(len, merged)), np.int64))]
            t = [np.empty(0, np.int32), *merged]
            if len(short):
                n = sizes[short]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(short * 256, n) + inner
                after = at + 1
                after[np.cumsum(n) - 1] = -1  # no token begins there
                seed = pa.table({"k": at, "n": after, "t": self.table.of_byte[data[np.repeat(begins[short], n) + inner]]})
                self.db.register("seed", seed)
                got = self.db.execute(_CONTRACT).fetchnumpy()
                self.db.unregister("seed")
                w.append(got["w"].astype(np.int64))
                t.append(got["t"])
            w, t = np.concatenate(w), np.concatenate(t)
            if len(long):
                order = np.argsort(w, kind="stable")
                w, t = w[order], t[order]
            counts += np.bincount(w, minlength=len(sizes))
            found.append(t.astype(np.int32))
        return np.concatenate([np.empty(0, np.int32), *found]), np.append(0, np.cumsum(counts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.ids(data, offsets)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids. An id that the vocabulary lacks is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        rows = pa.table({"d": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "p": np.arange(len(ids), dtype=np.int32), "t": ids.astype(np.int32)})
        self.db.register("ids", rows)
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(counts)
        for d, s in zip(got.column("d").to_pylist(), got.column("s").to_pylist()):
            out[d] = s.encode("latin-1")
        return out


_held: dict[str, DuckBpe] = {}
held_between_tasks("duck_bpe", _held.clear)


def held_duck(path: str) -> DuckBpe:
    if path not in _held:
        _held[path] = DuckBpe(path)
    return _held[path]


def _kind(df: DataFrame, column: str) -> str:
    return df.select(quoted(column)).dtypes[0][1]


#: Bytes of text that are worked on at once; one text is never cut.
AT_ONCE = 1_000_000


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], texts: pa.Array) -> pa.Array:
    """The ids of a batch's texts as lists; NULL for NULL."""
    flat = np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in parts)])
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(n for _, n in parts)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=texts.is_null())


def encode_bpe(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. A NULL text has NULL ids, an empty one an empty list.

    Special tokens' strings are ordinary text. Equal rows get equal results, each its own; an
    empty table gives an empty one; other columns are left out.
    """

    def run(batches):
        steady_memory("duck_bpe")
        duck = held_duck(vocabulary)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [duck.encode(*sliced(data, offsets, a, b)) for a, b in runs(offsets, AT_ONCE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts, batch.column(1))], ["doc_id", "ids"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, ids array<int>")


def decode_bpe(encoded: DataFrame, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; NULL ids give a NULL text, an empty list "". Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        duck = held_duck(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = np.append(0, np.cumsum(counts))
            texts: list[str] = []
            for first, end in runs(offsets, 1_000_000):
                texts += [raw.decode("utf-8", "replace") for raw in duck.decode(flat[offsets[first] : offsets[end]], counts[first:end])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], ["doc_id", "text"])

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, f"doc_id {_kind(encoded, id_col)}, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, round_trip) of every row: the ids of encode_bpe, and whether decoding them gives the text back.

    Both steps run on the whole text in one pass over the partition. NULL texts have NULL in both.
    """

    def run(batches):
        steady_memory("duck_bpe")
        duck = held_duck(vocabulary)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts, same = [], []
            for first, end in runs(offsets, AT_ONCE):
                part, places = sliced(data, offsets, first, end)
                parts.append(duck.encode(part, places))
                raw, ends = part.tobytes(), places.tolist()
                same += [back == raw[a:b] for back, a, b in zip(duck.decode(*parts[-1]), ends[:-1], ends[1:])]
            null = np.asarray(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts, batch.column(1)), pa.array(same, pa.bool_(), mask=null)], ["doc_id", "ids", "round_trip"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, ids array<int>, round_trip boolean")
