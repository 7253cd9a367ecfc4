"""Operator 5: Jaccard self-join of documents on word n-grams.

Prefix filtering over a rare-first order, with length, positional and suffix filters;
each candidate pair is verified once.

1.  Each task hashes its documents' n-grams and sends them, sorted and delta-coded, to
    buckets by hash. A bucket counts the documents of its n-grams, so that document
    frequencies are exact over the corpus. An n-gram of many documents of a chunk is sent
    once with their number, so that what all documents share is an entry a chunk.
2.  Buckets send back only n-grams of two documents or more: one of a single document is
    in no intersection. They carry a rank: first by frequency, then by hash.
3.  A document whose prefix (the n - ceil(t n) + 1 rarest n-grams) holds nothing but
    n-grams of its own has no partner and ends here. This takes most documents out.
4.  Documents with equal n-gram sets are joined on a fingerprint of the set, and one of
    them stands for all.
5.  The others' prefix n-grams are the join key. The list of rows of an n-gram goes on to
    where the other lists with the same first row go, as near copies share most lists: there
    pairs pass the length and the positional filter, and are known once. A very long list
    goes on in pairs of blocks, to many places.
6.  Token lists meet at the home of a pair's first document: a min-hash, so that lists of
    near copies mostly live together and each is sent once per home, not once per pair.
    A home of many pairs is divided. There the suffix filter and then the exact count decide,
    for all partners of a document at once. Links are counted and classes joined right there,
    so that nothing quadratic leaves a home, unless the pairs themselves are asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import mix, ngram_hashes, runs, sliced, steady_memory, utf8, word_hashes
from loam.llm.common import pick, small, written

HASH_BITS = 56
RANK_BITS = 27
CHUNK_NGRAMS = 1_000_000
_MANY = 65_535  # in place of a document: one of the chunk's frequent n-grams
CHUNK_DOCS = 60_000
BUCKET_BYTES = 8_000_000
HOME_DOCS = 1024
ROUTE_DOCS = 2048
#: An n-gram of more documents of a chunk goes to its bucket once, with their number.
OFTEN = 8
#: A list of more rows of one n-gram is cut into blocks of so many.
LIST_ROWS = 8192
#: Shuffled bytes of texts' n-grams a task, about.
TASK_BYTES = 16_000_000
#: A home with more pairs is divided by its first documents, so that no task grows with the largest group of copies.
CELL_PAIRS = 100_000


def pack(values: np.ndarray, extra: bytes = b"") -> bytes:
    """Ascending 64-bit numbers as the byte planes of their differences, compressed."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = (int(deltas.max()).bit_length() + 7) // 8 if len(deltas) else 0
    planes = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<IB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + extra)


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    n, width = struct.unpack_from("<IB", blob)
    raw = zstandard.ZstdDecompressor().decompress(memoryview(blob)[5:])
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64), raw[n * width :]


def prefix_length(size, threshold: float):
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


ROUTED = "route long, chunk long, blob binary"


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    route, chunk, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["route", "chunk", "blob"])


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _joined(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _parted(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        (n,) = struct.unpack_from("<I", blob, at)
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _table(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    return sink.getvalue().to_pybytes()


def _scatter(n: int, buckets: int):
    """Documents to (route, chunk, blob): n-grams to their buckets; a chunk's ids, sizes, fingerprints and frequent n-grams to the chunk (route < 0)."""

    def flush(chunk: int, ids: list[pa.Array], grams: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        rows_here = sum(map(len, ids))
        doc = np.repeat(np.arange(rows_here), np.concatenate(counts)).astype(np.uint16)
        gram = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        if len(gram):
            keep = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))
            gram, doc = gram[keep], doc[keep]
        size = np.bincount(doc, minlength=rows_here).astype(np.int64)
        marks = np.zeros((2, rows_here), np.uint64)
        by = np.argsort(doc, kind="stable")
        filled = np.flatnonzero(size)
        if len(filled):
            at = (np.cumsum(size) - size)[filled]
            marks[0, filled] = np.add.reduceat(mix(gram[by]), at)
            marks[1, filled] = np.add.reduceat(mix(gram[by] + np.uint64(0xD1B54A32D192ED03)), at)
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.empty(0, np.int64)
        times = np.diff(np.append(start, len(gram)))
        often = times > OFTEN
        kept = np.repeat(often, times)
        frequent = pack(gram[start[often]], np.concatenate([times[often].astype("<i4").view(np.uint8), doc[kept].view(np.uint8)]).tobytes())
        rows = [(-1 - chunk, chunk, _joined(_table(pa.concat_arrays(ids)), np.concatenate([size, marks.view(np.int64).ravel()]).tobytes(), frequent))]
        first = np.ones(len(gram), bool)
        first[kept] = False
        first[start[often]] = True
        weight = np.repeat(times, times)[first].astype("<i4")
        gram, doc = gram[first], np.where(kept, _MANY, doc).astype(np.uint16)[first]
        bucket = _bucket(gram, buckets)
        for a, b in _cuts(bucket):
            rows.append((int(bucket[a]), chunk, pack(gram[a:b], doc[a:b].tobytes() + weight[a:b][doc[a:b] == _MANY].tobytes())))
        return _routed(rows)

    def run(batches):
        steady_memory()
        base, seq = TaskContext.get().partitionId() << 22, 0
        ids: list[pa.Array] = []
        grams, counts, held, here = [], [], 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1), lower=True)
            named = np.asarray(batch.column(0).is_valid())
            for first, end in runs(offsets):
                words, per = word_hashes(*sliced(data, offsets, first, end))
                gram, have = ngram_hashes(words, per, n)
                if not named[first:end].all():
                    gram, have = gram[np.repeat(named[first:end], have)], np.where(named[first:end], have, 0)
                gram >>= np.uint64(64 - HASH_BITS)
                for a in range(first, end, CHUNK_DOCS):
                    b = min(end, a + CHUNK_DOCS)
                    if ids and here + b - a > CHUNK_DOCS:
                        yield flush(base + seq, ids, grams, counts)
                        seq, ids, grams, counts, held, here = seq + 1, [], [], [], 0, 0
                    lo, hi = have[: a - first].sum(), have[: b - first].sum()
                    ids.append(batch.column(0).slice(a, b - a))
                    here += b - a
                    grams.append(gram[lo:hi])
                    counts.append(have[a - first : b - first])
                    held += hi - lo
                if held >= CHUNK_NGRAMS:
                    yield flush(base + seq, ids, grams, counts)
                    seq, ids, grams, counts, held, here = seq + 1, [], [], [], 0, 0
        if ids:
            yield flush(base + seq, ids, grams, counts)

    return run


def _cuts(values: np.ndarray):
    """(start, end) of the runs of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.empty(0, np.int64)
    return zip([0, *ends[:-1].tolist()], ends.tolist())


def _grouped(batches, column: int):
    """Runs of rows with an equal value in a sorted column, as lists of (route, chunk, blob)."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[column] != now:
                if held:
                    yield now, held
                now, held = row[column], []
            held.append(row)
    if held:
        yield now, held


def _frequencies(batches):
    """A bucket's n-grams that several documents have, sent back to the chunks they came from."""
    steady_memory()
    for route, rows in _grouped(batches, 0):
        if route < 0:
            yield _routed(rows)
            continue
        grams, docs, weights = [], [], []
        for _, _, blob in rows:
            gram, rest = unpack(blob)
            doc = np.frombuffer(rest, np.uint16, len(gram))
            weight = np.ones(len(gram), np.int64)
            weight[doc == _MANY] = np.frombuffer(rest[2 * len(gram) :], "<i4")
            grams.append(gram)
            docs.append(doc)
            weights.append(weight)
        part = np.repeat(np.arange(len(grams), dtype=np.uint64), list(map(len, grams)))
        gram, doc, weight = np.concatenate(grams), np.concatenate(docs).astype(np.uint64), np.concatenate(weights)
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        entries = np.diff(np.append(start, len(gram)))
        df = np.add.reduceat(weight[order], start)
        several = df >= 2
        if not several.any():
            continue
        level = np.minimum(31, np.floor(2 * np.log2(df[several]) + 1e-9).astype(np.uint64))
        by = np.argsort(level, kind="stable")
        rank = np.empty(len(by), np.uint64)
        rank[by] = np.arange(len(by), dtype=np.uint64)
        token = np.repeat(level << np.uint64(RANK_BITS) | rank, entries[several])
        at = order[np.repeat(several, entries)]
        back = np.argsort(at)  # by chunk, and in it by n-gram
        at, token = at[back], token[back]
        out = []
        for a, b in _cuts(part[at]):
            d, t = doc[at[a:b]], token[a:b]
            many = d == _MANY
            out.append((route, rows[int(part[at[a]])][1], pack(np.sort(d[~many] << np.uint64(32) | t[~many]), t[many].astype("<u4").tobytes())))
        yield _routed(out)


_LISTS = "row long, doc_id {}, size int, mark1 long, mark2 long, home int, tokens binary"


def _lists(threshold: float, homes: int):
    """A chunk's documents with the ranked shared n-grams of those that may have a partner; of others tokens is NULL."""

    def run(batches):
        steady_memory()
        for chunk, rows in _grouped(batches, 1):
            table, numbers, frequent = _parted(next(blob for route, _, blob in rows if route < 0))
            ids = pa.ipc.open_stream(table).read_all().column(0).combine_chunks()
            size, mark1, mark2 = np.frombuffer(numbers, np.int64).reshape(3, -1)
            docs, keys, often = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for route, _, blob in sorted(r for r in rows if r[0] >= 0):
                low, rest = unpack(blob)
                token = np.concatenate([low & np.uint64(2**32 - 1), np.frombuffer(rest, "<u4").astype(np.uint64)])
                key = (token >> np.uint64(RANK_BITS)) << np.uint64(58) | np.uint64(route << RANK_BITS) | token & np.uint64(2**RANK_BITS - 1)
                docs.append((low >> np.uint64(32)).astype(np.int64))
                keys.append(key[: len(low)])
                often.append(key[len(low) :])
            gram, rest = unpack(frequent)
            times = np.frombuffer(rest, "<i4", len(gram))
            docs.append(np.frombuffer(rest[4 * len(gram) :], np.uint16).astype(np.int64))
            keys.append(np.repeat(np.concatenate(often), times))
            doc, key = np.concatenate(docs), np.concatenate(keys)
            shared = np.bincount(doc, minlength=len(size))
            live = prefix_length(size, threshold) > size - shared
            live &= size > 0
            keep = live[doc]
            doc, key = doc[keep], key[keep]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            who = np.flatnonzero(live)
            home, tokens = np.zeros(len(size), np.int32), np.full(len(size), None, object)
            if len(who):
                start, end = np.searchsorted(doc, who), np.searchsorted(doc, who, "right")
                home[who] = (np.minimum.reduceat(mix(key), start) % np.uint64(homes)).astype(np.int32)
                tokens[who] = [pack(key[a:b]) for a, b in zip(start, end)]
            columns = [pa.array(chunk * 65536 + np.arange(len(size))), ids, pa.array(size, pa.int32()), pa.array(mark1), pa.array(mark2), pa.array(home), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "size", "mark1", "mark2", "home", "tokens"])

    return run


POSTINGS = "token long, row long, size int, pos int, home int"


def _postings(threshold: float):
    def run(batches):
        for batch in batches:
            size = batch.column(1).to_numpy()
            prefix = prefix_length(size.astype(np.int64), threshold)
            lists = [unpack(b)[0] for b in batch.column(3).to_pylist()]
            own = size - np.array([len(x) for x in lists], np.int64)
            take = prefix - own
            if not len(lists):
                continue
            token = np.concatenate([x[:k] for x, k in zip(lists, take)]).astype(np.int64)
            n = np.minimum(take, [len(x) for x in lists])
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own, n)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(size, n)), pa.array(pos, pa.int32()), pa.array(np.repeat(batch.column(2).to_numpy(), n))], ["token", "row", "size", "pos", "home"])

    return run


def _meet(routes: int, threshold: float, most: int = 500_000):
    """Each n-gram's list of rows, sent to where its first row's other lists go: near copies share most lists, so that their pairs meet in one place.

    A list of more than LIST_ROWS rows is cut into blocks by size, and each two blocks that may
    hold a pair meet under a token of their own: no place gets more of it than two blocks.
    """

    def blob(columns) -> bytes:
        token, row, size, pos, home = columns
        raw = b"".join(x.tobytes() for x in (token, row, size.astype(np.int32), pos.astype(np.int32), home.astype(np.int32)))
        return zstandard.ZstdCompressor(level=1).compress(raw)

    def blocks(columns):
        token, row, size, pos, home = (x[np.lexsort((columns[1], columns[2]))] for x in columns)
        cuts = [(a, min(a + LIST_ROWS, len(row))) for a in range(0, len(row), LIST_ROWS)]
        for i, (a, b) in enumerate(cuts):
            for j in range(i, len(cuts)):
                c, d = cuts[j]
                if size[b - 1] < threshold * size[c] - 1e-9:
                    break
                if i == j and len(cuts) > 1:
                    continue  # pairs within a block are found where it meets another
                at = np.r_[a:b, c:d] if i < j else np.arange(a, b)
                own = mix(np.array([int(token[0]) * 2654435761 + i * 1_000_003 + j & (1 << 63) - 1], np.uint64))[0] >> np.uint64(1)
                yield int(own % np.uint64(routes)), 0, blob((np.full(len(at), own, np.int64), row[at], size[at], pos[at], home[at]))
        if len(cuts) > 1:  # a block too far from all others
            for i, (a, b) in enumerate(cuts):
                near = i + 1 < len(cuts) and size[b - 1] >= threshold * size[cuts[i + 1][0]] - 1e-9 or i and size[a - 1] >= threshold * size[a] - 1e-9
                if not near:
                    yield int(mix(row[a : a + 1].astype(np.uint64))[0] % np.uint64(routes)), 0, blob((token[a:b], row[a:b], size[a:b], pos[a:b], home[a:b]))

    def flush(columns):
        token = columns[0]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        length = np.diff(np.append(begin, len(token)))
        for i in np.flatnonzero(length > LIST_ROWS):
            for parts in blocks([c[begin[i] : begin[i] + length[i]] for c in columns]):
                yield _routed([parts])
        keep = np.repeat(length <= LIST_ROWS, length)
        token, row, size, pos, home = (c[keep] for c in columns)
        if not len(token):
            return
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.diff(np.append(start, len(token)))
        lead = np.repeat(np.where(n > 1, (mix(np.minimum.reduceat(row, start).astype(np.uint64)) % np.uint64(routes)).astype(np.int64), -1), n)
        order = np.argsort(lead, kind="stable")
        order = order[np.searchsorted(lead[order], 0) :]
        if not len(order):
            return
        lead = lead[order]
        cuts = np.append(np.flatnonzero(np.append(True, lead[1:] != lead[:-1])), len(lead))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            rows.append((int(lead[a]), 0, blob((token[at], row[at], size[at], pos[at], home[at]))))
        yield _routed(rows)

    def run(batches):
        carry: list[list[np.ndarray]] = []
        held = 0
        for last, batch in _with_last(batches):
            carry.append([c.to_numpy() for c in batch.columns])
            held += batch.num_rows
            if last or held >= most:
                now = [np.concatenate(x) for x in zip(*carry)]
                cut = len(now[0]) if last else int(np.searchsorted(now[0], now[0][-1]))
                if cut:
                    yield from flush([c[:cut] for c in now])
                carry = [[c[cut:] for c in now]]
                held = len(now[0]) - cut

    return run


CANDIDATES = "row_a long, row_b long, home_a int, pos_a int"
_POS = 22


def _candidates(threshold: float, most: int = 4_000_000):
    """Pairs of rows that share a prefix n-gram and pass the length and positional filters, each once, with the first one's lowest shared position."""
    share = threshold / (1 + threshold)

    def pairs(token, size, pos):
        i = np.arange(len(token))
        for d in range(1, len(token)):
            i = i[: np.searchsorted(i, len(token) - d)]
            i = i[token[i] == token[i + d]]
            i = i[size[i] >= threshold * size[i + d] - 1e-9]  # sizes ascend: a pair too far apart stays so
            if not len(i):
                return
            j = i + d
            need = np.ceil(share * (size[i] + size[j]) - 1e-9)
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
            yield i[ok], j[ok]

    def once(found):
        """The distinct pairs in order, each with its lowest position."""
        pair, pos = (np.concatenate(x) for x in zip(*found))
        if len(pair) and int(pair.max()) >> (63 - _POS) == 0:
            key = np.sort(pair << _POS | pos)
            pair, pos = key >> _POS, key & (2**_POS - 1)
        else:
            order = np.lexsort((pos, pair))
            pair, pos = pair[order], pos[order]
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        return pair[new], pos[new]

    def run(batches):
        steady_memory()
        for _, rows in _grouped(batches, 0):
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for _, _, blob in rows:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n, at = len(raw) // 28, 0
                for part, kind in zip(parts, (np.int64, np.int64, np.int32, np.int32, np.int32)):
                    part.append(np.frombuffer(raw, kind, n, at))
                    at += n * np.dtype(kind).itemsize
            token, row, size, pos, home = (np.concatenate(x) for x in parts)
            del parts
            order = np.lexsort((row, size, token))
            token, size, pos = token[order], size[order].astype(np.int64), pos[order].astype(np.int64)
            whole, first, local = np.unique(row, return_index=True, return_inverse=True)
            home = home[first]
            local = local[order]
            width = len(whole)
            found, held = [], 0
            for a, b in pairs(token, size, pos):
                found.append((local[a] * width + local[b], np.minimum(pos[a], 2**_POS - 1)))
                held += len(a)
                if held >= most:
                    found = [once(found)]
                    held = len(found[0][0]) if len(found[0][0]) < most // 2 else 0
                    if not held:  # mostly distinct pairs: hand them on; what comes twice is gathered afterwards
                        yield from out(*found.pop(), whole, home, width)
            if found:
                yield from out(*once(found), whole, home, width)

    def out(pair, pos, whole, home, width):
        a, b = pair // width, pair % width
        for k in range(0, len(pair), 500_000):
            x, y = a[k : k + 500_000], b[k : k + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(whole[x]), pa.array(whole[y]), pa.array(home[x]), pa.array(pos[k : k + 500_000].astype(np.int32))], ["row_a", "row_b", "home_a", "pos_a"])

    return run


def _with_last(batches):
    previous = None
    for batch in batches:
        if batch.num_rows:
            if previous is not None:
                yield False, previous
            previous = batch
    if previous is not None:
        yield True, previous


def suffix_bounds(keys: np.ndarray, tokens: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], row: np.ndarray, shift: int) -> np.ndarray:
    """At most so many tokens are in both suffixes of each pair: y is split at its quartiles, and x where they would stand.

    x and y: where the suffixes begin and end in tokens; row: the row of x; keys: row << shift | token, ascending.
    """
    bound = np.zeros(len(row), np.int64)
    at_x, at_y = x[0], y[0]
    size = y[1] - y[0]
    for k in (1, 2, 3, 4):
        if k < 4:
            to_y = y[0] + size * k // 4
            to_x = np.minimum(np.searchsorted(keys, row << shift | tokens[np.minimum(to_y, len(tokens) - 1)]), x[1])
            to_x = np.maximum(to_x, at_x)
        else:
            to_x, to_y = x[1], y[1]
        bound += np.minimum(to_x - at_x, to_y - at_y)
        at_x, at_y = to_x, to_y
    return bound


def verified(threshold: float, a: np.ndarray, b: np.ndarray, pos: np.ndarray, size: np.ndarray, lists: list[np.ndarray], most: int = 2_000_000):
    """(a, b, jaccard) of the pairs of rows that reach the threshold. size: of the whole sets; lists: their shared tokens."""
    share = threshold / (1 + threshold)
    held = np.array(list(map(len, lists)), np.int64)
    end = np.cumsum(held)
    begin = end - held
    flat, tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *lists]), return_inverse=True)
    shift = max(1, int(len(flat)).bit_length())
    keys = np.repeat(np.arange(len(lists)), held) << shift | tokens
    need = np.ceil(share * (size[a] + size[b]) - 1e-9).astype(np.int64)
    from_a = begin[a] + np.maximum(0, pos - (size[a] - held[a]))
    from_b = np.searchsorted(keys, b << shift | tokens[np.minimum(from_a, len(tokens) - 1)]) if len(a) else from_a
    ok = suffix_bounds(keys, tokens, (from_a, end[a]), (from_b, end[b]), a, shift) >= need
    a, b, need, from_b = a[ok], b[ok], need[ok], from_b[ok]
    order = np.argsort(a, kind="stable")
    a, b, need, from_b = a[order], b[order], need[order], from_b[order]
    mark = np.zeros(len(flat), bool)
    both = np.empty(len(a), np.int64)
    for first, last in _cuts(a):
        own = tokens[begin[a[first]] : end[a[first]]]
        mark[own] = True
        n = end[b[first:last]] - from_b[first:last]
        sums = np.cumsum(n)
        done = 0
        while done < len(n):
            k = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + most, "right")))
            m = n[done:k]
            start = np.cumsum(m) - m
            at = np.arange(int(m.sum())) + np.repeat(from_b[first + done : first + k] - start, m)
            hits = np.append(0, np.cumsum(mark[tokens[at]]))
            both[first + done : first + k] = hits[start + m] - hits[start]
            done = k
        mark[own] = False
    ok = both >= need
    a, b, both = a[ok], b[ok], both[ok]
    return a, b, both / (size[a] + size[b] - both)


def _cell(threshold: float, pairs: pa.Table, lists: pa.Table):
    """The verified pairs of a division of a home, as positions in lists."""
    lists = lists.sort_by("row")
    row = lists.column("row").to_numpy()
    a, b = (np.searchsorted(row, pairs.column(c).to_numpy()) for c in ("row_a", "row_b"))
    found = verified(threshold, a, b, pairs.column("pos_a").to_numpy().astype(np.int64), lists.column("size").to_numpy().astype(np.int64), [unpack(x)[0] for x in lists.column("tokens").to_pylist()])
    return lists, *found


def _verify_pairs(threshold: float):
    """(id_a, id_b, jaccard) of each pair."""

    def run(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        lists, a, b, jaccard = _cell(threshold, pairs, lists)
        ids = lists.column("doc_id").combine_chunks()
        return pa.table({"id_a": ids.take(pa.array(a)), "id_b": ids.take(pa.array(b)), "jaccard": pa.array(jaccard)})

    return run


def _verify_links(threshold: float):
    """Of each row with partners how many rows these stand for, its highest index, and a row that it is connected with here: no more rows than lists, however many pairs."""

    def run(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        lists, a, b, jaccard = _cell(threshold, pairs, lists)
        ids, copies, n = lists.column("doc_id").combine_chunks(), lists.column("copies").to_numpy(), lists.num_rows
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        best, root = np.zeros(n), np.arange(n)
        for x in (a, b):
            np.maximum.at(best, x, jaccard)
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        who = pa.array(np.flatnonzero(links))
        return pa.table({"row": lists.column("row").combine_chunks().take(who), "doc_id": ids.take(who), "root": ids.take(pa.array(root)).take(who), "links": pa.array(links.astype(np.int64)).take(who), "best": pa.array(best).take(who)})

    return run


def _joined_lists(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str):
    """(lists, first, near): all rows; of each n-gram set the row that stands for it; and a function of a cell's verification that gives its rows."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    docs = pick(docs, doc_id=id_col, text=text_col)
    kind = docs.dtypes[0][1]
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(16, total // BUCKET_BYTES)
    homes = max(64, rows // HOME_DOCS)
    tasks = max(8, total // TASK_BYTES)
    lists = (
        docs.mapInArrow(_scatter(n, buckets), ROUTED)
        .repartition(tasks, "route")
        .sortWithinPartitions("route")
        .mapInArrow(_frequencies, ROUTED)
        .repartition(tasks, "chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(_lists(threshold, homes), _LISTS.format(kind))
    )
    lists = written(lists)
    live = lists.where("tokens IS NOT NULL")
    first = live.groupBy("mark1", "mark2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    single = written(live.join(first.select(F.col("first.row").alias("row"), "copies"), "row").select("row", "doc_id", "size", "home", "copies", "tokens"))
    postings = single.select("row", "size", "home", "tokens").mapInArrow(_postings(threshold), POSTINGS)
    together = postings.repartition(tasks, "token").sortWithinPartitions("token").mapInArrow(_meet(max(16, rows // ROUTE_DOCS), threshold), ROUTED)
    found = together.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(_candidates(threshold), CANDIDATES)
    pairs = written(found.groupBy("row_a", "row_b").agg(F.first("home_a").alias("home_a"), F.min("pos_a").alias("pos_a")))
    parts = pairs.groupBy("home_a").agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).cast("long").alias("parts")).where("parts > 1")
    share = F.coalesce(F.pmod(F.xxhash64("row_a"), F.col("parts")), F.lit(0)).cast("int")
    placed = pairs.join(small(written(parts)), "home_a", "left").select(F.col("home_a").alias("at"), share.alias("part"), "row_a", "row_b", "pos_a")
    needed = placed.select(F.col("at").alias("home"), F.col("part").alias("division"), F.explode(F.array("row_a", "row_b")).alias("row")).distinct()
    there = needed.join(single.select("row", "doc_id", "size", "copies", "tokens"), "row")

    def near(verify, schema: str) -> DataFrame:
        return placed.groupBy("at", "part").cogroup(there.groupBy("home", "division")).applyInArrow(verify(threshold), schema.format(kind=kind))

    return lists, first, near


def ngram_jaccard_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text", copies: bool = False) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of documents whose sets of word n-grams have a Jaccard index of `threshold` or more.

    doc_id_a < doc_id_b. Documents with equal sets are paired with the lowest id among them
    (jaccard 1.0), and that document alone is paired with others: every other pair follows
    from these, and copies don't make a quadratic number of rows. With `copies`, all pairs of
    all documents are given. The result is exact but for collisions of 56-bit n-gram hashes.

    A text of fewer than n words has one n-gram of all its words; a very long text is compared
    whole. NULL texts, empty texts and texts without words have none and pair with nothing.
    Rows with a NULL id are left out, as no pair could name them. Rows that repeat an id are
    compared like others, but an id isn't paired with itself and a pair of ids is given once,
    with its highest index. Ids may be of any type that has an order. An empty table gives an
    empty result; other columns are left out.
    """
    lists, first, near = _joined_lists(docs, threshold, n, id_col, text_col)
    found = near(_verify_pairs, "id_a {kind}, id_b {kind}, jaccard double")
    sets = lists.where("tokens IS NOT NULL").select("mark1", "mark2", F.col("doc_id").alias("id_b")).join(first, ["mark1", "mark2"])
    alike = sets.select(F.col("first.doc_id").alias("id_a"), "id_b", F.lit(1.0).alias("jaccard"))
    if copies:
        of = written(sets.select(F.col("first.doc_id").alias("of"), "mark1", "mark2", "id_b"))
        by = lambda side: of.select(F.col("of").alias(f"id_{side}"), F.col("id_b").alias(f"copy_{side}")).distinct()
        found = found.join(by("a"), "id_a").join(by("b"), "id_b").select(F.col("copy_a").alias("id_a"), F.col("copy_b").alias("id_b"), "jaccard")
        one = of.select("mark1", "mark2", "id_b").distinct()
        alike = one.join(one.withColumnRenamed("id_b", "id_a"), ["mark1", "mark2"]).select("id_a", "id_b", F.lit(1.0).alias("jaccard"))
    both = found.unionByName(alike).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"), "jaccard").groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def _linked(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str):
    """(lists, first, links, edges): as _joined_lists, with each standing row's links and the edges that connect ids."""
    lists, first, near = _joined_lists(docs, threshold, n, id_col, text_col)
    links = written(near(_verify_links, "row long, doc_id {kind}, root {kind}, links long, best double"))
    alike = lists.where("tokens IS NOT NULL").select("mark1", "mark2", "doc_id").join(first, ["mark1", "mark2"]).select(F.col("first.doc_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    edges = links.select(F.col("root").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")).unionByName(alike).where("doc_id_a <> doc_id_b")
    return lists, first, links, edges


def ngram_jaccard_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links, best) of every row: the classes of documents connected by pairs of a Jaccard index of `threshold` or more.

    class_id is the lowest id of the class, links the number of other rows whose n-gram sets
    reach the threshold with this row's, copies counted each, and best the highest index among
    them. All pairs count, found and verified as for ngram_jaccard_pairs; none is written out.

    A row without a partner has its own id, 0 and NULL: rows with a NULL text or one without
    words among them. Rows with a NULL id aren't compared and have a NULL class. Very long texts
    are compared whole. Rows that repeat an id are compared each, with each other too, and are
    of one class. Ids may be of any type that has an order. An empty table gives an empty
    result; other columns are left out.
    """
    lists, first, links, edges = _linked(docs, threshold, n, id_col, text_col)
    labels = groups(edges)
    sums = links.groupBy("row").agg(F.sum("links").alias("others"), F.max("best").alias("best"))
    sets = first.select("mark1", "mark2", F.col("first.row").alias("row"), "copies").join(sums, "row", "left").select("mark1", "mark2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("best"))
    rows = lists.select("doc_id", F.col("tokens").isNotNull().alias("live"), "mark1", "mark2")
    found = rows.where("live").join(sets, ["mark1", "mark2"]).select("doc_id", "links", "best")
    every = found.unionByName(rows.where("NOT live").select("doc_id", F.lit(0).cast("long").alias("links"), F.lit(None).cast("double").alias("best")))
    return every.join(labels, "doc_id", "left").select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), "links", "best")


def _stars(batches):
    """Each node of a partition's pairs with the lowest node it is connected with there: no more rows than nodes, however many pairs."""
    above: dict = {}

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = [x for x in above if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in part], kind), pa.array(part, kind)], ["doc_id_a", "doc_id_b"])


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, first): every document of the pairs with the lowest id of its connected component.

    Each partition first reduces its pairs to one row per node, without a shuffle. Then, each
    round, a node takes the lowest label among its own and its neighbours' and then its
    label's label, so that chains shorten by half; rounds are written tables.
    """
    kind = pairs.select("doc_id_a").dtypes[0][1]
    pairs = written(pairs.select("doc_id_a", "doc_id_b").mapInArrow(_stars, f"doc_id_a {kind}, doc_id_b {kind}"))
    edges = written(pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).unionByName(pairs.select(F.col("doc_id_b").alias("a"), F.col("doc_id_a").alias("b"))))
    labels = written(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("first")))
    while True:
        near = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("first").alias("low"))
        low = labels.join(near, "doc_id").select("doc_id", "first", F.least("first", "low").alias("low"))
        jump = labels.select(F.col("doc_id").alias("low"), F.col("first").alias("further"))
        now = written(low.join(jump, "low", "left").select("doc_id", "first", F.least("low", F.coalesce("further", "low")).alias("now")))
        changed = now.where("now <> first").limit(1).count()
        labels = now.select("doc_id", F.col("now").alias("first"))
        if not changed:
            return labels


def keep_one_of_each_group(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates, with all columns: of each group connected by pairs the document of the lowest id stays.

    Rows with a NULL id or without words stay. Rows that share an id count as one document
    and stay or go together. Very long texts are compared whole; an empty table stays empty.
    """
    gone = groups(_linked(docs, threshold, n, id_col, text_col)[3]).where("doc_id <> first").select(F.col("doc_id").alias("_gone"))
    gone = small(written(gone))
    return docs.join(gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
