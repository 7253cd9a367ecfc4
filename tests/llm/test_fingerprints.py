import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loam.llm.arrays import ngram_hashes, utf8, word_hashes
from loam.llm.fingerprints import _within, blocks_for, near_fingerprints, simhash, simhash_neighbours, table_masks
from loam.llm.queries import QUERIES


def plain(text):
    term = ngram_hashes(*word_hashes(*utf8(pa.array([text]), lower=True)), 2)[0].tolist()
    bits = [sum(1 if t >> b & 1 else -1 for t in term) for b in range(64)]
    value = sum(1 << b for b, v in enumerate(bits) if v > 0)
    return (value - (1 << 64) if value >> 63 else value) if term else None


def brute(rows, radius=3):
    marks = [(i, plain(t or "")) for i, t in rows]
    first = {}
    for i, m in marks:
        if m is not None and i is not None:
            first[m] = min(first.get(m, i), i)
    near = {m: sorted(first[o] for o in first if o != m and bin((o ^ m) & (2**64 - 1)).count("1") <= radius) for m in first}
    return sorted(((i, m, first.get(m), near.get(m) if i is not None and first.get(m) == i else None) for i, m in marks), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.first_doc_id, r.near) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf, texts):
    assert got(QUERIES["op6_fingerprints"](spark, sf)) == brute(texts.items())


def test_all_within_the_radius(spark):
    random = np.random.default_rng(8)
    base = random.integers(-(2**63), 2**63, 40, dtype=np.int64)
    marks = set(base.tolist())
    for m in base.tolist():
        for k in range(1, 6):
            flips = int(sum(1 << int(b) for b in random.choice(64, k, replace=False)))
            v = (m ^ (flips - (1 << 64) if flips >> 63 else flips))
            marks.add(v)
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    for radius in (1, 3):
        rows = near_fingerprints(df, radius).collect()
        pairs = {(r.a, r.b): r.distance for r in rows}
        assert len(pairs) == len(rows)
        want = {(a, b): d for a in marks for b in marks if a < b and (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= radius}
        assert pairs == want


def test_query_finds_jaccard_near_copies(spark, sf, texts):
    """Of the pairs that share half of their 3-grams or more (without equal sets), nearly all are in the query's wide lists."""
    grams = {i: set(ngram_hashes(*word_hashes(*utf8(pa.array([t or ""]), lower=True)), 3)[0].tolist()) for i, t in texts.items()}
    ids = sorted(i for i in grams if grams[i])
    copies = [(a, b) for a in ids for b in ids if a < b and grams[a] != grams[b] and 2 * len(both := grams[a] & grams[b]) >= len(grams[a]) + len(grams[b]) - len(both)]
    rows = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, sf).collect()}
    mark = {i: rows[i].fingerprint for i in ids}
    listed = lambda a, b: mark[a] == mark[b] or rows[b].first_doc_id in rows[rows[a].first_doc_id].near_copies
    assert copies and sum(listed(a, b) for a, b in copies) >= 0.8 * len(copies)
    assert all(set(r.near) <= set(r.near_copies) for r in rows.values() if r.near is not None)
    firsts = {r.first_doc_id: r.fingerprint for r in rows.values() if r.fingerprint is not None}
    for i, m in firsts.items():
        assert rows[i].near_copies == sorted(o for o, n in firsts.items() if n != m and bin((n ^ m) & (2**64 - 1)).count("1") <= 12)


def test_wide_radius_against_brute_force(spark):
    random = np.random.default_rng(9)
    base = random.integers(-(2**63), 2**63, 60, dtype=np.int64)
    flips = np.bitwise_or.reduce(np.int64(1) << random.integers(0, 64, (60, 14)), axis=1)
    marks = np.unique(np.concatenate([base, base ^ flips, random.integers(-(2**63), 2**63, 700, dtype=np.int64)]))
    rows = near_fingerprints(spark.createDataFrame([(m,) for m in marks.tolist()], "fingerprint long"), 12).collect()
    far = np.bitwise_count((marks[:, None] ^ marks[None]).view(np.uint64))
    a, b = np.nonzero(np.triu(far <= 12, 1))
    want = {(int(x), int(y)): int(d) for x, y, d in zip(marks[a], marks[b], far[a, b])}
    assert want and len(rows) == len(want) and {(r.a, r.b): r.distance for r in rows} == want


def test_a_dense_group_does_not_gather_its_pairs():
    """Close fingerprints share most of 1820 keys: each pair comes once, and while they are found no more than a few batches are held."""
    random = np.random.default_rng(10)
    flips = np.bitwise_or.reduce(np.int64(1) << random.integers(8, 64, (800, 3)), axis=1)
    marks = np.unique(random.integers(-(2**63), 2**63, dtype=np.int64) ^ flips)
    group = pa.RecordBatch.from_arrays([pa.array(marks), pa.array(np.zeros(len(marks), np.int32))], ["fingerprint", "at"])
    seen = [np.empty(0, np.int64)]
    tracemalloc.start()
    try:
        for out in _within(12, 16)(iter([group.slice(0, 300), group.slice(300)])):
            at = [np.searchsorted(marks, out.column(c).to_numpy()) for c in (0, 1)]
            assert out.column("distance").to_pylist() == np.bitwise_count((marks[at[0]] ^ marks[at[1]]).view(np.uint64)).tolist()
            seen.append((at[0] * len(marks) + at[1]).astype(np.int64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = np.sort(np.concatenate(seen))
    far = np.bitwise_count((marks[:, None] ^ marks[None]).view(np.uint64))
    assert got.tolist() == np.flatnonzero(np.triu(far <= 12, 1).ravel()).tolist()
    assert len(got) > 250_000 and peak < 40e6


def test_tables_grow_with_the_corpus():
    assert [blocks_for(n, 3) for n in (0, 1000, 250_000, 10**9, 5 * 10**10)] == [4, 4, 5, 6, 7]
    assert all(len(table_masks(b, 3)) == n for b, n in ((4, 4), (5, 10), (6, 20)))
    assert all(bin(m & (2**64 - 1)).count("1") >= 24 for m in table_masks(5, 3))


def test_wide_tables_have_the_least_work():
    assert [blocks_for(n, 12) for n in (0, 500, 235_000, 2_800_000)] == [13, 14, 15, 16]


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(simhash_neighbours(edge)) == brute(rows)
    assert simhash_neighbours(empty).count() == 0
    mark, have = simhash(*utf8(pa.array(["", "!!", "a b"])))
    assert have.tolist() == [0, 0, 1]
    assert simhash_neighbours(edge).where(F.col("doc_id").isin(1, 2, 7, 8)).where("fingerprint IS NOT NULL OR near IS NOT NULL").count() == 0
