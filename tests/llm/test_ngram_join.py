import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import ngram_join
from loam.llm.ngram_join import groups, keep_one_of_each_group, ngram_jaccard_classes, ngram_jaccard_pairs, pack, unpack
from loam.llm.queries import QUERIES


def grams(text, n=3):
    words = [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, t=0.5, n=3):
    sets = [(i, grams(x, n)) for i, x in rows if i is not None and grams(x, n)]
    first, best = {}, {}
    for i, s in sets:
        first[s] = min(first.get(s, i), i)
    for i, s in sets:
        if first[s] != i:
            best[first[s], i] = 1.0
    distinct, lists, shared = list(first), defaultdict(list), Counter()
    for k, s in enumerate(distinct):
        for g in s:
            lists[g].append(k)
    for members in lists.values():
        for x in range(len(members)):
            for y in range(x):
                shared[members[y], members[x]] += 1
    for (x, y), k in shared.items():
        j = k / (len(distinct[x]) + len(distinct[y]) - k)
        a, b = sorted((first[distinct[x]], first[distinct[y]]))
        if j >= t - 1e-12 and a != b:
            best[a, b] = max(best.get((a, b), 0), j)
    return best


def links(rows, t=0.5, n=3):
    """(doc_id, class_id, links, best) of every row, from all pairs of rows; rows of one id are of one class."""
    sets = [grams(x, n) if i is not None else frozenset() for i, x in rows]
    have, lists, shared = [len(s) for s in sets], defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            lists[g].append(k)
    for members in lists.values():
        for x in range(len(members)):
            for y in range(x):
                shared[members[y], members[x]] += 1
    near, label = defaultdict(list), {i: i for i, _ in rows}
    for (x, y), k in shared.items():
        j = k / (have[x] + have[y] - k)
        if j >= t - 1e-12:
            near[x].append((y, j))
            near[y].append((x, j))
    while True:
        before = dict(label)
        for x, partners in near.items():
            for y, _ in partners:
                label[rows[x][0]] = min(label[rows[x][0]], label[rows[y][0]])
        if label == before:
            break
    return sorted(((i, label[i], len(near[k]), max((j for _, j in near[k]), default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def found(df):
    rows = df.collect()
    assert len({(r.doc_id_a, r.doc_id_b) for r in rows}) == len(rows)
    return {(r.doc_id_a, r.doc_id_b): r.jaccard for r in rows}


def classes(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "links", "best").collect()), key=repr)


def same(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_query_against_brute_force(spark, sf, texts):
    assert classes(QUERIES["op5_ngram_jaccard_join"](spark, sf)) == links(list(texts.items()))


def test_pairs_against_brute_force(docs, texts):
    same(found(ngram_jaccard_pairs(docs)), brute(texts.items()))


def near_copies(seed=3):
    random = np.random.default_rng(seed)
    base = [" ".join(random.choice(list("abcdefgh"), 12)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = base[i % 12].split()
        for _ in range(int(random.integers(0, 5))):
            words[int(random.integers(len(words)))] = str(random.choice(list("abcdefghxyz")))
        rows.append((i, " ".join(words)))
    return rows


def test_random_texts_and_thresholds(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for t in (0.2, 0.5, 0.8, 1.0):
        same(found(ngram_jaccard_pairs(df, t, n=2)), brute(rows, t, 2))
        assert classes(ngram_jaccard_classes(df, t, n=2)) == links(rows, t, 2)
    every = {(a, b): j for a, x in rows for b, y in rows if a < b and (j := len(grams(x, 2) & grams(y, 2)) / len(grams(x, 2) | grams(y, 2))) >= 0.5}
    same(found(ngram_jaccard_pairs(df, 0.5, n=2, copies=True)), every)


def test_small_blocks_and_cells_change_nothing(spark, monkeypatch):
    """Long lists of an n-gram, frequent n-grams of a chunk and homes of many pairs are divided; the result is the same."""
    rows = near_copies(8) + [(1000 + i, f"a b c d e f g h i j {'k' * (i % 7)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("LIST_ROWS", 4), ("OFTEN", 1), ("CELL_PAIRS", 20), ("CHUNK_DOCS", 16), ("CHUNK_NGRAMS", 50), ("ROUTE_DOCS", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    for t in (0.3, 0.6):
        assert classes(ngram_jaccard_classes(df, t, n=2)) == links(rows, t, 2)
        same(found(ngram_jaccard_pairs(df, t, n=2)), brute(rows, t, 2))


def test_pairs_beyond_64_bits_with_their_positions():
    """As many rows in one place as no longer leave room for the position in the pair's number."""
    n = 1_600_000
    row = np.arange(n, dtype=np.int64)
    token, size = row.copy(), np.full(n, 100, np.int32)
    token[-3:] = n
    raw = b"".join(x.tobytes() for x in (token, row, size, np.zeros(n, np.int32), np.zeros(n, np.int32)))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([zstandard.ZstdCompressor().compress(raw)])], ["route", "chunk", "blob"])
    got = [p for b in ngram_join._candidates(0.5)([batch]) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(got) == [(n - 3, n - 2), (n - 3, n - 1), (n - 2, n - 1)]


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = found(ngram_jaccard_pairs(edge))
    same(got, brute(rows))
    assert got == {(5, 6): 1.0}
    assert found(ngram_jaccard_pairs(empty)) == {}
    found_classes = classes(ngram_jaccard_classes(edge))
    assert len(found_classes) == len(rows)
    assert [r for r in found_classes if r[0] in (5, 6, None)] == [(5, 5, 2, 1.0), (5, 5, 2, 1.0), (6, 5, 0, None), (6, 5, 2, 1.0), (None, None, 0, None), (None, None, 0, None)]
    assert ngram_jaccard_classes(empty).count() == 0


def test_text_ids_and_dotted_names(spark):
    rows = [(f"d{i:03d}", x) for i, x in near_copies(4)]
    df = spark.createDataFrame(rows, "`my.id` string, text string")
    assert classes(ngram_jaccard_classes(df, 0.5, n=2, id_col="my.id")) == links(rows, 0.5, 2)
    same(found(ngram_jaccard_pairs(df, 0.5, n=2, id_col="my.id")), brute(rows, 0.5, 2))
    kept = keep_one_of_each_group(df, 0.5, n=2, id_col="my.id")
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {i for i, c, _, _ in links(rows, 0.5, 2) if i == c}


def test_groups_are_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 300)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "doc_id_a long, doc_id_b long, jaccard double")
    got = {r.doc_id: r.first for r in groups(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}


def test_one_of_each_group_stays(edge, empty, docs, texts):
    kept = keep_one_of_each_group(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, 11]
    assert keep_one_of_each_group(empty).count() == 0
    label, pairs = {i: i for i in texts}, brute(texts.items())
    for _ in range(len(texts)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in keep_one_of_each_group(docs).collect()} == {i for i in texts if label[i] == i}


@given(st.lists(st.integers(0, 2**63), unique=True), st.binary(max_size=20))
@settings(max_examples=60, deadline=None)
def test_packed_numbers_come_back(values, extra):
    array = np.array(sorted(values), np.uint64)
    back, rest = unpack(pack(array, extra))
    assert (back == array).all() and rest == extra


@given(st.lists(st.sets(st.integers(0, 60)), min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_verified_pairs_are_those_that_reach_the_threshold(found_sets):
    lists = [np.array(sorted(s), np.uint64) for s in found_sets]
    pairs = [(i, j) for i in range(len(lists)) for j in range(i + 1, len(lists)) if found_sets[i] & found_sets[j]]
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    pos = np.array([sorted(found_sets[i]).index(min(found_sets[i] & found_sets[j])) for i, j in pairs], np.int64)
    got = {(int(x), int(y)): z for x, y, z in zip(*ngram_join.verified(0.4, a, b, pos, np.array([len(x) for x in lists]), lists, most=7))}
    want = {(i, j): k for i, j in pairs if (k := len(found_sets[i] & found_sets[j]) / len(found_sets[i] | found_sets[j])) >= 0.4 - 1e-12}
    assert got == want
