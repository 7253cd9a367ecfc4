from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from loam.llm.bpe import PATTERN, load_ranks
from loam.llm.common import WORD_VOCABULARY
from loam.llm.packing import SumOfSquares, pack_windows
from loam.llm.queries import QUERIES
from loam.llm.sharding import interleave_shards


def test_place_minimises_the_sum_of_squares():
    random = np.random.default_rng(5)
    for capacity in (2, 7, 30):
        packer, level, fill = SumOfSquares(capacity), [0] * (capacity + 1), {}
        for _ in range(400):
            size = int(random.integers(1, capacity))
            scores = {}
            for h in range(capacity - size + 1):
                if h and not level[h]:
                    continue
                after = level.copy()
                if h:
                    after[h] -= 1
                after[h + size] += 1
                scores[h] = sum(x * x for x in after[1:capacity])
            window, at = packer.place(size)
            assert fill.get(window, 0) == at
            assert scores[at] == min(scores.values())
            assert at == max(h for h, s in scores.items() if s == scores[at])
            fill[window] = at + size
            if at:
                level[at] -= 1
            level[at + size] += 1
            assert packer.level[1:capacity].tolist() == level[1:capacity]


def check(rows, sizes, capacity):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_window[r.window_id].append((r.window_offset, r.length))
    assert by_doc.keys() == sizes.keys()
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sizes[doc]
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_window)


@pytest.fixture(scope="module")
def encode():
    ranks = load_ranks(WORD_VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: [*reference(text or ""), max(ranks.values()) + 1]


def contents(rows):
    """The ids of each document, put together from its segments in the windows."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        assert len(r.ids) == r.length
        out[r.doc_id] += r.ids
    return out


def test_packing_query_against_one_packer_in_the_same_order(spark, sf, docs, texts, encode):
    rows = QUERIES["op3_packing"](spark, sf).collect()
    ids = {i: encode(t) for i, t in texts.items()}
    assert contents(rows) == ids
    sizes = {i: len(x) for i, x in ids.items()}
    windows = check(rows, sizes, 2048)
    keys = docs.select("doc_id").withColumn("key", F.xxhash64(F.lit(42), "doc_id")).orderBy("key").collect()
    packer, want = SumOfSquares(2048), []
    for r in keys:
        start = 0
        while sizes[r.doc_id] - start >= 2048:
            want.append((r.doc_id, start, packer.windows, 0))
            packer.windows += 1
            start += 2048
        if start < sizes[r.doc_id]:
            want.append((r.doc_id, start, *packer.place(sizes[r.doc_id] - start)))
    assert sorted((r.doc_id, r.start, r.window_id, r.window_offset) for r in rows) == sorted(want)
    assert windows <= 1.1 * sum(sizes.values()) / 2048 + 1


def test_packing_groups_and_edges(edge, empty, docs, texts, encode):
    ids = {i: encode(t) for i, t in texts.items()}
    rows = pack_windows(docs, capacity=300, docs_per_group=10).collect()
    check(rows, {i: len(x) for i, x in ids.items()}, 300)
    assert contents(rows) == ids
    got, count, want = pack_windows(edge, capacity=16).collect(), Counter(), Counter()
    for r in got:
        count[r.doc_id] += r.length
    for r in edge.collect():
        want[r.doc_id] += len(encode(r.text))
    assert count == want and count[2] == 1
    assert pack_windows(empty).count() == 0
    few = pack_windows(edge, size=F.col("doc_id") - 5)
    assert few.agg(F.min("length")).first()[0] == 1 and few.where("ids IS NOT NULL").count() == 0  # sizes below 1 take no room


def test_packing_sizes_beside_clashing_names(edge):
    clash = edge.withColumn("id", F.col("doc_id").cast("string")).withColumn("a.b", F.col("doc_id"))
    assert pack_windows(clash, size=F.lit(3), id_col="id", capacity=10).count() == edge.count()
    assert pack_windows(clash, id_col="a.b", capacity=1000).select("doc_id").distinct().count() == 12


def test_repeated_rows_are_spread_over_groups(spark):
    for value in ("cast(NULL AS long)", "7L"):
        same = spark.range(3000, numPartitions=3).selectExpr(f"{value} AS doc_id", "'one two three' AS text")
        groups = Counter(r.window_id >> 32 for r in pack_windows(same, docs_per_group=300, capacity=64).collect())
        assert len(groups) == 10 and max(groups.values()) < 600 and sum(groups.values()) >= 3000


def test_shards_have_the_mixture(docs):
    rows = interleave_shards(docs, shards=4).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    total, per = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert all(abs(per[s, source] - n / 4) <= 2 for source, n in total.items() for s in range(4))
    assert {abs(n - len(rows) / 4) < 1 for n in Counter(r.shard for r in rows).values()} == {True}


def test_shards_do_not_depend_on_the_layout(docs):
    a = {(r.doc_id, r.position, r.shard) for r in interleave_shards(docs.repartition(7)).collect()}
    assert a == {(r.doc_id, r.position, r.shard) for r in interleave_shards(docs.coalesce(1)).collect()}
    assert a != {(r.doc_id, r.position, r.shard) for r in interleave_shards(docs, seed=1).collect()}


def test_sharding_edges(edge, empty):
    rows = interleave_shards(edge, shards=40).collect()
    assert sorted(r.position for r in rows) == list(range(edge.count()))
    assert all(r.shard == r.position * 40 // len(rows) for r in rows)
    assert interleave_shards(empty).count() == 0
