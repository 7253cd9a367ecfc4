from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.config import Config
from loam.operators import dedup, freshness, graph, health, lineage, passport, planner, profile, retrieval, rules
from loam.sources.files import chunks_from_lists

NOW = datetime(2024, 3, 1)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


def ids(df, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect())


def test_config(tmp_path):
    c = Config(min_chunk_length=5)
    c.save(tmp_path / "c.json")
    assert Config.from_file(tmp_path / "c.json") == c and Config.from_file(tmp_path / "none.json") == Config()


# --- profiles ---


def test_profile_of_nothing(spark):
    row = profile.chunk_recommendations(profile.chunk_profile(chunks_from_lists(spark, []))).first()
    assert row.total == 0 and row.overall == 0.0 and row.issues == 0 and len(row.recommendations) == 1


def test_profile(spark):
    good = "a sentence that is long enough to count"
    row = profile.chunk_profile(chunks_from_lists(spark, [good, good, "short", "", "   "], metadatas=[{"source": "a"}, {"source": "b"}, None, {}, {}])).first()
    assert (row.total, row.empty_count, row.short_count, row.unique_count, row.duplicate_count, row.unique_sources) == (5, 2, 2, 4, 1, 3)
    lengths = np.array([39, 39, 5, 3])
    assert row.completeness == pytest.approx(1 - 3 / 5) and row.uniqueness == pytest.approx(0.8) and row.validity == pytest.approx(1.0)
    assert row.consistency == pytest.approx(max(0, 1 - lengths.std() / lengths.mean()))
    assert row.overall == pytest.approx((row.completeness + row.uniqueness + row.validity + row.consistency) / 4)


def test_problems(spark):
    good = "an unremarkable sentence of some length"
    rows = profile.chunk_problems(chunks_from_lists(spark, ["", "hi", good, good, "$%^&*" * 10, "w" * 5001, None])).collect()
    assert sorted((r.ordinal, r.problem) for r in rows) == [(0, "empty"), (1, "too_short"), (3, "duplicate"), (4, "gibberish"), (5, "too_long"), (6, "empty")]
    assert [r.duplicate_of for r in rows if r.problem == "duplicate"] == ["chunk_2"]


def test_ratios(spark):
    df = spark.createDataFrame([("a",), (None,), ("",), ("a",), (None,)], "v string")
    row = df.agg(profile.null_ratio(F.col("v")).alias("n"), profile.duplicate_ratio(F.col("v")).alias("d")).first()
    assert (row.n, row.d) == (pytest.approx(0.6), pytest.approx(0.4))
    row = df.where("false").agg(profile.null_ratio(F.col("v")).alias("n"), profile.duplicate_ratio(F.col("v")).alias("d")).first()
    assert (row.n, row.d) == (1.0, 0.0)


def test_knowledge_base(spark):
    docs = spark.createDataFrame([("kb/a.md", "text " * 20, NOW), ("kb/b.md", "", NOW - timedelta(days=400)), ("kb/c.md", "x" * 50, None)], "path string, content string, mtime timestamp_ntz")
    rows = {r.path: r for r in profile.document_profile(docs, as_of()).collect()}
    assert rows["kb/a.md"].overall == 1.0 and rows["kb/b.md"].issues == 2 and rows["kb/c.md"].timeliness == 0.5
    assert rows["kb/b.md"].recommendations == ["Too short or empty", "Stale", "Without content"]
    dims = {r.dimension: r.score for r in profile.knowledge_base_profile(docs, chunks_from_lists(spark, ["some chunk text here ok"], metadatas=[{"source": "x/a.md"}]), as_of()).collect()}
    assert dims["consistency"] == pytest.approx(1 / 3) and dims["uniqueness"] == 1.0
    assert len(profile.knowledge_base_profile(docs.where("false"), None, as_of()).collect()) == 1
    assert profile.overall_of(profile.knowledge_base_profile(docs, None, as_of())).first()["items"] == 3


# --- duplicates ---


def test_exact(spark):
    c = chunks_from_lists(spark, ["alpha beta", "alpha  beta\n", "gamma", "gamma", None, ""], metadatas=[{}, {"a": 1}, {"a": 1}, {"a": 1}, None, {}])
    keep = {r.chunk_id: r.is_keep for r in dedup.exact_duplicates(c).collect()}
    assert keep == {"chunk_0": False, "chunk_1": True, "chunk_2": True, "chunk_3": False, "chunk_4": True, "chunk_5": False}
    assert ids(dedup.duplicate_groups(c), "keep_id") == ["chunk_1", "chunk_2", "chunk_4"]
    assert ids(dedup.survivors(c), "ordinal") == [1, 2, 4]
    row = dedup.duplicate_stats(c).first()
    assert (row.total_items, row.unique_items, row.duplicate_count, row.duplicate_groups) == (6, 3, 3, 3)
    assert dedup.duplicate_stats(c, normalized=False).first().duplicate_count == 2
    assert dedup.duplicate_stats(c.where("false")).first().duplicate_ratio == 0.0


def test_similar(spark):
    random = np.random.default_rng(0)
    base = random.normal(size=(30, 16))
    x = np.concatenate([base, base[:15] + 0.05 * random.normal(size=(15, 16)), np.zeros((2, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, None)], "ordinal long, embedding array<float>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if unit[i] @ unit[j] >= 0.9}
    for block in (7, 4096):
        assert set(ids(dedup.similar_pairs(df, 0.9, rows_per_block=block), "a", "b")) == want
    found = set(ids(dedup.similar_pairs_lsh(df, 0.9, bits=4), "a", "b"))
    assert found <= want and len(found) >= 0.9 * len(want)
    assert dedup.similar_pairs(df.where("false"), 0.9).count() == 0 and dedup.similar_pairs_lsh(df.where("false"), 0.9).count() == 0
    c = df.withColumns({"chunk_id": F.col("ordinal").cast("string"), "content": F.concat(F.lit("t"), (F.col("ordinal") % 40).cast("string")), "metadata": F.create_map().cast("map<string,string>")})
    gone = {r.ordinal: r.removed_by for r in dedup.two_phase(c, 0.9).collect()}
    assert gone[40] == "hash" and "semantic" in gone.values() and 0 not in gone


def near(n, d, of, seed):
    """Vectors in groups that are near each other, zeros and a repeated id among them."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(of, d))[random.integers(0, of, n)] + 0.4 * random.normal(size=(n, d))
    x[3] = 0
    return np.array([*range(n - 1), 7]), x.astype(np.float32)


def brute(i, x, threshold):
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cos = (x := x / np.where(norm == 0, 1, norm)) @ x.T
    pairs = {}
    for a, b in zip(*np.nonzero(cos >= threshold)):
        if i[a] < i[b]:
            pairs[i[a], i[b]] = max(cos[a, b], pairs.get((i[a], i[b]), -2))
    return pairs


def vectors(spark, i, x):
    return spark.createDataFrame([(int(k), row.tolist()) for k, row in zip(i, x)], "ordinal long, embedding array<float>")


@pytest.mark.parametrize("threshold", [-0.1, 0.3, 0.8])
def test_pairs_of_parts_of_blocks(spark, monkeypatch, threshold):
    i, x = near(120, 8, 30, 1)
    want = brute(i, x, threshold)
    rows = dedup._rows(vectors(spark, i, x), "ordinal", "embedding")
    monkeypatch.setattr(dedup, "ROWS", 7)
    monkeypatch.setattr(dedup, "COLUMNS", 11)
    for block in (40, 1000):
        batches = dedup._placed(rows, 120, 8, block).orderBy("task", "side", "id").toArrow().to_batches(max_chunksize=13)
        got = pa.Table.from_batches([*dedup._pairs_of(threshold)(iter(batches))]).to_pylist()
        assert sorted((r["a"], r["b"]) for r in got) == sorted(want)
        assert all(abs(r["similarity"] - want[r["a"], r["b"]]) < 1e-12 for r in got)


def test_lsh_with_few_buckets_joins_no_pairs(spark, monkeypatch):
    i, x = near(300, 16, 60, 2)
    i[-1] = 299
    df = vectors(spark, i, x)
    tables = int(np.ceil(np.log(0.1) / np.log(1 - (1 - np.arccos(0.5) / np.pi) ** 4)))
    side = (x @ np.random.Generator(np.random.PCG64(5)).normal(size=(16, tables * 4)) > 0).reshape(300, tables, 4)
    want = {(a, b) for a, b in brute(i, x, 0.5) if (side[a] == side[b]).all(axis=1).any()}
    assert 0.9 * len(brute(i, x, 0.5)) <= len(want) < len(brute(i, x, 0.5))
    found = dedup.similar_pairs_lsh(df, 0.5, bits=4, recall=0.9)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(ids(found, "a", "b")) == want
    monkeypatch.setattr(dedup, "JOINED_PAIR", 0)
    joined = dedup.similar_pairs_lsh(df, 0.5, bits=4, recall=0.9)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and set(ids(joined, "a", "b")) == want
    same = vectors(spark, range(200), np.ones((200, 4)))  # many buckets, all in one
    monkeypatch.setattr(dedup, "JOINED_PAIR", 100)
    uneven = dedup.similar_pairs_lsh(same, 0.9999, bits=20)
    assert "Join" not in uneven._jdf.queryExecution().executedPlan().toString() and uneven.count() == 199 * 100


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_links_connect_what_pairs_connect(spark, monkeypatch, threshold):
    i, x = near(200, 6, 40, 3)
    df = vectors(spark, i, x)

    def groups(edges):
        return {r.node: r.component for r in graph.connected_components(edges).collect()}

    want = groups(spark.createDataFrame([(int(a), int(b)) for a, b in brute(i, x, threshold)], "a long, b long"))
    assert len(set(want.values())) > 1 or threshold < 0.6
    monkeypatch.setattr(dedup, "ROWS", 9)
    monkeypatch.setattr(dedup, "COLUMNS", 14)
    for block in (70, 1000):
        batches = dedup._placed(dedup._rows(df, "ordinal", "embedding"), 200, 6, block).orderBy("task", "side", "id").toArrow().to_batches(max_chunksize=23)
        links = pa.Table.from_batches([*dedup._links_of(threshold)(iter(batches))])
        assert groups(spark.createDataFrame(links.to_pylist(), "a long, b long")) == want
        assert groups(dedup.similar_links(df, threshold, rows_per_block=block)) == want


def test_links_grow_with_vectors_not_with_pairs(spark):
    df = vectors(spark, range(300), np.ones((300, 4)))
    assert dedup.similar_pairs(df, 0.9).count() == 300 * 299 // 2 and dedup.similar_links(df, 0.9).count() == 299
    assert dedup.similar_links(df.where("false"), 0.9).count() == 0


def test_components_compute_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long").mapInArrow(count, "a long, b long")
    assert graph.connected_components(edges).count() == 21 and seen.value == 20


def test_two_phase_with_vectors_of_their_own(spark):
    c = chunks_from_lists(spark, ["a", "b", "c", "a", "d"])
    v = vectors(spark, [0, 1, 3, 4, 9], np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [0.1, 1.0], [0.0, 1.0]]))
    want = [(3, "hash"), (4, "semantic")]
    assert sorted(ids(dedup.two_phase(c, 0.9, vectors=v), "ordinal", "removed_by")) == want
    assert sorted(ids(dedup.two_phase(c.join(v, "ordinal", "left"), 0.9), "ordinal", "removed_by")) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    assert graph.connected_components(edges.where("false")).count() == 0


# --- rules ---


def test_chunk_rules(spark):
    c = chunks_from_lists(spark, ["a valid chunk of enough length", "", "ab", "bad � text that is long enough", None], metadatas=[{"source": "x"}, {"source": "x"}, {}, {"source": ""}, None])
    rows = rules.validate(c, rules.chunk_rules(), ["ordinal"]).collect()
    failed = {(r.ordinal, r.rule_name): r.severity for r in rows if not r.passed}
    assert failed == {
        (1, "chunk_not_empty"): "error", (1, "chunk_min_length"): "warning", (2, "chunk_min_length"): "warning", (2, "chunk_has_source"): "warning", (3, "chunk_no_replacement_chars"): "warning", (3, "chunk_has_source"): "warning",
        (4, "chunk_not_empty"): "error", (4, "chunk_min_length"): "error", (4, "chunk_max_length"): "error", (4, "chunk_no_replacement_chars"): "error", (4, "chunk_no_control_chars"): "error", (4, "chunk_has_source"): "warning",
    }
    results = rules.validate(c, rules.chunk_rules(), ["ordinal"])
    s = rules.validation_summary(results).first()
    assert (s.total, s.passed, s.errors) == (30, 18, 6)
    assert rules.failures_by_rule(results).first().rule_name == "chunk_has_source"
    assert set(ids(rules.stop_after_error(results), "ordinal")) == {0, 1}
    assert rules.validation_summary(results.where("false")).first().pass_rate == 1.0
    assert rules.first_failures(results, ["ordinal"], 2).count() == 2


def test_own_rules(spark):
    df = spark.createDataFrame([(5,), (15,), (None,)], "value int")
    own = [rules.Rule("big", F.col("value") > 10, message="too small"), rules.Rule("off", F.lit(False), enabled=False), rules.Rule("empty", None)]
    got = sorted((str(r.value), r.rule_name, r.passed, r.severity) for r in rules.validate(df, own, ["value"]).collect())
    assert got == [("15", "big", True, "warning"), ("15", "empty", False, "error"), ("5", "big", False, "warning"), ("5", "empty", False, "error"), ("None", "big", False, "error"), ("None", "empty", False, "error")]
    sets = rules.RuleSets()
    sets.register("memory", own[:1])
    assert sets.validate("memory", df).count() == 3
    assert rules.validate(df, []).count() == 0


# --- freshness ---


def test_policies(spark):
    rows = [("a", "short_term", 40), ("b", "short_term", 20), ("c", "short_term", 15), ("d", "long_term", 9999), ("e", "unknown", 9999), ("f", "web_cache", 7), ("g", "memory", None), ("h", "short_term", -10)]
    df = spark.createDataFrame([(i, c, None if d is None else NOW - timedelta(days=d)) for i, c, d in rows], "asset_id string, category string, updated_at timestamp_ntz")
    got = {r.asset_id: (r.is_stale, r.is_expired, round(r.freshness_score, 6)) for r in freshness.freshness_records(df, freshness.policies(spark), as_of()).collect()}
    assert got == {"a": (True, True, 0.0), "b": (True, False, round(1 / 3, 6)), "c": (False, False, 0.5), "d": (True, False, 0.0), "e": (False, False, 1.0), "f": (True, False, 0.0), "g": (False, False, 1.0), "h": (False, False, round(4 / 3, 6))}
    records = freshness.freshness_records(df, freshness.policies(spark), as_of())
    assert ids(freshness.stale_only(records), "asset_id") == ["b", "d", "f"] and ids(freshness.expired(records), "asset_id") == ["a"]
    assert freshness.freshness_summary(records.where("false")).first().avg_freshness == 0.0
    assert not any(r.is_expired for r in freshness.memory_records(df.drop("category"), freshness.policies(spark), as_of()).collect())


# --- lineage ---


def test_lineage(spark):
    ingests = spark.createDataFrame([(1, "p/a.md", "a.md", ["1", "2"], "kb"), (2, "p/b.md", "b.md", ["3"], "kb")], "seq long, path string, name string, chunk_ids array<string>, collection string")
    nodes, edges = lineage.record_ingestion(ingests)
    first = lineage.first_nodes(nodes)
    assert first.count() == 6 and edges.count() == 6
    one = spark.createDataFrame([("collection:kb",)], "id string")
    assert ids(lineage.upstream(first, edges, one), "id") == ["chunk:1", "chunk:2", "chunk:3"]
    assert ids(lineage.downstream(first, edges, spark.createDataFrame([("file:p/a.md",)], "id string")), "id") == ["chunk:1", "chunk:2"]
    start = spark.createDataFrame([("collection:kb",)], "node string")
    assert ids(lineage.chain(first, edges, start), "id") == ["chunk:1", "chunk:2", "chunk:3", "file:p/a.md", "file:p/a.md", "file:p/b.md"]
    assert ids(lineage.orphaned_chunks(first, spark.createDataFrame([("p/a.md",)], "source string")), "id") == ["chunk:3"]
    lines = [r.line for r in lineage.mermaid(first, edges).orderBy("part", "seq").collect()]
    assert lines[0] == "graph LR" and len(lines) == 13
    cache_nodes, cache_edges = lineage.record_web_cache(spark.createDataFrame([(1, "http://x", "c.md", "w")], "seq long, url string, path string, collection string"))
    assert sorted((r.kind, r.name, r.n) for r in lineage.lineage_stats(cache_nodes, cache_edges).collect()) == [("edge", "fetch_cache", 1), ("edge", "ingest", 1), ("node", "source", 1), ("node", "storage", 1), ("node", "transform", 1)]
    assert lineage.record_chat_export(spark.createDataFrame([(1, "c", "f.md", 3)], "seq long, chat string, path string, qa_count int"))[1].first().operation == "export_qa"


def test_cycles_and_unknown_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "gone"), ("a", "b")], "source string, target string")
    got = ids(lineage.chain(nodes, edges, spark.createDataFrame([("a",)], "node string"), up=False), "at", "id")
    assert got == [("a", "b"), ("b", "c"), ("c", "a")]


# --- health ---


def test_health(spark):
    one = lambda **kw: spark.createDataFrame([kw])
    parts = health.health_components(quality=one(overall=0.5), validation=one(total=10, passed=8), dedup=one(duplicate_ratio=0.1), freshness=one(avg_freshness=0.4))
    row = health.health_score(parts).first()
    assert row.overall == pytest.approx(0.5 * 0.35 + 0.8 * 0.25 + 0.9 * 0.2 + 0.4 * 0.2) and row.status == "warning"
    alone = health.health_components(validation=one(total=0, passed=0), dedup=one(duplicate_ratio=0.1))
    assert health.health_score(alone).first().overall == pytest.approx(0.9)
    assert health.health_score(alone.where("false")).first().status == "unknown"
    alerts = health.with_state(health.health_alerts(health.health_score(parts), parts, as_of(), 0.9))
    assert ids(alerts, "kind") == ["component_Freshness", "health"]
    first = alerts.orderBy("kind").first().id
    assert ids(alerts, "id") == ids(health.with_state(health.health_alerts(health.health_score(parts), parts, as_of(), 0.9)), "id")
    assert health.active(health.update_alert(alerts, first, resolved=True)).count() == 1
    assert health.active(health.update_alert(alerts, first, acknowledged=True)).count() == 2
    assert health.alert_summary(alerts).first().warning == 2
    with pytest.raises(ValueError):
        health.health_components()


@pytest.mark.parametrize(("scores", "want"), [([], "unknown"), ([0.5], "unknown"), ([0.5, 0.6, 0.7], "improving"), ([0.8, 0.7, 0.6], "degrading"), ([0.5, 0.52], "stable"), ([0.1, 0.9, 0.9, 0.9, 0.9, 0.9], "stable")])
def test_trend(spark, scores, want):
    df = spark.createDataFrame([(NOW + timedelta(days=i), s) for i, s in enumerate(scores)], "ts timestamp_ntz, health_score double")
    assert health.trend(df).first().trend == want


# --- passports ---


def test_passports(spark):
    assets = spark.createDataFrame([(i, f"a{i}", f"text {i}", "doc", None) for i in range(5)] + [(9, "a0", "newer", "doc", "p")], "seq long, asset_id string, content string, source_type string, source_path string")
    made = passport.create_passports(assets, as_of())
    assert made.count() == 5 and passport.passport_of(made, "a0").first().source_path == "p"
    marks = spark.createDataFrame([("a0", 0.9, 0.8), ("a1", 0.1, 0.1), ("a2", 0.65, 0.5), ("a3", 0.3, 0.9), ("zz", 1.0, 1.0)], "asset_id string, quality_score double, freshness_score double")
    done = passport.assess(made, marks, as_of())
    assert {r.asset_id: r.trust_level for r in done.collect()} == {"a0": "verified", "a1": "quarantined", "a2": "trusted", "a3": "suspect", "a4": "unverified"}
    assert ids(passport.trusted(done), "asset_id") == ["a0", "a2"] and ids(passport.quarantined(done), "asset_id") == ["a1"]
    s = passport.passport_stats(done).first()
    assert (s.total, s.assessed, s.verified, s.quarantined) == (5, 4, 1, 1)
    acts = spark.createDataFrame([("a0", "x", "me", NOW, "d"), ("a0", "w", "me", NOW - timedelta(1), "d")], "asset_id string, action string, agent_id string, ts timestamp_ntz, details string")
    assert [a.action for a in passport.passport_of(passport.record_action(done, acts), "a0").first().actions] == ["w", "x"]
    assert passport.as_context(done).where("asset_id = 'a4'").first().line == "[a4] trust=unverified quality=0.00 freshness=0.00 source=unknown"
    assert passport.as_metadata(done).where("asset_id = 'a0'").first().metadata["trust_level"] == "verified"
    with pytest.raises(ValueError):
        passport.assess(made, marks.withColumnRenamed("quality_score", "nonsense"), as_of())


# --- retrieval ---


def test_retrieval(spark):
    c = chunks_from_lists(spark, ["a good chunk of text, long enough", " ", "$%^&" * 9, None], metadatas=[{"source": "f"}, {"source": "none"}, {}, None])
    files = spark.createDataFrame([("f", NOW - timedelta(days=90))], "path string, mtime timestamp_ntz")
    rows = {r.ordinal: r for r in retrieval.embed_quality(c, as_of(), files).collect()}
    assert rows[0].freshness_score == 0.5 and rows[1].freshness_score == 0.5 and rows[2].freshness_score is None
    assert [rows[i].is_quarantined for i in range(4)] == [False, True, False, True] and rows[1].char_count is None
    s = retrieval.quality_summary(retrieval.embed_quality(c, as_of())).first()
    assert s.coverage == 1.0 and s.quarantine_rate == 0.5 and s.excellent + s.good + s.fair + s.poor == 4
    results = spark.createDataFrame([(1, 0.2, False), (1, None, None), (1, 0.9, True), (2, 0.9, False)], "query_id int, quality_score double, is_quarantined boolean")
    assert retrieval.retrieval_filter(results).count() == 2 and retrieval.retrieval_filter(results, exclude_quarantined=False).count() == 3
    assert ids(retrieval.search_gate(results), "query_id", "original", "kept", "removed") == [(1, 3, 1, 2), (2, 1, 1, 0)]
    assert ids(retrieval.noise_chunks(c), "ordinal") == [1, 3]
    assert sorted((r.ordinal, r.reason) for r in retrieval.quarantine_set(c).collect()) == [(1, "empty"), (2, "gibberish"), (3, "empty")]


# --- planner ---


def signal(spark, **kw):
    base = dict(health_score=0.9, quality_score=0.9, quality_issues=0, total_chunks=10, duplicate_count=0, duplicate_ratio=0.0, validation_errors=0, validation_pass_rate=1.0, stale_count=0, expired_count=0, freshness_score=1.0) | kw
    return spark.createDataFrame([tuple(base[c.split()[0]] for c in planner.SIGNALS.split(", "))], planner.SIGNALS)


def test_decisions(spark):
    assert ids(planner.decisions(signal(spark)), "decision_type") == ["no_action"]
    row = signal(spark, health_score=0.4, quality_score=0.5, quality_issues=3, duplicate_count=11, expired_count=1, stale_count=6, validation_errors=2)
    decided = planner.decisions(row)
    order = [(r.decision_type, r.severity) for r in planner.ordered(decided).collect()]
    assert order == [("delete_duplicates", "high"), ("delete_empty_chunks", "high"), ("delete_expired", "medium"), ("quarantine", "medium"), ("schedule_review", "low")]
    plan = planner.action_plan(decided, row).first()
    assert (plan.decisions, plan.high, plan.auto_executable, plan.needs_approval, plan.auto_execute) == (5, 2, 2, 3, True)
    assert plan.estimated_improvement == pytest.approx(0.25) and plan.plan_id == planner.action_plan(decided, row).first().plan_id
    assert planner.auto_safe(decided).count() == 2 and planner.needs_approval(decided).count() == 3 and planner.critical(decided).count() == 0
    assert planner.messages(decided).orderBy("seq").first().message == "[HIGH] delete_duplicates (confidence 99%): 11 exact duplicates"
    state = planner.governance_state(row, spark.createDataFrame([("stable",)], "trend string")).first()
    assert state.status == "unhealthy" and state.needs_dedup and state.needs_review


@pytest.mark.parametrize(("hours", "score", "want"), [(None, None, True), (0.5, 0.3, False), (2, 0.9, False), (2, 0.5, True), (7, 0.9, True)])
def test_should_run(spark, hours, score, want):
    rows = [] if hours is None else [(NOW - timedelta(hours=hours), score)]
    assert planner.should_run(spark.createDataFrame(rows, "ts timestamp_ntz, health_score double"), as_of()).first().run is want
