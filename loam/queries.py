"""Every operator as a query over the tables of a folder, by name. The clock is a constant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import dedup, freshness, graph, health, lineage, passport, planner, profile, retrieval, rules
from loam.plans import checks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "timestamp_ntz'2024-02-14 00:00:00'"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.expr(AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks; labelled ones have a metadata key more."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS ordinal", "concat('doc_', doc_id) AS chunk_id", "text AS content", "map('source', source, 'lang', lang) AS metadata", "lang")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of up to 400 days of age."""
    return table(spark, sf_dir, "documents").selectExpr("concat(source, '/doc_', doc_id, '.txt') AS path", "text AS content", f"{AS_OF} - make_dt_interval(cast(doc_id % 400 AS int)) AS mtime", "lang")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of events, each with its last event and one of six categories."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    kinds = F.array(*map(F.lit, ["short_term", "web_cache", "long_term", "chat_history", "memory", "unknown"]))
    return last.select(F.concat(F.lit("user_"), "user_id").alias("asset_id"), F.element_at(kinds, (F.col("user_id") % 6 + 1).cast("int")).alias("category"), "updated_at")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.freshness_records(assets(spark, sf_dir), freshness.policies(spark), as_of())


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- text functions ---


@query
def text_metrics(spark, sf_dir):
    x = F.col("text")
    return rounded(table(spark, sf_dir, "documents").select("doc_id", T.text_length(x).alias("text_length"), T.word_count(x).alias("word_count"), T.char_density(x).alias("char_density"), T.cjk_ratio(x).alias("cjk_ratio")))


@query
def text_entropy(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", T.entropy(F.col("text")).alias("entropy")))


@query
def gibberish_components(spark, sf_dir):
    a, b, c = T.gibberish_parts(F.col("text"))
    return rounded(table(spark, sf_dir, "documents").select("doc_id", a.alias("replacement"), b.alias("control"), c.alias("special"), T.gibberish_score(F.col("text")).alias("gibberish")))


@query
def quality_score(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", T.chunk_quality(F.col("text")).alias("quality")))


@query
def completeness_sections(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", T.completeness_score(F.col("text"), 400, ["license", "THE", "und "]).alias("completeness")))


@query
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized_hash(F.col("text")).alias("hash"), T.short_sha256(F.col("text")).alias("sha16"), F.length(T.normalize(F.col("text"))).alias("length"))


@query
def path_functions(spark, sf_dir):
    url = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return url.select("page_id", T.basename(F.col("path")).alias("name"), T.suffix(F.col("path")).alias("suffix"), T.path_category(F.concat(F.element_at(F.array(F.lit("short_term"), F.lit("long_term"), F.lit("短期"), F.lit("x")), (F.col("page_id") % 4 + 1).cast("int")), F.when(F.col("page_id") % 3 == 0, "/_cache_web/").otherwise("/"), F.lit("a.md"))).alias("category"))


@query
def null_dup_ratio(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = None
    for name, c in (("event_type", "event_type"), ("props", "props"), ("user_id", "cast(user_id AS string)")):
        row = events.select(F.expr(c).alias("v")).agg(profile.null_ratio(F.col("v")).alias("null_ratio"), profile.duplicate_ratio(F.col("v")).alias("duplicate_ratio")).withColumn("column", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


# --- profiles ---


@query
def chunk_profile(spark, sf_dir):
    return rounded(profile.chunk_profile(chunks(spark, sf_dir)))


@query
def chunk_profile_by_lang(spark, sf_dir):
    return rounded(profile.chunk_profile(chunks(spark, sf_dir), ["lang"]))


@query
def chunk_profile_cube(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("src", F.col("metadata")["source"])
    return rounded(profile.chunk_profile(c, ["lang", "src"], how="cube").select("lang", "src", "total", "unique_count", "completeness", "validity"))


@query
def chunk_problems(spark, sf_dir):
    return rounded(profile.chunk_problems(chunks(spark, sf_dir)))


@query
def problem_counts(spark, sf_dir):
    return profile.chunk_problems(chunks(spark, sf_dir)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def document_profile(spark, sf_dir):
    return rounded(profile.document_profile(files(spark, sf_dir), as_of()).withColumn("recommendations", F.array_join("recommendations", "; ")))


@query
def recommendations(spark, sf_dir):
    return profile.merged_recommendations(profile.document_profile(files(spark, sf_dir), as_of()))


@query
def kb_profile(spark, sf_dir):
    return rounded(profile.knowledge_base_profile(files(spark, sf_dir), chunks(spark, sf_dir), as_of()))


@query
def ingest_gate(spark, sf_dir):
    return retrieval.ingest_gate(profile.document_profile(files(spark, sf_dir), as_of())).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _names(spark, sf_dir):
    """Files of all documents, and the sources in the store of all embeddings."""
    return table(spark, sf_dir, "documents").selectExpr("concat('kb/', source, '/', doc_id, '.md') AS name"), table(spark, sf_dir, "embeddings").selectExpr("concat('/mnt/', vec_id, '.md') AS source")


@query
def file_store_consistency(spark, sf_dir):
    return rounded(profile.name_consistency(*_names(spark, sf_dir)))


@query
def orphan_names(spark, sf_dir):
    names, sources = _names(spark, sf_dir)
    sources = sources.withColumnRenamed("source", "name")
    left = profile.orphans(names, sources, limit=None).withColumn("side", F.lit("file"))
    return left.unionByName(profile.orphans(sources, names, limit=None).withColumn("side", F.lit("store")))


# --- duplicates ---


@query
def exact_dup_rows(spark, sf_dir):
    return dedup.exact_duplicates(chunks(spark, sf_dir))


@query
def exact_dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(chunks(spark, sf_dir)).withColumn("remove_ids", F.array_join("remove_ids", ","))


@query
def exact_dup_stats(spark, sf_dir):
    return rounded(dedup.duplicate_stats(chunks(spark, sf_dir)))


@query
def exact_dup_raw(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS ordinal", "concat('page_', page_id) AS chunk_id", "html AS content", "map('source', url) AS metadata")
    return rounded(dedup.duplicate_stats(pages, normalized=False))


@query
def dup_keep_by_metadata(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), F.col("quality").cast("string").alias("q"))
    c = chunks(spark, sf_dir).join(known, "ordinal", "left").withColumn("metadata", F.when(F.col("q").isNotNull(), F.map_concat("metadata", F.create_map(F.lit("quality"), F.col("q")))).otherwise(F.col("metadata")))
    return dedup.exact_duplicates(c).where("group_size > 1")


@query
def dedup_survivors(spark, sf_dir):
    return dedup.survivors(chunks(spark, sf_dir)).select("ordinal", "chunk_id")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS ordinal", "embedding")


@query
def semantic_pairs(spark, sf_dir):
    return rounded(dedup.similar_pairs(_vectors(spark, sf_dir), 0.4), 5)


@query
def semantic_groups(spark, sf_dir):
    return dedup.semantic_groups(dedup.similar_links(_vectors(spark, sf_dir), 0.4))


@query
def semantic_pairs_lsh(spark, sf_dir):
    return rounded(dedup.similar_pairs_lsh(_vectors(spark, sf_dir), 0.45, bits=6, recall=0.98), 5)


@query
def two_phase_dedup(spark, sf_dir):
    return dedup.two_phase(chunks(spark, sf_dir), 0.4, vectors=_vectors(spark, sf_dir))


# --- validation ---


@query
def validate_chunks(spark, sf_dir):
    return rules.validate(chunks(spark, sf_dir), rules.chunk_rules(), ["ordinal"]).select("ordinal", "rule_name", "passed", "severity")


@query
def validate_summary(spark, sf_dir):
    return rounded(rules.validation_summary(rules.validate(chunks(spark, sf_dir), rules.chunk_rules())))


@query
def validate_failures_by_rule(spark, sf_dir):
    return rules.failures_by_rule(rules.validate(chunks(spark, sf_dir), rules.chunk_rules()))


@query
def validate_first_failures(spark, sf_dir):
    return rules.first_failures(rules.validate(chunks(spark, sf_dir), rules.chunk_rules(), ["ordinal"]), ["ordinal"]).select("ordinal", "rule_name")


@query
def validate_fail_fast(spark, sf_dir):
    return rules.stop_after_error(rules.validate(chunks(spark, sf_dir), rules.chunk_rules(), ["ordinal"])).select("ordinal", "rule_name", "passed")


LINE = "CASE WHEN conv_id % 7 = 0 THEN concat('{bad ', turn) WHEN conv_id % 5 = 0 THEN concat('{\"content\":\"m', turn, '\"}') WHEN conv_id % 3 = 0 THEN concat('{\"role\":\"', role, '\",\"content\":\"\"}') ELSE concat('{\"role\":\"', role, '\",\"text\":\"m', turn, '\"}') END"


@query
def validate_chat(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{LINE} AS line")
    return rules.validate(lines, rules.chat_rules(), ["conv_id", "turn"]).select("conv_id", "turn", "rule_name", "passed")


@query
def validate_memory(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("intro\n## "), F.col("text"))).otherwise(F.col("text")).alias("content"))
    return rules.validate(notes, rules.memory_rules(), ["doc_id"]).select("doc_id", "rule_name", "passed", "severity")


@query
def validate_files(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "concat('kb/', page_id, element_at(array('.md', '.TXT', '.html', '.pdf'), cast(page_id % 4 + 1 AS int))) AS path", "page_id % 9 <> 0 AS found", "cast(octet_length(html) AS bigint) AS size", "encode(html, 'utf-8') AS content")
    return rules.validate(rows, rules.file_rules(8000), ["page_id"]).select("page_id", "rule_name", "passed")


# --- freshness ---


@query
def freshness_records(spark, sf_dir):
    return rounded(records(spark, sf_dir).select("asset_id", "category", "age_days", "is_stale", "is_expired", "freshness_score"))


@query
def freshness_report(spark, sf_dir):
    return rounded(freshness.freshness_summary(records(spark, sf_dir)))


@query
def expired_actions(spark, sf_dir):
    return freshness.expired(records(spark, sf_dir)).select("asset_id", "category", "action")


@query
def stale_not_expired(spark, sf_dir):
    return freshness.stale_only(records(spark, sf_dir)).select("asset_id", "category")


@query
def order_ages(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), "o_orderkey").alias("asset_id"), F.lit("memory").alias("category"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return rounded(freshness.memory_records(old.drop("category"), freshness.policies(spark), F.expr("timestamp_ntz'1998-08-02 00:00:00'")).groupBy("is_stale", "is_expired").agg(F.count(F.lit(1)).alias("n"), F.avg("freshness_score").alias("avg_freshness")))


# --- lineage ---


def _lineage(spark, sf_dir):
    customer, orders, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    nodes = nation.selectExpr("concat('nation:', n_nationkey) AS id", "n_name AS name", "'source' AS node_type", "map('path', n_name) AS metadata", "cast(n_nationkey AS bigint) AS seq")
    nodes = nodes.unionByName(customer.selectExpr("concat('customer:', c_custkey)", "c_name", "'transform'", "map('source', concat('nation:', c_nationkey))", "cast(c_custkey AS bigint)").toDF(*nodes.columns))
    nodes = nodes.unionByName(orders.selectExpr("concat('order:', o_orderkey)", "cast(o_orderkey AS string)", "'storage'", "map('status', o_orderstatus)", "cast(o_orderkey AS bigint)").toDF(*nodes.columns))
    edges = customer.selectExpr("concat('nation:', c_nationkey) AS source", "concat('customer:', c_custkey) AS target", "'chunk' AS operation", "cast(c_custkey AS bigint) AS seq")
    edges = edges.unionByName(orders.selectExpr("concat('customer:', o_custkey)", "concat('order:', o_orderkey)", "'embed_store'", "cast(o_orderkey AS bigint)").toDF(*edges.columns))
    return nodes, edges


@query
def lineage_upstream(spark, sf_dir):
    nodes, edges = _lineage(spark, sf_dir)
    return lineage.upstream(nodes, edges, nodes.where("node_type = 'storage'").select("id"))


@query
def lineage_downstream(spark, sf_dir):
    nodes, edges = _lineage(spark, sf_dir)
    return lineage.downstream(nodes, edges, nodes.where("node_type = 'source'").select("id"))


@query
def lineage_chain(spark, sf_dir):
    nodes, edges = _lineage(spark, sf_dir)
    return lineage.chain(nodes, edges, spark.createDataFrame([("nation:3",), ("nation:7",)], "node string"), up=False)


@query
def lineage_stats(spark, sf_dir):
    return lineage.lineage_stats(*_lineage(spark, sf_dir))


@query
def lineage_orphans(spark, sf_dir):
    nodes, _ = _lineage(spark, sf_dir)
    kept = table(spark, sf_dir, "nation").where("n_regionkey < 3").selectExpr("concat('nation:', n_nationkey) AS source")
    return lineage.orphaned_chunks(nodes, kept).select("id", "source")


@query
def lineage_mermaid(spark, sf_dir):
    return lineage.mermaid(*_lineage(spark, sf_dir))


@query
def lineage_first_nodes(spark, sf_dir):
    nodes, edges = lineage.record_ingestion(table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("seq"), F.collect_list(F.col("doc_id").cast("string")).alias("chunk_ids")).selectExpr("seq", "source AS path", "source AS name", "chunk_ids", "'kb' AS collection"))
    return lineage.first_nodes(nodes).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query
def web_cache_lineage(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS seq", "url", "concat('cache/', page_id, '.md') AS path", "'kb_web_cache' AS collection")
    nodes, edges = lineage.record_web_cache(pages)
    return lineage.lineage_stats(lineage.first_nodes(nodes), edges)


@query
def components(spark, sf_dir):
    return graph.connected_components(dedup.similar_links(_vectors(spark, sf_dir), 0.35)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


# --- health, alerts, plans ---


def _check(spark, sf_dir) -> checks.Signals:
    return checks.signals(chunks(spark, sf_dir), records(spark, sf_dir))


@query
def health_components(spark, sf_dir):
    return rounded(_check(spark, sf_dir).components)


@query
def health_score(spark, sf_dir):
    return rounded(health.health_score(_check(spark, sf_dir).components))


@query
def health_alerts(spark, sf_dir):
    by = health.health_components(quality=profile.chunk_profile(chunks(spark, sf_dir)), freshness=freshness.freshness_summary(records(spark, sf_dir)))
    return health.health_alerts(health.health_score(by), by, as_of(), threshold=0.95).select("kind", "level", "title", "message")


@query
def freshness_alerts(spark, sf_dir):
    return health.freshness_alerts(freshness.freshness_summary(records(spark, sf_dir)), as_of()).select("kind", "level", "message")


@query
def dedup_alerts(spark, sf_dir):
    return health.dedup_alerts(dedup.duplicate_stats(chunks(spark, sf_dir)), as_of()).select("kind", "level", "message")


@query
def alert_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), (F.col("event_id") % 3 + 1).cast("int")).alias("level"), (F.col("event_id") % 4 == 0).alias("resolved"))
    return health.alert_summary(e)


@query
def health_trend(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts")).agg((F.round(F.avg("value"), 6) / 100).alias("health_score"))
    return health.trend(days)


@query
def decisions(spark, sf_dir):
    return planner.decisions(_check(spark, sf_dir).row)


@query
def action_plan(spark, sf_dir):
    row = _check(spark, sf_dir).row
    return rounded(planner.action_plan(planner.decisions(row), row).drop("plan_id"))


@query
def governance_state(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts")).agg((F.round(F.avg("value"), 6) / 100).alias("health_score"))
    return rounded(planner.governance_state(_check(spark, sf_dir).row, health.trend(days)))


# --- passports and retrieval ---


def _passports(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "concat('doc_', doc_id) AS asset_id", "text AS content", "'document' AS source_type", "source AS source_path")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).selectExpr("concat('doc_', doc_id) AS asset_id", "quality * 0.6D + (1 - toxic) * 0.3D AS quality_score", "CASE WHEN toxic = 0 THEN 0.9D ELSE 0.2D END AS freshness_score")
    return passport.assess(passport.create_passports(docs, as_of()), marks, as_of())


@query
def passports(spark, sf_dir):
    return rounded(_passports(spark, sf_dir).select("asset_id", "passport_id", "quality_score", "freshness_score", "trust_level", "assessment_count"))


@query
def passport_trust(spark, sf_dir):
    return passport.trust_histogram(_passports(spark, sf_dir))


@query
def passport_stats(spark, sf_dir):
    return rounded(passport.passport_stats(_passports(spark, sf_dir)))


@query
def trusted_only(spark, sf_dir):
    return passport.trusted(_passports(spark, sf_dir)).select("asset_id", "trust_level")


@query
def passport_context(spark, sf_dir):
    return passport.as_context(_passports(spark, sf_dir))


def _embedded(spark, sf_dir) -> DataFrame:
    times = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.min("doc_id").alias("d")).where("d % 2 = 0").selectExpr("path", f"{AS_OF} - make_dt_interval(cast(d % 400 AS int)) AS mtime")
    return retrieval.embed_quality(chunks(spark, sf_dir), as_of(), times)


@query
def embed_quality(spark, sf_dir):
    return rounded(_embedded(spark, sf_dir).select("ordinal", "quality_score", "gibberish_score", "char_count", "content_hash", "is_quarantined", "freshness_score"))


@query
def quality_summary(spark, sf_dir):
    return rounded(retrieval.quality_summary(_embedded(spark, sf_dir)))


def _results(spark, sf_dir) -> DataFrame:
    """Each document as a result of one of 50 queries, every seventh without a score."""
    return _embedded(spark, sf_dir).select((F.col("ordinal") % 50).alias("query_id"), "ordinal", F.when(F.col("ordinal") % 7 != 0, F.col("quality_score")).alias("quality_score"), (F.col("is_quarantined") | (F.col("ordinal") % 11 == 0)).alias("is_quarantined"))


@query
def retrieval_filter(spark, sf_dir):
    return retrieval.retrieval_filter(_results(spark, sf_dir), 0.8).select("query_id", "ordinal")


@query
def search_gate(spark, sf_dir):
    return retrieval.search_gate(_results(spark, sf_dir), 0.8)


@query
def noise_chunks(spark, sf_dir):
    return retrieval.noise_chunks(chunks(spark, sf_dir), 60).select("ordinal")


@query
def quarantine_set(spark, sf_dir):
    return retrieval.quarantine_set(chunks(spark, sf_dir)).select("ordinal", "reason")
