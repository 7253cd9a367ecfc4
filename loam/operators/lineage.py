"""Lineage as two tables: nodes (id, name, node_type, metadata, seq) and edges (source, target, operation, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.graph import hops


def _map(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def record_ingestion(ingests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ingests (seq, path, name, chunk_ids, collection): file to chunks to collection."""
    chunk = F.explode("chunk_ids")
    each = ingests.select("seq", "path", "name", "collection", chunk.alias("chunk"))
    file_id, chunk_id, store = F.concat(F.lit("file:"), "path"), F.concat(F.lit("chunk:"), "chunk"), F.concat(F.lit("collection:"), "collection")
    nodes = ingests.select(file_id.alias("id"), "name", F.lit("source").alias("node_type"), _map(path=F.col("path")).alias("metadata"), "seq")
    nodes = nodes.unionByName(ingests.select(store.alias("id"), F.col("collection").alias("name"), F.lit("storage").alias("node_type"), _map(collection=F.col("collection")).alias("metadata"), "seq"))
    nodes = nodes.unionByName(each.select(chunk_id.alias("id"), F.col("chunk").alias("name"), F.lit("transform").alias("node_type"), _map(source=F.col("path")).alias("metadata"), "seq"))
    edges = each.select(file_id.alias("source"), chunk_id.alias("target"), F.lit("chunk").alias("operation"), "seq").unionByName(each.select(chunk_id.alias("source"), store.alias("target"), F.lit("embed_store").alias("operation"), "seq"))
    return nodes, edges


def record_web_cache(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (seq, url, path, collection): url to cached file to collection."""
    url, cache, store = F.concat(F.lit("url:"), "url"), F.concat(F.lit("cache:"), "path"), F.concat(F.lit("collection:"), "collection")
    node = lambda i, name, kind: pages.select(i.alias("id"), F.col(name).alias("name"), F.lit(kind).alias("node_type"), _map(url=F.col("url")).alias("metadata"), "seq")
    nodes = node(url, "url", "source").unionByName(node(cache, "path", "transform")).unionByName(node(store, "collection", "storage"))
    edges = pages.select(url.alias("source"), cache.alias("target"), F.lit("fetch_cache").alias("operation"), "seq").unionByName(pages.select(cache.alias("source"), store.alias("target"), F.lit("ingest").alias("operation"), "seq"))
    return nodes, edges


def record_chat_export(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """exports (seq, chat, path, qa_count): chat to exported file."""
    chat, file = F.concat(F.lit("chat:"), "chat"), F.concat(F.lit("file:"), "path")
    nodes = exports.select(chat.alias("id"), F.col("chat").alias("name"), F.lit("source").alias("node_type"), _map(chat=F.col("chat")).alias("metadata"), "seq")
    nodes = nodes.unionByName(exports.select(file.alias("id"), F.col("path").alias("name"), F.lit("transform").alias("node_type"), _map(qa_count=F.col("qa_count")).alias("metadata"), "seq"))
    return nodes, exports.select(chat.alias("source"), file.alias("target"), F.lit("export_qa").alias("operation"), "seq")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id: the first that was recorded."""
    return nodes.groupBy("id").agg(F.min_by(F.struct("name", "node_type", "metadata", "seq"), "seq").alias("n")).select("id", "n.*")


def upstream(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(of, id): the distinct known nodes right before each of the ids (column id)."""
    return edges.join(ids.withColumnRenamed("id", "of"), F.col("target") == F.col("of")).select("of", F.col("source").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")


def downstream(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(of, id): the distinct known nodes right after each of the ids (column id)."""
    return edges.join(ids.withColumnRenamed("id", "of"), F.col("source") == F.col("of")).select("of", F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")


def chain(nodes: DataFrame, edges: DataFrame, start: DataFrame, up: bool = True) -> DataFrame:
    """(at, id): for each node reached from the start (column node), each of its distinct known neighbours, once.

    A diamond gives its end once for each way in, and a cycle gives the start again.
    """
    ends = ("target", "source") if up else ("source", "target")
    known = edges.join(nodes.select(F.col("id").alias(ends[1])), ends[1], "left_semi")
    return hops(known, start, *ends).select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("id"))


def lineage_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type and edges by operation."""
    a = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return a.unionByName(edges.groupBy(F.col("operation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def orphaned_chunks(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Transform nodes whose metadata names a source that isn't in the sources (column source)."""
    named = nodes.where("node_type = 'transform'").withColumn("source", F.col("metadata")["source"]).where("source <> ''")
    return named.join(sources.select("source").distinct(), "source", "left_anti")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, seq, line): the lines of a Mermaid graph: head, nodes, edges, each in order."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    shape = F.when(F.col("node_type") == "source", F.format_string('    %s(["%s"])', clean("id"), "name")).when(F.col("node_type") == "storage", F.format_string('    %s[("%s")]', clean("id"), "name")).otherwise(F.format_string('    %s["%s"]', clean("id"), "name"))
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("graph LR").alias("line"))
    body = nodes.select(F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), shape.alias("line"))
    return head.unionByName(body).unionByName(edges.select(F.lit(2).alias("part"), F.col("seq").cast("long").alias("seq"), F.format_string("    %s -->|%s| %s", clean("source"), "operation", clean("target")).alias("line")))
