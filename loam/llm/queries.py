"""The training-data operators as queries over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.duck_bpe import encode_and_decode
from loam.llm.fingerprints import simhash_neighbours
from loam.llm.huffman import huffman_blocks
from loam.llm.language_id import fit_language_filters, identify_language
from loam.llm.ngram_join import ngram_jaccard_classes
from loam.llm.packing import pack_windows
from loam.llm.pii import redact_pii
from loam.llm.quality_rules import apply_quality_rules, learn_quality_rules
from loam.llm.sharding import interleave_shards
from loam.llm.token_counts import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_language(docs, fit_language_filters(docs))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_quality_rules(docs, learn_quality_rules(docs, labels(spark, sf_dir)))


QUERIES = {
    "op1_sharding": lambda spark, sf_dir: interleave_shards(documents(spark, sf_dir)),
    "op2_language_id": _language,
    "op3_packing": lambda spark, sf_dir: pack_windows(documents(spark, sf_dir)),
    "op4_pii": lambda spark, sf_dir: redact_pii(documents(spark, sf_dir)),
    "op5_ngram_jaccard_join": lambda spark, sf_dir: ngram_jaccard_classes(documents(spark, sf_dir)),
    "op6_fingerprints": lambda spark, sf_dir: simhash_neighbours(documents(spark, sf_dir), wide=12),
    "op7_bpe": lambda spark, sf_dir: encode_and_decode(documents(spark, sf_dir)),
    "op8_huffman": lambda spark, sf_dir: huffman_blocks(documents(spark, sf_dir)),
    "op9_quality_rules": _quality,
    "op10_token_counts": lambda spark, sf_dir: count_tokens(documents(spark, sf_dir)),
}

_NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) ELSE [array_to_string(ws, ' ')] END) AS s FROM w WHERE len(ws) > 0),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS jaccard FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (SELECT * FROM near WHERE jaccard >= 0.5),
reached(a, b) AS (SELECT a, b FROM linked UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
classes AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
SELECT doc_id, least(doc_id, low) AS class_id, count(linked.a) AS links, max(jaccard) AS best FROM documents LEFT JOIN classes ON classes.a = doc_id LEFT JOIN linked ON linked.a = doc_id GROUP BY 1, 2
"""

_SHARDS = """
WITH d AS (SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, k, doc_id NULLS FIRST) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, source, position, (position * 64 // total)::INTEGER AS shard FROM p
"""

SQL = {"op1_sharding": _SHARDS, "op5_ngram_jaccard_join": _NGRAMS}
