import corpus_pipeline
import tiktoken
from pyspark.sql import functions as F

from loam.llm.bpe import PATTERN, load_ranks
from loam.llm.common import WORD_VOCABULARY
from loam.llm.language_id import fit_language_filters, identify_language
from loam.llm.pii import redact_pii
from loam.llm.quality_rules import apply_quality_rules, learn_quality_rules

from .test_ngram_join import brute
from .test_packing_sharding import check, contents


def test_stages_are_the_operators(spark, sf, docs):
    """The pipeline against each operator's own decisions, put together in plain Python."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in apply_quality_rules(docs, learn_quality_rules(docs, labels)).where("keep").collect()}
    left = docs.where(F.col("doc_id").isin(list(good)))
    known = {r.doc_id for r in identify_language(left, fit_language_filters(left)).where("keep").collect()}
    left = left.where(F.col("doc_id").isin(list(known)))
    texts = {r.doc_id: r.text for r in left.collect()}
    label, pairs = {i: i for i in texts}, brute(texts.items())
    for _ in range(len(texts)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    left = left.where(F.col("doc_id").isin([i for i in texts if label[i] == i]))
    clean = {r.doc_id: r.text for r in redact_pii(left).collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(WORD_VOCABULARY), special_tokens={}).encode_ordinary
    ids = {i: encode(t) for i, t in clean.items()}
    check(rows, {i: len(x) + 1 for i, x in ids.items()}, 2048)
    assert {i: x[:-1] for i, x in contents(rows).items()} == ids  # the redacted texts' tokens lie in the windows


def test_stages_keep_columns_and_take_odd_rows(spark, sf, edge, empty):
    for table in (edge.withColumn("n_chars", F.length("text").cast("long")), empty.withColumn("n_chars", F.lit(0).cast("long"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert sorted(out.columns) == sorted(table.columns), name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() >= 0
    assert len(corpus_pipeline.STAGES) == 5
