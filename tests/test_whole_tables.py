"""Queries over small tables of their own, where a cut of the input would show."""

import pytest

import __spark_entry__


@pytest.fixture
def run(spark, tmp_path):
    def of(name, **tables):
        for table, (rows, columns) in tables.items():
            spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return __spark_entry__.queries()[name](spark, str(tmp_path)).collect()

    return of


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(*texts):
    return [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], DOCS


def test_two_phase_dedup_hashes_documents_without_vectors(run):
    rows = run("two_phase_dedup", documents=docs("a b", "c d", "e f", "a  b", "g h", "g h"), embeddings=([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert sorted((r.ordinal, r.removed_by) for r in rows) == [(2, "semantic"), (3, "hash"), (5, "hash")]


def test_dedup_alerts_counts_whole_texts(run):
    assert run("dedup_alerts", documents=docs("the one", "the two", "the three", "the four")) == []
    assert [r.message for r in run("dedup_alerts", documents=docs("the one", "the  one", "the three", "the four"))] == ["1 of 4 items are duplicates"]


def test_names_of_whole_tables_are_compared(run):
    tables = {"documents": docs(*["a"] * 1200), "embeddings": ([(i, [1.0]) for i in range(200, 1203)], "vec_id long, embedding array<float>")}
    (row,) = run("file_store_consistency", **tables)
    assert (row.overlap, row.orphan_files, row.orphan_sources) == (1000, 200, 3)
    orphans = sorted((r.side, r.name) for r in run("orphan_names", **tables))
    assert orphans == sorted([*(("file", f"{i}.md") for i in range(200)), *(("store", f"{i}.md") for i in range(1200, 1203))])
