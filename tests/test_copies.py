"""Searches over documents of which many read the same: each text is met once, and no document is lost."""

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import search, workspace
from skeinwork.sources import search_index

DOCS = [(i, ("red lamp", "blue lamp", "red red chair", "Red Lamp")[i % 4], "acme" if i % 8 < 4 else "zen") for i in range(400)] + [(900, None, "acme"), (901, None, None)]
QUERIES = [("a", "red"), ("a", "lamp"), ("b", "chair"), ("b", "acme"), ("c", "nothing")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, brand string")


def rows(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in df.collect())


def test_best_documents_from_classes_of_equal_texts(spark, docs, tmp_path):
    asked = spark.createDataFrame(QUERIES, "query_id string, token string")
    classes, members = search.alike(docs, "id", ["title", "brand"])
    assert classes.count() == 8 and members.count() == 402
    search_index.write(classes, str(tmp_path / "i"), "id", ["text"], "1", copies="copies")
    index = search_index.Index(spark, str(tmp_path / "i"))
    assert (index.n_docs, index.ranges) == (402, 1)
    scores = search.bm25(asked, docs, "id", ["title", "brand"])
    for k in (1, 7, 1000):
        want = rows(search.best_scores(scores, k))
        assert rows(search.of_members(index.best(asked, k), members, k)) == want
        assert rows(search.of_members(search.best_scores(search.bm25(asked, classes, "id", ["text"], copies="copies"), k), members, k)) == want


def test_best_fields_of_counted_copies(spark, docs):
    asked = spark.createDataFrame([("a", "red lamp"), ("b", "acme chair")], "query_id string, query string")
    counted = docs.groupBy("title", "brand").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    plain = {(r.query_id, r.doc_id): round(r.score, 9) for r in search.best_fields(asked, docs, "id").collect()}
    few = search.best_fields(asked, counted, "id", copies="copies").join(counted.select(F.col("id").alias("doc_id"), "copies"), "doc_id").collect()
    assert len(few) == 14 and sum(r.copies for r in few) == len(plain)
    assert all(plain[r.query_id, r.doc_id] == round(r.score, 9) for r in few)


def test_records_of_one_name_are_one_search(spark, docs):
    records = spark.createDataFrame([(1, "red lamp"), (2, "red lamp"), (3, "acme chair")], "key long, name string")
    got = {f: sorted(tuple(r) for r in workspace.searched(records, "key", F.col("name"), docs, "id", ["title", "brand"], (2, 16), 30, fold=f).collect()) for f in (False, True)}
    assert got[True] == got[False] and len(got[True]) == 90
    assert [r[1:] for r in got[True] if r[0] == 1] == [r[1:] for r in got[True] if r[0] == 2]
