"""Work that grows with the tables goes to more tasks, is done once for what is alike, and is not shuffled where it need not be."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinwork.operators import blocking, evidence, ranking, search
from skeinwork.plans import registry
from skeinwork.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_one_text_are_met_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["red oak table", "Red oak table", "blue chair", ""][i % 4]) for i in range(40)], "id long, body string")
    queries = spark.createDataFrame([("oak table",), ("red chair",), ("none",)], "query string").withColumn("query_id", F.col("query"))
    met, overlap = [], blocking.token_overlap
    monkeypatch.setattr(blocking, "token_overlap", lambda left, right, least: met.append(right.select("right_id").distinct().count()) or overlap(left, right, least))
    got = sorted(tuple(r) for r in search.containment(queries, docs, "id", "body", "plain").collect())
    score = {"oak table": [100, 100, 0, 0], "red chair": [1, 1, 1, 0]}
    assert got == sorted((q, i, s[i % 4]) for q, s in score.items() for i in range(40) if s[i % 4])
    assert met[0] <= 3


def test_review_ranks_are_limited_before_the_shuffle(spark):
    rows = [(f"L{i % 3}", i, i % 20 == 0, i % 7, (i % 5) / 5) for i in range(200)]
    pairs = spark.createDataFrame(rows, "left_id string, right_id long, exact_key boolean, shared_count int, jaccard double").repartition(5, "right_id")
    got = ranking.review_rank(pairs, 4)
    order = [F.col(c).desc() for c in ("exact_key", "shared_count", "jaccard", "right_id")]
    every = pairs.withColumn("review_rank", F.row_number().over(Window.partitionBy("left_id").orderBy(*order))).withColumn("k", F.row_number().over(Window.partitionBy("left_id", "exact_key").orderBy(*order)))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in every.where("exact_key or k <= 4").drop("k").select(*got.columns).collect()}
    assert "WindowGroupLimit" in plan(got)


def test_lines_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables.dealt, "__defaults__", (1_000,))
    got = registry.incidents(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 6 and "hashpartitioning(recall_id" in plan(got)
    assert got.count() == registry.table(spark, "/root/testdata/sf0.001", "lineitem").count()


def test_what_follows_keep_first_knows_its_keys(spark):
    rows = spark.createDataFrame([(i % 4, i % 3, i) for i in range(40)], "k int, s int, d int").repartition(7, "k")
    got = evidence.dedupe_incidents(rows.select("k", F.col("s").alias("source_record_id"), F.col("d").alias("publication_date"), F.col("d").alias("incident_date")), "k", 2).groupBy("k").count()
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in got.collect()} == {(k, 2) for k in range(4)}


def test_search_deals_documents_by_their_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red w{i % 5} blue w{i % 3}") for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(q, w) for q in range(6) for w in ("red", f"w{q}")], "query_id long, token string")
    want = {(r.query_id, r.doc_id, round(r.score, 9)) for r in search.bm25(asked, docs, "id", ["text"]).collect()}
    monkeypatch.setattr(blocking, "TASK_PAIRS", 40)
    got = search.bm25(asked, docs, "id", ["text"])
    assert got.rdd.getNumPartitions() > 4 and not re.search(r"hashpartitioning\(query_id#\w+, doc_id", plan(got))
    assert {(r.query_id, r.doc_id, round(r.score, 9)) for r in got.collect()} == want
