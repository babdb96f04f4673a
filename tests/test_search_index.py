"""The stored index: the same answers as scoring every document, from a part of its blocks."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from skeinwork.operators import search
from skeinwork.sources import search_index, sinks


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25))), i) for i in range(n)]


def brute(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t, *_ in docs}
    avg, df = sum(map(len, words.values())) / len(words), Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, tokens in queries.items():
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(max(math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for t in set(tokens) if tf[t])
            if any(tf[t] for t in tokens):
                scores.append((-round(s, 6), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id string, token string")


QUERIES = {"rare": ["w50", "w55", "w1"], "common": ["w0", "w1", "w2"], "one": ["w30"], "none": ["nothing"], "twice": ["w3", "w3", None]}


def test_best_documents(spark, tmp_path):
    docs = corpus() + [(900, None, 0), (901, "", 0), (902, "W50 w55", 0)]
    root = str(tmp_path / "i")
    search_index.write(spark.createDataFrame(docs, "id long, text string, bucket int"), root, "id", ["text"], "1", range_docs=8)
    index = search_index.Index(spark, root)
    assert index.ranges == 51 and index.docs().count() == 403
    for k, first in ((5, 4), (20, 1), (1000, 2)):
        got = sorted(tuple(r) for r in index.best(asked(spark, QUERIES), k, first=first).select("query_id", "doc_id", "rank").collect())
        assert got == brute(docs, {q: [t for t in ts if t] for q, ts in QUERIES.items()}, k)


def test_only_blocks_that_can_enter_are_read(spark, tmp_path):
    docs = corpus(2000) + [(5000 + i, "w50 w50 w50 w55 w55 w58", 0) for i in range(12)]
    root = str(tmp_path / "i")
    search_index.write(spark.createDataFrame(docs, "id long, text string, n int"), root, "id", ["text"], "1", range_docs=8, buckets=8)
    index = search_index.Index(spark, root)
    q = asked(spark, {"rare": ["w50", "w55", "w58", "w0"]})
    scores, rest = index.wanted(q, 10, str(tmp_path / "s"), first=12)
    every = index.heads_of(q).count()
    assert scores.count() > 10 and rest.count() < 0.4 * every
    plan = index.scored(rest)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*(dynamicpruning|IN)", text, re.I)


def test_same_scores_as_without_an_index(spark, tmp_path):
    d = spark.createDataFrame(corpus(150), "id long, text string, n int")
    search_index.write(d, str(tmp_path / "i"), "id", ["text"], "1")
    q = asked(spark, QUERIES)
    want = {(r.query_id, r.doc_id): round(r.score, 9) for r in search.bm25(q, d, "id", ["text"]).collect()}
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in search_index.Index(spark, str(tmp_path / "i")).best(q, 1000).collect()}
    assert got == want


def test_a_version_is_whole_and_readers_keep_theirs(spark, tmp_path):
    root = str(tmp_path / "i")
    d = lambda rows: spark.createDataFrame(rows, "id long, text string")
    search_index.write(d([(1, "red lamp"), (1, "blue lamp"), (2, "lamp")]).coalesce(1), root, "id", ["text"], "a")
    old = search_index.Index(spark, root)
    search_index.write(d([(3, "lamp")]), root, "id", ["text"], "b")
    q = asked(spark, {"q": ["lamp", "blue"]})
    assert [r.doc_id for r in old.best(q, 5).orderBy("rank").collect()] == [1, 2] and [r.doc_id for r in search_index.Index(spark, root).best(q, 5).collect()] == [3]
    assert sinks.exists(spark, f"{root}/version=a/blocks") and old.docs().where(F.col("text") == "red lamp").count() == 0


def test_nothing_indexed(spark, tmp_path):
    search_index.write(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"), "id", ["text"], "1")
    assert search_index.Index(spark, str(tmp_path / "i")).best(asked(spark, QUERIES), 5).count() == 0


def test_postings_and_pairs_are_never_shuffled_by_themselves(spark, tmp_path, monkeypatch):
    """Scores come out of groups of whole ranges, also where searches are dealt over parts, and a trimmed range keeps all that can rank."""
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 5))) for i in range(60)]
    search_index.write(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "i"), "id", ["text"], "1", range_docs=8)
    index = search_index.Index(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(i, f"w{j}") for i in range(5) for j in (i, (i + 2) % 7)], "query_id long, token string")
    wanted = index.heads_of(q).cache()
    plan = index.scored(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "explode(posts" not in plan
    rows = lambda d: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in d.collect())
    whole, best = rows(index.scored(wanted)), [tuple(r) for r in index.best(q, 4).select("query_id", "doc_id", "rank").orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search_index, "TASK_SEARCHES", 2)
    assert rows(index.scored(wanted)) == whole
    by = {i: sorted((-round(s, 6), d) for x, d, s in whole if x == i)[:4] for i in range(5)}
    assert best == [(i, d, n + 1) for i in range(5) for n, (_, d) in enumerate(by[i])]
