"""Pairs are added up where they arise, in as many tasks as they need; alike rows are learnt from as one with their number."""

import random

from pyspark.sql import functions as F

from skeinwork.operators import blocking, evaluate, features
from skeinwork.plans import registry


def _sides(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    left = [(f"L{i}", " ".join(rng.sample(words, 6)), ) for i in range(12)]
    right = [(i, " ".join(rng.sample(words, rng.randint(1, 12))), rng.choice(["w1", "shop w2", "", None])) for i in range(60)] + [(100, left[0][1], None)]
    return spark.createDataFrame(left, "left_id string, text string"), spark.createDataFrame(right, "right_id long, text string, source string")


def test_pairs_are_not_shuffled_and_need_more_tasks_when_they_are_more(spark, monkeypatch):
    left, right = _sides(spark)
    posts = lambda d, i: blocking.postings(d, i, F.split("text", " "), i)
    want = {tuple(r) for r in blocking.token_overlap(posts(left, "left_id"), posts(right, "right_id"), 1).collect()}
    monkeypatch.setattr(blocking, "TASK_PAIRS", 50)
    got = blocking.token_overlap(posts(left, "left_id"), posts(right, "right_id"), 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left_id" not in plan and got.rdd.getNumPartitions() > 4
    assert {tuple(r) for r in got.collect()} == want
    # a long left side is shuffled by token instead, with the same rows
    monkeypatch.setattr(blocking, "SHORT_POSTINGS", 1)
    assert {tuple(r) for r in blocking.token_overlap(posts(left, "left_id"), posts(right, "right_id"), 1).collect()} == want


def test_features_from_counts_are_those_from_texts(spark):
    left, right = _sides(spark)
    tok = lambda c: registry.t.tokens(F.col(c), "plain")
    l = left.select("left_id", tok("text").alias("tokens"), F.array(F.md5("text")).alias("keys"))
    r = right.select("right_id", tok("text").alias("tokens"), tok("source").alias("more"), F.md5("text").alias("key"))
    names = ["exact_upc", *registry.LEXICAL]
    got = {tuple(x) for x in blocking.linked_features(l, r).select("left_id", "right_id", *names).collect()}
    pairs = blocking.linked_candidates(l, r).select("left_id", "right_id").join(left.select("left_id", F.col("text").alias("left_name"), F.array(F.md5("text")).alias("left_keys")), "left_id")
    pairs = pairs.join(right.select("right_id", F.col("text").alias("right_description"), F.md5("text").alias("right_key"), F.col("source").alias("right_brand"), F.lit("").alias("right_model"), F.lit("").alias("manufacturer"), F.lit("").alias("retailer")), "right_id")
    want = {tuple(x) for x in features.pair_features(pairs, "plain", with_sequence=False).select("left_id", "right_id", *names).collect()}
    assert got == want and any(x[2] for x in got)


def test_alike_rows_count_as_many(spark):
    rng = random.Random(5)
    rows = [(i % 3, int(rng.random() < 0.3 + 0.1 * a), a, b) for i in range(400) for a, b in [(rng.randint(0, 4), rng.randint(0, 1))]]
    df = spark.createDataFrame(rows, "fold int, target int, a int, b int")
    alike = df.groupBy("fold", "target", "a", "b").agg(F.count("*").alias("n"))
    one = {r.model: r for r in evaluate.model_comparison(alike, "target", ["a", "b"], ["a"], 3, 2, copies="n").collect()}
    for kind, names in (("logistic_all", ["a", "b"]), ("logistic_lexical", ["a"])):
        p = evaluate.out_of_fold(df, names, "target", "logistic", 3)
        want = evaluate.confusion(p, "target", F.col("oof_probability") >= 0.5).first()
        assert (one[kind].tp, one[kind].fp, one[kind].tn, one[kind].fn) == (want.tp, want.fp, want.tn, want.fn)
        assert abs(one[kind].roc_auc - evaluate.roc_auc(p, "target", "oof_probability").first()[0]) < 1e-6
    p = evaluate.boosting.out_of_fold(df, ["a", "b"], "target", 3, rounds=2)
    assert abs(one["hist_gradient_boosting"].average_precision - evaluate.average_precision(p, "target", "oof_probability").first()[0]) < 1e-9
    folds = lambda d, **k: {(r.g, r.fold) for r in evaluate.balanced_folds(d, "g", "target", 3, **k).collect()}
    assert folds(df.drop("fold").withColumnRenamed("a", "g")) == folds(alike.groupBy("target", F.col("a").alias("g")).agg(F.sum("n").alias("n")), copies="n")
