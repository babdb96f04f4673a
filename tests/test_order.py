"""Order statistics and numbers taken in parts, against sorted lists."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import ranking

PLACES = {"ceil": lambda n, p: max(1, math.ceil(n * p)), "floor": lambda n, p: max(1, math.floor(n * p)), "nearest": lambda n, p: round((n - 1) * p) + 1, "upper_median": lambda n, p: n // 2 + 1}


def rows(seed, n=900):
    rng = random.Random(seed)
    hot = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random(), rng.gauss(0, 9)])) for _ in range(n)]
    return hot + [("one", 4.0), ("none", None)]


@pytest.mark.parametrize("convention", list(PLACES))
def test_quantiles_by_group(spark, convention):
    data = rows(1)
    d = spark.createDataFrame(data, "g string, v double").repartition(7)
    ps = [0.1, 0.5, 0.9, 0.99]
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {(g, p): sorted(vs)[min(len(vs), PLACES[convention](len(vs), p)) - 1] for g, vs in groups.items() for p in ps}
    assert {(r.g, r.p): r.v for r in ranking.quantiles(d, "v", ps, convention, ["g"]).collect()} == want
    every = sorted(v for vs in groups.values() for v in vs)
    assert {r.p: r.v for r in ranking.quantiles(d, "v", ps, convention).collect()} == {p: every[PLACES[convention](len(every), p) - 1] for p in ps}


def test_counts_up_to_a_value(spark):
    data = rows(2)
    got = {(r.g, r.value): (r.n, r.upto, r.total) for r in ranking.value_counts(spark.createDataFrame(data, "g string, v double"), "v", ["g"]).collect()}
    want = {}
    for g in {g for g, _ in data}:
        vs = [v for h, v in data if h == g and v is not None]
        want |= {(g, v): (vs.count(v), sum(x <= v for x in vs), len(vs)) for v in vs}
    assert got == want


def test_distribution(spark):
    data = [(i, c) for i, c in enumerate(random.Random(3).choices(range(40), k=501))] + [(900, None)]
    r = ranking.distribution(spark.createDataFrame(data, "i int, c long"), "c").first()
    vs = [c for _, c in data if c is not None]
    assert (r.groups, r.with_any, r.least, r.median, r.mean, r.largest) == (501, sum(c > 0 for c in vs), min(vs), statistics.median(vs), pytest.approx(sum(vs) / 501), max(vs))
    assert ranking.distribution(spark.createDataFrame([], "i int, c long"), "c").count() == 0


def test_numbers_in_order(spark):
    rng = random.Random(4)
    keys = rng.sample(range(100000), 12000)
    d = spark.createDataFrame([(k, f"x{k % 7}") for k in keys], "k int, s string").repartition(9)
    out = ranking.numbered(d, [F.col("s").desc(), F.col("k")], "ER-", "id")
    assert out.columns == ["k", "s", "id"]
    want = {k: f"ER-{i + 1:04d}" for i, (_, k) in enumerate(sorted(((f"x{k % 7}", k) for k in keys), key=lambda x: (-ord(x[0][1]), x[1])))}
    assert {r.k: r.id for r in out.collect()} == want and want[max(want, key=lambda k: int(want[k][3:]))] == "ER-12000"


def test_no_window_over_all_rows(spark):
    d = spark.range(5000).withColumn("v", F.rand(1))
    for df in (ranking.numbered(d, [F.col("v")], "N", "n"), ranking.quantiles(d, "v", [0.5], "ceil"), ranking.value_counts(d, "v")):
        df.collect()
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "Window" in plan
        for part in plan.split("SinglePartition")[1:]:
            assert "v#" not in part.split("\n\n")[0]
