"""Boosted trees against the same rule without bins, jobs or shared sums."""

import math
import random

import numpy as np
import pytest

from skeinwork.operators import boosting


def plain(x, y, rounds, leaves, penalty, least, step):
    """Leaf-wise trees with every value as a limit; x: rows of floats, nan lowest."""
    x = np.where(np.isnan(x), -np.inf, x)
    score = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))
    trees = [float(score[0])]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        held, splits = {0: np.arange(len(y))}, []
        strength = lambda at: g[at].sum() ** 2 / (h[at].sum() + penalty)  # noqa: B023, E731
        count = 1
        for _ in range(leaves - 1):
            best = (1e-12, None)
            for node, rows in sorted(held.items()):
                for j in range(x.shape[1]):
                    for v in np.unique(x[rows, j]):
                        a, b = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                        if len(a) >= least and len(b) >= least:
                            gain = strength(a) + strength(b) - strength(rows)
                            if gain > best[0] * (1 + 2e-9) + 1e-12:
                                best = (gain, (node, j, v, a, b))
            if best[1] is None:
                break
            node, j, v, a, b = best[1]
            held.pop(node)
            held[count], held[count + 1] = a, b
            splits.append((node, j, v, count))
            count += 2
        values = {n: -step * g[r].sum() / (h[r].sum() + penalty) for n, r in held.items()}
        for n, r in held.items():
            score[r] += values[n]
        trees.append((splits, values))
    return trees


def predicted(trees, row):
    row = np.where(np.isnan(row), -np.inf, row)
    s = trees[0]
    for splits, values in trees[1:]:
        node = 0
        for at, j, v, count in splits:
            if node == at:
                node = count + (row[j] > v)
        s += values[node]
    return 1 / (1 + math.exp(-s))


def table(n=160):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(6), round(rng.random(), 1), rng.choice([0.0, 1.0, None])
        rows.append((i, i % 3, float(a), b, c, int(rng.random() < (0.8 if a > 2 and b > 0.3 or c == 1.0 else 0.2))))
    return rows


SCHEMA = "i int, fold int, a double, b double, c double, y int"


@pytest.mark.parametrize("stored", [boosting.STORED, 2])
def test_same_as_without_histograms(spark, monkeypatch, stored):
    monkeypatch.setattr(boosting, "STORED", stored)
    rows = table()
    more = [(900, 0, 1.0, 0.5, None, None), (901, None, 1.0, 0.5, 1.0, 1)]
    got = {r.i: r.oof_probability for r in boosting.out_of_fold(spark.createDataFrame(rows + more, SCHEMA).repartition(3), ["a", "b", "c"], "y", 3, rounds=5, leaves=7, least_rows=8, step=0.3).collect()}
    x, y, fold = np.array([[math.nan if v is None else v for v in r[2:5]] for r in rows]), np.array([r[5] for r in rows]), np.array([r[1] for r in rows])
    for m in range(3):
        trees = plain(x[fold != m], y[fold != m], 5, 7, boosting.PENALTY, 8, 0.3)
        assert max(len(t[0]) for t in trees[1:]) == 6
        for r, v in zip(rows, x, strict=True):
            if r[1] == m:
                assert got[r[0]] == pytest.approx(predicted(trees, v), abs=1e-9)
        if m == 0:
            assert got[900] == pytest.approx(predicted(trees, np.array([1.0, 0.5, math.nan])), abs=1e-9)
    assert got[901] is None


def test_one_class_only(spark):
    rows = [(i, i % 2, float(i), 0.0, None, 1) for i in range(10)]
    assert all(r.oof_probability is None for r in boosting.out_of_fold(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], "y", 2, rounds=2).collect())
    assert boosting.out_of_fold(spark.createDataFrame([], SCHEMA), ["a", "b", "c"], "y", 2, rounds=1).count() == 0


def test_learns(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, rng.random(), rng.random(), 0.0, 0) for i in range(600)]
    rows = [(*r[:5], int((r[2] > 0.5) != (r[3] > 0.5))) for r in rows]
    got = boosting.out_of_fold(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "y", 2, rounds=12, step=0.3).collect()
    assert sum((r.oof_probability >= 0.5) == (r.y == 1) for r in got) > 0.9 * len(got)


def test_the_registered_comparison_has_all_rounds(spark, monkeypatch):
    from skeinwork.operators import evaluate
    from skeinwork.plans import registry

    asked, grown = [], boosting.out_of_fold
    # what is asked for is looked at; two rounds of it are grown
    monkeypatch.setattr(evaluate.boosting, "out_of_fold", lambda *a, **k: asked.append(k.get("rounds")) or grown(*a, **k | {"rounds": 2}))
    pairs = spark.createDataFrame([(i % 3, i % 2, *([i % 5] * 3), *([i % 7] * 4)) for i in range(60)], "fold int, target int, " + ", ".join(f"{c} int" for c in registry.COMPARED))
    monkeypatch.setattr(registry, "_labelled_pairs", lambda *_: pairs.selectExpr("*", "1L AS copies"))
    assert registry.queries()["model_comparison"](spark, "none").count() == 3
    assert asked == [boosting.ROUNDS] and boosting.ROUNDS == 150


def test_alike_rows_are_one_and_several_splits_come_from_one_job(spark, monkeypatch):
    """Fewer jobs than splits, on rows of one fold and bins with their numbers."""
    jobs, rows, sums, run = [], [], boosting.Grower.sums, boosting.Grower.run
    monkeypatch.setattr(boosting.Grower, "sums", lambda self, *a: jobs.append(1) or sums(self, *a))
    monkeypatch.setattr(boosting.Grower, "run", lambda self: rows.append(self.rows.count()) or run(self))
    data = table(600)
    got = boosting.out_of_fold(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"], "y", 3, rounds=4, leaves=7, least_rows=8, step=0.3)
    assert got.count() == 600 and rows[0] == len({r[1:5] for r in data}) < 600
    assert len(jobs) <= 4 * 6
    monkeypatch.setattr(boosting, "FEW_TASKS", 0)
    again = boosting.out_of_fold(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"], "y", 3, rounds=4, leaves=7, least_rows=8, step=0.3)
    near = lambda df: {r.i: round(r.oof_probability, 9) for r in df.collect()}
    assert near(got) == near(again)
