"""Balanced group folds: dealt in bulk, they are as even as dealing group by group."""

import random
from collections import Counter

import pytest

from skeinwork.operators import evaluate


def one_by_one(groups, k):
    """The same greedy rule, each group by itself: the fold that is left most even."""
    total = [max(1, sum(g[c] for g in groups.values())) for c in (0, 1)]
    folds, at = [[0, 0] for _ in range(k)], {}
    for name, g in sorted(groups.items(), key=lambda x: (-abs(x[1][0] - x[1][1]), -sum(x[1]), x[1], str(x[0]))):
        def spread(i):
            shares = [[(f[c] + (g[c] if i == j else 0)) / total[c] for j, f in enumerate(folds)] for c in (0, 1)]
            return round(sum(sum((x - sum(s) / k) ** 2 for x in s) ** 0.5 for s in shares), 12), sum(folds[i]), i
        best = min(range(k), key=spread)
        at[name] = best
        for c in (0, 1):
            folds[best][c] += g[c]
    return folds


def table(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(400):
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8])):
            rows.append((g, int(rng.random() < (0.8 if g % 3 else 0.1))))
    return rows + [(None, 1), (None, 0), (7, None)] + [(1000, i % 2) for i in range(30)]


@pytest.mark.parametrize("k", [3, 5])
def test_folds_are_even_and_groups_whole(spark, k):
    rows = table(k)
    got = evaluate.balanced_folds(spark.createDataFrame(rows, "g int, y int"), "g", "y", k).collect()
    assert sorted(((r.g, r.y) for r in got), key=str) == sorted(rows, key=str)
    folds = {}
    for r in got:
        folds.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and {f for x in folds.values() for f in x} == set(range(k))
    groups = {}
    for g, y in rows:
        groups.setdefault(g, [0, 0])[int(y == 1)] += 1
    bulk = [[0, 0] for _ in range(k)]
    for r in got:
        bulk[r.fold][int(r.y == 1)] += 1
    plain = one_by_one({g: tuple(x) for g, x in groups.items()}, k)
    largest = [max(x[c] for g, x in groups.items() if g != 1000) for c in (0, 1)]
    for c in (0, 1):
        assert max(f[c] for f in bulk) - min(f[c] for f in bulk) <= max(largest[c], max(f[c] for f in plain) - min(f[c] for f in plain))


def test_signatures_are_dealt_whole():
    plan = {(n, p): (r, rest) for n, p, r, rest in evaluate.dealt_signatures([(1, 0, 62), (0, 1, 7), (2, 2, 1)], 5)}
    assert {s: (r, len(rest)) for s, (r, rest) in plan.items()} == {(1, 0): (4, 42), (0, 1): (0, 7), (2, 2): (0, 1)}
    loads = Counter(f for _, rest in plan.values() for f in rest)
    assert max(loads.values()) - min(loads.values()) <= 2


def test_rules(spark):
    rows = [(True, 0, 0.0, 1), (False, 3, 0.2, 1), (False, 3, 0.1, 0), (False, 9, 0.9, 0), (None, None, None, 0)]
    got = {r.rule: (r.tp, r.fp, r.tn, r.fn) for r in evaluate.rule_models(spark.createDataFrame(rows, "exact_key boolean, shared_count int, jaccard double, y int"), "y").collect()}
    assert got == {"upc_only": (1, 0, 3, 1), "token_and_similarity": (2, 1, 2, 0)}


def test_no_groups(spark):
    assert evaluate.balanced_folds(spark.createDataFrame([], "g int, y int"), "g", "y").count() == 0
