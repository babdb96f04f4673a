"""Pairs of equal keys: each once, whatever the number of common keys, also where a key's pairs are dealt over parts."""

import pytest

from skeinwork.operators import blocking
from skeinwork.sources import tables


@pytest.mark.parametrize("part_pairs", [5, 10_000_000])
def test_pairs_of_several_keys_come_once(spark, monkeypatch, part_pairs):
    monkeypatch.setattr(blocking, "PART_PAIRS", part_pairs)
    left = [(i, k) for i in range(9) for k in ("a", f"k{i % 3}", "")] + [(1, "a"), (20, None), (None, "a")]
    right = [(i, k) for i in range(100, 112) for k in (f"k{i % 4}", "a" if i % 2 else f"own{i}")] + [(200, "k1"), (200, "k2"), (200, "a"), (201, "a")]
    got = blocking.exact_key(spark.createDataFrame(left, "left_id long, key string"), spark.createDataFrame(right, "right_id long, key string"))
    want = {(i, j) for i, k in left for j, m in right if k and k == m}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    # pairs themselves are not shuffled: no exchange above the join
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left_id#" not in plan.split("Join")[0]


def test_a_small_file_is_dealt_over_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    out = tables.spread(spark.read.parquet(str(tmp_path / "t")), 50)
    assert len(out.inputFiles()) == 20 and sorted(r.id for r in out.collect()) == list(range(1000))
