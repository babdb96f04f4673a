"""Bucketed upserts and keyed state with several writers."""

import datetime as dt

from skeinwork.sources import bucketed, keyed_state, sinks, tables


def rows(spark, *x):
    return spark.createDataFrame(list(x), "key string, seq int, v string")


def held(spark, root):
    return {r.key: r.v for r in bucketed.read(spark, root).collect()}


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    first = bucketed.upsert(rows(spark, *[(f"k{i}", 1, "a") for i in range(200)]), root, ["key"], "seq", 0, buckets=16)
    assert first == list(range(16))
    before = bucketed.manifest(spark, root)["folders"]
    touched = bucketed.upsert(rows(spark, ("k1", 1, "b"), ("k1", 2, "c"), ("new", 1, "n")), root, ["key"], "seq", 1)
    after = bucketed.manifest(spark, root)["folders"]
    assert 1 <= len(touched) <= 2 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    want = {f"k{i}": "a" for i in range(200)} | {"k1": "c", "new": "n"}
    assert held(spark, root) == want
    old = bucketed._read(spark, root, bucketed.manifest(spark, root, before=1))
    assert {r.key: r.v for r in old.collect()}["k1"] == "a"


def test_a_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    bucketed.upsert(rows(spark, ("a", 1, "x")), root, ["key"], "seq", 0, 4)
    bucketed.upsert(rows(spark, ("a", 1, "y"), ("b", 1, "w"), (None, 1, "null")), root, ["key"], "seq", 1)
    m = bucketed.manifest(spark, root)
    assert bucketed.upsert(rows(spark, ("a", 1, "other")), root, ["key"], "seq", 1) == [] and bucketed.manifest(spark, root) == m
    assert held(spark, root) == {"a": "y", "b": "w", None: "null"}
    bucketed.upsert(rows(spark).limit(0), root, ["key"], "seq", 2)
    assert held(spark, root) == {"a": "y", "b": "w", None: "null"}


def test_columns_come_and_go_and_old_folders_are_removed(spark, tmp_path):
    root = str(tmp_path / "t")
    bucketed.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "x")), root, ["key"], "seq", 0, 4)
    for n in (1, 2, 3):
        bucketed.upsert(spark.createDataFrame([("a", n, "y", float(n))], "key string, seq int, v string, more double"), root, ["key"], "seq", n)
    assert {(r.key, r.v, r.more) for r in bucketed.read(spark, root).collect()} == {("a", "y", 3.0), ("b", "x", None)}
    gone = bucketed.compacted(spark, root, keep=1)
    assert len(gone) == 3 and not any(tables.exists(spark, f"{root}/{p}") for p in gone)
    assert {(r.key, r.v) for r in bucketed.read(spark, root).collect()} == {("a", "y"), ("b", "x")}
    bucketed.rebucketed(spark, root, ["key"], 7)
    assert bucketed.manifest(spark, root)["buckets"] == 7 and held(spark, root) == {"a": "y", "b": "x"}


AT = dt.datetime(2024, 1, 1)


def put(spark, root, *entries, **options):
    d = spark.createDataFrame([(k, e, v, AT + dt.timedelta(seconds=i)) for i, (k, e, v) in enumerate(entries)], "key string, expected long, value string, at timestamp")
    return sorted(((r.key, r.expected, r.version, r.accepted) for r in keyed_state.put(d, root, **options).collect()), key=str)


def now(spark, root):
    return {r.key: (r.version, r.value) for r in keyed_state.state(spark, root).collect()}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = str(tmp_path / "s")
    assert put(spark, root, ("job", 0, "new"), ("other", None, "o")) == [("job", 0, 1, True), ("other", 0, 1, True)]
    seen = keyed_state.last_commit(spark, root)
    assert put(spark, root, ("job", 1, "running")) == [("job", 1, 2, True)]
    # the second writer checked before the first had committed: its commit's number is taken, and it looks again
    assert put(spark, root, ("job", 1, "cancelled"), ("third", 0, "t"), seen=seen) == [("job", 1, 2, False), ("third", 0, 1, True)]
    assert now(spark, root) == {"job": (2, "running"), "other": (1, "o"), "third": (1, "t")}
    assert keyed_state.last_commit(spark, root) == 3 and len(tables.listed(spark, f"{root}/log")) == 3


def test_state_is_the_last_version_also_after_a_snapshot(spark, tmp_path):
    root = str(tmp_path / "s")
    put(spark, root, ("a", 0, "1"), ("a", 0, "later in the same call"), (None, 0, "x"), ("b", 5, "never seen"))
    put(spark, root, ("a", 1, "2"))
    assert now(spark, root) == {"a": (2, "2")} and {(r.version, r.value) for r in keyed_state.history(spark, root).collect()} == {(1, "1"), (2, "2")}
    assert keyed_state.compacted(spark, root) == 2 and now(spark, root) == {"a": (2, "2")}
    assert put(spark, root, ("a", 2, None)) == [("a", 2, 3, True)] and now(spark, root) == {}
    assert put(spark, root, ("a", 0, "again")) == [("a", 0, 3, False)] and put(spark, root, ("a", 3, "again")) == [("a", 3, 4, True)]
    keyed_state.compacted(spark, root, keep_log=False)
    assert now(spark, root) == {"a": (4, "again")} and keyed_state.history(spark, root).count() == 0
    assert put(spark, root, ("a", 4, "more")) == [("a", 4, 5, True)]


def test_nothing_there(spark, tmp_path):
    assert keyed_state.state(spark, str(tmp_path / "none")).count() == 0 == keyed_state.history(spark, str(tmp_path / "none")).count()


def test_two_versions_never_share_a_number(spark, tmp_path):
    root = str(tmp_path / "v")
    assert tables.claim(spark, f"{root}/_numbers/{1:012d}", "of another writer")
    sinks.publish(spark.range(3), root, "mine")
    assert sinks._last_pointer(spark, root)["number"] == 2
