"""Review rows, audits and sensitivity details against plain loops."""

from collections import Counter
from statistics import median

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skeinwork.operators import blocking, profile, ranking, review_rows, search

SELECTED = "cpsc_source_record_id string, saferproducts_source_record_id string, incident_brand string, incident_date string, publication_date string, cpsc_recall_date string, product_token_jaccard double"
ROWS = [("r1", "i1", "", None, "2020-01-05", "2020-02-01", 0.5), ("r1", "i2", "own", "2020-03-01", "2020-03-02", "2020-02-01", None), ("r2", "i3", None, "", None, "2020-02-01", 0.2), ("r3", "i9", None, "2020-01-01", "2020-02-01", "2020-02-01", 0.1)]


def sources(spark):
    candidates = spark.createDataFrame(
        [("r1", "i1", "theirs", "2020-01-02", ["a"]), ("r1", "i2", "theirs", "2020-01-02", ["b"]), ("r2", "i3", "first", None, None), ("r2", "i3", "second", None, ["c"])],
        "cpsc_source_record_id string, saferproducts_source_record_id string, incident_brand string, incident_date string, blocking_sources array<string>",
    )
    recalls = spark.createDataFrame([("r1", "T1"), ("r2", "T2"), ("r2", "T0")], "source_record_id string, title string")
    incidents = spark.createDataFrame([("i1", "toys"), ("i2", None), ("i3", "tools"), (None, "x")], "source_record_id string, product_category string")
    return candidates, recalls, incidents


def test_evidence_fills_only_what_is_empty_and_counts_gaps(spark):
    joined = review_rows.join_evidence(spark.createDataFrame(ROWS, SELECTED), *sources(spark))
    got = {r.saferproducts_source_record_id: r for r in joined.collect()}
    assert len(got) == joined.count() == 4
    assert [got[i].incident_brand for i in ("i1", "i2", "i3", "i9")] == ["theirs", "own", "second", None]
    assert [got[i].incident_date for i in ("i1", "i2", "i3", "i9")] == ["2020-01-02", "2020-03-01", None, "2020-01-01"]
    assert [got[i].cpsc_title for i in ("i1", "i3", "i9")] == ["T1", "T2", None] and got["i1"].incident_category == "toys"
    assert tuple(got["i9"].evidence_join_status) == (False, False, False) and tuple(got["i3"].evidence_join_status) == (True, True, True)
    assert tuple(review_rows.gaps(joined).first()) == (4, 1, 1, 1)
    with pytest.raises(PySparkException, match="no whole evidence"):
        review_rows.whole(joined).collect()


def test_review_rows_have_their_shape(spark):
    joined = review_rows.join_evidence(spark.createDataFrame(ROWS, SELECTED), *sources(spark))
    out = review_rows.review_rows(joined, [F.col("saferproducts_source_record_id")])
    assert len(out.columns) == 45 and len(set(out.columns)) == 45
    got = out.orderBy("review_id").collect()
    assert [r.review_id for r in got] == ["ER-0001", "ER-0002", "ER-0003", "ER-0004"]
    assert [r.temporal_status for r in got] == ["pre_recall_public", "incident_on_or_after_recall", "unknown", "pre_incident_published_after_recall"]
    assert [r.jaccard_band for r in got] == ["high", "low", "medium", "low"] and {r.similarity_band for r in got} == {"low"}
    assert [r.blocking_sources for r in got] == [["a"], ["b"], ["c"], []] and {(r.exact_upc, r.initial_label, r.review_label) for r in got} == {(0, "unlabeled", "")}
    empty = review_rows.join_evidence(spark.createDataFrame([], SELECTED), *sources(spark))
    assert review_rows.review_rows(empty, [F.col("saferproducts_source_record_id")]).count() == 0


def test_candidate_rows_are_typed_with_defaults(spark):
    raw = spark.createDataFrame([(1, "i", "2", None, "x")], "cpsc_source_record_id long, saferproducts_source_record_id string, shared_product_token_count string, exact_upc int, other string")
    r = review_rows.candidate_rows(raw).first()
    assert r.asDict() | {"cpsc_source_record_id": "1"} == r.asDict() and len(r) == len(review_rows.CANDIDATE_COLUMNS)
    assert (r.exact_upc, r.shared_product_token_count, r.product_token_jaccard, r.blocking_sources, r.incident_brand) == (False, 2, 0.0, [], None)
    with pytest.raises(ValueError, match="saferproducts_source_record_id"):
        review_rows.candidate_rows(raw.drop("saferproducts_source_record_id"))


def test_failures_by_reason_and_repeated_keys(spark):
    rows = [(i % 30, None if i % 11 == 0 else i, "" if i % 7 == 0 else "k", None if i % 5 == 0 else 1) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, client long, kind string, at long")
    got = {(r.part, r.name): (r.n, r.example) for r in profile.failure_audit(d, "id", {"no client": F.col("client").isNotNull(), "no kind": F.col("kind") != ""}, ["at"], 5).collect()}
    good = [r for r in rows if r[1] is not None and r[2]]
    per = Counter(r[0] for r in good)
    no_client = [r for r in rows if r[1] is None]
    assert got["failure", "no client"] == (len(no_client), min(str(r[0]) for r in no_client))
    assert got["failure", "no kind"][0] == len(rows) - len(good) - len(no_client) and got["total", "failed"][0] == len(rows) - len(good)
    assert got["total", "missing at"][0] == sum(r[3] is None for r in good) and got["total", "repeated keys"][0] == sum(n > 1 for n in per.values())
    want = sorted(((k, n) for k, n in per.items() if n > 1), key=lambda x: (-x[1], x[0]))[:5]
    assert {k: v[0] for (p, k), v in got.items() if p == "repeated"} == {str(k): n for k, n in want}
    empty = profile.failure_audit(d.limit(0), "id", {"no client": F.col("client").isNotNull()}, ["at"]).collect()
    assert {r.n for r in empty} == {0} and all(r.part == "total" for r in empty)


def test_nested_fields_are_counted_on_their_items(spark):
    d = spark.createDataFrame([("h", [("a", ""), ("", "m")]), ("", []), (None, None)], "hazard string, items array<struct<name string, model string>>")
    got = {(r.level, r.field): (r.n, r.present) for r in profile.nested_completeness(d, "items", ["hazard", "items"], ["name", "model"]).collect()}
    assert got == {("row", "hazard"): (3, 1), ("row", "items"): (3, 1), ("item", "name"): (2, 1), ("item", "model"): (2, 1)}


def test_sensitivity_counts_rows_that_a_limit_leaves_nothing(spark):
    left = {f"l{i}": {f"t{j}" for j in range(i, i + 3)} for i in range(8)}
    right = {i: {f"t{j}" for j in range(12) if (i * 7 + j) % (j + 1) == 0} for i in range(60)}
    df = Counter(t for s in right.values() for t in s)
    limits = [5, 20, 60]
    want = {(m, a): sum(len(s & t) >= 2 and min(df[x] for x in s & t) <= m for t in right.values()) for m in limits for a, s in left.items()}
    posts = lambda d, n, kind: spark.createDataFrame([(k, t) for k, s in d.items() for t in s], f"{n} {kind}, token string")
    ids = spark.createDataFrame([(a,) for a in left], "left_id string")
    per = blocking.with_none(blocking.candidates_by_limit(posts(left, "left_id", "string"), posts(right, "right_id", "long"), limits), ids, limits)
    assert {(r.df_limit, r.left_id): r.n for r in per.collect()} == want
    for r in ranking.distribution(per, "n", ["df_limit"]).collect():
        own = sorted(n for (m, _), n in want.items() if m == r.df_limit)
        assert (r.least, r.median, r.largest, r.p90) == (own[0], median(own), own[-1], own[round((len(own) - 1) * 0.9)])
    least = sorted(want.values())[len(want) // 2]
    top = [(r.df_limit, r.left_id) for r in blocking.crowded_rows(per, least, 2).orderBy("df_limit", "rank").collect()]
    assert top == [(m, a) for m in limits for a, _ in sorted(((a, n) for (k, a), n in want.items() if k == m and n >= least), key=lambda x: (-x[1], x[0]))[:2]]


def test_dispatch_falls_back_query_by_query(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id string, id long, score double")
    first, records = hits([("a", 9, 1.0), ("a", 8, 1.0), ("a", 7, 0.5)]), hits([("a", 1, 1.0), ("b", 3, 0.2), ("b", 2, 0.2), ("b", 4, 0.1)])
    products = hits([("b", i, float(i % 40)) for i in range(300)])
    got = [(r.query_id, r.kind, r.id) for r in search.dispatch(first, records, products, 2).orderBy("query_id", F.col("kind").desc(), "place").collect()]
    best = [i for i, _ in sorted(((i, i % 40) for i in range(300)), key=lambda x: (-x[1], x[0]))]
    assert got == [("a", "first", 8), ("a", "first", 9), ("b", "record", 2), ("b", "record", 3)] + [("b", "product", i) for i in best[:20]]
    assert search.dispatch(None, records, products, 50).where("kind = 'product'").count() == 200
    with pytest.raises(ValueError, match="1 to 50"):
        search.dispatch(None, records, products, 51)


def test_evidence_is_shuffled_once_and_lies_in_order(spark):
    """Candidates, incidents and pairs meet in one shuffle by ranges of the incident, and sorting by it adds none."""
    joined = review_rows.join_evidence(spark.createDataFrame(ROWS, SELECTED), *sources(spark), in_order=True)
    plan = joined.orderBy(review_rows.INCIDENT)._jdf.queryExecution().executedPlan().toString()
    ordered = plan.split("== Initial Plan ==")[-1]
    assert ordered.count("Exchange rangepartitioning") == 1 and ordered.count("Exchange") <= 4
    assert [r[0] for r in joined.orderBy(review_rows.INCIDENT).select(review_rows.INCIDENT).collect()] == ["i1", "i2", "i3", "i9"]


def test_null_keys_have_no_evidence(spark):
    candidates, recalls, incidents = sources(spark)
    candidates = candidates.union(spark.createDataFrame([("r1", None, "x", None, None), (None, "i1", "y", None, None)], candidates.schema))
    rows = spark.createDataFrame([("r1", None, None, None, None, None, None), (None, "i1", None, None, None, None, None)], SELECTED)
    got = {r.cpsc_source_record_id: r for r in review_rows.join_evidence(rows, candidates, recalls, incidents).collect()}
    assert tuple(got["r1"].evidence_join_status) == (False, True, False) and got["r1"].incident_brand is None
    assert tuple(got[None].evidence_join_status) == (False, False, True) and got[None].incident_brand is None and got[None].incident_category == "toys"


def _shuffled(spark) -> int:
    """Bytes of shuffles that lie on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_review_rows_of_many_ranges_are_those_of_the_sql(spark, monkeypatch):
    """Only one range's shuffles lie on disk at a time, and ids go on from range to range."""
    import duckdb

    from skeinwork.plans import registry
    from skeinwork.sources import tables

    sf, seen, stored = "/root/testdata/sf0.001", [], tables.stored
    monkeypatch.setattr(review_rows, "PASS_ROWS", 1_000)

    def watched(df, path, *a, **k):
        out = stored(df, path, *a, **k)
        if "sorted" in path:
            seen.append((out.count(), _shuffled(spark)))
        return out

    before = _shuffled(spark)
    monkeypatch.setattr(tables, "stored", watched)
    got = registry.queries()["review_rows"](spark, sf)
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()['review_rows']})").fetchall()
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    assert sorted(map(str, (tuple(map(cell, r)) for r in got.select(cols).collect()))) == sorted(map(str, (tuple(map(cell, r)) for r in want)))
    assert len(seen) == 6 and sum(n for n, _ in seen) == len(want) and max(n for n, _ in seen) < 1_200
    # a range alone shuffles over 100,000 bytes
    assert max(size for _, size in seen) < before + 20_000


def test_ranges_keep_null_ids_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(review_rows, "PASS_ROWS", 2)
    rows = spark.createDataFrame([*ROWS, ("r1", None, None, None, None, None, None)], SELECTED)
    parts = review_rows.join_in_ranges(rows, *sources(spark), 5)
    got = {r.saferproducts_source_record_id: r for p in parts for r in p.collect()}
    want = {r.saferproducts_source_record_id: r for r in review_rows.join_evidence(rows, *sources(spark)).collect()}
    assert len(parts) > 1 and {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in want.items()}
    ids = [(r.review_id, r.saferproducts_source_record_id) for r in review_rows.review_rows(parts, [F.col(review_rows.INCIDENT)]).orderBy("review_id").collect()]
    assert ids == [("ER-0001", None), ("ER-0002", "i1"), ("ER-0003", "i2"), ("ER-0004", "i3"), ("ER-0005", "i9")]
