import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from skeinwork.functions import text as t
from skeinwork.operators import blocking, features, workspace
from skeinwork.sources import normalize, sinks

PRODUCTS = [("P1", "Blue Kettle Deluxe 2L", "Nordwell", "KD2", "77"), ("P2", "Blue kettle", "Other", "", ""), ("P3", "Garden hose", "Nordwell", "", "88"), ("P4", "Blue lamp", "Third", "KD2", ""), ("P5", "Steel pan", None, None, "77")]


def words(x):
    return {w for w in re.findall("[a-z0-9]{3,}", x.lower()) if w not in t.STOP_WORDS["workspace"]}


def plain(x):
    return re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()


def test_two_stage_candidates(spark):
    records = spark.createDataFrame([("R1", "Blue Kettle Deluxe", "nordwell", "kd-2", "77"), ("R2", "Steel pan", "", "", ""), ("R3", "the", "", "", "")], "k string, name string, brand string, model string, upc string")
    products = spark.createDataFrame(PRODUCTS, "parent_asin string, title string, brand string, model string, upc string")
    supplied = spark.createDataFrame([("R2", "S1", 1, 0.5, 0.9, False, True, "m"), ("R2", "S2", 0, 0.0, 0.0, True, False, "")], "k string, parent_asin string, shared int, jaccard double, sequence double, exact boolean, brand_in_name boolean, model string")
    got = {(r.k, r.parent_asin): r for r in workspace.candidates_of(records, supplied, products, "k", ["title", "brand", "model"]).collect()}
    assert got["R2", "S2"].evidence_score == 1.0 and got["R2", "S2"].rank == 1 and got["R2", "S2"].evidence == ["Exact UPC agreement"]
    assert got["R2", "S1"].evidence == ["Brand aligns with recall product", "High title similarity", "Marketplace model identifier available"]
    assert abs(got["R2", "S1"].evidence_score - round(0.58 * 0.5 + 0.22 * 0.5 + 0.12 * 0.9 + 0.08, 3)) < 1e-9
    want = {}
    for asin, title, brand, model, upc in PRODUCTS:
        a, b = words("Blue Kettle Deluxe"), words(title)
        shared, ratio = len(a & b), SequenceMatcher(None, plain("Blue Kettle Deluxe"), plain(title)).ratio()
        same_brand, same_model, exact = plain(brand) == "nordwell", plain(model) == "kd 2", upc == "77"
        if exact or (set(re.findall("[a-z0-9]+", f"{title} {brand} {model}".lower())) & {"blue", "kettle", "deluxe"} and (shared >= 2 or ratio >= 0.72 or same_brand)):
            want["R1", asin] = 1.0 if exact else round(min(0.99, 0.25 * shared / len(a) + 0.18 * shared / len(a | b) + 0.08 * ratio + 0.04 * same_brand + 0.03 * same_model), 3)
    assert {k: r.evidence_score for k, r in got.items() if k[0] == "R1"} == want and not any(k == "R3" for k, _ in got)
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1]["rank"]) if k[0] == "R1"][:2] == [("R1", "P1"), ("R1", "P5")]


def test_incidents_by_number_else_by_search(spark):
    records = spark.createDataFrame([("R1", "red kettle"), ("R2", "garden hose/reel"), ("R3", "")], "k string, name string")
    incidents = spark.createDataFrame([(1, "R1", "2020-02-01", "other"), (2, "R1", None, "x"), (3, None, "2020-01-01", "my red kettle"), (4, None, "2020-01-01", "the reel broke")], "id int, k string, publication_date string, body string")
    got = [(r.k, r.id, r.how) for r in workspace.incidents_of(records, incidents, "k", "name", "id", ["body"]).orderBy("k", "rank").collect()]
    assert got == [("R1", 2, "record_number"), ("R1", 1, "record_number"), ("R2", 4, "search")]


def test_the_version_named_last_is_current(spark, tmp_path):
    root = str(tmp_path / "v")
    for name in ("v9", "v10", "v2"):
        sinks.publish(spark.createDataFrame([(name,)], "x string"), root, name)
        assert sinks.current(spark, root).first().x == name


def test_rows_of_no_data_set_stay(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, dataset_id string")
    assert sorted(r.i for r in sinks.without_dataset(d, "a").collect()) == [2, 3]


def test_demo_cases_and_preferences(spark):
    c = spark.createDataFrame([(k, f"A{i}", i / 10) for k in (1, 2, 3, 4, 5) for i in range(12)], "k int, parent_asin string, evidence_score double")
    i = spark.createDataFrame([(k, n, "2020-01-%02d" % (n + 1)) for k in (2, 3, 4, 5) for n in range(25)], "k int, id int, publication_date string")
    got_c, got_i = workspace.demo_cases(c, i, "k", [5, 1], "id")
    assert {(r.k, r["count"]) for r in got_c.groupBy("k").count().collect()} == {(5, 8), (2, 8), (3, 8)} and got_i.count() == 60
    rows = spark.createDataFrame([("r", 1, "x"), ("r", 0, "y"), ("s", 1, "z")], "k string, kind int, v string")
    assert sorted(r.v for r in workspace.preferred(rows, "k", "kind").collect()) == ["y", "z"]
    one = workspace.chain("k", a=rows.where("k = 'r'"), b=rows).select("v", "provider").collect()
    assert sorted((r.v, r.provider) for r in one) == [("x", "a"), ("y", "a"), ("z", "b")]


def test_terms_and_limits(spark):
    d = spark.createDataFrame([(1, "Deep-fryer/pan of DON'T 3000 " + " ".join(f"w{i:02d}" for i in range(20)))], "k int, name string")
    got = sorted(r.token for r in workspace.search_terms(d, "k", F.col("name"), 3, 12).collect())
    assert got == sorted(["deep", "fryer", "pan", "don", "t", "3000"] + [f"w{i:02d}" for i in range(7)])
    assert workspace.history(spark.range(30).withColumn("at", F.col("id")), "at", "id").count() == 20


def test_candidates_of_every_product(spark):
    left = spark.createDataFrame([("a#0", ["red", "kettle", "steel"], ["111"]), ("a#1", ["toaster"], ["222"]), ("b#0", [], [])], "left_id string, tokens array<string>, keys array<string>")
    rows = [("x", "home", ["red", "kettle"], ""), ("y", "home", ["red", "pan"], ""), ("z", None, ["steel", "kettle"], ""), ("w", "toys", [], "222"), ("v", "home", ["red", "red", "kettle", "steel"], "111")]
    right = spark.createDataFrame(rows, "right_id string, category string, tokens array<string>, key string")
    got = {(r.left_id, r.right_id): (r.blocking_sources, r.exact_upc, r.shared_product_token_count, round(r.product_token_jaccard, 3)) for r in blocking.category_candidates(left, right, most=2).collect()}
    rare, exact = "two_tokens_plus_category_rare_token", "exact_upc"
    assert got == {("a#0", "x"): ([rare], 0, 2, 0.667), ("a#0", "z"): ([rare], 0, 2, 0.667), ("a#0", "v"): ([exact, rare], 1, 3, 1.0), ("a#1", "w"): ([exact], 1, 0, 0.0)}


def test_views_of_artifacts(spark):
    rows = spark.createDataFrame([("B1", " Kettle ", "1.0", "x", ["h"]), (None, None, "", "0.5", None)], "asin string, amazon_title string, exact_upc string, product_token_jaccard string, hazards array<string>")
    got = [(r.parent_asin, r.title, r.brand, r.exact_upc, r.product_token_jaccard) for r in normalize.view(rows, "candidate").collect()]
    assert got == [("B1", "Kettle", "", 1, 0.0), ("", "", "", 0, 0.5)]
    assert [r.hazards for r in normalize.view(rows, "recall").collect()] == ['["h"]', ""]
    best = features.shown(normalize.view(rows, "candidate")).collect()
    assert (best[0].evidence_score, best[0].evidence) == (1.0, ["Exact UPC agreement"]) and best[1].evidence_score == 0.11


def test_review_counts_of_the_best_candidates(spark):
    c = spark.createDataFrame([(k, f"A{i:02d}", i / 20) for k in (1, 2) for i in range(14)], "k int, parent_asin string, evidence_score double")
    r = spark.createDataFrame([("A13", i) for i in range(130)] + [("A05", 1), ("A05", 2), ("A00", 1), (None, 1)], "parent_asin string, n int")
    got = {(x.k, x.parent_asin): (x["rank"], x.reviews) for x in workspace.review_counts(c, r, "k").collect()}
    assert len(got) == 20 and got[1, "A13"] == (1, 100) and got[2, "A05"] == (9, 2) and got[1, "A12"] == (2, 0) and (1, "A00") not in got
