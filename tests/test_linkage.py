from pyspark.sql import functions as F

from skeinwork.functions import text as t
from skeinwork.operators import blocking, evaluate, evidence, features, profile, ranking, review, search
from skeinwork.sources import normalize, readers, sinks


def sides(spark):
    left = spark.createDataFrame([("R1", "Nordwell Folding Ladder", ["424242424242"])], "left_id string, name string, keys array<string>").withColumn("tokens", t.tokens(F.col("name")))
    right = spark.createDataFrame([("I1", "Nordwell T7 Folding ladder", "424242424242"), ("I2", "Other Nordwell folding chair", None), ("I3", "Kitchen scales", "")], "right_id string, body string, key string").withColumn("tokens", t.tokens(F.col("body")))
    return left, right


def test_candidates(spark):
    left, right = sides(spark)
    got = {r.right_id: r for r in blocking.linked_candidates(left, right, with_tokens=True).collect()}
    assert set(got) == {"I1", "I2"} and got["I1"].exact_key and not got["I2"].exact_key
    assert got["I1"].blocking_sources == ["exact_key", "tokens"] and got["I2"].shared_tokens == ["folding", "nordwell"]
    first = ranking.review_rank(blocking.linked_candidates(left, right), 1).orderBy("review_rank").first()
    assert first.right_id == "I1"


def test_one_common_token_is_not_enough(spark):
    left, _ = sides(spark)
    right = spark.createDataFrame([("I9", ["folding", "table"], "")], "right_id string, tokens array<string>, key string")
    assert blocking.linked_candidates(left, right).count() == 0


def test_rare_tokens(spark):
    left = spark.createDataFrame([(1, "common"), (1, "zq417")], "left_id int, token string")
    right = spark.createDataFrame([("A1", "zq417"), ("A1", "common"), ("A2", "zq417")] + [(f"B{i}", "common") for i in range(300)], "right_id string, token string")
    assert [r.right_id for r in blocking.rare_token_overlap(left, right, 250).collect()] == ["A1"]
    by = right.withColumn("c", F.lit("x"))
    assert [r.right_id for r in blocking.rare_token_overlap(left, by, 250, by=["c"]).collect()] == ["A1"]
    assert blocking.rarest_overlap(left, right).collect()[0].right_id == "A1"
    s = {r.df_limit: r.pairs for r in blocking.sensitivity(left, right, [1, 10, 1000]).collect()}
    assert s == {10: 1, 1000: 1}


def test_phrase_inside_words(spark):
    left = spark.createDataFrame([(1, "ring bo"), (2, "x"), (3, "")], "left_id int, phrase string")
    right = spark.createDataFrame([(1, "spring box"), (2, "box")], "right_id int, text string")
    assert {(r.left_id, r.right_id) for r in blocking.phrase_containment(left, right).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_pair_features(spark):
    p = spark.createDataFrame([("Nordwell T7 ladder", ["1-1"], "Nordwell", "T7", "ladder", "11", None, "Shop")], "left_name string, left_keys array<string>, right_brand string, right_model string, right_description string, right_key string, manufacturer string, retailer string")
    r = features.pair_features(p).first()
    assert (r.exact_upc, r.product_name_substring, r.model_in_left_name, r.manufacturer_present, r.retailer_present) == (1, 1, 1, 0, 1)
    assert r.product_token_jaccard == 1.0 and r.product_name_sequence_similarity == 1.0


def test_scores_and_bands(spark):
    L = F.lit
    r = spark.range(1).select(
        features.supplied_score(L(5), L(2), L(0.5), L(0.5), L(True), L(False)).alias("a"), features.supplied_score(L(0), L(0), L(0.0), L(0.0), L(False), L(True)).alias("b"),
        features.generated_score(L(False), L(9), L(3), L(1.0), L(1.0), L(True), L(True)).alias("c"), features.band(L(0.3), 0.15, 0.4).alias("d"), features.bucket_band(L(50)).alias("e"),
        features.supplied_reasons(L(True), L(False), L(2), L(0.9), L(False)).alias("f"), features.brand_relation(L("Nordwell "), L("the nordwell ladder")).alias("g"),
    ).first()
    assert abs(r.a - (0.58 + 0.11 + 0.06 + 0.08)) < 1e-12 and r.b == 1.0 and abs(r.c - 0.58) < 1e-9
    assert (r.d, r.e, r.g) == ("medium", "medium_bucket", "brand_in_name") and len(r.f) == 3


def test_bm25_prefers_rare_and_short(spark):
    d = spark.createDataFrame([(1, "ladder ladder fire"), (2, "ladder with a very long description of other things"), (3, "fan"), (4, "fan"), (5, "lamp")], "id int, body string")
    q = spark.createDataFrame([(1, "ladder")], "query_id int, token string")
    assert [r.doc_id for r in search.bm25(q, d, "id", ["body"]).orderBy(F.col("score").desc()).collect()] == [1, 2]
    c = search.containment(spark.createDataFrame([(1, "ladder fire")], "query_id int, query string"), d, "id", "body", "plain").orderBy("doc_id").collect()
    assert [(r.doc_id, r.score) for r in c] == [(1, 100), (2, 1)]


def test_metrics(spark):
    d = spark.createDataFrame([(0, .1), (0, .8), (1, .7), (1, .9)], "y int, p double")
    r = evaluate.confusion(d, "y", F.col("p") >= 0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 0, 2)
    assert evaluate.roc_auc(d, "y", "p").first().roc_auc == 0.75
    assert abs(evaluate.average_precision(d, "y", "p").first().average_precision - (0.5 + 0.5 * 2 / 3)) < 1e-12
    h = spark.createDataFrame([(1, 0, .9, "a"), (1, 1, .8, "b"), (2, 1, .9, "c"), (2, 0, .1, "d")], "g int, y int, p double, id string")
    assert {r.k: r.hit_rate for r in evaluate.top_k_hit_rate(h, "g", "y", "p", "id", [1, 2]).collect()} == {1: 0.5, 2: 1.0}


def test_folds_keep_groups(spark):
    d = spark.range(100).select((F.col("id") % 20).alias("g"), (F.col("id") % 2).cast("int").alias("y"))
    f = evaluate.group_folds(d, "g", "y", 5)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1 and f.select("fold").distinct().count() == 5


def test_canonical_and_detection(spark):
    d = spark.createDataFrame([("", "a1", "Title", "nan"), (None, None, "x", "b")], "parent_asin string, ASIN string, amazon_title string, brand string")
    r = normalize.canonical(d, "amazon_products").collect()
    assert (r[0].parent_asin, r[0].title, r[0].brand, r[0].valid) == ("a1", "Title", None, True) and not r[1].valid
    assert readers.detect_source(["recall_number", "recall_date"], "x.csv") == "cpsc" and readers.detect_source([], "x", "Amazon") == "amazon_products"


def test_nested_recalls(spark):
    raw = spark.createDataFrame([('{"RecallID":12345,"Products":{"Product":{"Name":"A"}},"ProductUPCs":[{"UPC":"1"},{"UPC":" "}],"RemedyOptions":{"RemedyOption":[{"Option":"Refund"}]}}',), ('{"Title":"x"}',)], "body string")
    a, b = normalize.recalls(raw).collect()
    assert a.source_record_id == "12345" and a.products[0].name == "A" and a.product_upcs == ["1"] and a.remedy_options[0].option == "Refund" and a.valid and not b.valid
    e = evidence.evidence_rows(normalize.recalls(raw).where("valid").withColumn("title", F.lit("T"))).collect()
    assert len(e) == 1 and e[0].product_mention_id is not None


def test_incidents(spark):
    raw = spark.createDataFrame([('{"IncidentReportNumber":"9","IncidentDate":"/Date(1297036800000)/","Locale":{"__deferred":{"uri":"x"}},"ProductBrand":" B "}',)], "body string")
    r = normalize.incidents(raw).first()
    assert (r.source_record_id, str(r.incident_date), r.locale, r.product_brand) == ("9", "2011-02-07", None, "B")


def test_products(spark):
    raw = spark.createDataFrame([('{"parent_asin":"A","title":"T","details":{"BRAND":"X","GTIN":"5"},"features":"one","description":["d"]}',), ('{"title":"T"}',)], "body string")
    r = normalize.products(raw).collect()
    assert len(r) == 1 and (r[0].brand, r[0].upc, r[0].features, r[0].description) == ("X", "5", ["one"], ["d"])


def test_upsert_and_slice(spark):
    old = spark.createDataFrame([("k", 9, "old")], "key string, seq int, v string")
    new = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("z", 1, "c")], "key string, seq int, v string")
    assert {(r.key, r.v) for r in sinks.upserted(old, new, ["key"], "seq").collect()} == {("k", "b"), ("z", "c")}
    kept, lost = sinks.sliced(spark.createDataFrame([("b1 ", 2), ("B1", 1), ("B0", 3)], "asin string, seq int"), spark.createDataFrame([("B1",), ("B9",)], "asin string"), "asin", "seq")
    assert [r.seq for r in kept.collect()] == [1] and [r.asin for r in lost.collect()] == ["B9"]


def test_review_sample_keeps_seeds_and_cap(spark):
    rows = spark.createDataFrame([(g, i, i == 0 and g < 2, i / 20) for g in range(5) for i in range(20)], "g int, i int, seed boolean, s double")
    got = review.stratified_sample(rows, ["g", "i"], "g", F.col("seed"), {"high": (F.col("s") > 0.5, 4)}, 10, 2, [F.col("s").desc()]).collect()
    assert len(got) == 10 and {(0, 0), (1, 0)} <= {(r.g, r.i) for r in got} and max(sum(r.g == g for r in got) for g in range(5)) == 2


def test_review_sample_looks_past_groups_that_are_full(spark):
    rows = spark.createDataFrame([(g, i, False, 1.0 - g / 10) for g in range(12) for i in range(60)], "g int, i int, seed boolean, s double")
    got = review.stratified_sample(rows, ["g", "i"], "g", F.col("seed"), {"all": (F.col("s") > -1, 20)}, 24, 2, [F.col("s").desc()]).collect()
    assert len(got) == 24 and all(sum(r.g == g for r in got) == 2 for g in range(12))


def test_strict_join_fails_on_a_miss(spark):
    import pytest

    base, side = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no side"):
        review.strict_join(base, side=(side, ["k"])).collect()


def test_narrative_references(spark):
    d = spark.createDataFrame([("i1", "bought at https://www.amazon.com/dp/B08FTL2RMH today"), ("i2", "see /dp/b08ftl2rmh")], "id string, body string")
    got = {(r.type, r.value) for r in evidence.narrative_references(d, "id", F.col("body")).collect()}
    assert ("amazon_asin", "B08FTL2RMH") in got and len(got) == 2


def test_profile(spark):
    d = spark.createDataFrame([("a", ["x"]), ("", [])], "s string, l array<string>")
    assert {(r.field, r.present, r.missing) for r in profile.completeness(d, ["s", "l"]).collect()} == {("s", 1, 1), ("l", 1, 1)}
