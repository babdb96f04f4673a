from datetime import date

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import dates
from skeinwork.functions import text as t


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tokenizers(spark):
    r = one(
        spark, a=t.tokens(F.lit("The Example Product 12-Inch"), "catalogue"), b=t.digits(F.lit("082392-599195")),
        c=t.squeezed(F.lit("  A  b ")), d=t.normalize_text(F.lit("  NORDWELL™ Kitchen-Pro  ")), e=t.compact(F.lit("G-100 b")), f=t.spaced(t.unmarked(F.lit("Harper's® StormSeal 5-gal."))),
    )
    assert (r.a, r.b, r.c, r.e) == (["example", "12"], "082392599195", "a b", "g100b")
    assert r.d == "nordwelltm kitchen pro" and r.f == "harper s stormseal 5 gal"


def test_folding_needs_more_than_lower(spark):
    r = one(spark, a=t.normalize_text(F.lit("GROẞ Straße")), b=t.normalize_lower(F.lit("abc-D")), n=t.normalize_text(F.lit(None).cast("string")))
    assert (r.a, r.b, r.n) == ("gross strasse", "abc d", "")


def test_similarities(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    empty = F.array().cast("array<string>")
    r = one(spark, j=t.jaccard(a, b, 6), c=t.coverage(a, b), z=t.jaccard(empty, empty), td=t.sequence_similarity(F.lit("tide"), F.lit("diet")), dt=t.sequence_similarity(F.lit("diet"), F.lit("tide")))
    assert (r.j, r.c, r.z, r.td, r.dt) == (0.333333, 0.5, 0.0, 0.25, 0.5)


def test_clean_and_ids(spark):
    r = one(spark, a=t.clean(F.lit(" NaN ")), b=t.clean(F.lit(" x ")), i=t.stable_id("pm", F.lit("a "), F.lit(None)), j=t.stable_id("pm", F.lit("a"), F.lit("")))
    assert r.a is None and r.b == "x" and r.i == r.j and len(r.i) == 23


@pytest.mark.parametrize("raw,want", [
    ("/Date(1297036800000)/", date(2011, 2, 7)), ("/Date(99999999999999999)/", None), ("2021-10-18T00:00:00", date(2021, 10, 18)), ("3/7/2021", date(2021, 3, 7)), ("junk", None), (None, None),
])
def test_source_dates(spark, raw, want):
    assert one(spark, d=dates.source_date(F.lit(raw).cast("string"))).d == want


def test_windows(spark):
    w = dates.month_windows(spark, "2020-01-15", "2020-03-10").orderBy("start").collect()
    assert [(str(r.start), str(r.end)) for r in w] == [("2020-01-15", "2020-02-01"), ("2020-02-01", "2020-03-01"), ("2020-03-01", "2020-03-10")]
    c = dates.chunk_windows(spark, "2020-01-01", "2020-09-15", 3).orderBy("start").collect()
    assert [(str(r.start), str(r.end)) for r in c] == [("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-06-30"), ("2020-07-01", "2020-09-15")]
    with pytest.raises(ValueError):
        dates.month_windows(spark, "2020-01-01", "2020-01-01")


@pytest.mark.parametrize("recall,incident,publication,want", [
    ("2022-06-30", "2021-10-18", "2021-11-10", "pre_recall_public"), ("2020-12-23", "2020-09-10", "2021-02-04", "pre_incident_published_after_recall"),
    ("2021-08-04", "2021-08-04", "2021-10-29", "incident_on_or_after_recall"), (None, "2021-08-04", "2021-10-29", "insufficient_dates"),
])
def test_temporal_status(spark, recall, incident, publication, want):
    d = lambda x: F.lit(x).cast("date")
    r = one(spark, s=dates.temporal_status(d(incident), d(publication), d(recall)), p=dates.pre_recall_public(d(incident), d(publication), d(recall)))
    assert r.s == want and r.p == (want == "pre_recall_public")


def test_raw_terms(spark):
    rows = [("Red  \"Mill\" a/b",), (None,), ("",), ('"',), ("x-1\ty",)]
    got = [r.x for r in spark.createDataFrame(rows, "s string").select(t.raw_terms(F.col("s")).alias("x")).collect()]
    assert got == [["red", "mill", "a/b"], [], [], [], ["x-1", "y"]]


def test_tokens_are_counted_for_all_tokenizers_from_one_cut(spark):
    rows = [(None,), ("",), ("The New Set of 12 inch LAMPS, lamps and a lamp",), ("GROẞ Straße ｆｕｌｌ ﬁne x² ™Acme® K9 ‘it’s’ İzmir",), ("a-b_c 1 22 333 the THE \x00 K9",), ("é è ½ ①",)]
    df = spark.createDataFrame(rows, "text string")
    each = df.select(*[F.size(t.tokens(F.col("text"), k)).alias(f"n_{k}") for k in t.STOP_WORDS])
    counted = t.tokens_by(df, "text")
    assert counted.columns == ["text", *each.columns]
    assert [tuple(r)[1:] for r in counted.collect()] == [tuple(r) for r in each.collect()]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4
