from skeinwork.sources import ingest


def test_snapshot_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, True), (3, False), (None, None)], "k int, valid boolean")
    c = ingest.snapshot(spark.createDataFrame([("{}",)], "body string"), rows, str(tmp_path / "s"), ["k"]).first()
    assert (c.n_read, c.accepted) == (4, 2) and spark.read.json(str(tmp_path / "s" / "rejected")).count() == 2


def test_columns_and_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffrecall_number,recall_date,\"a, \"\"b\"\"\"\n1,2,3\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('\n{"parent_asin": "x", "title": "t"}\n{"other": 1}\n')
    (tmp_path / "c.jsonl").write_text('{"parent_asin": "y"}\n')
    (tmp_path / "d.csv").write_text("k\n")
    (tmp_path / "candidate_rows.csv").write_text("k\n")
    (tmp_path / "empty.csv").write_text("")
    found = ingest.sniffed(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: (r["columns"], r.source) for r in found.collect()}
    assert got == {"a.csv": (["recall_number", "recall_date", 'a, "b"'], "cpsc"), "b.jsonl": (["parent_asin", "title"], "amazon_products"), "c.jsonl": (["parent_asin"], "amazon_products"), "d.csv": (["k"], None), "candidate_rows.csv": (["k"], "linkage")}
    only = {r.source: (len(r.files), r.only and r.only.rsplit("/", 1)[1]) for r in ingest.inventory(found).collect()}
    assert only == {"cpsc": (1, "a.csv"), "amazon_products": (2, None), "linkage": (1, "candidate_rows.csv")}
