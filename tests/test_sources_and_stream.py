import gzip
import json
import zipfile

import pytest

from skeinwork.sources import bucketed, readers, sinks
from skeinwork.streaming import landing


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿k,v\n1,x\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"k": 1}, {"k": 2}]}))
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"k": 1}\n{"k": 2}\n')
    assert readers.read_records(spark, str(tmp_path / "a.csv")).first().k == "1"
    assert readers.read_records(spark, str(tmp_path / "b.json")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "c.jsonl.gz")).count() == 2
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.xml")


def test_page_records(spark):
    pages = spark.createDataFrame([('{"d":{"results":[{"a":1}],"__count":"123","__next":"u"}}',), ('{"value":[{"a":2},{"a":3}]}',)], "body string")
    r = readers.page_records(pages).orderBy("count", "index").collect()
    assert len(r) == 3 and {x["count"] for x in r} == {123, None} and {x["next"] for x in r} == {"u", None}


def test_bundle(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("{}\n")
    sinks.write_bundle(str(tmp_path / "b.zip"), [("linkage", str(tmp_path / "p.jsonl"))])
    assert readers.read_bundle(str(tmp_path / "b.zip"))["datasets"][0]["source_type"] == "linkage"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"format": "evidence-bundle", "datasets": [{"file": "../x", "source_type": "linkage", "sha256": "0" * 64}]}))
    with pytest.raises(ValueError):
        readers.read_bundle(str(tmp_path / "bad.zip"))


def test_publish(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root, "v1")
    sinks.publish(spark.range(5), root, "v2")
    assert sinks.current(spark, root).count() == 5


def test_landing_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda x: spark.createDataFrame(x, "key string, seq int, v string").coalesce(1).write.mode("append").parquet(src)
    rows([("a", 1, "x"), ("a", 2, "y")])
    start = lambda: landing.stream(spark, src, "key string, seq int, v string").writeStream.foreachBatch(landing.upsert_into(out, ["key"], "seq")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    start()
    rows([("a", 1, "z"), ("b", 1, "w")])
    start()
    assert {(r.key, r.v) for r in bucketed.read(spark, out).collect()} == {("a", "z"), ("b", "w")}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = landing.upsert_into(out, ["key"], "seq")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, seq int, v string")
    batch(rows(("a", 1, "x")), 0)
    batch(rows(("a", 1, "y"), ("b", 1, "w")), 1)
    batch(rows(("a", 1, "y"), ("b", 1, "w")), 1)
    batch(rows(("a", 1, "z")), 2)
    assert {(r.key, r.v) for r in bucketed.read(spark, out).collect()} == {("a", "z"), ("b", "w")}
