"""Line numbers over split files, three ways with broken lines, and uploads in chunks."""

import base64
import gzip
import json
import random

import pytest

from skeinwork.sources import lines, uploads


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    texts = {}
    for name in ("a.txt", "b.txt", "c.txt.gz", "d.txt"):
        rows = ["x" * rng.randrange(0, 90) + str(i) for i in range(400 if name != "d.txt" else 0)]
        rows[50:52] = ["", ""] if rows else []
        data = "".join(r + "\n" for r in rows).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        texts |= {(name, i + 1): r for i, r in enumerate(rows)}
    got = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert {(r.file.rsplit("/", 1)[1], r.line): r.text for r in got.collect()} == texts


def test_broken_lines(spark, tmp_path, small_blocks):
    rows = [json.dumps({"k": i, "pad": "p" * 80}) for i in range(100)]
    rows[60], rows[61], rows[62] = '{"k": ', "[1, 2]", "   "
    plain, packed = tmp_path / "p.jsonl", tmp_path / "z.jsonl.gz"
    plain.write_text("﻿" + "\n".join(rows) + "\n", encoding="utf-8")
    packed.write_bytes(gzip.compress("\n".join(rows[:62]).encode()))
    both = [str(plain), str(packed)]
    report = {(r.file.rsplit("/", 1)[1], r.line): (r.record, r.error) for r in lines.json_lines(spark, both).collect()}
    assert len(report) == 98 + 61 and {k for k, v in report.items() if v[1]} == {("p.jsonl", 61), ("z.jsonl.gz", 61)}
    assert json.loads(report["p.jsonl", 100][0])["k"] == 99 and json.loads(report["p.jsonl", 1][0])["k"] == 0
    assert lines.json_lines(spark, both, "skip").count() == 97 + 60
    with pytest.raises(ValueError, match=r"p\.jsonl, line 61"):
        lines.json_lines(spark, both, "fail")
    with pytest.raises(ValueError, match="mode"):
        lines.json_lines(spark, both, "loose")


def test_records_of_page_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"d": {"results": [{"a": 1}, 7, {"a": 2}], "__count": "3"}}, indent=1))
    (tmp_path / "p2.json").write_text(json.dumps({"value": [{"a": 3}]}))
    got = sorted((r.file.rsplit("/", 1)[1], r["index"], json.loads(r.record)["a"]) for r in lines.page_files(spark, str(tmp_path)).collect())
    assert got == [("p1.json", 0, 1), ("p1.json", 2, 2), ("p2.json", 0, 3)]


SESSIONS = [("whole", 10, 4), ("gaps", 40, 4), ("wrong", 10, 4), ("twice", 8, 4), ("empty", 0, 4), ("far", 4, 4), ("text", 4, 4), ("nothing", 9, 4)]
CHUNKS = [
    ("whole", 2, b"ij"), ("whole", 0, b"abcd"), ("whole", 1, b"efgh"), ("whole", 1, b"efgh"), ("gaps", 0, b"abcd"), ("gaps", 4, b"abcd"), ("gaps", 8, b"abcd"),
    ("wrong", 0, b"abcd"), ("wrong", 1, b"efg"), ("wrong", 2, b"ijkl"), ("twice", 0, b"abcd"), ("twice", 1, b"efgh"), ("twice", 1, b"EFGH"), ("far", 0, b"abcd"), ("far", 1, b"x"), ("text", 0, None), ("stranger", 3, b"a"),
]


def frames(spark):
    return spark.createDataFrame(SESSIONS, "upload_id string, size_bytes long, chunk_size int"), spark.createDataFrame(CHUNKS, "upload_id string, chunk_index int, data binary")


def test_faults_of_uploads(spark):
    got = {tuple(r) for r in uploads.faults(*frames(spark)).collect()}
    assert got == {
        ("gaps", 1, 3, "missing", None, 3), ("gaps", 5, 7, "missing", None, 3), ("gaps", 9, 9, "missing", None, 1), ("wrong", 1, 1, "wrong size", 3, 4), ("wrong", 2, 2, "wrong size", 4, 2),
        ("twice", 1, 1, "contradictory", 4, 4), ("far", 1, 1, "out of range", 1, None), ("text", 0, 0, "undecodable", None, 4), ("nothing", 0, 2, "missing", None, 3), ("stranger", 3, 3, "unknown upload", 1, None),
    }


@pytest.mark.parametrize("piece", [1, 8, 1 << 20])
def test_assembly_in_pieces(spark, piece):
    rows = uploads.assembled(*frames(spark), piece).orderBy("upload_id", "piece").collect()
    content = {}
    for r in rows:
        assert r.offset == len(content.get(r.upload_id, b"")) and len(r.data) <= max(piece, 4)
        content[r.upload_id] = content.get(r.upload_id, b"") + bytes(r.data)
    assert content == {"whole": b"abcdefghij", "empty": b""}


def test_base64(spark):
    d = spark.createDataFrame([(1, base64.b64encode(b"\x00\xffab").decode()), (2, "@@"), (3, ""), (4, None), (5, "abc")], "i int, data string")
    assert {r.i: r.data and bytes(r.data) for r in uploads.decoded(d).collect()} == {1: b"\x00\xffab", 2: None, 3: b"" or bytearray(), 4: None, 5: None}
