"""A table of the last row of each key, in hash buckets: a batch writes only the buckets that it touches.

Every commit has a number and a manifest that names the folder of each bucket; folders are never written twice. A commit is
made by creating the file of its number, which only one writer can; a batch that comes again finds its number taken and changes
nothing. Readers hold a manifest, so later commits don't touch what they read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking
from . import tables

#: Buckets of a new table; `rebucketed` changes them.
BUCKETS = 64
_DIGITS = 12


def _commit(root: str, number: int) -> str:
    return f"{root}/_commits/{number:0{_DIGITS}d}"


def commits(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in tables.listed(spark, f"{root}/_commits") if n.isdigit()]


def manifest(spark: SparkSession, root: str, before: int | None = None) -> dict | None:
    """The manifest of the last commit (of a smaller number): number, buckets, schema, and the folder of each bucket that has rows."""
    numbers = [n for n in commits(spark, root) if before is None or n < before]
    return json.loads(tables.word_of(spark, _commit(root, max(numbers)))) if numbers else None


def _read(spark: SparkSession, root: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    paths = [f"{root}/{p}" for b, p in m["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no commit under {root}")
    return _read(spark, root, m)


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, root: str, key: list[str], seq: str, number: int, buckets: int = BUCKETS) -> list[int]:
    """Commit a batch under a number: of each key the last row by seq, new rows after those of earlier commits. Gives the buckets that
    were written, none if the number is taken. Columns that earlier commits lack are null there, and the other way round."""
    spark = new.sparkSession
    if tables.exists(spark, _commit(root, number)):
        return []
    before = manifest(spark, root, number)
    buckets = before["buckets"] if before else buckets
    of = _bucket(key, buckets)
    run = f"data/{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
    fresh = new.withColumn("__new", F.lit(1))
    if before:
        touched = sorted(r[0] for r in new.select(of.alias("b")).distinct().collect())
        fresh = _read(spark, root, before, touched).withColumn("__new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    last = ranking.keep_last(fresh, key, ["__new", seq]).drop("__new")
    last.withColumn("__bucket", of).repartition("__bucket").write.partitionBy("__bucket").mode("errorifexists").parquet(f"{root}/{run}")
    written = {n.split("=")[1]: f"{run}/{n}" for n in tables.listed(spark, f"{root}/{run}") if n.startswith("__bucket=")}
    out = {"number": number, "buckets": buckets, "schema": json.loads(last.schema.json()), "folders": (before["folders"] if before else {}) | written}
    if not tables.claim(spark, _commit(root, number), json.dumps(out)):
        tables.remove(spark, f"{root}/{run}")
        return []
    return sorted(map(int, written))


def rebucketed(spark: SparkSession, root: str, key: list[str], buckets: int) -> None:
    """Write the whole table anew with another number of buckets, as one commit after the last."""
    m = manifest(spark, root)
    number = m["number"] + 1
    run = f"data/{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
    _read(spark, root, m).withColumn("__bucket", _bucket(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{root}/{run}")
    written = {n.split("=")[1]: f"{run}/{n}" for n in tables.listed(spark, f"{root}/{run}") if n.startswith("__bucket=")}
    if not tables.claim(spark, _commit(root, number), json.dumps(m | {"number": number, "buckets": buckets, "folders": written})):
        tables.remove(spark, f"{root}/{run}")
        raise RuntimeError(f"commit {number} was taken by another writer")


def compacted(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the bucket folders that none of the last `keep` commits names; gives them. Commit files stay, so batches stay known."""
    numbers = commits(spark, root)[-keep:]
    used = {p for n in numbers for p in json.loads(tables.word_of(spark, _commit(root, n)))["folders"].values()}
    gone = []
    for run in tables.listed(spark, f"{root}/data"):
        if int(run.split("-")[0]) > max(numbers, default=0):
            continue  # a writer may be at work there
        for name in tables.listed(spark, f"{root}/data/{run}"):
            if name.startswith("__bucket=") and f"data/{run}/{name}" not in used:
                tables.remove(spark, f"{root}/data/{run}/{name}")
                gone.append(f"data/{run}/{name}")
    return gone
