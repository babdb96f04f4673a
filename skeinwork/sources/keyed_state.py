"""Keyed state as an append-only log: jobs, reviews and other records that several writers change.

An entry has a key, a version and a value. A writer says which version it has seen (0: none); its entry is accepted if that is
still the last one, and refused otherwise. A commit is made by creating the file of its number, so of two writers that
saw the same state one is first, and the other checks anew. The state is the last version of each key; a snapshot makes the
log before it unnecessary for reading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking
from . import tables

ENTRY = "key string, version long, value string, at timestamp, commit long"
_DIGITS = 12


def _commit(root: str, number: int) -> str:
    return f"{root}/_commits/{number:0{_DIGITS}d}"


def last_commit(spark: SparkSession, root: str) -> int:
    return max((int(n) for n in tables.listed(spark, f"{root}/_commits") if n.isdigit()), default=0)


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in tables.listed(spark, f"{root}/_snapshots") if n.isdigit()]


def _log(spark: SparkSession, root: str, after: int, upto: int) -> DataFrame:
    words = [tables.word_of(spark, _commit(root, n)) for n in range(after + 1, upto + 1)]
    paths = [f"{root}/log/{w}" for w in words]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def state(spark: SparkSession, root: str, upto: int | None = None, deleted: bool = False) -> DataFrame:
    """(key, version, value, at, commit): the last entry of each key; an entry with a null value deletes."""
    upto = last_commit(spark, root) if upto is None else upto
    base = max((n for n in _snapshots(spark, root) if n <= upto), default=0)
    entries = _log(spark, root, base, upto)
    if base:
        held = spark.read.schema(ENTRY).parquet(f"{root}/snapshots/{tables.word_of(spark, f'{root}/_snapshots/{base:0{_DIGITS}d}')}")
        entries = held.unionByName(entries)
    last = ranking.keep_last(entries, ["key"], ["version"])
    return last if deleted else last.where("value is not null")


def history(spark: SparkSession, root: str) -> DataFrame:
    """All entries that the log still has."""
    numbers = [int(n) for n in tables.listed(spark, f"{root}/_commits") if n.isdigit()]
    paths = [p for n in numbers if tables.exists(spark, p := f"{root}/log/{tables.word_of(spark, _commit(root, n))}")]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def put(entries: DataFrame, root: str, attempts: int = 10, seen: int | None = None) -> DataFrame:
    """Append entries (key, expected, value, at) and give (key, expected, version, accepted) of each: accepted with version expected + 1, or
    refused with the version that is there. Of several entries of a key in one call the first by time is looked at. Null keys are refused.
    seen: a commit that the writer has checked against already; tests use it to make two writers meet."""
    spark = entries.sparkSession
    given = tables.stored(entries.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("expected").cast("long"), F.lit(0)).alias("expected"), F.col("value").cast("string").alias("value"), F.col("at").cast("timestamp").alias("at")), f"{tables.scratch(spark)}/given")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("at", "expected", "value"))
    for _ in range(attempts):
        number = last_commit(spark, root) if seen is None else seen
        seen = None
        there = state(spark, root, number, deleted=True).select(F.col("key").alias("__key"), F.col("version").alias("__version"))
        checked = given.withColumn("__turn", turn).join(there, F.col("key") == F.col("__key"), "left").withColumn("__version", F.coalesce("__version", F.lit(0)))
        ok = F.col("key").isNotNull() & (F.col("__turn") == 1) & (F.col("expected") == F.col("__version"))
        run = uuid.uuid4().hex
        outcome = tables.stored(checked.withColumn("accepted", ok), f"{tables.scratch(spark)}/checked")
        answer = outcome.select("key", "expected", F.when(F.col("accepted"), F.col("expected") + 1).otherwise(F.col("__version")).alias("version"), "accepted")
        if not outcome.where("accepted").take(1):
            return answer
        outcome.where("accepted").select("key", (F.col("expected") + 1).alias("version"), "value", "at", F.lit(number + 1).cast("long").alias("commit")).write.mode("errorifexists").parquet(f"{root}/log/{run}")
        if tables.claim(spark, _commit(root, number + 1), run):
            return answer
        tables.remove(spark, f"{root}/log/{run}")
    raise RuntimeError(f"other writers were first {attempts} times")


def compacted(spark: SparkSession, root: str, keep_log: bool = True) -> int:
    """Write the state as a snapshot; later reads begin there. Without keep_log the log before it goes, and with it the history."""
    number = last_commit(spark, root)
    if not number or number in _snapshots(spark, root):
        return number
    run = uuid.uuid4().hex
    state(spark, root, number, deleted=True).write.mode("errorifexists").parquet(f"{root}/snapshots/{run}")
    if not tables.claim(spark, f"{root}/_snapshots/{number:0{_DIGITS}d}", run):
        tables.remove(spark, f"{root}/snapshots/{run}")
    if not keep_log:
        for n in range(1, number + 1):
            tables.remove(spark, f"{root}/log/{tables.word_of(spark, _commit(root, n))}")
    return number
