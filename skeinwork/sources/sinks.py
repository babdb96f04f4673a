"""Sinks: upsert by key, registries, exports, bundles and versioned snapshots."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking
from .tables import claim, exists, scratch, stored  # noqa: F401


def upserted(current: DataFrame | None, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows after an upsert: of each key the last by seq, new rows after current ones."""
    n = new.withColumn("__new", F.lit(1))
    every = n if current is None else current.withColumn("__new", F.lit(0)).unionByName(n, allowMissingColumns=True)
    return ranking.keep_last(every, key, ["__new", seq]).drop("__new")


def counted(df: DataFrame, key: list[str]) -> DataFrame:
    """(read, accepted, rejected, distinct_keys) of a canonical frame with column valid, in one job."""
    return df.agg(F.count("*").alias("n_read"), F.count_if("valid").alias("accepted"), F.count_if(~F.col("valid")).alias("rejected"), F.countDistinct(F.when(F.col("valid"), F.struct(*key))).alias("distinct_keys"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select([F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).csv(path)


def without_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    """Rows of other data sets; rows of none stay."""
    return df.where(F.coalesce(F.col("dataset_id") != dataset_id, F.lit(True)))


def new_files(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Fingerprints that the registry does not have, each once."""
    return found.dropDuplicates(["sha256"]).join(registry, "sha256", "left_anti")


_POINTER = "version string, number long"


def point_to(spark: SparkSession, root: str, version: str, number: int) -> None:
    """Name a written version as the one of this number; the greatest number is the current one."""
    spark.createDataFrame([(version, number)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/_pointers")


def _last_pointer(spark: SparkSession, root: str, before: int | None = None):
    if not exists(spark, f"{root}/_pointers"):
        return None
    named = spark.read.schema(_POINTER).json(f"{root}/_pointers")
    if before is not None:
        named = named.where(F.col("number") < before)
    last = named.agg(F.max("number").alias("number"), F.max_by("version", F.struct("number", "version")).alias("version")).first()
    return last if last["number"] is not None else None


def publish(df: DataFrame, root: str, version: str) -> None:
    """Write an immutable version, then name it as the current one; readers see either the old or the new.

    Pointers are numbered, since the names of versions need not sort by age."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    point_to_next(df.sparkSession, root, version)


def point_to_next(spark: SparkSession, root: str, version: str) -> int:
    """Name a version under the next number; of two writers that want the same number one takes the one after."""
    last = _last_pointer(spark, root)
    number = 1 + (last["number"] if last else 0)
    while not claim(spark, f"{root}/_numbers/{number:012d}", version):
        number += 1
    point_to(spark, root, version, number)
    return number


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version named last."""
    last = _last_pointer(spark, root)
    if last is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/version={last['version']}")


def version_before(spark: SparkSession, root: str, number: int) -> DataFrame | None:
    """The last version of a smaller number, if there is one."""
    last = _last_pointer(spark, root, number)
    return spark.read.parquet(f"{root}/version={last['version']}") if last else None


def manifest(df: DataFrame, **fields) -> DataFrame:
    """One row with the count, a digest of the rows that does not depend on their order, and other fields.

    The digest adds up the first 60 bits of md5 of each row's cells as text, a null cell being empty and any other led by a sign."""
    cell = lambda c, k: F.coalesce(F.concat(F.lit("="), F.to_json(c) if k.startswith(("map", "array", "struct")) else F.col(c).cast("string")), F.lit(""))
    row = F.conv(F.substring(F.md5(F.concat_ws(chr(31), *[cell(c, k) for c, k in df.dtypes])), 1, 15), 16, 10).cast("decimal(38,0)")
    one = df.agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("content_sum"))
    return one.select(*[F.lit(v).alias(k) for k, v in fields.items()], "*")


def write_bundle(path: str, files: list[tuple[str, str]], tag: str = "evidence-bundle") -> None:
    """A zip of local files (source_type, path) with a manifest of their digests; for files that a person carries."""
    entries = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for kind, f in files:
            data = Path(f).read_bytes()
            z.writestr(Path(f).name, data)
            entries.append({"file": Path(f).name, "source_type": kind, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        z.writestr("manifest.json", json.dumps({"format": tag, "datasets": entries}))


def sliced(catalogue: DataFrame, wanted: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(first catalogue row of each wanted key, wanted keys that the catalogue lacks); keys compare trimmed in upper case."""
    norm = lambda d: d.withColumn("__k", F.upper(F.trim(key))).where("__k <> ''")
    w = norm(wanted).select("__k").distinct()
    hit = norm(catalogue).join(w, "__k", "left_semi")
    return ranking.keep_first(hit, ["__k"], [seq]).drop("__k"), w.join(norm(catalogue).select("__k").distinct(), "__k", "left_anti").select(F.col("__k").alias(key))
