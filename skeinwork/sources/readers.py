"""Sources: files by suffix, containers of records, source detection, page envelopes, zip bundles."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys under which files and services hold their records.
CONTAINERS = ("data", "results", "items", "recalls", "incidents", "records")
SERVICE_CONTAINERS = ("Recalls", "recalls", "Recall", "recall", "value")
# Hints by which a source may be named.
HINTS = {"amazon": "amazon_products", "amazon_product": "amazon_products", "amazon_metadata": "amazon_products", "reviews": "amazon_reviews", "safer": "saferproducts", "saferproducts.gov": "saferproducts", "candidate": "linkage"}
SOURCE_TYPES = ("cpsc", "saferproducts", "amazon_products", "amazon_reviews", "linkage")
# Header sets and file name parts by which sources are known, in order of trial.
SIGNS = [
    ("cpsc", [{"recall_number", "recall_date"}], ["cpsc"]),
    ("saferproducts", [{"incident_date", "publication_date"}], ["saferproducts", "safer"]),
    ("linkage", [{"cpsc_recall_number", "amazon_parent_asin"}], ["linkage", "candidate"]),
    ("amazon_reviews", [{"rating", "text"}, {"rating", "review_text"}], []),
    ("amazon_products", [{"parent_asin"}, {"amazon_parent_asin"}], ["parent_asin"]),
]


def read_records(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of .csv, .json, .jsonl and .ndjson files, each also with .gz; every CSV field is text."""
    name = re.sub(r"\.gz$", "", path.lower())
    if name.endswith(".csv"):
        df = spark.read.option("header", True).option("mode", mode).option("multiLine", True).option("escape", '"').csv(path)
        first = df.columns[0] if df.columns else ""
        return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df
    if name.endswith((".jsonl", ".ndjson")):
        df = spark.read.option("mode", mode).json(path)
        return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if "_corrupt_record" in df.columns else df
    if name.endswith(".json"):
        return unwrapped(spark.read.option("multiLine", True).json(path))
    raise ValueError(f"unsupported file type: {path}")


def unwrapped(df: DataFrame, containers: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """Records out of the first container that the frame has; an array of structs or one struct."""
    for c in containers:
        if c in df.columns:
            kind = dict(df.dtypes)[c]
            if kind.startswith("array<struct"):
                return df.select(F.explode(c).alias("r")).select("r.*")
            if kind.startswith("struct"):
                return df.select(f"{c}.*")
    return df


def detect_source(columns: list[str], filename: str, hint: str | None = None) -> str:
    if hint:
        h = HINTS.get(hint.strip().lower(), hint.strip().lower())
        if h in SOURCE_TYPES:
            return h
    have, name = {c.lower() for c in columns}, filename.lower()
    for kind, headers, parts in SIGNS:
        if any(h <= have for h in headers) or any(p in name for p in parts):
            return kind
    raise ValueError("unknown source; give a hint: " + ", ".join(SOURCE_TYPES))


def page_records(pages: DataFrame, body: str = "body") -> DataFrame:
    """(record as JSON text, index, count, next) of service pages held as JSON text: d.results, d or value."""
    v = lambda p: F.get_json_object(body, p)
    listed = F.coalesce(v("$.d.results"), F.when(v("$.d").startswith("["), v("$.d")), v("$.value"))
    items = F.from_json(listed, "array<string>")
    count = F.coalesce(v("$.d.__count"), v("$['odata.count']")).try_cast("bigint")
    nxt = F.coalesce(v("$.d.__next"), v("$['odata.nextLink']"))
    rest = [c for c in pages.columns if c != body]
    return pages.select(*rest, F.posexplode_outer(items).alias("index", "record"), count.alias("count"), nxt.alias("next")).where(F.col("record").isNull() | F.col("record").startswith("{"))


def with_origin(df: DataFrame) -> DataFrame:
    """df with the file each row came from."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def distinct_paths(paths: list[str]) -> list[str]:
    seen, out = set(), []
    for p in paths:
        if p.lower() not in seen:
            seen.add(p.lower())
            out.append(p)
    return out


def category_of(path_col: Column) -> Column:
    """Category from names like meta_Category.jsonl.gz."""
    return F.regexp_extract(path_col, r"meta_([^/]+?)\.jsonl(?:\.gz)?$", 1)


def case_catalogue(spark: SparkSession, path: str) -> DataFrame | None:
    """Cases of a bundle file; none if it is missing or broken."""
    try:
        df = spark.read.option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return df.select(F.explode("cases").alias("c")).select("c.*") if "cases" in df.columns else None


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_bundle(path: str, tag: str = "evidence-bundle", most_manifest: int = 1 << 20) -> dict:
    """The checked manifest of a zip bundle: format, unique safe names, known sources, sizes and digests that hold."""
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("manifest.json")
        if info.file_size > most_manifest:
            raise ValueError("manifest too large")
        manifest = json.loads(z.read(info))
        if manifest.get("format") != tag or not manifest.get("datasets"):
            raise ValueError("not such a bundle")
        names = [d["file"] for d in manifest["datasets"]]
        if len(set(names)) != len(names):
            raise ValueError("a file is named twice")
        for d in manifest["datasets"]:
            p = PurePosixPath(d["file"])
            if p.is_absolute() or ".." in p.parts or d.get("source_type") not in SOURCE_TYPES or not re.fullmatch("[0-9a-f]{64}", d.get("sha256", "")):
                raise ValueError(f"bad entry: {d}")
            h = hashlib.sha256()
            with z.open(d["file"]) as f:
                while block := f.read(1 << 20):
                    h.update(block)
            if h.hexdigest() != d["sha256"]:
                raise ValueError(f"digest of {d['file']} differs")
        return manifest
