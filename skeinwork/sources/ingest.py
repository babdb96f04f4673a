"""Snapshots of what came in, columns and inventory of files. Paged services: paged.py; the search index: search_index.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, readers, sinks


def snapshot(raw: DataFrame, canonical: DataFrame, root: str, key: list[str]) -> DataFrame:
    """Write the answers as they came, the valid rows and the rejected ones; the counts of the three."""
    raw.write.mode("overwrite").text(f"{root}/raw")
    canonical.where("valid").write.mode("overwrite").parquet(f"{root}/accepted")
    sinks.csv_ready(canonical.where(~F.coalesce("valid", F.lit(False)))).write.mode("overwrite").json(f"{root}/rejected")
    return sinks.counted(canonical, key)


def sniffed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, columns, source): of each file of a folder the column names of a CSV header or the keys of the first JSON line, and the
    source that these or the file's name tell, null if none does. One job reads all files; a file without a line has no row."""
    first = lines.numbered_lines(spark, paths).withColumn("text", F.regexp_replace(F.trim("text"), "^\ufeff", "")).where(F.col("text") != "").groupBy("file").agg(F.min_by("text", "line").alias("text"))
    cells = F.transform(F.regexp_extract_all("text", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.regexp_replace(F.substring(c, 2, F.length(c) - 2), '""', '"')).otherwise(c))
    names = F.when(F.startswith("text", F.lit("{")), F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))).otherwise(cells)
    return first.select("file", names.alias("columns")).withColumn("source", source_of(F.col("columns"), F.element_at(F.split("file", "/"), -1)))


def source_of(columns: Column, name: Column) -> Column:
    """The source that a header or a file name tells, in the order of the signs."""
    have, out = F.transform(columns, lambda c: F.lower(c)), F.lit(None).cast("string")
    for kind, headers, parts in reversed(readers.SIGNS):
        told = F.lit(False)
        for h in headers:
            told = told | (F.size(F.array_except(F.array(*[F.lit(x) for x in sorted(h)]), have)) == 0)
        for p in parts:
            told = told | F.contains(F.lower(name), F.lit(p))
        out = F.when(told, kind).otherwise(out)
    return out


def inventory(found: DataFrame) -> DataFrame:
    """(source, files, only): the files of each source that sniffed() has told, and its only file if it has one."""
    per = found.where("source is not null").groupBy("source").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return per.withColumn("only", F.when(F.size("files") == 1, F.col("files")[0]))
