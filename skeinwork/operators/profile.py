"""Profiles, audits and reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def populated(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, present, missing), all counted in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(populated(df, c)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), (F.col("n") - F.col(c)).alias("missing")) for c in columns])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def table_counts(**frames: DataFrame) -> DataFrame:
    out = None
    for name, df in frames.items():
        d = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = d if out is None else out.union(d)
    return out


def duplicates(df: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Keys with several rows, most frequent first."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), key).limit(most)


def most_common(df: DataFrame, column: str, most: int = 25) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column)).limit(most)


def product_profile(products: DataFrame, key: str, category: str, flags: dict[str, Column]) -> DataFrame:
    """Rows, distinct keys, surplus rows and flag counts, in all and by category (null: all)."""
    per = products.groupBy(category, key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f) for f, c in flags.items()])
    sums = [F.sum(f).alias(f) for f in flags]
    by = per.groupBy(category).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("surplus"), *sums)
    every = per.groupBy(key).agg(F.sum("n").alias("n"), *sums).agg(F.lit(None).cast(dict(products.dtypes)[category]).alias(category), F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("surplus"), *sums)
    return by.union(every)


def bucket_sizes(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("candidates"))


def with_empty(left: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """Counts for every left row, 0 where there are none."""
    return left.select(key).join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def seed_recovery(seeds: DataFrame, **strategies: DataFrame) -> DataFrame:
    """(strategy, seeds, recovered, left_rows): known pairs that each blocker finds."""
    out = None
    total = seeds.select("left_id", "right_id").distinct()
    for name, pairs in strategies.items():
        hit = total.join(pairs.select("left_id", "right_id").distinct().withColumn("hit", F.lit(1)), ["left_id", "right_id"], "left")
        d = hit.agg(F.lit(name).alias("strategy"), F.count("*").alias("seeds"), F.count("hit").alias("recovered"), F.countDistinct(F.when(F.col("hit") == 1, F.col("left_id"))).alias("left_rows"))
        out = d if out is None else out.union(d)
    return out


def status_counts(pairs: DataFrame, status: Column, left: str = "left_id") -> DataFrame:
    return pairs.groupBy(status.alias("status")).agg(F.count("*").alias("pairs"), F.countDistinct(left).alias("left_rows"))


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, least, median, largest) in one pass."""
    one = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("least", F.min), ("median", F.median), ("largest", F.max))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}_{n}").cast("double").alias(n) for n in ("least", "median", "largest")]) for c in columns])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def nested_completeness(df: DataFrame, items: str, columns: list[str], fields: list[str]) -> DataFrame:
    """(level, field, n, present): populated counts of df's columns and of the fields of its array of structs `items`, each in one pass."""
    out = None
    inner = df.select(F.explode(items).alias("__i")).select("__i.*")
    for level, d, names in (("row", df, columns), ("item", inner, fields)):
        one = d.agg(F.count("*").alias("n"), *[F.count_if(populated(d, c)).alias(c) for c in names])
        cells = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(c).alias("field"), F.col("n"), F.col(c).alias("present")) for c in names])
        part = one.select(F.explode(cells).alias("c")).select("c.*")
        out = part if out is None else out.union(part)
    return out


def failure_audit(df: DataFrame, key: str, checks: dict[str, Column], dated: list[str], most: int = 20) -> DataFrame:
    """(part, name, n, example): rows by the first check that they fail (a null check counts as failed), with the least failing key as
    an example; observed, accepted and failed rows; distinct keys, keys with several rows and the `most` commonest of them, and rows without
    each date among the accepted. Failing rows are folded by reason, accepted ones by key; nothing else is shuffled."""
    reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])
    rows = df.withColumn("__reason", reason)
    k = F.col(key).cast("string")
    shape = lambda d, part, name, n, example=None: d.select(F.lit(part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"), (F.lit(None).cast("string") if example is None else example).alias("example"))
    failures = rows.where(F.col("__reason").isNotNull()).groupBy("__reason").agg(F.count("*").alias("n"), F.min(k).alias("least"))
    good = rows.where(F.col("__reason").isNull())
    per_key = good.groupBy(key).agg(F.count("*").alias("n"))
    totals = rows.agg(
        F.count("*").alias("observed"), F.count_if(F.col("__reason").isNull()).alias("accepted"), F.count_if(F.col("__reason").isNotNull()).alias("failed"),
        *[F.count_if(F.col("__reason").isNull() & F.col(c).isNull()).alias(f"missing {c}") for c in dated],
    )
    keys = per_key.agg(F.count("*").alias("distinct keys"), F.count_if(F.col("n") > 1).alias("repeated keys"))
    spread = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in d.columns])).alias("c")).select("c.*")
    common = per_key.where("n > 1").orderBy(F.col("n").desc(), key).limit(most)
    out = shape(spread(totals), "total", F.col("name"), F.col("n"))
    out = out.union(shape(spread(keys), "total", F.col("name"), F.col("n")))
    out = out.union(shape(failures, "failure", F.col("__reason"), F.col("n"), F.col("least")))
    return out.union(shape(common, "repeated", k, F.col("n")))
