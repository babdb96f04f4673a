"""Ranks, keep-first and keep-last, quantiles by several conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group; the order must be total for a stable answer."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def review_rank(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Exact-key pairs all stay; of the others the k best of each left row. Pairs are there once.

    An exact-key pair is a kind of its own, so that all kinds have k rows at most and tasks give away no more than that before pairs are
    shuffled; ranks go over those that are left, since exact keys come first."""
    order = [F.col("exact_key").desc(), F.col("shared_count").desc(), F.col("jaccard").desc(), F.col("right_id").desc()]
    kinds = pairs.withColumn("__own", F.when(F.col("exact_key"), F.col("right_id")))
    few = top_k(kinds, ["left_id", "exact_key", "__own"], order, k, "rank_in_kind").drop("rank_in_kind", "__own")
    return few.withColumn("review_rank", F.row_number().over(Window.partitionBy("left_id").orderBy(*order)))


def _kept(df: DataFrame, key: list[str], order: list[str], pick) -> DataFrame:
    names = df.columns
    chosen = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(pick(F.struct(*names), F.struct(*order)).alias("__r"))
    # keys come from the grouping, so that their partitioning is known to what follows; a number's zero may have a sign there
    types = dict(df.dtypes)
    own = {k: f"__k{i}" for i, k in enumerate(key) if types.get(k) in ("string", "boolean", "date", "timestamp", "tinyint", "smallint", "int", "bigint")}
    return chosen.select([F.col(own.get(n, f"__r.{n}")).alias(n) for n in names])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, least in order. An aggregate chooses it and combines before the shuffle, so no window
    has to hold a hot key's rows."""
    return _kept(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _kept(df, key, order, F.max_by)


#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def in_parts(df: DataFrame | list[DataFrame], order: list[Column]) -> DataFrame:
    """df in order, written, with `__part` and `__at`: parts follow each other in order, and so do the rows of a part.

    The parts are the ranges into which a sort deals the rows, so none holds more than its share unless values are equal. df may be several
    that follow each other in order; each is written, and its shuffles removed, before the next is looked at."""
    ranges = df if isinstance(df, list) else [df]
    path, out = tables.scratch(ranges[0].sparkSession), None
    for i, one in enumerate(ranges):
        placed = one.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
        rows = tables.stored(placed, f"{path}/sorted{i}", cleared=len(ranges) > 1).withColumn("__part", F.shiftright("__at", _ROW_BITS) + F.lit(i << (64 - _ROW_BITS)))
        out = rows if out is None else out.unionByName(rows)
    return out


def cuts(df: DataFrame, column: str, n: int, rows: int, sampled: int = 10_000) -> list:
    """Values that cut df into n ranges of like size, n - 1 at most, from a sample of about so many of its rows; which rows are sampled moves the
    ranges only."""
    values = df.where(F.col(column).isNotNull()).select(column).sample(min(1.0, sampled / max(1, rows)), seed=3).toArrow()[column].to_pylist()
    values.sort()
    return sorted({values[len(values) * i // n] for i in range(1, n)} if values else set())


def row_numbers(df: DataFrame | list[DataFrame], order: list[Column], name: str = "number") -> DataFrame:
    """df with the place of each row, from 1, in a total order. Rows are numbered inside parts; a window runs over the parts' counts alone."""
    parts = in_parts(df, order)
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", before.alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return parts.join(starts, "__part").withColumn(name, number).drop("__part", "__at", "__before")


def numbered(df: DataFrame | list[DataFrame], order: list[Column], prefix: str, name: str, width: int = 4) -> DataFrame:
    """Sequential ids such as ER-0001 in a total order."""
    n = F.col("__number").cast("string")
    out = row_numbers(df, order, "__number").withColumn(name, F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))
    return out.drop("__number")


def _place(n: Column, p: float, convention: str) -> Column:
    """Place of a quantile among n sorted values, from 1. ceil: p n; floor: p n, at least 1; nearest: (n - 1) p, ties to even."""
    return {
        "ceil": F.greatest(F.lit(1), F.ceil(n * p)),
        "floor": F.greatest(F.lit(1), F.floor(n * p)),
        "nearest": F.bround((n - 1) * F.lit(p)) + 1,
        "upper_median": F.floor(n / 2) + 1,
    }[convention].cast("long")


def quantile(sorted_values: Column, p: float, convention: str) -> Column:
    """Element of a sorted array, for short arrays."""
    return F.try_element_at(sorted_values, _place(F.size(sorted_values), p, convention).cast("int"))


def _counts_in_parts(df: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, value, n, __part) of distinct values, and (by, __part, before, inside, total): how many rows lie before a part, in it and in all.

    Windows run over the parts of each group, which are as many as a sort has partitions."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = in_parts(counts, [*map(F.col, by), F.col("value")])
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    sums = placed.groupBy(*by, "__part").agg(F.sum("n").alias("inside"))
    return placed, sums.withColumn("before", F.sum("inside").over(whole.orderBy("__part")) - F.col("inside")).withColumn("total", F.sum("inside").over(whole))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join in which null keys are equal too."""
    b = b.select([F.col(c).alias(f"__b_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return a.join(b, cond).drop(*[f"__b_{k}" for k in keys])


def value_counts(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """(by, value, n, upto, total): how often each value occurs, how many are up to it, and how many there are.

    Running counts are taken inside parts of the order, so no task holds a group's values."""
    placed, parts = _counts_in_parts(df, value, by)
    inside = F.sum("n").over(Window.partitionBy(*by, "__part").orderBy("value"))
    out = _same(placed.withColumn("__inside", inside), parts.drop("inside"), [*by, "__part"])
    return out.select(*by, "value", "n", (F.col("before") + F.col("__inside")).alias("upto"), "total")


def order_statistics(df: DataFrame, value: str, places: dict[str, Column], by: list[str] = []) -> DataFrame:
    """(by, and a column of each name): the values at places (from 1, as an expression of `total`) among each group's sorted values.

    Two passes: counts of parts tell in which part a place lies, and only that part is put in order."""
    placed, parts = _counts_in_parts(df, value, by)
    asked = parts.select(*by, "__part", "before", "inside", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.cast("long").alias("place")) for n, p in places.items()])).alias("a")).select(*by, "__part", "before", "inside", "a.*")
    hit = asked.where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("inside")))
    needed = _same(placed, hit.select(*by, "__part").distinct(), [*by, "__part"])
    ordered = needed.withColumn("__inside", F.sum("n").over(Window.partitionBy(*by, "__part").orderBy("value"))).select(*by, "__part", "value", "n", "__inside")
    found = _same(ordered, hit, [*by, "__part"]).where((F.col("before") + F.col("__inside") >= F.col("place")) & (F.col("before") + F.col("__inside") - F.col("n") < F.col("place")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in places])


def quantiles(df: DataFrame, value: str, ps: list[float], convention: str, by: list[str] = []) -> DataFrame:
    """(by, p, v): quantiles of a column by one of the conventions."""
    one = order_statistics(df, value, {f"q{i}": _place(F.col("total"), p, convention) for i, p in enumerate(ps)}, by)
    return one.select(*by, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{i}").alias("v")) for i, p in enumerate(ps)])).alias("q")).select(*by, "q.p", "q.v")


def distribution(counts: DataFrame, value: str, by: list[str] = [], convention: str = "nearest") -> DataFrame:
    """least, median, mean, p90, largest and number of groups with any, over one count for each group."""
    total = F.col("total")
    at = order_statistics(counts, value, {"lower": F.floor((total + 1) / 2), "upper": F.floor(total / 2) + 1, "p90": _place(total, 0.9, convention)}, by)
    v = F.col(value)
    sums = counts.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("groups"), F.count_if(v > 0).alias("with_any"), F.min(v).alias("least"), (F.sum(v) / F.count("*")).alias("mean"), F.max(v).alias("largest"),
    )
    both = _same(sums, at, by) if by else sums.where("groups > 0").join(at)
    return both.select(*by, "groups", "with_any", "least", ((F.col("lower") + F.col("upper")) / 2).alias("median"), "mean", "largest", "p90")
