"""Review: strict evidence joins, queues, overlays and deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("MATCH", "NON_MATCH", "UNCERTAIN")


def strict_join(base: DataFrame, **sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """base with every side joined on its keys; a row that misses any side is an error, raised when it is evaluated."""
    out = base
    for name, (side, keys) in sides.items():
        out = out.join(side.withColumn(f"__{name}", F.lit(True)), keys, "left")
        out = out.withColumn(f"__{name}", F.coalesce(F.col(f"__{name}"), F.raise_error(F.concat(F.lit(f"no {name} for "), F.to_json(F.struct(*keys)))).cast("boolean")))
        out = out.where(F.col(f"__{name}")).drop(f"__{name}")
    return out


def missing(base: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(side, keys, "left_anti")


def queue(candidates: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their decision, those decided as a match left out, strongest first (ties by keys)."""
    out = candidates.join(reviews.select(*keys, "decision"), keys, "left").where(F.coalesce("decision", F.lit("")) != "MATCH")
    return out.orderBy(F.col("exact_key").desc(), F.col("similarity").desc(), *keys)


def overlay(candidates: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """review_label from the latest review where there is one."""
    return candidates.join(reviews.select(*keys, F.col("decision").alias("__d")), keys, "left").withColumn("review_label", F.coalesce("__d", "review_label")).drop("__d")


def latest(reviews: DataFrame, keys: list[str], at: str) -> DataFrame:
    from . import ranking

    return ranking.keep_last(reviews, keys, [at])


def working_labels(rows: DataFrame, label: str = "review_label") -> DataFrame:
    """Rows of decided labels, with target 1 for a match."""
    return rows.where(F.col(label).isin("MATCH", "NON_MATCH")).withColumn("target", (F.col(label) == "MATCH").cast("int"))


def _digest(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_sample(rows: DataFrame, keys: list[str], group: str, seeds: Column, strata: dict[str, tuple[Column, int]], size: int, cap: int, strength: list[Column], seed: int = 17) -> DataFrame:
    """All seeds, then each stratum in turn up to its target, strongest first, at most `cap` rows of a group; at last any rows.

    Before a stratum is ranked, rows already taken are left out and a group offers no more rows than it may still give, so
    that exactly the wanted number reaches the driver; all in all that is the sample's size. Rows that repeat a key count as
    one and are all returned."""
    spark = rows.sparkSession
    types = dict(rows.dtypes)
    order = [*strength, _digest(seed, *keys)]
    picked = {tuple(r[k] for k in keys): r for r in rows.where(seeds).orderBy(*keys).limit(size + 1).collect()}
    if len(picked) > size:
        raise ValueError("the sample is smaller than its seeds")
    used: dict = {}
    for r in picked.values():
        used[r[group]] = used.get(r[group], 0) + 1
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rest = rows.where(~seeds)
    for cond, target in [*strata.values(), (F.lit(True), size)]:
        want = min(target, size - len(picked))
        if want <= 0:
            continue
        taken = F.broadcast(spark.createDataFrame(list(picked), key_schema))
        given = F.broadcast(spark.createDataFrame([(g, n) for g, n in used.items() if g is not None], f"`{group}` {types[group]}, __used int"))
        pool = rest.where(cond).join(taken, keys, "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").join(given, group, "left")
        pool = pool.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= cap - F.coalesce("__used", F.lit(0)))
        for r in pool.orderBy(*order).limit(want).collect():
            picked[tuple(r[k] for k in keys)] = r
            used[r[group]] = used.get(r[group], 0) + 1
    chosen = [tuple(k) for k in picked]
    return rows.join(F.broadcast(spark.createDataFrame(chosen, key_schema)), keys, "left_semi")


def round_robin_sample(rows: DataFrame, keys: list[str], stratum: list[str], seeds: Column, size: int, prefer: list[Column], seed: int = 17) -> DataFrame:
    """All seeds, then one of each stratum, then a second of each, and so on, the preferred first; `size` rows in all.

    Rows are numbered inside their stratum and taken by number, so one sort of small numbers decides."""
    w = Window.partitionBy(*stratum).orderBy(*prefer, _digest(seed, *keys))
    numbered = rows.withColumn("__seed", seeds.cast("int")).withColumn("__turn", F.when(seeds, F.lit(0)).otherwise(F.row_number().over(w)))
    return numbered.orderBy("__turn", _digest(seed, *stratum), *keys).limit(size).drop("__turn", "__seed")


def initial_label(exact: Column) -> Column:
    return F.when(exact, "positive_seed").otherwise("unlabeled")


def allowed(decisions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (role, action) that a permission names; everything else is denied."""
    return decisions.join(permissions, ["role", "action"], "left_semi")


# Who may do what.
PERMISSIONS = [(r, a) for r, acts in {"reviewer": ("review_identity", "read", "investigate", "export"), "investigator": ("read", "investigate", "export")}.items() for a in acts]
