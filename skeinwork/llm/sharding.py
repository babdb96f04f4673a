"""Sharding by sampled splitters: law `bytes`, shards of near equal sizes with equal texts side by side.

Rows are keyed by their text's digest, so equal texts share a key. A sample drawn with odds in proportion to size
gives quantile boundaries of key ranges; the exact size of every range follows from one aggregation. Rows of equal
key form a group, which stays together. Groups over `large` of a shard's size (at most shards / large of them) are
placed first, largest first, into the emptiest shard. The others are laid end to end in range and key order, and each
goes to the shard in whose remaining room its middle falls. A group that fits no shard is overfull: it is subdivided
by id digest into pieces, which are laid like groups. Large groups that stay whole are numbered in pieces too, so that
no task orders more than a small part of a shard.

Null text has only the one extra byte. Repeated rows are separate rows. Null ids are dealt as a key of their own.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Key ranges for each shard, and sampled keys for each range.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 8
#: Pieces into which a group larger than a shard is cut, and those in which a whole large group is numbered.
PIECES = 4096
NUMBERED = 256
#: Part of a shard's size from which a group is placed by itself.
LARGE = 1 / 640


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = RANGES_PER_SHARD, samples_per_range: int = SAMPLES_PER_RANGE, pieces: int = PIECES, large: float = LARGE, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs. Texts are read once; ids, sizes and digests are
    written and used from there."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.md5(raw).alias("key"),
    )
    rows = common.stored(rows, path or common.scratch(docs.sparkSession), "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("group_size"))
    total = groups.agg(F.sum("group_size").alias("total"), F.count("*").alias("n")).first()
    if not total["total"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    per_shard = total["total"] / shards
    wanted = shards * ranges_per_shard * samples_per_range
    # odds of being drawn: size over total times the wanted number, by a hash of the key so that reruns agree
    odds = F.col("group_size") / F.lit(float(total["total"])) * F.lit(float(wanted))
    draw = F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit("draw"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    drawn = [r[0] for r in groups.where(draw < odds).select("key").orderBy("key").collect()]  # at most about `wanted` keys, whatever the input
    step = max(1, len(drawn) // (shards * ranges_per_shard))
    splitters = drawn[step::step]
    in_range = _range_of(F.col("key"), splitters)
    # at most shards / large groups, so the driver and the broadcasts hold a bounded number of them
    big = sorted(((r["group_size"], r["key"]) for r in groups.where(F.col("group_size") > per_shard * large).collect()), key=lambda x: (-x[0], x[1]))
    load, at, overfull = [0.0] * shards, {}, []
    for g, key in big:
        k = min(range(shards), key=lambda i: (load[i], i))
        if load[k] + g > per_shard * 1.01:
            overfull.append(key)
        else:
            load[k] += g
            at[key] = k
    room = [max(0.0, per_shard - x) for x in load]
    bounds = [sum(room[: i + 1]) for i in range(shards - 1)]
    spark = docs.sparkSession
    fixed = F.broadcast(spark.createDataFrame([(k, v, False) for k, v in at.items()] + [(k, None, True) for k in overfull], "key string, fixed int, overfull boolean"))
    dealt = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)))
    piece = F.when(F.col("overfull"), F.pmod(dealt, F.lit(pieces))).when(F.col("fixed").isNotNull(), F.pmod(dealt, F.lit(NUMBERED))).otherwise(F.lit(0)).cast("int")
    pieced = rows.join(fixed, "key", "left").withColumn("piece", piece).drop("overfull").withColumn("range", in_range)
    units = pieced.groupBy("range", "key", "piece", "fixed").agg(F.sum("size").alias("unit_bytes"), F.count("*").alias("unit_rows"))
    units = units.withColumn("unit_size", F.when(F.col("fixed").isNull(), F.col("unit_bytes")).otherwise(F.lit(0)))
    range_sizes = units.groupBy("range").agg(F.sum("unit_size").alias("range_size"))
    starts = range_sizes.withColumn("start", F.sum("range_size").over(Window.orderBy("range")) - F.col("range_size")).drop("range_size")
    inside = Window.partitionBy("range").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("unit_size").over(inside), F.lit(0)) + F.col("unit_size") / 2
    placed = (
        units.join(F.broadcast(starts), "range")
        .withColumn("middle", middle)
        .withColumn("shard", F.coalesce(F.col("fixed"), F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("middle")))))
        .withColumn("rows_before", F.coalesce(F.sum("unit_rows").over(Window.partitionBy("range", "shard").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    cell_rows = placed.groupBy("shard", "range").agg(F.sum("unit_rows").alias("cell_rows"))
    cells = cell_rows.withColumn("cell_start", F.sum("cell_rows").over(Window.partitionBy("shard").orderBy("range")) - F.col("cell_rows")).drop("cell_rows")
    units_placed = placed.join(F.broadcast(cells), ["shard", "range"]).select("key", "piece", "shard", (F.col("cell_start") + F.col("rows_before")).alias("unit_start"))
    order = Window.partitionBy("key", "piece").orderBy("doc_id")
    out = pieced.withColumn("nth", F.row_number().over(order)).join(units_placed, ["key", "piece"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("unit_start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key, by a search through a constant sorted array."""
    if not splitters:
        return F.lit(0)
    # the leading 13 hex digits as a number: width_bucket-like search in a literal array of doubles is exact below 2**53
    number = F.conv(F.substring(key, 1, 13), 16, 10).cast("long")
    bounds = sorted({int(s[:13], 16) for s in splitters})
    coarse = 256
    start = [0] * (coarse + 1)
    for i in range(coarse + 1):
        limit = i << 44
        start[i] = sum(1 for b in bounds if b < limit)
    first = F.shiftright(number, 44).cast("int")
    lo = F.element_at(F.array(*[F.lit(x) for x in start[:coarse]]), first + 1)
    hi = F.element_at(F.array(*[F.lit(x) for x in start[1:]]), first + 1)
    near = F.slice(F.array(*[F.lit(b) for b in bounds]), lo + 1, hi - lo)
    return (lo + F.size(F.filter(near, lambda b: b <= number))).cast("int")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read_table(spark, sf_dir, "documents"))
