"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every shuffled copy of a document gets a virtual finish time: the cumulative size of its source's queue up to and
including it, divided by the source's target. All queues are merged in order of that time (ties: source, copy, id)
and the merged queue is cut at the total budget, which is the sum of the targets. A source's second pass starts when
its first is used up, so no document is taken more often than `repeats` times.

Null text has size 0; a null source is a source of its own, last in order. Rows of size 0 take nothing. With no
words at all every target is 0. Repeated rows queue separately when their ids differ; rows that agree in source and id
share one place in the queue and are taken together. An empty table gives an empty result. Other columns are ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix shares out, as a part of all words.
SHARE = 1.5
#: Times that one document may be taken.
REPEATS = 2
#: Parts of each queue and of the merged queue in which running sums are taken apart from each other: as many as keep a part
#: at so many rows on average, at least `LEAST_PARTS`.
PART_ROWS, LEAST_PARTS = 50_000, 4096


def word_count(text: Column) -> Column:
    """Number of words; splitting at the spaces around them is cheaper than collecting the words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(spaced, r"[^x]+", "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, number, source_size, target) from (source, size): shares by weight, capped at repeats * source size, the
    excess given to the others by weight; number: the source's place in order. A source is capped when the level, budget left per
    unit of weight left, is above its cap per unit of weight. In order of that ratio the level rises with each capped source and
    falls after, so the final level is the highest of the running levels."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbers = per.withColumn("number", F.row_number().over(order))
    weighed = numbers.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
    ratio = weighed.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (
        ratio.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
        .withColumn("final", F.max("level").over(whole))
    )
    return level.select("source", "number", "source_size", F.when(F.col("ratio") < F.col("final"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, parts: int | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of docs; reruns agree.

    Texts are read once: ids, sources and sizes are written and used from there. Queue order is by the first 60 bits of md5 of the
    id and the copy's number. A queue's rows are numbers only and are written once; running sums go by (source, part of the hash
    range), so that no task holds a whole source. Of the merged queue a part of the virtual time that ends within the budget is
    taken as a whole, and only the one part in which the budget ends is put in order."""
    path = path or common.scratch(docs.sparkSession)
    rows = common.stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), path, "sizes")
    goal = common.stored(targets(rows, weights, share, repeats), path, "targets")
    parts = parts or max(LEAST_PARTS, rows.count() * repeats // PART_ROWS)
    named = goal.select(F.col("source").alias("__source"), "number", "target")
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("copy").cast("string")))
    queue = (
        rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).groupBy("number", "target", "doc_id").agg(F.sum("size").alias("size"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
        .withColumn("part", F.floor(F.col("key") / F.lit(float(1 << 60)) * parts).cast("int"))
    )
    queue = common.stored(queue, path, "queue", drop_shuffle=True)
    in_order = ["number", "copy", "part"]
    sums = queue.groupBy(*in_order).agg(F.sum("size").alias("part_size"))
    starts = sums.withColumn("start", F.sum("part_size").over(Window.partitionBy("number").orderBy("copy", "part")) - F.col("part_size")).drop("part_size")
    inside = F.sum("size").over(Window.partitionBy(*in_order).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = queue.withColumn("inside", inside).join(starts, in_order)
    finish = F.when(F.col("target") > 0, (F.col("inside") + F.col("start")) / F.col("target")).otherwise(F.lit(0.0))
    timed = placed.select("number", "copy", "key", "doc_id", "size", finish.alias("finish")).withColumn("slice", F.floor(F.col("finish") * F.lit(parts)))
    timed = common.stored(timed, path, "timed", drop_shuffle=True)
    budget = F.lit(float(goal.agg(F.sum("target")).first()[0] or 0.0))
    slices = timed.groupBy("slice").agg(F.sum("size").alias("slice_size")).withColumn("after", F.sum("slice_size").over(Window.orderBy("slice")))
    slices = common.stored(slices.select("slice", (F.col("after") - F.col("slice_size")).alias("before"), "after").where(F.col("before") <= budget), path, "slices")
    whole = timed.join(slices.where(F.col("after") <= budget).select("slice"), "slice", "left_semi").select("number", "doc_id")
    merged = Window.partitionBy("slice").orderBy("finish", "number", "copy", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = timed.join(slices.where(F.col("after") > budget), "slice").withColumn("upto", F.col("before") + F.sum("size").over(merged)).where(F.col("upto") <= budget)
    taken = whole.unionByName(cut.select("number", "doc_id")).groupBy("number", "doc_id").agg(F.count("*").alias("copies")).select(F.col("number").alias("__n"), F.col("doc_id").alias("__id"), "copies")
    described = rows.join(goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    out = described.join(taken, (F.col("number") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    copies = F.coalesce(F.col("copies"), F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: a row taken twice is there twice, a row not taken is gone; columns as in docs."""
    own = [common.free_name(docs, n) for n in ("id", "of_source", "copies", "copy")]
    i, s, n, copy = own
    plan = mix_plan(docs, id_col, text_col, source_col, **options).where("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).agg(F.max("copies").alias(n))
    hit = docs.join(plan, docs[id_col].eqNullSafe(plan[i]) & docs[source_col].eqNullSafe(plan[s]))
    return hit.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), plan[n])).alias(copy)).drop(copy)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: The same plan without parts: running sums over each whole queue and over the merged queue.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[^x]+', '', 'g'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM r
), f AS (
  SELECT *, max(level) OVER () AS final FROM l
), goal AS (
  SELECT source, source_size, CASE WHEN ratio < final THEN cap ELSE final * weight END AS target FROM f
), q AS (
  SELECT d.source, d.doc_id, d.size, c.copy, substr(md5(concat_ws(':', d.doc_id::VARCHAR, c.copy::VARCHAR)), 1, 15) AS key FROM d, (VALUES (0), (1)) c(copy)
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY copy, key, doc_id ROWS UNBOUNDED PRECEDING) AS words FROM q
), t AS (
  SELECT p.*, CASE WHEN target > 0 THEN words::DOUBLE / target ELSE 0.0 END AS finish FROM p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
), m AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM t
), k AS (
  SELECT source, doc_id, count(*) AS copies FROM m WHERE upto <= (SELECT sum(target) FROM goal) GROUP BY source, doc_id
)
SELECT d.doc_id, d.size, g.source_size, g.target, d.size * coalesce(k.copies, 0) AS taken, d.source
FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN k ON d.doc_id = k.doc_id AND d.source IS NOT DISTINCT FROM k.source
"""
