"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

DataFrame functions only. Null text counts as empty. Texts are equal when identical after every run of
`[\\x20\\x09-\\x0D]+` becomes one space. Rows with a null id are never merged: each stays, as its own group.
Repeated ids with equal text form one group; an empty table gives an empty result; other columns are ignored
here and kept by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Two reads of the texts. The first groups by hash and the bytes themselves; copies are folded before the shuffle, so no
    task holds a group. Only groups of several rows, and texts that share a hash, are written, without their bytes. The
    second read meets them by hash; a hash that stands for several texts, if there is one, is met by the bytes too."""
    spark = docs.sparkSession
    path = path or common.scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hashed = rows.select("doc_id", F.unhex(F.md5("norm")).alias("h"), "norm")
    texts = hashed.where("doc_id is not null").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_hash = (
        texts.groupBy("h").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .where("group_size > 1")
    )
    by_hash = common.stored(by_hash, path, "groups", drop_shuffle=True)
    slim = hashed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    joined = slim.join(by_hash, "h", "left")
    out = joined.where("texts is null or texts = 1 or doc_id is null").select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("keep_id", "doc_id")).alias("keep_id"),
        F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.coalesce("group_size", F.lit(1))).cast("long").alias("group_size"),
        "text_sha256",
    )
    shared = by_hash.where("texts > 1").select("h")
    if shared.take(1):
        mixed = hashed.where("doc_id is not null").join(shared, "h", "left_semi")
        apart = mixed.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(mixed.join(apart, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that `exact_groups` drops; all columns stay, whatever their names.

    A row goes only if its own text has an earlier copy: rows of one id are told apart by their texts' digests."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["__sha"]), "left_anti")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
