"""Uploads that come in chunks: what is missing, wrong or too much, and the content of whole uploads in bounded pieces.

sessions: (upload_id, size_bytes, chunk_size); chunks: (upload_id, chunk_index, data binary), null data being a chunk that could
not be decoded. A chunk covers the bytes from chunk_index * chunk_size on; all but the last have chunk_size bytes. The same
chunk may come twice if its content is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a piece of assembled content, at most (a chunk larger than that is a piece by itself).
PIECE_BYTES = 8 << 20


def decoded(chunks: DataFrame, encoded: str = "data") -> DataFrame:
    """Chunks whose data came as base64 text; text that is none becomes null."""
    sound = F.col(encoded).rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return chunks.withColumn(encoded, F.when(sound, F.unbase64(F.when(sound, F.col(encoded)))))


def _expected(index: Column) -> Column:
    """Bytes that a chunk should have; null if there is no such chunk."""
    n = F.ceil(F.col("size_bytes") / F.col("chunk_size"))
    return F.when((index >= 0) & (index < n), F.least(F.col("chunk_size"), F.col("size_bytes") - index * F.col("chunk_size"))).cast("long")


def _judged(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each different chunk with its expected size and how many contents its index has."""
    one = chunks.groupBy("upload_id", "chunk_index", F.sha2("data", 256).alias("digest")).agg(F.first("data").alias("data"))
    contents = F.count("*").over(Window.partitionBy("upload_id", "chunk_index"))
    return one.withColumn("contents", contents).join(sessions.select("upload_id", "size_bytes", "chunk_size"), "upload_id").withColumn("expected", _expected(F.col("chunk_index")))


def _sound() -> Column:
    return F.coalesce((F.col("contents") == 1) & (F.octet_length("data") == F.col("expected")), F.lit(False))


def faults(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(upload_id, chunk_index, last_index, fault, found, expected): runs of chunks that are missing, and single chunks that are
    `undecodable`, `out of range`, of `wrong size` (bytes found and expected) or `contradictory` (came with different contents).
    Chunks of an upload that has no session are `unknown upload`.

    Missing chunks are the gaps between neighbours in order, so nothing is made for a chunk that is not there."""
    judged = _judged(sessions, chunks)
    size = F.octet_length("data").cast("long")
    kind = (
        F.when(F.col("expected").isNull(), "out of range").when(F.col("contents") > 1, "contradictory")
        .when(F.col("data").isNull(), "undecodable").when(size != F.col("expected"), "wrong size")
    )
    row = ["upload_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_index").cast("long").alias("last_index")]
    single = judged.withColumn("fault", kind).where("fault is not null").groupBy("upload_id", "chunk_index", "fault", "expected").agg(F.max(size).alias("found"))
    single = single.select(*row, "fault", "found", "expected")
    n = F.ceil(F.col("size_bytes") / F.col("chunk_size")).cast("long")
    there = judged.where("expected is not null").select("upload_id", F.col("chunk_index").cast("long").alias("i")).distinct()
    ends = sessions.select("upload_id", F.explode(F.array(F.lit(-1).cast("long"), n)).alias("i"))
    following = F.lead("i").over(Window.partitionBy("upload_id").orderBy("i"))
    gaps = there.unionByName(ends).withColumn("then", following).where("then > i + 1")
    none = F.lit(None).cast("long")
    missing = gaps.select("upload_id", (F.col("i") + 1).alias("chunk_index"), (F.col("then") - 1).alias("last_index"), F.lit("missing").alias("fault"), none.alias("found"), (F.col("then") - F.col("i") - 1).alias("expected"))
    strange = chunks.join(sessions.select("upload_id"), "upload_id", "left_anti").groupBy("upload_id").agg(F.min("chunk_index").cast("long").alias("chunk_index"), F.max("chunk_index").cast("long").alias("last_index"), F.count("*").alias("found"))
    return single.unionByName(missing).unionByName(strange.select("upload_id", "chunk_index", "last_index", F.lit("unknown upload").alias("fault"), "found", none.alias("expected")))


def assembled(sessions: DataFrame, chunks: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(upload_id, piece, offset, data) of the uploads without a fault: their content in order, in pieces of bounded size.

    An upload is whole if its sound chunks are as many as it has chunks; an upload of no bytes is one empty piece."""
    sound = _judged(sessions, chunks).withColumn("ok", _sound())
    n = F.ceil(F.col("size_bytes") / F.col("chunk_size")).cast("long")
    counts = sound.groupBy("upload_id").agg(F.count("*").alias("came"), F.count_if("ok").alias("good"))
    whole = sessions.select("upload_id", n.alias("n")).join(counts, "upload_id", "left").where((F.coalesce("came", F.lit(0)) == F.col("n")) & (F.coalesce("good", F.lit(0)) == F.col("n")))
    each = F.greatest(F.lit(1), F.floor(F.lit(piece_bytes) / F.col("chunk_size")))
    placed = sound.where("ok").join(whole.select("upload_id"), "upload_id", "left_semi").withColumn("piece", F.floor(F.col("chunk_index") / each).cast("long")).withColumn("offset", F.col("chunk_index").cast("long") * F.col("chunk_size"))
    held = placed.groupBy("upload_id", "piece").agg(F.min("offset").alias("offset"), F.sort_array(F.collect_list(F.struct("chunk_index", "data"))).alias("c"))
    joined = F.aggregate(F.transform("c", lambda x: x["data"]), F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x))
    empty = whole.where("n = 0").select("upload_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("offset"), F.expr("cast('' as binary)").alias("data"))
    return held.select("upload_id", "piece", "offset", joined.alias("data")).unionByName(empty)
