"""Benchmark decontamination by winnowing.

Of the k-grams in every window of w consecutive ones the least hash is kept as a fingerprint (of equal ones the last),
on both sides. With k + w - 1 = n every shared span of n words holds a whole window on both sides, so it shares a
fingerprint. Documents' fingerprints that a bitmap of the benchmark's lets through are stored with the words around
them; they are joined with the benchmark's fingerprints and extended to both sides, word by word as text, and a run of n
words or more is a hit. An item of fewer words is one gram of that length, looked up at every place of a document.

The bitmap has `MOST_BITS` bits at most, however large the benchmark is: beyond that more fingerprints pass it and the
join rules them out. Documents are read once. No pair of a document and an item is made without a shared gram.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no words and no hits; an item without words
has no windows. Every row of documents gets a row, repeated ones too; texts of any length are taken whole. Items
of one id count once in `items`; an item of null id hits words but is not listed. An empty benchmark hits nothing.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Consecutive words that make a window.
WINDOW = 10
#: Bits of the bitmap for each of the benchmark's fingerprints, least and most bits in all (2 ** 27 are 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27

_GAP = np.ones(256, dtype=bool)
_GAP[0x30:0x3A] = _GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on; the last places, which have fewer, are left out."""
    n = max(0, len(words) - size + 1)
    out, factor = np.full(n, np.uint64(size)), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(size):
            factor *= _STEP
            out += words[j : j + n] * factor
    return common.mix64(out)


def winnow(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash (the last of equal ones) among each `span` consecutive grams within starts[i] .. ends[i] - 1."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        below = grams[j : j + n] <= least
        np.copyto(least, grams[j : j + n], where=below)
        np.copyto(place, np.arange(j, j + n), where=below)
    inside = np.zeros(n + 1, dtype=np.int64)
    whole = ends - starts >= span
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - span + 1, -1)
    chosen = np.zeros(len(grams), dtype=bool)
    chosen[place[np.cumsum(inside[:n]) > 0]] = True
    return np.flatnonzero(chosen)


def _around(words: common.Words, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Words lo .. hi - 1 as text with single spaces, for each pair."""
    length = words.ends - words.starts + 1
    joined = words.lowered[common.ragged(words.starts, length - 1)]
    begin = np.cumsum(length) - length
    spaced = np.full(int(length.sum()), 0x20, dtype=np.uint8)
    spaced[common.ragged(begin, length - 1)] = joined
    size = begin[hi - 1] + length[hi - 1] - 1 - begin[lo]
    off = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(spaced[common.ragged(begin[lo], size)].tobytes())).cast(pa.string())


def _places(words: common.Words, n: int, shorter: list[int] | None, passes: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, hashes, words of the gram): the winnowed k-grams, then whole grams of each shorter length; shorter None: of rows that are so short."""
    hashes = words.hashes() if len(words.starts) else np.zeros(0, np.uint64)
    first, last = words.first[:-1], words.first[1:]
    k = (n + 1) // 2
    grams = gram_hashes(hashes, k)
    at = winnow(grams, first, np.maximum(first, last - k + 1), n - k + 1)
    yield at, grams[at], k
    for m in range(1, n) if shorter is None else shorter:
        grams = gram_hashes(hashes, m)
        if shorter is None:
            at = first[words.counts == m]
        else:
            at = np.arange(len(grams))
            at = at[at + m <= last[words.doc[: len(grams)]]]
        # a gram that is an item by itself never meets a k-gram of longer items
        yield at, common.mix64(grams[at] ^ np.uint64(m)), -m


def _fingerprints(column: str, n: int, shorter: Callable[[], list[int] | None], bitmap: Callable[[], np.ndarray | None], heads: bool) -> Callable:
    """Rows (row, id, n_words, hash, pos, left, gram, around): a head for each row of the input, with null hash, if asked for, and its fingerprints."""
    k = (n + 1) // 2

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, short, bits = TaskContext.get().partitionId() << 40, shorter(), bitmap()
        mask = None if bits is None else np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, column):
                ids = batch.column(0).slice(lo, hi - lo)
                words = common.Words(data, off, _GAP)
                row = number + np.arange(hi - lo)
                number += hi - lo
                if heads:
                    none = lambda t: pa.nulls(hi - lo, t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(row), ids, pa.array(words.counts.astype(np.int64)), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.string())], names=NAMES)
                for at, hashes, gram in _places(words, n, short, None):
                    if bits is not None:
                        bit = hashes & mask
                        kept = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                        at, hashes = at[kept], hashes[kept]
                    if not len(at):
                        continue
                    doc = words.doc[at]
                    start, end, size = words.first[doc], words.first[doc + 1], abs(gram)
                    reach = n - k if gram > 0 else 0
                    left = np.maximum(start, at - reach)
                    right = np.minimum(end, at + size + reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[doc]), ids.take(pa.array(doc)), pa.nulls(len(at), pa.int64()), pa.array(hashes.view(np.int64)), pa.array((at - start).astype(np.int32)), pa.array((at - left).astype(np.int32)), pa.array(np.full(len(at), gram, np.int32)), _around(words, left, right)],
                        names=NAMES,
                    )

    return f


NAMES = ["row", "id", "n_words", "hash", "pos", "left", "gram", "around"]


def _schema(id_type: str) -> str:
    return f"row long, id {id_type}, n_words long, hash long, pos int, left int, gram int, around string"


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the benchmark's fingerprints, a power of two of them, at most MOST_BITS."""
    count = items.select("hash").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()))
    placed = items.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    parts = placed.groupBy(F.shiftright("bit", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[parts["lane"].to_numpy()] = parts["set"].to_numpy()
    return out.view(np.uint64)


def _run(here: Column, there: Column, from_here: Column, from_there: Column, step: int, most: int) -> Column:
    """Equal words one after the other, going `step` at a time from the two places on."""
    total, going = F.lit(0), F.lit(True)
    for j in range(most):
        going = going & F.coalesce(F.get(here, from_here + j * step) == F.get(there, from_there + j * step), F.lit(False))
        total = total + going.cast("int")
    return total


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WINDOW, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Heads (row, id, n_words), one for each row of docs, and hits (row, start, end, item): runs of words that are also in the item,
    long enough to hold one of its windows; end is exclusive. Every word in a window's occurrence lies in a run."""
    spark = docs.sparkSession
    path = path or common.scratch(spark)
    k = (n + 1) // 2
    described = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    items = common.map_batches(described, _fingerprints("text", n, lambda: None, lambda: None, False), _schema(described.schema["id"].dataType.simpleString()))
    items = common.stored(items.select("hash", "gram", F.col("id").cast("string").alias("item"), F.col("left").alias("item_left"), F.col("around").alias("item_around")), path, "items")
    shorter = sorted(-r["gram"] for r in items.where("gram < 0").select("gram").distinct().collect())
    shared = spark.sparkContext.broadcast(_bitmap(items))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = common.map_batches(texts, _fingerprints("text", n, lambda: shorter, lambda: shared.value, True), _schema(texts.schema["id"].dataType.simpleString()))
    found = common.stored(found, path, "found")
    shared.destroy()
    met = found.where("hash is not null").select("row", "hash", "gram", "pos", "left", "around").join(items, ["hash", "gram"])
    here, there = F.split("around", " "), F.split("item_around", " ")
    whole = _run(here, there, F.col("left"), F.col("item_left"), 1, k) == k
    before = _run(here, there, F.col("left") - 1, F.col("item_left") - 1, -1, n - k)
    after = _run(here, there, F.col("left") + k, F.col("item_left") + k, 1, n - k)
    long = met.where("gram > 0").where(whole).withColumn("before", before).withColumn("after", after).where(F.col("before") + F.col("after") + k >= n)
    long = long.select("row", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + k + F.col("after")).alias("end"), "item")
    short = met.where("gram < 0 and around = item_around").select("row", F.col("pos").alias("start"), (F.col("pos") - F.col("gram")).alias("end"), "item")
    return found.where("hash is null").select("row", "id", "n_words"), long.unionByName(short)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WINDOW, path: str | None = None) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans), one row per row of docs: spans are the maximal runs of hit words (start, end exclusive), items the sorted ids."""
    heads, found = hits(docs, benchmark, id_col, text_col, item_col, n, path)
    per = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    # runs in order of their start: one that begins inside the last span makes it longer
    join = lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= r["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(r)))
    spans = F.aggregate("runs", F.expr("cast(array() as array<struct<start:int,end:int>>)"), join)
    out = heads.join(per.select("row", "items", spans.alias("spans")), "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id belongs to a contaminated one; rows of null id stay."""
    bad = contamination(docs, benchmark, id_col, **options).where("n_hit > 0").select(F.col(id_col).alias("__contaminated")).distinct()
    return docs.join(bad, docs[id_col] == bad["__contaminated"], "left_anti")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: All windows of both sides as text, without fingerprints.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)
), h AS (
  SELECT g.doc_id, g.s, g.m, i.item_id FROM g JOIN i ON g.m = i.m AND g.g = i.g
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
