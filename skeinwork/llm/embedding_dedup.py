"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A bounded sample of unit vectors (those of the least hashes) is centred and rotated; alternating sign codes and the best rotation towards them gives
balanced bits of small quantisation error. Several such rotations, from different starts, make one long code, which is
cut into substrings, one table for each. Vectors of one label that agree in a whole substring meet in its table; those
close enough in the whole code are compared by their original components in double precision.

The bits of a table's key grow with the logarithm of the largest label. The number of tables follows from the sample:
sampled vectors get partners at exactly the least cosine, and tables are added until `RECALL` of these pairs meet. If
`MOST_TABLES` do not reach it, one more table takes all vectors of a label, so that every pair is compared. Equal vectors stand for each other. Large buckets are compared in
tiles of bounded size; a tile gives counts for each vector and the edges of a spanning forest, never its list of pairs.
A pair that meets in several tables counts in the first.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows of null label or
null id. Vectors of different lengths are never compared. Rows of one id are one node for the components, while each
row counts the links of its own vector. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 0.93
#: Vectors that the rotations are learnt from, about; twice as many at most.
SAMPLE = 4096
#: Least and most bits of a table's key, vectors of a label that a key is to have on average.
KEY_BITS, MOST_KEY_BITS, PER_KEY = 12, 24, 16
#: Part of simulated pairs that must meet, simulated pairs at least, tables at most.
RECALL = 0.9995
PAIRS = 4096
MOST_TABLES = 256
ITERATIONS = 30
TILE = 1024


@dataclass
class Quantiser:
    mean: np.ndarray
    projection: np.ndarray  # components x bits, a multiple of key_bits
    most_bits: int  # codes of vectors at the least cosine differ in no more bits
    key_bits: int = KEY_BITS
    exact: bool = False  # one more table, in which all vectors meet

    @property
    def tables(self) -> int:
        return self.projection.shape[1] // self.key_bits + self.exact

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.projection > 0

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """rows x tables: the number that each substring of a code spells."""
        cut = bits.reshape(len(bits), -1, self.key_bits)
        keys = cut @ (1 << np.arange(self.key_bits))
        return np.concatenate([keys, np.zeros((len(bits), 1), keys.dtype)], axis=1) if self.exact else keys


def rotation(v: np.ndarray, rng: np.random.Generator, iterations: int = ITERATIONS) -> np.ndarray:
    """Iterative quantisation: signs for a fixed rotation, then the rotation nearest to the signs."""
    d = v.shape[1]
    r, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for _ in range(iterations):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(v.T @ signs)
        r = u @ w
    return r


def key_bits(largest: int) -> int:
    """Bits of a key for labels of so many vectors."""
    return min(MOST_KEY_BITS, max(KEY_BITS, (max(1, largest) // PER_KEY).bit_length()))


def fit(sample: np.ndarray, least: float = LEAST, seed: int = 3, width: int = KEY_BITS, most_tables: int = MOST_TABLES) -> Quantiser:
    """Quantiser from unit vectors; as many tables of `width` bits as the simulated pairs need."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    mean = sample.mean(0)
    v = sample - mean
    first = sample[np.arange(max(n, -(-PAIRS // n) * n)) % n]
    noise = rng.standard_normal(first.shape)
    noise -= (noise * first).sum(1, keepdims=True) * first
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = least * first + (1 - least * least) ** 0.5 * noise
    pca = np.linalg.svd(v, full_matrices=False)[2].T if n >= d else np.eye(d)
    parts: list[np.ndarray] = []
    met, apart, tables = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=np.int64), 0
    while tables < most_tables:
        while sum(p.shape[1] for p in parts) < (tables + 1) * width:
            parts.append(pca @ rotation(v @ pca, rng))  # each rotation starts elsewhere
        one = np.concatenate(parts, axis=1)[:, tables * width : (tables + 1) * width]
        differ = ((first - mean) @ one > 0) != ((partner - mean) @ one > 0)
        met |= ~differ.any(axis=1)
        apart += differ.sum(1)
        tables += 1
        if met.mean() >= RECALL:
            break
    whole = np.concatenate(parts, axis=1)[:, : tables * width]
    exact = bool(met.mean() < RECALL)
    return Quantiser(mean, whole, whole.shape[1] if exact else int(apart.max() + 3 * apart.std() + 1), width, exact)


def _sound() -> Column:
    """Whether a row (vec_id, label, v) can link."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    return F.coalesce(fine & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _meetings(tile: np.ndarray, side: np.ndarray, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile, across its sides if it has two, in blocks; rows are sorted by tile and side."""
    cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
    sizes = np.diff(cuts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    two = np.zeros(len(sizes), dtype=bool)
    np.logical_or.at(two, of, side == 1)
    small = np.flatnonzero(sizes[of] <= 48)
    for lag in range(1, 48):
        i = small[small + lag < len(tile)]
        i = i[of[i] == of[i + lag]]
        if not len(i):
            break
        j = i + lag
        ok = ~two[of[i]] | (side[i] != side[j])
        yield i[ok], j[ok]
    for k in np.flatnonzero(sizes > 48):
        rows = np.arange(cuts[k], cuts[k + 1])
        left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if two[k] else (rows, rows)
        step = max(1, block // len(right))
        for p in range(0, len(left), step):
            i, j = np.repeat(left[p : p + step], len(right)), np.tile(right, len(left[p : p + step]))
            if not two[k]:
                ok = i < j
                i, j = i[ok], j[ok]
            yield i, j


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", path: str | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors."""
    spark = vectors.sparkSession
    path = path or common.scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = rows.where(_sound())
    # equal vectors of a label stand for each other; a class has a number of its own, since one id may be in several
    classes = sound.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times")).withColumn("dim", F.size("v"))
    reps = common.stored(classes.withColumn("rep", F.monotonically_increasing_id()), path, "reps")
    members = common.stored(sound.join(reps.select("label", "v", "rep", "times"), ["label", "v"]).select("vec_id", "rep", "times"), path, "members")
    dims = [r["dim"] for r in reps.groupBy("dim").agg(F.countDistinct("label").alias("n"), F.count("*").alias("c")).where("c > 1").orderBy("dim").collect()]
    parts = [_links(reps.where(F.col("dim") == d), d, least, f"{path}/dim{d}") for d in dims]
    if not parts:
        found = spark.createDataFrame([], "node long, links long, root long")
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    edges = found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # the classes of one id are tied by it
    first = members.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").drop("last")
    shared = members.join(first, "vec_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    comp = common.components(edges.union(shared).distinct(), path).select(F.col("node").alias("rep"), "root")
    placed = members.join(comp, "rep", "left").join(counts, "rep", "left").select("vec_id", F.coalesce("root", "rep").alias("root"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    placed = common.stored(placed, path, "placed")
    smallest = placed.groupBy("root").agg(F.min("vec_id").alias("component"))
    per_id = placed.groupBy("vec_id").agg(F.min("root").alias("root")).join(smallest, "root").select("vec_id", "component")
    every = placed.select("vec_id", "n_links").unionByName(rows.where(~_sound()).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = every.join(per_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dim: int, least: float, path: str) -> DataFrame:
    """(node, links, root): for classes of one vector length, links to other classes' members and edges that span them."""
    spark = reps.sparkSession
    count, largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    hashed = F.pmod(F.xxhash64("label", "least", "v"), F.lit(count))
    picked = sorted(reps.where(hashed < SAMPLE).select(hashed.alias("h"), "v").limit(2 * SAMPLE).collect())
    q = fit(_unit(np.array([r["v"] for r in picked], dtype=np.float64)), least, width=key_bits(largest))
    shared = spark.sparkContext.broadcast(q)
    words = -(-q.projection.shape[1] // 64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = q.bits(_unit(_matrix(batch.column(2))))
            padded = np.zeros((len(bits), words * 64), dtype=bool)
            padded[:, : bits.shape[1]] = bits
            code = np.packbits(padded, axis=1, bitorder="little").view(np.int64)
            lists = lambda x, n, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(x.ravel(), kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(code, words, pa.int64()), lists(q.keys(bits).astype(np.int32), q.tables, pa.int32())], names=["rep", "label", "code", "keys"])

    label_type = reps.schema["label"].dataType.simpleString()
    codes = common.stored(common.map_batches(reps.select("rep", "label", "v"), coded, f"rep long, label {label_type}, code array<long>, keys array<int>"), path, "codes")
    posted = codes.select("rep", "label", F.posexplode("keys").alias("table", "key"))
    sizes = posted.groupBy("label", "table", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / TILE).cast("int")).drop("size")
    placed = posted.join(sizes, ["label", "table", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = placed.select(F.xxhash64("label", "table", "key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "table", "rep")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = shared.value.most_bits
        for rows in common.whole_runs(batches):
            tile, side = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            code = _matrix(rows.column("code")).view(np.uint64)
            hit = np.zeros(len(tile), dtype=bool)
            for i, j in _meetings(tile, side, 1 << 18):
                near = np.bitwise_count(code[i] ^ code[j]).sum(1, dtype=np.int32) <= limit
                hit[i[near]] = True
                hit[j[near]] = True
            kept = rows.filter(pa.array(hit)).select(["tile", "side", "table", "rep"])
            yield from kept.combine_chunks().to_batches()

    ordered = tiles.join(codes.select("rep", "code"), "rep").select("tile", "side", "table", "rep", "code").repartition("tile").sortWithinPartitions("tile", "side")
    near = common.stored(common.map_batches(ordered, close, "tile long, side int, table int, rep long"), path, "near")
    full = near.join(reps.select("rep", "times", "v"), "rep").join(codes.select("rep", "keys"), "rep").select("tile", "side", "table", "rep", "times", "v", "keys").repartition("tile").sortWithinPartitions("tile", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_runs(batches):
            tile, side, table, rep, times = (rows.column(c).to_numpy() for c in range(5))
            unit, keys = _unit(_matrix(rows.column("v"))), _matrix(rows.column("keys"))
            links = np.zeros(len(tile), dtype=np.int64)
            lab = rep.copy()
            ties: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in _meetings(tile, side, 1 << 16):
                ok = (unit[i] * unit[j]).sum(1) >= least
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                # the first table in which both have the same key
                first = (keys[i] == keys[j]).argmax(1) == table[i]
                np.add.at(links, i[first], times[j[first]])
                np.add.at(links, j[first], times[i[first]])
                ties.append((i[first].astype(np.int32), j[first].astype(np.int32)))
            if ties:
                i, j = (np.concatenate([t[k] for t in ties]) for k in (0, 1))
                while True:
                    low = np.minimum(lab[i], lab[j])
                    if (lab[i] == low).all() and (lab[j] == low).all():
                        break
                    np.minimum.at(lab, i, low)
                    np.minimum.at(lab, j, low)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(lab[some])], names=["node", "links", "root"])

    out = common.map_batches(full, compared, "node long, links long, root long")
    summed = out.groupBy("node", "root").agg(F.sum("links").alias("links"))
    return common.stored(summed.select("node", "links", "root"), path, "links")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read_table(spark, sf_dir, "embeddings"))
