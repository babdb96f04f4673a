"""Hard negatives by exact inner products, with an orthogonal rotation that lets most pairs go early.

The axes are the principal components of a bounded sample (some `SAMPLE` rows, at most twice as many; it affects time, never results), so a
vector's leading components hold most of it. Anchors and rows meet in tiles of bounded size. In a tile the products of
the leading components are added up in stages; what is left is at most the product of the two remainders' norms, and a
slack covers rounding. A pair that can no longer reach what its anchor needs is dropped; the rest is verified with
products of the whole numbers. The first pass finds each anchor's positives, the second the negatives whose score lies
between given parts of a positive's score.

Rows with a null id, label or vector, or a component that is null or not finite (after scaling too) take no part. Only
vectors of one length are compared. Of several rows of one id the one with the least label and vector is used. A score
beyond a long is its nearest long. Ties go to the smaller id. An anchor without another row of its label has no
positives and gives no row, nor does a positive of negative score. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that the axes are learnt from, about.
SAMPLE = 4096
#: Anchors and rows in a tile, on average; pairs that are looked at together.
ANCHORS, ROWS, PAIRS = 4096, 8192, 1 << 19
#: Parts of the components after which pairs are dropped.
STAGES = (8, 4, 2, 1)
#: Rounding of rotated products against the product of the norms.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


class Vectors:
    """Whole-number vectors of one length, rotated, with the norms of what follows each stage."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, axes: np.ndarray | None):
        self.ids, self.q = ids, q
        d = q.shape[1]
        self.u = q if axes is None else q @ axes
        self.ends = sorted({-(-d // s) for s in STAGES}) if d else []
        self.rest = [np.sqrt((self.u[:, e:] ** 2).sum(1)) for e in self.ends]
        self.norm = np.sqrt((q**2).sum(1))
        self.wide = np.abs(q).max(1, initial=0) >= 1 << 24

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.q, out.u, out.ends, out.norm, out.wide = self.ids[at], self.q[at], self.u[at], self.ends, self.norm[at], self.wide[at]
        out.rest = [r[at] for r in self.rest]
        return out


def scores(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Inner products of whole numbers; those that could leave the range of a long are made with Python's numbers."""
    out = np.zeros(len(i), dtype=np.int64)
    for lo in range(0, len(i), block):
        x, y = i[lo : lo + block], j[lo : lo + block]
        big = a.wide[x] | b.wide[y]
        with np.errstate(invalid="ignore", over="ignore"):
            out[lo : lo + block] = (np.where(big[:, None], 0, a.q[x]).astype(np.int64) * np.where(big[:, None], 0, b.q[y]).astype(np.int64)).sum(1)
        for k in np.flatnonzero(big):
            whole = sum(int(p) * int(q) for p, q in zip(a.q[x[k]], b.q[y[k]], strict=True))
            out[lo + k] = max(-LONGEST - 1, min(LONGEST, whole))
    return out


def survivors(a: Vectors, b: Vectors, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product, slack) of the pairs whose score can lie in low[i] .. high[i]."""
    if not a.ends:
        i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
        ok = (low[i] <= 0) & (high[i] >= 0)
        return i[ok], j[ok], np.zeros(int(ok.sum())), np.ones(int(ok.sum()))
    slack = SLACK * a.norm * b.norm.max(initial=0.0) + 1e-6
    product, at = np.zeros((len(a), len(b))), 0
    i = j = part = None
    for k, end in enumerate(a.ends):
        if i is None:
            product += a.u[:, at:end] @ b.u[:, at:end].T
            rest = np.outer(a.rest[k], b.rest[k]) + slack[:, None]
            alive = (product + rest >= low[:, None]) & (product - rest <= high[:, None])
            if alive.sum() * 16 <= alive.size or end == a.ends[-1]:
                i, j = np.nonzero(alive)
                part = product[i, j]
        elif len(i):
            for lo in range(0, len(i), 1 << 16):
                x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                part[lo : lo + (1 << 16)] += np.einsum("ij,ij->i", a.u[x, at:end], b.u[y, at:end])
            rest = a.rest[k][i] * b.rest[k][j] + slack[i]
            ok = (part + rest >= low[i]) & (part - rest <= high[i])
            i, j, part = i[ok], j[ok], part[ok]
        at = end
    return i, j, part, slack[i]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` rows of each group with the highest scores, then smallest ids, in that order."""
    order = np.lexsort((ids, -score.astype(np.float64) if score.dtype.kind == "f" else np.bitwise_not(score), group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < most]


class Leaders:
    """The `most` best (score, id) of each group so far."""

    def __init__(self, groups: int, most: int):
        self.groups, self.most = groups, most
        self.group = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = _best(group, score, ids, self.most)
        self.group, self.score, self.ids = group[kept], score[kept], ids[kept]

    def last(self) -> np.ndarray:
        """The score that a new row must reach at least; minus infinity where there is room."""
        out = np.full(self.groups, -np.inf)
        full = np.bincount(self.group, minlength=self.groups) >= self.most
        at = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True)) if len(self.group) else []
        out[self.group[at]] = self.score[at]
        out[~full] = -np.inf
        return out


def _promising(group: np.ndarray, product: np.ndarray, slack: np.ndarray, sure: np.ndarray, most: int) -> np.ndarray:
    """Which rows can be among the `most` best of their group, given products known up to slack; sure: rows that count in any case."""
    best = _best(group[sure], product[sure], np.zeros(int(sure.sum()), np.int64), most)
    at = np.flatnonzero(sure)[best]
    g = group[at]
    cut = np.full(int(group.max(initial=0)) + 1, -np.inf)
    if len(g):
        last = np.flatnonzero(np.append(g[1:] != g[:-1], True))
        full = np.diff(np.append(-1, last)) >= most
        cut[g[last[full]]] = product[at[last[full]]]
    return product >= cut[group] - 2 * slack


def positives_of(a: Vectors, b: Vectors, most: int) -> Leaders:
    """For each anchor the best rows of another id; a and b have one label."""
    found = Leaders(len(a), most)
    step = max(1, PAIRS // max(1, len(a)))
    for lo in range(0, len(b), step):
        part = b.take(slice(lo, lo + step))
        i, j, product, slack = survivors(a, part, found.last(), np.full(len(a), np.inf))
        other = a.ids[i] != part.ids[j]
        i, j, product, slack = i[other], j[other], product[other], slack[other]
        ok = _promising(i, product, slack, np.ones(len(i), dtype=bool), most)
        i, j = i[ok], j[ok]
        found.add(i, scores(a, part, i, j), part.ids[j])
    return found


def negatives_of(a: Vectors, b: Vectors, low: np.ndarray, high: np.ndarray, most: int) -> Leaders:
    """For each anchor and range low[i, w] .. high[i, w] the best rows whose score lies in it, as group i * ranges + w; an empty range has low > high."""
    n, w = low.shape
    found = Leaders(n * w, most)
    step = max(1, PAIRS // max(1, n))
    real = low <= high
    top = np.where(real, high, -np.inf).max(1, initial=-np.inf)
    for lo in range(0, len(b), step):
        part = b.take(slice(lo, lo + step))
        need = np.where(real, np.maximum(low, found.last().reshape(n, w)), np.inf).min(1, initial=np.inf)
        i, j, product, slack = survivors(a, part, need, top)
        ok = np.zeros(len(i), dtype=bool)
        for c in range(w):
            near = np.flatnonzero(real[i, c] & (product + slack >= low[i, c]) & (product - slack <= high[i, c]))
            x, s = product[near], slack[near]
            inside = (x - s >= low[i[near], c]) & (x + s <= high[i[near], c])
            ok[near[_promising(i[near], x, s, inside, most)]] = True
        i, j = i[ok], j[ok]
        score = scores(a, part, i, j)
        for c in range(w):
            hit = real[i, c] & (score >= low[i, c]) & (score <= high[i, c])
            found.add(i[hit] * w + c, score[hit], part.ids[j[hit]])
    return found


def _vectors(rows: pa.Table, axes: dict[int, np.ndarray]) -> Vectors:
    v = rows.column("q").combine_chunks()
    q = v.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if len(v.flatten()) else np.zeros((rows.num_rows, 0))
    return Vectors(rows.column("id").to_numpy(), q, axes.get(q.shape[1]))


def _labelled(label: pa.ChunkedArray) -> list[tuple[object, int, int]]:
    """(label, first, past last) of the runs of a sorted column."""
    codes = label.combine_chunks().dictionary_encode()
    at = codes.indices.to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
    return [(codes.dictionary[int(at[x])].as_py(), int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _axes(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Principal axes for each length that the sample holds enough of; the sample is the rows of the least hashes, some SAMPLE of them."""
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, count))) < SAMPLE).select("q").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r["q"]), []).append(r["q"])
    out = {}
    for d, q in by.items():
        if d and len(q) >= d:
            x = np.array(q)
            x = x / np.maximum(np.abs(x).max(), 1.0)
            out[d] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    return out


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, path: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, q array<double> of whole numbers):
    for each row where `anchor` holds and each of its best rows of the same label, the best rows of other labels whose score is
    least .. most per cent of the positive's. ids are unique."""
    spark = rows.sparkSession
    path = path or common.scratch(spark)
    rows = common.stored(rows.select("id", "label", "q", anchor.alias("anchor")), path, "rows")
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    row_parts, anchor_parts = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))
    axes = spark.sparkContext.broadcast(_axes(rows, n))
    part = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")

    def tiles(anchors: DataFrame) -> DataFrame:
        """Each block of anchors (id, label, q, marks) with each block of rows, sorted by tile, side and label."""
        left = anchors.withColumn("a", part(anchor_parts, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1)))).withColumn("side", F.lit(0))
        right = rows.select("id", "label", "q").withColumn("marks", F.lit(None).cast("array<long>")).withColumn("b", part(row_parts, 2)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1)))).withColumn("side", F.lit(1))
        both = left.unionByName(right).withColumn("tile", F.xxhash64(F.size("q"), "a", "b"))
        return both.select("tile", F.size("q").alias("dim"), "side", "label", "id", "q", "marks").repartition("tile").sortWithinPartitions("tile", "dim", "side", "label")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
        for whole in common.whole_runs(batches):
            key = np.stack([whole.column(c).to_numpy() for c in ("tile", "dim")])
            cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                tile = whole.slice(x, y - x)
                k = int((tile.column("side").to_numpy() == 0).sum())
                if 0 < k < y - x:
                    yield tile.slice(0, k), tile.slice(k)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in sides(batches):
            a, b = _vectors(left, axes.value), _vectors(right, axes.value)
            there = {label: (x, y) for label, x, y in _labelled(right.column("label"))}
            for label, x, y in _labelled(left.column("label")):
                if label in there:
                    one = a.take(slice(x, y))
                    best = positives_of(one, b.take(slice(*there[label])), positives)
                    yield pa.RecordBatch.from_arrays([pa.array(one.ids[best.group]), pa.array(best.ids), pa.array(best.score)], names=["anchor_id", "positive_id", "positive_score"])

    anchors = rows.where("anchor").select("id", "label", "q")
    first = common.map_batches(tiles(anchors.withColumn("marks", F.lit(None).cast("array<long>"))), near, "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = common.stored(first.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives), path, "positives")
    marked = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("marks"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in sides(batches):
            a, b = _vectors(left, axes.value), _vectors(right, axes.value)
            labels = _labelled(right.column("label"))
            marks = left.column("marks").to_pylist()
            for label, x, y in _labelled(left.column("label")):
                one = a.take(slice(x, y))
                low = np.ones((len(one), positives), dtype=np.int64)
                high = np.zeros((len(one), positives), dtype=np.int64)
                for i, m in enumerate(marks[x:y]):
                    low[i, : len(m)] = [-(-least * p // 100) for p in m]
                    high[i, : len(m)] = [most * p // 100 for p in m]
                other = np.ones(len(b), dtype=bool)
                for name, p, q in labels:
                    if name == label:
                        other[p:q] = False
                best = negatives_of(one, b.take(other), low, high, negatives)
                i, c = np.divmod(best.group, positives)
                mark = np.array([marks[x + k][w] for k, w in zip(i, c, strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one.ids[i]), pa.array(mark), pa.array(best.ids), pa.array(best.score)], names=["anchor_id", "mark", "negative_id", "negative_score"])

    second = common.map_batches(tiles(anchors.join(marked, F.col("id") == F.col("anchor_id")).select("id", "label", "q", "marks")), far, "anchor_id long, mark long, negative_id long, negative_score long")
    by_score = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("negative_score"), "negative_id")
    best = second.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    out = best.join(chosen.withColumnRenamed("anchor_id", "of"), (F.col("anchor_id") == F.col("of")) & (F.col("mark") == F.col("positive_score")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, q): the rows that take part, one for each id, with components floor(scale * x)."""
    q = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * F.lit(scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), q.alias("q")).where("id is not null and label is not null and q is not null")
    sound = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    one = rows.where(F.coalesce(sound, F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "q")).alias("row"))
    # floor() gives longs; beyond their range a double is whole already
    floor = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)
    return one.select("id", "row.label", F.transform("row.q", floor).alias("q"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(common.read_table(spark, sf_dir, "embeddings"))
    shifted = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(shifted, F.col("id") % 50 == 0)


#: Every anchor with every row.
OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""
