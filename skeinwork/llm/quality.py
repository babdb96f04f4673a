"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is described by how often its byte classes follow each other and by how often its words repeat. A bounded
sample of labelled texts gives weights of these terms and a truncated decomposition; the sample's vectors, a fixed
number of numbers, are broadcast. Every document is projected, its cosines with all of them are computed exactly in
blocks, and its nearest neighbours' labels are averaged with their similarities (and the classes' true shares) as weights.

Null and empty texts have no direction: their score is the share of label 1. Without labels of both kinds every score
is that share, 1 without labels at all. Repeated rows score alike; an empty table gives an empty result; other columns
pass through untouched. Labels that are null are not used; of contradicting labels of one id the smaller holds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most labelled texts of each label that the space is learnt from.
SAMPLE_PER_LABEL = 2000
DIMENSIONS = 48
NEIGHBOURS = 25
#: Similarities count with this power.
SHARPNESS = 8
#: Texts described at a time, each by a row of N_TERMS numbers.
BLOCK_ROWS = 256

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_classes() -> tuple[np.ndarray, int]:
    """Letters of both cases apart from each other but digits, white space and far bytes in one class each."""
    out = np.zeros(256, dtype=np.int32)
    k = 1  # 0: control characters
    for group in [bytes([c]) for c in range(97, 123)] + [bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b"\t\r\x0b\x0c"] + [bytes([c]) for c in _PUNCTUATION] + [bytes(range(128, 192)), bytes(range(192, 256))]:
        out[list(group)] = k
        k += 1
    return out, k


CLASSES, N_CLASSES = _byte_classes()
N_WORD_TERMS = 6
N_TERMS = N_CLASSES * N_CLASSES + N_WORD_TERMS
#: Weight of the terms on words against those on bytes.
WORD_WEIGHT = 1.0


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_TERMS for each text: square roots of shares, so that lengths do not matter."""
    rows = len(off) - 1
    out = np.zeros((rows, N_TERMS), dtype=np.float32)
    if not len(data):
        return out
    cls = CLASSES[data]
    doc = np.repeat(np.arange(rows), np.diff(off))
    pair = (doc[1:] == doc[:-1]).nonzero()[0]
    key = doc[pair] * (N_CLASSES * N_CLASSES) + cls[pair] * N_CLASSES + cls[pair + 1]
    counts = np.bincount(key, minlength=rows * N_CLASSES * N_CLASSES).reshape(rows, -1)
    out[:, :-N_WORD_TERMS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    words = common.Words(data, off)
    h = words.hashes()
    n = np.maximum(words.counts, 1)
    per = lambda at: np.bincount(words.doc[at], minlength=rows) / n
    for j, back in enumerate((1, 2, 3)):
        at = np.flatnonzero((h[back:] == h[:-back]) & (words.doc[back:] == words.doc[:-back])) + back
        out[:, N_CLASSES * N_CLASSES + j] = np.sqrt(per(at))
    order = np.lexsort((h, words.doc))
    again = order[1:][(h[order][1:] == h[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])]
    out[:, -3] = per(again)
    upper = np.flatnonzero((words.ends - words.starts > 1) & (np.minimum(words.ends - 1, words.starts + 1) >= 0))
    second = data[words.starts[upper] + 1]
    out[:, -2] = np.sqrt(per(upper[(second >= 65) & (second <= 90)]))
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    odd = (last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 65) & (last <= 90)) & ~((last >= 48) & (last <= 57)) & (last != 46) & (last != 44)
    out[:, -1] = np.sqrt(per(np.flatnonzero(odd)))
    out[:, -N_WORD_TERMS:] *= WORD_WEIGHT
    return out


@dataclass
class Model:
    weights: np.ndarray  # of the terms
    basis: np.ndarray  # N_TERMS x dimensions
    vectors: np.ndarray  # of the sample, length 1
    labels: np.ndarray
    votes: np.ndarray  # weight of each sampled text's vote
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        cosine = self.project(x) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        sim = np.take_along_axis(cosine, near, axis=1).astype(np.float64)
        weight = np.maximum(sim, 0) ** SHARPNESS * self.votes[near]
        total = weight.sum(1)
        voted = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-300)
        return np.clip(np.where((total > 0) & (x.any(axis=1)), voted, self.prior), 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, prior: float, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Weights from each term's spread over the sample, basis by a randomised decomposition."""
    if not len(x) or len(np.unique(y)) < 2:
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    seen = (x > 0).sum(0)
    weights = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
    weights[-N_WORD_TERMS:] = 1
    a = x * weights
    rng = np.random.default_rng(seed)
    d = min(dimensions, *a.shape)
    y0 = a @ rng.standard_normal((a.shape[1], d + 10)).astype(np.float32)
    for _ in range(4):
        y0, _ = np.linalg.qr(y0)
        y0 = a @ (a.T @ y0)
    q, _ = np.linalg.qr(y0)
    _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    basis = vt[:d].T.astype(np.float32)
    share = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
    model = Model(weights, basis, np.zeros((0, d), np.float32), y.astype(np.float64), share, prior)
    vectors = a @ basis
    model.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return model


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Model from labelled rows that are not held out: of each label the `sample_per_label` ids of least digest.

    Of an id with several texts the least one counts. The sample has a fixed bound, so one task fits the model; the driver
    gets the chosen ids and the model."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"))
    share = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    prior = share.get(1, 0) / sum(share.values()) if share else 1.0
    order = F.md5(F.col("__id").cast("string"))
    chosen = [(r["__id"], int(r["__y"])) for v in (0, 1) for r in known.where(F.col("__y") == v).orderBy(order, "__id").limit(sample_per_label).collect()]
    if not chosen:
        return fit(np.zeros((0, N_TERMS), np.float32), np.zeros(0), prior)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__y", T.IntegerType())])))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, "__text", block_rows=BLOCK_ROWS):
                x = features(data, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in (0, 1)] + [pa.array([r.tobytes() for r in x], pa.binary())], names=["digest", "y", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, y, x.as_py()) for batch in batches for d, y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
        x = np.empty((len(rows), N_TERMS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i] = np.frombuffer(r[2], dtype=np.float16)
        y = np.array([r[1] for r in rows])
        del rows
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(x, y, prior))], pa.binary())})

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(wanted, "__id").groupBy("__id", "__y").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    sample = common.map_batches(picked.select(order.alias("digest"), F.col("__y").alias("y"), "__text"), described, "digest string, y int, x binary")
    return pickle.loads(common.map_batches(sample.repartition(1), fitted, "model binary").first()[0])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns `keep` (all by default) of docs, then the score as column `name`; a column of that name in docs is replaced."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    shared = spark.sparkContext.broadcast(model)
    inner = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, "__text", block_rows=BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(m.score(features(data, off)), pa.float64())], names=inner.names)

    out = common.map_batches(docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].alias("__text")), run, inner)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = learn(docs, common.read_table(spark, sf_dir, "labels"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
