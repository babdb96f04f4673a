"""Boosted trees grown leaf by leaf from histograms of gradients; the models of all folds are grown in the same jobs.

Features become numbers of bins once, and rows of one fold that are alike in bins are learnt from as one, with their numbers. A round
grows one tree for each fold's model: a job adds up gradients, curvatures and rows by bin in the root; the next ones do so for what would go
left in every leaf that may yet be split, so that several splits follow from one job; what goes right is what the leaf has besides. Only these
sums, as many as features times bins times leaves, come to the driver, which chooses the splits. Rows keep their scores, which are written every
`STORED` rounds, so a job looks at few trees and no lineage grows.

Missing values are lower than any other. Rows of null target or fold are not learnt from; every row gets a probability, those of
null fold or of a fold without a model a null one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables

# Rounds, step, leaves and penalty of the published model; least rows and curvature of a leaf, bins of a feature.
ROUNDS, STEP, LEAVES, PENALTY = 150, 0.05, 7, 0.5
LEAST_ROWS, LEAST_CURVATURE, BINS = 20, 1e-3, 255
STORED = 10
#: Rows of one fold and bins that a task takes, and tasks whose sums the driver adds up by itself.
TASK_ROWS, FEW_TASKS = 20_000, 16
#: Gains that differ by less, in proportion, are equal.
TIE = 1e-9


@dataclass
class Tree:
    """Nodes in order of their making: a node's feature is -1 while it is a leaf; rows of a bin up to `limit` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    limit: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, limit: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.limit[node], self.left[node] = feature, limit, a
        self.feature += [-1, -1]
        self.limit += [0, 0]
        self.left += [-1, -1]
        self.value += [0.0, 0.0]
        return a, a + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        feature, limit, left = np.array(self.feature), np.array(self.limit), np.array(self.left)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            at[inner] = left[n] + (bins[inner, feature[n]] > limit[n])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def _columns(batch: pa.RecordBatch, features: int, folds: int) -> tuple[np.ndarray, ...]:
    """fold, bins, scores, numbers of rows of target 0 and 1 that the row stands for."""
    whole = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    flat = lambda name, n: batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return whole("__fold"), flat("__bins", features), flat("__scores", folds), whole("__n0"), whole("__n1")


class Grower:
    def __init__(self, rows: DataFrame, edges: list[np.ndarray], folds: int, path: str, rounds: int, step: float, leaves: int, penalty: float, least_rows: int):
        self.rows, self.folds, self.path = rows, folds, path
        self.rounds, self.step, self.leaf_count, self.penalty, self.least_rows = rounds, step, leaves, penalty, least_rows
        self.width = max(len(e) for e in edges) + 1
        self.features = len(edges)
        self.trees: list[list[Tree]] = [[] for _ in range(folds)]
        self.written, self.few = 0, False

    def sums(self, growing: list[Tree | None], asked: list[list[tuple[int, int, int]]]) -> list[list[np.ndarray]]:
        """For each model and each (leaf, feature, limit) asked for: features x bins x (gradient, curvature, rows) of the leaf's rows up to the limit."""
        trees, written, k, f, width = self.trees, self.written, self.folds, self.features, self.width
        recent = [t[written:] for t in trees]
        most = max(map(len, asked))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, f, most * width, 3))
            for batch in batches:
                fold, bins, scores, n0, n1 = _columns(batch, f, k)
                for m in range(k):
                    if not asked[m]:
                        continue
                    mine = np.flatnonzero((fold != m) & (n0 + n1 > 0))
                    at, place = growing[m].leaves(bins[mine]), np.full(len(mine), -1)
                    for i, (leaf, j, limit) in enumerate(asked[m]):
                        place[(at == leaf) & (bins[mine, j] <= limit)] = i
                    mine, place = mine[place >= 0], place[place >= 0]
                    b = bins[mine]
                    p = 1 / (1 + np.exp(-(scores[mine, m] + sum((t.scores(b) for t in recent[m]), np.zeros(len(b))))))
                    n = (n0[mine] + n1[mine]).astype(np.float64)
                    weights = p * n - n1[mine], p * (1 - p) * n, n
                    for j in range(f):
                        slot = place * width + b[:, j]
                        for c, w in enumerate(weights):
                            total[m, j, :, c] += np.bincount(slot, weights=w, minlength=most * width)
            m, j, slot = np.nonzero(total[..., 2])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (m, j, slot)] + [pa.array(total[m, j, slot, c]) for c in range(3)], names=["m", "j", "slot", "g", "h", "n"])

        parts = self.rows.mapInArrow(add_up, "m int, j int, slot int, g double, h double, n double")
        if not self.few:
            parts = parts.groupBy("m", "j", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        got = parts.toArrow()
        total = np.zeros((k, f, most * width, 3))
        at = tuple(got.column(c).to_numpy() for c in ("m", "j", "slot"))
        for c, name in enumerate("ghn"):
            np.add.at(total, (*at, c), got.column(name).to_numpy())
        return [[total[m, :, i * width : (i + 1) * width] for i in range(len(asked[m]))] for m in range(k)]

    def best(self, held: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin that goes left) of the best split of a node; a gain of 0 if there is none."""
        before = held.cumsum(axis=1)
        whole = before[:1, -1:, :]
        after = whole - before
        strength = lambda x: x[..., 0] ** 2 / (x[..., 1] + self.penalty)
        gain = strength(before) + strength(after) - strength(whole)
        ok = (before[..., 2] >= self.least_rows) & (after[..., 2] >= self.least_rows) & (before[..., 1] >= LEAST_CURVATURE) & (after[..., 1] >= LEAST_CURVATURE)
        gain = np.where(ok, gain, 0.0)
        # of splits that are equal but for rounding the first one
        j, b = np.unravel_index(int((gain >= gain.max() * (1 - TIE)).argmax()), gain.shape)
        return float(gain[j, b]), int(j), int(b)

    def grow(self) -> None:
        """One tree for each model, split at the leaf of the greatest gain until it has all its leaves."""
        trees = [Tree() if s is not None else None for s in self.starts]
        asked = [[] if t is None else [(0, 0, self.width)] for t in trees]
        growing = [None if t is None else Growing(t, root[0], self) for t, root in zip(trees, self.sums(trees, asked), strict=True)]
        while True:
            asked = [[] if g is None else g.split() for g in growing]
            if not any(asked):
                break
            for g, told, found in zip(growing, asked, self.sums(trees, asked), strict=True):
                if g is not None:
                    g.lefts |= {leaf: s for (leaf, _, _), s in zip(told, found, strict=True)}
        for m, g in enumerate(growing):
            if g is not None:
                g.value()
                self.trees[m].append(trees[m])

    def store(self, number: int) -> None:
        """Write the rows with their scores so far."""
        trees, written, k, f = self.trees, self.written, self.folds, self.features
        recent = [t[written:] for t in trees]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, bins, scores, _, _ = _columns(batch, f, k)
                now = np.stack([scores[:, m] + sum((t.scores(bins) for t in recent[m]), np.zeros(len(bins))) for m in range(k)], axis=1)
                at = batch.schema.get_field_index("__scores")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(now) + 1, dtype=np.int32) * k), pa.array(now.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

        self.rows = tables.stored(self.rows.mapInArrow(scored, self.rows.schema), f"{self.path}/scores{number}")
        self.written = max(map(len, trees))

    def run(self) -> DataFrame:
        counts = {r["__fold"]: (r["n0"], r["n1"]) for r in self.rows.groupBy("__fold").agg(F.sum("__n0").alias("n0"), F.sum("__n1").alias("n1")).collect()}
        self.few = self.rows.rdd.getNumPartitions() <= FEW_TASKS
        self.starts: list[float | None] = []
        for m in range(self.folds):
            no, yes = (sum(n[c] for f, n in counts.items() if f != m) for c in (0, 1))
            self.starts.append(float(np.log(yes / no)) if yes and no else None)
        start = F.array(*[F.lit(s or 0.0) for s in self.starts])
        self.rows = self.rows.withColumn("__scores", start)
        for r in range(self.rounds):
            self.grow()
            if (r + 1) % STORED == 0 and r + 1 < self.rounds:
                self.store(r + 1)
        self.store(self.rounds)
        known = F.array(*[F.lit(s is not None) for s in self.starts])
        own = F.when(F.get(known, F.col("__fold")), 1 / (1 + F.exp(-F.get("__scores", F.col("__fold")))))
        return self.rows.select("__fold", "__bins", own.alias("oof_probability"))


class Growing:
    """A tree that is being grown: sums of its leaves, and of what would go left in them by their best splits, where a job has told these."""

    def __init__(self, tree: Tree, root: np.ndarray, grower: Grower):
        self.tree, self.grower, self.left_over = tree, grower, grower.leaf_count - 1
        self.held, self.lefts, self.choices, self.ends = {0: root}, {}, {}, {}

    def split(self) -> list[tuple[int, int, int]]:
        """Split while the sums that decide are known; the (leaf, feature, limit) to be told, none if the tree is whole."""
        while self.left_over:
            for node in self.held.keys() - self.choices.keys():
                self.choices[node] = self.grower.best(self.held[node])
            most = max((self.choices[n][0] for n in self.held), default=0.0)
            node = next((n for n in sorted(self.held) if self.choices[n][0] >= most * (1 - TIE)), None)
            if node is None or self.choices[node][0] <= 1e-12:
                return []
            _, j, b = self.choices[node]
            if node not in self.lefts and self.left_over > 1:
                open_ = sorted((n for n in self.held if n not in self.lefts and self.choices[n][0] > 1e-12), key=lambda n: (n != node, -self.choices[n][0]))
                return [(n, *self.choices[n][1:]) for n in open_[: self.left_over]]
            # the last split asks for no sums by bin, so those of the leaf's rows up to the limit do
            own, left = self.held.pop(node), self.lefts.pop(node, None)
            a, z = self.tree.split(node, j, b)
            if left is None:
                low = own[j, : b + 1].sum(axis=0)
                self.ends |= {a: low, z: own[0].sum(axis=0) - low}
            else:
                self.held |= {a: left, z: own - left}
            self.left_over -= 1
        return []

    def value(self) -> None:
        """Give the leaves their values."""
        for node, (g, h, _) in [*((n, s[0].sum(axis=0)) for n, s in self.held.items()), *self.ends.items()]:
            self.tree.value[node] = -self.grower.step * g / (h + self.grower.penalty)


def edges_of(df: DataFrame, features: list[str], bins: int = BINS, copies: str | None = None) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: its values where they are few, else quantiles of the rows that the rows stand for."""
    if copies:
        df = df.select(*features, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias("__i")).drop("__i")
    asked = [F.percentile_approx(F.col(c).cast("double"), [(i + 1) / bins for i in range(bins - 1)], 10_000).alias(f"f{i}") for i, c in enumerate(features)]
    row = df.agg(*asked).first()
    return [np.unique(np.array(x if x is not None else [], dtype=np.float64)) for x in row]


def out_of_fold(df: DataFrame, features: list[str], target: str, k: int = 5, fold: str = "fold", rounds: int = ROUNDS, step: float = STEP, leaves: int = LEAVES, penalty: float = PENALTY, least_rows: int = LEAST_ROWS, copies: str | None = None) -> DataFrame:
    """df with oof_probability: what the model that has not seen the row's fold says. copies: a column with the number of rows that a row stands for."""
    path = tables.scratch(df.sparkSession)
    edges = edges_of(df.where(F.col(target).isNotNull()), features, copies=copies)
    number = lambda c, e: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), lambda x: x < F.col(c).cast("double"))) + 1)
    binned = F.array(*[number(c, e) if len(e) else F.lit(0) for c, e in zip(features, edges, strict=True)]).cast("array<int>")
    rows = df.withColumn("__fold", F.col(fold).cast("int")).withColumn("__y", F.col(target).cast("int")).withColumn("__bins", binned).withColumn("__copies", (F.lit(1) if copies is None else F.col(copies)).cast("long"))
    rows = tables.stored(rows, f"{path}/rows")
    of = lambda y: F.coalesce(F.sum(F.when(F.col("__y") == y, F.col("__copies"))), F.lit(0)).alias(f"__n{y}")
    alike = tables.spread(rows.where("__fold is not null").groupBy("__fold", "__bins").agg(of(0), of(1)), TASK_ROWS)
    grower = Grower(alike, [np.append(e, np.inf) for e in edges], k, path, rounds, step, leaves, penalty, least_rows)
    return rows.join(grower.run(), ["__fold", "__bins"], "left").select(*df.columns, "oof_probability")
