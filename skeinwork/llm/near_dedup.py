"""Near-duplicate documents by MinHash bands, verified by odd sketches and confirmed on whole shingle sets.

Each document's set of word shingles gives MinHash samples. They make bands, by which candidates meet, and they are
folded into an odd sketch, a bitmap in which every (position, sample) flips one bit: the share of set bits in the XOR
of two sketches estimates how many samples differ, most precisely at high similarity. Candidates that pass that
estimate are confirmed on their whole sets.

Documents of equal sets are one class from the start and stand for each other. In a first round each class asks for one
link, to the partner of least id with which it shares most bands. Then the buckets that still hold several components are
cut into tiles of bounded rows and shingles. A tile looks at the pairs that meet in its bucket first, leaves out those in one
component and those that sizes, recurring shingles or sketches rule out, compares whole sets of the others, and gives no
more than the edges that join its components. So no list of pairs is ever made, and no link that would join two
components is left out, whatever the size of a bucket.

Null texts and texts without words have an empty set and link with nothing. Rows of one id count as one node, whatever
their texts. Null ids are left out of linking and kept. An empty table gives an empty result. Other columns pass through
`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    """shingle: words in a shingle; a link needs `den * intersection >= num * union`."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 24
    rows: int = 6
    words: int = 16  # 64-bit words of an odd sketch
    seed: int = 11
    tile: int = 1024  # rows of a tile's side
    tile_shingles: int = 1 << 19  # shingles of a tile's side, unless one row has more
    slack: float = 4.5  # standard deviations by which an estimate may fall short

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def estimate(self) -> float:
        j = self.num / self.den
        return j - self.slack * (j * (1 - j) / self.samples) ** 0.5

    @property
    def most_bits(self) -> int:
        """Set bits that the XOR of two sketches of that estimate is expected to show, and four deviations more."""
        n = self.words * 64
        differ = 2 * self.samples * (1 - self.estimate)
        bits = n / 2 * (1 - (1 - 2 / n) ** differ)
        return int(bits + 4 * (differ * differ / n) ** 0.5 + 2)


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of all shingles, repeats included; a text of fewer words is one shingle."""
    w = common.Words(data, off)
    h = w.hashes()
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = [common.U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    last = w.first[1:][w.doc]  # index past each word's document
    take = np.flatnonzero(np.arange(n) + width <= last)
    acc = np.zeros(len(take), dtype=np.uint64)
    for k in range(width):
        acc += h[take + k] * mult[k]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(width - 1):
        more = w.counts[short] > k
        extra[more] += h[w.first[short[more]] + k] * mult[k]
    for i, r in enumerate(short.tolist()):
        extra[i] ^= common.U64(0x5851F42D4C957F2D * int(w.counts[r]) & (1 << 64) - 1)
    rows = np.concatenate([w.doc[take], short])
    hashes = common.mix64(np.concatenate([acc, extra]))
    return hashes, rows


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingle hashes in ascending order, from first[row] to first[row + 1]."""
    hashes, rows = shingle_hashes(data, off, width)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(off)))


def _sketch_block(hashes: np.ndarray, first: np.ndarray, s: Settings):
    """For rows with shingles: (row, bands as uint64, odd sketches as uint64, two sums of the whole set)."""
    full = np.flatnonzero(np.diff(first) > 0)
    starts = first[full]
    rng = np.random.default_rng(s.seed)
    a = rng.integers(1, 1 << 63, s.samples, dtype=np.uint64) * common.U64(2) + common.U64(1)
    b = rng.integers(0, 1 << 63, s.samples, dtype=np.uint64)
    bands = np.zeros((len(full), s.bands), dtype=np.uint64)
    odd = np.zeros((len(full), s.words * 64), dtype=np.uint8)
    rows = np.arange(len(full))
    for i in range(s.samples if len(full) else 0):
        mixed = hashes * a[i]
        mixed += b[i]
        mixed ^= mixed >> common.U64(32)
        low = common.mix64(np.minimum.reduceat(mixed, starts) + common.U64(i))
        bands[:, i // s.rows] = bands[:, i // s.rows] * common.U64(0x9E3779B97F4A7C15) + low
        odd[rows, (low >> common.U64(40)) % common.U64(s.words * 64)] ^= 1
    bands = common.mix64(bands + np.arange(s.bands, dtype=np.uint64))
    packed = np.packbits(odd, axis=1, bitorder="little").view(np.uint64) if len(full) else np.zeros((0, s.words), np.uint64)
    sums = [np.add.reduceat(common.mix64(hashes + common.U64(k)), starts) if len(full) else np.zeros(0, np.uint64) for k in (1, 2)]
    return full, bands, packed, sums


def _list(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(values.astype(np.uint64).view(np.int64).ravel(), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), flat)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, odd) of a frame (doc_id, text); bands and odd are null for empty sets."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, "text"):
                hashes, first = shingle_sets(data, off, s.shingle)
                full, bands, odd, sums = _sketch_block(hashes, first, s)
                at = np.full(hi - lo, -1, dtype=np.int64)
                at[full] = np.arange(len(full))
                pick = pa.array(at, pa.int64(), mask=at < 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64())] + [pa.array(x.view(np.int64), pa.int64()).take(pick) for x in sums] + [_list(bands, s.bands).take(pick), _list(odd, s.words).take(pick)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"],
                )

    return common.map_batches(docs, run, schema)


def _set_digest(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(hashes + common.U64(1)), dtype=np.uint64)])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def _whole_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(rep, members, digest): the sorted shingle hashes of each row of (rep, text) as bytes, and set_a of the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in common.text_blocks(batch, "text"):
                hashes, first = shingle_sets(data, off, s.shingle)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()), pa.array(_set_digest(hashes, first), pa.int64())], names=["rep", "members", "digest"])

    return common.map_batches(docs, run, "rep long, members binary, digest long")


def _recurring(members: DataFrame, s: Settings, n_buckets: int) -> DataFrame:
    """(rep, common): how many of each row's shingles some other row has too.

    Two sets share no more than the smaller of these numbers, which bounds their similarity from above exactly."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            for lo in range(0, len(sets), 256):
                part = sets[lo : lo + 256]
                h = np.concatenate(part)
                owner = np.repeat(reps[lo : lo + 256], [len(x) for x in part])
                b = (h >> np.uint64(16)) % np.uint64(n_buckets)
                order = np.argsort(b, kind="stable")
                h, owner, b = h[order], owner[order], b[order]
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else [0]
                for i, j in zip(cut[:-1], cut[1:]):
                    yield pa.RecordBatch.from_arrays([pa.array([int(b[i])], pa.int32()), pa.array([h[i:j].tobytes()], pa.binary()), pa.array([owner[i:j].tobytes()], pa.binary())], names=["bucket", "h", "owner"])

    def count(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h").combine_chunks()])
        owner = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("owner").combine_chunks()])
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, dtype=bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        reps, times = np.unique(owner[order][same[1:] | same[:-1]], return_counts=True)
        return pa.table({"rep": pa.array(reps, pa.int64()), "common": pa.array(times, pa.int64())})

    dealt = common.map_batches(members.select("rep", "members"), deal, "bucket int, h binary, owner binary")
    return dealt.groupBy("bucket").applyInArrow(count, "rep long, common long").groupBy("rep").agg(F.sum("common").alias("common"))


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) with whether their whole sets are similar enough."""
    sized = pairs.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                out.append(s.den * both >= s.num * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return common.map_batches(sized, run, "a long, b long, linked boolean")


#: Columns of a tile's rows; `members` only where whole sets are compared.
TILE_COLUMNS = ["tile", "side", "band", "node", "comp", "n", "common", "bands", "odd"]


def _candidates(rows: pa.Table, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one tile that may be linked, in blocks: of different components, meeting in this band first,
    with sizes, numbers of recurring shingles and sketches that allow a link.

    A tile with one side is a bucket's part against itself, one with both a part against another."""
    side, comp, n, common_ = (rows.column(c).to_numpy() for c in ("side", "comp", "n", "common"))
    band = rows.column("band")[0].as_py()
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(side), s.bands)
    odd = rows.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(side), s.words)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(right)
    right = left if one else right
    for p in range(0, len(left), step := max(1, (1 << 19) // max(1, len(right)))):
        i = left[p : p + step]
        most = np.minimum(common_[i][:, None], common_[right][None, :])
        ok = (comp[i][:, None] != comp[right][None, :]) & (s.den * most >= s.num * (n[i][:, None] + n[right][None, :] - most))
        if one:
            ok &= i[:, None] < right[None, :]
        a, b = np.nonzero(ok)
        a, b = i[a], right[b]
        for q in range(0, len(a), 1 << 16):
            x, y = a[q : q + (1 << 16)], b[q : q + (1 << 16)]
            near = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int32) <= s.most_bits
            x, y = x[near], y[near]
            first = (bands[x] == bands[y]).argmax(1) == band
            if first.any():
                yield x[first], y[first]


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles, one after another, of rows sorted by tile."""
    for rows in common.whole_runs(batches):
        tile = rows.column("tile").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield rows.slice(a, b - a)


def _hopeful(tiles: DataFrame, s: Settings) -> DataFrame:
    """(tile, side, band, node) of the rows that have a candidate in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles_of(batches):
            hit = np.zeros(rows.num_rows, dtype=bool)
            for i, j in _candidates(rows, s):
                hit[i] = hit[j] = True
            if hit.any():
                yield from rows.select(["tile", "side", "band", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    ordered = tiles.select(*TILE_COLUMNS).repartition("tile").sortWithinPartitions("tile")
    return common.map_batches(ordered, run, "tile long, side int, band int, node long")


def _shared(sets: list[np.ndarray], width: int = 1 << 16) -> Iterator[np.ndarray]:
    """Bitmaps of the shingles that several sets hold, rows x uint64, `width` shingles at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    name = np.cumsum(new) - 1
    several = np.bincount(name) > 1
    name, owner = (np.cumsum(several) - 1)[name], owner[several[name]]
    name = name[several[np.cumsum(new) - 1]]
    for lo in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        a, b = np.searchsorted(name, [lo, lo + width])
        bits = np.zeros((len(sets), min(width, int(name[-1]) + 1 - lo) + 63 >> 6), dtype=np.uint64)
        at = name[a:b] - lo
        np.bitwise_or.at(bits, (owner[a:b], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        yield bits


def _joined(tiles: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges between components that links confirmed on whole sets join, no more of them than a tile has components."""

    def edges(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        pairs = list(_candidates(rows, s))
        i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        n, comp = rows.column("n").to_numpy(), rows.column("comp").to_numpy()
        both = np.zeros(len(i), dtype=np.int64)
        if len(i):
            for bits in _shared([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("members").combine_chunks()]):
                step = max(1, (1 << 21) // bits.shape[1])
                for p in range(0, len(i), step):
                    both[p : p + step] += np.bitwise_count(bits[i[p : p + step]] & bits[j[p : p + step]]).sum(1, dtype=np.int64)
        ok = s.den * both >= s.num * (n[i] + n[j] - both)
        a, b = comp[i[ok]], comp[j[ok]]
        # only edges that span what they join
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        low = np.arange(len(names))
        while len(x):
            least = np.minimum(low[x], low[y])
            if (low[x] == least).all() and (low[y] == least).all():
                break
            np.minimum.at(low, x, least)
            np.minimum.at(low, y, least)
        return names, names[low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles_of(batches):
            a, b = edges(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])

    ordered = tiles.select(*TILE_COLUMNS, "members").repartition("tile").sortWithinPartitions("tile")
    return common.map_batches(ordered, run, "a long, b long")


def near_groups(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    s, spark = settings, docs.sparkSession
    path = path or common.scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = common.stored(sketches(rows, s), path, "sketches")
    linkable = sk.where("n_shingles > 0 and doc_id is not null")
    # ids with several sets: their classes have nodes of their own, tied to the id
    several = common.stored(linkable.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo <> hi").select("doc_id"), path, "several")
    # classes of equal sets; the smallest id stands for each
    heads = linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "odd")])
    own = F.xxhash64("set_a", "set_b").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    heads = heads.join(several.withColumn("many", F.lit(True)), "doc_id", "left").withColumn("node", F.when(F.col("many"), own).otherwise(F.col("doc_id"))).drop("many")
    heads = common.stored(heads.withColumnRenamed("n_shingles", "n"), path, "heads")
    postings = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = postings.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    met = common.stored(postings.join(shared.drop("size"), "bucket"), path, "met", drop_shuffle=True)
    info = common.stored(heads.join(met.select("node").distinct(), "node", "left_semi"), path, "info")
    # first round: each class asks for the partner of least id with which it shares most bands
    bits = F.expr("aggregate(zip_with(p, q, (u, v) -> bit_count(u ^ v)), 0, (t, u) -> t + u)")
    star = met.where("least < node").groupBy("node", "least").agg(F.count("*").alias("times")).groupBy("node").agg(F.max_by("least", F.struct("times", -F.col("least"))).alias("b")).select(F.col("node").alias("a"), "b")
    fits = (
        star.join(info.select(F.col("node").alias("a"), F.col("odd").alias("p"), F.col("n").alias("m")), "a").join(info.select(F.col("node").alias("b"), F.col("odd").alias("q"), "n"), "b")
        .where(bits <= s.most_bits).where(f"{s.den} * least(m, n) >= {s.num} * greatest(m, n)").select("a", "b")
    )
    # rows of one id can have several sets; the one whose digest heads the class is meant
    texts = rows.join(info.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _whole_sets(texts, s).join(info.select("node", F.col("doc_id").alias("rep"), F.col("set_a").alias("digest")), ["rep", "digest"])
    sets = common.stored(sets.groupBy("node").agg(F.first("members").alias("members")), path, "sets", drop_shuffle=True)
    links = common.stored(_confirmed(fits, sets.withColumnRenamed("node", "rep"), s).where("linked").select("a", "b"), path, "links1", drop_shuffle=True)
    ties = linkable.join(several, "doc_id", "left_semi").join(heads.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    comp = common.components(links.union(ties), path, "first")

    def unsettled(extra):
        """Rows (bucket, band, node, parts) of the buckets that hold several components, and extra with its components."""
        at = extra.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        slim = met.select("bucket", "band", "node").join(at.select("node", "comp", "n"), "node")
        parts = F.ceil(F.greatest(F.count("*") / s.tile, F.sum("n") / s.tile_shingles)).cast("int")
        mixed = slim.groupBy("bucket").agg(parts.alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "parts")
        return at, slim.select("bucket", "band", "node").join(mixed, "bucket")

    # only classes in such buckets can still link, so only their shingles count as recurring
    _, open_rows = unsettled(info)
    open_sets = common.stored(sets.join(open_rows.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "rep"), path, "open_sets")
    n_buckets = max(4, -(-int(open_sets.agg(F.sum(F.length("members"))).first()[0] or 0) // (8 << 20)))
    recurring = _recurring(open_sets, s, n_buckets).withColumnRenamed("rep", "node")
    open_info = common.stored(info.join(recurring, "node").where(f"{s.den} * common >= {s.num} * n").select("node", "n", "common", "bands", "odd"), path, "open")
    at, placed = unsettled(open_info)
    # a bucket of several parts is compared part by part: each row goes to one tile for every part
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = placed.select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "band", "node",
    )
    hopeful = common.stored(_hopeful(tiles.join(at, "node"), s), path, "hopeful", drop_shuffle=True)
    if hopeful.take(1):
        whole = hopeful.join(at, "node").join(sets, "node")
        again = common.components(common.stored(_joined(whole, s), path, "links2", drop_shuffle=True), path, "second")
    else:
        again = comp.limit(0)
    first = heads.select("set_a", "set_b", "node").join(comp, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("node"))
    root = common.stored(first.join(again, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root")), path, "roots")
    out = sk.select("doc_id", "n_shingles", "set_a", "set_b").join(root, ["set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of least id; all columns stay.

    Rows of one id are one document: they stay or go together."""
    gone = near_groups(docs, settings, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


#: The settings of query op4: sets of three words, 85 in 100.
CONTRACT = Settings(shingle=3, num=85, den=100)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.read_table(spark, sf_dir, "documents"), CONTRACT)
