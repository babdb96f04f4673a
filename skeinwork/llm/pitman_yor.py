"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is a restaurant for the words that follow it, and all of these share one parent. Seating in the restaurants
is sampled by Gibbs: a customer sits at a table of their dish with weight (customers - discount) or at a new one with
weight (strength + discount * tables) times the parent's probability of the dish; all customers of a dish are reseated
together, by drawing its number of tables. Each table sends one customer to the parent, whose base is continuous, so that each word has one table there and
the parent's new-table mass is the probability of all unknown words together. Predictive probabilities are averaged
over the samples after burn-in.

Texts are lower-cased (A-Z) and cut into words `[^\\x20\\x09-\\x0D]+`, then one end. Null text counts as empty: one token,
the end. A null id is never held out. Repeated rows count and score separately. With no training rows every word is
unknown and the parent is all new-table mass. An empty table gives an empty result. Other columns are ignored.

While contexts are seated, the parent has one table for each dish of theirs, so that a word's probability goes by the
number of contexts that serve it, counted over all training texts; the final parent is made of all sampled tables.

Execution: texts are cut into chunks of `chunks.CHUNK_BYTES` in order of the input's partitions. Chunks send their distinct
words and word pairs, with counts, to buckets of words and of contexts. A bucket of contexts tells the buckets of words
how many contexts serve each word and gets the corpus-wide sums before it seats (pairs are sent twice for that, which is
cheaper on disk than keeping them); the contexts of a word with more than `HOT_SHARE` of all tokens are spread over many
buckets. Buckets answer each chunk in the chunk's own order, with narrow numbers, and chunks are scored with their
answers. Everything that grows with the corpus is shuffled or written, nothing of it goes to the driver but sums and
the at most 1 / HOT_SHARE hot words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common

BUCKET_BYTES = 4 << 20
HOT_SHARE = 0.002
#: Strength and discount of the contexts' restaurants and of the parent.
STRENGTH, DISCOUNT = 1.0, 0.8
PARENT_STRENGTH, PARENT_DISCOUNT = 1.0, 0.6
BURN_IN, SAMPLES = 3, 3
#: Customers up to which all numbers of tables of a dish are weighed; with more, GRID of them at a time.
ROW, GRID = 1000, 64
END, START = np.uint64(1), np.uint64(2)
UNSTEADY = "the input's partitions changed between reads; write it to files first"


class Tokens:
    """Token hashes of a block, ends included, with rows and contexts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = common.Words(data, off)
        n = len(off) - 1
        self.counts = w.counts + 1
        last = np.cumsum(self.counts) - 1
        self.hash = np.full(int(self.counts.sum()), END, dtype=np.uint64)
        inner = np.ones(len(self.hash), dtype=bool)
        inner[last] = False
        self.hash[inner] = w.hashes() | np.uint64(4)  # apart from END and START
        self.context = np.empty_like(self.hash)
        self.context[1:] = self.hash[:-1]
        self.context[last[:-1] + 1] = START
        if n:
            self.context[0] = START
        self.row = np.repeat(np.arange(n), self.counts)


def _tokens(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context, row, train) of all tokens of a chunk."""
    hashes, contexts, at, train, base = [], [], [], [], 0
    for batch in rows:
        flags = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, off in common.text_blocks(batch, "text"):
            t = Tokens(data, off)
            hashes.append(t.hash)
            contexts.append(t.context)
            at.append(t.row + (base + lo))
            train.append(flags[lo:hi][t.row])
        base += batch.num_rows
    return np.concatenate(hashes), np.concatenate(contexts), np.concatenate(at), np.concatenate(train)


def _words(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, index of each token's word, training counts)."""
    words, inv = np.unique(hashes, return_inverse=True)
    return words, inv, np.bincount(inv[train], minlength=len(words)).astype(np.int64)


def _bucket(words: np.ndarray, n: int) -> np.ndarray:
    return (common.mix64(words) >> np.uint64(20)) % np.uint64(n)


class Pairs:
    """A chunk's distinct (context, word) pairs, ordered by bucket, context and word."""

    def __init__(self, words: np.ndarray, inv: np.ndarray, contexts: np.ndarray, train: np.ndarray, n_buckets: int, hot: np.ndarray, parts: np.ndarray):
        names, cinv = np.unique(contexts, return_inverse=True)
        key = cinv.astype(np.uint64) << np.uint64(32) | inv.astype(np.uint64)
        uniq, self.of_token = np.unique(key, return_inverse=True)
        context, word = (uniq >> np.uint64(32)).astype(np.int64), (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bucket = _bucket(names, n_buckets)[context]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            split = np.where(hot[at] == names, parts[at], 1)[context]
            some = np.flatnonzero(split > 1)
            bucket[some] = (bucket[some] + _bucket(words[word[some]] ^ np.uint64(0x5DEECE66D), 1 << 30) % split[some].astype(np.uint64)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.context, self.word, self.bucket = names[context[order]], word[order], bucket[order]
        self.count = np.bincount(self.of_token[train], minlength=len(uniq))[order]
        self.of_token = self.rank[self.of_token]
        self.cut = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(order) else np.zeros(1, np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Of arguments above 100."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_rows: list[np.ndarray] = [np.zeros(0), np.zeros(1)]


def _log_ways(c: int) -> np.ndarray:
    """Of 1 .. c tables: log of the weight of all seatings of c customers, where a table of s has rising((1 - discount), s - 1).

    By w(c + 1, t) = w(c, t - 1) + (c - discount * t) * w(c, t); rows are kept for later calls of the same worker."""
    while len(_rows) <= c:
        n, last = len(_rows) - 1, _rows[-1]
        stay = np.log(n - DISCOUNT * np.arange(1, n + 1)) + last
        _rows.append(np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, last)))
    return _rows[c]


#: Terms of the alternating series, used up to SERIES * c ** discount tables, where it loses no more than three digits.
TERMS, SERIES = 120, 2.0
_J = np.arange(1, TERMS + 1)
_SIGN = -np.sin(np.pi * DISCOUNT * _J) / np.pi * np.where(_J % 2, -1, 1)
_LOG_J = np.array([math.lgamma(DISCOUNT * j + 1) - math.lgamma(j + 1) for j in _J])


def _log_ways_at(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """_log_ways of many customers at some numbers of tables, without a row of them all."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    out = np.empty(len(c))
    t_factorial = np.where(t > 100, _lgamma(np.maximum(t, 100) + 1), np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 101)))])[np.minimum(t, 100).astype(np.int64)])
    few = t <= SERIES * c**DISCOUNT
    for part in np.array_split(np.flatnonzero(few), max(1, int(few.sum()) // 4096)):
        left = np.maximum(t[part, None] - _J + 1, 0)
        falling = np.cumsum(np.where(left > 0, np.log(np.maximum(left, 1)), -np.inf), axis=1)
        log = falling + _LOG_J + _lgamma(c[part, None] - DISCOUNT * _J) - _lgamma(c[part, None])
        top = log.max(axis=1)
        out[part] = top + np.log(np.maximum((_SIGN * np.exp(log - top[:, None])).sum(axis=1), 1e-300)) + _lgamma(c[part]) - t[part] * np.log(DISCOUNT) - t_factorial[part]
    rest = np.flatnonzero(~few)
    if len(rest):
        # coefficient of x ** c in u ** t, u = 1 - (1 - x) ** discount, by its saddle point; y = -log(1 - x)
        n, k = c[rest], t[rest]
        k = np.minimum(k, n - 1e-3)
        lo, hi = np.full(len(rest), -25.0), np.full(len(rest), 5.0)
        mean = lambda y: np.expm1(y) * DISCOUNT * np.exp(-DISCOUNT * y) / -np.expm1(-DISCOUNT * y)
        for _ in range(60):
            mid = (lo + hi) / 2
            low = k * mean(np.exp(mid)) < n
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        y = np.exp((lo + hi) / 2)
        x, u = -np.expm1(-y), -np.expm1(-DISCOUNT * y)
        m = mean(y)
        spread = k * m * (1 + x / (1 - x) * (1 - DISCOUNT) - m)
        out[rest] = k * np.log(u) - n * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12)) + _lgamma(n + 1) - k * np.log(DISCOUNT) - t_factorial[rest]
    out[t >= c] = 0.0
    return out


def _draw_tables(c: np.ndarray, log_weight: np.ndarray, order: list[tuple[int, np.ndarray]], rng) -> np.ndarray:
    """Numbers of tables of dishes of c customers, each drawn in proportion to its ways * exp(tables * log_weight).

    order: (customers, dishes) of up to ROW customers; 0 and the dishes of more."""
    t = np.ones(len(c), dtype=np.int64)
    for n, dishes in order:
        if n:
            ways, of = _log_ways(n), np.arange(1, n + 1)
            for part in np.array_split(dishes, -(-len(dishes) * n // (1 << 20))):
                log = ways + of * log_weight[part, None]
                sums = np.cumsum(np.exp(log - log.max(axis=1)[:, None]), axis=1)
                t[part] = 1 + (sums < (rng.random(len(part)) * sums[:, -1])[:, None]).sum(axis=1)
        else:
            for part in np.array_split(dishes, -(-len(dishes) // 512)):
                t[part] = _draw_many(c[part], log_weight[part], rng)
    return np.minimum(t, c)


def _draw_many(c: np.ndarray, log_weight: np.ndarray, rng) -> np.ndarray:
    """The same for dishes of more than ROW customers: on a grid that closes in on where the weight lies."""
    lo, hi = np.ones(len(c)), c.astype(np.float64)
    for step in range(4):
        share = np.linspace(0, 1, GRID)
        at = lo[:, None] * (hi / lo)[:, None] ** share if step == 0 else lo[:, None] + (hi - lo)[:, None] * share
        at = np.clip(np.round(at), 1, c[:, None])
        log = _log_ways_at(np.repeat(c, GRID), at.ravel()).reshape(at.shape) + at * log_weight[:, None]
        log -= log.max(axis=1)[:, None]
        if step < 3:
            far = log > -40
            first, last = far.argmax(axis=1), GRID - 1 - far[:, ::-1].argmax(axis=1)
            every = np.arange(len(c))
            lo, hi = at[every, np.maximum(first - 1, 0)], at[every, np.minimum(last + 1, GRID - 1)]
    # whole numbers, or strides where there are too many; between grid points the logarithm is taken as a line
    stride = np.maximum(1, (hi - lo) / (16 * GRID - 1))
    fine = lo[:, None] + stride[:, None] * np.arange(16 * GRID)
    log = np.stack([np.interp(f, a, x, right=-np.inf) for f, a, x in zip(fine, at, log)])
    sums = np.cumsum(np.exp(log), axis=1)
    k = (sums < (rng.random(len(c)) * sums[:, -1])[:, None]).sum(axis=1)
    spot = fine[np.arange(len(c)), k] + np.where(stride > 1, (rng.random(len(c)) - 0.5) * stride, 0)
    return np.clip(np.round(spot), 1, c).astype(np.int64)


def _reseat(count, group, base, scale, rng, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Mean numbers of tables of each dish and of each restaurant.

    count: customers of each dish; group: its restaurant; base: the parent's probability of it; scale: by how much the
    whole restaurant exceeds the piece that is here, if it is spread over buckets.

    A sweep reseats all customers. The product of (strength + discount * j) over a restaurant's tables is a gamma
    integral; given its variable, the restaurant's dishes are independent, and the number of tables of a dish has weight
    (its ways) * (discount * variable * base) ** tables, from which it is drawn as a whole."""
    n_groups = int(group.max()) + 1 if len(group) else 0
    tables = np.minimum(count, 1).astype(np.int64)
    many = np.flatnonzero(count > 1)
    fixed = np.bincount(group, weights=tables, minlength=n_groups)
    if not len(many):
        return tables.astype(np.float64), fixed
    c, g, p = count[many], group[many], base[many]
    parts = np.ones(n_groups)
    parts[g] = scale[many]
    # start: about as many tables as seating one after another gives on average
    t, done = np.ones(len(c)), np.ones(len(c))
    total = fixed.copy()
    for _ in range(12):
        weight = (STRENGTH + DISCOUNT * parts[g] * total[g]) * p
        step = np.minimum(c - done, np.maximum(1, done * 0.8))
        t = np.minimum(t + step * weight / (weight + np.maximum(done - DISCOUNT * t, 0.1)), c)
        done = done + step
    total = fixed + np.bincount(g, weights=np.clip(np.round(t), 1, c) - 1, minlength=n_groups)
    by_count = np.argsort(c, kind="stable")
    by_count = by_count[: np.searchsorted(c[by_count], ROW, side="right")]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(c[by_count]) != 0, [True]])) if len(by_count) else np.zeros(1, np.int64)
    order = [(int(c[by_count[lo]]), by_count[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])]
    large = np.flatnonzero(c > ROW)
    if len(large):
        order.append((0, large))
    sum_t, sum_total = np.zeros(len(c)), np.zeros(n_groups)
    for sweep in range(burn_in + samples):
        variable = rng.gamma(STRENGTH / DISCOUNT + parts * total)
        t = _draw_tables(c, np.log(np.maximum(DISCOUNT * variable[g] * p, 1e-300)), order, rng)
        total = fixed + np.bincount(g, weights=t - 1, minlength=n_groups)
        if sweep >= burn_in:
            sum_t += t
            sum_total += total
    mean = tables.astype(np.float64)
    mean[many] = sum_t / samples
    return mean, sum_total / samples


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in the least of 1, 2, 4 or 8 bytes that holds them all; the last byte says in how many."""
    top = int(a.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return a.astype(f"<u{width}").tobytes() + bytes([width])


def _sized(x) -> np.ndarray:
    """What `_small` has packed."""
    raw = np.frombuffer(x.as_buffer(), dtype=np.uint8)
    return raw[:-1].view(f"<u{raw[-1]}")


def _coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers, of which many are equal, as their distinct values and the place of each among them."""
    names, place = np.unique(values.astype(np.float32), return_inverse=True)
    return names.tobytes(), _small(place)


def _decoded(names, place) -> np.ndarray:
    return _array(names, np.float32)[_sized(place)]


def _array(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=kind)


def _digest(words: np.ndarray) -> int:
    """By which a receiver sees that it has the same words as the sender."""
    return int(np.bitwise_xor.reduce(words).view(np.int64)) if len(words) else 0


def _places(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where the words are among the sorted names, which have them all unless the input changed."""
    where = np.searchsorted(names, words)
    if where.size and (where.max() >= len(names) or not (names[where] == words).all()):
        raise ValueError(UNSTEADY)
    return where


def _dealt(words: np.ndarray, n_buckets: int) -> dict[int, np.ndarray]:
    """Bucket -> places of its words, in order."""
    b = _bucket(words, n_buckets).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) != 0, [True]])) if len(b) else [0]
    return {int(b[order[lo]]): order[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, path: str | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    docs must give the same rows in the same partitions each time it is read, as files do; otherwise it fails."""
    spark = docs.sparkSession
    path = path or common.scratch(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~held_out).alias("train"))
    size, n_starts = (int(x or 0) for x in rows.select(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first())
    n_buckets = max(4, -(-size // BUCKET_BYTES))

    # words: chunk -> bucket of the word -> counts over all training texts, and each chunk's places among the bucket's words
    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in chunks.chunks(batches):
            h, _, _, train = _tokens(held)
            words, _, counts = _words(h, train)
            dealt = _dealt(words, n_buckets)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(dealt), pa.int32()), "key": pa.array([key] * len(dealt), pa.int64()), "w": pa.array([words[at].tobytes() for at in dealt.values()], pa.binary()), "c": pa.array([_small(counts[at]) for at in dealt.values()], pa.binary())})

    def words_in(table: pa.Table) -> pa.Table:
        w = [_array(x, np.uint64) for x in table.column("w").combine_chunks()]
        names, inv = np.unique(np.concatenate(w), return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, inv, np.concatenate([_sized(x) for x in table.column("c").combine_chunks()]).astype(np.int64))
        cut = np.cumsum([0] + [len(x) for x in w])
        hottest = sums >= max(1, HOT_SHARE * sums.sum())
        n, none = len(w), [None] * len(w)
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()] * (n + 1), pa.int32()), "key": pa.array([-1, *table.column("key").to_pylist()], pa.int64()), "w": pa.array([names.tobytes(), *none], pa.binary()),
            "c": pa.array([_small(sums), *[_small(inv[a:b]) for a, b in zip(cut[:-1], cut[1:])]], pa.binary()), "tokens": pa.array([int(sums.sum()), *none], pa.int64()), "types": pa.array([int((sums > 0).sum()), *none], pa.int64()),
            "top": pa.array([names[hottest].tobytes(), *none], pa.binary()), "top_c": pa.array([sums[hottest].tobytes(), *none], pa.binary()),
        })

    sent = common.map_batches(rows, words_out, "bucket int, key long, w binary, c binary")
    words = common.stored(sent.groupBy("bucket").applyInArrow(words_in, "bucket int, key long, w binary, c binary, tokens long, types long, top binary, top_c binary"), path, "words", drop_shuffle=True)
    n_train, n_types = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("types")).first())
    # a bucket's words with HOT_SHARE of its own tokens, of which only those with HOT_SHARE of all are taken
    tops = words.where(F.length("top") > 0).select("top", "top_c")

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                h, c = _array(x, np.uint64), _array(y, np.int64)
                ok = c >= HOT_SHARE * n_train
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[ok].view(np.int64)), "n": pa.array(c[ok])})

    hot_rows = common.map_batches(tops, hottest, "h long, n long").collect()  # at most 1 / HOT_SHARE rows
    hot_rows = sorted((np.uint64(r["h"] & (1 << 64) - 1), r["n"]) for r in hot_rows)
    hot = np.array([h for h, _ in hot_rows], dtype=np.uint64)
    parts = np.array([min(n_buckets, 1 + int(4 * n / max(1, n_train) * n_buckets)) for _, n in hot_rows], dtype=np.int64)

    # pairs: chunk -> bucket of the context -> seating -> answers to chunks, and tables for each word
    def pairs_of(held: list[pa.RecordBatch]):
        h, ctx, at, train = _tokens(held)
        names, inv, _ = _words(h, train)
        return names, inv, at, Pairs(names, inv, ctx, train, n_buckets, hot, parts)

    def pairs_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in chunks.chunks(batches):
            names, _, _, p = pairs_of(held)
            blobs: list[list[bytes]] = [[], [], [], [], []]
            for lo, hi in zip(p.cut[:-1], p.cut[1:]):
                vocabulary, index = np.unique(p.word[lo:hi], return_inverse=True)
                ctx = p.context[lo:hi]
                run = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1], [True]]))
                for b, x in zip(blobs, (ctx[run[:-1]].tobytes(), _small(np.diff(run)), _small(index), _small(p.count[lo:hi]), names[vocabulary].tobytes())):
                    b.append(x)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(p.bucket[p.cut[:-1]].astype(np.int32), pa.int32()), "key": pa.array([key] * len(blobs[0]), pa.int64())} | {f"b{i}": pa.array(x, pa.binary()) for i, x in enumerate(blobs)})

    def dishes_of(table: pa.Table):
        """(words, contexts, restaurant, word and customers of each dish, each pair's dish, where chunks' pairs begin) of a bucket."""
        col = lambda i: table.column(f"b{i}").combine_chunks()
        ctx, vocab = [_array(x, np.uint64) for x in col(0)], [_array(x, np.uint64) for x in col(4)]
        runs, index, count = ([_sized(x) for x in col(i)] for i in (1, 2, 3))
        names, vinv = np.unique(np.concatenate(vocab), return_inverse=True)
        vstart = np.cumsum([0] + [len(x) for x in vocab])
        word = np.concatenate([vinv[vstart[i] : vstart[i + 1]].astype(np.uint32)[x] for i, x in enumerate(index)])
        cnames, cinv = np.unique(np.concatenate(ctx), return_inverse=True)
        dish = np.repeat(cinv.astype(np.uint64) << np.uint64(32), np.concatenate(runs)) | word
        del word
        uniq, inv = np.unique(dish, return_inverse=True)
        del dish
        c = np.bincount(inv, weights=np.concatenate(count), minlength=len(uniq)).astype(np.int64)
        g, w = (uniq >> np.uint64(32)).astype(np.int64), (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return names, cnames, g, w, c, inv, np.cumsum([0] + [len(x) for x in index])

    def burden(cnames: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By which the tables of a spread restaurant's pieces compare: customers of a dish to the power at which tables grow."""
        return np.bincount(g, weights=np.where(c > 0, c, 0) ** DISCOUNT, minlength=len(cnames))

    # the parent with one table for each dish: buckets tell how many of their restaurants serve a word, and get the sum of all
    def told(table: pa.Table) -> pa.Table:
        names, cnames, g, w, c, _, _ = dishes_of(table)
        bucket = table.column("bucket")[0].as_py()
        spread = [(int(np.searchsorted(hot, cnames[i])), x) for i, x in zip(np.flatnonzero(np.isin(cnames, hot)).tolist(), burden(cnames, g, c)[np.isin(cnames, hot)].tolist())]
        serving = np.bincount(w[c > 0], minlength=len(names))
        names, serving = names[serving > 0], serving[serving > 0]
        dealt = _dealt(names, n_buckets)
        to = [*dealt, *[-1 - i for i, _ in spread]]
        return pa.table({
            "to": pa.array(to, pa.int32()), "bucket": pa.array([bucket] * len(to), pa.int32()), "w": pa.array([*[names[at].tobytes() for at in dealt.values()], *[b""] * len(spread)], pa.binary()),
            "n": pa.array([*[_small(serving[at]) for at in dealt.values()], *[b""] * len(spread)], pa.binary()), "burden": pa.array([*[0.0] * len(dealt), *[x for _, x in spread]], pa.float64()),
        })

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"bucket": [], "to": [], "digest": [], "n": [], "total": [], "burden": []}
        if left.num_rows and (to := left.column("to")[0].as_py()) < 0:
            out = {"bucket": [-1], "to": [to], "digest": [0], "n": [b""], "total": [0], "burden": [float(np.sort(left.column("burden").to_numpy()).sum())]}
        elif left.num_rows:
            if not right.num_rows:
                raise ValueError(UNSTEADY)
            names = _array(right.column("w").combine_chunks()[0], np.uint64)
            sums = np.zeros(len(names), dtype=np.int64)
            asked = [_places(names, _array(x, np.uint64)) for x in left.column("w").combine_chunks()]
            for at, n in zip(asked, left.column("n").combine_chunks()):
                sums[at] += _sized(n).astype(np.int64)
            out = {"bucket": left.column("bucket").to_pylist(), "to": left.column("to").to_pylist(), "digest": [_digest(names[at]) for at in asked], "n": [_small(sums[at]) for at in asked], "total": [int(sums.sum())] + [0] * (len(asked) - 1), "burden": [0.0] * len(asked)}
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)})

    sent = common.map_batches(rows, pairs_out, "bucket int, key long, " + ", ".join(f"b{i} binary" for i in range(5)))
    asked = sent.groupBy("bucket").applyInArrow(told, "to int, bucket int, w binary, n binary, burden double")
    serving = asked.groupBy("to").cogroup(words.where("key < 0").select("bucket", "w").groupBy("bucket")).applyInArrow(summed, "bucket int, to int, digest long, n binary, total long, burden double")
    serving = common.stored(serving, path, "serving", drop_shuffle=True)
    n_dishes = int(serving.agg(F.sum("total")).first()[0] or 0)
    whole = np.zeros(len(hot))
    for r in serving.where("bucket < 0").select("to", "burden").collect():  # a row for each hot word
        whole[-1 - r["to"]] = r["burden"]

    def pairs_in(table: pa.Table, right: pa.Table) -> pa.Table:
        names, cnames, g, w, c, inv, cut = dishes_of(table)
        bucket = table.column("bucket")[0].as_py()
        rng = np.random.default_rng([seed, bucket])
        mine = np.flatnonzero(np.bincount(w[c > 0], minlength=len(names)))
        dealt = _dealt(names[mine], n_buckets)
        everywhere = np.ones(len(names), dtype=np.int64)
        for to, digest, n in zip(right.column("to").to_pylist(), right.column("digest").to_pylist(), right.column("n").combine_chunks()):
            at = mine[dealt.pop(to, mine[:0])]
            if digest != _digest(names[at]):
                raise ValueError(UNSTEADY)
            everywhere[at] = _sized(n)
        if dealt:
            raise ValueError(UNSTEADY)
        base = (everywhere - PARENT_DISCOUNT) / (PARENT_STRENGTH + n_dishes)
        trained = np.flatnonzero(c > 0)
        scale = np.ones(len(cnames))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, cnames), len(hot) - 1)
            scale = np.where(hot[at] == cnames, whole[at] / np.maximum(burden(cnames, g, c), 1e-9), 1.0)
        t = np.zeros(len(c))
        if len(trained):
            t[trained], _ = _reseat(c[trained], g[trained], base[w[trained]], scale[g[trained]], rng, burn_in, samples)
        numer = (c - DISCOUNT * t).astype(np.float32)[inv]
        out = {"to": [], "key": [], "x": [], "y": []}

        def put(to: int, key: int, x: bytes, y: bytes) -> None:
            for k, v in zip(out, (to, key, x, y)):
                out[k].append(v)

        for i, key in enumerate(table.column("key").to_pylist()):
            put(-1, key, *_coded(numer[cut[i] : cut[i + 1]]))
        # tables of each word for the parent (key -1), tables of each context for its restaurant's total (key -2)
        for key, who, of in ((-1, names, w), (-2, cnames, g)):
            tables = np.bincount(of, weights=t, minlength=len(who)).astype(np.float32)
            who, tables = who[tables > 0], tables[tables > 0]
            for to, at in _dealt(who, n_buckets).items():
                put(to, key, who[at].tobytes(), tables[at].tobytes())
        return pa.table({"to": pa.array(out["to"], pa.int32()), "key": pa.array(out["key"], pa.int64()), "bucket": pa.array([bucket] * len(out["to"]), pa.int32()), "x": pa.array(out["x"], pa.binary()), "y": pa.array(out["y"], pa.binary())})

    seated = common.stored(sent.groupBy("bucket").cogroup(serving.where("bucket >= 0").select("bucket", "to", "digest", "n").groupBy("bucket")).applyInArrow(pairs_in, "to int, key long, bucket int, x binary, y binary"), path, "seated", drop_shuffle=True)
    common.remove(spark, f"{path}/serving")

    # all tables, and those of the restaurant of first words
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_, first = 0.0, 0.0
            for key, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if key == -1:
                    all_ += float(_array(y, np.float32).sum(dtype=np.float64))
                else:
                    first += float(_array(y, np.float32)[_array(x, np.uint64) == START].sum(dtype=np.float64))
            yield pa.RecordBatch.from_pydict({"all": pa.array([all_]), "first": pa.array([first])})

    tables = seated.where("`to` >= 0").select(F.col("to").alias("bucket"), "key", "x", "y")
    served, first_tables = (float(x or 0) for x in common.map_batches(tables.select("key", "x", "y"), totals, "all double, first double").agg(F.sum("all"), F.sum("first")).first())

    # the parent: tables of all contexts are its customers; each word has one table there
    def parent(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"key": [], "bucket": [], "digest": [], "c": [], "p": [], "pi": [], "t": [], "ti": []}
        # a bucket without words can still have the restaurant of first words
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if left.num_rows:
            at_names = left.column("key").to_pylist().index(-1)
            names, counts = _array(left.column("w")[at_names], np.uint64), _sized(left.column("c")[at_names]).astype(np.int64)
        customers, restaurant = np.zeros(len(names)), np.zeros(len(names))
        for kind, x, y in zip(right.column("key").to_pylist(), right.column("x").combine_chunks(), right.column("y").combine_chunks()):
            x, y = _array(x, np.uint64), _array(y, np.float32)
            if kind == -1:
                customers[_places(names, x)] += y
            else:
                restaurant[_places(names, x[x != START])] += y[x != START]
        unknown = (PARENT_STRENGTH + PARENT_DISCOUNT * n_types) / (PARENT_STRENGTH + served)
        p = np.where(counts > 0, (np.maximum(customers, 1) - PARENT_DISCOUNT) / (PARENT_STRENGTH + served), unknown)
        for k, c in zip(left.column("key").to_pylist(), left.column("c")):
            if k >= 0:
                at = _sized(c)
                for name, v in zip(out, (k, key[0].as_py(), _digest(names[at]), _small(counts[at]), *_coded(p[at]), *_coded(restaurant[at]))):
                    out[name].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)})

    answers = words.select("bucket", "key", "w", "c").groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(parent, "key long, bucket int, digest long, c binary, p binary, pi binary, t binary, ti binary")
    answers = answers.unionByName(seated.where("`to` < 0").select("key", "bucket", F.col("x").alias("p"), F.col("y").alias("pi")), allowMissingColumns=True)
    first_total = STRENGTH + n_starts
    first_alpha = (STRENGTH + DISCOUNT * first_tables) / first_total

    def scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held = left.select(["doc_id", "text", "train"]).combine_chunks().to_batches()
        names, inv, at, p = pairs_of(held)
        count, chance, restaurant = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names))
        numer = np.zeros(len(p.word), dtype=np.float32)
        dealt = _dealt(names, n_buckets)
        begin = {int(p.bucket[lo]): (lo, hi) for lo, hi in zip(p.cut[:-1], p.cut[1:])}
        for b, digest, *cells in zip(right.column("bucket").to_pylist(), right.column("digest").to_pylist(), *[right.column(k).combine_chunks() for k in ("c", "p", "pi", "t", "ti")]):
            c, v, vi, t, ti = cells
            if c.is_valid:
                place = dealt.pop(b, None)
                if place is None or digest != _digest(names[place]):
                    raise ValueError(UNSTEADY)
                count[place], chance[place], restaurant[place] = _sized(c), _decoded(v, vi), _decoded(t, ti)
            else:
                lo, hi = begin.pop(b, (0, 0))
                if len(_sized(vi)) != hi - lo:
                    raise ValueError(UNSTEADY)
                numer[lo:hi] = _decoded(v, vi)
        if dealt or begin:
            raise ValueError(UNSTEADY)
        # a word's restaurant has as many customers as the word has training tokens, since each is followed by a token
        total = STRENGTH + count
        alpha = (STRENGTH + DISCOUNT * restaurant) / total
        ctx_at = np.minimum(np.searchsorted(names, p.context), len(names) - 1)
        inner = p.context != START
        prob = numer / np.where(inner, total[ctx_at], first_total) + np.where(inner, alpha[ctx_at], first_alpha) * chance[p.word]
        logs = np.log10(np.maximum(prob, 1e-300))[p.of_token]
        c = count[inv]
        base = np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))
        n = sum(b.num_rows for b in held)
        add = lambda x=None: np.bincount(at, weights=x, minlength=n)
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": pa.array(add().astype(np.int64)), "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(logs))})

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double"
    keyed = common.map_batches(rows, chunks.tagged, f"key long, doc_id {docs.schema[id_col].dataType.simpleString()}, text string, train boolean")
    out = keyed.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(scored, schema)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents"))
