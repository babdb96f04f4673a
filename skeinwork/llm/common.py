"""Shared pieces of the training-data operators: Arrow text blocks, hashing, components, scratch tables."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the polynomial byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls of the same worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), U64(base), dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none of them empty: each is cut into lanes of 8 bytes, which are mixed with their place and added."""
    size = ends - starts
    lanes = np.maximum(size + 7 >> 3, 1)
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    if len(size) and lanes.max() == 1:
        first, place, left = starts, np.zeros(len(starts), np.int64), size
    else:
        first = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        left = np.repeat(size, lanes) - 8 * place
        first = np.repeat(starts, lanes) + 8 * place
    lane = words[first]
    lane &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.clip(left, 1, 8).astype(U64)))
    lane = mix64(lane ^ (mix64(place.astype(U64) + U64(1)) if len(place) != len(size) else U64(0x5692161D100B05E5)))
    if len(lane) != len(size):
        lane = np.add.reduceat(lane, np.cumsum(lanes) - lanes)
    return mix64(lane ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))


class ByteHasher:
    """64-bit hashes of any byte ranges of one block, from prefix sums; for ranges of a few hundred bytes.

    A polynomial modulo 2**64: strings of over 1,000 bytes of a certain self-similar form have the same hash at any base."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=U64)
        if n:
            np.cumsum((data.astype(U64) + U64(1)) * _power_table(BASE, n), dtype=U64, out=self.prefix[1:])
        self.inverse = _power_table(BASE_INV, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix64(raw ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, null as empty; no copy is made of a column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off_buf, data_buf = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then those of start[1], and so on."""
    total = np.cumsum(count)
    if not len(total) or not total[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.arange(total[-1]) + np.repeat(start - (total - count), count)


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = 1 << 20, block_rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of pieces of a text column; null counts as empty.

    Rows stay whole, so a piece is longer than block_bytes only if one text is; it has block_rows at most."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    data, off = bytes_of(col)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + block_bytes, side="right")) - 1
        hi = min(n, lo + block_rows, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


#: Bytes between words: space and the five control characters 0x09 to 0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block after lower-casing A-Z; they never cross documents. gap: other bytes between words.

    starts, ends: byte ranges; doc: row of each word; first: index of each row's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, gap: np.ndarray = _IS_SPACE):
        n = len(data)
        word = np.zeros(n + 2, dtype=bool)
        np.logical_not(gap[data], out=word[1 : n + 1])
        begin = word[1:] & ~word[:-1]
        end = word[:-1] & ~word[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        cut = inner[word[inner] & word[inner + 1]]
        begin[cut] = True
        end[cut] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end)
        self.lowered = _LOWER[data]
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.lowered, self.starts, self.ends)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that workers need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    target = Path(tempfile.mkdtemp()) / "skeinwork_package.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    sc._skein_shipped = True


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables in which no value of the column, by which the rows are sorted, goes on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        end = batch.column(column)[batch.num_rows - 1].as_py()
        if held[0].column(column)[0].as_py() == end:
            continue
        rows = pa.Table.from_batches(held)
        keep = int((rows.column(column).to_numpy() == end).sum())
        yield rows.slice(0, rows.num_rows - keep)
        held = rows.slice(rows.num_rows - keep).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names; it goes when the driver ends.

    Where the setting is absent, a session on one machine uses /tmp/checkpoints, any other is refused."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        named = sc._jsc.sc().getCheckpointDir()
        if named.isDefined():
            base = named.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            base = "/tmp/checkpoints"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    path = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


#: Spark's own setting by which a finished query's shuffle files go at once instead of with a later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, name: str, drop_shuffle: bool = False) -> DataFrame:
    """Write df as Parquet under path and read it back: lineage is cut and any executor can go.

    drop_shuffle: the shuffle files that the writing needed go as soon as it is done."""
    spark, target = df.sparkSession, f"{path}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    if drop_shuffle:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(target)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(target)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def components(edges: DataFrame, path: str, name: str = "cc") -> DataFrame:
    """(node, root): the smallest id reachable from each node of edges (a long, b long).

    Alternating large-star and small-star steps; each round is written to path, so neither lineage
    nor the driver holds the graph. Nodes on no edge get no row."""
    spark = edges.sparkSession
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(current, path, f"{name}0")
    step, before = 0, None
    while True:
        # large star: every larger neighbour of a node is tied to the smallest node around it
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node and its smaller neighbours are tied to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        step += 1
        current = stored(small, path, f"{name}{step}")
        remove(spark, f"{path}/{name}{step - 1}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now[0] == now[2] and (before == (now[0], now[1]) or not current.join(current.select(F.col("a").alias("b")).distinct(), "b", "left_semi").take(1)):
            break
        before = (now[0], now[1])
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more; otherwise they wait for the next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
