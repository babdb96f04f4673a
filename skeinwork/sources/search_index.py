"""A stored search index with block maxima, and a search that reads only the blocks that can enter the answer.

Documents are dealt into ranges by a hash of their id. A block holds one token's postings in one range, with the
greatest BM25 part that any of them can give. Blocks lie in folders by bucket of the token and by span of ranges. A search
reads the block heads of its tokens, adds up for each range what its documents can reach at most, scores the documents of
the most promising ranges, and takes the k-th best score as a limit: ranges that cannot reach it are not read any
further. Both reads join with the small list of wanted blocks, so Spark prunes the folders of buckets and spans.

Documents, blocks, heads and counts are one version, which a pointer names when all of it is written; readers keep the
version that they began with."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import ranking, search
from . import sinks

#: Documents of a range, postings of a bucket on average, least and most buckets, spans of each bucket.
RANGE_DOCS, BUCKET_POSTINGS, LEAST_BUCKETS, MOST_BUCKETS, SPANS = 128, 4_000_000, 8, 4096, 4
#: Ranges that are scored first for each query.
FIRST = 4
#: Documents of one task that makes blocks, searches that meet one range at a time, and words that go to every task that reads blocks.
TASK_DOCS, TASK_SEARCHES, SHORT_TOKENS = 32_768, 2_000, 1_000_000
#: Scores count to the sixth place, so a range is read if it comes as near as that.
ROUNDING = 2e-6


def _blocks(id_type: str) -> str:
    return f"token string, range int, posts array<struct<doc_id:{id_type},tf:int,len:int>>, best double, n long, bucket int, span int"


def _finder(pattern: str):
    rx = re.compile(pattern)
    return rx.findall if not rx.groups else lambda text: [m.group() for m in rx.finditer(text)]


def _flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def _counts(pattern: str):
    """Sums over batches (copies, text): rows, documents, words, and different words of each row."""
    def counts(batches):
        find = _finder(pattern)
        for b in batches:
            words, copies = [find(x) for x in b.column("text").to_pylist()], b.column("copies").to_pylist()
            sums = b.num_rows, sum(copies), sum(len(w) * c for w, c in zip(words, copies)), sum(len(set(w)) for w in words)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["rows", "n", "total", "most"])

    return counts


def _blocks_of(pattern: str, avg_len: float):
    """One range's documents (doc_id, copies, text, range) as blocks; words are counted in place, so no posting is shuffled by itself."""
    k1, b = search.K1, search.B

    def blocks(docs: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(_flat(docs, "doc_id")))
        find, words, lens = _finder(pattern), [], []
        for text in docs["text"].to_pylist():
            found = find(text)
            words += found
            lens.append(len(found))
        lens, size = np.array(lens, np.int64), docs.num_rows
        tokens = pa.array(words, pa.string()).dictionary_encode()
        key, tf = np.unique(tokens.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(size), lens), return_counts=True)
        code, doc = np.divmod(key, size)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / avg_len))
        posts = pa.StructArray.from_arrays([_flat(docs, "doc_id").take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(lens[doc], pa.int32())], names=["doc_id", "tf", "len"])
        copies = _flat(docs, "copies").to_numpy()[doc]
        some = len(starts) > 0
        return pa.table({
            "token": tokens.dictionary.take(pa.array(code[starts])), "range": pa.array(np.full(len(starts), docs["range"][0].as_py()), pa.int32()),
            "posts": pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), posts),
            "best": pa.array(np.maximum.reduceat(part, starts) if some else [], pa.float64()), "n": pa.array(np.add.reduceat(copies, starts) if some else [], pa.int64()),
        })

    return blocks


def _scores_of(avg_len: float, k: int | None, kinds: tuple):
    """Scores of one range's blocks (token, posts) for the searches (query_id, token, idf) that meet it: of each search all documents, or
    those that reach its k-th best there to the rounding."""
    k1, b, rounding = search.K1, search.B, ROUNDING

    def scores(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        at = pc.index_in(_flat(wanted, "token"), value_set=_flat(blocks, "token"))
        wanted = wanted.filter(pc.is_valid(at))
        at = at.drop_null().to_numpy()
        names = ["query_id", "doc_id", "score"]
        if not len(at):
            return pa.table([pa.array([], kinds[0]), pa.array([], kinds[1]), pa.array([], pa.float64())], names=names)
        lists = _flat(blocks, "posts")
        offsets, posts = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        offsets = offsets - offsets[0]
        docs, searches = posts.field("doc_id").dictionary_encode(), _flat(wanted, "query_id").dictionary_encode()
        tf, lens = posts.field("tf").to_numpy(), posts.field("len").to_numpy()
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / avg_len))
        # each wanted block beside all of its postings
        counts = offsets[at + 1] - offsets[at]
        row = np.repeat(np.arange(len(at)), counts)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[at][row]
        size = len(docs.dictionary)
        pair, place = np.unique(searches.indices.to_numpy()[row].astype(np.int64) * size + docs.indices.to_numpy()[pos], return_inverse=True)
        score = np.bincount(place, _flat(wanted, "idf").to_numpy()[row] * part[pos])
        q, d = np.divmod(pair, size)
        if k is not None:
            order = np.lexsort((-score, q))
            first = np.searchsorted(q, np.arange(len(searches.dictionary)))
            kth = np.minimum(first + k, np.append(first[1:], len(q))) - 1
            keep = score >= score[order][kth][q] - rounding
            q, d, score = q[keep], d[keep], score[keep]
        return pa.table([searches.dictionary.take(pa.array(q)), docs.dictionary.take(pa.array(d)), pa.array(score)], names=names)

    return scores


def write(docs: DataFrame, root: str, id_col: str, fields: list[str], version: str, pattern: str = "[a-z0-9]+", range_docs: int = RANGE_DOCS, buckets: int | None = None, spans: int = SPANS, copies: str | None = None) -> None:
    """Write a version of the index: the last row of each id, its postings in blocks, heads and counts; then name it as the current one.

    copies: a column with the number of documents that a row stands for (search.alike)."""
    spark = docs.sparkSession
    place = f"{root}/version={version}"
    every = docs.withColumn("__seq", F.monotonically_increasing_id())
    ranking.keep_last(every.where(F.col(id_col).isNotNull()), [id_col], ["__seq"]).drop("__seq").write.mode("errorifexists").parquet(f"{place}/docs")
    stored = spark.read.schema(docs.schema).parquet(f"{place}/docs")
    weight = F.lit(1).cast("long") if copies is None else F.col(copies).cast("long")
    texts = stored.select(F.col(id_col).alias("doc_id"), weight.alias("copies"), F.lower(F.concat_ws(" ", *fields)).alias("text"))
    rows, n, total, most = (x or 0 for x in texts.select("copies", "text").mapInArrow(_counts(pattern), "rows long, n long, total long, most long").agg(*map(F.sum, ("rows", "n", "total", "most"))).first())
    ranges = max(1, -(-rows // range_docs))
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-most // BUCKET_POSTINGS)))
    kind = texts.schema["doc_id"].dataType.simpleString()
    one = {"n_docs": F.lit(n).cast("long"), "avg_len": F.lit(total / n if n else 0.0), "ranges": F.lit(ranges), "buckets": F.lit(buckets), "spans": F.lit(spans), "id_type": F.lit(kind)}
    spark.range(1).select(*[c.alias(name) for name, c in one.items()]).write.parquet(f"{place}/counts")
    parts = max(-(-rows // TASK_DOCS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = texts.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")).repartition(parts, "range")
    blocks = (
        ranged.groupBy("range").applyInArrow(_blocks_of(pattern, total / n if total else 1.0), _blocks(kind).rsplit(", bucket", 1)[0])
        .withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).withColumn("span", F.pmod(F.col("range"), F.lit(spans)))
    )
    blocks.repartition("bucket", "span").sortWithinPartitions("bucket", "span", "token", "range").write.partitionBy("bucket", "span").parquet(f"{place}/blocks")
    heads = spark.read.schema(_blocks(kind)).parquet(f"{place}/blocks").select("token", "range", "span", "best", "n", "bucket")
    heads.sortWithinPartitions("bucket", "token", "range").write.partitionBy("bucket").parquet(f"{place}/heads")
    sinks.point_to_next(spark, root, version)


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version named last."""
    last = sinks._last_pointer(spark, root)
    if last is None:
        raise FileNotFoundError(f"no index under {root}")
    return f"{root}/version={last['version']}"


class Index:
    """One version of an index; a search that is under way is not touched by later versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.place = spark, current(spark, root)
        self.n_docs, self.avg_len, self.ranges, self.buckets, self.spans, kind = spark.read.parquet(f"{self.place}/counts").first()
        self.blocks = spark.read.schema(_blocks(kind)).parquet(f"{self.place}/blocks")
        self.heads = spark.read.schema("token string, range int, span int, best double, n long, bucket int").parquet(f"{self.place}/heads")

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/docs")

    def heads_of(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, range, span, bucket, idf, top): the blocks of each query's tokens and what a document gets there at most."""
        asked = queries.where("token is not null").select("query_id", "token").distinct()
        tokens = asked.select("token").distinct().withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))
        heads = self.heads.join(tokens, ["bucket", "token"]).withColumn("df", F.sum("n").over(Window.partitionBy("token")))
        idf = F.greatest(F.log((F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        known = heads.withColumn("idf", idf)
        return asked.join(known, "token").select("query_id", "token", "range", "span", "bucket", "idf", (F.col("idf") * F.col("best")).alias("top"), "n")

    def scored(self, wanted: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the documents in the wanted blocks (query_id, token, range, span, bucket, idf).

        All blocks of a range meet all searches that want it, so pairs are added up in place; k: only those among a search's k best of their
        range are given, to the rounding. Many searches are dealt over parts, to each of which the blocks go."""
        searches, words = wanted.agg(F.approx_count_distinct("query_id"), F.approx_count_distinct("token")).first()
        parts = max(1, -(-searches // TASK_SEARCHES))
        asked = wanted.select("query_id", "token", "range", "idf", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
        tokens = wanted.select("bucket", "token").distinct()
        found = self.blocks.join(F.broadcast(tokens) if words <= SHORT_TOKENS else tokens, ["bucket", "token"], "left_semi")
        found = found.select("token", "range", "posts", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        types = {"query_id": wanted.schema["query_id"].dataType, "doc_id": self.blocks.schema["posts"].dataType.elementType["doc_id"].dataType}
        scores = _scores_of(self.avg_len or 1.0, k, tuple(to_arrow_type(t) for t in types.values()))
        return found.groupBy("range", "part").cogroup(asked.groupBy("range", "part")).applyInArrow(scores, ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", score double")

    def wanted(self, queries: DataFrame, k: int, path: str, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(scores of the first ranges, blocks still to be read): what a search for the k best documents reads."""
        heads = sinks.stored(self.heads_of(queries), f"{path}/heads")
        reach = heads.groupBy("query_id", "range").agg(F.sum("top").alias("reach"))
        order = Window.partitionBy("query_id").orderBy(F.desc("reach"), "range")
        reach = sinks.stored(reach.withColumn("place", F.row_number().over(order)), f"{path}/reach")
        ahead = heads.join(reach.where(F.col("place") <= first).select("query_id", "range"), ["query_id", "range"])
        scores = sinks.stored(self.scored(ahead, k), f"{path}/ahead")
        kth = ranking.top_k(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "at").where(F.col("at") == k).select("query_id", F.col("score").alias("limit"))
        later = reach.where(F.col("place") > first).join(kth, "query_id", "left").where(F.col("limit").isNull() | (F.col("reach") >= F.col("limit") - ROUNDING))
        return scores, heads.join(later.select("query_id", "range"), ["query_id", "range"])

    def best(self, queries: DataFrame, k: int, path: str | None = None, first: int = FIRST) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query (query_id, token); scores count to the sixth place, ties by id."""
        path = path or sinks.scratch(self.spark)
        scores, rest = self.wanted(queries, k, path, first)
        every = scores.unionByName(self.scored(rest, k))
        return ranking.top_k(every, ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], k)
