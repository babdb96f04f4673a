"""Time-ordered target encoding: rates of an outcome among earlier rows of other folds, for ids with a hierarchy of priors.

Rows with an equal key and time are folded into one vector with a count for each fold. A scan adds the vectors of a key
in order of time; a row then takes, at the latest vector strictly earlier than itself, the total less its own fold's
component. Keys of more than `HOT_ROWS` rows are cut into chunks of one hour: the chunks' vectors are summed and scanned
first, and what lies before a chunk enters it as rows without a time, so a chunk is scanned by itself and no task holds
a hot key. A hot sale is one row in everything that depends on the sale alone, and its joins can be split.

The list of hot keys has at most rows / HOT_ROWS entries and is stored; Spark broadcasts it, as any table, only below
its threshold. Nothing is collected.

Lines without a sale or whose sale has no time are dropped. Null item and client ids are -1, an ordinary id; a null
vendor id is a value of its own, and so is a null or unknown kind, nation or segment. Repeated lines count each. Of
several rows of one id in items, vendors or clients the least value that is not null is used. A sale_id with several
rows in sales has its lines counted for each of them, and a result row for each time and client. Rows of one moment
are not history of each other. A null flag is not `returned`. An empty table gives an empty result (lines, sales) or
unknown values (the others). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FOLDS = 5
#: Rate, in millionths, before there is any history, and the number of lines that a prior weighs.
PRIOR, WEIGHT = 500_000, 50
#: Keys of more rows are scanned by hours.
HOT_ROWS = 20_000


def hour_of(t: Column) -> Column:
    """Hours since 1970; never falls as time goes on."""
    return F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(t)


def rate(n: Column, s: Column, prior: Column) -> Column:
    """The prior without history, else the share of s in n, in millionths, drawn towards the prior; in whole numbers."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", F.lit(1_000_000) * s + WEIGHT * prior, n + WEIGHT)).cast("long")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where values are; null equals null."""
    return pc.dictionary_encode(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0), null_encoding="encode").indices.to_numpy()


def _scan(batches: Iterator[pa.RecordBatch], keys: int, folds: int, held: int) -> Iterator[pa.RecordBatch]:
    """Columns: run, keys, chunk, t, fold, n, s, then `held` others; sorted by run, keys, chunk and time, rows without a time first."""
    for rows in common.whole_runs(batches):
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for c in range(keys + 2):
            code = rows.column(c).to_numpy() if c in (0, keys + 1) else _codes(rows.column(c))
            new[1:] |= code[1:] != code[:-1]
        time = rows.column(keys + 2)
        carried = pc.is_null(time).to_numpy()
        t = pc.fill_null(time.cast(pa.int64()), 0).to_numpy()
        other = new.copy()
        other[1:] |= (t[1:] != t[:-1]) | (carried[1:] != carried[:-1])
        fold, n, s = (rows.column(keys + 3 + i).to_numpy() for i in range(3))
        entry = np.cumsum(other) - 1
        first = np.flatnonzero(new)
        begin = np.repeat(entry[first], np.diff(np.append(first, len(new))))
        past = []
        for count in (n, s):
            vector = np.zeros((entry[-1] + 2, folds), dtype=np.int64)
            cell = np.flatnonzero(np.append(True, other[1:] | (fold[1:] != fold[:-1])))
            np.add.at(vector, (entry[cell] + 1, fold[cell]), np.add.reduceat(count, cell))
            before = np.cumsum(vector, axis=0)
            gained = before[entry] - before[begin]
            past.append(gained.sum(axis=1) - gained[np.arange(len(fold)), fold])
        out = rows.select(range(keys + 6, keys + 6 + held)).append_column("past_n", pa.array(past[0])).append_column("past_s", pa.array(past[1]))
        yield from out.filter(pa.array(~carried)).combine_chunks().to_batches()


def histories(rows: DataFrame, key: list[str], keep: list[str], path: str, name: str, folds: int = FOLDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The columns `keep` of rows (key columns, t, fold, n, s, others) with past_n and past_s: sums of n and s over the rows of an equal
    key (null equals null), an earlier t and another fold. rows are read three times and should be stored."""
    hot = common.stored(rows.groupBy(*key).agg(F.count("*").alias("__rows")).where(F.col("__rows") > hot_rows).select(*[F.col(k).alias(f"__{k}") for k in key]).withColumn("__hot", F.lit(True)), path, f"{name}_hot")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    tagged = rows.join(hot, same, "left").withColumn("__chunk", F.when(F.col("__hot"), hour_of(F.col("t"))).otherwise(F.lit(-1)).cast("long"))
    chunks = tagged.where("__hot").groupBy(*key, "__chunk").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "ns" for f in range(folds)])
    before = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    vectors = chunks.select(*key, "__chunk", F.array(*[F.struct(*[F.coalesce(F.sum(f"{c}{f}").over(before), F.lit(0)).alias(c) for c in "ns"]) for f in range(folds)]).alias("v"))
    vectors = vectors.select(*key, "__chunk", F.posexplode("v").alias("fold", "v"))
    types = {f.name: f.dataType for f in rows.schema.fields}
    order = [*key, "__chunk"]
    carried = vectors.select(*order, F.lit(None).cast(types["t"]).alias("t"), F.col("fold").cast("int"), F.col("v.n").alias("n"), F.col("v.s").alias("s"), *[F.lit(None).cast(types[c]).alias(f"out_{c}") for c in keep])
    own = tagged.select(*order, "t", F.col("fold").cast("int"), F.col("n").cast("long"), F.col("s").cast("long"), *[F.col(c).alias(f"out_{c}") for c in keep])
    together = own.unionByName(carried).withColumn("__run", F.xxhash64(*order)).select("__run", *order, "t", "fold", "n", "s", *[f"out_{c}" for c in keep])
    ordered = together.repartition("__run").sortWithinPartitions("__run", *order, "t")
    kinds = ", ".join([*(f"out_{c} {types[c].simpleString()}" for c in keep), "past_n long", "past_s long"])
    done = common.map_batches(ordered, lambda batches: _scan(batches, len(key), folds, len(keep)), kinds)
    return done.withColumnsRenamed({f"out_{c}": c for c in keep})


def target_rates(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, path: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per sale_id, item_id and vendor_id: own counts, and history count and rate of item, vendor and client."""
    path = path or common.scratch(lines.sparkSession)
    least = lambda df, name, i, v: common.stored(df.where(F.col(i).isNotNull()).groupBy(F.col(i).cast("long").alias(f"{name}_key")).agg(F.min(v).cast("string").alias(v)), path, name)
    kinds, nations, segments = least(items, "items", "item_id", "kind"), least(vendors, "vendors", "vendor_id", "nation_id"), least(clients, "clients", "client_id", "segment")
    counted = (
        lines.where("sale_id is not null").select("sale_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "vendor_id", F.coalesce(F.col("flag") == "returned", F.lit(False)).cast("long").alias("s"))
        .groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    )
    sold = sales.where("sold_at is not null and sale_id is not null").select("sale_id", F.coalesce("client_id", F.lit(-1)).alias("client_id"), F.col("sold_at").alias("t"))
    joined = counted.join(sold, "sale_id")
    joined = joined.join(kinds, F.col("item_id") == F.col("items_key"), "left").join(nations, F.col("vendor_id") == F.col("vendors_key"), "left")
    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    base = common.stored(joined.select("sale_id", "item_id", "vendor_id", "client_id", "t", fold.alias("fold"), "n", "s", "kind", "nation_id"), path, "base", drop_shuffle=True)

    total = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    by_sale = base.groupBy("sale_id", "client_id", "t", "fold").agg(*total).join(segments, F.col("client_id") == F.col("clients_key"), "left").drop("clients_key")
    by_sale = common.stored(by_sale, path, "by_sale", drop_shuffle=True)
    of = lambda df, what, value: df.groupBy(F.lit(what).alias("what"), value.cast("string").alias("value"), "t", "fold").agg(*total)
    coarse = of(by_sale, "all", F.lit(None)).unionByName(of(by_sale, "segment", F.col("segment"))).unionByName(of(base, "kind", F.col("kind"))).unionByName(of(base, "nation", F.col("nation_id")))
    coarse = common.stored(coarse, path, "coarse", drop_shuffle=True)
    coarse = common.stored(histories(coarse, ["what", "value"], ["what", "value", "t", "fold"], path, "coarse_past", hot_rows=hot_rows), path, "coarse_rates", drop_shuffle=True)
    pick = lambda what: coarse.where(F.col("what") == what).select(F.col("value").alias(f"{what}_value"), F.col("t").alias(f"{what}_t"), F.col("fold").alias(f"{what}_fold"), F.col("past_n").alias(f"{what}_n"), F.col("past_s").alias(f"{what}_s"))
    at = lambda what: (F.col("t") == F.col(f"{what}_t")) & (F.col("fold") == F.col(f"{what}_fold"))
    # a null value becomes a word that no value with its leading mark can be, so joins stay plain equalities
    word = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    clients_past = histories(by_sale, ["client_id"], ["sale_id", "client_id", "segment", "t", "fold"], path, "client_past", hot_rows=hot_rows).withColumnsRenamed({"past_n": "client_n", "past_s": "client_s"})
    per_sale = clients_past.join(pick("all"), at("all")).join(pick("segment"), at("segment") & (word("segment") == word("segment_value")))
    all_rate = rate(F.col("all_n"), F.col("all_s"), F.lit(PRIOR))
    per_sale = per_sale.withColumn("all_rate", all_rate).withColumn("client_rate", rate(F.col("client_n"), F.col("client_s"), rate(F.col("segment_n"), F.col("segment_s"), F.col("all_rate"))))
    per_sale = common.stored(per_sale.select(F.col("sale_id").alias("s_id"), F.col("client_id").alias("s_client"), F.col("t").alias("s_t"), "all_rate", "client_n", "client_rate"), path, "per_sale", drop_shuffle=True)

    held = ["sale_id", "item_id", "vendor_id", "client_id", "t", "fold", "n", "s", "kind", "nation_id"]
    with_item = histories(base, ["item_id"], held, path, "item_past", hot_rows=hot_rows).withColumnsRenamed({"past_n": "item_n", "past_s": "item_s"})
    with_item = common.stored(with_item, path, "with_item", drop_shuffle=True)
    with_both = histories(with_item, ["vendor_id"], [*held, "item_n", "item_s"], path, "vendor_past", hot_rows=hot_rows).withColumnsRenamed({"past_n": "vendor_n", "past_s": "vendor_s"})
    done = (
        with_both.join(pick("kind"), at("kind") & (word("kind") == word("kind_value"))).join(pick("nation"), at("nation") & (word("nation_id") == word("nation_value")))
        .join(per_sale, (F.col("sale_id") == F.col("s_id")) & (F.col("client_id") == F.col("s_client")) & (F.col("t") == F.col("s_t")))
    )
    item_rate = rate(F.col("item_n"), F.col("item_s"), rate(F.col("kind_n"), F.col("kind_s"), F.col("all_rate")))
    vendor_rate = rate(F.col("vendor_n"), F.col("vendor_s"), rate(F.col("nation_n"), F.col("nation_s"), F.col("all_rate")))
    return done.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", item_rate.alias("item_rate"), "vendor_n", vendor_rate.alias("vendor_rate"), "client_n", "client_rate")


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_rates(*(common.read_table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


#: The same by windows over every line: all history less that of the own fold.
OP12_SQL = """
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)
), tab AS (
  SELECT list(v ORDER BY i) AS tb FROM bits
), sold AS (
  SELECT sale_id, coalesce(client_id, -1) AS client_id, sold_at AS t,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 5 AS fold
  FROM sales, tab WHERE sold_at IS NOT NULL AND sale_id IS NOT NULL
), l AS (
  SELECT s.sale_id, coalesce(x.item_id, -1) AS item_id, x.vendor_id, s.client_id, s.t, s.fold, i.kind, v.nation_id, c.segment, count(*) AS n, count(*) FILTER (x.flag = 'returned') AS s
  FROM sale_lines x JOIN sold s ON x.sale_id = s.sale_id LEFT JOIN items i ON coalesce(x.item_id, -1) = i.item_id LEFT JOIN vendors v ON x.vendor_id = v.vendor_id LEFT JOIN clients c ON s.client_id = c.client_id
  GROUP BY ALL
), h AS (
  SELECT *, PAST
  FROM l WINDOW WINDOWS
), a AS (
  SELECT *, CASE WHEN all_n < 1 THEN 500000 ELSE (1000000 * all_s + 50 * 500000) // (all_n + 50) END AS all_rate FROM h
), p AS (
  SELECT *, RATES1 FROM a
)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s::BIGINT AS n_returned, RATES2 FROM p
"""


def _sql() -> str:
    columns = {"all": "1", "kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
    priors = {"item": "kind", "vendor": "nation", "client": "segment"}
    past = ", ".join(f"(coalesce(sum({c}) OVER w_{k}, 0) - coalesce(sum({c}) OVER f_{k}, 0))::BIGINT AS {k}_{c}" for k in columns for c in "ns")
    frame = "ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    windows = ", ".join(f"w_{k} AS (PARTITION BY {v} {frame}), f_{k} AS (PARTITION BY {v}, fold {frame})" for k, v in columns.items())
    of = lambda k, prior: f"CASE WHEN {k}_n < 1 THEN {prior} ELSE (1000000 * {k}_s + 50 * {prior}) // ({k}_n + 50) END"
    first = ", ".join(f"{of(k, 'all_rate')} AS {k}_rate" for k in priors.values())
    second = ", ".join(f"{k}_n, ({of(k, f'{p}_rate')})::BIGINT AS {k}_rate" for k, p in priors.items())
    return OP12_SQL.replace("PAST", past).replace("WINDOWS", windows).replace("RATES1", first).replace("RATES2", second)


OP12_SQL = _sql()
