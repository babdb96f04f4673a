"""Rows for human review: candidate rows with typed defaults, evidence joined from three sources, the full review shape.

Joins are left joins on the sources' keys, so a gap shows in `evidence_join_status` and is counted over the whole table;
`whole` turns gaps into an error where a complete join is demanded. Where a source has several rows of one key, the
greatest by its values in the order of its columns is used, so that no selected row is multiplied and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..sources import tables
from . import features, ranking

RECALL, INCIDENT = "cpsc_source_record_id", "saferproducts_source_record_id"

#: A candidate row's columns with types, and defaults where a value is missing (None: stays null).
CANDIDATE_COLUMNS = (
    ("cpsc_source_record_id", "string", None), ("cpsc_recall_number", "string", None), ("cpsc_recall_date", "string", None),
    ("cpsc_product_name", "string", None), ("saferproducts_source_record_id", "string", None), ("blocking_sources", "array<string>", "array()"),
    ("exact_upc", "boolean", "false"), ("shared_product_tokens", "array<string>", "array()"), ("shared_product_token_count", "int", "0"),
    ("product_token_jaccard", "double", "0"), ("incident_date", "string", None), ("publication_date", "string", None), ("incident_brand", "string", None),
    ("incident_model", "string", None), ("incident_upc", "string", None), ("incident_product_description", "string", None),
)
#: Fields taken from the candidate where the selected row's own is empty.
FILLED = (
    "blocking_sources", "selection_reason", "review_rank", "incident_brand", "incident_model", "incident_upc",
    "incident_product_description", "incident_date", "publication_date",
)
#: A review row's columns and the fields of the recall and the incident that they come from.
FROM_RECALL = (
    ("cpsc_title", "title"), ("cpsc_description", "description"), ("cpsc_hazards", "hazards"),
    ("cpsc_manufacturers", "manufacturers"), ("cpsc_retailers", "retailers"), ("cpsc_url", "url"),
)
FROM_INCIDENT = (
    ("incident_description", "incident_description"), ("incident_category", "product_category"), ("incident_manufacturer", "manufacturer_name"),
    ("incident_retailer", "retailer_name"), ("incident_locale", "locale"), ("incident_product_purchased_date", "product_purchased_date"),
    ("incident_product_manufactured_date", "product_manufactured_date"), ("incident_manufacturer_comments", "manufacturer_comments"),
    ("incident_user_still_has_product", "user_still_has_product"), ("incident_severity", "severity_type_id"),
)
#: Pair features of a review row, with the default of each.
FEATURES = (
    ("exact_upc", "int", "0"), ("shared_product_token_count", "int", "0"), ("product_token_jaccard", "double", "0"),
    ("product_name_sequence_similarity", "double", "0"), ("cpsc_name_token_coverage", "double", "0"), ("incident_name_token_coverage", "double", "0"),
    ("incident_brand_in_cpsc_name", "int", "0"), ("incident_model_in_cpsc_name", "int", "0"), ("manufacturer_in_cpsc_name", "int", "0"),
)
SIMILARITY_BAND, JACCARD_BAND = (0.40, 0.70), (0.15, 0.40)


def _typed(df: DataFrame, name: str, kind: str, default: str | None) -> Column:
    c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return (c if default is None else F.coalesce(c, F.expr(default).cast(kind))).alias(name)


def candidate_rows(df: DataFrame) -> DataFrame:
    """df as candidate pairs: all columns of the shape in its order, typed; absent or null ones have their defaults. Both ids must be
    columns, other columns are left out."""
    absent = [c for c in (RECALL, INCIDENT) if c not in df.columns]
    if absent:
        raise ValueError("a candidate needs " + " and ".join(absent))
    return df.select(*[_typed(df, *c) for c in CANDIDATE_COLUMNS])


def is_empty(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if kind.startswith(("array", "map")) else c.isNull()


def _taken(df: DataFrame, source: DataFrame, key: str, fields: tuple, found: str) -> DataFrame:
    """df with the fields of source under their names in a review row, and `found`: whether source has the row's key."""
    have = [(name, f) for name, f in fields if f in source.columns]
    # one row for each key; the aggregate combines before the shuffle
    one = source.groupBy(F.col("source_record_id").alias(key)).agg(F.max(F.struct(F.lit(True).alias("there"), *[F.col(f).alias(name) for name, f in have])).alias("__row"))
    one = one.select(key, F.lit(True).alias(found), *[F.col(f"__row.{name}").alias(name) for name, _ in have])
    out = df.drop(*[name for name, _ in fields]).join(one, key, "left").withColumn(found, F.coalesce(found, F.lit(False)))
    return _absent(out, source, fields)


def _absent(df: DataFrame, source: DataFrame, fields: tuple) -> DataFrame:
    """df with nulls for the fields that source has not, as constants, which no shuffle carries."""
    return df.withColumns({name: F.lit(None).cast("string") for name, f in fields if f not in source.columns})


#: Rows of pairs, candidates and incidents that one task takes.
TASK_ROWS = 500_000


def _met(pairs: DataFrame, candidates: DataFrame, incidents: DataFrame, rows: int, in_order: bool) -> DataFrame:
    """pairs with FILLED taken from their candidate where their own are empty, FROM_INCIDENT, and __candidate, __incident: whether these are there.

    The three are shuffled once, as one table, by incident; where rows are asked for in order, by ranges of it, which a sort then finds in place."""
    have = [f for f in FILLED if f in candidates.columns]
    told = [(name, f) for name, f in FROM_INCIDENT if f in incidents.columns]
    there = F.lit(True).alias("there")
    own = pairs.drop(*[name for name, _ in FROM_INCIDENT]).withColumn("__kind", F.lit(0))
    cs = candidates.where(F.col(RECALL).isNotNull() & F.col(INCIDENT).isNotNull()).select(RECALL, INCIDENT, F.lit(1).alias("__kind"), F.struct(there, *have).alias("__c"))
    ins = incidents.where("source_record_id is not null").select(F.col("source_record_id").alias(INCIDENT), F.lit(2).alias("__kind"), F.struct(there, *[F.col(f).alias(name) for name, f in told]).alias("__i"))
    every = own.unionByName(cs, allowMissingColumns=True).unionByName(ins, allowMissingColumns=True)
    parts = max(-(-3 * rows // TASK_ROWS), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = (every.repartitionByRange if in_order else every.repartition)(parts, INCIDENT)
    pair, incident = Window.partitionBy(INCIDENT, RECALL), Window.partitionBy(INCIDENT)
    out = every.withColumns({
        "__c": F.max("__c").over(pair), "__candidate": F.max(F.col("__kind") == 1).over(pair), "__i": F.max("__i").over(incident), "__incident": F.max(F.col("__kind") == 2).over(incident),
    }).where("__kind = 0")
    values = {f: F.when(is_empty(pairs, f), F.col(f"__c.{f}")).otherwise(F.col(f)) if f in pairs.columns else F.col(f"__c.{f}") for f in have}
    out = out.withColumns(values | {name: F.col(f"__i.{name}") for name, _ in told}).drop("__c", "__i", "__kind")
    return _absent(out, incidents, FROM_INCIDENT)


def join_evidence(selected: DataFrame, candidates: DataFrame, recalls: DataFrame, incidents: DataFrame, rows: int = 0, in_order: bool = False) -> DataFrame:
    """selected pairs with what their candidate, recall and incident say, and which of the three there are.

    rows: how many pairs there are, by which they are dealt over tasks; in_order: the rows lie in order of their incidents, for review_rows in
    that order. Recalls come first, while rows are short."""
    return _joined(_recalled(selected, recalls, rows), candidates, incidents, rows, in_order)


def _recalled(selected: DataFrame, recalls: DataFrame, rows: int) -> DataFrame:
    return _taken(selected, tables.dealt(recalls, "source_record_id", rows), RECALL, FROM_RECALL, "__recall")


def _joined(recalled: DataFrame, candidates: DataFrame, incidents: DataFrame, rows: int, in_order: bool) -> DataFrame:
    out = _met(recalled, candidates, incidents, rows, in_order)
    sides = ("candidate", "recall", "incident")
    return out.withColumn("evidence_join_status", F.struct(*[F.col(f"__{s}").alias(s) for s in sides])).drop(*[f"__{s}" for s in sides])


#: Pairs that meet their candidates and incidents at a time.
PASS_ROWS = 40_000_000


def join_in_ranges(selected: DataFrame, candidates: DataFrame, recalls: DataFrame, incidents: DataFrame, rows: int) -> list[DataFrame]:
    """join_evidence by ranges of the incident that follow each other, each of PASS_ROWS pairs or so, for review_rows in order of the incident.

    The shuffle of pairs, candidates and incidents is several times as large as what is kept of it, so only that of one range lies on disk at a time.
    Pairs with their recalls are written once; candidates and incidents are read again for each range."""
    n = -(-rows // PASS_ROWS)
    if n < 2:
        return [join_evidence(selected, candidates, recalls, incidents, rows, in_order=True)]
    pairs = tables.stored(_recalled(selected, recalls, rows), f"{tables.scratch(selected.sparkSession)}/recalled", cleared=True)
    ends = ranking.cuts(pairs, INCIDENT, n, rows)

    def within(df: DataFrame, column: str, low, high) -> DataFrame:
        c = F.col(column)
        df = df if low is None else df.where(c >= F.lit(low))
        return df if high is None else df.where(c < F.lit(high) if low is not None else (c < F.lit(high)) | c.isNull())

    return [
        _joined(within(pairs, INCIDENT, *r), within(candidates, INCIDENT, *r), within(incidents, "source_record_id", *r), -(-rows // (len(ends) + 1)), True)
        for r in zip([None, *ends], [*ends, None], strict=True)
    ]


def gaps(joined: DataFrame) -> DataFrame:
    """One row: rows, and how many lack their candidate, recall or incident."""
    s = "evidence_join_status"
    return joined.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.col(f"{s}.{k}")).alias(f"missing_{k}") for k in ("candidate", "recall", "incident")])


def whole(joined: DataFrame) -> DataFrame:
    """joined, evaluated with an error if a row lacks any of its three sources."""
    s = F.col("evidence_join_status")
    ok = s["candidate"] & s["recall"] & s["incident"]
    return joined.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("no whole evidence for "), F.to_json(F.struct(RECALL, INCIDENT)))).cast("boolean")))


def review_rows(joined: DataFrame | list[DataFrame], order: list[Column]) -> DataFrame:
    """The 45 columns of a review row, numbered ER-0001 and so on in a total order; joined may be several that follow each other in it.

    Dates are compared as ISO texts; the temporal status is `unknown` where one is missing or empty."""
    every, joined = joined, joined[0] if isinstance(joined, list) else joined
    text = lambda c: _typed(joined, c, "string", None)
    date = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    similarity, jaccard = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in joined.columns else F.lit(0.0) for c in ("product_name_sequence_similarity", "product_token_jaccard"))
    out = ranking.numbered(every, order, "ER-", "review_id")
    return out.select(
        "review_id", *map(text, (RECALL, "cpsc_recall_number", "cpsc_recall_date", "cpsc_product_name")), *[F.col(n) for n, _ in FROM_RECALL],
        *map(text, (INCIDENT, "incident_date", "publication_date", "incident_brand", "incident_model", "incident_upc", "incident_product_description")),
        *[F.col(n) for n, _ in FROM_INCIDENT], *[_typed(joined, *f) for f in FEATURES], _typed(joined, "blocking_sources", "array<string>", "array()"), text("selection_reason"),
        dates.temporal_status(date("incident_date"), date("publication_date"), date("cpsc_recall_date"), "unknown").alias("temporal_status"),
        features.band(similarity, *SIMILARITY_BAND).alias("similarity_band"), features.band(jaccard, *JACCARD_BAND).alias("jaccard_band"),
        _typed(joined, "initial_label", "string", "'unlabeled'"), _typed(joined, "review_label", "string", "''"), _typed(joined, "reviewer_notes", "string", "''"),
    )
