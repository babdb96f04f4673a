"""Mentions, evidence rows, cases, timelines and findings; all cases of a frame come from one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as t

# Prefixes of evidence ids, names of sources, types of references and the patterns they are found by.
EVIDENCE_IDS = {"recall": "E-CPSC-", "incident": "E-SP-", "candidate": "E-AMZ-"}
SOURCES = {"recall": "CPSC", "incident": "SaferProducts.gov", "candidate": "Amazon Reviews 2023 metadata"}
REFERENCE_TYPES = {"id": "amazon_asin", "url": "marketplace_url"}
CATALOGUE_ID = r"(?i)(?:/dp/|/gp/product/)([A-Z0-9]{10})"
ADDRESS = r"""(?i)https?://[^\s\]")>]+"""
CATALOGUE_ADDRESS = "https://www.amazon.com/dp/"


def mentions(recalls: DataFrame) -> DataFrame:
    """One row for each product of each record, with its identifiers: the record's id and every code of it."""
    at = recalls.select("*", F.posexplode("products").alias("index", "product"))
    ident = F.concat(
        F.array(F.struct(F.lit("recall_id").alias("kind"), F.col("source_record_id").alias("value"))),
        F.transform(F.coalesce("product_upcs", F.array().cast("array<string>")), lambda u: F.struct(F.lit("upc").alias("kind"), u.alias("value"))),
    )
    return at.select(
        t.stable_id("pm", F.lit("recalls"), F.col("source_record_id"), F.col("index"), F.col("product.name"), F.col("product.model")).alias("mention_id"),
        "source_record_id", F.col("product.name").alias("name"), F.col("product.model").alias("model"), F.col("product.type").alias("category"), F.col("product.description").alias("description"),
        F.col("recall_date").cast("timestamp").alias("observed_at"), F.col("url").alias("source_url"),
        F.create_map(F.lit("category_id"), F.coalesce("product.category_id", F.lit("")), F.lit("reported_number_of_units"), F.coalesce("product.number_of_units", F.lit(""))).alias("attributes"),
        ident.alias("identifiers"),
    )


def evidence_rows(recalls: DataFrame) -> DataFrame:
    """Evidence of each record in one pass: itself, then its named hazards, injuries and remedies.

    Rows name a mention only where the record has exactly one product."""
    one = F.when(F.size("products") == 1, t.stable_id("pm", F.lit("recalls"), F.col("source_record_id"), F.lit(0), F.col("products")[0]["name"], F.col("products")[0]["model"]))
    text = F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("description", F.lit("")))
    row = lambda kind, i, body: F.struct(F.lit(kind).alias("evidence_type"), i.cast("int").alias("index"), body.alias("text"))
    names = lambda c, kind: F.transform(c, lambda x, i: row(kind, i, x))
    every = F.concat(
        F.array(row("recall", F.lit(0), text)), names(F.transform("hazards", lambda h: h["name"]), "hazard"), names(F.col("injuries"), "injury"), names(F.transform("remedies", lambda r: r["name"]), "remedy"),
    )
    rows = recalls.select("source_record_id", one.alias("product_mention_id"), F.explode(F.filter(every, lambda e: F.coalesce(e["text"], F.lit("")) != "")).alias("e"), F.col("recall_date").cast("timestamp").alias("published_at"))
    return rows.select(t.stable_id("ev", F.lit("recalls"), F.col("source_record_id"), F.col("e.evidence_type"), F.col("e.index")).alias("evidence_id"), "source_record_id", "e.evidence_type", "product_mention_id", "e.text", "published_at")


def dedupe_incidents(incidents: DataFrame, key: str, most: int = 20) -> DataFrame:
    """First of each incident of each case, then the earliest by publication and incident date."""
    from . import ranking

    first = ranking.keep_first(incidents, [key, "source_record_id"], ["publication_date", "incident_date"])
    return ranking.top_k(first, [key], [F.col("publication_date").asc_nulls_last(), F.col("incident_date").asc_nulls_last(), F.col("source_record_id")], most, "position")


def identity_status(label: Column, present: Column) -> Column:
    u = F.upper(F.coalesce(label, F.lit("")))
    return F.when(~present, "not_available").when(u == "MATCH", "working_match").when(u == "UNCERTAIN", "human_review_required").when(u == "NON_MATCH", "no_confirmed_match").otherwise("ranked_candidate_only")


#: Candidates of a case that are evidence.
SHOWN = 5


def cases(recalls: DataFrame, incidents: DataFrame, candidates: DataFrame, key: str = "recall_id", shown: int = SHOWN) -> DataFrame:
    """One nested row for each record: incidents, candidates, evidence, timeline, findings and derived signals.

    incidents: (key, source_record_id, incident_date, publication_date, title); candidates: (key, parent_asin, title,
    evidence_score, review_label). A case has all its incidents and candidates in one row; export_rows and timeline_rows give them as rows of their own.
    Findings and signals come from counts and the best candidate, so they need no lists. Both sides are aggregated before they are joined."""
    last = lambda *cs: F.struct(*[x for i, c in enumerate(cs) for x in (c.isNull().alias(f"m{i}"), c.alias(f"v{i}"))]).alias("order")
    inc = incidents.join(recalls.select(key, "recall_date"), key).withColumn("pre_recall", dates.pre_recall_public(F.col("incident_date"), F.col("publication_date"), F.col("recall_date")))
    inc_order = last(*map(F.col, ("publication_date", "incident_date", "source_record_id")))
    inc_rows = F.array_sort(F.collect_list(F.struct(inc_order, "publication_date", "incident_date", "source_record_id", "title", "pre_recall")))
    inc_rows = F.transform(inc_rows, lambda x: x.dropFields("order"))
    per_inc = inc.groupBy(key).agg(inc_rows.alias("incidents"), F.count_if("pre_recall").alias("n_pre"), F.min(F.when(F.col("pre_recall"), F.col("publication_date"))).alias("earliest_publication_date"))
    cand = F.struct(last(-F.col("evidence_score"), F.col("parent_asin")), "parent_asin", "title", "evidence_score", "review_label")
    per_cand = candidates.groupBy(key).agg(F.array_sort(F.collect_list(cand)).alias("candidates"), F.min(cand).alias("best"))
    joined = recalls.join(per_inc, key, "left").join(per_cand, key, "left").withColumn("n_pre", F.coalesce("n_pre", F.lit(0)))
    joined = joined.withColumn("incidents", F.coalesce("incidents", F.array().cast(dict(joined.dtypes)["incidents"]))).withColumn("candidates", F.coalesce("candidates", F.array().cast(dict(joined.dtypes)["candidates"])))
    rid = F.col(key).cast("string")
    item = lambda i, s, k, r, title, d: F.struct(i.alias("evidence_id"), F.lit(s).alias("source"), F.lit(k).alias("kind"), r.alias("record_id"), title.alias("title"), d.cast("string").alias("date"))
    evidence = F.concat(
        F.array(item(F.concat(F.lit(EVIDENCE_IDS["recall"]), rid), SOURCES["recall"], "official_recall", rid, F.col("title"), F.col("recall_date"))),
        F.transform("incidents", lambda x, i: item(F.concat(F.lit(EVIDENCE_IDS["incident"]), rid, F.lit("-"), (i + 1).cast("string")), SOURCES["incident"], "consumer_incident", x["source_record_id"].cast("string"), x["title"], F.coalesce(x["publication_date"], x["incident_date"]))),
        F.transform(F.slice("candidates", 1, shown), lambda x, i: item(F.concat(F.lit(EVIDENCE_IDS["candidate"]), rid, F.lit("-"), (i + 1).cast("string")), SOURCES["candidate"], "marketplace_identity", x["parent_asin"].cast("string"), x["title"], F.lit(None))),
    )
    point = lambda d, k, e, p: F.struct(F.coalesce(d.cast("string"), F.lit("9999-99-99")).alias("sort"), F.lit(k).alias("type"), d.cast("string").alias("date"), e.alias("evidence_id"), p.alias("pre_recall"))
    timeline = F.array_sort(F.concat(
        F.transform("incidents", lambda x, i: point(F.coalesce(x["publication_date"], x["incident_date"]), "consumer_incident", F.concat(F.lit(EVIDENCE_IDS["incident"]), rid, F.lit("-"), (i + 1).cast("string")), x["pre_recall"])),
        F.array(point(F.col("recall_date"), "official_recall", F.concat(F.lit(EVIDENCE_IDS["recall"]), rid), F.lit(False))),
    ))
    top, some = F.col("best"), F.col("best").isNotNull()
    lead = dates.lead_days(F.col("recall_date"), F.col("earliest_publication_date"))
    status = identity_status(top["review_label"], some)
    temporal = F.when(
        F.col("n_pre") > 0, F.concat(F.col("n_pre").cast("string"), F.lit(" incident record(s) were published before the recall; the earliest precedes it by "), lead.cast("string"), F.lit(" days.")),
    ).otherwise(F.lit("The linked records do not establish a signal before the recall."))
    identity = F.when(~some, F.lit(None)).when(
        top["evidence_score"] > 0, F.concat(F.coalesce(top["title"], top["parent_asin"].cast("string")), F.lit(" is the best available candidate (linkage score "), F.format_number(top["evidence_score"], 3), F.lit("); the score is no probability.")),
    ).otherwise(F.lit("The evidence does not support confirming a product; human review is required."))
    finding = lambda k, body: F.struct(F.lit(k).alias("type"), body.alias("text"))
    findings = F.filter(F.array(finding("identity", identity), finding("temporal_signal", temporal), finding("safety_boundary", F.lit("Linkage and temporal association establish no cause."))), lambda f: f["text"].isNotNull())
    signals = F.struct(
        status.alias("identity_status"), status.isin("human_review_required", "ranked_candidate_only", "no_confirmed_match").alias("human_review_required"),
        F.col("n_pre").alias("pre_recall_public_incident_count"), F.col("earliest_publication_date"), lead.alias("lead_time_days"),
    )
    return joined.select(key, "recall_date", "title", "incidents", "candidates", evidence.alias("evidence"), timeline.alias("timeline"), findings.alias("findings"), signals.alias("derived_signals"))


def brief(case_rows: DataFrame, key: str = "recall_id") -> DataFrame:
    """A deterministic text for each case: its title, then its findings."""
    lines = F.transform("findings", lambda f: F.concat(F.lit("- "), f["text"]))
    return case_rows.select(key, F.concat_ws("\n", F.concat(F.lit("Case "), F.col(key).cast("string"), F.lit(": "), F.coalesce("title", F.lit(""))), lines).alias("brief"))


def evidence_by_id(case_rows: DataFrame, evidence_id: str) -> DataFrame:
    return case_rows.select(F.explode("evidence").alias("e")).select("e.*").where(F.col("evidence_id") == evidence_id)


def _placed_incidents(recalls: DataFrame, incidents: DataFrame, key: str) -> DataFrame:
    """Incidents of the records with recall_date and `number`, the place in their case. A window's rows are spilled where they are many."""
    placed = incidents.join(recalls.select(key, "recall_date"), key)
    order = [F.col(c).asc_nulls_last() for c in ("publication_date", "incident_date", "source_record_id")]
    return placed.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def _evidence_id(kind: str, key: str, number: Column | None = None) -> Column:
    return F.concat(F.lit(EVIDENCE_IDS[kind]), F.col(key).cast("string"), *([] if number is None else [F.lit("-"), number.cast("string")]))


def timeline_rows(recalls: DataFrame, incidents: DataFrame, key: str = "recall_id") -> DataFrame:
    """Flat rows (key, n, type, date, evidence_id, pre_recall) of the timeline that `cases` has, n from 0, without a case being put together.
    pre_recall is null where dates are missing that decide it."""
    at = _placed_incidents(recalls, incidents, key)
    before = (F.col("incident_date") < F.col("recall_date")) & (F.col("publication_date") < F.col("recall_date"))
    told = at.select(key, F.lit("consumer_incident").alias("type"), F.coalesce("publication_date", "incident_date").alias("date"), "number", before.alias("pre_recall"))
    own = recalls.select(key, F.lit("official_recall").alias("type"), F.col("recall_date").alias("date"), F.lit(None).cast("int").alias("number"), F.lit(False).alias("pre_recall"))
    # ids are compared as texts; within a case and type they differ by their number alone, so they are made afterwards
    order = [F.col("date").asc_nulls_last(), F.col("type"), F.col("number").cast("string")]
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    ids = F.when(F.col("number").isNull(), _evidence_id("recall", key)).otherwise(_evidence_id("incident", key, F.col("number")))
    return told.union(own).withColumn("n", n).select(key, "n", "type", F.col("date").cast("string").alias("date"), ids.alias("evidence_id"), "pre_recall")


def export_rows(recalls: DataFrame, incidents: DataFrame, candidates: DataFrame, key: str = "recall_id", shown: int = SHOWN) -> DataFrame:
    """Flat rows (section, id, source, title, date, status, details) of the evidence that `cases` has and of all candidates, without a case
    being put together: no row grows with a case. Candidates of unknown records are there too."""
    row = lambda section, i, source, title, date, status, details: F.struct(F.lit(section).alias("section"), i.alias("id"), F.lit(source).alias("source"), title.alias("title"), date.cast("string").alias("date"), status.alias("status"), details.alias("details"))
    item = lambda kind, i, title, date, details: row("evidence", i, SOURCES[kind], title, date, F.lit(""), F.lit(details))
    own = item("recall", _evidence_id("recall", key), F.col("title"), F.col("recall_date"), "official_recall")
    told = item("incident", _evidence_id("incident", key, F.col("number")), F.col("title"), F.coalesce("publication_date", "incident_date"), "consumer_incident")
    placed = candidates.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(F.col("evidence_score").desc_nulls_last(), F.col("parent_asin").asc_nulls_last())))
    seen = item("candidate", _evidence_id("candidate", key, F.col("number")), F.col("title"), F.lit(None), "marketplace_identity")
    listed = row("candidate", F.col("parent_asin").cast("string"), "catalogue", F.col("title"), F.lit(""), F.coalesce("review_label", F.lit("")), F.concat(F.lit("score="), F.col("evidence_score").cast("string")))
    both = F.when(F.col("number") <= shown, F.array(listed, seen)).otherwise(F.array(listed))
    parts = recalls.select(key, own.alias("r")), _placed_incidents(recalls, incidents, key).select(key, told.alias("r")), placed.select(key, F.explode(both).alias("r"))
    return parts[0].union(parts[1]).union(parts[2]).select(key, "r.*")


def narrative_references(incidents: DataFrame, id_col: str, text: Column, host: str = "amazon.") -> DataFrame:
    """(source_record_id, type, value, url): catalogue ids and market addresses named in narratives, each value once."""
    rows = incidents.select(F.col(id_col).alias("source_record_id"), text.alias("t"))
    ids = F.transform(F.regexp_extract_all("t", F.lit(CATALOGUE_ID), F.lit(1)), lambda v: F.struct(F.lit(REFERENCE_TYPES["id"]).alias("type"), F.upper(v).alias("value"), F.concat(F.lit(CATALOGUE_ADDRESS), F.upper(v)).alias("url")))
    urls = F.transform(F.filter(F.regexp_extract_all("t", F.lit(ADDRESS), F.lit(0)), lambda u: F.contains(F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)), F.lit(host))), lambda u: F.struct(F.lit(REFERENCE_TYPES["url"]).alias("type"), u.alias("value"), u.alias("url")))
    named = F.when(F.contains(F.lower("t"), F.lit(host.rstrip("."))), urls).otherwise(F.array().cast("array<struct<type:string,value:string,url:string>>"))
    found = rows.select("source_record_id", F.explode(F.concat(ids, named)).alias("r")).select("source_record_id", "r.*")
    return found.groupBy("type", "value").agg(F.min("source_record_id").alias("source_record_id"), F.min("url").alias("url"))


def recall_number(query: Column) -> Column:
    """The first free-standing number of four to six digits."""
    return F.nullif(F.regexp_extract(query, r"(?i)\b(?:recall\s*(?:number|#)?\s*)?(\d{4,6})\b", 1), F.lit(""))
