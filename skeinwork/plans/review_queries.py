"""Named queries of review rows, blocking sensitivity and audits, with their SQL.

A line item is an incident, its order the recall, and the line with its part the candidate pair of the two."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocking, profile, ranking, review_rows, search
from ..sources import tables
from .registry import _POSTINGS, left_postings, query, right_texts, table

LIMITS = [50, 100, 250, 500, 1000, 2500, 5000, 10000]
_BY_LIMIT = f"""{_POSTINGS}, df AS (SELECT token, count(*) AS df FROM rp GROUP BY 1), r AS (SELECT left_id, right_id, min(df) AS rarest FROM met JOIN df USING (token) GROUP BY 1, 2 HAVING count(*) >= 2),
  lim AS (SELECT unnest({LIMITS}) AS df_limit), x AS (SELECT df_limit, left_id, count(*) AS n FROM r JOIN lim ON rarest <= df_limit GROUP BY 1, 2)"""


@query("blocking_sensitivity", f"""WITH {_BY_LIMIT}, every AS (SELECT df_limit, left_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT item_id AS left_id FROM benchmark) b CROSS JOIN lim LEFT JOIN x USING (df_limit, left_id)),
  s AS (SELECT *, row_number() OVER (PARTITION BY df_limit ORDER BY n) AS i, count(*) OVER (PARTITION BY df_limit) AS m FROM every)
  SELECT df_limit, count(*) FILTER (n > 0) AS left_rows, sum(n)::BIGINT AS pairs, min(n) AS least, (sum(n) FILTER (i = (m + 1) // 2) + sum(n) FILTER (i = m // 2 + 1))::BIGINT // 2 AS median, max(n) FILTER (i = 1 + round_even((m - 1) * 0.9::DOUBLE, 0)::BIGINT) AS p90, max(n) AS largest FROM s GROUP BY 1""")
def blocking_sensitivity(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("left_id")).distinct()
    # several passes look at the few counts, so pairs are made once for all of them
    per = tables.stored(blocking.candidates_by_limit(left_postings(spark, sf), right_texts(spark, sf), LIMITS), f"{tables.scratch(spark)}/by_limit")
    per = blocking.with_none(per, ids, LIMITS)
    d = ranking.distribution(per, "n", ["df_limit"])
    sums = per.groupBy("df_limit").agg(F.sum("n").alias("pairs"))
    return d.join(sums, "df_limit").select("df_limit", F.col("with_any").alias("left_rows"), "pairs", "least", F.floor("median").alias("median"), "p90", "largest")


@query("crowded_products", f"WITH {_BY_LIMIT}, k AS (SELECT *, row_number() OVER (PARTITION BY df_limit ORDER BY n DESC, left_id) AS rank FROM x WHERE n >= 500) SELECT df_limit, left_id, n, rank::INTEGER AS rank FROM k WHERE rank <= 10")
def crowded_products(spark, sf):
    return blocking.crowded_rows(blocking.candidates_by_limit(left_postings(spark, sf), right_texts(spark, sf), LIMITS))


_FAILS = "CASE WHEN ts IS NULL THEN 'no time' WHEN client_id IS NULL THEN 'no client' WHEN coalesce(kind, '') = '' THEN 'no kind' WHEN props IS NULL OR NOT (starts_with(props, '{') AND ends_with(props, '}')) THEN 'props are no object' END"


@query("click_audit", f"""WITH c AS (SELECT *, {_FAILS} AS reason FROM clicks), good AS (SELECT click_id, count(*) AS n FROM c WHERE reason IS NULL GROUP BY 1)
  SELECT 'total' AS part, 'observed' AS name, count(*) AS n, NULL::VARCHAR AS example FROM c UNION ALL SELECT 'total', 'accepted', count(*), NULL FROM c WHERE reason IS NULL UNION ALL SELECT 'total', 'failed', count(*), NULL FROM c WHERE reason IS NOT NULL
  UNION ALL SELECT 'total', 'missing value', count(*), NULL FROM c WHERE reason IS NULL AND value IS NULL UNION ALL SELECT 'total', 'missing arrived_at', count(*), NULL FROM c WHERE reason IS NULL AND arrived_at IS NULL
  UNION ALL SELECT 'total', 'distinct keys', count(*), NULL FROM good UNION ALL SELECT 'total', 'repeated keys', count(*), NULL FROM good WHERE n > 1
  UNION ALL SELECT 'failure', reason, count(*), min(click_id::VARCHAR) FROM c WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL (SELECT 'repeated', click_id::VARCHAR, n, NULL FROM good WHERE n > 1 ORDER BY n DESC, click_id LIMIT 20)""")
def click_audit(spark, sf):
    checks = {
        "no time": F.col("ts").isNotNull(), "no client": F.col("client_id").isNotNull(), "no kind": F.col("kind") != "",
        "props are no object": F.col("props").startswith("{") & F.col("props").endswith("}"),
    }
    return profile.failure_audit(table(spark, sf, "clicks"), "click_id", checks, ["value", "arrived_at"])


_PARTS = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS hazard, list_transform(string_split(p_name, ' '), lambda w: {'name': w, 'model': CASE WHEN length(w) % 2 = 0 THEN p_brand END, 'type': CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END}) AS products FROM part), i AS (SELECT unnest(products, recursive := true) FROM p)"


def _parts(spark, sf):
    """Parts as recalls whose products are the words of their names."""
    item = lambda w: F.struct(w.alias("name"), F.when(F.length(w) % 2 == 0, F.col("p_brand")).alias("model"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("type"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("hazard"), F.transform(F.split("p_name", " "), item).alias("products"))


@query("product_completeness", f"""WITH {_PARTS} SELECT 'row' AS level, 'hazard' AS field, count(*) AS n, count(*) FILTER (hazard <> '') AS present FROM p UNION ALL SELECT 'row', 'products', count(*), count(*) FILTER (len(products) > 0) FROM p
  UNION ALL SELECT 'item', 'name', count(*), count(*) FILTER (name <> '') FROM i UNION ALL SELECT 'item', 'model', count(*), count(*) FILTER (model <> '') FROM i UNION ALL SELECT 'item', 'type', count(*), count(*) FILTER (type <> '') FROM i""")
def product_completeness(spark, sf):
    return profile.nested_completeness(_parts(spark, sf), "products", ["hazard", "products"], ["name", "model", "type"])


@query("common_product_types", f"WITH {_PARTS} SELECT type, count(*) AS n FROM i WHERE type <> '' GROUP BY 1 ORDER BY n DESC, type LIMIT 25")
def common_product_types(spark, sf):
    items = _parts(spark, sf).select(F.explode("products").alias("i")).select("i.type").where("type <> ''")
    return profile.most_common(items, "type")


def _evidence(spark, sf, incidents_from: str = "true"):
    """Pairs with empty fields, their candidates, recalls and incidents, and how many pairs there are; incidents_from: the lines there are incidents of."""
    line = table(spark, sf, "lineitem")
    rows = line.count()
    iid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    ids = [F.col("l_orderkey").cast("string").alias(review_rows.RECALL), iid.alias(review_rows.INCIDENT)]
    dated = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(review_rows.RECALL), F.col("o_orderdate").cast("date").alias("cpsc_recall_date"))
    pairs = line.select(*ids, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("incident_brand"), "l_quantity", "l_discount")
    # dealt by the recall's id, so that recalls meet the pairs where orders have
    selected = tables.dealt(pairs, review_rows.RECALL, rows).join(tables.dealt(dated, review_rows.RECALL, rows), review_rows.RECALL).select(
        review_rows.RECALL, review_rows.INCIDENT, "cpsc_recall_date", "incident_brand", F.lit("by hand").alias("selection_reason"), F.lit(None).cast("date").alias("incident_date"),
        (F.col("l_quantity") / 50).alias("product_token_jaccard"), (F.col("l_discount") * 10).alias("product_name_sequence_similarity"),
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    shipped = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_shipdate").cast("date").alias("shipped"))
    # keys are numbers until the parts have joined, and texts after that
    candidates = shipped.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        *ids, F.col("p_brand").alias("incident_brand"), F.col("p_name").alias("incident_product_description"), F.array(F.lit("brand")).alias("blocking_sources"),
        F.col("shipped").alias("incident_date"), F.date_add("shipped", 30).alias("publication_date"),
    )
    recalls = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source_record_id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("url"))
    incidents = line.where(incidents_from).select(iid.alias("source_record_id"), F.col("l_linestatus").alias("product_category"))
    return selected, candidates, recalls, incidents, rows


_NULLS = {name: "NULL::VARCHAR" for name, _ in review_rows.FROM_RECALL + review_rows.FROM_INCIDENT}
_REVIEW = {
    "cpsc_source_record_id": "l_orderkey::VARCHAR", "cpsc_recall_number": "NULL::VARCHAR", "cpsc_recall_date": "strftime(o_orderdate, '%Y-%m-%d')", "cpsc_product_name": "NULL::VARCHAR",
    "saferproducts_source_record_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER)", "incident_date": "strftime(l_shipdate, '%Y-%m-%d')", "publication_date": "strftime(l_shipdate::DATE + 30, '%Y-%m-%d')",
    "incident_brand": "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE p_brand END", "incident_model": "NULL::VARCHAR", "incident_upc": "NULL::VARCHAR", "incident_product_description": "p_name",
    **_NULLS, "cpsc_title": "o_orderpriority", "incident_category": "l_linestatus",
    **{name: ("0::INTEGER" if kind == "int" else "0::DOUBLE") for name, kind, _ in review_rows.FEATURES}, "product_token_jaccard": "l_quantity / 50", "product_name_sequence_similarity": "l_discount * 10",
    "blocking_sources": "'brand'", "selection_reason": "'by hand'", "temporal_status": "CASE WHEN l_shipdate::DATE >= o_orderdate::DATE THEN 'incident_on_or_after_recall' WHEN l_shipdate::DATE + 30 >= o_orderdate::DATE THEN 'pre_incident_published_after_recall' ELSE 'pre_recall_public' END", "similarity_band": "CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END",
    "jaccard_band": "CASE WHEN l_quantity / 50 >= 0.4 THEN 'high' WHEN l_quantity / 50 >= 0.15 THEN 'medium' ELSE 'low' END", "initial_label": "'unlabeled'", "review_label": "''", "reviewer_notes": "''",
}
_JOINED = "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"


@query("review_rows", f"WITH k AS (SELECT row_number() OVER (ORDER BY concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER)) AS i, {', '.join(f'{e} AS {n}' for n, e in _REVIEW.items())} FROM {_JOINED}) SELECT 'ER-' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS review_id, {', '.join(_REVIEW)} FROM k")
def review_rows_query(spark, sf):
    joined = review_rows.join_in_ranges(*_evidence(spark, sf))
    rows = review_rows.review_rows([review_rows.whole(j) for j in joined], [F.col(review_rows.INCIDENT)])
    return rows.withColumn("blocking_sources", F.array_join("blocking_sources", ","))


@query("evidence_gaps", f"SELECT count(*) AS n_rows, 0::BIGINT AS missing_candidate, 0::BIGINT AS missing_recall, count(*) FILTER (l_quantity <= 5) AS missing_incident FROM {_JOINED}")
def evidence_gaps(spark, sf):
    return review_rows.gaps(review_rows.join_evidence(*_evidence(spark, sf, "l_quantity > 5")))


_REQUIRED = "l_orderkey::VARCHAR AS cpsc_source_record_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER) AS saferproducts_source_record_id"


@query("candidate_rows", f"SELECT {_REQUIRED}, NULL::VARCHAR AS cpsc_recall_number, NULL::VARCHAR AS cpsc_recall_date, NULL::VARCHAR AS cpsc_product_name, '' AS blocking_sources, l_returnflag = 'R' AS exact_upc, '' AS shared_product_tokens, l_linenumber::INTEGER AS shared_product_token_count, 0::DOUBLE AS product_token_jaccard, NULL::VARCHAR AS incident_date, NULL::VARCHAR AS publication_date, NULL::VARCHAR AS incident_brand, l_linestatus AS incident_model, NULL::VARCHAR AS incident_upc, NULL::VARCHAR AS incident_product_description FROM lineitem")
def candidate_rows(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(review_rows.RECALL), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias(review_rows.INCIDENT), F.when(F.col("l_returnflag") == "R", 1).alias("exact_upc"),
        F.col("l_linenumber").cast("string").alias("shared_product_token_count"), F.col("l_linestatus").alias("incident_model"), F.lit(1).alias("unused"),
    )
    return review_rows.candidate_rows(raw).withColumns({c: F.array_join(c, ",") for c in ("blocking_sources", "shared_product_tokens")})


@query("dispatched_search", """WITH f AS (SELECT s_nationkey AS query_id, 'first' AS kind, s_suppkey AS id, s_acctbal AS score FROM supplier WHERE s_acctbal > 9000),
  r AS (SELECT c_nationkey AS query_id, 'record' AS kind, c_custkey AS id, c_acctbal AS score FROM customer), p AS (SELECT c_nationkey AS query_id, 'product' AS kind, o_orderkey AS id, o_totalprice AS score FROM orders JOIN customer ON c_custkey = o_custkey),
  k AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id)::INTEGER AS place, id, score FROM (SELECT * FROM f UNION ALL SELECT * FROM r UNION ALL SELECT * FROM p))
  SELECT * FROM k WHERE (kind = 'first' AND place <= 12) OR (query_id NOT IN (SELECT query_id FROM f) AND ((kind = 'record' AND place <= 12) OR (kind = 'product' AND place <= 120)))""")
def dispatched_search(spark, sf):
    """A nation is a query; rich suppliers are the first backend's hits, customers the records and their orders the products."""
    c = table(spark, sf, "customer")
    first = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    records = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    orders = table(spark, sf, "orders").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return search.dispatch(first, records, orders.select(F.col("c_nationkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))


@query("search_term_forms", """WITH w AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS x FROM conversations)
  SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(replace(x, '"', ''), '\\s+'), lambda y: y <> ''), ' ') AS raw,
    array_to_string(list_slice(list_filter(string_split_regex(translate(x, '/-', '  '), '\\s+'), lambda y: length(y) >= 2), 1, 16), ' ') AS product,
    array_to_string(list_slice(list_filter(string_split_regex(translate(x, '/-', '  '), '\\s+'), lambda y: length(y) >= 3), 1, 12), ' ') AS incident FROM w""")
def search_term_forms(spark, sf):
    """The three forms of search terms: of records and reviews, of products, of incidents."""
    forms = {"raw": t.raw_terms(F.col("text")), "product": t.query_terms(F.col("text"), 2, 16), "incident": t.query_terms(F.col("text"), 3, 12)}
    return table(spark, sf, "conversations").select("conv_id", "turn", *[F.array_join(c, " ").alias(n) for n, c in forms.items()])
