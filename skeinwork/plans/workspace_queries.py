"""Named queries of the ranked answers, lookups, registries and audits, with their SQL.

Stand-ins as in the registry; a customer is a record whose incidents are the line items of their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocking, features, review, search, workspace
from ..sources import bucketed, keyed_state, normalize, search_index, sinks, uploads
from .registry import _BM, _CANDIDATES, _IDX, _INCIDENTS, _POSTINGS, _STATUS, _status, incidents, left_postings, left_side, query, right_postings, right_side, table

_OWNED = f"{_INCIDENTS}, own AS (SELECT o_custkey AS recall_id, inc.recall_id * 10 + line AS id, publication_date, incident_date FROM inc JOIN orders ON o_orderkey = inc.recall_id)"
_CAND = "cand AS (SELECT l_suppkey AS recall_id, l_partkey AS parent_asin, max(l_quantity) / 50 AS evidence_score FROM lineitem GROUP BY 1, 2)"


def _owned(spark, sf):
    """Line items as incidents of the customer whose order they are of."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    i = incidents(spark, sf)
    return i.join(o, i["recall_id"] == o["o_orderkey"]).select(F.col("o_custkey").alias("recall_id"), (i["recall_id"] * 10 + F.col("line")).alias("id"), "publication_date", "incident_date")


def _supplied(spark, sf):
    """Parts as candidates of their suppliers."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("recall_id"), F.col("l_partkey").alias("parent_asin")).agg((F.max("l_quantity") / 50).alias("evidence_score"))


for _name, _most in (("ranked_top_20", 20), ("ranked_top_10", 10), ("ranked_top_8", 8)):
    query(_name, f"WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY evidence_score DESC, parent_asin) AS rank FROM cand) SELECT recall_id, parent_asin, evidence_score, rank FROM k WHERE rank <= {_most}")(
        lambda spark, sf, most=_most: workspace.ranked(_supplied(spark, sf), "recall_id", most)
    )


@query("earliest_incidents", f"WITH {_OWNED}, k AS (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY publication_date NULLS FIRST, id) AS rank FROM own) SELECT recall_id, id, publication_date, rank FROM k WHERE rank <= 40")
def earliest_incidents(spark, sf):
    return workspace.earliest(_owned(spark, sf), "recall_id", "id").select("recall_id", "id", "publication_date", "rank")


@query("newest_records", "SELECT o_orderkey, o_orderdate::DATE AS dated FROM orders ORDER BY dated DESC NULLS LAST, o_orderkey LIMIT 25")
def newest_records(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dated"))
    return workspace.newest(o, "dated", "o_orderkey", 25)


@query("benchmark_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END NULLS LAST, o_orderkey) AS place FROM orders")
def benchmark_order(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("at"))
    return workspace.places_by_date(o, "at", "o_orderkey").select("o_orderkey", "place")


_UPLOADS = "u AS (SELECT doc_id AS upload_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, ceil(octet_length(encode(coalesce(text, ''))) / 1000)::BIGINT AS k FROM documents)"


def _uploads(spark, sf):
    """Documents as uploads in chunks of 1,000 bytes: of each seventh the second chunk has not come, of each eleventh the last has a byte too many."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("upload_id"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    sessions = d.select("upload_id", F.octet_length("b").cast("long").alias("size_bytes"), F.lit(1000).alias("chunk_size"))
    last = F.ceil(F.octet_length("b") / 1000).cast("int") - 1
    cut = d.where(F.octet_length("b") > 0).withColumn("last", last).select("upload_id", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_index"))
    data = F.substring("b", F.col("chunk_index") * 1000 + 1, F.lit(1000))
    longer = F.when((F.col("upload_id") % 11 == 0) & (F.col("chunk_index") == F.col("last")), F.concat(data, F.lit("x").cast("binary"))).otherwise(data)
    return sessions, cut.where(~((F.col("upload_id") % 7 == 0) & (F.col("chunk_index") == 1))).select("upload_id", "chunk_index", longer.alias("data"))


@query("upload_faults", f"""WITH {_UPLOADS} SELECT upload_id, 1::BIGINT AS chunk_index, 1::BIGINT AS last_index, 'missing' AS fault, NULL::BIGINT AS found, 1::BIGINT AS expected FROM u WHERE upload_id % 7 = 0 AND k >= 2
  UNION ALL SELECT upload_id, k - 1, k - 1, 'wrong size', n - 1000 * (k - 1) + 1, n - 1000 * (k - 1) FROM u WHERE upload_id % 11 = 0 AND k >= 1 AND NOT (upload_id % 7 = 0 AND k = 2)""")
def upload_faults(spark, sf):
    return uploads.faults(*_uploads(spark, sf))


@query("upload_pieces", f"""WITH {_UPLOADS}, p AS (SELECT upload_id, b, unnest(range(0, greatest(1, ceil(n / 4000)::BIGINT))) AS piece FROM u WHERE NOT (upload_id % 7 = 0 AND k >= 2) AND NOT (upload_id % 11 = 0 AND k >= 1))
  SELECT upload_id, piece, piece * 4000 AS "offset", sha256(b[piece * 4000 + 1:piece * 4000 + 4000]) AS digest FROM p""")
def upload_pieces(spark, sf):
    return uploads.assembled(*_uploads(spark, sf), 4000).select("upload_id", "piece", "offset", F.sha2("data", 256).alias("digest"))


_BATCHED = "SELECT client_id, change_id, change_id % 2 AS batch FROM client_changes"


@query("bucketed_upsert", f"WITH x AS ({_BATCHED}), k AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY batch DESC, change_id DESC) AS i FROM x) SELECT client_id, change_id FROM k WHERE i = 1")
def bucketed_upsert(spark, sf):
    """Changes of even number are one batch, those of odd number the next; the last change of each client stays."""
    root, c = sinks.scratch(spark), table(spark, sf, "client_changes").select("client_id", "change_id")
    for number in (0, 1):
        bucketed.upsert(c.where(F.col("change_id") % 2 == number), root, ["client_id"], "change_id", number)
    return bucketed.read(spark, root).select("client_id", "change_id")


@query("state_after_two_writers", """WITH a AS (SELECT client_id, change_id, row_number() OVER (PARTITION BY client_id ORDER BY change_id) AS i FROM client_changes WHERE client_id IS NOT NULL AND change_id % 2 = 0),
  b AS (SELECT client_id, change_id, row_number() OVER (PARTITION BY client_id ORDER BY change_id) AS i FROM client_changes WHERE client_id IS NOT NULL AND change_id % 2 = 1 AND client_id NOT IN (SELECT client_id FROM a))
  SELECT client_id::VARCHAR AS key, 1::BIGINT AS version, change_id::VARCHAR AS value FROM a WHERE i = 1 UNION ALL SELECT client_id::VARCHAR, 1, change_id::VARCHAR FROM b WHERE i = 1""")
def state_after_two_writers(spark, sf):
    """Two writers that have seen no entry of any client: what the first has written refuses the second's."""
    root = sinks.scratch(spark)
    c = table(spark, sf, "client_changes").where("client_id is not null and change_id is not null")
    for writer in (0, 1):
        mine = c.where(F.col("change_id") % 2 == writer)
        keyed_state.put(mine.select(F.col("client_id").alias("key"), F.lit(0).alias("expected"), F.col("change_id").alias("value"), F.timestamp_seconds(F.col("change_id")).alias("at")), root)
    return keyed_state.state(spark, root).select("key", "version", "value")


@query("user_history", "WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rank FROM events) SELECT * FROM k WHERE rank <= 20")
def user_history(spark, sf):
    return workspace.history(table(spark, sf, "events").select("user_id", "event_id", "ts"), "ts", "event_id", ["user_id"]).select("user_id", "event_id", "rank")


_TERMS = "SELECT item_id, unnest(list_filter(string_split(translate(lower(text), '/-', '  '), ' '), lambda x: length(x) >= 3)[1:12]) AS term FROM (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark)"
_NUMBER = "CASE WHEN doc_id % 30 = 0 THEN doc_id // 30 END"


@query("incident_lookup", f"""WITH q0 AS ({_TERMS}), direct AS (SELECT {_NUMBER} AS item_id, doc_id, row_number() OVER (PARTITION BY {_NUMBER} ORDER BY n_chars NULLS FIRST, doc_id) AS rank FROM documents WHERE {_NUMBER} IN (SELECT item_id FROM benchmark)),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(term, '[a-z0-9]+')) AS token FROM q0 WHERE item_id NOT IN (SELECT item_id FROM direct)), {_IDX}, {_BM},
  f AS (SELECT query_id AS item_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)
  SELECT item_id, doc_id, rank, 'record_number' AS how FROM direct WHERE rank <= 40 UNION ALL SELECT item_id, doc_id, rank, 'search' FROM f WHERE rank <= 40""")
def incident_lookup(spark, sf):
    """Every thirtieth document names a benchmark item by number; items that none names are searched by their first terms."""
    d = table(spark, sf, "documents").withColumn("item_id", F.when(F.col("doc_id") % 30 == 0, (F.col("doc_id") / 30).cast("long")))
    return workspace.incidents_of(table(spark, sf, "benchmark"), d, "item_id", "text", "doc_id", ["text"], at="n_chars")


@query("product_hits", f"""WITH q0 AS (SELECT DISTINCT p_brand || ' ' || p_name AS name, unnest([lower(p_brand), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS term FROM part),
  q AS (SELECT DISTINCT name AS query_id, unnest(regexp_extract_all(term, '[a-z0-9]+')) AS token FROM q0), w AS (SELECT p_partkey AS doc_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS token FROM part),
  ln AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), tot AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM ln), tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT token, count(*) AS n FROM tf GROUP BY 1), {_BM},
  k AS (SELECT query_id AS name, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) SELECT name, doc_id AS p_partkey, rank, p_type FROM k JOIN part ON p_partkey = doc_id WHERE rank <= 5""")
def product_hits(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    root = sinks.scratch(spark)
    classes, members = search.alike(p, "p_partkey", ["p_name", "p_brand"])
    search_index.write(classes, root, "p_partkey", ["text"], "1", copies="copies")
    hits = workspace.searched_index(names, "name", F.col("name"), search_index.Index(spark, root), "p_partkey", workspace.PRODUCT_TERMS, 5, members)
    return workspace.hit_rows(hits, p.select("p_partkey", "p_type"), "p_partkey").select("name", "p_partkey", "rank", "p_type")


@query("indexed_search", f"""WITH q0 AS ({_TERMS}), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(term, '[a-z0-9]+')) AS token FROM q0), {_IDX}, {_BM},
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 20""")
def indexed_search(spark, sf):
    """The best 20 documents of each benchmark item from a stored index with block maxima."""
    root = sinks.scratch(spark)
    search_index.write(table(spark, sf, "documents").select("doc_id", "text"), root, "doc_id", ["text"], "1")
    terms = workspace.search_terms(table(spark, sf, "benchmark"), "item_id", F.col("text"), *workspace.INCIDENT_TERMS)
    return search_index.Index(spark, root).best(terms, 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("two_stage_candidates")
def two_stage_candidates(spark, sf):
    """Suppliers of even number have supplied candidates; for the others parts are searched by a name like theirs."""
    s = table(spark, sf, "supplier")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("parent_asin"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.concat(F.lit("9"), F.col("p_partkey").cast("string")).alias("upc"))
    like = p.select(F.col("parent_asin").alias("s_suppkey"), F.concat_ws(" ", "title", "model").alias("name"), "brand", "model", "upc")
    records = s.select("s_suppkey").join(like, "s_suppkey")
    even = _supplied(spark, sf).where("recall_id % 2 = 0").select(
        F.col("recall_id").alias("s_suppkey"), "parent_asin", (F.col("parent_asin") % 4).cast("int").alias("shared"), "evidence_score", F.lit(0.25).alias("jaccard"), F.col("evidence_score").alias("sequence"), (F.col("parent_asin") % 50 == 0).alias("exact"), (F.col("parent_asin") % 3 == 0).alias("brand_in_name"), F.lit("m").alias("model"),
    )
    return workspace.candidates_of(records, even.drop("evidence_score"), p, "s_suppkey", ["title", "brand", "model"]).withColumn("evidence", F.array_join("evidence", "; "))


@query("bundle_list", "SELECT c_custkey AS bundle_id, c_acctbal AS imported_at, count(o_orderkey) AS dataset_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY imported_at DESC NULLS LAST, bundle_id LIMIT 20")
def bundle_list(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("bundle_id"), F.col("c_acctbal").alias("imported_at"))
    return workspace.bundle_list(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("dataset_id")))


@query("has_data", "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) > 0 AS has_data")
def has_data(spark, sf):
    return workspace.has_data(part=table(spark, sf, "part"), orders=table(spark, sf, "orders"))


@query("valid_reviews", "SELECT p_partkey AS parent_asin, p_size AS recall_id FROM part WHERE (p_size, p_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem)")
def valid_reviews(spark, sf):
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("parent_asin"), F.col("p_size").cast("long").alias("recall_id"))
    return workspace.valid_reviews(r, _supplied(spark, sf), "recall_id").select("parent_asin", F.col("recall_id").cast("int").alias("recall_id"))


@query("case_review_counts", f"WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY evidence_score DESC, parent_asin) AS rank FROM cand), r AS (SELECT l_partkey AS parent_asin, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT recall_id, k.parent_asin, rank, least(coalesce(n, 0), 100)::BIGINT AS reviews FROM k LEFT JOIN r USING (parent_asin) WHERE rank <= 10")
def case_review_counts(spark, sf):
    """Returned line items as reviews of their part."""
    reviews = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("parent_asin"))
    return workspace.review_counts(_supplied(spark, sf), reviews, "recall_id")


@query("provider_chain", "SELECT doc_id, 'labels' AS provider FROM labels UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'documents' FROM documents WHERE coalesce(lang <> 'en', true) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def provider_chain(spark, sf):
    d = table(spark, sf, "documents")
    return workspace.chain("doc_id", labels=table(spark, sf, "labels").select("doc_id"), english=d.where("lang = 'en'").select("doc_id"), documents=d.select("doc_id"))


@query("first_artifact_record", "WITH k AS (SELECT p_name, p_brand, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS i FROM part) SELECT p_name, p_brand, p_partkey FROM k WHERE i = 1")
def first_artifact_record(spark, sf):
    return workspace.first_record(table(spark, sf, "part").select("p_name", "p_brand", "p_partkey"), "p_name", "p_brand", "p_partkey")


_SCORED = "SELECT l_suppkey AS recall_id, l_partkey AS parent_asin, max(l_quantity) AS evidence_score FROM lineitem WHERE {} GROUP BY 1, 2"


@query("artifact_candidates", f"""WITH a AS ({_SCORED.format("l_returnflag = 'R' AND l_linenumber > 5")}), g AS ({_SCORED.format("l_returnflag = 'A'")}), u AS (SELECT * FROM a UNION ALL SELECT * FROM g WHERE recall_id NOT IN (SELECT recall_id FROM a)),
  k AS (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY evidence_score DESC, parent_asin) AS rank FROM u) SELECT * FROM k WHERE rank <= 10""")
def artifact_candidates(spark, sf):
    line = table(spark, sf, "lineitem")
    scored = lambda d: d.groupBy(F.col("l_suppkey").alias("recall_id"), F.col("l_partkey").alias("parent_asin")).agg(F.max("l_quantity").alias("evidence_score"))
    return workspace.artifact_candidates(scored(line.where("l_returnflag = 'R' and l_linenumber > 5")), scored(line.where("l_returnflag = 'A'")), "recall_id")


@query("preferred_artifacts", "WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus, min(l_linestatus) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) SELECT l_orderkey, l_linenumber, l_linestatus FROM x WHERE l_linestatus = best")
def preferred_artifacts(spark, sf):
    return workspace.preferred(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_orderkey", "l_linestatus")


@query("demo_cases", f"""WITH {_OWNED}, {_CAND}, c AS (SELECT DISTINCT recall_id FROM cand WHERE recall_id IN (SELECT recall_id FROM own) ORDER BY CASE recall_id WHEN 17 THEN 1 WHEN 4 THEN 2 ELSE 3 END, recall_id LIMIT 3),
  k AS (SELECT recall_id, 'candidate' AS section, parent_asin AS id, row_number() OVER (PARTITION BY recall_id ORDER BY evidence_score DESC, parent_asin) AS rank FROM cand JOIN c USING (recall_id)),
  n AS (SELECT recall_id, 'incident', id, row_number() OVER (PARTITION BY recall_id ORDER BY publication_date NULLS FIRST, id) AS rank FROM own JOIN c USING (recall_id)) SELECT * FROM k WHERE rank <= 8 UNION ALL SELECT * FROM n WHERE rank <= 20""".replace("SELECT DISTINCT recall_id FROM cand WHERE", "SELECT recall_id FROM (SELECT DISTINCT recall_id FROM cand) WHERE"))
def demo_cases(spark, sf):
    c, i = workspace.demo_cases(_supplied(spark, sf), _owned(spark, sf), "recall_id", [17, 4], "id")
    return c.select("recall_id", F.lit("candidate").alias("section"), F.col("parent_asin").alias("id"), "rank").union(i.select("recall_id", F.lit("incident"), "id", "rank"))


@query("token_histograms", f"WITH {_POSTINGS}, h AS (SELECT left_id, shared, count(*) AS n FROM pairs GROUP BY 1, 2) SELECT left_id, sum(n)::BIGINT AS candidate_count, string_agg(shared || ':' || n, ',' ORDER BY shared) AS shared_token_histogram, max(shared) AS max_shared_tokens FROM h GROUP BY 1")
def token_histograms(spark, sf):
    h = workspace.token_histograms(blocking.token_overlap(left_postings(spark, sf), right_postings(spark, sf), 1), ["left_id"])
    return h.withColumn("shared_token_histogram", F.array_join(F.transform("shared_token_histogram", lambda x: F.concat_ws(":", x["shared"].cast("string"), x["n"].cast("string"))), ","))


@query("bucket_enrichment", "WITH x AS (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS candidate_bucket_size FROM orders) SELECT *, CASE WHEN candidate_bucket_size <= 5 THEN 'small_bucket' WHEN candidate_bucket_size <= 50 THEN 'medium_bucket' ELSE 'large_bucket' END AS bucket_band FROM x")
def bucket_enrichment(spark, sf):
    return workspace.with_bucket(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("review_distributions", f"WITH {_INCIDENTS}, r AS (SELECT recall_id, {_STATUS} AS status, (line % 3)::VARCHAR AS band FROM inc) SELECT 'status' AS field, status AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'max_rows_per_group', NULL, max(n) FROM (SELECT count(*) AS n FROM r GROUP BY recall_id)")
def review_distributions(spark, sf):
    r = incidents(spark, sf).select("recall_id", _status().alias("status"), (F.col("line") % 3).cast("string").alias("band"))
    return workspace.review_distributions(r, "recall_id", ["status", "band"])


@query("strategy_samples", f"""WITH {_POSTINGS}, df AS (SELECT token, count(*) AS df FROM rp GROUP BY 1), rk AS (SELECT left_id, token, df, row_number() OVER (PARTITION BY left_id ORDER BY df, token) AS rank FROM lp JOIN df USING (token)),
  tk AS (SELECT left_id, string_agg(token || '=' || df, ',' ORDER BY rank) AS rarest FROM rk WHERE rank <= 5 GROUP BY 1), c AS (SELECT left_id, count(*) FILTER (shared >= 2) AS two, count(*) FILTER (shared >= 3) AS three FROM pairs GROUP BY 1)
  SELECT item_id AS left_id, rarest, coalesce(two, 0) AS two, coalesce(three, 0) AS three FROM (SELECT item_id FROM benchmark ORDER BY 1 LIMIT 30) LEFT JOIN tk ON tk.left_id = item_id LEFT JOIN c ON c.left_id = item_id""")
def strategy_samples(spark, sf):
    left, right = left_postings(spark, sf), right_postings(spark, sf)
    pairs = blocking.token_overlap(left, right, 2)
    s = workspace.strategy_samples(table(spark, sf, "benchmark").select(F.col("item_id").alias("left_id")), "left_id", blocking.rarest_tokens(left, right, 5), {"two": pairs, "three": pairs.where("shared >= 3")})
    return s.withColumn("rarest", F.array_join(F.transform("rarest_tokens", lambda x: F.concat_ws("=", x["token"], x["df"].cast("string"))), ",")).drop("rarest_tokens")


@query("labelled_predictions", "SELECT d.doc_id, n_chars::DOUBLE / 1000 AS oof_probability, quality AS target FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def labelled_predictions(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", (F.col("n_chars").cast("double") / 1000).alias("oof_probability"), F.lit(-1).alias("target"))
    return workspace.with_labels(p, table(spark, sf, "labels").withColumnRenamed("quality", "target"), "doc_id")


_RULED = "x AS (SELECT l_linenumber % 5 AS fold, (l_returnflag = 'R')::INTEGER AS target, l_quantity > 25 AS long, l_discount >= 0.05 OR l_tax > 0.06 AS cheap FROM lineitem), r AS (SELECT fold, target, 'long' AS rule, long AS hit FROM x UNION ALL SELECT fold, target, 'cheap', cheap FROM x), c AS (SELECT rule, fold, count(*) FILTER (target = 1 AND hit) AS tp, count(*) FILTER (target = 0 AND hit) AS fp, count(*) FILTER (target = 0 AND NOT hit) AS tn, count(*) FILTER (target = 1 AND NOT hit) AS fn FROM r GROUP BY 1, 2)"


@query("rule_baselines", f"WITH {_RULED} SELECT rule, fold, tp, fp, tn, fn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall FROM c")
def rule_baselines(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 5).alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("target"), "l_quantity", "l_discount", "l_tax")
    out = workspace.rule_baselines(line, "target", {"long": F.col("l_quantity") > 25, "cheap": (F.col("l_discount") >= 0.05) | (F.col("l_tax") > 0.06)})
    return out.select("rule", "fold", "tp", "fp", "tn", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("link_export", "SELECT c_custkey AS left_id, o_orderkey AS right_id, c_name AS left_c_name, o_orderdate::DATE AS right_at FROM customer JOIN orders ON o_custkey = c_custkey")
def link_export(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = lambda d, i, k: d.select(F.col(i).alias("left_id" if i == "c_custkey" else "right_id"), F.col(k).cast("string").alias("key"))
    links = blocking.exact_key_links(key(c, "c_custkey", "c_custkey"), key(o, "o_orderkey", "o_custkey"))
    return workspace.link_export(links, c.select(F.col("c_custkey").alias("left_id"), "c_name"), o.select(F.col("o_orderkey").alias("right_id"), F.col("o_orderdate").cast("date").alias("at")))


@query("case_totals", "SELECT (SELECT count(*) FROM customer) AS cases, (SELECT count(*) FROM orders) AS incidents")
def case_totals(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("incidents"))
    return workspace.totals(table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left"), ["incidents"])


@query("decisions_allowed", "SELECT user_id, event_type FROM events WHERE (user_id % 2 = 0 AND event_type IN ('view', 'click')) OR (user_id % 2 = 1 AND event_type = 'view')")
def decisions_allowed(spark, sf):
    grants = spark.createDataFrame([("0", "view"), ("0", "click"), ("1", "view")], "role string, action string")
    e = table(spark, sf, "events").select("user_id", "event_type", (F.col("user_id") % 2).cast("string").alias("role"), F.col("event_type").alias("action"))
    return review.allowed(e, grants).select("user_id", "event_type")


@query("category_candidates", f"""WITH {_POSTINGS}, {_CANDIDATES}, df AS (SELECT lang, token, count(*) AS df FROM rp GROUP BY 1, 2), hit AS (SELECT DISTINCT left_id, right_id FROM met JOIN rp USING (right_id, token) JOIN df USING (lang, token) WHERE df <= 250),
  u AS (SELECT left_id, right_id, 1 AS e, 0 AS l FROM keyed UNION ALL SELECT left_id, right_id, 0, 1 FROM pairs JOIN hit USING (left_id, right_id) WHERE shared >= 2), g AS (SELECT left_id, right_id, max(e) AS e, max(l) AS l FROM u GROUP BY 1, 2)
  SELECT g.left_id, g.right_id, concat_ws(',', CASE WHEN e = 1 THEN 'exact_upc' END, CASE WHEN l = 1 THEN 'two_tokens_plus_category_rare_token' END) AS blocking_sources, e AS exact_upc, coalesce(shared, 0)::INTEGER AS shared_product_token_count,
    round(coalesce(shared::DOUBLE / (nl.n + nr.n - shared), 0.0), 9) AS product_token_jaccard FROM g LEFT JOIN pairs USING (left_id, right_id) LEFT JOIN nl USING (left_id) LEFT JOIN nr USING (right_id)""")
def category_candidates(spark, sf):
    left = left_side(spark, sf).select("left_id", "tokens", F.array(F.md5("text")).alias("keys"))
    right = right_side(spark, sf).select("right_id", F.col("lang").alias("category"), "tokens", F.md5("text").alias("key"))
    out = blocking.category_candidates(left, right)
    return out.select("left_id", "right_id", F.array_join("blocking_sources", ",").alias("blocking_sources"), "exact_upc", "shared_product_token_count", F.round("product_token_jaccard", 9).alias("product_token_jaccard"))


_SHOWN = "x AS (SELECT p_partkey::VARCHAR AS parent_asin, CASE WHEN p_size % 2 = 0 THEN trim(p_name) ELSE trim(p_type) END AS title, (p_size % 10 = 0)::INTEGER AS ex, (p_size % 5) * 2 AS sh, (p_size % 20)::DOUBLE / 20 AS j, (p_partkey % 100)::DOUBLE / 100 AS sq, p_size % 3 = 0 AS br FROM part)"


@query("shown_candidates", f"""WITH {_SHOWN}, y AS (SELECT *, CASE WHEN ex = 1 THEN 1.0::DOUBLE ELSE least(0.58::DOUBLE * least(sh::DOUBLE / 8, 1.0::DOUBLE) + 0.22::DOUBLE * j + 0.12::DOUBLE * sq + 0.08::DOUBLE * br::INTEGER, 1.0::DOUBLE) END AS score FROM x)
  SELECT parent_asin, title, '' AS brand, round(score, 3) AS score, concat_ws('; ', CASE WHEN ex = 1 THEN 'Exact UPC agreement' END, CASE WHEN br THEN 'Brand aligns with recall product' END, CASE WHEN sh >= 2 THEN sh || ' shared product-name tokens' END, CASE WHEN sq >= 0.7 THEN 'High title similarity' END) AS evidence FROM y""")
def shown_candidates(spark, sf):
    """Rows of two artifacts, one naming its columns in full: titles come from the full name first."""
    p = table(spark, sf, "part")
    raw = p.select(
        F.col("p_partkey").cast("string").alias("asin"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("amazon_title"), F.col("p_type").alias("title"),
        F.when(F.col("p_size") % 10 == 0, "1.0").otherwise("").alias("exact_upc"), (F.col("p_size") % 5 * 2).cast("string").alias("shared_product_token_count"), ((F.col("p_size") % 20) / 20).alias("product_token_jaccard"),
        ((F.col("p_partkey") % 100) / 100).alias("product_name_sequence_similarity"), F.when(F.col("p_size") % 3 == 0, features.BRAND_IN_NAME).otherwise("other").alias("brand_relation"),
    )
    out = features.shown(normalize.view(raw, "candidate"))
    return out.select("parent_asin", "title", "brand", F.col("evidence_score").alias("score"), F.array_join("evidence", "; ").alias("evidence"))


@query("artifact_incidents", "SELECT event_id::VARCHAR AS source_record_id, strftime(ts, '%Y-%m-%d') AS incident_date, event_type AS brand, '' AS model FROM events")
def artifact_incidents(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("source_record_id"), F.date_format("ts", "yyyy-MM-dd").alias("incident_date"), F.concat(F.lit(" "), "event_type").alias("product_brand"))
    return normalize.view(e, "incident").select("source_record_id", "incident_date", "brand", "model")
