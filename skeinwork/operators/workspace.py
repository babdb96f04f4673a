"""Ranked and limited answers, two-stage lookups, registries, artifact lookups and audits of candidate files.

Limits are the features here: an answer shows the best 20 candidates or the 40 earliest incidents of each record. All
records of a frame are answered by one job; a fallback searches only for the records that the first stage left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import evaluate, features, ranking, search

#: Candidates shown, shown of artifacts and of demo cases; incidents shown; history entries kept.
CANDIDATES, ARTIFACT_CANDIDATES, DEMO_CANDIDATES = 20, 10, 8
INCIDENTS, DEMO_INCIDENTS, HISTORY = 40, 20, 20
#: Search terms of an incident and of a product query: least length and number; products that a search gives.
INCIDENT_TERMS, PRODUCT_TERMS, SEARCHED = (3, 12), (2, 16), 300


def ranked(candidates: DataFrame, key: str, most: int = CANDIDATES, score: str = "evidence_score", tie: str = "parent_asin") -> DataFrame:
    """The best candidates of each record, ties by id, with their rank."""
    return ranking.top_k(candidates, [key], [F.col(score).desc(), F.col(tie)], most)


def earliest(incidents: DataFrame, key: str, tie: str, most: int = INCIDENTS, at: str = "publication_date") -> DataFrame:
    """The incidents of each record published first; those without a date come before."""
    return ranking.top_k(incidents, [key], [F.col(at).asc_nulls_first(), F.col(tie)], most)


def newest(rows: DataFrame, at: str, tie: str, most: int = HISTORY) -> DataFrame:
    return rows.orderBy(F.col(at).desc_nulls_last(), tie).limit(most)


def by_date_then_id(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """Dated rows in order, undated ones last."""
    return rows.orderBy(F.col(at).asc_nulls_last(), tie)


def places_by_date(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """rows with their place in that order, over all of them."""
    return ranking.row_numbers(rows, [F.col(at).asc_nulls_last(), F.col(tie)], "place")


def search_terms(records: DataFrame, key: str, name: Column, least: int, most: int) -> DataFrame:
    """(query_id, token): tokens of the first `most` terms of `least` characters."""
    terms = records.select(F.col(key).alias("query_id"), F.explode(t.query_terms(name, least, most)).alias("term"))
    return terms.select("query_id", F.explode(F.regexp_extract_all("term", F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).distinct()


def searched(records: DataFrame, key: str, name: Column, docs: DataFrame, id_col: str, fields: list[str], terms: tuple[int, int], most: int, fold: bool = False) -> DataFrame:
    """(key, id_col, rank): the best hits of each record's name; scores count to the sixth place, ties by id.

    Records of one name are one search. fold: documents that read the same are met as one, which is for short texts."""
    named = records.select(key, name.alias("query_id"))
    asked = search_terms(named.select("query_id").distinct(), "query_id", F.col("query_id"), *terms)
    if fold:
        classes, members = search.alike(docs, id_col, fields)
        best = search.of_members(search.best_scores(search.bm25(asked, classes, id_col, ["text"], copies="copies"), most), members, most)
    else:
        best = search.best_scores(search.bm25(asked, docs, id_col, fields), most)
    return named.join(best, "query_id").select(key, F.col("doc_id").alias(id_col), "rank")


def searched_index(records: DataFrame, key: str, name: Column, index, id_col: str, terms: tuple[int, int], most: int, members: DataFrame | None = None) -> DataFrame:
    """The same from a stored index (sources.search_index.Index), of which only what can enter the answer is read; members: where it holds
    classes of search.alike."""
    best = index.best(search_terms(records, key, name, *terms), most)
    best = best if members is None else search.of_members(best, members, most)
    return best.select(F.col("query_id").alias(key), F.col("doc_id").alias(id_col), "rank")


def hit_rows(hits: DataFrame, base: DataFrame, id_col: str) -> DataFrame:
    """Hits with the rows that they stand for."""
    return hits.join(base, id_col)


def incidents_of(records: DataFrame, incidents: DataFrame, key: str, name: str, id_col: str, fields: list[str], at: str = "publication_date") -> DataFrame:
    """(key, id_col, rank, how): the incidents that name the record, or else those that a search for its name finds."""
    direct = earliest(incidents.join(records.select(key).distinct(), key, "left_semi"), key, id_col, at=at).select(key, id_col, "rank", F.lit("record_number").alias("how"))
    rest = records.join(direct.select(key).distinct(), key, "left_anti")
    found = searched(rest, key, F.col(name), incidents, id_col, fields, INCIDENT_TERMS, INCIDENTS).withColumn("how", F.lit("search"))
    return direct.unionByName(found)


def candidates_of(records: DataFrame, supplied: DataFrame, products: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, parent_asin, evidence_score, evidence, exact, how, rank): ranked candidates of each record.

    records: (key, name, brand, model, upc); supplied: (key, parent_asin, shared, jaccard, sequence, exact, brand_in_name,
    model); products: (parent_asin, title, brand, model, upc). Records with supplied candidates have these scored anew; for
    the others products of the same code and those that a search finds are scored, if they agree enough."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    names = records.withColumn("__lt", t.tokens(F.col("name"), "workspace"))
    own = supplied.drop("name", "__lt").join(names.select(key, "__lt"), key)
    own_model = text("model") != ""
    first = own.select(
        key, "parent_asin", F.round(features.supplied_score(F.col("shared"), F.size("__lt"), F.col("jaccard"), F.col("sequence"), F.col("brand_in_name"), F.col("exact")), 3).alias("evidence_score"),
        features.supplied_reasons(F.col("exact"), F.col("brand_in_name"), F.col("shared"), F.col("sequence"), own_model).alias("evidence"), "exact", F.lit("supplied").alias("how"),
    )
    rest = names.join(supplied.select(key).distinct(), key, "left_anti")
    p = products.select("parent_asin", "title", F.col("brand").alias("__brand"), F.col("model").alias("__model"), F.col("upc").alias("__upc"))
    coded = rest.where(text("upc") != "").select(key, text("upc").alias("__upc")).join(p.select("parent_asin", "__upc"), "__upc")
    coded = ranking.top_k(coded, [key], [F.col("parent_asin")], CANDIDATES).select(key, "parent_asin").withColumn("exact", F.lit(True))
    named = rest.where(F.size("__lt") > 0)
    found = searched(named, key, F.col("name"), products, "parent_asin", fields, PRODUCT_TERMS, SEARCHED, fold=True).select(key, "parent_asin").join(coded.select(key, "parent_asin"), [key, "parent_asin"], "left_anti")
    pairs = coded.unionByName(found.withColumn("exact", F.lit(False))).join(rest, key).join(p, "parent_asin")
    norm = lambda c: t.normalize_lower(F.col(c))
    rt = t.tokens(F.col("title"), "workspace")
    pairs = pairs.withColumns({
        "__shared": t.shared(F.col("__lt"), rt), "__j": t.jaccard(F.col("__lt"), rt), "__b": (text("brand") != "") & (norm("brand") == norm("__brand")), "__m": (text("model") != "") & (norm("model") == norm("__model")),
        "__s": t.sequence_similarity(norm("name"), norm("title"), None),
    })
    fits = pairs.where(F.col("exact") | features.acceptable(F.col("__shared"), F.col("__s"), F.coalesce("__b", F.lit(False))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    second = fits.select(
        key, "parent_asin", F.round(features.generated_score(F.col("exact"), F.col("__shared"), F.size("__lt"), F.col("__j"), F.col("__s"), flag("__b"), flag("__m")), 3).alias("evidence_score"),
        features.generated_reasons(F.col("exact"), flag("__b"), flag("__m"), F.col("__shared"), F.col("__s")).alias("evidence"), "exact", F.lit("generated").alias("how"),
    )
    return ranked(first.unionByName(second), key)


# ---------------------------------------------------------------- registries and histories


def bundle_list(bundles: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """The newest bundles with the number of their data sets, 0 where they have none."""
    counts = members.groupBy("bundle_id").agg(F.count("dataset_id").alias("dataset_count"))
    return newest(bundles.join(counts, "bundle_id", "left").withColumn("dataset_count", F.coalesce("dataset_count", F.lit(0))), "imported_at", "bundle_id", most)


def history(entries: DataFrame, at: str, tie: str, by: list[str] = [], most: int = HISTORY) -> DataFrame:
    """The newest entries, of each owner if owners are given."""
    if not by:
        return newest(entries, at, tie, most)
    return ranking.top_k(entries, by, [F.col(at).desc_nulls_last(), F.col(tie)], most)


def has_data(**frames: DataFrame) -> DataFrame:
    """One row: whether any frame has rows."""
    every = None
    for df in frames.values():
        one = df.limit(1).select(F.lit(1).alias("one"))
        every = one if every is None else every.union(one)
    return every.agg((F.count("*") > 0).alias("has_data"))


# Candidates of a case whose product reviews are counted, and how far they are counted.
REVIEWED_CANDIDATES, COUNTED_REVIEWS = 10, 100


def review_counts(candidates: DataFrame, reviews: DataFrame, key: str, product: str = "parent_asin", score: str = "evidence_score") -> DataFrame:
    """(key, product, rank, reviews): for the best candidates of each case how many product reviews there are, 0 where there is none.

    Reviews are counted by product before they meet the candidates."""
    counts = reviews.groupBy(product).agg(F.count("*").alias("reviews"))
    best = ranked(candidates, key, REVIEWED_CANDIDATES, score, product).select(key, product, "rank")
    return best.join(counts, product, "left").select(key, product, "rank", F.least(F.coalesce("reviews", F.lit(0)), F.lit(COUNTED_REVIEWS)).cast("long").alias("reviews"))


def valid_reviews(reviews: DataFrame, candidates: DataFrame, key: str, product: str = "parent_asin") -> DataFrame:
    """Reviews of products that are candidates of their case."""
    return reviews.join(candidates.select(key, product).distinct(), [key, product], "left_semi")


# ---------------------------------------------------------------- artifacts


def chain(key: str, **providers: DataFrame) -> DataFrame:
    """Rows of the first provider that knows a record, with the provider's name."""
    out = None
    for name, df in providers.items():
        own = df.withColumn("provider", F.lit(name))
        out = own if out is None else search.gated(out, own, key)
    return out


def first_record(records: DataFrame, key: str, file_order: str, line: str) -> DataFrame:
    """The first row of each record in the order of files and lines."""
    return ranking.keep_first(records, [key], [file_order, line])


def artifact_candidates(reviewed: DataFrame, generic: DataFrame, key: str) -> DataFrame:
    """The best ten of the reviewed candidates of a record, or else of the generic ones; both are scored."""
    return ranked(search.gated(reviewed, generic, key), key, ARTIFACT_CANDIDATES)


def preferred(rows: DataFrame, key: str, preference: str) -> DataFrame:
    """Rows of each record that come from its most preferred kind of file, the one of least number."""
    best = rows.groupBy(key).agg(F.min(preference).alias("__best"))
    return rows.join(best, key).where(F.col(preference) == F.col("__best")).drop("__best")


def demo_cases(candidates: DataFrame, incidents: DataFrame, key: str, wanted: list, tie: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(candidates, incidents) of at most `most` records that have both, wanted records first."""
    both = candidates.select(key).distinct().join(incidents.select(key).distinct(), key, "left_semi")
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key)) if wanted else F.lit(0)
    chosen = both.orderBy(F.when(place > 0, place).otherwise(F.lit(len(wanted) + 1)), key).limit(most)
    return ranked(candidates.join(F.broadcast(chosen), key), key, DEMO_CANDIDATES), earliest(incidents.join(F.broadcast(chosen), key), key, tie, DEMO_INCIDENTS)


# ---------------------------------------------------------------- audits


def token_histograms(pairs: DataFrame, by: list[str], shared: str = "shared") -> DataFrame:
    """(by, candidate_count, shared_token_histogram, max_shared_tokens) of each product's candidates.

    The histogram is an array of (shared, n) in order; counts come first, so only distinct numbers are collected."""
    per = pairs.groupBy(*by, F.col(shared).alias("shared")).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("candidate_count"), F.array_sort(F.collect_list(F.struct("shared", "n"))).alias("shared_token_histogram"), F.max("shared").alias("max_shared_tokens"))


def with_bucket(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Each pair with the size of its bucket and that size's band; counted before it is joined, so no window holds a bucket."""
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("candidate_bucket_size"))
    return pairs.join(sizes, by).withColumn("bucket_band", features.bucket_band(F.col("candidate_bucket_size")))


def review_distributions(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(field, value, n): distributions of the columns, and the most rows that a group has, in one pass over the rows."""
    per = rows.groupBy(group, *columns).agg(F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    spread = per.select("n", F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.sum("n").alias("n"))
    largest = per.groupBy(group).agg(F.sum("n").alias("n")).agg(F.lit("max_rows_per_group").alias("field"), F.lit(None).cast("string").alias("value"), F.max("n").alias("n"))
    return spread.unionByName(largest)


def strategy_samples(records: DataFrame, key: str, rarest: DataFrame, strategies: dict[str, DataFrame], most: int = 30, shown: int = 5) -> DataFrame:
    """The first records with the number of pairs of each strategy and their rarest tokens with frequencies.

    rarest: (key, token, df, rank); strategies: frames with the key, a row for each pair."""
    out = F.broadcast(records.orderBy(key).limit(most))
    tokens = rarest.where(F.col("rank") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "token", "df"))).alias("rarest_tokens"))
    out = out.join(tokens, key, "left")
    for name, pairs in strategies.items():
        out = out.join(pairs.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def with_labels(predictions: DataFrame, labels: DataFrame, key: str, label: str = "target") -> DataFrame:
    """Predictions of labelled rows; the label's value replaces that of the predictions."""
    return predictions.drop(label).join(labels.select(key, label), key)


def rule_baselines(rows: DataFrame, target: str, rules: dict[str, Column], fold: str = "fold") -> DataFrame:
    """Confusion and its measures of each rule in each fold."""
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("int").alias("hit")) for n, c in rules.items()])
    at = rows.select(fold, target, F.explode(cells).alias("c")).select(fold, target, "c.rule", "c.hit")
    return evaluate.confusion(at, target, F.col("hit"), ["rule", fold])


def link_export(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each linked pair with both sides' columns, prefixed; links: (left_id, right_ids array)."""
    pairs = links.select("left_id", F.explode("right_ids").alias("right_id"))
    named = lambda d, i, p: d.select(F.col(i), *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != i])
    return pairs.join(named(left, "left_id", "left"), "left_id").join(named(right, "right_id", "right"), "right_id")


def totals(cases: DataFrame, columns: list[str]) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), *[F.sum(c).alias(c) for c in columns])
