"""Features of candidate pairs, scores, bands and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def pair_features(pairs: DataFrame, tokenizer: str = "linkage", with_sequence: bool = True) -> DataFrame:
    """Features of a left name against a right brand, model and description.

    pairs has left_name, left_keys (array), right_brand, right_model, right_description, right_key, manufacturer and
    retailer; its columns stay. The sequence ratio is the one Python step and comes last, on candidates only."""
    name, brand = t.normalize_text(F.col("left_name")), t.normalize_text(F.col("right_brand"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    product = F.concat_ws(" ", blank("right_brand"), blank("right_model"), blank("right_description"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    lt, rt = t.tokens(F.col("left_name"), tokenizer), t.tokens(F.col("__product"), tokenizer)
    keys = F.array_distinct(F.filter(F.transform(F.coalesce("left_keys", F.array().cast("array<string>")), lambda k: t.compact(k, folding=False)), lambda k: k != ""))
    key = t.compact(F.col("right_key"), folding=False)
    base = pairs.withColumn("__product", product).withColumns({"__lt": lt, "__rt": rt, "__keys": keys, "__key": key, "__name": name, "__brand": brand, "__model": t.compact(F.col("right_model")), "__maker": t.normalize_text(F.col("manufacturer")), "__text": t.normalize_text(F.col("__product"))})
    out = base.withColumns({
        "exact_upc": flag((F.col("__key") != "") & F.array_contains("__keys", F.col("__key"))),
        "left_upc_count": F.size("__keys"), "right_has_upc": flag(F.col("__key") != ""),
        "shared_product_token_count": t.shared(F.col("__lt"), F.col("__rt")),
        "product_token_jaccard": t.jaccard(F.col("__lt"), F.col("__rt"), 6),
        "left_name_token_coverage": t.coverage(F.col("__lt"), F.col("__rt"), 6), "right_name_token_coverage": t.coverage(F.col("__rt"), F.col("__lt"), 6),
        "product_name_substring": flag(t.contains_phrase(F.col("__text"), F.col("__name"))),
        "product_brand_present": flag(F.col("__brand") != ""), "product_model_present": flag(F.col("__model") != ""),
        "manufacturer_present": flag(F.col("__maker") != ""), "retailer_present": flag(F.coalesce("retailer", F.lit("")) != ""),
        "brand_in_left_name": flag(t.contains_phrase(F.col("__name"), F.col("__brand"))),
        "model_in_left_name": flag(t.contains_phrase(t.compact(F.col("left_name")), F.col("__model"))),
        "manufacturer_in_left_name": flag(t.contains_phrase(F.col("__name"), F.col("__maker"))),
    })
    if with_sequence:
        out = out.withColumn("product_name_sequence_similarity", t.sequence_similarity(F.col("__name"), F.col("__text")))
    return out.drop("__product", "__lt", "__rt", "__keys", "__key", "__name", "__brand", "__model", "__maker", "__text")


def title_features(pairs: DataFrame) -> DataFrame:
    """Features of a left name against a catalogue title with brand, manufacturer and model."""
    norm = lambda c: t.squeezed(t.compat_lower(F.col(c)))
    lt, rt, bt = (t.tokens(F.col(c), "benchmark") for c in ("left_name", "title", "brand"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return pairs.withColumns({
        "title_token_coverage": t.coverage(rt, lt), "name_token_coverage_in_title": t.coverage(lt, rt),
        "brand_in_name": flag(t.contains_phrase(norm("left_name"), norm("brand"))), "brand_token_in_title": flag(F.arrays_overlap(bt, rt)),
        "model_in_title": flag(t.contains_phrase(norm("title"), norm("model"))), "manufacturer_in_title": flag(t.contains_phrase(norm("title"), norm("manufacturer"))),
        "title_sequence_similarity": t.sequence_similarity(norm("left_name"), norm("title"), None),
    })


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def supplied_score(shared: Column, left_tokens: Column, jaccard: Column, sequence: Column, brand_in_name: Column, exact: Column) -> Column:
    """Rank of a candidate that came with its features; an exact key is 1."""
    s = 0.58 * F.least(shared / F.greatest(left_tokens, F.lit(1)), F.lit(1.0)) + 0.22 * jaccard + 0.12 * sequence + 0.08 * brand_in_name.cast("double")
    return F.when(exact, 1.0).otherwise(_clamped(s))


def generated_score(exact: Column, shared: Column, left_tokens: Column, jaccard: Column, similarity: Column, brand: Column, model: Column) -> Column:
    """Rank of a candidate found by search; below 1 unless the key is exact."""
    s = 0.45 * exact.cast("double") + 0.25 * F.least(shared / F.greatest(left_tokens, F.lit(1)), F.lit(1.0)) + 0.18 * jaccard + 0.08 * similarity + 0.04 * brand.cast("double") + 0.03 * model.cast("double")
    return F.when(exact, 1.0).otherwise(F.least(s, F.lit(0.99)))


#: Name tokens that the score of a shown candidate counts shared ones against, and the relation that counts as a brand's.
SHOWN_TOKENS, BRAND_IN_NAME = 8, "brand_in_cpsc_name"


def shown(candidates: DataFrame) -> DataFrame:
    """Candidate views with evidence_score, to three places, and evidence, the reasons for it."""
    exact, brand = F.col("exact_upc") == 1, F.col("brand_relation") == BRAND_IN_NAME
    shared, sequence = F.col("shared_product_token_count"), F.col("product_name_sequence_similarity")
    score = supplied_score(shared, F.lit(SHOWN_TOKENS), F.col("product_token_jaccard"), sequence, brand, exact)
    return candidates.withColumns({"evidence_score": F.round(score, 3), "evidence": supplied_reasons(exact, brand, shared, sequence, F.lit(False))})


# The wording of reasons; a candidate that came with its features and one found by search differ.
EXACT_REASON = "Exact UPC agreement"
SHARED_REASON = " shared product-name tokens"
SUPPLIED_REASONS = {"brand": "Brand aligns with recall product", "similarity": "High title similarity", "model": "Marketplace model identifier available"}
GENERATED_REASONS = {"brand": "Brand agreement", "model": "Model agreement", "similarity": "Strong title similarity"}
#: Title similarities from which they are a reason.
SUPPLIED_SIMILARITY, GENERATED_SIMILARITY = 0.7, 0.72


def _several(shared: Column) -> Column:
    return F.when(shared >= 2, F.concat(shared.cast("string"), F.lit(SHARED_REASON)))


def supplied_reasons(exact: Column, brand: Column, shared: Column, similarity: Column, model: Column) -> Column:
    """array<string> of what speaks for a candidate that came with its features, in a fixed order."""
    r = SUPPLIED_REASONS
    return F.array_compact(F.array(F.when(exact, EXACT_REASON), F.when(brand, r["brand"]), _several(shared), F.when(similarity >= SUPPLIED_SIMILARITY, r["similarity"]), F.when(model, r["model"])))


def generated_reasons(exact: Column, brand: Column, model: Column, shared: Column, similarity: Column) -> Column:
    """array<string> of what speaks for a candidate found by search, in a fixed order."""
    r = GENERATED_REASONS
    return F.array_compact(F.array(F.when(exact, EXACT_REASON), F.when(brand, r["brand"]), F.when(model, r["model"]), _several(shared), F.when(similarity >= GENERATED_SIMILARITY, r["similarity"])))


def acceptable(shared: Column, similarity: Column, brand: Column) -> Column:
    return (shared >= 2) | (similarity >= 0.72) | brand


def band(value: Column, medium: float, high: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def bucket_band(n: Column) -> Column:
    return F.when(n <= 5, "small_bucket").when(n <= 50, "medium_bucket").otherwise("large_bucket")


def model_band(model: Column) -> Column:
    return F.when(F.trim(F.coalesce(model, F.lit(""))) != "", "with_model").otherwise("without_model")


def brand_relation(brand: Column, name: Column) -> Column:
    b = F.trim(F.lower(F.coalesce(brand, F.lit(""))))
    return F.when(b == "", "brand_missing").when(F.contains(F.lower(F.coalesce(name, F.lit(""))), b), "brand_in_name").otherwise("brand_not_in_name")


def rules(exact: Column, shared: Column, jaccard: Column, similarity: Column) -> dict[str, Column]:
    """Rule classifiers, 1 for a match."""
    return {
        "upc_only": exact.cast("int"),
        "token_similarity": (((shared >= 3) & (jaccard >= 0.20)) | exact).cast("int"),
        "strict_title": (((jaccard >= 0.30) & (similarity >= 0.45)) | exact).cast("int"),
    }


def strata(exact: Column, status: Column, similarity: Column, jaccard: Column, shared: Column) -> dict[str, Column]:
    """Overlapping review strata of pairs without an exact key, in order of filling."""
    high = (similarity >= 0.70) | (jaccard >= 0.40)
    medium = ~high & ((similarity >= 0.40) | (jaccard >= 0.15))
    return {
        "pre_recall_public": ~exact & (status == "pre_recall_public"), "high_similarity": ~exact & high, "medium_similarity": ~exact & medium,
        "two_shared_tokens": ~exact & (shared == 2), "low_similarity": ~exact & ~high & ~medium,
    }
