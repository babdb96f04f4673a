"""Raw records into canonical rows: alias lists, nested containers of any shape, validity instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as t

# Aliases of the canonical fields, by source, in order of trial.
ALIASES = {
    "cpsc": {
        "source_record_id": ("source_record_id", "cpsc_source_record_id", "id", "record_id"),
        "recall_number": ("recall_number", "cpsc_recall_number", "recallnumber"),
        "recall_date": ("recall_date", "cpsc_recall_date", "date"),
        "product_name": ("product_name", "cpsc_product_name", "product"),
        "title": ("title", "cpsc_title", "description"),
        "hazards": ("hazards", "cpsc_hazards", "hazard"),
        "description": ("description", "cpsc_description"),
        "url": ("url", "cpsc_url", "recall_url"),
        "brand": ("brand", "product_brand"),
        "model": ("model", "product_model", "model_number"),
        "upc": ("upc", "product_upc"),
        "category": ("category", "product_category", "category_id"),
    },
    "saferproducts": {
        "source_record_id": ("source_record_id", "saferproducts_source_record_id", "incident_id", "id"),
        "incident_date": ("incident_date", "date_of_incident"),
        "publication_date": ("publication_date", "published_date", "date_published"),
        "brand": ("product_brand", "brand", "incident_brand"),
        "model": ("product_model", "model", "incident_model"),
        "upc": ("product_upc", "upc", "incident_upc"),
        "product_description": ("product_description", "product", "incident_product_description"),
        "description": ("incident_description", "description", "comments"),
        "manufacturer": ("manufacturer_name", "manufacturer", "incident_manufacturer"),
        "retailer": ("retailer_name", "retailer", "incident_retailer"),
        "recall_number": ("cpsc_recall_number", "recall_number", "recallnumber"),
    },
    "amazon_products": {
        "parent_asin": ("parent_asin", "amazon_parent_asin", "parentAsin", "asin"),
        "title": ("title", "amazon_title", "product_title"),
        "brand": ("brand", "amazon_brand"),
        "model": ("model", "model_number", "modelNumber", "amazon_model"),
        "upc": ("upc", "product_upc", "barcode", "gtin"),
        "manufacturer": ("manufacturer", "amazon_manufacturer"),
        "category": ("category", "main_category", "category_name", "amazon_category"),
    },
    "amazon_reviews": {
        "review_id": ("review_id", "id"),
        "asin": ("asin", "parent_asin", "parentAsin"),
        "parent_asin": ("parent_asin", "parentAsin", "asin"),
        "rating": ("rating", "stars", "score"),
        "review_title": ("title", "review_title"),
        "review_text": ("text", "review_text", "review_body"),
        "review_date": ("timestamp", "review_date", "date"),
        "verified_purchase": ("verified_purchase", "verified", "verifiedPurchase"),
    },
    "linkage": {
        "recall_number": ("cpsc_recall_number", "recall_number"),
        "parent_asin": ("amazon_parent_asin", "parent_asin", "asin"),
        "title": ("amazon_title", "title"),
        "brand": ("amazon_brand", "brand"),
        "model": ("amazon_model", "model"),
        "upc": ("amazon_upc", "upc"),
        "exact_upc": ("exact_upc",),
        "shared_product_token_count": ("shared_product_token_count",),
        "product_token_jaccard": ("product_token_jaccard",),
        "product_name_sequence_similarity": ("product_name_sequence_similarity",),
        "brand_relation": ("brand_relation",),
        "blocking_sources": ("blocking_sources",),
        "review_label": ("review_label", "label"),
    },
}
REQUIRED = {"cpsc": [], "saferproducts": ["source_record_id"], "amazon_products": ["parent_asin"], "amazon_reviews": ["asin"], "linkage": ["recall_number", "parent_asin"]}
WHOLE, REAL = ("exact_upc", "shared_product_token_count"), ("product_token_jaccard", "product_name_sequence_similarity")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first alias, in any case, that is neither null nor empty."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.col(f"`{have[n.lower()]}`").cast("string"), F.lit("")) for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# Fields of the views of stored artifacts, each with the columns that may hold it, in order of trial.
VIEWS = {
    "candidate": {
        "parent_asin": ("amazon_parent_asin", "parent_asin", "asin"), "title": ("amazon_title", "title"), "brand": ("amazon_brand", "brand"),
        "manufacturer": ("amazon_manufacturer", "manufacturer"), "model": ("amazon_model", "model"), "upc": ("amazon_upc", "upc"), "category": ("amazon_category", "category"),
        "exact_upc": ("exact_upc",), "shared_product_token_count": ("shared_product_token_count",), "product_token_jaccard": ("product_token_jaccard",),
        "product_name_sequence_similarity": ("product_name_sequence_similarity",), "brand_relation": ("brand_relation",), "blocking_sources": ("blocking_sources",),
        "candidate_bucket_size": ("candidate_bucket_size",),
    },
    "recall": {
        "recall_number": ("recall_number", "cpsc_recall_number"), "source_record_id": ("source_record_id", "cpsc_source_record_id"), "recall_date": ("recall_date", "cpsc_recall_date"),
        "product_name": ("product_name", "cpsc_product_name"), "title": ("title", "cpsc_title"), "hazards": ("hazards", "cpsc_hazards"),
        "description": ("description", "cpsc_description"), "url": ("url", "cpsc_url"),
    },
    "incident": {
        "source_record_id": ("saferproducts_source_record_id", "source_record_id"), "incident_date": ("incident_date",), "publication_date": ("publication_date",),
        "brand": ("incident_brand", "product_brand"), "model": ("incident_model", "product_model"), "upc": ("incident_upc", "product_upc"),
        "product_description": ("incident_product_description", "product_description"), "description": ("incident_description", "description"),
        "manufacturer": ("incident_manufacturer", "manufacturer_name"), "retailer": ("incident_retailer", "retailer_name"),
    },
}


def view(df: DataFrame, kind: str) -> DataFrame:
    """The fields of an artifact's rows under their common names. Texts are trimmed and never null; numbers that are missing
    or unreadable are 0; nested values become JSON."""
    flat = df.select([F.to_json(f"`{c}`").alias(c) if k.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, k in df.dtypes])
    out = []
    for field, names in VIEWS[kind].items():
        c = _first(flat, names)
        if field in (*WHOLE, "candidate_bucket_size"):
            c = F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))
        elif field in REAL:
            c = F.coalesce(c.try_cast("double"), F.lit(0.0))
        else:
            c = F.trim(F.coalesce(c, F.lit("")))
        out.append(c.alias(field))
    return flat.select(*out)


def canonical(df: DataFrame, source: str) -> DataFrame:
    """Canonical columns and `valid`, from whatever columns the frame has."""
    out = {}
    for field, names in ALIASES[source].items():
        c = t.clean(_first(df, names))
        if field in WHOLE:
            c = F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))
        elif field in REAL:
            c = F.coalesce(c.try_cast("double"), F.lit(0.0))
        out[field] = c
    if source == "cpsc":
        out["source_record_id"] = F.coalesce(out["source_record_id"], F.concat(F.lit("cpsc-"), F.coalesce(out["recall_number"], F.lit(""))))
    if source == "amazon_reviews":
        made = F.concat_ws(":", out["asin"], F.coalesce(out["review_date"], F.lit("")), F.substring(F.coalesce(out["review_title"], F.lit("")), 1, 40))
        out["review_id"] = F.coalesce(out["review_id"], made)
    valid = F.lit(True)
    for r in REQUIRED[source]:
        valid = valid & out[r].isNotNull()
    return df.select(*[c.alias(n) for n, c in out.items()], valid.alias("valid"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by column valid."""
    return df.where("valid").drop("valid"), df.where("not valid").drop("valid")


def _items(record: str, group: str, item: str) -> str:
    """SQL: array<string> of the JSON objects under a group: a list, one object, or either inside the item key."""
    g, i = f"get_json_object({record}, '$.{group}')", f"get_json_object({record}, '$.{group}.{item}')"
    body = f"coalesce({i}, {g})"
    return f"filter(case when {body} like '[%' then from_json({body}, 'array<string>') when {body} like '{{%' then array({body}) else cast(array() as array<string>) end, x -> x like '{{%')"


def _text(json: str, field: str) -> str:
    return f"nullif(trim(get_json_object({json}, '$.{field}')), '')"


def recalls(raw: DataFrame, body: str = "body") -> DataFrame:
    """Recall records of JSON text with nested groups of any shape; `valid` needs an id."""
    struct = lambda **f: "named_struct(" + ", ".join(f"'{k}', {_text('x', v)}" for k, v in f.items()) + ")"
    group = lambda g, i, s: F.expr(f"transform({_items(body, g, i)}, x -> {s})")
    names = lambda g, i, f: F.expr(f"filter(transform({_items(body, g, i)}, x -> {_text('x', f)}), v -> v is not null)")
    field = lambda f: F.expr(_text(body, f))
    firm = struct(name="Name", company_id="CompanyID")
    return raw.select(
        field("RecallID").alias("source_record_id"), field("RecallNumber").alias("recall_number"), dates.iso_date(field("RecallDate")).alias("recall_date"), dates.iso_timestamp(field("LastPublishDate")).alias("last_publish_date"),
        field("Title").alias("title"), field("Description").alias("description"), field("URL").alias("url"), field("ConsumerContact").alias("consumer_contact"),
        group("Products", "Product", struct(name="Name", description="Description", model="Model", type="Type", category_id="CategoryID", number_of_units="NumberOfUnits")).alias("products"),
        names("Injuries", "Injury", "Name").alias("injuries"), group("Manufacturers", "Manufacturer", firm).alias("manufacturers"), group("Retailers", "Retailer", firm).alias("retailers"),
        group("Importers", "Importer", firm).alias("importers"), group("Distributors", "Distributor", firm).alias("distributors"), names("ManufacturerCountries", "ManufacturerCountry", "Country").alias("manufacturer_countries"),
        names("ProductUPCs", "ProductUPC", "UPC").alias("product_upcs"), group("Hazards", "Hazard", struct(name="Name", hazard_type="HazardType", hazard_type_id="HazardTypeID")).alias("hazards"),
        group("Remedies", "Remedy", struct(name="Name")).alias("remedies"), group("RemedyOptions", "RemedyOption", struct(option="Option")).alias("remedy_options"),
    ).withColumn("valid", F.col("source_record_id").isNotNull())


# Names of incident fields at the source, in order of trial.
INCIDENT_FIELDS = {
    "source_record_id": ("IncidentReportNumber", "IncidentReportNo", "ReportNumber", "ReportId", "IncidentID", "Id"),
    "incident_date": ("IncidentDate", "IncidentDateTime"),
    "publication_date": ("IncidentReportPublicationDate", "ReportFirstPublicationDate", "PublicationDate"),
    "incident_description": ("IncidentDescription", "Description"),
    "incident_location": ("IncidentLocation",),
    "locale": ("Locale",),
    "product_brand": ("ProductBrandName", "ProductBrand"),
    "product_model": ("ProductModelName", "ProductModel"),
    "product_description": ("IncidentProductDescription", "ProductDescription"),
    "product_category": ("ProductCategory",),
    "product_upc": ("ProductUPCCode", "ProductUPC"),
    "product_serial_number": ("ProductSerialNumber",),
    "product_manufactured_date": ("ProductManufacturedDate",),
    "product_purchased_date": ("ProductPurchasedDate",),
    "manufacturer_name": ("ProductManufacturerName", "ManufacturerName", "Manufacturer"),
    "manufacturer_location": ("ManufacturerLocation",),
    "manufacturer_notification_date": ("ManufacturerNotificationDate",),
    "manufacturer_comments": ("CompanyComments", "ManufacturerComments"),
    "retailer_name": ("ProductRetailCompanyName", "RetailCompanyName", "RetailerName", "RetailCompany"),
    "retailer_location": ("RetailCompanyLocation", "RetailerLocation"),
}


def incidents(raw: DataFrame, body: str = "body") -> DataFrame:
    """Incident records of JSON text; nested values count as missing, dates in any of the source's forms."""
    def value(names: tuple[str, ...]) -> Column:
        found = [F.expr(_text(body, n)) for n in names]
        return F.coalesce(*[F.when(~v.rlike(r"^[\[{]"), v) for v in found])

    out = {k: dates.source_date(value(v)) if k.endswith("_date") else value(v) for k, v in INCIDENT_FIELDS.items()}
    return raw.select(*[c.alias(k) for k, c in out.items()]).withColumn("valid", F.col("source_record_id").isNotNull())


def products(raw: DataFrame, body: str = "body", category: Column | None = None) -> DataFrame:
    """Catalogue metadata of JSON text; keeps rows with an id and a title. Keys of details are found in any case."""
    details = F.from_json(F.get_json_object(body, "$.details"), "map<string,string>")
    lowered = F.map_from_entries(F.array_compact(F.transform(F.map_entries(F.map_filter("details", lambda k, v: v.isNotNull())), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    pick = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("__low", F.lit(k)), F.lit("")) for k in keys], F.lit(""))
    text = lambda f: F.coalesce(F.get_json_object(body, f"$.{f}"), F.lit(""))
    several = lambda f: F.when(F.get_json_object(body, f"$.{f}").startswith("["), F.from_json(F.get_json_object(body, f"$.{f}"), "array<string>")).when(text(f) != "", F.array(text(f))).otherwise(F.array().cast("array<string>"))
    base = raw.withColumn("details", F.coalesce(details, F.create_map().cast("map<string,string>"))).withColumn("__low", lowered)
    out = base.select(
        (category if category is not None else F.lit(None).cast("string")).alias("source_category"), text("parent_asin").alias("parent_asin"), text("title").alias("title"), pick("brand").alias("brand"),
        pick("manufacturer").alias("manufacturer"), pick("model").alias("model"), pick("upc", "upc code", "gtin", "ean").alias("upc"), text("store").alias("store"), text("main_category").alias("main_category"),
        several("categories").alias("categories"), several("features").alias("features"), several("description").alias("description"), F.get_json_object(body, "$.average_rating").try_cast("double").alias("average_rating"),
        F.get_json_object(body, "$.rating_number").try_cast("bigint").alias("rating_number"), F.get_json_object(body, "$.price").alias("price"), "details",
    )
    return out.where("parent_asin <> '' and title <> ''")


def company_names(recall_rows: DataFrame) -> Column:
    """Distinct normalised names of manufacturers, importers and distributors of canonical recall rows."""
    have = [c for c in ("manufacturers", "importers", "distributors") if c in recall_rows.columns]
    every = F.concat(*[F.transform(F.coalesce(F.col(c), F.array().cast(dict(recall_rows.dtypes)[c])), lambda x: t.normalize_lower(x["name"])) for c in have])
    return F.array_distinct(F.filter(every, lambda n: n != ""))


def brand(recall_rows: DataFrame) -> Column:
    """The first manufacturer's name, else the first importer's."""
    return F.coalesce(F.try_element_at("manufacturers", F.lit(1))["name"], F.try_element_at("importers", F.lit(1))["name"])


def first_product(column: str = "products") -> Column:
    return F.try_element_at(column, F.lit(1))


def codes(body: str = "body") -> Column:
    """Product codes of a raw record: one text, a list of texts, a list of objects that name theirs, and the products' own."""
    one = "case when {v} like '[%' then transform(from_json({v}, 'array<string>'), x -> case when x like '{{%' then coalesce(get_json_object(x, '$.upc'), get_json_object(x, '$.UPC'), get_json_object(x, '$.value'), get_json_object(x, '$.code')) else x end) when {v} is null then cast(array() as array<string>) else array({v}) end"
    listed = [one.format(v=f"get_json_object({body}, '$.{k}')") for k in ("product_upcs", "ProductUPCs")]
    own = f"transform({_items(body, 'products', 'product')}, x -> coalesce(get_json_object(x, '$.upc'), get_json_object(x, '$.UPC')))"
    return F.expr(f"array_distinct(filter(transform(concat({listed[0]}, {listed[1]}, {own}), x -> trim(x)), x -> x <> ''))")


def identity_text(*fields: str) -> Column:
    """The normalised text of all identity fields of an incident, blanks left out."""
    return t.normalize_text(F.concat_ws(" ", *[F.nullif(F.trim(f), F.lit("")) for f in fields]))
