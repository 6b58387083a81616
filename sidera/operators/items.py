"""The item catalogue: types, texts, filters, context and merging of its cleaned parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidera.functions import text as X
from sidera.sources.io import latest_by_key

MIN_TITLE, MIN_DESCRIPTION, MIN_RATINGS = 50, 500, 20
META_COLUMNS = "parent_asin main_category title average_rating rating_number features description price store categories".split()


def normalize_types(meta: DataFrame) -> DataFrame:
    kinds = {"average_rating": "float", "rating_number": "int", "price": "float", "features": "array<string>", "description": "array<string>", "categories": "array<string>"}
    return meta.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in META_COLUMNS))


def add_texts(meta: DataFrame) -> DataFrame:
    join = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit(""))
    return meta.withColumns({"description_text": join("description", " "), "features_text": join("features", " "), "categories_text": join("categories", " > ")})


def valid(items: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Items with a key, a title and a description longer than the bounds and ratings enough."""
    return items.where(F.col(key).isNotNull() & (F.length("title") > MIN_TITLE) & (F.length("description_text") > MIN_DESCRIPTION) & (F.col("rating_number") >= MIN_RATINGS))


def fill_nulls(items: DataFrame) -> DataFrame:
    texts = "main_category title features_text description_text store categories_text".split()
    return items.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"rating_number": F.coalesce("rating_number", F.lit(0))})


def plain_number(c: Column) -> Column:
    """A number as text in its shortest form, without an exponent up to 2^53; '' for null."""
    whole = F.format_string("%.0f", c.cast("double"))
    return F.coalesce(F.when((F.abs(c) >= 1e7) & (F.abs(c) < 2.0**53) & (c == F.floor(c)), whole).otherwise(c.cast("string")), F.lit(""))


def item_context() -> Column:
    """The item's fields under their names, in one text."""
    named = (("Product: ", "title"), ("\n\nDescription: ", "description_text"), ("\n\nFeatures: ", "features_text"), ("\n\nCategory: ", "main_category"), ("\n\nStore: ", "store"))
    parts = [x for label, c in named for x in (F.lit(label), F.col(c))]
    numbers = [F.lit("\n\nAverage rating: "), plain_number(F.col("average_rating")), F.lit(", Rating count: "), F.col("rating_number").cast("string")]
    price = [F.lit("\n\nPrice: "), plain_number(F.col("price")), F.lit("\n\nCategories: "), F.col("categories_text")]
    return F.concat(*parts, *numbers, *price)


def prepare(meta: DataFrame) -> DataFrame:
    """Raw metadata to the item table: no shuffle, one pass."""
    kept = fill_nulls(valid(add_texts(normalize_types(meta))))
    columns = "parent_asin main_category title average_rating rating_number features_text description_text price store categories_text".split()
    return kept.select(*columns).withColumn("item_context", item_context())


def sample_by_category(items: DataFrame, rank: Column, frac: float, at_least: int = 1, category: str = "main_category", key: str = "parent_asin") -> DataFrame:
    """Of each category the greater of floor(frac * size) and at_least rows, those of least rank.

    Sizes come by a partial aggregate; only a category's own rows are sorted.
    """
    from pyspark.sql import Window

    sized = items.withColumn("__n", F.count("*").over(Window.partitionBy(category)))
    sized = sized.withColumn("__rn", F.row_number().over(Window.partitionBy(category).orderBy(rank, key)))
    take = F.when(F.col("__n") * frac < at_least, F.lit(at_least)).otherwise(F.floor(F.col("__n") * frac))
    return sized.where(F.col("__rn") <= take).drop("__n", "__rn")


def merge(items: DataFrame, cleaned: DataFrame, metadata: DataFrame, ordinal: str = "ordinal", key: str = "parent_asin") -> DataFrame:
    """items with the latest cleaned texts (inner) and the latest metadata (left); blanks and NA are null, empty lists too."""
    c = latest_by_key(cleaned, key, ordinal).select(key, *(X.na_to_null(F.col(n)).alias(n) for n in ("clean_title", "clean_description")), *(empty_to_null(F.col(n)).alias(n) for n in ("clean_features",)))
    columns = [x for x in "product_type pet_species life_stage primary_use_case material_or_active".split() if x in metadata.columns]
    m = latest_by_key(metadata, key, ordinal).select(key, *columns)
    return items.join(c, key, "inner").join(m, key, "left")


def empty_to_null(c: Column) -> Column:
    return F.when(F.size(c) == 0, F.lit(None)).otherwise(c)


def as_list(df: DataFrame, name: str) -> Column:
    """A list column as it is, a scalar as a list of one."""
    return F.col(name) if df.schema[name].dataType.typeName() == "array" else F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))


def category_or(c: Column, fallback: Column) -> Column:
    """The category text, or the fallback where it is null or blank."""
    return F.when(X.ensure_text(c) == "", fallback).otherwise(c)


def clean_context(df: DataFrame) -> Column:
    """What a cleaning step is asked about: the labelled fields that aren't empty."""
    named = (("Title", "title"), ("Description", "description_text"), ("Features", "features_text"), ("Category", "categories_text"))
    return X.labelled([(label, F.col(c)) for label, c in named if c in df.columns])


def features_or_original(df: DataFrame) -> DataFrame:
    """features_text, or where it is null the original's, if df has such."""
    if "original_features_text" not in df.columns:
        return df
    return df.withColumn("features_text", F.coalesce("features_text", "original_features_text"))


def enriched_context(df: DataFrame) -> Column:
    """The item's fields with what was extracted from them, each under its name on a line; N/A for what is missing."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in df.columns else F.lit("N/A")
    material = "material_or_active"
    listed = material in df.columns and df.schema[material].dataType.typeName() == "array"
    category = F.coalesce("categories_text", "main_category", F.lit(""))
    texts = {"Title": F.coalesce("title", F.lit("")), "Description": F.coalesce("description_text", F.lit("")), "Category": category, "Features": F.coalesce("features_text", F.lit(""))}
    extracted = {"Pet Species": known("pet_species"), "Product Type": known("product_type"), "Life Stage": known("life_stage"), "Primary Use Case": known("primary_use_case")}
    rows = texts | extracted | {"Material/Active": X.list_to_csv(F.col(material)) if listed else known(material)}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), c) for name, c in rows.items()))


def lenient(c: Column, kind: str) -> Column:
    """A cast by which what can't be read is null."""
    return c.try_cast(kind)
