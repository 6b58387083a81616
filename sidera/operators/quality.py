"""Quality gates of the prepared tables, as rows of checks with a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(value: Column, ok: float, warn: float, higher: bool = True) -> Column:
    """OK, WARN or FAIL by two bounds."""
    good = (lambda b: value >= b) if higher else (lambda b: value < b)
    return F.when(good(ok), "OK").when(good(warn), "WARN").otherwise("FAIL")


def checks(df: DataFrame, table: str, aggregates: dict[str, tuple[Column, float, float, bool]]) -> DataFrame:
    """(tbl, item, value, verdict): all checks of a table by one aggregation."""
    one = df.agg(*(v[0].cast("double").alias(k) for k, v in aggregates.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("item"), F.round(F.col(k), 6).alias("value"), gate(F.col(k), v[1], v[2], v[3]).alias("verdict")) for k, v in aggregates.items()))
    return one.select(F.lit(table).alias("tbl"), F.explode(rows).alias("r")).select("tbl", "r.*")


def null_rate(c: str) -> Column:
    return F.avg(F.col(c).isNull().cast("double"))


def items_report(items: DataFrame, key: str = "item_id", enough: int = 60_000, few: int = 50_000) -> DataFrame:
    return checks(
        items,
        "items",
        {
            "rows": (F.count("*"), enough, few, True),
            "surplus_keys": (F.count("*") - F.count_distinct(key), 1, 1, False),
            "null_title": (F.count_if(F.col("title").isNull()), 1, 1, False),
            "short_titles": (F.count_if(F.length("title") <= 50), 1, 1, False),
            "short_descriptions": (F.count_if(F.length("description_text") <= 500), 1, 1, False),
            "few_ratings": (F.count_if(F.col("rating_number") < 20), 1, 1, False),
        },
    )


def sequences_report(sequences: DataFrame, enough: int = 25_000, least: int = 5) -> DataFrame:
    return checks(
        sequences,
        "sequences",
        {
            "rows": (F.count("*"), enough, enough, True),
            "min_len": (F.min("seq_len"), least, least, True),
            "surplus_users": (F.count("*") - F.count_distinct("user_id"), 1, 1, False),
        },
    )


def unknown_items(sequences: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """(n_sequences, n_with_unknown, coverage): sequences that hold an item outside the catalogue."""
    flat = sequences.select("user_id", F.explode("sequence").alias(key)).distinct()
    bad = flat.join(items.select(key).distinct(), key, "left_anti").select("user_id").distinct().withColumn("b", F.lit(1))
    return sequences.select("user_id").join(bad, "user_id", "left").agg(F.count("*").alias("n_sequences"), F.count("b").alias("n_with_unknown"), F.round(1 - F.count("b") / F.count("*"), 6).alias("coverage"))


def fill_rates(df: DataFrame, columns: list[str], ok: float = 0.7, warn: float = 0.4) -> DataFrame:
    return checks(df, "metadata", {c: (1 - null_rate(c), ok, warn, True) for c in columns})


def columns_report(df: DataFrame, table: str, required: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """A row for each required column (1 if it is there) and each column that has to be a list, from the schema alone."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    rows = [(table, f"column_{c}", float(c in kinds), "OK" if c in kinds else "FAIL") for c in required]
    rows += [(table, f"list_{c}", float(kinds[c] == "array"), "OK" if kinds[c] == "array" else "FAIL") for c in lists if c in kinds]
    return df.sparkSession.createDataFrame(rows, "tbl string, item string, value double, verdict string")


def kept_rows(df: DataFrame, table: str, items: DataFrame, ok: float = 1.0, warn: float = 1.0) -> DataFrame:
    """The share of the catalogue's rows that a table made of it has."""
    n, of = df.agg(F.count("*").alias("n")), items.agg(F.count("*").alias("of"))
    share = F.when(F.col("of") > 0, F.col("n") / F.col("of")).otherwise(1.0)
    rows = n.crossJoin(of).select(share.alias("v"))  # one row each
    verdict = F.when(F.col("v") > 1, "FAIL").otherwise(gate(F.col("v"), ok, warn)) if ok == 1.0 else gate(F.col("v"), ok, warn)
    return rows.select(F.lit(table).alias("tbl"), F.lit("kept_rows").alias("item"), F.round("v", 6).alias("value"), verdict.alias("verdict"))


CLEAN = ("clean_title", "clean_description", "clean_features")
EXTRACTED = ("product_type", "pet_species", "life_stage", "primary_use_case", "material_or_active")
SPECIES = ("dog", "cat", "fish", "bird", "small_animal", "reptile", "horse", "other")
STAGES = ("puppy", "kitten", "adult", "senior", "all")


def cleaned_report(cleaned: DataFrame, items: DataFrame) -> DataFrame:
    """Kept rows, columns, null rates (under 1 % well, under 5 % a warning) and short titles of the cleaned texts."""
    there = [c for c in CLEAN if c in cleaned.columns]
    rates = {f"null_{c}": (null_rate(c), 0.01, 0.05, False) for c in there}
    if "clean_title" in there:
        rates["short_clean_titles"] = (F.count_if(F.length("clean_title") < 5), 1, float("inf"), False)
    return union([kept_rows(cleaned, "cleaned", items), columns_report(cleaned, "cleaned", list(CLEAN), ("clean_features",)), checks(cleaned, "cleaned", rates)])


def metadata_report(meta: DataFrame, items: DataFrame) -> DataFrame:
    """Kept rows, columns, fill rates and the number of rows outside the value domains."""
    there = [c for c in EXTRACTED if c in meta.columns]
    domains = {f"odd_{c}": (F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*known)), 1, float("inf"), False) for c, known in (("pet_species", SPECIES), ("life_stage", STAGES)) if c in there}
    return union([kept_rows(meta, "metadata", items), columns_report(meta, "metadata", list(EXTRACTED), ("material_or_active",)), fill_rates(meta, there), checks(meta, "metadata", domains)])


def merged_report(merged: DataFrame, items: DataFrame, sequences: DataFrame, key: str = "item_id") -> DataFrame:
    """Kept rows, unique keys, null rates (under 0.1 % well, under 2 % a warning), context lengths, and the share of the sequences' items that it has (99 and 95 %)."""
    texts = [c for c in ("title", "description_text", "features_text") if c in merged.columns]
    rules = {"surplus_keys": (F.count("*") - F.count_distinct(key), 1, 1, False)} | {f"null_{c}": (null_rate(c), 0.001, 0.02, False) for c in texts}
    if "item_context" in merged.columns:
        rules |= {"empty_contexts": (F.count_if(F.length("item_context") == 0), 1, 1, False), "short_contexts": (F.count_if(F.length("item_context") < 100), 1, float("inf"), False)}
    used = sequences.select(F.explode("sequence").alias(key)).distinct().join(merged.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    cover = checks(used, "merged", {"sequence_items": (F.coalesce(F.count("__in") / F.count("*"), F.lit(1.0)), 0.99, 0.95, True)})
    columns = columns_report(merged, "merged", ["title", "description_text", "features_text", "item_context"], ("material_or_active",))
    return union([kept_rows(merged, "merged", items, 1.0, 0.99), columns, checks(merged, "merged", rules), cover])


def union(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def level_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("verdict").agg(F.count("*").alias("n"))
