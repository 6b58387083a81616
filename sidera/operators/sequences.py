"""Ordered purchase sequences by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidera.functions import arrays as A

LEAST, MOST = 5, 100


def clean_events(events: DataFrame, required: tuple[str, ...] = ("user_id", "parent_asin", "timestamp")) -> DataFrame:
    return events.na.drop(subset=list(required))


def of_known(events: DataFrame, items: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Events of items in the catalogue."""
    return events.join(items.select(key), key, "left_semi")


def build(events: DataFrame, user: str, item: str, order: list[str], least: int = LEAST, most: int | None = MOST) -> DataFrame:
    """(user, sequence, seq_len): each user's items in the full order given, the last `most` of them, users with `least` or more."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, item))), lambda s: s[item])
    out = events.groupBy(user).agg(ordered.alias("sequence"))
    if most is not None:
        out = out.withColumn("sequence", A.tail(F.col("sequence"), most))
    return out.withColumn("seq_len", F.size("sequence").cast("long")).where(F.col("seq_len") >= least)


def to_sids(sequences: DataFrame, sids: DataFrame, item: str = "item_id", sid: str = "sid", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(user_id, sid_sequence, sid_sequence_length): items as semantic ids in order; items without one go.

    An exploded join in place of a lookup table by row, so the catalogue may be of any size.
    """
    flat = sequences.select("user_id", F.posexplode("sequence").alias("pos", item))
    named = flat.join(sids.select(item, sid), item)
    back = named.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", sid))), lambda s: s[sid]).alias("sid_sequence"))
    back = back.where(F.size("sid_sequence") >= least).withColumn("sid_sequence", A.tail(F.col("sid_sequence"), most))
    return back.withColumn("sid_sequence_length", F.size("sid_sequence").cast("long"))


def split_exact(df: DataFrame, rank, key: list, frac: float, val_first: bool, position: str | None = None) -> DataFrame:
    """df with `split` (and its place in the order from 0, by the name given): exactly floor(n * frac) rows are 'val', the first or the last in the order of (rank, key).

    Ranks are counted by ranges of the order, so no single task sorts all rows: rows are numbered within the buckets of
    the rank's leading bits and offset by the sizes of the buckets before. The rank is a whole number from 0 to 2^31 - 1.
    """
    ranked = df.withColumn("__r", rank)
    n = ranked.agg(F.count("*").alias("__total"))
    bucket = F.floor(F.col("__r") / (1 << 20)).cast("long")
    sizes = ranked.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__c"))
    offsets = sizes.withColumn("__off", F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).drop("__c")  # one row a bucket
    numbered = ranked.withColumn("__b", bucket).withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__r", *key)))
    placed = numbered.join(offsets, "__b").crossJoin(F.broadcast(n))  # one row
    at = F.col("__off") + F.col("__i")
    take = F.floor(F.col("__total") * frac)
    val = at <= take if val_first else at > F.col("__total") - take
    placed = placed.withColumn(position, at - 1) if position else placed
    return placed.withColumn("split", F.when(val, "val").otherwise("train")).drop("__r", "__b", "__i", "__off", "__total")
