"""Hierarchical identifiers of four levels: assigned, written as tokens, parsed, quantised and measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidera.functions import arrays as V

LEVELS = "ABCD"
START, END = "<|sid_start|>", "<|sid_end|>"
STRICT = r"<\|sid_start\|>" + "".join(rf"<\|{x}(\d+)\|>" for x in LEVELS) + r"<\|sid_end\|>"
BARE = "".join(rf"<\|{x}(\d+)\|>" for x in LEVELS)
LOOSE = r"<\|sid_start\|>(?:" + rf"<\|[{LEVELS}]\d+\|>" + r")+<\|sid_end\|>"


def assign_d(df: DataFrame, key: str) -> DataFrame:
    """df with D: the place of a row among those of its (A, B, C), in the order of the key, from 0."""
    return df.withColumn("D", (F.row_number().over(Window.partitionBy("A", "B", "C").orderBy(key)) - 1).cast("int"))


def token(*levels: Column) -> Column:
    parts: list[Column] = [F.lit(START)]
    for name, c in zip(LEVELS, levels):
        parts += [F.lit(f"<|{name}"), c.cast("string"), F.lit("|>")]
    return F.concat(*parts, F.lit(END))


def with_token(df: DataFrame, name: str = "sid_tokens") -> DataFrame:
    return df.withColumn(name, token(*(F.col(x) for x in LEVELS)))


def from_list(df: DataFrame, col: str = "semantic_ids") -> DataFrame:
    """A, B, C and D of a list of three or four codes; a missing D is 0. Without the column df is as it was."""
    if col not in df.columns:
        return df
    pick = {x: F.get(F.col(col), F.lit(k)).cast("smallint") for k, x in enumerate(LEVELS[:3])}
    return df.withColumns(pick | {"D": F.coalesce(F.get(F.col(col), F.lit(3)), F.lit(0)).cast("int")})


def parse(c: Column, pattern: str = STRICT) -> Column:
    """The first identifier of a text as a struct of level texts, or null."""
    got = F.struct(*(F.regexp_extract(c, pattern, k + 1).alias(x) for k, x in enumerate(LEVELS)))
    return F.when(c.rlike(pattern), got)


def parse_bare(c: Column) -> Column:
    return parse(c, BARE)


def parse_token(c: Column) -> Column:
    """The first identifier of any levels, as text, or null."""
    return F.when(c.rlike(LOOSE), F.regexp_extract(c, LOOSE, 0))


def parse_all(c: Column) -> Column:
    """All identifiers of a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(STRICT), F.lit(0)), lambda m: parse(m))


def depth(pred: Column, gold: Column) -> Column:
    """Levels that agree from A on: 0 to 4; null if either is."""
    out = F.lit(4)
    for k in reversed(range(4)):
        out = F.when(pred[LEVELS[k]] != gold[LEVELS[k]], F.lit(k)).otherwise(out)
    return F.when(pred.isNotNull() & gold.isNotNull(), out)


def vocabulary(spark, size: int = 256) -> DataFrame:
    """(token_id, token): three control tokens and size tokens of each level."""
    control = [(0, START), (1, END), (2, "<|rec|>")]
    names = F.element_at(F.array(*map(F.lit, LEVELS)), (F.floor(F.col("id") / size) + 1).cast("int"))
    levels = spark.range(4 * size).select((F.col("id") + 3).cast("int").alias("token_id"), F.concat(F.lit("<|"), names, (F.col("id") % size).cast("string"), F.lit("|>")).alias("token"))
    return spark.createDataFrame(control, "token_id int, token string").unionByName(levels)


def quantize(vectors: DataFrame, codebook: list[list[list[float]]], key: str, col: str) -> DataFrame:
    """(key, codes, residual): residual quantisation by the nearest codeword of each level, the lowest code of equals.

    The codebook (levels x codes x dimensions, of fixed size) is a literal of the plan; there is no shuffle.
    """
    out = vectors.select(key, F.transform(col, lambda x: x.cast("double")).alias("__r"), F.array().cast("array<int>").alias("codes"))
    for words in codebook:
        table = F.array(*(F.array(*(F.lit(float(x)) for x in w)) for w in words))
        far = F.transform(table, lambda w, k: F.struct(V.squared_distance(F.col("__r"), w).alias("d"), k.alias("k")))
        out = out.withColumn("__k", F.array_min(far)["k"])
        out = out.withColumn("codes", F.concat("codes", F.array("__k"))).withColumn("__r", V.subtract(F.col("__r"), F.get(table, F.col("__k"))))
    return out.select(key, "codes", F.col("__r").alias("residual"))


def level_stats(df: DataFrame, levels: str = "ABC", size: int = 256) -> DataFrame:
    """(level, used, dead, perplexity, top_share) of each level's codes: one pass over the level columns stacked."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).cast("int").alias("code")) for x in levels))).alias("s")).select("s.*")
    counts = stacked.groupBy("level", "code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("level")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w))
    return p.groupBy("level").agg(F.count("*").alias("used"), (F.lit(size) - F.count("*")).alias("dead"), F.round(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))), 6).alias("perplexity"), F.round(F.max("p"), 6).alias("top_share"))


def collisions(df: DataFrame) -> DataFrame:
    """(n_items, n_unique, collision_share, max_bucket) of the (A, B, C) buckets."""
    buckets = df.groupBy("A", "B", "C").agg(F.count("*").alias("n"))
    return buckets.agg(F.sum("n").cast("long").alias("n_items"), F.count("*").alias("n_unique"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("collision_share"), F.max("n").alias("max_bucket"))


def decode(codes: Column, codebook: list[list[list[float]]]) -> Column:
    """The vector of a list of codes: the sum of the codewords of its levels; null if a code is missing or out of range."""
    parts = []
    for level, words in enumerate(codebook):
        table = F.array(*(F.array(*(F.lit(float(x)) for x in w)) for w in words))
        code = F.get(codes, F.lit(level))
        parts.append(F.when((code >= 0) & (code < len(words)), F.get(table, code)))
    out = parts[0]
    for p in parts[1:]:
        out = V.add(out, p)
    return out


def token_buckets(df: DataFrame, tokens: Column, levels: str = LEVELS, size: int = 256) -> DataFrame:
    """(bucket, token, n): how often each token is in the texts of items whose code at a level is bucket % size; bucket = level * size + code.

    Counts stand for the gathered lists, so no bucket is ever in one row; a code of `size` or more has no bucket.
    """
    rows = df.select(F.explode(F.array(*(F.struct((F.lit(k * size) + F.col(x)).cast("int").alias("bucket"), F.col(x).alias("code")) for k, x in enumerate(levels)))).alias("s"), tokens.alias("__t"))
    return rows.where(F.col("s.code") < size).select("s.bucket", F.explode("__t").alias("token")).groupBy("bucket", "token").agg(F.count("*").alias("n"))
