"""Resampling statistics and text metrics that need Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ALPHA, CONTRASTS = 0.05, 3
#: Resampled values that are held at once.
STEP = 4_000_000


def bonferroni(alpha: float = ALPHA, contrasts: int = CONTRASTS) -> float:
    return alpha / contrasts


def resampled_means(x: np.ndarray, counts: np.ndarray, times: int, rng) -> np.ndarray:
    """Means of `times` resamples of a sample that has the value x[k] counts[k] times: how often a resample has each
    distinct value is multinomial, so the sample itself is never needed."""
    n, step = int(counts.sum()), max(1, STEP // max(1, len(x)))
    return np.concatenate([rng.multinomial(n, counts / n, min(step, times - k)) @ x / n for k in range(0, times, step)])


def interval(values: np.ndarray, alpha: float) -> tuple[float, float, bool]:
    lo, hi = np.quantile(values, (alpha / 2, 1 - alpha / 2))
    return float(lo), float(hi), bool(lo > 0 or hi < 0)


def p_value(deltas: np.ndarray) -> float:
    return float(min(1.0, 2 * min((deltas >= 0).mean(), (deltas <= 0).mean()))) if len(deltas) else 1.0


def _distinct(df: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, value, count): all that a bootstrap of means needs of a sample; counted with a partial aggregate."""
    return df.select(group, value.cast("double").alias("value")).where("value is not null").groupBy(group, "value").agg(F.count("*").alias("count"))


def bootstrap_ci(df: DataFrame, group: str, value: str, ci: float = 0.95, times: int = 1000, seed: int = 42) -> DataFrame:
    """(group, n, mean, lo, hi) by the percentile bootstrap; the ends are the sorted means at int(a * times) and int((1 - a) * times)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        x, counts = pdf["value"].to_numpy(float), pdf["count"].to_numpy(np.int64)
        means, a = np.sort(resampled_means(x, counts, times, np.random.default_rng(seed))), (1 - ci) / 2
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [counts.sum()], "mean": [x @ counts / counts.sum()], "lo": [means[int(a * times)]], "hi": [means[min(times - 1, int((1 - a) * times))]]})

    return _distinct(df, group, F.col(value)).groupBy(group).applyInPandas(one, f"{group} string, n bigint, mean double, lo double, hi double")


def paired_bootstrap(df: DataFrame, group: str, sample: str, a: str, b: str, times: int = 10_000, alpha: float = ALPHA, contrasts: int = CONTRASTS, seed: int = 42) -> DataFrame:
    """(group, n, delta, p, lo, hi, significant, lo_bonf, hi_bonf, significant_bonf) of b less a, resampled by sample."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        d, counts = pdf["value"].to_numpy(float), pdf["count"].to_numpy(np.int64)
        deltas = resampled_means(d, counts, times, np.random.default_rng(seed))
        return pd.DataFrame([(pdf[group].iloc[0], counts.sum(), d @ counts / counts.sum(), p_value(deltas), *interval(deltas, alpha), *interval(deltas, bonferroni(alpha, contrasts)))], columns=[group, "n", "delta", "p", "lo", "hi", "significant", "lo_bonf", "hi_bonf", "significant_bonf"])

    schema = f"{group} string, n bigint, delta double, p double, lo double, hi double, significant boolean, lo_bonf double, hi_bonf double, significant_bonf boolean"
    rows = df.select(group, sample, a, b).na.drop()
    return _distinct(rows, group, F.round(F.col(b) - F.col(a), 12)).groupBy(group).applyInPandas(one, schema)


def paired_arms(a: DataFrame, b: DataFrame, group: str, sample: str, value: str) -> DataFrame:
    """(group, sample, a, b): the values of two arms at the samples that both have, each once."""
    one = lambda df, name: df.groupBy(group, sample).agg(F.first(value).alias(name))
    return one(a, "a").join(one(b, "b"), [group, sample])


#: Resamples whose picks are the bits of one number.
_BITS = 63


def _picks(sample: Column, word: int, seed: int, digits: int = 16) -> Column:
    """63 bits of which each is 1 with the chance that a resample holds a sample at all, 1 - 1/e to `digits` binary digits."""
    chance, out = int(round((1 - np.exp(-1)) * 2**digits)), F.lit(0).cast("long")
    for d in range(digits):
        drawn = F.xxhash64(F.lit(seed), F.lit(word), F.lit(d), sample).bitwiseAND(F.lit(2**_BITS - 1))
        out = drawn.bitwiseOR(out) if chance >> d & 1 else drawn.bitwiseAND(out)
    return out


def coverage_bootstrap(df: DataFrame, group: str, sample: str, a: str, b: str, catalog_size: int, times: int = 2000, alpha: float = ALPHA, seed: int = 42) -> DataFrame:
    """(group, n, delta, lo, hi, significant) of the share of the catalogue in the union of the samples' sets of b, less that of a.

    A Poisson bootstrap: whether a resample holds a sample follows from a hash of both, a bit each. An item is in the
    resamples of any of its samples, an OR of bits; only the counts of each resample are gathered.
    """
    words = -(-times // _BITS)
    picked = [_picks(F.col("s"), w, seed).alias(f"w{w}") for w in range(words)]
    arms = F.array(F.struct(F.lit(0).alias("arm"), F.col("a").alias("set")), F.struct(F.lit(1).alias("arm"), F.col("b").alias("set")))
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(sample).cast("string").alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    flat = rows.select("g", "s", F.explode(arms).alias("x")).select("g", "s", "x.arm", F.explode("x.set").alias("item")).where("item is not null")
    n = max(3 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flat = flat.repartition(n, "item")  # the picks, which are far wider, are made and joined where the item's rows are; a row twice changes no OR
    covered = flat.select("g", "arm", "item", *picked).groupBy("g", "arm", "item").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)))

    def count(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for (g, arm), part in pdf.groupby(["g", "arm"]):
                bits = np.unpackbits(np.ascontiguousarray(part[[f"w{w}" for w in range(words)]].to_numpy(np.int64)).view(np.uint8).reshape(len(part), words, 8), axis=2, bitorder="little")
                sums = bits.reshape(len(part), words, 64)[:, :, :_BITS].sum(0).ravel()[:times]
                yield pa.RecordBatch.from_pydict({"g": [g], "arm": [int(arm)], "n": [len(part)], "sums": [sums.tolist()]}, schema=pa.schema([("g", pa.string()), ("arm", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = covered.mapInArrow(count, "g string, arm int, n bigint, sums array<bigint>")
    samples = rows.groupBy("g").agg(F.count("*").alias("samples"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        side = lambda k, c: sum((np.asarray(x) for x in pdf[c][pdf.arm == k]), np.zeros(times) if c == "sums" else 0)
        deltas = (side(1, "sums") - side(0, "sums")) / catalog_size
        return pd.DataFrame([(pdf.g.iloc[0], pdf.samples.iloc[0], (side(1, "n") - side(0, "n")) / catalog_size, *interval(deltas, alpha))], columns=[group, "n", "delta", "lo", "hi", "significant"])

    return parts.join(samples, "g").groupBy("g").applyInPandas(one, f"{group} string, n bigint, delta double, lo double, hi double, significant boolean")


def over_seeds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, std, n_seeds); std is the sample's, null for one seed."""
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.count(value).alias("n_seeds"))


def macro_average(df: DataFrame, keys: list[str], task: str, value: str) -> DataFrame:
    """Mean over tasks of the tasks' means."""
    return df.groupBy(*keys, task).agg(F.avg(value).alias("__m")).groupBy(*keys).agg(F.round(F.avg("__m"), 6).alias(value), F.count("*").alias("n_tasks"))


def perplexity(nll: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens, perplexity): exp of the summed loss over the summed tokens of a table (nll, tokens)."""
    return nll.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.round(F.exp(F.sum("nll") / F.sum("tokens")), 6).alias("perplexity"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row at a time in the bits of one number."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@pandas_udf(T.DoubleType())
def _rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    out = []
    for p, g in zip(pred, gold):
        n = lcs(list(g), list(p)) if p is not None and g is not None else 0
        out.append(2 * n / (len(p) + len(g)) if n else 0.0)
    return pd.Series(out)


def rouge_l(pred: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of two token lists; 0 if either is empty."""
    return _rouge_l(pred, gold)


def hashed_cosine(df: DataFrame, a: str, b: str, features: int = 1 << 18) -> DataFrame:
    """df with `cosine` of hashed word 1- and 2-grams; a text without words has cosine 0."""

    def grams(c: str) -> Column:
        w = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda x: x != "")
        two = F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
        return F.transform(F.concat(w, F.filter(two, lambda x: x.isNotNull())), lambda x: F.pmod(F.xxhash64(x), F.lit(features)))

    @pandas_udf(T.DoubleType())
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            (i, m), (j, n) = (np.unique(np.asarray(v, np.int64), return_counts=True) for v in (p, q))
            _, u, v = np.intersect1d(i, j, assume_unique=True, return_indices=True)
            size = np.sqrt(float((m * m).sum()) * float((n * n).sum()))
            out.append(float((m[u] * n[v]).sum()) / size if size else 0.0)
        return pd.Series(out)

    return df.withColumn("cosine", cosine(grams(a), grams(b)))


def label_mask(ids: list[int], begin: list[int], end: int, ignore: int = -100) -> list[int]:
    """The ids between each `begin` and the next `end` (which counts), ignore elsewhere."""
    out, k, n = [ignore] * len(ids), 0, len(begin)
    while k <= len(ids) - n:
        if n and ids[k : k + n] == begin:
            k += n
            while k < len(ids):
                out[k] = ids[k]
                k += 1
                if ids[k - 1] == end:
                    break
        else:
            k += 1
    return out


def masked(c: Column, begin: list[int], end: int, ignore: int = -100) -> Column:
    """label_mask() of a column of id lists, in one pass of an aggregate in the JVM; a null list stays null.

    Inside an answer an `end` closes it and counts; outside, an answer begins after each whole `begin`, of which none overlap.
    """
    n = len(begin)
    if not n:
        return F.transform(c, lambda x: F.lit(ignore))
    want = F.array(*(F.lit(x).cast("int") for x in begin))
    start = F.struct(F.lit(False).alias("open"), F.lit(-1).alias("free"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        opened, free, out = state["open"], state["free"], state["out"]
        # a template that ends here and begins at or after the first free place opens an answer
        begins = ~opened & (item["k"] - n + 1 > free) & (F.slice(c, F.greatest(item["k"] - n + 2, F.lit(1)), F.lit(n)) == want)
        closes = opened & (item["x"] == end)
        return F.struct((begins | (opened & ~closes)).alias("open"), F.when(closes | begins, item["k"]).otherwise(free).alias("free"), F.concat(out, F.array(F.when(opened, item["x"]).otherwise(F.lit(ignore).cast("int")))).alias("out"))

    numbered = F.transform(c, lambda x, k: F.struct(x.cast("int").alias("x"), k.alias("k")))
    return F.aggregate(numbered, start, step, lambda s: s["out"])


def pack(lengths: list[int], most: int) -> list[list[int]]:
    """Rows in order, next-fit: indices of each pack; a longer row is cut to `most`."""
    out, room = [], 0
    for k, n in enumerate(min(x, most) for x in lengths):
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(k)
        room -= n
    return out


def packed(df: DataFrame, order: str, ids: str, most: int, pad: int = 0, shard: str | None = None) -> DataFrame:
    """(shard, pack, ids array<int>, used): the rows of each shard, in the order of a column, packed next-fit and padded.

    A shard's rows are packed by one task, a row at a time; without a shard column the whole table is shard 0.
    """
    source = df.select((F.col(shard) if shard else F.lit(0)).cast("int").alias("shard"), F.col(order).alias("__o"), F.col(ids).alias("ids"))

    def run(frames):
        at, number, rest = None, 0, []
        whole = lambda: (at, number, rest + [pad] * (most - len(rest)), len(rest))
        for f in frames:
            rows = []
            for s, v in zip(f["shard"], f["ids"]):
                v = [] if v is None else list(v)[:most]
                if s != at or len(rest) + len(v) > most:
                    if rest:
                        rows.append(whole())
                    at, number, rest = s, (number + bool(rest)) if s == at else 0, []
                rest = rest + v
            yield pd.DataFrame(rows, columns=["shard", "pack", "ids", "used"])
        if rest:
            yield pd.DataFrame([whole()], columns=["shard", "pack", "ids", "used"])

    return source.repartition("shard").sortWithinPartitions("shard", "__o").mapInPandas(run, "shard int, pack int, ids array<int>, used int")
