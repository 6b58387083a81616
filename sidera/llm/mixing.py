"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are put in an order permuted by a hash of their ids and cut into blocks of `block` rows. Target
weights give every source an exact quota of blocks. A binary tree over the output shards splits the vector of quotas
from the root down: a node sends its left half a multivariate-hypergeometric draw of its blocks, so every shard gets
the same number of blocks and each split is that of a uniform shuffle of all blocks. A shard's blocks of a source
follow those of the shard before it, hence are disjoint; its rows are then shuffled locally by a second hash.

Ranks come without a sort of a whole source: rows are counted by (source, hash bucket), and only buckets that hold a
border between shards are ranked inside, on narrow rows. The rows with their texts are shuffled once, to their shards.

Weights: a mapping by source name, in which sources without one get none, a function of the sources' blocks that gives
such a mapping, as `tempered()` does, or None, by which every block is drawn. The total is the largest at which no
block is drawn twice: that of the source with the fewest blocks for its weight. A source with under `scarce` of the
blocks for its weight that the median source has (by weight) doesn't set the total: it is drawn whole, and the others
share by their weights, so a tiny or null source can't shrink the draw.

The sources' counts (a row each) and the tree's upper part are on the driver, so sources are names of collections, some
thousands at most; take a site's collection, not its host.

Cases: a null source is a source of its own, spelled '' ; a source's last block may be short; a null id is an id like
another, and rows with equal ids stay together in one shard, so a quota can be off by the rows that repeat an id at a
border; texts do not matter; an empty table gives no rows; weights that allow no block give none; columns named like
those made here (shard, position) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidera.llm.common import numbered

#: Rows of the table of borders up to which it is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 50_000
BUCKET_ROWS = 1 << 14
#: Power of a source's blocks that is its target weight in op8 and the pipeline: under 1, large sources weigh less than
#: their size, as is usual for mixtures of corpora.
TEMPERATURE = 0.7
SCARCE = 0.5
Weights = dict[str, float] | Callable[[dict[str, int]], dict[str, float]] | None


def tempered(power: float = TEMPERATURE) -> Callable[[dict[str, int]], dict[str, float]]:
    """Target weights: each source's blocks to the given power."""
    return lambda blocks: {s: float(n) ** power for s, n in blocks.items()}


def quotas(blocks: dict[str, int], weights: Weights = None, scarce: float = SCARCE) -> dict[str, int]:
    """The blocks to draw from each source."""
    if weights is None:
        return dict(blocks)
    if callable(weights):
        weights = weights(blocks)
    part = {s: w for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    if not part:
        return dict.fromkeys(blocks, 0)
    room = {s: blocks[s] / w for s, w in part.items()}
    order = sorted(part, key=lambda s: (room[s], s))
    half = np.searchsorted(np.cumsum([part[s] for s in order]), sum(part.values()) / 2)
    least = scarce * room[order[min(half, len(order) - 1)]]
    whole = {s: blocks[s] for s in part if room[s] < least}
    part = {s: w for s, w in part.items() if s not in whole}
    total = sum(part.values())
    size = int(min(blocks[s] * total / w for s, w in part.items()) + 1e-9)
    exact = {s: size * w / total for s, w in part.items()}
    out = {s: int(x + 1e-9) for s, x in exact.items()}
    for s in sorted(part, key=lambda s: (out[s] - exact[s], s))[: size - sum(out.values())]:  # largest remainders
        out[s] = min(out[s] + 1, blocks[s])
    return {s: (whole | out).get(s, 0) for s in blocks}


def split(quota: np.ndarray, lo: int, hi: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The quotas of shards lo..mid and mid..hi of a node with the given quotas; the draw depends on seed, lo and hi only."""
    mid, total = (lo + hi) // 2, int(quota.sum())
    left = total * (mid - lo) // (hi - lo)
    draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, left, method="marginals") if total else quota * 0
    return draw, quota - draw


def grow(quota: np.ndarray, lo: int, hi: int, seed: int, leaves: int = 1) -> Iterator[tuple[np.ndarray, int, int]]:
    """The nodes below (lo, hi) that have at most `leaves` shards."""
    stack = [(quota, lo, hi)]
    while stack:
        q, a, b = stack.pop()
        if b - a <= leaves:
            yield q, a, b
        else:
            left, right = split(q, a, b, seed)
            stack += [(right, (a + b) // 2, b), (left, a, (a + b) // 2)]


def assign(docs: DataFrame, weights: Weights = None, scarce: float = SCARCE, block: int = 4, shard_rows: int = 4096, seed: int = 23, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' drawn rows with all their columns and (shard int, position int)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "position")
    key, order = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.xxhash64(F.lit(seed), F.col(id_col))
    narrow = docs.select(key.alias("__s"), order.alias("__h"))
    counts = {r[0]: r[1] for r in narrow.groupBy("__s").count().collect()}  # one row a source
    quota = quotas({s: -(-n // block) for s, n in counts.items()}, weights, scarce)
    names = sorted(quota)
    drawn = np.array([quota[s] for s in names], np.int64)
    shards = max(1, -(-int(drawn.sum()) * block // shard_rows))
    bits = max(0, int(np.ceil(np.log2(max(1, max(counts.values(), default=1) / BUCKET_ROWS)))))
    bucket: Column = F.shiftrightunsigned("__h", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    # buckets in the unsigned order of the hash
    unsigned = F.col("__h").bitwiseXOR(F.lit(-(2**63)))
    sized = narrow.groupBy("__s", bucket.alias("__b")).agg(F.count("*").alias("__n"))
    along = Window.partitionBy("__s").orderBy("__b")
    sized = sized.withColumn("__from", F.sum("__n").over(along) - F.col("__n"))
    # the tree: its upper part here, the subtrees in tasks
    tops = [(lo, hi, [int(x) for x in q]) for q, lo, hi in grow(drawn, 0, shards, seed, max(1, -(-shards // 256)))]

    def subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames if names else ():
            for lo, hi, q in zip(frame.lo, frame.hi, frame.q):
                leaves = list(grow(np.array(q, np.int64), int(lo), int(hi), seed))
                yield pd.DataFrame({"__s": names * len(leaves), "shard": np.repeat([a for _, a, _ in leaves], len(names)), "n": np.concatenate([x for x, _, _ in leaves])}).astype({"shard": "int32", "n": "int64"})

    tree = spark.createDataFrame(tops, "lo int, hi int, q array<bigint>").mapInPandas(subtrees, "__s string, shard int, n bigint")
    run = Window.partitionBy("__s").orderBy("shard")
    spans = tree.withColumn("__hi", F.sum("n").over(run) * block).withColumn("__lo", F.col("__hi") - F.col("n") * block).where("n > 0").select("__s", "shard", "__lo", "__hi")
    # each bucket with the shards whose ranks it meets
    met = sized.join(spans, "__s").where((F.col("__lo") < F.col("__from") + F.col("__n")) & (F.col("__hi") > F.col("__from")))
    met = met.select("__s", "__b", "shard", F.greatest(F.col("__lo") - F.col("__from"), F.lit(0)).alias("__at"), (F.col("__hi") - F.col("__from")).alias("__to"), "__n")
    edge = met.select("__s", "__b", F.explode(F.array("__at", "__to")).alias("__r"), "__n").where("__r > 0 and __r < __n").select("__s", "__b", "__r").distinct()
    inside = narrow.withColumn("__b", bucket).join(edge.select("__s", "__b").distinct(), ["__s", "__b"], "left_semi")
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy(unsigned)).cast("long") - 1)
    border = ranked.join(edge, ["__s", "__b", "__r"]).select("__s", "__b", "__r", unsigned.alias("__u"))
    starts = met.join(border.withColumnRenamed("__r", "__at").withColumnRenamed("__u", "__u0"), ["__s", "__b", "__at"], "left")
    starts = starts.join(border.withColumnRenamed("__r", "__to").withColumnRenamed("__u", "__u1"), ["__s", "__b", "__to"], "left")
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1)
    table = starts.groupBy("__s", "__b").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__u0", least).alias("lo"), F.coalesce("__u1", most).alias("hi"), F.col("__u1").isNull().alias("open"), "shard"))).alias("__cuts"))
    table = table.withColumnRenamed("__s", "__ks").withColumnRenamed("__b", "__kb")
    if sum(-(-n // BUCKET_ROWS) * 2 for n in counts.values()) + shards * len(names) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    # the row's shard is that of the cut that holds its hash; a source's rows beyond its quota meet none
    full = docs.withColumn("__s", key).withColumn("__h", order).withColumn("__b", bucket)
    placed = full.join(table, (F.col("__s") == F.col("__ks")) & (F.col("__b") == F.col("__kb")))
    hit = F.filter("__cuts", lambda c: (c.lo <= unsigned) & ((unsigned < c.hi) | c.open))
    placed = placed.withColumn("shard", F.get(hit, F.lit(0)).getField("shard")).where("shard is not null")
    second = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("__h"))
    local = Window.partitionBy("shard").orderBy(second, F.col(id_col))
    return placed.withColumn("position", (F.row_number().over(local) - 1).cast("int")).select(*docs.columns, "shard", "position")


def stage(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The drawn rows, laid out by shard and position, with the columns that came in."""
    plain = numbered(docs)
    name = dict(zip(docs.columns, plain.columns))
    drawn = assign(plain, id_col=name[id_col], source_col=name[source_col], **options).sortWithinPartitions("shard", "position")
    return drawn.select(*(F.col(p).alias(c) for c, p in name.items()))
