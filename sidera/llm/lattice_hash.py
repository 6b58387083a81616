"""Operator 2: near-duplicate embeddings by lattice hashing.

In each of `tables` tables a vector at length one is projected at random to `blocks` blocks of eight dimensions, scaled,
and each block is decoded to the nearest point of the lattice E8; the points are the vector's cell. Every vector is
kept under its own cell and asks for it and the `probes` neighbouring cells that lie nearest beyond it, reached by one
of the 240 shortest lattice vectors in one block. Vectors that meet are verified by their exact cosine.

Every row is a query and every partner counts: pairs have no cap. Equal vectors are hashed once. groups() gives one row
an id, with its class and the number of its pairs; pairs() gives the pairs themselves, those of equal vectors by a join
of their own.

Cases: vectors that are null, empty, of length zero, or hold a null, NaN or infinity, and rows with a null id, are in
no pair (such an id is a group of its own, a null id has no row); vectors of different dimensions are never compared; rows that repeat an id count once (the least vector);
pairs are (lesser id, greater id), each once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import GOLD, components, durable, mix64

THRESHOLD, TABLES, BLOCKS, PROBES, SCALE = 0.95, 10, 2, 12, 2.2


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (D8)."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1).astype(np.int64) % 2)
    gap = x[odd] - f[odd]
    worst = np.abs(gap).argmax(1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 moved by one half in every coordinate."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=64)
def projection(dim: int, table: int, blocks: int, seed: int = 5) -> np.ndarray:
    """dim x 8 * blocks, with orthonormal columns where dim allows; it keeps the mean square of distances."""
    rng = np.random.default_rng([seed, dim, table])
    g = rng.standard_normal((dim, 8 * blocks))
    q = np.linalg.qr(g)[0] if dim >= 8 * blocks else g / np.sqrt(dim)
    return q * np.sqrt(dim)


def cells(x: np.ndarray, table: int, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """vectors x (1 + probes) keys of unit vectors: their own cell, then the nearest of the neighbouring cells."""
    y = (x @ projection(x.shape[1], table, blocks)) * (scale / np.sqrt(8.0))
    points = np.stack([nearest(y[:, 8 * k : 8 * k + 8]) for k in range(blocks)], 1)
    probes = min(probes, blocks * len(roots()))
    where = np.repeat(points[:, None], 1 + probes, 1)
    if probes:
        rest = y.reshape(len(y), blocks, 8) - points
        gain = (rest @ roots().T).reshape(len(y), -1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]  # in no order: all of them are asked
        rows = np.repeat(np.arange(len(y)), probes)
        where[rows, np.tile(np.arange(1, probes + 1), len(y)), best.ravel() // 240] += roots()[best.ravel() % 240]
    code = np.rint(where.reshape(len(y), 1 + probes, -1) * 2).astype(np.int64).astype(np.uint64)
    key = np.full(code.shape[:2], mix64(np.array([table + 1 + 1000 * x.shape[1]], np.uint64) * GOLD)[0])
    for k in range(code.shape[2]):
        key = mix64(key * np.uint64(0x100000001B3) + code[:, :, k])
    return key.view(np.int64)


def unit(lists: pa.Array) -> tuple[np.ndarray, int]:
    """The vectors of an array of equally long lists, at length one."""
    dim = len(lists[0])
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True), dim


def _spread(tables: int, blocks: int, probes: int, scale: float, name: str):
    """(id by that name, cell) of the own cells of vectors and of so many of their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                for a in range(0, part.num_rows, 1024):
                    piece = part.slice(a, 1024)
                    x, _ = unit(piece.column("v"))
                    for t in range(tables):
                        keys = cells(x, t, blocks, probes, scale)
                        n, w = keys.shape
                        yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(np.repeat(np.arange(n), w))), pa.array(keys.ravel())], [name, "cell"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = pa.compute.list_value_length(batch.column("va")).to_numpy(zero_copy_only=False)
        cosine = np.full(batch.num_rows, -2.0)  # keys of different dimensions hardly ever meet; if so they are no pair
        same = a == pa.compute.list_value_length(batch.column("vb")).to_numpy(zero_copy_only=False)
        for dim in np.unique(a[same]):
            at = np.flatnonzero(same & (a == dim))
            part = batch.take(pa.array(at))
            cosine[at] = (unit(part.column("va"))[0] * unit(part.column("vb"))[0]).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], ["a", "b", "cosine"])


def _close(vectors: DataFrame, threshold: float, tables: int, blocks: int, probes: int, scale: float, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, same) of every vector, (same, rep, n) of unequal ones, and (a, b, cosine) of those of them that are close, by rep."""
    v = F.col("v")
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vectors = vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    source = durable(source.groupBy("id").agg(F.min("v").alias("v")))
    kind = source.schema["id"].dataType.simpleString()
    # equal vectors: the least id stands for all of them
    by = source.select("id", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("double").cast("string")), ","), 256).alias("same"))
    reps = durable(by.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    alone = source.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    # own cells are made apart from the asked ones: it costs less than to write all of them for two readers
    homes = alone.mapInArrow(_spread(tables, blocks, 0, scale, "a"), f"a {kind}, cell bigint")
    asked = alone.mapInArrow(_spread(tables, blocks, probes, scale, "b"), f"b {kind}, cell bigint")
    met = homes.join(asked, "cell").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (alone.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    close = met.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_cosines, f"a {kind}, b {kind}, cosine double").where(F.col("cosine") >= threshold)
    return by, reps, close


def pairs(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, cosine) of the pairs found whose cosine is at least the threshold."""
    by, reps, close = _close(vectors, threshold, tables, blocks, probes, scale, id_col, vector_col)
    # back to all ids
    one, two = (by.join(reps, "same").select("same", "n", F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("a", "x"), ("b", "y")))
    wide = close.join(one.select("a", "x"), "a").join(two.select("b", "y"), "b").select("x", "y", "cosine")
    twins = one.where("n > 1").join(two.select("same", "y"), "same").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    every = wide.unionByName(twins) if threshold <= 1 else wide
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def groups(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, group_id, links) of every id: the least id that pairs() leads to, and in how many of its pairs the id is.

    Equal vectors are counted, not expanded: what is written grows with the rows. An id in no pair is a group of its own.
    """
    by, reps, close = _close(vectors, threshold, tables, blocks, probes, scale, id_col, vector_col)
    close = durable(close.select("a", "b"))
    ends = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = ends.join(reps.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    twins = F.col("n") - 1 if threshold <= 1 else F.lit(0)
    of_reps = reps.join(more, "rep", "left").join(components(close).withColumnRenamed("id", "rep"), "rep", "left")
    of_reps = of_reps.select("same", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("more", F.lit(0)) + twins).alias("links"))
    found = by.join(of_reps, "same").select("id", "group_id", "links")
    every = vectors.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(found, "id", "left")
    return every.select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def oracle(threshold: float = THRESHOLD, table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """All pairs by brute force and the groups they make, in DuckDB's SQL: what groups() gives at full recall."""
    one = f"one as materialized (select {id_col} as id, {vector_col}::double[] as v from {table})"
    ends = f"ends as materialized (select x.id as a, y.id as b from one x join one y on x.id <> y.id where list_cosine_similarity(x.v, y.v) >= {threshold})"
    reach = "reach(id, other) as (select a, b from ends union select reach.id, ends.b from reach join ends on reach.other = ends.a)"
    least, links = "(select id, min(other) as least from reach group by id)", "(select a, count(*) as n from ends group by a)"
    return f"with recursive {one}, {ends}, {reach} select one.id as {id_col}, least(one.id, coalesce(r.least, one.id)) as group_id, coalesce(l.n, 0) as links from one left join {least} r on r.id = one.id left join {links} l on l.a = one.id"
