"""Nearest neighbours and comparisons of vector tables, by blocks of exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of queries and of a chunk of the corpus at most; a product of the two is one task's step.
BLOCK, CHUNK = 4096, 32_768
#: Rows and columns of a product that is held at once.
TILE = (256, 4096)


def _laid(df: DataFrame, key: str, columns: dict[str, str], number: str, count: int) -> DataFrame:
    """(number, the columns as named): `count` lots of rows by the key, each in a partition of its own; vectors lie end to end."""
    kinds = dict(df.dtypes)
    kept = {to: F.col(c) if kinds[c] in ("bigint", "array<float>") else F.col(c).cast("array<double>" if kinds[c].startswith("array") else "bigint") for c, to in columns.items()}
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias(number), F.struct(*(v.alias(to) for to, v in kept.items())).alias("r"))
    lots = rows.groupBy(number).agg(F.collect_list("r").alias("r"))
    laid = lots.select(number, *((F.flatten(f"r.{to}") if kinds[c].startswith("array") else F.col(f"r.{to}")).alias(to) for c, to in columns.items()))
    return laid.repartitionById(count, F.col(number))


def _numbers(batch: pa.RecordBatch, name: str, i: int, rows: int | None = None) -> np.ndarray:
    """The list of a row; of so many vectors, a matrix."""
    v = batch.column(name)[i].values.to_numpy(zero_copy_only=False)
    return v.astype(np.int64) if rows is None else v.astype(float).reshape(rows, -1)


def usable(df: DataFrame, key: str, col: str, dim: int | None) -> DataFrame:
    """Rows with a key and a vector of `dim` numbers, none of them null, NaN or infinite and not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & (F.size(col) == (dim or 0)) & ~bad & F.exists(col, lambda x: x != 0))


def nearest(q: np.ndarray, x: np.ndarray, c: np.ndarray, y: np.ndarray, k: int, skip_self: bool, normalize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, score): of each of the queries q with vectors x the k of c with vectors y of greatest product.

    A product in single precision and the bound of its error leave the pairs that may be among the k; only those are
    multiplied in double precision, so the result is that of all products in double precision.
    """
    at, to = (np.linalg.norm(v, axis=1) for v in (x, y))
    short, largest = (x / at[:, None]).astype(np.float32), 1.0 if normalize else float(to.max())
    if normalize:
        x, y, at = x / at[:, None], y / to[:, None], np.ones(len(x))
    long, error, found = (y / largest).astype(np.float32), (y.shape[1] + 8) * 2.0**-22, []

    def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        steps = range(0, len(row), 1 << 16)
        score = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", x[row[i : i + (1 << 16)]], y[col[i : i + (1 << 16)]]), 12) for i in steps)])
        return np.where((q[row] == c[col]) | ~np.isfinite(score), -np.inf, score) if skip_self else np.where(np.isfinite(score), score, -np.inf)

    for p in range(0, len(q), TILE[0]):
        n = min(TILE[0], len(q) - p)
        rows, cols, scores, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
        for j in range(0, len(c), TILE[1]):
            near = short[p : p + n] @ long[j : j + TILE[1]].T
            if j == 0 and near.shape[1] > k + 1:  # the best of the first product give a first bound
                best = np.argpartition(-near, k, axis=1)[:, : k + 1]
                bound = np.sort(exact(np.repeat(np.arange(p, p + n), k + 1), best.ravel()).reshape(n, -1), axis=1)[:, 1]
            row, col = np.divmod(np.flatnonzero(near >= (bound / at[p : p + n] / largest - error).astype(np.float32)[:, None]), near.shape[1])
            score = exact(row + p, col + j)
            ok = score > -np.inf
            rows, cols, scores = (np.concatenate(v) for v in ((rows, row[ok]), (cols, col[ok] + j), (scores, score[ok])))
            order = np.lexsort((c[cols], -scores, rows))
            rows = rows[order]
            size = np.bincount(rows, minlength=n)
            end = np.cumsum(size)
            ok = np.arange(len(rows)) - np.repeat(end - size, size) < k
            rows, cols, scores = rows[ok], cols[order][ok], scores[order][ok]
            size = np.bincount(rows, minlength=n)
            full = size == k
            bound[full] = scores[np.cumsum(size)[full] - 1]
        found.append((q[rows + p], c[cols], scores))
    return tuple(np.concatenate(v) for v in zip(*found))


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", col: str = "embedding", skip_self: bool = True, normalize: bool = True) -> DataFrame:
    """(query, neighbour, score, rank): the k of greatest product (cosine if normalized), ties to the lesser id.

    Every block of queries meets every chunk of the corpus once, a task each; a meeting returns k candidates a query, so
    what is shuffled is k rows for each query and chunk, not the pairs. Rows without a usable vector of the corpus's
    dimension are neither query nor neighbour. The products are quadratic; nothing else is.
    """
    dim = corpus.agg(F.max(F.size(col))).first()[0]
    queries, corpus = (usable(df, key, col, dim) for df in (queries, corpus))
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    n_q, n_c = (max(1, -(-df.count() // most)) for df, most in ((queries, BLOCK), (corpus, CHUNK)))
    n_q = max(n_q, min(3 * cores, n_q * 8))
    met = _laid(queries, key, {key: "q", col: "x"}, "nq", n_q).crossJoin(_laid(corpus, key, {key: "c", col: "y"}, "nc", n_c))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = (_numbers(batch, name, i) for name in "qc")
                x, y = _numbers(batch, "x", i, len(q)), _numbers(batch, "y", i, len(c))
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in nearest(q, x, c, y, k, skip_self, normalize)], ["query", "neighbour", "score"])

    found = met.select("q", "x", "c", "y").mapInArrow(best, "query bigint, neighbour bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overlap_at_k(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, overlap): mean share of common neighbours of two knn tables."""
    la = a.groupBy("query").agg(F.collect_set("neighbour").alias("x"))
    lb = b.groupBy("query").agg(F.collect_set("neighbour").alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return la.join(lb, "query").agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("overlap"))


def prefix_coincidence(neighbours: DataFrame, codes: DataFrame, levels: int, random_rank: Column, key: str = "vec_id", k: int = 10, lots: int = 256) -> DataFrame:
    """(length, n, share, random_share): of pairs of a row and its k nearest neighbours, and of rows paired at random,
    how many have codes that agree in their first `length` levels.

    At random each row goes with the next k of its lot (of `lots`, by the key) in the order of a hash, so no task orders all.
    """
    left = codes.select(F.col(key).alias("query"), F.col("codes").alias("cq"))
    right = codes.select(F.col(key).alias("neighbour"), F.col("codes").alias("cn"))
    near = neighbours.where(F.col("rank") <= k).select("query", "neighbour").join(left, "query").join(right, "neighbour").select("cq", "cn", F.lit(True).alias("near"))
    lot = Window.partitionBy(F.pmod(F.col(key), F.lit(lots))).orderBy(random_rank, key)
    ahead = codes.select(F.col("codes").alias("cq"), F.array(*(F.lead("codes", j).over(lot) for j in range(1, k + 1))).alias("next"))
    ahead = ahead.select("cq", F.explode("next").alias("cn")).where("cn is not null")
    both = near.unionByName(ahead.withColumn("near", F.lit(False)))
    marks = F.array(*(F.struct(F.lit(n).alias("length"), (F.slice("cq", 1, n) == F.slice("cn", 1, n)).cast("double").alias("s")) for n in range(1, levels + 1)))
    rows = both.select("near", F.explode(marks).alias("m")).groupBy("m.length")
    share = lambda x, name: F.round(F.avg(F.when(F.col("near") == x, F.col("m.s"))), 6).alias(name)
    return rows.agg(F.count_if("near").alias("n"), share(True, "share"), share(False, "random_share"))


def matrix(df: DataFrame, key: str, col: str, most: int = 2048) -> np.ndarray:
    """A small table of vectors on the driver, in the order of its key; ValueError beyond `most` rows."""
    rows = df.select(key, col).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    return np.array([r[1] for r in rows], float)


def gram(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums of products, sums, rows) of a table of any length, added up by partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, t, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                s, t, n = (x.T @ x if s is None else s + x.T @ x), (x.sum(0) if t is None else t + x.sum(0)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()]), pa.array([t.tolist()]), pa.array([n], pa.int64())], ["s", "t", "n"])

    parts = df.select(col).where(F.col(col).isNotNull()).mapInArrow(add, "s array<double>, t array<double>, n bigint")
    d = df.select(F.max(F.size(col))).first()[0]
    one = parts.select(F.posexplode("s").alias("k", "x"), F.lit(0).alias("w")).unionByName(parts.select(F.posexplode("t").alias("k", "x"), F.lit(1).alias("w"))).unionByName(parts.select(F.lit(0).alias("k"), F.col("n").cast("double").alias("x"), F.lit(2).alias("w")))
    got = {(r.w, r.k): r.x for r in one.groupBy("w", "k").agg(F.sum("x").alias("x")).collect()}
    return np.array([got[0, k] for k in range(d * d)]).reshape(d, d), np.array([got[1, k] for k in range(d)]), int(got[2, 0])


def effective_rank(df: DataFrame, col: str) -> float:
    """exp of the entropy of the squared singular values' shares."""
    values = np.clip(np.linalg.eigvalsh(gram(df, col)[0]), 0, None)
    p = values / values.sum()
    return float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))


def linear_cka(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(0), y - y.mean(0)
    return float(np.linalg.norm(x.T @ y) ** 2 / (np.linalg.norm(x.T @ x) * np.linalg.norm(y.T @ y)))


def cka(df: DataFrame, a: str, b: str) -> float:
    """Linear CKA of two vector columns of one table of any length, from the products of the columns laid side by side."""
    s, t, n = gram(df.select(F.concat(a, b).alias("v")), "v")
    s -= np.outer(t, t) / n
    d = df.select(F.max(F.size(a))).first()[0]
    return float(np.linalg.norm(s[:d, d:]) ** 2 / (np.linalg.norm(s[:d, :d]) * np.linalg.norm(s[d:, d:])))


#: Pairs up to which rsa() sorts all distances to rank them; beyond, they are ranked by so many bins of equal width.
SORTED, BINS = 1 << 25, 1 << 20
#: Vectors of a block of rsa() at most, and bins of a row of counts.
ROWS, PART = 2048, 1 << 16


def rsa(df: DataFrame, a: str, b: str, key: str, most: int = SORTED) -> DataFrame:
    """(pairs, pearson, spearman) of the cosine distances of all pairs of rows, in two vector columns.

    Up to `most` pairs the distances are sorted. Beyond, no pair is written: each is made twice, to count the distances by
    bins of 2 / BINS and then to add up the products of the bins' mean ranks. Against ranks by sorting, spearman then
    differs by the order within bins, for a smooth distribution by about 1 / (bins in use)^2 and at most about 2 / (bins in use).
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(key).isNotNull())
    cores, n = max(1, df.sparkSession.sparkContext.defaultParallelism), rows.count()
    pairs = n * (n - 1) // 2
    count = max(1, -(-n // ROWS), min(2 * cores, -(-n // 256)))
    left, right = (_laid(rows, key, {a: f"a{k}", b: f"b{k}", key: f"id{k}"}, f"n{k}", count) for k in "xy")
    met = left.join(right, F.col("nx") <= F.col("ny"))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cosines of the pairs of two blocks, in steps that fit the memory."""
        for batch in batches:
            for i in range(batch.num_rows):
                m, n = (len(batch.column(f"id{k}")[i]) for k in "xy")
                same = batch.column("nx")[i].as_py() == batch.column("ny")[i].as_py()
                units = []
                for c in "ab":
                    for k, size in (("x", m), ("y", n)):
                        v = _numbers(batch, c + k, i, size)
                        with np.errstate(invalid="ignore"):
                            units.append(v / np.linalg.norm(v, axis=1, keepdims=True))
                for p in range(0, m, TILE[0]):
                    x, y = (u[p : p + TILE[0]] @ w.T for u, w in (units[:2], units[2:]))
                    pick = np.arange(n)[None] > np.arange(p, p + len(x))[:, None] if same else slice(None)
                    yield x[pick].ravel(), y[pick].ravel()

    if pairs <= most:
        return _sorted_rsa(met, cosines)

    def bins(x: np.ndarray) -> np.ndarray:
        """The bin of the distance 1 - x; the last is of distances that are not a number."""
        with np.errstate(invalid="ignore"):
            at = ((1 - x) * (BINS / 2)).astype(np.int64)
        return np.where(np.isnan(x), BINS, np.clip(at, 0, BINS - 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = np.zeros((2, BINS + PART), np.int64), np.zeros(6)
        for x, y in cosines(batches):
            sums += len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
            for k, v in enumerate((x, y)):
                sizes[k] += np.bincount(bins(v), minlength=BINS + PART)
        if sums[0]:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([sums.tolist()])], ["part", "v"])
            for k, v in enumerate(sizes.reshape(-1, PART)):
                if v.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.astype(float).tolist()])], ["part", "v"])

    def added(key, t):
        v = t["v"].combine_chunks()
        return pa.table({"part": [key[0].as_py()], "v": [v.values.to_numpy(zero_copy_only=False).reshape(len(v), -1).sum(0).tolist()]}, pa.schema([("part", pa.int64()), ("v", pa.list_(pa.float64()))]))

    met = met.coalesce(3 * cores)
    total = {r.part: np.array(r.v) for r in met.mapInArrow(counted, "part bigint, v array<double>").groupBy("part").applyInArrow(added, "part bigint, v array<double>").collect()}  # of fixed size
    n, sx, sy, xx, yy, xy = total.pop(-1)
    sizes = np.zeros((2, BINS + PART))
    for k, v in total.items():
        sizes.reshape(-1, PART)[k] = v
    ranks = np.cumsum(sizes, axis=1) - sizes / 2 - n / 2  # less the mean of all
    spread = np.sqrt((sizes * ranks**2).sum(1))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sum((float(ranks[0][bins(x)] @ ranks[1][bins(y)]) for x, y in cosines(batches)), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([s])], ["s"])

    with np.errstate(invalid="ignore"):
        pearson = (xy - sx * sy / n) / np.sqrt((xx - sx * sx / n) * (yy - sy * sy / n))
    one = met.mapInArrow(products, "s double").agg(F.sum("s").alias("s"))
    return one.select(F.lit(int(n)).cast("bigint").alias("pairs"), F.round(F.lit(float(pearson)), 6).alias("pearson"), F.round(F.col("s") / F.lit(float(spread.prod())), 6).alias("spearman"))


def _sorted_rsa(met: DataFrame, cosines) -> DataFrame:
    """(pairs, pearson, spearman) with the ranks of all distances by sorting."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in cosines(batches):
            yield pa.RecordBatch.from_arrays([pa.array(1 - x), pa.array(1 - y)], ["x", "y"])

    d = met.mapInArrow(far, "x double, y double")
    ranked = d
    for c in ("x", "y"):  # average ranks by counting equal values, lot by lot of the range that distances have
        sizes = d.groupBy(F.round(c, 12).alias(f"v{c}")).agg(F.count("*").alias("c")).withColumn("lot", F.floor(F.col(f"v{c}") * 1000).cast("int"))
        lots = sizes.groupBy("lot").agg(F.sum("c").alias("size"))  # 2001 at most
        lots = lots.select("lot", (F.sum("size").over(Window.orderBy("lot")) - F.col("size")).alias("before"))
        rank = sizes.withColumn("upto", F.sum("c").over(Window.partitionBy("lot").orderBy(f"v{c}"))).join(F.broadcast(lots), "lot")
        rank = rank.select(f"v{c}", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias(f"r{c}"))
        ranked = ranked.withColumn(f"v{c}", F.round(c, 12)).join(rank, f"v{c}")
    return ranked.agg(F.count("*").alias("pairs"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def moments(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance) of a table of any length."""
    s, t, n = gram(df, col)
    return t / n, (s - np.outer(t, t) / n) / max(1, n - 1)


def kmeans(df: DataFrame, col: str, k: int, iterations: int = 10, seed: int = 42):
    """MLlib's model of k centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="v").fit(df.select(array_to_vector(F.col(col).cast("array<double>")).alias("v")))


def initial_rows(kind: str, n: int, dim: int, seed: int, mean: np.ndarray | None = None, cov: np.ndarray | None = None, scale: float = 0.02, titles: list[np.ndarray] | None = None, codebook: np.ndarray | None = None) -> np.ndarray:
    """n new embedding rows: 'isotropic', 'mvn' (of a mean and covariance), 'title_mean' (rows of token vectors averaged,
    the mean where there are none) or 'projected' (a codebook by an orthonormal map that keeps distances)."""
    rng = np.random.default_rng(seed)
    if kind == "isotropic":
        return rng.standard_normal((n, dim)) * scale
    if kind == "mvn":
        return rng.multivariate_normal(mean, cov, size=n, method="eigh")
    if kind == "title_mean":
        return np.stack([t.mean(0) if len(t) else mean for t in titles])
    if kind == "projected":
        q = np.linalg.qr(rng.standard_normal((dim, codebook.shape[1])))[0]
        return codebook @ q.T
    raise ValueError(f"unknown kind {kind}")


def rescale(rows: np.ndarray, target: float) -> np.ndarray:
    """rows with the given Frobenius norm."""
    return rows * (target / max(float(np.linalg.norm(rows)), 1e-12))


def frobenius_target(table: np.ndarray, n: int, slices: int = 32, seed: int = 42) -> float:
    """Mean Frobenius norm of random slices of n rows."""
    rng = np.random.default_rng(seed)
    return float(np.mean([np.linalg.norm(table[rng.choice(len(table), n, replace=False)]) for _ in range(slices)]))
