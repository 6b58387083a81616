"""Steps that stay bounded on large tables, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sidera.operators import vectors


def test_ranks_by_bins(spark):
    """No pair is written beyond a number of pairs, and the correlations are those of sorted distances."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 6))
    x[1::50] = x[::50]  # copies, so there are equal distances
    df = spark.createDataFrame([(k, v.tolist(), v[:3].tolist()) for k, v in enumerate(x)], "vec_id bigint, a array<double>, b array<double>")
    d = []
    for v in (x, x[:, :3]):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d.append(pd.Series(np.round(1 - (u @ u.T)[np.triu_indices(900, 1)], 12)))
    want = (len(d[0]), d[0].corr(d[1]), d[0].rank().corr(d[1].rank()))
    for most in (0, vectors.SORTED):
        assert tuple(vectors.rsa(df, "a", "b", "vec_id", most).first()) == pytest.approx(want, abs=1.1e-6)
    zero = df.union(spark.createDataFrame([(900, [0.0] * 6, [0.0] * 3)], df.schema))
    assert np.isnan(vectors.rsa(zero, "a", "b", "vec_id", 0).first().pearson)


@pytest.mark.parametrize(("n", "m", "d", "normalize"), [(600, 9000, 16, True), (600, 9000, 16, False), (900, 5000, 3, True), (9, 9, 4, False)])
def test_nearest_by_all_products(n, m, d, normalize):
    """Ties at the k-th place, copies and large vectors; what single precision leaves out is never among the k."""
    rng = np.random.default_rng(m)
    y = np.round(rng.standard_normal((m, d)) * 3) * 10.0 ** rng.integers(0, 3, (m, 1))
    y[~y.any(1), 0] = 1
    c = rng.permutation(m)
    x, q, k = y[:n], c[:n], 5
    u, w = (v / np.linalg.norm(v, axis=1, keepdims=True) if normalize else v for v in (x, y))
    s = np.round(np.einsum("id,jd->ij", u, w), 12)
    s[q[:, None] == c[None]] = -np.inf
    order = np.lexsort((np.broadcast_to(c, s.shape), -s), axis=1)[:, :k]
    got = vectors.nearest(q, x, c, y, k, True, normalize)
    assert np.array_equal(got[0], np.repeat(q, k)) and np.allclose(got[2], np.take_along_axis(s, order, 1).ravel(), atol=2e-12)
    assert np.mean(got[1] == c[order].ravel()) > 0.999  # the last digit may part ties in either


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "CHUNK", 150)
    v = np.random.default_rng(3).standard_normal((700, 5))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    v = v.astype(np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(i, int(j), r + 1) for i in range(700) for r, j in enumerate(np.lexsort((np.arange(700), -s[i]))[:4])}
    assert {(r.query, r.neighbour, r.rank) for r in vectors.knn(df, df, 4).collect()} == want


def test_predictions_join_an_order_once(spark, sf):
    """An order is no row for each of its predictions; parts past the last are the first again."""
    from sidera.plans import fixtures

    df = fixtures.predictions(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(-1, 9" not in plan and df.count() == fixtures.table(spark, sf, "orders").count()
    parts = fixtures.table(spark, sf, "part").count()
    code = {r.p_partkey: tuple(str(r[x]) for x in "ABCD") for r in fixtures.sids(spark, sf).select("p_partkey", *"ABCD").collect()}
    keys = {r.o_orderkey: (r.o_custkey * 7 + r.o_orderkey) % parts for r in fixtures.table(spark, sf, "orders").collect()}
    for r in df.where("sample_id % 7 = 3").collect():
        k, g = r.sample_id, keys[r.sample_id]
        assert r.gold == (None if k % 50 == 0 else code[g])
        assert list(r.beams) == [None if (k + j) % 17 == 0 else code[g if j == k % 13 else (g + (j + 1) * (k % 5 + 1) * 8) % parts] for j in range(10)]


def test_counts_of_types_without_texts(spark, sf):
    """Counted by numbers as by the texts of all samples; no pair's or history's text is shuffled."""
    from sidera.plans import fixtures, registry, samples

    names = ("seq_last_", "copurchase_")
    texts = samples.all_samples(fixtures.sids(spark, sf), fixtures.sid_sequences(spark, sf)).groupBy("type").agg(F.count("*"), F.count_distinct("instruction"))
    df = registry.QUERIES["type_distribution"](spark, sf)
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in texts.collect()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(text in plan for text in ("might also buy", "Predict next")) and any(n in plan for n in names)


def test_sequences_of_numbers(spark, sf):
    """As by joining the items of each sequence after its cut."""
    from sidera.operators import sequences
    from sidera.plans import fixtures

    want = sequences.to_sids(fixtures.user_sequences(spark, sf), fixtures.sids(spark, sf).select("item_id", "sid"))
    got = fixtures.sid_sequences(spark, sf)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_picks_of_a_coverage_are_not_shuffled(spark):
    from sidera.operators import statistics

    df = spark.createDataFrame([("t", k, [f"x{k % 5}"], [f"x{k % 5}", f"x{k % 5}", f"y{k}"]) for k in range(40)], "g string, k int, a array<string>, b array<string>")
    made = statistics.coverage_bootstrap(df, "g", "k", "a", "b", 100, times=200)
    assert made.first().delta == pytest.approx(0.40)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [item" in plan and plan.count("Aggregate") == 2  # no distinct of rows before


def test_characters_beyond_the_first_plane(spark):
    from sidera.functions import arrays

    rows = [("a\U0001f600b", "\U0001f600 \U0001f600"), ("AbA", "baa"), ("", " "), ("x", ""), (None, "x"), ("abc", "def")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(arrays.char_f1(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.4), 1.0, 1.0, 0.0, None, 0.0]
