"""Readers, items, sequences, statistics and vectors on hand-written rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidera import schemas
from sidera.operators import items, quality, sequences, statistics, vectors
from sidera.operators.semantic_ids import assign_d
from sidera.plans import samples
from sidera.sources import io
from sidera.streaming import incremental

META = [
    {"parent_asin": "A", "main_category": "M", "title": "t" * 51, "average_rating": 4.5, "rating_number": 20, "features": ["f1", "f2"], "description": ["d" * 300, "e" * 300], "price": 9.99, "store": None, "categories": ["P", "Q"]},
    {"parent_asin": "B", "main_category": None, "title": "t" * 50, "rating_number": 99, "features": [], "description": ["d" * 600], "categories": []},
    {"parent_asin": "C", "title": "u" * 60, "rating_number": 19, "description": ["d" * 600]},
    {"parent_asin": None, "title": "u" * 60, "rating_number": 50, "description": ["d" * 600]},
]


def test_items(spark, tmp_path):
    path = tmp_path / "meta.jsonl"
    path.write_text("\n".join([*map(json.dumps, META), "{broken", ""]))
    meta = io.read_ndjson(spark, str(path))
    assert meta.count() == 4
    made = items.prepare(meta).collect()
    assert [r.parent_asin for r in made] == ["A"]
    r = made[0]
    assert r.features_text == "f1 f2" and r.categories_text == "P > Q" and r.store == ""
    assert r.item_context.startswith("Product: ttt") and r.item_context.endswith("Average rating: 4.5, Rating count: 20\n\nPrice: 9.99\n\nCategories: P > Q")


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("user_id,parent_asin,rating,timestamp\nu,a,5.0,3\nu,,4.0,1\n")
    df = io.read_csv(spark, str(path), ["user_id", "parent_asin", "timestamp"], schemas.RATINGS)
    assert dict(df.dtypes)["timestamp"] == "bigint" and sequences.clean_events(df).count() == 1
    with pytest.raises(ValueError, match="place"):
        io.read_csv(spark, str(path), ["user_id", "place"])


def test_log_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "k string, n int, clean string, error string"
    io.append_log(spark.createDataFrame([("a", 1, None, "boom"), ("b", 1, "B", None)], schema), path)
    io.append_log(spark.createDataFrame([("a", 2, "A", None), ("b", 2, None, "late")], schema), path)
    latest, done = io.read_log(spark, path, "k", "n", schema)
    assert {r.k: r.clean for r in latest.collect()} == {"a": "A", "b": None} and [r.k for r in done.collect()] == ["a"]
    things = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    log = io.read_ndjson(spark, path, schema)
    assert sorted(r.k for r in incremental.todo(things, log, "k", "n").collect()) == ["b", "c"]
    assert {r.k: r.clean for r in incremental.results(things, log, "k", "n", ["clean"]).collect()} == {"a": "A", "b": None, "c": None}


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    io.append_log(spark.createDataFrame([("a", 1), (None, 2)], "k string, n int"), src)
    for _ in range(2):  # the second run has nothing new
        q = incremental.stream_results(spark.readStream.schema("k string, n int").json(src), "k", lambda df, n: io.append_log(df, out), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert [r.k for r in spark.read.json(out).collect()] == ["a"]


def test_rewrite_and_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_parquet(spark.range(3).withColumn("type", F.lit("x")), path, ["type"])
    back = io.rewrite(io.read_parquet(spark, path, ["id"]).select((F.col("id") + 1).alias("id")), path)
    assert sorted(r.id for r in back.collect()) == [1, 2, 3]
    for n in (20, 3):
        (tmp_path / f"step_{n}.json").write_text(json.dumps({"v": n * 2}, indent=1))
    assert [(r.step, r.v) for r in io.read_steps(spark, f"{tmp_path}/step_*.json").collect()] == [(3, 6), (20, 40)]
    assert io.resolve([str(tmp_path / "none"), path]) == path and io.resolve([]) is None
    io.write_parquet(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<float>"), path + "v")
    assert io.read_vectors(spark, path + "v")[1] == 2
    io.write_parquet(spark.createDataFrame([([1.0],), ([3.0, 4.0],)], "embedding array<float>"), path + "w")
    with pytest.raises(ValueError, match="1 to 2"):
        io.read_vectors(spark, path + "w")


def test_sequences(spark):
    events = spark.createDataFrame([("u", f"i{k % 7}", k) for k in range(130)] + [("v", "i1", 1)], "user_id string, item_id string, ts int")
    got = sequences.build(events, "user_id", "item_id", ["ts"]).collect()
    assert [(r.user_id, r.seq_len, r.sequence[0], r.sequence[-1]) for r in got] == [("u", 100, "i2", "i3")]
    codes = spark.createDataFrame([(f"i{k}", f"s{k}") for k in range(6)], "item_id string, sid string")
    mapped = sequences.to_sids(spark.createDataFrame([("u", [f"i{k % 7}" for k in range(14)])], "user_id string, sequence array<string>"), codes).first()
    assert mapped.sid_sequence == [f"s{k % 7}" for k in range(14) if k % 7 < 6]


@pytest.mark.parametrize(("n", "frac", "first"), [(0, 0.1, True), (7, 0.1, True), (101, 0.05, True), (101, 0.1, False), (1, 1.0, True)])
def test_split(spark, n, frac, first):
    df = sequences.split_exact(spark.range(n), (F.col("id") * 2654435761) % 2147483648, ["id"], frac, first)
    rows = {r.id: r.split for r in df.collect()}
    order = sorted(range(n), key=lambda k: (k * 2654435761 % 2147483648, k))
    take = int(n * frac)
    val = set(order[:take] if first else order[n - take :])
    assert {k for k, v in rows.items() if v == "val"} == val and len(rows) == n


def test_many_of_one_code(spark):
    df = assign_d(spark.range(300).select("id", F.lit(1).alias("A"), F.lit(2).alias("B"), F.lit(3).alias("C")), "id")
    assert df.agg(F.max("D"), F.count_distinct("D")).first() == (299, 300)


def test_empty_snippets(spark):
    rows = spark.createDataFrame([("s", " " * 130)], "sid string, description_text string")
    assert samples.description_contains_to_sid(rows).count() == 0 and samples.description_contains_to_sid(rows, empty_snippet=True).count() == 1


def test_bootstraps(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, 300).astype(float)
    df = spark.createDataFrame([("t", k, float(x), float(min(1, x + (k % 3 == 0)))) for k, x in enumerate(a)], "g string, k int, a double, b double")
    ci = statistics.bootstrap_ci(df, "g", "a").first()
    assert ci.lo <= ci.mean <= ci.hi and ci.mean == pytest.approx(a.mean()) and abs((ci.hi - ci.lo) - 2 * 1.96 * a.std() / 300**0.5) < 0.02
    p = statistics.paired_bootstrap(df, "g", "k", "a", "b", times=2000).first()
    assert p.significant and p.significant_bonf and p.p == 0 and p.lo > 0 and p.lo_bonf <= p.lo
    same = statistics.paired_bootstrap(df, "g", "k", "a", "a", times=200).first()
    assert same.delta == 0 and same.p == 1 and not same.significant
    sets = spark.createDataFrame([("t", k, [f"x{k % 5}"], [f"x{k % 5}", f"y{k}"]) for k in range(40)], "g string, k int, a array<string>, b array<string>")
    c = statistics.coverage_bootstrap(sets, "g", "k", "a", "b", 100, times=200).first()
    assert c.delta == pytest.approx(0.40) and 0 < c.lo <= c.hi <= 0.40
    assert statistics.bonferroni() == pytest.approx(0.05 / 3)


def test_packing(spark):
    df = spark.createDataFrame([(k, [k] * n) for k, n in enumerate([3, 4, 5, 20])], "k int, ids array<int>").coalesce(1)
    got = [(r.pack, r.used, list(r.ids)) for r in statistics.packed(df, "k", "ids", 8).collect()]
    assert [(p, u) for p, u, _ in got] == [(0, 7), (1, 5), (2, 8)] and all(len(i) == 8 for _, _, i in got)
    assert [len(x) for x in statistics.pack([3, 4, 5, 20], 8)] == [2, 1, 1]
    assert statistics.label_mask([9, 1, 2, 5, 3, 7], [1, 2], 3) == [-100, -100, -100, 5, 3, -100]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 5)), rng.standard_normal((60, 3))
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))], "vec_id int, a array<double>, b array<double>")
    p = np.linalg.svd(x)[1] ** 2
    p /= p.sum()
    assert vectors.effective_rank(df, "a") == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert vectors.cka(df, "a", "b") == pytest.approx(vectors.linear_cka(x, y)) and vectors.linear_cka(x, x) == pytest.approx(1)
    mean, cov = vectors.moments(df, "a")
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    assert np.allclose(vectors.matrix(df, "vec_id", "a"), x)
    with pytest.raises(ValueError, match="over 10"):
        vectors.matrix(df, "vec_id", "a", 10)
    book = rng.standard_normal((12, 3))
    rows = vectors.initial_rows("projected", 12, 8, 0, codebook=book)
    assert np.allclose(rows @ rows.T, book @ book.T) and np.linalg.norm(vectors.rescale(rows, 2.5)) == pytest.approx(2.5)
    assert np.array_equal(vectors.initial_rows("isotropic", 3, 4, 1), vectors.initial_rows("isotropic", 3, 4, 1)) and vectors.initial_rows("mvn", 6, 5, 1, mean, cov).shape == (6, 5)
    assert np.allclose(vectors.initial_rows("title_mean", 2, 5, 0, mean=mean, titles=[x[:3], x[:0]]), [x[:3].mean(0), mean])
    assert vectors.frobenius_target(x, 10) > 0
    with pytest.raises(ValueError, match="unknown"):
        vectors.initial_rows("other", 1, 1, 0)


def test_gates(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.1,)], "v double")
    assert [r[0] for r in df.select(quality.gate(F.col("v"), 0.7, 0.4)).collect()] == ["OK", "WARN", "FAIL"]
    assert [r[0] for r in df.select(quality.gate(F.col("v"), 0.2, 0.6, False)).collect()] == ["FAIL", "WARN", "OK"]


def test_seeded_hash_of_large_keys(spark):
    """No key overflows, both engines agree, and another seed gives another order, not the same one turned."""
    import duckdb

    from sidera.plans.registry import spread, spread_sql

    keys = [0, 1, -5, 4 * 10**9, 10**12, 2**62, -(2**62), *range(2, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: (r.a, r.b) for r in df.select("k", spread("k", 42).alias("a"), spread("k", 7).alias("b")).collect()}
    con = duckdb.connect()
    con.execute("create table t(k bigint)")
    con.executemany("insert into t values (?)", [(k,) for k in keys])
    assert got == {k: (a, b) for k, a, b in con.execute(f"select k, {spread_sql('k', 42)}, {spread_sql('k', 7)} from t").fetchall()}
    assert all(0 <= x < 2**31 for v in got.values() for x in v)
    first, second = (sorted(range(2, 400), key=lambda k: got[k][i]) for i in (0, 1))
    turn = second.index(first[0])
    assert sum(a == b for a, b in zip(first, second[turn:] + second[:turn])) < 40
    split = sequences.split_exact(df, spread("k", 42), ["k"], 0.1, True)
    assert split.where("split = 'val'").count() == len(keys) // 10


def test_many_items_of_one_code(spark):
    df = spark.range(40_000).selectExpr("id", "1 as A", "2 as B", "3 as C")
    assert assign_d(df, "id").agg(F.max("D")).first()[0] == 39_999


def test_neighbours_without_usable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, None]), (8, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query, r.neighbour) for r in vectors.knn(df, df, 5).collect()}
    assert got == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}
    assert vectors.knn(df.limit(0), df.limit(0), 5).count() == 0


def test_numbers_of_a_context(spark):
    df = spark.createDataFrame([(9.5, 4.25), (4.25, 10.0), (12345678.0, 0.5), (None, None)], "price double, average_rating float")
    got = [tuple(r) for r in df.select(items.plain_number(F.col("price")), items.plain_number(F.col("average_rating"))).collect()]
    assert got == [("9.5", "4.25"), ("4.25", "10.0"), ("12345678", "0.5"), ("", "")]


def test_enriched_context_without_extracted_columns(spark):
    df = spark.createDataFrame([("t", None, None, None, "M")], "title string, description_text string, categories_text string, features_text string, main_category string")
    want = "Title: t\nDescription: \nCategory: M\nFeatures: \nPet Species: N/A\nProduct Type: N/A\nLife Stage: N/A\nPrimary Use Case: N/A\nMaterial/Active: N/A"
    assert df.select(items.enriched_context(df)).first()[0] == want
    assert items.features_or_original(df).columns == df.columns


def test_sample_sizes():
    kinds = {"a": "sid_prediction", "b": "text_generation", "c": "other"}
    assert samples.sample_sizes(kinds) == {"a": 1000, "b": 1000, "c": 200}
    assert samples.sample_sizes(kinds, 50) == dict.fromkeys("abc", 50)
    assert samples.sample_sizes(kinds, 50, 7) == {"a": 50, "b": 7, "c": 50} and samples.sample_sizes(kinds, None, 7)["b"] == 7


def test_label_masks_by_a_plain_version(spark):
    rng = np.random.default_rng(0)
    for begin in ([1, 2], [1, 1], [3], [1, 2, 1]):
        lists = [rng.integers(0, 5, rng.integers(0, 30)).tolist() for _ in range(150)] + [None]
        df = spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>")
        got = {r.k: r.m for r in df.select("k", statistics.masked(F.col("ids"), begin, 4).alias("m")).collect()}
        assert got == {k: None if v is None else statistics.label_mask(v, begin, 4) for k, v in enumerate(lists)}


def test_packs_by_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, list(range(1, int(rng.integers(0, 25))))) for k in range(200)]
    got = statistics.packed(spark.createDataFrame(rows, "k int, s int, ids array<int>"), "k", "ids", 20, shard="s").collect()
    for s in range(3):
        mine = [v[:20] for k, t, v in rows if t == s]
        want = [[x for k in p for x in mine[k]] for p in statistics.pack([len(v) for v in mine], 20)]
        have = [r.ids[: r.used] for r in sorted((r for r in got if r.shard == s), key=lambda r: r.pack)]
        assert have == [w for w in want if w] and all(len(r.ids) == 20 for r in got)


def test_bootstraps_by_plain_resampling(spark):
    """Ends of the intervals against resampling of the very samples, in their spread."""
    rng = np.random.default_rng(2)
    a, b = rng.random(300) < 0.5, rng.random(300) < 0.6
    df = spark.createDataFrame([("t", k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "task string, sample_id int, a double, b double")
    pick = rng.integers(0, 300, (4000, 300))
    means, deltas = np.sort(b[pick].mean(1)), (b.astype(float) - a)[pick].mean(1)
    r = statistics.bootstrap_ci(df, "task", "b").first()
    assert r.n == 300 and r.mean == pytest.approx(b.mean()) and r.lo == pytest.approx(means[100], abs=0.015) and r.hi == pytest.approx(means[3900], abs=0.015)
    p = statistics.paired_bootstrap(df, "task", "sample_id", "a", "b").first()
    lo, hi = np.quantile(deltas, (0.025, 0.975))
    assert p.delta == pytest.approx((b.astype(float) - a).mean()) and p.lo == pytest.approx(lo, abs=0.02) and p.hi == pytest.approx(hi, abs=0.02)
    sets = [(set(rng.integers(0, 200, 3).tolist()), set(rng.integers(0, 400, 4).tolist())) for _ in range(300)]
    df = spark.createDataFrame([("t", k, [str(v) for v in x], [str(v) for v in y]) for k, (x, y) in enumerate(sets)], "task string, sample_id int, a array<string>, b array<string>")
    c = statistics.coverage_bootstrap(df, "task", "sample_id", "a", "b", 400).first()
    size = lambda p, k: len(set().union(*(sets[i][k] for i in set(p.tolist()))))
    plain = [(size(p, 1) - size(p, 0)) / 400 for p in pick[:2000]]
    assert c.n == 300 and c.delta == pytest.approx((size(np.arange(300), 1) - size(np.arange(300), 0)) / 400)
    assert (c.lo, c.hi) == pytest.approx(tuple(np.quantile(plain, (0.025, 0.975))), abs=0.03)


def test_hashed_cosine_and_rouge_by_plain_versions(spark):
    import collections
    import re

    texts = [("the cat sat on the mat", "the cat sat on a mat by the cat"), ("one two", "three four"), ("", "words here"), ("a b c", "a b c"), ("same words same", "same words same")]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t struct<a:string,b:string>").select("k", "t.*")
    got = {r.k: (r.cosine, r.rouge) for r in statistics.hashed_cosine(df, "a", "b").withColumn("rouge", statistics.rouge_l(F.split("a", " "), F.split("b", " "))).collect()}
    for k, (x, y) in enumerate(texts):
        grams = []
        for t in (x, y):
            w = re.findall(r"\b\w\w+\b", t)
            grams.append(collections.Counter(w + [f"{p} {q}" for p, q in zip(w, w[1:])]))
        p, q = grams
        size = np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
        assert got[k][0] == pytest.approx(sum(v * q[g] for g, v in p.items()) / size if size else 0.0)
        a, b = x.split(" "), y.split(" ")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert got[k][1] == pytest.approx(2 * table[-1, -1] / (len(a) + len(b)))


def test_residual_codes_and_prefixes_by_plain_versions(spark):
    from sidera.operators import semantic_ids

    rng = np.random.default_rng(4)
    v, book = rng.standard_normal((300, 6)), [(rng.standard_normal((8, 6)) / 2**k).tolist() for k in range(3)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    codes = semantic_ids.quantize(df, book, "vec_id", "embedding")
    rows = {r.vec_id: r for r in codes.withColumn("back", semantic_ids.decode(F.col("codes"), book)).collect()}
    plain = {}
    for k, x in enumerate(v):
        rest, plain[k] = x.copy(), []
        for words in np.array(book):
            plain[k].append(int(((rest - words) ** 2).sum(1).argmin()))
            rest = rest - words[plain[k][-1]]
        assert rows[k].codes == plain[k] and np.allclose(rows[k].residual, rest) and np.allclose(np.array(rows[k].back) + rest, x)
    got = {r.length: r for r in vectors.prefix_coincidence(vectors.knn(df, df, 4), codes, 3, F.xxhash64("vec_id"), k=4, lots=2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    near = [(i, j) for i in range(300) for j in np.lexsort((np.arange(300), -s[i]))[:4]]
    for length in (1, 2, 3):
        assert got[length].n == len(near) and got[length].share == pytest.approx(np.mean([plain[i][:length] == plain[j][:length] for i, j in near]), abs=1e-6)
        every = np.mean([plain[i][:length] == plain[j][:length] for i in range(300) for j in range(300) if i != j])
        assert abs(got[length].random_share - every) < 0.06


def test_kmeans_finds_groups_apart(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [50, 0], [0, 50]])
    rows = [(k, (centres[k % 3] + rng.standard_normal(2)).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    found = vectors.kmeans(df, "v", 3)
    assert np.allclose(sorted(c.round(-1).tolist() for c in found.clusterCenters()), sorted(centres.tolist()))
    code = {r.k: r.prediction for r in found.transform(df.select("k", array_to_vector("v").alias("v"))).collect()}
    assert all((code[a] == code[b]) == (a % 3 == b % 3) for a in range(150) for b in range(0, 150, 7))
    with_shift = spark.createDataFrame([(k, x, [y * 2 for y in x]) for k, x in rows], "k int, a array<double>, b array<double>")
    x = np.array([r[1] for r in rows])
    assert vectors.cka(with_shift, "a", "b") == pytest.approx(vectors.linear_cka(x, 2 * x)) == pytest.approx(1.0)
    share = np.linalg.svd(x, compute_uv=False) ** 2
    share /= share.sum()
    assert vectors.effective_rank(df, "v") == pytest.approx(np.exp(-(share * np.log(share)).sum()))


def test_initial_rows_and_targets(spark):
    rng = np.random.default_rng(6)
    table = rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(table)], "k int, v array<double>")
    mean, cov = vectors.moments(df, "v")
    assert np.allclose(mean, table.mean(0)) and np.allclose(cov, np.cov(table.T))
    drawn = vectors.initial_rows("mvn", 20_000, 12, 1, mean, cov)
    assert np.allclose(np.cov(drawn.T), cov, atol=0.08 * np.abs(cov).max()) and np.array_equal(drawn, vectors.initial_rows("mvn", 20_000, 12, 1, mean, cov))
    book = rng.standard_normal((50, 5))
    far = vectors.initial_rows("projected", 50, 12, 2, codebook=book)
    assert np.allclose(np.linalg.norm(far[:, None] - far[None], axis=2), np.linalg.norm(book[:, None] - book[None], axis=2))
    assert np.linalg.norm(vectors.rescale(far, 3.0)) == pytest.approx(3.0)
    assert vectors.frobenius_target(table, 100) == pytest.approx(np.sqrt((table**2).sum() / 4), rel=0.05)
