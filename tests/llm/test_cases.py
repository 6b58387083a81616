"""Null, empty, long, repeated and clashing input for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from sidera.llm import language_id, lattice_hash, local_descriptors, mil_quality, mixing, prob_minhash, secret_ledger, sentencepiece_codec, substring_dedup, url_filter
from sidera.llm.common import components

EXTRA = "id string, blob string, shard int, position int, ids int, slot int, margin double, keep string, v int, n int, seen int, k int, url2 string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
PASSAGE = " ".join(f"word{k}" for k in range(70))
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(120_000))
KEY = "AKIA" + "A1B2C3D4" * 2
TEXTS = [
    (1, PASSAGE + " one tail of its own", "en", "a"),
    (2, "another head first " + PASSAGE, "en", "a"),
    (3, PASSAGE + " one tail of its own", "en", "b"),
    (3, PASSAGE + " one tail of its own", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, None),
    (None, PASSAGE + " one tail of its own", "fr", "a"),
    (None, None, None, None),
    (6, LONG, "fr", "a"),
    (7, f"key {KEY} and again {KEY}", "fr", None),
    (8, "?!? 123 ...", "en", "c"),
    (9, "日本語 ▁ tab\tand  spaces 🎉", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *["x" if "string" in c else None for c in EXTRA.split(",")]) for i, t, g, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3), (k, k + 1) if False else (300, 301)] + [(400 + k, 401 + k) for k in range(40)]
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sentencepiece(docs, none):
    rows = sentencepiece_codec.encode(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.exact is None and r.ids is None) if t is None else r.exact for r, (_, t, _, _) in zip(sorted(rows, key=str), sorted(TEXTS, key=str)) if (r.ids is None) == (t is None))
    assert sum(r.ids is None for r in rows) == 2 and [r.ids for r in rows if r.doc_id == 5] == [[]]
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs.where("doc_id is not null"))).collect()}
    assert back == {i: t for i, t, _, _ in TEXTS if i is not None}
    assert sentencepiece_codec.encode(none).count() == 0


def test_language(docs, none):
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id for r in rows if r.rejected} >= {4, 5, 8} and all(r.lang_id is None for r in rows if r.doc_id in (4, 5, 8))
    assert language_id.stage(docs).columns == docs.columns
    assert language_id.stage(none).count() == 0
    empty = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert all(r.rejected for r in language_id.identify(docs, empty).collect())
    assert all(r.rejected == r.ambiguous for r in rows)
    one = language_id.train(docs.withColumn("lang", F.lit("en")))
    assert {r.lang_id for r in language_id.identify(docs, one).collect()} == {"en", None}


def test_minhash(docs, none):
    rows = {r.doc_id: (r.group_id, r.group_size) for r in prob_minhash.groups(docs).collect()}
    assert rows == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
    kept = prob_minhash.stage(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "9", "None"])
    # unlike texts of one id stay, copies go whatever their ids are
    mixed = docs.sparkSession.createDataFrame([(1, "a text of its own here"), (1, PASSAGE), (2, PASSAGE + " end"), (None, PASSAGE), (None, PASSAGE), (3, "quite another thing")], "doc_id bigint, text string")
    assert sorted(map(str, prob_minhash.stage(mixed).collect())) == sorted(map(str, [r for r in mixed.collect() if r.text[:4] != "word"] + [r for r in mixed.collect() if (r.doc_id, r.text) == (1, PASSAGE)]))
    assert prob_minhash.groups(none).count() == 0 and prob_minhash.stage(none).count() == 0


def test_substring(docs, none):
    rows = {r.doc_id: r for r in substring_dedup.repeats(docs).collect()}
    assert set(rows) == {1, 2, 3, 6}  # the long text comes round again within itself
    assert [tuple(s) for s in rows[2].spans] == [(3, 73)] and rows[2].repeated_words == 70 and rows[2].longest_level == 50
    assert not rows[6].spans and rows[6].own_spans and not rows[2].own_spans and rows[6].repeated_words == 0
    assert substring_dedup.repeats(none).count() == 0
    named = substring_dedup.repeats(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    assert {r.doc_id: (r.spans, r.own_spans, r.longest_level) for r in named.collect()} == {f"d{k}": (r.spans, r.own_spans, r.longest_level) for k, r in rows.items()}


def test_secrets(spark, docs, none):
    rows, ledger, findings = secret_ledger.scan(docs)
    got = rows.collect()
    assert [(r.doc_id, r.rule_id, r.n) for r in got] == [(7, "aws_access_key", 2)]
    blobs = len({t for _, t, _, _ in TEXTS if t is not None})
    assert ledger.count() == blobs and {len(r.scanned) for r in ledger.collect()} == {len(secret_ledger.RULES)}
    # all is seen: nothing is scanned again, a new path of the same blob gets its finding
    ledger, findings = spark.createDataFrame(ledger.collect(), secret_ledger.LEDGER), spark.createDataFrame(findings.collect(), secret_ledger.FINDINGS)
    more = docs.unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("bigint")))
    again, after, new = secret_ledger.scan(more, ledger=ledger, findings=findings)
    assert sorted((r.doc_id, r.n) for r in again.collect()) == [(7, 2), (70, 2)] and after.count() == 0 == new.count()
    # a new version of a rule is scanned alone, and the old version's findings are out of date
    rules = tuple(secret_ledger.Rule(r.rule_id, r.version + (r.rule_id == "aws_access_key"), r.pattern, r.words) for r in secret_ledger.RULES)
    third, after, _ = secret_ledger.scan(docs, rules, ledger, findings)
    assert [(r.doc_id, r.rule_version, r.n) for r in third.collect()] == [(7, 2, 2)]
    assert {tuple(r.scanned) for r in after.collect()} == {("aws_access_key@2",)} and after.count() == blobs
    clean = secret_ledger.stage(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    text = clean.where("doc_id = 7").first()
    assert text.text == "key [aws_access_key redacted] and again [aws_access_key redacted]" and text.n_chars == len(text.text)
    assert secret_ledger.scan(none)[0].count() == 0 and secret_ledger.stage(none).count() == 0


def test_stored_ledger(docs, none, tmp_path):
    at = f"file://{tmp_path}/ledger"
    assert secret_ledger.scan_stored(docs.where("doc_id < 7"), at).count() == 0
    size = lambda name: docs.sparkSession.read.parquet(f"{at}/{name}").count()
    seen = size("ledger")
    assert 0 < seen < len({t for _, t, _, _ in TEXTS if t is not None}) and size("findings") == 0
    for _ in range(2):  # the second time there is nothing left to scan
        assert [(r.doc_id, r.rule_id, r.n) for r in secret_ledger.scan_stored(docs, at).collect()] == [(7, "aws_access_key", 2)]
        assert size("ledger") == len({t for _, t, _, _ in TEXTS if t is not None}) and size("findings") == 1
    assert secret_ledger.scan_stored(none, at).count() == 0


def test_mixing(docs, none):
    rows = mixing.assign(docs, weights={"a": 1, "b": 1}, block=1).collect()
    sources = [r.source for r in rows]
    assert sources.count("a") == sources.count("b") and set(sources) == {"a", "b"}
    assert mixing.stage(docs).columns == docs.columns
    assert mixing.assign(none).count() == 0 and mixing.stage(none).count() == 0
    assert mixing.assign(docs, weights={"zzz": 1.0}).count() == 0
    assert mixing.assign(docs).count() == len(TEXTS)  # without weights no row is dropped


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, None, "x"), (6, 0, 1, "x"), (6, 1, 0, "y"), (None, 1, 1, "z"), (4, None, None, "z")], "doc_id bigint, quality int, toxic int, text string")
    rows = mil_quality.classify(docs, mil_quality.train(docs, labels)).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.p_quality is None and not r.keep for r in rows if r.doc_id in (4, 5))
    assert next(r.passages for r in rows if r.doc_id == 6) == 120_000 // mil_quality.PASSAGE
    nothing = mil_quality.train(docs, labels.limit(0))
    assert not any(r.keep for r in mil_quality.classify(docs, nothing).collect())
    assert mil_quality.classify(none, nothing).count() == 0


def test_vectors(spark):
    unit = [1.0] + [0.0] * 63
    near = [1.0, 0.05] + [0.0] * 62
    rows = [(1, unit), (2, unit), (2, unit), (3, near), (4, None), (5, []), (6, [0.0] * 64), (7, [float("nan")] * 64), (8, [1.0, None] + [0.0] * 62), (None, unit), (9, [2.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, id int, cell string")
    got = {(r.a, r.b): round(r.cosine, 4) for r in lattice_hash.pairs(df).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.9988, (2, 3): 0.9988, (9, 10): 1.0}
    assert lattice_hash.pairs(df.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://user@ADS.Example.com:80/a/b.html?q=1#f", 0), (2, None, 1), (3, "no url", 2), (3, "no url", 2), (4, "http://10.0.0.1/x/", 3), (5, "https://localhost", 4), (None, "http://ads.example.com/a/", 5)], "page_id int, url string, rule_id int")
    rules = spark.createDataFrame([(1, "example.com/", "block", 0), (2, "ads.example.com/a/", "allow", 0), (3, "ads.example.com/a/", "block", 0), (4, None, "block", 9), (5, "10.0.0.1/", "block", 0), (6, "localhost/", "block", 0), (7, "ads.example.com/a/b.html?q=1", "block", 0)], url_filter.RULES_SCHEMA)
    got = sorted(((r.page_id or 0), r.action, r.rule_id or 0) for r in url_filter.decide(pages, rules).collect())
    assert got == sorted([(1, "block", 7), (2, "none", 0), (3, "none", 0), (3, "none", 0), (4, "block", 5), (5, "block", 6), (0, "allow", 2)])
    assert url_filter.decide(pages.limit(0), rules).count() == 0
    assert {r.action for r in url_filter.decide(pages, rules.limit(0)).collect()} == {"none"}


def test_url_expressions():
    """The digests of a URL's expressions are those of the strings, made one by one."""
    import hashlib

    for url, host, paths in (
        ("http://u@A.B.Example.com:80/a/b.html?q=1#f", "a.b.example.com", ["/", "/a/", "/a/b.html", "/a/b.html?q=1"]),
        ("https://example.com", "example.com", ["/"]),
        ("https://example.com./x/", "example.com", ["/", "/x/"]),
        ("https://example.com?q=/z/", "example.com", ["/", "/?q=/z/"]),
        ("ftp://10.0.0.1//a", "10.0.0.1", ["/", "//", "//a"]),
    ):
        labels = host.split(".")
        ends = [host] if host[0].isdigit() else [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
        want = sorted(hashlib.sha256((e + p).encode()).digest() for e in ends for p in paths)
        assert sorted(url_filter.digests(url)) == want, url
    assert not list(url_filter.digests("no url")) and not list(url_filter.digests("http:///path"))


def test_long_urls_and_many_rules(spark):
    import time

    slashes = "http://a.example.com/" + "p/" * 500_000
    pages = spark.createDataFrame([(1, slashes), (2, "http://b.example.com/" + "x" * 1_000_000), (3, "http://host77.example.net/a/b"), (4, "http://" + "h." * 300 + "example.org/" + "q/" * 300)], "page_id int, url string")
    rules = [(k, f"host{k}.example.net/", "block", 0) for k in range(1, 50_001)] + [(60_000, "example.com/" + "p/" * 400_000, "block", 0), (60_001, "b.example.com/", "allow", 0), (60_002, "h.h.example.org/q/q/", "block", 1)]
    start = time.time()
    got = {r.page_id: (r.action, r.rule_id) for r in url_filter.decide(pages, spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).collect()}
    assert got == {1: ("block", 60_000), 2: ("allow", 60_001), 3: ("block", 77), 4: ("block", 60_002)}
    assert time.time() - start < 60


def test_pictures(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 255, (2, 12, 12)).astype(np.float32)
    big = np.rint(local_descriptors.resize(x, 96, 96)).astype(np.uint8)
    crop = big[0][10:86, 6:90]
    rows = [(1, 96, 96, big[0].tobytes()), (2, 76, 84, np.ascontiguousarray(crop).tobytes()), (3, 96, 96, big[1].tobytes()), (3, 96, 96, big[1].tobytes()), (4, None, 96, b"x"), (5, 96, 96, None), (6, 96, 96, b"short"), (7, 4, 4, bytes(16)), (8, 96, 96, bytes([7]) * 9216), (None, 96, 96, big[0].tobytes())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "media_id int, height int, width int, pixels binary, tab string")
    assert [(r.a, r.b) for r in local_descriptors.copies(df).collect()] == [(1, 2)]
    assert local_descriptors.copies(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None] * 64), (4, [float(k) for k in range(64)])], "vec_id int, embedding array<double>")
    assert sorted((r.media_id, r.height) for r in local_descriptors.pictures(bad).where("pixels is not null").collect()) == [(2, 6), (4, 48)]
    odd = spark.createDataFrame([(k, rng.normal(size=100 if k < 4 else 90).tolist()) for k in range(8)], "vec_id int, embedding array<double>")
    drawn = local_descriptors.pictures(odd.unionByName(odd.select((odd.vec_id + 10).alias("vec_id"), "embedding")))
    assert sorted((r.a, r.b) for r in local_descriptors.copies(drawn).collect()) == [(k, k + 10) for k in range(8)]
