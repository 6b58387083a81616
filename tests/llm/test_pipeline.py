"""The pipeline's stages against what each operator says alone."""

import corpus_pipeline
from sidera.llm import language_id, mixing, prob_minhash, secret_ledger

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "secret_scans", "mixing", "sentencepiece"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start = ids(docs)
    rejected = {r.doc_id for r in language_id.identify(docs, language_id.train(docs)).where("rejected").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert ids(one) == start - rejected and one.columns == docs.columns
    two = corpus_pipeline.STAGES[1][1](spark, one, SF)
    gone = {r.doc_id for r in prob_minhash.groups(one).where("doc_id <> group_id").collect()}
    assert gone and ids(two) == ids(one) - gone and two.columns == docs.columns
    three = corpus_pipeline.STAGES[2][1](spark, two, SF)
    assert ids(three) == ids(two) and three.columns == docs.columns and secret_ledger.scan(three)[0].count() == 0
    four = corpus_pipeline.STAGES[3][1](spark, three, SF)
    assert ids(four) == {r.doc_id for r in mixing.assign(three, mixing.tempered()).collect()} and four.columns == docs.columns
    five = corpus_pipeline.STAGES[4][1](spark, four, SF).collect()
    assert {r.doc_id for r in five} == ids(four) and all(r.exact for r in five)
    assert {(r.doc_id, r.n_ids) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.n_ids) for r in five}


def whole(spark, rows, at, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, ids int, blob string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    return corpus_pipeline.run(spark, str(at)).collect()


def test_whole_run_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column and columns with the operators' own names go through all stages."""
    assert whole(spark, [], tmp_path / "empty") == []
    words = [" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(k, t, "en", "a", len(t), 1, 2, "x") for k, t in enumerate(words)] + [(9, words[0], "en", None, None, None, None, None), (None, words[1], None, "b", 1, 1, 1, ""), (5, None, "en", "a", 0, 0, 0, None), (6, "", None, None, None, None, None, None), (7, "?!", "en", "a", 2, 0, 0, "")]
    got = whole(spark, rows, tmp_path / "odd")
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and all(r.exact for r in got)
    bare = [(k, t, "en", "a") for k, t in enumerate(words)]
    assert len(whole(spark, bare, tmp_path / "bare", "doc_id bigint, text string, lang string, source string")) == 4


def test_rows_of_the_whole_run_by_a_plain_version(spark):
    """The ids that come out, by rules applied row by row: the classifier and J_P are the operators', all that follows from them is made here."""
    import collections
    import re

    import numpy as np

    from sidera.llm import sentencepiece_codec

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").toPandas()
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    x, letters = language_id.features(docs.text.tolist())
    margin = language_id.decode(model, x @ model.weights + model.bias)[2]
    kept = docs[(letters > 0) & (margin >= 0.25)].reset_index(drop=True)
    d, h, w = prob_minhash.shingles(kept.text.tolist())
    cut = np.searchsorted(d, np.arange(len(kept) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
    parent = list(range(len(kept)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(kept)):
        for b in range(a + 1, len(kept)):
            if prob_minhash.probability_jaccard(sets[a], sets[b]) >= prob_minhash.THRESHOLD:
                y, z = sorted((find(a), find(b)))
                parent[z] = y
    left = kept[[find(k) == k for k in range(len(kept))]]
    blocks = {s: -(-n // 4) for s, n in collections.Counter(left.source).items()}
    quota = mixing.quotas(blocks, mixing.tempered())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(left.doc_id)
    source = dict(zip(left.doc_id, left.source))
    took = collections.Counter(source[i] for i in got)
    sizes = collections.Counter(left.source)
    assert all(min(4 * quota[s], sizes[s]) - 3 <= took[s] <= min(4 * quota[s], sizes[s]) for s in sizes)
    text = dict(zip(left.doc_id, left.text))
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    for i, r in got.items():
        out = text[i]
        for rule in secret_ledger.RULES:
            if any(word in text[i].lower() for word in rule.words):
                out = re.sub(rule.pattern.replace(r"\z", r"\Z"), f"[{rule.rule_id} redacted]", out)
        assert c.decode(r.ids) == out
