"""The whole job of an operator, where a part of it was once left out."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidera.llm import lattice_hash, local_descriptors, mixing, queries, secret_ledger
from tests.compare import rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_all_unwanted_hosts_are_blocked(spark, sf):
    rows = queries.op7_url_filters(spark, f"/root/testdata/{sf}").collect()
    unwanted = re.compile(r"://(?:[^/?#]*\.)?(?:ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.")
    want = {r.page_id for r in rows if r.url and unwanted.search(r.url)}
    assert want and {r.page_id for r in rows if r.action == "block"} == want


def key(kind, body, end=True):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n" + (f"-----END {kind}PRIVATE KEY-----" if end else "")


def test_secrets_of_all_names_noises_and_whole_keys(spark):
    import duckdb

    value = "Zq81xLw0Vt5RmK2pYc"
    names = ["client_secret", "DB_PASSWORD", "aws_secret_access_key", "secret_key", "my.app-token", "tokenId", "api_key", "pwd"]
    texts = [f"{n}{s}{value} end" for n in names for s in ("=", ": ", ' = "')]
    texts += [f"token {n}={n} {value} end" for n in ("###", "$$$", "%%%", "&&&", "***", "!!", "!!!!")]
    assigned = len(texts)
    texts += [f"a {key('RSA ', 'MIIBody1' + value)} b", f"a {key('RSA ', 'MIIBody2' + value)} b", f"a {key('', 'MIIBody3' + value, False)}", f"a {key('EC ', 'One' + value)} b {key('', 'Two' + value)} c"]
    plain = ["a token of trust, a secret well kept", "the secret is internationalisation", "password: short", "-----BEGIN PUBLIC KEY-----"]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id bigint, text string")
    got = secret_ledger.scan(docs)[0].toPandas()
    assert set(got.doc_id) == set(range(len(texts)))
    keys = got[got.rule_id == "private_key"]
    assert len(keys) == 5 == keys.secret_sha.nunique() and set(keys.doc_id) == set(range(assigned, len(texts)))
    clean = {r.doc_id: r.text for r in secret_ledger.stage(docs).collect()}
    assert not any(value in clean[k] for k in range(len(texts))) and [clean[len(texts) + k] for k in range(len(plain))] == plain
    assert clean[assigned] == "a [private_key redacted] b" and clean[assigned + 3] == "a [private_key redacted] b [private_key redacted] c"
    documents = docs.toPandas()  # noqa: F841
    assert rows(got) == rows(duckdb.sql(secret_ledger.oracle()).df())


def test_pipeline_scans_with_a_stored_ledger(spark, tmp_path):
    """The pipeline's stage scans what its ledger lacks, keeps the findings for later runs, and redacts by them."""
    import corpus_pipeline
    from sidera.llm.common import shared_folder

    secret, schema = f"key AKIA{'Q7R8S9T0' * 2} end {tmp_path.name}", "doc_id bigint, text string, n_chars bigint"
    clean = "key [aws_access_key redacted] end " + tmp_path.name
    rows_ = [(1, secret, 1), (2, secret, 1), (3, "my token " + tmp_path.name, 1), (4, None, None), (5, "plain " + tmp_path.name, 1), (None, secret, 1)]
    docs = spark.createDataFrame(rows_, schema)
    blob = lambda df: {r[0] for r in df.select(F.sha2("text", 256)).where("text is not null").collect()}
    want = collections.Counter([(1, clean, len(clean)), (2, clean, len(clean)), *rows_[2:5], (None, clean, len(clean))])
    assert collections.Counter(map(tuple, corpus_pipeline.redact_secrets(spark, docs, "").collect())) == want
    stored = spark.read.parquet(f"{shared_folder(spark)}/secret-ledger/ledger")
    assert blob(docs) <= {r.blob for r in stored.collect()}

    at = f"file://{tmp_path}/ledger"
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    for _ in range(2):  # the second time nothing is left to scan
        assert collections.Counter(map(tuple, secret_ledger.stage(docs, folder=at).collect())) == want
        assert sorted(r.blob for r in read("ledger").collect()) == sorted(blob(docs)) and read("findings").count() == 1
    more = docs.unionByName(spark.createDataFrame([(8, f"ghp_{'a1' * 18} " + tmp_path.name, 9)], schema))
    assert "[github_token redacted] " + tmp_path.name in {r.text for r in secret_ledger.stage(more, folder=at).collect()}
    assert sorted(r.blob for r in read("ledger").collect()) == sorted(blob(more)) and read("findings").count() == 2
    # a rule's new version is scanned with, and alone
    rules = tuple(secret_ledger.Rule(r.rule_id, r.version + 1, r.pattern, r.words) if r.rule_id == "github_token" else r for r in secret_ledger.RULES)
    assert "[github_token redacted] " + tmp_path.name in {r.text for r in secret_ledger.stage(more, folder=at, rules=rules).collect()}
    assert {tuple(r.scanned) for r in read("ledger").collect() if len(r.scanned) < len(rules)} == {("github_token@2",)}


@pytest.mark.parametrize("sizes", [(100_000, 100_000, 100_000, 100_000, 1), (400_000, 200_000, 100_000, 50_000, 10), (100_000, 100_000, 100_000, 500), (100_000, 100_000, 100_000, 100_000, 1, 1)])
def test_a_tiny_or_null_source_does_not_shrink_the_draw(sizes):
    blocks = {"" if k == len(sizes) - 1 else f"s{k}": n for k, n in enumerate(sizes)}
    assert mixing.quotas(blocks) == blocks
    drawn = mixing.quotas(blocks, mixing.tempered())
    assert drawn[""] == blocks[""] and sum(drawn.values()) >= 0.5 * sum(sizes)
    equal = mixing.quotas(blocks, dict.fromkeys(blocks, 1.0))
    assert equal[""] == blocks[""] and sum(equal.values()) >= 0.25 * sum(sizes)


def test_tempered_weights_are_met():
    blocks = {"hot": 93_000, **{f"s{k}": 8_600 + 10 * k for k in range(19)}}
    drawn, want = mixing.quotas(blocks, mixing.tempered()), mixing.tempered()(blocks)
    share = sum(drawn.values()) / sum(want.values())
    assert all(abs(drawn[s] - want[s] * share) <= 1 for s in blocks) and sum(drawn.values()) > 0.75 * sum(blocks.values())


def test_draw_against_a_plain_version(spark):
    """Blocks, quotas, shards and positions of a draw, made again row by row without any code of the operator but the tree's splits."""
    docs = spark.createDataFrame([(k, "abc"[min(2, k % 5)]) for k in range(997)], "doc_id bigint, source string")
    weights, block, rows_a_shard, seed = {"a": 2.0, "b": 1.0, "c": 3.0}, 3, 50, 23
    got = {r.doc_id: (r.shard, r.position) for r in mixing.assign(docs, weights, block=block, shard_rows=rows_a_shard, seed=seed).collect()}
    rank = {r.doc_id: (r.h, r.s) for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).withColumn("s", F.xxhash64(F.lit(seed + 1), "doc_id", "h")).collect()}
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r.source].append(r.doc_id)
    blocks = {s: -(-len(v) // block) for s, v in by.items()}
    size = max(n for n in range(sum(blocks.values()) + 1) if all(n * w / 6 <= blocks[s] + 1e-9 for s, w in weights.items()))
    quota = {s: int(size * w / 6) for s, w in weights.items()}
    for s in sorted(weights, key=lambda s: (quota[s] - size * weights[s] / 6, s))[: size - sum(quota.values())]:
        quota[s] += 1
    shards = -(-sum(quota.values()) * block // rows_a_shard)
    nodes = {(0, shards): [quota[s] for s in "abc"]}
    while any(hi - lo > 1 for lo, hi in nodes):
        lo, hi = next(x for x in nodes if x[1] - x[0] > 1)
        q, mid = nodes.pop((lo, hi)), (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, sum(q) * (mid - lo) // (hi - lo), method="marginals").tolist()
        nodes[lo, mid], nodes[mid, hi] = left, [x - y for x, y in zip(q, left)]
    want, at = {}, dict.fromkeys("abc", 0)
    order = {s: sorted(v, key=lambda i: rank[i][0] % 2**64) for s, v in by.items()}
    for lo in range(shards):
        members = []
        for s, n in zip("abc", nodes[lo, lo + 1]):
            members += order[s][at[s] : at[s] + n * block]
            at[s] += n * block
        want |= {i: (lo, p) for p, i in enumerate(sorted(members, key=lambda i: (rank[i][1], i)))}
    assert got == want


def grouped(ids, pairs):
    """(id, least id of its group, number of its pairs) by a plain loop."""
    root, links = {k: k for k in ids}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        lo, hi = sorted((root[a], root[b]))
        root = {k: lo if r == hi else r for k, r in root.items()}
        links[a] += 1
        links[b] += 1
    return sorted((k, root[k], links[k]) for k in ids)


def test_near_vectors_have_one_row_each(spark, tmp_path):
    """As many rows as ids, whatever the pairs: a group, one of equal vectors, and vectors that can't be compared."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 64))
    group = x[:1] + 0.02 * rng.standard_normal((40, 64))
    v = [*x.tolist(), *group.tolist(), *[x[1].tolist()] * 30, *(x[1:2] + 0.01).tolist(), None, [], [0.0] * 64]
    df = spark.createDataFrame([*enumerate(v), (3, x[3].tolist()), (None, x[0].tolist())], "vec_id bigint, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op2_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "group_id", "links").collect()))
    pairs = [(r.a, r.b) for r in lattice_hash.pairs(df).collect()]
    assert got == grouped(range(len(v)), pairs) and len(pairs) > 2 * len(v)
    assert lattice_hash.groups(df.limit(0)).count() == 0


def test_pictures_have_one_row_each(spark, tmp_path):
    """As many rows as ids, whatever the pairs: groups of noisy copies, and vectors that give no picture."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((20, 64))
    v = [*x.tolist(), *(x[:1] + 0.02 * rng.standard_normal((12, 64))).tolist(), *[x[1].tolist()] * 3, None, [1.0]]
    df = spark.createDataFrame([*enumerate(v), (3, x[3].tolist()), (None, x[0].tolist())], "vec_id bigint, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op6_media_columns(spark, str(tmp_path)).select("media_id", "group_id", "links").collect()))
    pairs = [(r.a, r.b) for r in local_descriptors.copies(local_descriptors.pictures(df)).collect()]
    assert got == grouped(range(len(v)), pairs) and len(pairs) > 1.5 * len(v)
    assert local_descriptors.groups(local_descriptors.pictures(df.limit(0))).count() == 0
