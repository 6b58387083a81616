"""Every operator against SQL, a brute-force version, an exact round trip or held-out labels."""

import collections
import re

import duckdb
import numpy as np
import pytest

from sidera.llm import language_id, lattice_hash, local_descriptors, mil_quality, mixing, prob_minhash, queries, sentencepiece_codec, substring_dedup
from tests.compare import by_sql, rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), by_sql(queries.ORACLES[name], SF)
    assert rows(got) == rows(want) and (len(got) or name == "op2_embedding_near_dedup")


def test_near_vectors_by_sql(spark, tmp_path):
    """The query against its SQL over vectors that have near copies, equal ones and groups, as the small tables have none."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    near = x[:400] + 0.02 * rng.standard_normal((400, 64)).astype(np.float32)
    group = x[:1] + 0.02 * rng.standard_normal((40, 64)).astype(np.float32)
    v = np.concatenate([x, near, x[:100], group])
    spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).toPandas()
    want = duckdb.connect().sql(queries.ORACLES["op2_embedding_near_dedup"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")).df()
    assert rows(got) == rows(want) and len(got) > 1000


def test_pieces_against_library(docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    proto = pb.ModelProto()
    proto.ParseFromString(open(sentencepiece_codec.default_model(), "rb").read())
    for p, s in zip(proto.pieces, c.score):
        p.score = float(s)
    proto.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [*docs.text[:300], "", " ", "a  b   c", "日本語 テキスト 🎉", "\n\t a", "x" * 5000]
    ids, at = c.encode(texts)
    own = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    weigh = lambda seq: sum(c.score[i] for i in seq)
    for text, mine, theirs in zip(texts, own, lib.encode(texts)):
        assert c.decode(mine) == text == lib.decode(mine)
        # equal but for ties, which single precision breaks at will
        assert mine == theirs or (sorted(map(len, map(c.pieces.__getitem__, mine))) and abs(weigh(mine) - weigh(theirs)) < 1e-2)
    assert np.mean([m == t for m, t in zip(own, lib.encode(texts))]) > 0.95


def test_best_path_by_brute_force():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    known = {p: c.score[i] for i, (p, _, t) in enumerate(c.pieces) if t == 1}
    for segment in ("▁the", "▁reading", "▁été", "▁▁▁x", "▁日本鿿"):
        best = [0.0] + [-1e18] * len(segment)
        for j in range(1, len(segment) + 1):
            for i in range(j):
                gain = known.get(segment[i:j], c.unknown if j - i == 1 else -1e18)
                best[j] = max(best[j], best[i] + gain)
        ids, _ = c.solve([segment])
        pieces = [c.pieces[i] for i in ids]
        got, run = 0.0, 0
        for i, (p, _, t) in zip(ids, pieces):
            got += c.score[i] if t == 1 else 0
            run += t == 6
        unknown = sum(ch not in known for ch in segment)
        assert got + unknown * c.unknown == pytest.approx(best[-1]) and (run > 0) == (unknown > 0)


@pytest.mark.parametrize("kind", ["base64", "small letters", "ideographs", "one letter", "a period", "prose", "marks"])
def test_long_segments_lane_by_lane(docs, kind):
    """A text without spaces, cut in lanes, has the ids that it has in one go; two million bytes take seconds."""
    import random
    import string
    import time

    draw = random.Random(7)
    made = {
        "base64": lambda n: "".join(draw.choices(string.ascii_letters + string.digits + "+/", k=n)),
        "small letters": lambda n: "".join(draw.choices(string.ascii_lowercase, k=n)),
        "ideographs": lambda n: "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3)),
        "one letter": lambda n: "x" * n,
        "a period": lambda n: ("abcab" * n)[:n],
        "prose": lambda n: ("".join(docs.text) * 2).replace(" ", "")[:n],
        "marks": lambda n: (sentencepiece_codec.MARK + "y") * (n // 4),
    }[kind]
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    text = made(20_000)
    if kind != "marks":
        assert c.solve_long(text).tolist() == c.solve([text])[0].tolist()
    big, start = made(2_000_000), time.time()
    ids, _ = c.encode([big])
    assert time.time() - start < 40 and c.decode(ids.tolist()) == big


def test_decoded_lattice_points():
    """The nearest point of E8 has no root that would bring it nearer, and lies within the covering radius."""
    x = np.random.default_rng(0).normal(0, 2, (500, 8))
    p = lattice_hash.nearest(x)
    near = ((x - p) ** 2).sum(1)
    assert (near <= 1 + 1e-9).all() and len(lattice_hash.roots()) == 240
    assert all((near <= ((x - p - r) ** 2).sum(1) + 1e-9).all() for r in lattice_hash.roots())
    assert np.allclose(p.sum(1) % 2, 0) and np.allclose(p * 2, np.rint(p * 2))


def test_embeddings_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.95, 1.0, (len(x), 1))
    v = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z])
    got = {(r.a, r.b): r.cosine for r in lattice_hash.pairs(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id bigint, embedding array<double>")).collect()}
    s = v @ v.T
    want = {(i, j): s[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.95}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_repeated_passages(spark, docs):
    got = {r.doc_id: r for r in substring_dedup.repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    words = {i: re.findall(r"\w+", t.lower()) for i, t in zip(docs.doc_id, docs.text)}
    for length in (50, 100, 200, 400, 800):
        seen = collections.defaultdict(collections.Counter)
        for i, w in words.items():
            for p in range(len(w) - length + 1):
                seen[hash(tuple(w[p : p + length]))][i] += 1
        cover, across, own = (collections.defaultdict(set) for _ in range(3))
        for i, w in words.items():
            for p in range(len(w) - length + 1):
                holders, span = seen[hash(tuple(w[p : p + length]))], range(p, p + length)
                for to, said in ((across, len(holders) > 1), (own, holders[i] > 1), (cover, len(holders) > 1 or holders[i] > 1)):
                    if said:
                        to[i] |= set(span)
        if length == 50:
            assert set(got) == set(cover) and across and own
            for name, want in (("spans", across), ("own_spans", own)):
                assert {i: {x for s in r[name] for x in range(s.start, s.stop)} for i, r in got.items() if r[name]} == want
        else:  # all documents with a passage of 2 * L that occurs twice are seen at L; none is seen without one of L
            assert {i for i, r in got.items() if r.longest_level >= length} <= set(cover)
            assert set(cover) <= {i for i, r in got.items() if r.longest_level >= length // 2}


def test_near_copies(spark, docs):
    d, h, w = prob_minhash.shingles(docs.text.tolist())
    cut = np.searchsorted(d, np.arange(len(docs) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
    holders = collections.defaultdict(list)
    for i, (x, _) in enumerate(sets):
        for y in x.tolist():
            holders[y].append(i)
    pairs = {(a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        if prob_minhash.probability_jaccard(sets[a], sets[b]) >= prob_minhash.THRESHOLD:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for k in range(len(docs)):
        groups[find(k)].append(int(docs.doc_id[k]))
    together = lambda gs: {(a, b) for g in gs for k, a in enumerate(sorted(g)) for b in sorted(g)[k + 1 :]}
    want = together(groups.values())
    found = collections.defaultdict(list)
    for r in prob_minhash.groups(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        found[r.group_id].append(r.doc_id)
    got = together(found.values())
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    for trial in range(4):
        sets = []
        for _ in range(2):
            keys = np.sort(rng.choice(60, 40, False))
            sets.append((prob_minhash.mix64(keys.astype(np.uint64) + np.uint64(1000 * trial)), rng.integers(1, 6, 40)))
        sets = [(h[np.argsort(h)], w[np.argsort(h)]) for h, w in sets]
        a, b = ({int(k): float(v) for k, v in zip(*s)} for s in sets)
        brute = sum(1 / sum(max(a.get(e, 0) / a[x], b.get(e, 0) / b[x]) for e in {*a, *b}) for x in a if x in b)
        assert prob_minhash.probability_jaccard(*sets) == pytest.approx(brute)
        sig = prob_minhash.signatures(np.repeat([0, 1], 40), np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), 2, 8192)
        assert abs((sig[0] == sig[1]).mean() - brute) < 0.03


def test_language_held_out(docs):
    even = docs.index % 2 == 0
    model = language_id.fit(docs.text[even].tolist(), docs.lang[even].tolist())
    x, letters = language_id.features(docs.text[~even].tolist())
    pick, _, margin = language_id.decode(model, x @ model.weights + model.bias)
    right = np.array([model.languages[k] for k in pick]) == docs.lang[~even].to_numpy()
    assert right.mean() > 0.97 and (margin < 0.25).mean() < 0.01
    code = language_id.codewords(12)
    assert ((code.shape[1] - code @ code.T) / 2 + np.eye(12) * 99).min() >= 5


def test_decoding_by_brute_force(docs):
    model = language_id.fit(docs.text[:300].tolist(), docs.lang[:300].tolist())
    x, _ = language_id.features(docs.text[300:340].tolist())
    pick, loss, margin = language_id.decode(model, x @ model.weights + model.bias)
    assert {tuple(c) for c in model.code.T} == {(1, *s) for s in [(1, 1, -1), (1, -1, 1), (1, -1, -1), (-1, 1, 1), (-1, 1, -1), (-1, -1, 1), (-1, -1, -1)]}
    for k in range(40):
        scores = []
        for word in model.code:
            total = 0.0
            for bit, sign in enumerate(word):
                m = float(sum(x[k, f] * model.weights[f, bit] for f in np.flatnonzero(x[k]))) + float(model.bias[bit])
                total += float(model.skill[bit]) * np.exp(-np.clip(sign * m, -20, 20))
            scores.append(total)
        first, second = sorted(scores)[:2]
        assert scores[pick[k]] == pytest.approx(first, rel=1e-3) and loss[k] == pytest.approx(first, rel=1e-3) and margin[k] == pytest.approx(second - first, rel=1e-3, abs=1e-6)


def test_quality_scores_by_brute_force(docs):
    """Attention, pooling and logits passage by passage in plain Python."""
    texts = [*docs.text[:6], "", "one two"]
    model = mil_quality.Model(("quality", "toxic"), {k: v.astype(np.float64) for k, v in mil_quality.start(2).items()})
    b = mil_quality.bags(texts)
    logit, attention = mil_quality.score(model, b)
    p, at = model.p, 0
    for d, text in enumerate(texts):
        words = text.split()
        passages = [words[k : k + mil_quality.PASSAGE] for k in range(0, len(words), mil_quality.PASSAGE)]
        assert len(passages) == b.documents[d + 1] - b.documents[d]
        if not passages:
            assert np.isnan(logit[d]).all()
            continue
        vectors = []
        for k, passage in enumerate(passages):
            codes = [mil_quality.WORDS[w] for w in passage]
            total = sum(p["E"][c & 0xFFFF] + p["E"][c >> 16 & 0xFFFF] for c in codes) / np.sqrt(len(codes))
            length, signs = sum(c >> 32 & 0xFF for c in codes) / len(codes), sum(c >> 40 for c in codes) / len(codes)
            measures = np.array([len({c & 0xFFFF for c in codes}) / len(codes), min(length / 10, 2), min(signs, 3), len(codes) / mil_quality.PASSAGE])
            vectors.append(np.tanh(total + measures @ p["M"] + p["b"]))
        for h in range(2):
            raw = [float(np.tanh(v @ p["V"][h]) * (1 / (1 + np.exp(-(v @ p["U"][h])))) @ p["w"][h]) for v in vectors]
            weight = np.exp(raw) / np.exp(raw).sum()
            assert attention[at : at + len(vectors), h] == pytest.approx(weight, rel=1e-4)
            assert logit[d, h] == pytest.approx(float(sum(w * v for w, v in zip(weight, vectors)) @ p["c"][h] + p["d"][h]), rel=1e-4, abs=1e-5)
        at += len(vectors)


def test_quality_held_out(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").toPandas().set_index("doc_id")
    ids = sorted(set(labels.index) & set(big.index))
    train, test = ids[::2], ids[1::2]
    heads = ("quality", "toxic")
    model = mil_quality.fit(big.text[train].tolist(), labels.loc[train, list(heads)].to_numpy(float), heads)
    logit = mil_quality.score(model, mil_quality.bags(big.text[test].tolist()))[0]
    good = labels.quality[test].to_numpy() == 1
    toxic = labels.toxic[test].to_numpy() == 1
    assert (logit[good, 0] > 0).mean() > 0.98 and (logit[~good, 0] < 0).mean() > 0.9
    assert np.median(logit[toxic, 1]) > np.median(logit[~toxic, 1])


def test_quality_gradients(docs):
    b = mil_quality.bags(docs.text[:5].tolist())
    y, even = np.array([[1, 0], [0, 1], [1, np.nan], [0, 0], [1, 1]], float), np.ones((5, 2))
    p = {k: v.astype(float) for k, v in mil_quality.start(2).items()}
    _, g = mil_quality.gradients(p, b, y, even)
    rng = np.random.default_rng(1)
    for name in p:
        where = np.argwhere(np.abs(g[name]) > np.abs(g[name]).max() * 0.1) if p[name].size > 8 else np.argwhere(np.ones_like(p[name]))
        for at in map(tuple, where[rng.permutation(len(where))[:4]]):
            ends = []
            for step in (1e-3, -1e-3):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                ends.append(mil_quality.gradients(q, b, y, even)[0])
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=2e-4), (name, at)


def agreement(x, y):
    """Agreeing matches of two described pictures, of all pairs of descriptors."""
    i, j = np.nonzero(np.bitwise_count(x[5][:, None] ^ y[5][None]).sum(2) <= local_descriptors.MOST_BITS)
    m = np.stack([x[2][i], x[3][i], x[1][i], x[4][i], y[2][j], y[3][j], y[1][j], y[4][j]], 1)
    return local_descriptors.consensus(m)[0] if len(m) else 0


def test_pictures_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [np.rint(local_descriptors.resize(rng.integers(0, 255, (1, 10, 10)).astype(np.float32), 80, 80))[0].astype(np.uint8) for _ in range(12)]
    edited = [np.clip(p * 0.9 + rng.normal(0, 3, p.shape) + 10, 0, 255).astype(np.uint8) for p in base[:4]]
    cropped = [np.ascontiguousarray(p[8:72, 4:74]) for p in base[4:8]]
    turned = [np.ascontiguousarray(np.rot90(p)) for p in base[8:10]]
    pictures = base + edited + cropped + turned
    df = spark.createDataFrame([(k, p.shape[0], p.shape[1], p.tobytes()) for k, p in enumerate(pictures)], "media_id int, height int, width int, pixels binary")
    got = {(r.a, r.b) for r in local_descriptors.copies(df).collect()}
    assert {(k, k + 12) for k in range(10)} == got
    found = [local_descriptors.describe(p[None]) for p in pictures]
    for a in range(len(pictures)):
        for b in range(a + 1, len(pictures)):
            assert ((a, b) in got) == (agreement(found[a], found[b]) >= local_descriptors.LEAST)


def test_consensus_of_many_pairs_at_once():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 30):
        m = np.concatenate([rng.integers(0, 40, (60, n, 2)), rng.choice([1.0, 0.6], (60, n, 1)), rng.uniform(0, 6, (60, n, 1))] * 2, 2)
        m[:30, :, 4:6], m[:30, :, 6:] = m[:30, :, :2] + 3, m[:30, :, 2:4]
        m[:, n // 2] = m[:, 0]
        many = local_descriptors.consensus_of_many(m)
        one = [local_descriptors.consensus(np.unique(x, axis=0)) for x in m]
        assert many[0].tolist() == [x[0] for x in one] and many[3].tolist() == [len(np.unique(x, axis=0)) for x in m]


def test_recall_against_all_descriptor_pairs(spark):
    """Pictures drawn from vectors, with noisy vectors, crops, a covered side, noise and a turn, against a brute force that
    compares every two descriptors whether they share a table or not."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((50, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    def near(c):
        z = rng.standard_normal(v.shape)
        z -= (z * v).sum(1, keepdims=True) * v
        return c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)

    vectors = np.concatenate([v, near(0.99), near(0.97)])
    drawn = local_descriptors.pictures(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id int, embedding array<double>"))
    pictures = [np.frombuffer(r.pixels, np.uint8).reshape(48, 48) for r in sorted(drawn.collect())]
    for p in pictures[:50]:
        pictures += [p[4:44, 2:42], np.where(np.arange(48)[None] < 14, 128, p).astype(np.uint8), np.clip(p * 0.9 + 10 + rng.normal(0, 5, p.shape), 0, 255).astype(np.uint8), np.rot90(p)]
    df = spark.createDataFrame([(k, *p.shape, np.ascontiguousarray(p).tobytes()) for k, p in enumerate(pictures)], "media_id int, height int, width int, pixels binary")
    got = {(r.a, r.b) for r in local_descriptors.copies(df).collect()}
    found = [local_descriptors.describe(np.ascontiguousarray(p)[None]) for p in pictures]
    want = {(a, b) for a in range(len(pictures)) for b in range(a + 1, len(pictures)) if agreement(found[a], found[b]) >= local_descriptors.LEAST}
    assert len(want) > 300 and got <= want and len(got) >= 0.95 * len(want)


def test_mixture_is_exact(spark, docs):
    counts = docs.source.value_counts()
    weights = {s: 1.0 + k % 3 for k, s in enumerate(sorted(counts.index))}
    quota = mixing.quotas({s: int(-(-n // 4)) for s, n in counts.items()}, weights)
    total = sum(weights.values())
    assert all(abs(quota[s] - sum(quota.values()) * w / total) < 1 for s, w in weights.items())
    out = mixing.assign(spark.read.parquet(f"{SF}/documents.parquet"), weights, block=4, shard_rows=64).toPandas()
    assert out.doc_id.is_unique
    took = out.source.value_counts()
    assert all(took[s] == min(quota[s] * 4, counts[s]) for s in counts.index)
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 4 + 2 * len(counts) and len(sizes) == -(-sum(quota.values()) * 4 // 64)
    for _, g in out.groupby("shard"):
        assert sorted(g.position) == list(range(len(g)))
    # each shard has each source's blocks in the number that the tree gives it
    names = sorted(quota)
    tree = {lo: q for q, lo, _ in mixing.grow(np.array([quota[s] for s in names], np.int64), 0, len(sizes), 23)}
    for shard, g in out.groupby("shard"):
        for s, n in zip(names, tree[shard]):
            assert n * 4 - 3 <= (g.source == s).sum() <= n * 4 or n == 0 == (g.source == s).sum()


def test_stars_and_chains_of_near_copies(spark):
    """Groups joined by one document that has not the least id, or only link by link, against all pairs of the buckets."""
    rng = np.random.default_rng(6)
    texts, names = {}, iter(range(10**6))

    def copy(words, n):
        w = list(words)
        for at in rng.choice(len(w) // 2, n, False):
            w[2 * at] = f"r{next(names)}"
        return " ".join(w)

    for centre in (150, 299):
        words = [f"o{next(names)}" for _ in range(200)]
        start = len(texts)
        for k in range(300):
            texts[start + k] = " ".join(words) if k == centre else copy(words, int(rng.integers(15, 21)))
    line = [f"l{next(names)}" for _ in range(100 + 20 * 300)]
    for k, at in enumerate(rng.permutation(300).tolist()):
        texts[600 + k] = " ".join(line[20 * at : 20 * at + 100])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    d, h, w = prob_minhash.shingles(list(texts.values()))
    cut = np.searchsorted(d, np.arange(len(texts) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
    slots = collections.defaultdict(list)
    for r in sorted(prob_minhash.sign(df).select("id", "bands").collect()):
        for s in r.bands:
            slots[s].append(r.id)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for v in slots.values() for k, a in enumerate(v) for b in v[k + 1 :]}:
        if prob_minhash.probability_jaccard(sets[a], sets[b]) >= prob_minhash.THRESHOLD:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    count = collections.Counter(find(k) for k in texts)
    want = {k: find(k) for k in texts if count[find(k)] > 1}
    assert sorted(count.values())[-2] >= 295
    assert {r.doc_id: r.group_id for r in prob_minhash.groups(df).collect()} == want
