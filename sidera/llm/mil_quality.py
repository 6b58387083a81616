"""Operator 10: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage's words are hashed as they stand and by their shape (runs
of capitals, small letters, digits, other signs); its vector is tanh of the scaled sum of the learned vectors of those
hashes and of a few measures (distinct words, length of words, signs). For each label a gated attention network,
softmax over passages of w . (tanh(V h) * sigmoid(U h)), weighs the passages, and the label's score is a logistic
function of the weighted passage representation. All parts are learned together from labels of whole documents.

It is fitted to at most `train_rows` labelled documents, drawn by a hash of the id with as many of each combination
of labels where there are that many; this bound is the only sample. Scoring encodes every passage of every text.

Cases: a text that is null, empty or without words has no passage; its scores are null and it is not kept; a null
label is left out of training for that label; without any labelled document all scores are null and nothing is kept;
labels that repeat an id count by their largest value; rows with a null or repeated id are scored one by one.
Ties in attention share the weight. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import steps

PASSAGE, BUCKETS, WIDTH, GATE, MEASURES = 24, 1 << 14, 16, 8, 4
#: Pull of the word vectors to zero.
DECAY = 1e-4
_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "9"), (re.compile(r"([^Aa9])\1+"), r"\1"))


class Words(dict):
    """Of the words seen lately: bucket of the word, of its shape, length and signs, in one number."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        if word.isalpha():
            shape, signs = "a" if word.islower() else "Aa" if word.istitle() else "A" if word.isupper() else "Xx", 0
        else:
            shape = word
            for pattern, to in _RUNS:
                shape = pattern.sub(to, shape)
            signs = min(63, sum(not c.isalnum() for c in word))
        half = BUCKETS // 2
        core = xxhash.xxh3_64_intdigest(word.lower().strip(".,;:!?\"'()").encode()) % half
        found = self[word] = core | (xxhash.xxh3_64_intdigest(shape.encode()) % half + half) << 16 | min(63, len(word)) << 32 | signs << 40
        return found


WORDS = Words()


@dataclass
class Bags:
    """Documents cut in passages: word rows (word bucket, shape bucket), where passages and documents begin, measures."""

    rows: np.ndarray
    passages: np.ndarray
    documents: np.ndarray
    measures: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    count = -(-n // PASSAGE)
    documents = np.concatenate([[0], np.cumsum(count)])
    begin = np.concatenate([[0], np.cumsum(n)])
    which = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(which)) - documents[:-1][which]
    starts = begin[:-1][which] + inner * PASSAGE
    passages = np.append(starts, begin[-1])
    code = np.empty(begin[-1], np.int64)
    for k, ws in enumerate(words):
        code[begin[k] : begin[k + 1]] = np.fromiter(map(WORDS.__getitem__, ws), np.int64, len(ws))
    rows = np.stack([code & 0xFFFF, code >> 16 & 0xFFFF], 1).astype(np.int32)
    if not len(starts):
        return Bags(rows, passages, documents, np.zeros((0, MEASURES), np.float32))
    size = np.diff(passages).astype(np.float32)
    owner = np.repeat(np.arange(len(size)), np.diff(passages))
    key = np.sort(owner * np.int64(BUCKETS) + rows[:, 0])  # nearly in order: passages come one after another
    distinct = np.bincount(key[np.append(True, key[1:] != key[:-1])] // BUCKETS, minlength=len(size))
    length, signs = np.add.reduceat(code >> 32 & 0xFF, starts), np.add.reduceat(code >> 40, starts)
    measures = np.stack([distinct / size, np.minimum(length / size / 10, 2), np.minimum(signs / size, 3), size / PASSAGE], 1)
    return Bags(rows, passages, documents, measures.astype(np.float32))


@dataclass
class Model:
    """Learned arrays by name; heads are the labels' names."""

    heads: tuple[str, ...]
    p: dict[str, np.ndarray]


def _segment_softmax(s: np.ndarray, documents: np.ndarray) -> np.ndarray:
    has = documents[:-1] < documents[1:]
    heads, size = documents[:-1][has], np.diff(documents)[has]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), size, axis=0))
    return e / np.repeat(np.add.reduceat(e, heads), size, axis=0)


def encode(p: dict[str, np.ndarray], b: Bags) -> np.ndarray:
    """passages x WIDTH."""
    n = np.diff(b.passages).astype(np.float32)[:, None]
    out = np.empty((len(n), WIDTH), np.float32)
    for a in range(0, len(n), 2048):  # a bounded piece of word vectors at a time
        z = min(a + 2048, len(n))
        lo, hi = b.passages[a], b.passages[z]
        vectors = p["E"][b.rows[lo:hi, 0]] + p["E"][b.rows[lo:hi, 1]]
        out[a:z] = np.add.reduceat(vectors, b.passages[a:z] - lo) / np.sqrt(n[a:z])
    return np.tanh(out + b.measures @ p["M"] + p["b"])


def score(model: Model, b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """(documents x heads, logits, NaN without a passage; passages x heads, attention)."""
    p, out = model.p, np.full((len(b.documents) - 1, len(model.heads)), np.nan)
    if not len(b.measures) or not model.heads:
        return out, np.zeros((len(b.measures), len(model.heads)))
    h = encode(p, b)
    has = b.documents[:-1] < b.documents[1:]
    weights = []
    for k in range(len(model.heads)):
        gate = np.tanh(h @ p["V"][k]) / (1 + np.exp(-(h @ p["U"][k])))
        a = _segment_softmax(gate @ p["w"][k], b.documents)
        z = np.add.reduceat(a[:, None] * h, b.documents[:-1][has])
        out[has, k] = z @ p["c"][k] + p["d"][k]
        weights.append(a)
    return out, np.stack(weights, 1)


def gradients(p: dict[str, np.ndarray], b: Bags, y: np.ndarray, even: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted cross entropy and its gradient; y is documents x heads with NaN where a label is missing."""
    h, heads = encode(p, b), y.shape[1]
    has = b.documents[:-1] < b.documents[1:]
    first, size = b.documents[:-1][has], np.diff(b.documents)[has]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh, loss = np.zeros_like(h), 0.0
    for k in range(heads):
        t, s = np.tanh(h @ p["V"][k]), 1 / (1 + np.exp(-(h @ p["U"][k])))
        a = _segment_softmax((t * s) @ p["w"][k], b.documents)
        z = np.add.reduceat(a[:, None] * h, first)
        logit = np.clip(z @ p["c"][k] + p["d"][k], -30, 30)
        label, known = np.nan_to_num(y[has, k]), ~np.isnan(y[has, k])
        weight = np.where(known, even[has, k], 0) / max(1, known.sum())
        prob = 1 / (1 + np.exp(-logit))
        loss += float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
        dl = (weight * (prob - label)).astype(np.float32)
        g["c"][k] = z.T @ dl
        g["d"][k] = dl.sum()
        dz = np.repeat(dl[:, None] * p["c"][k][None], size, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        g["w"][k] = (t * s).T @ ds
        dgate = ds[:, None] * p["w"][k][None]
        dt, du = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        g["V"][k], g["U"][k] = h.T @ dt, h.T @ du
        dh += a[:, None] * dz + dt @ p["V"][k].T + du @ p["U"][k].T
    dx = dh * (1 - h * h)
    g["M"], g["b"] = b.measures.T @ dx, dx.sum(0)
    per = np.repeat(dx / np.sqrt(np.diff(b.passages))[:, None], np.diff(b.passages), axis=0)
    for c in (0, 1):
        order = np.argsort(b.rows[:, c], kind="stable")
        rows = b.rows[order, c]
        heads_at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        g["E"][rows[heads_at]] += np.add.reduceat(per[order], heads_at)
    return loss, g


def start(heads: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    return {"E": draw(BUCKETS, WIDTH) * np.float32(0.1), "M": draw(MEASURES, WIDTH), "b": np.zeros(WIDTH, np.float32), "V": draw(heads, WIDTH, GATE), "U": draw(heads, WIDTH, GATE), "w": draw(heads, GATE), "c": draw(heads, WIDTH), "d": np.zeros(heads, np.float32)}


def fit(texts: list[str], labels: np.ndarray, heads: tuple[str, ...], epochs: int = 20, batch: int = 32, rate: float = 0.03, seed: int = 3) -> Model:
    """The model of texts with labels (documents x heads; NaN where missing), by Adam."""
    y = np.asarray(labels, float).reshape(len(texts), len(heads))
    use = np.array([bool(t and t.split()) for t in texts]) & ~np.isnan(y).all(1)
    texts, y = [t for t, u in zip(texts, use) if u], y[use]
    if not texts:
        return Model((), {})
    rate_of = np.clip(np.nanmean(y, axis=0), 0.02, 0.98)
    even = np.where(y > 0.5, 0.5 / rate_of, 0.5 / (1 - rate_of))
    p, rng = start(len(heads), seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    order = np.array(sorted(range(len(texts)), key=lambda k: len(texts[k])))
    packs = [(bags([texts[k] for k in order[a : a + batch]]), order[a : a + batch]) for a in range(0, len(order), batch)]
    # words of one or two documents teach nothing of others: their vectors stay zero, as those of words never seen
    seen = np.zeros(BUCKETS)
    for b, _ in packs:
        owner = np.repeat(np.repeat(np.arange(len(b.documents) - 1), np.diff(b.documents)), np.diff(b.passages))
        for c in (0, 1):
            seen += np.bincount(np.unique(owner * np.int64(BUCKETS) + b.rows[:, c]) % BUCKETS, minlength=BUCKETS)
    common = (seen >= 3)[:, None]
    p["E"] *= common
    for epoch in range(epochs):
        for k in rng.permutation(len(packs)):
            b, ids = packs[k]
            _, g = gradients(p, b, y[ids], even[ids])
            g["E"] = g["E"] * common + DECAY * p["E"]
            step += 1
            pace = rate * min(1.0, 2 * (1 - epoch / epochs))
            for n, x in g.items():
                m[n] += 0.1 * (x - m[n])
                v[n] += 0.01 * (x * x - v[n])
                p[n] -= (pace * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(heads, p)


def train(docs: DataFrame, labels: DataFrame, heads: tuple[str, ...] = ("quality", "toxic"), train_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of about train_rows labelled documents, never over twice as many."""
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.max(h).cast("double").alias(h) for h in heads))
    kinds = {tuple(r[:-1]): r[-1] for r in named.groupBy(*heads).count().collect()}
    if not kinds:
        return Model((), {})
    each, keep = -(-train_rows // len(kinds)), F.lit(False)
    draw = F.pmod(F.xxhash64(F.col("__id"), F.lit(29)), F.lit(1 << 30))
    for kind, n in kinds.items():
        same = F.lit(True)
        for h, value in zip(heads, kind):
            same = same & F.col(h).eqNullSafe(F.lit(value).cast("double"))
        keep = keep | (same & (draw < int((1 << 30) * min(1.0, each / n))))
    drawn = F.broadcast(named.where(keep).limit(2 * train_rows))  # of bounded size
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = sorted(texts.join(drawn, "__id").select("__id", "__text", *heads).limit(2 * train_rows).collect(), key=lambda r: (str(r[0]), r[1]))
    return fit([r[1] for r in rows], np.array([[np.nan if x is None else x for x in r[2:]] for r in rows], float).reshape(len(rows), len(heads)), heads)


def classify(docs: DataFrame, model: Model, heads: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passages, p_<head> and peak_<head>, the passage of most attention, for each head, keep) of every row.

    keep: the first head's probability is at least a half. The other heads inform; they drop nothing.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: BUCKETS x WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = send.value
        for batch in steps(batches, "__text"):
            b = bags(batch.column("__text").to_pylist())
            logit, attention = score(m, b)
            if not m.heads:
                logit = np.full((batch.num_rows, len(heads)), np.nan)
            prob = 1 / (1 + np.exp(-logit))
            none = np.isnan(prob[:, 0])
            out = [batch.column(0), pa.array(np.diff(b.documents).astype(np.int32))]
            for k in range(len(heads)):
                out.append(pa.array(prob[:, k], mask=none))
                peak = np.zeros(batch.num_rows, np.int32)
                for d in np.flatnonzero(~none):
                    peak[d] = attention[b.documents[d] : b.documents[d + 1], k].argmax()
                out.append(pa.array(peak, mask=none))
            keep = (~none) & (np.nan_to_num(prob[:, 0]) >= 0.5)
            yield pa.RecordBatch.from_arrays([*out, pa.array(keep)], [batch.schema.names[0], "passages", *(x for h in heads for x in (f"p_{h}", f"peak_{h}")), "keep"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    columns = ", ".join(f"`p_{h}` double, `peak_{h}` int" for h in heads)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, passages int, {columns}, keep boolean")
