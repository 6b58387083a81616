"""Operator 5: language ID by error-correcting output codes.

Each language has a codeword of bits; for every bit a logistic classifier over hashed byte n-grams (2, 3 and 4
bytes of the lower-cased text) predicts it. Decoding weighs the exponential loss of every bit by that bit's
held-out skill and chooses the codeword of least loss; the loss left to the second codeword is the margin.

The bits are distinct splits of the languages into two sets, drawn at random: `10 log2` of their number, or all splits
where there are no more. The classifiers are fitted to at most `train_rows` labelled rows, drawn by a hash
of the id with as many from each language where it has them; this bound is the only sample, and scoring reads every
text whole.

Cases: a text that is null or has no letter is rejected with a null language; a text of whatever length whose margin is
under `ambiguous_margin` is flagged ambiguous and rejected, as two codewords are as near. Rows with a null label are scored but never trained on; a single label
makes every other text that label; a table with no labels rejects all. Equal losses go to the language first in
order. Rows with a null or repeated id are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import numbered, steps

FEATURES = 1 << 13


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, of +1 and -1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    skill: np.ndarray  # weight of each bit in decoding


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of ceil(10 log2 k) bits: distinct splits in two, drawn at random, all of them where there are no more.

    Of several draws the one counts whose nearest two codewords are farthest apart.
    """
    if k <= 1:
        return np.ones((k, 1))
    bits = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1.0
    for _ in range(200):
        draw = np.where(rng.random((k, 16 * bits)) < 0.5, -1.0, 1.0)
        draw = draw * draw[0]  # a split and its opposite are one
        code = np.unique(draw[:, (draw < 0).any(0)], axis=1)
        code = code[:, rng.permutation(code.shape[1])[:bits]]
        distance = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * 1e9).min()
        if distance > apart:
            best, apart = code, distance
    return best


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x FEATURES, letters of each): square roots of byte n-gram counts, at length one."""
    raw = [t.lower().encode() for t in texts]
    out = np.zeros((len(raw), FEATURES), np.float32)
    letters = np.zeros(len(raw), np.int64)
    for k, r in enumerate(raw):
        b = np.frombuffer(r, np.uint8)
        letter = ((b >= 97) & (b <= 122)) | (b >= 0x80)
        letters[k] = int((letter & ((b & 0xC0) != 0x80)).sum())
        # anything but a letter is a boundary; runs of boundaries count once
        c = np.where(letter, b, 32).astype(np.uint32)
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
        c = c[(c != 32) | np.append(True, c[:-1] != 32)]
        if len(c) < 2:
            continue
        two = c[:-1] * np.uint32(0x01000193) + c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0xC2B2AE35)
        four = three[:-1] * np.uint32(0x27D4EB2F) + c[3:] * np.uint32(0x165667B1)
        out[k] = np.bincount(np.concatenate([two, three, four]) >> np.uint32(19), minlength=FEATURES)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, letters


def fit(texts: list[str], labels: list[str], rounds: int = 120, rate: float = 12.0, seed: int = 11) -> Model:
    """The model of the labelled texts; a tenth is held out for the skill of each bit."""
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((FEATURES, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32), np.ones(code.shape[1]))
    x, _ = features(texts)
    y = code[[languages.index(v) for v in labels]]
    held = np.random.default_rng(seed).random(len(texts)) < 0.1
    if held.all() or not held.any():
        held = np.arange(len(texts)) % 10 == 9
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    xt, yt = x[~held], y[~held].astype(np.float32)
    side = [np.maximum((yt > 0).mean(0), 1e-3), np.maximum((yt < 0).mean(0), 1e-3)]
    even = np.where(yt > 0, 0.5 / side[0], 0.5 / side[1]).astype(np.float32)  # both sides of a bit weigh the same
    for _ in range(rounds):
        g = (yt * even / (1 + np.exp(np.clip(yt * (xt @ w + b), -30, 30)))) / len(xt)
        w += rate * (xt.T @ g - 1e-6 * w)
        b += rate * g.sum(0)
    right = ((x[held] @ w + b) * y[held] > 0).mean(0) if held.any() else np.ones(code.shape[1])
    skill = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, code, w, b, skill / skill.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its loss, loss of the second less its own) by loss-weighted decoding."""
    loss = (np.exp(-np.clip(margins[:, None, :] * model.code[None], -20, 20)) * model.skill).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    first = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
    second = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] if loss.shape[1] > 1 else first + 1e9
    return order[:, 0], first, second - first


def training_rows(docs: DataFrame, train_rows: int, id_col: str, text_col: str, label_col: str) -> list:
    """About train_rows labelled rows, never over twice as many, chosen by a hash of their ids."""
    named = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(label_col).count().collect()}
    if not sizes:
        return []
    each = -(-train_rows // len(sizes))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30))
    keep = F.lit(False)
    for label, n in sorted(sizes.items()):
        keep = keep | ((F.col(label_col) == label) & (draw < int((1 << 30) * min(1.0, each / n))))
    return named.where(keep).select(F.col(id_col), F.col(text_col), F.col(label_col)).limit(2 * train_rows).collect()


def train(docs: DataFrame, train_rows: int = 1600, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    rows = sorted(training_rows(docs, train_rows, id_col, text_col, label_col), key=lambda r: (str(r[0]), r[1]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def identify(docs: DataFrame, model: Model, ambiguous_margin: float = 0.25, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_id, loss, margin, ambiguous, rejected) of each row; with text_col in keep the text goes along."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: FEATURES x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = send.value
        names = np.array([*m.languages, None], object)
        for batch in steps(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            pick, loss, margin, letters = (np.zeros(len(texts), t) for t in (np.int64, float, float, np.int64))
            for a in range(0, len(texts), 256):
                x, letters[a : a + 256] = features(texts[a : a + 256])
                if m.languages:
                    pick[a : a + 256], loss[a : a + 256], margin[a : a + 256] = decode(m, x @ m.weights + m.bias)
            none = (letters == 0) | (not m.languages)
            ambiguous = none | (margin < ambiguous_margin)
            found = names[np.where(none, len(m.languages), pick)]
            out = [pa.array(found, pa.string()), pa.array(loss, mask=none), pa.array(margin, mask=none), pa.array(ambiguous), pa.array(ambiguous)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "lang_id", "loss", "margin", "ambiguous", "rejected"])

    source = docs.select(F.col(id_col), *(c for c in keep if c != id_col), F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, lang_id string, loss double, margin double, ambiguous boolean, rejected boolean")


def stage(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that are not rejected, with the columns that came in."""
    model = train(docs, text_col=text_col)
    plain = numbered(docs)
    text = plain.columns[docs.columns.index(text_col)]
    found = identify(plain.withColumn("__row", F.lit(0)), model, id_col="__row", text_col=text, keep=tuple(plain.columns), **options)
    return found.where(~F.col("rejected")).select(*(F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns)))
