"""Operator 3: substring dedup by level-wise doubling.

Words are runs of word characters, lower-cased. A window is repeated if the same words occur at two places, in two
documents or in one. Windows repeated at one length alone are extended to twice that length, until no candidates survive:

* Level BASE (25 words): of the windows only those that have the least hash among BASE + 1 successive ones are sent.
  Two equal passages choose equal windows, so any passage of 2 * BASE words that occurs twice holds a chosen
  repeated one; nothing is lost.
* Level 2 * BASE (50 words): every window that holds a repeated one of the base level is hashed and sent. What repeats
  here is exact: all windows of 50 words that occur twice, told apart by whether they do in two documents or in one.
* Levels 4 * BASE and on: windows of L words, of which again only the least of L + 1 successive ones go, and of these
  only such as hold a window that survived at L / 2. The longest level at which a document has a survivor says how
  long its repeats are: any passage of 2 * L words that occurs twice is seen at L.

Hashes travel packed by bucket, ten to sixteen bytes a window, and are grouped by a sort of each bucket in NumPy; the
number of buckets follows from the size of the texts, so a bucket's size doesn't grow with the table. Texts are
read for the base level and once more, after one shuffle to the ids of documents that have repeats, for all later ones.

Cases: documents without a repeat, with fewer than 2 * BASE words, with a null or empty text, or a null id give no row;
rows that repeat an id and a text are one document, so a document alone is never its own copy. Ids may be of any type:
others than whole numbers go by a 64-bit hash and come back by a join. Texts are whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import WORD, durable, hashed, mix64, steps

BASE = 25
#: Windows that a task gathers before it packs them, some 20 bytes each.
HELD = 400_000
#: Bytes of text whose windows share a bucket.
BUCKET_BYTES = 64 << 20
_B = 0xD6E8FEB86659FD93  # odd, hence invertible
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and of its inverse."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in enumerate((_B, pow(_B, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(flat: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any window follows."""
    up, _ = powers(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * up[:-1], out=out[1:])
    return out


def windows(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of the window of that length at every position at which one begins."""
    if len(sums) <= length:
        return np.zeros(0, np.uint64)
    down = powers(len(sums))[1]
    return mix64((sums[length:] - sums[:-length]) * down[: len(sums) - length] + np.uint64(length))


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over every `width` successive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


def chosen(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of values that are the least of some `width` successive ones."""
    if len(h) < width:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = sliding(h, width, np.minimum)
    top = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(top, width, np.maximum) == h)


def pack(h: np.ndarray, docs: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, ids of documents, windows of each, positions, hashes); entries come ordered by document and position."""
    bucket = (h >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, h, docs, pos = bucket[order], h[order], docs[order], pos[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts, np.append(cuts[1:], len(h))):
        d, p = docs[a:b], pos[a:b]
        heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        for out, v in zip(rows, (int(bucket[a]), d[heads].tobytes(), np.diff(np.append(heads, b - a)).astype(np.uint32).tobytes(), p.astype(np.uint32).tobytes(), h[a:b].tobytes())):
            out.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "docs", "counts", "pos", "h"])


PACKED = "bucket int, docs binary, counts binary, pos binary, h binary"


class Packer:
    """Gathers the windows of several steps before they are packed, so that a row of a bucket holds many of them
    where buckets are many too."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, h: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, docs, pos))
        self.size += len(h)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pack(*(np.concatenate(x) for x in zip(*self.parts)), self.buckets)
        self.parts, self.size = [], 0


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, position) of all entries of a bucket."""

    def whole(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    return whole("h", np.uint64), np.repeat(whole("docs", np.int64), whole("counts", np.uint32)), whole("pos", np.uint32)


def repeated(h: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries whose hash occurs at two places at least, whether in two documents, whether twice in their own)."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    twice = np.zeros(len(hs), bool)
    twice[1:] |= hs[1:] == hs[:-1]
    twice[:-1] |= hs[1:] == hs[:-1]
    order = order[twice]
    order = order[np.lexsort((pos[order], docs[order], h[order]))]
    hs, ds, ps = h[order], docs[order], pos[order]
    if not len(hs):
        return order, twice[:0], twice[:0]
    same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    new = np.append(True, ~(same & (ps[1:] == ps[:-1])))  # a row that is there twice counts once
    order, hs, ds = order[new], hs[new], ds[new]
    heads = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
    size = np.diff(np.append(heads, len(hs)))
    across = np.repeat(np.maximum.reduceat(ds, heads) != np.minimum.reduceat(ds, heads), size)
    heads = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])))
    size = np.diff(np.append(heads, len(hs)))
    own = np.repeat(size > 1, size)
    ok = across | own
    return order[ok], across[ok], own[ok]


def by_document(docs: np.ndarray, payload: np.ndarray) -> pa.Table:
    """(id, the payload of its entries)."""
    order = np.argsort(docs, kind="stable")
    docs, payload = docs[order], payload[order]
    heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    parts = [payload[a:b].tobytes() for a, b in zip(heads, np.append(heads[1:], len(docs)))]
    return pa.table([pa.array(docs[heads], pa.int64()), pa.array(parts, pa.binary())], ["id", "part"])


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, offsets, ids) of the documents of a step."""
    flat, offsets = hashed([WORD.findall(t.lower()) if t else [] for t in batch.column("__text").to_pylist()])
    return flat, offsets, batch.column("id").to_numpy(zero_copy_only=False)


def _room(offsets: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which positions have room for a window in their own document."""
    n = np.diff(offsets)
    left = np.repeat(offsets[1:], n) - np.arange(total)
    return (left >= length)[: max(0, total - length + 1)]


def base_level(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in steps(batches, "__text"):
            flat, offsets, ids = _read(batch)
            h = windows(prefix(flat), BASE)
            h = np.where(_room(offsets, BASE, len(flat)), h, np.uint64(2**64 - 1))
            at = chosen(h, BASE + 1)
            at = at[h[at] != np.uint64(2**64 - 1)]
            owner = np.searchsorted(offsets, at, side="right") - 1
            long = np.diff(offsets)[owner] >= 2 * BASE
            at, owner = at[long], owner[long]
            yield from packer.add(h[at], ids[owner], at - offsets[owner])
        yield from packer.flush()

    return docs.mapInArrow(run, PACKED)


def later_levels(docs: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of level 2 * BASE (id null), and (id, level, pos, h) of the chosen windows of later levels (bucket null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packer = [*"bucket docs counts pos h".split(), "id", "level"], Packer(buckets)

        def wide_rows(packed: pa.RecordBatch) -> pa.RecordBatch:
            n = packed.num_rows
            return pa.RecordBatch.from_arrays([*packed.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)

        for batch in steps(batches, "__text"):
            flat, offsets, ids = _read(batch)
            sums = prefix(flat)
            marks = [np.frombuffer(b"".join(m), np.uint64) for m in batch.column("marks").to_pylist()]
            h = windows(sums, BASE)
            edge = np.zeros(len(flat) + 1, np.int32)
            for k, m in enumerate(marks):
                a, b = offsets[k], offsets[k + 1]
                hit = a + np.flatnonzero(np.isin(h[a : max(a, b - BASE + 1)], m))
                np.add.at(edge, np.maximum(hit - BASE, a), 1)
                np.add.at(edge, hit + 1, -1)
            wide = windows(sums, 2 * BASE)
            room = _room(offsets, 2 * BASE, len(flat))
            at = np.flatnonzero((np.cumsum(edge)[: len(wide)] > 0) & room)
            owner = np.searchsorted(offsets, at, side="right") - 1
            yield from map(wide_rows, packer.add(wide[at], ids[owner], at - offsets[owner]))
            length, out = 4 * BASE, [[], [], [], []]
            longest = int(np.diff(offsets).max(initial=0))
            while length <= longest:
                top = np.where(_room(offsets, length, len(flat)), windows(sums, length), np.uint64(2**64 - 1))
                pick = chosen(top, length + 1)
                pick = pick[top[pick] != np.uint64(2**64 - 1)]
                who = np.searchsorted(offsets, pick, side="right") - 1
                heads = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
                for a, b in zip(heads, np.append(heads[1:], len(who))):
                    for o, v in zip(out, ((pick[a:b] - offsets[who[a]]).astype(np.uint32).tobytes(), top[pick[a:b]].tobytes(), int(ids[who[a]]), length)):
                        o.append(v)
                length *= 2
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], names)
        yield from map(wide_rows, packer.flush())

    return docs.mapInArrow(run, f"{PACKED}, id bigint, level int")


def _marks(table: pa.Table) -> pa.Table:
    h, docs, pos = unpack(table)
    keep, _, _ = repeated(h, docs, pos)
    return by_document(docs[keep], h[keep])


def _places(table: pa.Table) -> pa.Table:
    """(id, positions, own): those repeated in other documents, and apart those repeated in their own."""
    h, docs, pos = unpack(table)
    keep, across, own = repeated(h, docs, pos)
    parts = [by_document(docs[keep[x]], pos[keep[x]]) for x in (across, own)]
    return pa.concat_tables([p.append_column("own", pa.array([k == 1] * p.num_rows, pa.bool_())) for k, p in enumerate(parts)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, across, own, any): a document's repeated starts of each kind as runs of successive positions."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def runs(parts: list[bytes]) -> list[dict]:
        p = np.unique(np.frombuffer(b"".join(parts), np.uint32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(p) > 1)
        lo, hi = (p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)]) if len(p) else (p, p)
        return [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)]

    for batch in batches:
        rows = [(runs(x), runs(y), runs(x + y)) for x, y in zip(batch.column("across").to_pylist(), batch.column("own").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], kind) for k in range(3))], ["id", "across", "own", "runs"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos, h) of packed windows of one document a row that hold a survivor of the level before."""
    for batch in batches:
        ids, ps, hs = [], [], []
        for i, level, pos, h, alive in zip(*(batch.column(c).to_pylist() for c in ("id", "level", "pos", "h", "alive"))):
            p = np.frombuffer(pos, np.uint32).astype(np.int64)
            lo = np.array([r["lo"] for r in alive])
            hi = np.array([r["hi"] for r in alive])
            # the first run that does not end before the window begins has to begin by the window's middle
            k = np.searchsorted(hi, p)
            ok = (k < len(lo)) & (lo[np.minimum(k, len(lo) - 1)] <= p + level // 2)
            ids.append(np.full(ok.sum(), i, np.int64))
            ps.append(p[ok].astype(np.int32))
            hs.append(np.frombuffer(h, np.int64)[ok])
        if ids:
            yield pa.RecordBatch.from_arrays([np.concatenate(ids), np.concatenate(ps), np.concatenate(hs)], ["id", "pos", "h"])


def _joined(runs: str) -> Column:
    """Runs of starts whose windows touch as one span of words."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last.getField("start").alias("start"), (r.hi + 2 * BASE).alias("stop"))))
        return F.when((F.size(acc) > 0) & (last.getField("stop") >= r.lo), longer).otherwise(F.concat(acc, F.array(F.struct(r.lo.alias("start"), (r.hi + 2 * BASE).alias("stop")))))

    return F.aggregate(runs, empty, add)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, own_spans array<struct<start,stop>>, repeated_words, longest_level) of each document that has a repeated passage.

    spans: the words, counted from 0, that lie in a window of 2 * BASE words which occurs in another document; repeated_words
    is their number. own_spans: those in a window that occurs twice in this document.
    """
    spark = docs.sparkSession
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col(id_col).cast("bigint") if whole else F.xxhash64(id_col)
    source = docs.where(F.col(id_col).isNotNull()).select(key.alias("id"), F.col(text_col).alias("__text"))
    size = source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    marks = base_level(source, buckets).groupBy("bucket").applyInArrow(_marks, "id bigint, part binary")
    marks = marks.groupBy("id").agg(F.collect_list("part").alias("marks"))
    levels = durable(later_levels(source.join(marks, "id"), buckets))
    places = levels.where("bucket is not null").select(*"bucket docs counts pos h".split()).groupBy("bucket").applyInArrow(_places, "id bigint, part binary, own boolean")
    parts = places.groupBy("id").agg(*(F.collect_list(F.when(F.col("own") == own, F.col("part"))).alias(name) for name, own in (("across", False), ("own", True))))
    kind = "array<struct<lo:int,hi:int>>"
    runs = durable(parts.mapInArrow(_runs, f"id bigint, across {kind}, own {kind}, runs {kind}"))
    alive, level, longest = runs.select("id", F.col("runs").alias("alive")), 4 * BASE, runs.select("id", F.lit(2 * BASE).alias("level"))
    while True:
        candidates = levels.where((F.col("level") == level) & F.col("bucket").isNull()).select("id", "level", "pos", "h").join(alive, "id")
        opened = candidates.mapInArrow(_open, "id bigint, pos int, h bigint")
        place = F.struct("id", "pos")
        two = opened.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h")
        left = durable(opened.join(two, "h", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("p")))
        if left.isEmpty():
            break
        alive = left.select("id", F.transform("p", lambda x: F.struct(x.alias("lo"), x.alias("hi"))).alias("alive"))
        longest = longest.unionByName(left.select("id", F.lit(level).alias("level")))
        level *= 2
    spans = runs.select("id", _joined("across").alias("spans"), _joined("own").alias("own_spans"))
    out = spans.join(longest.groupBy("id").agg(F.max("level").alias("longest_level")), "id")
    out = out.withColumn("repeated_words", F.aggregate("spans", F.lit(0), lambda s, x: s + x.stop - x.start))
    if whole:
        out = out.withColumn(id_col, F.col("id").cast(docs.schema[id_col].dataType))
    else:
        out = out.join(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), key.alias("id")).distinct(), "id")
    return out.select(id_col, "spans", "own_spans", "repeated_words", "longest_level")
