"""Operator 6: media columns matched by local image descriptors.

A media row is a grey picture: height, width and its bytes row by row. On each scale of a pyramid corners are the local
maxima of the Harris measure; each corner's direction is that of the intensity centroid around it, and its descriptor
is 256 comparisons of smoothed intensities at point pairs turned to that direction. A match is two descriptors that differ
in MOST_BITS bits at most; it implies a similarity transform by the corners' scales, directions and places. Two pictures
are copies if `least` matches with corners distinct on both sides agree on one transform. So copies that are cropped,
scaled, turned or edited in part are found.

1. A descriptor's eight words of 32 bits are keys of eight Hamming tables: corners that share a word at one table are
   compared in full. All matches within 7 bits meet for sure, others by chance.
2. Pairs of pictures of which SEED such matches agree on a transform are candidates. Those with `least` are copies;
   of the others all corners are compared with all, so the tables need to find two matches of a copy only.

copies() gives these pairs, groups() one row an id, with its class and the number of its pairs.

Corners and matches travel packed by column and bucket, and each bucket is sorted in NumPy; the number of buckets follows
from that of the corners, so a bucket's size doesn't grow with the table. Ids are whole numbers.

All corners above a part of the picture's own greatest measure count, and all members of a table's entry are compared:
there is no cap on corners, entries or partners.

Cases: a row with a null id, null or short bytes, a size under 8 or a null size is in no pair; neither is a picture of
one grey; rows that repeat an id are pictures of one medium, whose corners count together and once each; pairs are (lesser id, greater id), each once; of
transforms with equally many matches the first match's counts. `matches` and `agreeing` count what the tables found where
that is enough, else all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import components, durable, mix64

SCALES = (1.0, 0.6)
RADIUS, BITS, TURNS, MOST_BITS, SHARE, LEAST, NEAR = 13, 256, 36, 24, 0.02, 4, 3.0
#: Words of a descriptor that have a table, and matches found there that make a pair of pictures a candidate.
TABLES, SEED = 8, 2
#: Bytes of entries in a bucket.
BUCKET_BYTES = 16 << 20
PAD = RADIUS + 3


@lru_cache(maxsize=1)
def pattern() -> np.ndarray:
    """TURNS x BITS x 2 x 2: the point pairs (dx, dy) at every direction."""
    rng = np.random.default_rng(17)
    p = rng.normal(0, RADIUS / 2.2, (BITS * 4, 2, 2))
    p = p[(np.hypot(p[..., 0], p[..., 1]) < RADIUS - 1).all(1)][:BITS]
    t = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(t), -np.sin(t)], -1), np.stack([np.sin(t), np.cos(t)], -1)], 1)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, p)).astype(np.int32)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pictures (n, H, W) at h x w, bilinear."""
    n, hh, ww = x.shape
    r = np.clip((np.arange(h) + 0.5) * hh / h - 0.5, 0, hh - 1)
    c = np.clip((np.arange(w) + 0.5) * ww / w - 0.5, 0, ww - 1)
    r0, c0 = np.minimum(r.astype(int), max(hh - 2, 0)), np.minimum(c.astype(int), max(ww - 2, 0))
    fr, fc = (r - r0)[None, :, None].astype(np.float32), (c - c0)[None, None].astype(np.float32)
    r1, c1 = np.minimum(r0 + 1, hh - 1), np.minimum(c0 + 1, ww - 1)
    rows = x[:, r0] * (1 - fr) + x[:, r1] * fr
    return rows[:, :, c0] * (1 - fc) + rows[:, :, c1] * fc


def box(x: np.ndarray, k: int) -> np.ndarray:
    """Mean over (2k+1) x (2k+1), edges repeated."""
    p = np.pad(x, ((0, 0), (k + 1, k), (k + 1, k)), mode="edge")
    s = p.cumsum(1, dtype=np.float64).cumsum(2)
    m = 2 * k + 1
    return ((s[:, m:, m:] - s[:, :-m, m:] - s[:, m:, :-m] + s[:, :-m, :-m]) / (m * m)).astype(np.float32)


def peaks(r: np.ndarray, k: int = 2) -> np.ndarray:
    """Where a value is the greatest of its (2k+1) x (2k+1) surroundings."""
    out = r
    for axis in (1, 2):
        p = np.pad(out, [(0, 0) if a != axis else (k, k) for a in range(3)], mode="edge")
        out = np.maximum.reduce([np.take(p, np.arange(i, i + out.shape[axis]), axis) for i in range(2 * k + 1)])
    return r >= out


def describe(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(picture, scale, x, y, angle, words (corners x 8, uint32)) of the corners of pictures (n, H, W)."""
    parts = []
    base = x.astype(np.float32)
    for scale in SCALES:
        h, w = int(round(x.shape[1] * scale)), int(round(x.shape[2] * scale))
        if min(h, w) < 8:
            continue
        level = base if scale == 1.0 else resize(box(base, 1), h, w)
        smooth = box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        measure = a * b - c * c - 0.05 * (a + b) ** 2
        top = measure.max((1, 2), keepdims=True)
        n, r, q = np.nonzero(peaks(measure) & (measure > SHARE * top) & (top > 1e-3))
        if not len(n):
            continue
        wide = np.pad(smooth, ((0, 0), (PAD, PAD), (PAD, PAD)), mode="reflect" if min(h, w) > PAD else "edge")
        dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
        disc = np.hypot(dx, dy) <= RADIUS
        dy, dx = dy[disc], dx[disc]
        for lo in range(0, len(n), 4096):
            i, y, z = n[lo : lo + 4096], r[lo : lo + 4096] + PAD, q[lo : lo + 4096] + PAD
            patch = wide[i[:, None], y[:, None] + dy, z[:, None] + dx]
            angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
            pts = pattern()[turn]
            first = wide[i[:, None], y[:, None] + pts[:, :, 0, 1], z[:, None] + pts[:, :, 0, 0]]
            second = wide[i[:, None], y[:, None] + pts[:, :, 1, 1], z[:, None] + pts[:, :, 1, 0]]
            words = np.packbits(first < second, axis=1).view(">u4").astype(np.uint32)
            parts.append((i, np.full(len(i), scale), (z - PAD + 0.5) / scale, (y - PAD + 0.5) / scale, angle, words))
    if not parts:
        return tuple(np.zeros(s) for s in ((0,), (0,), (0,), (0,), (0,))) + (np.zeros((0, 8), np.uint32),)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(6))


def consensus(m: np.ndarray) -> tuple[int, float, float]:
    """(matches that agree on one transform, its scale, its rotation) of rows (xa, ya, sa, ta, xb, yb, sb, tb)."""
    ratio = m[:, 2] / m[:, 6]  # a corner at a coarser scale lies in a larger picture
    turn = m[:, 7] - m[:, 3]
    cos, sin = np.cos(turn) * ratio, np.sin(turn) * ratio
    codes = [np.unique(np.rint(m[:, c] / 4), axis=0, return_inverse=True)[1].ravel() for c in ([0, 1], [4, 5])]
    marks = [(c[:, None] == np.arange(c.max(initial=-1) + 1)).astype(np.float32) for c in codes]
    best = (0, 1.0, 0.0)
    for lo in range(0, len(m), 256):  # so many transforms at once, each against all matches
        k = slice(lo, lo + 256)
        dx, dy = m[None, :, 0] - m[k, None, 0], m[None, :, 1] - m[k, None, 1]
        off = np.hypot(m[k, None, 4] + cos[k, None] * dx - sin[k, None] * dy - m[None, :, 4], m[k, None, 5] + sin[k, None] * dx + cos[k, None] * dy - m[None, :, 5])
        bend = np.abs((turn[None] - turn[k, None] + np.pi) % (2 * np.pi) - np.pi)
        ok = (off <= NEAR * np.maximum(1.0, ratio[k, None])) & (bend < 0.5) & (np.abs(np.log2(ratio[None] / ratio[k, None])) < 0.6)
        # corners of one place count once, on either side
        places = np.minimum(*(((ok.astype(np.float32) @ x) > 0).sum(1) for x in marks))
        top = int(places.argmax())
        if places[top] > best[0]:
            best = (int(places[top]), float(ratio[lo + top]), float(turn[lo + top]))
    return best


def consensus_of_many(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """consensus() of groups of equally many matches (groups, matches, 8): (agreeing, scale, rotation, distinct matches) of each."""
    groups, n = m.shape[:2]
    ratio, turn = m[..., 2] / m[..., 6], m[..., 7] - m[..., 3]
    cos, sin = np.cos(turn) * ratio, np.sin(turn) * ratio
    dx, dy = m[:, None, :, 0] - m[:, :, None, 0], m[:, None, :, 1] - m[:, :, None, 1]
    c, s = cos[..., None], sin[..., None]
    off = np.hypot(m[:, :, None, 4] + c * dx - s * dy - m[:, None, :, 4], m[:, :, None, 5] + s * dx + c * dy - m[:, None, :, 5])
    bend = np.abs((turn[:, None] - turn[..., None] + np.pi) % (2 * np.pi) - np.pi)
    ok = (off <= NEAR * np.maximum(1.0, ratio[..., None])) & (bend < 0.5) & (np.abs(np.log2(ratio[:, None] / ratio[..., None])) < 0.6)
    before, at = np.triu(np.ones((n, n), bool), 1), ok.astype(np.float32)

    def distinct(same: np.ndarray) -> np.ndarray:  # of those that agree with each match, such as none before equals
        return (ok & (at @ (same & before).astype(np.float32) == 0)).sum(2)

    cells = np.rint(m[..., [0, 1, 4, 5]] / 4)
    places = np.minimum(*(distinct((cells[:, :, None, k : k + 2] == cells[:, None, :, k : k + 2]).all(3)) for k in (0, 2)))
    top = places.argmax(1)
    row = np.arange(groups)
    twice = ((m[:, :, None] == m[:, None]).all(3) & before).any(1).sum(1)
    return places[row, top], ratio[row, top], turn[row, top], n - twice


#: Where a corner lies and how, in 1/64 of a dot and in steps of scale and angle.
PLACE = np.dtype([("x", "<u4"), ("y", "<u4"), ("s", "u1"), ("t", "u1")])
#: Entries that a task gathers before it packs them.
HELD = 200_000


def _geometry(c: np.ndarray) -> np.ndarray:
    """(x, y, scale, angle) of corners."""
    return np.stack([c["x"] / 64.0, c["y"] / 64.0, np.array(SCALES)[c["s"]], c["t"] * (2 * np.pi / 256)], 1)


def _columns(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """(bucket, each column's bytes) with a row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(bucket))
    out = {"bucket": pa.array(bucket[heads].astype(np.int32))}
    for name, v in columns.items():
        v = v[order]
        out[name] = pa.array([v[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary())
    return pa.table(out)


def _whole(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


CORNERS = "bucket int, id binary, tab binary, place binary, words binary"
MATCHES = "bucket int, a binary, b binary, pa binary, pb binary"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, place, words) of each picture's corners."""
    for batch in batches:
        h, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w"))
        raw = batch.column("pixels")
        for hh, ww in np.unique(np.stack([h, w], 1), axis=0):
            rows = np.flatnonzero((h == hh) & (w == ww))
            step = max(1, 400_000 // int(hh * ww))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                x = np.stack([np.frombuffer(raw[int(k)].as_buffer(), np.uint8, int(hh * ww)).reshape(hh, ww) for k in some])
                i, s, px, py, t, words = describe(x)
                c = np.zeros(len(i), PLACE)
                c["x"], c["y"], c["s"] = np.rint(px * 64), np.rint(py * 64), [SCALES.index(v) for v in s]
                c["t"] = np.rint(t / (2 * np.pi) * 256).astype(np.int64) % 256
                order = np.argsort(i, kind="stable")
                cut = np.searchsorted(i[order], np.arange(len(some) + 1))
                c, words = c[order], words[order]
                spans = list(zip(cut, cut[1:]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([words[a:b].tobytes() for a, b in spans], pa.binary())], ["id", "place", "words"])


def _tables(buckets: int):
    """CORNERS of described pictures: every corner once for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            place, words = _whole(whole, "place", PLACE), _whole(whole, "words", np.uint32).reshape(-1, 8)
            count = pa.compute.binary_length(whole.column("place")).to_numpy() // PLACE.itemsize
            ids = np.repeat(whole.column("id").to_numpy(), count)
            tab = np.repeat(np.arange(TABLES, dtype=np.uint8), len(ids))
            slot = mix64(words.T[:TABLES].ravel().astype(np.uint64) | tab.astype(np.uint64) << np.uint64(32))
            columns = {"id": np.tile(ids, TABLES), "tab": tab, "place": np.tile(place, TABLES), "words": np.tile(words, (TABLES, 1))}
            yield from _columns((slot % np.uint64(buckets)).astype(np.int64), columns).to_batches()

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                held.append(batch.slice(lo, 1024))
                size += sum(pa.compute.binary_length(held[-1].column("place")).to_numpy()) // PLACE.itemsize * TABLES
                if size >= HELD:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    return run


def _compare(buckets: int):
    """Matches of the corners of a bucket: each pair of corners once, at the first table where it meets."""

    def solve(table: pa.Table) -> pa.Table:
        ids, tab, place = _whole(table, "id", np.int64), _whole(table, "tab", np.uint8), _whole(table, "place", PLACE)
        words = _whole(table, "words", np.uint32).reshape(-1, 8)
        key = words[np.arange(len(ids)), tab].astype(np.int64) | tab.astype(np.int64) << 32
        order = np.argsort(key, kind="stable")
        ids, tab, place, words, key = ids[order], tab[order].astype(np.int64), place[order], words[order], key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(key)))
        left, right = [], []

        quarters = [np.ascontiguousarray(q) for q in np.ascontiguousarray(words).view(np.uint64).reshape(-1, 4).T]

        def check(a: np.ndarray, b: np.ndarray) -> None:
            apart = sum(np.bitwise_count(q[a] ^ q[b]).astype(np.int16) for q in quarters)
            keep(a[apart <= MOST_BITS], b[apart <= MOST_BITS])

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            ok = (ids[a] != ids[b]) & ((words[a, :TABLES] == words[b, :TABLES]).argmax(1) == tab[a])
            a, b = a[ok], b[ok]
            swap = ids[a] > ids[b]
            left.append(np.where(swap, b, a))
            right.append(np.where(swap, a, b))

        for n in np.unique(size[size > 1]):
            at = heads[size == n]
            if n <= 64:
                i, j = np.triu_indices(int(n), 1)
                for lo in range(0, len(at), max(1, 200_000 // len(i))):
                    some = at[lo : lo + max(1, 200_000 // len(i)), None]
                    check((some + i).ravel(), (some + j).ravel())
            else:
                for h in at:
                    for i in range(h, h + int(n) - 1):
                        apart = np.bitwise_count(quarters[0][i] ^ quarters[0][i + 1 : h + n])
                        for q in quarters[1:]:  # they share a word, so the sum stays under 256
                            apart = apart + np.bitwise_count(q[i] ^ q[i + 1 : h + n])
                        near = np.flatnonzero(apart <= MOST_BITS)
                        if len(near):
                            keep(np.full(len(near), i), near + i + 1)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        pair = mix64(ids[a].astype(np.uint64) * np.uint64(0x100000001B3) + mix64(ids[b].astype(np.uint64)))
        return _columns((pair % np.uint64(buckets)).astype(np.int64), {"a": ids[a], "b": ids[b], "pa": place[a], "pb": place[b]})

    return solve


def _agree(least: int):
    """The pairs of a bucket whose matches agree; a match that came twice counts once."""

    def solve(table: pa.Table) -> pa.Table:
        rows = np.rec.fromarrays([_whole(table, "a", np.int64), _whole(table, "b", np.int64), _whole(table, "pa", PLACE), _whole(table, "pb", PLACE)], names="a,b,pa,pb")
        order = np.lexsort((rows.b, rows.a))
        rows = rows[order]
        heads = np.flatnonzero(np.append(True, (rows.a[1:] != rows.a[:-1]) | (rows.b[1:] != rows.b[:-1]))) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(rows)))
        out: list[tuple] = []
        for n in np.unique(size[size >= least]).tolist():
            at = heads[size == n]
            step = max(1, 1_000_000 // (n * n))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                which = some[:, None] + np.arange(n)
                if n <= 256:
                    m = np.concatenate([_geometry(rows.pa[which.ravel()]), _geometry(rows.pb[which.ravel()])], 1).reshape(len(some), n, 8)
                    agreeing, scale, turn, distinct = consensus_of_many(m)
                    for k in np.flatnonzero(agreeing >= least).tolist():
                        out.append((int(rows.a[some[k]]), int(rows.b[some[k]]), int(distinct[k]), int(agreeing[k]), float(scale[k]), float(np.degrees(turn[k]))))
                else:  # one at a time, in pieces
                    m = np.unique(np.concatenate([_geometry(rows.pa[which[0]]), _geometry(rows.pb[which[0]])], 1), axis=0)
                    one, ratio, turned = consensus(m)
                    if one >= least:
                        out.append((int(rows.a[some[0]]), int(rows.b[some[0]]), len(m), one, ratio, float(np.degrees(turned))))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(KINDS.items())})

    return solve


def _all_corners(least: int):
    """The pairs of pictures (a, b, their corners) of which `least` matches agree when all corners are compared with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, pa_, wa, pb, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "pa", "wa", "pb", "wb"))):
                place = [np.frombuffer(b"".join(x), PLACE) for x in (pa_, pb)]
                words = [np.frombuffer(b"".join(x), np.uint64).reshape(-1, 4) for x in (wa, wb)]
                pairs = []
                for lo in range(0, len(words[0]), 1024):
                    apart = sum(np.bitwise_count(words[0][lo : lo + 1024, k, None] ^ words[1][None, :, k]).astype(np.int16) for k in range(4))
                    i, j = np.nonzero(apart <= MOST_BITS)
                    pairs.append((i + lo, j))
                i, j = (np.concatenate(x) for x in zip(*pairs))
                m = np.unique(np.concatenate([_geometry(place[0][i]), _geometry(place[1][j])], 1), axis=0)
                agreeing, scale, turn = consensus(m)
                if agreeing >= least:
                    out.append((a, b, len(m), agreeing, scale, float(np.degrees(turn))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS.values())], list(KINDS))

    return run


KINDS = {"a": pa.int64(), "b": pa.int64(), "matches": pa.int32(), "agreeing": pa.int32(), "scale": pa.float64(), "degrees": pa.float64()}
PAIRS = "a bigint, b bigint, matches int, agreeing int, scale double, degrees double"


def copies(media: DataFrame, least: int = LEAST, id_col: str = "media_id", height_col: str = "height", width_col: str = "width", pixels_col: str = "pixels") -> DataFrame:
    """(a, b, matches, agreeing, scale, degrees) of the pairs of pictures with `least` agreeing matches."""
    m = media.select(F.col(id_col).cast("bigint").alias("id"), F.col(height_col).alias("h"), F.col(width_col).alias("w"), F.col(pixels_col).alias("pixels"))
    m = m.where("id is not null and h >= 8 and w >= 8 and pixels is not null and length(pixels) >= cast(h as bigint) * w")
    described = durable(m.mapInArrow(_described, "id bigint, place binary, words binary"))
    corners = described.agg(F.sum(F.length("place"))).first()[0] or 0
    entries = corners // PLACE.itemsize * TABLES * (PLACE.itemsize + 41)
    buckets = max(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_BYTES))
    matches = described.mapInArrow(_tables(buckets), CORNERS).groupBy("bucket").applyInArrow(_compare(buckets), MATCHES)
    found = durable(matches.groupBy("bucket").applyInArrow(_agree(min(SEED, least)), PAIRS))
    more = found.where(F.col("agreeing") < least).select("a", "b")
    wanted = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct()
    whole = described.join(wanted, "id", "left_semi").groupBy("id").agg(F.collect_list("place").alias("p"), F.collect_list("words").alias("w"))
    sides = [whole.select(F.col("id").alias(x), F.col("p").alias(f"p{x}"), F.col("w").alias(f"w{x}")) for x in "ab"]
    again = more.join(sides[0], "a").join(sides[1], "b").select("a", "b", "pa", "wa", "pb", "wb").mapInArrow(_all_corners(least), PAIRS)
    return found.where(F.col("agreeing") >= least).unionByName(again)


def groups(media: DataFrame, least: int = LEAST, id_col: str = "media_id", **columns: str) -> DataFrame:
    """(id, group_id, links) of every id: the least id that the pairs of copies() lead to, and in how many of them the id is.

    An id in no pair, such as that of a picture that can't be read, is a group of its own; a null id has no row.
    """
    close = durable(copies(media, least, id_col, **columns).select("a", "b"))
    links = close.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    every = media.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    found = every.join(components(close), "id", "left").join(links, "id", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def pictures(vectors: DataFrame, factor: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, height, width, pixels): each vector drawn as a smooth grey square, of `factor` dots a number; its mean
    fills up a square that it doesn't. Vectors that are null, empty or hold a null, NaN or infinity have null pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            sizes = [0] * batch.num_rows
            fine: dict[int, list[int]] = {}
            values = batch.column(1).to_pylist()
            for k, v in enumerate(values):
                if v and None not in v and np.isfinite(v).all():
                    fine.setdefault(len(v), []).append(k)
            for dim, rows in fine.items():
                side = int(np.ceil(np.sqrt(dim)))
                for lo in range(0, len(rows), 512):
                    some = rows[lo : lo + 512]
                    x = np.array([values[k] for k in some], np.float32)
                    x = np.concatenate([x, np.repeat(x.mean(1, keepdims=True), side * side - dim, 1)], 1).reshape(-1, side, side)
                    spread = np.maximum(x.std((1, 2), keepdims=True), 1e-9)
                    grey = np.clip(128 + 48 * (x - x.mean((1, 2), keepdims=True)) / spread, 0, 255)
                    big = np.clip(np.rint(resize(grey, side * factor, side * factor)), 0, 255).astype(np.uint8)
                    for k, p in zip(some, big):
                        out[k], sizes[k] = p.tobytes(), side * factor
            size = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, size, pa.array(out, pa.binary())], ["media_id", "height", "width", "pixels"])

    source = vectors.select(id_col, vector_col)
    return source.mapInArrow(run, f"media_id {source.schema[0].dataType.simpleString()}, height int, width int, pixels binary")
