"""Operator 9: near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its shingles (`size` successive words, lower-cased, without punctuation), a shingle's
weight the number of times it occurs. Each weighted shingle is a Poisson process whose rate is its weight: successive
arrivals come after exponential gaps drawn from the shingle's own hash stream, each at a random one of `m` registers,
and a register keeps the shingle that arrives first. Two documents agree at a register with the probability Jaccard
similarity J_P of their weighted shingles. A process ends as soon as its time passes the latest register of its
document, as nothing later can change the signature.

1. Documents with the same shingle multiset are found by a 128-bit digest and form a group at once; the least id goes on.
2. Registers are hashed in `bands` bands of `rows`. Of those who share a band hash, in the order of their ids, each is
   compared by its registers with the leaders so far: it is paired with the likeliest one whose estimate reaches the
   threshold; if there is none, it is paired with all leaders within `SLACK` of it and leads too. This first pass only
   joins most of a group cheaply.
3. Every such pair is verified by the exact J_P of the two texts, at least `threshold`. The texts of documents in a bucket
   of two or more are written once, and every round of verification reads those.
4. In buckets that still hold members of different groups, followers and members of refuted pairs included, each member
   outside the bucket's largest group is paired with its likeliest partners of other groups within `SLACK` of the
   threshold, and the pairs not yet verified are. Rounds follow, each with `GROWTH` times as many partners and the groups
   joined so far, until none has left a pair out: then every two members of a bucket within `SLACK` are verified or are
   in one group. There is no cap on buckets, leaders or partners. Documents that are many, alike below the threshold and
   in no common group cost a verification each pair.
5. Groups are the connected components of the verified pairs.

Cases: a text that is null, empty or without words has no shingles and is in no group; a text shorter than `size` is
one shingle of all its words; rows with a null id are in no group; rows that repeat an id count once (the first text in
order stands for it); ties go to the least id. Texts are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidera.llm.common import GOLD, WORD, components, durable, hashed, mix64, numbered, steps

SIZE, M, BANDS, ROWS, THRESHOLD = 2, 96, 24, 4, 0.6
#: Three standard errors of an estimate from M registers.
SLACK = 0.15
#: Partners of a member in the first round after the leaders', and their growth from round to round.
PARTNERS, GROWTH = 8, 8


def shingles(texts: list[str | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of every distinct shingle of every document, ordered by document and hash."""
    flat, offsets = hashed([WORD.findall(t.lower()) if t else [] for t in texts])
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat))
    place = at - offsets[doc]
    width = np.minimum(size, n)[doc]
    ok = place + width <= n[doc]
    at, doc, width = at[ok], doc[ok], width[ok]
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = width > k
        h[more] = mix64(h[more] * np.uint64(0x100000001B3) + flat[at[more] + k] + np.uint64(k + 1))
    key = h ^ mix64(doc.astype(np.uint64) + GOLD)  # one word to sort by; the document is found again by position
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(heads, len(key)))
    doc, h = doc[order[heads]], h[order[heads]]
    order = np.lexsort((h, doc))
    return doc[order], h[order], weight[order]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """docs x m registers: the shingle that arrives first at each; documents without shingles have zeros."""
    first = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, np.uint64)
    seen = np.zeros(docs, bool)
    seen[doc] = True
    rate, time, state = weight.astype(float), np.zeros(len(h)), mix64(h + GOLD)
    base = doc * m
    while len(h):
        state = state + GOLD
        draw = mix64(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        to = base + ((mix64(draw ^ GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        better = time < first[to]
        slot, when, what = to[better], time[better], h[better]
        np.minimum.at(first, slot, when)
        win = when == first[slot]
        who[slot[win]] = what[win]
        latest = first.reshape(docs, m).max(1)
        on = time < latest[base // m]
        h, rate, time, state, base = h[on], rate[on], time[on], state[on], base[on]
    who[~np.repeat(seen, m)] = 0
    return who.reshape(docs, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets of (sorted hashes, weights): sum over common d of 1 / sum over e of max(a_e/a_d, b_e/b_d)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    return float((1.0 / ((only_a + below[last]) / x + (only_b + above[last]) / y)).sum())


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, m: int = M, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, digest binary, bands array<long>, low binary) of each row that has an id and at least one word; low: a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * GOLD)
        for batch in steps(batches, "__text"):
            doc, h, weight = shingles(batch.column(1).to_pylist(), size)
            who = signatures(doc, h, weight, batch.num_rows, m)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            has = np.flatnonzero(np.diff(cut))
            both = np.stack([h, weight.astype(np.uint64)], 1)
            digest = [xxhash.xxh3_128_digest(both[cut[k] : cut[k + 1]].tobytes()) for k in has]
            low = [who[k].astype(np.uint8).tobytes() for k in has]
            key = np.tile(salt, (len(has), 1))
            for r in range(rows):
                key = mix64(key ^ who[has, r : bands * rows : rows])
            lists = pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * bands, key.astype(np.uint64).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.array(digest, pa.binary()), lists, pa.array(low, pa.binary())], ["id", "digest", "bands", "low"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, digest binary, bands array<long>, low binary")


def verify(texts: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """(a, b, jp) of distinct pairs, the exact J_P of their texts (id, __text). Texts travel to their id and those of pairs once more to the pair's b."""
    kind = texts.schema["id"].dataType.simpleString()
    wanted = edges.select(F.col("a").alias("id"), F.col("b").alias("hub")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("hub"))).distinct()
    sent = texts.join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by hub, the hub's own text first, so one text is held at a time
        hub, own = None, None
        for batch in steps(batches, "__text"):
            ids, hubs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            doc, h, weight = shingles(batch.column(2).to_pylist(), size)
            cut = np.searchsorted(doc, np.arange(len(ids) + 1))
            out = []
            for k, (i, to) in enumerate(zip(ids, hubs)):
                mine = h[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]]
                if i == to:
                    if hub != to:
                        hub, own = to, mine
                elif hub == to:
                    out.append((i, to, probability_jaccard(mine, own)))
            a, b, j = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema[0].type), pa.array(b, batch.schema[1].type), pa.array(j, pa.float64())], ["a", "b", "jp"])

    laid = sent.select("id", "hub", "__text").repartition("hub").sortWithinPartitions("hub", F.col("id") != F.col("hub"), "id")
    return laid.mapInArrow(run, f"a {kind}, b {kind}, jp double").dropDuplicates(["a", "b"])


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """J_P by the share of equal registers, less the chance that other registers agree in the byte kept."""
    return np.maximum(0.0, ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256))


def _bucket(ids: list, low: np.ndarray, threshold: float) -> list[tuple]:
    """The pairs of one bucket's members, who come in the order of their ids."""
    out, leaders, table = [], [0], low[:1].copy()
    room = 1
    for k in range(1, len(ids)):
        likely = _estimates(table[:room], low[k])
        best = int(likely.argmax())
        if likely[best] >= threshold:
            out.append((ids[k], ids[leaders[best]]))
            continue
        out += [(ids[k], ids[leaders[j]]) for j in np.flatnonzero(likely >= threshold - SLACK)]
        if room == len(table):
            table = np.concatenate([table, np.zeros_like(table)])
        table[room] = low[k]
        leaders.append(k)
        room += 1
    return out


def _partners(ids: list, root: np.ndarray, low: np.ndarray, threshold: float, most: int) -> tuple[list[tuple], bool]:
    """Pairs of one bucket's members of different groups: of each member outside the largest group the `most` likeliest
    within SLACK; and whether any had more. Members come in the order of their ids; root tells their groups."""
    values, place, counts = np.unique(root, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(place != counts.argmax())
    out, cut = [], False
    step = max(1, 200_000 // len(ids))
    for at in range(0, len(outside), step):
        mine = outside[at : at + step]
        likely = (np.count_nonzero(low[mine, None] == low[None], axis=-1) / low.shape[1] - 1 / 256) / (1 - 1 / 256)
        likely[root[mine, None] == root[None]] = -1
        for k, row in zip(mine.tolist(), likely):
            to = np.flatnonzero(row >= threshold - SLACK)
            if len(to) > most:
                cut = True
                to = to[np.argsort(-row[to], kind="stable")[:most]]
            out += [(ids[max(k, x)], ids[min(k, x)]) for x in to.tolist()]
    return out, cut


def _by_slot(solve):
    """solve of rows that come ordered by slot and id, whole slots at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            slot = part.column("slot")
            last = slot[-1].as_py()
            cut = int(np.searchsorted(slot.to_numpy(), last))
            rest = part.slice(cut)
            if cut:
                yield solve(part.slice(0, cut))
        if rest is not None:
            yield solve(rest)

    return run


def _read(part: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, registers, first row of each slot, its rows)."""
    slot = part.column("slot").to_numpy()
    ids = part.column("id").to_pylist()
    low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
    heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    return ids, low, heads, np.diff(np.append(heads, len(slot)))


def _lead(threshold: float):
    """(a, b) of rows (slot, id, low)."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        ids, low, heads, size = _read(part)
        two = heads[size == 2]
        near = two[_estimates(low[two], low[two + 1]) >= threshold - SLACK]
        pairs = [(ids[k + 1], ids[k]) for k in near.tolist()]
        for h, n in zip(heads[size > 2].tolist(), size[size > 2].tolist()):
            pairs += _bucket(ids[h : h + n], low[h : h + n], threshold)
        pairs = sorted(set(pairs))
        kind = part.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([y for _, y in pairs], kind)], ["a", "b"])

    return _by_slot(solve)


def _carry(threshold: float, most: int):
    """(a, b, cut) of rows (slot, id, root, low); a row without a and b says that pairs were left out."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        ids, low, heads, size = _read(part)
        root = part.column("root").combine_chunks().dictionary_encode()
        root = (root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).indices.to_numpy()
        pairs, left_out = set(), False
        for h, n in zip(heads.tolist(), size.tolist()):
            found, cut = _partners(ids[h : h + n], root[h : h + n], low[h : h + n], threshold, most)
            pairs.update(found)
            left_out |= cut
        rows = [(a, b, False) for a, b in sorted(pairs)] + [(None, None, True)] * left_out
        kind = part.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.bool_())], ["a", "b", "cut"])

    return _by_slot(solve)


def buckets(signed: DataFrame) -> DataFrame:
    """(id, slot, n) of the buckets with two members or more, of rows of sign() with distinct ids."""
    flat = signed.select("id", F.explode("bands").alias("slot")).distinct()
    return flat.withColumn("n", F.count("*").over(Window.partitionBy("slot"))).where("n > 1")


def candidates(signed: DataFrame, slots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of the first pairs to verify; slots of buckets()."""
    kind = signed.schema["id"].dataType.simpleString()
    laid = slots.join(signed.select("id", "low"), "id").select("slot", "id", "low").repartition("slot").sortWithinPartitions("slot", "id")
    return laid.mapInArrow(_lead(threshold), f"a {kind}, b {kind}").distinct()


def remaining(signed: DataFrame, slots: DataFrame, roots: DataFrame, threshold: float, most: int) -> DataFrame:
    """(a, b, cut) of pairs in one bucket whose groups differ, as _carry() gives them; candidates() has all of buckets of two."""
    kind = signed.schema["id"].dataType.simpleString()
    at = slots.where("n > 2").join(roots, "id", "left").select("slot", "id", F.coalesce("root", "id").alias("root"))
    mixed = at.groupBy("slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("slot")
    rows = at.join(mixed, "slot").join(signed.select("id", "low"), "id")
    laid = rows.select("slot", "id", "root", "low").repartition("slot").sortWithinPartitions("slot", "id")
    return laid.mapInArrow(_carry(threshold, most), f"a {kind}, b {kind}, cut boolean").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SIZE, m: int = M, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, group_id, group_size) of every document in a group of two or more; group_id is the least id of the group."""
    assert bands * rows <= m
    first = sign(docs, id_col, text_col, size, m, bands, rows).groupBy("id").agg(F.min(F.struct("digest", "bands", "low")).alias("s"))
    signed = durable(first.select("id", "s.*"))
    same = signed.groupBy("digest").agg(F.min("id").alias("b"), F.count("*").alias("n"))
    exact = signed.select(F.col("id").alias("a"), "digest").join(same.where("n > 1"), "digest").where("a <> b").select("a", "b")
    alone = signed.join(same.select(F.col("b").alias("id")), "id", "left_semi")
    slots = durable(buckets(alone))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).where("id is not null")
    texts = durable(texts.join(slots.select("id").distinct(), "id", "left_semi"))
    tested = durable(candidates(alone, slots, threshold))

    def true(pairs: DataFrame) -> DataFrame:
        return durable(verify(texts, pairs, size).where(F.col("jp") >= threshold).select("a", "b"))

    roots, most = durable(components(exact.unionByName(true(tested)))), PARTNERS
    while True:
        asked = durable(remaining(alone, slots, roots, threshold, most))
        fresh = durable(asked.where("not cut").select("a", "b").join(tested, ["a", "b"], "left_anti"))
        found = true(fresh)
        if not found.isEmpty():
            roots = durable(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found)))
        if asked.where("cut").isEmpty():
            break
        tested, most = tested.unionByName(fresh), most * GROWTH
    sizes = roots.groupBy("root").agg(F.count("*").alias("group_size"))
    return roots.join(sizes, "root").select(F.col("id").alias(id_col), F.col("root").alias("group_id"), "group_size")


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, that of the least id (a null id last), and all rows in no group, with the columns that came in.

    Rows are told apart by a 64-bit hash of id and text, so unlike texts under one id are documents of their own and rows
    with a null id have their copies found like others. Rows equal in id and text are one document; rows with a null text stay.
    """
    plain = numbered(docs)
    name = dict(zip(docs.columns, plain.columns))
    ident, text = name[id_col], name[text_col]
    keyed = plain.where(F.col(text).isNotNull()).withColumn("__k", F.xxhash64(ident, text))
    found = groups(keyed, "__k", text, **options).select("__k", "group_id")
    named = keyed.select("__k", F.col(ident).alias("__id")).join(found, "__k")
    first = named.groupBy(F.col("group_id").alias("__g")).agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__k").alias("k")))["k"].alias("__first"))
    gone = found.join(first, (F.col("group_id") == F.col("__g")) & (F.col("__k") != F.col("__first"))).select("__k")
    rest = keyed.join(gone, "__k", "left_anti").dropDuplicates(["__k"]).drop("__k")
    return rest.unionByName(plain.where(F.col(text).isNull())).select(*(F.col(p).alias(c) for c, p in name.items()))
