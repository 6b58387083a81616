"""Operator 1: SentencePiece encoding and decoding.

Unigram Viterbi over a double-array trie of pieces with log scores, with byte fallback and whitespace-marker
decoding. The pieces are those of a public model file; nothing is trained. A file of the BPE kind carries merge
ranks in place of log scores, and a rank r is read as the Zipf log probability -log(r + 1) less its normaliser.

A text's white space becomes the marker U+2581, with one marker put before the text. As no piece has a marker
after another character, the best path of a text is that of its segments (markers, then other characters), so
each distinct segment is solved once and kept, and all new segments of a step are solved together in NumPy.

A long segment, such as a text without spaces, is cut in lanes that are solved side by side, each from WARM bytes before
its own part on. What a lane decides depends on the scores of the last `reach` nodes before it only by their
differences, as no piece is longer. So a lane that has the differences of the lane before it there decides as if all had
been solved in one go; one that hasn't is solved again from the scores of the lane before. Hence the result is exact.

Cases: a null text gives null ids and a null decoded text; the empty text gives no ids and decodes to ''; a
character that no piece holds, and the marker character itself where the text has it, go by their UTF-8 bytes,
so decode(encode(text)) is the text always. Equal scores go to the piece that begins earlier. Rows are kept as
they are, repeated or not, of any length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.llm.common import steps

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, BYTE, USER = 1, 6, 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(model: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as file:
        proto.ParseFromString(file.read())
    rows = [(p.piece, p.score, p.type) for p in proto.pieces]
    if proto.trainer_spec.model_type != 2:  # scores are log probabilities already
        return rows
    ranks = [-s for _, s, t in rows if t == NORMAL and s > -1e8]
    last = max(ranks, default=0) + 1
    norm = math.log(sum(1 / (r + 1) for r in ranks) or 1)
    return [(p, -math.log((min(-s, last) if s > -1e8 else last) + 1) - norm if t == NORMAL else 0.0, t) for p, s, t in rows]


class DoubleArray:
    """A double-array trie over bytes: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        size = len(tree) * 2 + 1024
        self.base, self.check, self.value = (np.full(size, v, np.int32) for v in (0, -1, -1))
        used = bytearray(size)
        used[0] = 1
        place, queue, low = {0: 0}, [0], 258
        tried: dict[int, int] = {}  # a node with as many children begins its search where the last such found room
        for node in queue:
            s = place[node]
            if node in ends:
                self.value[s] = ends[node]
            kids = sorted(tree[node])
            if not kids:
                continue
            while used[low]:
                low += 1
            at = max(1, low - kids[0] - 1, tried.get(min(len(kids), 16), 1) if len(kids) > 1 else 1)
            while True:
                if at + 258 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    self.base, self.check, self.value = (np.concatenate([x, np.full(grow, v, np.int32)]) for x, v in ((self.base, 0), (self.check, -1), (self.value, -1)))
                if not any(used[at + c + 1] for c in kids):
                    break
                at += 1
            self.base[s] = tried[min(len(kids), 16)] = at
            for c in kids:
                t = at + c + 1
                used[t], self.check[t], place[tree[node][c]] = 1, s, t
                queue.append(tree[node][c])
        end = len(used) - used[::-1].index(1) + 258
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()


class Codec:
    """Encodes and decodes with the pieces of one model file."""

    #: Distinct segments that are kept at once.
    KEEP = 200_000
    #: Characters of segments that are kept at once.
    KEEP_CHARS = 30_000_000
    #: Characters of segments that are solved at once.
    PIECE = 50_000
    #: Bytes from which a segment is cut in lanes of LANE bytes, each begun WARM bytes early.
    LONG, LANE, WARM = 8192, 1024, 256

    def __init__(self, model: str):
        self.pieces = read_pieces(model)
        self.trie = DoubleArray({p.encode(): i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)})
        self.score = np.round(np.array([s for _, s, _ in self.pieces]) * 2**20) / 2**20  # sums are exact, so ties are ties
        self.byte_id = np.full(256, -1, np.int32)
        for i, (p, _, t) in enumerate(self.pieces):
            if t == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.reach = max([4, *(len(p.encode()) for p, _, t in self.pieces if t in (NORMAL, USER))])
        self.unknown = min(self.score[i] for i, (_, _, t) in enumerate(self.pieces) if t == NORMAL) - 10.0
        self._forget()
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER) else b"" for p, _, t in self.pieces]

    def _forget(self) -> None:
        # the marker character where a text has it itself, under a key that is no segment
        mark = self.byte_id[list(MARK.encode())]
        self.at: dict[str | None, int] = {None: 0}
        self.starts = np.array([0, len(mark)], np.int64)
        self.ids = mark.astype(np.int32)
        self.kept = 0

    def _forward(self, raw: list[bytes], seeds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Scores and best last edges of all nodes of texts, which begin where `nodes` says, and the edges (from, to, id) by byte of all texts.

        seeds: scores of the first nodes of the one text, in place of 0 at its first.
        """
        n = np.array([len(r) for r in raw], np.int64)
        begin = np.cumsum(n) - n
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        total = len(text) - 1
        seg = np.repeat(np.arange(len(raw)), n)
        end = (begin + n)[seg]
        first = (text[:total] & 0xC0) != 0x80
        # every piece that begins at every character, by walking all of them down the trie together
        at = np.flatnonzero(first)
        state = np.zeros(len(at), np.int32)
        pos, stop = at.copy(), end[at]
        froms, tos, ids = [], [], []
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        single = np.zeros(total + 1, bool)  # a piece holds just the character that begins here
        ends = np.append(np.flatnonzero(first), total)
        after = np.zeros(total + 1, np.int64)
        after[ends[:-1]] = ends[1:]
        while len(at):
            to = base[state] + text[pos].astype(np.int32) + 1
            ok = (check[to] == state) & (base[state] > 0)
            at, state, pos, stop = at[ok], to[ok], pos[ok] + 1, stop[ok]
            hit = value[state] >= 0
            froms.append(at[hit])
            tos.append(pos[hit])
            ids.append(value[state[hit]])
            single[at[hit][after[at[hit]] == pos[hit]]] = True
            more = pos < stop
            at, state, pos, stop = at[more], state[more], pos[more], stop[more]
        lone = np.flatnonzero(first & ~single[:total])
        froms.append(lone)
        tos.append(after[lone])
        ids.append(np.full(len(lone), -1, np.int32))
        a, b, i = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        gain = np.where(i >= 0, self.score[i], self.unknown)
        # the step at which an edge is used: the offset of its end in its text; then later begins first
        rel = b - begin[seg[a]]
        if seeds is not None:
            some = rel >= len(seeds)
            a, b, i, gain, rel = a[some], b[some], i[some], gain[some], rel[some]
        # every depth of the walk has its ends in order, and a deeper one begins earlier: two stable sorts of few runs
        order = np.argsort(b, kind="stable")
        order = order[np.argsort(rel[order].astype(np.uint16) if rel.max(initial=0) < 65536 else rel[order], kind="stable")]
        a, b, i, gain, rel = a[order], b[order], i[order], gain[order], rel[order]
        best = np.full(total + len(raw) + 1, -np.inf)
        node_a, node_b = a + seg[a], b + seg[a]  # a text has one node more than bytes
        nodes = begin + np.arange(len(raw))
        best[nodes] = 0.0
        if seeds is not None:
            best[: len(seeds)] = seeds
        via = np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.diff(rel, prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            reach = best[node_a[lo:hi]] + gain[lo:hi]
            target = node_b[lo:hi]
            heads = np.flatnonzero(np.diff(target, prepend=-1))
            top = np.maximum.reduceat(reach, heads)
            best[target[heads]] = top
            # of equal scores the piece that begins earlier, which is the last of its group, is written last
            win = np.flatnonzero(reach == np.repeat(top, np.diff(np.append(heads, hi - lo))))
            via[target[win]] = lo + win
        return best, via, nodes, a, b, i, node_a, text

    def solve(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best path of each segment, one after another, and the number of ids of each."""
        raw = [s.encode() for s in segments]
        n = np.array([len(r) for r in raw], np.int64)
        _, via, nodes, a, b, i, node_a, text = self._forward(raw)
        # back along the best paths, all segments a step at a time
        node = nodes + n
        owner = np.arange(len(raw))
        outs, owners = [], []
        alive = n > 0
        node, owner = node[alive], owner[alive]
        while len(node):
            edge = via[node]
            outs.append(edge)
            owners.append(owner)
            node = node_a[edge]
            on = node > nodes[owner]
            node, owner = node[on], owner[on]
        edges = np.concatenate(outs)[::-1] if outs else np.zeros(0, np.int64)
        owners = np.concatenate(owners)[::-1] if owners else edges
        order = np.argsort(owners, kind="stable")
        edges, owners = edges[order], owners[order]
        ids, width = self._spell(i[edges], a[edges], b[edges], text)
        return ids, np.bincount(owners, weights=width, minlength=len(raw)).astype(np.int64)

    def _spell(self, i: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each edge): its piece, or the bytes of a character that none holds."""
        width = np.where(i >= 0, 1, b - a)
        which = np.repeat(np.arange(len(i)), width)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
        return np.where(i[which] >= 0, i[which], self.byte_id[text[a[which] + inner]]).astype(np.int32), width

    def solve_long(self, segment: str) -> np.ndarray:
        """The ids of one segment of any length, lane by lane."""
        raw = segment.encode()
        size = len(raw)
        text = np.frombuffer(raw, np.uint8)

        def border(at: int) -> int:  # the character's begin at or before a byte
            while 0 < at < size and raw[at] & 0xC0 == 0x80:
                at -= 1
            return max(0, at)

        starts = [border(k) for k in range(0, size, self.LANE)]
        stops = [*starts[1:], size]
        back, piece = np.zeros(size + 1, np.int32), np.full(size + 1, -1, np.int32)  # by node: bytes and id of the last edge
        before, known = np.zeros(1), {}  # scores of the nodes up to the lane's begin, of the lane before it

        def take(s: int, e: int, lo: int, best: np.ndarray, via: np.ndarray, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> None:
            edge = via[s + 1 - lo : e + 1 - lo]
            ok = edge >= 0
            back[s + 1 : e + 1] = np.where(ok, b[edge] - a[edge], 0)
            piece[s + 1 : e + 1] = np.where(ok, i[edge], -1)

        step = max(1, self.PIECE // (self.LANE + self.WARM))
        for group in range(0, len(starts), step):
            lanes = range(group, min(group + step, len(starts)))
            begins = [border(starts[k] - max(self.WARM, self.reach)) for k in lanes]
            best, via, nodes, a, b, i, _, _ = self._forward([raw[lo : stops[k]] for k, lo in zip(lanes, begins)])
            byte = nodes - np.arange(len(nodes))  # where a lane's bytes begin among those of all
            for k, lo, at, off in zip(lanes, begins, nodes.tolist(), byte.tolist()):
                s, e = starts[k], stops[k]
                own, edge = best[at : at + e - lo + 1], via[at : at + e - lo + 1]
                seen = len(before)
                if k:
                    mine = own[s - lo + 1 - seen : s - lo + 1]
                    fine = np.isfinite(before)
                    apart = before[fine] - mine[fine] if (np.isfinite(mine) == fine).all() else np.array([0.0, 1.0])
                    if (apart != apart[0]).any():
                        lo = s + 1 - seen
                        seeds = before - before[fine].max()
                        key = raw[lo:e], seeds.tobytes()
                        if key not in known:
                            if len(known) > 256:
                                known.clear()
                            known[key] = self._forward([key[0]], seeds)
                        own, edge, _, ka, kb, ki, _, _ = known[key]
                        take(s, e, lo, own, edge, ka, kb, ki)
                        before = own[e - lo + 1 - min(e - lo + 1, self.reach + 1) : e - lo + 1].copy()
                        continue
                take(s, e, lo, own, edge, a, b, i)
                before = own[e - lo + 1 - min(e - lo + 1, self.reach + 1) : e - lo + 1].copy()
        ends, at, steps_back = [], size, back.tolist()
        while at:
            ends.append(at)
            at -= steps_back[at]
        b = np.array(ends[::-1], np.int64)
        return self._spell(piece[b], b - back[b], b, text)[0]

    def _learn(self, segments: list[str]) -> None:
        long = [s for s in segments if len(s) * 4 > self.LONG and len(s.encode()) > self.LONG]
        short = sorted(set(segments) - set(long)) if long else segments
        # a bounded number of bytes is solved at once: the lattice takes some hundred times as much
        sizes = np.cumsum([len(s) for s in short]) // self.PIECE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(short)]
        solved = [self.solve(short[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        for s in long:
            ids = self.solve_long(s)
            solved.append((ids, np.array([len(ids)], np.int64)))
        ids, counts = (np.concatenate(x) for x in zip(*solved))
        known = len(self.at)
        self.at.update(zip([*short, *long], range(known, known + len(segments))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        self.kept += sum(map(len, segments))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offset at which each text's begin (one more than texts)."""
        if len(self.at) > self.KEEP or self.kept > self.KEEP_CHARS:
            self._forget()
        parts: list[list[str | None]] = []
        for text in texts:
            if not text:
                parts.append([])
            elif MARK in text:  # its own markers go by bytes
                own: list[str | None] = []
                for k, part in enumerate(text.split(MARK)):
                    own += [None] * (k > 0) + SEGMENT.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
                parts.append(own)
            else:
                parts.append(SEGMENT.findall(MARK + text.replace(" ", MARK)))
        new = {s for p in parts for s in p if s not in self.at}
        if new:
            self._learn(sorted(new))
        code = np.fromiter((self.at[s] for p in parts for s in p), np.int64)
        count = self.starts[code + 1] - self.starts[code]
        where = np.arange(count.sum()) + np.repeat(self.starts[code] - (np.cumsum(count) - count), count)
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids[where], ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: markers become spaces, byte pieces UTF-8, and the marker put before the text goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, ids array<int>, n_ids, exact): each row's ids, and whether they decode to its text again (null for a null text)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        raw = c.raw
        for batch in steps(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            ids, offsets = c.encode(texts)
            missing = np.array([t is None for t in texts])
            exact = []
            lengths = [0 if t is None else len(t.encode()) for t in texts]
            flat = ids.tolist()
            cut = offsets.tolist()
            for k, t in enumerate(texts):
                exact.append(None if t is None else b"".join(map(raw.__getitem__, flat[cut[k] : cut[k + 1]]))[1 if lengths[k] else 0 :] == t.encode())
            lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[:-1], offsets[-1]).astype(np.int32), mask=np.append(missing, False)), pa.array(ids))
            count = pa.array(np.diff(offsets).astype(np.int32), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, count, pa.array(exact, pa.bool_())], [*batch.schema.names[:-1], "ids", "n_ids", "exact"])

    source = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, ids array<int>, n_ids int, exact boolean")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null ids give null."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")
