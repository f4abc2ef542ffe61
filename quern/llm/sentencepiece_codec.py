"""SentencePiece encoding and decoding of whole texts: a batched numpy lattice whose step is 1 where two pieces may stand side by side and 0 where not.

A text (after the model's leading blank) falls into segments that no piece crosses: a run of blanks with what follows up
to the next blank, and each line break. Distinct segments are encoded once; those of equal length advance together, a
character a step. For every end position a hash of each substring up to it probes the sorted hashes of the pieces; the
widest piece that may stand there is the position's maximum, and its start the backpointer.

The pieces belong to a merge (BPE) model, so this is no maximum over sums of scores: the unigram path with the greatest sum
would differ from the model's own encoding. A merge model's encoding of a prefix ends in exactly one piece, and a piece may
follow another if undoing both pieces' merges, latest first, never shows a pair across the border that would have merged
earlier; the path of the steps of 1 is the encoding that merging gives. Two kinds of segments are merged one at a time from
a heap instead, to the same ids: those that begin with several blanks (the first word of an indented line), whose pieces'
merge order is no order of depth, and those of over LONGEST_BATCHED characters (prose without blanks).

Characters that are no piece become their bytes' pieces. Decoding joins the pieces, reads byte pieces as UTF-8 and drops
the leading blank.

Defined results: a null text has null ids, an empty one has none. U+2581 is read as a blank, as the model has it. Repeated
rows each get their row; columns of the input with the names of the result's columns are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memo import Memo
from .shared import map_texts
from .text import hash_spans, proofs, utf8

BLANK = "▁"
LONGEST_BATCHED = 256
CACHED_SEGMENTS = 600_000
PAIRS_BITS = 20
_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
UNKNOWN = -2


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _P + ord(c) + 1) & _M
    return h


class Model:
    """A model's pieces as arrays; made once on the driver."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [-1] * 256
        self.score_of: dict[str, tuple[float, int]] = {}
        self.decoded: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.decoded.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.decoded.append(b"")
            else:
                self.score_of[name] = (scores[i], i)
                self.decoded.append(name.replace(BLANK, " ").encode())
        # merge order: single characters, then pieces by falling score; pieces with several blanks are left to the heap
        plain = [p for p in self.score_of if not p.startswith(BLANK * 2)]
        order = sorted(plain, key=lambda p: (len(p) > 1, -self.score_of[p][0], self.score_of[p][1]))
        self.singles = sum(len(p) == 1 for p in order)
        rank = {p: r for r, p in enumerate(order)}
        left, right = list(range(len(order))), list(range(len(order)))
        usable = [True] * len(order)
        hashes = [_hash(p) for p in order]
        for r in range(self.singles, len(order)):
            p = order[r]
            for k in range(1, len(p)):
                a, b = rank.get(p[:k], -1), rank.get(p[k:], -1)
                if 0 <= a < r and 0 <= b < r and usable[a] and usable[b] and _may_meet(order, rank, usable, left, right, self.singles, a, b, r):
                    left[r], right[r] = a, b
                    break
            else:
                usable[r] = False
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.ids = np.array([self.score_of[p][1] for p in order], np.int32)
        self.hashes, self.lengths = np.array(hashes, np.uint64), np.array([len(p) for p in order])
        self.longest = int(self.lengths.max())
        ok = np.flatnonzero(usable)
        ok = ok[np.argsort(self.hashes[ok])]
        self.sorted_hashes, self.sorted_ranks = self.hashes[ok], ok.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.sorted_hashes >> np.uint64(44)] = True
        self.powers = np.array([pow(_P, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.names = set(self.score_of)

    @cached_property
    def output(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces in a row, and each piece's offset and length."""
        sizes = np.array([len(d) for d in self.decoded])
        return np.frombuffer(b"".join(self.decoded), np.uint8), np.append(0, np.cumsum(sizes))[:-1], sizes

    def find(self, h: np.ndarray) -> np.ndarray:
        """Merge order of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.sorted_hashes, h[some]), len(self.sorted_hashes) - 1)
        out[some] = np.where(self.sorted_hashes[at] == h[some], self.sorted_ranks[at], -1)
        return out

    def may_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b side by side."""
        out = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 30)
        on = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(on):
            pair = self.find(self.hashes[a] * self.powers[np.minimum(self.lengths[b], self.longest)] + self.hashes[b])
            fits = self.lengths[a] + self.lengths[b] <= self.longest
            bad = fits & (pair >= 0) & (pair < limit)
            out[on[bad]] = False
            keep = ~bad & (np.maximum(a, b) >= self.singles)
            on, a, b, limit = on[keep], a[keep], b[keep], limit[keep]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def merged(self, text: str) -> list[int]:
        """Ids of a segment by merging from a heap: highest score first, leftmost of equals."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (found := self.score_of.get(both := symbols[i] + symbols[j])):
                heapq.heappush(heap, (-found[0], i, j, both))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [self.score_of[s][1]] if s in self.score_of else [self.byte_ids[x] for x in s.encode()]
        return out


def _may_meet(order, rank, usable, left, right, singles, a, b, limit) -> bool:
    while True:
        pair = rank.get(order[a] + order[b], -1)
        if 0 <= pair < limit and usable[pair]:
            return False
        if max(a, b) < singles:
            return True
        if a > b:
            limit, a = a, right[a]
        else:
            limit, b = b + 1, left[b]


class Encoder:
    """A model with what it remembers: encoded segments, and which pairs of pieces may meet."""

    def __init__(self, model: Model):
        self.model = model
        self.pair_key = np.full(1 << PAIRS_BITS, -1, np.int64)
        self.pair_says = np.zeros(1 << PAIRS_BITS, bool)
        self.memo = Memo(CACHED_SEGMENTS)

    def may_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = (key * 0x9E3779B1 >> 20) & ((1 << PAIRS_BITS) - 1)
        out = self.pair_says[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            kinds, at, of = np.unique(key[new], return_index=True, return_inverse=True)
            says = self.model.may_meet(a[new][at], b[new][at])
            out[new] = says[of]
            slot = slot[new][at]
            self.pair_key[slot], self.pair_says[slot] = kinds, says
        return out

    def lattice(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of equal length [word, position]: the piece that ends at each position, and the backpointer to its start."""
        m = self.model
        n, length = points.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * np.uint64(_P) + points[:, i] + np.uint64(1)
        last = np.full((length + 1, n), UNKNOWN, np.int32)
        back = np.zeros((length + 1, n), np.int16)
        for i in range(1, length + 1):
            todo = np.arange(n)
            for width in range(min(i, m.longest), 0, -1):
                j = i - width
                piece = m.find(prefix[i, todo] - prefix[j, todo] * m.powers[width])
                some = np.flatnonzero(piece >= 0)
                stands = np.zeros(len(todo), bool)
                stands[some] = True
                if j:
                    previous = last[j, todo[some]]
                    real = previous >= 0
                    stands[some[real]] = self.may_meet(previous[real], piece[some[real]])
                best = todo[stands]
                last[i, best], back[i, best] = piece[stands], j
                todo = todo[~stands]
                if not len(todo):
                    break
            back[i, todo] = i - 1  # characters that are no piece
        return last, back

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of segments of equal length, spelt with BLANK."""
        m = self.model
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1).astype(np.uint64)
        last, back = self.lattice(points)
        n, length = points.shape
        rows, at = np.arange(n), np.full(n, length)
        steps = []
        while True:
            on = at > 0
            if not on.any():
                break
            steps.append(np.where(on, last[at, rows], -1))
            at = np.where(on, back[at, rows], 0)
        path = np.stack(steps[::-1], 1)
        odd = (path == UNKNOWN).any(1)
        size = (path != -1).sum(1)
        ids = m.ids[np.maximum(path, 0)]
        flat = ids[path != -1]
        ends = np.cumsum(size)
        out = np.split(flat, ends[:-1])
        for k in np.flatnonzero(odd).tolist():
            found: list[int] = []
            place = 0
            for p in path[k][path[k] != -1].tolist():
                if p == UNKNOWN:
                    found += [m.byte_ids[x] for x in texts[k][place].encode()]
                    place += 1
                else:
                    found.append(int(m.ids[p]))
                    place += int(m.lengths[p])
            out[k] = np.array(found, np.int32)
        return out

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of segments, spelt with BLANK."""
        by_length: dict[int, list[int]] = {}
        made: list = [None] * len(texts)
        for k, t in enumerate(texts):
            if len(t) > LONGEST_BATCHED or t.startswith(BLANK * 2):
                made[k] = np.array(self.model.merged(t), np.int32)
            else:
                by_length.setdefault(len(t), []).append(k)
        for ks in by_length.values():
            for k, ids in zip(ks, self.batch([texts[k] for k in ks]), strict=True):
                made[k] = ids
        return made

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets in them."""
        data, offsets = utf8(column)
        sizes = np.diff(offsets)
        raw = data.tobytes()
        if (mark := BLANK.encode()) in raw:  # shorter then: text by text
            texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
            offsets = np.append(0, np.cumsum(sizes))
        # a blank before each text that has a character
        some = sizes > 0
        grown = np.append(0, np.cumsum(sizes + some))
        framed = np.full(int(grown[-1]), 32, np.uint8)
        framed[np.arange(len(data)) + np.repeat(np.cumsum(some), sizes)] = data
        heads = grown[:-1][some]
        is_blank, is_break = framed == 32, framed == 10
        start = np.zeros(len(framed), bool)
        start[1:] = (is_blank[1:] & ~is_blank[:-1]) | is_break[1:] | is_break[:-1]
        start[heads] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(framed))
        raw = framed.tobytes()
        segments = lambda at: [raw[begin[k] : end[k]].decode().replace(" ", BLANK) for k in at.tolist()]
        ids, size = self.memo.ids(hash_spans(framed, begin, end), proofs(framed, begin, end), lambda at: self.each(segments(at)))
        total = np.append(0, np.cumsum(size))
        return ids, total[np.searchsorted(begin, grown)]


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts' bytes of rows of ids; byte pieces that are no UTF-8 stay as they are."""
    data, begin, size = model.output
    lengths = size[ids]
    total = np.append(0, np.cumsum(lengths))
    raw = data[np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], lengths)].tobytes()
    at = total[offsets].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(shared, model_path: str) -> Encoder:
    """One encoder a worker and model, so that what it remembers lasts over batches and tasks."""
    if model_path not in _encoders:
        _encoders[model_path] = Encoder(shared.value)
    return _encoders[model_path]


def encode_texts(texts: DataFrame, model_path: str, text: str = "text", round_trip: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """texts with piece_ids, n_pieces and pieces_crc32 (of the ids as little-endian unsigned 32-bit integers); with round_trip whether decoding gives the text back."""
    shared = texts.sparkSession.sparkContext.broadcast(Model(model_path))
    fields = [("piece_ids", "array<int>", pa.list_(pa.int32())), ("n_pieces", "bigint", pa.int64()), ("pieces_crc32", "bigint", pa.int64())]
    if round_trip:
        fields.append(("round_trip", "boolean", pa.bool_()))

    def compute(column: pa.Array) -> list:
        ids, at = _encoder(shared, model_path).encode(column)
        null = column.is_null().to_numpy(zero_copy_only=False)
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(null, False)), pa.array(ids))
        out = [lists, pa.array(np.diff(at), mask=null), pa.array(crc, pa.int64(), mask=null)]
        if round_trip:
            data, offsets = utf8(column)
            raw = data.tobytes()
            back = decode(shared.value, ids, at)
            blank = BLANK.encode()
            same = [raw[a:b].replace(blank, b" ") == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), back, strict=True)]
            out.append(pa.array(np.array(same, bool), mask=null))
        return out

    return map_texts(texts, text, fields, compute, 2_000_000, drop)


def decode_ids(rows: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """rows with the text that a column of ids stands for; a null is null, and bytes that are no UTF-8 become U+FFFD."""
    from pyspark.sql import functions as F

    shared = rows.sparkSession.sparkContext.broadcast(Model(model_path))

    @F.pandas_udf("string")
    def decoded(column):
        import pandas as pd

        lists = [np.asarray(x, np.int64) if x is not None else None for x in column]
        real = [x for x in lists if x is not None]
        flat = np.concatenate(real) if real else np.empty(0, np.int64)
        found = iter(decode(shared.value, flat, np.append(0, np.cumsum([len(x) for x in real])).astype(np.int64)))
        return pd.Series([next(found).decode("utf-8", "replace") if x is not None else None for x in lists], dtype=object)

    return rows.withColumn(text, decoded(F.col(ids)))
