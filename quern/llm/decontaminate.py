"""Benchmark decontamination: texts that hold a benchmark item, found by q-gram lemma filtering and banded alignment.

Texts and items are spelt alike: letters and digits in lower case, everything between them one blank. An item of m
characters may differ from the text's region by an edit budget of floor(EDITS * m). If it does, the two share at least
m - Q + 1 - Q * budget of the item's q-grams on diagonals that lie within the budget of each other; so q-gram hits are
counted in overlapping bands of diagonals, twice the budget and more wide, and a band with that many hits is a region.
Semi-global alignment of the item with the region, over the diagonals that a hit of the band can be reached from within the
budget and no others, then gives its edit distance, and with it the verdict. Budgets shrink where an item is so short that
the lemma would ask for nothing; items of under Q characters must occur whole, between word borders.

The benchmark is the stated query set: it is handed out in blocks of at most QUERY_CHARACTERS characters, each matched
against all texts, so that neither its size nor a text's length has a limit. Texts are never joined with each other. Long
texts are spelt first and then looked at in pieces of PIECE characters that overlap by more than any item's region.

Defined results: null texts, texts without letters or digits, and such items match nothing. Repeated items each match, and
each row of texts by itself, whatever other rows have its id. Columns of texts may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts
from .text import blocks, code_points, utf8

Q = 10
EDITS = 0.08
QUERY_CHARACTERS = 4_000_000
FILTER_BITS = 22
#: Bytes, or spelt characters, of text that are looked at together; a longer text goes in overlapping pieces.
PIECE = 1_000_000
#: Pairs of a q-gram hit and an item's place that are sorted at once; bands that go on are carried over.
SLICE = 2_000_000


@cache
def _spelling() -> np.ndarray:
    """The letter or digit that a code point is spelt as; 32 for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalnum():
            small = chr(c).lower()
            table[c] = ord(small) if len(small) == 1 else c
    return table


def spell(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spelt texts in a row, each framed by blanks, and their offsets."""
    spelt = _spelling()[points]
    mark = spelt == 32
    keep = np.ones(len(spelt), bool)
    keep[1:] = ~(mark[1:] & mark[:-1])
    edges = first[:-1][first[:-1] < len(spelt)]
    total = np.append(0, np.cumsum(keep))
    # a text's leading blanks are replaced by its frame
    lead = np.zeros(len(spelt), bool)
    lead[edges] = mark[edges]
    keep &= ~lead
    keep[edges] = ~mark[edges]
    total = np.append(0, np.cumsum(keep))
    n = np.diff(total[first])
    out = np.full(int(total[-1]) + 2 * len(n), 32, np.uint32)
    offsets = np.append(0, np.cumsum(n + 2))
    place = np.arange(int(total[-1])) + np.repeat(2 * np.arange(len(n)) + 1, n)
    out[place] = spelt[keep]
    return out, offsets


def qgrams(spelt: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of each q characters in a row."""
    if len(spelt) < q:
        return np.empty(0, np.uint32)
    have, width = {1: spelt * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)}, 1
    total = None
    done = 0
    rest = q
    while rest:
        if rest & 1:
            part = have[width]
            if total is None:
                total, done = part, width
            else:
                size = len(part) - done
                total = (total[:size] * np.uint32(0x85EBCA77)) ^ (part[done : done + size] + (total[:size] >> np.uint32(15)))
                done += width
        rest >>= 1
        if rest:
            part = have[width]
            joined = (part[:-width] * np.uint32(0xC2B2AE3D)) ^ (part[width:] + (part[:-width] >> np.uint32(13)))
            width *= 2
            have[width] = joined
    total = total[: len(spelt) - q + 1]
    total = (total ^ (total >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return total ^ (total >> np.uint32(15))


def budget_of(length: int) -> int:
    """Edits that an item of this length may have; at least one hit must be asked for."""
    return max(0, min(int(EDITS * length), (length - Q) // Q))


class Items:
    """Spelt items with a table of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        column = pa.array([t or "" for t in texts], pa.string())
        spelt, at = spell(*code_points(*utf8(column)))
        self.ids, self.spelt, self.short = [], [], []
        gram, item, place = [], [], []
        for k, name in enumerate(ids):
            # without the frame's blanks
            body = spelt[at[k] + 1 : at[k + 1] - 1]
            if len(body) and body[-1] == 32:
                body = body[:-1]
            if not len(body):
                continue
            self.ids.append(name)
            self.spelt.append(body)
            if len(body) < Q:
                self.short.append(len(self.ids) - 1)
                continue
            g = qgrams(body)
            gram.append(g)
            item.append(np.full(len(g), len(self.ids) - 1))
            place.append(np.arange(len(g)))
        self.lengths = np.array([len(s) for s in self.spelt])
        self.budgets = np.array([budget_of(len(s)) for s in self.spelt], np.int64)
        self.needed = np.maximum(1, self.lengths - Q + 1 - Q * self.budgets)
        empty = np.empty(0, np.int64)
        self.gram = np.concatenate(gram) if gram else empty.astype(np.uint32)
        order = np.argsort(self.gram, kind="stable")
        self.gram = self.gram[order]
        self.item = (np.concatenate(item) if item else empty)[order]
        self.place = (np.concatenate(place) if place else empty)[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.gram >> np.uint32(32 - FILTER_BITS)] = True


def alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int:
    """Edits that turn the item into the best part of the text whose alignment stays on the diagonals low to high (place in the text less place in the item); budget + 1 if more."""
    wide = high - low + 1
    # before an item's k-th character, cell d is the text's character at k + low + d; beyond the text nothing is equal
    padded = np.full(len(item) + wide, 0xFFFFFFFF, np.uint32)
    begin, end = max(0, low), min(len(text), low + len(padded))
    if end > begin:
        padded[begin - low : end - low] = text[begin:end]
    cost = np.zeros(wide + 1, np.int64)
    cost[wide] = budget + 2  # a diagonal further than high
    steps = np.arange(wide)
    for k, c in enumerate(item.tolist()):
        now = np.minimum(cost[:-1] + (padded[k : k + wide] != c), cost[1:] + 1)
        cost[:-1] = np.minimum.accumulate(now - steps) + steps
        if cost[:-1].min() > budget:
            return budget + 1
    return int(cost[:-1].min())


def matches(spelt: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(text, item, edits) for spelt texts in a row and their offsets; item is an index of items."""
    best: dict[tuple[int, int], int] = {}
    g = qgrams(spelt)
    if len(items.gram) and len(g):
        hit = np.flatnonzero(items.seen[g >> np.uint32(32 - FILTER_BITS)])
        low = np.searchsorted(items.gram, g[hit], "left")
        n = np.searchsorted(items.gram, g[hit], "right") - low
        hit, low, n = hit[n > 0], low[n > 0], n[n > 0]
        text = np.searchsorted(at, hit, "right") - 1
        inside = hit + Q <= at[text + 1]
        hit, low, n, text = hit[inside], low[inside], n[inside], text[inside]
        kept, kept_spots = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        for some in _slices(n, SLICE):
            entry = np.repeat(low[some], n[some]) + np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            where, owner = np.repeat(hit[some], n[some]), np.repeat(text[some], n[some])
            item, diagonal = items.item[entry], where - items.place[entry]
            width = items.budgets[item] + 1
            # bands of 2 * width diagonals that overlap by width: any width neighbouring diagonals are in one of them
            band = (diagonal - at[owner] + (1 << 20)) // width
            keys = np.stack([np.concatenate([owner, owner]), np.concatenate([item, item]), np.concatenate([band, band - 1])], 1)
            keys, spots = np.concatenate([kept, keys]), np.concatenate([kept_spots, *[items.place[entry]] * 2])
            order = np.lexsort((spots, *keys.T[::-1]))
            keys, spots = keys[order], spots[order]
            # the lemma counts q-grams of the item, so one that the region holds twice is one
            distinct = np.append(True, (keys[1:] != keys[:-1]).any(1) | (spots[1:] != spots[:-1]))
            keys, spots = keys[distinct], spots[distinct]
            if some.stop < len(hit):
                # bands that hits still to come may fall into are counted with those
                last = at[keys[:, 0]] + (keys[:, 2] + 2) * (items.budgets[keys[:, 1]] + 1) - (1 << 20) + items.lengths[keys[:, 1]]
                later = (last >= hit[some.stop]) & (keys[:, 0] == text[some.stop])
                kept, kept_spots, keys = keys[later], spots[later], keys[~later]
            head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.empty(0, np.int64)
            count = np.diff(np.append(head, len(keys)))
            for k in head[count >= items.needed[keys[head, 1]]].tolist():
                owner_, item_, band_ = keys[k].tolist()
                budget = int(items.budgets[item_])
                if best.get((owner_, item_), budget + 1) == 0:
                    continue
                lowest = band_ * (budget + 1) - (1 << 20)
                edits = alignment(items.spelt[item_], spelt[at[owner_] : at[owner_ + 1]], lowest - budget, lowest + 2 * (budget + 1) - 1 + budget, budget)
                if edits <= budget:
                    best[owner_, item_] = min(edits, best.get((owner_, item_), edits))
    for k in items.short:
        body = items.spelt[k]
        framed = np.concatenate([[32], body, [32]]).astype(np.uint32)
        if len(framed) > len(spelt):
            continue
        same = np.ones(len(spelt) - len(framed) + 1, bool)
        for j, c in enumerate(framed.tolist()):
            same &= spelt[j : j + len(same)] == c
        for owner_ in np.unique(np.searchsorted(at, np.flatnonzero(same), "right") - 1).tolist():
            best[owner_, k] = 0
    return [(t, i, e) for (t, i), e in sorted(best.items())]


def _slices(n: np.ndarray, most: int) -> Iterator[slice]:
    total = np.cumsum(n)
    done = 0
    while done < len(n):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")))
        yield slice(done, upto)
        done = upto


def _spelt_pieces(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spelt texts (as by spell, text of each piece) in blocks of about PIECE bytes; a longer text in pieces that overlap by so many spelt characters."""
    data, offsets = utf8(column)
    sizes = np.diff(offsets)
    done = 0
    while done < len(sizes):
        if sizes[done] > PIECE:
            for piece in _long(data[offsets[done] : offsets[done + 1]], overlap):
                yield piece, np.array([0, len(piece)]), np.array([done])
            done += 1
            continue
        upto = done
        while upto < len(sizes) and sizes[upto] <= PIECE and (upto == done or offsets[upto + 1] - offsets[done] <= PIECE):
            upto += 1
        yield *spell(*code_points(data[offsets[done] : offsets[upto]], offsets[done : upto + 1] - offsets[done])), np.arange(done, upto)
        done = upto


def _long(data: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """A text's spelling in pieces, each beginning with the last `overlap` characters before it; only the text's ends are framed."""
    step = max(PIECE, 2 * overlap)
    held = np.array([32], np.uint32)
    a = 0
    while a < len(data):
        b = min(a + step, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        spelt = _spelling()[code_points(data[a:b], np.array([0, b - a]))[0]]
        joined = np.concatenate([held, spelt, *([[np.uint32(32)]] if b == len(data) else [])]).astype(np.uint32)
        blank = joined == 32
        joined = joined[np.append(True, ~(blank[1:] & blank[:-1]))]
        if len(joined) - len(held) >= step // 2 or b == len(data):  # else little is left of it, and more text is put behind
            yield joined
            held = joined[-overlap:]
        else:
            held = joined
        a = b


def found_in(column: pa.Array, items: Items) -> dict[tuple[int, int], int]:
    """Least edits by (text, item) of a column of texts."""
    overlap = int((items.lengths + 2 * items.budgets).max(initial=0)) + 4
    best: dict[tuple[int, int], int] = {}
    for spelt, at, owner in _spelt_pieces(column, overlap):
        for t, i, e in matches(spelt, at, items):
            place = (int(owner[t]), i)
            best[place] = min(e, best.get(place, e))
    return best


def item_blocks(benchmark: DataFrame, item_key: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks that fit the driver and a broadcast, whatever its size."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_key).alias("id"), F.col(text).alias("text")).toLocalIterator():
        if ids and size + len(r["text"] or "") > QUERY_CHARACTERS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
    yield Items(ids, texts)


def contaminated(texts: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, edits): one row for each row of texts and benchmark item that it holds."""
    sc = texts.sparkSession.sparkContext
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item_type, key_type = benchmark.schema[item_key].dataType.simpleString(), rows.schema["key"].dataType.simpleString()
    out = None
    for items in item_blocks(benchmark, item_key, item_text):
        shared = sc.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for whole in batches:
                for x in blocks(whole, "text", 8_000_000):
                    found = sorted(found_in(x.column(1), items).items())
                    picked = x.column(0).take(pa.array([t for (t, _), _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([picked, pa.array([items.ids[i] for (_, i), _ in found], kind), pa.array([e for _, e in found], pa.int32())], names=["key", "item_id", "edits"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(benchmark.schema[item_key].dataType)
        part = rows.mapInArrow(run, f"key {key_type}, item_id {item_type}, edits int")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("key", key)


def decontaminate(texts: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """texts without the rows that hold an item. Each row is judged by its own text, in one pass a block of the benchmark; nothing is joined."""
    columns = texts.columns
    rows = texts.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    for items in item_blocks(benchmark, item_key, item_text):
        shared = texts.sparkSession.sparkContext.broadcast(items)

        def clean(column: pa.Array, shared=shared) -> list:
            out = np.ones(len(column), bool)
            out[[t for t, _ in found_in(column, shared.value)]] = False
            return [pa.array(out)]

        rows = map_texts(rows, f"c{columns.index(text)}", [("clean", "boolean", pa.bool_())], clean, 8_000_000).where("clean").drop("clean")
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
