"""Vectorised kernels over blocks of UTF-8 texts.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; these bytes never occur inside a longer UTF-8 sequence,
so words can be found, compared and hashed on the bytes of an Arrow column without decoding it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel gets; intermediate arrays take about 40 times as much.
BLOCK_BYTES = 2_000_000

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word that are hashed eight at a time with those of all other words; a longer word is hashed alone.
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Of a word's size what its hash begins with, and which bits of eight bytes are its own.
_SEEDS = mix(np.arange(LONG_WORD + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _step(h: np.ndarray, eight: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9FB21C651E98DF25) ^ eight)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, or one row."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of a block: byte ranges, 64-bit hashes, and for each text the index of its first word (and one past the last)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans_of_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """inside: for each byte whether it is of a word, if the caller knows."""
    inside = WORD_BYTE[data] if inside is None else inside
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: their size, then eight bytes at a time, each through mix. Ranges of one size of up to eight bytes never share a hash."""
    size = ends - starts
    if not len(size):
        return np.empty(0, np.uint64)
    eights = _eights(data)
    out = _step(_SEEDS[np.minimum(size, LONG_WORD)], eights[starts] & _MASKS[np.minimum(size, 8)])
    some = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at, left = starts[some] + 8, size[some] - 8
    while len(some):
        out[some] = _step(out[some], eights[at] & _MASKS[np.minimum(left, 8)])
        on = left > 8
        some, at, left = some[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))


def proofs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of byte ranges a value of their first and last eight bytes and their size that has nothing in common with hash_spans()."""
    size = ends - starts
    eights, mask = _eights(data), _MASKS[np.minimum(size, 8)]
    first, last = eights[starts] & mask, eights[np.maximum(ends - 8, starts)] & mask
    return first * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(0x165667B19E3779F9) + size.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = spans_of_words(data, offsets)
    return Words(starts, ends, hash_spans(data, starts, ends), first)


def order_hashes(w: Words) -> list[np.ndarray]:
    """Two hashes of each text's words in their order; 0 for a text without any."""
    count = np.diff(w.first)
    place = (np.arange(len(w.hashes)) - np.repeat(w.first[:-1], count)).astype(np.uint64)
    out = []
    for salt in (1, 2):
        total = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(mix(w.hashes + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)), out=total[1:])
        out.append(np.where(count > 0, total[w.first[1:]] - total[w.first[:-1]] | np.uint64(1), np.uint64(0)))
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes; the caller drops those that cross texts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def complete(first: np.ndarray, n: int) -> np.ndarray:
    """True for positions from which n words of one text follow; as long as grams()."""
    total = int(first[-1])
    if total < n:
        return np.empty(0, bool)
    ok = np.ones(total, bool)
    for back in range(1, n):
        at = first[1:] - back
        at = at[at >= first[:-1]]
        ok[at] = False
    return ok[: total - n + 1]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in a row, and the offsets of the texts in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return points, total[offsets]


def pieces(offsets: np.ndarray, data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that also cut texts longer than `most` bytes, each time after a separator, and the text of each piece."""
    cuts, of = [], []
    for k in np.flatnonzero(np.diff(offsets) > most).tolist():
        at, end = int(offsets[k]) + most, int(offsets[k + 1])
        while at < end:
            ahead = data[at : min(at + 4096, end)]
            gap = np.flatnonzero(~WORD_BYTE[ahead])
            if len(gap):
                cuts.append(at + int(gap[0]) + 1)
                of.append(k)
                at = cuts[-1] + most
            else:
                at += 4096
    if not cuts:
        return offsets, np.arange(len(offsets) - 1)
    both = np.insert(offsets[:-1], np.array(of) + 1, cuts)
    return np.append(both, offsets[-1]), np.insert(np.arange(len(offsets) - 1), np.array(of) + 1, of)
