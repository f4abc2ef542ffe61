"""What a worker remembers of short texts that come again and again: rows of ids by a 64-bit hash, and a second value that tells texts apart whose hashes are equal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from .text import mix


Make = Callable[[np.ndarray], Sequence[Sequence[int]]]


class Memo:
    """Rows of ids by hash, at most about `most` of them: then all are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.row = np.empty(0, np.int64)
        self.about = np.empty((1 << 12, 3), np.uint64)  # of each row its proof, where its ids begin, how many there are
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0

    def ids(self, hashes: np.ndarray, proofs: np.ndarray, make: Make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all hashed texts in a row and the texts' sizes; make() gets the indices of texts that are new, each once."""
        places = self.places(hashes, proofs, make)
        if places is None:  # both values together become the hash, for this once
            self.forget()
            found = self.ids(mix(hashes ^ mix(proofs)), np.zeros_like(proofs), make)
            self.forget()
            return found
        begin, size = places
        at = np.repeat(begin + size - np.cumsum(size), size)
        at += np.arange(len(at))
        return self.flat.take(at), size

    def places(self, hashes: np.ndarray, proofs: np.ndarray, make: Make) -> tuple[np.ndarray, np.ndarray] | None:
        """Where each text's ids begin and how many there are, until the next call; None if two of the texts have one hash."""
        order = np.argsort(hashes)
        kinds = hashes[order]
        head = np.ones(len(kinds), bool)
        head[1:] = kinds[1:] != kinds[:-1]
        of = np.empty(len(kinds), np.int64)
        of[order] = np.cumsum(head) - 1
        kinds, one = kinds[head], order[head]  # one place of each
        if (proofs != proofs[one][of]).any():
            return None
        if len(self.known) > self.most:
            self.forget()
        at = np.searchsorted(self.known, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != kinds[inside]
        if (self.about[self.row[at[~new]], 0] != proofs[one[~new]]).any():  # one of these has the hash of another one that is remembered
            self.forget()
            return Memo.places(self, hashes, proofs, make)
        if new.any():
            made = make(one[new])
            size = np.array([len(x) for x in made], np.int64)
            end = self.used + np.cumsum(size)
            rows = np.arange(len(self.known), len(self.known) + len(made))
            self.flat = _grown(self.flat, self.used, int(end[-1]))
            self.flat[self.used : end[-1]] = np.fromiter(chain.from_iterable(made), np.int32)
            self.used = int(end[-1])
            self.about = _grown(self.about, rows[0], rows[-1] + 1)
            self.about[rows] = np.stack([proofs[one[new]], (end - size).view(np.uint64), size.view(np.uint64)], 1)
            self.known = np.insert(self.known, at[new], kinds[new])
            self.row = np.insert(self.row, at[new], rows)
            at += np.cumsum(new) - new  # as many new ones stand before
        about = self.about[self.row[at]].view(np.int64)
        return about[:, 1][of], about[:, 2][of]


def _grown(held: np.ndarray, used: int, room: int) -> np.ndarray:
    """held, or a copy of what is used of it with twice the room that is asked for."""
    if room <= len(held):
        return held
    out = np.empty((2 * room, *held.shape[1:]), held.dtype)
    out[:used] = held[:used]
    return out


class FrontedMemo(Memo):
    """A Memo with a table in front, where a text is found by the low bits of its hash without sorting; a later text takes the place of an earlier one."""

    def __init__(self, most: int, bits: int):
        self.rows = 1 << bits
        self.turn = 0
        super().__init__(most)

    def forget(self) -> None:
        super().forget()
        self.turn += 1
        self.front = np.full((self.rows, 4), 0, np.uint64)  # hash, proof, where the ids begin, how many there are
        self.front[:, 0] = ~np.arange(self.rows, dtype=np.uint64)  # no hash that belongs there

    def places(self, hashes: np.ndarray, proofs: np.ndarray, make: Make) -> tuple[np.ndarray, np.ndarray] | None:
        row = (hashes & np.uint64(self.rows - 1)).view(np.int64)
        held = self.front.take(row, axis=0)
        known = held[:, 0] == hashes
        known &= held[:, 1] == proofs
        begin, size = held.view(np.int64)[:, 2:].T.copy()
        some = np.flatnonzero(~known)
        if not len(some):
            return begin, size
        turn = self.turn
        found = super().places(hashes[some], proofs[some], lambda at: make(some[at]))
        if self.turn != turn:  # what was found in front is forgotten
            some = np.arange(len(hashes))
            found = super().places(hashes, proofs, make)
        if found is None:
            return None
        begin[some], size[some] = found
        self.front[row[some]] = np.stack([hashes[some], proofs[some], begin[some].view(np.uint64), size[some].view(np.uint64)], 1)
        return begin, size
