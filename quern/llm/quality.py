"""Quality rules: fixed limits on repetition and length, then gradient-boosted trees over document statistics.

Statistics are taken from whole texts, vectorised over blocks of texts. The trees (logistic loss, histogram splits) are
fitted on at most SAMPLE labelled texts, chosen by a hash of the id; the score may only fall as the shares of symbols,
repeated lines and repeated words rise (FALLING): splits that break this are not made, and both sides of a split on such
a statistic are kept on their side of the split's middle. Flattened to node arrays, all trees score all texts of a block
at once. The limit is taken on a fifth of the labelled texts that the trees are not fitted on: of the scores that tell its
good from its bad texts with the greatest balanced accuracy, the lowest. So a few wrong labels on either side do not move it.

Defined results: a null text is an empty one and fails the base rules. Without both labels among the labelled texts
the trees keep all that the base rules keep. Columns of the input with the names of the result's columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts
from .text import complete, grams, hash_spans, mix, utf8, words

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, PENALTY = 60, 4, 32, 0.15, 20.0, 1.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?")] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[65:91] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "capital_share",
    "punctuation_share", "distinct_share", "words_a_line", "short_word_share", "long_word_share",
)
FALLING = ("symbol_share", "dup_line_share", "repeat_share")


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block the counts named in BASE, and the figures named in STATISTICS."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    w = words(data, offsets)
    n_words = np.diff(w.first)
    text = w.texts

    def in_texts(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text, flags, n).astype(np.int64)

    head = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    length = head[w.ends] - head[w.starts]
    word_chars = by_text(length)
    # lines
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    some = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[some], end[some]
    owner = np.searchsorted(offsets, begin, "right") - 1
    salt = np.uint64(0x9E3779B97F4A7C15)
    _, at = np.unique(mix(hash_spans(data, begin, end) + owner.astype(np.uint64) * salt), return_index=True)
    lines = np.bincount(owner, minlength=n)
    dup_lines = lines - np.bincount(owner[at], minlength=n)
    # windows of five words
    g, ok = grams(w.hashes, 5), complete(w.first, 5)
    place = np.flatnonzero(ok)
    _, of, count = np.unique(mix(g[ok] + text[place].astype(np.uint64) * salt), return_inverse=True, return_counts=True)
    twice = place[count[of] > 1]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + 5, -1)
    repeat_words = by_text(np.cumsum(change[:-1]) > 0)
    _, at = np.unique(mix(w.hashes + text.astype(np.uint64) * salt), return_index=True)
    distinct = np.bincount(text[at], minlength=n)
    base = np.stack([n_words, word_chars, in_texts(SYMBOLS[data]), dup_lines, repeat_words], 1).astype(np.int64)
    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(word_chars, 1)
    figures = np.stack([
        np.log1p(n_words), word_chars * per_word, base[:, 2] * per_char, dup_lines / np.maximum(lines, 1), repeat_words * per_word, in_texts(DIGITS[data]) * per_char,
        in_texts(CAPITALS[data]) * per_char, in_texts(PUNCTUATION[data]) * per_char, distinct * per_word, n_words / np.maximum(lines, 1),
        by_text(length <= 2) * per_word, by_text(length >= 12) * per_word,
    ], 1)
    return base, figures


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


class Trees:
    """Boosted trees as node arrays [tree, node]; a node's children are 2 k + 1 and 2 k + 2, and a leaf sends all to the left."""

    def __init__(self, falling: list[int]):
        self.falling = falling
        size = 2 ** (DEPTH + 1) - 1
        self.feature = np.zeros((0, size), np.int64)
        self.limit = np.zeros((0, size))
        self.value = np.zeros((0, size))
        self.start = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        return self.start + self.value[trees, node].sum(1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
        raw = np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            feature, limit, value, out = self._tree(binned, cuts, p - y, p * (1 - p))
            raw += out
            self.feature = np.vstack([self.feature, feature])
            self.limit = np.vstack([self.limit, limit])
            self.value = np.vstack([self.value, value])
        return self

    def _tree(self, binned, cuts, g, h):
        size = self.feature.shape[1]
        feature, limit, value, out = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size), np.zeros(len(g))
        todo = [(0, np.arange(len(g)), -np.inf, np.inf)]
        while todo:
            node, rows, low, high = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if 2 * node + 2 < size:
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, k], g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, k], h[rows], len(c) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(binned[rows, k], minlength=len(c) + 1))[:-1]
                    a = np.clip(-left_g / (left_h + PENALTY), low, high)
                    b = np.clip(-(total_g - left_g) / (total_h - left_h + PENALTY), low, high)
                    worth = -(left_g * a + (left_h + PENALTY) * a * a / 2) - ((total_g - left_g) * b + (total_h - left_h + PENALTY) * b * b / 2)
                    v = np.clip(-total_g / (total_h + PENALTY), low, high)
                    worth += total_g * v + (total_h + PENALTY) * v * v / 2
                    allowed = (left_n >= LEAST_LEAF) & (len(rows) - left_n >= LEAST_LEAF)
                    if k in self.falling:
                        allowed &= a >= b
                    worth = np.where(allowed, worth, -np.inf)
                    j = int(worth.argmax())
                    if worth[j] > best[0]:
                        best = (worth[j], (k, j, a[j], b[j]))
            if best[1] is None:
                v = RATE * float(np.clip(-total_g / (total_h + PENALTY), low, high))
                out[rows] = v
                while True:  # all that come here end in the leftmost leaf below
                    value[node] = v
                    if 2 * node + 2 >= size:
                        break
                    node = 2 * node + 1
                continue
            k, j, a, b = best[1]
            feature[node], limit[node] = k, cuts[k][j]
            middle = (a + b) / 2
            goes = binned[rows, k] <= j
            left, right = ((max(low, middle), high), (low, min(high, middle))) if k in self.falling else ((low, high), (low, high))
            todo += [(2 * node + 1, rows[goes], *left), (2 * node + 2, rows[~goes], *right)]
        return feature, limit, value, out


def fit(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Trees, float]:
    """The trees and the score from which on a text is kept."""
    trees = Trees([STATISTICS.index(s) for s in FALLING])
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("quern_key"), F.col(label).cast("int").alias("quern_label"))
    n = marked.count()
    share = round(1_000_000 * min(1.0, SAMPLE / max(n, 1)))
    marked = marked.where(F.pmod(F.xxhash64("quern_key"), F.lit(1_000_000)) < share)  # about SAMPLE rows at most: few enough to broadcast
    rows = texts.select(F.col(key).alias("quern_key"), F.col(text).alias("text")).join(F.broadcast(marked), "quern_key")

    def compute(column: pa.Array) -> list:
        base, figures = statistics(column)
        return [pa.array(base_failed(base)), pa.array(list(figures), pa.list_(pa.float64()))]

    fields = [("failed", "boolean", pa.bool_()), ("figures", "array<double>", pa.list_(pa.float64()))]
    got = map_texts(rows, "text", fields, compute, 2_000_000, ("text",)).where("not failed").toPandas()
    if not len(got) or got.quern_label.nunique() < 2:
        return trees, -np.inf
    got = got.sort_values("quern_key")
    x, y = np.stack(got.figures.to_numpy()), got.quern_label.to_numpy().astype(float)
    held = np.arange(len(y)) % 5 == 0
    trees.fit(x[~held], y[~held])
    return trees, best_limit(trees.score(x[held]), y[held])


def best_limit(score: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on texts are kept with the greatest balanced accuracy; without both labels all are."""
    n_good, n_bad = (y == 1).sum(), (y != 1).sum()
    if not n_good or not n_bad:
        return -np.inf
    limits = np.append(-np.inf, np.unique(score))
    good, bad = np.sort(score[y == 1]), np.sort(score[y != 1])
    kept = 1 - np.searchsorted(good, limits, "left") / n_good
    dropped = np.searchsorted(bad, limits, "left") / n_bad
    return float(limits[(kept + dropped).argmax()])


def judge(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", drop: tuple[str, ...] = ()) -> DataFrame:
    """texts with the counts of BASE, base_failed, kept and quality_score."""
    model, limit = fit(texts, labels, key, text, label)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        base, figures = statistics(column)
        failed, score = base_failed(base), shared.value.score(figures)
        return [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(~failed & (score >= limit)), pa.array(score)]

    fields = [*((n, "bigint", pa.int64()) for n in BASE), ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()), ("quality_score", "double", pa.float64())]
    return map_texts(texts, text, fields, compute, 2_000_000, drop)
