"""Language identification with spans of mixed-language text.

Words are runs of letters. The script of a word (by ranges of code points) leaves only the languages that were seen in
that script; the log-likelihoods of its centred 3-grams and 5-grams of letters score them; a Viterbi pass over the words
of a text, with a penalty for each change of language, labels them. Runs of words with one label are spans. The text's
language is the one with the most letters, its score that language's share of the letters.

Every label is learned. The n-gram tables are fitted on at most SAMPLE_TEXTS labelled texts a language (about; chosen by a
hash of the id). They have 2 ** BITS rows an order for up to FULL_LANGUAGES languages and half as many each time the
languages double, 2 ** LEAST_BITS at least: they grow with the labels only beyond 4,096. All texts are labelled whole.

Defined results: a null text or one without letters is `und` with score 0. If no language could be learned, all are `und`.
Of equally good languages the alphabetically first wins. A word in a script of no learned language counts for none of them;
a text with no other letters gets the first of the languages, with score 0. Repeated rows each get their row; columns of
the input with the names of the result's columns are replaced.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_texts
from .text import code_points, pieces, utf8

BITS = 16
SAMPLE_TEXTS = 3000
FULL_LANGUAGES = 64
LEAST_BITS = 10
SWITCH_PENALTY = 12.0
#: A script counts as one of a language's own from this share of its letters on.
SCRIPT_SHARE = 0.01

#: Unicode script blocks.
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Gurmukhi", ((0xA00, 0xA7F),)),
    ("Gujarati", ((0xA80, 0xAFF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Kannada", ((0xC80, 0xCFF),)),
    ("Malayalam", ((0xD00, 0xD7F),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("Han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)
N_SCRIPTS = len(SCRIPTS) + 2  # 0: not a letter; the last: a letter of another script


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its script and its lower case."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            script[c] = N_SCRIPTS - 1
            if len(small := chr(c).lower()) == 1:
                lower[c] = ord(small)
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = k
    return script, lower


def table_bits(languages: int) -> int:
    """Bits of a bucket in tables for so many languages."""
    return max(LEAST_BITS, BITS - max(0, (languages - 1) // FULL_LANGUAGES).bit_length())


class Letters:
    """Letters of a block of texts, word by word: spelling features (of so many bits), scripts and positions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
        scripts, lower = tables()
        points, first = code_points(data, offsets)
        script = scripts[points]
        letter = script > 0
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        edges = first[(first > 0) & (first < len(points))]
        start[edges] = letter[edges]
        at = np.flatnonzero(letter)
        self.script, begins = script[at], start[at]
        self.word_first = np.flatnonzero(begins)
        self.word_of = np.cumsum(begins) - 1
        self.word_from = at[self.word_first]
        self.word_letters = np.diff(np.append(self.word_first, len(at)))
        self.word_upto = self.word_from + self.word_letters
        self.text_first = np.searchsorted(self.word_from, first)  # the first word of each text
        self.points_first = first
        n = len(at)
        spelt = lower[points[at]].astype(np.uint64)
        padded = np.zeros(n + 4, np.uint64)
        padded[2 : n + 2] = spelt
        ends = np.zeros(n + 1, bool)
        ends[self.word_first] = True
        ends[n] = True
        first_letter, last_letter = ends[:n], ends[1:]
        l1 = np.where(first_letter, 0, padded[1 : n + 1])
        r1 = np.where(last_letter, 0, padded[3 : n + 3])
        second, before_last = np.ones(n, bool), np.ones(n, bool)
        second[1:] = first_letter[:-1] | first_letter[1:]
        before_last[:-1] = last_letter[1:] | last_letter[:-1]
        l2 = np.where(second, 0, padded[:n])
        r2 = np.where(before_last, 0, padded[4 : n + 4])
        three = spelt * np.uint64(0x9E3779B97F4A7C15) + l1 * np.uint64(0xC2B2AE3D27D4EB4F) + r1 * np.uint64(0x165667B19E3779F9)
        five = three * np.uint64(0xD6E8FEB86659FD93) + l2 * np.uint64(0xFF51AFD7ED558CCD) + r2 * np.uint64(0xC4CEB9FE1A85EC53)
        down = np.uint64(64 - bits)
        self.features = [((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> down).astype(np.int64) for x in (three, five)]


def _fit(texts: DataFrame, text: str, label: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of centred log-likelihoods [order, bucket, language], and which language is written in which script."""
    rows = len(names)
    of = {name: k for k, name in enumerate(names)}
    bits = table_bits(rows)
    size = 2 << bits

    def count(batches):
        total = np.zeros((rows, size + N_SCRIPTS), np.int64)
        for b in batches:
            labels = np.array([of[x] for x in b.column(1).to_pylist()], np.int64)
            from .text import blocks

            done = 0
            for part in blocks(b, "text"):
                x = Letters(*utf8(part.column(0)), bits)
                mine = np.repeat(labels[done : done + part.num_rows], np.diff(x.text_first))[x.word_of]
                for k, f in enumerate(x.features):
                    total[:, k << bits : (k + 1) << bits] += np.bincount(mine * (1 << bits) + f, minlength=rows << bits).reshape(rows, -1)
                total[:, size:] += np.bincount(mine * N_SCRIPTS + x.script, minlength=rows * N_SCRIPTS).reshape(rows, -1)
                done += part.num_rows
        who, where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(where), pa.array(total[who, where])], names=["who", "slot", "n"])

    counts = texts.select(F.col(text).alias("text"), F.col(label).alias("label")).mapInArrow(count, "who long, slot long, n long")
    got = counts.groupBy("who", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x slots
    total = np.zeros((rows, size + N_SCRIPTS))
    total[got["who"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    tables_ = total[:, :size].reshape(rows, 2, 1 << bits)
    logs = np.log((tables_ + 0.5) / (tables_.sum(2, keepdims=True) + 0.5 * (1 << bits)))
    logs -= logs.mean(0, keepdims=True)
    scripts = total[:, size:]
    written = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return np.ascontiguousarray(np.clip(logs, -6, 6).transpose(1, 2, 0)).astype(np.float32), written


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; texts advance together, a word a step. scores: [word, label]; first: each text's first word."""
    n, k = scores.shape
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, sorted_lengths = first[:-1][order], lengths[order]
    steps = int(sorted_lengths[0]) if len(order) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(steps), "left")  # texts longer than t
    stays = np.ones((n, k), bool)
    came = np.zeros(n, np.int32)
    value = np.zeros((len(order), k), np.float32)
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        v = value[:m]
        if t:
            best = v.argmax(1)
            jump = v[np.arange(m), best] - np.float32(penalty)
            stays[at] = v >= jump[:, None]
            came[at] = best
            v = np.maximum(v, jump[:, None])
        v = v + scores[at]
        value[:m] = v - v.max(1, keepdims=True)
    label = value.argmax(1)
    out = np.zeros(n, np.int64)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        now = label[:m]
        out[at] = now
        label[:m] = np.where(stays[at, now], now, came[at])
    return out


#: Bytes whose letters are held at once; the words of a whole block are held.
PIECE_BYTES = 500_000


def _label(column: pa.Array, model, names: list[str], with_spans: bool) -> list:
    data, offsets = utf8(column)
    n_texts, k = len(offsets) - 1, len(names)
    logs, written = model
    piece = max(1, PIECE_BYTES * FULL_LANGUAGES // max(FULL_LANGUAGES, k))
    bits = table_bits(k)
    ends, owner = pieces(offsets, data, piece)
    parts: list[tuple] = []
    points_before = np.zeros(n_texts, np.int64)
    low = 0
    while low < len(owner) and k:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + piece, "right")) - 1)
        x = Letters(data[ends[low] : ends[high]], ends[low : high + 1] - ends[low], bits)
        scores = np.zeros((len(x.word_first), k), np.float32)
        if len(x.word_first):
            for f, table in zip(x.features, logs, strict=True):
                scores += np.add.reduceat(table[f], x.word_first, 0)
            fits = written[:, x.script[x.word_first]].T
            known = fits.any(1)
            scores[~known] = 0
            scores[~fits & known[:, None]] -= 1e4
            of = np.repeat(owner[low:high], np.diff(x.text_first))
            origin = np.repeat(x.points_first[:-1], np.diff(x.text_first)) - points_before[of]
            parts.append((of, scores, known, x.word_letters, x.word_from - origin, x.word_upto - origin))
        np.add.at(points_before, owner[low:high], np.diff(x.points_first))
        low = high
    if not parts:
        return [["und"] * n_texts, np.zeros(n_texts), *([[[] for _ in range(n_texts)]] if with_spans else [])]
    text, scores, known, size, begin, upto = (np.concatenate(x) for x in zip(*parts, strict=True))
    label = viterbi(scores, np.searchsorted(text, np.arange(n_texts + 1)), SWITCH_PENALTY)
    letters = np.bincount(text * k + label, np.where(known, size, 0), n_texts * k).reshape(n_texts, k)
    total = np.bincount(text, size, n_texts)
    best = letters.argmax(1)
    score = np.where(total > 0, letters[np.arange(n_texts), best] / np.maximum(total, 1), 0)
    found = [names[b] if n > 0 else "und" for b, n in zip(best, total, strict=True)]
    if not with_spans:
        return [found, score]
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(label)) - 1
    spans = [[] for _ in range(n_texts)]
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        spans[text[h]].append({"start": int(begin[h]), "end": int(upto[t]), "lang": names[label[h]]})
    return [found, score, spans]


def identify(texts: DataFrame, learn_from: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", spans: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """texts with lang_pred, score and, if asked for, spans (code points, end exclusive); learned from the labelled rows of learn_from."""
    labelled = learn_from.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    found = labelled.groupBy(label).count().orderBy(F.desc("count"), label).collect()  # a row a label
    share: Column = F.lit(0)
    for k, (name, n) in enumerate(found):
        most = F.lit(min(1_000_000, round(1_000_000 * SAMPLE_TEXTS / n)))
        share = share.when(F.col(label) == name, most) if k else F.when(F.col(label) == name, most)
    share = share.otherwise(0) if found else share
    names = sorted(name for name, _ in found)
    sample = labelled.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < share)
    shared = texts.sparkSession.sparkContext.broadcast(_fit(sample, text, label, names)) if names else None
    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    if spans:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        fields.append(("spans", "array<struct<start:bigint,end:bigint,lang:string>>", kind))
    block = 4_000_000 * 4 // max(4, len(names))
    return map_texts(texts, text, fields, lambda column: _label(column, shared.value if shared else (None, None), names, spans), block, drop)
