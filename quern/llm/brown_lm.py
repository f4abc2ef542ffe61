"""A Brown class-based language model of the corpus, and the score of every text under it.

Tokens are words, A-Z lower-cased, and one end after each text. Every word of the training texts has a class by the
exchange criterion. The CLUSTERED most frequent words are put into classes by exchange clustering: words move one at a
time to the class that raises the likelihood of the class bigrams most. Each other word then goes to the class that
raises it most given all of the word's neighbours in the training texts, wherever they stand: clustered neighbours count
by class, the end as itself, and others by a hash of their last two bytes, OPEN kinds of ending. There are CLASSES
classes, or the cube root of the number of training words if that is more; the end has a class of its own. Words that
occur in held-out texts only take the class that most words with their ending that occur once in training have. A token's
probability is that of its class after the class before it (Witten-Bell interpolation of class bigrams and class
frequencies, from all tokens) times that of the word in its class (its count plus ALPHA over the class's tokens plus
ALPHA for each of its kinds and one unknown).

Counts of all words of all training texts are taken; none is left out and the vocabulary may be as large as it likes.
What leaves the executors is CLUSTERED words with their bigrams, and classes x classes counts. To look up counts and
classes in a vocabulary of any size, texts are dealt to blocks of about BLOCK_BYTES; the distinct words of each block, not
its tokens, are joined with them, and each block meets its own. Words are compared by 64-bit hashes.

Defined results: a null text is an empty one, its only token the end. Without training texts all counts are 0. Of equally
good classes the first wins. Repeated rows count, and are scored, each for itself. Columns other than id and text are not
read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import MOST_PARTS, Workspace
from .text import LOWER, blocks, hash_spans, mix, spans_of_words, utf8

CLUSTERED = 2000
CLASSES = 64
OPEN = 32
ROUNDS = 4
ALPHA = 0.1
BLOCK_BYTES = 10_000_000
END = np.uint64(0x2545F4914F6CDD1D)
#: Gains of so many occurrences of a neighbour are looked up, those of more are worked out.
FEW = 4


def class_count(kinds: int) -> int:
    """Classes for a vocabulary of so many words."""
    return max(CLASSES, round(kinds ** (1 / 3)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in a row, their kinds of ending (OPEN for the end), and the offsets of the texts in them."""
    small = LOWER[data]
    starts, ends, first = spans_of_words(small, offsets)
    hashes = hash_spans(small, starts, ends)
    last = small[ends - 1].astype(np.uint64) * np.uint64(256) + small[np.maximum(ends - 2, starts)]
    ending = (mix(last) % np.uint64(OPEN)).astype(np.int64)
    n = len(first) - 1
    at = first[1:] + np.arange(n)
    out = np.empty(len(hashes) + n, np.uint64)
    kind = np.empty(len(out), np.int64)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside], kind[inside] = hashes, ending
    out[at], kind[at] = END, OPEN
    return out, kind, np.append(0, at + 1)


def class_of(hashes: np.ndarray, kind: np.ndarray, listed: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Classes of tokens: those of the listed (sorted) words, else after them one for each kind of ending and the end."""
    if not len(listed):
        return n_classes + kind
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return np.where(listed[at] == hashes, classes[at], n_classes + kind)


def _gain(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words from counts[i, j] of word j after word i and frequencies n (words in order of frequency)."""
    words = len(n)
    classes = max(1, min(classes, words))
    of = np.arange(words) % classes
    one_hot = np.zeros((words, classes))
    one_hot[np.arange(words), of] = 1
    right = counts @ one_hot  # of each word: followers by class
    left = counts.T @ one_hot  # and predecessors by class
    table = one_hot.T @ right
    size = one_hot.T @ n

    for _ in range(rounds):
        moved = 0
        for w in range(words):
            c = of[w]
            r, lft, own = right[w].copy(), left[w].copy(), counts[w, w]
            r[c] -= own
            lft[c] -= own
            # take w out
            table[c] -= right[w]
            table[:, c] -= left[w]
            table[c, c] += own
            size[c] -= n[w]
            # likelihood gained by putting w into each class
            row, column, corner = _gain(table + r[None, :]) - _gain(table), _gain(table + lft[:, None]) - _gain(table), np.diagonal(table)
            score = row.sum(1) - np.diagonal(row) + column.sum(0) - np.diagonal(column)
            score += _gain(corner + r + lft + own) - _gain(corner) - 2 * (_gain(size + n[w]) - _gain(size))
            best = int(score.argmax())
            if score[best] <= score[c] + 1e-9:
                best = c
            # without w its followers in class c are r; put back
            full_r, full_l = r.copy(), lft.copy()
            full_r[best] += own
            full_l[best] += own
            table[best] += full_r
            table[:, best] += full_l
            table[best, best] -= own
            size[best] += n[w]
            if best != c:
                moved += 1
                of[w] = best
                right[:, c] -= counts[:, w]
                right[:, best] += counts[:, w]
                left[:, c] -= counts[w]
                left[:, best] += counts[w]
        if not moved:
            break
    return of


def _before(now: np.ndarray, first: np.ndarray, at_start: int) -> np.ndarray:
    out = np.empty_like(now)
    out[1:] = now[:-1]
    out[first[:-1]] = at_start
    return out


def _transitions(listed: np.ndarray, classes: np.ndarray, n_classes: int, count_words: bool):
    """Counts of neighbouring classes, or of neighbouring listed words, in training texts; the end comes before a first word."""
    size = len(listed) if count_words else n_classes + OPEN + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for whole in batches:
            for x in blocks(whole, "text"):
                h, kind, first = tokens(*utf8(x.column("text")))
                if count_words:
                    at = np.minimum(np.searchsorted(listed, h), size - 1)
                    now = np.where(listed[at] == h, at, -1)
                else:
                    now = class_of(h, kind, listed, classes, n_classes)
                before = _before(now, first, -1 if count_words else size - 1)
                ok = (now >= 0) & (before >= 0)
                total += np.bincount(before[ok] * size + now[ok], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run, size


def _neighbours(listed: np.ndarray, classes: np.ndarray, n_classes: int):
    """For each word that is not listed, and each piece of the texts, how often it has which class before it and (from wide on) after it."""
    wide = n_classes + OPEN + 1

    def run(batches):
        for whole in batches:
            for x in blocks(whole, "text"):
                h, kind, first = tokens(*utf8(x.column("text")))
                now = class_of(h, kind, listed, classes, n_classes)
                rest = np.flatnonzero((now >= n_classes) & (now < wide - 1))
                before = _before(now, first, wide - 1)[rest]
                word, at, of = np.unique(h[rest], return_index=True, return_inverse=True)
                # a text's last token is the end, so each word has one after it
                key, n = np.unique(np.concatenate([of * (2 * wide) + before, of * (2 * wide) + wide + now[rest + 1]]), return_counts=True)
                ends = np.searchsorted(key, np.arange(len(word) + 1) * (2 * wide))
                met = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key % (2 * wide)) << 32 | n, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kind[rest][at].astype(np.int32)), met], names=["word", "kind", "met"])

    return run


def best_classes(pairs: np.ndarray, n_classes: int, owner: np.ndarray, slot: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """The class of each word by the exchange criterion, from n neighbours of its owner in each slot (class before; after, from len(pairs) on), in order of owner."""
    base = np.concatenate([pairs[:, :n_classes], pairs[:n_classes].T])
    few = np.stack([_gain(base + r) - _gain(base) for r in range(FEW + 1)])
    size = pairs[:n_classes].sum(1), pairs[:, :n_classes].sum(0)
    total = np.bincount(owner, np.where(slot < len(pairs), n, 0), words)
    ends = np.searchsorted(owner, np.arange(words + 1))
    out = np.empty(words, np.int64)
    some = 0
    while some < words:
        upto = max(some + 1, int(np.searchsorted(ends, ends[some] + 10_000, "right")) - 1)
        part = slice(ends[some], ends[upto])
        gained = few[np.minimum(n[part], FEW), slot[part]]
        many = np.flatnonzero(n[part] > FEW)
        x = base[slot[part][many]]
        gained[many] = _gain(x + n[part][many, None]) - _gain(x)
        score = np.add.reduceat(gained, ends[some:upto] - ends[some], 0)
        for s in size:
            score -= _gain(s + total[some:upto, None]) - _gain(s)
        score[:, size[0] == 0] = -np.inf  # classes without clustered words tell nothing of their neighbours
        out[some:upto] = score.argmax(1)
        some = upto
    return out


def _assign(pairs: np.ndarray, n_classes: int):
    """word, kind, n and class from rows of _neighbours in order of words."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        word, at, of = np.unique(rows["word"].to_numpy(), return_index=True, return_inverse=True)
        met = rows["met"].combine_chunks()
        entries = met.flatten().to_numpy()
        key, inverse = np.unique(np.repeat(of, met.value_lengths().to_numpy()) * (2 * len(pairs)) + (entries >> 32), return_inverse=True)
        n = np.bincount(inverse, entries & 0xFFFFFFFF, len(key)).astype(np.int64)
        owner, slot = key // (2 * len(pairs)), key % (2 * len(pairs))
        found = best_classes(pairs, n_classes, owner, slot, n, len(word))
        total = np.bincount(owner, np.where(slot < len(pairs), n, 0), len(word)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(rows["kind"].to_numpy()[at]), pa.array(total), pa.array(found.astype(np.int32))], names=["word", "kind", "n", "class"])

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            word = rows["word"].to_numpy()
            cut = int(np.searchsorted(word, word[-1])) if len(word) else 0  # the last word may go on in the next batch
            if cut:
                yield flush(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held)

    return run


def _table(run, size: int, texts: DataFrame) -> np.ndarray:
    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    total = np.zeros(size * size)
    total[got["slot"].to_numpy()] = got["n"].to_numpy()
    return total.reshape(size, size)


def _distinct_words(batches):
    """Distinct words of each block, with their counts in training texts. Rows come block by block."""

    def flush(block: int, parts: list) -> pa.RecordBatch:
        h, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at, of = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(of, n, len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), block, np.int32)), pa.array(kind[at].astype(np.int32)), pa.array(total)], names=["word", "block", "kind", "n"])

    current, held = None, []
    for whole in batches:
        for x in blocks(whole, "text"):
            h, kind, first = tokens(*utf8(x.column("text")))
            train = np.repeat(~x.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            block = x.column("block").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for i, j in zip(edges, np.append(edges[1:], len(block)), strict=True):
                if block[i] != current and held:
                    yield flush(current, held)
                    held = []
                current = block[i]
                part = slice(first[i], first[j])
                u, at, of = np.unique(h[part], return_index=True, return_inverse=True)
                held.append((u, kind[part][at], np.bincount(of, train[part], len(u))))
    if held:
        yield flush(current, held)


def _of_unknown(classed: DataFrame, n_classes: int) -> np.ndarray:
    """For each kind of ending the class of unknown words, and that of the end."""
    once = np.zeros((OPEN, n_classes))
    for r in classed.where("n = 1").groupBy("kind", "class").count().collect():  # at most OPEN x classes rows
        once[r["kind"], r["class"]] = r["count"]
    return np.append(np.where(once.any(1), once.argmax(1), once.sum(0).argmax()), n_classes)


class _Known:
    """Counts and classes of the words of a block: those joined with it and the listed ones."""

    def __init__(self, right: pa.Table, listed: tuple[np.ndarray, np.ndarray, np.ndarray], unknown: np.ndarray):
        words = np.concatenate([right["word"].to_numpy().view(np.uint64), listed[0]])
        by = np.argsort(words)
        self.words, self.unknown = words[by], unknown
        self.n = np.concatenate([right["n"].to_numpy(), listed[1]])[by]
        self.classes = np.concatenate([right["class"].to_numpy(), listed[2]])[by]

    def find(self, hashes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        same = self.words[at] == hashes
        return np.where(same, self.n[at], 0), np.where(same, self.classes[at], self.unknown[kind])


def score_texts(texts: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of texts; held_out is true for rows to learn nothing from."""
    spark = texts.sparkSession
    space = Workspace(spark, "brown")
    rows = texts.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(volume / BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.substring("text", 1, 64)), F.lit(parts)).cast("int"))

    tasks = min(parts, MOST_PARTS)
    sorted_ = dealt.select("text", "held_out", "block").repartition(tasks, "block").sortWithinPartitions("block")
    places = space.write("places", sorted_.mapInArrow(_distinct_words, "word long, block int, kind int, n long"))
    counted = places.groupBy("word").agg(F.sum("n").alias("n"), F.min("kind").alias("kind"), F.count("*").alias("blocks"))
    vocabulary = space.write("vocabulary", counted.where("n > 0"))
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = int(total["n"] or 0), int(total["v"] or 0)

    space.drop()
    train = rows.where(~F.col("held_out"))
    end = int(END.astype(np.int64))
    top = vocabulary.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(CLUSTERED).collect()  # for the first step; the others follow
    top.sort(key=lambda r: r["word"] % (1 << 64))
    listed = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    n_listed = np.array([r["n"] for r in top], np.int64)
    n_classes = class_count(v_train)
    classes = np.empty(0, np.int64)
    if top:
        bigrams = _table(*_transitions(listed, classes, n_classes, True), train)
        order = np.argsort(-n_listed, kind="stable")
        classes = np.empty(len(top), np.int64)
        classes[order] = exchange(bigrams[np.ix_(order, order)], n_listed[order].astype(float), n_classes)
    first_pairs = _table(*_transitions(listed, classes, n_classes, False), train)
    met = train.select("text").mapInArrow(_neighbours(listed, classes, n_classes), "word long, kind int, met array<long>")
    by_word = met.repartition(tasks, "word").sortWithinPartitions("word")
    classed = space.write("classed", by_word.mapInArrow(_assign(first_pairs, n_classes), "word long, kind int, n long, class int"))
    unknown = _of_unknown(classed, n_classes)
    looked_up = space.write("looked_up", places.select("block", "word").join(classed.select("word", "n", "class"), "word").select("block", "word", "n", "class"))
    space.drop("places")

    n_end = sum(r["n"] for r in vocabulary.where(F.col("word") == end).select("n").collect())  # one row
    n, kinds = np.zeros(n_classes + 1), np.zeros(n_classes + 1)
    for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # at most a row a class
        n[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    known = np.append(listed, END), np.append(n_listed, n_end), np.append(classes, n_classes)
    np.add.at(n, known[2], known[1])
    np.add.at(kinds, known[2], known[1] > 0)
    given = spark.sparkContext.broadcast((known, unknown))
    size = n_classes + 1

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _Known(right, *given.value)
        total = np.zeros(size * size, np.int64)
        for whole in left.combine_chunks().to_batches():
            for x in blocks(whole, "text"):
                h, kind, first = tokens(*utf8(x.column("text")))
                _, now = words.find(h, kind)
                total += np.bincount(_before(now, first, n_classes) * size + now, minlength=size * size)
        at = np.flatnonzero(total)
        return pa.table([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    by_block = looked_up.groupBy("block")
    counted = dealt.where(~F.col("held_out")).select("block", "text").groupBy("block").cogroup(by_block).applyInArrow(count, "slot long, n long")
    got = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    pairs = np.zeros(size * size)
    pairs[got["slot"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(size, size)
    space.drop()
    before, follows = pairs.sum(1, keepdims=True), np.maximum((pairs > 0).sum(1, keepdims=True), 1)
    alone = (pairs.sum(0) + ALPHA) / (pairs.sum() + ALPHA * size)
    model = spark.sparkContext.broadcast((np.log10((pairs + follows * alone) / (before + follows)), np.log10(n + ALPHA * (kinds + 1))))
    log_total = math.log10(n_train + ALPHA * (v_train + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        moves, class_total = model.value
        words = _Known(right, *given.value)
        made = []
        for x in (x for whole in left.combine_chunks().to_batches() for x in blocks(whole, "text")):
            h, kind, first = tokens(*utf8(x.column("text")))
            c, cls = words.find(h, kind)
            previous = _before(cls, first, n_classes)
            emitted = np.log10(c + ALPHA)
            columns = [
                np.diff(first), np.add.reduceat((c > 0).astype(np.int64), first[:-1]), np.full(x.num_rows, n_train),
                np.add.reduceat(emitted - log_total, first[:-1]), np.add.reduceat(emitted - class_total[cls] + moves[previous, cls], first[:-1]),
            ]
            made.append(pa.table([x.column("key"), x.column("held_out"), *map(pa.array, columns)], names=NAMES))
        if not made:
            made.append(pa.table([left["key"], left["held_out"], *(pa.array([], pa.int64()) for _ in range(3)), *(pa.array([], pa.float64()) for _ in range(2))], names=NAMES))
        return pa.concat_tables(made)

    schema = f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.groupBy("block").cogroup(by_block).applyInArrow(score, schema)
    return out.withColumnRenamed("key", key)


NAMES = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
