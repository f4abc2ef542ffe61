"""Near duplicates, repeated passages, benchmark items."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontaminate, near_dedup, repeats

from conftest import edited, prose


def bag(text):
    words = (text or "").split()
    if not words:
        return {}
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def similarity(a, b):
    kinds = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in kinds) for d in a if d in b)


def classes_by_hand(rows):
    bags = {i: bag(t) for i, t in rows if i is not None}
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in bags}


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(5)
    a = {int(k): int(rng.integers(1, 6)) for k in rng.integers(0, 50, 40)}
    b = {int(k): int(rng.integers(1, 6)) for k in rng.integers(0, 50, 40)}
    x, y = ((np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)])) for m in (a, b))
    exact = similarity(a, b)
    assert near_dedup.probability_jaccard(x, y) == pytest.approx(exact)
    text = np.r_[np.zeros(len(x[0]), int), np.ones(len(y[0]), int)]
    held = near_dedup.signatures(text, near_dedup.mix(np.r_[x[0], y[0]]), np.r_[x[1], y[1]], 2, registers=8000)
    assert (held[0] == held[1]).mean() == pytest.approx(exact, abs=0.03)
    doubled = near_dedup.signatures(text[: len(x[0])], near_dedup.mix(x[0]), 7 * x[1], 1, registers=100)
    assert (doubled[0] == near_dedup.signatures(text[: len(x[0])], near_dedup.mix(x[0]), x[1], 1, registers=100)[0]).all()


def test_classes(docs, rows, nothing):
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    expected = classes_by_hand([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == expected
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    assert sum(n > 1 for n in collections.Counter(expected.values()).values()) >= 1
    assert near_dedup.near_duplicate_classes(nothing).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_a_large_group_that_one_leader_cannot_join(spark, monkeypatch, block):
    rng = random.Random(2)
    base = prose(rng, "en", 160)
    rows = [(100 + i, edited(rng, base, n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7, 8])]
    rows += [(5, edited(rng, rows[9][1], 3)), (6, edited(rng, rows[8][1], 3)), (7, rows[3][1]), (7, rows[3][1])]
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SPREAD", block)
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_hand(rows)


def test_one_of_each_class_stays(docs, rows):
    kept = near_dedup.first_of_each_class(docs)
    assert kept.columns == docs.columns
    expected = classes_by_hand([(r[0], r[1]) for r in rows])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, c in expected.items() if i == c)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "m n o p q r"), (3, "m n o p q r"), (4, None), (5, None)]
    kept = near_dedup.first_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=repr) == sorted([(None, "g h i j k l"), (1, "a b c d e f"), (3, "m n o p q r"), (4, None), (5, None)], key=repr)


def test_texts_that_share_an_id_and_ids_of_text(spark):
    rng = random.Random(4)
    a, b = prose(rng, "en", 100), prose(rng, "de", 100)
    rows = [("x", a), ("x", b), ("y", a), ("z", edited(rng, b, 1)), (None, edited(rng, a, 1)), ("w", ""), ("w", None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id string, text string, class_id long")
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.first_of_each_class(df).where("text <> ''").collect()) == sorted([("x", a), ("x", b)])
    assert near_dedup.first_of_each_class(df).count() == 4
    got = collections.Counter(map(tuple, near_dedup.near_duplicate_classes(df).collect()))
    assert got == collections.Counter([("x", "x"), ("x", "x"), ("y", "x"), ("z", "x"), (None, "x"), ("w", "w"), ("w", "w")])


def removed_by_hand(rows):
    """rows: (id, text, xxhash64 of the text)."""
    seen, out = set(), []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check_repeats(df):
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = sorted(map(tuple, repeats.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == removed_by_hand(rows)
    return got


@pytest.mark.parametrize("group", [400_000, 40])
def test_repeats(docs, nothing, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    assert sum(r[2] for r in check_repeats(docs)) > 0
    assert repeats.without_repeats(nothing).count() == 0


def test_repeats_with_null_repeated_and_text_ids(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, "en", 90) for _ in range(3))
    inner = prose(rng, "de", 30)
    rows = [(None, inner + " " + inner), (None, a), (None, b + " " + inner), (1, c), (1, a + " " + b), (1, a + " " + b), (2, c), (2, "few words"), (2, "few words"), (3, None), (3, "")]
    got = check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[:3] for r in got if r[0] == 2] == [(2, 2, 0), (2, 2, 0), (2, 90, 90)]
    check_repeats(spark.createDataFrame([(None if i is None else f"id {i}", t) for i, t in rows], "doc_id string, text string").na.fill("~", ["doc_id"]))


def test_a_passage_in_most_texts_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 50)
    rng = random.Random(3)
    passage = prose(rng, "en", 24)
    long = " ".join(prose(rng, "fr", 60) if k % 3 else passage for k in range(200))
    check_repeats(spark.createDataFrame([(k, prose(rng, "de", 5) + " " + passage) for k in range(150)] + [(200, long), (201, "ab " * 300)], "doc_id long, text string"))


def test_rewritten_texts_hold_what_is_kept(spark):
    rng = random.Random(6)
    a = prose(rng, "en", 40)
    got = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame([(1, a, 5), (2, "see " + a + " end", 6)], "doc_id long, text string, n_words long"), rewrite=True).collect()}
    assert got[1]["text"] == " ".join(a.split()) and got[2]["text"] == "see end"


def test_leaves_and_spans_over_batches():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 3, 200)) << 33, np.zeros(200, np.int64)
    b[1::3] = 1
    b = b[np.lexsort((b, a))]
    table = pa.RecordBatch.from_pydict({"a": a, "b": b, "row": np.arange(200), "start": np.zeros(200, np.int32)})
    seen, expected = set(), []
    for k in range(200):
        if (a[k], b[k]) in seen:
            expected.append(k)
        seen.add((a[k], b[k]))
    for step in (1, 7, 200):
        parts = pa.Table.from_batches(repeats._leaves([table.slice(k, step) for k in range(0, 200, step)])).to_pylist()
        assert [r["row"] for r in parts if r["kind"] == repeats.REPEAT] == expected
        assert [(r["kind"], r["row"]) for r in parts if r["kind"] != repeats.REPEAT] == [(repeats.HEAD, 0), (repeats.TAIL, 199)]
    places = pa.RecordBatch.from_pydict({"row": np.array([1, 1, 1, 4, 4, 6]), "start": np.array([2, 3, 7, 0, 1, 5], np.int32)})
    for step in (1, 2, 6):
        got = [(r["row"], [(s["start"], s["n"]) for s in r["spans"]]) for x in repeats._spans([places.slice(k, step) for k in range(0, 6, step)]) for r in x.to_pylist()]
        assert got == [(1, [(2, 2), (7, 1)]), (4, [(0, 2)]), (6, [(5, 1)])]


def test_words_that_a_polynomial_confuses():
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    from quern.llm.text import utf8, words

    w = words(*utf8(pa.array([f"{x} {y} {x} ab ab\0 ba", x * 2 + " " + y * 2])))
    assert len(set(w.hashes.tolist())) == 7 and w.hashes[0] == w.hashes[2]


ITEMS = [(1, prose(random.Random(1), "en", 40)), (2, prose(random.Random(2), "de", 25)), (3, "tiny"), (4, ""), (5, None), (6, prose(random.Random(3), "fr", 60)), (6, "twice listed item of a few words")]


def test_benchmark_items(spark, docs, rows, nothing):
    rng = random.Random(4)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    plain = rows[3][1]
    near = list(ITEMS[0][1])
    for k in range(20, len(near), 40):
        near[k] = "z"
    texts = [
        (1, plain + " " + ITEMS[0][1] + " " + plain), (2, plain), (3, ITEMS[5][1].upper().replace(" ", "  \n")), (4, "it is tiny."), (5, "destiny"), (6, None), (7, ""),
        (8, plain + "".join(near)), (9, ITEMS[5][1][: len(ITEMS[5][1]) // 2]), (10, (prose(rng, "en", 3000) + " ") * 30 + ITEMS[5][1] + prose(rng, "de", 2000)), (11, "tiny"), (11, "tiny"), (None, ITEMS[1][1]),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in found) == collections.Counter([(1, 1), (3, 6), (4, 3), (8, 1), (10, 6), (11, 3), (11, 3), (None, 2)])
    assert {r["doc_id"]: r["edits"] for r in found if r["doc_id"] in (1, 3, 10)} == {1: 0, 3: 0, 10: 0}
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0
    kept = decontaminate.decontaminate(docs.withColumn("item_id", docs.doc_id), benchmark)
    assert kept.count() == len(rows) and "item_id" in kept.columns


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "QUERY_CHARACTERS", 10)
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ITEMS)], "doc_id long, text string")
    found = decontaminate.contaminated(texts, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 1), (1, 2), (2, 3), (5, 6), (6, 6)}


def test_edits_up_to_the_budget_are_found(spark):
    rng = random.Random(9)
    items = decontaminate.Items([k for k, _ in ITEMS], [t for _, t in ITEMS])
    for k, (_, text) in enumerate([ITEMS[0], ITEMS[5]]):
        body = items.spelt[[0, 3][k]].tolist()
        for n in range(items.budgets[[0, 3][k]]):
            letters = [j for j in range(1, len(body) - 1) if body[j] != 32 and body[j - 1] != 32 and body[j + 1] != 32]
            j = rng.choice(letters)
            (body.__setitem__, body.insert)[n % 2](j, ord("q"))
        document = prose(rng, "en", 50) + " " + "".join(map(chr, body)) + " " + prose(rng, "en", 50)
        assert [i for _, i in decontaminate.found_in(pa.array([document]), items)] == [[0, 3][k]]
        del text


def distance(item, text):
    """Edits from the item to the best part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        now = [k]
        for j, d in enumerate(text):
            now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def spelt_as_text(text):
    column = pa.array([text])
    from quern.llm.text import code_points, utf8

    return "".join(map(chr, decontaminate.spell(*code_points(*utf8(column)))[0].tolist()))


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(at, rng.choice("abcdefgh"))
        else:
            del out[at]
    return "".join(out)


def test_verdicts_and_edits_against_all_alignments():
    rng = random.Random(21)
    bodies = [prose(rng, "en", n).replace("\n", " ") for n in (3, 6, 12, 25, 60)]
    items = decontaminate.Items(list(range(len(bodies))), bodies)
    texts, seen = [], 0
    for body in bodies:
        budget = int(items.budgets[bodies.index(body)])
        for edits in [*range(budget + 4)] * 2:
            texts.append(prose(rng, "de", 8) + " " + changed(rng, body, edits) + " " + prose(rng, "de", 8))
    got = decontaminate.found_in(pa.array(texts), items)
    spelt = [spelt_as_text(t) for t in texts]
    for k, item in enumerate(items.spelt):
        word, budget = "".join(map(chr, item.tolist())), int(items.budgets[k])
        for t, text in enumerate(spelt):
            edits = distance(word, text)
            assert got.get((t, k)) == (edits if edits <= budget else None), (k, t, edits, budget)
            seen += 0 < edits <= budget
    assert seen > 20


def test_alignment_on_diagonals():
    rng = random.Random(5)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randrange(1, 9), rng.randrange(0, 14)))
        a, b = (np.array([ord(c) for c in x], np.uint32) for x in (item, text))
        assert decontaminate.alignment(a, b, -len(item), len(text), 20) == distance(item, text)


def test_long_texts_are_cut_after_spelling(monkeypatch):
    rng = random.Random(31)
    body = prose(rng, "fr", 30)
    items = decontaminate.Items([1, 2], [body, "tiny"])
    gap = body.replace(" ", " " * 700)
    monkeypatch.setattr(decontaminate, "PIECE", 400)
    for lead in (0, 50, 333, 390, 399, 400, 401, 555, 800):
        text = "x" * lead + " " + gap + " " + "destiny " * 150
        assert decontaminate.found_in(pa.array([text, "b", text + " tiny", None]), items) == {(0, 0): 0, (2, 0): 0, (2, 1): 0}, lead


def test_rows_are_judged_by_their_own_text(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, ITEMS[0][1]), (None, "clean"), (1, "clean"), (1, ITEMS[5][1]), (2, None), (2, "")]
    kept = decontaminate.decontaminate(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, clean boolean"), benchmark).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, "clean", True), (1, "clean", True), (2, None, True), (2, "", True)], key=repr)


def test_items_are_counted_whole_over_slices_of_hits(monkeypatch):
    rng = random.Random(11)
    whole = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    prompt = "answer the following question with one of the words that follow it "
    bodies = [whole, "short item 14x", *(prompt + "".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(30)), "ab" * 60]
    changed = "".join("Z" if k % 12 == 6 else c for k, c in enumerate(whole))
    texts = ["before " + changed + " after", "so short item 14x is here", *(prose(rng, "en", 20) + " " + b + " " + prose(rng, "en", 20) for b in bodies[2:]), "ab" * 400]
    items = decontaminate.Items(list(range(len(bodies))), bodies)
    expected = decontaminate.found_in(pa.array(texts), items)
    assert {(k, k) for k in range(len(bodies))} <= set(expected)
    slices = decontaminate._slices
    for most in (1, 7, 100):
        monkeypatch.setattr(decontaminate, "_slices", lambda n, _, most=most: slices(n, most))
        assert decontaminate.found_in(pa.array(texts), items) == expected
