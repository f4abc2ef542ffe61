"""Personal data, the language model, token files, SentencePiece, and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from quern.llm import brown_lm, pii, sentencepiece_codec, token_store
from quern.llm.queries import tokenizer_path
from quern.llm.shared import id_remainder

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def base_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_patterns_on_random_texts():
    rng = random.Random(3)
    parts = ["1", "2", "25", "9", ".", ".", "@", "@", "a", "b-", "é", "+", "+1", " ", "-", "(", ")", "4111111111111111", "255.", "a@b.c", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text)[0] == base_by_hand(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000, "1 " * 200_000, "(at)" * 50_000 + "dot"])
def test_long_texts_take_little_time(text):
    import time

    began = time.time()
    pii.candidates(text)
    assert time.time() - began < 3


def test_labelers_are_weighed():
    counts = {"0:+++00:13311": 100, "0:---00:10000": 80, "0:+-+00:13311": 3, "0:-++00:13311": 4, "2:+++00:13100": 50, "2:---00:13100": 60}
    z = pii.reliabilities(counts)
    assert z["0:+++00"] > 0.95 and z["0:---00"] < 0.05
    assert z == pii.reliabilities(counts | {"0:+++00:13311": 40, "0:+++00:00000": 60})  # labelers are judged by votes alone
    weights = pii.train(counts)
    assert pii._features("0:+++00:13311") @ weights > 0 > pii._features("2:---00:13100") @ weights
    assert not pii.train({}).any()


def test_gazetteers():
    assert [pii._listed("card", n) for n in ("4111 1111 1111 1111", "2221000000000009", "37828224631000", "9111111111111111")] == [1, 1, -1, -1]
    assert [pii._listed("ip", n) for n in ("8.8.8.8", "127.0.0.1", "192.0.2.7", "240.1.1.1", "256.1.1.1")] == [1, -1, -1, -1, -1]
    assert [pii._listed("phone", n) for n in ("+49 30 1234567", "+999 12345678", "(030) 123-4567")] == [1, -1, 0]
    assert [pii._listed("email", n) for n in ("ann at mail dot com", "ann (at) mail (dot) invalidtop")] == [1, -1]
    assert [pii._listed("secret", n) for n in ("ghp_abcdef123", "plainword")] == [1, 0]
    assert pii._entropy("ab" * 5000) == pytest.approx(1.0)


def test_all_spans_against_plain_loops(spark):
    rng = random.Random(13)
    parts = [
        "token = f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "ann at mail dot com", "call 523-555-1055 now", "+1 (523) 555-1055", "+999", "card 4111 1111 1111 1112", "4111111111111111", "10.20.30.40",
        "999.1.1.1", "bob@example.org", "plain words", "isbn 97831614841001", "password: hunter2hunter2", "abc" * 12, "x", "(030) 555-1234", "version 1.2.3.4", "+4930123456 78",
    ]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    weights = pii.train(collections.Counter(p for t in texts for p in pii._patterns(t)))
    expected, added = {}, 0
    for i, t in enumerate(texts):
        base = pii.base_spans(t)[0]
        more = []
        for begin, kind, end, votes in pii.candidates(t)[1]:
            assert not any(a <= begin and end <= b for a, _, b in base)
            if pii._features(pii._pattern(t, kind, begin, end, votes)) @ weights > 0:
                more.append((begin, kind, end))
        added += len(more)
        expected[i] = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == expected and added > 100


def test_pii(docs, rows, nothing):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        base = base_by_hand(text or "")
        r = got[doc_id]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == k for x in base) for k in range(4)]
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(",")) | ({""} if not joined else set())
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) == 4
    assert pii.find(nothing).count() == 0


def test_further_spans_and_redaction(spark):
    token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = [(i, f'word {i} token = "{token}" more, x{i}@mail.example.org and 10.0.0.{i}') for i in range(30)] + [(99, "4111111111111111 4111111111111111"), (98, None), (97, "plain words only")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame).collect()}
    assert all(f"secret:{rows[i][1].index(token)}:{rows[i][1].index(token) + 40}" in got[i] for i in range(30))
    assert got[99] == "card:0:16,card:17:33" and got[98] == got[97] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redact_texts(frame).collect()}
    assert red[3] == 'word 3 token = "<SECRET>" more, <EMAIL> and <IP>' and red[98] is None and red[97] == "plain words only"


def test_language_model(docs, rows, nothing):
    held = id_remainder("doc_id", 10) == 0
    got = {r["doc_id"]: r for r in brown_lm.score_texts(docs, held).collect()}
    assert len(got) == len(rows)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {r[0]: [*(r[1] or "").encode().translate(lower).split(), None] for r in rows}
    is_held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in tokens}
    count = collections.Counter(t for i, own in tokens.items() if not is_held[i] for t in own)
    total = sum(count.values())
    norm = math.log10(total + 0.1 * (len(count) + 1))
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held[i], len(own), sum(count[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[t] + 0.1) - norm for t in own))
        assert r["score"] < 0
    assert brown_lm.score_texts(nothing, held).count() == 0


def test_scores_against_a_model_made_by_hand(spark):
    rng = random.Random(23)
    kinds = [f"w{k}{rng.choice('abcdef')}" for k in range(90)]
    rows = [(i, " ".join(rng.choice(kinds[: 30 + 60 * (i % 2)]) for _ in range(rng.randint(0, 40))) + (" Unseen" if i % 5 == 0 else "")) for i in range(60)]
    held = {i: i % 5 == 0 for i, _ in rows}
    tokens = {i: [*t.lower().split(), None] for i, t in rows}
    train = [tokens[i] for i, _ in rows if not held[i]]
    n = collections.Counter(w for own in train for w in own)
    words = sorted((w for w in n if w), key=lambda w: (-n[w], brown_lm.tokens(*_utf8(w))[0][:1].view(np.int64)[0]))
    place = {w: k for k, w in enumerate(words)}
    follows = np.zeros((len(words), len(words)))
    for own in train:
        for a, b in zip(own, own[1:-1]):
            follows[place[a], place[b]] += 1
    size = brown_lm.class_count(len(n)) + 1
    # the order of equally frequent words is that of their hashes without sign, as the operator sorts them
    unsigned = sorted(words, key=lambda w: (-n[w], int(brown_lm.tokens(*_utf8(w))[0][0])))
    order = [place[w] for w in unsigned]
    found = brown_lm.exchange(follows[np.ix_(order, order)], np.array([float(n[w]) for w in unsigned]), size - 1)
    of = dict(zip(unsigned, found.tolist())) | {None: size - 1}
    pairs, total, distinct = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for own in train:
        for a, b in zip([None, *own], own):
            pairs[of[a], of[b]] += 1
    for w, count in n.items():
        total[of[w]] += count
        distinct[of[w]] += 1
    alone = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * size)
    kinds_after = np.maximum((pairs > 0).sum(1), 1)
    moves = (pairs + kinds_after[:, None] * alone) / (pairs.sum(1) + kinds_after)[:, None]
    emitted = lambda w: (n[w] + 0.1) / (total[of.get(w, 0)] + 0.1 * (distinct[of.get(w, 0)] + 1))
    assert moves.sum(1) == pytest.approx(np.ones(size))
    for c in range(size):  # all words of a class, and one unknown
        own = [w for w in n if of[w] == c]
        assert sum(map(emitted, own)) + 0.1 / (total[c] + 0.1 * (distinct[c] + 1)) == pytest.approx(1)
    got = {r["doc_id"]: r["score"] for r in brown_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0).collect()}
    for i, own in tokens.items():
        path = [size - 1, *(of.get(w, 0) for w in own)]
        assert got[i] == pytest.approx(sum(math.log10(moves[a, b]) + math.log10(emitted(w)) for a, b, w in zip(path, path[1:], own))), i


def _utf8(word):
    from quern.llm.text import utf8

    return utf8(pa.array([word]))


def test_remembered_texts_with_equal_hashes():
    from quern.llm.memo import Memo

    memo, made = Memo(100), []

    def make(texts):
        return lambda at: made.append(len(at)) or [[ord(c) for c in texts[k]] for k in at.tolist()]

    def ids(texts, hashes, proofs):
        flat, size = memo.ids(np.array(hashes, np.uint64), np.array(proofs, np.uint64), make(texts))
        assert "".join(map(chr, flat)) == "".join(texts) and size.tolist() == [len(t) for t in texts]

    ids(["ab", "c", "ab"], [1, 2, 1], [10, 20, 10])
    ids(["ab", "d"], [1, 3], [10, 30])
    assert made == [2, 1]
    ids(["x", "y", "x"], [1, 1, 1], [11, 12, 11])
    ids(["x", "d"], [1, 3], [11, 30])
    ids(["zz", "d"], [1, 3], [13, 30])


def test_language_model_in_blocks_is_the_same(docs, monkeypatch):
    held = id_remainder("doc_id", 10) == 0
    one = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown_lm.score_texts(docs, held).collect()}
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 4000)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown_lm.score_texts(docs, held).collect()} == one


def test_words_beyond_the_clustered_ones_learn_their_class(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CLUSTERED", 8)
    rng = random.Random(5)
    frequent = [[f"{g}{i}" for i in range(4)] for g in "xy"]
    rare = [[f"{g}{i}zz" for i in range(30)] for g in "pq"]  # all end alike
    texts = [" ".join(rng.choice(rare[k % 2] if rng.random() < 0.2 else frequent[k % 2]) for k in range(20)) for _ in range(300)]
    right, wrong = (" ".join(rare[(k + swap) % 2][k] for k in range(20)) for swap in (0, 1))
    frame = spark.createDataFrame([*enumerate(texts), (1000, right), (1001, wrong)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown_lm.score_texts(frame, frame["doc_id"] >= 1000).collect()}
    assert got[1000]["n_known"] == got[1001]["n_known"] == 21
    assert got[1000]["score"] > got[1001]["score"] + 3
    assert brown_lm.class_count(0) == brown_lm.CLASSES and brown_lm.class_count(10**9) == 1000


def test_class_model_is_a_distribution_and_exchange_helps():
    rng = np.random.default_rng(0)
    group = rng.permutation(np.repeat(np.arange(3), 10))
    counts = np.zeros((30, 30))
    now = 0
    for _ in range(6000):
        following = rng.choice(np.flatnonzero(group == (group[now] + 1) % 3))
        counts[now, following] += 1
        now = following
    found = brown_lm.exchange(counts, counts.sum(0), classes=3, rounds=10)
    assert len({(a, b) for a, b in zip(group, found, strict=True)}) == 3


@pytest.mark.parametrize("n", [0, 1, 5, 2047, 2048, 2049, 9000])
def test_token_files_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.zipf(1.3, n) % 3000, np.zeros(n, int)):
        sizes = np.array([n // 3, 0, n - n // 3])
        raw = token_store.encode_file(ids.astype(np.int32), sizes)
        back, same = token_store.decode_file(raw)
        assert (back == ids).all() and (same == sizes).all()


@pytest.mark.parametrize("n", [token_store.BLOCK_IDS - 1, token_store.BLOCK_IDS, 3 * token_store.BLOCK_IDS + 1])
def test_token_files_of_very_likely_and_very_rare_ids(n):
    rng = np.random.default_rng(n)
    rare = np.where(rng.random(n) < 0.002, rng.integers(0, 1 << 24, n), 7)  # long carries and wide steps of the coder
    for ids in (rare, np.arange(n), np.tile(np.arange(40), n)[:n]):
        back, _ = token_store.decode_file(token_store.encode_file(ids.astype(np.int32), np.array([n])))
        assert (back == ids).all()


def test_carries_go_through_words_of_all_ones():
    lanes, n = 3, 400
    coder = token_store.RangeEncoder(lanes, n + 8)
    coder.low[:] = np.uint64((1 << 64) - 2)  # the next part that is not the first overflows
    coder.out[:4] = coder.out[n + 8 : n + 12] = 0xFFFFFFFF
    coder.out[0] = 5
    coder.at[:2] += 4
    hit, p = np.zeros(lanes, bool), np.full(lanes, 32768, np.int32)
    coder.out[n + 8] = 6
    coder.code(lanes, p, hit, np.full(lanes, 3, np.uint64), np.full(lanes, 1, np.uint64))
    assert coder.out[:4].tolist() == [6, 0, 0, 0] and coder.out[n + 8 : n + 12].tolist() == [7, 0, 0, 0]


def test_remembered_words_are_found_without_sorting(tokenizer, monkeypatch):
    from quern.llm import memo

    encoder, texts = token_store.WordEncoder(tokenizer.to_str()), pa.array(["Some words, élan and 12 more words", "it's <odd> 中文", None])
    ids, sizes = encoder.encode(texts)
    monkeypatch.setattr(memo.np, "argsort", lambda *_: pytest.fail("sorted"))
    again, same = encoder.encode(texts)
    assert (again == ids).all() and (same == sizes).all()


def test_a_table_in_front_of_what_is_remembered():
    from quern.llm.memo import FrontedMemo

    memo, rng, made = FrontedMemo(50, 3), np.random.default_rng(3), []
    text = lambda h, p: [h, p] * (h % 4)

    def ids(hashes, proofs):
        flat, size = memo.ids(np.array(hashes, np.uint64), np.array(proofs, np.uint64), lambda at: made.append(len(at)) or [text(hashes[k], proofs[k]) for k in at.tolist()])
        want = [text(h, p) for h, p in zip(hashes, proofs, strict=True)]
        assert flat.tolist() == [x for w in want for x in w] and size.tolist() == [len(w) for w in want]

    ids([1, 9, 1, 2], [1, 1, 1, 1])  # 1 and 9 have one place
    ids([9, 1, 2, 9], [1, 1, 1, 1])
    assert made == [3]
    ids([1, 2], [2, 1])  # another text with the hash of one in front
    ids([2, 1, 1, 2], [1, 1, 2, 1])  # two with one hash
    for _ in range(300):  # places are taken over, and all is forgotten now and then
        hashes = rng.integers(0, 200, 12).tolist()
        ids(hashes, [7 if rng.random() < 0.95 else 8 for _ in hashes])


def test_damage_is_found():
    ids = np.random.default_rng(1).zipf(1.3, 5000) % 3000
    raw = token_store.encode_file(ids.astype(np.int32), np.array([5000]))
    for at in (0, 12, 60, len(raw) - 3):
        with pytest.raises(ValueError):
            token_store.decode_file(raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :])
    with pytest.raises(ValueError):
        token_store.decode_file(raw[:-9])
    repeated = np.tile(ids[:50], 100).astype(np.int32)
    assert len(token_store.encode_file(repeated, np.array([5000]))) < len(repeated) / 2


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_token_files_of_a_table(spark, docs, rows, nothing, tokenizer, tmp_path, monkeypatch):
    definition = open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    token_store.write_tokens(docs, definition, f"file://{tmp_path}/a")
    got = token_store.read_tokens(spark, f"file://{tmp_path}/a", ids=True).collect()
    start = 0
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = by_id[doc_id]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_store.write_tokens(nothing, definition, f"file://{tmp_path}/b")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_words_are_encoded_as_in_whole_texts(tokenizer):
    texts = ["ΟΔΟΣ ΑΣ'S it's I'LL  Don't x　y", "<|endoftext|>abc<|startoftext|> d", "é ́x", "a\x1cb\x85c 日本語 ½²", "İstanbul ẞ ﬁ", "a b"]
    encoder = token_store.WordEncoder(tokenizer.to_str())
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for k, t in enumerate(texts):
        assert ids[ends[k] - sizes[k] : ends[k]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_pieces_are_the_models_own(rows):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    texts = ["Hello  world", " a", "a ", " ", "  ", "", "a\tb\nc", "a▁b", "é", "ﬁ", "<s> x</s>", "<0x0A>", "\x00a", "😀 x😀y \n\n  z", "      x" * 3, "z" * 500]
    texts += ["".join(rng.choice("abcdehilnorstu      ..,\n0123éßüñ中文▁😀xyz") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [r[1] for r in rows if r[1]]
    model = sentencepiece_codec.Model(path)
    encoder = sentencepiece_codec.Encoder(model)
    for part in (texts[:700], texts[700:]):
        ids, at = encoder.encode(pa.array(part))
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == processor.encode(t), t
        assert [b.decode() for b in sentencepiece_codec.decode(model, ids, at)] == [t.replace("▁", " ") for t in part]


def test_pieces_of_a_table(docs, rows, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode_texts(docs, path, round_trip=True)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        assert got[doc_id]["round_trip"] is (None if text is None else True)
        assert (got[doc_id]["piece_ids"] is None) == (text is None)
    back = {r["doc_id"]: r["again"] for r in sentencepiece_codec.decode_ids(coded, path, text="again").collect()}
    assert back == {r[0]: r[1] for r in rows}
    assert sentencepiece_codec.encode_texts(nothing, path).count() == 0


def test_very_long_texts(spark, tokenizer, tmp_path):
    from quern.llm import near_dedup, repeats

    rng = random.Random(41)
    long = prose(rng, "en", 60_000)
    near = long.split(" ")
    near[30_000] = "changed"
    rows = [(1, long), (2, " ".join(near)), (3, "short text"), (4, "x" * 300_000 + " y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.without_repeats(frame).collect()}
    assert removed[2][0] == removed[1][0] and removed[2][1] == removed[2][0] - 1 and removed[3] == (2, 0)
    scored = {r["doc_id"]: r["n_tokens"] for r in brown_lm.score_texts(frame, F.col("doc_id") == 2).collect()}
    assert scored == {1: len(long.split()) + 1, 2: len(long.split()) + 1, 3: 3, 4: 3}
    assert all(r["round_trip"] for r in sentencepiece_codec.encode_texts(frame, tokenizer_path("piece_bpe_32k.model"), round_trip=True).collect())
    token_store.write_tokens(frame, open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read(), f"file://{tmp_path}/long")
    sizes = {r["doc_id"]: r["n_tokens"] for r in token_store.read_tokens(spark, f"file://{tmp_path}/long").collect()}
    assert sizes == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline
    from test_duplicates import classes_by_hand

    leak = prose(random.Random(21), "en", 40)
    more = [(900, rows[5][1] + " " + leak + " " + rows[6][1], "en", "s", 1), (901, "mail me at someone@mail.example.com, " + prose(random.Random(22), "en", 50), None, "s", 1)]
    more += [(None, prose(random.Random(31), "de", 40), "de", "s", 1), (None, prose(random.Random(32), "fr", 40), None, "s", 1), (5, prose(random.Random(33), "fr", 40), "fr", "s", 1), (902, more[1][1], "en", "s", 1)]
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    documents.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    # the same by plain loops: three Latin languages are known, so a text stays if enough of its letters are Latin
    letters = lambda t, kind: len(re.findall(kind, t or ""))
    kept = [(i, t) for i, t, *_ in [*rows, *more] if letters(t, r"[^\W\d_]") and letters(t, r"[A-Za-zÀ-ɏ]") >= 0.9 * letters(t, r"[^\W\d_]")]
    classes = classes_by_hand([(k, t) for k, (_, t) in enumerate(kept)])
    first: dict[int, int] = {}
    for k, c in classes.items():
        first[c] = min(first.get(c, k), k, key=lambda j: (kept[j][0] is None, kept[j][0] or 0, j))
    kept = [kept[k] for k in first.values() if leak not in kept[k][1]]
    weights = pii.train(collections.Counter(p for _, t in kept for p in pii._patterns(t)))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    expected = [(i, tuple(model.encode(pii.redacted(t, pii.spans(t, weights, {})[1])))) for i, t in kept]
    assert collections.Counter((r["doc_id"], tuple(r["piece_ids"])) for r in got) == collections.Counter(expected)
    assert all(r["round_trip"] for r in got) and 900 not in [r["doc_id"] for r in got] and [r["doc_id"] for r in got].count(5) == 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_items", "personal_data", "tokens"]
    read = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, f"file://{tmp_path}").columns == read.columns
    read_one = read.where("doc_id = 901")
    red = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, read_one, f"file://{tmp_path}").collect()}
    assert red[901]["text"].startswith("mail me at <EMAIL>, ") and red[901]["n_chars"] == len(red[901]["text"])
    empty = read.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
