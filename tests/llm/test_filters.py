"""URL filter, language identification and quality rules."""

import collections
import random
import re

import numpy as np
import pytest

from quern.llm import language_id, quality, url_filter

URLS = [
    "http://a.example.org/es/1", "https://example.org/en/12", "http://www.example.com/fr/x?y=1", "http://example.com/de/", "http://EXAMPLE.ORG/en/2#z", "http://x.net/en/1",
    "http://notexample.org/es/", "http://org/", "http://b.org", "no scheme example.org/es/", "", None, "://", "http://a.com/fr", "http://a.com/fr/", "ftp://u:p@h.org:80/a://b", "http://x.net/en/1",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    many = URLS + [f"http://site{i}.org/page/{i}" for i in range(40)] + [f"http://shop{i}.com/de/{i}?ref=x" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(many)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(many)
    says = {r: v for v, r in url_filter.RULES}
    for i, u in enumerate(many):
        host, path, rule = by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == says[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert got[URLS.index(None)]["verdict"] == "block"
    new = spark.createDataFrame([(1, "http://shop77.net/de/5?ref=x"), (2, "http://site99.net/page/99")], "page_id long, url string")
    both = url_filter.filter_urls(pages.select("page_id", "url").union(new.selectExpr("page_id + 1000", "url")))
    unruled = {r["page_id"]: r["score"] for r in both.where("page_id > 1000").collect()}
    assert unruled[1001] < unruled[1002]


def test_markov_probabilities_add_up(spark):
    grams = spark.createDataFrame([("^^^a", 3, 0), ("^^^b", 1, 2), ("^^ab", 3, 1), ("^abc", 3, 0), ("^aba", 0, 4)], "gram string, accepted long, rejected long")
    got = {r["gram"]: r["ratio"] for r in url_filter.markov_ratio(grams).collect()}
    assert set(got) == {"^^^a", "^^^b", "^^ab", "^abc", "^aba"}
    assert got["^abc"] > 0 > got["^aba"]


def test_urls_without_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages).count() == 0
    alike = spark.createDataFrame([(1, "http://q.net/1"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.filter_urls(alike).collect()} == {"allow", "block"}


def test_language(docs, rows, nothing):
    got = {r["doc_id"]: r for r in language_id.identify(docs, docs, spans=True).collect()}
    assert len(got) == len(rows)
    wrong = 0
    for doc_id, text, lang, *_ in rows:
        r = got[doc_id]
        assert 0 <= r["score"] <= 1 and r["source"] == dict((x[0], x[3]) for x in rows)[doc_id]
        if not text or not re.search(r"[^\W\d_]", text):
            assert r["lang_pred"] == "und" and r["score"] == 0 and not r["spans"]
        elif lang and len(text) > 60:
            wrong += r["lang_pred"] != lang
        for s in r["spans"]:
            assert text[s["start"]].isalpha() and text[s["end"] - 1].isalpha()
    assert wrong == 0
    assert language_id.identify(nothing, docs).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_letters_of_a_script_that_was_not_learned(spark, docs):
    texts = [(1, "Привет мир"), (2, "123 !?"), (3, None), (4, "Привет hello мир")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string"), docs).collect()}
    assert got[1] == ("de", 0.0) and got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and 0 < got[4][1] < 0.5


def test_every_label_is_learned(spark):
    rng = random.Random(17)
    rows, names = [], [f"l{k:02}" for k in range(70)]
    for k, name in enumerate(names):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)]
        rows += [(len(rows) + j, " ".join(rng.choice(own) for _ in range(40)), name) for j in range(4 if k < 64 else 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(frame.drop("lang"), frame).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: name for i, _, name in rows}
    assert [language_id.table_bits(n) for n in (0, 4, 64, 65, 128, 129, 5000)] == [16, 16, 16, 15, 15, 14, 10]


def test_mixed_text_gets_spans(spark, docs, rows):
    en, de = rows[2][1].strip(), rows[16][1].strip()
    mixed = spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string")
    (r,) = language_id.identify(mixed, docs, spans=True).collect()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"]
    assert abs(r["spans"][1]["start"] - len(en)) < 25


def test_long_text_in_pieces_is_labelled_alike(monkeypatch, docs, rows):
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, docs).collect()}
    model = language_id._fit(docs.where("lang is not null and text is not null"), "text", "lang", ["de", "en", "fr"])
    import pyarrow as pa

    monkeypatch.setattr(language_id, "PIECE_BYTES", 500)
    got = language_id._label(pa.array([r[1] for r in rows], pa.string()), model, ["de", "en", "fr"], False)
    assert [(a, b) for a, b in zip(*got, strict=True)] == [whole[r[0]] for r in rows]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 4, 9, 10])
    scores = rng.normal(size=(10, 3)).astype(np.float32) * 3
    got = language_id.viterbi(scores, first, 2.0)
    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(path, a=a):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        best = max(value(p) for p in itertools.product(range(3), repeat=int(b - a)))
        assert value(got[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def statistics_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = [False] * len(words)
    for k in range(len(words) - 4):
        if grams[tuple(words[k : k + 5])] > 1:
            marked[k : k + 5] = [True] * 5
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(marked)


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(r[0], 0 if (r[1] or "").count("same line") else 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        expected = statistics_by_hand(text)
        r = got[doc_id]
        assert tuple(r[c] for c in quality.BASE) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(nothing, labels).count() == 0
    none = quality.judge(docs, labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def test_limit_bears_wrong_labels():
    rng = np.random.default_rng(2)
    score = np.concatenate([rng.normal(2, 0.5, 900), rng.normal(-2, 0.5, 100)])
    y = np.r_[np.ones(900), np.zeros(100)]
    y[:9] = 0
    y[-5:] = 1
    assert -1.5 < quality.best_limit(score, y) < 1.5
    assert quality.best_limit(score, np.ones(1000)) == -np.inf
    every = [((score[y == 1] >= t).mean() + (score[y == 0] < t).mean(), -t) for t in [*np.unique(score), -np.inf]]
    assert quality.best_limit(score, y) == -max(every)[1]


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    fall = quality.STATISTICS.index("symbol_share")
    y = ((x[:, fall] < 0.5) ^ (rng.random(3000) < 0.05) ^ ((x[:, fall] > 0.8) & (rng.random(3000) < 0.5))).astype(float)
    trees = quality.Trees([quality.STATISTICS.index(s) for s in quality.FALLING]).fit(x, y)
    assert ((trees.score(x) > 0) == (x[:, fall] < 0.5)).mean() > 0.95
    line = np.repeat(x[:50, None, :], 101, 1)
    line[:, :, fall] = np.linspace(0, 1, 101)
    scores = trees.score(line.reshape(-1, x.shape[1])).reshape(50, 101)
    assert (np.diff(scores, axis=1) <= 1e-9).all()
