import random

import pytest

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "en er ch ei sch ung lich keit ge be ver der die und nicht ein ß ü ö ä auf mit heit zu te".split(),
    "fr": "es le de ent que eau oux ai ou é è ç ê tion ment re la ier elle tre par vi an".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", ".\n"]) for w in words)


def edited(rng: random.Random, text: str, words: int) -> str:
    own = text.split(" ")
    for _ in range(words):
        own[rng.randrange(len(own))] = "changed" + str(rng.randrange(1000))
    return " ".join(own)


def corpus() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars, score, id, key): prose, copies, near copies, repeats, and odd cases; the last three clash with names in use."""
    rng = random.Random(7)
    texts = [(prose(rng, lang, rng.choice([30, 80, 200])), lang) for lang in ("en", "de", "fr") for _ in range(14)]
    base, lang = texts[0][0] + " " + texts[1][0], "en"
    texts += [(base, lang), (base, lang), (base.replace(" ", "  "), lang), (edited(rng, base, 2), lang), (edited(rng, base, 4), lang), (edited(rng, base, 40), lang)]
    passage = prose(rng, "en", 60)
    texts += [(prose(rng, "en", 15) + " " + passage + " " + prose(rng, "en", 15), "en") for _ in range(4)]
    texts += [("same line of text here\n" * 9, "en"), (" ".join(["a"] * 50), None), ("", None), (None, None), ("  \n\t ", None), ("12345 67890", None), ("x" * 5000, None)]
    texts += [(texts[2][0] + " mail ann.b@mail.example.com or +1 (523) 555-1055, from 10.20.30.40 with 4111 1111 1111 1111", "en"), ("a b c", "en"), ("中文 文字 текст", None)]
    texts += [(prose(rng, "de", 4000), "de")]
    rows = [(i, t, lang, f"src{i % 3}", len(t or ""), 1.5, "x", None) for i, (t, lang) in enumerate(texts)]
    rows.append((None, prose(rng, "en", 40), "en", None, None, None, None, None))
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, key string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
