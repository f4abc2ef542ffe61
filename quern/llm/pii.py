"""Personal data in texts: fixed base patterns, and further spans that weakly supervised labelers agree on.

The base patterns (email, ip, card, phone) are exact and always stay. Further candidates - credentials, written-out
e-mail addresses, local telephone numbers, and number groups that a base check turned down - are put to LABELERS: each
(format, checksum, gazetteer, context for, context against) votes yes, no or abstains. Gazetteers are tables: top-level
domains, networks set aside for examples and hosts themselves, ranges of card issuers, calling codes, prefixes of issued
keys. Each candidate also has a profile of its span and neighbours (size, share of digits, mix of characters, what stands
on either side) that no labeler sees. Candidates of all texts are counted by votes and profile (at most kinds x 3 **
labelers x PROFILES patterns, so the counts are small whatever the input); expectation-maximisation (Dawid-Skene, one
confusion table a labeler and kind) estimates from the votes how reliable each labeler is; a logistic regression on votes
and profile, fitted to the posteriors, decides every candidate. A candidate inside a base span is no candidate.

Defined results: a null text is an empty one and has no spans; positions are code points, ends exclusive; texts are
scanned whole, in time linear in their length but for sorting spans. Equal spans of two kinds are two spans. Repeated rows
each get their row. Columns of the input with the names of the result's columns are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

#: Kinds in their order, patterns, and word lists.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ASSIGNED = re.compile(r"(?i)\b(token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)s?\b[\x20\t]*[=:][\x20\t]*[\"']?([A-Za-z0-9_\-+/.]{8,})")
OPAQUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}(?![A-Za-z0-9])")
WRITTEN_MAIL = re.compile(r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}[\x20]?(?:\(at\)|\[at\]|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\(dot\)|\[dot\]|[\x20]dot[\x20])[\x20]?[A-Za-z0-9-]{1,63})+")
WHOLE_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
DIGIT_GROUP = re.compile(r"[0-9]++")
LOCAL_PHONE = re.compile(r"(?<![0-9+.)-])(?<![0-9][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
CUES = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf"),
    "secret": ("token", "key", "secret", "password", "passwort", "credential", "auth"),
}
COUNTER_CUES = ("version", "isbn", "issn", "doi", "sha", "md5", "commit", "checksum", "page", "no.", "id", "total")
#: The gazetteers.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro app dev io ai co me tv cc xyz online site shop blog cloud tech "
    "ar at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr lt lu lv ma mx my nl no nz pe ph pl pt ro rs ru se sg si sk th tr tw ua uk us vn za".split()
)
#: Networks (first address, bits) that no person's host is in: this host, loopback, link-local, examples, multicast and reserved.
SET_ASIDE = (("0.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
#: Ranges of the first digits of card numbers by issuers, and how long these are.
ISSUERS = (
    ("4", "4", (16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14, 16)), ("36", "36", (14, 16)), ("38", "39", (14, 16)),
    ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)), ("3528", "3589", (16, 19)), ("62", "62", (16, 17, 18, 19)), ("5018", "5018", (16,)), ("6304", "6304", (16, 18, 19)),
)
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 225 233 234 237 251 254 255 256 260 263 "
    "350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 387 389 420 421 423 502 503 506 507 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 977 994 995 998".split()
)
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "SG.", "eyJ", "ya29.", "npm_", "hf_", "tok_", "key-")
LABELERS = ("format", "checksum", "gazetteer", "context", "counter")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping; both classes lack the @, so each match is found from its @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        begin = at
        if m:
            while begin > last and text[begin - 1] in LOCAL:
                begin -= 1
        if begin < at:
            out.append((begin, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's number, end) of all matches that pass their checks, and of those that fail."""
    found, failed = [(a, 0, b) for a, b in _emails(text)], []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = (p.lstrip("0") for p in m.group().split("."))
            (found if all(len(p) < 4 and int(p or 0) <= 255 for p in parts) else failed).append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = NOT_DIGIT.sub("", m.group())
                (found if 14 <= len(d) <= 19 and luhn(d) else failed).append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            (found if 10 <= sum(map(m.group().count, "0123456789")) <= 15 else failed).append((m.start(), 3, m.end()))
    found.sort()
    return found, failed


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _number_of(address: str) -> int:
    out = 0
    for part in address.split("."):
        out = out * 256 + int(part)
    return out


_ASIDE = tuple((_number_of(a) >> (32 - bits), 32 - bits) for a, bits in SET_ASIDE)


def _listed(name: str, span: str) -> int:
    """The gazetteer's vote."""
    if name == "card":
        digits = NOT_DIGIT.sub("", span)
        return 1 if any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in ISSUERS) else -1
    if name == "ip":
        parts = span.split(".")
        if not all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts):
            return -1
        number = _number_of(span)
        return -1 if any(number >> shift == first for first, shift in _ASIDE) else 1
    if name == "phone":
        if not span.startswith("+"):
            return 0
        digits = NOT_DIGIT.sub("", span[:8])
        return 1 if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else -1
    if name == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower() in TOP_DOMAINS else -1
    return 1 if span.startswith(KEY_PREFIXES) else 0


def _checked(name: str, span: str, kept: bool) -> int:
    """The checksum labeler's vote: what a span's own characters prove or refute."""
    if name == "card":
        digits = NOT_DIGIT.sub("", span)
        return 1 if 14 <= len(digits) <= 19 and luhn(digits) else -1
    if name == "ip":
        return 1 if kept else -1
    if name == "phone":
        return 1 if 10 <= sum(map(span.count, "0123456789")) <= 15 else -1
    if name == "email":
        return 1 if re.search(r"[A-Za-z]", span) else -1
    return 1 if DIGIT.search(span) and re.search(r"[A-Za-z]", span) and _entropy(span) >= 3.0 else -1


def _votes(text: str, kind: int, begin: int, end: int, strict: bool, kept: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 yes, -1 no, 0 abstains."""
    span, name = text[begin:end], KINDS[kind]
    before = text[max(0, begin - 32) : begin].lower()
    context = 1 if any(c in before for c in CUES[name]) else 0
    counter = -1 if any(c in before for c in COUNTER_CUES) else 0
    return (1 if strict else -1, _checked(name, span, kept), _listed(name, span), context, counter)


#: Values that each place of a profile may have.
PROFILE = (6, 4, 4, 4, 4)
PROFILES = math.prod(PROFILE)


def _beside(c: str) -> int:
    """The text's edge or a blank, a letter or digit, a bracket or quote, anything else."""
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "()[]{}<>\"'" else 3


def _profile(text: str, begin: int, end: int) -> str:
    """What a span and its neighbours look like, a digit a place."""
    span = text[begin:end]
    n = end - begin
    digits = sum(map(span.count, "0123456789"))
    size = min(5, max(0, n.bit_length() - 3))
    kinds = bool(digits) + any("a" <= c <= "z" for c in span) + any("A" <= c <= "Z" for c in span)
    return f"{size}{min(3, 4 * digits // n)}{kinds}{_beside(text[begin - 1 : begin])}{_beside(text[end : end + 1])}"


def _pattern(text: str, kind: int, begin: int, end: int, votes: tuple[int, ...]) -> str:
    return f"{kind}:{''.join('-0+'[v + 1] for v in votes)}:{_profile(text, begin, end)}"


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, tuple[int, ...]]]]:
    """The base spans, and the further candidates with their votes."""
    found, failed = base_spans(text)
    seen: dict[tuple[int, int, int], bool] = {}
    for begin, kind, end in failed:
        seen[(begin, kind, end)] = False
        if kind == 2:  # neighbouring numbers that the base pattern ran together
            for m in DIGIT_GROUP.finditer(text, begin, end):
                if 14 <= m.end() - m.start() <= 19 and m.span() != (begin, end):
                    seen[(m.start(), 2, m.end())] = True
        elif kind == 3 and (m := WHOLE_PHONE.match(text, begin, end)) and m.end() < end:
            seen[(begin, 3, m.end())] = True
    for m in ASSIGNED.finditer(text):
        seen[(m.start(2), 4, m.end(2))] = True
    for m in OPAQUE.finditer(text):
        seen.setdefault((m.start(), 4, m.end()), False)
    if "at" in text or "AT" in text:
        if "dot" in text or "DOT" in text or "Dot" in text:
            for m in WRITTEN_MAIL.finditer(text):
                seen[(m.start(), 0, m.end())] = True
    for m in LOCAL_PHONE.finditer(text):
        seen[(m.start(), 3, m.end())] = True
    if not seen:
        return found, []
    starts, reach, furthest = [a for a, _, _ in found], [], 0
    for _, _, b in found:
        furthest = max(furthest, b)
        reach.append(furthest)  # where the base spans up to this one end at the latest
    out = []
    for (begin, kind, end), strict in sorted(seen.items()):
        before = bisect_right(starts, begin)
        if not before or reach[before - 1] < end:
            out.append((begin, kind, end, _votes(text, kind, begin, end, strict, False)))
    return found, out


def _patterns(text: str) -> list[str]:
    found, more = candidates(text)
    rows = [(a, k, b, (1, *_votes(text, k, a, b, True, True)[1:])) for a, k, b in found] + more
    return [_pattern(text, kind, a, b, votes) for a, kind, b, votes in rows]


def reliabilities(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """For each kind and row of votes the probability that it stands for personal data, by expectation-maximisation."""
    voted: Counter[str] = Counter()
    for pattern, count in counts.items():
        voted[pattern.rpartition(":")[0]] += count
    posterior = {}
    for kind in sorted({p.split(":")[0] for p in voted}):
        mine = sorted(p for p in voted if p.startswith(kind + ":"))
        votes = np.array([["-0+".index(c) for c in p.split(":")[1]] for p in mine])
        n = np.array([voted[p] for p in mine], float)
        z = np.where((votes - 1).sum(1) > 0, 0.9, 0.1)
        for _ in range(rounds):
            prior = np.clip((n * z).sum() / n.sum(), 0.01, 0.99)
            log = np.stack([np.full(len(mine), math.log(prior)), np.full(len(mine), math.log(1 - prior))])
            for j in range(votes.shape[1]):
                for c, w in enumerate((z, 1 - z)):
                    table = np.bincount(votes[:, j], n * w, 3) + 0.5
                    table[2 if c == 0 else 0] += 1  # labelers are taken to be better than chance
                    log[c] += np.log(table / table.sum())[votes[:, j]]
            z = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        posterior |= dict(zip(mine, z.tolist(), strict=True))
    return posterior


_FIRST_VOTE = 1 + len(KINDS)
_FIRST_PROFILE = _FIRST_VOTE + 3 * len(LABELERS)
_SIZE = _FIRST_PROFILE + sum(PROFILE)


def _features(pattern: str) -> np.ndarray:
    kind, votes, profile = pattern.split(":")
    x = np.zeros(_SIZE)
    x[0] = x[1 + int(kind)] = 1
    for j, v in enumerate(votes):
        x[_FIRST_VOTE + 3 * j + "-0+".index(v)] = 1
    at = _FIRST_PROFILE
    for width, v in zip(PROFILE, profile, strict=True):
        x[at + int(v)] = 1
        at += width
    return x


def train(counts: dict[str, int], rounds: int = 50) -> np.ndarray:
    """Weights of the span classifier, fitted to the posteriors by penalised Newton steps; patterns count by the root of their number."""
    weights = np.zeros(_SIZE)
    if not counts:
        return weights
    target = reliabilities(counts)
    names = sorted(counts)
    x, y = np.array([_features(p) for p in names]), np.array([target[p.rpartition(":")[0]] for p in names])
    n = np.sqrt(np.array([counts[p] for p in names], float))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 0.1 * weights
        hessian = (x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(_SIZE)
        step = np.linalg.solve(hessian, gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def spans(text: str, weights: np.ndarray, known: dict[str, bool]) -> tuple[list, list]:
    """Base spans and all spans of a text, each (start, kind's number, end) in order."""
    found, more = candidates(text)
    extra = []
    for begin, kind, end, votes in more:
        pattern = _pattern(text, kind, begin, end, votes)
        if pattern not in known:
            known[pattern] = bool(_features(pattern) @ weights > 0)
        if known[pattern]:
            extra.append((begin, kind, end))
    return found, sorted(found + extra)


def _text_of(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list) -> str:
    out, last = [], 0
    for a, k, b in found:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def fit(texts: DataFrame, text: str = "text") -> np.ndarray:
    """The classifier, from the vote patterns of all texts."""

    def count(batches):
        total: Counter[str] = Counter()
        for x in batches:
            for t in x.column(0).to_pylist():
                if t:
                    total.update(_patterns(t))
        yield pa.RecordBatch.from_pydict({"pattern": list(total), "n": list(total.values())}, schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return train({r["pattern"]: r["n"] for r in counted.collect()})  # at most kinds x 3 ** labelers x PROFILES rows


def find(texts: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """texts with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    weights = fit(texts, text)
    fields = [*((f"n_{k}", "bigint", pa.int64()) for k in KINDS[:4]), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string())]

    def compute(column: pa.Array) -> list:
        known: dict[str, bool] = {}
        out: list[list] = [[] for _ in fields]
        for t in column.to_pylist():
            base, everything = spans(t or "", weights, known)
            kinds = [k for _, k, _ in base]
            row = [*(kinds.count(k) for k in range(4)), hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(everything)]
            for values, v in zip(out, row, strict=True):
                values.append(v)
        return out

    return map_texts(texts, text, fields, compute, 4_000_000, drop)


def redact_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts whose spans have given way to the names of their kinds, like <EMAIL>; nulls stay."""
    weights = fit(texts, text)

    def compute(column: pa.Array) -> list:
        known: dict[str, bool] = {}
        return [[t if t is None else redacted(t, spans(t, weights, known)[1]) for t in column.to_pylist()]]

    return map_texts(texts, text, [(text, "string", pa.string())], compute, 4_000_000).select(*[f"`{c}`" for c in texts.columns])
