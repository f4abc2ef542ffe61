"""Repeated passages: suffixes of all texts in prefix-partitioned suffix trees, and texts without their repeats.

A window is WINDOW consecutive words of one text; every window is a suffix of its text, looked at to that depth. The
suffixes of all texts are dealt by their prefixes: repartitionByRange cuts the order of suffixes at sampled bounds, and a
bound is a prefix as long as it takes (some words where a prefix is rare, a whole window and a place in the corpus where a
passage is in a third of all texts), so that each group has about GROUP suffixes. A group's tree is held as an enhanced
suffix array: its leaves in order, and the common prefix of neighbours. The intervals of leaves with WINDOW words in common
are the internal nodes of that depth; of a node's leaves all but the earliest are repeats. Neighbouring repeats of a text
are joined: the spans are its parts of maximal repeats. Groups are read leaf by leaf and take no memory; where a node goes
on from one group to the next, the groups' first and last leaves are compared.

A suffix travels as 128 bits: 32 of its first EDGE words, 32 of twice as many, 64 of all its words, all from 64-bit hashes
of words; suffixes that differ anywhere differ in the last 64 but for one in 2 ** 64.

Two things go before. Of texts with the same words in the same order only the earliest has suffixes: all of WINDOW words
or more in the others are repeats. And a window of which the gram of ANCHOR words with the smallest hash (which depends on
the window's words alone) occurs once in the corpus is no repeat; windows that share that gram are one row meanwhile.

Defined results: earlier is in the order of ids, null ids last; rows with one id are different documents, in the order of
xxhash64 of their texts; of rows alike in both any one is the first. A null text is an empty one; texts of under WINDOW
words have no window. Ids may be of any type with an order. Columns of the input with the names of the result's columns
are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, map_texts, parts_for
from .text import blocks, complete, grams, mix, order_hashes, utf8, words

WINDOW = 20
EDGE = 7
ANCHOR = 10
#: Suffixes of a group.
GROUP = 400_000
_SUM = np.uint64(0x9FB21C651E98DF25)


def runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: index of the first window, number of windows, hash of the anchor."""
    ok = complete(first, WINDOW)
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g = grams(hashes, ANCHOR)
    index = np.uint64((1 << len(g).bit_length()) - 1)
    least = (g & ~index) | np.arange(len(g), dtype=np.uint64)
    span, need = 1, WINDOW - ANCHOR + 1
    while span < need:
        step = min(span, need - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & index).astype(np.int64)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    ends = ok.copy()
    ends[:-1] &= ~ok[1:] | new[1:]
    return at, np.flatnonzero(ends) + 1 - at, g[anchor[at]]


def suffixes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of the windows that begin at some words: those of EDGE and 2 * EDGE words, and those of all words."""
    edges = grams(hashes, EDGE)
    one = edges[at]
    two = mix(one * _SUM ^ edges[at + EDGE])
    whole = mix(two * _SUM ^ edges[at + WINDOW - EDGE])
    low = np.uint64(0xFFFFFFFF)
    return (one & ~low) | (two & low), whole


def _run_rows(batches):
    names = ["gram", "row", "start", "n"]
    for whole in batches:
        for x in blocks(whole, "text"):
            w = words(*utf8(x.column("text")))
            at, n, gram = runs(w.hashes, w.first)
            text = np.searchsorted(w.first, at, "right") - 1
            rows = x.column("row").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(rows), pa.array((at - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32))], names=names)


def _suffix_rows(batches):
    """For each text and its listed runs (start, n): a row for each of their windows."""
    for whole in batches:
        for x in blocks(whole, "text"):
            w = words(*utf8(x.column("text")))
            listed = x.column("runs")
            flat = listed.flatten()
            of = np.repeat(np.arange(x.num_rows), listed.value_lengths().to_numpy())
            start, n = (flat.field(k).to_numpy() for k in range(2))
            begin = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(of, n)
            if len(of):
                a, b = suffixes(w.hashes, w.first[of] + begin)
                rows = x.column("row").to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rows), pa.array(begin.astype(np.int32))], names=["a", "b", "row", "start"])


#: Kinds of rows that a group's tree gives: repeats, its first leaf, its last leaf.
REPEAT, HEAD, TAIL = 0, 1, 2
_LEAF = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])
LEAF = "kind int, a long, b long, row long, start int"


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of neighbouring leaves: the depth in words (0, EDGE, 2 * EDGE or WINDOW) of their lowest common node."""
    deep = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return np.where(deep, WINDOW, np.where(a[1:] == a[:-1], 2 * EDGE, np.where(a[1:] >> 32 == a[:-1] >> 32, EDGE, 0)))


def _leaves(batches):
    """Repeats among the leaves of a group, which come in order; and its first and its last leaf."""

    def edge(kind: int, leaf: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((kind, *leaf), _LEAF, strict=True)], schema=_LEAF)

    last = None
    for x in batches:
        if not x.num_rows:
            continue
        a, b, row, start = (x.column(n).to_numpy() for n in ("a", "b", "row", "start"))
        if last is None:
            yield edge(HEAD, (a[0], b[0], row[0], start[0]))
            depth = np.append(0, common_words(a, b))
        else:
            depth = common_words(np.append(last[0], a), np.append(last[1], b))
        repeat = pa.array(depth == WINDOW)  # leaves of a node of that depth that are not its first
        last = a[-1], b[-1], row[-1], start[-1]
        n = int((depth == WINDOW).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, REPEAT, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), x.column("row").filter(repeat), x.column("start").filter(repeat)], schema=_LEAF)
    if last is not None:
        yield edge(TAIL, last)


def _spans(batches):
    """Starts in order of (row, start) to one row a text: its runs of neighbouring starts as (start, n)."""
    schema = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))])

    def made(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(row)))
        text = np.flatnonzero(np.append(True, row[head][1:] != row[head][:-1]))
        spans = pa.StructArray.from_arrays([pa.array(start[head].astype(np.int32)), pa.array(n.astype(np.int32))], ["start", "n"])
        return pa.RecordBatch.from_arrays([pa.array(row[head][text]), pa.ListArray.from_arrays(pa.array(np.append(text, len(head)), pa.int32()), spans)], schema=schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for x in batches:
        if not x.num_rows:
            continue
        row, start = x.column("row").to_numpy(), x.column("start").to_numpy()
        cut = int(np.searchsorted(row, row[-1]))  # the last text may go on in the next batch
        if held and row[0] != held[0][0][0]:
            yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
        if cut:
            held.append((row[:cut], start[:cut]))
            yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
        held.append((row[cut:], start[cut:]))
    if held:
        yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _sums(column: pa.Array) -> list:
    return [pa.array(h.view(np.int64)) for h in order_hashes(words(*utf8(column)))]


def _numbered(texts: DataFrame, space: Workspace) -> DataFrame:
    """(row, id, text, h1, h2) of texts (id, text): row is in the order of documents, h1 and h2 are equal for texts of the same words."""
    hashed = map_texts(texts, "text", [("h1", "bigint", pa.int64()), ("h2", "bigint", pa.int64())], _sums, 2_000_000)
    order = ["last", "id", "h", "place"]
    hashed = hashed.withColumns({"last": F.col("id").isNull(), "h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = hashed.repartitionByRange(parts_for(volume), *order).sortWithinPartitions(*order)
    return space.write("base", dealt.select(F.monotonically_increasing_id().alias("row"), "id", "text", "h1", "h2"), "zstd")


def repeats(base: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Rows of later copies (row), and of other texts (row, spans): runs (start, n) of windows that repeat an earlier one. base: as of _numbered."""
    copies = space.write("copies", base.where("h1 <> 0").groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
    again = space.write("again", base.select("row", "h1", "h2").join(copies, ["h1", "h2"]).where("row <> first").select("row"))
    found = space.write("runs", base.select("row", "text").mapInArrow(_run_rows, "gram long, row long, start int, n int"))
    # written, so that both sides of the join are dealt anew and Spark may split the rows of a gram that is in many texts
    often = space.write("often", found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    kept = found.join(often, "gram").join(again, "row", "left_anti")
    listed = space.write("listed", kept.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"), F.sum("n").alias("n")))  # of one text
    space.drop("runs", "often", "copies")
    total = listed.agg(F.sum("n")).first()[0] or 0
    groups = parts_for(total, GROUP)
    order = ["a", "b", "row", "start"]
    dealt = base.select("row", "text").join(listed.select("row", "runs"), "row").mapInArrow(_suffix_rows, "a long, b long, row long, start int")
    leaves = space.write("leaves", dealt.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(_leaves, LEAF))
    space.drop("listed")
    # a group's first leaf is a repeat if its node has begun in an earlier group: two rows a group
    head, tail = leaves.where(F.col("kind") == HEAD), leaves.where(F.col("kind") == TAIL).select("a", "b", F.struct("row", "start").alias("before"))
    goes_on = head.join(tail, ["a", "b"]).where(F.col("before") < F.struct("row", "start")).select("row", "start").distinct()
    starts = leaves.where(F.col("kind") == REPEAT).select("row", "start").union(goes_on)
    return again, starts.repartition(groups, "row").sortWithinPartitions("row", "start").mapInArrow(_spans, "row long, spans array<struct<start:int,n:int>>")


def without_repeats(texts: DataFrame, key: str = "doc_id", text: str = "text", rewrite: bool = False) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of each row of texts; with rewrite also the kept words as text."""
    space = Workspace(texts.sparkSession, "repeats")
    base = _numbered(texts.select(F.col(key).alias("id"), F.col(text).alias("text")), space)
    again, spans = repeats(base, space)
    removed = space.write("removed", spans.withColumn("copy", F.lit(False)).unionByName(again.withColumn("copy", F.lit(True)), allowMissingColumns=True))
    space.drop("leaves", "again")
    names = ["id", "n_words", "n_removed", "kept_sha256", *([text] if rewrite else [])]

    def run(batches):
        for whole in batches:
            for x in blocks(whole, "text"):
                data, at = utf8(x.column("text"))
                data = data.tobytes()
                out: list[tuple] = []
                for k, (copy, own_spans) in enumerate(zip(x.column("copy").to_pylist(), x.column("spans").to_pylist(), strict=True)):
                    own = data[at[k] : at[k + 1]].split()  # at bytes 0x20 and 0x09 to 0x0D
                    n = len(own)
                    if copy and n >= WINDOW:
                        own = []
                    elif own_spans:
                        change = np.zeros(n + 1, np.int32)
                        begin = np.array([s["start"] for s in own_spans])
                        np.add.at(change, begin, 1)
                        np.add.at(change, begin + np.array([s["n"] for s in own_spans]) + WINDOW - 1, -1)
                        own = list(compress(own, (np.cumsum(change[:-1]) <= 0).tolist()))
                    kept = b" ".join(own)
                    out.append((n, n - len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if rewrite else None))
                columns = [x.column("id"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())]
                if rewrite:
                    columns.append(pa.array([r[3] for r in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {base.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (f", `{text}` string" if rewrite else "")
    out = base.join(removed, "row", "left").select("id", "text", "spans", "copy").mapInArrow(run, schema)
    return out.withColumnRenamed("id", key)


def sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, n_words, n_removed and kept_sha256 of without_repeats(), where ids are unique and not null."""
    return rf"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM {table}),
windows AS (SELECT doc_id, place, md5(array_to_string(own[place : place + {WINDOW - 1}], ' ')) AS body FROM (SELECT doc_id, own, unnest(range(1, len(own) - {WINDOW - 2})) AS place FROM split WHERE len(own) >= {WINDOW})),
again AS (SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS turn FROM windows) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, place + back AS place FROM again, (SELECT unnest(range({WINDOW})) AS back)),
single AS (SELECT doc_id, unnest(own) AS word, unnest(range(1, len(own) + 1)) AS place FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body FROM single ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(own) AS n_words, len(own) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""
