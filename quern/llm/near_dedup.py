"""Near duplicates of texts: ProbMinHash signatures, banding, verification, and classes of linked texts.

A text is a bag of shingles of five words (a shorter text with a word is one shingle), each weighted by how often it
occurs. For every shingle a Poisson process whose rate is the weight deals arrivals to REGISTERS registers; a register
keeps the shingle that arrives first. Two texts agree in a register with the probability Jaccard similarity of their
bags. A text's processes end as soon as their next arrival is later than all that its registers hold.

Rows are numbered once, in a written table, and all steps go by that number: ids may be null, repeated, or of any type with
an order. Rows with the same words in the same order are copies and are treated as one text. BANDS bands of ROWS registers
propose pairs: a pair of similarity 0.8 meets in at least one band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS =
0.999993. A pair is a link if the exact probability Jaccard of its bags is 0.8 or more; pairs whose registers agree in
under PRESELECT of all cases are not computed exactly, which loses a link of similarity 0.8 with a probability of some
10 ** -7 (over five standard errors).

Not all pairs of a bucket are looked at. In each round a text is compared with one other: of all its buckets' leaders the
most central. Central is a text that is in large buckets (the sum of their sizes): of the copies of a text, each with edits
of its own, that is the one with the fewest, which others are alike to even where they are not alike to each other. From
the second round on only buckets that still hold texts of several classes matter, the order of leaders is shaken by a hash
of the round, and texts of the leader's class meet a text of another class. Linked texts become one class. So n copies of a
text cost n comparisons a round. Last, the pairs of texts of different classes that still share a
bucket are compared inside tasks, block by block of at most BLOCK texts (and BLOCK_BYTES) against as many: signatures first,
and texts only for those that agree with any; only links become rows. No other pair that banding proposes is lost.

Buckets of any size are dealt with their size at hand: their members are spread over parts of SPREAD for each join.

Defined results: a text that is null or has no word is in a class of its own. The class id is the smallest id of the class,
null if no row of it has one; where ids are repeated classes may share their class id. Columns of the result replace those
of the input; repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, map_texts
from .text import blocks, complete, grams, mix, order_hashes, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
PRESELECT = 0.63


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: text index, hash and weight of each distinct shingle (in order of texts), and two hashes of each text's words (0 without any)."""
    w = words(*utf8(column))
    n = len(w.first) - 1
    count = np.diff(w.first)
    text = w.texts
    g = grams(w.hashes, SHINGLE)
    ok = complete(w.first, SHINGLE)
    h, t = g[ok], text[: len(g)][ok]
    sums = order_hashes(w)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        h, t = np.concatenate([h, mix(sums[0][short])]), np.concatenate([t, short])
    key = mix(h + t.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, at, weight = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(t[at], kind="stable")
    return t[at][order], h[at][order], weight[order], sums[0], sums[1]


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """For each of n texts the 32-bit fingerprints that its registers hold; 0 without shingles."""
    low = np.uint64(0xFFFFFFFF)
    held = np.full((n, registers), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = held.reshape(-1)
    mark = mix(shingle + np.uint64(0x51ED270B))  # fingerprints
    mark = np.maximum(mark & low, np.uint64(1))
    when = np.zeros(len(shingle))
    rate = 1.0 / weight
    latest = np.full(n, np.inf)
    turn, look = 0, 1
    while len(shingle):
        turn += 1
        x = mix(shingle + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        when = when - np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) * rate
        register = ((mix(x) & low) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        packed = (when.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | mark
        np.minimum.at(flat, text * registers + register, packed)
        if turn >= look:  # the processes of a text end once no register can change
            look = max(turn + 1, turn * 5 // 4)
            busy = np.unique(text)
            worst = held[busy].max(1)
            full = (worst >> np.uint64(32)).astype(np.uint32)
            latest[busy] = np.where(worst == np.uint64(0xFFFFFFFFFFFFFFFF), np.inf, full.view(np.float32))
            on = when <= latest[text] * (1 + 1e-6)
            text, shingle, mark, when, rate = text[on], shingle[on], mark[on], when[on], rate[on]
    out = (held & low).astype(np.uint32)
    out[held == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
    return out


def _sign(column: pa.Array) -> list:
    text, shingle, weight, k1, k2 = bags(column)
    n = len(column)
    held = signatures(text, shingle, weight, n)
    bucket = np.zeros((n, BANDS), np.uint64)
    bands = held.reshape(n, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        bucket = mix(bucket * np.uint64(0x9FB21C651E98DF25) + bands[:, :, r] + np.arange(BANDS, dtype=np.uint64))
    some = k1 > 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(some, BANDS, 0))), pa.int32()), pa.array(bucket[some].reshape(-1).view(np.int64)))
    small = np.ascontiguousarray((held ^ (held >> np.uint32(16))).astype(np.uint16))
    return [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([row.tobytes() for row in small], pa.binary()), lists]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags given as (sorted distinct hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    ratio = np.sort(wa[i] / wb[j])  # of the shared shingles; for the others the ratio is infinite or 0
    wa, wb = wa[i][np.argsort(wa[i] / wb[j])], wb[j][np.argsort(wa[i] / wb[j])]
    alone_a, alone_b = float(a[1].sum() - wa.sum()), float(b[1].sum() - wb.sum())
    # for shared shingle d: sum over e of max(a_e / a_d, b_e / b_d); a_e / a_d is the larger one where ratio_e > ratio_d
    upto_b, from_a = np.cumsum(wb), np.cumsum(wa[::-1])[::-1]
    k = np.searchsorted(ratio, ratio, "right")
    sums = (alone_a + np.append(from_a, 0)[k]) / wa + (alone_b + upto_b[k - 1]) / wb
    return float((1.0 / sums).sum())


#: Rounds of comparing each text of an open bucket with one leader, before the blocks.
ROUNDS = 2
#: Members of a bucket, and bytes of their texts, that one task compares with each other or with as many others.
BLOCK = 2048
BLOCK_BYTES = 8_000_000
#: Members of a bucket that go to one task of a join.
SPREAD = 5_000


def _agreement(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers agree often enough."""

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(x.column(n).to_pylist()), np.uint16).reshape(x.num_rows, REGISTERS) for n in ("p", "q"))
            keep = (p == q).mean(1) >= PRESELECT
            yield pa.RecordBatch.from_arrays([x.column(n).filter(pa.array(keep)) for n in ("a", "b")], names=["a", "b"])

    both = pairs.join(signed.select(F.col("node").alias("a"), F.col("sig").alias("p")), "a").join(signed.select(F.col("node").alias("b"), F.col("sig").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _split(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    text, shingle, weight, _, _ = bags(column)
    first = np.searchsorted(text, np.arange(len(column) + 1))
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        order = np.argsort(shingle[i:j])
        out.append((shingle[i:j][order], weight[i:j][order]))
    return out


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose exact similarity reaches SIMILARITY."""

    def run(batches):
        for whole in batches:
            for x in blocks(whole, "p", 1_000_000):
                left, right = _split(x.column(2)), _split(x.column(3))
                keep = np.array([probability_jaccard(p, q) >= SIMILARITY - 1e-9 for p, q in zip(left, right, strict=True)], bool)
                yield pa.RecordBatch.from_arrays([x.column(n).filter(pa.array(keep)) for n in ("a", "b")], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("q")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("p")), "a")
    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def components(space: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of all nodes on an edge (a, b); comp is the smallest that can be reached. Tables are named after `name`."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = space.write(f"{name}_0", nodes.withColumn("comp", F.col("node")))
    turn = 0
    while True:
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("u")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("v")), "b")
        apart = space.write(f"{name}_apart", ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if apart.isEmpty():
            space.drop(f"{name}_apart")
            return labels
        up = apart.groupBy("u").agg(F.min("v").alias("v"))
        up2 = up.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select(F.col("u").alias("comp"), F.coalesce("w", "v").alias("better"))
        turn += 1
        labels = space.write(f"{name}_{turn}", labels.join(up2, "comp", "left").select("node", F.coalesce("better", "comp").alias("comp")))
        space.drop(f"{name}_apart", f"{name}_{turn - 1}")


def _met(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Members (bucket, node, n, size, central) of buckets with texts of several classes, with the leader that each meets there and its weight, and the bucket's present members and bytes."""
    own = members if labels is None else members.join(labels, "node", "left")
    known = own.select("bucket", "node", "n", "size", "central", (F.col("node") if labels is None else F.coalesce("comp", "node")).alias("comp"))
    chance = 1.0 if labels is None else 0.5 + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / (2 << 20)
    weighed = known.withColumn("weight", F.col("central") * chance)
    by_weight = F.struct("weight", "comp", "node")
    by_class = F.struct(F.xxhash64("comp", F.lit(turn)).alias("h"), "weight", "comp", "node")
    leaders = F.max(by_weight).alias("first"), F.min(by_class).alias("low"), F.max(by_class).alias("high")
    mixed = weighed.groupBy("bucket").agg(*leaders, F.max("n").alias("n"), F.count("*").alias("now"), F.sum("size").alias("bytes")).where("low.comp <> high.comp")
    spread = mixed.select("bucket", "first", "low", "high", "now", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPREAD).cast("int"))).alias("salt"))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.floor((F.col("n") - 1) / SPREAD) + 1).cast("int"))
    pick = lambda name: F.coalesce(*[F.when(F.col("comp") != F.col(k)["comp"], F.col(k)[name]) for k in ("first", "low", "high")]).alias(name if name == "weight" else "leader")
    return salted.join(spread, ["bucket", "salt"]).select("bucket", known["node"], known["n"], "size", "central", "comp", "now", "bytes", pick("weight"), pick("node"))


_BLOCK = ["bucket", "low", "high", "part", "node", "comp"]


def _agreeing(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block of one bucket's texts, and the places of its pairs (i, j) of different classes whose registers agree; each pair is looked at in the first bucket it shares."""
    table = table.combine_chunks()
    nodes, comp, part = (table[n].to_numpy() for n in ("node", "comp", "part"))
    low, high, bucket = (table[n][0].as_py() for n in ("low", "high", "bucket"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(nodes), REGISTERS)
    own = table["buckets"].combine_chunks().flatten().to_numpy().reshape(len(nodes), BANDS)
    rights = np.flatnonzero(part == high)
    lefts: list[np.ndarray] = []
    found: list[np.ndarray] = []
    for i in np.flatnonzero(part == low).tolist():
        js = rights[((nodes[rights] > nodes[i]) | (low != high)) & (comp[rights] != comp[i])]
        js = js[own[i][(own[js] == own[i]).argmax(1)] == bucket]
        js = js[(sig[js] == sig[i]).mean(1) >= PRESELECT]
        lefts.append(np.full(len(js), i))
        found.append(js)
    none = [np.empty(0, np.int64)]
    return table, np.concatenate(lefts + none), np.concatenate(found + none)


def _some_agree(table: pa.Table) -> pa.Table:
    """The texts of a block that agree with any other of it."""
    table, i, j = _agreeing(table)
    return table.select(_BLOCK).take(pa.array(np.unique(np.concatenate([i, j]))))


def _links_in_block(table: pa.Table) -> pa.Table:
    """Links between the texts of a block."""
    table, left, right = _agreeing(table)
    nodes = table["node"].to_numpy()
    bag = [x for whole in table.select(["text"]).to_batches() for y in blocks(whole, "text", 1_000_000) for x in _split(y.column(0))]
    at = np.append(0, np.cumsum([len(h) for h, _ in bag]))
    kinds, code = np.unique(np.concatenate([h for h, _ in bag]), return_inverse=True)
    size = np.diff(at)
    plain = np.array([w.max(initial=1) == 1 for _, w in bag])
    mark = np.zeros(len(kinds), np.int8)
    out: list[tuple[int, int]] = []
    for i in np.unique(left).tolist():
        js = right[left == i]
        mark[code[at[i] : at[i + 1]]] = 1
        common = np.add.reduceat(mark[np.concatenate([code[at[j] : at[j + 1]] for j in js])], np.append(0, np.cumsum(size[js])[:-1]), dtype=np.int64)
        mark[code[at[i] : at[i + 1]]] = 0
        alike = common / (size[i] + size[js] - common)  # right where no shingle of either text has a weight over 1
        for j, same in zip(js.tolist(), alike.tolist(), strict=True):
            if not (plain[i] and plain[j]):
                same = probability_jaccard(bag[i], bag[j])
            if same >= SIMILARITY - 1e-9:
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _blocked(met: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of different classes that share a bucket, found in blocks of a bucket's members."""
    parts = F.greatest(F.ceil(F.col("now") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    kinds = "bucket long, low int, high int, part int, node long, comp long"
    some = dealt.select(*_BLOCK).join(signed, "node").select(*_BLOCK, "sig", "buckets").groupBy("bucket", "low", "high").applyInArrow(_some_agree, kinds)
    whole = some.join(signed, "node").join(texts, "node").select(*_BLOCK, "sig", "buckets", "text")
    return whole.groupBy("bucket", "low", "high").applyInArrow(_links_in_block, "a long, b long").distinct()


def _classed(base: DataFrame, space: Workspace) -> DataFrame:
    """(row, comp) of base (row, text): the class of each row, named by one of its rows."""
    fields = [("k1", "bigint", pa.int64()), ("k2", "bigint", pa.int64()), ("sig", "binary", pa.binary()), ("buckets", "array<bigint>", pa.list_(pa.int64()))]
    sized = base.select("row", "text", F.octet_length("text").alias("size"))
    signed = space.write("signed", map_texts(sized, "text", fields, _sign, 1_000_000, ("text",)))
    some = signed.where("k1 <> 0")
    copies = space.write("copies", some.groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first"))
    firsts = some.join(copies, ["k1", "k2"], "left").where("first is null or row = first").select(F.col("row").alias("node"), "size", "sig", "buckets")
    chosen = space.write("chosen", firsts)
    bands = chosen.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met_in = bands.join(shared, "bucket").select("bucket", "node", "n", "size")
    paired = space.write("paired", met_in)
    central = paired.groupBy("node").agg(F.sum("n").alias("central"))
    members = space.write("members", paired.join(central, "node").select("bucket", "node", "n", "size", "central"))
    space.drop("paired")
    # joins of wide rows that grow with the corpus are dealt by key at any size
    candidates = members.select("node").distinct().hint("merge")
    sigs = space.write("sigs", chosen.join(candidates, "node", "left_semi").select("node", "sig", "buckets"))
    space.drop("chosen")
    texts = space.write("texts", base.select(F.col("row").alias("node"), "text").join(candidates, "node", "left_semi"), "zstd")

    edges, labels = None, None
    met = space.write("met_0", _met(members, None, 0))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = met.groupBy("node").agg(F.max(F.struct("weight", "leader")).alias("l")).select("node", "l.leader")
            ordered = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
            found = space.write(f"links_{turn}", _links(_agreement(ordered, sigs), texts))
        else:
            found = space.write(f"links_{turn}", _blocked(met, sigs, texts))
        edges = found if edges is None else edges.union(found)
        if labels is None or not found.isEmpty():
            labels = components(space, edges, f"labels_{turn}")
        if turn < ROUNDS:
            met = space.write(f"met_{turn + 1}", _met(met.select("bucket", "node", "n", "size", "central"), labels, turn + 1))
            space.drop(f"met_{turn}")
            if met.isEmpty():
                break
    space.drop("texts", "sigs", "members")
    out = signed.select("row", "k1", "k2").join(copies, ["k1", "k2"], "left").select("row", F.coalesce("first", "row").alias("node"))
    return out.join(labels, "node", "left").select("row", F.coalesce("comp", "node").alias("comp"))


def _numbered(texts: DataFrame, space: Workspace) -> DataFrame:
    """texts with its columns as c0, c1 and so on, and each row's number."""
    return space.write("base", texts.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(texts.columns)]), "zstd")


def near_duplicate_classes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id): one row for each row of texts."""
    space = Workspace(texts.sparkSession, "near")
    base = _numbered(texts.select(key, text), space)
    classed = space.write("classed", _classed(base.select("row", F.col("c1").alias("text")), space).join(base.select("row", F.col("c0").alias("id")), "row"))
    # written, so that both sides of the join are dealt anew and Spark may split the rows of a large class
    smallest = space.write("smallest", classed.groupBy("comp").agg(F.min("id").alias("class_id")))
    return classed.join(smallest, "comp").select(F.col("id").alias(key), "class_id")


def first_of_each_class(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id (any of several), rows without an id last."""
    space = Workspace(texts.sparkSession, "firsts")
    names = texts.columns
    base = _numbered(texts, space)
    at = {c: f"c{k}" for k, c in enumerate(names)}
    classed = _classed(base.select("row", F.col(at[text]).alias("text")), space).join(base.select("row", F.col(at[key]).alias("id")), "row")
    first = classed.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("f")).select("f.row")
    kept = space.write("first", first)
    return base.join(kept.hint("merge"), "row", "left_semi").select(*[F.col(at[c]).alias(c) for c in names])


def sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id and class_id of near_duplicate_classes(), where ids are unique and not null. Pairs whose shared shingles have a mass under SIMILARITY in either text cannot be links."""
    least = SIMILARITY - 1e-9
    return rf"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM {table}),
shingles AS (SELECT doc_id, body, count(*) AS w FROM (SELECT doc_id, md5(array_to_string(own[place : place + {SHINGLE - 1}], ' ')) AS body
FROM (SELECT doc_id, own, unnest(range(1, greatest(2, len(own) - {SHINGLE - 2}))) AS place FROM split WHERE len(own) > 0)) GROUP BY 1, 2),
sizes AS (SELECT doc_id, sum(w) AS total FROM shingles GROUP BY 1),
bags AS (SELECT doc_id, body, w, w / total AS p FROM shingles JOIN sizes USING (doc_id)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM bags x JOIN bags y ON x.body = y.body AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING sum(least(x.p, y.p)) >= {least}),
both_bags AS (SELECT a, b, body, max(wa) AS wa, max(wb) AS wb FROM (SELECT a, b, body, w AS wa, 0 AS wb FROM pairs JOIN shingles ON doc_id = a UNION ALL SELECT a, b, body, 0, w FROM pairs JOIN shingles ON doc_id = b) GROUP BY 1, 2, 3),
ratios AS (SELECT a, b, wa, wb, CASE WHEN wb = 0 THEN 1e300 ELSE wa / wb END AS r FROM both_bags),
sums AS (SELECT a, b, wa, wb, sum(wa) OVER (PARTITION BY a, b) - sum(wa) OVER upto AS more, sum(wb) OVER upto AS less FROM ratios WINDOW upto AS (PARTITION BY a, b ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
links AS (SELECT a, b FROM sums WHERE wa > 0 AND wb > 0 GROUP BY 1, 2 HAVING sum(1 / (more / wa + less / wb)) >= {least}),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM {table} UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT doc_id, min(other) AS class_id FROM reached GROUP BY 1"""
