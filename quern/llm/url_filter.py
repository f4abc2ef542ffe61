"""URL filter: written rules first, then a ratio of two character language models. DataFrame functions only.

Two variable-order Markov models, one of the URLs that a rule accepts and one of those that a rule rejects, give every
character a probability after up to ORDER characters before it: Witten-Bell weights join each context to the next shorter
one, and contexts seen fewer than MIN_CONTEXT times are left out, so the order in use varies from place to place. A URL's
score is the mean over its characters of the log ratio. Three in sixteen URLs with a rule (by the first digit of their md5)
take no part in the counts; the threshold that best separates their two classes (Youden's J over hundredths of a nat) decides the URLs that no rule fits.

URLs are lower-cased and spelt in 42 symbols (digits are one symbol, rare characters another), so the models have at
most 42 ** 4 rows (3.1 million of some 80 bytes) whatever the input, which is why their table may be broadcast. Counts are
taken over all distinct URLs.

Defined results: a null URL, or one without characters, has empty host and path, no score, and the verdict block if no
rule fits. Without any URL of one class that class's model is uniform and the threshold is 0. Repeated rows each get
their row. Columns of the input with the names of the result's columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, without

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 3
MIN_CONTEXT = 4
SYMBOLS = 42
CALIBRATION_DIGITS = ("0", "1", "2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits is the longest
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def spelling(url: Column) -> Column:
    """The URL after its scheme in the models' symbols, between start and end marks; null if there is nothing to spell."""
    text = F.translate(F.coalesce(_after_scheme(url), url), UPPER + "123456789", LOWER + "000000000")
    text = F.regexp_replace(text, r"[^a-z0/._?&=#%:+~\-]", "*")
    return F.when(F.length(text) > 0, F.concat(F.lit("^" * ORDER), text, F.lit("$")))


def _grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("spelt") - ORDER))).withColumn("gram", F.substr("spelt", F.col("at"), F.lit(ORDER + 1)))


def markov_ratio(counts: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) counts to (gram, ratio): the log ratio of the models' probabilities of each gram's last character."""
    longest = counts
    levels = []
    for order in range(ORDER, -1, -1):
        levels.append(longest)
        longest = longest.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    model = None
    for order, level in enumerate(reversed(levels)):
        level = level.withColumn("context", F.substr("gram", F.lit(1), F.lit(order)))
        contexts = level.groupBy("context").agg(*[x for c in ("accepted", "rejected") for x in (F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}"))])
        level = level.join(contexts, "context")
        if model is None:
            level = level.withColumns({"p_accepted": F.lit(1 / SYMBOLS), "p_rejected": F.lit(1 / SYMBOLS)})
        else:
            level = level.withColumn("shorter", F.substr("gram", F.lit(2))).join(model.withColumnRenamed("gram", "shorter"), "shorter")
        p = {}
        for c in ("accepted", "rejected"):
            n, kinds, below = F.col(f"n_{c}"), F.col(f"kinds_{c}"), F.col(f"p_{c}")
            enough = n >= (MIN_CONTEXT if order else 1)
            p[f"p_{c}"] = F.when(enough, (F.col(c) + kinds * below) / (n + kinds)).otherwise(below)
        model = level.select("gram", *[v.alias(k) for k, v in p.items()])
    return model.select("gram", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """From (score, verdict): the hundredth from which on accepting separates the verdicts best; the lowest of equals."""
    bins = scored.where("score is not null").groupBy(F.greatest(F.lit(-1600), F.least(F.lit(1600), F.floor(F.col("score") * 100))).alias("bin")).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("r")
    )
    below, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.greatest(F.sum(c).over(everything), F.lit(1))
    best = bins.select("bin", (share("r") - share("a")).alias("j")).orderBy(F.desc("j"), "bin").first()  # at most 3,201 bins
    return best["bin"] / 100 if best and best["j"] > 0 else 0.0


def filter_urls(pages: DataFrame, column: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), score and threshold."""
    spark = pages.sparkSession
    space = Workspace(spark, "urls")
    url = F.col("quern_url")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(column).alias("quern_url")).where("quern_url is not null").distinct()
    urls = urls.select("quern_url", host_of(url).alias("host"), path_of(url).alias("path"), spelling(url).alias("spelt"))
    urls = urls.select("quern_url", "spelt", verdict.alias("verdict"), F.left(F.md5(url.cast("binary")), F.lit(1)).isin(*CALIBRATION_DIGITS).alias("held"))
    urls = space.write("urls", urls)
    counted = [F.sum(((F.col("verdict") == v) & ~F.col("held")).cast("long")).alias(c) for v, c in (("allow", "accepted"), ("block", "rejected"))]
    counts = _grams(urls).groupBy("gram").agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counted, ("accepted", "rejected"), strict=True)])
    model = space.write("model", markov_ratio(space.write("counts", counts)))
    # the model has at most SYMBOLS ** (ORDER + 1) rows
    scores = _grams(urls).join(F.broadcast(model), "gram").groupBy("quern_url").agg(F.avg("ratio").alias("score"))
    scores = space.write("scores", urls.join(scores, "quern_url", "left").select("quern_url", "score", "verdict", "held"))
    limit = threshold(scores.where("held and verdict is not null"))
    kept = without(pages, "host", "path", "rule", "verdict", "score", "threshold")
    out = kept.join(scores.select(F.col("quern_url"), "score"), F.col(column) == F.col("quern_url"), "left").drop("quern_url")
    out = out.withColumns({"host": host_of(F.col(column)), "path": path_of(F.col(column)), "threshold": F.lit(limit)})
    out = out.withColumns({"rule": rule, "judged": verdict})
    return out.withColumn("verdict", F.coalesce("judged", F.when(F.col("score") >= limit, "allow").otherwise("block"))).drop("judged")


def sql(table: str = "pages", rules=RULES) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict of filter_urls()."""
    fits = []
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        name, _, tail = text.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}')", text, says))
    rule = " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in fits)
    says = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    levels = []
    for order in range(ORDER, -1, -1):
        source = "SELECT gram, a, r FROM counts" if order == ORDER else f"SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM g{order + 1} GROUP BY 1"
        levels.append(f"g{order} AS ({source}), c{order} AS (SELECT left(gram, {order}) AS context, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ka, count(*) FILTER (r > 0) AS kr FROM g{order} GROUP BY 1)")
    for order in range(ORDER + 1):
        least = MIN_CONTEXT if order else 1
        pa, pr = (f"m.p{c}" if order else f"(1.0 / {SYMBOLS})" for c in "ar")
        below = f"JOIN m{order - 1} m ON m.gram = substr(g.gram, 2)" if order else ""
        p = [f"CASE WHEN n{c} >= {least} THEN (g.{c} + k{c} * {x}) / (n{c} + k{c}) ELSE {x} END AS p{c}" for c, x in (("a", pa), ("r", pr))]
        levels.append(f"m{order} AS (SELECT g.gram, {p[0]}, {p[1]} FROM g{order} g JOIN c{order} c ON c.context = left(g.gram, {order}) {below})")
    held = ", ".join(f"'{d}'" for d in CALIBRATION_DIGITS)
    return f"""WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM {table}),
split AS (SELECT page_id, url, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {says} END AS judged FROM split),
urls AS (SELECT DISTINCT url, judged, left(md5(url), 1) IN ({held}) AS held, '{"^" * ORDER}' || nullif(regexp_replace(translate(coalesce(rest, url), '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0/._?&=#%:+~\\-]', '*', 'g'), '') || '$' AS spelt FROM ruled WHERE url IS NOT NULL),
places AS (SELECT url, judged, held, substr(spelt, k, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(spelt) - {ORDER - 1})) AS k FROM urls WHERE spelt IS NOT NULL)),
counts AS (SELECT gram, count(*) FILTER (judged = 'allow' AND NOT held) AS a, count(*) FILTER (judged = 'block' AND NOT held) AS r FROM places GROUP BY 1),
{", ".join(levels)},
scores AS (SELECT url, any_value(judged) AS judged, any_value(held) AS held, avg(ln(pa) - ln(pr)) AS score FROM places JOIN m{ORDER} USING (gram) GROUP BY 1),
bins AS (SELECT greatest(-1600, least(1600, floor(score * 100))) AS bin, count(*) FILTER (judged = 'allow') AS a, count(*) FILTER (judged = 'block') AS r FROM scores WHERE held AND judged IS NOT NULL GROUP BY 1),
shares AS (SELECT bin, coalesce(sum(r) OVER w, 0) / greatest(sum(r) OVER (), 1) - coalesce(sum(a) OVER w, 0) / greatest(sum(a) OVER (), 1) AS j FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce((SELECT bin / 100 FROM shares WHERE j > 0 ORDER BY j DESC, bin LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, rule, coalesce(r.judged, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM ruled r LEFT JOIN scores s ON r.url = s.url, chosen"""
