"""What a table's columns hold: counts, lengths, numbers, commonest values, and what may identify people.

Every measure that depends on values alone is a weighted sum over the table of frequencies (column, value, n): one scan,
one exchange with partial counts before it, exact at any size, the same whatever the partitions. Nothing is capped while
counting; VALUES_TRACKED only decides from where on a distinct count is shown as a floor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..settings import LEAST_COVERAGE, SINGLE_VALUE_SHARE, VALUES_SHOWN, VALUES_TRACKED, WATCHED_WORDS


def as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns as text without null; other forms than text are cast."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns or df.columns])


def cells(text: DataFrame) -> DataFrame:
    """(column_name, position, value): a row for each cell."""
    one = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("position"), F.col(f"`{c}`").alias("value")) for k, c in enumerate(text.columns)])
    return text.select(F.inline(one))


def frequencies(cell_rows: DataFrame, keys: tuple[str, ...] = ("column_name", "position")) -> DataFrame:
    """(*keys, value, n) of rows of cells."""
    return cell_rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))


#: Measures by name; each is a sum, least or greatest over frequencies. A further measure is one more entry.
def measures(cap: int) -> dict[str, Column]:
    value, n = F.col("value"), F.col("n")
    filled, parsed = value != "", T.number(value)
    total = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")
    kinds = F.count(F.when(filled, 1))
    return {
        "rows_seen": F.sum(n).cast("long"),
        "empty_count": total(~filled),
        "null_like_text_count": total(T.is_null_word(value)),
        "distinct_count": F.least(kinds, F.lit(cap)).cast("long"),
        "distinct_count_is_at_least": kinds > cap,
        "shortest_value_length": F.min(F.when(filled, F.length(value))),
        "longest_value_length": F.max(F.when(filled, F.length(value))),
        "number_count": total(parsed.isNotNull()),
        "not_a_number_count": total(filled & parsed.isNull()),
        "smallest_number": F.min(parsed),
        "largest_number": F.max(parsed),
        "top_count": F.coalesce(F.max(F.when(filled, n)), F.lit(0)).cast("long"),
        "all_digit_count": total(filled & T.is_all_digits(value)),
        "path_like_count": total(filled & T.is_path(value)),
    }


def derived() -> dict[str, Column]:
    """Measures of a column that follow from others, in order."""
    rows, filled = F.col("rows_seen"), F.col("rows_seen") - F.col("empty_count")
    return {
        "filled_in_count": filled,
        "is_all_numbers": (filled > 0) & (F.col("not_a_number_count") == 0),
        "is_all_empty": (rows > 0) & (F.col("empty_count") == rows),
        "single_value_share": F.when(rows > 0, F.col("top_count") / rows).otherwise(0.0),
        "holds_one_value": F.col("single_value_share") >= SINGLE_VALUE_SHARE,
    }


def profile(freq: DataFrame, keys: tuple[str, ...] = ("column_name", "position"), cap: int = VALUES_TRACKED) -> DataFrame:
    """A row for each column: all measures, and the derived ones."""
    made = freq.groupBy(*keys).agg(*[c.alias(k) for k, c in measures(cap).items()])
    return reduce(lambda df, kv: df.withColumn(*kv), derived().items(), made)


def top_values(freq: DataFrame, keys: tuple[str, ...] = ("column_name", "position"), k: int = VALUES_SHOWN) -> DataFrame:
    """(*keys, value, n, rank): the k commonest filled-in values of each column, equal counts by value."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    return freq.where("value <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coverage(freq: DataFrame, keys: tuple[str, ...] = ("column_name", "position"), k: int = VALUES_SHOWN) -> DataFrame:
    """(*keys, shown_count, filled_in_count, coverage, is_suppressed) of each column with a value: what the k commonest values cover."""
    filled = freq.where("value <> ''").groupBy(*keys).agg(F.sum("n").alias("filled_in_count"))
    shown = top_values(freq, keys, k).groupBy(*keys).agg(F.sum("n").alias("shown_count"))
    share = F.col("shown_count") / F.col("filled_in_count")
    return filled.join(shown, list(keys)).select(*keys, "shown_count", "filled_in_count", share.alias("coverage"), (share < LEAST_COVERAGE).alias("is_suppressed"))


def concerns(profiled: DataFrame, keys: tuple[str, ...] = ("column_name", "position")) -> DataFrame:
    """Columns that may identify people: watched by name or with a path, and filled in. Counts are exact over all rows."""
    words, filled = T.watched_words(F.col("column_name")), F.col("filled_in_count")
    digits, paths = F.col("all_digit_count") / filled, F.col("path_like_count") / filled
    verdict = F.when(paths > 0, "contains paths, which may hold usernames").when(digits == 1, "all digits, consistent with having been anonymised").otherwise("contains letters, NOT consistent with having been anonymised")
    found = profiled.where(filled > 0).withColumn("matched_words", words).where((F.size("matched_words") > 0) | (F.col("path_like_count") > 0))
    return found.select(
        *keys, (F.size("matched_words") > 0).alias("watched_by_name"), "matched_words", filled.alias("values_seen"),
        F.round(digits, 4).alias("all_digit_share"), F.round(paths, 4).alias("path_like_share"), verdict.alias("verdict"),
    )


def needs_attention(verdict: Column) -> Column:
    return F.contains(verdict, F.lit("NOT consistent")) | F.contains(verdict, F.lit("path"))


def first_values(cell_rows: DataFrame, order: str, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, example): each column's first filled-in value in row order."""
    return cell_rows.where("value <> ''").groupBy(*keys).agg(F.min_by("value", order).alias("example"))


def compare(preview: DataFrame, full: DataFrame) -> DataFrame:
    """Two profiles of the same columns side by side: what a preview would have said wrongly."""
    names = ["distinct_count", "is_all_empty", "holds_one_value", "number_count"]
    sides = [p.select("column_name", *[F.col(n).alias(f"{side}_{n}") for n in names]) for side, p in (("preview", preview), ("full", full))]
    differs = reduce(lambda a, b: a | b, [F.col(f"preview_{n}") != F.col(f"full_{n}") for n in ("is_all_empty", "holds_one_value")])
    return sides[0].join(sides[1], "column_name").withColumn("verdict_changes", differs)


assert all(w == w.lower() for w in WATCHED_WORDS)
