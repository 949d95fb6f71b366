"""Rows that must hold, sets that must be equal, and text that must not leak."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Invalid(ValueError):
    """Rows that break a rule; found says which rule and how often."""

    def __init__(self, found: list) -> None:
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in found))
        self.found = found


#: Digests as the store writes them.
DIGEST = r"^[0-9a-f]{64}\z"


def safe_text(text: Column) -> Column:
    """Not null, and without control characters but tab and line ends."""
    return F.coalesce(~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit(False))


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, a null answer counting as broken; one pass over the rows."""
    counts = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))))).alias("rule", "n"))


def require(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, after a pass that raises Invalid if any breaks a rule."""
    found = [(r["rule"], r["n"]) for r in broken_rules(rows, rules).filter("n > 0").orderBy("rule").collect()]
    if found:
        raise Invalid(found)
    return rows


def in_scope(rows: DataFrame, scope: str, column: str = "scope") -> DataFrame:
    """Rows of one security scope; a null scope belongs to none."""
    return rows.filter(F.col(column) == scope)


def with_status(rows: DataFrame, *statuses: str, column: str = "status") -> DataFrame:
    """Rows in one of these statuses."""
    return rows.filter(F.col(column).isin(*statuses))


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (same, missing, unexpected): are the distinct rows of both the same?"""
    names = left.columns
    sides = F.sum("_l").alias("_l"), F.sum("_r").alias("_r")
    both = left.distinct().withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(right.select(names).distinct().withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
    counts = both.groupBy(*names).agg(*sides).agg(F.count_if(F.col("_r") == 0).alias("missing"), F.count_if(F.col("_l") == 0).alias("unexpected"))
    return counts.select(((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("same"), "missing", "unexpected")


def leaks(chunks: DataFrame, group: str, order: str, text: str, forbidden: list[str]) -> DataFrame:
    """(group, needle): forbidden strings in a text that comes in ordered chunks, also across their borders.

    Each chunk is searched behind the end of what came before it, one character
    shorter than the longest string; chunks are no shorter than that but the last.
    """
    longest = max(map(len, forbidden))
    before = F.coalesce(F.lag(F.right(F.col(text), F.lit(longest - 1))).over(Window.partitionBy(group).orderBy(order)), F.lit(""))
    joined = chunks.withColumn("_seen", F.concat(before, text) if longest > 1 else F.col(text))
    needles = F.filter(F.array(*map(F.lit, forbidden)), lambda x: F.contains(F.col("_seen"), x))
    return joined.select(group, F.explode(needles).alias("needle")).distinct()


def variants(value: str) -> list[str]:
    """The ways in which a private path may be written: as it is, with the other slashes, and with these doubled as in JSON."""
    other = {value, value.replace("\\", "/"), value.replace("/", "\\")}
    return sorted(x for x in other | {y.replace("\\", "\\\\") for y in other} if x)


def count_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(what, name, n): rows counted by each of the columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("name")) for c in columns)))
    return rows.select(each.alias("x")).groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("n"))


def distinct_diagnostics(rows: DataFrame, key: list[str], message: str, most: int) -> DataFrame:
    """Diagnostics distinct by key, without the message, in order; the first so many, with how many were left out."""
    once = rows.groupBy(*key).agg(F.min(message).alias(message))
    total = once.agg(F.count(F.lit(1)).alias("_total"))
    return once.orderBy(*key).limit(most).crossJoin(total).withColumn("omitted", F.greatest(F.col("_total") - most, F.lit(0))).drop("_total")  # one row


def unions(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames of one schema."""
    return reduce(DataFrame.unionByName, frames)
