"""Truncations that always say what they left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.encoding import cursor_last, page_cursor


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], per_group: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each group, and (kept, omitted) over all."""
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= per_group).drop("_n")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    tally = sizes.agg(F.coalesce(F.sum(F.least("n", F.lit(per_group))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.greatest(F.col("n") - per_group, F.lit(0))), F.lit(0)).alias("omitted"))
    return kept, tally


def global_limit(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first most - 1 rows where there are more than most, else all; omitted says how many rows went.

    orderBy().limit() keeps most rows a task, so no task sees the whole.
    """
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    first = rows.orderBy(*order).limit(most).withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(*order)))
    joined = first.crossJoin(F.broadcast(total))  # one row
    keep = (F.col("_total") <= most) | (F.col("_n") < most)
    return joined.filter(keep).withColumn("omitted", F.when(F.col("_total") > most, F.col("_total") - most + 1).otherwise(0)).drop("_n", "_total")


def dedupe(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_then_prefix(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """One row a key, the last in the given order; of these the first so many by key, each with omitted, the number of those left out."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("_last", F.max("_n").over(Window.partitionBy(*key))).filter("_n = _last").drop("_n", "_last")
    total = last.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return last.orderBy(*key).limit(most).crossJoin(F.broadcast(total))  # one row


def category_budget(rows: DataFrame, category: str, key: str, order: list[str], most: int) -> DataFrame:
    """A budget shared by categories in their order: (category, kept, omitted).

    Counts are enough: each category takes what the ones before it left.
    """
    counts = rows.filter(F.col(category).isin(order)).groupBy(category).agg(F.count(key).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(most) - F.col("before"), F.lit(0))
    ranked = counts.withColumn("_rank", rank).withColumn("before", before)  # as many rows as categories
    return ranked.select(category, F.least("n", left).alias("kept"), (F.col("n") - F.least("n", left)).alias("omitted"))


def carry_forward(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to each row of its group."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def keyset_page(rows: DataFrame, key: str, last: str | None, size: int) -> DataFrame:
    """The page after a key, with has_more; reads one row more than it returns."""
    after = rows.filter(F.col(key) > last) if last is not None else rows
    page = after.orderBy(key).limit(size + 1).withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(key))).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size)
    return page.filter(F.col("_n") <= size).drop("_n")


def offset_page(rows: DataFrame, order: list[Column], size: int, offset: int, most: int = 1000) -> tuple[DataFrame, int | None]:
    """A page of rows in an order that ends in a unique key, and the next page's offset; None at the end."""
    if not 0 < size <= most or offset < 0:
        raise ValueError(f"pages have 1 to {most} rows")
    found = rows.orderBy(*order).offset(offset).limit(size + 1)
    more = found.count() > size
    return found.limit(size), offset + size if more else None


def bound_pages(rows: DataFrame, key: str, size: int, digest: str, graph: str, direction: str, root: str, cursor: str | None = None) -> tuple[list, str | None]:
    """The rows of the page behind a cursor, and the next cursor; a cursor of another query raises ValueError."""
    last = cursor_last(cursor, digest, graph, direction, root, size) if cursor else None
    page = keyset_page(rows, key, last, size).orderBy(key).collect()  # size rows
    more = bool(page) and page[0]["has_more"]
    return page, page_cursor(digest, graph, direction, root, size, page[-1][key]) if more else None


def drained(page: Callable[[str | None], tuple[list, str | None]], most: int) -> Iterator:
    """All rows of a paged query, page by page; ValueError beyond most rows or where a cursor comes back."""
    cursor, seen, n = None, set(), 0
    while True:
        rows, cursor = page(cursor)
        n += len(rows)
        if n > most:
            raise ValueError(f"more than {most} rows")
        yield from rows
        if cursor is None:
            return
        if cursor in seen:
            raise ValueError("a cursor came back")
        seen.add(cursor)


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: Column, most: float) -> DataFrame:
    """rows with spent, up to the first of each group that would pass the budget; that one and all behind it go."""
    spent = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    worst = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", spent).withColumn("_most", F.max("spent").over(worst)).filter(F.col("_most") <= most).drop("_most")


def canonical_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by all keys, nulls first: the order in which a collection is written."""
    return rows.orderBy(*(F.asc_nulls_first(k) for k in keys))


def by_count(rows: DataFrame, count: str, name: str) -> DataFrame:
    """rows by count, largest first, then by name."""
    return rows.orderBy(F.desc(count), name)


def capped_groups(rows: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """(group, occurrences, values, omitted): rows of each group counted, with its first distinct values in order; no more than most of them come together."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    out = ranked.groupBy(*group).agg(F.sum("_n").alias("occurrences"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(value)))).alias("values"), F.count(F.lit(1)).alias("_all"))
    return out.select(*group, "occurrences", "values", F.greatest(F.col("_all") - most, F.lit(0)).alias("omitted"))
