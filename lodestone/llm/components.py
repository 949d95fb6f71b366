"""Connected components by alternating large and small stars.

Every round rewrites the links so that each vertex hangs on a smaller one, until
all hang on the least of their component. All steps are joins of written tables
and partial aggregates; nothing is collected but two sums that tell whether a
round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import forget, written


def _sums(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"] or 0


def _least(links: DataFrame) -> DataFrame:
    return written(links.groupBy("a").agg(F.min("b").alias("m")), "least")


def star_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (vertex, root): the least vertex that each linked vertex reaches.

    Links may repeat, point either way and be loops. Vertices without another
    vertex are not returned.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = written(links.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = _sums(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both.withColumn("b", F.least("a", "b")))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        forget(least)
        least = _least(large)
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(hung.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        for x in (least, large, now):
            forget(x)
        now, after = small, _sums(small)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
