"""Names looked up through scopes that know their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.resolution import outcome
from lodestone.tables import written


def enclosing(scopes: DataFrame, within: DataFrame) -> DataFrame:
    """(scope, outer, distance) for each scope of within and all that enclose it, itself at distance 0.

    scopes: (scope, parent); the outermost have a null parent. The reach of all
    scopes doubles in each round, so rounds are the logarithm of the depth. A
    scope that encloses itself raises ValueError.
    """
    up = written(scopes.filter("parent IS NOT NULL").select("scope", F.col("parent").alias("outer"), F.lit(1).alias("distance")))
    reach, frontier, step, most = up, up, 1, max(1, up.count())
    while not frontier.isEmpty():
        if step > 2 * most or not reach.filter("scope = outer").isEmpty():
            raise ValueError("scopes enclose themselves")
        far = frontier.filter(F.col("distance") == step).select(F.col("scope").alias("from"), F.col("outer").alias("at"))
        further = far.join(reach.select(F.col("scope").alias("at"), "outer", "distance"), "at")
        frontier = written(further.select(F.col("from").alias("scope"), "outer", (F.col("distance") + step).alias("distance")))
        reach, step = written(reach.union(frontier)), 2 * step
    own = within.select("scope").distinct()
    return own.select("scope", F.col("scope").alias("outer"), F.lit(0).alias("distance")).union(reach.join(own, "scope", "left_semi"))


def looked_up(references: DataFrame, scopes: DataFrame, declarations: DataFrame) -> DataFrame:
    """references (reference, scope, name) with scope_found, candidates, outcome and target: the innermost enclosing scope that declares the name decides.

    scopes: (scope, parent); declarations: (scope, name, target). Blank names
    declare nothing. Several targets in the deciding scope are ambiguous. Each
    pair of scope and name is looked up once, however often it is referred to.
    """
    asked = written(references.select("scope", "name").distinct())
    known = declarations.filter("name NOT IN ('', '_')").select(F.col("scope").alias("outer"), "name", "target").distinct()
    met = enclosing(scopes, asked).join(asked, "scope").join(known, ["outer", "name"])
    near = met.withColumn("_k", F.rank().over(Window.partitionBy("scope", "name").orderBy("distance"))).filter("_k = 1")
    found = near.groupBy("scope", "name").agg(F.first("outer").alias("scope_found"), F.count(F.lit(1)).alias("candidates"), F.min("target").alias("target"))
    out = references.join(found, ["scope", "name"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("outcome", outcome(F.col("candidates"))).withColumn("target", F.when(F.col("candidates") == 1, F.col("target")))
