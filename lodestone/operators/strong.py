"""Strong components of graphs that no task can hold.

Where vertices have many arcs, the least and the greatest arc of each in either
direction are solved first. What they join is joined in the graph too, and all arcs
are then those between the parts so found, mostly few.

A graph is first contracted. A vertex with a single predecessor is in no
component but its predecessor's, so whole trees and chains of such vertices become
their first vertex, found by pointer jumping in as many rounds as the logarithm of
their length; the same is done for single successors. What is left is coloured in
both directions: every vertex learns the least label that reaches it and the least
that it reaches, over labels that shuffle the vertices. Where both are the same, that
vertex's component is found; other components keep together, and edges between
different colours go. As labels fall as records do, each round cuts what is left into
many parts. At any point what is small enough is ordered by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.waves import BLOCK_EDGES, edge_blocks, spread
from lodestone.tables import written


def _reversed(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def shuffled(vertices: DataFrame) -> DataFrame:
    """(vertex, label): another number for each vertex, one to one, in no order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield pa.record_batch([batch.column(0), pa.array((x ^ (x >> np.uint64(31))).view(np.int64))], ["vertex", "label"])

    return vertices.select("vertex").mapInArrow(made, "vertex long, label long")


def contracted(arcs: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vertex, component) of arcs (a, b), distinct and without loops: trees of vertices with a single predecessor are solved as their first vertex.

    solve gives (vertex, component) for the vertices of the arcs it gets; a
    component is named by any of its vertices. Such a tree's vertex is in the
    component of the first just if it, or one below it, has an arc to that component.
    """
    into = arcs.groupBy(F.col("b").alias("vertex")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("up"))
    single = written(into.filter("n = 1").select("vertex", "up"))
    many = single.count()
    if not many:
        return solve(arcs)
    jumps, least = _jumps(single, many)
    # After so many steps, who is not at a vertex without a single predecessor is on a ring of such; its least vertex serves as first.
    top = jumps[-1]
    rings = top.join(single.select(F.col("vertex").alias("up")), "up", "left_semi")
    heads = written(rings.select(F.col("up").alias("vertex")).distinct().join(least, "vertex").select(F.col("least").alias("vertex")).distinct())
    if heads.isEmpty():
        return _solved_below(arcs, single, jumps, solve)
    tree = written(single.join(heads, "vertex", "left_anti"))
    return _solved_below(arcs, tree, _jumps(tree, many)[0], solve)


def _jumps(single: DataFrame, many: int) -> tuple[list[DataFrame], DataFrame]:
    """Jumps (vertex, up) of 1, 2, 4, ... steps upwards, until none moves further or many are passed, and the least vertex (vertex, least) passed by then.

    Who has no single predecessor stays where it is.
    """
    jumps, least = [single], written(single.select("vertex", F.least("vertex", "up").alias("least")))
    for _ in range(many.bit_length()):
        last = jumps[-1]
        further = last.select(F.col("vertex").alias("up"), F.col("up").alias("next"))
        met = written(last.join(further, "up", "left").select("vertex", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if met.filter("moved").isEmpty():
            break
        low = least.select(F.col("vertex").alias("up"), F.col("least").alias("beyond"))
        least = written(least.join(last, "vertex").join(low, "up", "left").select("vertex", F.least("least", "beyond").alias("least")))
        jumps.append(met.select("vertex", "up"))
    return jumps, least


def _solved_below(arcs: DataFrame, tree: DataFrame, jumps: list[DataFrame], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components of arcs, of which those to tree's vertices (vertex, up) form trees."""
    top = jumps[-1].withColumnRenamed("up", "top")
    outer = arcs.join(tree.select(F.col("vertex").alias("b")), "b", "left_anti").join(top.withColumnRenamed("vertex", "a"), "a", "left")
    outer = written(outer.select("a", F.coalesce("top", "a").alias("top"), "b"))
    found = written(solve(written(outer.filter("top <> b").select(F.col("top").alias("a"), "b").distinct())))
    name = lambda v, c: found.select(F.col("vertex").alias(v), F.col("component").alias(c))
    back = outer.join(name("top", "x"), "top", "left").join(name("b", "y"), "b", "left").filter(F.coalesce("x", "top") == F.coalesce("y", "b"))
    inside = written(back.select(F.col("a").alias("vertex")).distinct().join(tree.select("vertex"), "vertex", "left_semi"))
    for jump in jumps:  # whatever stands above a vertex inside is inside
        above = jump.join(inside, "vertex", "left_semi").select(F.col("up").alias("vertex")).join(tree.select("vertex"), "vertex", "left_semi")
        inside = written(inside.union(above).distinct())
    below = top.join(inside.withColumn("inside", F.lit(True)), "vertex", "left").join(name("top", "x"), "top", "left")
    below = below.select("vertex", F.when(F.col("inside"), F.coalesce("x", "top")).otherwise(F.col("vertex")).alias("component"))
    ends = arcs.select(F.col("a").alias("vertex")).union(arcs.select("b")).distinct().join(tree.select("vertex"), "vertex", "left_anti")
    rest = ends.join(found, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
    return written(below.union(rest))


def coloured(arcs: DataFrame, small: Callable[[DataFrame], DataFrame | None], block_edges: int) -> DataFrame:
    """(vertex, component) of arcs, by the least labels that reach each vertex and that it reaches."""
    vertices = written(arcs.select(F.col("a").alias("vertex")).union(arcs.select("b")).distinct())
    found, left = [], arcs
    while True:
        ordered = small(left)
        if ordered is not None:
            found.append(ordered)
            break
        begin = written(shuffled(left.select(F.col("a").alias("vertex")).union(left.select("b")).distinct()))
        down, up = spread(edge_blocks(left, block_edges), begin), spread(edge_blocks(_reversed(left), block_edges), begin)
        both = written(down.join(up.withColumnRenamed("label", "up"), "vertex"))
        own = both.filter("label = up")
        found.append(own.join(own.groupBy("label").agg(F.min("vertex").alias("component")), "label").select("vertex", "component"))
        rest = both.filter("label <> up")
        end = lambda v: rest.select(F.col("vertex").alias(v), F.col("label").alias(f"d{v}"), F.col("up").alias(f"u{v}"))
        left = written(left.join(end("a"), "a").join(end("b"), "b").filter("da = db AND ua = ub").select("a", "b"))
    named = found[0]
    for more in found[1:]:
        named = named.union(more)
    return written(vertices.join(named, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component")))


def outline(arcs: DataFrame) -> DataFrame:
    """The arcs (a, b) to the least and the greatest vertex that each leads to, and from the least and the greatest that lead to each."""
    out = arcs.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    into = arcs.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    ends = [out.select("a", F.explode(F.array("low", "high")).alias("b")), into.select(F.explode(F.array("low", "high")).alias("a"), "b")]
    return ends[0].union(ends[1]).distinct()


def by_outline(arcs: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vertex, component) of distinct arcs (a, b) without loops, as solve gives them; by their outline first, if that has at most half the arcs.

    No arc is left out: all of them are then arcs between the outline's components.
    """
    few = written(outline(arcs))
    if 2 * few.count() > arcs.count():
        return solve(arcs)
    inner = written(solve(few))
    end = lambda x: inner.select(F.col("vertex").alias(x), F.col("component").alias(f"{x}_in"))
    between = arcs.join(end("a"), "a").join(end("b"), "b").filter("a_in <> b_in")
    rest = written(between.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct())
    outer = written(solve(rest)).select(F.col("vertex").alias("component"), F.col("component").alias("outer"))
    return written(inner.join(outer, "component", "left").select("vertex", F.coalesce("outer", "component").alias("component")))


def components(arcs: DataFrame, small: Callable[[DataFrame], DataFrame | None], block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(vertex, component), the least vertex of each, of distinct arcs (a, b) without loops.

    small orders a graph in one task, or returns None if it is too large for that.
    """

    def backward(x: DataFrame) -> DataFrame:
        done = small(x)
        return done if done is not None else contracted(_reversed(x), lambda y: coloured(_reversed(y), small, block_edges))

    def solved(x: DataFrame) -> DataFrame:
        done = small(x)
        return done if done is not None else contracted(x, backward)

    done = small(arcs)
    named = done if done is not None else by_outline(arcs, solved)
    least = written(named.groupBy("component").agg(F.min("vertex").alias("least")))
    return named.join(least, "component").select("vertex", F.col("least").alias("component"))
