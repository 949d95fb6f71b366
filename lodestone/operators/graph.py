"""Dependency graphs: normalisation, components, neighbours and impact."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.operators import strong, waves
from lodestone.operators.limits import capped_groups
from lodestone.tables import written

#: Depth up to which a large graph is walked by joins, a level each.
NEAR = 8
#: Edges up to this number are ordered or walked in one task, which then holds some 160 MB: 135 to 160 bytes an edge were measured.
SMALL_EDGES = 1 << 20


def aggregate_edges(candidates: DataFrame, key: list[str], evidence: str, most: int) -> DataFrame:
    """One edge a key: occurrences (candidates), the first distinct evidence rows, and how many were left out.

    No more than most pieces of evidence of an edge come together.
    """
    return capped_groups(candidates, key, evidence, most).withColumnsRenamed({"values": "evidence", "omitted": "omitted_evidence"})


def normalize_nodes(candidates: DataFrame, identity_cols: list[str], fixed: list[str]) -> DataFrame:
    """Distinct nodes with conflict: true where rows of one identity disagree in a fixed column."""
    disagree = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) > 1 for c in fixed]
    conflict = F.lit(False)
    for x in disagree:
        conflict = conflict | x
    return candidates.groupBy(*identity_cols).agg(*(F.min(c).alias(c) for c in fixed), conflict.alias("conflict"))


class Conflicting(ValueError):
    """Candidates of one node disagree."""


def merged_nodes(candidates: DataFrame, key: list[str], fixed: list[str], evidence: str, most: int) -> DataFrame:
    """One node an identity with the first distinct evidence of all its candidates, and how much was left out.

    Conflicting if candidates of one identity differ in a fixed column.
    """
    nodes = written(normalize_nodes(candidates, key, fixed))
    if lost := nodes.filter("conflict").count():
        raise Conflicting(f"{lost} nodes have candidates that disagree")
    proof = capped_groups(candidates.select(*key, evidence), key, evidence, most).select(*key, F.col("values").alias("evidence"), F.col("omitted").alias("omitted_evidence"))
    return nodes.drop("conflict").join(proof, key)


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, key: str, node_id: str) -> DataFrame:
    """from_id and to_id of edges between keys; null where an endpoint is unknown."""
    n = nodes.select(F.col(key).alias("_k"), F.col(node_id).alias("_id"))
    a = n.select(F.col("_k").alias("from_key"), F.col("_id").alias("from_id"))
    b = n.select(F.col("_k").alias("to_key"), F.col("_id").alias("to_id"))
    return edges.join(a, "from_key", "left").join(b, "to_key", "left")


def eligibility(edges: DataFrame, nodes: DataFrame, key: str, is_local: Column) -> DataFrame:
    """edges (a, b) with eligible: are both endpoints local vertices?"""
    local = nodes.filter(is_local).select(F.col(key).alias("_v"))
    from_ok = local.withColumnRenamed("_v", "a").withColumn("_from", F.lit(True))
    to_ok = local.withColumnRenamed("_v", "b").withColumn("_to", F.lit(True))
    met = edges.join(from_ok, "a", "left").join(to_ok, "b", "left")
    return met.withColumn("eligible", F.coalesce(F.col("_from") & F.col("_to"), F.lit(False))).drop("_from", "_to")


def limitation_reasons(**flags: Column) -> Column:
    """Sorted names of the flags that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items()))))


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices in order, where each one's edges begin, and the edges' other ends as vertex numbers, in order."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    order = np.lexsort((b, a))
    return vertices, np.searchsorted(a[order], np.arange(len(vertices) + 1)), b[order]


def _tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a graph in one task; iterative, so depth is no limit."""
    vertices, begins, ends = _arrays(batches)
    n = len(vertices)
    at, stop, to = (array("q", x.astype(np.int64).tobytes()) for x in (begins[:-1], begins[1:], ends))
    order, low, root, stack, count = array("q", [-1]) * n, array("q", [0]) * n, array("q", [-1]) * n, array("q"), 0
    for begin in range(n):
        if order[begin] >= 0:
            continue
        order[begin] = low[begin] = count
        count += 1
        stack.append(begin)
        work = array("q", [begin])
        while work:
            v = work[-1]
            if at[v] < stop[v]:
                w = to[at[v]]
                at[v] += 1
                if order[w] < 0:
                    order[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append(w)
                elif root[w] < 0 and order[w] < low[v]:
                    low[v] = order[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == order[v]:
                first = len(stack) - 1
                while stack[first] != v:
                    first -= 1
                members = stack[first:]
                del stack[first:]
                least = min(members)
                for w in members:
                    root[w] = least
    yield pa.record_batch([pa.array(vertices), pa.array(vertices[np.frombuffer(root, dtype=np.int64)] if n else vertices)], ["vertex", "component"])


def _levels(batches: Iterator[pa.RecordBatch], seeds: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """Vertices that seeds reach, with their depth, in one task: a level at a time over the whole frontier."""
    vertices, begins, ends = _arrays(batches)
    found = np.full(len(vertices), -1, dtype=np.int64)
    front = np.flatnonzero(np.isin(vertices, seeds))
    found[front] = 0
    for level in range(1, depth + 1):
        sizes = begins[front + 1] - begins[front]
        if not sizes.sum():
            break
        each = np.repeat(begins[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        met = ends[each]
        front = np.unique(met[found[met] < 0])
        if not len(front):
            break
        found[front] = level
    there = np.flatnonzero(found > 0)
    yield pa.record_batch([pa.array(vertices[there]), pa.array(found[there].astype(np.int32))], ["vertex", "depth"])


def _near(arcs: DataFrame, begin: DataFrame, depth: int) -> DataFrame:
    """(vertex, depth) of what begin (vertex) reaches over at most depth arcs (a, b), a join a level; no task holds more than a join does."""
    levels = [begin]
    for _ in range(depth):
        met = written(levels[-1].join(arcs, F.col("vertex") == F.col("a")).select(F.col("b").alias("vertex")).distinct())
        seen = reduce(DataFrame.union, levels)
        levels.append(written(met.join(seen.join(met, "vertex", "left_semi"), "vertex", "left_anti")))
        if levels[-1].isEmpty():
            break
    found = [x.select("vertex", F.lit(k).alias("depth")) for k, x in enumerate(levels)]
    return reduce(DataFrame.union, found[1:], found[0].limit(0))


def strong_components(edges: DataFrame, small_edges: int = SMALL_EDGES, block_edges: int = waves.BLOCK_EDGES) -> DataFrame:
    """Edges (a, b) of long ids -> (vertex, component), the least id of the vertices mutually reachable.

    A graph of at most small_edges distinct edges is ordered by one task. A larger
    one is solved by its outline, contracted and coloured until what is left is small enough.
    """
    arcs = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())

    def small(x: DataFrame) -> DataFrame | None:
        return x.coalesce(1).mapInArrow(_tarjan, "vertex long, component long") if x.limit(small_edges + 1).count() <= small_edges else None

    if (done := small(arcs)) is not None:
        return done
    named = written(strong.components(written(arcs.filter("a <> b")), small, block_edges))
    loops = arcs.filter("a = b").select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    return named.union(loops.join(named, "vertex", "left_anti"))


def component_summary(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, cyclic): cyclic if there are several members or a self-loop."""
    loops = edges.filter("a = b").select(F.col("a").cast("long").alias("vertex")).distinct().withColumn("_loop", F.lit(1))
    joined = components.join(loops, "vertex", "left")
    found = joined.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("_loop").alias("_loop"))
    return found.select("component", "size", ((F.col("size") > 1) | F.col("_loop").isNotNull()).alias("cyclic"))


def component_ids(components: DataFrame, graph: str, name: Column) -> DataFrame:
    """(component, size, scc_id) with the stable id over the members' sorted names."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"), identity.stable_id_of_members(identity.SCC, F.lit(graph), F.collect_list(name)).alias("scc_id"))


def direct_neighbours(edges: DataFrame, root: int, outward: bool = True) -> DataFrame:
    """(neighbour, edge_ids) of a root, with uncertain edges too."""
    here, there = ("a", "b") if outward else ("b", "a")
    return edges.filter(F.col(here) == root).groupBy(F.col(there).alias("neighbour")).agg(F.array_sort(F.collect_list("edge_id")).alias("edge_ids"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int, outward: bool = True, small_edges: int = SMALL_EDGES, block_edges: int = waves.BLOCK_EDGES, near: int = NEAR) -> DataFrame:
    """(vertex, depth) reached from seeds (vertex) over at most so many edges; seeds are not reached.

    A graph of at most small_edges edges is walked by one task, however deep. A
    larger one is walked by joins if depth is at most near, and else depths
    spread through blocks of edges, many levels a job.
    """
    here, there = ("a", "b") if outward else ("b", "a")
    arcs = edges.select(F.col(here).cast("long").alias("a"), F.col(there).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    begin = seeds.select(F.col("vertex").cast("long")).filter("vertex IS NOT NULL").distinct()
    if arcs.limit(small_edges + 1).count() <= small_edges:
        first = begin.limit(small_edges + 1).toArrow()["vertex"].to_numpy()
        if len(first) <= small_edges:
            return arcs.distinct().coalesce(1).mapInArrow(lambda it: _levels(it, first, depth), "vertex long, depth int")
    if depth <= near:
        return _near(written(arcs.filter("a <> b")), written(begin), depth)
    blocks = waves.edge_blocks(written(arcs.filter("a <> b").distinct()), block_edges)
    found = waves.spread(blocks, begin.select("vertex", F.lit(0).cast("long").alias("label")), 1, depth)
    return found.filter("label > 0").select("vertex", F.col("label").cast("int").alias("depth"))


@dataclass
class BudgetedImpact:
    """What a bounded traversal found, and why it ended."""

    reached: list[tuple[int, int]] = field(default_factory=list)
    boundary: list[int] = field(default_factory=list)
    edge_ids: list[str] = field(default_factory=list)
    scanned: int = 0
    visited: int = 0
    reasons: list[str] = field(default_factory=list)


def budgeted_impact(edges: DataFrame, seeds: list[int], max_depth: int, max_nodes: int, max_edges: int, outward: bool = True) -> BudgetedImpact:
    """Bounded traversal in a fixed order: frontier by id, then neighbour, then edge id.

    edges: (a, b, edge_id, eligible). The edge that meets the node limit counts
    as scanned and is not kept. A node first met by an uncertain edge is a
    boundary until an eligible edge reaches it. Each level fetches no more
    edges than the budget leaves, so the driver holds what the caller allows.
    """
    spark = edges.sparkSession
    here, there = ("a", "b") if outward else ("b", "a")
    out = BudgetedImpact(visited=len(set(seeds)))
    seen, local, uncertain, kept = set(seeds), set(seeds), set(), set()
    front, level = sorted(set(seeds)), 0
    while front and not out.reasons:
        if level >= max_depth:
            out.reasons.append("depth_limit")
            break
        frontier = spark.createDataFrame([(x,) for x in front], f"{here} long")
        rows = edges.join(frontier, here, "left_semi").orderBy(here, there, "edge_id").limit(max_edges - out.scanned + 1)
        found = []
        for r in rows.select(there, "edge_id", "eligible").collect():
            if out.scanned == max_edges:
                out.reasons.append("edge_limit")
                break
            out.scanned += 1
            target, edge_id, sure = r
            if target not in seen:
                if out.visited == max_nodes:
                    out.reasons.append("node_limit")
                    break
                seen.add(target)
                out.visited += 1
            if target not in local:
                if sure:
                    local.add(target)
                    uncertain.discard(target)
                    found.append(target)
                    out.reached.append((level + 1, target))
                else:
                    uncertain.add(target)
            kept.add(edge_id)
        front, level = sorted(found), level + 1
    out.reached = [(v, d) for d, v in sorted(out.reached)]
    out.boundary, out.edge_ids, out.reasons = sorted(uncertain), sorted(kept), sorted(out.reasons)
    return out


def graph_statistics(edges: DataFrame, most: int) -> DataFrame:
    """One row: vertices, edges before the cap, edges kept and omitted, occurrences."""
    vertices = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().agg(F.count(F.lit(1)).alias("vertices"))
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    kept = F.least("edges", F.lit(most))
    return vertices.crossJoin(counts).select("vertices", "edges", "occurrences", kept.alias("kept_edges"), (F.col("edges") - kept).alias("omitted_edges"))  # one row each


def transitions(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Candidates (a, b, source): each key and the next of its group."""
    following = F.lead(key).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(F.col(key).alias("a"), following.alias("b"), F.col(group).alias("source")).filter("b IS NOT NULL")
