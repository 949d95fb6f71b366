"""Labels that spread over the edges of a large graph, many levels a job.

Edges are dealt into blocks of bounded size by the order of their source, so that
a vertex of any degree may span several. In a round, the blocks that were sent
labels bring them to a fixpoint over their own edges, however many levels that
takes, and what improved goes on to the other blocks that hold the vertex as a
source. A graph whose ids follow its shape needs about as many rounds as a path
crosses blocks, not as many as it has edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import written

#: Edges of a block; a task holds about 100 bytes for each.
BLOCK_EDGES = 1 << 20
NONE = np.iinfo(np.int64).max


def edge_blocks(arcs: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Write distinct edges (a, b) as (block, a, b), in blocks of about so many edges, by a and b."""
    n = -(-arcs.count() // block_edges) or 1
    dealt = arcs.repartitionByRange(n, "a", "b") if n > 1 else arcs.coalesce(1)
    return written(dealt.select(F.spark_partition_id().cast("long").alias("block"), "a", "b"))


def settled(a: np.ndarray, b: np.ndarray, vertex: np.ndarray, label: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices whose label falls, and to what, if labels spread over the edges a -> b and grow by step on each."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    src, dst = ends[: len(a)], ends[len(a) :]
    order = np.argsort(src, kind="stable")
    dst, begins = dst[order], np.searchsorted(src[order], np.arange(len(names) + 1))
    now = np.full(len(names), NONE)
    at = np.searchsorted(names, vertex)
    np.minimum.at(now, at, label)
    front, fell = np.unique(at), np.zeros(len(names), dtype=bool)
    while len(front):
        size = begins[front + 1] - begins[front]
        each = np.repeat(begins[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to, new = dst[each], np.repeat(now[front], size) + step
        better = (new < now[to]) & (new <= most)
        to, new = to[better], new[better]
        np.minimum.at(now, to, new)
        front = np.unique(to)
        fell[front] = True
    return names[fell], now[fell]


def by_block(rows: DataFrame, task: Callable[..., Iterator[tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """Bring rows (block, kind, x, y) together by block; task gets (block, [x and y of kind 0], [of kind 1]) as arrays and gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solved() -> Iterator[pa.RecordBatch]:
            if held:
                kind, x, y = (np.concatenate([h[k] for h in held]) for k in range(3))
                parts = [(x[kind == k], y[kind == k]) for k in (0, 1)]
                for columns in task(now, *parts):
                    yield pa.record_batch([pa.array(c) for c in columns], [f"c{k}" for k in range(len(columns))])

        for batch in batches:
            block, kind, x, y = (batch.column(k).to_numpy() for k in range(4))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)] if len(block) else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if block[i] != now:
                    yield from solved()
                    now, held = int(block[i]), []
                held.append((kind[i:j].copy(), x[i:j].copy(), y[i:j].copy()))
        yield from solved()

    return rows.select("block", "kind", "x", "y").repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def spread(blocks: DataFrame, begin: DataFrame, step: int = 0, most: int = NONE - 1) -> DataFrame:
    """(vertex, label): the least label that reaches each vertex from begin (vertex, label), its own included, grown by step on each edge.

    Labels over most go no further.
    """
    homes = written(blocks.select(F.col("a").alias("vertex"), "block").distinct())
    state = written(begin.select("vertex", "label"))
    front = state.withColumn("origin", F.lit(-1).cast("long"))

    def settle(block: int, edges: tuple[np.ndarray, np.ndarray], sent: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        vertex, label = settled(*edges, *sent, step, most)
        yield vertex, label, np.full(len(vertex), block)

    while True:
        sent = written(front.join(homes, "vertex").filter("block <> origin").select("block", "vertex", "label"))
        if sent.isEmpty():
            return state
        awake = blocks.join(sent.select("block").distinct(), "block", "left_semi").select("block", F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"))
        met = awake.union(sent.select("block", F.lit(1), "vertex", "label"))
        fell = by_block(met, settle, "vertex long, label long, origin long")
        least = fell.groupBy("vertex").agg(F.min(F.struct("label", "origin")).alias("x")).select("vertex", "x.label", "x.origin")
        known = state.withColumnRenamed("label", "known")
        front = written(least.join(known, "vertex", "left").filter("known IS NULL OR label < known").select("vertex", "label", "origin"))
        better = front.select("vertex", F.col("label").alias("new"))
        state = written(state.join(better, "vertex", "full").select("vertex", F.least("label", "new").alias("label")))
