"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one, padded to a power of two and turned by fast
Hadamard pseudo-rotations (random signs and a Walsh-Hadamard transform, three
times). A vector's bucket in a table is its nearest signed axis. A query probes
the axes nearest to it in every table; the candidates it meets are ranked by
their exact distance on the original vectors. Every row is indexed; buckets
with many rows or many queries are cut into blocks that meet pairwise, so no
group grows with the data, and nothing is dropped. A query that meets fewer
than k candidates is compared with all rows, in blocks of queries.

Cases: vectors that are null, all zero, or hold a null or a non-finite number
take no part; vectors of another length are no candidates; a null id takes no
part; rows that repeat an id count once, with the nearest; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import lean, written

BLOCK = 4096
ROUNDS = 3


def rotation_signs(width: int, table: int) -> np.ndarray:
    """The random signs of a table's rotation; the same in every process."""
    return np.random.default_rng([104729, width, table]).integers(0, 2, (ROUNDS, width)) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in width * log2(width) steps."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors after the table's pseudo-rotation."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), width))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    x[:, : vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    for signs in rotation_signs(width, table):
        x = hadamard(x * signs)
    return x


def axis_scores(vectors: np.ndarray, table: int) -> np.ndarray:
    """Nearness to each signed axis: first the positive ones, then the negative."""
    x = rotated(vectors, table)
    return np.concatenate([x, -x], axis=1)


def usable(rows: list) -> list[int]:
    """Numbers of the vectors that take part."""
    return [k for k, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]


def _by_length(ids: list, rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths: dict[int, list[int]] = {}
    for k in usable(rows):
        if ids[k] is not None:
            lengths.setdefault(len(rows[k]), []).append(k)
    for own in lengths.values():
        yield np.array([ids[k] for k in own], dtype=np.int64), np.array([rows[k] for k in own], dtype=np.float64)


ENTRY = "id long, dims int, hash int, bucket int, vector binary"


def _entries(batches: Iterator[pa.RecordBatch], tables: int, probes: int, form: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, dims, table, bucket, vector): one a table and probe."""
    for batch in batches:
        for ids, vectors in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = [x.astype(form).tobytes() for x in vectors]
            for table in range(tables):
                scores = axis_scores(vectors, table)
                chosen = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                each = chosen.shape[1]
                n = len(ids) * each
                yield pa.record_batch(
                    [pa.array(np.repeat(ids, each)), pa.array(np.full(n, vectors.shape[1]), pa.int32()), pa.array(np.full(n, table), pa.int32()), pa.array(chosen.reshape(-1), pa.int32()), pa.array([x for x in data for _ in range(each)], pa.binary())],
                    ["id", "dims", "hash", "bucket", "vector"],
                )


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares would overflow or vanish, of scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = vectors - query
        out = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            half = vectors[odd] / 2 - query / 2  # differences of finite numbers may overflow
            top = np.abs(half).max(axis=1, keepdims=True)
            size = np.where(top > 0, top, 1.0)
            out[odd] = 2 * size[:, 0] * np.sqrt(((half / size) ** 2).sum(axis=1)) * (top[:, 0] > 0)
            fine = np.flatnonzero((top[:, 0] > 0) & (top[:, 0] < 1e-140))
            if len(fine):  # halving loses the last bit of the smallest numbers
                apart = apart[odd[fine]]
                top = np.abs(apart).max(axis=1, keepdims=True)
                out[odd[fine]] = np.where(top[:, 0] > 0, top[:, 0] * np.sqrt(((apart / np.where(top > 0, top, 1.0)) ** 2).sum(axis=1)), 0.0)
    return out


def nearest_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates of each query, exactly, ties to the smaller id; rows that repeat an id take one place.

    Bounds on all squared distances come from one matrix product over vectors
    that are scaled by a power of two and moved to the first; candidates whose
    lower bound is within the k-th upper bound are measured exactly.
    """
    out = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    repeated = len(first) < len(ids)
    power = -int(np.frexp(max(np.abs(vectors).max(), np.abs(queries).max()))[1])
    near = np.ldexp(vectors, power)
    centre = near[0].copy()
    near -= centre
    asked = np.ldexp(queries, power) - centre
    own, theirs = (near**2).sum(axis=1), (asked**2).sum(axis=1)
    share = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
    for a in range(0, len(queries), 256):
        sums = theirs[a : a + 256, None] + own[None]
        rough = sums - 2 * asked[a : a + 256] @ near.T
        slack = share * sums + 1e-290
        same = query_ids[a : a + 256, None] == ids[None]
        upper = np.where(same, np.inf, rough + slack)
        upper = np.minimum.reduceat(upper, first, axis=1) if repeated else upper
        limit = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
        may = (rough - slack <= limit[:, None]) & ~same
        for i, row in enumerate(may):
            chosen = np.flatnonzero(row)
            exact = distances(vectors[chosen], queries[a + i])
            seen: set[int] = set()
            for j in np.lexsort((ids[chosen], exact)):
                if (other := int(ids[chosen[j]])) not in seen:
                    seen.add(other)
                    out.append((int(query_ids[a + i]), other, float(exact[j])))
                if len(seen) == k:
                    break
    return out


def _found(rows: list[tuple[int, int, float]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 8, probes: int = 14, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return query_id, rank (from 1), vec_id and score (Euclidean distance) for the rows that is_query selects."""
    spark = vectors.sparkSession
    form = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    base = vectors.select(F.col(id_col).cast("long"), vector_col)
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long"), vector_col)
    index = written(base.mapInArrow(lean(lambda it: _entries(it, tables, 1, form)), ENTRY), "index")
    probed = written(asked.mapInArrow(lean(lambda it: _entries(it, tables, probes, form)), ENTRY), "probes")
    key = ["dims", "hash", "bucket"]
    blocks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(written(blocks(index, "_n").join(blocks(probed, "_m"), key), "sizes"))  # at most tables * signed axes rows a vector length
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, key).withColumn("block", spread("_n")).withColumn("of", every("_m"))
    right = probed.join(sizes, key).withColumn("of", spread("_m")).withColumn("block", every("_n"))
    group = [*key, "block", "of"]

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _found([])
        sides = [(x["id"].to_numpy(), np.frombuffer(b"".join(x["vector"].to_pylist()), dtype=form).reshape(len(x), -1).astype(np.float64)) for x in (a, b)]
        return _found(nearest_in_block(*sides[1], *sides[0], k))

    met_rows = left.select(*group, "id", "vector").groupBy(group).cogroup(right.select(*group, "id", "vector").groupBy(group)).applyInArrow(met, FOUND)
    best = written(top(met_rows, k), "found")
    whole = probed.select(F.col("id").alias("query_id"), F.col("dims")).distinct()
    short = whole.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    wanting = written(short.join(asked.withColumnRenamed(id_col, "query_id"), "query_id").select("query_id", vector_col), "short")
    more = [exact_neighbours(base, block, k) for block in _blocks(wanting, 1024)]
    for x in more:
        best = best.union(x)
    ranked = top(best, k) if more else best
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct candidates of each query."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    block = []
    for row in rows.toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def exact_neighbours(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact search for a block of queries over all rows: each task keeps its own k nearest."""
    asked = list(_by_length([x[0] for x in queries], [list(x[1]) if x[1] is not None else None for x in queries]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for query_ids, wanted in asked:
                    if wanted.shape[1] == own.shape[1]:
                        yield from _found(nearest_in_block(query_ids, wanted, ids, own, k)).to_batches()

    return top(vectors.mapInArrow(scan, FOUND), k)


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100; candidates: all."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
