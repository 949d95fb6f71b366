"""Best-fit-decreasing packing of tokenised documents into sequences.

Only lengths matter for the packing, and there are at most capacity of them.
The distributed part counts pieces by length; the driver runs best-fit
decreasing over these counts, with a segment tree over remaining capacities
that finds the tightest open sequence in logarithmic time, and writes a plan of
runs: so many pieces of one length, from this rank on, go to sequences from
that number on. Each piece finds its place from its length and its rank among
the pieces of that length. The result is the one that placing the pieces one
by one would give; the plan's size does not depend on the number of documents.

Cases: a null text is an empty document, which has the end id alone; rows that
repeat an id are packed one by one; a null id is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import lean, written
from lodestone.llm.tokenizer_fst import compiled


class CapacityTree:
    """Open sequences by remaining capacity; finds the least remaining capacity that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.sums = np.zeros(2 * self.leaves, dtype=np.int64)
        self.ranges: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.sums[k] += n
            k //= 2

    def put(self, room: int, first: int, n: int) -> None:
        """Open sequences first to first + n - 1 have so much room."""
        if n and room:
            self.ranges[room].append((first, n))
            self._add(room, n)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to so many neighbouring sequences of this room; returns first and number."""
        first, n = self.ranges[room].popleft()
        if n > most:
            self.ranges[room].appendleft((first + most, n - most))
            n = most
        self._add(room, -n)
        return first, n

    def tightest(self, least: int) -> int | None:
        """The least room >= least that any open sequence has."""
        k = least + self.leaves
        if self.sums[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.sums[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.sums[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, first offset), by length and rank."""
    tree, runs, opened = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                n = max(1, left // each)
                first, opened = opened, opened + n
            else:
                each = room // length
                first, n = tree.take(room, max(1, left // each))
            placed = min(left, n * each)
            runs.append((length, rank, placed, each, first, capacity - room))
            if placed == n * each:
                tree.put(room - each * length, first, n)
            else:  # one sequence that took the last pieces
                tree.put(room - placed * length, first, n)
            left -= placed
            rank += placed
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, buckets: int) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of each document, and a bucket to count them in."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "_bucket"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, last = compiled(definition.value), end_id.to_bytes(4, "little")
        turn = 0
        for batch in batches:
            owner, rows = [], []
            for k, ids in enumerate(fst.encoded(batch.column(1).to_pylist())):
                data = ids.tobytes() + last
                n = len(data) // 4
                head = n % capacity or capacity
                cuts = [0, *range(head, n, capacity), n]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(k)
                    rows.append((p, a, b - a, zlib.crc32(data[4 * a : 4 * b]), turn % buckets))
                    turn += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    return docs.select(id_col, text_col).mapInArrow(lean(pieces, ("ids", "powers")), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _bucket int")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents; returns id_col, piece, start, length, ids_crc32, sequence_id and offset for each piece.

    Documents longer than capacity are cut from the end, so that the first
    piece may be shorter.
    """
    # Buckets keep the numbering of equally long pieces, of which there may be any share, in small groups.
    buckets = max(16, min(65_536, docs.count() // 2000))
    cut = written(tokenised_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, buckets), "pieces")
    groups = written(cut.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n")), "groups")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("_bucket", "length").orderBy(id_col, "piece", "ids_crc32")
    ranked = cut.withColumn("_in", F.row_number().over(order) - 1).join(bases, ["_bucket", "length"])
    ready = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in")).alias("_rank"))
    kind = docs.schema[id_col].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        key = (runs[:, 0] << 44) | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = runs[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
            k = rank - run[:, 1]
            sequence, offset = run[:, 4] + k // run[:, 3], run[:, 5] + k % run[:, 3] * length
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ready.mapInArrow(lean(placed), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The whole documents table in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
