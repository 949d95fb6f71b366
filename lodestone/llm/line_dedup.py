"""Line deduplication with two Bloom filters.

The first filter holds the line keys seen once, the second those seen at least
twice. Every task fills both over its own documents; the tasks' filters are
folded segment by segment (a bit set in two tasks' first filters counts as seen
twice), which can only raise false suspicions and never miss a repeat. Only
lines that the second filter suspects are shuffled, as 128-bit digests, for
exact confirmation and the choice of the first document.

Cases: a null or empty text is one empty line; a null id counts as one document
that comes after all others; rows that repeat an id count as one document, and
each keeps its own lines; an empty table gives an empty result. Input columns
named n_lines or n_dropped are replaced by the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import BLANK, NULL_ID, lean, ordered_ids, power_of_two, sized, written

SEGMENT_BITS = 1 << 16
SEGMENT_BYTES = SEGMENT_BITS // 8


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text as bytes, and their keys."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip(BLANK).lower() for x in lines]


def eligible(key: bytes, min_chars: int) -> bool:
    """Has the key at least so many code points?"""
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars)


def bit_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit hash."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _test(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _set(bitmap: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, place >> 3, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8)))


def _packed(segment: np.ndarray) -> bytes:
    """A filter segment: 16-bit places of its set bits where that is shorter, else the bitmap."""
    if np.count_nonzero(segment) * 2 < SEGMENT_BYTES // 2:
        places = np.flatnonzero(np.unpackbits(segment, bitorder="little")).astype("<u2")
        if places.nbytes < SEGMENT_BYTES:
            return places.tobytes()
    return segment.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT_BYTES:
        return np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(SEGMENT_BITS, dtype=np.uint8)
    out[np.frombuffer(data, dtype="<u2")] = 1
    return np.packbits(out, bitorder="little")


def _fill(batches: Iterator[pa.RecordBatch], bits: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Both filters of one task, as segments."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    used = False
    for batch in batches:
        hashes: list[int] = []
        for text in batch.column(1).to_pylist():
            keys = {k for k in line_keys(text)[1] if eligible(k, min_chars)}
            hashes += map(xxhash.xxh3_64_intdigest, keys)
        if not hashes:
            continue
        used = True
        unique, counts = np.unique(np.array(hashes, dtype=np.uint64), return_counts=True)
        first, second = bit_places(unique, bits)
        again = (counts > 1) | (_test(once, first) & _test(once, second))
        for place in (first[again], second[again]):
            _set(twice, place)
        for place in (first, second):
            _set(once, place)
    if used:
        rows: list[tuple[int, bytes, bytes]] = []
        a, b = once.reshape(-1, SEGMENT_BYTES), twice.reshape(-1, SEGMENT_BYTES)
        for k in np.flatnonzero(a.any(axis=1)):
            rows.append((int(k), _packed(a[k]), _packed(b[k])))
            if len(rows) == 512:
                yield _segments(rows)
                rows = []
        yield _segments(rows)


def _segments(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["segment", "once", "twice"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the tasks' segments: what two tasks saw once was seen twice."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            once, twice = _unpacked(a), _unpacked(b)
            if k in state:
                seen, more = state[k]
                once, twice = seen | once, more | twice | (seen & once)
            state[k] = once, twice
    yield _segments([(k, b"", _packed(twice)) for k, (_, twice) in state.items() if twice.any()])


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The second filter over all documents; bits / 8 bytes, whatever the input."""
    shape = "segment int, once binary, twice binary"
    parts = docs.mapInArrow(lean(lambda it: _fill(it, bits, min_chars)), shape)
    folded = parts.repartition("segment").mapInArrow(lean(_fold), shape).select("segment", "twice")
    out = np.zeros((bits // SEGMENT_BITS, SEGMENT_BYTES), np.uint8)
    for row in folded.toLocalIterator():
        out[row.segment] = _unpacked(bytes(row.twice))
    return out.reshape(-1)


def digest(key: bytes) -> bytes:
    """What stands for a line key in the exact confirmation."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(batches: Iterator[pa.RecordBatch], shared, bits: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    bitmap = shared.value
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = [k for k in set(line_keys(text)[1]) if eligible(k, min_chars)]
            if own:
                a, b = bit_places(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits)
                for i in np.flatnonzero(_test(bitmap, a) & _test(bitmap, b)):
                    ids.append(doc)
                    keys.append(digest(own[i]))
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc"])


def _kept(text: str | None, lost) -> tuple[str, int, int]:
    """What is left of a text; lost(position-independent key) tells a line that goes."""
    lines, keys = line_keys(text)
    left = [x for x, k in zip(lines, keys, strict=True) if not lost(k)]
    return b"\n".join(left).decode(), len(lines), len(lines) - len(left)


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, filter_bits: int | None = None, broadcast_rows: int = 400_000) -> DataFrame:
    """Drop lines whose key stands in at least two documents, but in the first of these.

    Returns docs with the text that is left, n_lines (before) and n_dropped.
    filter_bits: size of each Bloom filter; by default 256 bits a document, at
    least 2^20 and at most 2^28 (32 MB). A fuller filter suspects more lines,
    which costs shuffle and changes no result. broadcast_rows: confirmed
    repeats up to this number go to all tasks; beyond it the texts are joined
    with their own lost keys by id.
    """
    spark = docs.sparkSession
    own, less = ordered_ids(docs, id_col)
    pairs = docs.select(own.alias("doc"), F.col(text_col).alias("text"))
    bits = filter_bits or power_of_two(256 * docs.count(), 1 << 20, 1 << 28)
    shared = spark.sparkContext.broadcast(twice_filter(pairs, bits, min_chars))
    suspects = pairs.mapInArrow(lean(lambda it: _suspects(it, shared, bits, min_chars)), "key binary, doc long")
    if_first = F.min("doc").alias("first")
    repeats = written(suspects.groupBy("key").agg(if_first, F.max("doc").alias("last")).filter("first < last").select("key", "first"), "repeats")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = T.StructType([*(T.StructField(c, T.StringType()) if c == text_col else docs.schema[c] for c in rest), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at, named = rest.index(text_col), rest.index(id_col)

    if repeats.limit(broadcast_rows + 1).count() <= broadcast_rows:
        firsts = spark.sparkContext.broadcast({bytes(r.key): r.first for r in repeats.toLocalIterator()})

        def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, bitmap = firsts.value, shared.value
            for batch in batches:
                done = []
                for doc, text in zip(batch.column(named).to_pylist(), batch.column(at).to_pylist(), strict=True):
                    doc = NULL_ID if doc is None else doc - less
                    suspected = _suspected(text, bitmap, bits, min_chars)
                    done.append(_kept(text, lambda k, d=doc, s=suspected: k in s and table.get(digest(k), d) != d))
                yield _with_counts(batch, at, done, out)

        return docs.select(rest).mapInArrow(lean(by_table), out)

    joined = suspects.join(repeats, "key").filter("doc <> first")
    lost = joined.groupBy("doc").agg(F.collect_list("key").alias("__line_dedup_lost"))
    keyed = docs.select(*rest, own.alias("__line_dedup_doc"))
    both = keyed.join(lost, keyed["__line_dedup_doc"] == lost["doc"], "left").select(*rest, "__line_dedup_lost")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, keys in zip(batch.column(at).to_pylist(), batch.column(len(rest)).to_pylist(), strict=True):
                gone = {bytes(k) for k in keys or ()}
                done.append(_kept(text, lambda k, g=gone: bool(g) and eligible(k, min_chars) and digest(k) in g))
            yield _with_counts(batch, at, done, out)

    return both.mapInArrow(lean(by_join), out)


def _suspected(text: str | None, bitmap: np.ndarray, bits: int, min_chars: int) -> set[bytes]:
    own = [k for k in set(line_keys(text)[1]) if eligible(k, min_chars)]
    if not own:
        return set()
    a, b = bit_places(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits)
    return {own[i] for i in np.flatnonzero(_test(bitmap, a) & _test(bitmap, b))}


def _with_counts(batch: pa.RecordBatch, at: int, done: list[tuple[str, int, int]], schema: T.StructType) -> pa.RecordBatch:
    columns = [batch.column(i) for i in range(len(schema) - 2)]
    columns[at] = pa.array([x[0] for x in done], pa.string())
    counts = [pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)]
    return pa.record_batch([*columns, *counts], [f.name for f in schema])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest columns of the contract over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH pieces AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM pieces
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeats AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.*, coalesce(r.first <> doc_id, false) AS gone FROM keyed LEFT JOIN repeats r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
