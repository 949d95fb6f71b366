"""Importance resampling towards a target distribution, with an exact cut by radix selection.

Features are runs of words, hashed into buckets. An array holds each bucket's
gain, the logarithm of its share in the target over its share in the documents;
a document's weight is the mean gain of its features, and noise that depends on
the id alone turns the highest scores into a sample without replacement. The
cut is found by a distributed radix selection: rows have a composite key of
score, id and row number, and each pass counts the next 16 bits of the key
among the rows that agree with the digits found so far. Only rows up to the
k-th key are then ordered by range and ranked.

Cases: a null text has no words; a null id comes after all others and hashes as
an empty one; ties of score and id (repeated rows) are cut by the row's place in
the scored table, so that exactly the number asked for is drawn; an empty table
gives an empty result, an empty target gives every bucket a share by smoothing;
other columns are ignored but those named in keep, which are returned as they
are, after the operator's own, and must not have their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import lean, numbered, ordered_ids, self_cleaning, written
from lodestone.llm.wordspans import SEPARATOR, Words, buffer_of, byte_classes, segments, slices, words_of

#: Bytes that end a word: all of ASCII but digits and letters.
CLASSES = byte_classes(bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)))
DIGIT = 16
#: Added to a signed 64-bit number, this gives the unsigned one of the same order.
LOW = 1 << 63
#: Spans longer than this are hashed one by one.
LONG = 64
OWN = ("n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of a buffer, a byte of all spans at a time."""
    size = end - start
    out = np.empty(len(start), dtype=np.uint32)
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = start[short], -size[short]
    crc = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(LONG):
        n = int(np.searchsorted(left, -j, side="left"))  # spans of more than j bytes
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    out[short] = ~crc
    return out


def joined_words(words: Words) -> Words:
    """The same words with exactly one space after each, so that runs of words are spans."""
    size = words.end - words.start + 1
    past = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(words.start - past[:-1], size) + np.arange(past[-1])
    take[past[1:] - 1] = 0
    data = words.data[take] if len(words.data) else words.data
    data[past[1:] - 1] = 32
    return words._replace(data=data, start=past[:-1], end=past[1:] - 1)


def features(column: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the texts of a column, in parts: the row and bucket of each feature, and the rows of the words."""
    data, at = buffer_of(column)
    for part, where, repeated in segments(data, at, CLASSES, SEPARATOR, order - 1):
        words = words_of(part, where, CLASSES)
        spaced = joined_words(words) if order > 1 else words
        rows, found = [], []
        for n in range(1, order + 1):
            last = np.arange(max(n - 1, repeated), len(words.start))
            last = last[words.row[last] == words.row[last - n + 1]]
            rows.append(words.row[last])
            found.append(crc32_of_spans(spaced.data, spaced.start[last - n + 1], spaced.end[last]) % np.uint32(buckets))
        yield np.concatenate(rows), np.concatenate(found).astype(np.int64), words.row[repeated:]


def bucket_counts(docs: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket; tasks send their sums only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 0):
            for _, found, _ in features(batch.column(0), order, buckets):
                sums += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(counted), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    here, target = here.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((target + 1) * (here.sum() + len(here)) / ((here + 1) * (target.sum() + len(here))))).astype(np.int64)


def weighed(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, order: int, buckets: int, keep: Sequence[str]) -> DataFrame:
    """id_col, n_features, n_words and weight of every document, and the columns to keep."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_text, order, buckets)))
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *(F.col(c).alias(f"_keep_{c}") for c in keep))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    names = [*kept.columns[1:], "n_features", "n_words", "weight"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            n, words, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for row, found, word_row in features(batch.column(0), order, buckets):
                n += np.bincount(row, minlength=len(n))
                words += np.bincount(word_row, minlength=len(n))
                total += np.bincount(row, weights=gain.value[found], minlength=len(n)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.record_batch([*batch.columns[1:], pa.array(n), pa.array(words), pa.array(weight)], names)

    return kept.mapInArrow(lean(scored), f"{fields}, n_features long, n_words long, weight long")


def noise(doc: Column, seed: str) -> Column:
    """Thousandths of a Gumbel variate that depends on the id alone, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def radix_threshold(rows: DataFrame, key: Sequence[str], k: int) -> tuple[int, ...] | None:
    """The k-th least composite key of long columns; None for k = 0.

    Each pass counts one digit of one column among the rows that agree with all
    digits before, so that at most 2^16 counts reach the driver. Leading digits
    that these rows share take no pass of their own.
    """
    if k <= 0:
        return None
    found: list[int] = []
    for column in key:
        agreeing = rows.filter(_equal(key, found))
        unsigned = F.col(column).bitwiseXOR(F.lit(-LOW))
        low, high = (int(x) + LOW for x in agreeing.agg(F.min(column), F.max(column)).first())
        shift = -(-(low ^ high).bit_length() // DIGIT) * DIGIT
        prefix = low >> shift
        chosen = agreeing.filter(_begins(unsigned, prefix, shift))
        while shift:
            shift -= DIGIT
            digits = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            for digit, n in sorted(tuple(r) for r in chosen.groupBy(digits.alias("digit")).count().collect()):
                if k <= n:
                    break
                k -= n
            prefix = prefix << DIGIT | digit
            chosen = agreeing.filter(_begins(unsigned, prefix, shift))
            if k == n:  # all that agree so far are wanted: the greatest of them is the k-th
                return tuple(chosen.agg(F.max(F.struct(*key))).first()[0])
        found.append(prefix - LOW)
    return tuple(found)


def _begins(unsigned: Column, prefix: int, shift: int) -> Column:
    """Are the bits of a number from shift upwards these?"""
    if shift == 64:
        return F.lit(True)
    return F.shiftrightunsigned(unsigned, shift) == F.lit(prefix - (prefix >> 63 << 64)).cast("long")


def _equal(key: Sequence[str], values: Sequence[int]) -> Column:
    out = F.lit(True)
    for c, v in zip(key, values, strict=False):
        out = out & (F.col(c) == F.lit(v))
    return out


@self_cleaning
def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, order: int = 1, buckets: int = 10_000, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """Draw so many percent of the documents of at least min_words words, rounded down, by highest score, ties to the smaller id.

    Returns id_col, n_features, weight, score and rank of every document (rank
    is null if it isn't drawn), then the columns named in keep. order: the most
    words of a feature.
    """
    if clash := {id_col, *OWN} & set(keep):
        raise ValueError(f"these columns cannot be kept under their names: {sorted(clash)}")
    parts = weighed(docs, target, id_col, text_col, target_text, order, buckets, keep)
    score = (F.col("weight") + noise(F.col(id_col), seed)).alias("score")
    scored = written(parts.select("*", score, F.monotonically_increasing_id().alias("_row")), "scored")
    doc, _ = ordered_ids(scored, id_col)
    keyed = scored.withColumn("_less", F.bitwise_not("score")).withColumn("_doc", doc)
    able = keyed.filter(F.col("n_words") >= min_words)
    key = ["_less", "_doc", "_row"]
    last = radix_threshold(able, key, percent * able.count() // 100)
    if last is None:
        drawn = F.lit(False)
    else:
        a, d, r = (F.lit(x).cast("long") for x in last)
        less, own, row = map(F.col, key)
        drawn = (F.col("n_words") >= min_words) & ((less < a) | ((less == a) & ((own < d) | ((own == d) & (row <= r)))))
    out = [F.col(id_col), F.col("n_features"), F.col("weight"), F.col("score")]
    more = [F.col(f"_keep_{c}").alias(c) for c in keep]
    ranked = numbered(keyed.filter(drawn), key, "rank")
    rest = keyed.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"), *more)
    return ranked.select(*out, "rank", *more).unionByName(rest)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of the whole documents table, towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
here AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
there AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
bytes AS (SELECT w, list_transform(range(1, length(hex(w)), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT)) AS b FROM (SELECT w FROM here UNION SELECT w FROM there)),
hashed AS (SELECT w, xor(4294967295, list_reduce(b, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket FROM bytes, crc),
ours AS (SELECT bucket, count(*) AS s FROM here JOIN hashed USING (w) GROUP BY bucket),
theirs AS (SELECT bucket, count(*) AS t FROM there JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM here) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT count(*) FROM there) + 10000) AS DOUBLE))) AS g
  FROM ours LEFT JOIN theirs USING (bucket)
),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM here JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
