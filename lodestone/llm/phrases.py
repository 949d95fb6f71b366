"""Phrase collocations from compressed position bitmaps.

The documents are cut into shards of some million words. In a shard every word
has a position, with one left free before each piece, and every (language, word)
a bitmap of its positions: eight positions a block, only blocks with a bit set
are kept, their numbers as gaps. A phrase's bitmap marks the positions of its last
word. It is extended by a word by moving it one position on and intersecting it
with the word's bitmap; across a free position nothing meets. Supports are bits
counted in each shard and summed over the shards.

The words' bitmaps are a table, of a row for each word and shard. Words that are
frequent over all shards go back to their shards, where all pairs are made and
counted; pairs that are frequent over all shards are then extended, class by class of
first pairs, to three words and at once to four. So a shard makes no phrase that holds
an infrequent word, and no longer one that holds an infrequent pair. Up to four
million frequent pairs are sent to all shards as numbers; of more, their bitmaps are
written and go back by a join. No vocabulary is sent without a bound.

Cases: a null text is empty and a null language is `und`; a language without a
candidate gives no row; equal scores and counts are ordered by phrase in the order
of UTF-8 bytes; repeated rows count as often as they stand there; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import lean, numbered, power_of_two, self_cleaning, sized, written
from lodestone.llm.wordspans import BREAK, buffer_of, byte_classes, segments, slices, spans_as_array, words_of

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words of a shard, and pairs of blocks that are intersected at once.
SHARD_WORDS = 1 << 21
TOGETHER = 1 << 20
#: Rows of a batch that goes back to Spark.
BATCH = 200_000
#: Frequent words that go to all tasks by a join; more are joined by a shuffle.
MOST_SENT = 400_000
#: Frequent pairs that go to all tasks as numbers, 32 MB at most; of more, the bitmaps are written and joined.
MOST_PAIRS = 1 << 22


class Bitmaps(NamedTuple):
    """Blocks of bitmaps: the number of the bitmap, of the block, and eight bits. Sorted by bitmap, then block."""

    of: np.ndarray
    block: np.ndarray
    bits: np.ndarray


def bitmaps(of: np.ndarray, position: np.ndarray) -> Bitmaps:
    """Bitmaps of positions, which come sorted by bitmap, then position."""
    return merged(of.astype(np.int32), (position >> 3).astype(np.int32), np.left_shift(1, position & 7).astype(np.uint8))


def merged(of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
    """Blocks of one bitmap and number become one; they come sorted."""
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])])) if len(of) else np.zeros(0, dtype=np.int64)
    return Bitmaps(of[new], block[new], np.bitwise_or.reduceat(bits, new) if len(new) else bits)


def packed(maps: Bitmaps, number: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each of so many bitmaps the number of positions, the gaps between its blocks in seven bits a byte, and the blocks' bits."""
    size = np.bincount(maps.of, minlength=number)
    past = np.concatenate([[0], np.cumsum(size)])
    gap = np.diff(maps.block, prepend=0)
    own = past[:-1][size > 0]
    gap[own] = maps.block[own]
    width = 1 + sum((gap >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(at[-1], dtype=np.uint8)
    for k in range(5):
        some = np.flatnonzero(width > k)
        out[at[some] + k] = (gap[some] >> 7 * k & 127) | ((width[some] > k + 1) << 7)
    binary = lambda ends, data: pa.Array.from_buffers(pa.large_binary(), number, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    count = np.bincount(maps.of, weights=np.bitwise_count(maps.bits), minlength=number).astype(np.int64)
    return count, binary(at[past], out), binary(past, maps.bits)


def unpacked(gaps: pa.Array, bits: pa.Array) -> Bitmaps:
    """The bitmaps of rows; bitmaps are numbered by row."""
    plain = lambda x: (np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset : x.offset + len(x) + 1], np.frombuffer(x.buffers()[2] or b"", dtype=np.uint8))
    (gap_at, gap), (bit_at, bit) = (plain(x.cast(pa.large_binary())) for x in (gaps, bits))
    gap, bit = gap[gap_at[0] : gap_at[-1]], bit[bit_at[0] : bit_at[-1]]
    size = np.diff(bit_at)
    last = np.flatnonzero(gap < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    value = np.zeros(len(last), dtype=np.int64)
    for k in range(5):
        some = np.flatnonzero(last - start >= k)
        value[some] |= (gap[start[some] + k].astype(np.int64) & 127) << 7 * k
    block = np.cumsum(value)
    first = (bit_at[:-1] - bit_at[0])[size > 0]
    block -= np.repeat(block[first] - value[first], size[size > 0])
    return Bitmaps(np.repeat(np.arange(len(size), dtype=np.int32), size), block.astype(np.int32), bit.copy())


def sorted_by_block(maps: Bitmaps) -> tuple[Bitmaps, np.ndarray]:
    """The blocks of all bitmaps by number, and where each number begins."""
    order = np.argsort(maps.block, kind="stable")
    whole = Bitmaps(*(x[order] for x in maps))
    last = int(whole.block[-1]) if len(order) else 0
    return whole, np.searchsorted(whole.block, np.arange(last + 3, dtype=np.int32)).astype(np.int32)


def extended(prefix: Bitmaps, others: tuple[Bitmaps, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of prefixes moved on by one position and intersected with all others, sorted by block: prefix, other, block and bits where any bit is left."""
    by_block, begins = others
    of, block = np.concatenate([prefix.of, prefix.of]), np.concatenate([prefix.block, prefix.block + 1])
    bits = np.concatenate([(prefix.bits << 1).astype(np.uint8), prefix.bits >> 7])
    some = np.flatnonzero((bits > 0) & (block < len(begins) - 1))
    of, block, bits = of[some], block[some], bits[some]
    low = begins[block]
    size = begins[block + 1] - low
    mine = np.repeat(np.arange(len(of), dtype=np.int32), size)
    past = np.cumsum(size)
    other = np.arange(past[-1] if len(past) else 0) - np.repeat(past - size - low, size)
    both = bits[mine] & by_block.bits[other]
    left = np.flatnonzero(both)
    mine = mine[left]
    return of[mine].astype(np.int64), by_block.of[other[left]].astype(np.int64), block[mine], both[left]


def classes_of(prefix: Bitmaps, others: tuple[Bitmaps, np.ndarray]) -> Iterator[Bitmaps]:
    """The prefixes in classes that make about so many intersections."""
    begins = others[1]
    part = np.cumsum(begins[np.minimum(prefix.block + 2, len(begins) - 1)] - begins[np.minimum(prefix.block, len(begins) - 1)], dtype=np.int64) // TOGETHER
    first = np.flatnonzero(np.concatenate([[True], prefix.of[1:] != prefix.of[:-1]])) if len(prefix.of) else np.zeros(0, dtype=np.int64)
    cuts = [0, *first[1:][np.diff(part[first]) > 0], len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield Bitmaps(*(x[a:b] for x in prefix))


def named(keys: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, Bitmaps]:
    """Distinct keys, and their bitmaps."""
    order = np.lexsort((block, keys))
    keys, block, bits = keys[order], block[order], bits[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    return keys[new], merged((np.cumsum(new) - 1).astype(np.int32), block, bits)


def in_batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.record_batch(columns, names)
    for at in range(0, whole.num_rows, BATCH):
        yield whole.slice(at, BATCH)


def word_bitmaps(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """(shard, lang, word, n, gaps, bits): the bitmap of each language's word in each shard."""
    names = ["shard", "lang", "word", "n", "gaps", "bits"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        words, langs, places, at = [], [], [], 0
        known: dict[str, int] = {}

        def shard() -> Iterator[pa.RecordBatch]:
            code = pa.chunked_array(words).dictionary_encode().combine_chunks()
            words.clear()
            small = len(code.dictionary) * len(known) < 1 << 31
            key = code.indices.to_numpy().astype(np.int32 if small else np.int64) * len(known) + np.concatenate(langs)
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            own = key[new].astype(np.int64)
            place = np.concatenate(places)[order]
            del key, order
            langs.clear()
            places.clear()
            maps = bitmaps(np.cumsum(new, dtype=np.int32) - 1, place)
            del new, place
            count, gaps, bits = packed(maps, len(own))
            lang = pa.array(list(known)).take(pa.array(own % len(known)))
            word = code.dictionary.take(pa.array(own // len(known))).cast(pa.large_string())
            yield from in_batches([pa.array(np.full(len(own), turn)), lang, word, pa.array(count), gaps, bits], names)

        for batch in slices(batches, 0):
            row_lang = np.array([known.setdefault(x, len(known)) for x in batch.column(1).to_pylist()], dtype=np.int32)
            data, where = buffer_of(batch.column(0))
            for part, starts, _ in segments(data, where, CLASSES, BREAK):
                found = words_of(part, starts, CLASSES)
                if not len(found.start):
                    continue
                words.append(spans_as_array(found))
                langs.append(row_lang[found.row])
                places.append((at + np.cumsum(1 + found.first)).astype(np.int32))
                at = int(places[-1][-1])
                if at >= shard_words:
                    yield from shard()
                    turn, at = turn + 1, 0
                    known.clear()
                    row_lang = np.array([known.setdefault(x, len(known)) for x in batch.column(1).to_pylist()], dtype=np.int32)
        if words:
            yield from shard()

    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return texts.mapInArrow(lean(made), "shard long, lang string, word string, n long, gaps binary, bits binary")


def by_shard(rows: DataFrame, task: Callable[[np.ndarray, Bitmaps], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the rows (shard, key, gaps, bits) of each shard together and give their keys and bitmaps to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, maps, n = None, [], [], 0

        def solved() -> Iterator[pa.RecordBatch]:
            if n:
                whole = Bitmaps(*(np.concatenate([m[k] for m in maps]) for k in range(3)))
                for batch in task(np.concatenate(keys), whole):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, now)), *batch.columns], ["shard", *batch.schema.names])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)] if len(of) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if of[a] != now:
                    yield from solved()
                    now, keys, maps, n = int(of[a]), [], [], 0
                own = unpacked(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a))
                keys.append(batch.column(1).to_numpy()[a:b])
                maps.append(own._replace(of=own.of + n))
                n += b - a
        yield from solved()

    return rows.select("shard", "key", "gaps", "bits").repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), schema)


def pairs_in_shard(ids: np.ndarray, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    """(key, n, gaps, bits) of all pairs of words that stand side by side; a key is the first word's id and the second's in 32 bits each."""
    others = sorted_by_block(maps)
    for part in classes_of(maps, others):
        a, b, block, bits = extended(part, others)
        keys, own = named(ids[a] << 32 | ids[b], block, bits)
        count, gaps, own_bits = packed(own, len(keys))
        yield from in_batches([pa.array(keys), pa.array(count), gaps, own_bits], ["key", "n", "gaps", "bits"])


def pair_counts_in_shard(ids: np.ndarray, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    """(key, n) of all pairs of words that stand side by side."""
    for batch in pairs_in_shard(ids, maps):
        yield batch.select(["key", "n"])


def longer_of_known(known: np.ndarray, ids: np.ndarray, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    """longer_in_shard, from the words' bitmaps and the sorted keys of all frequent pairs."""
    others, keys, parts, n = sorted_by_block(maps), [], [], 0
    for part in classes_of(maps, others):
        a, b, block, bits = extended(part, others)
        pair = ids[a] << 32 | ids[b]
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        some = np.flatnonzero(known[at] == pair) if len(known) else np.zeros(0, dtype=np.int64)
        own, made = named(pair[some], block[some], bits[some])
        keys.append(own)
        parts.append(made._replace(of=made.of + np.int32(n)))
        n += len(own)
    del others
    if n:
        yield from longer_in_shard(np.concatenate(keys), Bitmaps(*(np.concatenate([p[k] for p in parts]) for k in range(3))))


def longer_in_shard(pairs: np.ndarray, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    """(first, rest, n) of phrases of three and four words: the first two words' ids, and the others'."""
    others, second = sorted_by_block(maps), pairs & 0xFFFFFFFF
    for part in classes_of(maps, others):
        a, b, block, bits = extended(part, others)
        both, three = named(a << 32 | b, block, bits)
        a, b = both >> 32, both & 0xFFFFFFFF
        yield from counted(pairs[a], second[b], three)
        for class_ in classes_of(three, others):
            c, d, block, bits = extended(class_, others)
            both, four = named(c << 32 | d, block, bits)
            c, d = both >> 32, both & 0xFFFFFFFF
            yield from counted(pairs[a[c]], second[b[c]] << 32 | second[d], four)


def counted(first: np.ndarray, rest: np.ndarray, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    n = np.bincount(maps.of, weights=np.bitwise_count(maps.bits), minlength=len(first)).astype(np.int64)
    yield from in_batches([pa.array(first), pa.array(rest), pa.array(n)], ["first", "rest", "n"])


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, support: int, shard_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the frequent words (lang, word, f, id), the frequent phrases of two to four words (first, rest, f) and all languages' words (lang, n)."""
    single = written(word_bitmaps(docs, text_col, lang_col, shard_words), "words")
    enough = F.col("f") >= support
    total = written(single.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    words = numbered(single.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(enough), ["lang", "word"], "id")
    words = written(words, "frequent_words")
    if (words.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("ids of frequent words take 31 bits")
    back = single.join(sized(words.select("lang", "word", F.col("id").alias("key")), MOST_SENT), ["lang", "word"])
    counts = by_shard(back, pair_counts_in_shard, "shard long, key long, n long").groupBy("key").agg(F.sum("n").alias("f")).filter(enough)
    pairs = written(counts, "frequent_pairs")
    if pairs.count() <= MOST_PAIRS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(pairs.select("key").toArrow()["key"].to_numpy()))
        longer = by_shard(back, lambda ids, maps: longer_of_known(known.value, ids, maps), "shard long, first long, rest long, n long")
    else:
        double = written(by_shard(back, pairs_in_shard, "shard long, key long, n long, gaps binary, bits binary"), "pairs")
        longer = by_shard(double.join(pairs.select("key"), "key", "left_semi"), longer_in_shard, "shard long, first long, rest long, n long")
    longer = longer.groupBy("first", "rest").agg(F.sum("n").alias("f")).filter(enough)
    phrases = written(pairs.select(F.col("key").alias("first"), F.lit(0).cast("long").alias("rest"), "f").union(longer), "phrases")
    return words, phrases, total


def word_ids() -> list[Column]:
    """The ids of a phrase's four words; 0 where it has fewer."""
    first, rest = F.col("first"), F.col("rest")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    three = F.shiftright(rest, 32)
    return [F.shiftright(first, 32), low(first), F.when(three > 0, three).otherwise(rest), F.when(three > 0, low(rest)).otherwise(0)]


def part_key(ids: list[Column]) -> Column:
    """The key of a run of one to four words: ids of two words in each of two numbers; a single word is its id."""
    two = lambda x: F.shiftleft(x[0], 32).bitwiseOR(x[1]) if len(x) == 2 else x[0] if x else F.lit(0).cast("long")
    return F.struct(two(ids[:2]).alias("first"), two(ids[2:]).alias("rest"))


def best_cuts(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(first, rest, a, l, r, score) of every phrase: the cut of the lowest score."""
    w = word_ids()
    size = F.when(w[3] > 0, 4).when(w[2] > 0, 3).otherwise(2)
    cut = lambda n, k: F.struct(F.lit(k).alias("k"), part_key(w[:k]).alias("left"), part_key(w[k:n]).alias("right"))
    cuts = reduce(lambda out, n: out.when(size == n, F.array(*(cut(n, k) for k in range(1, n)))), (3, 4), F.when(size == 2, F.array(cut(2, 1))))
    each = phrases.select("first", "rest", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("first", "rest", "a", "c.*")
    known = written(words.select(F.col("id").alias("first"), F.lit(0).cast("long").alias("rest"), "f").union(phrases), "counts")
    side = lambda name, count: known.select(F.col("first").alias(f"{name}_first"), F.col("rest").alias(f"{name}_rest"), F.col("f").alias(count))
    each = each.select("first", "rest", "a", "k", *(F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in ("left", "right") for p in ("first", "rest")))
    both = each.join(side("left", "l"), ["left_first", "left_rest"]).join(side("right", "r"), ["right_first", "right_rest"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    least = both.groupBy("first", "rest").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x"))
    return least.select("first", "rest", "x.a", "x.l", "x.r", "x.score")


def absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """(first, rest) of the phrases that stand inside a longer one of at least so many percent of their count."""
    w = word_ids()
    inside = lambda n, size: [part_key(w[k : k + size]) for k in range(n - size + 1)]
    parts = F.when(w[3] > 0, F.array(*inside(4, 2), *inside(4, 3))).when(w[2] > 0, F.array(*inside(3, 2)))
    around = phrases.select("f", F.explode(parts).alias("p")).groupBy("p.first", "p.rest").agg(F.max("f").alias("longer"))
    held = F.expr(f"CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(f AS DECIMAL(19, 0)) * {percent}")
    return phrases.join(around, ["first", "rest"]).filter(held).select("first", "rest")


@self_cleaning
def collocations(docs: DataFrame, support: int = 30, absorb_percent: int = 80, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Phrases of two to four words that occur at least support times, by language: lang, rank, phrase, a, l, r, n, score.

    The score is that of the phrase's weakest cut, 2,000,000 * a / (l + r),
    rounded down. Phrases inside a longer one of at least absorb_percent of their
    count are left out. top: the first so many of each language, or all.
    """
    words, phrases, total = frequent_phrases(docs, text_col, lang_col, support, shard_words)
    scored = best_cuts(words, phrases).join(written(absorbed(phrases, absorb_percent), "absorbed"), ["first", "rest"], "left_anti")
    ids = F.explode(F.filter(F.transform(F.array(*word_ids()), lambda x, k: F.struct(k.alias("k"), x.alias("id"))), lambda x: x["id"] > 0))
    each = written(scored.withColumn("x", ids).select("first", "rest", "a", "l", "r", "score", "x.k", "x.id"), "scored")
    spelt = each.join(words.select("id", "lang", "word"), "id").groupBy("first", "rest", "a", "l", "r", "score")
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]))
    ready = written(spelt.agg(F.min("lang").alias("lang"), text.alias("phrase")), "spelt")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language may hold most phrases: its first are those of its shares' first
        shares = power_of_two(ready.count() // 50_000, 8, 256)
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        ready = ready.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
        ranked = ready.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    else:
        least = ready.withColumn("_less", -F.col("score")).withColumn("_fewer", -F.col("a"))
        whole = numbered(least, ["lang", "_less", "_fewer", "phrase"], "_number")
        base = whole.groupBy("lang").agg((F.min("_number") - 1).alias("_before"))
        ranked = whole.join(base, "lang").withColumn("rank", F.col("_number") - F.col("_before"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM starts),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.c AS l, y.c AS r, cut, (2000000::HUGEINT * a // (x.c + y.c))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_sizes AS (SELECT lang, k, w, a, unnest(range(2, k)) AS size FROM candidates WHERE k > 2),
inner_starts AS (SELECT *, unnest(range(1, k - size + 2)) AS i FROM inner_sizes),
around AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_starts GROUP BY ALL),
left_over AS (SELECT weakest.* FROM weakest LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
