"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within three bits of each other have a variant in
common, at most one bit (half the radius, rounded down) from the one and at most
two bits (half, rounded up) from the other. So every distinct fingerprint makes
all variants of both balls, 65 and 2,081, and variants meet: what shares one is
linked, verified by the balls' own sizes. The shuffle is by the variants'
leading bits, their slice; a fingerprint travels once to each slice and its
variants there are made in the task, so that what is shuffled is a small part of
the variants. Within a slice links are reduced to a tree, so that fingerprints
that lie together in any number are never expanded into pairs. Documents of one
fingerprint are one vertex.

Cases: null, empty and blank texts have no words and fingerprint zero, and are
linked like any other; a null id counts as larger than all others and is
returned as null, as is a component of null ids alone; rows that repeat an id
are linked to each other only if their fingerprints are; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import lean, pieces, self_cleaning, written
from lodestone.llm.components import star_components

SEED = 42
#: Fingerprints that a slice of the variants holds on average, and the bits that name a slice at most.
SLICE_ROWS = 20_000
MOST_BITS = 24
#: Centres whose variants are held at once.
CENTRES = 50_000


def simhash(text: str | None, width: int) -> int:
    """The fingerprint of a text over shingles of so many words, as a signed 64-bit number."""
    counts, n, held = np.zeros(64, dtype=np.int64), 0, []
    for words, last in pieces(text):
        held += words
        if last and not n and held and len(held) < width:
            shingles = [b" ".join(held)]
        else:
            shingles = map(b" ".join, zip(*(held[k:] for k in range(width)), strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype="<u8")
        n += len(hashes)
        for k in range(0, len(hashes), 8192):
            counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        held = held[len(held) - width + 1 :] if width > 1 and len(held) >= width else held if len(held) < width else []
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _row_key(id_col: str, text_col: str) -> list[Column]:
    doc = F.col(id_col).cast("long")
    return [F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("none"), F.xxhash64(text_col).alias("version")]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, none, version, fp) for each row; a null id is 0 with none set, version is a hash of the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(x, width) for x in batch.column(3).to_pylist()]
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(fp, pa.int64())], ["doc", "none", "version", "fp"])

    keyed = docs.select(*_row_key(id_col, text_col), F.col(text_col))
    return keyed.mapInArrow(lean(made), "doc long, none boolean, version long, fp long")


def flips(bits: int, number: int) -> np.ndarray:
    """All masks of so many of the lowest bits."""
    return np.array([sum(1 << k for k in own) for own in combinations(range(bits), number)], dtype=np.uint64)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the least that it reaches over links a - b."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def met(slice_: int, fps: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of which variants meet in a slice of the variants, one less than fingerprints at most.

    Variants of the smaller ball that are the same link their centres; those of
    the larger ball look them up. Each variant stands for one centre, so the
    work is linear in the fingerprints, however many lie together.
    """
    small, large = radius // 2, radius - radius // 2
    rest = 64 - bits
    base = (np.uint64(slice_) << np.uint64(rest)) | (fps & np.uint64((1 << rest) - 1))
    away = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(slice_))
    masks = [np.concatenate([flips(rest, j) for j in range(k + 1)]) for k in range(large + 1)]

    def variants(own: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for f in range(reach + 1):
            at, mask = own[away[own] == f], masks[reach - f]
            step = max(1, 1_000_000 // len(mask))
            for k in range(0, len(at), step):
                yield (base[at[k : k + step], None] ^ mask[None]).reshape(-1), np.repeat(at[k : k + step], len(mask))

    label, every = np.arange(len(fps)), np.arange(len(fps))
    centres = np.flatnonzero(away <= small)
    for k in range(0, len(centres), CENTRES):
        parts = list(variants(centres[k : k + CENTRES], small))
        key, owner = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        pairs = [(owner[same], owner[same + 1])]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, owner = key[first], owner[first]
        for variant, of in variants(every, large):
            at = np.minimum(np.searchsorted(key, variant), len(key) - 1)
            hit = np.flatnonzero((key[at] == variant) & (owner[at] != of))
            pairs.append((owner[at[hit]], of[hit]))
        a, b = (np.concatenate([label, *(x[i] for x in pairs)]) if i else np.concatenate([every, *(x[0] for x in pairs)]) for i in (0, 1))
        label = least_labels(len(fps), a, b)
    hung = np.flatnonzero(label != every)
    return fps[hung], fps[label[hung]]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all that are within so many bits, over any number of steps, and no others.

    The variants' leading bits deal them out: a fingerprint goes to each slice
    that holds one of its variants, and the task there makes them.
    """
    if radius > 3:
        raise ValueError("balls are made for pairs within three bits")
    n, large = nodes.count(), radius - radius // 2
    reach = lambda bits: sum(comb(bits, k) for k in range(large + 1))
    bits = next((k for k in range(6, MOST_BITS) if n * reach(k) >> k <= SLICE_ROWS), MOST_BITS)
    masks = [int(x) << (64 - bits) for k in range(large + 1) for x in flips(bits, k).tolist()]
    signed = F.array(*(F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in masks))
    dealt = nodes.select("fp", F.explode(signed).alias("mask")).select("fp", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("mask")), 64 - bits).alias("slice"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def solved() -> pa.RecordBatch:
            a, b = met(now, np.concatenate(held).view(np.uint64), bits, radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            fp, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for x, y in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
                if held and of[x] != now:
                    yield solved()
                    held = []
                now = int(of[x])
                held.append(fp[x:y])
        if held:
            yield solved()

    gathered = dealt.repartition("slice").sortWithinPartitions("slice")
    return gathered.mapInArrow(lean(joined), "a long, b long").distinct()


@self_cleaning
def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    """(doc, none, version, fp, group, component): group is a fingerprint that names the component, component its least id, as (none, doc)."""
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(F.struct("none", "doc")).alias("rep")), "nodes")
    roots = written(star_components(links(nodes, radius)), "roots")
    grouped = written(nodes.join(roots, nodes["fp"] == roots["vertex"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("group")), "grouped")
    least = grouped.groupBy("group").agg(F.min("rep").alias("component"))
    classes = written(grouped.select("fp", "group").join(least, "group"), "classes")
    return marked.join(classes, "fp").select("doc", "none", "version", "fp", "group", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Return id_col, fp (signed 64-bit) and component_id, the smallest id that a row reaches over links."""
    known = lambda c: F.when(~F.col(f"{c}none"), F.col(f"{c}doc"))
    return _classes(docs, id_col, text_col, width, radius).select(known("").alias(id_col), "fp", known("component.").alias("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each component: one of its smallest id."""
    key = ["doc", "none", "version"]
    found = _classes(docs, id_col, text_col, width, radius).filter(F.struct("none", "doc") == F.col("component"))
    first = found.groupBy("group", "doc", "none").agg(F.min("version").alias("version"))
    kept = written(first.join(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key).select(*(F.col(c).alias(f"__{c}") for c in key), "n"), "kept")
    same = [own == F.col(f"__{c}") for own, c in zip(_row_key(id_col, text_col), key, strict=True)]
    left = docs.join(kept.drop("n"), same[0] & same[1] & same[2], "left_semi")
    return left if kept.filter("n > 1").isEmpty() else left.dropDuplicates([id_col, text_col])
