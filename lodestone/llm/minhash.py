"""Near-duplicates by fast similarity sketches, banding and exact verification.

A document is the set of its distinct shingles, as 64-bit hashes. A sketch has T
coordinates. In each of the first T rounds every element is thrown into one
hashed bin with a hashed value; in each of T more rounds all elements go to one
bin in turn, so that every coordinate is filled. Values of earlier rounds are
smaller, and a document's rounds end when all its bins are filled, after one or
two rounds for most. Two sets agree in a coordinate with the probability of their
Jaccard similarity J, and the number of agreeing coordinates concentrates as if
they were independent. Sets meet where a band of coordinates agrees: with 24 bands
of 4, a pair at J = 0.85 is missed with a probability of 2 in 100,000,000.

Sets that are equal are one vertex. Where several vertices share a band, all meet
one of them, a hub, and links are confirmed on the full sets; so a group of near
copies costs a comparison a member and not a pair. What is then not in one
component is met by rare element: sets that are alike share one of the elements of
theirs that the fewest sets have, which texts that only share a passage do not. A
vertex stands there once for each of these, in however many bands it met others.
There hubs, more in each round, meet the others, until each group's vertices are in
one component or have all met. No pair of a band that could join two
components is left out.

Cases: a null or blank text has an empty set and is linked with nothing, not even
with its like; fewer words than a shingle are one shingle; a null id comes after
all others and is returned as null, as is a component of null ids alone; rows
that repeat an id are linked only if their sets are; an empty table gives an empty
result; other columns are ignored. Two shingles count as one if their 64-bit
hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BLANK, forget, lean, power_of_two, self_cleaning, sized, written
from lodestone.llm.components import star_components
from lodestone.llm.wordspans import SEPARATOR, buffer_of, byte_classes, segments, slices, spans_as_array, words_of

CLASSES = byte_classes(BLANK)
#: Coordinates of a sketch and of a band.
COORDINATES, BAND = 96, 4
#: Pairs for each of the groups into which a hub's members are dealt.
MEMBERS = 4096
#: Hubs for each element, in one round after another.
HUBS = (8, 64)
#: Vertices of which the places go to all tasks; more are joined by a shuffle.
MOST_WANTED = 400_000
#: Elements of sets that are sketched together.
TOGETHER = 1 << 19
#: Bytes of text that are sketched at once.
SKETCHED = 2 << 20
MASK = (1 << 64) - 1
_EMPTY = np.uint64(MASK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit hashes of the words of each text."""
    data, at = buffer_of(column)
    rows, hashes = [], []
    for part, where, _ in segments(data, at, CLASSES, SEPARATOR):
        words = words_of(part, where, CLASSES)
        named = spans_as_array(words).dictionary_encode()
        own = np.array([xxhash.xxh3_64_intdigest(x) for x in named.dictionary.to_pylist()], dtype=np.uint64)
        hashes.append(own[named.indices.to_numpy()] if len(words.start) else own)
        rows.append(words.row)
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(rows), np.arange(1, len(column))))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(hashes))):
        total = mixed(total + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & MASK) + hashes[k : k + n])
    return np.unique(total)


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """A row of so many coordinates for each set that is not empty."""
    if 2 * size > 255:
        raise ValueError("rounds are counted in eight bits")
    out = np.full(len(sets) * size, _EMPTY)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for turn in range(2 * size):
        if not len(elements):
            break
        h = mixed(elements + np.uint64(0xD1B54A32D192ED03 * (turn + 1) & MASK))
        place = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if turn < size else np.full(len(h), turn - size)
        np.minimum.at(out, owner * size + place, (np.uint64(turn) << np.uint64(56)) | (mixed(h) >> np.uint64(8)))
        if turn < size or turn % 8 == 0:
            open_ = (out == _EMPTY).reshape(-1, size).any(axis=1)[owner]
            elements, owner = elements[open_], owner[open_]
    return out.reshape(-1, size)


def band_keys(rows: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each sketch, as signed numbers."""
    n = rows.shape[1] // band
    key = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(rows), 1))
    for k in range(band):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k : n * band : band])
    return key.view(np.int64)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    doc = F.col(id_col).cast("long")
    return [F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("none"), F.xxhash64(text_col).alias("version")]


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, none, version, n, node, bands) for each row: the size of its set, a 128-bit digest of it (null if it is empty) and its band keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SKETCHED):
            sets = [shingle_set(x, width) for x in word_hashes(batch.column(3))]
            size = np.array([len(x) for x in sets])
            full = np.flatnonzero(size)
            keys = [[] for _ in sets]
            for part in np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // TOGETHER)) + 1):
                for k, row in zip(part, band_keys(sketches([sets[k] for k in part])), strict=True):
                    keys[k] = row
            node = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32()), pa.array(np.concatenate(keys).astype(np.int64)))
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(size), pa.array(node, pa.binary()), bands], ["doc", "none", "version", "n", "node", "bands"])

    keyed = docs.select(*_row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(lean(made), "doc long, none boolean, version long, n long, node binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Write (node, set) of the documents in wanted (doc, none, version, node), sets as bytes."""
    key = ["doc", "none", "version"]
    texts = docs.select(*_row_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).join(sized(wanted, MOST_WANTED), key)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SKETCHED):
            own = [shingle_set(x, width).tobytes() for x in word_hashes(batch.column(0))]
            yield pa.record_batch([batch.column(1), pa.array(own, pa.binary())], ["node", "set"])

    return written(texts.select("text", "node").dropDuplicates(["node"]).mapInArrow(lean(made), "node binary, set binary"), "sets", "zstd")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Write those of the pairs (hub, node) of which 100 * intersection >= percent * union, as (a, b).

    A hub's members are dealt into groups, and its set goes once to each that has
    any; sets pass one by one.
    """
    groups = power_of_two(pairs.count() // MEMBERS, 16, 65_536)
    dealt = pairs.select("hub", "node", F.pmod(F.xxhash64("node"), F.lit(groups)).alias("salt"))
    hubs = dealt.select("hub", "salt").distinct().join(sets, F.col("hub") == sets["node"]).select("hub", "salt", F.lit(0).alias("kind"), sets["node"].alias("node"), "set")
    members = dealt.join(sets, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "set")
    met = hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            hub, kind, node, set_ = (batch.column(k) for k in (0, 2, 3, 4))
            for k, is_member in enumerate(kind.to_pylist()):
                elements = np.frombuffer(set_[k].as_buffer(), dtype=np.uint64)
                if not is_member:
                    own = elements.copy()
                    continue
                at = np.minimum(np.searchsorted(own, elements), len(own) - 1)
                both = int(np.count_nonzero(own[at] == elements))
                if 100 * both >= percent * (len(own) + len(elements) - both):
                    a.append(hub[k].as_py())
                    b.append(node[k].as_py())
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return written(met.mapInArrow(lean(compared), "a binary, b binary"), "confirmed", batch=64)


def rare_elements(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Write (node, element, room): of each of the nodes' sets the elements of which any similar set must share one, among those that other of the sets have.

    Elements are ordered by the number of the sets that have them. Two sets that
    share so many percent of either share one of the first n - ceil(n * percent / 100) + 1
    elements of both, of which those that no other set has need not be named.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
            size = np.array([len(x) for x in own])
            at = pa.array(np.repeat(np.arange(len(own)), size))
            yield pa.record_batch([batch.column(0).take(at), pa.array(np.repeat(size, size)), pa.array(np.concatenate(own) if own else size)], ["node", "n", "element"])

    each = written(sets.join(nodes, "node", "left_semi").mapInArrow(lean(made), "node binary, n long, element long"), "elements", batch=256)
    shared = written(each.groupBy("element").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared_elements")
    known = each.join(shared, "element").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("m", "element"))).alias("own"))  # a set's own elements
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("n") - F.size("own"))
    rooms = F.transform(F.slice("own", F.lit(1), F.greatest(first, F.lit(0)).cast("int")), lambda x, k: F.struct(x["element"].alias("element"), (F.size("own") - k).cast("long").alias("room")))
    return written(known.select("node", F.explode(rooms).alias("x")).select("node", "x.*"), "rare")


def joined_parts(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Write parts (node, part) with what the links (a, b) join; star components are made of the parts, not of their nodes."""
    if parts is None:
        return written(star_components(links).withColumnsRenamed({"vertex": "node", "root": "part"}), "parts")
    end = lambda x: parts.select(F.col("node").alias(x), F.col("part").alias(f"{x}_part"))
    known = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    stars = star_components(known.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    moved = parts.join(stars.withColumnRenamed("vertex", "part"), "part", "left").select("node", F.coalesce("root", "part").alias("part"))
    new = stars.select(F.col("vertex").alias("node"), F.col("root").alias("part")).join(parts, "node", "left_anti")
    return written(moved.union(new), "parts")


def met_parts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, part) of those of the members (key, node, n) that similar ones join, over any number of steps, if they share a key; none if no members share any.

    First one hub of each key meets its other members. Where these are then in
    several components, members go on under their rare elements, once each and not
    once a key, which drops no link: similar sets share such an element. There one
    hub for each of 8, then 64 of an element's hash classes meets its other members,
    but for those known to be in its component, and then leaves it. Last, all
    that is left under an element meets.
    """
    label = members.select("key", "node", "n", F.col("n").alias("room"), F.col("node").alias("part"))
    parts = None
    for classes in (1, *HUBS, None):
        several = label.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
        left = written(label.join(several, "key"), "members")
        if left.isEmpty():
            return parts
        if classes:
            of_class = left.groupBy("key", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(classes)).alias("class")).agg(F.min(F.struct("node", "n", "room", "part")).alias("hub"))
            hubs, once = written(of_class.select("key", "hub.*"), "hubs"), F.lit(True)
        else:
            hubs, once = left, F.col("hub_node") < F.col("node")
        fits = (100 + percent) * F.least("room", "hub_room") >= percent * (F.col("n") + F.col("hub_n"))
        own = hubs.select("key", *(F.col(c).alias(f"hub_{c}") for c in ("node", "n", "room", "part")))
        pairs = left.join(own, "key").filter((F.col("part") != F.col("hub_part")) & fits & once)
        pairs = written(pairs.select(F.least("hub_node", "node").alias("hub"), F.greatest("hub_node", "node").alias("node")).distinct(), "pairs")
        first, parts = parts is None, joined_parts(parts, confirmed(pairs, sets, percent))
        if not classes:
            return parts
        rest = left.join(hubs.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "room")
        label = written(rest.join(parts, "node", "left").select("key", "node", "n", "room", F.coalesce("part", "node").alias("part")), "label")
        if first:
            label = written(refined(label, sets, percent), "refined")
        forget(left)


def refined(label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of label (key, node, n, room, part) of keys with several parts, each node under its rare elements instead and once for each."""
    several = label.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    nodes = written(label.join(several, "key").select("node", "n", "part").distinct(), "left")
    rare = rare_elements(sets, nodes.select("node"), percent)
    return nodes.join(rare, "node").select(F.col("element").alias("key"), "node", "n", "room", "part")


@self_cleaning
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """Return id_col, n_shingles, component_id (the smallest id that a row reaches over links, itself included) and kept (is it that row's own id?).

    Rows are linked if 100 * intersection >= percent * union of their sets of shingles of so many words.
    """
    marked = written(sketched(docs, id_col, text_col, width), "sketched")
    nodes = written(marked.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("none", "doc", "version", "n", "bands")).alias("rep")).select("node", "rep.*"), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "shared")
    members = written(banded.join(shared, "key").select("key", "node", "n"), "shared_bands")
    wanted = written(nodes.join(members.select("node").distinct(), "node", "left_semi").select("doc", "none", "version", "node"), "wanted")
    parts = met_parts(members, full_sets(docs, wanted, id_col, text_col, width), percent)
    named = nodes.select("node", F.struct("none", "doc").alias("rep"))
    if parts is None:
        classes = named.withColumnRenamed("rep", "component")
    else:
        grouped = written(named.join(parts, "node", "left").select("node", "rep", F.coalesce("part", "node").alias("group")), "grouped")
        least = grouped.groupBy("group").agg(F.min("rep").alias("component"))
        classes = grouped.select("node", "group").join(least, "group").select("node", "component")
    classes = written(classes, "classes")
    found = marked.select("doc", "none", "n", "node").join(classes, "node", "left")
    component = F.coalesce("component", F.struct("none", "doc"))
    known = lambda x: F.when(~x["none"], x["doc"])
    own = F.struct("none", "doc")
    return found.select(known(own).alias(id_col), F.col("n").alias("n_shingles"), known(component).alias("component_id"), (component == own).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.b, root FROM reach JOIN links ON links.a = reach.doc_id WHERE root < links.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
