"""Benchmark decontamination over a distributed positional inverted index.

The index holds a posting (document, term, position) for each training token
whose term stands in the test set (others cannot take part in a match), and for
each document an end mark, the empty term at the position after its last word.
A window of test words is looked up from its rarest term: that term's postings,
shifted by its offset, are the alignments of test item and document; they are
intersected with the shifted postings of the second rarest term, and what is
left with those of all other terms. Runs of neighbouring matches as long as a
window are exact occurrences.

Everything is DataFrame code. Rare terms come from counts over the whole index.
Only tables of test words, and ids of documents up to a checked number, are
broadcast; beyond that the same joins shuffle.

Cases: a null or empty text has no words and is never hit; an item without
words has no windows; items with a null id are left out unless unnamed is set,
as the query and the pipeline do, and then only their id is left out of the list; items that repeat an id count once a
document; rows that repeat an id are told apart by their texts, and rows that
repeat both get the same result each; a null id is kept; empty tables give no
hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import NULL_ID, ascii_lower, self_cleaning, sized, written

#: What separates words: all of ASCII but digits and letters. Fixed by the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END_MARK = ""
DOC = ("doc", "version")
MOST_TEST_ROWS = 2_000_000
MOST_DOC_IDS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def document_key(id_col: str, text_col: str) -> list[Column]:
    """A document is its id and a hash of its text, as ids may repeat; the hash's last bit tells a null id."""
    none = F.col(id_col).isNull().cast("long")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_col).bitwiseAND(F.lit(-2)).bitwiseOR(none).alias("version")]


def document_id() -> Column:
    """The id that a document's key was made of."""
    return F.when((F.col("doc") != NULL_ID) | (F.col("version").bitwiseAND(F.lit(1)) == 0), F.col("doc"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write and return postings (doc, version, term, pos); terms: the vocabulary to keep, None for all."""
    marked = docs.select(*document_key(id_col, text_col), F.posexplode(F.array_append(words(F.col(text_col)), F.lit(END_MARK))).alias("pos", "term"))
    if terms is not None:
        vocabulary = written(terms.select("term").union(docs.sparkSession.createDataFrame([(END_MARK,)], "term string")).distinct(), "vocabulary")
        marked = marked.join(sized(vocabulary, MOST_TEST_ROWS), "term", "left_semi")
    return written(marked.select(*DOC, "term", "pos"), "postings")


def test_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """Write and return (item, item_id as text, j, term, n): the words of each item; unnamed: also of items without id."""
    kept = items.filter(F.col(id_col).isNotNull() | F.lit(unnamed)).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
    numbered = kept.withColumn("item", F.monotonically_increasing_id())
    return written(numbered.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("j", "term")), "items")


def anchors(item_words: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """The two rarest offsets (j1, t1, j2, t2) of each window; j2 is null in windows of one word.

    Windows with a term that the index lacks are left out: they occur nowhere.
    """
    counts = index.filter(F.col("term") != END_MARK).groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    known = written(item_words.join(counts, "term", "left").select("item", "j", "term", "n", F.coalesce("f", F.lit(0)).alias("f")), "frequencies")
    length = F.least(F.lit(width), F.col("n"))
    start = F.explode(F.sequence(F.greatest(F.col("j") - length + 1, F.lit(0)), F.least(F.col("j"), F.col("n") - length)))
    inside = known.select("*", start.alias("s"))
    window = Window.partitionBy("item", "s")
    ranked = inside.select("item", "s", "j", "term", "f", F.min("f").over(window).alias("least"), F.row_number().over(window.orderBy("f", "j")).alias("k"))
    first, second = F.when(F.col("k") == 1, F.struct("j", "term")), F.when(F.col("k") == 2, F.struct("j", "term"))
    pairs = ranked.filter("least > 0 AND k <= 2").groupBy("item", "s").agg(F.max(first).alias("a"), F.max(second).alias("b"))
    return written(pairs.select("item", F.col("a.j").alias("j1"), F.col("a.term").alias("t1"), F.col("b.j").alias("j2"), F.col("b.term").alias("t2")).distinct(), "anchors")


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, doc, version, shift): document position minus item offset where two rarest terms of a window agree."""
    firsts = sized(pairs.select(F.col("t1").alias("term"), "item", "j1").distinct(), MOST_TEST_ROWS)
    begun = index.join(firsts, "term").select("item", *DOC, (F.col("pos") - F.col("j1")).alias("shift"), "j1")
    seconds = sized(pairs.filter("j2 IS NOT NULL").select("item", "j1", "j2", F.col("t2").alias("term")), MOST_TEST_ROWS)
    probes = begun.join(seconds, ["item", "j1"]).select("item", *DOC, "shift", (F.col("shift") + F.col("j2")).alias("pos"), "term").filter("pos >= 0")
    rare = index.join(sized(pairs.select(F.col("t2").alias("term")).filter("term IS NOT NULL").distinct(), MOST_TEST_ROWS), "term", "left_semi")
    both = probes.join(rare, [*DOC, "pos", "term"]).select("item", *DOC, "shift")
    lone = begun.join(sized(pairs.filter("j2 IS NULL").select("item", "j1"), MOST_TEST_ROWS), ["item", "j1"], "left_semi").select("item", *DOC, "shift")
    return written(both.union(lone).distinct(), "alignments")


def occurrences(index: DataFrame, item_words: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(item_id, doc, version, first, last): runs of matching words at least as long as the item's windows."""
    there = written(found.select(*DOC).distinct(), "aligned")
    nearby = index.join(sized(there, MOST_DOC_IDS), list(DOC), "left_semi")
    probes = found.join(sized(item_words, MOST_TEST_ROWS), "item").select("item", "item_id", "n", *DOC, "shift", "j", (F.col("shift") + F.col("j")).alias("pos"), "term").filter("pos >= 0")
    hits = probes.join(nearby, [*DOC, "pos", "term"]).select("item", "item_id", "n", *DOC, "shift", "pos")
    one = Window.partitionBy("item", *DOC, "shift").orderBy("pos")
    runs = hits.distinct().withColumn("run", F.col("pos") - F.row_number().over(one)).groupBy("item", "item_id", "n", *DOC, "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.lit(width), "n")).select("item_id", *DOC, "first", "last")


@self_cleaning
def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, unnamed: bool = False) -> DataFrame:
    """For each document: doc, version, n_words, n_hit (words in occurring windows), items (their ids, sorted), unnamed (1 if an item without id is among them)."""
    item_words = test_words(items, item_id_col, item_text_col, unnamed)
    index = build_index(docs, item_words, id_col, text_col)
    found = occurrences(index, item_words, alignments(index, anchors(item_words, index, width)), width)
    found = written(found, "occurrences")
    order = Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select(*DOC, "first", "last").distinct().withColumn("reached", F.coalesce(F.max("last").over(order), F.lit(-1)))
    covered = spans.groupBy(*DOC).agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("reached") + 1) + 1)).alias("n_hit"))
    named = found.groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    hit = covered.join(named, list(DOC))
    whole = index.filter(F.col("term") == END_MARK).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    return whole.join(hit, list(DOC), "left").select(*DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(0)).alias("unnamed"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, unnamed: bool = False) -> DataFrame:
    """docs without the documents that hold a whole window of a test item."""
    hit = written(contamination(docs, items, id_col, text_col, width=width, unnamed=unnamed).filter("n_hit > 0").select(*DOC).distinct(), "contaminated")
    keyed = docs.select("*", *(c.alias(f"__key_{n}") for c, n in zip(document_key(id_col, text_col), DOC, strict=True)))
    small = sized(hit, MOST_DOC_IDS)
    same = [F.col(f"__key_{n}") == small[n] for n in DOC]
    return keyed.join(small, same[0] & same[1], "left_anti").select(docs.columns)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, doc, version, first, last): the item's words in their order, at most slop other words between neighbours.

    The walk begins with the rarest of the item's first and last words and joins
    one shifted posting list after the other; each start counts with its nearest end.
    """
    item_words = test_words(items, item_id_col, item_text_col)
    gaps = F.explode(F.sequence(F.lit(1), F.lit(slop + 1)))
    now = index.join(sized(item_words.filter("j = 0"), MOST_TEST_ROWS), "term").select("item", "item_id", "n", *DOC, F.col("pos").alias("first"), "pos")
    longest = item_words.agg(F.max("n")).first()[0] or 0
    done = now.filter("n = 1")
    for j in range(1, longest):
        step = sized(item_words.filter(F.col("j") == j).select("item", "term"), MOST_TEST_ROWS)
        probes = now.join(step, "item").withColumn("gap", gaps).select("item", "item_id", "n", *DOC, "first", (F.col("pos") + F.col("gap")).alias("pos"), "term")
        now = written(probes.join(index, [*DOC, "pos", "term"]).select("item", "item_id", "n", *DOC, "first", "pos").distinct(), "walk")
        done = done.union(now.filter(F.col("n") == j + 1))
    return done.groupBy("item_id", *DOC, "first").agg(F.min("pos").alias("last"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The whole documents table against the whole benchmark table."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items, unnamed=True)
    return found.select(document_id().alias("doc_id"), "n_words", "n_hit", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS win FROM starts),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l),
dx AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS win FROM dw),
m AS (SELECT doc_id, s, dx.l, item_id FROM dx JOIN iw ON iw.l = dx.l AND iw.win = dx.win),
p AS (SELECT doc_id, unnest(range(s, s + l)) AS place FROM m),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM p GROUP BY doc_id),
own AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM own GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
