"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail and IP addresses, card and phone numbers that
fixed patterns find. How much a term reveals of an entity is estimated from the
corpus: with N documents, n_e that hold the entity, n_t that hold the term and
n_et in which the term stands near the entity,

    information(e) = log2(N / n_e),   pmi(e, t) = log2(n_et * N / (n_e * n_t)),

and the term's disclosure of the entity is pmi / information, at most 1, which
it reaches if the term stands nowhere else. A term with enough support whose
disclosure exceeds a threshold is generalised wherever it stands in documents
that hold the entity, and removed above a second threshold. Terms are runs of
letters and digits of any length; one to three letters a-z, all lower-case,
are judged only where the same word stands capitalised near an entity. Base spans are always replaced. Documents
without an entity are left alone.

Everything is DataFrame code. Positions count code points; a pattern's matches
and the pieces between them give where each begins.

Cases: a null text is empty and has no spans; rows that repeat an id are told
apart by their texts, and rows that repeat both count once in the corpus and
get the same result each; a null id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import ascii_lower, self_cleaning, sized, written
from lodestone.llm.decontamination import DOC, document_id, document_key

KINDS = ("email", "ip", "card", "phone", "term")
#: Each finds what the contract's pattern finds, leftmost and without overlaps. A run that fails at its start fails
#: everywhere inside, so matches begin where a run or the last match's end is, and repetitions give nothing back:
#: time is linear and the depth of recursion constant, whatever the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character that every match holds, where one is rare enough to ask for first.
HOLDS = {"email": "@", "phone": "+", "ip": "."}
#: A term: letters with their marks and digits, of any length.
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Still no candidates by themselves: tests hold that such words are none.
SHORT = r"^[a-z]{1,3}$"
#: Code points in a block of positions that meet in a join.
BLOCK = 128
MOST_TERMS = 500_000


def is_valid(kind: str, match: Column) -> Column:
    """Does a match of the pattern count?"""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    found = F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: is_valid(kind, x))
    return F.contains(text, F.lit(HOLDS[kind])) & found if kind in HOLDS else found


def placed_matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, version, match, start, end) of all matches of a pattern in the column text."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))
    each = docs.select(*DOC, F.posexplode(pairs).alias("i", "x")).select(*DOC, "i", F.col("x.m").alias("match"), F.length("x.p").alias("gap"), F.coalesce(F.length("x.m"), F.lit(0)).alias("size"))
    order = Window.partitionBy(*DOC).orderBy("i")
    start = F.sum("gap").over(order) + F.sum("size").over(order) - F.col("size")
    return each.withColumn("start", start).filter("match IS NOT NULL").select(*DOC, "match", "start", (F.col("start") + F.col("size")).alias("end"))


def protected_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write (doc, version, kind, start, end, entity) of the base patterns, and the documents that hold one."""
    anything = reduce(Column.__or__, (_may_hold(k, F.col("text")) for k in PATTERNS))
    some = written(docs.filter(anything).distinct(), "holders")
    found = []
    for kind, pattern in PATTERNS.items():
        spans = placed_matches(some.filter(_may_hold(kind, F.col("text"))), pattern).filter(is_valid(kind, F.col("match")))
        entity = ascii_lower(F.col("match")) if kind in ("email", "ip") else F.regexp_replace("match", "[^0-9]", "")
        found.append(spans.select(*DOC, F.lit(kind).alias("kind"), "start", "end", F.concat(F.lit(f"{kind}:"), entity).alias("entity")))
    return written(reduce(DataFrame.union, found), "spans"), some


def free_words(spans: DataFrame, holders: DataFrame, reach: int) -> DataFrame:
    """Write (doc, version, term, able, near, start, end): all words of documents with an entity that overlap no base span; near: within reach of one.

    Texts and spans are dealt out by document before they become words, so that
    words are never shuffled: all that follows sorts within a document.
    """
    own = spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("own"))
    rows = holders.join(own, list(DOC)).repartition(*DOC)
    none, zero = F.lit(None).cast("long"), F.lit(0)
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"), F.split("text", TERM, -1).alias("p"))
    words = F.transform(pairs, lambda x: F.struct(x["m"].alias("match"), F.length(x["p"]).alias("gap"), F.coalesce(F.length(x["m"]), zero).alias("size"), none.alias("s"), none.alias("e")))
    bases = F.transform("own", lambda x: F.struct(F.lit(None).cast("string").alias("match"), zero.alias("gap"), zero.alias("size"), x["start"].cast("long").alias("s"), x["end"].cast("long").alias("e")))
    each = rows.select(*DOC, F.posexplode(F.concat(words, bases)).alias("i", "x")).select(*DOC, "i", "x.*")
    one, past = Window.partitionBy(*DOC), (Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(one.orderBy("i"))
    placed = each.select(*DOC, "match", F.col("s").isNotNull().alias("base"), F.coalesce("s", end - F.col("size")).alias("start"), F.coalesce("e", end).alias("end")).filter("base OR match IS NOT NULL")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(one.orderBy("start", F.desc("base")).rowsBetween(*past))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(one.orderBy(F.desc("start"), "base").rowsBetween(*past))
    met = placed.withColumn("before", before).withColumn("after", after).filter("NOT base")
    free = met.filter("coalesce(before <= start, true) AND coalesce(after >= end, true)")
    near = F.coalesce(F.col("start") - F.col("before") <= reach, F.lit(False)) | F.coalesce(F.col("after") - F.col("end") <= reach, F.lit(False))
    return written(free.select(*DOC, ascii_lower(F.col("match")).alias("term"), (~F.col("match").rlike(SHORT)).alias("able"), near.alias("near"), "start", "end"), "free")


def nearby_words(spans: DataFrame, words: DataFrame, reach: int) -> DataFrame:
    """(doc, version, entity, term), distinct: able words within reach of an entity."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / BLOCK), F.floor(b / BLOCK))).alias("block")
    around = spans.select(*DOC, "entity", F.col("start").alias("s"), F.col("end").alias("e"), blocks(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach))
    each = words.filter("able AND near").select(*DOC, "term", "start", "end", blocks(F.col("start"), F.col("end")))
    close = (F.col("end") >= F.col("s") - reach) & (F.col("start") <= F.col("e") + reach)
    return each.join(around, [*DOC, "block"]).filter(close).select(*DOC, "entity", "term").distinct()


def masked_terms(words: DataFrame, held: DataFrame, told: DataFrame) -> DataFrame:
    """Write (doc, version, term, disclosure): the terms that stand in a document and disclose an entity that it holds.

    Terms meet the entities that they disclose, and these the document's own: a
    document never meets all terms of an entity that many documents hold.
    """
    standing = words.select(*DOC, "term").join(sized(told, MOST_TERMS), "term").distinct()
    both = standing.join(held, [*DOC, "entity"], "left_semi")
    return written(both.groupBy(*DOC, "term").agg(F.max("disclosure").alias("disclosure")), "masked")


def revealing_terms(docs: DataFrame, spans: DataFrame, holders: DataFrame, reach: int, support: int, least: float) -> DataFrame:
    """(doc, version, start, end, disclosure): occurrences, in documents that hold an entity, of terms whose disclosure of it is at least so much."""
    words = free_words(spans, holders, reach)
    near = nearby_words(spans, words, reach)
    together = near.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    together = written(together, "together")
    terms = written(together.select("term").distinct(), "terms")
    held = written(spans.select(*DOC, "entity").distinct(), "held")
    of_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    every = docs.select(*DOC, F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    of_term = every.join(sized(terms, MOST_TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = docs.count()
    pmi = F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.greatest("n_t", "n_et")))
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    told = together.join(of_entity, "entity").join(of_term, "term").withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(0.0)).filter(F.col("disclosure") >= least)
    told = written(told.select("term", "entity", "disclosure"), "disclosing")
    masked = masked_terms(words, held, told)
    return words.join(sized(masked, MOST_TERMS), [*DOC, "term"]).select(*DOC, "start", "end", "disclosure").distinct()


@self_cleaning
def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 64, support: int = 2, generalise_at: float = 0.8) -> DataFrame:
    """Return (doc, version, kind, start, end, disclosure); kind is a base kind or term, ends are exclusive.

    reach: code points around an entity in which a term counts as near.
    support: documents in which term and entity must stand together.
    """
    keyed = docs.select(*document_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans, holders = protected_spans(keyed)
    terms = revealing_terms(keyed, spans, holders, reach, support, generalise_at)
    base = spans.select(*DOC, "kind", "start", "end", F.lit(None).cast("double").alias("disclosure"))
    return base.union(terms.select(*DOC, F.lit("term"), "start", "end", "disclosure"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.95, **options) -> DataFrame:
    """docs with base spans replaced by their kind, revealing terms by TERM, and terms above remove_at by nothing."""
    found = private_spans(docs, id_col, text_col, **options)
    label = F.when(F.col("disclosure") >= remove_at, "").otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    lists = found.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end", label.alias("label")))).alias("__spans"))
    keyed = docs.select("*", *(c.alias(f"__{n}") for c, n in zip(document_key(id_col, text_col), DOC, strict=True)))
    both = keyed.join(lists, (keyed["__doc"] == lists["doc"]) & (keyed["__version"] == lists["version"]), "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(s["end"].cast("long").alias("at"), F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), s["label"]).alias("out"))
    )
    made = F.aggregate("__spans", begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    done = F.when(F.col("__spans").isNull(), text).otherwise(made)
    return both.select(*(done.alias(c) if c == text_col else docs[c] for c in docs.columns))


def span_list(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    own = F.filter(spans, lambda s: s["rank"] < len(kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_sanitisation(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = private_spans(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    lists = found.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    whole = docs.select(*document_key("doc_id", "text")).join(lists, list(DOC), "left").withColumn("spans", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return whole.select(document_id().alias("doc_id"), *counts, F.sha2(span_list(F.col("spans"), KINDS[:4]), 256).alias("base_sha256"), span_list(F.col("spans"), KINDS).alias("spans"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(dg) + 1), lambda i: CAST(substr(dg, length(dg) - i + 1, 1) AS INT) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND CAST(substr(dg, length(dg) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999) <= 255))"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length(dg) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(dg) BETWEEN 9 AND 15"),
}


def _matches_sql(source: str, keep: str, text: str, pattern: str, at: str = "0") -> str:
    """SELECT of keep, m (match) and s (start) for each match of a pattern in source."""
    return f"""SELECT {keep}, ms[i] AS m, {at} + list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS ps FROM {source}))"""


_BASE = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS r, s, s + length(m) AS e, '{kind}:' || {_LOWER.format('m') if kind in ('email', 'ip') else 'dg'} AS entity FROM (SELECT *, {_DIGITS} AS dg FROM ({_matches_sql('d', 'doc_id', 't', pattern)})) WHERE {good}"
    for rank, (kind, (pattern, good)) in enumerate(_SQL_KINDS.items())
)
_TERM = r"[\p{L}\p{M}\p{N}]+"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_BASE}),
held AS (SELECT DISTINCT doc_id, entity FROM base),
holders AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM base)),
words AS ({_matches_sql('holders', 'doc_id', 't', _TERM)}),
free AS (
  SELECT doc_id, {_LOWER.format('m')} AS term, NOT regexp_full_match(m, '[a-z]{{1,3}}') AS able, s, s + length(m) AS e FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND w.s < b.e AND w.s + length(w.m) > b.s)
),
near AS (SELECT DISTINCT f.doc_id, b.entity, f.term FROM free f JOIN base b ON b.doc_id = f.doc_id WHERE f.able AND f.e >= b.s - 64 AND f.s <= b.e + 64),
together AS (SELECT term, entity, count(*) AS n_et FROM near GROUP BY term, entity HAVING count(*) >= 2),
of_entity AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
of_term AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_LOWER.format('t')}, '{_TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM together) GROUP BY term),
told AS (
  SELECT term, entity FROM together JOIN of_entity USING (entity) JOIN of_term USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
  WHERE n > n_e AND log2(n_et * n / (n_e * greatest(n_t, n_et))) / log2(n / n_e) >= 0.8
),
masked AS (SELECT DISTINCT doc_id, term FROM held JOIN told USING (entity)),
spans AS (SELECT doc_id, kind, r, s, e FROM base UNION ALL SELECT DISTINCT doc_id, 'term', 4, s, e FROM free JOIN masked USING (doc_id, term)),
lists AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r, e) AS spans,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r) FILTER (WHERE r < 4) AS base_spans,
    {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS[:4])} FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS[:4])}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (doc_id)
"""
