"""Queries that apply the operators to the star-schema tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import identity, paths
from lodestone.operators import graph, ignore_rules, inventory, limits, resolution, store
from lodestone.sources import manifests
from lodestone.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, read) under its own name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- listings -------------------------------------------------------------

ENTRIES = r"""
files AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages),
parts AS (SELECT path, string_split(path, '/') AS p FROM files),
dirs AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS k FROM parts)),
entries AS (SELECT path, false AS is_dir FROM files WHERE path NOT IN (SELECT path FROM dirs) UNION ALL SELECT path, true FROM dirs)
"""


def page_files(read) -> DataFrame:
    """The pages' addresses as file paths."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return read("pages").select(F.rtrim(bare, F.lit("/")).alias("path")).distinct()


def page_entries(read) -> DataFrame:
    return inventory.with_directories(page_files(read))


@query(f"""WITH {ENTRIES}
SELECT path, is_dir, len(string_split(path, '/')) AS depth, string_split(path, '/')[1] AS top, string_split(path, '/')[-1] AS base FROM entries""")
def entries_from_pages(spark, read):
    p = F.col("path")
    return page_entries(read).select("path", "is_dir", paths.depth(p).cast("long").alias("depth"), paths.top_segment(p).alias("top"), paths.base_name(p).alias("base"))


@query(f"""WITH {ENTRIES} SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext,
CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir,
regexp_matches(path, '(^|/)\\.[^/.]') AS hidden FROM entries""")
def path_parts(spark, read):
    p = F.col("path")
    return page_entries(read).select("path", paths.extension(p).alias("ext"), paths.directory(p).alias("dir"), paths.has_hidden_segment(p).alias("hidden"))


IGNORE_LINES = [("", "es/"), ("", "m.*"), ("", "!**/es/1*"), ("", "# comment"), ("", "blog.*/en"), ("", "**/fr/?2*")]


@query(f"""WITH {ENTRIES},
rules(ordinal, re, negated, dirs_only) AS (VALUES (0, '(?:^|/)es$', false, true), (1, '(?:^|/)m\\.[^/]*$', false, false), (2, '^(?:.*/)?es/1[^/]*$', true, false), (4, '^blog\\.[^/]*/en$', false, false), (5, '^(?:.*/)?fr/[^/]2[^/]*$', false, false)),
each AS (SELECT path, is_dir, array_to_string(string_split(path, '/')[1:k], '/') AS part FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM entries)),
met AS (SELECT path, is_dir, ordinal, negated FROM each JOIN rules ON regexp_matches(part, re) AND (NOT dirs_only OR is_dir OR part <> path)),
best AS (SELECT path, is_dir, max(ordinal) AS rule, NOT arg_max(negated, ordinal) AS ignored FROM met GROUP BY path, is_dir)
SELECT e.path, e.is_dir, coalesce(ignored, false) AS ignored, rule FROM entries e LEFT JOIN best USING (path, is_dir)""")
def ignore_filter(spark, read):
    return ignore_rules.decide(page_entries(read), ignore_rules.rules_table(spark, IGNORE_LINES))


@query("""WITH c AS (SELECT language, count(*) AS n FROM documents JOIN (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French')) m(lang, language) USING (lang) GROUP BY language)
SELECT language, n, floor(n / sum(n) OVER () * 10000 + 0.5) / 100 AS percentage FROM c""")
def language_share(spark, read):
    mapping = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "lang string, language string")
    return inventory.language_share(read("documents"), "lang", mapping)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE lang IN ('en', 'de', 'fr')) AS known, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) AS unknown FROM documents")
def status_counts(spark, read):
    known = F.col("lang").isin("en", "de", "fr")
    return inventory.flag_counts(read("documents"), "files", known=known, unknown=~known)


TOKENS = [("track(", "tracker", "script"), ("charset", "meta", "html"), ("<table", "table", "html"), ("no-such-token", "none", "html")]


@query("""SELECT name, ecosystem, count(*) AS files, min(url) AS first_file FROM (SELECT DISTINCT url, name, ecosystem, token FROM pages
JOIN (VALUES ('track(', 'tracker', 'script'), ('charset', 'meta', 'html'), ('<table', 'table', 'html'), ('no-such-token', 'none', 'html')) t(token, name, ecosystem) ON contains(html, token)) GROUP BY name, ecosystem""")
def token_detection(spark, read):
    found = inventory.token_evidence(read("pages"), spark.createDataFrame(TOKENS, "token string, name string, ecosystem string"), "url", "html")
    return found.select("name", "ecosystem", F.col("files").cast("long").alias("files"), F.col("evidence")[0]["file"].alias("first_file"))


@query("SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k")
def json_manifest(spark, read):
    return manifests.json_fields(read("events"), "props", "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, lang, count(*) AS findings, count(DISTINCT n_chars) AS evidence, min(n_chars) AS first_evidence FROM documents GROUP BY source, lang""")
def keyed_merge(spark, read):
    found = inventory.keyed_merge(read("documents"), ["source", "lang"], ["n_chars"])
    return found.select("source", "lang", "findings", F.size("evidence").cast("long").alias("evidence"), F.col("evidence")[0]["n_chars"].alias("first_evidence"))


@query(f"""WITH {ENTRIES} SELECT max(len(string_split(path, '/'))) AS max_depth,
count(DISTINCT string_split(path, '/')[1]) FILTER (WHERE is_dir OR contains(path, '/')) AS top_directories,
count(DISTINCT path) FILTER (WHERE NOT is_dir AND NOT contains(path, '/')) AS top_files FROM entries""")
def layout(spark, read):
    return inventory.layout(page_entries(read)).withColumn("max_depth", F.col("max_depth").cast("long"))


@query("SELECT p_name AS key, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS vals FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2")
def conflict_groups(spark, read):
    return inventory.conflicts(read("part"), "p_name", "p_brand").select(F.col("p_name").alias("key"), F.array_join("values", ",").alias("vals"))


@query(f"""WITH {ENTRIES}, f AS (SELECT string_split(path, '/') AS p FROM files)
SELECT p[1] AS workspace, count(DISTINCT p[2]) AS locations, count(DISTINCT array_to_string(p[2:], '/')) AS members,
count(DISTINCT p[2]) >= 2 OR count(DISTINCT array_to_string(p[2:], '/')) >= 2 AS monorepo FROM f GROUP BY p[1]""")
def monorepo_flag(spark, read):
    parts = F.split("path", "/")
    rest = F.array_join(F.slice(parts, 2, 1000), "/")
    return inventory.monorepo(page_files(read), parts[0], F.get(parts, F.lit(1)), rest)


# ---- identities -----------------------------------------------------------


def _seg(x: str) -> str:
    """DuckDB SQL for a length-prefixed segment, as hex."""
    return f"lpad(printf('%X', strlen({x})), 16, '0') || hex({x})"


def _sid(domain: str, *parts: str) -> str:
    body = " || ".join(_seg(p) for p in (f"'{domain}'", *parts))
    return f"'{domain}:sha256:' || sha256(unhex({body}))"


@query(f"""SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS key, {_sid(identity.NODE, "'part'", "'en'", "p_name", "CAST(p_partkey AS VARCHAR)", "'resolved_local'")} AS id FROM part
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), {_sid(identity.NODE, "'supplier'", "'en'", "s_name", "CAST(s_suppkey AS VARCHAR)", "'resolved_local'")} FROM supplier
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), {_sid(identity.NODE, "'nation'", "'en'", "n_name", "CAST(n_nationkey AS VARCHAR)", "'resolved_local'")} FROM nation
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), {_sid(identity.NODE, "'region'", "'en'", "r_name", "CAST(r_regionkey AS VARCHAR)", "'resolved_local'")} FROM region""")
def stable_ids(spark, read):
    tables = [("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")]
    out = None
    for kind, key, name in tables:
        k = F.col(key).cast("string")
        one = read(kind).select(F.lit(kind).alias("kind"), k.alias("key"), identity.node_id(F.lit(kind), F.lit("en"), F.col(name), k, F.lit("resolved_local")).alias("id"))
        out = one if out is None else out.union(one)
    return out


# ---- the part-transition graph --------------------------------------------

CANDIDATES = """
c AS (SELECT l_orderkey, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
edges AS (SELECT a, b, count(*) AS occurrences FROM c WHERE b IS NOT NULL GROUP BY a, b)
"""


def candidates(read) -> DataFrame:
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return graph.transitions(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey")


def edges_of(read) -> DataFrame:
    return candidates(read).groupBy("a", "b").agg(F.count(F.lit(1)).alias("occurrences"))


_EDGE_ID = _sid(identity.EDGE, "'part'", "'follows'", "CAST(a AS VARCHAR)", "CAST(b AS VARCHAR)", "'resolved_local'")


def edge_id_column():
    return identity.edge_id(F.lit("part"), F.lit("follows"), F.col("a").cast("string"), F.col("b").cast("string"), F.lit("resolved_local"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT DISTINCT a, b, l_orderkey FROM c WHERE b IS NOT NULL),
k AS (SELECT a, b, count(*) AS n, array_to_string(list_sort(list(l_orderkey))[1:2], ',') AS evidence FROM e GROUP BY a, b)
SELECT {_EDGE_ID} AS edge_id, a, b, occurrences, evidence, greatest(n - 2, 0) AS omitted_evidence FROM edges JOIN k USING (a, b)""")
def graph_edges(spark, read):
    found = graph.aggregate_edges(candidates(read), ["a", "b"], "source", 2)
    joined = F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",")
    return found.select(edge_id_column().alias("edge_id"), "a", "b", "occurrences", joined.alias("evidence"), F.col("omitted_evidence").cast("long").alias("omitted_evidence"))


@query(f"""WITH {CANDIDATES}, v AS (SELECT a AS k FROM edges UNION SELECT b FROM edges)
SELECT k, count(*) AS versions, min(p_name) AS name, count(DISTINCT p_name) > 1 AS conflict FROM v JOIN part ON p_partkey = k GROUP BY k""")
def graph_nodes(spark, read):
    e = edges_of(read)
    v = e.select(F.col("a").alias("k")).union(e.select("b")).distinct().join(read("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k")
    counts = v.groupBy("k").agg(F.count(F.lit(1)).alias("versions"))
    return graph.normalize_nodes(v, ["k"], ["name"]).join(counts, "k").select("k", "versions", "name", "conflict")


@query(f"""SELECT {_sid(identity.CONTAINMENT, "'region_contains_nation'", "r_name", "n_name")} AS id, r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT {_sid(identity.CONTAINMENT, "'nation_contains_customer'", "n_name", "c_name")}, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def containment(spark, read):
    r, n, c = read("region"), read("nation"), read("customer")
    up = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit("region_contains_nation").alias("kind"))
    down = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child"), F.lit("nation_contains_customer").alias("kind"))
    return up.union(down).select(identity.containment_id(F.col("kind"), F.col("parent"), F.col("child")).alias("id"), "parent", "child")


@query(f"""WITH {CANDIDATES}, p AS (SELECT p_partkey AS k, p_type = 'ECONOMY' AS ok FROM part)
SELECT x.ok AND y.ok AS eligible, count(*) AS n, sum(occurrences) AS occurrences FROM edges JOIN p x ON a = x.k JOIN p y ON b = y.k GROUP BY 1""")
def edge_eligibility(spark, read):
    found = graph.eligibility(edges_of(read), read("part"), "p_partkey", F.col("p_type") == "ECONOMY")
    return found.groupBy("eligible").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("occurrences"))


@query(f"""WITH {CANDIDATES} SELECT (SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges)) AS vertices, count(*) AS edges, CAST(sum(occurrences) AS BIGINT) AS occurrences,
least(count(*), 1000) AS kept_edges, count(*) - least(count(*), 1000) AS omitted_edges FROM edges""")
def graph_statistics(spark, read):
    return graph.graph_statistics(edges_of(read), 1000)


CLOSURE = f"""WITH RECURSIVE {CANDIDATES}, v AS (SELECT a AS x FROM edges UNION SELECT b FROM edges),
reach AS (SELECT a AS x, b AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
mutual AS (SELECT r.x, r.y FROM reach r JOIN reach s ON r.x = s.y AND r.y = s.x),
comp AS (SELECT v.x AS vertex, coalesce(min(least(m.y, v.x)), v.x) AS component FROM v LEFT JOIN mutual m ON m.x = v.x GROUP BY v.x)"""


@query(f"{CLOSURE} SELECT * FROM comp")
def scc(spark, read):
    return graph.strong_components(edges_of(read))


@query(f"""{CLOSURE}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
SELECT component, size, {_sid(identity.CYCLE, "'part'", "CAST(component AS VARCHAR)")} AS cycle_id, 'structural' AS classification FROM s
WHERE size > 1 OR component IN (SELECT a FROM edges WHERE a = b)""")
def cycles(spark, read):
    e = written(edges_of(read).select("a", "b"))
    found = graph.component_summary(graph.strong_components(e), e).filter("cyclic")
    return found.select("component", "size", identity.stable_id(identity.CYCLE, F.lit("part"), F.col("component").cast("string")).alias("cycle_id"), F.lit("structural").alias("classification"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT *, {_EDGE_ID} AS edge_id FROM edges)
SELECT b AS neighbour, array_to_string(list_sort(list(edge_id)), ',') AS edge_ids FROM e WHERE a = 7 GROUP BY b""")
def direct_dependencies(spark, read):
    found = graph.direct_neighbours(edges_of(read).withColumn("edge_id", edge_id_column()), 7)
    return found.select("neighbour", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT *, {_EDGE_ID} AS edge_id FROM edges)
SELECT a AS neighbour, array_to_string(list_sort(list(edge_id)), ',') AS edge_ids FROM e WHERE b = 7 GROUP BY a""")
def direct_dependents(spark, read):
    found = graph.direct_neighbours(edges_of(read).withColumn("edge_id", edge_id_column()), 7, outward=False)
    return found.select("neighbour", F.array_join("edge_ids", ",").alias("edge_ids"))


def _impact_sql(here: str, there: str) -> str:
    return f"""WITH RECURSIVE {CANDIDATES}, s AS (SELECT {here} AS v FROM edges ORDER BY {here} LIMIT 1),
walk AS (SELECT v, 0 AS d FROM s UNION SELECT e.{there}, d + 1 FROM walk JOIN edges e ON e.{here} = v WHERE d < 3)
SELECT v AS vertex, min(d) AS depth FROM walk GROUP BY v HAVING min(d) > 0"""


def _impact(read, outward: bool) -> DataFrame:
    e = edges_of(read)
    here = "a" if outward else "b"
    return graph.impact(e, e.orderBy(here).limit(1).select(F.col(here).alias("vertex")), 3, outward)


@query(_impact_sql("a", "b"))
def impact_down(spark, read):
    return _impact(read, True)


@query(_impact_sql("b", "a"))
def impact_up(spark, read):
    return _impact(read, False)


@query()
def impact_budgeted(spark, read):
    e = graph.eligibility(edges_of(read), read("part"), "p_partkey", F.col("p_type") != "ECONOMY").withColumn("edge_id", edge_id_column())
    start = e.filter("eligible").orderBy("a").first()["a"]
    found = graph.budgeted_impact(e, [start], 16, 200, 400)
    rows = [("reached", v, d) for v, d in found.reached] + [("boundary", v, None) for v in found.boundary] + [("scanned", found.scanned, None), ("visited", found.visited, None)]
    return spark.createDataFrame(rows, "what string, value long, depth int")


# ---- resolution -----------------------------------------------------------


@query(f"""WITH {ENTRIES}, roots AS (SELECT path AS root FROM dirs WHERE len(string_split(path, '/')) <= 2),
m AS (SELECT path, arg_max(root, strlen(root)) AS root FROM files JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path)
SELECT f.path, m.root FROM files f LEFT JOIN m USING (path)""")
def nearest_module(spark, read):
    roots = page_entries(read).filter(F.col("is_dir") & (paths.depth(F.col("path")) <= 2)).select(F.col("path").alias("root"))
    return resolution.nearest_root(page_files(read), "path", roots, "root").select("path", "root")


@query(f"""WITH {ENTRIES}, roots AS (SELECT path AS root, unnest(['x', 'y'][1:1 + strlen(path) % 2]) AS owner FROM dirs WHERE len(string_split(path, '/')) <= 2),
m AS (SELECT path, root, owner, rank() OVER (PARTITION BY path ORDER BY strlen(root) DESC) AS k FROM files JOIN roots ON path = root OR starts_with(path, root || '/')),
o AS (SELECT path, min(root) AS root, count(DISTINCT owner) AS candidates FROM m WHERE k = 1 GROUP BY path)
SELECT path, root, coalesce(candidates, 0) AS candidates, CASE WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM files LEFT JOIN o USING (path)""")
def longest_prefix_ties(spark, read):
    owners = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), F.octet_length("path") % 2 + 1)
    roots = page_entries(read).filter(F.col("is_dir") & (paths.depth(F.col("path")) <= 2)).select(F.col("path").alias("root"), F.explode(owners).alias("owner"))
    found = resolution.longest_matches(page_files(read), "path", roots, "root", "owner")
    return found.select("path", "root", F.size("candidates").cast("long").alias("candidates"), "outcome")


@query("""WITH r AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'no such part'), d AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part WHERE p_size < 10 GROUP BY p_name)
SELECT name, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN k END AS target FROM r LEFT JOIN d USING (name)""")
def name_resolution(spark, read):
    part = read("part")
    names = part.select(F.col("p_name").alias("name")).union(spark.createDataFrame([("no such part",)], "name string")).distinct()
    found = resolution.lookup(names, "name", part.filter("p_size < 10"), "p_name", "p_partkey")
    return found.select("name", F.size("candidates").cast("long").alias("candidates"), "outcome", "target")


@query("""WITH r AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT 'nothing'),
t0 AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part WHERE p_size < 3 GROUP BY 1),
t1 AS (SELECT p_brand AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part GROUP BY 1),
t2 AS (SELECT p_type AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part GROUP BY 1),
j AS (SELECT r.name, CASE WHEN t0.n > 0 THEN 'name' WHEN t1.n > 0 THEN 'brand' WHEN t2.n > 0 THEN 'type' ELSE 'none' END AS tier, coalesce(t0.n, t1.n, t2.n, 0) AS candidates, coalesce(t0.k, t1.k, t2.k) AS k
FROM r LEFT JOIN t0 USING (name) LEFT JOIN t1 ON r.name = t1.name LEFT JOIN t2 ON r.name = t2.name)
SELECT name, tier, candidates, CASE candidates WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN candidates = 1 THEN k END AS target FROM j""")
def cascade_resolution(spark, read):
    part = read("part")
    tier = lambda c, rows=part: rows.select(F.col(c).alias("key"), F.col("p_partkey").alias("target"))
    names = part.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("name")).union(spark.createDataFrame([("nothing",)], "name string")).distinct()
    return resolution.cascade(names, "name", [("name", tier("p_name", part.filter("p_size < 3"))), ("brand", tier("p_brand")), ("type", tier("p_type"))])


@query("""SELECT p_name AS alias, p_type AS scope, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS target FROM part GROUP BY 1, 2""")
def poisoned_aliases(spark, read):
    return resolution.poisoned_aliases(read("part").select(F.col("p_name").alias("alias"), F.col("p_type").alias("scope"), "p_brand"), ["alias", "scope"], "p_brand")


@query("""WITH p AS (SELECT lang AS grp, CASE WHEN doc_id % 97 = 5 THEN 'stale' WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'resolved' ELSE 'external' END AS status, source AS target, doc_id % 50 AS g FROM documents JOIN labels USING (doc_id)),
a AS (SELECT g, bool_or(status = 'stale') AS old, bool_or(status = 'ambiguous') AS amb, bool_and(status = 'resolved') AS res, bool_and(status = 'external') AS ext, count(DISTINCT CASE WHEN status = 'resolved' THEN target END) AS n, min(CASE WHEN status = 'resolved' THEN target END) AS t FROM p GROUP BY g),
s AS (SELECT g, t, CASE WHEN old THEN 'unresolved' WHEN amb OR n > 1 THEN 'ambiguous' WHEN res AND n = 1 THEN 'resolved' WHEN ext THEN 'external' ELSE 'unresolved' END AS state FROM a)
SELECT g, state, CASE WHEN state = 'resolved' THEN t END AS target FROM s""")
def unanimity(spark, read):
    status = F.when(F.col("doc_id") % 97 == 5, "stale").when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "resolved").otherwise("external")
    proofs = read("documents").select("doc_id", "source").join(read("labels"), "doc_id").select((F.col("doc_id") % 50).alias("g"), status.alias("status"), F.col("source").alias("target"))
    return resolution.unanimous(proofs, ["g"], "status", "target")


@query("SELECT doc_id, sha256(text) AS recorded, sha256(text) <> sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS stale FROM documents")
def staleness(spark, read):
    now = F.sha2(F.trim(F.regexp_replace("text", r"[\t\n\x0C\r ]+", " ")), 256)
    return read("documents").select("doc_id", F.sha2("text", 256).alias("recorded"), (F.sha2("text", 256) != now).alias("stale"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'matched' END AS outcome
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def reconcile(spark, read):
    return resolution.reconcile(read("documents").select("doc_id"), read("labels").select("doc_id"), ["doc_id"])


EVENTS = "SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events"


@query(f"""WITH i AS ({EVENTS}), p AS (SELECT event_id AS point_id, user_id, ts + INTERVAL 1 HOUR AS moment FROM events WHERE event_type = 'purchase')
SELECT point_id, event_id FROM p JOIN i USING (user_id) WHERE moment >= ts AND moment < next_ts""")
def range_containment(spark, read):
    ev = read("events")
    intervals = ev.select("event_id", "user_id", "ts", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_ts"))
    points = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("point_id"), "user_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return resolution.containing_interval(points, intervals, "user_id", "at", "ts", "next_ts").select("point_id", "event_id")


# ---- limits and pages -----------------------------------------------------


@query("""WITH k AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
f AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) AS m, count(*) OVER () AS total FROM k WHERE n <= 3)
SELECT user_id, event_id, CASE WHEN total > 20 THEN total - 19 ELSE 0 END AS omitted FROM f WHERE total <= 20 OR m < 20""")
def top_diagnostics(spark, read):
    order = [F.col("ts"), F.col("event_id")]
    kept, _ = limits.top_per_group(read("events").filter("event_type = 'error'").select("user_id", "ts", "event_id"), ["user_id"], order, 3)
    return limits.global_limit(kept, [F.col("user_id"), *order], 20).select("user_id", "event_id", F.col("omitted").cast("long").alias("omitted"))


@query("SELECT CAST(sum(least(n, 3)) AS BIGINT) AS kept, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS omitted FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)")
def omission_counts(spark, read):
    return limits.top_per_group(read("events").filter("event_type = 'error'"), ["user_id"], [F.col("ts")], 3)[1]


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY ALL")
def dedupe_first(spark, read):
    return limits.dedupe(read("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY ALL")
def dedupe_last(spark, read):
    return limits.dedupe(read("events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("""WITH c AS (SELECT event_type, count(*) AS n, list_position(['purchase', 'signup', 'error', 'view', 'click'], event_type) AS r FROM events GROUP BY event_type),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT event_type, CAST(least(n, greatest(500 - before, 0)) AS BIGINT) AS kept, CAST(n - least(n, greatest(500 - before, 0)) AS BIGINT) AS omitted FROM b""")
def category_budget(spark, read):
    return limits.category_budget(read("events"), "event_type", "event_id", ["purchase", "signup", "error", "view", "click"], 500)


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_carry(spark, read):
    return limits.carry_forward(read("conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "system", F.col("text")), "section").select("conv_id", "turn", "section")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 21 OFFSET 40")
def page_offset(spark, read):
    return limits.offset_page(read("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 21, 40)[0]


@query("SELECT o_orderkey, true AS has_more FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def page_keyset(spark, read):
    return limits.keyset_page(read("orders").select("o_orderkey"), "o_orderkey", 100, 20)


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT user_id, event_id, ts, CAST(value AS DECIMAL(18, 2)) AS value FROM events)")
def running_budget(spark, read):
    spent = F.sum(F.col("value").cast("decimal(18,2)")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return read("events").select("user_id", "event_id", spent.alias("spent"))


# ---- store ----------------------------------------------------------------


@query("SELECT sha256(text) AS digest, min(strlen(text)) AS size FROM documents GROUP BY 1")
def payloads(spark, read):
    return store.payloads(read("documents"), "text").select("digest", "size")


@query("""WITH d AS (SELECT DISTINCT text FROM documents), c AS (SELECT text, unnest(range(0, CAST(ceil(strlen(text) / 1024) AS BIGINT))) AS ordinal FROM d)
SELECT sha256(text) AS digest, ordinal, lower(substr(hex(encode(text)), CAST(ordinal * 2048 + 1 AS BIGINT), 2048)) AS bytes FROM c""")
def payload_chunks(spark, read):
    return store.chunks(store.payloads(read("documents"), "text"), 1024).select("digest", F.col("ordinal").cast("long").alias("ordinal"), F.lower(F.hex("bytes")).alias("bytes"))


@query("SELECT sha256(text) AS digest, strlen(text) AS size, true AS verified FROM (SELECT DISTINCT text FROM documents) WHERE strlen(text) > 0")
def payload_roundtrip(spark, read):
    return store.reassemble(store.chunks(store.payloads(read("documents"), "text"), 1024))


@query("SELECT sha256(text) AS digest FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1) WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def payload_stage(spark, read):
    docs = read("documents")
    return store.stage(store.payloads(docs.filter("doc_id % 2 = 0"), "text"), store.payloads(docs.filter("doc_id % 2 = 1"), "text")).select("digest")


@query("SELECT count(*) AS n, CAST(sum(c_acctbal) AS DECIMAL(18, 2)) AS freed FROM (SELECT CAST(c_acctbal AS DECIMAL(18, 2)) AS c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_custkey < 100)")
def gc_candidates(spark, read):
    lost = store.unreferenced(read("customer"), read("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "c_custkey", F.lit(100))
    return lost.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(18,2)").alias("freed"))


@query("""WITH c AS (SELECT min(o_custkey) AS k FROM orders), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = k ORDER BY o_orderdate, o_orderkey LIMIT 3)
SELECT (SELECT count(*) FROM o) AS purged, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) AS children, (SELECT count(*) FROM orders JOIN c ON o_custkey = k) <= 3 AS complete""")
def purge_batch(spark, read):
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    own = orders.join(F.broadcast(orders.agg(F.min("o_custkey").alias("o_custkey"))), "o_custkey", "left_semi")
    return store.purge_batch(own, "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], 3, read("lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def current_publication(spark, read):
    return store.current(read("orders").filter("o_orderstatus = 'F'"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


ALLOWED = [("signup", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view")]


@query("""WITH s AS (SELECT user_id, event_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id, event_id, previous, state FROM s WHERE previous IS NOT NULL AND (previous, state) NOT IN (('signup', 'view'), ('view', 'view'), ('view', 'click'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view'))""")
def lifecycle_violations(spark, read):
    history = read("events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    return store.violations(history, "user_id", ["ts", "event_id"], "state", spark.createDataFrame(ALLOWED, "previous string, next string")).select("user_id", "event_id", "previous", "state")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'P' THEN 'F' ELSE o_orderstatus END AS state, o_orderstatus IN ('O', 'P') AS changed FROM orders""")
def lifecycle_transition(spark, read):
    return store.transition(read("orders").select("o_orderkey", F.col("o_orderstatus").alias("state")), "state", {"O": "P", "P": "F"}).select("o_orderkey", "state", "changed")


@query("""SELECT r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'created' WHEN sha256(d.text) = sha256(r.text) THEN 'replayed' ELSE 'conflict' END AS outcome
FROM (SELECT doc_id + 10 AS doc_id, text FROM documents UNION ALL SELECT -1, 'x') r LEFT JOIN documents d USING (doc_id)""")
def registration(spark, read):
    docs = read("documents")
    asked = docs.select((F.col("doc_id") + 10).alias("doc_id"), "text").union(spark.createDataFrame([(-1, "x")], "doc_id long, text string"))
    digest = lambda rows: rows.select("doc_id", F.sha2("text", 256).alias("digest"))
    return store.register(digest(docs), digest(asked), "doc_id", "digest").select("doc_id", "outcome")


@query("""SELECT 'rows' AS name, 'integer' AS kind, count(*) AS integer_value, CAST(NULL AS DECIMAL(38, 6)) AS decimal_value, CAST(NULL AS BOOLEAN) AS boolean_value, CAST(NULL AS VARCHAR) AS text_value FROM orders
UNION ALL SELECT 'customers', 'integer', count(DISTINCT o_custkey), NULL, NULL, NULL FROM orders UNION ALL SELECT 'last_status', 'text', NULL, NULL, NULL, max(o_orderstatus) FROM orders
UNION ALL SELECT 'highest', 'decimal', NULL, CAST(max(o_totalprice) AS DECIMAL(38, 6)), NULL, NULL FROM orders UNION ALL SELECT 'finished', 'boolean', NULL, NULL, bool_and(o_orderstatus = 'F'), NULL FROM orders""")
def statistics_eav(spark, read):
    one = read("orders").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderstatus").alias("last_status"), F.max("o_totalprice").alias("highest"), F.bool_and(F.col("o_orderstatus") == "F").alias("finished"))
    return store.typed_statistics(one, {x: F.col(x) for x in ("rows", "customers", "last_status", "highest", "finished")})


@query("""SELECT relation, count(*) AS n FROM (SELECT 'part' AS relation FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'supplier' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) GROUP BY relation""")
def publication_integrity(spark, read):
    lines = read("lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    lost = store.dangling(lines, "l_partkey", read("part").filter("p_size > 5"), "p_partkey", "part")
    lost = lost.union(store.dangling(lines, "l_suppkey", read("supplier").filter("s_acctbal > 0"), "s_suppkey", "supplier"))
    lost = lost.union(store.dangling(lines, "l_orderkey", read("orders").filter("o_orderstatus <> 'P'"), "o_orderkey", "order"))
    return lost.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT n_regionkey AS region, count(*) AS artifacts, sha256(unhex(string_agg({_seg("CAST(n_nationkey AS VARCHAR)")} || {_seg("n_name")}, '' ORDER BY n_nationkey))) AS digest FROM nation GROUP BY n_regionkey""")
def manifest_digest(spark, read):
    rows = read("nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", "n_name")
    return store.manifest_digest(rows, "region", F.col("n_nationkey"), [F.col("n_nationkey").cast("string"), F.col("n_name")])


LAYERS = [("workers", "4", "default", 0), ("workers", "8", "file", 1), ("depth", "64", "default", 0), ("depth", None, "environment", 2), ("page", "100", "default", 0), ("page", "50", "arguments", 3)]


@query("""SELECT key, arg_max(value, p) AS value, arg_max(layer, p) AS layer FROM (VALUES ('workers', '4', 'default', 0), ('workers', '8', 'file', 1), ('depth', '64', 'default', 0), ('depth', NULL, 'environment', 2), ('page', '100', 'default', 0), ('page', '50', 'arguments', 3)) t(key, value, layer, p) WHERE value IS NOT NULL GROUP BY key""")
def layered_config(spark, read):
    return store.layered(spark.createDataFrame(LAYERS, "key string, value string, layer string, priority int"), "key", "value", "layer", "priority")


@query("""SELECT source AS name, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'es') THEN 'available' WHEN required THEN 'missing' ELSE 'optional' END AS state
FROM (VALUES ('src0', true), ('src1', true), ('no-such', true), ('perhaps', false)) p(source, required)""")
def profile_completeness(spark, read):
    profile = spark.createDataFrame([("src0", True), ("src1", True), ("no-such", True), ("perhaps", False)], "name string, required boolean")
    return store.profile_completeness(profile, read("documents").filter("lang = 'es'").select(F.col("source").alias("name")), "name")
