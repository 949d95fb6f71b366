"""Queries over program sources and types, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import method_sets
from lodestone.operators.scopes import looked_up
from lodestone.operators.type_expressions import expression_relations
from lodestone.plans.bindings import query
from lodestone.sources import go_syntax

# ---- Go sources, of which each customer with orders has a file ---------------


def sources(read) -> DataFrame:
    """(path, content): an import, two constants, a type and a method for each order, and marks inside comments and literals that are none.

    Files of every eleventh customer have a bracket too many.
    """
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = read("orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("i"))
    per = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("i", F.col("o_orderkey").cast("string").alias("k")))).alias("o"))  # a customer's orders
    each = lambda f: F.array_join(F.transform("o", f), "")
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    alias = lambda x: F.when(x["i"] % 4 == 0, "_ ").when(x["i"] % 4 == 1, say("a", x["i"], " ")).when(x["i"] % 4 == 2, ". ").otherwise("")
    imports = each(lambda x: say("\t", alias(x), '"ex.org/o', x["k"], '" // import "none"\n'))
    constants = each(lambda x: say("\tC", x["i"], ", D", x["i"], " = ", x["k"], ', "// }"\n'))
    star = lambda x: F.when(x["k"].cast("long") % 2 == 1, "*").otherwise("")
    types = each(lambda x: say("type S", x["i"], " struct { v int; w [4]struct{} }\nfunc (s ", star(x), "S", x["i"], ") M", x["k"], "() { /* } */\n}\n"))
    content = say(
        "/* customer ", F.col("o_custkey"), "\n   type Old struct { */\npackage p", F.col("o_custkey") % 25, '\n\nimport (\n\t"fmt"\n', imports, ")\nvar doc = `func ghost() {\ntype Ghost struct {`\nconst (\n", constants, ")\n", types,
        F.when(F.col("o_custkey") % 11 == 0, "}").otherwise(""),
    )
    return per.select(say("c", F.col("o_custkey"), ".go").alias("path"), content.alias("content"))


_ORDERS = """o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
good AS (SELECT *, 'c' || c || '.go' AS path FROM o WHERE c % 11 <> 0)"""


@query("SELECT 'c' || c || '.go' AS path, CASE WHEN c % 11 <> 0 THEN 'p' || c % 25 END AS package, CASE WHEN c % 11 <> 0 THEN 'parsed' ELSE 'failed' END AS status FROM (SELECT DISTINCT o_custkey AS c FROM orders)")
def go_files(spark, read):
    return go_syntax.go_files(sources(read))


@query(f"""WITH {_ORDERS}
SELECT DISTINCT path, 6 AS line, 'fmt' AS import_path, '' AS alias, 'default' AS alias_kind FROM good
UNION ALL SELECT path, CAST(6 + i AS INT), 'ex.org/o' || k, CASE i % 4 WHEN 0 THEN '_' WHEN 1 THEN 'a' || i WHEN 2 THEN '.' ELSE '' END, CASE i % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'named' WHEN 2 THEN 'dot' ELSE 'default' END FROM good""")
def go_imports(spark, read):
    return go_syntax.go_imports(sources(read)).select("path", F.col("line").cast("int").alias("line"), "import_path", "alias", "alias_kind")


@query(f"""WITH {_ORDERS},
s AS (SELECT DISTINCT path, 8 + n AS line, 'variable' AS kind, 'doc' AS name, '' AS receiver_base, false AS pointer FROM good
UNION ALL SELECT path, 10 + n + i, 'constant', x || i, '', false FROM good, (SELECT unnest(['C', 'D']) AS x)
UNION ALL SELECT path, 12 + 2 * n + 3 * (i - 1), 'struct', 'S' || i, '', false FROM good
UNION ALL SELECT path, 13 + 2 * n + 3 * (i - 1), 'method', 'M' || k, 'S' || i, k % 2 = 1 FROM good)
SELECT path, CAST(line AS INT) AS line, kind, name, receiver_base, pointer, false AS generic FROM s""")
def go_symbols(spark, read):
    return go_syntax.go_symbols(sources(read)).select("path", F.col("line").cast("int").alias("line"), "kind", "name", "receiver_base", "pointer", "generic")


# ---- types, scopes and method sets --------------------------------------------


def type_sources(read) -> DataFrame:
    """(path, content): one of five kinds of type for each order of a customer."""
    k = F.col("o_orderkey").cast("string")
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    forms = [
        say("type T", k, " = []*K", k), say("type T", k, " map[string]chan<- pkg.V", k), say("type T", k, " struct {\n\ta, b *K", k, ' `json:"x"`\n\tBase', k, "\n\tc [4]func(x, y int, z ...E", k, ") error // any\n}"),
        say("type T", k, " interface {\n\tBase", k, "\n\tM(p Q", k, ") (R", k, ", error)\n\t~int | string\n}"), say("type T", k, "[P any] Pair[K", k, ", []V", k, "]"),
    ]
    text = F.when(F.col("o_orderkey") % 5 == 0, forms[0])
    for n in range(1, 5):
        text = text.when(F.col("o_orderkey") % 5 == n, forms[n])
    each = read("orders").select("o_custkey", text.alias("text"))
    per = each.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("types"))  # a customer's orders
    return per.select(say("c", F.col("o_custkey").cast("string"), ".go").alias("path"), say("package p\n\n", F.col("types"), "\n").alias("content"))


_TYPE_ROWS = """(0, 0, 'alias_of', NULL, 'type:[]*K', true, ''), (0, 1, 'uses', NULL, 'K', false, ''), (1, 0, 'uses', NULL, 'string', false, ''), (1, 1, 'uses', NULL, 'pkg.V', false, ''),
(2, 0, 'uses', 'a', 'K', false, ''), (2, 1, 'uses', 'b', 'K', false, ''), (2, 2, 'uses', 'Base', 'Base', false, ''), (2, 3, 'embeds', NULL, 'Base', false, ''),
(2, 4, 'uses', 'c', 'int', false, ''), (2, 5, 'uses', 'c', 'E', false, ''), (2, 6, 'uses', 'c', 'error', false, ''),
(3, 0, 'embeds', NULL, 'Base', false, ''), (3, 1, 'uses', NULL, 'Base', false, ''), (3, 2, 'uses', 'M', 'Q', false, ''), (3, 3, 'uses', 'M', 'R', false, ''), (3, 4, 'uses', 'M', 'error', false, ''),
(3, 5, 'constrains', NULL, 'type:~int | string', true, ''), (3, 6, 'uses', NULL, 'int', false, ''), (3, 7, 'uses', NULL, 'string', false, ''),
(4, 0, 'instantiates', NULL, 'Pair', false, 'K@;[]V@'), (4, 1, 'uses', NULL, 'Pair', false, ''), (4, 2, 'uses', NULL, 'K', false, ''), (4, 3, 'uses', NULL, 'V', false, '')"""


@query(f"""SELECT 'T' || o_orderkey AS owner, CAST(ordinal AS INT) AS ordinal, kind, CASE WHEN member = 'Base' THEN 'Base' || o_orderkey ELSE member END AS member,
CASE WHEN target IN ('string', 'int', 'error', 'Pair') OR target LIKE '%~%' THEN target ELSE target || o_orderkey END AS target, structural, replace(arguments, '@', CAST(o_orderkey AS VARCHAR)) AS arguments
FROM orders JOIN (VALUES {_TYPE_ROWS}) t(form, ordinal, kind, member, target, structural, arguments) ON o_orderkey % 5 = form""")
def type_expressions(spark, read):
    types = go_syntax.go_types(type_sources(read)).select(F.col("name").alias("owner"), "alias", "expression")
    return expression_relations(types).withColumn("arguments", F.array_join("arguments", ";"))


@query("""WITH d AS (SELECT 'c' || o_custkey || '.go' AS path, 'T' || o_orderkey AS name, ['type_alias', 'defined_type', 'struct', 'interface', 'defined_type'][1 + o_orderkey % 5] AS kind, c_acctbal AS b FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT path, name, kind, 'package:.:p' AS scope, CASE WHEN kind NOT IN ('struct', 'interface') THEN 'resolved' WHEN b < 0 THEN 'partial' WHEN b > 9000 THEN 'ambiguous' ELSE 'resolved' END AS status FROM d""")
def declarations(spark, read):
    """Declared types against symbols of which customers in debt have none and rich ones each twice."""
    files = type_sources(read)
    asset = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".go")).alias("path"), F.col("c_acctbal").alias("b"))
    known = go_syntax.go_symbols(files).join(asset, "path").filter("b >= 0").select("path", "kind", "name", "offset", F.explode(F.array_repeat(F.lit(1), F.when(F.col("b") > 9000, 2).otherwise(1))))
    return go_syntax.reconciled(go_syntax.go_declarations(files), known.drop("col"))[0].select("path", "name", "kind", "scope", "status")


@query("""WITH RECURSIVE scopes AS (SELECT 'r' || r_regionkey AS scope, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
decl AS (SELECT 'r' || r_regionkey AS scope, 'x' || (r_regionkey + 2) AS name, 'region' AS target FROM region UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey % 7, 'nation' FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey % 7, 'again' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'c' || c_custkey, 'x' || c_custkey % 7, 'customer' FROM customer),
asked AS (SELECT o_orderkey AS reference, 'o' || o_orderkey AS scope, 'x' || o_orderkey % 8 AS name FROM orders),
up AS (SELECT reference, name, scope AS place, 0 AS d FROM asked UNION ALL SELECT reference, name, parent, d + 1 FROM up JOIN scopes ON scopes.scope = up.place WHERE parent IS NOT NULL),
hit AS (SELECT reference, d, place, target, rank() OVER (PARTITION BY reference ORDER BY d) AS k FROM up JOIN decl ON decl.scope = up.place AND decl.name = up.name),
best AS (SELECT reference, any_value(place) AS scope_found, count(*) AS n, min(target) AS target FROM hit WHERE k = 1 GROUP BY reference)
SELECT reference, scope_found, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN target END AS target FROM asked LEFT JOIN best USING (reference)""")
def scope_chain(spark, read):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    x = lambda c, m: F.concat(F.lit("x"), (F.col(c) % m).cast("string")).alias("name")
    region, nation, customer, orders = (read(t) for t in ("region", "nation", "customer", "orders"))
    tree = lambda rows, p, own, q, above: rows.select(name(p, own).alias("scope"), name(q, above).alias("parent"))
    scopes = region.select(name("r", "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent"))
    scopes = scopes.union(tree(nation, "n", "n_nationkey", "r", "n_regionkey")).union(tree(customer, "c", "c_custkey", "n", "c_nationkey")).union(tree(orders, "o", "o_orderkey", "c", "o_custkey"))
    declared = region.select(name("r", "r_regionkey").alias("scope"), F.concat(F.lit("x"), (F.col("r_regionkey") + 2).cast("string")).alias("name"), F.lit("region").alias("target"))
    declared = declared.union(nation.select(name("n", "n_nationkey"), x("n_nationkey", 7), F.lit("nation"))).union(nation.filter("n_nationkey % 5 = 0").select(name("n", "n_nationkey"), x("n_nationkey", 7), F.lit("again")))
    declared = declared.union(customer.select(name("c", "c_custkey"), x("c_custkey", 7), F.lit("customer")))
    asked = orders.select(F.col("o_orderkey").alias("reference"), name("o", "o_orderkey").alias("scope"), x("o_orderkey", 8))
    return looked_up(asked, scopes, declared).select("reference", "scope_found", "candidates", "outcome", "target")


_EMBEDS = """arcs AS (SELECT 'p' || p_partkey AS type, 'p' || p_partkey // 2 AS target, p_size % 2 = 1 AS pointer FROM part WHERE p_partkey >= 2
UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey // 3, false FROM part WHERE p_size % 3 = 0 AND p_partkey >= 3 UNION ALL SELECT 'p' || p_partkey, 'outside', false FROM part WHERE p_size = 50
UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey // 4, false FROM supplier WHERE s_suppkey >= 4),
methods AS (SELECT 'p' || l_partkey AS type, 'M' || l_suppkey % 12 AS name, min(l_linestatus) AS signature, min(l_returnflag) = 'A' AS pointer FROM lineitem GROUP BY ALL),
fields AS (SELECT 'p' || p_partkey AS type, 'M' || p_size % 12 AS name, CAST(NULL AS VARCHAR) AS signature, false AS pointer FROM part WHERE p_partkey % 4 = 0),
members AS (SELECT * FROM methods UNION ALL SELECT * FROM fields WHERE (type, name) NOT IN (SELECT (type, name) FROM methods)),
asked AS (SELECT 's' || l_suppkey AS type, 'M' || l_partkey % 12 AS name, min(l_linestatus) AS signature FROM lineitem WHERE l_quantity > 47 GROUP BY ALL),
known AS (SELECT 'p' || p_partkey AS type FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
pairs AS (SELECT DISTINCT 'p' || l_partkey AS type, 's' || l_suppkey AS interface, (l_partkey + l_suppkey) % 2 = 0 AS pointer FROM lineitem),
walk AS (SELECT type, type AS part, 0 AS depth, false AS by_pointer FROM known UNION ALL SELECT walk.type, target, depth + 1, by_pointer OR pointer FROM walk JOIN arcs ON arcs.type = walk.part),
counted AS (SELECT type, part, depth, count(*) AS ways, bool_or(by_pointer) AS by_pointer FROM walk GROUP BY ALL),
made AS (SELECT * FROM counted QUALIFY depth = min(depth) OVER (PARTITION BY type, part)),
open AS (SELECT DISTINCT type FROM made WHERE part NOT IN (SELECT type FROM known)),
every AS (SELECT made.type, name, depth, sum(ways) AS ways, max(signature) AS signature, bool_or(NOT pointer OR by_pointer) AS value FROM made JOIN members ON members.type = made.part GROUP BY ALL),
found AS (SELECT * FROM every QUALIFY depth = min(depth) OVER (PARTITION BY type, name)),
have AS (SELECT * FROM found WHERE ways = 1 AND signature IS NOT NULL),
wanted AS (SELECT DISTINCT made.type AS interface, name, asked.signature FROM made JOIN asked ON asked.type = made.part WHERE made.type LIKE 's%'),
met AS (SELECT p.type, p.interface, p.pointer, w.name, w.name IS NOT NULL AND coalesce(w.signature <> h.signature, true) AS no_pointer, w.name IS NOT NULL AND (coalesce(w.signature <> h.signature, true) OR NOT h.value) AS no_value
FROM pairs p LEFT JOIN wanted w USING (interface) LEFT JOIN have h ON h.type = p.type AND h.name = w.name),
verdict AS (SELECT type, interface, pointer, count(DISTINCT name) FILTER (WHERE no_value) AS by_value, count(DISTINCT name) FILTER (WHERE no_pointer) AS by_pointer,
coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE CASE WHEN pointer THEN no_pointer ELSE no_value END), '') AS missing, type IN (SELECT type FROM open) OR interface IN (SELECT type FROM open) AS unknown FROM met GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_EMBEDS}
SELECT type, interface, pointer, CASE WHEN unknown THEN 'unknown' WHEN missing = '' THEN 'proven' ELSE 'disproven' END AS status,
NOT unknown AND by_value > 0 AND by_pointer = 0 AS pointer_required, CASE WHEN unknown THEN '' ELSE missing END AS missing FROM verdict""")
def interface_judgements(spark, read):
    part, supplier, lines = read("part"), read("supplier"), read("lineitem")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key, size, supp = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    arc = lambda rows, p, own, target, pointer: rows.select(name(p, own).alias("type"), target.alias("target"), pointer.alias("pointer"))
    no = F.lit(False)
    embeds = arc(part.filter(key >= 2), "p", key, name("p", F.floor(key / 2)), size % 2 == 1).union(arc(part.filter((size % 3 == 0) & (key >= 3)), "p", key, name("p", F.floor(key / 3)), no))
    embeds = embeds.union(arc(part.filter(size == 50), "p", key, F.lit("outside"), no)).union(arc(supplier.filter(supp >= 4), "s", supp, name("s", F.floor(supp / 4)), no))
    methods = lines.groupBy(name("p", F.col("l_partkey")).alias("type"), name("M", F.col("l_suppkey") % 12).alias("name")).agg(F.min("l_linestatus").alias("signature"), (F.min("l_returnflag") == "A").alias("pointer"))
    fields = part.filter(key % 4 == 0).select(name("p", key).alias("type"), name("M", size % 12).alias("name"), F.lit(None).cast("string").alias("signature"), no.alias("pointer"))
    required = lines.filter("l_quantity > 47").groupBy(name("s", F.col("l_suppkey")).alias("type"), name("M", F.col("l_partkey") % 12).alias("name")).agg(F.min("l_linestatus").alias("signature"), F.min(no).alias("pointer"))
    members = methods.union(fields.join(methods, ["type", "name"], "left_anti").select(*methods.columns)).union(required)
    known = part.select(name("p", key).alias("type")).union(supplier.select(name("s", supp)))
    uses = lines.select(name("p", F.col("l_partkey")).alias("type"), name("s", F.col("l_suppkey")).alias("interface"), ((F.col("l_partkey") + F.col("l_suppkey")) % 2 == 0).alias("pointer"))
    return method_sets.judged(uses, known, members, embeds).withColumn("missing", F.array_join("missing", ","))
