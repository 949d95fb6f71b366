"""Language ID, suffix tree, SimHash, neighbours and sanitisation."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestone.llm.language_id import Profiles, identify_language, learn_profiles
from lodestone.llm.nearest_neighbours import hadamard, nearest_in_block, nearest_neighbours
from lodestone.llm.sanitisation import OP4_SQL, masked_terms, op4_sanitisation, private_spans, sanitise
from lodestone.llm.simhash import drop_near_duplicates, near_duplicates, simhash
from lodestone.llm.suffix_tree_lm import score_texts

AWKWARD = [(1, None), (2, ""), (3, "123 !?"), (4, "É"), (None, "plain words here"), (5, "plain words here"), (5, "plain words here"), (6, "w" * 50_000)]


def test_language_is_predicted_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify_language(docs.filter(held), learn_profiles(docs.filter(~held)))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right > 0.95
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_language_of_awkward_rows(docs_of):
    docs = docs_of(AWKWARD)
    found = {(r.doc_id, r.text): r.lang_pred for r in identify_language(docs, learn_profiles(docs)).collect()}
    assert [found[k, t] for k, t in AWKWARD[:3]] == ["und"] * 3 and found[4, "É"] == "en" and len(found) == 7
    none = learn_profiles(docs.filter("false"))
    assert none.names == () and {r.lang_pred for r in identify_language(docs, none).collect()} == {"und"}
    assert isinstance(none, Profiles) and identify_language(docs.filter("false"), none).collect() == []


def test_suffix_tree_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {r.doc_id: r for r in score_texts(docs, training, most_frequent=500).collect()}
    rows = [(r.doc_id, r.text.encode().lower().split()) for r in docs.collect()]
    counts = Counter()
    for i, w in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*w, None])
    total, size = sum(counts.values()), len(counts)
    for i, w in rows:
        base = sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in [*w, None])
        assert abs(base - got[i].base_score) < 1e-6 * abs(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and got[i].score < 0


def test_suffix_tree_of_awkward_rows(docs_of):
    docs = docs_of(AWKWARD)
    got = score_texts(docs, F.lit(True)).collect()
    assert len(got) == len(AWKWARD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert len({(r.score, r.base_score) for r in got if r.doc_id in (1, 2)}) == 1
    none = score_texts(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert score_texts(docs.filter("false"), F.lit(True)).collect() == []


def brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs_of):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(k + 10, base + f" x{k}") for k in range(30)] + [(100, None), (101, "  "), (102, "one"), (103, "One"), (None, base), (7, base), (104, "quite another text of words"), (105, base), (105, "unlike")]
    found = near_duplicates(docs_of(rows)).collect()
    prints = {brute_simhash(t): set() for _, t in rows}
    for i, t in rows:
        prints[brute_simhash(t)].add(1 << 62 if i is None else i)
    assert Counter(r.fp & (1 << 64) - 1 for r in found) == Counter(brute_simhash(t) for _, t in rows)
    groups = [({f}, set(ids)) for f, ids in prints.items()]
    k = 0
    while k < len(groups):  # join what is linked
        for j in range(k + 1, len(groups)):
            if any((a ^ b).bit_count() <= 3 for a in groups[k][0] for b in groups[j][0]):
                groups[k] = (groups[k][0] | groups[j][0], groups[k][1] | groups[j][1])
                del groups[j]
                k = -1
                break
        k += 1
    root = {f: min(ids) for fs, ids in groups for f in fs}
    assert all(r.component_id == root[r.fp & (1 << 64) - 1] for r in found)
    kept = [r.doc_id for r in drop_near_duplicates(docs_of(rows)).collect()]
    assert sorted(kept) == sorted(min(ids) for _, ids in groups)
    assert near_duplicates(docs_of(rows).filter("false")).collect() == []
    assert simhash("a b c d", 3) & (1 << 64) - 1 == brute_simhash("a b c d")


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)


def test_neighbours_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    asked = ids % 20 == 0
    exact = {(q, v): s for q, v, s in nearest_in_block(ids[asked], vectors[asked], ids, vectors, 10)}
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 10 * asked.sum()
    assert len({(r.query_id, r.vec_id) for r in got} & set(exact)) >= 0.9 * len(exact)
    at = {int(i): v for i, v in zip(ids, vectors, strict=True)}
    assert all(abs(r.score - np.sqrt(((at[r.query_id] - at[r.vec_id]) ** 2).sum())) < 1e-12 and r.vec_id != r.query_id for r in got)


def test_neighbours_of_awkward_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.1]), (7, [1.0, 0.0, 0.0]), (1, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("own"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 8), (0, 3, 6)]
    assert nearest_neighbours(df.filter("false"), F.lit(True)).collect() == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


SPANS = [
    (1, "mail é a@b.c_d@e.fr and a@b, x@@y.z or a.b+c@d-e.co.uk."), (2, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3"), (3, "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 1"),
    (4, "+1 (555) 123-4567 +44 20 7946 0958. +12345678 +1 () 2"), (5, None), (6, ""), (7, "9" * 40_000 + " " + "a" * 40_000 + "@"), (8, "1 " * 20_000), (None, "a@b.c"), (1, "a@b.c"), (9, "a@b.c +1 (555) 123-4567 😀 4111111111111111"),
]


def test_base_spans(docs_of, tmp_path):
    docs_of(SPANS).write.parquet(str(tmp_path / "documents.parquet"))
    found = op4_sanitisation(docs_of([(0, "")]).sparkSession, str(tmp_path)).collect()
    got = sorted((repr(r.doc_id), [x for x in r.spans.split(",") if x and x[:4] != "term"]) for r in found)
    assert got == sorted((repr(i), brute_spans(t)) for i, t in SPANS)


def test_revealing_terms(docs_of):
    rows = [(k, f"the person Zebulon writes to me@example.org every day number {k}") for k in range(3)] + [(k, f"the person writes every day of the year number {k}") for k in range(10, 60)]
    docs = docs_of(rows)
    found = private_spans(docs).filter("kind = 'term'").collect()
    named = {(r.doc, rows[r.doc][1][r.start : r.end]) for r in found}
    assert named == {(k, "Zebulon") for k in range(3)}
    texts = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert texts[0] == "the person  writes to [EMAIL] every day number 0" and texts[10] == rows[3][1]
    assert sanitise(docs.filter("false")).collect() == []


def test_masked_terms_grow_with_what_documents_hold(spark):
    sizes = {}
    for n in (40, 80):
        words = spark.createDataFrame([(k, 0, f"t{k // 2}") for k in range(n)] * 2, "doc long, version long, term string")
        held = spark.createDataFrame([(k, 0, "shared") for k in range(n)], "doc long, version long, entity string")
        told = spark.createDataFrame([(f"t{k}", "shared", 0.9) for k in range(n // 2)] + [("t0", "other", 0.99), ("gone", "shared", 1.0)], "term string, entity string, disclosure double")
        found = masked_terms(words, held, told).collect()
        assert {(r.doc, r.term, r.disclosure) for r in found} == {(k, f"t{k // 2}", 0.9) for k in range(n)}
        sizes[n] = len(found)
    assert sizes == {40: 40, 80: 80}


def test_sanitisation_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.sql(OP4_SQL)
    got = op4_sanitisation(spark, sf_dir).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_neighbours_where_ids_repeat(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * k]) for k in range(30)] + [(k, [1.0, 0.1 * k]) for k in range(2, 8)]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    exact = [(1, 0.0)] + [(k, 0.1 * k) for k in range(2, 6)]
    got = nearest_in_block(ids[:1], vectors[:1], ids, vectors, 5)
    assert [(v, round(s, 9)) for _, v, s in got] == [(v, round(s, 9)) for v, s in exact]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    for tables in (8, 1):  # one table with few probes leaves queries to the exact search
        found = nearest_neighbours(df, F.col("vec_id") == 0, k=5, tables=tables, probes=1).orderBy("rank").collect()
        assert [(r.vec_id, round(r.score, 9)) for r in found] == [(v, round(s, 9)) for v, s in exact]


def test_revealing_terms_of_any_kind_and_everywhere(docs_of):
    long = "w" * 60
    names = ["Zebulon", "Li", "A7731", "李", long]
    rows = [(k, f"the {' '.join(names[:4])} at me@example.org {long} " + f"and so on number x{k} " * 30 + " ".join(names)) for k in range(3)] + [(k, f"the day at and so on of the year number x{k}") for k in range(10, 60)]
    docs = docs_of(rows)
    found = private_spans(docs).filter("kind = 'term'").collect()
    named = Counter((r.doc, rows[r.doc][1][r.start : r.end]) for r in found)
    assert named == {(k, x): 2 for k in range(3) for x in names}
    texts = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert not any(x in texts[k].split() for k in range(3) for x in names) and texts[10] == rows[3][1]


def brute_neighbours(ids, vectors, query, k):
    """By Python's own exact fractions."""
    from fractions import Fraction

    q = [Fraction(x) for x in vectors[query]]
    apart = {}
    for i, v in zip(ids, vectors, strict=True):
        if i != ids[query]:
            apart[i] = min(apart.get(i, math.inf), sum((Fraction(x) - y) ** 2 for x, y in zip(v, q, strict=True)))
    return [i for _, i in sorted((d, i) for i, d in apart.items())[:k]]


def test_neighbours_of_any_size(spark):
    rng = np.random.default_rng(5)
    for shift, size in ((1e6, 1e-4), (0, 1e170), (0, 1e-200), (0, 1e307), (1e-200, 1e-203), (-3e5, 1.0)):
        vectors = (rng.normal(size=(120, 8)) * size + shift).tolist()
        ids = list(range(119)) + [7]
        got = nearest_in_block(np.array(ids[:5]), np.array(vectors[:5]), np.array(ids), np.array(vectors), 9)
        assert all(np.isfinite(s) and s > 0 for *_, s in got)
        for q in range(5):
            assert [v for i, v, _ in got if i == q] == brute_neighbours(ids, vectors, q, 9)


def test_neighbours_over_blocks(spark, monkeypatch):
    from lodestone.llm import nearest_neighbours as module

    rng = np.random.default_rng(6)
    vectors = (np.rint(rng.normal(size=(300, 4)) * 4) / 4).tolist() + [[1e-200] * 4, [1e170] * 4, [1.5e170] * 4]  # ties across blocks
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(module, "BLOCK", 7)
    found = nearest_neighbours(df, F.col("vec_id") % 60 == 0, k=5, tables=4, probes=8).collect()
    for q in range(0, 300, 60):  # at 300 doubles tie where fractions do not
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == brute_neighbours(range(303), vectors, q, 5)


def test_balls_join_what_is_linked_and_nothing_else(spark):
    from lodestone.llm.simhash import least_labels, links

    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {0, (1 << 64) - 1, *(int(x) for x in centres)}
    for x in centres[:20].tolist():
        for _ in range(12):  # chains that go on by zero to four bits
            for k in rng.choice(64, int(rng.integers(0, 5)), replace=False).tolist():
                x ^= 1 << k
            fps.add(int(x))
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = least_labels(len(fps), *(np.array([p[k] for p in pairs]) for k in (0, 1)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    at = {x: k for k, x in enumerate(fps)}
    found = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in links(nodes).collect()]
    assert (least_labels(len(fps), *(np.array([p[k] for p in found]) for k in (0, 1))) == want).all() and len(set(want.tolist())) < len(fps)


def test_simhash_of_pieces(monkeypatch):
    from lodestone.llm import _common

    texts = ["a b c d e f g h i j", "", None, "one two", "one two three", "x " * 50, "  spaced   out \n words go here  "]
    whole = [[simhash(t, w) for t in texts] for w in (1, 3, 5)]
    monkeypatch.setattr(_common, "PIECE", 3)
    assert [[simhash(t, w) for t in texts] for w in (1, 3, 5)] == whole
    assert [x & (1 << 64) - 1 for x in whole[1]] == [brute_simhash(t) for t in texts]
