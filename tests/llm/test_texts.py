"""Line dedup, repeats and decontamination against brute force."""

import hashlib
from collections import Counter
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import repeats
from lodestone.llm.decontamination import build_index, contamination, decontaminate, proximity_matches
from lodestone.llm.line_dedup import deduplicate_lines
from lodestone.llm.repeats import remove_repeats

LONG = "this line stands in several documents"
AWKWARD = [
    (1, f"{LONG}\nown line of the first\n"), (2, f"  {LONG.upper()} \t\nshort\nown line of the second"), (3, None), (4, ""), (5, "short\n" + LONG), (5, LONG + "\nagain this id"),
    (None, LONG), (7, "x" * 30_000 + "\n" + LONG), (8, "ééééééééé\nééééééééé é"), (9, "ééééééééé\nééééééééé é"),
]


def brute_lines(rows):
    big = 1 << 62
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(big if i is None else i)
    out = []
    for i, t in rows:
        own = big if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and own != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"filter_bits": 1 << 16}])
def test_lines(docs_of, sample, options):
    for df, rows in ((docs_of(AWKWARD), AWKWARD), sample):
        got = sorted((tuple(r) for r in deduplicate_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
        assert got == brute_lines(rows)


def test_lines_keep_other_columns(docs_of):
    found = deduplicate_lines(docs_of(AWKWARD))
    assert sorted(found.columns) == sorted(docs_of(AWKWARD).columns + ["n_dropped"])
    assert {r.score for r in found.collect()} == {"own"}
    assert deduplicate_lines(docs_of([(1, "a")]).filter("false")).collect() == []


def brute_repeats(rows, width):
    big = 1 << 62
    first = {}
    data = [(i, big if i is None else i, (t or "").encode()) for i, t in rows]
    for _, k, b in data:
        for s in range(len(b) - width + 1):
            x = b[s : s + width]
            first[x] = min(first.get(x, big + 1), k)
    out = []
    for i, k, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < k:
                gone[s : s + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


PASSAGE = "a passage of words that is copied from one text to the other, and longer than a window"
REPEATS = [
    (1, PASSAGE + " end"), (2, "start " + PASSAGE), (3, None), (4, ""), (5, PASSAGE[:45]), (6, "aaaa" * 60), (7, "b" + "aaaa" * 40), (8, PASSAGE), (8, PASSAGE + " again"), (None, PASSAGE + PASSAGE),
    (9, "é" * 60), (10, "xé" + "é" * 40), (11, PASSAGE[:60] + "different" + PASSAGE[20:80]),
]


@pytest.mark.parametrize("options", [{}, {"part_bytes": 300, "slice_bytes": 64}, {"part_bytes": 1000, "least_hot": 1}])
def test_repeats(docs_of, options):
    found = remove_repeats(docs_of(REPEATS), **options)
    got = sorted((tuple(r) for r in found.withColumn("kept", F.sha2("kept", 256)).collect()), key=repr)
    assert got == brute_repeats(REPEATS, 50)


@pytest.mark.parametrize("buffer", [repeats.FLUSH, 3])
def test_shared_anchors_do_not_depend_on_buffers(monkeypatch, buffer):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(repeats, "FLUSH", buffer)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 150)
    common = "a passage that stands in most of the texts and has more bytes than a window, "
    rows = [(k, 0, (common if k % 4 else "") + "".join(map(chr, rng.integers(97, 123, 60))) + (common if k % 3 else "")) for k in range(40)]
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["doc", "version", "text"])
    made = pa.Table.from_batches(list(repeats.anchor_rows(iter([batch]), 5, 50, 1 << 22))).sort_by([("key", "ascending"), ("kind", "ascending")])
    found = [(p, d) for b in repeats.shared_anchors(iter(made.to_batches()), 5, 10) for p, d in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True)]
    got = sorted((int(r["doc"]), int(r["at"])) for p, d in found if p >= 0 for r in np.frombuffer(d, repeats.PLACE))
    holders, places = defaultdict(list), []
    for doc, _, text in rows:
        data = text.encode()
        place, *_, gram = repeats.anchored_blocks(data, np.array([len(data)]), 50)
        for p, g in zip(place.tolist(), gram.tolist(), strict=True):
            holders[g].append(doc)
            places.append((doc, p, g))
    assert got == sorted((doc, p) for doc, p, g in places if len(set(holders[g])) > 1)
    hot = sorted(int(x) for p, d in found if p == repeats.HOT for x in np.frombuffer(d, "<u8"))
    assert hot == sorted(g for g, own in holders.items() if len(own) > 10 and len(set(own)) > 1) and hot


@pytest.mark.parametrize("windows", [repeats.WINDOWS, 5])
def test_ranges_do_not_depend_on_the_windows_ordered_together(monkeypatch, windows):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(repeats, "WINDOWS", windows)
    width, gram, rows = 30, bytes(range(repeats.GRAM)), []
    for number in range(120):
        lead, tail = int(rng.integers(0, 7)), int(rng.integers(0, 7))
        if lead + tail >= width - repeats.GRAM:
            rows.append((number, lead, bytes(rng.integers(0, 2, lead, dtype=np.uint8)) + (gram if number % 4 else gram[::-1]) + bytes(rng.integers(0, 2, tail, dtype=np.uint8))))
    records = np.array([(k, k + number % 2, 0, number, lead, len(x)) for k, (number, lead, x) in enumerate(rows)], dtype=repeats.BLOCK)
    data = np.uint32(len(rows)).tobytes() + records.tobytes() + b"".join(x for *_, x in rows)
    batch = pa.record_batch([pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["key", "data"])
    told = [np.frombuffer(x, repeats.VERDICT) for b in repeats.judged(iter([batch]), width) for x in b.column(1).to_pylist()]
    got = {(int(r["number"]), k, int(r["least"])) for t in told for r in t for k in range(int(r["head"]), int(r["tail"]) - width + 1)}
    holders = {}
    for k, (number, lead, x) in enumerate(rows):
        for at in range(len(x) - width + 1):
            if at <= lead <= at + width - repeats.GRAM:
                holders.setdefault((lead - at, x[at : at + width]), []).append((k, k + number % 2, number, at))
    want = {(number, at, min(r[0] for r in own)) for own in holders.values() for _, most, number, at in own if min(r[0] for r in own) < max(r[1] for r in own) and min(r[0] for r in own) < most}
    assert {x for x in got if x[0] in {n for n, *_ in rows}} == want


def test_repeats_on_sample(sample):
    df, rows = sample
    got = sorted((tuple(r) for r in remove_repeats(df, part_bytes=100_000).withColumn("kept", F.sha2("kept", 256)).collect()), key=repr)
    assert got == brute_repeats(rows, 50)


def test_window_groups_by_digits():
    rng = np.random.default_rng(3)
    width, gram = 40, bytes(range(repeats.GRAM))
    rows = []
    for doc in range(300):
        lead = int(rng.integers(0, width - repeats.GRAM + 1))
        rest = bytes(rng.integers(0, 2, width - repeats.GRAM, dtype=np.uint8)) if doc % 3 else bytes(width - repeats.GRAM)
        rows.append((doc, lead, rest[:lead] + gram + rest[lead:]))
    data = np.frombuffer(b"".join(x for *_, x in rows), dtype=np.uint8)
    lead, doc = np.array([x[1] for x in rows]), np.array([x[0] for x in rows])
    digits = repeats.window_digits(data, np.arange(300) * width, lead, width)
    live, least = repeats.equal_windows(lead, digits, doc, doc)
    first, n = {}, Counter(x for *_, x in rows)
    for d, _, x in rows:
        first.setdefault(x, d)
    assert {int(k): int(v) for k, v in zip(live, least, strict=True)} == {d: first[x] for d, _, x in rows if n[x] > 1}


def test_repeats_of_nothing(docs_of):
    assert remove_repeats(docs_of(REPEATS).filter("false")).collect() == []
    assert [r.n_removed for r in remove_repeats(docs_of([(1, "x")])).collect()] == [0]


ITEMS = [(7, "One two three four five six seven eight nine ten eleven"), (3, "solo"), (4, "the cat"), (5, None), (6, "..."), (None, "never"), (3, "solo"), (10, "a a a a a a a a a a a a")]
CONTAMINATED = [
    (1, "x ONE two, three four five six seven eight nine ten y"), (2, "two three four five six seven eight nine ten eleven"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""),
    (6, "the cat sat; the Cat. SOLO"), (7, "a " * 30), (7, "another text of seven: solo"), (None, "solo"), (8, "never"), (9, "solo"), (9, "solo"), (10, "w " * 20_000 + "the cat"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(rows, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for s in range(max(len(w) - width, 0) + 1):
                windows[tuple(w[s : s + width])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    own |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(own))))
    return sorted(out, key=repr)


def test_contamination(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination(docs_of(CONTAMINATED), items).collect()
    got = sorted(((None if r.doc == (1 << 63) - 1 else r.doc, r.n_words, r.n_hit, tuple(r["items"])) for r in found), key=repr)
    assert got == brute_contamination(CONTAMINATED, ITEMS)
    clean = {r.text for r in decontaminate(docs_of(CONTAMINATED), items).collect()}
    assert clean == {t for i, t in CONTAMINATED if not brute_contamination([(i, t)], ITEMS)[0][2]}
    assert contamination(docs_of(CONTAMINATED), items.filter("false")).filter("n_hit > 0").count() == 0
    assert contamination(docs_of(CONTAMINATED).filter("false"), items).collect() == []


def test_proximity(spark, docs_of):
    docs = docs_of([(1, "red big fox"), (2, "red very big old fox"), (3, "fox big red"), (4, "red fox")])
    items = spark.createDataFrame([(1, "red fox"), (2, "big")], "item_id long, text string")
    got = {(r.item_id, r.doc, r["first"], r["last"]) for r in proximity_matches(build_index(docs), items, 1).collect()}
    assert got == {("1", 1, 0, 2), ("1", 4, 0, 1), ("2", 1, 1, 1), ("2", 2, 2, 2), ("2", 3, 1, 1)}


def test_contamination_by_items_without_id(spark, docs_of, tmp_path):
    import duckdb

    from lodestone.llm.decontamination import OP1_SQL, op1_decontamination

    rows = [(1, "the secret passage stands here"), (2, "nothing to see"), (3, "secret passage and known answer")]
    items = spark.createDataFrame([(None, "secret passage"), (4, "known answer")], "item_id long, text string")
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs_of(rows), str(tmp_path)).collect()} == {2}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, op1_decontamination(spark, str(tmp_path)).collect())) == sorted(con.execute(OP1_SQL).fetchall())
