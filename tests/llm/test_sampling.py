"""Importance resampling, phrases and MinHash near-duplicates against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash, phrases, wordspans
from lodestone.llm.importance_resampling import CLASSES, crc32_of_spans, features, radix_threshold, resample
from lodestone.llm.minhash import band_keys, near_duplicates, shingle_set, sketches, word_hashes
from lodestone.llm.phrases import Bitmaps, bitmaps, collocations, extended, packed, sorted_by_block, unpacked

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BIG = 1 << 62


# --- importance resampling


def brute_draw(rows, target, order=1, percent=10, min_words=20, buckets=10_000):
    def found(text):
        w = WORD.findall((text or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    here, there = Counter(), Counter()
    for _, t in rows:
        here.update(found(t)[1])
    for t in target:
        there.update(found(t)[1])
    total, wanted = sum(here.values()) + buckets, sum(there.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((there[b] + 1) * total / ((here[b] + 1) * wanted)))
    out = []
    for i, t in rows:
        w, f = found(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], BIG if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "été", "x", "word", "42", "THE", "of", "z" * 90, "naïve"]
    return [(k, " ,".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for k in range(n)]


AWKWARD = [(1000, None), (1001, ""), (1002, " .,\n"), (None, "alpha " * 30), (1003, "a" * 5000), (1004, "alpha beta " * 15), (1004, "alpha beta " * 15), (1004, "alpha beta " * 15), (1005, "Ünï " * 25)]


@pytest.mark.parametrize("order", [1, 3])
@pytest.mark.parametrize("percent", [0, 10, 50, 100])
def test_draw(spark, docs_of, order, percent):
    rows, target = texts(60) + AWKWARD, ["alpha beta, alpha beta", None, "", "the été of 42"]
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, score string")
    found = resample(docs_of(rows), bench, order=order, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_draw(rows, target, order, percent)


def test_draw_keeps_columns_and_takes_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "text string")
    rows = texts(30)
    found = resample(docs_of(rows), bench, percent=50, keep=["text", "n_lines"]).collect()
    assert dict((r.doc_id, r.text) for r in found) == dict(rows) and {r.n_lines for r in found} == {"own"}
    assert resample(docs_of(rows).filter("false"), bench).collect() == []
    with pytest.raises(ValueError):
        resample(docs_of(rows), bench, keep=["score"])


def test_threshold(spark):
    rng = np.random.default_rng(1)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.choice([*ends, 5, 70_000, -70_000], 300), rng.choice([*ends, 1 << 40, 3], 300), strict=True))]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (0, 1, 17, 150, 299, 300):
        assert radix_threshold(df, ["a", "b", "c"], k) == (sorted(rows)[k - 1] if k else None)


def test_features_of_a_cut_text_are_those_of_the_whole(monkeypatch):
    text = " ".join(w for _, t in texts(40) for w in t.split())
    whole = [np.sort(np.concatenate([x[k] for x in features(pa.array([text]), 3, 500)])) for k in (1, 2)]
    monkeypatch.setattr(wordspans.segments, "__defaults__", (0, 300))
    parts = list(features(pa.array([text]), 3, 500))
    assert len(parts) > 5 and all(np.array_equal(np.sort(np.concatenate([x[k] for x in parts])), w) for k, w in zip((1, 2), whole, strict=True))


def test_crc_of_spans():
    data = np.frombuffer(bytes(range(256)) * 4, dtype=np.uint8)
    start = np.arange(0, 900, 7)
    end = start + np.arange(len(start))
    assert crc32_of_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


# --- phrases


def brute_phrases(rows, support=30, percent=80, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    able = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    longer = defaultdict(int)
    for (lang, w), a in able.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    out = defaultdict(list)
    for (lang, w), a in able.items():
        if 100 * longer[lang, w] >= percent * a and longer[lang, w]:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def prose(n, seed):
    rng = np.random.default_rng(seed)
    words = [*"a b c d e".split(), "É", "x|y", "12"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", "\n", ".\x0b"]
    return [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(int(rng.integers(0, 80)))), [None, "en", "und", "fr"][k % 4]) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"shard_words": 70, "most_pairs": 0}, {"top": 7}, {"top": None}, {"support": 3, "absorb_percent": 50}])
def test_phrases(docs_of, monkeypatch, options):
    monkeypatch.setattr(phrases, "MOST_PAIRS", (options := dict(options)).pop("most_pairs", phrases.MOST_PAIRS))
    rows = [*prose(120, 5), (None, "en"), ("", "fr"), ("a b c a b c " * 20, "es"), ("w" * 9000, None), ("same words here " * 4, "de"), *[("same words here", "de")] * 40]
    expect = {"shard_words": 0, **options}
    expect.pop("shard_words")
    want = brute_phrases(rows, expect.get("support", 30), expect.get("absorb_percent", 80), expect.get("top", 2000) or BIG)
    found = collocations(docs_of([(k, t, lang) for k, (t, lang) in enumerate(rows)]), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == want and want


def test_phrases_of_nothing(docs_of):
    assert collocations(docs_of([(1, "a b")])).collect() == [] and collocations(docs_of([(1, "a")]).filter("false")).collect() == []


def test_bitmaps_pack_and_extend(monkeypatch):
    rng = np.random.default_rng(2)
    word = rng.integers(0, 6, 4000)
    place = np.cumsum(1 + (rng.random(4000) < 0.1) + (rng.random(4000) < 0.002) * 70_000)
    order = np.argsort(word, kind="stable")
    maps = bitmaps(word[order], place[order])
    count, gaps, bits = packed(maps, 8)
    assert count.tolist() == [*np.bincount(word, minlength=8)]
    back = unpacked(gaps, bits)
    assert all(np.array_equal(a, b) for a, b in zip(maps, back, strict=True))
    monkeypatch.setattr(phrases, "TOGETHER", 500)
    got = Counter()
    others = sorted_by_block(maps)
    for part in phrases.classes_of(maps, others):
        a, b, block, own = extended(part, others)
        for x, y, n in zip(a.tolist(), b.tolist(), np.bitwise_count(own).tolist(), strict=True):
            got[x, y] += n
    assert got == Counter((x, y) for x, y, d in zip(word[:-1].tolist(), word[1:].tolist(), np.diff(place).tolist(), strict=True) if d == 1)
    assert isinstance(maps, Bitmaps)


# --- MinHash near-duplicates


def brute_groups(rows, width=5, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(a & b)
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    label[i] = label[j] = min(label[i], label[j])
    least = defaultdict(lambda: BIG)
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(least[label[k]], BIG if i is None else i)
    real = lambda x: None if x == BIG else x
    return sorted(((i, len(s), real(least[label[k]]), (BIG if i is None else i) == least[label[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies():
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(500, " ".join(base))]
    for k in range(30):  # a chain of copies, each a little further from the first
        base[4 * k] = f"other{k}"
        rows.append((499 - k, " ".join(base)))
    for k in range(25):
        own = [f"v{k}" for k in range(150)]
        for at in rng.integers(0, 150, 2):
            own[at] = f"n{k}"
        rows.append((600 + k, " ".join(own)))
    return rows


CASES = [
    (1, "One two THREE four five six"), (2, "one two three four five six"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, " \n"), (6, "short text"), (7, "Short\ttext"), (None, "short text"),
    (None, "alone and null"), (8, "é " * 50), (9, "É " * 50), (10, " one two"), (11, "x" * 70_000), (12, "x" * 70_000),
]


def test_near_duplicates(docs_of, sample):
    for df, rows in ((docs_of(CASES + near_copies()), CASES + near_copies()), sample):
        found = near_duplicates(df)
        assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_groups(rows)


def test_near_duplicates_options(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 4)
    monkeypatch.setattr(minhash, "MOST_WANTED", 0)
    rows = CASES + near_copies()
    assert sorted((tuple(r) for r in near_duplicates(docs_of(rows), percent=70, width=2).collect()), key=repr) == brute_groups(rows, 2, 70)
    assert near_duplicates(docs_of(rows).filter("false")).collect() == []
    assert near_duplicates(docs_of([(1, "a b"), (2, "c d")])).filter(~F.col("kept")).collect() == []


def test_near_duplicates_meet_once_an_element(docs_of, monkeypatch):
    rows, whole, seen = near_copies(), minhash.written, defaultdict(list)

    def counted(df, name="table", *args, **more):
        out = whole(df, name, *args, **more)
        seen[name].append(out.count() if name in ("rare", "refined") else None)
        return out

    monkeypatch.setattr(minhash, "written", counted)
    assert sorted((tuple(r) for r in near_duplicates(docs_of(rows)).collect()), key=repr) == brute_groups(rows)
    assert seen["refined"] == seen["rare"] and seen["rare"][0] > 0  # not once more for each band
    assert len(seen["pairs"]) <= 2 + len(minhash.HUBS)


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = [np.unique(x) for x in (pool[:1], pool[:3], pool[:400], pool[60:460], pool[:2000], pool[100:2100])]
    rows = sketches(sets)
    assert rows.shape == (6, minhash.COORDINATES) and not (rows == minhash._EMPTY).any()
    assert np.array_equal(rows, np.concatenate([sketches([x]) for x in sets]))
    for a, b in ((2, 3), (4, 5)):
        alike = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        assert abs((rows[a] == rows[b]).mean() - alike) < 0.17
    assert band_keys(rows).shape == (6, minhash.COORDINATES // minhash.BAND) and len(np.unique(band_keys(rows)[0])) == 24


def test_shingles_of_a_cut_text(monkeypatch):
    text = " ".join(f"w{k % 50}" for k in range(3000))
    whole = shingle_set(word_hashes(pa.array([text]))[0], 5)
    monkeypatch.setattr(wordspans.segments, "__defaults__", (0, 200))
    assert np.array_equal(whole, shingle_set(word_hashes(pa.array([text]))[0], 5)) and len(whole) == 50
    assert CLASSES[ord("a")] == wordspans.WORD
