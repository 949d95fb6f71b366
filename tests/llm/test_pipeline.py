"""The corpus pipeline against plain Python, language vectors against plain sums, and a very long text."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.language_id import bundles, identify_language, learn_profiles, letter_vector
from test_models import brute_simhash
from test_texts import brute_contamination, brute_lines

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COMMON = "this common line stands in many documents"
ITEM = "one two three four five six seven eight nine ten eleven"


def made_rows():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(words, 60)) + (f"\n{COMMON}" if k % 3 == 0 else "")) for k in range(24)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # copies, one of which the line stage changes
    rows += [(200, f"begin {ITEM} end"), (201, "1234 !!"), (202, ""), (203, None), (204, "w " * 5000), (205, f"{COMMON}\n{COMMON}\nlast"), (206, " ".join(words[:50]) + " tail"), (207, " ".join(words[:50]) + " tail")]
    return [(i, t, "en" if i % 2 else "de") for i, t in rows]


def plain_pipeline(rows, items):
    """(doc_id, piece, start, length, crc) of what five plain stages leave, and the least number of sequences that any packing needs."""
    docs = {i: t for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)}
    docs = {i: kept for i, _, _, kept in brute_lines(list(docs.items()))}
    prints = {i: brute_simhash(t) for i, t in docs.items()}
    groups = []
    for i in sorted(docs):
        linked = [g for g in groups if any((prints[i] ^ prints[j]).bit_count() <= 3 for j in g)]
        groups = [g for g in groups if g not in linked] + [set().union({i}, *linked)]
    docs = {min(g): docs[min(g)] for g in groups}
    hit = {i for i, _, n, _ in brute_contamination(list(docs.items()), items) if n}
    out = []
    for i, t in docs.items():
        if i not in hit:
            ids = np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
            head = len(ids) % 2048 or 2048
            cuts = [0, *range(head, len(ids), 2048), len(ids)]
            out += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out)


def test_run_is_the_plain_pipeline(spark, tmp_path):
    rows, items = made_rows(), [(1, ITEM), (2, None)]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, items)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert {i for i, *_ in want} >= {0, 1, 204} and not {i for i, *_ in want} & {200, 201, 202, 203} and sum(i in range(100, 105) or i == 207 for i, *_ in want) == 1  # the line stage empties copies
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for o2, n in own if o2 < o) for o, _ in sorted(own)] and sum(n for _, n in own) <= 2048


def plain_vector(text, dimensions):
    letters = [ord(c) if c.isalpha() else 0 for c in f"  {text.lower()}  "]
    table = {0: letter_vector(0, dimensions)} | {c: letter_vector(c, dimensions) for c in letters}
    total = np.zeros(dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b and (a or c):
            total += np.roll(table[a].astype(int), 2) * np.roll(table[b].astype(int), 1) * table[c].astype(int)
    return total


def test_segments_do_not_change_bundles(monkeypatch):
    from lodestone.llm import pretokens

    texts, group = ["some words ΣΑΣ in a row, and 12 more  words", "", "x", "no blank at all".replace(" ", "-")], np.array([0, 1, 1, 0])
    whole = bundles(texts, group, 2, 64)
    monkeypatch.setattr(pretokens, "SEGMENT", 3)
    assert (bundles(texts, group, 2, 64) == whole).all()


def test_language_is_the_nearest_plain_sum(docs_of):
    known = [(1, "the cat and the hat", "en"), (2, "die Katze und der Hut", "de"), (3, "one more sentence of the same", "en"), (4, "und noch ein Satz", "de")]
    asked = [(10, "the other cat"), (11, "der andere Satz und"), (12, "hat!"), (13, "Ünd, 3 die")]
    profiles = learn_profiles(docs_of(known))
    want = {x: sum(plain_vector(t, 512) for _, t, lang in known if lang == x) for x in ("de", "en")}
    assert profiles.names == ("de", "en") and all((profiles.vectors[k] == want[x]).all() for k, x in enumerate(("de", "en")))
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs_of(asked), profiles).collect()}
    for i, t in asked:
        scores = {x: cosine(plain_vector(t, 512), want[x]) for x in want}
        best = max(scores, key=scores.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(max(scores[best], 0))
    assert (bundles(["the cat", "é x yz"], np.array([0, 1]), 2, 64) == np.stack([plain_vector(t, 64) for t in ("the cat", "é x yz")])).all()


def test_very_long_text(spark):
    from lodestone.llm.repeats import remove_repeats
    from lodestone.llm.suffix_tree_lm import score_texts
    from lodestone.llm.token_counts import count_tokens

    size = 3_000_000
    long = ("some words of a very long text, number x%d. " * 70_000) % tuple(range(70_000))
    assert len(long) > size
    docs = spark.createDataFrame([(1, long), (2, "some words")], "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts[1] == len(LIBRARY.encode(long, add_special_tokens=False).ids)
    scored = {r.doc_id: r for r in score_texts(docs, F.lit(True)).collect()}
    assert scored[1].n_tokens == len(long.split()) + 1 and scored[1].n_known == scored[1].n_tokens
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 0}
