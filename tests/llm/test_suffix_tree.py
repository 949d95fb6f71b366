"""The suffix tree's scores against a plain model, and its tables against both."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _common
from lodestone.llm.suffix_tree_lm import LOW, Level, ValueTable, learned, run_windows, runs, score_texts

END = b"\n"


def stream(text):
    return b" ".join((text or "").encode().lower().split()) + END


def plain_model(texts, depth, least, divergence, evidence, discount):
    """log10 probability of a text, written down from the definition."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for text in texts:
        padded = END * depth + stream(text)
        for i in range(depth, len(padded)):
            for k in range(depth + 1):
                counts[k][padded[i - k : i]][padded[i]] += 1
    tested = [{c: n for c, n in level.items() if sum(n.values()) >= least or k == 0} for k, level in enumerate(counts)]
    kept = [set() for _ in range(depth + 1)]
    for k in range(depth, -1, -1):
        for c, n in tested[k].items():
            total, up = sum(n.values()), counts[k - 1][c[1:]] if k else None
            gain = sum(x * math.log(x / total / (up[s] / sum(up.values()))) for s, x in n.items()) if k else math.inf
            if gain >= divergence * total and gain >= evidence * len(n):
                kept[k].add(c)
                for j in range(k):
                    kept[j].add(c[k - j :])

    def score(text):
        padded, out = END * depth + stream(text), 0.0
        for i in range(depth, len(padded)):
            p = 1 / 256
            for k in range(depth + 1):
                c = padded[i - k : i]
                if c not in kept[k]:
                    break
                n = counts[k][c]
                total = sum(n.values())
                share = {s: (x - min(discount, x / 2)) / total for s, x in n.items()}
                p = share.get(padded[i], 0.0) + (1 - sum(share.values())) * p
            out += math.log10(p)
        return out

    return score


TEXTS = [(1, "abra cadabra abra"), (2, "Abra  cadabra\n zebra abra cad"), (3, None), (4, ""), (5, "the the the cat sat on the mat"), (6, "cat sat"), (None, "mat the cat é é"), (7, "a a a b b b c"), (8, "unseen words ß"), (8, "abra")]


@pytest.mark.parametrize("options", [{}, {"most_windows": 5, "most_frequent": 0}])
def test_scores_are_the_plain_model_s(docs_of, options):
    held = {8, None}
    score = plain_model([t for i, t in TEXTS if i not in held], 5, 2, 0.01, 2.0, 0.75)
    words = [(i, (t or "").encode().lower().split()) for i, t in TEXTS]
    known = Counter(x for i, w in words if i not in held for x in [*w, None])
    total, size = sum(known.values()), len(known)
    base = lambda w: sum(math.log10((known[x] + 1) / (total + size + 1)) for x in [*w, None])
    want = sorted((repr(i), len(w) + 1, sum(known[x] > 0 for x in [*w, None]), round(base(w), 9), round(score(t), 9)) for (i, t), (_, w) in zip(TEXTS, words, strict=True))
    got = score_texts(docs_of(TEXTS), F.coalesce(F.col("doc_id"), F.lit(8)) != 8, **options).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}


def test_end_counts_where_it_is_no_frequent_token(docs_of):
    docs = docs_of([(k, "a a a b b b c") for k in range(3)])
    few, many = (sorted((r.n_known, round(r.base_score, 9)) for r in score_texts(docs, F.lit(True), most_frequent=n).collect()) for n in (2, 300_000))
    assert few == many and few[0][0] == 8


def test_pieces_make_the_whole_stream(monkeypatch):
    monkeypatch.setattr(_common, "PIECE", 5)
    for text in ("", None, "   ", "one", " one  two three\tfour five   ", "a" * 40 + " b", "x y z " * 10):
        found = list(runs([text], 3))
        assert b"".join(x[2] for x in found) == stream(text) and [x[4] for x in found].count(True) == 1
        before = END * 3
        for _, context, symbols, _, _ in found:
            assert context == before[-3:]
            before += symbols


def learned_from(texts, depth, evidence):
    windows, _ = run_windows([END * depth] * len(texts), [stream(x) for x in texts], depth)
    grams, n = np.unique(windows, return_counts=True)
    low = Level(grams & np.uint64((1 << 8 * (LOW + 1)) - 1), n)
    return low, learned(grams.astype(np.int64), n, low, depth, 2, 0.01, evidence)


def test_distributions_sum_to_one():
    low, levels = learned_from(["abracadabra abra cadabra " * 30] * 5, 3, 1.0)
    for level, k in ((low, LOW), (levels[0], 3)):
        level.kept[:] = True
        for context in (b"abr", b"rac", b" ab"):
            window = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], dtype=np.uint64)
            p = level.step(window, k, np.full(256, 1 / 256), np.ones(256, dtype=bool), 0.75)
            assert abs(p.sum() - 1) < 1e-9 and p.max() > 0.5


def test_the_tree_grows_with_the_corpus():
    for more in (0, 60):  # a context that a small corpus retains stays in a large one
        low, _ = learned_from(["qzjxv qzjxv"] * 2 + ["plain words stand here " * 4000] * more, 5, 2.0)
        one = low.shorter(1)
        one.test(one.shorter(0), 1, 2, 0.01, 2.0)
        assert ord("q") in one.contexts[one.kept]


def test_value_table():
    keys = np.random.default_rng(1).integers(0, 1 << 48, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    table = ValueTable(keys[::2], np.arange(len(keys[::2]), dtype=float))
    value, missing = table.get(keys)
    assert sorted(missing.tolist()) == list(range(1, len(keys), 2)) and (value[::2] == np.arange(len(keys[::2]))).all() and not value[1::2].any()
    assert ValueTable(keys[:0], np.zeros(0)).get(keys)[1].size == len(keys)
    window, begins = run_windows([END * 3, b"abc"], [b"ab", b"d"], 3)
    assert [int(x).to_bytes(4, "big") for x in window] == [b"\n\n\na", b"\n\nab", b"abcd"] and begins.tolist() == [0, 2]
