"""Compiled tokenizer, packing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import pretokens
from lodestone.llm.packing import pack, packing_plan
from lodestone.llm.pretokens import NEXT, chunk_maps, scan
from lodestone.llm.token_counts import CountingTransducer, IntTable, count_tokens
from lodestone.llm.tokenizer_fst import CompiledTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["'", "s", "'t", "'re", "ve", "'ll", "d", "r", "v", "l", "e", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "中", "!", "-", "<|endoftext|>", "\0", "😀", "Don't", "'S", "\x1c", "\x85", "́"]


@pytest.fixture(scope="module")
def fst():
    with open(PATH) as f:
        return CompiledTokenizer(f.read(), most_paths=500)


@pytest.fixture(scope="module")
def counter():
    with open(PATH) as f:
        return CountingTransducer(f.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=60).map("".join))
def test_ids_are_the_library_s(fst, text):
    text = text.encode("utf-8", "ignore").decode()
    assert next(fst.encoded([text])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=60).map("".join))
def test_counts_are_the_library_s(counter, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.counted([text], most_kept=50) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_counts_of_all_tokens_and_of_runs(counter):
    rng = random.Random(4)
    words = [LIBRARY.decode([k]) for k in range(0, 50_256, 7)]
    joined = ["".join(rng.choice(words).strip() for _ in range(rng.randint(2, 5))) for _ in range(3000)]
    runs = [x * n for x in ("a", "aa", "ab", "é", "=", "-", "the", "中") for n in (*range(1, 40), 500, 3001)]
    for texts in (words, joined, runs):
        assert counter.counted(texts) == [len(x.ids) for x in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
    for x in runs[::13]:
        assert counter.count_one(x.encode()) == int(counter.counts([x.encode()])[0])


def test_tables_of_numbers():
    entries = {k * k << 3: k for k in range(5000)}
    table = IntTable.of(entries)
    keys = np.arange(200_000, dtype=np.int64)
    assert table.get(keys).tolist() == [entries.get(k, -1) for k in range(200_000)]
    assert IntTable.of({}).get(keys[:3]).tolist() == [-1] * 3


@pytest.mark.parametrize("segment", [pretokens.SEGMENT, 3])
def test_groups_and_long_texts(fst, counter, monkeypatch, segment):
    monkeypatch.setattr(pretokens, "SEGMENT", segment)
    texts = ["", None, "x" * 5000, "'" * 300 + "re", " " * 1000 + "x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "some words, it's  said \n we're  \t here "] * 3
    expected = [LIBRARY.encode(x or "", add_special_tokens=False).ids for x in texts]
    for most in (1, 700, 10**6):
        assert [x.tolist() for x in fst.encoded(texts, most)] == expected
        assert counter.counted(texts, most) == [len(x) for x in expected]


def test_chunk_maps_compose():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 12, (9, 128)).astype(np.uint8)
    maps = scan(chunk_maps(classes))
    for begin in range(12):
        state = begin
        for row in range(9):
            for kind in classes[row]:
                state = NEXT[state * 12 + kind]
            assert maps[row, begin] == state


def brute_packing(lengths, capacity):
    open_ = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k in range(len(open_)) if open_[k] >= n), key=lambda k: open_[k], default=None)
        if best is None:
            open_.append(capacity - n)
        else:
            open_[best] -= n
    return sorted(open_)


def test_plan_is_best_fit_decreasing():
    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([8, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        used = defaultdict(list)
        for n, _, pieces, each, first, offset in packing_plan(dict(Counter(lengths)), capacity).tolist():
            for k in range(pieces):
                used[first + k // each].append((offset + k % each * n, n))
        rooms = []
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            rooms.append(capacity - at)
        assert sorted(rooms) == brute_packing(lengths, capacity)


def test_counts_and_packing_of_awkward_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "word " * 5000), (3, "word " * 5000), (4, "<|endoftext|> x"), (5, "é" * 2500)] + [(k, "same text") for k in range(10, 60)]
    ids = lambda t: LIBRARY.encode(t or "", add_special_tokens=False).ids
    counted = count_tokens(docs_of(rows), PATH).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == sorted((repr(i), len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in rows)
    placed = pack(docs_of(rows), PATH, capacity=100).collect()
    expected = []
    for i, t in rows:
        own = [*ids(t), 0]
        cuts = [0, *range(len(own) % 100 or 100, len(own), 100), len(own)]
        expected += [(repr(i), p, a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(expected)
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(sequences) == len(brute_packing([x[3] for x in expected], 100))
    assert pack(docs_of(rows).filter("false"), PATH).collect() == count_tokens(docs_of(rows).filter("false"), PATH).collect() == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, table = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf_dir)
        assert table.columns == docs.columns, name
        table = corpus_pipeline.written(table, "test")
        assert 0.5 * before < table.count() <= before
    last = corpus_pipeline.packing(spark, table, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in table.select("doc_id").collect()}
    assert len({r.doc_id for r in table.collect()}) == table.count()
