"""Token counts by a byte-level BPE tokenizer compiled to finite-state transducers.

The first transducer cuts a text into pre-tokens. The second reads a pre-token's
bytes and counts. Merging by rank has this property: of every beginning of a
pre-token the last token is the longest token that ends there and may stand
behind the last token of what is left before it; which tokens may stand side by
side is a finite relation. So a state is what the machine must remember to find
it: the node that an automaton of all tokens has reached, and the last tokens at
the places before. A transition's annotation is how many more tokens the longer
beginning has; the pre-token's count is their sum. Nothing but the file's
vocabulary and merges is used; no library counts.

All different pre-tokens of a group run in step. A pre-token always begins in
the same state, so its map is a number; the numbers of whole texts come from a
prefix scan over all pre-tokens, after the first transducer's chunk maps have
been composed by one.

Cases: a null text is empty and has no tokens; texts of any length are taken
whole, the longest in segments cut where a pre-token must begin; repeated rows
and ids are counted row by row; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm._common import KEPT, lean
from lodestone.llm.pretokens import byte_letters, cut, grouped

#: Pre-tokens of more bytes are counted by themselves.
LONG = 96
NONE = -1
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places of the memory of token pairs.
PAIR_BITS = 20


def merged(pieces: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Merge neighbours, the pair of the earliest merge first and the leftmost of these, until none is left."""
    while True:
        found = [(pairs[x], k) for k, x in enumerate(zip(pieces, pieces[1:], strict=False)) if x in pairs]
        if not found:
            return pieces
        token, k = min(found)
        pieces = [*pieces[:k], token, *pieces[k + 2 :]]


@dataclass
class IntTable:
    """Numbers of 64-bit keys by open addressing, NONE for others."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, entries: dict[int, int]) -> IntTable:
        bits = max(4, (3 * len(entries)).bit_length())
        keys, values = np.full(1 << bits, NONE, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        own, numbers = np.array(list(entries), dtype=np.int64), np.array(list(entries.values()), dtype=np.int32)
        place, left = cls._slots(own, bits), np.arange(len(own))
        while len(left):
            free = keys[place] == NONE
            keys[place[free]] = own[left[free]]
            settled = keys[place] == own[left]
            values[place[settled]] = numbers[left[settled]]
            left, place = left[~settled], (place[~settled] + 1) & (len(keys) - 1)
        return cls(keys, values)

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._slots(keys, len(self.keys).bit_length() - 1)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], np.int32(NONE))
        left = np.flatnonzero((there != keys) & (there != NONE))
        place = place[left]
        while len(left):
            place = (place + 1) & (len(self.keys) - 1)
            there = self.keys[place]
            hit = there == keys[left]
            out[left[hit]] = self.values[place[hit]]
            open_ = ~hit & (there != NONE)
            left, place = left[open_], place[open_]
        return out


class CountingTransducer:
    """The tables of both transducers' second, compiled from a tokenizer file's JSON text."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE with its usual pattern, no normalizer and no prefix space is compiled")
        added = spec.get("added_tokens") or []
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip, normalize or stand alone are not compiled")
        self.added = {x["content"]: x["id"] for x in added}
        letters = byte_letters()
        number = {x: k for x, k in spec["model"]["vocab"].items() if x not in self.added}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]]
        made = [number[a + b] for a, b in merges]
        if any(x not in number for x in letters) or any(a >= b for a, b in zip(made, made[1:], strict=False)) or set(made) | {number[x] for x in letters} != set(number.values()):
            raise ValueError("the merges do not make the vocabulary in its order")
        # From here on a token is its rank: first the bytes, then what the merges make, in their order.
        rank = {x: letters[x] for x in letters} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
        pairs = {(rank[a], rank[b]): rank[a + b] for a, b in merges}
        data = {k: bytes(letters[c] for c in x) for x, k in rank.items()}
        self.left, self.right = np.arange(len(rank), dtype=np.int32), np.arange(len(rank), dtype=np.int32)
        for (a, b), k in pairs.items():
            self.left[k], self.right[k] = a, b
        self.pairs = IntTable.of({a << 32 | b: k for (a, b), k in pairs.items()})
        self._automaton({k: x for k, x in data.items() if len(x) == 1 or merged(list(x), pairs) == [k]})
        self.lengths = np.array([len(data[k]) for k in range(len(rank))], dtype=np.int32)

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        """An automaton of all tokens: edges, each node's longest suffix that is a node, the longest token that ends there, and for each token the next shorter one that ends with it."""
        nodes: dict[bytes, int] = {b"": 0}
        for x in sorted(tokens.values(), key=len):
            for k in range(1, len(x) + 1):
                nodes.setdefault(x[:k], len(nodes))
        at = sorted(nodes, key=len)
        fail, longest = np.zeros(len(nodes), dtype=np.int32), np.full(len(nodes), NONE, dtype=np.int32)
        token = {x: k for k, x in tokens.items()}
        for x in at[1:]:
            k = 1
            while x[k:] not in nodes:
                k += 1
            fail[nodes[x]] = nodes[x[k:]]
            longest[nodes[x]] = token.get(x, longest[fail[nodes[x]]])
        self.fail, self.longest = fail, longest
        self.shorter = np.full(len(self.left), NONE, dtype=np.int32)
        for x, k in token.items():
            self.shorter[k] = longest[fail[nodes[x]]]
        self.edges = IntTable.of({nodes[x[:-1]] << 8 | x[-1]: n for x, n in nodes.items() if x})

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May token b stand behind token a: does no merge across their border come before those that make them?

        Time runs backwards from the whole tokens: of the last piece of a and the
        first piece of b, the one that was made later is undone.
        """
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        most = np.int64(len(self.left))
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(a), most), np.full(len(a), most)  # when a larger piece takes them in
        while len(live):
            m = self.pairs.get(x << 32 | y)
            clash = (m != NONE) & (m < until_x) & (m <= until_y)
            out[live[clash]] = False
            undo_x = (x >= y) & (x >= 256)
            undo_y = ~undo_x & (y >= 256)
            go = (undo_x | undo_y) & ~clash
            live, x, y, until_x, until_y, undo_x = live[go], x[go], y[go], until_x[go], until_y[go], undo_x[go]
            until_x, until_y = np.where(undo_x, x, until_x), np.where(undo_x, until_y, y)
            x, y = np.where(undo_x, self.right[x], x).astype(np.int64), np.where(undo_x, y, self.left[y]).astype(np.int64)
        return out

    @cached_property
    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs met before and whether they may stand side by side; a place keeps the last pair that fell on it."""
        return np.full(1 << PAIR_BITS, NONE, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, answers = self._known
        key = a.astype(np.int64) << 32 | b
        place = IntTable._slots(key, PAIR_BITS)
        out = answers[place]
        new = np.flatnonzero(keys[place] != key)
        if len(new):
            out[new] = self.beside(a[new], b[new])
            keys[place[new]] = key[new]
            same = new[keys[place[new]] == key[new]]
            answers[place[same]] = out[same]
        return out

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next nodes."""
        node, byte = node.astype(np.int64), byte.astype(np.int64)
        out = self.edges.get(node << 8 | byte).astype(np.int64)
        left = np.flatnonzero(out == NONE)
        while len(left):  # every byte is a token, so the root has an edge for each
            node[left] = self.fail[node[left]]
            out[left] = self.edges.get(node[left] << 8 | byte[left])
            left = left[out[left] == NONE]
        return out

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token; all run in step, the longest first."""
        sizes = np.array([len(x) for x in pretokens], dtype=np.int64)
        out = np.zeros(len(pretokens), dtype=np.int64)
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self.count_one(pretokens[k])
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        for k in range(0, len(order), 32_768):
            own = order[k : k + 32_768]
            out[own] = self._run([pretokens[i] for i in own], sizes[own])
        return out

    def _run(self, pretokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
        flat = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        begin = np.cumsum(sizes) - sizes
        last = np.zeros((int(sizes[0]), len(sizes)), dtype=np.int32)
        total = np.zeros((int(sizes[0]) + 1, len(sizes)), dtype=np.int32)
        node = np.zeros(len(sizes), dtype=np.int64)
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # those longer than i
            node = self._step(node[:n], flat[begin[:n] + i])
            token = self.longest[node]
            left = np.arange(n)
            while len(left):
                before = i + 1 - self.lengths[token[left]]
                inner = before > 0
                fits = ~inner
                fits[inner] = self._beside(last[before[inner] - 1, left[inner]], token[left[inner]])
                left = left[~fits]
                token[left] = self.shorter[token[left]]
            last[i, :n] = token
            total[i + 1, :n] = total[i + 1 - self.lengths[token], np.arange(n)] + 1
        return total[sizes, np.arange(len(sizes))]

    def count_one(self, data: bytes) -> int:
        """The same walk for one long pre-token, step by step."""
        edges, pairs, token_of = self._edges_of, self._pair_memory, self.longest
        last: list[int] = []
        total = [0]
        node = 0
        for i, byte in enumerate(data):
            while (to := edges.get(node << 8 | byte)) is None:
                node = int(self.fail[node])
            node = to
            token = int(token_of[node])
            while True:
                before = i + 1 - int(self.lengths[token])
                if before == 0:
                    break
                key = last[before - 1], token
                if key not in pairs:
                    if len(pairs) > 200_000:
                        pairs.clear()
                    pairs[key] = bool(self.beside(np.array(key[:1]), np.array(key[1:]))[0])
                if pairs[key]:
                    break
                token = int(self.shorter[token])
            last.append(token)
            total.append(total[before] + 1)
        return total[-1]

    @cached_property
    def _edges_of(self) -> dict[int, int]:
        there = self.edges.keys != NONE
        return dict(zip(self.edges.keys[there].tolist(), self.edges.values[there].tolist(), strict=True))

    @cached_property
    def _pair_memory(self) -> dict[tuple[int, int], bool]:
        return {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_edges_of", "_pair_memory", "_counts", "_special")}

    @cached_property
    def _counts(self) -> dict[str, int]:
        return {}

    @cached_property
    def _special(self) -> regex.Pattern | None:
        return regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def counted(self, texts: Iterable[str | None], most_chars: int = 400_000, most_kept: int = 200_000) -> list[int]:
        """The number of tokens of each text; special strings count as their own. most_kept: pre-tokens whose sums are kept."""
        kept, out = self._counts, []
        for group in grouped(texts, most_chars):
            found = cut([x for _, x in group], self._special, self.added)
            numbers = list(map(kept.get, found.different))
            if None in numbers:
                new = [x for x, n in zip(found.different, numbers, strict=True) if n is None]
                if len(kept) + len(new) > most_kept:
                    kept.clear()
                kept.update(zip(new, self.counts([x.encode() for x in new]).tolist(), strict=True))
                numbers = [kept[x] if n is None else n for x, n in zip(found.different, numbers, strict=True)]
            emitted = np.array(numbers, dtype=np.int64)[found.kind]
            emitted[found.marked] = found.special >= 0
            bounds = np.cumsum(emitted)[found.marked[found.last]]
            for (k, _), n in zip(group, np.diff(bounds, prepend=0).tolist(), strict=True):
                if k == len(out):
                    out.append(n)
                else:
                    out[k] += n
        return out


_shared: dict[int, CountingTransducer] = {}
KEPT["counts"] = _shared.clear


def shared(key: int, compiled) -> CountingTransducer:
    """This process's tables of a broadcast; what one task has met serves the next."""
    if key not in _shared:
        _shared.clear()
        _shared[key] = compiled.value
    return _shared[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Return id_col, n_bytes, n_tokens and over_limit (more than limit tokens) for each row.

    tokenizer_path is read and compiled on the driver; the tasks get the tables.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(CountingTransducer(Path(tokenizer_path).read_text()))
    key = compiled._jbroadcast.id() if compiled._jbroadcast is not None else 0
    kind = docs.schema[id_col].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = shared(key, compiled)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(x.encode()) if x else 0 for x in texts]
            tokens = fst.counted(texts)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(lean(counts, ("counts", "powers")), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for the whole documents table."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
