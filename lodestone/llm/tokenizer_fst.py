"""Ids of byte-level BPE: pre-tokens by the transducer, their paths kept once they are met.

Paths are made by merging by rank, which the file's merges are checked to
follow, else by the library, and kept up to a bound.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from lodestone.llm._common import KEPT
from lodestone.llm.pretokens import byte_letters, cut, grouped


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class CompiledTokenizer:
    """Ids of whole texts, as the tokenizer file's library gives them without added tokens."""

    def __init__(self, definition: str, most_paths: int = 200_000) -> None:
        """definition: the file's JSON text. most_paths: pre-tokens kept; the memory's bound."""
        spec = json.loads(definition)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE with its usual pattern, no normalizer and no prefix space is compiled")
        added = spec.get("added_tokens") or []
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip, normalize or stand alone are not compiled")
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {x["content"]: x["id"] for x in added}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        to_byte = byte_letters()
        tokens = {x: k for x, k in spec["model"]["vocab"].items() if x not in self.added}
        ranks = {bytes(map(to_byte.__getitem__, x)): k for x, k in tokens.items()}
        merged = ("".join(x) if isinstance(x, list) else x.replace(" ", "") for x in spec["model"]["merges"])
        order = [tokens[x] for x in merged]
        # Merging the pair of least id is the file's merging only if ids follow its merges.
        self.core = CoreBPE(ranks, {}, ".") if order == sorted(order) and len(ranks) == len(tokens) else None
        # Tokens that the file's merges never make: paths through them are left to the library.
        whole = [(x.decode(), k) for x, k in ranks.items() if len(x) > 1 and _valid(x)]
        self.unmade = {k for (_, k), y in zip(whole, self.library.encode_batch_fast([x for x, _ in whole], add_special_tokens=False), strict=True) if y.ids != [k]}
        self.paths: dict[str, bytes] = {}
        self.most_paths = most_paths

    def emitted(self, tokens: list[str]) -> list[bytes]:
        """Little-endian ids of each pre-token."""
        paths = self.paths
        out = list(map(paths.get, tokens))
        if None not in out:
            return out
        new = {x for x, y in zip(tokens, out, strict=True) if y is None}
        if len(paths) + len(new) > self.most_paths:
            recent = {x: y for x, y in zip(tokens, out, strict=True) if y is not None}  # mostly the frequent ones
            paths.clear()
            paths.update(recent)
        if self.core is not None:
            hard = []
            for x in new:
                ids = self.core.encode_single_piece(x.encode())
                if self.unmade.isdisjoint(ids):
                    paths[x] = array("I", ids).tobytes()
                else:
                    hard.append(x)
            new = hard
        new = list(new)
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for x, y in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                paths[x] = np.array(y.ids, dtype="<u4").tobytes()
        return list(map(paths.__getitem__, tokens))

    def encoded(self, texts: Iterable[str | None], most_chars: int = 400_000) -> Iterator[np.ndarray]:
        """The ids of each text; special strings count as their own."""
        held: list[np.ndarray] = []
        now = 0
        for group in grouped(texts, most_chars):
            for (k, _), ids in zip(group, self._run([x for _, x in group]), strict=True):
                if k != now:
                    yield held[0] if len(held) == 1 else np.concatenate(held)
                    held, now = [], k
                held.append(ids)
        if held:
            yield held[0] if len(held) == 1 else np.concatenate(held)

    def _run(self, parts: list[str]) -> list[np.ndarray]:
        found = cut(parts, self.special, self.added)
        ids = self.emitted(found.different)
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        emitted = sizes[found.kind]
        real = found.special >= 0
        emitted[found.marked] = real  # end marks among the pre-tokens emit the special id, if one follows
        total = np.cumsum(emitted)
        source = np.concatenate([np.frombuffer(b"".join(ids), dtype="<u4"), found.special[real].astype("<u4")])
        place = (np.cumsum(sizes) - sizes)[found.kind]
        place[found.marked[real]] = sizes.sum() + np.arange(np.count_nonzero(real))
        flat = source[np.repeat(place - (total - emitted), emitted) + np.arange(total[-1])]
        return np.split(flat, total[found.marked[found.last]][:-1])


_compiled: dict[int, CompiledTokenizer] = {}


def compiled(definition: str, make: Callable[[str], CompiledTokenizer] = CompiledTokenizer) -> CompiledTokenizer:
    """One compiled tokenizer for each definition and process."""
    key = hash(definition)
    if key not in _compiled:
        _compiled[key] = make(definition)
    return _compiled[key]


KEPT["ids"] = _compiled.clear
