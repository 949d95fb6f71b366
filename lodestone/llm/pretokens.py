"""Pre-tokens of byte-level BPE, cut by a deterministic transducer.

The transducer reads classes of code points; its transitions say where a
pre-token begins: before the code point that is read, before the one in front of
it, or both. A stream of texts, each closed by an end mark that leads every
state back to the start, is cut into chunks of equal length. All chunks run in
step from all states, which gives each a state map; the maps compose through a
parallel prefix scan, and each chunk is run once more from the state in which it
really begins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import regex

from lodestone.llm._common import KEPT

# Classes of code points. The letters of the contractions 's 't 'm 'd 're 've 'll are apart.
LETTER, SHORT, R, V, EL, E, NUMBER, OTHER, SPACE, BLANKS, QUOTE, END = range(12)
# States: nothing open; a run of letters, numbers, others; one space; one other blank; several blanks that end in a space or another blank; a quote that opened a token; that and r, v or l.
CLOSED, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
N_CLASSES = N_STATES = 12
#: Marks on transitions.
HERE, BEFORE = 1, 2
CHUNK = 128
FORGET = 16


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each state * N_CLASSES + class."""
    opened = {LETTER: LETTERS, SHORT: LETTERS, R: LETTERS, V: LETTERS, EL: LETTERS, E: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SPACE: ONE_SPACE, BLANKS: ONE_BLANK, QUOTE: QUOTED}
    go: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(N_STATES):
        for kind, to in opened.items():  # any token ends and another begins, unless said otherwise below
            go[state, kind] = (to, HERE)
        go[state, END] = (CLOSED, HERE)
    letters = (LETTER, SHORT, R, V, EL, E)
    for kind in letters:
        go[LETTERS, kind] = (LETTERS, 0)
    go[NUMBERS, NUMBER] = (NUMBERS, 0)
    go[OTHERS, OTHER] = go[OTHERS, QUOTE] = (OTHERS, 0)
    for state, mark in ((ONE_SPACE, 0), (RUN_SPACE, BEFORE)):  # the last space belongs to what follows
        for kind in (*letters, NUMBER, OTHER, QUOTE):
            go[state, kind] = (OTHERS if kind == QUOTE else opened[kind], mark)
    for kind in (*letters, NUMBER, OTHER, QUOTE):  # the last blank stands alone
        go[RUN_BLANK, kind] = (opened[kind], HERE | BEFORE)
    for state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        go[state, SPACE], go[state, BLANKS] = (RUN_SPACE, 0), (RUN_BLANK, 0)
    go[QUOTED, SHORT] = (CLOSED, 0)
    go[QUOTED, R], go[QUOTED, V], go[QUOTED, EL] = (QUOTED_R, 0), (QUOTED_V, 0), (QUOTED_L, 0)
    go[QUOTED, OTHER] = go[QUOTED, QUOTE] = (OTHERS, 0)
    for state, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, EL)):
        for kind in range(N_CLASSES):
            to, _ = go[LETTERS, kind]
            go[state, kind] = (to, BEFORE if to == LETTERS else BEFORE | HERE)
        go[state, last] = (CLOSED, 0)
    table = np.array([go[s, k] for s in range(N_STATES) for k in range(N_CLASSES)], dtype=np.uint8)
    return table[:, 0].copy(), table[:, 1].copy()


NEXT, MARK = _transducer()
_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """The class of each code point; made once a process."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANKS)):
            for m in regex.finditer(pattern, every):
                shift = np.arange(m.start(), m.end())
                table[np.where(shift < 0xD800, shift, shift + 0x800)] = kind
        for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", EL), ("e", E), (" ", SPACE), ("'", QUOTE)):
            for x in letters:
                table[ord(x)] = kind
        _classes = table
    return _classes


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """For each chunk (row) the state that it leads to from each state.

    Most chunks forget the state they began in within a few code points; from
    there on they run once instead of from every state.
    """
    columns = np.ascontiguousarray(classes.T)
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], columns.shape[1], axis=1)
    lanes = np.arange(columns.shape[1])
    out = np.empty_like(state)
    for a in range(0, CHUNK, FORGET):
        for t in range(a, min(a + FORGET, CHUNK)):
            state = NEXT[state * np.uint8(N_CLASSES) + columns[t, lanes]]
        open_ = (state != state[0]).any(axis=0)
        done = ~open_
        one, rest = state[0, done], lanes[done]
        for t in range(min(a + FORGET, CHUNK), CHUNK):
            one = NEXT[one * np.uint8(N_CLASSES) + columns[t, rest]]
        out[:, rest] = one
        lanes, state = lanes[open_], state[:, open_]
        if not len(lanes):
            break
    out[:, lanes] = state
    return np.ascontiguousarray(out.T)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row k becomes the composition of maps 0 to k."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def marks(classes: np.ndarray) -> np.ndarray:
    """True where a token begins; an end mark counts as a token of its own."""
    n = len(classes)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, dtype=np.uint8)
    padded[:n] = classes
    grid = padded.reshape(-1, CHUNK)
    state = np.zeros(len(grid), dtype=np.uint8)
    if len(grid) > 1:
        state[1:] = scan(chunk_maps(grid))[:-1, CLOSED]
    said = np.empty(grid.shape, dtype=np.uint8)
    columns = np.ascontiguousarray(grid.T)
    for t in range(CHUNK):
        place = state * np.uint8(N_CLASSES) + columns[t]
        said[:, t] = MARK[place]
        state = NEXT[place]
    flat = said.reshape(-1)[:n]
    begins = flat & HERE != 0
    begins[:-1] |= flat[1:] & BEFORE != 0
    return begins


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2^64 of an odd number and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = 1 << max(20, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    return _powers[0], _powers[1]


def same_strings(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group the substrings that begin at starts: one substring's number for each group, and each one's group.

    Equal polynomial hashes are compared code point by code point; should two
    different substrings share one, all are told apart by themselves.
    """
    up, down = _power_tables(len(points))
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    stops = np.append(starts[1:], len(points))
    lengths = stops - starts
    hashes = (sums[stops] - sums[starts]) * down[starts] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    twin = first[group]
    shift = np.repeat(starts[twin] - starts, np.minimum(lengths, lengths[twin])) if (lengths == lengths[twin]).all() else None
    if shift is None or not np.array_equal(points[np.arange(len(points)) + shift], points):
        return np.arange(len(starts)), np.arange(len(starts))
    return first, group


#: A blank that surely begins a pre-token: a space behind what is no blank.
SAFE = regex.compile(r"(?<=\S) ")
SEGMENT = 1 << 20


def segments(text: str) -> Iterator[str]:
    """A text in pieces of about SEGMENT code points, cut only where a pre-token begins whatever stands around."""
    at = 0
    while len(text) - at > SEGMENT and (m := SAFE.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def grouped(texts: Iterable[str | None], most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Segments of texts, with the texts' numbers, in groups of about so many code points."""
    group: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for part in segments(text or ""):
            group.append((k, part))
            size += len(part)
            if size >= most_chars:
                yield group
                group, size = [], 0
    if group:
        yield group


@dataclass(frozen=True)
class Cut:
    """Pre-tokens of some segments: the different ones, each one's kind, and where end marks stand among them.

    special: the id of the special string that stands in place of an end mark,
    or -1. last: the number of each segment's last end mark.
    """

    different: list[str]
    kind: np.ndarray
    marked: np.ndarray
    special: np.ndarray
    last: np.ndarray


def cut(parts: list[str], special: regex.Pattern | None, ids: dict[str, int]) -> Cut:
    """Cut segments into pre-tokens; special strings are none, but stand by themselves."""
    pieces: list[str] = []
    after: list[int] = []
    last: list[int] = []
    for text in parts:
        at = 0
        if special is not None:
            for m in special.finditer(text):
                pieces.append(text[at : m.start()])
                after.append(ids[m[0]])
                at = m.end()
        pieces.append(text[at:] if at else text)
        after.append(-1)
        last.append(len(pieces) - 1)
    stream = "\0".join(pieces) + "\0"
    ends = np.cumsum([len(x) + 1 for x in pieces]) - 1
    points = np.frombuffer(stream.encode("utf-32-le"), dtype="<u4")
    classes = code_point_classes()[points]
    classes[ends] = END
    starts = np.flatnonzero(marks(classes))
    kinds, kind = same_strings(points, starts)
    stops = np.append(starts[1:], len(points))
    different = [stream[a:b] for a, b in zip(starts[kinds].tolist(), stops[kinds].tolist(), strict=True)]
    return Cut(different, kind, np.searchsorted(starts, ends), np.array(after, dtype=np.int64), np.array(last))


KEPT["powers"] = _powers.clear
