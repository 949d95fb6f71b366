"""Repeated byte windows by depth-limited radix sort.

Every window of width bytes is ordered by digits, most significant first, and
no further than its width. After each digit only groups that still hold several
documents go on; the groups left after the last digit are the repeated windows.

The first digit is the window's anchor: of all grams of GRAM bytes inside it the
one with the least hash, so that equal windows share anchor and offset, and
neighbouring windows mostly share one anchor. That pass is distributed: records
of all anchors are dealt by the leading bits of the gram's hash, sorted, and
those whose gram stands in several documents come back to their texts. Only
these fetch their bytes: a block is all that the anchor's windows cover. Blocks
meet by gram again, equal ones of a part of the corpus as one. There they are
compared byte by byte: grams first, then whole blocks (the windows of a block
that has its gram for itself are settled at once), then single windows by digits
of eight bytes. Hashes decide only where records meet, never what is equal.

A gram that stands very often sends two records a buffer in the first pass, and
in the second its blocks are dealt by the bytes beside it too.

Documents of one text are resolved beforehand: all but those of the least id
lose what any window covers. Records travel packed, many to a row.

Cases: a null text is empty; texts shorter than a window lose nothing; a null
id comes after all others; rows that repeat an id count as one document, and
each loses its own bytes; long texts are taken in slices that overlap by a
window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import forget, give_back, lean, ordered_ids, sized, written

GRAM = 24
GROUP_BYTES = 400_000
#: Text bytes in a part, and about as many bytes of records for a key of the radix passes.
PART_BYTES = 4_000_000
SLICE_BYTES = 1 << 22
FLUSH = 400_000
LEAST_HOT = 1000
#: Windows that are ordered together.
WINDOWS = 200_000
#: Packed rows that go to a Python worker at once.
BATCH_ROWS = 64
#: Of a place in a group of texts; longer groups are refused.
PLACE_BITS = 24
#: Texts that stand several times, up to which the table of their hashes is broadcast.
MOST_COPIED = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ANCHOR = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("at", "<u4"), ("count", "<u4"), ("known", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("version", "<i8"), ("at", "<u4")])
OCCURRENCE = np.dtype([("block", "<u4"), ("doc", "<i8"), ("version", "<i8"), ("low", "<u4")])
BLOCK = np.dtype([("first", "<i8"), ("last", "<i8"), ("part", "<u4"), ("number", "<u4"), ("lead", "<u4"), ("size", "<u4")])
VERDICT = np.dtype([("number", "<u4"), ("head", "<u4"), ("tail", "<u4"), ("least", "<i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(0, GRAM, 8):
        h = _mixed((h ^ np.ndarray((n,), "<u8", data, k, (1,))) * MIX[0])
    return h


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """Each hash's key below n, by its leading bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def part_of(doc: np.ndarray, version: np.ndarray, parts: int) -> np.ndarray:
    """The part of the corpus that a document belongs to."""
    return dealt(_mixed(_mixed(doc.astype(np.uint64) * MIX[0]) ^ version.astype(np.uint64)), parts)


def anchored_blocks(data: bytes, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over texts put one after the other: each anchor's place, the first and last start of its windows, and its hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < width:
        return none
    if len(data) >> PLACE_BITS:
        raise ValueError("slices are too long")
    hashes = gram_hashes(data)
    bits = np.uint64(PLACE_BITS)  # the same for all texts, so that equal windows choose alike
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    reach, span = width - GRAM + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - width + 1
    least = np.minimum(least[:n], least[reach - span : reach - span + n])
    stops = np.cumsum(sizes)
    inside = np.ones(n + width, dtype=bool)
    for k in range(1, width):  # a window must end in the text it begins in
        inside[np.maximum(stops - k, 0)] = False
    starts = np.flatnonzero(inside[:n])
    if not len(starts):
        return none
    chosen = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    place = chosen[new]
    return place, starts[new], starts[np.append(new[1:], len(starts)) - 1], hashes[place]


def grouped(batches: Iterator[pa.RecordBatch], width: int, slice_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Texts of columns doc, version, text in groups of about GROUP_BYTES, long ones in slices: doc, version, first byte's place, bytes."""
    group: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text")), strict=True):
            data = (text or "").encode()
            for at in range(0, max(1, len(data) - width + 1), slice_bytes):
                group.append((doc, version, at, data[at : at + slice_bytes + width - 1]))
                size += len(group[-1][3])
                if size > GROUP_BYTES:
                    yield _taken(group)
                    group, size = [], 0
    if group:
        yield _taken(group)


def _taken(group: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    return (*(np.array([x[k] for x in group], dtype=np.int64) for k in range(3)), [x[3] for x in group])


def packed(key: np.ndarray, records: np.ndarray, names: tuple[str, str] = ("key", "data")) -> pa.RecordBatch:
    """One row a key with all its records."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    offsets = (np.append(begins, len(key)) * records.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])
    return pa.record_batch([pa.array(key[begins].astype(np.int32)), data], list(names))


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """From rows (key, data) in order of key: the data of each key."""
    held, now = [], None
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(data)
    if held:
        yield held


def _gram_groups(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records by gram, where each gram begins, and which grams stand in several documents."""
    records = records[np.argsort(records["gram"], kind="stable")]
    gram, doc = records["gram"], records["doc"]
    begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return records, begins, np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins)


def _places(records: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records of shared grams, by part."""
    places = np.empty(len(records), dtype=PLACE)
    for c in PLACE.names:
        places[c] = records[c]
    return packed(part_of(places["doc"], places["version"], parts), places, ("part", "data"))


DEALT = "key int, kind int, part int, data binary"


def _dealt_rows(records: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of one buffer: anchors by key (kind 1); and those whose gram stands in several documents of the buffer by part (kind 0).

    Of the latter only two go by key, with the least and the greatest document
    and the number of all: a gram that stands everywhere sends two records a
    buffer.
    """
    records, begins, several = _gram_groups(records)
    sizes = np.diff(np.append(begins, len(records)))
    met = np.repeat(several, sizes)
    own, first, last = records[met], [], []
    if len(own):
        order = np.lexsort((own["doc"], own["gram"]))
        own = own[order]
        heads = np.flatnonzero(np.append(True, own["gram"][1:] != own["gram"][:-1]))
        tails = np.append(heads[1:], len(own)) - 1
        first, last = own[heads].copy(), own[tails].copy()
        first["count"], last["count"] = tails - heads, 1
        first["known"] = last["known"] = 1
        part, data = _places(own, parts).columns
        yield pa.record_batch([part, pa.array(np.zeros(len(part), np.int32)), part, data], ["key", "kind", "part", "data"])
    alone = np.concatenate([x for x in (records[~met], first, last) if len(x)])
    batch = packed(dealt(alone["gram"], parts), alone)
    yield pa.record_batch([batch.column(0), pa.array(np.ones(len(batch), np.int32)), pa.nulls(len(batch), pa.int32()), batch.column(1)], ["key", "kind", "part", "data"])


def anchor_rows(batches: Iterator[pa.RecordBatch], parts: int, width: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """All anchors of the texts as DEALT rows."""
    held: list[np.ndarray] = []
    size = 0
    for doc, version, base, texts in grouped(batches, width, slice_bytes):
        sizes = np.array([len(x) for x in texts])
        place, _, _, gram = anchored_blocks(b"".join(texts), sizes, width)
        stops = np.cumsum(sizes)
        owner = np.searchsorted(stops, place, side="right")
        records = np.zeros(len(place), dtype=ANCHOR)
        records["gram"], records["doc"], records["version"], records["count"] = gram, doc[owner], version[owner], 1
        records["at"] = place - (stops - sizes)[owner] + base[owner]
        held.append(records)
        size += len(records)
        if size > FLUSH:
            yield from _dealt_rows(np.concatenate(held), parts)
            held, size = [], 0
    if size:
        yield from _dealt_rows(np.concatenate(held), parts)


#: In place of a part: the grams that stand more often than a limit.
HOT = -1


def shared_anchors(batches: Iterator[pa.RecordBatch], parts: int, limit: int) -> Iterator[pa.RecordBatch]:
    """From DEALT rows in order of key and kind: the anchors whose gram stands in several documents, by part; and grams that stand more than limit times."""
    held: list[bytes] = []
    now = None

    def solved() -> Iterator[pa.RecordBatch]:
        records, begins, several = _gram_groups(np.frombuffer(b"".join(held), dtype=ANCHOR))
        total = np.add.reduceat(records["count"].astype(np.int64), begins)
        hot = records["gram"][begins[several & (total > limit)]]
        if len(hot):
            yield pa.record_batch([pa.array([HOT], pa.int32()), pa.array([hot.tobytes()], pa.binary())], ["part", "data"])
        kept = np.repeat(several, np.diff(np.append(begins, len(records)))) & (records["known"] == 0)
        yield _places(records[kept], parts)

    for batch in batches:
        for key, kind, part, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held and (kind == 0 or key != now):
                yield from solved()
                held = []
            if kind == 0:
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])
            else:
                now = key
                held.append(data)
    if held:
        yield from solved()


EXTRACTED = "kind int, key int, data binary"


def split_hot(place: np.ndarray, low: np.ndarray, stop: np.ndarray, hot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of grams that are not hot as they are (side 0), others cut in two: which block each was, first byte, end, and side.

    A window has as many bytes beside its gram as it is wider. So it has half of
    them behind the gram (side 1) or else in front of it (side 2), and these
    bytes are a further digit that deals out a hot gram's blocks.
    """
    rest = width - GRAM
    half = (rest + 1) // 2
    at = np.arange(len(place))
    cut = place - (rest - half)  # windows that begin here or later have half of the bytes behind their gram
    last = stop - width
    sides = [(at[~hot], low[~hot], stop[~hot], 0)]
    behind, before = hot & (last >= cut), hot & (low < cut)
    sides.append((at[behind], np.maximum(low, cut)[behind], stop[behind], 1))
    sides.append((at[before], low[before], (np.minimum(last, cut - 1) + width)[before], 2))
    return (*(np.concatenate([x[k] for x in sides]) for k in range(3)), np.concatenate([np.full(len(x[0]), x[3]) for x in sides]))


def extracted(texts: pa.Table, found: pa.Table, keys: int, width: int, slice_bytes: int, hot: np.ndarray) -> pa.Table:
    """Of one part: its occurrences of blocks (kind 0, by part) and its distinct blocks with their bytes (kind 1, by key).

    hot: grams, in order, whose blocks are dealt by a further digit.
    """
    rows: list[tuple[int, int, bytes]] = []
    if len(texts) and len(found):
        part, half = texts["part"][0].as_py(), (width - GRAM + 1) // 2
        places = np.frombuffer(b"".join(found["data"].to_pylist()), dtype=PLACE)
        order = np.lexsort((places["at"], places["version"], places["doc"]))
        places = places[order]
        new = np.flatnonzero(np.append(True, (places["doc"][1:] != places["doc"][:-1]) | (places["version"][1:] != places["version"][:-1])))
        of = {(int(places["doc"][a]), int(places["version"][a])): places["at"][a:b] for a, b in zip(new, np.append(new[1:], len(places)), strict=True)}
        numbers: dict[tuple[bytes, int], int] = {}
        hashes: list[int] = []
        first: list[int] = []
        last: list[int] = []
        occurrences: list[np.ndarray] = []
        for doc, version, base, data in grouped(texts.to_batches(), width, slice_bytes):
            kept = [k for k, key in enumerate(zip(doc.tolist(), version.tolist(), strict=True)) if key in of]
            if not kept:
                continue
            doc, version, base, data = doc[kept], version[kept], base[kept], [data[k] for k in kept]
            sizes = np.array([len(x) for x in data])
            whole = b"".join(data)
            place, low, high, gram = anchored_blocks(whole, sizes, width)
            stops = np.cumsum(sizes)
            owner = np.searchsorted(stops, place, side="right")
            shift = (base - (stops - sizes))[owner]
            bounds = np.searchsorted(owner, np.arange(len(data) + 1))
            there = np.zeros(len(place), dtype=bool)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                there[a:b] = np.isin(place[a:b] + shift[a:b], of[int(doc[k]), int(version[k])])
            place, low, stop, gram, owner, shift = (x[there] for x in (place, low, high + width, gram, owner, shift))
            which, low, stop, side = split_hot(place, low, stop, np.isin(gram, hot), width)
            place, gram, owner, shift = place[which], gram[which], owner[which], shift[which]
            block = np.empty(len(place), dtype=np.int64)
            for k, (p, a, b, d, beside) in enumerate(zip(place.tolist(), low.tolist(), stop.tolist(), doc[owner].tolist(), side.tolist(), strict=True)):
                n = numbers.setdefault((whole[a:b], p - a), len(hashes))
                block[k] = n
                if n == len(hashes):
                    further = (b"", whole[p + GRAM : p + GRAM + half], whole[p - half : p])[beside]
                    hashes.append(int(gram[k]) ^ xxhash.xxh3_64_intdigest(further, beside) if beside else int(gram[k]))
                    first.append(d)
                    last.append(d)
                elif d < first[n]:
                    first[n] = d
                elif d > last[n]:
                    last[n] = d
            own = np.empty(len(place), dtype=OCCURRENCE)
            own["block"], own["doc"], own["version"], own["low"] = block, doc[owner], version[owner], low + shift
            occurrences.append(own)
        if hashes:
            rows.append((0, part, np.concatenate(occurrences).tobytes()))
            records = np.empty(len(hashes), dtype=BLOCK)
            records["first"], records["last"], records["part"], records["number"] = first, last, part, np.arange(len(hashes))
            blocks = list(numbers)
            records["lead"], records["size"] = [x[1] for x in blocks], [len(x[0]) for x in blocks]
            key = dealt(np.array(hashes, dtype=np.uint64), keys)
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            for a, b in zip(new, np.append(new[1:], len(key)), strict=True):
                own = order[a:b]
                rows.append((1, int(key[own[0]]), np.uint32(len(own)).tobytes() + records[own].tobytes() + b"".join(blocks[k][0] for k in own)))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    give_back()
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["kind", "key", "data"])


def window_digits(data: np.ndarray, start: np.ndarray, lead: np.ndarray, width: int) -> np.ndarray:
    """What windows hold beside the gram at lead, as digits of eight bytes, most significant first."""
    rest = width - GRAM
    padded = -(-rest // 8) * 8
    columns = np.zeros((rest + 1, padded), dtype=np.int64)
    for k in range(rest + 1):
        columns[k, :rest] = [*range(k), *range(k + GRAM, width)]
    out = np.empty((len(start), padded // 8), dtype=np.uint64)
    for a in range(0, len(start), 50_000):
        part = slice(a, a + 50_000)
        text = data[start[part, None] + columns[lead[part]]]
        text[:, rest:] = 0
        out[part] = text.view(">u8")
    return out


def equal_windows(group: np.ndarray, digits: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that other documents hold too, and the least document of each; group: the first digit, first and last: least and greatest document of each row."""
    live, group = np.arange(len(group)), group.copy()
    least = first.copy()
    for k in range(-1, digits.shape[1]):
        digit = digits[live, k] if k >= 0 else np.zeros(len(live), dtype=np.uint64)
        order = np.lexsort((digit, group[live]))
        live, digit = live[order], digit[order]
        if not len(live):
            break
        own = group[live]
        begins = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])))
        sizes = np.diff(np.append(begins, len(live)))
        low = np.minimum.reduceat(first[live], begins)
        several = low < np.maximum.reduceat(last[live], begins)
        group[live] = np.repeat(np.arange(len(begins)), sizes)
        least[live] = np.repeat(low, sizes)
        live = live[np.repeat(several, sizes)]
    return live, least[live]


def mixed_runs(blocks: list[bytes], own: np.ndarray, gram: np.ndarray, lead: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges (block, head, tail, least document) of some blocks, own, whose windows stand in several documents; all blocks of their grams are among them.

    Windows at different places before their gram never meet, so that where they
    are very many they go by place, some places at a time.
    """
    counts = size[own] - width + 1
    begin = np.zeros(len(blocks), np.int64)
    begin[own] = np.cumsum(size[own]) - size[own]
    data = np.frombuffer(b"".join(blocks[k] for k in own), dtype=np.uint8)
    places = width - GRAM + 1
    step = max(1, places * WINDOWS // max(1, int(counts.sum())))
    for low in range(0, places, step):
        # A window at place at has its gram at lead - at, which is to lie in [low, low + step).
        head = np.maximum(lead[own] - (low + step) + 1, 0)
        stop = np.minimum(lead[own] - low + 1, counts)
        n = np.maximum(stop - head, 0)
        block = np.repeat(own, n)
        at = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head, n)
        offset = lead[block] - at
        digits = window_digits(data, begin[block] + at, offset, width)
        live, least = equal_windows(gram[block] * places + offset, digits, first[block], last[block])
        if len(live):
            order = np.lexsort((at[live], block[live]))
            b, a, least = block[live][order], at[live][order], least[order]
            new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1] + 1) | (least[1:] != least[:-1]))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(b)) - 1
            yield b[head], a[head], a[tail] + width, least[head]


def judged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """From blocks by key: by part, the ranges of its blocks that stand in several documents, each with the least of these."""
    for rows in by_key(batches):
        records, texts = [], []
        for data in rows:
            n = int(np.frombuffer(data, "<u4", 1)[0])
            own = np.frombuffer(data, BLOCK, n, 4)
            stops = (4 + n * BLOCK.itemsize + np.cumsum(own["size"], dtype=np.int64)).tolist()
            texts += [data[a:b] for a, b in zip([4 + n * BLOCK.itemsize, *stops], stops, strict=False)]
            records.append(own)
        every = np.concatenate(records)
        distinct: dict[tuple[bytes, int], int] = {}
        of = np.array([distinct.setdefault((x, lead), len(distinct)) for x, lead in zip(texts, every["lead"].tolist(), strict=True)])
        order = np.argsort(of, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        first, last = np.minimum.reduceat(every["first"][order], begins), np.maximum.reduceat(every["last"][order], begins)
        blocks, lead = [x for x, _ in distinct], np.array([x for _, x in distinct], dtype=np.int64)
        size = np.array([len(x) for x in blocks], dtype=np.int64)
        grams: dict[bytes, int] = {}
        gram = np.array([grams.setdefault(x[k : k + GRAM], len(grams)) for x, k in distinct])
        alone = np.bincount(gram)[gram] == 1
        whole = np.flatnonzero(alone & (first < last))
        runs = [(whole, np.zeros(len(whole), np.int64), size[whole], first[whole])]
        mixed = np.flatnonzero(~alone)
        mixed = mixed[np.argsort(gram[mixed], kind="stable")]
        counts = np.cumsum(size[mixed] - width + 1)
        new = np.flatnonzero(np.append(True, np.diff(gram[mixed]) != 0)) if len(mixed) else mixed
        turn = (counts[new] - (size[mixed[new]] - width + 1)) // WINDOWS if len(mixed) else mixed
        cuts = [*new[np.flatnonzero(np.append(True, np.diff(turn) != 0))].tolist(), len(mixed)] if len(mixed) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            runs += mixed_runs(blocks, mixed[x:y], gram, lead, size, first, last, width)
        b, head, tail, least = (np.concatenate([x[k] for x in runs]) for k in range(4))
        order = np.argsort(b, kind="stable")
        b, head, tail, least = b[order], head[order], tail[order], least[order]
        low, high = np.searchsorted(b, of), np.searchsorted(b, of, side="right")
        row = np.repeat(np.arange(len(of)), high - low)
        run = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
        useful = least[run] < every["last"][row]
        row, run = row[useful], run[useful]
        out = np.empty(len(row), dtype=VERDICT)
        out["number"], out["head"], out["tail"], out["least"] = every["number"][row], head[run], tail[run], least[run]
        yield packed(every["part"][row].astype(np.int64), out, ("part", "data"))
        del rows, records, texts, every, distinct, blocks, grams, out
        give_back()


REMOVED = "doc long, version long, spans binary"


def merged(found: pa.Table, verdicts: pa.Table) -> pa.Table:
    """Of one part: the maximal byte runs that each document loses, as pairs of 32-bit places in order."""
    rows: list[tuple[int, int, bytes]] = []
    if len(found) and len(verdicts):
        own = np.frombuffer(b"".join(found["data"].to_pylist()), dtype=OCCURRENCE)
        told = np.frombuffer(b"".join(verdicts["data"].to_pylist()), dtype=VERDICT)
        told = told[np.argsort(told["number"], kind="stable")]
        low, high = np.searchsorted(told["number"], own["block"]), np.searchsorted(told["number"], own["block"], side="right")
        row = np.repeat(np.arange(len(own)), high - low)
        run = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
        lost = told["least"][run] < own["doc"][row]
        row, run = row[lost], run[lost]
        doc, version = own["doc"][row], own["version"][row]
        head, tail = own["low"][row].astype(np.int64) + told["head"][run], own["low"][row].astype(np.int64) + told["tail"][run]
        order = np.lexsort((head, version, doc))
        doc, version, head, tail = doc[order], version[order], head[order], tail[order]
        if len(doc):
            other = np.append(False, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))
            number = np.cumsum(other)
            reached = np.maximum.accumulate(tail + (number << 32)) - (number << 32)
            new = np.flatnonzero(np.append(True, other[1:] | (head[1:] > reached[:-1])))
            spans = np.stack([head[new], reached[np.append(new[1:], len(doc)) - 1]], axis=1).astype("<i4")
            bounds = np.flatnonzero(np.append(True, np.diff(number[new]) != 0))
            rows = [(int(doc[new[a]]), int(version[new[a]]), spans[a:b].tobytes()) for a, b in zip(bounds, np.append(bounds[1:], len(new)), strict=True)]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["doc", "version", "spans"])


def removed_spans(units: DataFrame, parts: int, width: int, slice_bytes: int, hot_limit: int) -> DataFrame:
    """Write and return (doc, version, spans) from (part, doc, version, text), no text of which stands in two documents.

    hot_limit: grams that stand more often are hot.
    """
    texts = units.select("doc", "version", "text")
    spark = units.sparkSession
    anchors = texts.mapInArrow(lean(lambda it: anchor_rows(it, parts, width, slice_bytes)), DEALT)
    gathered = anchors.repartition(parts, "key").sortWithinPartitions("key", "kind")
    shared = written(gathered.mapInArrow(lean(lambda it: shared_anchors(it, parts, hot_limit)), "part int, data binary"), "shared", batch=BATCH_ROWS)
    often = [np.frombuffer(r["data"], "<u8") for r in shared.filter(F.col("part") == HOT).toLocalIterator()]
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, "<u8"), *often])))
    both = units.groupBy("part").cogroup(shared.filter(F.col("part") != HOT).groupBy("part"))
    blocks = written(both.applyInArrow(lambda a, b: extracted(a, b, parts, width, slice_bytes, hot.value), EXTRACTED), "blocks", "zstd", BATCH_ROWS * 8)
    forget(shared)
    hot.destroy()
    gathered = blocks.filter("kind = 1").select("key", "data").repartition(parts, "key").sortWithinPartitions("key")
    verdicts = written(gathered.mapInArrow(lean(lambda it: judged(it, width)), "part int, data binary"), "verdicts", "zstd", BATCH_ROWS)
    own = blocks.filter("kind = 0").select(F.col("key").alias("part"), "data")
    out = written(own.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(merged, REMOVED), "removed", batch=BATCH_ROWS)
    for x in (blocks, verdicts):
        forget(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE_BYTES, least_hot: int = LEAST_HOT) -> DataFrame:
    """Remove each byte that is covered by a window which also starts in a document of a smaller id.

    Returns id_col, n_bytes, n_removed, n_spans and kept, the bytes that are
    left. part_bytes: text in a part, which one task holds with its records.
    least_hot: grams that stand more often, and in more than a millionth of all
    places, are dealt by further bytes; there are fewer than 80,000 of them.
    """
    if width < GRAM:
        raise ValueError(f"windows have at least {GRAM} bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, _ = ordered_ids(docs, id_col)
    pairs = docs.select(doc.alias("doc"), text.alias("text"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // part_bytes))
    several = not pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    version = F.xxhash64("text") if several else F.lit(0).cast("long")  # tells rows of one id apart
    keyed = pairs.select("doc", version.alias("version"), "text", F.sha2("text", 256).alias("same"))
    copied = written(keyed.groupBy("same").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copied")
    whole = keyed.join(sized(copied, MOST_COPIED), "same", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = part_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), parts)
            yield pa.record_batch([pa.array(part.astype(np.int32)), *batch.columns], ["part", "doc", "version", "text"])

    own = whole.filter(~F.col("copy") & (F.octet_length("text") >= width)).select("doc", "version", "text")
    units = written(own.mapInArrow(lean(with_part), "part int, doc long, version long, text string"), "units", "zstd")
    removed = removed_spans(units, parts, width, slice_bytes, max(least_hot, size // 1_000_000))
    forget(units)
    kind = docs.schema[id_col].dataType.simpleString()

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lost, runs = [], [], []
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            for data, spans, copy in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if copy:
                    own = [(0, len(data))] if len(data) >= width else []
                else:
                    own = np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist()
                at, rest = 0, []
                for a, b in own:
                    rest.append(data[at:a])
                    at = b
                kept.append(b"".join(rest) + data[at:])
                lost.append(len(data) - len(kept[-1]))
                runs.append(len(own))
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(lost, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    spread = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), text.alias("text"))
    spread = spread.select("*", version.alias("version"), F.sha2("text", 256).alias("same")).join(sized(copied, MOST_COPIED), "same", "left")
    spread = spread.join(removed, ["doc", "version"], "left").select("id", "text", "spans", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy"))
    return spread.mapInArrow(lean(left), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, windows of 50 bytes."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS k FROM (SELECT *, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT doc_id, s FROM w JOIN f USING (k) WHERE first < doc_id),
m AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM g),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, run),
left_over AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q, b - a AS lost FROM runs
  UNION ALL SELECT doc_id, coalesce(max(b), 0), max(n), 0 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, max(n) AS n_bytes, CAST(sum(lost) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
       sha256(unhex(string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p))) AS kept_sha256
FROM left_over JOIN d USING (doc_id) GROUP BY doc_id
"""
