"""Language-model scoring with a probabilistic suffix tree.

A text becomes its tokens' bytes, lower-cased in A-Z, with a space between
tokens and a line feed as its end. Contexts of up to depth bytes are counted
over all training texts. A context is retained if its next symbols diverge from
those of its parent (the context without its first byte) by a test on the
Kullback-Leibler divergence, or if a longer retained context needs it. The
distribution of a retained context is smoothed by absolute discounting towards
its parent's, the root's towards the uniform one. A symbol is scored from the
longest retained suffix of what precedes it, across tokens. The retained
contexts grow with the corpus; they stay in tables, which the distinct windows
(a symbol with the depth bytes before it) of all texts join level by level.

Beside it stands an add-one unigram score over whole tokens. Counts of tokens
and windows cover the whole corpus. The most frequent of each, a bounded number,
go to all tasks; the values of all others reach their texts through a shuffle.

Cases: a null text is empty and has its end alone; rows that repeat an id are
scored one by one; null ids count as the empty text in the split; with no
training rows every distribution is uniform; texts are taken whole, the longest
in pieces; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import crc_mod, forget, lean, pieces, self_cleaning, written

END = b"\n"
#: Stands for the end of a text among tokens; no token holds a blank.
END_TOKEN = "\n"
GROUP_BYTES = 1_000_000
EMPTY = np.uint64((1 << 64) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(texts: list[str | None], depth: int) -> Iterator[tuple[int, bytes, bytes, list[bytes], bool]]:
    """Pieces of texts: text number, the depth bytes before, the symbols, the tokens, and whether the text ends here."""
    for k, text in enumerate(texts):
        context, begun = END * depth, False
        for words, last in pieces(text):
            symbols = (b" " if begun and words else b"") + b" ".join(words) + (END if last else b"")
            if symbols:
                yield k, context, symbols, words, last
            context, begun = (context + symbols)[-depth:], begun or bool(words)


def grouped(texts: list[str | None], depth: int) -> Iterator[list[tuple[int, bytes, bytes, list[bytes], bool]]]:
    """Runs in groups of about GROUP_BYTES."""
    group: list = []
    size = 0
    for run in runs(texts, depth):
        group.append(run)
        size += len(run[2])
        if size > GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def run_windows(contexts: list[bytes], symbols: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol a number that holds it in the lowest byte and the depth bytes before it above, and where each run begins."""
    sizes = np.array([len(x) for x in symbols])
    stream = bytes(8) + b"".join(x for pair in zip(contexts, symbols, strict=True) for x in pair)
    every = np.ndarray((len(stream) - 8,), ">u8", stream, 1, (1,))
    begins = np.cumsum(sizes + depth) - sizes - depth
    keep = np.ones(len(every), dtype=bool)
    for k in range(depth):
        keep[begins + k] = False
    return every[keep].astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1), np.cumsum(sizes) - sizes


COUNTS = "token string, gram long, n long, uses long"


def corpus_counts(docs: DataFrame, text_col: str, held_col: str, depth: int) -> DataFrame:
    """Write and return (token, gram, n, uses): each task's counts of tokens and of windows; one of the two is null.

    n counts training texts, uses of windows counts all.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def word_rows() -> pa.RecordBatch:
            n = np.fromiter(words.values(), np.int64, len(words))
            out = pa.record_batch([pa.array([x.decode() for x in words], pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n), pa.array(n)], ["token", "gram", "n", "uses"])
            words.clear()
            return out

        def gram_rows(held: bool) -> pa.RecordBatch:
            keys, uses = _merged(grams[held])
            grams[held].clear()
            return pa.record_batch([pa.nulls(len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(np.zeros_like(uses) if held else uses), pa.array(uses)], ["token", "gram", "n", "uses"])

        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for held in (False, True):
                for group in grouped([x for x, y in zip(texts, flags, strict=True) if y == held], depth):
                    found = grams[held]
                    found.append(np.unique(run_windows([x[1] for x in group], [x[2] for x in group], depth)[0], return_counts=True))
                    if sum(len(x) for x, _ in found) > 2_500_000:
                        found[:] = [_merged(found)]
                        if len(found[0][0]) > 1_500_000:  # pre-aggregated rows leave before memory fills
                            yield gram_rows(held)
                    if not held:
                        for x in group:
                            words.update(x[3])
                        words[END] += sum(x[4] for x in group)
                        if len(words) > 700_000:
                            yield word_rows()
        if words:
            yield word_rows()
        for held in (False, True):
            if grams[held]:
                yield gram_rows(held)

    return written(docs.select(text_col, held_col).mapInArrow(lean(counted), COUNTS), "counts")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([x for x, _ in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([x for _, x in parts])[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _mask(k: int) -> np.uint64:
    """Of the symbol and k bytes of context."""
    return np.uint64((1 << 8 * (k + 1)) - 1)


class Level:
    """All contexts of one length: grams (context and symbol) in order, their counts, and what is made of them."""

    def __init__(self, grams: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(grams)
        first = np.flatnonzero(np.append(True, np.diff(grams[order]) != 0)) if len(grams) else np.zeros(0, np.int64)
        self.grams = grams[order][first]
        self.n = np.add.reduceat(n[order], first) if len(first) else n[:0]
        context = self.grams >> np.uint64(8)
        self.begins = np.flatnonzero(np.append(True, np.diff(context) != 0)) if len(first) else first
        self.contexts = context[self.begins]
        self.sizes = np.diff(np.append(self.begins, len(self.grams)))
        self.totals = self.sums(self.n)
        self.kept = np.zeros(len(self.contexts), dtype=bool)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each context's symbols."""
        return np.add.reduceat(values, self.begins) if len(self.begins) else values[:0]

    def shorter(self, k: int) -> Level:
        """Contexts of k bytes from these, which have one more."""
        return Level(self.grams & _mask(k), self.n)

    def test(self, parent: Level, k: int, least: int, divergence: float, evidence: float) -> None:
        """Retain contexts of k bytes whose symbols diverge from those of the parent."""
        p = (parent.n / np.repeat(parent.totals, parent.sizes))[np.searchsorted(parent.grams, self.grams & _mask(k - 1))]
        gain = self.sums(self.n * np.log(self.n / np.repeat(self.totals, self.sizes) / p))
        self.kept |= (self.totals >= least) & (gain >= divergence * self.totals) & (gain >= evidence * self.sizes)

    def keep(self, contexts: np.ndarray) -> None:
        """Retain these, which longer ones need."""
        self.kept |= np.isin(self.contexts, contexts)

    def step(self, windows: np.ndarray, k: int, p: np.ndarray, inside: np.ndarray, discount: float) -> np.ndarray:
        """p after this level; inside: windows whose contexts were retained so far, which this level narrows."""
        if not len(self.grams):
            inside &= False
            return p
        share = (self.n - np.minimum(discount, self.n / 2)) / np.repeat(self.totals, self.sizes)
        rest = 1 - self.sums(share)
        gram = windows & _mask(k)
        at = np.minimum(np.searchsorted(self.contexts, gram >> np.uint64(8)), len(self.contexts) - 1)
        inside &= (self.contexts[at] == gram >> np.uint64(8)) & self.kept[at]
        own = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.where(inside, np.where(self.grams[own] == gram, share[own], 0.0) + rest[at] * p, p)


#: Levels that are learned in the driver. Their size is bounded by the alphabet: LOW bytes of context and a symbol.
LOW = 2
SUBTREE_ROWS = 1_000_000


def in_subtrees(windows: DataFrame, solve, shape: str) -> DataFrame:
    """Apply solve(gram, n, uses) to windows whose last LOW bytes of context are the same: whole subtrees, some at a time."""
    key = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            of = batch.column(3).to_numpy()
            new = np.flatnonzero(of[1:] != of[:-1]) + 1
            if size and len(of) and of[0] != held[-1].column(3)[-1].as_py():
                new = np.append(0, new)
            if size + len(of) > SUBTREE_ROWS and len(new):
                cut = int(new[-1])
                yield from solve(*_columns([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield from solve(*_columns(held))

    keyed = windows.select("gram", "n", "uses", key.cast("int").alias("subtree"))
    return keyed.repartition("subtree").sortWithinPartitions("subtree").mapInArrow(lean(solved), shape)


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([x.column(k).to_numpy() for x in batches]) for k in range(3)]


def learned(gram: np.ndarray, n: np.ndarray, low: Level, depth: int, least: int, divergence: float, evidence: float) -> list[Level]:
    """Levels LOW + 1 to depth of some subtrees, with the contexts that the tests retain; low: the level below."""
    levels = [Level(gram[n > 0].astype(np.uint64), n[n > 0])]
    for k in range(depth - 1, LOW, -1):
        levels.append(levels[-1].shorter(k))
    levels.reverse()
    for k in range(depth, LOW, -1):
        level = levels[k - LOW - 1]
        level.test(levels[k - LOW - 2] if k > LOW + 1 else low, k, least, divergence, evidence)
        if k < depth:
            above = levels[k - LOW]
            level.keep(above.contexts[above.kept] & _mask(k - 1))
    return levels


def window_logs(windows: DataFrame, depth: int, least_count: float, divergence: float, evidence: float, discount: float) -> DataFrame:
    """Learn the tree from windows (gram, n, uses) and write (window, uses, log): log10 of each one's symbol after its longest retained context.

    n is a window's training count, zero if it is only scored. least_count:
    contexts seen less often are not tested; a count and no share of the corpus,
    so that the tree grows with it. divergence: least divergence from the
    parent, in nats. evidence: least divergence times the context's count for
    each of its symbols. Contexts of up to LOW bytes are learned in the driver;
    the longer ones below each of them are a subtree, learned where its windows
    meet, twice: first to tell which short contexts they need.
    """
    spark, least = windows.sparkSession, max(2, int(least_count))
    short = F.col("gram").bitwiseAND(F.lit(int(_mask(LOW))))
    rows = windows.filter("n > 0").groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    levels = [Level(rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy())]
    for k in range(LOW - 1, -1, -1):
        levels.append(levels[-1].shorter(k))
    levels.reverse()
    below = spark.sparkContext.broadcast(levels[LOW])

    def needed(gram, n, uses) -> Iterator[pa.RecordBatch]:
        level = learned(gram, n, below.value, depth, least, divergence, evidence)[0]
        yield pa.record_batch([pa.array(np.unique(level.contexts[level.kept] & _mask(LOW - 1)).astype(np.int64))], ["context"])

    wanted = [r[0] for r in in_subtrees(windows, needed, "context long").distinct().collect()] if depth > LOW else []  # at most 256 to the power of LOW
    need = np.array(wanted, dtype=np.uint64)
    for k in range(LOW, -1, -1):
        if k:
            levels[k].test(levels[k - 1], k, least, divergence, evidence)
        levels[k].keep(need)
        need = levels[k].contexts[levels[k].kept] & (_mask(k - 2) if k > 1 else np.uint64(0))
    levels[0].kept[:] = True
    lower = spark.sparkContext.broadcast(levels)

    def logs(gram, n, uses) -> Iterator[pa.RecordBatch]:
        window, low = gram.astype(np.uint64), lower.value
        every = [*low, *learned(gram, n, low[LOW], depth, least, divergence, evidence)]
        p, inside = np.full(len(window), 1 / 256), np.ones(len(window), dtype=bool)
        for k, level in enumerate(every[: depth + 1]):
            p = level.step(window, k, p, inside, discount)
        yield pa.record_batch([pa.array(gram), pa.array(uses), pa.array(np.log10(p))], ["window", "uses", "log"])

    out = written(in_subtrees(windows, logs, "window long, uses long, log double"), "logs")
    below.destroy()
    lower.destroy()
    return out


class ValueTable:
    """Values of 64-bit keys by open addressing, at most half full; looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.zeros(1 << self.bits)
        place, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[place] == EMPTY
            self.keys[place[free]] = keys[left[free]]
            settled = self.keys[place] == keys[left]
            self.values[place[settled]] = values[left[settled]]
            left, place = left[~settled], (place[~settled] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, zero for those that are not there, and the numbers of the latter."""
        place = self._slots(keys)
        out = self.values[place]
        left = np.flatnonzero(self.keys[place] != keys)
        place, missing = place[left], []
        while len(left):
            gone = self.keys[place] == EMPTY
            out[left[gone]] = 0
            missing.append(left[gone])
            left, place = left[~gone], (place[~gone] + 1) & (len(self.keys) - 1)
            out[left] = self.values[place]
            other = self.keys[place] != keys[left]
            left, place = left[other], place[other]
        return out, np.concatenate(missing) if missing else left


def least_frequent(table: DataFrame, column: str, most: int) -> int:
    """The least count that no more than so many rows of the table reach."""
    by_count = sorted(((r[0], r["k"]) for r in table.groupBy(column).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc(column)).limit(most).collect()), reverse=True)
    total, least = 0, 1
    for n, k in by_count:
        total += k
        if total > most:
            return n + 1
        least = n
    return least


PARTIAL = "row long, doc {kind}, held_out boolean, n_tokens long, known long, logs double, score double, words array<struct<token:string,n:bigint>>, grams array<bigint>"


@self_cleaning
def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, least_count: int = 2, divergence: float = 0.01, evidence: float = 2.0, discount: float = 0.75, most_frequent: int = 300_000, most_windows: int = 1 << 21) -> DataFrame:
    """Learn from the rows that training selects and score all.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score and
    score. depth: 2 to 7 bytes of context. most_frequent and most_windows
    bound what goes to all tasks and change no result.
    """
    if not LOW <= depth <= 7:
        raise ValueError(f"contexts have {LOW} to 7 bytes")
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col, (~F.coalesce(training, F.lit(False))).alias("_held_out"))
    counts = corpus_counts(rows, text_col, "_held_out", depth)
    windows = written(counts.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "windows")
    vocabulary = written(counts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    forget(counts)
    logs = window_logs(windows, depth, least_count, divergence, evidence, discount)
    forget(windows)
    often = least_frequent(logs, "uses", most_windows)
    found = logs.filter(F.col("uses") >= often).select("window", "log").toArrow()
    table = spark.sparkContext.broadcast(ValueTable(found["window"].to_numpy().astype(np.uint64), found["log"].to_numpy()))
    size, total, ends = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("token") == END_TOKEN, F.col("n"))), F.lit(0))).first()
    least = least_frequent(vocabulary, "n", most_frequent)
    values = {r["token"].encode(): float(np.log10(r["n"] + 1)) for r in vocabulary.filter(F.col("n") >= least).toLocalIterator()}
    frequent = spark.sparkContext.broadcast(values | {END: float(np.log10(ends + 1))})  # every text has an end

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_of, windows_of = frequent.value.get, table.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for group in grouped(batch.column(1).to_pylist(), depth):
                window, begins = run_windows([x[1] for x in group], [x[2] for x in group], depth)
                value, missing = windows_of.get(window)
                scores = np.add.reduceat(value, begins)
                owner = np.searchsorted(begins, missing, side="right") - 1
                other: list = [None] * len(group)
                for k in np.unique(owner).tolist():
                    other[k] = window[missing[owner == k]].astype(np.int64)
                done = []
                for _, _, _, words, last in group:
                    seen, base, rare = 0, 0.0, []
                    for x, n in Counter(words + [END] * last).items():
                        v = log_of(x)
                        if v is None:
                            rare.append({"token": x.decode(), "n": n})
                        elif v:
                            seen += n
                            base += v * n
                    done.append((len(words) + last, seen, base, rare))
                numbers = np.array([x[0] for x in group])
                columns = list(zip(*done, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))
                n_tokens, known, base, rare = (pa.array(x, t) for x, t in zip(columns, kinds, strict=True))
                take = pa.array(numbers)
                yield pa.record_batch([pa.array(row + numbers), batch.column(0).take(take), batch.column(2).take(take), n_tokens, known, base, pa.array(scores), rare, pa.array(other, pa.list_(pa.int64()))], ["row", "doc", "held_out", "n_tokens", "known", "logs", "score", "words", "grams"])
            row += batch.num_rows

    done = written(rows.mapInArrow(lean(partial), PARTIAL.format(kind=docs.schema[id_col].dataType.simpleString())), "partial")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    rare = done.select("row", F.explode("words").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    rare = rare.join(vocabulary.filter(F.col("n") < least), "token").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    other = done.select("row", F.explode("grams").alias("window")).groupBy("row", "window").agg(F.count(F.lit(1)).alias("times"))
    other = other.join(logs.filter(F.col("uses") < often), "window").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("score"))
    same = ["row", F.lit(None).cast(docs.schema[id_col].dataType).alias("doc"), F.lit(None).cast("boolean").alias("held_out"), zero.alias("n_tokens")]
    parts = done.select("row", "doc", "held_out", "n_tokens", "known", "logs", "score")
    parts = parts.union(rare.select(*same, "known", "logs", none.alias("score"))).union(other.select(*same, zero.alias("known"), none.alias("logs"), "score"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "known", "logs", "score")]
    whole = parts.groupBy("row").agg(F.max("doc").alias("doc"), F.max("held_out").alias("held_out"), *sums)
    log_all = float(np.log10(total + size + 1))
    return whole.select(F.col("doc").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score")


def op3_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    """Learn from six sevenths of the documents, score all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2)
