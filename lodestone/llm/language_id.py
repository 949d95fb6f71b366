"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A
letter trigram's vector binds the first letter's vector rotated by two places,
the second's by one and the third's as it is; whatever is no letter counts as
one boundary letter. A document's vector bundles (adds) those of its trigrams,
a language's prototype those of its documents, and the language with the
largest cosine is predicted, on ties the first by name.

Cases: a null text, or one without a letter, is `und` with score 0, as is every
text where no language was learned; rows without a language teach nothing;
repeated rows count each; texts are taken whole; an empty table gives an empty
result. Input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import crc_mod, lean
from lodestone.llm.pretokens import E as LAST_LETTER
from lodestone.llm.pretokens import code_point_classes, grouped, segments

BOUNDARY = 0
BATCH_CHARS = 400_000
_letters: dict[tuple[int, int], np.ndarray] = {}


@dataclass(frozen=True)
class Profiles:
    """Prototype vectors of the learned languages, one row each, in order of name."""

    names: tuple[str, ...]
    vectors: np.ndarray
    dimensions: int


def letter_vector(code_point: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter; the same in every process."""
    key = (code_point, dimensions)
    if key not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[key] = (np.random.default_rng([7919, code_point]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _letters[key]


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over a batch: text numbers, trigram numbers, counts, and each trigram's three code points."""
    stream = "\n\n" + "\n\n".join(x.lower() for x in texts) + "\n\n"
    sizes = np.array([len(x.lower()) + 2 for x in texts])
    points = np.frombuffer(stream.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    points[code_point_classes()[points] > LAST_LETTER] = BOUNDARY
    present = np.zeros(0x110000, dtype=bool)
    present[points] = True
    alphabet = np.flatnonzero(present)
    rank = np.zeros(0x110000, dtype=np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    code, k = rank[points], len(alphabet)
    owner = np.repeat(np.arange(len(texts)), sizes)
    gram = (code[:-2] * k + code[1:-1]) * k + code[2:]
    # Each text ends in two boundaries, so no trigram with a letter in the middle reaches over a text's end.
    keep = (points[1:-1] != BOUNDARY) & ((points[:-2] != BOUNDARY) | (points[2:] != BOUNDARY))
    keyed, counts = np.unique(owner[np.flatnonzero(keep) - 1] * k**3 + gram[keep], return_counts=True) if keep.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams, number = np.unique(keyed % k**3, return_inverse=True)
    letters = alphabet[np.stack([grams // k**2, grams // k % k, grams % k], axis=1)]
    return keyed // k**3, number, counts, letters


def trigram_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of trigrams, as float32 so that bundling is a matrix product."""
    alphabet, place = np.unique(letters, return_inverse=True)
    table = np.stack([letter_vector(int(x), dimensions) for x in alphabet]) if len(alphabet) else np.zeros((0, dimensions), np.int8)
    place = place.reshape(letters.shape)
    rotated = [np.roll(table, shift, axis=1) for shift in (2, 1, 0)]
    return (rotated[0][place[:, 0]] * rotated[1][place[:, 1]] * rotated[2][place[:, 2]]).astype(np.float32)


def bundles(texts: list[str], group: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    """The sum of trigram vectors over the texts of each group; long texts in segments, cut at blanks, which no trigram's middle letter crosses."""
    total = np.zeros((n_groups, dimensions), dtype=np.float64)
    for parts in grouped(texts, BATCH_CHARS):
        total += _bundled([x for _, x in parts], group[[k for k, _ in parts]], n_groups, dimensions)
    return total


def _bundled(texts: list[str], group: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    text, gram, counts, letters = trigram_counts(texts)
    total = np.zeros((n_groups, dimensions), dtype=np.float64)
    for k in range(0, len(letters), 16_384):  # bounded memory, whatever the alphabet
        part = (gram >= k) & (gram < k + 16_384)
        width = min(16_384, len(letters) - k)
        flat = np.bincount(group[text[part]] * width + gram[part] - k, weights=counts[part], minlength=n_groups * width)
        total += flat.reshape(n_groups, width).astype(np.float32) @ trigram_vectors(letters[k : k + width], dimensions)
    return total


def has_letter(text: str) -> bool:
    """Is any code point a letter?"""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return bool(len(points) and (code_point_classes()[points] <= LAST_LETTER).any())


def in_groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about BATCH_CHARS together."""
    first = size = 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= BATCH_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = 512, most_languages: int = 2000) -> Profiles:
    """Bundle all given documents into prototypes; their number is languages times dimensions, whatever the input.

    Raises ValueError on more than most_languages, which bounds what comes to the driver.
    """

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                names, group = np.unique(langs[a:b], return_inverse=True)
                for name, row in zip(names.tolist(), bundles(texts[a:b], group, len(names), dimensions), strict=True):
                    sums[name] = sums.get(name, 0) + row
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([np.rint(x).astype(np.int64) for x in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    parts = known.mapInArrow(lean(bundled), "lang string, vector array<bigint>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = sums.limit(most_languages * dimensions + 1).collect()
    if len(rows) > most_languages * dimensions:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted({r.lang for r in rows})
    at = {x: k for k, x in enumerate(names)}
    vectors = np.zeros((len(names), dimensions))
    for r in rows:
        vectors[at[r.lang], r.at] = r.v
    keep = np.linalg.norm(vectors, axis=1) > 0
    return Profiles(tuple(x for x, k in zip(names, keep, strict=True) if k), vectors[keep], dimensions)


def identify_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine with the predicted prototype (0 to 1)."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = rest.index(text_col)
    out = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array([*profiles.names, "und"], dtype=object)
    unit = profiles.vectors / np.linalg.norm(profiles.vectors, axis=1, keepdims=True) if len(profiles.names) else np.zeros((0, profiles.dimensions))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            best, score = np.full(len(texts), len(unit)), np.zeros(len(texts))
            for a, b in in_groups(texts):
                vectors = bundles(texts[a:b], np.arange(b - a), b - a, profiles.dimensions)
                norms = np.linalg.norm(vectors, axis=1)
                ok = np.flatnonzero(norms > 0)
                if len(unit) and len(ok):
                    cosine = vectors[ok] @ unit.T / norms[ok, None]
                    best[a + ok] = cosine.argmax(axis=1)
                    score[a + ok] = np.clip(cosine.max(axis=1), 0, 1)
            if len(unit):  # letters whose trigrams are none or cancel: the first language, without certainty
                for k in np.flatnonzero(best == len(unit)):
                    if any(has_letter(x) for x in segments(texts[k])):
                        best[k] = 0
            yield pa.record_batch([*(batch.column(i) for i in range(len(rest))), pa.array(names[best].tolist(), pa.string()), pa.array(score)], out.fieldNames())

    return docs.select(rest).mapInArrow(lean(predicted), out)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Learn from four fifths of the documents, predict the language of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    profiles = learn_profiles(docs.filter(~held_out))
    return identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")
