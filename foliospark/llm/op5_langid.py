"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of its own, drawn by its code point. A trigram's vector binds (multiplies) the letters' vectors, the
first rotated twice and the second once. A text's vector bundles (adds) its trigrams' vectors, and a language's
prototype bundles the unit vectors of its training texts, less the mean of all languages. The prediction is the
prototype of greatest cosine.

Training reads a bounded sample: of each language at most SLOTS documents, one for each value of a hash of the document
id (of rows that share an id the least text by its hash). Every language of the table is learned; the model takes 12 KB
for each. Every document's whole text is predicted.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if nothing can be
learned (no labelled training text); equal cosines go to the language that comes first by name; very long texts go in
runs cut at white space; repeated rows are predicted each; an empty table gives no rows; extra columns of the input,
whatever their names, are ignored by identify() and kept by accepted(). Only text and lang of documents for which train
is true are learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced
from .op8_wordbpe import runs


DIMENSIONS = 1024
SLOTS = 256
UNKNOWN = "und"
#: accepted() rejects documents whose cosine with their language's whole prototype is lower.
MIN_LIKENESS = 0.2
#: Bits of a letter's code in a trigram's, letters and trigrams whose vectors a worker remembers (16 and 8 MB).
BITS = 21
LETTERS, TRIGRAMS = 1 << 14, 1 << 13
SEED = 7
CHUNK = 1 << 18
Model = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]


def letter_codes() -> np.ndarray:
    """For each code point 0 if it is no letter, else its own; case is folded where it is one to one."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low if len(low) == 1 else ch)
    return out


class Profiler:
    """Turns texts into bundled trigram vectors; remembers the vectors of letters and trigrams it has met."""

    def __init__(self) -> None:
        self.codes = letter_codes()
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.book = np.empty((TRIGRAMS, DIMENSIONS), np.int8)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of letters, and of the gap (0)."""
        if len(self.letter) > LETTERS:
            self.letter.clear()
        for c in set(codes.tolist()) - self.letter.keys():
            self.letter[c] = np.random.default_rng([SEED, c]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return np.stack([self.letter[c] for c in codes.tolist()])

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """The rows of the book for at most TRIGRAMS different codes, which are bound when first met."""
        new = [t for t in trigrams.tolist() if t not in self.row]
        if len(self.row) + len(new) > TRIGRAMS:
            self.row.clear()
            new = trigrams.tolist()
        mask = (1 << BITS) - 1
        for i in range(0, len(new), 1024):
            some, n = np.array(new[i : i + 1024]), len(self.row)
            a, b, c = some >> 2 * BITS, some >> BITS & mask, some & mask
            self.book[n : n + len(some)] = np.roll(self.letters(a), 2, 1) * np.roll(self.letters(b), 1, 1) * self.letters(c)
            self.row.update(zip(some.tolist(), range(n, n + len(some))))
        return np.array([self.row[t] for t in trigrams.tolist()])

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigram codes over letters and single gaps, and the text of each; only those with a letter in the middle."""
        joined = "\n\n".join(texts) + "\n\n"
        codes = self.codes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        keep = (codes > 0) | np.concatenate([[False], codes[:-1] > 0])  # a letter, or the first gap after one
        codes, owner = codes[keep], owner[keep]
        if len(codes) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate([[0], codes]).astype(np.int64)
        tri = codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:]
        good = codes[1:-1] > 0
        return tri[good], owner[:-1][good]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """One vector a text; zeros if it has no letter."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and j - i < 256 and (size == 0 or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            # a longer text goes in runs cut at white space, which no trigram crosses
            for part in ([[run] for run in runs(texts[i], CHUNK)] if j == i + 1 else [texts[i:j]]):
                tri, owner = self.trigrams(part)
                if len(tri):
                    distinct, which = np.unique(tri, return_inverse=True)
                    for k in range(0, len(distinct), 1 << 11):
                        some = slice(k, k + (1 << 11))
                        here = (which >= k) & (which < k + (1 << 11))
                        width = len(distinct[some])
                        counts = np.bincount(owner[here] * width + which[here] - k, minlength=len(part) * width).reshape(len(part), width).astype(np.float32)
                        rows = self.vectors(distinct[some])
                        out[i : i + len(part)] += counts @ self.book[rows].astype(np.float32)
            i = j
        return out


_PROFILER: list[Profiler] = []


def profiler() -> Profiler:
    if not _PROFILER:
        _PROFILER.append(Profiler())
    return _PROFILER[0]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def train(docs: DataFrame, trainable: Column) -> Model:
    """Languages in order, their prototypes less the mean, the mean, and the whole prototypes."""
    slot = F.xxhash64("doc_id")
    labelled = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", slot.alias("h"), "text")
    # at most SLOTS rows a language; as a table its size is known when the join is planned
    picked = materialize(labelled.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h"), "language-sample")
    chosen = labelled.join(picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = "lang string, v binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, v in zip(langs, _unit(profiler().bundles(texts))):
                total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in chosen.select("lang", "text").repartition(16, "lang").mapInArrow(sums, schema).collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["v"], np.float64)
    if not total:
        return [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32)
    names = sorted(total)
    units = _unit(np.stack([total[k] for k in names]))
    mean = units.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS)
    return names, _unit(units - mean).astype(np.float32), mean.astype(np.float32), units.astype(np.float32)


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each text the language, the greatest cosine (0 to 1), how far the next language is, and the cosine with the
    language's whole prototype."""
    names, prototypes, mean, whole = model
    v = profiler().bundles([t or "" for t in texts])
    found = v.any(axis=1) & bool(names)
    if not names:
        return [UNKNOWN] * len(v), np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
    cos = _unit(_unit(v) - mean) @ prototypes.T
    each, best = np.arange(len(cos)), cos.argmax(1)
    top = cos[each, best]
    rest = cos.copy()
    rest[each, best] = -1
    label = [names[i] if ok else UNKNOWN for i, ok in zip(best, found)]
    like = (_unit(v) * whole[best]).sum(1)
    return label, np.where(found, np.clip(top, 0, 1), 0).astype(float), np.where(found, np.clip(top - rest.max(1, initial=-1), 0, 2), 0).astype(float), like


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, margin of every document."""
    schema = "doc_id long, lang_pred string, score double, margin double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            label, score, margin, _ = judge(b.column(1).to_pylist(), model)
            yield pa.record_batch([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, all columns, that are like a learned language, which becomes their lang; they are not shuffled."""
    model = model or train(docs, F.lit(True))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            label, _, _, like = judge(b.column(at).to_pylist(), model)
            columns = [pa.array(label, pa.string()) if i == lang else c for i, c in enumerate(b.columns)]
            keep = pa.array([x != UNKNOWN and y >= MIN_LIKENESS for x, y in zip(label, like)], pa.bool_())
            yield pa.record_batch(columns, b.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin of every document; learns from the documents not held out."""
    return predict(docs, train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")
