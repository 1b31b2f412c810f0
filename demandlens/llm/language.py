"""Language ID (12): multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of anything but letters become one blank, and a blank is put at
both ends; features are all runs of 1 to ``LONGEST`` characters, hashed to buckets.

Training counts the n-grams of every labelled text.  A task keeps a count matrix for at most
``HELD`` languages at a time and sends it in slices; the slices of a language are added up
in streams, first by groups of tasks, so nothing is gathered and no language or slice meets
in one list.  The matrix of log-probabilities is broadcast: ``MATRIX_BYTES`` at most, as with
many languages buckets are folded together until it fits.

Scoring is sparse: a batch of texts is a list of (text, bucket) entries, whose rows of the
matrix are gathered and added up by text, a bounded number at a time.

Null texts and those without a letter: ``und`` with score 0, as are all texts if nothing was
learned.  Ties go to the first language by code point.  Very long texts are gathered a part
at a time.  Repeated rows count and are predicted each for itself.  Rows without a language
are not learned from; an empty table gives an empty result.  Further columns are no inputs,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LONGEST = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"
#: Languages whose counts a task holds at once, and slices that a language's counts are sent in.
HELD, SLICES = 32, 8
#: Streams that add up slices, and the size that the broadcast matrix may have.
STREAMS, MATRIX_BYTES = 64, 64 << 20
#: Characters of texts that are hashed at a time, and numbers of the matrix that are gathered at a time.
CHARACTERS, GATHERED = 1 << 19, 1 << 21

_NO_LETTERS = re.compile(r"[\W\d_]+")


def characters(text: str) -> np.ndarray:
    """Code points of the cleaned text; empty if it has no letter."""
    clean = _NO_LETTERS.sub(" ", text.lower()).strip(" ")
    if not any(map(str.isalpha, clean[:64])) and not any(map(str.isalpha, clean)):
        return np.empty(0, dtype=np.uint32)
    return np.frombuffer(f" {clean} ".encode("utf-32-le", "replace"), dtype="<u4")


def hashed(points: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams that begin at each character: a row an n, -1 where the text ends before."""
    out = np.full((LONGEST, len(points)), -1, dtype=np.int32)
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(LONGEST):
        h = h[:len(points) - n] * np.uint32(0x01000193) + points[n:] + np.uint32(n + 1)
        mixed = h * np.uint32(0x9E3779B1)
        out[n, :len(points) - n] = ((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(1)) % np.uint32(buckets)
    return out


def _streams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams, texts in order, about ``CHARACTERS`` characters at a time."""
    held: list[np.ndarray] = []
    who: list[np.ndarray] = []
    n = 0

    def entries() -> tuple[np.ndarray, np.ndarray]:
        points, owner = np.concatenate(held), np.concatenate(who)
        at = hashed(points)
        at[:, owner < 0] = -1
        for k in range(1, LONGEST):  # n-grams that would run on into the next text
            at[k, :len(points) - k][np.abs(owner[k:]) != owner[:len(points) - k]] = -1
        flat, row = at.T.ravel(), np.repeat(owner - 1, LONGEST)
        return row[flat >= 0], flat[flat >= 0]

    for i, text in enumerate(texts, 1):
        points = characters(text)
        for at in range(0, len(points), CHARACTERS):
            # a part of a long text also holds the next few characters, at which none of its n-grams begin
            part = points[at:at + CHARACTERS + LONGEST - 1]
            owner = np.full(len(part), i, dtype=np.int64)
            owner[CHARACTERS:] = -i
            held.append(part)
            who.append(owner)
            n += len(part)
            if n >= CHARACTERS:
                yield entries()
                held, who, n = [], [], 0
    if held:
        yield entries()


_SUMS = "lang string, slice int, task long, n binary"


def _sent(lang: str, counts: np.ndarray, task: int) -> pa.RecordBatch:
    shut = zstandard.ZstdCompressor(level=1).compress
    parts = [shut(p.tobytes()) for p in counts.reshape(SLICES, -1)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int64()),
                                       pa.array(parts, pa.binary())], names=["lang", "slice", "task", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            if lang not in held:
                if len(held) >= HELD:
                    first = next(iter(held))
                    yield _sent(first, held.pop(first), task)
                held[lang] = np.zeros(BUCKETS, dtype=np.int64)
            for _, bucket in _streams(own):
                held[lang] += np.bincount(bucket, minlength=BUCKETS)
    for lang, counts in held.items():
        yield _sent(lang, counts, task)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices, which come sorted by language and slice."""
    now, total, task = None, None, 0

    def out() -> pa.RecordBatch:
        n = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([task], pa.int64()), pa.array([n], pa.binary())],
                                          names=["lang", "slice", "task", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["n"]), dtype=np.int64)
            if now != (row["lang"], row["slice"]):
                if now:
                    yield out()
                now, total, task = (row["lang"], row["slice"]), np.zeros_like(own), row["task"]
            total = total + own
    if now:
        yield out()


class Model:
    """Log-probabilities (buckets x languages) and log-shares of the languages, sorted by code point."""

    def __init__(self, langs: list[str], counts: np.ndarray, n_docs: np.ndarray):
        while len(counts) > 256 and counts.shape[0] * counts.shape[1] * 4 > MATRIX_BYTES:
            counts = counts[:len(counts) // 2] + counts[len(counts) // 2:]
        smooth = counts + SMOOTHING
        self.langs = langs
        self.matrix = np.log(smooth / smooth.sum(0)).astype(np.float32)
        self.prior = np.log(n_docs / n_docs.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        step = max(1, GATHERED // len(self.langs))
        for row, bucket in _streams(texts):
            bucket = bucket % len(self.matrix)
            for at in range(0, len(row), step):
                own = row[at:at + step]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                total[own[first]] += np.add.reduceat(self.matrix[bucket[at:at + step]], first, axis=0, dtype=np.float64)
                seen[own[first]] = True
        total += self.prior
        total -= total.max(1, keepdims=True)
        best = total.argmax(1)
        score = 1 / np.exp(total).sum(1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], np.where(seen, score, 0.0)


def fit(docs: DataFrame, text: str, lang: str, learn: Column) -> Model | None:
    """The model of all rows of ``docs`` that meet ``learn`` and have a text and a language; None if there are none."""
    given = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    n_docs = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n_docs:
        return None
    slices = written(given.mapInArrow(_counted, _SUMS))
    by = [F.col("lang"), F.col("slice")]
    some = slices.repartition(STREAMS, *by, F.col("task") % 8).sortWithinPartitions(*by, "task").mapInArrow(_added, _SUMS)
    rows = some.repartition(STREAMS, *by).sortWithinPartitions(*by, "task").mapInArrow(_added, _SUMS).toArrow().to_pylist()
    langs = sorted(n_docs)
    counts = np.zeros((BUCKETS, len(langs)), dtype=np.int64)
    width = BUCKETS // SLICES
    for row in rows:
        counts[row["slice"] * width:(row["slice"] + 1) * width, langs.index(row["lang"])] += np.frombuffer(
            zstandard.ZstdDecompressor().decompress(row["n"]), dtype=np.int64)
    return Model(langs, counts, np.array([n_docs[x] for x in langs], dtype=np.float64))


def predict(docs: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """One row a document: ``key``, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score = sent.value.predict(texts) if sent.value and texts else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)
