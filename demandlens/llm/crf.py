"""Quality classifier (8): a linear-chain conditional random field over the lines of a document.

Every line gets surface measures (shares of character kinds, word shapes, repeats); its
features are its own measures and those of the line before and after.  The field has a
weight per feature and one per pair of neighbouring labels, and is trained with numpy on
whole-document labels: all lines of a good document are good, all of a bad one bad.  A
document's score is the mean, weighted by line length, of its lines' marginal probabilities
of being good (forward-backward).

Training reads a bounded sample: at most ``TRAIN_DOCS`` labelled documents (smallest hashes
of their ids) of at most ``DOC_LINES`` lines each and ``TRAIN_LINES`` in all, in whole documents.  Scoring reads every line.

Null or blank text: one empty line.  Blank lines of other texts don't count.  Repeated rows
are scored each for itself, with equal scores.  Without labels of both kinds all scores are
0.5.  Of several labels of one document the worst counts; labels that are neither 0 nor 1, or
have no key, are left out.  Very long texts are scored whole (they are only no examples).  An
empty table gives an empty result; further columns are carried, and one with the name of the
score gives way to it.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

TRAIN_DOCS = 2000
TRAIN_LINES = 100_000
#: Documents with more lines are no training examples, so that what reaches the driver is bounded.
DOC_LINES = 1000
STEPS = 250
DECAY = 1e-3
ACCEPT = 0.7

# kinds of bytes: lower, upper, digit, blank, symbol, bar, exclamation mark, other punctuation, start of a longer
# character, its continuation
_KINDS = 10
_KIND = np.full(256, 7, dtype=np.int64)
_KIND[ord("a"):ord("z") + 1] = 0
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_KIND[list(b"#*$%&<>")] = 4
_KIND[ord("|")] = 5
_KIND[ord("!")] = 6
_KIND[0xC0:] = 8
_KIND[0x80:0xC0] = 9

MEASURES = 14


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines (a row each), their weights (characters), and the number of lines of each text."""
    lines: list[bytes] = []
    n_lines, words, alike, distinct, again = [], [], [], [], []
    for text in texts:
        own = [x for x in text.split(b"\n") if x.strip()] or [b""]
        n_lines.append(len(own))
        seen: set[bytes] = set()
        for line in own:
            w = line.split()
            words.append(len(w))
            alike.append(sum(map(eq, w, w[1:])))
            distinct.append(len(set(w)))
            again.append(line in seen)
            seen.add(line)
        lines += own
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    kinds = _KIND[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    kinds += np.repeat(np.arange(len(lines)) * _KINDS, size)
    n = np.bincount(kinds, minlength=len(lines) * _KINDS).reshape(-1, _KINDS).astype(np.float64)
    chars = n.sum(1) - n[:, 9]
    words = np.array(words, dtype=np.float64)
    some, letters = np.maximum(chars, 1), n[:, 0] + n[:, 1] + n[:, 8]
    x = np.column_stack([
        np.log1p(chars), n[:, 1] / np.maximum(letters, 1), n[:, 2] / some, n[:, 4] / some, n[:, 5] / some, n[:, 6] / some,
        n[:, 7] / some, n[:, 8] / some, n[:, 3] / some, (chars - n[:, 3]) / np.maximum(words, 1) / 10, np.array(alike) / np.maximum(words, 1),
        np.array(distinct) / np.maximum(words, 1), 1 / (1 + words), np.array(again, dtype=np.float64)])
    return x, np.maximum(chars, 1), np.array(n_lines)


def neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of the lines: 1, own measures, those of the line before and after (0 at the ends), ends."""
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    ends = np.zeros((len(x), 2))
    ends[first, 0], ends[last, 1] = 1, 1
    return np.hstack([np.ones((len(x), 1)), x, before, after, ends])


def _steps(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, the first line of each, and how many have a line at each step."""
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    size = n_lines[order]
    return order, first, np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")


def marginals(score: np.ndarray, pairs: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected counts of label pairs, and the sum of log Z; ``score``: of good against bad."""
    _, first, alive = _steps(n_lines)
    unary = np.column_stack([np.zeros(len(score)), score])
    ahead, back = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(alive)):
        at = first[:alive[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + pairs[0], ahead[at - 1, 1:] + pairs[1])
    for t in range(len(alive) - 1, 0, -1):
        at = first[:alive[t]] + t
        come = unary[at] + back[at]
        back[at - 1] = np.logaddexp(pairs[:, 0] + come[:, :1], pairs[:, 1] + come[:, 1:])
    both = ahead + back
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    later = np.ones(len(score), dtype=bool)
    later[np.cumsum(n_lines) - n_lines] = False
    at = np.flatnonzero(later)
    joint = ahead[at - 1][:, :, None] + pairs + (unary + back)[at][:, None, :] - log_z[at][:, None, None]
    return good, np.exp(joint).sum(0), float(log_z[np.cumsum(n_lines) - 1].sum())


@dataclass
class Field:
    """Trained weights; ``mean`` and ``spread`` standardise the measures."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, size, n_lines = measures(texts)
        f = neighbours((x - self.mean) / self.spread, n_lines)
        good = marginals(f @ self.weights, self.pairs, n_lines)[0]
        first = np.cumsum(n_lines) - n_lines
        return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def train(x: np.ndarray, n_lines: np.ndarray, quality: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with weight decay, by Adam over all given documents."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    f = neighbours((x - mean) / spread, n_lines)
    y = np.repeat(quality.astype(np.float64), n_lines)
    theta = np.zeros(f.shape[1] + 4)
    seen = np.zeros((2, 2))
    later = np.ones(len(y), dtype=bool)
    later[np.cumsum(n_lines) - n_lines] = False
    at = np.flatnonzero(later)
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(f @ theta[:-4], theta[-4:].reshape(2, 2), n_lines)
        g = np.concatenate([f.T @ (y - good), (seen - pairs).ravel()]) / len(y) - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, spread, theta[:-4], theta[-4:].reshape(2, 2))


@released
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures([t or b""])[0].astype("<f4") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()),
                                          pa.array([r.tobytes() if len(r) <= DOC_LINES else b"" for r in rows], pa.binary())],
                                         names=["quality", "n", "x"])


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, train_docs: int = TRAIN_DOCS,
        train_lines: int = TRAIN_LINES) -> Field | None:
    """The field fitted on ``labels`` (``key``, quality 0 or 1), or None without labels of both kinds.

    The sample of labels has at most ``train_docs`` rows, so its broadcast is bounded by that parameter.
    """
    sample = (labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
              .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("k"), "k").limit(train_docs))
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "k")
    rows = texts.select(F.col("quality").cast("int"), "text").mapInArrow(_measured, "quality int, n long, x binary")
    rows = rows.orderBy(F.xxhash64("x"), "n").toArrow().to_pylist()
    room, used = train_lines, []
    for row in rows:
        if row["x"] and row["n"] <= room:
            used.append(row)
            room -= row["n"]
    quality = np.array([r["quality"] for r in used])
    if not len(used) or quality.min() == quality.max():
        return None
    x = np.concatenate([np.frombuffer(r["x"], dtype="<f4").reshape(-1, MEASURES) for r in used]).astype(np.float64)
    return train(x, np.array([r["n"] for r in used]), quality)


def _scorer(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            score = field.scores(texts) if field is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(score)], names=["doc", "score"])
    return released(run)


def score(docs: DataFrame, text: str, field: Field | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of every text in a column ``name`` (in place of one of that name)."""
    given = docs.select(F.col(text).cast("string").alias("text"), F.struct(*docs.columns).alias("doc"))
    schema = T.StructType([given.schema["doc"], T.StructField("score", T.DoubleType())])
    rest = [F.col("doc")[c].alias(c) for c in docs.columns if c != name]
    return given.mapInArrow(_scorer(field), schema).select(*rest, F.col("score").alias(name))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``: deals rows into folds."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
