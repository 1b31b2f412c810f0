"""LM scoring (9): a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased, and one end.  The model predicts the class
of a token from the classes of the two before it: each has a vector, a matrix per position
maps them, their sum is matched with the class's output vector, plus a bias.  The ``TOP``
commonest words and the end are classes of their own; the other words share ``SHARED``
classes by their last three bytes, inside which they follow their counts.  So a token's
probability is P(class | context) * P(word | class): normalised over all words seen in
training and one unknown word per shared class.

1. Tasks turn their documents into blocks of about ``BLOCK`` tokens: a local vocabulary with
   training counts, and the tokens as numbers into it.  Texts are read once.
2. The vocabularies of all blocks meet by word: one shuffle gives each (block, word) the
   count in all training documents.  No vocabulary is ever whole in one place.
3. Each block gets its counts back and becomes a stream of classes, with the base score and
   the within-class part of every document.
4. Training: each task runs minibatches of its blocks' training documents from the common
   start (noise is drawn once a minibatch from the class frequencies, so its part is a
   matrix product); the results are averaged, weighted by tokens, first in groups of tasks,
   then on the driver, which sees one model per group.  ``PASSES`` such rounds go through
   different minibatches of all training tokens.
5. Scoring: matrix products give the scores of all classes after all pairs of classes, hence
   the normaliser of each pair; tokens look theirs up.

Null or blank text: one end.  Repeated rows are trained on and scored each for itself.
Without training documents the model is uniform over what it knows.  Very long texts make a
block of their own.  An empty table gives an empty result; columns beyond key and text don't
matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

BLOCK = 2_000_000
TOP = 254
SHARED = 256
CLASSES = 2 + TOP + SHARED
START, END = 0, 1
WIDTH = 16
NOISE = 64
BATCH = 512
PASSES = 2
RATE = 0.1
#: Models that the driver averages at most; so many groups of tasks are averaged before.
GROUPS = 16


def _shut(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _open(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _blocked(block: int, key_kind: pa.DataType):
    """Batches of (key, train, text) to blocks of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        keys, train, tokens, n = [], [], [], 0
        words: dict[bytes, int] = {}

        def done() -> pa.RecordBatch:
            size = np.fromiter(map(len, tokens), dtype="<i8", count=len(tokens))
            flat = np.concatenate(tokens)
            counts = np.bincount(flat[np.repeat(np.array(train), size)], minlength=len(words))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([keys], pa.list_(key_kind)), pa.array([train]), pa.array([_shut(size)], pa.binary()),
                 pa.array([_shut(flat)], pa.binary()), pa.array([list(words)], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                 pa.array([int(counts.sum())])], names=["block", "keys", "train", "sizes", "tokens", "words", "counts", "n_train"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for key, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                own = (text.as_py() or b"").lower().split()
                tokens.append(np.fromiter([words.setdefault(w, len(words)) for w in own], dtype="<i4", count=len(own)))
                keys.append(key)
                train.append(bool(flag))
                n += len(own)
                if n >= block:
                    yield done()
                    number, n = number + 1, 0
                    keys, train, tokens, words = [], [], [], {}
        if keys:
            yield done()
    return run


def shared_class(word: bytes) -> int:
    """Class of a word that is no top word."""
    return 2 + TOP + zlib.crc32(word[-3:]) % SHARED


class Counts:
    """What the corpus says about words and classes: totals, top words, masses of the shared classes."""

    def __init__(self, n_tokens: int, n_types: int, n_docs: int, top: dict[bytes, int], shared: dict[int, tuple[int, float]]):
        self.docs, self.top = n_docs, {w: 2 + i for i, w in enumerate(top)}
        self.n, self.types = n_tokens + n_docs, n_types + (n_docs > 0)
        self.mass = np.full(CLASSES, 0.5)
        seen = np.zeros(CLASSES)
        seen[END] = n_docs
        for i, c in enumerate(top.values()):
            self.mass[2 + i], seen[2 + i] = c + 0.5, c
        self.mass[END] = n_docs + 0.5
        for k, (c, mass) in shared.items():
            self.mass[k], seen[k] = mass + 0.5, c
        self.prior = (seen + 0.5) / (seen + 0.5)[1:].sum()
        self.prior[START] = 0.0

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.types + 1)))


def _with_counts(counts: Counts, key_kind: pa.DataType):
    """A block and the counts of its words to streams of classes."""
    def run(found: pa.Table, blocks: pa.Table) -> pa.Table:
        row = blocks.select(["block", "keys", "train", "sizes", "tokens", "words"]).slice(0, 1).to_pylist()[0]
        c = np.zeros(len(row["words"]), dtype=np.float64)
        c[found["at"].to_numpy()] = found["c"].to_numpy()
        kind = np.fromiter((counts.top.get(w) or shared_class(w) for w in row["words"]), dtype="<u2", count=len(row["words"]))
        size, tokens = _open(row["sizes"], "<i8"), _open(row["tokens"], "<i4")
        ends = np.cumsum(size + 1)
        stream = np.full(int(ends[-1]), END, dtype="<u2")
        inner = np.ones(len(stream), dtype=bool)
        inner[ends - 1] = False
        stream[inner] = kind[tokens]
        inside = np.log10((c + 0.5) / counts.mass[kind])
        doc = np.repeat(np.arange(len(size)), size)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x[tokens], minlength=len(size)).astype(np.float64)

        base = per_doc(counts.base(c)) + counts.base(np.array([counts.docs]))[0]
        known = per_doc((c > 0).astype(np.float64)).astype(np.int64) + (counts.docs > 0)
        return pa.table({"keys": pa.array([row["keys"]], pa.list_(key_kind)), "train": [row["train"]], "sizes": pa.array([_shut(size + 1)], pa.binary()),
                         "stream": pa.array([_shut(stream)], pa.binary()), "known": [known.tolist()], "base": [base.tolist()],
                         "inside": [per_doc(inside).tolist()]})
    return run


class Model:
    """Parameters: context vectors, a matrix per position, output vectors, biases."""

    def __init__(self, prior: np.ndarray, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.given = draw.normal(0, 0.3, (CLASSES, WIDTH)).astype(np.float32)
        self.maps = np.stack([np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32)])
        self.out = draw.normal(0, 0.05, (CLASSES, WIDTH)).astype(np.float32)
        self.bias = np.log(np.maximum(prior, 1e-12)).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.given, self.maps, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores after the last class, after the one before it (biases with the first), and log normalisers of all pairs."""
        given, out = self.given.astype(np.float64), self.out.astype(np.float64)
        first = given @ self.maps[0] @ out.T + self.bias
        second = given @ self.maps[1] @ out.T
        first[:, START] = -np.inf
        norm = np.empty((CLASSES, CLASSES))
        for c in range(CLASSES):
            s = first[c] + second
            top = s.max(1, keepdims=True)
            norm[c] = (top + np.log(np.exp(s - top).sum(1, keepdims=True)))[:, 0]
        return first, second, norm


def _sums(kind: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes that occur, and the sums of their rows of ``x``."""
    order = np.argsort(kind, kind="stable")
    own = kind[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(x[order], first, axis=0)


def contexts(stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; ``START`` outside the document."""
    first = np.cumsum(sizes) - sizes
    one = np.roll(stream, 1)
    one[first] = START
    two = np.roll(one, 1)
    two[first] = START
    return one, two


def learn(model: Model, squares: list[np.ndarray], prior: np.ndarray, target: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray) -> None:
    """One minibatch of noise-contrastive estimation (ascent with AdaGrad steps)."""
    log_noise = np.log(np.maximum(NOISE * prior, 1e-12)).astype(np.float32)
    mapped = [model.given @ m for m in model.maps]
    q = mapped[0][one] + mapped[1][two]
    out = model.out[noise]
    real = (q * model.out[target]).sum(1) + model.bias[target] - log_noise[target]
    fake = q @ out.T + (model.bias[noise] - log_noise[noise])
    up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
    down = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
    dq = up[:, None] * model.out[target] + down @ out
    steps = [np.zeros_like(p) for p in model.parts()]
    at, sums = _sums(target, np.column_stack([up[:, None] * q, up]))
    steps[2][at] += sums[:, :-1]
    steps[3][at] += sums[:, -1]
    np.add.at(steps[2], noise, down.T @ q)
    np.add.at(steps[3], noise, down.sum(0))
    for i, context in enumerate((one, two)):
        at, sums = _sums(context, dq)
        steps[0][at] += sums @ model.maps[i].T
        steps[1][i] += model.given[at].T @ sums
    for p, g, s in zip(model.parts(), steps, squares, strict=True):
        g /= len(target)
        s += g * g
        p += RATE * g / (np.sqrt(s) + 1e-6)


def minibatches(use: np.ndarray, turn: int) -> list[np.ndarray]:
    """Those of pass ``turn``: every ``PASSES``-th of one shuffled order, the same in all passes, so that each token is in one pass (shuffles ``use``)."""
    np.random.default_rng(len(use)).shuffle(use)
    return [use[i:i + BATCH] for i in range(turn * BATCH, len(use), PASSES * BATCH)]


def _trained(prior: np.ndarray, flat: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(prior).load(flat)
        squares = [np.full_like(p, 1e-8) for p in model.parts()]
        chance = np.cumsum(prior)
        chance /= chance[-1]
        seen = 0
        for batch in batches:
            for row in batch.to_pylist():
                sizes, stream = _open(row["sizes"], "<i8"), _open(row["stream"], "<u2").copy()
                one, two = contexts(stream, sizes)
                use = np.flatnonzero(np.repeat(np.array(row["train"], dtype=bool), sizes))
                draw = np.random.default_rng([turn, len(use)])
                for own in minibatches(use, turn):
                    noise = np.searchsorted(chance, draw.random(NOISE), side="right").clip(1, CLASSES - 1)
                    learn(model, squares, prior, stream[own], one[own], two[own], noise)
                    seen += len(own)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(seen)]), pa.array([(model.flat().astype(np.float64) * seen).tobytes()], pa.binary())],
                                             names=["task", "seen", "model"])
    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seen, total = None, 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["model"], dtype=np.float64)
            total = x.copy() if total is None else total + x
            seen += row["seen"]
            task = row["task"] if task is None else min(task, row["task"])
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["task", "seen", "model"])


_MODELS = "task long, seen double, model binary"


def train(streams: DataFrame, counts: Counts) -> Model:
    """The model after ``PASSES`` rounds of averaged training over all training documents."""
    model = Model(counts.prior)
    for turn in range(PASSES):
        own = streams.select("train", "sizes", "stream").mapInArrow(_trained(counts.prior, model.flat(), turn), _MODELS)
        groups = (own.repartition(GROUPS, F.col("task") % GROUPS).sortWithinPartitions("task").mapInArrow(_averaged, _MODELS)
                  .toArrow().sort_by("task").to_pylist())
        if groups:
            model.load(sum(np.frombuffer(g["model"], dtype=np.float64) for g in groups) / sum(g["seen"] for g in groups))
    return model


def _scored(tables: tuple[np.ndarray, np.ndarray, np.ndarray], n: int):
    first, second, norm = tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["train", "sizes", "stream", "known", "base", "inside"]).to_pylist()):
                sizes, stream = _open(row["sizes"], "<i8"), _open(row["stream"], "<u2")
                one, two = contexts(stream, sizes)
                of_class = (first[one, stream] + second[two, stream] - norm[one, two]) / np.log(10)
                score = np.add.reduceat(of_class, np.cumsum(sizes) - sizes) + np.array(row["inside"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[i].values, pa.array([not t for t in row["train"]]), pa.array(sizes), pa.array(row["known"]),
                     pa.array([n] * len(sizes), pa.int64()), pa.array(row["base"]), pa.array(score)],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """One row a document: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability)."""
    kind = docs.schema[key].dataType
    key_kind = pa.from_numpy_dtype(np.int64) if kind.simpleString() == "bigint" else pa.string()
    if kind.simpleString() not in ("bigint", "string"):
        raise TypeError("the key must be a long or a string")
    name = kind.simpleString()
    given = docs.select(F.col(key), ~held_out, F.col(text).cast("string"))
    blocks = written(given.mapInArrow(_blocked(BLOCK, key_kind), f"block long, keys array<{name}>, train array<boolean>, sizes binary, tokens binary,"
                                                                  " words array<binary>, counts array<long>, n_train long"))
    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", "x.words", "x.counts")
    n_tokens = blocks.agg(F.sum("n_train")).first()[0] or 0
    by_word = W.Window.partitionBy("words")
    c, nth = F.sum("counts").over(by_word), F.row_number().over(by_word.orderBy("block"))
    # a word is kept as text only once, and only if common enough to be a top word
    common = (F.col("nth") == 1) & (F.col("c") * 1_000_000 >= n_tokens) & (F.col("c") > 0)
    found = (local.withColumns({"c": c, "nth": nth})
             .select("block", "at", "c", (F.col("nth") == 1).alias("once"), F.when(common, F.col("words")).alias("word"),
                     (F.crc32(F.substring("words", -3, 3)) % SHARED + 2 + TOP).cast("int").alias("kind")))
    found = written(found)
    top = {bytes(r["word"]): r["c"] for r in found.where("word IS NOT NULL").orderBy(F.col("c").desc(), "word").select("word", "c").limit(TOP).collect()}
    types = found.where("once AND c > 0")
    kinds = types.where(F.col("word").isNull() | ~F.col("word").isin(*top)) if top else types
    shared = {r["kind"]: (r["c"], r["mass"]) for r in kinds.groupBy("kind").agg(F.sum("c").alias("c"), F.sum(F.col("c") + 0.5).alias("mass")).collect()}
    n_docs = blocks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    counts = Counts(n_tokens, types.count(), n_docs, top, shared)
    streams = "keys array<%s>, train array<boolean>, sizes binary, stream binary, known array<long>, base array<double>, inside array<double>" % name
    rows = found.select("block", "at", "c").groupBy("block").cogroup(blocks.select("block", "keys", "train", "sizes", "tokens", "words").groupBy("block"))
    rows = written(rows.applyInArrow(_with_counts(counts, key_kind), streams))
    model = train(rows, counts)
    schema = f"key {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_scored(model.tables(), counts.n), schema).withColumnRenamed("key", key)
