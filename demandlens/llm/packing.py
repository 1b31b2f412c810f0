"""Packing (2): power-of-two decomposition.

A document's tokens are cut into pieces of binary lengths: as many of the largest length as
fit, then one for each set bit of the rest, longest first.  Pieces of equal length share a
bucket (log2 of the length), so every training batch is dense: a sequence is one piece, it
never crosses documents, and nothing is padded.

Cutting needs no other document, so packing is one pass without a shuffle.  ``sequence_id``
is the task's number in the upper bits and a running number below: equal files give equal
ids, also when a task is run again.

Null or blank text: only the end id, one piece of one token.  Very long texts give many
pieces of the largest length.  Repeated rows are packed each for themselves.  An empty table
gives no pieces.  Other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

MAX_LENGTH = 2048
END_ID = 1
#: Bytes of remembered words and ids that a task holds at most; beyond, it starts anew.
REMEMBERED = 64 << 20
#: Bytes of text that are coded at a time, at least: larger parts have fewer different words.
AT_A_TIME = 8 << 20
#: A word may end with a run of these and still be plain (the apostrophe has a meaning of its own to the tokenizer).
_ENDINGS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def _tails(words: pa.StringArray, skip: np.ndarray) -> pa.StringArray:
    """Each word without its first ``skip`` bytes."""
    words = pa.concat_arrays([words])  # offsets from 0
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[:len(words) + 1].astype(np.int64)
    size = np.diff(at) - skip
    data = _gathered(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), at[:-1] + skip, size)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data))


class Ids:
    """Token ids of texts by way of their words.

    The tokenizer never looks across blanks, so the ids of a text are those of its words in
    order.  Each new word is encoded once; plain words (letters, then perhaps a run of
    punctuation, which the tokenizer's own pattern parts) go through it many at a time.
    Known words are an Arrow array and their ids flat arrays, a few bytes each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.empty(0, dtype=np.uint32)
        self.size = np.empty(0, dtype=np.int64)

    def _encode(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=np.uint32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one run of letters each, and their numbers."""
        ids = self._encode(" ".join(words))
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            return ids, np.diff(ends, prepend=0)
        each = [self._encode(w) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each])

    def learn(self, words: pa.StringArray) -> None:
        if not len(words):
            return
        cores = pc.utf8_rtrim(words, characters=_ENDINGS).dictionary_encode()
        letters = cores.dictionary.to_pylist()
        plain = np.array([x.isalpha() and x.lower().isalpha() for x in letters])
        core = cores.indices.to_numpy()
        # what stands after the letters of a plain word; any other word is odd as a whole
        odd = _tails(words, np.where(plain[core], pc.binary_length(cores.dictionary).to_numpy()[core], 0)).dictionary_encode()
        known = [x for x, p in zip(letters, plain, strict=True) if p]
        done = [self._plain(known[i:i + 1000]) for i in range(0, len(known), 1000)]
        each = [self._encode(w) for w in odd.dictionary.to_pylist()]
        flat = np.concatenate([ids for ids, _ in done] + each)
        size = np.concatenate([n for _, n in done] + [np.array([len(x) for x in each] + [0])]).astype(np.int64)
        start = np.cumsum(size) - size
        # odd parts stand after the letters, and last of all an empty part
        parts = np.column_stack([np.where(plain[core], (np.cumsum(plain) - 1)[core], len(size) - 1), len(known) + odd.indices.to_numpy()])
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, _gathered(flat, start[parts.ravel()], size[parts.ravel()])])
        self.size = np.concatenate([self.size, size[parts].sum(1)])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the number of each."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        if self.words.nbytes + self.flat.nbytes + self.size.nbytes > REMEMBERED:
            self.forget()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.words) + np.arange(len(new))
        self.learn(coded.dictionary.take(pa.array(new)))
        at = at[coded.indices.to_numpy()]
        size = self.size[at]
        edges = np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return _gathered(self.flat, (np.cumsum(self.size) - self.size)[at], size), np.diff(edges)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``AT_A_TIME`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= AT_A_TIME:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(n: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cuts of documents of ``n`` tokens each: document, start and length of every piece."""
    bits = longest.bit_length() - 1
    value = longest >> np.arange(bits + 1)
    often = np.column_stack([n // longest, (n % longest)[:, None] >> np.arange(bits - 1, -1, -1) & 1])
    row = np.repeat(np.arange(len(n)), often.sum(1))
    length = np.repeat(np.tile(value, len(n)), often.ravel())
    return row, np.cumsum(length) - length - (np.cumsum(n) - n)[row], length


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; ``longest`` is a power of two."""
    return pieces(np.array([n]), longest)[2].tolist()


def _packer(tokenizer: str, longest: int, end_id: int, with_ids: bool, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        for batch in _merged(batches):
            coded, n = ids.texts(batch.column(1))
            n = n + 1
            own = np.zeros(int(n.sum()), dtype=bool)
            own[np.cumsum(n) - 1] = True
            flat = np.full(len(own), end_id, dtype="<u4")
            flat[~own] = coded
            row, start, length = pieces(n, longest)
            of = memoryview(flat).cast("B")
            ends = np.cumsum(length)
            crc = [zlib.crc32(of[4 * a:4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64()), pa.array(n[row]),
                    pa.array(np.arange(sequence, sequence + len(row))), pa.array(np.zeros(len(row), dtype=np.int64)),
                    pa.array(np.log2(np.maximum(length, 1)).astype(np.int32))]
            sequence += len(row)
            if with_ids:  # the pieces are slices of the flat ids, one after the other
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return released(pack)


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, longest: int = MAX_LENGTH, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """One row a piece: ``key``, start (the document's tokens before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (0: a piece is a sequence), bucket (log2 of the length) and, with ``with_ids``, ids.

    ``tokenizer``: path of a tokenizer file that every executor can read; it must not look across blanks.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids
    kinds = [docs.schema[key].dataType.simpleString(), *["long"] * 6, "int"] + ["array<int>"] * with_ids
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, longest, end_id, with_ids, names), schema).withColumnRenamed("key", key)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences with one folder per length, so that a reader's batches are dense."""
    packed.write.partitionBy("bucket").parquet(path)
