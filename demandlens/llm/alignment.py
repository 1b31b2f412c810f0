"""Cross-tokenizer alignment (13): interval coalescing of two tokenizations of a text.

Tokenizer A codes a blank and the text, tokenizer B the text, to which it adds that blank
itself, so both cover the same bytes.  All tokens of both are sorted by their first byte
(``lexsort``); where a token starts at or after the running maximum of the ends before it
(``maximum.accumulate``), a group begins.  A group's A and B tokens are linked, each with
each.

Texts are cut before a lone blank between two characters that are no white space.  Both
tokenizers always have a token edge there (A's pattern begins a token at such a blank, and
no piece of B holds a blank after anything else, which is checked), so the tokens of a text
are those of its units in order.  New units are coded one after the other as one text and
aligned together; a task remembers them in flat arrays of bounded size.

1. One pass over the texts makes blocks of documents: their counts and digests, the block's
   distinct id pairs with the number of documents that hold each, and which pairs a document
   links how often.
2. The pairs of all blocks meet by pair: one shuffle gives each (block, pair) its count in
   all documents; the highest count of each A id (a row an id of A's vocabulary) is joined.
3. Each block gets its counts back and sums them up by document.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have
no tokens: zeros and an empty string instead of a digest.  A very long text makes a block
of its own.  Repeated rows count as documents of their own and get a row each.  An empty
table gives an empty result; columns beyond key and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import released, written

#: Bytes of text that make a block, and of a text that are looked at for cuts at a time.
BLOCK = 4 << 20
PART = 16 << 20
#: Bytes of units that are coded as one text.
CODED = 1 << 16
#: Links that are listed at a time; groups with more than ``LARGE`` first put equal ids together.
LISTED = 1 << 18
LARGE = 256
#: Units that are coded and aligned at a time.
LEARNED = 1 << 15
#: Bytes of remembered units that a task holds at most; beyond, it starts anew.
REMEMBERED = 64 << 20
#: Units whose texts are put together at a time.
JOINED = 1 << 14

# bytes that a unit's last character, and the character after its blank, may end and begin with: printable ASCII, or (the
# lead bytes of) characters of two bytes from U+00C0 on, none of which is white space
_ASCII = np.zeros(256, dtype=bool)
_ASCII[33:127] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True
_BEGINS = _ASCII | _LEAD


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all items, and where each starts and how long it is."""
    size = np.array([len(x) for x in items], dtype=np.int64)
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.cumsum(size) - size, size


def _ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at ``last`` is one that a unit may end with."""
    own = data[last]
    return _ASCII[own] | ((own >= 0x80) & (own < 0xC0) & _LEAD[data[np.maximum(last - 1, 0)]])


def cuts(data: np.ndarray) -> np.ndarray:
    """Places inside of a text (its bytes, a blank first) before which it is cut."""
    out = []
    for at in range(0, len(data), PART):
        blank = np.flatnonzero(data[at:at + PART] == 32) + at
        blank = blank[(blank > 1) & (blank + 1 < len(data))]
        out.append(blank[_ends(data, blank - 1) & _BEGINS[data[blank + 1]]])
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        # tasks are Spark's; threads of the tokenizer would only hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary, of = self.a.get_vocab(), _byte_level()
        a_bytes, b_bytes = [b""] * (max(vocabulary.values()) + 1), []
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.whole_words = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            as_byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.whole_words &= "▁" not in piece.lstrip("▁")
            b_bytes.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode())
        self.a_table, self.b_table = _table(a_bytes), _table(b_bytes)
        self.a_size, self.b_size = self.a_table[2], self.b_table[2]
        self.wide = len(b_bytes)
        self.digits = _table([str(i).encode() for i in range(max(len(a_bytes), len(b_bytes)))])

    def code(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both for texts that begin with a blank, and whether both give back the text's bytes."""
        for text, a, b in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            want = np.frombuffer(text.encode(), dtype=np.uint8)
            a, b = np.array(a.ids, dtype=np.int64), np.array(b, dtype=np.int64)
            same = [np.array_equal(_gathered(flat, at[ids], size[ids]), want) for ids, (flat, at, size) in ((a, self.a_table), (b, self.b_table))]
            yield a, b, all(same)


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group (from 0) of each A and each B token; both cover the same bytes, token after token."""
    size = np.concatenate([a_size, b_size])
    end = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    start = end - size
    order = np.lexsort((end, start))
    furthest = np.maximum.accumulate(end[order])
    begins = np.ones(len(size), dtype=np.int64)
    begins[1:] = start[order][1:] >= furthest[:-1]
    group = np.empty(len(size), dtype=np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[:len(a_size)], group[len(a_size):]


def written_groups(t: Tokenizers, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text, ``a1,a2|b1;`` each, as bytes, and the number of bytes of each group."""
    a_in, b_in = np.bincount(ga), np.bincount(gb)
    a_to, b_to = np.cumsum(a_in), np.cumsum(b_in)
    ids, sep = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    a_at, b_at = np.arange(len(a)) + (b_to - b_in)[ga], np.arange(len(b)) + a_to[gb]
    ids[a_at], ids[b_at] = a, b
    sep[a_at[a_to - 1]], sep[b_at[b_to - 1]] = ord("|"), ord(";")
    flat, start, digits = t.digits
    ends = np.cumsum(digits[ids] + 1)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    number = np.ones(len(out), dtype=bool)
    number[ends - 1] = False
    out[ends - 1] = sep
    out[number] = _gathered(flat, start[ids], digits[ids])
    return out, np.diff(ends[b_at[b_to - 1]], prepend=0)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of ``n`` of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(n, at) if len(n) else n


def _fewer(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often), by group; in large groups equal ids are one row."""
    big = large[group]
    often = np.ones(len(ids), dtype=np.int64)
    if not big.any():
        return group, ids, often
    wide = int(ids.max()) + 1
    key, n = _summed(group[big] * wide + ids[big], often[big])
    group, ids, often = (np.concatenate(x) for x in ((group[~big], key // wide), (ids[~big], key % wide), (often[~big], n)))
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], often[order]


def links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, unit_of: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair ``a * wide + b``, how often) of all links, by unit and pair; a long group makes no more rows than it has
    id pairs, and they are listed ``LISTED`` or so at a time."""
    large = np.bincount(ga, minlength=len(unit_of)) * np.bincount(gb, minlength=len(unit_of)) > LARGE
    ag, ax, an = _fewer(ga, a, large)
    bg, bx, bn = _fewer(gb, b, large)
    b_in = np.bincount(bg, minlength=len(unit_of))
    b_first = np.cumsum(b_in) - b_in
    made, at, out = np.cumsum(b_in[ag]), 0, []
    while at < len(ag):
        to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + LISTED, side="right")))
        n = b_in[ag[at:to]]
        which = np.repeat(np.arange(at, to), n)
        other = np.repeat(b_first[ag[at:to]] - np.cumsum(n) + n, n) + np.arange(len(which))
        out.append(_summed((unit_of[ag[which]] << 32) | (ax[which] * wide + bx[other]), an[which] * bn[other]))
        at = to
    key, often = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 2
    if len(out) > 1:
        key, often = _summed(key, often)
    return key >> 32, key & 0xFFFFFFFF, often


class Units:
    """Units coded and aligned so far, in flat arrays: whether both tokenizers gave each back, its tokens, groups and links,
    its groups as text (each with ``;`` after it), and its distinct links' pairs with how often each is linked."""

    FIELDS = {"whole": bool, "n_a": np.int32, "n_b": np.int32, "n_groups": np.int32, "n_links": np.int64, "text_size": np.int32, "n_pairs": np.int32,
              "text": np.uint8, "pair": np.uint32, "often": np.int32}

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.binary())
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.empty(0, dtype=kind))

    def size(self) -> int:
        return self.words.nbytes + sum(getattr(self, name).nbytes for name in self.FIELDS)

    def numbers(self, found: pa.BinaryArray) -> np.ndarray:
        """The number of each unit; new ones are coded first."""
        at = pc.index_in(found, value_set=self.words)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        for first in range(0, len(new), LEARNED):
            some = new[first:first + LEARNED]
            known = len(self.words)
            order = self.learn(found.take(pa.array(some)))
            at[some[order]] = known + np.arange(len(some))
        return at

    def learn(self, new: pa.BinaryArray) -> np.ndarray:
        """Codes, aligns and adds units; gives the order in which they were added."""
        at, data = _flat(new)
        able = self.t.whole_words & (data[at[:-1]] == 32) & (np.diff(at) > 1)
        able &= _BEGINS[data[np.minimum(at[:-1] + 1, len(data) - 1)]] & _ends(data, at[1:] - 1)
        order = np.argsort(~able, kind="stable")
        new = new.take(pa.array(order))
        at, data = _flat(new)
        a, b, n_a, n_b, whole = self._coded(at, data, int(able.sum()))
        ga, gb = groups(self.t.a_size[a], self.t.b_size[b])
        n = len(new)
        a_in, b_in = np.bincount(ga), np.bincount(gb)
        unit_of = np.empty(len(a_in), dtype=np.int64)
        unit_of[ga] = np.repeat(np.arange(n), n_a)
        text, bytes_of = written_groups(self.t, a, b, ga, gb)
        unit, pair, often = links(a, b, ga, gb, unit_of, self.t.wide)
        more = {"whole": whole, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(unit_of, minlength=n), "n_links": np.bincount(unit_of, weights=a_in * b_in, minlength=n),
                "text_size": np.bincount(unit_of, weights=bytes_of, minlength=n), "n_pairs": np.bincount(unit, minlength=n), "text": text, "pair": pair, "often": often}
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.concatenate([getattr(self, name), more[name].astype(kind)]))
        self.words = pa.concat_arrays([self.words, new])
        return order

    def _coded(self, at: np.ndarray, data: np.ndarray, n_able: int) -> tuple[np.ndarray, ...]:
        """Ids of A and B of all units, how many each has, and whether both give it back (else it has none)."""
        n = len(at) - 1
        n_a, n_b, whole = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        ids: tuple[list, list] = ([], [])

        def text(i: int, j: int) -> str:
            return data[at[i]:at[j]].tobytes().decode()

        def alone(i: int, j: int) -> None:
            for k, (a, b, ok) in enumerate(self.t.code([text(k, k + 1) for k in range(i, j)]), i):
                whole[k] = ok
                if ok:
                    ids[0].append(a)
                    ids[1].append(b)
                    n_a[k], n_b[k] = len(a), len(b)

        # units that begin and end like those inside a text are coded one after the other, as a text
        edges = [0]
        while edges[-1] < n_able:
            edges.append(min(n_able, max(edges[-1] + 1, int(np.searchsorted(at, at[edges[-1]] + CODED)))))
        for first in range(0, len(edges) - 1, 4):
            some = list(zip(edges[first:first + 4], edges[first + 1:first + 5], strict=False))
            for (i, j), (a, b, ok) in zip(some, self.t.code([text(i, j) for i, j in some]), strict=True):
                to = at[i + 1:j + 1] - at[i]
                a_ends, b_ends = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
                a_to, b_to = np.searchsorted(a_ends, to, side="right"), np.searchsorted(b_ends, to, side="right")
                if ok and (a_ends[a_to - 1] == to).all() and (b_ends[b_to - 1] == to).all():
                    ids[0].append(a)
                    ids[1].append(b)
                    n_a[i:j], n_b[i:j] = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
                else:
                    alone(i, j)
        for i in range(n_able, n, 256):
            alone(i, min(n, i + 256))
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in ids)
        return a, b, n_a, n_b, whole


def _flat(items: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a binary array."""
    items = pa.concat_arrays([items])
    at = np.frombuffer(items.buffers()[1], dtype=np.int32)[items.offset:items.offset + len(items) + 1].astype(np.int64)
    data = np.frombuffer(items.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]] if len(items) else np.empty(0, dtype=np.uint8)
    return at - at[0], data


def _shut(x: np.ndarray) -> bytes:
    """Small whole numbers, compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _open(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def units(texts: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray]:
    """How many units each text has (empty texts: none), and the units of all, a blank before each text."""
    n, starts, size = [], [], 0
    for text in texts:
        at = np.concatenate([[0], cuts(np.frombuffer(b" " + text, dtype=np.uint8))]) if text else np.empty(0, dtype=np.int64)
        n.append(len(at))
        starts.append(at + size)
        size += len(text) + 1 if text else 0
    data = b"".join(b" " + t for t in texts if t)
    offsets = np.concatenate([*starts, [size]]).astype(np.int32)
    return np.array(n, dtype=np.int64), pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _block(u: Units, number: int, keys: list, texts: list[bytes], key_kind: pa.DataType) -> pa.RecordBatch:
    """The row of a block: what is known of its documents without the others, and its pairs."""
    size, own = units(texts)
    coded = own.dictionary_encode()
    if u.size() > REMEMBERED:
        u.forget()
    unit = u.numbers(coded.dictionary)[coded.indices.to_numpy()] if len(own) else np.empty(0, dtype=np.int64)
    n = len(keys)
    doc = np.repeat(np.arange(n), size)
    # a document of which a unit did not come back has no tokens
    bad = np.bincount(doc, weights=~u.whole[unit], minlength=n) > 0
    unit, size = unit[~bad[doc]], np.where(bad, 0, size)
    doc = np.repeat(np.arange(n), size)
    counts = [np.bincount(doc, weights=getattr(u, c)[unit], minlength=n).astype(np.int64) for c in _COUNTS]
    used, unit = np.unique(unit, return_inverse=True)
    n_pairs = u.n_pairs[used].astype(np.int64)
    first = np.cumsum(u.n_pairs.astype(np.int64)) - u.n_pairs
    pairs, local = np.unique(_gathered(u.pair, first[used], n_pairs), return_inverse=True)
    often_of, first = _gathered(u.often, first[used], n_pairs), np.cumsum(n_pairs) - n_pairs
    text_size = u.text_size.astype(np.int64)
    text_at, text_size = (np.cumsum(text_size) - text_size)[used], text_size[used]
    digests, held, in_doc, gap, often = [], np.zeros(len(pairs), dtype=np.int64), [], [], []
    for i, to in zip((np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True):
        h, linked = hashlib.sha256(), np.zeros(len(pairs))
        for at in range(i, to, JOINED):
            x = unit[at:min(to, at + JOINED)]
            text = _gathered(u.text, text_at[x], text_size[x])
            h.update(text[:len(text) - (at + JOINED >= to)].tobytes())  # no ; after the last
            which = np.repeat(first[x] - np.cumsum(n_pairs[x]) + n_pairs[x], n_pairs[x]) + np.arange(n_pairs[x].sum())
            linked += np.bincount(local[which], weights=often_of[which], minlength=len(pairs))
        own = np.flatnonzero(linked)
        held[own] += 1
        in_doc.append(len(own))
        gap.append(np.diff(own, prepend=0))
        often.append(linked[own])
        digests.append(h.hexdigest() if to > i else "")
    packed = [_shut(np.array(in_doc)), _shut(np.concatenate(gap)), _shut(np.concatenate(often))]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([keys], pa.list_(key_kind)), *(pa.array([c.tolist()], pa.list_(pa.int64())) for c in counts), pa.array([digests], pa.list_(pa.string())),
         *(pa.array([x], pa.binary()) for x in packed), pa.array([pairs.astype(np.int64)], pa.list_(pa.int64())), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))],
        names=["block", "keys", *_COUNTS, "digests", "sizes", "gaps", "often", "pairs", "held"])


def _blocked(a_path: str, b_path: str, key_kind: pa.DataType):
    """Batches of (key, text) to blocks of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Units(Tokenizers(a_path, b_path))
        number = TaskContext.get().partitionId() << 24
        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BLOCK:
                    yield _block(u, number, keys, texts, key_kind)
                    number += 1
                    keys, texts, size = [], [], 0
        if keys:
            yield _block(u, number, keys, texts, key_kind)
    return released(run)


def _finished(name: str, key_kind: pa.DataType):
    def run(counted: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        at = counted["at"].to_numpy()
        count, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        count[at], best[at] = counted["c"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
        for row in blocks.to_pylist():
            in_doc, pair, often = _open(row["sizes"]), _open(row["gaps"]), _open(row["often"])
            starts = (np.cumsum(in_doc) - in_doc)[in_doc > 0]
            total = np.cumsum(pair)
            pair = total - np.repeat((total - pair)[starts], in_doc[in_doc > 0])
            n_best, count_sum = np.zeros(len(in_doc), dtype=np.int64), np.zeros(len(in_doc), dtype=np.int64)
            if len(starts):
                n_best[in_doc > 0] = np.add.reduceat(best[pair] * often, starts)
                count_sum[in_doc > 0] = np.add.reduceat(count[pair] * often, starts)
            out.append(pa.table([pa.array(row["keys"], key_kind), *(pa.array(row[c], pa.int64()) for c in _COUNTS), pa.array(n_best), pa.array(count_sum),
                                 pa.array(row["digests"], pa.string())], names=["key", *_COUNTS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)
    return run


def align_documents(docs: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """One row a document: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` (a byte-level vocabulary) and ``b_path`` (a sentencepiece model) are files that every executor can read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    import sentencepiece

    wide = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    kind, key_kind = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    schema = (f"block long, keys array<{kind}>, " + ", ".join(f"{c} array<long>" for c in _COUNTS)
              + ", digests array<string>, sizes binary, gaps binary, often binary, pairs array<long>, held array<int>")
    blocks = written(docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(_blocked(a_path, b_path, key_kind), schema))
    local = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("block", "at", "x.pairs", "x.held")
    found = written(local.select("block", "at", F.expr(f"cast(pairs div {wide} as int)").alias("a"),
                                 F.sum("held").over(W.Window.partitionBy("pairs")).alias("c")))
    top = found.groupBy("a").agg(F.max("c").alias("top"))
    # at most a row an id of A's vocabulary
    counted = found.join(F.broadcast(top), "a").select("block", "at", "c", (F.col("c") == F.col("top")).alias("best"))
    rows = counted.groupBy("block").cogroup(blocks.drop("pairs", "held").groupBy("block"))
    return rows.applyInArrow(_finished(key, key_kind), f"key {kind}, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
                             + ", groups_sha256 string").withColumnRenamed("key", key)
