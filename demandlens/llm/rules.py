"""Quality rules (4): a rule bitmask ledger.

One pass over the texts measures every document and evaluates every rule once; the ledger
keeps the measurements and one long with a bit per failed rule.  Policies are versioned sets
of rules (masks): applying one, or asking what it would keep without one of its rules, is
bitwise work on the ledger and never reads a text again.

Measurements (words are runs of anything but ASCII blanks, of the whole text): words, their
code points, symbols ``#*$%&|<>``, lines with a word that repeat an earlier line, words
inside five-word windows that occur twice or more in the text, words in capitals, words that
hold a letter.

Null text: as empty.  Empty texts have 0 everywhere and fail the rules on too few words.
Repeated rows get a ledger row each.  Rules with a ratio compare products, so that nothing
is divided by zero.  Very long texts are measured whole.  An empty table gives an empty
ledger; columns beyond key and text don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_caps_words",
            "n_letter_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rules by bit: a condition on the measurements that a bad text meets.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "capitals": "10 * n_caps_words > 4 * n_words",
    "no_letters": "10 * n_letter_words < 6 * n_words",
}
#: Versioned policies: the rules that a kept text must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
                dtype=np.uint64)


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words lying in a window of ``window`` words that occurs twice or more in ``ids``."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        key = np.zeros(n, dtype=np.uint64)
        for j in range(window):
            part = (ids[j:j + n].astype(np.uint64) + np.uint64(1)) * _MIX[j % len(_MIX)]
            part ^= part >> np.uint64(29)
            key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window:window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one whole text in UTF-8, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    points = np.frombuffer(joined, dtype=np.uint8)
    chars = int(len(points) - ((points & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    caps = letters = 0
    if n:
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        start = np.cumsum(size) - size
        upper = np.add.reduceat(((points >= 65) & (points <= 90)).astype(np.int32), start)
        lower = np.add.reduceat(((points >= 97) & (points <= 122)).astype(np.int32), start)
        other = np.add.reduceat((points >= 0x80).astype(np.int32), start)
        caps = int(((upper >= 2) & (lower == 0)).sum())
        letters = int(((upper + lower + other) > 0).sum())
    return (n, chars, len(_SYMBOL.findall(joined)), len(lines) - len(set(lines)), len(lines),
            repeated_window_words(ids), caps, letters)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
        cols = [pa.array(c, type=pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", *MEASURES])


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(name) for name in rules)


def ledger(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: ``key``, the measurements and ``failed`` (a bit per failed rule)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_measure_batches, schema)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed.cast("long")).withColumnRenamed("key", key)


def passes(policy: str) -> Column:
    """Whether a ledger row meets a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: how many rows it fails, fails alone, and would be kept without it."""
    rules = POLICIES[policy]
    bits = rows.select(F.col("failed").bitwiseAND(F.lit(mask(rules))).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).alias("bit")) for r in rules]))
    return (bits.select("f", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without")))
