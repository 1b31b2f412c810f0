"""Quality field, language model and quality rules."""

import itertools
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import crf, lbl, queries, rules

SMALL = "/root/testdata/sf0.01"

ODD = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "one"), (4, "one"), (None, "two words"), (5, "É è x y\x1cz"), (6, "#*$ %&|<> !!"),
       (7, "x " * 50_000), (8, "same line here\nsame line here\nsame line here"), (9, "a b c d e f a b c d e f")]


@pytest.fixture
def odd(spark):
    """Nulls, blanks, repeats, a very long text, and columns whose names operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"key": F.lit(1), "score": F.lit("x"), "doc": F.lit(None).cast("int"), "failed": F.lit(0), "row": F.lit(2), "n_words": F.lit(3)})


def test_marginals_match_enumeration():
    draw = np.random.default_rng(0)
    n_lines, pairs = np.array([3, 1, 4]), draw.normal(size=(2, 2))
    score = draw.normal(size=8)
    good, joint, log_z = crf.marginals(score, pairs, n_lines)
    at, want_joint, want_z = 0, np.zeros((2, 2)), 0.0
    for n in n_lines:
        ways = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([math.exp(sum(score[at + i] * y for i, y in enumerate(ys)) + sum(pairs[a, b] for a, b in itertools.pairwise(ys))) for ys in ways])
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(x for x, ys in zip(w, ways, strict=True) if ys[i]) / w.sum())
        for x, ys in zip(w, ways, strict=True):
            for a, b in itertools.pairwise(ys):
                want_joint[a, b] += x / w.sum()
        want_z += math.log(w.sum())
        at += n
    assert joint == pytest.approx(want_joint)
    assert log_z == pytest.approx(want_z)


def test_field_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality_crf"](spark, SMALL).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    held = [(q, r) for q, r in labels if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.97


def test_field_on_odd_rows(spark, odd):
    field = crf.train(*crf.measures([b"good line of text", b"### $$$ %%%"])[::2], np.array([1, 0]), 20)
    got = crf.score(odd, "text", field).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() == set(odd.columns)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in crf.score(odd, "text", None).collect()} == {0.5}
    assert crf.score(odd.limit(0), "text", field).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert crf.fit(odd, "doc_id", "text", none) is None
    assert crf.fit(odd, "doc_id", "text", spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 1)], "doc_id long, quality int")) is None


def test_repeated_labels_count_once(spark, odd):
    kinds = "doc_id long, quality int"
    twice = crf.fit(odd, "doc_id", "text", spark.createDataFrame([(7, 1), (7, 0), (7, 0), (8, 1), (8, 1)], kinds))
    once = crf.fit(odd, "doc_id", "text", spark.createDataFrame([(7, 0), (8, 1)], kinds))
    assert twice.weights == pytest.approx(once.weights) and twice.pairs == pytest.approx(once.pairs)


def test_unlabelled_inputs_do_not_change_scores(spark):
    texts = [b"a line of words\nand one more", b"A!! B!! C!!"]
    field = crf.train(*crf.measures(texts)[::2], np.array([1, 0]), 20)
    alone = [field.scores([t])[0] for t in texts]
    assert field.scores(texts) == pytest.approx(alone)


def base_scores(rows):
    words = {k: [*(t or "").encode().lower().split(), None] for k, t in rows}
    counts = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, types = sum(counts.values()), len(counts)
    return {k: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (types + 1))) for w in ws)) for k, ws in words.items()}


def test_language_model_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op9_lbl_scores"](spark, SMALL).collect()}
    for k, (n, known, total, base) in base_scores(rows).items():
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (n, known, total)
        assert got[k].base_score == pytest.approx(base, abs=1e-6)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)


def test_language_model_is_normalised():
    prior = np.random.default_rng(1).random(lbl.CLASSES)
    prior[lbl.START] = 0
    model = lbl.Model(prior / prior.sum())
    first, second, norm = model.tables()
    for c, d in ((0, 0), (5, 0), (300, 17), (lbl.CLASSES - 1, 2)):
        assert np.exp(first[c] + second[d] - norm[c, d]).sum() == pytest.approx(1)
    # within the classes: counts of seen words and one unknown word make up the mass
    counts = lbl.Counts(10, 3, 2, {b"a": 6}, {lbl.shared_class(b"b"): (4, 5.0)})
    assert counts.mass[lbl.shared_class(b"b")] == 5.5 and counts.mass[2] == 6.5 and counts.prior.sum() == pytest.approx(1)


def test_training_steps_climb():
    draw = np.random.default_rng(0)
    stream = np.array([2, 3, 4] * 400 + [1], dtype="<u2")
    prior = np.bincount(stream, minlength=lbl.CLASSES) + 0.5
    prior[lbl.START] = 0
    prior = prior / prior.sum()
    model, one_two = lbl.Model(prior), lbl.contexts(stream.copy(), np.array([len(stream)]))
    squares = [np.full_like(p, 1e-8) for p in model.parts()]
    for _ in range(60):
        at = draw.integers(0, len(stream), 256)
        noise = draw.choice(lbl.CLASSES, lbl.NOISE, p=prior)
        lbl.learn(model, squares, prior, stream[at], one_two[0][at], one_two[1][at], noise)
    first, second, norm = model.tables()
    after = (first[one_two[0], stream] + second[one_two[1], stream] - norm[one_two]).mean()
    assert after > np.log(prior[stream]).mean() + 0.5


def test_passes_train_on_every_token_once(monkeypatch):
    sizes, train = np.array([3000, 200, 1800]), [True, False, True]
    stream, seen = np.arange(5000, dtype="<u2"), []
    row = pa.RecordBatch.from_arrays([pa.array([train]), pa.array([lbl._shut(sizes)], pa.binary()), pa.array([lbl._shut(stream)], pa.binary())],
                                     names=["train", "sizes", "stream"])
    monkeypatch.setattr(lbl, "learn", lambda model, squares, prior, target, *rest: seen.append(target))
    monkeypatch.setattr(lbl, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    prior = np.full(lbl.CLASSES, 1 / lbl.CLASSES)
    for turn in range(lbl.PASSES):
        list(lbl._trained(prior, lbl.Model(prior).flat(), turn)(iter([row])))
    assert sorted(np.concatenate(seen)) == [*range(3000), *range(3200, 5000)]


def test_language_model_on_odd_rows(spark, odd):
    got = lbl.score(odd, "doc_id", "text", F.lit(False)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[7] == 50_001 and {r.doc_id: r.n_tokens for r in got}[1] == 1
    assert lbl.score(odd.limit(0), "doc_id", "text", F.lit(False)).count() == 0
    untrained = lbl.score(odd, "doc_id", "text", F.lit(True)).collect()
    assert {r.n_known for r in untrained} == {0} and {r.base_score for r in untrained} == {0.0}


def simple_measures(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(b"".join(words).count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_ledger(spark, odd):
    got = rules.ledger(odd, "doc_id", "text").collect()
    want = sorted([(k is None, k or 0, *simple_measures(t)) for k, t in ODD])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert rules.ledger(odd.limit(0), "doc_id", "text").count() == 0


def test_ablations_count_the_ledger(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (2,), (5,), (4,)], "failed long")
    got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in rules.ablations(rows, "base").collect()}
    assert got == {"few_words": (4, 3, 5), "repeated_windows": (2, 1, 3)}
