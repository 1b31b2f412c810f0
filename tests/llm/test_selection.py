"""Importance resampling, language ID and tokenizer alignment."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import alignment, importance, language, queries

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

ODD = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "one"), (4, "one"), (None, "two words"), (5, "É è x y\x1cz  zwei   Wörter"), (6, "#*$ %&|<> !!"),
       (7, "x yz " * 50_000), (8, "same line here\nsame line here\n\n  same"), (9, "a b <s> c <|endoftext|> d e 　f"), (10, " leading and trailing  "),
       (11, "123 4567 a1b2 ²"), (12, "日本語 テキスト​ 👍🏽 ok"), (13, "=" * 5000), (14, "tab\tnew\r\nline \x00 nul \x7f")]


@pytest.fixture
def odd(spark):
    """Nulls, blanks, repeats, a very long text, and columns whose names operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"key": F.lit(1), "score": F.lit("x"), "block": F.lit(None).cast("int"), "rank": F.lit(0), "lang": F.lit("xx"), "bucket": F.lit(2), "n_words": F.lit(3)})


def listed(text, longest):
    """Words and features of a text, character by character."""
    words, now = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            now += c
        elif now:
            words.append(now)
            now = ""
    return words, Counter(" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))


def brute_resample(docs, targets, longest, percent, min_words, buckets=10_000):
    def hashed(texts):
        out = Counter()
        for t in texts:
            for f, n in listed(t, longest)[1].items():
                out[zlib.crc32(f.encode()) % buckets] += n
        return out
    s, t = hashed(x for _, x in docs), hashed(targets)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for k, text in docs:
        words, found = listed(text, longest)
        n = sum(found.values())
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] * c for f, c in found.items()) // n if n else 0
        head = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, n, weight, weight + math.floor(-1000 * math.log(-math.log((head + 0.5) / 4294967296))), len(words)])
    able = sorted((-r[3], r[0] is not None, r[0] or 0, r[1], i) for i, r in enumerate(rows) if r[4] >= min_words)
    rank = {x[-1]: j for j, x in enumerate(able[:len(able) * percent // 100], 1)}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(rows)]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_rows(spark, odd, longest, monkeypatch):
    targets = ["one two yz", None, "", "same line"]
    monkeypatch.setattr(importance, "PART", 7)
    got = importance.resample(odd, "doc_id", "text", spark.createDataFrame([(t,) for t in targets], "text string"), "text", longest, percent=60, min_words=1)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = brute_resample(ODD, targets, longest, 60, 1)
    assert in_order(got.collect()) == in_order(want)
    assert importance.resample(odd.limit(0), "doc_id", "text", odd, "text").count() == 0
    assert importance.resample(odd, "doc_id", "text", odd.limit(0), "text").count() == len(ODD)


def test_resampling_of_a_table(spark):
    got = queries.QUERIES["op11_importance_resampling"](spark, TINY).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    assert in_order(got) == in_order(brute_resample(docs, targets, 1, 10, 20))


def test_ranks_of_equal_rows(spark):
    rows = spark.range(10_000).select(F.lit(5).alias("score"), (F.col("id") % 3).alias("key"), F.col("id").alias("_row")).repartition(7)
    got = importance.ranked(rows, [F.col("score").desc(), F.col("key"), F.col("_row")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 10_001))
    assert [(r.key, r._row) for r in got] == sorted((r.key, r._row) for r in got)


def test_languages_of_a_table(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_language_id"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    held = [(d.lang, got[d.doc_id].lang_pred) for d in docs if got[d.doc_id].held_out and d.lang and any(map(str.isalpha, d.text or ""))]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.95


def brute_bayes(labelled, texts):
    """Counts n-grams of the cleaned texts one by one."""
    def grams(text):
        clean = "".join(c if (c.isalnum() and not c.isdecimal()) else " " for c in text.lower())
        clean = " ".join(clean.split(" ")).strip(" ")
        while "  " in clean:
            clean = clean.replace("  ", " ")
        if not any(map(str.isalpha, clean)):
            return None
        points = [ord(c) for c in f" {clean} "]
        out = []
        for i in range(len(points)):
            h = 0
            for n in range(language.LONGEST):
                if i + n < len(points):
                    h = (h * 0x01000193 + points[i + n] + n + 1) % 2**32
                    m = h * 0x9E3779B1 % 2**32
                    out.append(((m ^ (m >> 15)) >> 1) % language.BUCKETS)
        return out
    langs = sorted({x for x, _ in labelled})
    counts = {x: Counter(g for y, t in labelled if y == x for g in grams(t) or []) for x in langs}
    total = {x: sum(counts[x].values()) + language.SMOOTHING * language.BUCKETS for x in langs}
    rows = []
    for text in texts:
        own = grams(text or "")
        if own is None:
            rows.append(("und", 0.0))
            continue
        logs = [math.log(sum(y == x for y, _ in labelled) / len(labelled)) + sum(math.log((counts[x][g] + language.SMOOTHING) / total[x]) for g in own) for x in langs]
        best = max(range(len(langs)), key=lambda i: (logs[i], -i))
        rows.append((langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)))
    return rows


def test_languages_against_plain_counts(spark, odd, monkeypatch):
    labelled = [("b", "Der Hund und die Katze"), ("a", "the dog and the cat"), ("a", "a line, or two"), ("c", "12 3")]
    table = spark.createDataFrame([(x, t, True) for x, t in labelled] + [(None, "none", True), ("a", None, True), ("z", "left out", False)], "lang string, text string, use boolean")
    model = language.fit(table, "text", "lang", F.col("use"))
    assert model.langs == ["a", "b", "c"]
    texts = ["the cat", "die Katze!", "x", "", "  12", "Ünder Ære", "the dog and the cat " * 40]
    for characters in (1 << 19, 5):
        monkeypatch.setattr(language, "CHARACTERS", characters)
        lang, score = model.predict(texts)
        want = brute_bayes(labelled, texts)
        assert lang == [x for x, _ in want] and score == pytest.approx([s for _, s in want], abs=1e-4)
    rows = language.predict(odd, "doc_id", "text", model).collect()
    assert len(rows) == len(ODD) and [r.asDict().keys() == {"doc_id", "lang_pred", "score"} for r in rows]
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[1] == by[2] == by[3] == by[6] == by[13] == ("und", 0.0) and by[4][0] == "a" and 0 < by[7][1] <= 1
    assert language.fit(table.limit(0), "text", "lang", F.lit(True)) is None
    assert {(r.lang_pred, r.score) for r in language.predict(odd, "doc_id", "text", None).collect()} == {("und", 0.0)}
    assert language.predict(odd.limit(0), "doc_id", "text", model).count() == 0


def test_many_languages_fold_buckets(monkeypatch):
    counts = np.arange(language.BUCKETS * 2).reshape(-1, 2)
    monkeypatch.setattr(language, "MATRIX_BYTES", language.BUCKETS * 2)
    model = language.Model(["a", "b"], counts, np.array([1.0, 3.0]))
    assert model.matrix.shape == (language.BUCKETS // 4, 2) and np.exp(model.matrix.astype(float)).sum(0) == pytest.approx([1, 1], rel=1e-4)


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    of = alignment._byte_level()
    docs, counts = [], Counter()
    for key, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_tok.encode(text):
                p = b_tok.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = []
        groups, links = [], []
        i = j = 0
        while i < len(a):
            ga, gb, na, nb = [a[i]], [b[j]], len(a[i][1]), len(b[j][1])
            i, j = i + 1, j + 1
            while na != nb:
                if na < nb:
                    ga.append(a[i])
                    na += len(a[i][1])
                    i += 1
                else:
                    gb.append(b[j])
                    nb += len(b[j][1])
                    j += 1
            groups.append((ga, gb))
            links += [(x, y) for x, _ in ga for y, _ in gb]
        counts.update(set(links))
        text = ";".join(",".join(str(x) for x, _ in ga) + "|" + ",".join(str(y) for y, _ in gb) for ga, gb in groups)
        docs.append((key, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(k, na, nb, ng, len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), h) for k, na, nb, ng, ls, h in docs]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_a_table(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, TINY)
    assert got.columns == ALIGNED
    assert in_order(got.collect()) == in_order(brute_alignment(rows))


def test_alignment_of_odd_rows(spark, odd):
    got = alignment.align_documents(odd, "doc_id", "text", queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert in_order(got.collect()) == in_order(brute_alignment(ODD))
    assert alignment.align_documents(odd.limit(0), "doc_id", "text", queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_units_are_cut_where_both_tokenizers_have_an_edge(monkeypatch):
    t = alignment.Tokenizers(queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert t.whole_words
    more = ["a b\u00a0 c", "a\u3000 b \u3000c", "é è\u0301 \u0301x ÿ", "\u2003 a", "x\x85 y", "日 本 x", "end ", "a  b"]
    for part in (1 << 20, 3):
        monkeypatch.setattr(alignment, "PART", part)
        for text in [x for _, x in ODD if x and len(x) < 1000] + more:
            n, own = alignment.units([text.encode(), b"", b"x y"])
            own = [x.decode() for x in own.to_pylist()]
            assert n.tolist() == [len(own) - 2, 0, 2] and "".join(own) == f" {text} x y"
            whole, parts = next(t.code([" " + text])), list(t.code(own[:-2]))
            assert whole[2] == all(p[2] for p in parts)
            if whole[2]:
                assert whole[0].tolist() == [x for p in parts for x in p[0]] and whole[1].tolist() == [x for p in parts for x in p[1]]


def test_units_are_remembered_within_bounds(monkeypatch):
    u = alignment.Units(alignment.Tokenizers(queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")))
    texts = [b"one two one", b"", "zwei  Wörter, one".encode()]
    first = alignment._block(u, 1, [1, 2, 3], texts, pa.int64())
    known = len(u.words)
    assert alignment._block(u, 1, [1, 2, 3], texts, pa.int64()).equals(first) and len(u.words) == known
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    monkeypatch.setattr(alignment, "JOINED", 1)
    again = alignment._block(u, 1, [1, 2, 3], texts, pa.int64())
    assert again.equals(first)


def test_links_of_a_long_group(monkeypatch):
    a, b = np.array([3, 3, 5, 7, 3]), np.array([2, 2, 9, 1])
    ga, gb = np.array([0, 0, 0, 0, 1]), np.array([0, 0, 0, 1])
    want = ([0, 0, 0, 0, 0, 0, 1], [32, 39, 52, 59, 72, 79, 31], [4, 2, 2, 1, 2, 1, 1])
    for listed_at_a_time in (1, 3, 1000):
        for large in (1, 1000):
            monkeypatch.setattr(alignment, "LISTED", listed_at_a_time)
            monkeypatch.setattr(alignment, "LARGE", large)
            assert [x.tolist() for x in alignment.links(a, b, ga, gb, np.array([0, 1]), 10)] == list(want)
