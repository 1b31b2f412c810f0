"""Near-duplicates and line dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from demandlens.llm import line_dedup, near_dups
from demandlens.llm.common import components


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def bag(text, n=5):
    w = (text or "").encode().split()
    n = min(n, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(texts):
    """Class (smallest key) of every key: weighted Jaccard of 0.8 or more, transitively."""
    bags, found = {k: bag(t) for k, t in texts.items()}, Union(texts)
    where = defaultdict(list)
    size = {k: sum(b.values()) for k, b in bags.items()}
    blank = [k for k in texts if not size[k]]
    for k in blank[1:]:
        found.link(blank[0], k)
    for k, b in bags.items():
        common = Counter()
        for s, n in b.items():
            for j, m in where[s]:
                common[j] += min(n, m)
            where[s].append((k, n))
        for j, c in common.items():
            if c >= 0.8 * (size[k] + size[j] - c):
                found.link(k, j)
    return {k: found.root(k) for k in texts}


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (20, 21)] + [(100, 100 + i) for i in range(1, 40)] + [(300 + i, 301 + i) for i in range(30)]
    found = Union({x for p in pairs for x in p})
    for a, b in pairs:
        found.link(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {x: found.root(x) for x in found.up}


def test_signatures_estimate_weighted_jaccard():
    words = near_dups._Words()
    draw = random.Random(1)
    a = [f"w{draw.randrange(60)}" for _ in range(400)]
    b = a[:340] + [f"v{i}" for i in range(60)]
    bags = [near_dups.shingles(" ".join(x).encode(), words, 1) for x in (a, b)]
    ca, cb = Counter(a), Counter(b)
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    sign = near_dups.signatures(bags, 4000)
    assert abs((sign[0] == sign[1]).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5


def test_signature_does_not_depend_on_company():
    words = near_dups._Words()
    texts = [b"x", b"a b c d e f g", b" ".join(b"w%d" % (i % 7) for i in range(500)), b" ".join(b"z%d" % i for i in range(3000))]
    bags = [near_dups.shingles(t, words) for t in texts]
    together = near_dups.signatures(bags)
    for i, b in enumerate(bags):
        assert (near_dups.signatures([b])[0] == together[i]).all()


def near_texts():
    draw = random.Random(7)
    base = [[f"w{draw.randrange(300)}" for _ in range(120)] for _ in range(6)]
    out = []
    for _ in range(160):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(w))
    out += [None, "", " \n\t ", "one", "one", "one two", "a b c d e", "a  b\nc d e", "é à", " ".join(f"w{i % 9}" for i in range(30000))]
    return dict(enumerate(out))


def test_near_duplicates_match_brute_force(spark):
    texts = near_texts()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(rows, "doc_id", "text").collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_on_the_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r.class_id for r in near_dups.classes(rows, "doc_id", "text").collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_keep_one_row_of_a_class(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (None, "z y", 4), (None, "z  y", 5), (3, None, 6), (4, "", 7), (5, "q", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "digest")
    got = near_dups.kept(docs, "doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert got[0].asDict().keys() == {"doc_id", "text", "digest"}
    assert near_dups.kept(docs.limit(0), "doc_id", "text").count() == 0
    assert near_dups.classes(docs.limit(0), "doc_id", "text").count() == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(draw, text, n, letters):
    c = list(text)
    for _ in range(n):
        i, how = draw.randrange(len(c) + 1), draw.choice("ids")
        if how == "i" or not c:
            c.insert(i, draw.choice(letters))
        elif how == "d":
            del c[i % len(c)]
        else:
            c[i % len(c)] = draw.choice(letters)
    return "".join(c)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    draw = random.Random(threshold)
    pairs = [("", ""), ("a", ""), ("", "ab")]
    for _ in range(200):
        a = "".join(draw.choice("abé😀 ") for _ in range(draw.randrange(15)))
        pairs.append((a, changed(draw, a, draw.randrange(5), "abé😀")))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.distance(F.col("a"), F.col("b"), threshold)).collect()
    for r in got:
        d = edits(r.a, r.b)
        assert r.d == (d if d <= threshold else None)


def test_banded_distance_of_a_changed_stretch(spark):
    """As many errors as the registered query's stretch has characters."""
    draw = random.Random(16)
    pairs = [("", ""), ("a" * 17, ""), ("", "é" * 16)]
    for _ in range(120):
        a = "".join(draw.choice("abé😀 ") for _ in range(draw.randrange(110)))
        pairs.append((a, changed(draw, a, draw.randrange(24), "abé😀")))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.distance(F.col("a"), F.col("b"), line_dedup.STRETCH)).collect()
    for r in got:
        d = edits(r.a, r.b)
        assert r.d == (d if d <= line_dedup.STRETCH else None)


def test_registered_query_verifies_by_the_automaton(spark, tmp_path, monkeypatch):
    from demandlens.llm import queries

    base = "this line of text is longer than twenty-five characters and has one word that is changed"
    docs = [(1, base), (2, base.replace("twenty-five", "forty")), (3, base.replace("text", "words").replace("one", "a").replace("is longer", "has more"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run, asked = line_dedup.distance, []
    monkeypatch.setattr(line_dedup, "distance", lambda a, b, threshold: asked.append(threshold) or run(a, b, threshold))
    got = {r.doc_id: r.class_doc_id for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and set(asked) == {line_dedup.STRETCH}
    monkeypatch.setattr(line_dedup, "distance", lambda a, b, threshold: F.lit(None).cast("int"))
    got = {r.doc_id: r.class_doc_id for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def brute_lines(docs, threshold, least):
    own = [(k, i, x.strip(" \t\r\x0b\x0c")) for k, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    own = [x for x in own if len(x[2]) >= least]
    texts = sorted({x[2] for x in own})
    found = Union(texts)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                found.link(a, b)
    first = {}
    for k, i, x in sorted(own):
        first.setdefault(found.root(x), (k, i))
    return {(k, i): first[found.root(x)] for k, i, x in own}


@pytest.mark.parametrize(("threshold", "wide"), [(1, 128), (1, 3), (2, 128), (2, 3)])
def test_line_classes_match_brute_force(spark, monkeypatch, threshold, wide):
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    draw = random.Random(5)
    base = ["item %08d in the list" % draw.randrange(10**8) for _ in range(25)]
    docs = [(k, "\n".join(changed(draw, draw.choice(base), draw.choice([0, 0, 1, 1, 2]), "0123x") for _ in range(6))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "short"), (103, "ab" * 20000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line) for r in line_dedup.Lines(rows, "doc_id", "text", threshold, 12).classes().collect()}
    assert got == brute_lines(docs, threshold, 12)


def in_one_stretch(a, b, stretch):
    if len(a) > len(b):
        a, b = b, a
    agree = len(b) - min(stretch, len(b) // 3)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    s = next((i for i in range(len(a)) if a[len(a) - 1 - i] != b[len(b) - 1 - i]), len(a))
    return min(p + s, len(a)) >= agree


def brute_stretch(docs, stretch, least):
    own = [(k, i, x.strip(" \t\r\x0b\x0c")) for k, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    own = [x for x in own if x[2]]
    texts = sorted({x[2] for x in own})
    found = Union(texts)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if min(len(a), len(b)) >= least and in_one_stretch(a, b, stretch):
                found.link(a, b)
    first, n = {}, Counter(found.root(x) for x in texts)
    for k, i, x in sorted(own):
        first.setdefault(found.root(x), (k, i))
    return {(k, i): (*first[found.root(x)], n[found.root(x)]) for k, i, x in own}


@pytest.mark.parametrize(("stretch", "wide"), [(16, 128), (16, 3), (5, 3), (2, 2)])
def test_lines_with_one_changed_stretch_match_brute_force(spark, monkeypatch, stretch, wide):
    monkeypatch.setattr(line_dedup, "WIDE_STRETCH", wide)
    draw = random.Random(stretch * 100 + wide)
    words = ["alpha", "be", "gamma", "deltaé", "of", "the", "universe", "x" * 11, "y" * 17]
    base = [" ".join(draw.choice(words) for _ in range(draw.randrange(3, 12))) for _ in range(12)]

    def near(text):
        w = text.split(" ")
        for _ in range(draw.choice([0, 1, 1, 1, 2])):
            i = draw.randrange(len(w))
            w[i:i + draw.randrange(2)] = [draw.choice(words)] * draw.randrange(2)
        return " ".join(w) + draw.choice(["", "", ".", " 12345"])
    docs = [(k, "\n".join(near(draw.choice(base)) for _ in range(6))) for k in range(45)]
    docs += [(100 + i, f"item number {i:05d} of this long list of alike lines") for i in range(40)]
    docs += [(200, None), (201, ""), (202, "short"), (203, "short\n\nshort "), (204, "ab" * 20000), (205, "ab" * 20000 + "c"), (206, "é" * 24), (207, "é" * 25), (208, "é" * 26)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"line": F.lit(1), "node": F.lit("n"), "bucket": F.lit(2)})
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.class_texts) for r in line_dedup.Lines(rows, "doc_id", "text", short=True, stretch=stretch).classes().collect()}
    assert got == brute_stretch(docs, stretch, 25)
    assert line_dedup.Lines(rows.limit(0), "doc_id", "text", short=True, stretch=stretch).classes().count() == 0


def test_wide_buckets_are_cut_without_a_row_for_each_length(spark, monkeypatch):
    """Near copies of one line, of many lengths: the rows of the buckets stay a small multiple of the lines."""
    draw = random.Random(11)
    words = [f"word{draw.randrange(10**5)}" for _ in range(60)]
    texts = []
    for _ in range(200):
        w = list(words)
        for _ in range(2):
            w[46 + draw.randrange(14)] = "z" * draw.randrange(1, 12)
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    made, run = [], line_dedup.Lines._shared

    def counted(rows, many=False):
        out = run(rows, many)
        made.append(out.count())
        return out
    monkeypatch.setattr(line_dedup.Lines, "_shared", staticmethod(counted))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.class_texts) for r in line_dedup.Lines(rows, "doc_id", "text", short=True, stretch=16).classes().collect()}
    assert got == brute_stretch(docs, 16, 25)
    assert max(made) <= 4 * len(docs)


def test_few_pairs_of_near_copies(spark, monkeypatch):
    """Copies of one line with changes in several places: few are paired, as few pairs differ in one stretch only."""
    draw = random.Random(13)
    words = [f"word{draw.randrange(10**5)}" for _ in range(60)]
    texts = []
    for _ in range(240):
        w = list(words)
        for _ in range(3):
            w[30 + draw.randrange(30)] = "z" * draw.randrange(1, 12)
        texts.append(" ".join(w))
    docs, met, run = list(enumerate(texts)), [], line_dedup._together

    def counted(*args):
        out = run(*args)
        met.append(out.count())
        return out
    monkeypatch.setattr(line_dedup, "_together", counted)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.class_texts) for r in line_dedup.Lines(rows, "doc_id", "text", short=True, stretch=16).classes().collect()}
    assert got == brute_stretch(docs, 16, 25)
    assert sum(met) <= 4 * len(docs)


def test_stretch_keys_meet(spark):
    """Any two lines with one changed stretch share a bucket, one of them in its own class."""
    draw, pairs = random.Random(9), []
    for _ in range(400):
        a = "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(25, 200)))
        i, cut = draw.randrange(len(a) + 1), draw.randrange(17)
        b = a[:i] + "".join(draw.choice("xyz") for _ in range(draw.randrange(17))) + a[i + cut:]
        if min(len(a), len(b)) >= 25 and in_one_stretch(a, b, 16):
            pairs.append((a, b))
    assert len(pairs) > 200
    keys = lambda c: line_dedup.stretch_keys(F.col(c), F.char_length(c), 16)
    for r in spark.createDataFrame(pairs, "a string, b string").select(keys("a").alias("ka"), keys("b").alias("kb")).collect():
        a, b = ({x: i >= 4 for i, x in enumerate(k)} for k in (r.ka, r.kb))
        assert any(not (a[k] and b[k]) for k in a.keys() & b.keys())


def test_documents_without_repeated_lines(spark):
    long = "this line has well over twenty-five characters"
    docs = [(1, f"{long}\nshort\n{long}!", 0, 9), (2, f"short\n{long}", 0, 9), (3, long, 0, 9), (3, long, 1, 9), (4, None, 0, 9), (5, "", 0, 9),
            (None, f"{long}\nanother line that stands in no other document", 0, 9), (6, "own text of this document, unlike all others", 0, 9)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, row int, n_chars int")
    got = sorted(line_dedup.Lines(rows, "doc_id", "text").documents().collect(), key=str)
    kept = sorted([(1, f"{long}\nshort"), (2, "short"), (4, None), (5, ""), (6, docs[7][1]), (None, "another line that stands in no other document")], key=str)
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == kept
    assert {r.doc_id: r.n_chars for r in got}[1] == len(f"{long}\nshort") and {r.doc_id: r.n_chars for r in got}[6] == 9
    assert line_dedup.Lines(rows.limit(0), "doc_id", "text").documents().count() == 0


def test_lines_of_a_table_with_near_copies(spark, tmp_path):
    """The registered query and its SQL on a table into which lines with one changed word are planted."""
    import duckdb

    from demandlens.llm import queries
    from tests.oracle_check import compare

    draw = random.Random(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    lines = [x for _, t in docs for x in t.split("\n") if 40 < len(x) < 400][:60]
    planted = 0
    for i, line in enumerate(lines):
        w = line.split(" ")
        at = draw.randrange(len(w))
        if len(w[at]) > 12:
            continue
        w[at] = draw.choice(["changed", "other", "ab"])
        planted += 1
        docs.append((100_000 + i, " ".join(w)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES["op7_line_dedup"](spark, str(tmp_path))
    got = df.collect()
    by = {(r.doc_id, r.line): r for r in got}
    caught = sum(by[k, 0].class_doc_id < 100_000 for k, _ in docs if k >= 100_000)
    assert planted > 40 and caught >= 0.95 * planted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(queries.ORACLES["op7_line_dedup"])
    assert compare([tuple(r) for r in got], df.columns, res.fetchall(), [d[0] for d in res.description]) is None


def test_short_equal_lines(spark):
    long = "this line has well over twenty-five characters"
    docs = [(1, f"All rights reserved.\n\n{long}\nAll rights reserved."), (2, f" All rights reserved.\n{long}!\n \nAll rights reserved"),
            (3, "All rights reserved."), (4, "x"), (5, "own"), (6, "x\n\ny")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {1: f"All rights reserved.\n\n{long}", 2: " \nAll rights reserved", 4: "x", 5: "own", 6: "\ny"}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, rows, "").collect()} == kept
    got = {(r.doc_id, r.line): (r.class_doc_id, r.class_line, r.kept) for r in line_dedup.Lines(rows, "doc_id", "text", short=True).classes().collect()}
    assert got[2, 0] == (1, 0, False) and got[2, 3] == (2, 3, True) and got[6, 0] == (4, 0, False) and len(got) == 11


def test_bands_differ_by_place():
    sign = np.zeros((1, near_dups.COMPONENTS), dtype=np.uint64)
    assert len(set(near_dups.bands(sign)[0].tolist())) == near_dups.BANDS
