"""Packing, mixing, licence scan, top-k search, sharding, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from demandlens.llm import licences, mixing, packing, queries, sharding, topk
from demandlens.llm.common import read

SMALL = "/root/testdata/sf0.001"
ODD = ["", "  a  b ", "it's don't DON'T", None, "x<|endoftext|>y <|startoftext|>", "ab cd e\tf\x0bg", "İstanbul ΣΑΣ Σ 한국 été ́x", "a1b2 3.14 foo--bar!!! '' ' ''s",
       "...\n\n!!", "ﬁn ª º ² ½", "日本語テスト。です", " ̈a", "words " * 30_000, "same", "same"]


def test_packing_round_trip(spark):
    small = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = ODD + small
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit(0), "start": F.lit(1), "ids": F.lit("x")})
    got = packing.pack(docs, "doc_id", "text", queries.tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    for k, text in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r.ids] == ids
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens, 1 << r.bucket) == (at, len(ids), r.length) and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
            at += r.length
    assert packing.pack(docs.limit(0), "doc_id", "text", queries.tokenizer_path()).count() == 0


def test_cuts_are_the_binary_digits():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        assert sum(packing.cuts(n, 64)) == n and all(x == 64 or x < 64 and not x & (x - 1) for x in packing.cuts(n, 64))
        assert packing.cuts(n, 64) == sorted(packing.cuts(n, 64), reverse=True)
    row, start, length = packing.pieces(np.array([5, 0, 200, 64, 1]), 64)
    assert list(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)) == [
        (0, 0, 4), (0, 4, 1), (2, 0, 64), (2, 64, 64), (2, 128, 64), (2, 192, 8), (3, 0, 64), (4, 0, 1)]


def test_buckets_are_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, "doc_id", "text", queries.tokenizer_path()), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("bucket = 3").count() == 1


def level_targets(sizes, share=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if part[s] >= repeats * sizes[s]]
        if not full:
            return out | part
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
            open_.remove(s)
        if not open_:
            return out


def test_mix_meets_targets(spark):
    rows = read(spark, "/root/testdata/sf0.01", "documents").withColumn("row", F.lit(1)).withColumn("taken", F.lit("x"))
    rows = rows.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    m = mixing.Mix(rows, "doc_id", "text", "source", with_texts=True)
    got = m.documents().collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in rows.collect()}
    sizes = {}
    for r in got:
        assert r.size == words[r.doc_id] and r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = level_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {round(r.target, 6) for r in own} == {round(want[s], 6)} and {r.source_size for r in own} == {sizes[s]}
        assert sum(r.taken for r in own) == pytest.approx(want[s], rel=0.02)
    again = mixing.Mix(rows, "doc_id", "text", "source").documents().collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    texts = m.texts().collect()
    of = {r.doc_id: r.text for r in rows.collect()}
    total = {}
    for r in texts:
        total[r.doc_id] = total.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert total == {r.doc_id: r.taken for r in got if r.taken}
    # the runs that are taken stand in the document
    for r in texts[:200]:
        plain = " " + " ".join(x.decode() for x in of[r.doc_id].encode().split()) + " "
        assert r.text == of[r.doc_id] or all(f" {run} " in plain for run in r.text.split("\n"))


def test_mix_shards_draw_whole_parts_and_the_rest(spark):
    docs = spark.createDataFrame([(i, "w " * 40, f"s{i % 7}") for i in range(700)], "doc_id long, text string, source string")
    m = mixing.Mix(docs, "doc_id", "text", "source", block=8, shard_slots=500)
    per_shard = {r.shard: r.n for r in m.counts.groupBy("shard").agg(F.sum("count").alias("n")).collect()}
    assert len(per_shard) == 11 and {per_shard[i] for i in range(10)} == {500}
    got = m.documents().groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.02) for r in got)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit("a")).alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))
        assert n < 1000 or [r.x for r in rows] != list(range(n))


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "w " * 100_000, "c")],
                                 "doc_id long, text string, source string").withColumn("sid", F.lit(1))
    got = mixing.Mix(docs, "doc_id", "text", "source", with_texts=True)
    rows = got.documents().collect()
    assert len(rows) == 6 and all(r.taken <= 2 * r.size for r in rows)
    assert got.texts().columns == docs.columns
    for n in (0, 1):
        few = mixing.Mix(docs.where("doc_id = 1").limit(n), "doc_id", "text", "source", with_texts=True)
        assert few.documents().count() == n and few.texts().count() == 0


def test_licences_in_other_dress(spark):
    mit = licences.KNOWN["MIT"][1]
    docs = [(1, "Copyright (c) 2020 Jane Doe\n" + mit.upper().replace(". ", ".\n\n")), (2, "  * All rights reserved.\n" + mit + "\n// © 2021 Them"),
            (3, mit + " and more"), (4, "Some text.\nReleased under the MIT Licence!\nSPDX-License-Identifier: apache-2.0\nreleased under the mit license"),
            (5, None), (6, ""), (7, "x " * 100_000), (4, "...")]
    got = licences.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)), "doc_id", "text").collect()
    found = sorted((r.doc_id, r.licence or "", r.notices) for r in got)
    assert found == sorted([(1, "MIT", ""), (2, "MIT", "MIT"), (3, "", ""), (4, "", "Apache-2.0,MIT"), (5, "", ""), (6, "", ""), (7, "", ""), (4, "", "")])
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_licences_of_common_kinds_and_blocks(spark):
    import textwrap

    mit = licences.KNOWN["MIT"][1].removeprefix("MIT License ")
    header = licences.KNOWN["Apache-2.0"][1].replace("at http", "at\n#\n#   http").replace(" Unless", "\n#\n# Unless")
    docs = [(1, "Some article.\nLicensed under CC BY-NC 4.0."), (2, "The MIT License (MIT)\n\nCopyright (c) 2020 Me\n\n" + mit), (3, mit)]
    docs += [(10 + i, text) for i, text in enumerate(licences.BODIES.values())]
    docs += [(20, licences.KNOWN["BSD-3-Clause"][-30]), (21, "Tool\n\n" + "\n".join(textwrap.wrap(mit, 70)) + "\n\nUsage"),
             (22, "# My tool\n#\n# " + header + "\n\nimport os"), (23, "About\n\n" + licences.BODIES["GPL-3.0"] + "\n\nMore"),
             (24, "About\n\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
             (25, "We like\n\nnot Licensed under CC BY-NC 4.0\nand other terms"), (26, "\n\n" * 100_000 + "x")]
    got = licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    found = {r.doc_id: (r.licence, r.notices) for r in got}
    assert [found[i] for i in (1, 21, 22, 23, 24)] == [(None, x) for x in ("CC-BY-NC-4.0", "MIT", "Apache-2.0", "GPL-3.0", "CC-BY-SA-4.0")]
    assert [found[i][0] for i in (2, 3, *range(10, 10 + len(licences.BODIES)))] == ["MIT", "MIT", *licences.BODIES]
    assert found[20][0] and found[25] == (None, "") and found[26] == (None, "")


def brute_topk(rows, k):
    own = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in own), default=0)
    full = [(i, [int(x) for x in v] + [0] * (width - len(v))) for i, v in own]
    out = []
    for at, (q, x) in enumerate(full):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for n, (i, v) in enumerate(full) if n != at)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("annulus", [4096, 16])
def test_topk_matches_brute_force(spark, monkeypatch, annulus):
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    monkeypatch.setattr(topk, "VISITS", 4)
    monkeypatch.setattr(topk, "GROUP", 2048 if annulus > 16 else 7)
    draw = random.Random(3)
    rows = [(i, [float(draw.randrange(-5, 6)) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(100)]
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (None, [1.0] * 6), (580, [2.0, 2.0]), (580, [1.0, 1.0]), (600, [])]
    docs = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("id", F.lit(1))
    got = topk.search(docs, "vec_id", F.col("v"), F.col("id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows, 5)


def test_topk_of_few_and_large(spark):
    def run(rows):
        return topk.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", F.col("v"), F.col("id") % 20 == 0, 5).collect()
    assert run([]) == []
    assert run([(20, [1.0])]) == []
    assert run([(1, [1.0]), (2, [1.0])]) == []
    # rows of one id are candidates and queries of their own
    assert [tuple(r) for r in run([(20, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [-9.0, 0.0]), (2, [2.0, 0.0])])] == [(20, 1, 1, 5), (20, 2, 2, 2), (20, 3, 1, -9)]
    assert sorted(tuple(r) for r in run([(20, [1.0]), (20, [3.0])])) == [(20, 1, 20, 3), (20, 1, 20, 3)]
    assert [tuple(r) for r in run([(20, [2.0**28, 1.0]), (1, [2.0**28, 3.0]), (2, [2.0**28, 2.0])])] == [(20, 1, 1, 2**56 + 3), (20, 2, 2, 2**56 + 2)]


def test_lookup_table():
    names = [f"shard-{i}" for i in range(13)]
    owner = sharding.lookup(names, 1009)
    held = [owner.count(i) for i in range(13)]
    assert sum(held) == 1009 and max(held) - min(held) <= 1
    fewer = sharding.lookup(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 12)
    assert moved < 0.1 * 1009
    for shards, size in ((names, 1000), (names, 11), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError, match=r"."):
            sharding.lookup(shards, size)


def test_placement_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a|b"), (None, None), (2, "x" * 100_000)], "doc_id long, source string").withColumn("slot", F.lit("q")).withColumn("shard", F.lit(0))
    got = sharding.place(rows, ["doc_id", "source"], ["a", "b", "c"], 31).collect()
    assert len(got) == 5 and all(0 <= r.shard < 3 for r in got)
    assert len({(r.slot, r.shard) for r in got if r.doc_id == 1}) == 1
    assert sharding.place(rows.limit(0), ["doc_id"], ["a"], 31).count() == 0


def test_pipeline_stages_follow_each_other(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    assert corpus_pipeline.run(spark, SMALL).count() == counts[5]


def test_pipeline_of_odd_tables(spark, tmp_path):
    odd = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "tiny", "en", "b", 4), (None, "words " * 50, "en", "b", 300)]
    for n, rows in (("none", []), ("odd", odd)):
        path = tmp_path / n
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("row", F.lit(1)).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(path)).collect()
        assert (n == "none") == (not got)


def test_whole_licences_in_a_table(spark, tmp_path):
    """The registered query and its SQL on a table with whole licence files and notices."""
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    docs += [(100_000 + i, text) for i, text in enumerate(licences.BODIES.values())]
    docs += [(200_000 + i, text.upper().replace(" ", "  ")) for i, text in enumerate(licences.BODIES.values())]
    docs += [(300_000, "Copyright (c) 2020 Them\n\n" + licences.KNOWN["MIT"][1]), (300_001, "x\nSPDX-License-Identifier: MIT\ny"), (300_002, None), (300_003, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES["op6_license_scan"](spark, str(tmp_path))
    got = df.collect()
    assert sum(r.licence is not None for r in got) == 2 * len(licences.BODIES) + 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(queries.ORACLES["op6_license_scan"])
    want = {r[0]: r for r in res.fetchall()}
    at = [d[0] for d in res.description].index("licence")
    assert all((want[r.doc_id][at] or None) == r.licence for r in got) and len(want) == len(got)
