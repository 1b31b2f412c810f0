"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, crf, importance, language, lbl, licences, line_dedup, mixing, near_dups, packing, rules, sharding, topk
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of binary lengths."""
    return packing.pack(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), with_ids=False)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policies ``base`` and ``v1``."""
    rows = rules.ledger(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumns({"base_failed": ~rules.passes("base"), "kept": rules.passes("v1")})


_MEASURES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS c
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM g, range(5) AS x(o) WHERE c >= 2 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_caps_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')))::BIGINT AS n_letter_words
      FROM w LEFT JOIN cov USING (r))
"""
ORACLES["op4_quality_rules"] = _MEASURES_SQL + "SELECT *, (failed & %d) <> 0 AS base_failed, failed = 0 AS kept FROM (SELECT *, CAST(%s AS BIGINT) AS failed FROM m)" % (
    rules.mask(rules.POLICIES["base"]),
    " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rules.RULES.values())))


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all other vectors."""
    # doubles of 2^53 and more are whole; beyond 64 bits floor() would not hold them
    whole = F.transform(F.transform("embedding", lambda x: x.cast("double") * 64), lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return topk.search(read(spark, sf_dir, "embeddings"), "vec_id", F.when(finite, whole), F.col("id") % 20 == 0, 20)


ORACLES["op5_exact_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their lines against the known licence texts."""
    return licences.scan(read(spark, sf_dir, "documents"), "doc_id", "text")


def _license_sql() -> str:
    texts = ", ".join("('{}', '{}')".format(t.replace("'", "''"), name) for name, own in licences.KNOWN.items() for t in own)
    return f"""
WITH known AS (SELECT md5({licences.canonical_sql('t')}) AS digest, min(licence) AS licence FROM (VALUES {texts}) k(t, licence) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) JOIN known ON md5({licences.canonical_sql('line')}) = digest GROUP BY r)
SELECT doc_id, x.digest, licence, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, md5({licences.canonical_sql('t')}) AS digest FROM d) x LEFT JOIN known k ON x.digest = k.digest LEFT JOIN n USING (r)
"""


ORACLES["op6_license_scan"] = _license_sql()


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents placed on the shards by their ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], [f"shard-{i}" for i in range(sharding.SHARDS)])


ORACLES["op10_sharding"] = f"""
WITH RECURSIVE p AS (SELECT i, ('0x' || substr(md5('shard-' || i), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS o,
                            ('0x' || substr(md5('shard-' || i), 16, 15))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 AS s
                     FROM range({sharding.SHARDS}) x(i)),
turns AS (
  SELECT 0 AS turn, list_transform(range({sharding.TABLE_SIZE}), lambda x: -1) AS owner,
         (SELECT list(o ORDER BY i) FROM p) AS o, (SELECT list(s ORDER BY i) FROM p) AS s, list_transform(range({sharding.SHARDS}), lambda x: 0) AS tried
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, j: CASE WHEN j = slot + 1 THEN turn % {sharding.SHARDS} ELSE x END), o, s,
         list_transform(tried, lambda x, j: CASE WHEN j = turn % {sharding.SHARDS} + 1 THEN nth + 1 ELSE x END)
  FROM (SELECT *, (o[turn % {sharding.SHARDS} + 1] + nth * s[turn % {sharding.SHARDS} + 1]) % {sharding.TABLE_SIZE} AS slot
        FROM (SELECT *, list_filter(range(tried[turn % {sharding.SHARDS} + 1], {sharding.TABLE_SIZE}),
                     lambda x: owner[(o[turn % {sharding.SHARDS} + 1] + x * s[turn % {sharding.SHARDS} + 1]) % {sharding.TABLE_SIZE} + 1] = -1)[1] AS nth FROM turns
              WHERE turn < {sharding.TABLE_SIZE}))),
owners AS (SELECT generate_subscripts(owner, 1) - 1 AS slot, unnest(owner) AS shard FROM turns WHERE turn = {sharding.TABLE_SIZE}),
k AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, k.slot, CAST(shard AS INTEGER) AS shard FROM k JOIN owners ON k.slot = owners.slot
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all documents takes of each."""
    return mixing.Mix(read(spark, sf_dir, "documents"), "doc_id", "text", "source").documents()


def quality_field(docs: DataFrame, spark: SparkSession, sf_dir: str) -> crf.Field | None:
    """The quality field, from labels outside the held-out fold."""
    labels = read(spark, sf_dir, "labels")
    return crf.fit(docs, "doc_id", "text", labels.where(crf.remainder(F.col("doc_id"), 4) != 2))


@query
def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    rows = crf.score(docs.select("doc_id", "text"), "text", quality_field(docs, spark, sf_dir))
    return rows.select("doc_id", (crf.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= crf.ACCEPT).cast("int").alias("predicted"))


@query
def op9_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return lbl.score(docs, "doc_id", "text", crf.remainder(F.col("doc_id"), 5) == 1)


@query
def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.classes(read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of all documents: equal lines of any length, and lines that differ in one stretch."""
    return line_dedup.Lines(read(spark, sf_dir, "documents"), "doc_id", "text", short=True, stretch=line_dedup.STRETCH).classes()


ORACLES["op1_bagminhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT min(doc_id) AS id, ws FROM d GROUP BY ws),
s AS (SELECT id, array_to_string(ws[i:i + 4], ' ') AS shingle, count(*) AS c
      FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0) GROUP BY ALL),
w AS (SELECT id, sum(c) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN w x ON a = x.id JOIN w y ON b = y.id WHERE o >= 0.8 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS r FROM t UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a),
c AS (SELECT id, min(r) AS class_id, count(*) AS class_texts FROM reach GROUP BY id)
SELECT doc_id, class_id, class_texts FROM d JOIN t ON d.ws = t.ws JOIN c ON t.id = c.id
"""

# the longest common beginning and ending of two lines are found by halves, for all pairs of lines of like lengths that agree in their
# first or last third (of lines with one changed stretch, two thirds agree, so half of that at one end)
ORACLES["op7_line_dedup"] = """
WITH RECURSIVE x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)),
u AS (SELECT line, length(line) AS n, least(16, length(line) // 3) AS s, row_number() OVER () AS id, min({'k': doc_id, 'pos': pos}) AS first FROM l WHERE length(line) >= 1 GROUP BY line),
near AS (SELECT a.id AS a, b.id AS b, a.line AS la, b.line AS lb, a.n AS na, b.n AS nb, b.s AS s
         FROM u a JOIN u b ON left(a.line, 8) = left(b.line, 8) AND a.n BETWEEN b.n - b.s AND b.n AND (a.n < b.n OR a.id < b.id) WHERE a.n >= 25
         UNION
         SELECT a.id, b.id, a.line, b.line, a.n, b.n, b.s
         FROM u a JOIN u b ON right(a.line, 8) = right(b.line, 8) AND a.n BETWEEN b.n - b.s AND b.n AND (a.n < b.n OR a.id < b.id) WHERE a.n >= 25),
start AS (SELECT *, len(list_filter(range(1, na + 1), lambda i: left(la, i) = left(lb, i))) AS p FROM near),
e AS (SELECT a, b FROM start WHERE right(la, greatest(nb - s - p, 0)) = right(lb, greatest(nb - s - p, 0))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS r FROM u UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a),
c AS (SELECT reach.id, min(u.first) AS first, count(*) AS class_texts FROM reach JOIN u ON r = u.id GROUP BY reach.id)
SELECT doc_id, CAST(pos AS INTEGER) AS line, c.first.k AS class_doc_id, CAST(c.first.pos AS INTEGER) AS class_line, class_texts,
       c.first.k = doc_id AND c.first.pos = pos AS kept
FROM l JOIN u ON l.line = u.line JOIN c ON u.id = c.id
"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark texts."""
    return importance.resample(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "text")


# crc32 is worked out byte by byte from its table
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT r, unnest(ws) AS word FROM d),
bw AS (SELECT unnest(ws) AS word FROM b),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM bw)),
code AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
                lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN code USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN code USING (word) GROUP BY bucket),
gain AS (SELECT x.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE
                               / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS g
         FROM range(10000) x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM w JOIN code USING (word) JOIN gain USING (bucket) GROUP BY r),
z AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features,
             CASE WHEN n IS NULL THEN 0 ELSE total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END END AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS head FROM d LEFT JOIN m USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((head + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= 10 * (SELECT count(*) FROM ranks) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (r)
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    held_out = crf.remainder(F.col("doc_id"), 3) == 1
    rows = language.predict(docs.select("doc_id", "text"), "doc_id", "text", language.fit(docs, "text", "lang", ~held_out))
    return rows.withColumn("held_out", held_out)


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that two tokenizers' tokens make, and their links, over all documents."""
    return alignment.align_documents(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
