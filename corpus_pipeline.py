"""The corpus pipeline: five stages over ``documents``, each by one of the training-data operators.

1. quality classifier: documents that it rejects go (scores below ``crf.ACCEPT``);
2. line dedup: of each class of equal (of any length) or nearly equal lines one stays, in its
   place; a document of which nothing is left goes;
3. near-dups: of each class of near-duplicate documents that with the smallest id stays;
4. mixing: the words that the mix takes of each document, a row for each pass that takes some;
5. packing: the token sequences of all that, with their ids.

Nulls, empty texts and repeated rows are treated as the operators say; of rows that are equal
in id and text, the near-dup stage keeps one.  An empty table gives an empty result.  Very long
texts go through every stage whole.  Columns beyond those of ``documents`` are carried through
the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import crf, line_dedup, mixing, near_dups, packing
from demandlens.llm.common import read, written
from demandlens.llm.queries import quality_field, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; all, if there are no labels to learn from."""
    field = quality_field(docs, spark, sf_dir)
    if field is None:
        return docs
    return crf.score(docs, "text", field, "_quality").where(F.col("_quality") >= crf.ACCEPT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat another, or differ from it in one edit."""
    return line_dedup.Lines(docs, "doc_id", "text", short=True).documents()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return near_dups.kept(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources."""
    return mixing.Mix(docs, "doc_id", "text", "source", with_texts=True).texts()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents, with their token ids."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dups", near_duplicates), ("mixing", mix), ("packing", pack)]
#: SQL can't express the trained field or the tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again as the next stage's input."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
