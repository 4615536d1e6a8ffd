"""The corpus pipeline: each stage reads what its predecessor kept and applies one operator.

Defined cases: null texts have no language and go; rows without a doc_id pass as
themselves, as no id tells them apart; repeated rows are near copies of each
other; an empty table gives an empty result; further columns are kept by all
stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import read_table, shared_path, small_batches
from palimpsest.llm.language import known_language
from palimpsest.llm.linededup import without_repeated_lines
from palimpsest.llm.mixing import interleaved
from palimpsest.llm.queries import TARGETS
from palimpsest.llm.nearcopies import without_near_copies
from palimpsest.llm.sentencepieces import encoded
from palimpsest.sources.files import Files

_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a label get theirs."""
    small_batches(spark)
    return known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has."""
    small_batches(spark)
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix of sources."""
    return interleaved(docs, TARGETS)


def in_file_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, source, text`` of documents read from files, with ``mix_position``, a document's place (from 0) in the order that the files hold, which is that of the mix."""
    place = docs.metadataColumn("_metadata")
    held = docs.select("doc_id", "source", "text", place.getField("file_name").alias("file"), place.getField("row_index").alias("nth"))
    before, n = [], 0
    for name, rows in sorted((r["file"], r["count"]) for r in held.groupBy("file").count().collect()):  # one row a file, whose name begins with the number of its task
        before.append((name, n))
        n += rows
    starts = F.broadcast(spark.createDataFrame(before, "file string, before long"))
    return held.join(starts, "file").select("doc_id", "source", "text", (F.col("before") + F.col("nth")).alias("mix_position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as SentencePiece ids, with their places in the mix."""
    small_batches(spark)
    found = encoded(in_file_order(spark, docs), _MODEL)
    return found.select("doc_id", "source", "ids", "n_tokens", "ids_crc32", "matched", "restored", "mix_position")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", tokens),
]

#: No stage but the order of the mix could be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over ``documents``; each is written to the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), ""
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"pipeline-{k}")
        kept.write.parquet(path)
        if k:  # what the stage has read is no longer needed
            Files(spark).delete(before)
        docs, before = spark.read.parquet(path), path
    return docs
