"""The corpus pipeline: quality rules, one document per similar group, decontamination, masking, piece ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
stage's documents.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenspark.llm import decontaminate, jaccard_join, pieces, pii, quality_rules
from greenspark.llm.common import read
from greenspark.operators.lineage import cut
from greenspark.operators.spatial import once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from the text of the others."""
    judged = quality_rules.quality_rules(docs).withColumnRenamed("_quality", "_judged")
    kept = once(judged, "_quality", F.col("_judged")).where(F.col("_quality")["kept"])  # the verdict is not computed again in the filter
    return _columns(kept.withColumn("text", F.col("_quality")["clean_text"]))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 0.8 of their runs of five words."""
    return jaccard_join.one_of_each(docs, 5, 80).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each identifier is replaced by its kind."""
    return _columns(pii.redacted(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", one_per_group),
          ("benchmark decontamination", without_benchmark), ("PII", without_personal_data),
          ("SentencePiece encoding and decoding", piece_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to the checkpoint folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


ORACLE_SQL = None  # similar groups, template windows and piece ids have no SQL form
CHECKS = {"pipeline": (run, ORACLE_SQL)}
