"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

Rows are told apart by a number of their own where ids are needed, so rows of null doc_id and rows that share a doc_id are
judged by their texts like all others.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm import decontamination, near_dup, quality_classifier, quality_rules, sentencepiece
from fairground.llm._shared import cut, table, unused


#: Hundredths of similarity from which documents are near copies; op7_near_dup has its own.
SIMILAR = 80


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects."""
    return quality_rules.passing(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier finds good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates; a null id comes after all others."""
    row, content, order, component = unused(docs, "row", "content", "order", "component")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_dup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), SIMILAR).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    # Of rows that share an id their contents decide, and the row number only between equal rows.
    hashed = F.xxhash64(*(F.col(f"`{c}`").cast("string") if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))
    ranked = rows.select(row, F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), hashed.alias(content), F.col(row).alias("row")).alias(order))
    kept = ranked.join(groups, row).groupBy(component).agg(F.min(order)["row"].alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    return decontamination.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, round_trip): the encoded corpus, decoded once to check it."""
    decoded = sentencepiece.encode_and_decode(docs)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The classifier can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
