"""Pipeline stages: each applies one corpus operator and lets its decisions take effect on the documents.

Stages keep the columns of their input. Decisions that depend on the text alone are joined by the text's
SHA-256, so rows without an id and rows that repeat one get their own decision; those on groups are
joined by id: rows without an id stay, rows that repeat an id share a decision and stay if one of them would.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boundra.llm.common import broadcast_if, materialise, table
from boundra.llm.decontaminate import find_contamination
from boundra.llm.exact_dedup import exact_dedup
from boundra.llm.jaccard_join import similar_groups
from boundra.llm.language_id import fold
from boundra.llm.sentencepiece_codec import encode_decode
from boundra.llm.toxicity import score_toxicity, train

#: Up to so many rejected rows are sent to all tasks; more are joined by shuffling.
SENT = 1_000_000
#: The stage for near copies compares shingles of so many words at so many percent; op2's contract binds only its query.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _without(docs: DataFrame, rejected: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose key isn't in the one column of ``rejected``."""
    gone = broadcast_if(materialise(rejected.toDF("_rejected").distinct(), "rejected"), SENT)
    return docs.join(gone, key == gone["_rejected"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the training folds of the labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = score_toxicity(docs.select(_digest(docs["text"]).alias("k"), "text"), model, "k")
    return _without(docs, scored.filter("predicted = 1").select("doc_id"), _digest(docs["text"]))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id; one of rows that repeat it. Rows without an id all stay."""
    decided = materialise(exact_dedup(docs), "decided").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = materialise(decided.filter("doc_id IS NOT NULL AND (NOT kept OR n > 1)"), "decided")
    left = _without(docs, decided.filter("NOT kept").select("doc_id"), docs["doc_id"])
    if decided.filter("kept").isEmpty():
        return left
    # rows without an id are each their own
    return left.withColumn("_own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "text", "_own"]).drop("_own")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by the Jaccard join."""
    groups = similar_groups(docs, size=NEAR_WORDS, percent=NEAR_PERCENT).groupBy("doc_id").agg(F.min(F.col("component_id")).alias("least"), F.max(F.col("component_id")).alias("most"))
    return _without(docs, groups.filter("doc_id IS NOT NULL AND most < doc_id").select("doc_id"), docs["doc_id"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_contamination(docs.select(_digest(docs["text"]).alias("k"), "text"), table(spark, sf_dir, "benchmark"), "k")
    return _without(docs, found.filter("size(spans) > 0").select("doc_id"), _digest(docs["text"]))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 of what is left."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
