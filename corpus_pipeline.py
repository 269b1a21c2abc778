"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundra.llm import stages
from boundra.llm.common import materialise, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact_copies),
    ("jaccard_join", stages.near_copies),
    ("decontamination", stages.decontamination),
    ("sentencepiece", stages.tokens),
]

#: SQL can't express the toxicity model or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
