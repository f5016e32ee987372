"""The corpus pipeline: raw documents to token ids, stage by stage.

Defined cases: documents without text or letters go with the first stage; rows that repeat count once; documents with a null
id pass all stages, near copies of them too; an empty table, and one whose rows all go, gives no rows; texts may be of any
length; other columns come along up to the last stage, which returns encodings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longleaf.llm import common, exact_dedup, language_id, minhash, mixing, sentencepiece_codec

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("minhash_dedup", minhash.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: SQL can't say what the first, third and last stages do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
