"""A training-data pipeline: documents through five operators, each stage stored before the next one reads it.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All stages but the last return the columns of
``documents``.  Null, empty and very long texts, repeated rows and further
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphbi.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from graphbi.llm.common import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; null and empty texts have the score of the bias and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints; null and wordless texts are one group."""
    return simhash.drop_near_duplicates(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur before are cut from the texts; a document that loses all its words goes."""
    return suffix_dedup.drop_repeats(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe.encode(docs, public_tokenizers.path(bpe.TOKENIZER))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("suffix_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("bpe_encoding", encoded),
]

#: No stage but decontamination can be said in SQL: a trained model, hashes and a tokenizer. See the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"llm-pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
