"""A training corpus from `documents`: quality rules, line dedup, near-dedup, mixing, token ids.

run() applies the stages one after the other; each takes (spark, docs, sf_dir) and all but the last return the columns of
`documents`. What a stage decides holds for all that follow.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsymbol.llm import bpe, linededup, minhash, mixing, quality
from tsymbol.llm.common import materialise, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; what loses all its lines goes. n_chars follows the text."""
    made = linededup.thin(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity of 0.8 or more."""
    return minhash.dedup(docs, minhash.Near(percent=80, shingle=5))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each copy; that they decode to its text is checked."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("doc_id", "source"), checked=True)


STAGES = [
    ("quality_rules", good),
    ("line_dedup", distinct_lines),
    ("minhash_near_dedup", distinct_texts),
    ("source_mixing", mixed),
    ("byte_bpe", token_ids),
]

#: The suffix-array verdicts, prefix doubling and BPE can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
