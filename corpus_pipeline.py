"""A corpus from raw documents to packed sequences, in five stages.

In all of them further columns stay until the last, whatever their names; rows are read whole at any length;
repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import minhash, packing, quality, secrets, substrings
from factloom.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are among them. A null doc_id does not matter."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; rows without a doc_id, and all rows of one that stays, stay."""
    return minhash.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of smaller doc_id holds are cut; documents of which nothing is left go.

    Rows without a doc_id stay whole; texts under one doc_id do not cut each other.
    """
    return substrings.without_repeats(docs).where("text <> ''")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, null texts too."""
    import public_tokenizers

    return secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 4096 tokens; rows without a doc_id are packed too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Alignment, the forest and the packing cannot be told in SQL. A test holds the rows of run() against a plain-Python version of
#: the five stages, where the packed places are free.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; each stage reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
