"""Training-corpus pipeline: five stages of the corpus operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``: toxic documents go, one document of each near-duplicate group
stays, passages that an earlier document has are cut out, documents are repeated or dropped to meet
the sources' target weights, and what is left is packed into sequences.

Results on odd input are those of the operators: null texts count as empty, equal rows stay rows of
their own until a stage decides on them, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import checkpointed, table
from larkspur.llm.jaccard import one_of_each
from larkspur.llm.mixing import repeat
from larkspur.llm.packing import pack
from larkspur.llm.queries import word_tokenizer
from larkspur.llm.suffixes import deduplicated
from larkspur.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, holds to be toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest id stays."""
    return one_of_each(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in a 50-byte string that a document of smaller id also has are removed."""
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return repeat(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages train a classifier, build suffix arrays and pack by subset sums: SQL cannot state their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
