"""Extra columns that have the operators' own names, in every registered query's operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm.jaccard import jaccard_components, one_of_each
from larkspur.llm.mixing import mix, repeat
from larkspur.llm.ngrams import score_documents
from larkspur.llm.packing import pack
from larkspur.llm.separators import token_counts
from larkspur.llm.sharding import shard_rows
from larkspur.llm.suffixes import deduplicated, suffix_dedup
from larkspur.llm.toxicity import without_toxic

PATH = public_tokenizers.path("word_bpe_49k.json")
NAMES = ("part", "bucket", "n", "fp", "mins", "prefix", "m", "o", "block", "size", "rank", "target", "shard", "slot", "law", "range", "piece", "length", "stream", "ordinal", "ids", "held_out", "score", "carried", "kept_text", "component", "grp", "copies", "first", "token")


@pytest.mark.parametrize("operator", [suffix_dedup, lambda d: shard_rows(d), lambda d: token_counts(d, PATH), jaccard_components, mix, lambda d: pack(d, PATH), score_documents])
def test_same_rows_with_clashing_columns(documents, operator):
    plain = documents([(1, "a b c d e f", "s"), (2, "a b c d e f", "t"), (3, None, None), (4, "x y " * 40, "s"), (5, "x y " * 40 + "z", "t")])
    clash = plain.select("*", *[F.lit("own").alias(c) for c in NAMES])
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(operator(clash).collect()) == key(operator(plain).collect())


@pytest.mark.parametrize("stage", [one_of_each, deduplicated, repeat])
def test_stages_keep_clashing_columns(documents, stage):
    docs = documents([(1, "a b c d e f g", "s"), (2, "other words are here", "t")]).select("*", *[F.lit("own").alias(c) for c in NAMES])
    out = stage(docs)
    assert out.columns == docs.columns and all(r[c] == "own" for r in out.collect() for c in NAMES)


@pytest.mark.parametrize("own", ["_toxicity", "__toxicity", "score"])
def test_toxicity_stage_keeps_clashing_columns(spark, documents, own):
    docs = documents([(1, "a kind word"), (2, "you grumblefrotz"), (3, None)]).withColumn(own, F.lit("own"))
    out = without_toxic(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1} and all(r[own] == "own" for r in out.collect())


@pytest.mark.parametrize("own", ["_copies", "__size", "_words", "__copy"])
def test_mix_keeps_clashing_columns(documents, own):
    docs = documents([(1, "a b c", "s"), (2, "d e", "t")]).withColumn(own, F.lit(1))
    assert all(r[own] == 1 for r in repeat(docs).collect())
