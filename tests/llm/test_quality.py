import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import quality
from larkspur.llm.quality import RULES, STOP_WORDS, Rule, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    m |= {"n_exclamations": text.count("!"), "n_stop_words": sum(x in STOP_WORDS for x in w), "n_lines": len(lines)}
    m["base_failed"] = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    failed = []
    for r in RULES:
        if m[r.denominator]:
            ratio = m[r.numerator] / m[r.denominator]
            if r.least is not None and ratio < r.least or r.most is not None and ratio > r.most:
                failed.append(r.name)
    return m | {"failed_rules": failed, "kept": not m["base_failed"] and not failed}


def check(df, texts):
    for r in quality_rules(df).collect():
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, texts[r["doc_id"]]


def test_against_brute_force(documents, sample):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "é ü! \x0b#$\x0c \xa0 \x1c \x85", "x\r\ny\r\nx\r\n", "of the and " * 30, "l1\nl1\n\nl1 \n" * 5, "!! " * 60, "word" * 5000, "the " + "of a to in " * 2000]
    texts += [r["text"] for r in sample.collect()]
    check(documents(texts), texts)


@pytest.mark.parametrize("bits", [3, 20])
def test_texts_beyond_the_packed_positions(documents, monkeypatch, bits):
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    texts = ["a b c d a b c", "x y z x y z q x y z", "one two three four five six seven eight nine ten one two three", "a a a a a"]
    check(documents(texts), texts)


@given(st.lists(st.text(alphabet="ab \n\t#!|", max_size=60), min_size=1, max_size=20))
@settings(max_examples=6, deadline=None)
def test_any_text(spark, texts):
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts)


def test_columns_rules_and_empty(documents):
    docs = documents([(1, "a b"), (1, "a b"), (None, None)]).withColumn("kept", F.lit("own")).withColumn("n_words", F.lit(7))
    out = quality_rules(docs, keep=("doc_id", "kept", "lang"))
    assert out.columns.count("kept") == 1 and "lang" in out.columns and out.count() == 3 and out.filter("kept").count() == 0
    assert quality_rules(documents([])).collect() == []
    only = quality_rules(documents(["the dog " * 40 + "cat"]), rules=(Rule("size", "n_words", None, 100, None),))
    assert only.first()["failed_rules"] == ["size"]


def test_one_scan_without_python_or_shuffle(sample):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        quality_rules(sample).explain()
    assert "Exchange" not in out.getvalue() and "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
