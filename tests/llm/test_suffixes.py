import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm.suffixes import SuffixLevels, _segments, deduplicated, suffix_dedup


def brute(rows, length):
    first = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if doc is not None and first[b[p : p + length]] < doc:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(map(tuple, suffix_dedup(df, **options).collect()), key=str)


def planted(seed, n=80):
    rng = random.Random(seed)
    words = ["ab", "cde", "é", "f", "ghi jk", "\0", "lm\n"]
    fresh = lambda k: "".join(rng.choice(words) + rng.choice(" xyz") for _ in range(k))
    passages = [fresh(12) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            texts.append(fresh(rng.randrange(0, 60)))
        elif kind < 0.7:
            texts.append(fresh(rng.randrange(0, 20)) + rng.choice(passages) + fresh(rng.randrange(0, 20)) + rng.choice(passages))
        elif texts:
            t = list(rng.choice(texts))
            if t:
                t[rng.randrange(len(t))] = "Q"
            texts.append("".join(t))
    texts += ["z" * 300, "z" * 100, "zy" * 60, "", None, passages[0]] + ["copy of one text " * 6] * 20
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(documents, seed):
    rows = planted(seed) + [(5000, "shared id and passage " * 5), (5000, "shared id and passage " * 5 + "!"), (None, "shared id and passage " * 5)]
    for length, gram, batch in ((50, 24, 200), (20, 8, 7), (50, 24, 10**6)):
        assert run(documents(rows), length=length, gram=gram, batch_strings=batch) == brute(rows, length)


def test_whole_table(spark):
    from larkspur.llm.queries import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows, 50)


def test_texts_and_columns(documents):
    assert run(documents([])) == []
    passage = "a passage of well over fifty bytes that two documents hold in full"
    docs = documents([(1, "one " + passage), (2, passage + " zwei"), (3, None)]).withColumn("n_removed", F.lit("mine"))
    out = {r["doc_id"]: r for r in deduplicated(docs).collect()}
    assert deduplicated(docs).columns == docs.columns
    assert out[1]["text"] == "one " + passage and out[2]["text"] == " zwei" and out[2]["n_chars"] == 5 and out[3]["text"] == "" and out[2]["n_removed"] == "mine"


@given(st.lists(st.lists(st.integers(0, 6), max_size=12), max_size=12))
@settings(max_examples=100, deadline=None)
def test_levels_are_a_binary_counter(batches):
    data = np.frombuffer(b"".join(b"%02d" % x for batch in batches for x in batch), dtype=np.uint8)
    index, seen, at = SuffixLevels(data, 2), {}, 0
    for owner, batch in enumerate(batches):
        for x in batch:
            seen.setdefault(x, owner)
        if batch:
            starts = at + 2 * np.arange(len(batch))
            assert index.add(starts, np.full(len(batch), owner)).tolist() == [seen[x] for x in batch]
            at += 2 * len(batch)
        ranks = [r for r, _, _ in index.levels]
        assert ranks == sorted(set(ranks), reverse=True)
    assert sum(1 << r for r, _, _ in index.levels) == sum(1 for b in batches if b)


def test_segments_cover_every_string_once():
    texts = [t.encode() for _, t in planted(8, 30) if t]
    got = sorted((int(t), int(o) + i, data[a + i : a + i + 50]) for data, _, first, end, text, offset in _segments(texts, 50, 24) for a, e, t, o in zip(first, end, text, offset) for i in range(e - a - 49))
    assert got == sorted((i, p, t[p : p + 50]) for i, t in enumerate(texts) for p in range(len(t) - 49))


def test_hashing_takes_little_beside_the_texts():
    texts = [random.Random(i).randbytes(2000) for i in range(1000)]
    tracemalloc.start()
    for _ in _segments(texts, 50, 24):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
