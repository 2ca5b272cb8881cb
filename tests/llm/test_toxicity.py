import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm.toxicity import DECAY, REACH, cleaned, fit, kernel_rows, landmark_columns, score_documents, sentences, toxicity, train, without_toxic, word_scores


def brute_features(word):
    from larkspur.llm.toxicity import FIRST, LAST, _TABLE

    code = [FIRST, *(int(_TABLE[ord(c)]) for c in word), LAST]
    out = {}
    for i in range(len(code)):
        for j in range(i + 1, len(code)):
            for k in range(j + 1, len(code)):
                if k - i <= REACH and code[i] and code[j] and code[k]:
                    out.setdefault((code[i], code[j], code[k]), []).append(DECAY ** (k - i - 2))
    return out


def test_kernel_counts_gapped_subsequences():
    words = ["idiot", "i.d.i.o.t", "id-iot", "banana", "a", "thing"]
    columns = landmark_columns(words)
    got = kernel_rows(words, columns)
    norm = lambda f: np.sqrt(sum(x * x for v in f.values() for x in v))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            f, g = brute_features(a), brute_features(b)
            want = sum(sum(v) * sum(g[c]) for c, v in f.items() if c in g) / max(norm(f) * norm(g), 1e-6)
            assert got[i, j] == pytest.approx(want, abs=1e-4)
    assert got[0, 2] > 3 * max(got[0, 3], got[0, 5]) and got[0, 1] > got[0, 5]
    assert word_scores(words, columns[:, 0].astype(float)) == pytest.approx(got[:, 0], abs=1e-5)


def synthetic(seed, n=240):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ti", "es", "ou", "st"]) for _ in range(rng.randrange(1, 4)))
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 80))]
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "idiot", "pathetic"]))
        texts.append(" ".join(words) + ".")
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def test_gapped_insults(documents):
    model = fit(*synthetic(1))
    cases = ["theres an mo-ron thou, ides cum thor and s.c.u.m of est", "ther m o r o n the scuum and onan pathe-tic es", "there on an onti and thest erou estan thou", "", None, " \n"]
    scores = [r["score"] for r in toxicity(documents(cases), model).orderBy("doc_id").collect()]
    assert scores[0] > 0.5 and scores[1] > 0.5 and max(scores[2:]) < 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    found = sum(r["predicted"] for r in rows if r["toxic"])
    wrong = sum(r["predicted"] for r in rows if not r["toxic"])
    # Of the 97 toxic documents held out here, six of junk hold no insult at all, and four one of a kind that too few labels show.
    assert len(rows) > 500 and right >= 0.98 * len(rows) and found >= 0.88 * sum(r["toxic"] for r in rows) and wrong <= 0.01 * len(rows)


def test_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, None, "a"), (None, "x", "b"), (1, "y", "c")])
    assert [r["score"] for r in score_documents(docs, none).collect()] == [0.0] * 3
    assert train(docs, none) is None and score_documents(documents([]), none).collect() == []
    texts, toxic = synthetic(2)
    docs = documents(texts).withColumn("score", F.lit("own")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(toxic) if not t}
    rows = {r["doc_id"]: r for r in score_documents(docs, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    texts, toxic = synthetic(3, 120)
    docs = documents(texts)
    schema = "doc_id long, quality int, toxic int"
    import zlib

    flipped = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    a, b = (sorted(map(tuple, score_documents(docs, spark.createDataFrame([(i, 1, t) for i, t in enumerate(x)], schema)).collect())) for x in (toxic, flipped))
    assert a == b


def test_sentences_and_words():
    assert sentences("One two. Three!\nFour") == ["One two.", "Three!", "Four"] and cleaned("(Word,)") == "word"
