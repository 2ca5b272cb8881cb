import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm.mixing import mix, repeat, targets
from larkspur.llm.sharding import _hypergeometric, communication_matrix, shard_rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 50}, {"a": 5}, {"a": 0, "b": 7}, {"x": 1000, "y": 1, "z": 1}, {f"s{i}": (i * 37) % 91 + 1 for i in range(20)}])
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = brute_targets(sizes)
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(want)


def test_mix_meets_targets_and_bounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, again = mix(docs).collect(), mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == docs.count()
    text = {r["doc_id"]: r for r in docs.collect()}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == words(text[r["doc_id"]]["text"]) and r["source"] == text[r["doc_id"]]["source"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    want = brute_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s]


def test_larger_documents_are_likelier(documents):
    docs = documents([(i, "w " * (1 + i % 10), "s" if i < 4000 else "t") for i in range(8000)])
    rates = defaultdict(list)
    for r in mix(docs, weights=(1, 3), budget=0.9).collect():
        rates[r["source"], r["size"]].append(r["copies"] % 1.5)
    means = [np.mean(rates["s", n]) for n in range(1, 11)]
    assert means[9] > means[4] > means[0]


def test_mix_edges(documents):
    assert mix(documents([])).collect() == []
    rows = mix(documents([(1, None, None), (2, "", "a"), (None, "a b", "b")] + [(3, "x y z", "a")] * 3)).collect()
    assert len(rows) == 6 and all(r["taken"] <= 2 * r["size"] for r in rows)
    clash = documents([(1, "a b c", "a"), (2, "d e f", "b")]).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("rank", F.lit(1))
    assert len(mix(clash).collect()) == 2
    assert repeat(clash).columns == clash.columns and repeat(clash).count() > 0


def test_repeat_takes_as_often(documents, sample):
    want = Counter({r["doc_id"]: r["copies"] for r in mix(sample).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in repeat(sample).collect()) == want


def test_hypergeometric_draws_have_the_exact_law(spark):
    n, k, m = 12, 9, 30
    draws = spark.range(20000).select(_hypergeometric((F.col("id") + 0.5) / 20000, F.lit(n), F.lit(k), F.lit(m)).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in draws:
        assert r["count"] / 20000 == pytest.approx(comb(k, r["x"]) * comb(m - k, n - r["x"]) / comb(m, n), abs=2e-4)


@pytest.mark.parametrize("args", [(0, 5, 9), (9, 5, 9), (5, 0, 9), (5, 9, 9), (0, 0, 0), (1, 1, 1), (500_000, 41_667, 1_000_000)])
def test_hypergeometric_edges(spark, args):
    n, k, m = args
    for u in (1e-9, 0.5, 1 - 1e-9):
        x = spark.range(1).select(_hypergeometric(F.lit(u), *map(F.lit, args)).alias("x")).first()["x"]
        assert max(0, n + k - m) <= x <= min(n, k)


def test_matrix_has_exact_margins(spark):
    sizes = {0: 5, 1: 17, 3: 4, 6: 100, 7: 1}
    rows = communication_matrix(spark.createDataFrame(list(sizes.items()), "block int, n long"), 8, 6).collect()
    counts = {r["block"]: r["counts"] for r in rows}
    assert {b: sum(c) for b, c in counts.items()} == {b: sizes.get(b, 0) for b in range(8)}
    columns = [sum(c[s] for c in counts.values()) for s in range(6)]
    assert max(columns) - min(columns) <= 1 and all(x >= 0 for c in counts.values() for x in c)


def check_shards(rows, docs, shards=24):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(documents, sample):
    rows = shard_rows(sample).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in sample.collect()])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, shard_rows(sample.repartition(5)).collect()), key=str)
    for docs in ([], [(1, "x")], [(None, None), (2, ""), (2, "")] + [(3, "same")] * 40):
        check_shards(shard_rows(documents(docs)).collect(), docs)


def test_shuffle_is_uniform(documents):
    docs = documents([(i, "t") for i in range(4800)])
    first = [r["shard"] for r in shard_rows(docs).collect() if r["doc_id"] < 1200]
    expected = 50
    assert sum((first.count(s) - expected) ** 2 / expected for s in range(24)) < 55  # chi-square, 23 degrees, p about 2e-4


def test_repeated_rows_share_their_copies_exactly(documents):
    rows = [(1, "same words here", "s"), (1, "same words here", "s"), (1, "other words now", "s"), (None, "no id", "s"), (None, "no id", "s"), *[(i, "w " * i, "s") for i in range(2, 12)]]
    docs = documents(rows)
    want = Counter()
    for r in mix(docs, seed=3).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], words(r["text"])) for r in repeat(docs, seed=3).collect())
    assert got == +want
