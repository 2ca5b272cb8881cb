import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import jaccard
from larkspur.llm.graph import components
from larkspur.llm.jaccard import jaccard_components, one_of_each
from larkspur.llm.shingles import shingle_sets


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [(d, brute_set(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            e, r = sets[j]
            if den * len(s & r) >= num * len(s | r):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets)


@given(st.lists(st.text(alphabet="aAbÉ \t\n\x0b\x1c.\x85\xa0", max_size=30), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_shingles_count_like_sets(texts, n):
    found = list(shingle_sets([t.encode() for t in texts], n, chunk=20))
    want = [brute_set(t, n) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, x) for x in range(600, 700)] + [(1, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vary(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], fresh(40)
    base = fresh(120)
    for _ in range(120):  # a large group at every distance around the threshold
        rows.append(" ".join(vary(rng, base, rng.randrange(0, 6))))
    for _ in range(40):
        b = fresh(rng.randrange(5, 60))
        rows += [" ".join(b), " ".join(vary(rng, b, 1)), " ".join(b).upper()]
    rows += [" ".join(fresh(10) + passage + fresh(10)) for _ in range(60)]  # a common passage
    rows += ["", None, "one", "ONE", "a b c", "a b c", " \t", "a b c d e f g h", "a b c d e f g"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_links_against_brute_force(spark, documents, monkeypatch, n, num, den):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(jaccard, "QUERIES", 5)
    rows = planted(n)
    got = sorted(map(tuple, jaccard_components(documents(rows), n, num, den, most_frequent=50).collect()))
    assert got == brute(rows, n, num, den)


def test_without_help_from_grouping(documents, monkeypatch):
    """The token-group matrix alone finds every link: each document is a group of its own, with the pivot as its guest."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1)
    rows = planted(9)
    assert sorted(map(tuple, jaccard_components(documents(rows), 4, 85, 100).collect())) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("seed", range(6))
def test_block_components(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in rng.integers(0, 12, 40)]
    got = jaccard.block_components(jaccard._Block(sets), sets, 85, 100)
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want[want == want[i]] = want[j]
    same = lambda c: [[bool(x == y) for y in c] for x in c]
    assert same(got) == same(want)


def test_ids_with_several_texts_tie_them(documents):
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = jaccard_components(documents([(9, one), (3, one), (9, two), (7, two), (8, "alone here with words")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (7, 3), (8, 8), (9, 3), (9, 3)]


def test_edges_of_the_contract(documents):
    assert jaccard_components(documents([])).collect() == []
    rows = jaccard_components(documents([(5, "x y z"), (5, "x y z"), (3, "x y z"), (None, "x y z"), (1, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (1, 1), (3, 3), (5, 3), (5, 3)]
    kept = one_of_each(documents([(5, "x y z"), (3, "x y z"), (9, "other text")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_whole_table(spark):
    from larkspur.llm.queries import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op7_ngram_jaccard"](spark, "/root/testdata/sf0.001").collect())) == brute(rows, 4, 85, 100)


def test_one_of_each_decides_by_row(documents):
    copied, own = "a b c d e f g h", "one text that nobody else has"
    rows = [(3, copied), (5, copied), (5, own), (7, "said twice here"), (7, "said twice here"), (None, "no id at all"), (None, "no id at all"), (None, copied), (8, ""), (8, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each(documents(rows)).collect()), key=str)
    assert kept == sorted([(3, copied), (5, own), (7, "said twice here"), (None, "no id at all"), (8, ""), (8, "")], key=str)
