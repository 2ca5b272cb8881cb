import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm.packing import minimum_bin_slack, pack, ranked
from larkspur.llm.separators import SEPARATOR, count_tokens, token_counts, token_stream
from larkspur.llm.tokens import WordCoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "The the, THE. it's 'tis l'été. ÀÉ é", "x\x1cy \xa0 z w", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΑΣ. Σ", "1234 5.6 ... !!! $$$ #a", "\n\t\x0b\x0c\r", "中文字 한글 ʼn ǅ ß", "word " * 3000, "z" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_cached_ids_equal_the_tokenizers(tokenizer, sample, special):
    texts = ODD + [r["text"] for r in sample.select("text").collect()][:60]
    tokenizer.encode_special_tokens = special
    coder = WordCoder(PATH, special, capacity=50)
    for _ in range(2):
        for text, got in zip(texts, coder.ids(texts)):
            assert np.frombuffer(got, "<u4").tolist() == expected(tokenizer, text), text
    tokenizer.encode_special_tokens = False


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=25, deadline=None)
def test_cached_ids_on_any_text(texts):
    direct = Tokenizer.from_file(PATH)
    for text, got in zip(texts, WordCoder(PATH).ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == expected(direct, text)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_bins_use_every_piece_once(counts):
    used = defaultdict(int)
    for times, chosen in minimum_bin_slack(counts, 40):
        assert times > 0 and sum(n * c for n, c in chosen.items()) <= 40
        for n, c in chosen.items():
            used[n] += times * c
    assert used == counts


def test_bins_are_near_the_bound():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 2048, 20000), return_counts=True))}
    bins = sum(t for t, _ in minimum_bin_slack(counts))
    assert bins <= 1.01 * -(-sum(n * c for n, c in counts.items()) // 2048)


def check_packing(rows, texts, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*expected(tokenizer, text), 0], dtype="<u4")
        own = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(i, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for i, p in enumerate(range(0, len(ids), 2048))]
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_packing_against_the_tokenizer(documents, sample, tokenizer):
    texts = dict(enumerate(ODD)) | {r["doc_id"] + 100: r["text"] for r in sample.limit(80).collect()}
    rows = pack(documents(list(texts.items())), PATH).collect()
    check_packing(rows, texts, tokenizer)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * -(-total // 2048) + 1


def test_packing_of_nothing_and_of_equal_rows(documents):
    assert pack(documents([]), PATH).collect() == []
    rows = pack(documents([(1, "same text")] * 5 + [(None, None)]), PATH).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def test_counts_from_flat_streams(documents, sample, tokenizer):
    texts = dict(enumerate(ODD)) | {r["doc_id"] + 100: r["text"] for r in sample.limit(60).collect()}
    tokenizer.encode_special_tokens = True
    want = {doc: len(expected(tokenizer, t)) for doc, t in texts.items()}
    tokenizer.encode_special_tokens = False
    for block in (7, 1000, 1 << 16):  # many blocks without a separator, and many separators in a block
        rows = token_counts(documents(list(texts.items())), PATH, block_tokens=block).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want)


def test_separator_scan_alone(spark):
    s = SEPARATOR
    blocks = [[1, 2, 3], [4, 5, 6], [s, s, 7], [8, s, 9], [s]]
    df = spark.createDataFrame([(0, i, bytearray(np.array(b, "<u2").tobytes())) for i, b in enumerate(blocks)], "stream int, block long, ids binary")
    assert sorted((r["ordinal"], r["n_tokens"]) for r in count_tokens(df).collect()) == [(0, 6), (1, 0), (2, 2), (3, 1)]
    assert token_stream(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_distinct_words_are_covered_in_one_pass():
    coder, plain = WordCoder(PATH, capacity=3), Tokenizer.from_file(PATH)
    for words in (["Aa,", "b", "Aa", "x1!"], ["b", "new", "Aa,"], ["b"], []):
        assert coder._cover(words) == [np.array(plain.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]


def test_ranks_start_no_python_worker(spark):
    df = spark.range(1, 4).selectExpr("id as doc_id", "if(id < 3, 5L, 7L) as length")
    out = ranked(df, "length", {5: 2, 7: 1}, ["doc_id"], 1)
    assert sorted((r["length"], r["rank"]) for r in out.collect()) == [(5, 0), (5, 1), (7, 0)]
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
