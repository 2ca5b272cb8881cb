import hashlib
import time
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import tokens, toxicity
from larkspur.llm.common import REST, release, rest
from larkspur.llm.mixing import mix
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_suffixes import brute as brute_removed
from tests.llm.test_tokens_packing import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_what_the_last_one_kept(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(f.columns == COLUMNS for f in frames[:-1])
    start, clean, single, cut, mixed, packed = ([r.asDict() for r in f.collect()] for f in frames)

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"]}
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in clean}
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) <= 0.2 * len(start)

    texts = [(r["doc_id"], r["text"]) for r in clean]
    assert {r["doc_id"] for r in single} == {d for d, _, c in brute_components(texts, 5, 80, 100) if d == c}

    left = {d: h for d, _, _, _, h in brute_removed([(r["doc_id"], r["text"]) for r in single], 50)}
    whole = {r["doc_id"]: r["text"] for r in single}
    for r in cut:
        assert r["n_chars"] == len(r["text"])
        if r["text"] == whole[r["doc_id"]]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == left[r["doc_id"]]
        else:
            assert len(r["text"]) < len(whole[r["doc_id"]])
    assert len(cut) == len(single)

    copies = {r["doc_id"]: r["copies"] for r in mix(frames[3]).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: c for d, c in copies.items() if c})

    rows = defaultdict(list)
    for r in packed:
        rows[r["doc_id"], r["piece"]].append(r)
    assert {k[0]: len(v) for k, v in rows.items()} == Counter(r["doc_id"] for r in mixed)
    once = [r for r in packed]
    at = Counter()
    for r in once:  # copies of a document are told apart by their turn
        key = r["doc_id"], r["piece"]
        r["doc_id"] = r["doc_id"], at[key]
        at[key] += 1
    final = {r["doc_id"]: r["text"] for r in mixed}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(once, {k: final[k[0]] for k in {r["doc_id"] for r in once}}, tokenizer)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_a_worker_keeps_the_cache_of_one_operator():
    toxicity._CACHE["model"], tokens._CODERS["path"] = ({}, {}), None
    release(toxicity._CACHE)
    assert list(toxicity._CACHE) == ["model"] and not tokens._CODERS
    release()
    assert not toxicity._CACHE


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_worker_at_rest_gives_back_what_outlived_its_task():
    def task():
        held = [bytes([i % 256]) * 20_000 for i in range(4000)]
        rest()
        return held

    held = task()
    full = _resident()
    del held[:-1]  # the last keeps the heap from shrinking by itself
    time.sleep(REST + 1)
    assert full - _resident() > 40_000_000
