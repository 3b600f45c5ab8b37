"""Byte-level BPE and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tradewind.llm import byte_bpe, mixing, ngram_join, quality_classifier, secrets

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("ready", [(200, 1000), (0, 1)])
def test_encoding_equals_library_and_round_trips(spark, awkward, documents, ready):
    extra = ["aaaaaaaaaaaaaaaaaaaaaaa", "\x1c\x1d x\x85y\u2028 z", "don't it'll I've", "\t\t  \n\n a", "日本語テキスト", "x" * 900, "<|endoftext|>", " ", "e\u0301\u0327", "١٢٣ ½"]
    docs = awkward.select("doc_id", "text", "n").union(spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(extra)], "doc_id long, text string, n long"))
    docs = docs.union(documents.limit(60).selectExpr("doc_id + 1000", "text", "1L"))
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ready_words=ready[0], ready_documents=ready[1])
    rows = sorted((r["doc_id"] or -1, r["text_bytes"].decode(), np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()) for r in got.collect())
    assert [r[:2] for r in rows] == texts
    assert all(ids == PLAIN.encode_ordinary(t) for _, t, ids in rows)


def test_fast_pattern_finds_the_same():
    draw, letters = random.Random(2), ["a", "Z", "é", "ÿ", "×", " ", "  ", "\t", "\n", "\x0b", "\x1c", "'s", "'", "'ll", "'LL", "1", "½", "!", "-", "_", "\x00", "\x7f", "\xa0", "中"]
    find = byte_bpe._finder(public_tokenizers.PATTERN)
    for n in range(20000):
        text = "".join(draw.choices(letters[: 15 + n % 10], k=draw.randint(0, 12)))
        assert find(text) == regex.findall(public_tokenizers.PATTERN, text), repr(text)


def test_blocks_and_empty_table(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 1)
    rows = byte_bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, digests=True, ready_words=10).collect()
    assert len(rows) == 12
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, empty, empty)}
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tasks_start_anew_and_ties_go_left(spark, monkeypatch):
    """Blocks of few words, words forgotten between them, and pairs of one rank that overlap ("ab" "a" "ba")."""
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "TASK_WORDS", 12)
    ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(["ab", "ba", "aba", "bb", "aab", "abab", "bab"])}
    plain = tiktoken.Encoding("small", pat_str=r"[ab]+|[^ab]", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("ab", k=draw.randint(1, 14))) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for ready in (0, 30):
        got = byte_bpe.encode(docs, ranks, r"[ab]+|[^ab]", ready_words=ready).collect()
        assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() for r in got} == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


def test_spark_decodes(spark):
    tokens = spark.createDataFrame([(PLAIN.encode_ordinary("café \U0001f600 ok"),), ([],), (None,)], "ids array<int>")
    got = [r["text_bytes"] for r in byte_bpe.decode(tokens, RANKS).collect()]
    assert bytes(got[0]).decode() == "café \U0001f600 ok" and bytes(got[1]) == b"" and got[2] is None


def test_pipeline_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect() if r["predicted"]}
    kept = docs.where(docs["doc_id"].isin(*good))
    first = {r["doc_id"] for r in ngram_join.near_copies(kept).collect() if r["doc_id"] == r["component_id"]}
    assert 0 < len(first) < len(good) <= docs.count()
    clean = secrets.redact(kept.where(kept["doc_id"].isin(*first)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    want = []
    for r in clean.collect():
        ids = PLAIN.encode_ordinary(r["text"])
        want += [(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] * copies[r["doc_id"]]
    assert got == sorted(want)


def test_stages_keep_columns(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(5, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_words_of_one_length_fold_together_as_in_the_library(monkeypatch):
    """Words are folded as arrays in the task, in small lots too, not by an interpreted expression."""
    draw, merges = random.Random(11), byte_bpe.Merges(RANKS)
    words = ["".join(draw.choices("etaoinsE é0'中\x00", k=draw.randint(1, 24))) for _ in range(4000)] + ["a" * 700, "ab" * 300, "x", "é"]
    for lot in (1 << 20, 64):
        monkeypatch.setattr(byte_bpe, "FOLD_BYTES", lot)
        got = merges.fold(words)
        assert all(np.frombuffer(ids, dtype="<u4").tolist() == PLAIN._core_bpe.encode_single_piece(w.encode()) for w, ids in zip(words, got) if w.encode() not in RANKS)
    assert merges.fold([]) == []
