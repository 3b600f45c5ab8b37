"""Quality classifier, language identification, quality rules."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tradewind.llm import language_id, quality_classifier, quality_rules
from tradewind.llm.hashing import Texts, hash_text, windows

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_hash_of_a_substring_is_that_of_the_text():
    t = Texts(["ab cd", None, "", "cd"])
    assert t.words_per_text().tolist() == [2, 0, 0, 1]
    assert [int(h) for h in t.words()] == [hash_text("ab"), hash_text("cd"), hash_text("cd")]
    assert len(windows(t.words(), t.word_doc, 2)[0]) == 1
    assert int(Texts(["AB"], fold=True).words()[0]) == hash_text("ab")


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == held(i) for i, r in got.items())
    pairs = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if held(r["doc_id"])]
    assert np.mean([p["predicted"] == y for p, y in pairs]) > 0.9
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_features_by_hand():
    doc, bucket, n = quality_classifier.features(["ab cde", ""], 20, (3,))
    # words ab, cde; 3-grams with blanks at the ends only: "ab ", "cde", "de\n", " cd"
    assert n == 2 and doc.tolist() == [0] * 6 and len(set(bucket)) == 5


def test_quality_awkward(spark, awkward, nothing):
    model = quality_classifier.train(awkward, spark.createDataFrame([(5, 1, None), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = quality_classifier.score(awkward, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) <= 2
    empty = quality_classifier.train(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score(nothing, empty).count() == 0
    assert quality_classifier.keep_good(nothing, empty).columns == nothing.columns


def brute_forward(word, table, unknown, most):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(most, len(word)) + 1):
        p = table.get(word[:k], (unknown,) if k == 1 else None)
        if p is not None:
            total += p[0] * brute_forward(word[k:], table, unknown, most)
    return total


def test_forward_sums_all_segmentations():
    table = {"▁": (0.1,), "a": (0.2,), "b": (0.3,), "ab": (0.15,), "▁a": (0.05,), "ba": (0.02,)}
    words = ["▁ab", "▁abab", "▁xab", "▁bbaab", "x", "▁aba"]
    got = language_id.Scorer(language_id.Model(["en"], table, (0.001,), 2)).log_probabilities(words)
    assert all(math.isclose(g, math.log(brute_forward(w, table, 0.001, 2))) for g, w in zip(got[:, 0], words))


def test_expected_counts_split_by_posterior():
    got = language_id.expected_counts(Counter({"ab": 2}), {"a": 0.5, "b": 0.5, "ab": 0.25}, 0.01, 2)
    assert {k: round(v, 9) for k, v in got.items()} == {"a": 1.0, "b": 1.0, "ab": 1.0}


def test_words_need_letters():
    assert language_id.words_of("½ ² 12_3 É2a") == ["▁é", "▁a"] and language_id.words_of(None) == []
    assert [len(w) for w in language_id.words_of("x" * 100)] == [48, 48, 5]


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model")), per_language=60)
    rows = language_id.identify(docs, model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    aside = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in aside]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_awkward(spark, awkward, nothing):
    pieces = ["▁the", "the", "ing", "▁", "t", "h", "e"]
    model = language_id.train(awkward, pieces)
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == 12
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, None}
    assert all(r["lang_pred"] in ("und", "en", "de", "fr") for r in rows)
    assert language_id.identify(nothing, language_id.train(nothing, pieces)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward, language_id.train(nothing, pieces)).collect()} == {"und"}


W = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    w = W.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if W.search(x):
            dup += x in seen
            seen.add(x)
    windows_ = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if windows_[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_rules_by_brute_force(spark, awkward, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "given" else awkward
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(((r["doc_id"] or -1), *(r[k] for k in names)) for r in quality_rules.rate(docs).collect())
    assert got == sorted(((r["doc_id"] or -1), *counted(r["text"])) for r in docs.select("doc_id", "text").collect())


def test_rules_verdict(spark, nothing):
    plain = "the quick fox of the wood and the hill is in a house to be with that "
    good = " ".join(f"{plain} word{chr(97 + i)}x" for i in range(4))
    odd = " ".join(f"Q{i}#$%Z{i * 7}&*" for i in range(60))
    docs = spark.createDataFrame([(i, good.replace("fox", "fox" + "a" * i), "en") for i in range(30)] + [(30, odd, "en"), (31, odd, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.rate(docs).collect()}
    assert not got[30]["kept"] and got[30]["class_distance"] > 0.3 and got[31]["class_distance"] > 0.3
    assert all(got[i]["class_distance"] < 0.2 for i in range(30))
    assert quality_rules.rate(nothing).count() == 0


def test_js_distance():
    p = np.array([[1, 0], [1, 1], [0, 0]])
    assert np.allclose(quality_rules.js_distance(p, np.array([[0, 1], [2, 2], [1, 1]])), [1, 0, 0])


def test_rules_hold_short_texts_against_their_length(spark):
    rng = np.random.default_rng(3)
    common = quality_rules.COMMON_WORDS["en"][:12]
    said = lambda n: " ".join(str(w) if w in common else f"word{chr(97 + i % 26)}" for i, w in enumerate(rng.choice([*common, *["x"] * 12], n)))
    listed = " | ".join(f"item{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    docs = spark.createDataFrame([*((i, said(400), "en") for i in range(40)), *((100 + i, said(25), "en") for i in range(100)), (200, listed, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.rate(docs).collect()}
    assert not got[200]["kept"] and not got[200]["base_failed"] and got[200]["n_words"] == 59 and got[200]["class_distance"] <= 0.3
    short = [got[100 + i] for i in range(100)]
    assert sum(r["word_distance"] > 0.33 for r in short) > 10 and sum(r["kept"] for r in short) > 90
    sizes, limits = quality_rules.chance_limits(quality_rules.references(docs)["en"][quality_rules.CLASSES :], 0.33, 0.99)
    assert all(np.diff(sizes) > 0) and limits[-1] == 0.33 and limits[0] > np.interp(25, sizes, limits) > 0.33


def test_short_pipe_lists_of_the_given_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.rate(docs).join(labels.where("quality is not null"), "doc_id").where("n_words between 40 and 149 and not base_failed").collect()
    kept = lambda y: np.mean([r["kept"] for r in rows if r["quality"] == y])
    assert kept(1) > 0.95 and kept(0) < 0.5
