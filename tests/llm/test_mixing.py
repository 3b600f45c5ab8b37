"""Mixing sources to target weights."""

from fractions import Fraction

import numpy as np
import pytest

from tradewind.llm import mixing


def test_targets_cap_and_share_again():
    assert mixing.targets({"a": 60, "b": 60}) == {"a": Fraction(40), "b": Fraction(80)}
    # b is capped at 3 x 10; its excess goes to a and null by weights 1 and 3.
    got = mixing.targets({"a": 100, "b": 10, None: 100})
    assert got == {"a": Fraction(45), "b": Fraction(30), None: Fraction(135)}
    assert sum(got.values()) == 210 and mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0} and mixing.targets({}) == {}


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(3)
    p, size = rng.uniform(0.05, 0.95, 40), rng.integers(1, 50, 40)
    total = np.zeros(40)
    for _ in range(4000):
        out, left = mixing.pivot(p, size, rng.random(40))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        total += out
    assert np.abs(total / 4000 - p).max() < 0.05


@pytest.mark.parametrize("leaf", [512, 8])
def test_mix_meets_targets(spark, documents, leaf, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_apply_repeats_rows(spark, documents, awkward):
    for docs in (documents, awkward):
        taken = sum(r["copies"] for r in mixing.mix(docs).collect())
        out = mixing.apply_mix(docs)
        assert out.columns == docs.columns and out.count() == taken


def test_awkward(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == 12
    assert all(r["taken"] == 0 and r["size"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(nothing).count() == 0 and mixing.apply_mix(nothing).count() == 0
