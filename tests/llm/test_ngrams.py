"""Perplexity from all n-grams of a language, whether its arrays hold them or not."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import quality_rules
from tests.llm.test_operators import brute_kneser_ney


@pytest.mark.parametrize("most", [0, 3000, quality_rules.MOST])
def test_rare_ngrams_count_in_full(spark, monkeypatch, most):
    """Some 150,000 different n-grams in a language, most of them seen once; languages beyond the broadcast ones too."""
    monkeypatch.setattr(quality_rules, "MOST", most)
    monkeypatch.setattr(quality_rules, "LANGUAGES", 1)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)] + ["힣", "é", "🙂"]
    texts, of = [], []
    for i in range(64):
        words = ["".join(rng.choices(letters, k=rng.randint(20, 60))) for _ in range(60)]
        texts.append(" ".join(words) + " " + "the end " * 4)
        of.append("zh" if i < 60 else None)
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, of, strict=True))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4, F.col("doc_id"))
    got = {r.doc_id: r for r in quality_rules.quality(d).collect()}
    assert len(got) == len(texts)
    for lang in ("zh", None):
        mine = [i for i in range(len(texts)) if of[i] == lang]
        probability, level = brute_kneser_ney([texts[i] for i in mine])
        assert lang is None or len(level[4]) > 1 << 17
        for i in mine[:4]:
            line = ["^"] * 3 + list(texts[i])
            assert got[i].bits == pytest.approx(np.mean([-np.log2(probability(line[j : j + 3], line[j + 3])) for j in range(len(line) - 3)]), abs=1e-3)
    assert {r.doc_id for r in quality_rules.quality_filter(d).collect()} == {i for i, r in got.items() if r.kept}
