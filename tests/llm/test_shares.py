"""Sources and languages that are small beside the others."""

import random
from collections import Counter

from pyspark.sql import functions as F

from skeinflow.llm import mixing, quality_rules
from tests.llm.test_operators import docs, prose


def test_mixing_takes_short_documents_among_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 4)
    rng = random.Random(14)
    texts = [prose(rng, 3) if i % 6 == 0 else prose(rng, 400) for i in range(1200)]
    sources = ["a" if i % 6 == 0 else "b" for i in range(6)]
    taken, target = Counter(), {}
    for r in mixing.mix(docs(spark, texts, sources)).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    assert target[600] == 1200
    for size, t in target.items():
        assert abs(taken[size] - t) <= 0.02 * t


def test_every_language_has_its_own_band(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PART_ROWS", 8)
    rng = random.Random(15)
    rows = []
    for k in range(19):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(200)]
        for _ in range(24 if k < 15 else 20):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(100)), f"l{k:02}"))
        rows.append((len(rows), " ".join("".join(rng.choice("#|%ZQXJ") for _ in range(5)) for _ in range(100)), f"l{k:02}"))
    rows += [(len(rows), None, "l18"), (None, "few words", "l17"), (len(rows) + 1, None, "alone"), (len(rows) + 2, "a b", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = lambda d: Counter((r.doc_id, r.n_words, r.bits, r.kept) for r in quality_rules.quality(d).collect())
    got = quality_rules.quality(table).collect()
    assert len(got) == len(rows)
    whole = Counter((r.doc_id, r.n_words, r.bits, r.kept) for r in got)
    for lang in ("l03", "l16", "l18"):
        alone = seen(table.where(F.col("lang") == lang))
        assert all(whole[k] == n for k, n in alone.items()) and sum(k[3] for k in alone) >= 18
    kept = quality_rules.quality_filter(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
