"""Stages of the pipeline on small tables."""

import random

import corpus_pipeline
from tests.llm.test_operators import docs, prose


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_dedup_from_80_percent(spark):
    rng = random.Random(12)
    base = prose(rng, 200).split()
    near = base[:60] + ["changed"] + base[61:130] + ["altered"] + base[131:180] + ["other"] + base[181:]
    far = base[:25] + ["a1"] + base[26:50] + ["a2"] + base[51:75] + ["a3"] + base[76:100] + ["a4"] + base[101:125] + ["a5"] + base[126:150] + ["a6"] + base[151:]
    texts = [" ".join(w) for w in (base, near + ["x", "y", "z", "u", "v"], far)]
    assert 0.80 <= similarity(*texts[:2]) < 0.85 and similarity(texts[0], texts[2]) < 0.8 and similarity(texts[1], texts[2]) < 0.8
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_near_dedup_keeps_one_row_of_a_group(spark):
    rng = random.Random(13)
    twice, nulls, one, other = (prose(rng, 60) for _ in range(4))
    texts = [twice, twice, nulls, nulls, one, one, other, None, None, ""]
    ids = [4, 4, None, None, None, 6, 6, 9, None, None]
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, texts, ids=ids), "")
    assert kept.columns == docs(spark, []).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(4, twice), (None, nulls), (6, one), (6, other), (9, None), (None, None), (None, "")], key=str)
    stripped = corpus_pipeline.substring_stage(spark, kept, "")
    assert {r.text for r in stripped.collect()} >= {twice, nulls, one, other}
