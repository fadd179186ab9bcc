"""Texts longer than a slice of the kernels, ids that are texts, nulls and repeated rows through operators and pipeline."""

import hashlib
import pickle
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from skeinflow.llm import bpe, kernels, mixing, quality_classifier, quality_rules, substring_dedup, toxicity
from skeinflow.llm.minhash_dedup import near_duplicates
from tests.llm.test_operators import WORD, brute_components, brute_counts, brute_repeats, docs, prose


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(30)
    long = prose(rng, 180_000)
    assert len(long) > kernels.SLICE_BYTES
    words = long.split()
    near = " ".join([*words[:90_000], "other", *words[90_001:]])
    return [long, near, " ".join(words[500:560]), prose(rng, 80), long, None]


def test_long_texts_in_dedup(spark, long_texts):
    d = docs(spark, long_texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(d).collect()}
    assert got == dict(enumerate(brute_repeats(long_texts)))
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(d).collect()}
    assert found == set(brute_components(long_texts, list(range(len(long_texts)))))


def test_long_texts_in_rules_and_models(spark, long_texts):
    d = docs(spark, long_texts)
    for r in quality_rules.quality(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(long_texts[r.doc_id])
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for scored in (quality_classifier.quality_scores(d, labels), toxicity.toxicity(d, labels)):
        by_id = {r.doc_id: r.score for r in scored.collect()}
        assert len(by_id) == len(long_texts) and by_id[0] == by_id[4] and all(0 <= s <= 1 for s in by_id.values())


def test_long_texts_in_encoding(spark, long_texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.parse_ranks(open(path, "rb").read()))}, special_tokens={})
    for r in bpe.encode_documents(docs(spark, long_texts), path, P.PATTERN, with_ids=False).collect():
        ids = ref.encode_ordinary(long_texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_text_ids_and_repeated_rows_through_the_pipeline(spark):
    """Every good text is in the mix, whatever ids its rows bear, and no stage ends on ids that are no numbers."""
    rng = random.Random(31)
    texts = [prose(rng, 120) for _ in range(40)]
    rows = [(f"id-{i}", t) for i, t in enumerate(texts)]
    rows += [("id-0", texts[0]), ("id-0", texts[0]), ("id-1", texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[4]), (None, None), ("id-5", None), ("id-5", "")]
    schema = "text string, lang string, source string, n_chars long, d1 long, bands string, size long, t1 long, part int, grp int, kept int, doc_id string"
    d = spark.createDataFrame([(t, "en", "s", len(t or ""), 1, "b", 2, 4, 5, 6, 7, i) for i, t in rows], schema)
    columns, kept = d.columns, set()
    for name, f in corpus_pipeline.STAGES[:3]:
        d = f(spark, d, "")
        assert d.columns == columns, name
        if name == "quality_rules":
            kept = {r.text for r in d.collect()}
            assert len(kept) >= 34 and None not in kept
    assert sorted(r.text for r in d.collect()) == sorted(kept)
    mixed = corpus_pipeline.mixing_stage(spark, d, "")
    assert mixed.columns == columns and mixed.count() > 0
    assert corpus_pipeline.bpe_stage(spark, mixed, "").count() == mixed.count()


def test_mix_tells_sources_apart(spark):
    """Rows equal in id and text but of different sources keep their own parts of the plan."""
    rng = random.Random(32)
    same = prose(rng, 40)
    rows = [(7, same, s) for s in ("a", "b", "c")] + [(i, prose(rng, 30), "abc"[i % 3]) for i in range(100, 160)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing._parts(d).select("doc_id", "source", "tie", "taken").collect():
        want[(r.doc_id, r.source)] = r.taken
    got = dict.fromkeys(want, 0)
    for r in mixing.mix_documents(d).collect():
        got[(r.doc_id, r.source)] += len(WORD.findall(r.text))
    assert got == want


def test_quality_classifier_sends_its_table_once(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"word{i % 7} and more of it " * 5) for i in range(60)], "doc_id long, text string").repartition(8)
    labels = d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v, f=type(spark.sparkContext).broadcast: sent.append(len(pickle.dumps(v))) or f(self, v))
    assert quality_classifier.quality_scores(d, labels).count() == 60
    table = 4 * quality_classifier.DIM << quality_classifier.BITS
    assert sum(n >= table for n in sent) == 1 and sum(sent) < 1.1 * table


def test_sums_of_partitions_meet_before_they_are_passed_on(spark):
    d = spark.createDataFrame([(i, "the same five words here") for i in range(64)], "doc_id long, text string").repartition(8)
    plan = quality_classifier.partial_sums(d)
    assert plan.groupBy("slice").count().where("count > 1").count() == 0 and plan.count() > 0
