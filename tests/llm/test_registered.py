import pytest

import corpus_pipeline
from skeinflow.llm import quality_rules, registry
from skeinflow.llm.common import table
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, data, name):
    same(registry.queries()[name](spark, data), connect(data), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_whole_table(spark, data, name):
    of = {"op6_warc": "pages"}.get(name, "documents")
    assert registry.queries()[name](spark, data).count() == table(spark, data, of).count()


def test_quality_counts(spark, data):
    """All that SQL can say of op9's rows."""
    got = registry.queries()["op9_quality_rules"](spark, data).drop("bits", "word_bits", "kept")
    same(got, connect(data), quality_rules.COUNTS)


def test_pipeline_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, data).select("ids_sha256").collect()) == sorted(r.ids_sha256 for r in docs.select("ids_sha256").collect())
