import corpus_pipeline
from nothi.llm import common, registry
from nothi.llm import op6_packing as op6
from tests.llm.helpers import docs, empty
from tests.llm.test_toxicity import LABELS, corpus


def test_stages(spark, sf_dir):
    before = common.table(spark, sf_dir, "documents")
    columns, n, ids = before.columns, before.count(), None
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, before, sf_dir), name)
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            totals = after.groupBy("sequence_id").sum("length").collect()
            assert all(t[1] == op6.LENGTH or t[1] & (t[1] - 1) == 0 for t in totals)
            return
        assert after.columns == columns and 0 < after.count() <= n
        assert after.exceptAll(before).isEmpty()
        n, ids, before = after.count(), {r.doc_id for r in after.select("doc_id").collect()}, after
    assert ids


def test_order_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixture", "packing"]
    assert registry.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_odd_tables(spark, tmp_path):
    rows, labels = corpus(60)
    spark.createDataFrame(labels, LABELS).write.parquet(f"file://{tmp_path}/labels.parquet")
    for df in (docs(spark), empty(spark), docs(spark, rows)):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES:
            df = common.materialize(stage(spark, df, f"file://{tmp_path}"), name)
            assert name == "packing" or df.columns == columns
            df.count()
