import corpus_pipeline
from kinfold.llm import toxicity
from pyspark.sql import functions as F

from .test_parity_join import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = {r["doc_id"]: r for r in docs.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, sf_dir)
        assert out.columns == docs.columns, name
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) <= set(now)
        if name == "toxicity":
            model = toxicity.train(docs, labels, F.lit(True))
            score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
            assert set(rows) == {i for i, s in score.items() if s < 0.7} and rows == {i: now[i] for i in rows}
        elif name == "line dedup":
            assert all(len(r["text"]) <= len(now[i]["text"]) and r["n_chars"] == len(r["text"]) for i, r in rows.items())
        elif name == "n-gram Jaccard join":
            assert set(rows) == {c for _, _, c in brute([(i, r["text"]) for i, r in now.items()])} and rows == {i: now[i] for i in rows}
        else:
            items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(t in r["text"] for r in rows.values() for t in items) and rows == {i: now[i] for i in rows}
        now, current = rows, spark.createDataFrame(list(rows.values()), docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, current, sf_dir).collect()
    assert {r["doc_id"] for r in mixed} == set(now) and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, mixed))


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
