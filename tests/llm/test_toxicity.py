import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import toxicity
from kinfold.llm.queries import QUERIES


def test_nnpu_recovers_the_positive_feature():
    rng = np.random.default_rng(1)
    n, n_p = 3000, 300
    toxic = np.concatenate([np.ones(n_p, bool), rng.random(n - n_p) < 0.2])
    row, column = [], []
    for i in range(n):
        own = [0] if toxic[i] and rng.random() < 0.95 else []
        for c in own + list(1 + rng.choice(20, 4, replace=False)):
            row.append(i)
            column.append(c)
    positive = np.arange(n) < n_p
    row, column = np.array(row), np.array(column)
    w, b = toxicity.nnpu(row, column, positive, 21, 0.2)
    z = b + np.bincount(row, weights=w[column], minlength=n)
    assert ((z > 0) == toxic)[n_p:].mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = QUERIES["op3_nonneg_pu_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    tp = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert tp / (out.toxic == 1).sum() >= 0.85
    assert tp / max((out.predicted == 1).sum(), 1) >= 0.7


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "vile " * 30_000, "z"), (3, "vile", "z"), (None, "vile", None)], "doc_id long, text string, p string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model is None or len(model.keys)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    empty = docs.limit(0)
    assert toxicity.train(empty, labels.limit(0), F.lit(True)) is None
    assert toxicity.score(empty, None).count() == 0
