import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import suffix_tree
from kinfold.llm.queries import QUERIES

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def base(rows, held):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def test_base_score_and_gain_on_held_out_text(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = base(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    got = QUERIES["op1_suffix_tree_scoring"](spark, sf_dir).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert abs(r.base_score - want[r.doc_id][3]) < 1e-6 * abs(r.base_score)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_rare_words_take_the_join_and_agree(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * i + k * k) % 97}" for k in range(40)) + (" New one" if i % 7 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    all_here = {r[0]: r for r in suffix_tree.learn_and_score(df, held).collect()}
    monkeypatch.setattr(suffix_tree, "FREQUENT_SHARE", 0.005)
    want = base(rows, lambda i: i % 4 == 1)
    for r in suffix_tree.learn_and_score(df, held).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 and math.isfinite(r["score"]) and r["score"] < 0
        assert abs(r["base_score"] - all_here[r["doc_id"]]["base_score"]) < 1e-6


def test_distributions_sum_to_one(spark):
    text = "the cat sat on the mat and the dog sat on the log " * 20
    df = spark.createDataFrame([(i, text + f"odd{i}") for i in range(30)], "doc_id long, text string")
    tree, _ = suffix_tree.train(df)
    root = tree.root()
    assert abs(root.sum() - 1) < 1e-9 and (tree.levels[0].total > 0).any() and len(tree.pairs)
    s = np.arange(tree.rare + 1)
    for one in np.flatnonzero(tree.levels[0].total > 0):
        assert abs(tree.probability(s, [np.full(len(s), one)], root).sum() - 1) < 1e-9
    for two in np.flatnonzero(tree.levels[1].total > 0):
        one = tree.pairs[two] % (tree.rare + 1)
        assert abs(tree.probability(s, [np.full(len(s), one), np.full(len(s), two)], root).sum() - 1) < 1e-9


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a"), (3, "a"), (4, "b " * 50_000), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("c", F.lit(1))
    df = df.union(df.filter("doc_id = 1"))  # a row that repeats both id and text
    out = suffix_tree.learn_and_score(df, F.lit(False)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 2), (1, 1), (1, 1), (2, 1), (3, 2), (3, 3), (4, 50_001)]
    assert len({(r["base_score"], r["score"]) for r in out if r["doc_id"] in (1, 2)}) == 1
    assert suffix_tree.learn_and_score(df.limit(0), F.lit(False)).count() == 0
    none = suffix_tree.learn_and_score(df, F.lit(True)).collect()
    assert len(none) == 7 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_what_is_kept_does_not_depend_on_the_size_of_the_corpus(spark):
    few = [(i, f"{a} brown {b}") for i in range(16) for a, b in (("quick", "foxes"), ("big", "bears"))]
    rest = [(100 + i, " ".join(f"x{i}y{k}" for k in range(10_000))) for i in range(200)]  # 2,000,000 other words
    small, _ = suffix_tree.train(spark.createDataFrame(few, "doc_id long, text string"))
    large, _ = suffix_tree.train(spark.createDataFrame(few + rest, "doc_id long, text string").repartition(4))
    assert set(small.words) <= set(large.words) and large.rare >= small.rare == 6
    for a, b in zip(small.levels, large.levels, strict=True):
        assert 0 < (a.total > 0).sum() <= (b.total > 0).sum() and (b.keys >= 0).sum() >= (a.keys >= 0).sum() > 0


def test_the_tree_is_a_table_that_no_process_holds(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tree, _ = suffix_tree.train(docs)
    assert tree.rare > 1000 and len(pickle.dumps(tree)) < 10_000 and isinstance(tree.words.base, np.memmap)
    whole = {r["doc_id"]: r["score"] for r in suffix_tree.learn_and_score(docs, F.lit(False)).collect()}
    monkeypatch.setattr(suffix_tree, "BUCKET", 500)  # many buckets
    for r in suffix_tree.learn_and_score(docs, F.lit(False)).collect():
        assert abs(r["score"] - whole[r["doc_id"]]) <= 1e-9 * abs(r["score"])
