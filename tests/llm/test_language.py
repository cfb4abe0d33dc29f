import itertools

import numpy as np

from kinfold.llm import language
from kinfold.llm.queries import QUERIES


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    counts = [0, 1, 4, 7, 3]
    doc = np.repeat(np.arange(5), counts)
    for i, window in itertools.product(range(5), (1, 2, 3, 100)):
        score = rng.normal(0, 2, (len(doc), 3)).astype(np.float32)
        label = language.viterbi(score, doc, 5, 1.5, window)
        s = score[doc == i]
        value = lambda path: sum(s[t, p] for t, p in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        if len(s):
            assert abs(value(label[doc == i]) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-4


def test_spans_and_scripts(spark):
    en, ru = "the quick brown fox jumps over that lazy dog " * 3, "съешь ещё этих мягких французских булок да выпей чаю " * 3
    de = "über die grünen wiesen springt der müde fuchs und schläft nicht "
    train = spark.createDataFrame([(en * 3, "en"), (ru * 3, "ru"), (de * 9, "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.train(train)
    docs = spark.createDataFrame([(1, en), (2, ru + "42"), (3, en + ru), (4, None), (5, "12 %"), (6, ""), (7, "漢字"), (8, de * 2000)], "doc_id long, text string")
    out = {r[0]: (r[1], r[2]) for r in language.identify(docs, model).collect()}
    assert [out[i][0] for i in (1, 2, 4, 5, 6, 8)] == ["en", "ru", "und", "und", "und", "de"]
    assert out[7][0] in model.langs and out[7][1] == 0 and all(0 <= s <= 1 for _, s in out.values())
    got = sorted((r["doc_id"], r["span"], r["lang"], r["first_word"], r["n_words"]) for r in language.spans(docs.filter("doc_id = 3"), model).collect())
    assert got == [(3, 0, "en", 0, 27), (3, 1, "ru", 27, 27)]


def test_nothing_learnt(spark):
    none = spark.createDataFrame([], "text string, lang string")
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [tuple(r) for r in language.identify(docs, language.train(none)).collect()] == [(1, "und", 0.0)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = QUERIES["op5_script_viterbi_language"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.97


def test_many_languages_give_the_same_labels_as_windows():
    rng = np.random.default_rng(5)
    for k in (3, 14):
        score = rng.normal(size=(700, k)) * 4
        doc = np.sort(rng.integers(0, 6, 700))
        a = language._uncut(score, doc, 7, 6.0)
        many, language.MANY = language.MANY, 99
        try:
            b = language.viterbi(score, doc, 7, window=50)
        finally:
            language.MANY = many
        assert a.tolist() == b.tolist()


def test_marks_alone_are_no_letters(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "\u0301\u0302 \u0301", "en"), (3, None, "fr"), (1, "the cat", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(df, language.train(df)).collect())
    assert got == [(1, "en"), (1, "en"), (2, "und"), (3, "und")]
