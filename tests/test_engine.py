import random

import pytest
from pyspark.sql import functions as F

from kinfold.config import Settings
from kinfold.operators import apply, engine, evaluate, graph, resolve, review, rules

FOUND = "source_id string, target_id string, confidence double, action string, conflict boolean, conflict_property string, rule string, priority int, threshold double, forced boolean"


def outcomes(spark, rows, enabled=False):
    df = spark.createDataFrame([(*r[:5], None, *r[5:]) for r in rows], FOUND)
    return {(r["source_id"], r["target_id"], r["rule"]): (r["decided"], r["outcome"]) for r in engine.decide(df, Settings(auto_merge_enabled=enabled)).collect()}


def test_promotion_force_gate_and_short_circuit(spark):
    rows = [
        ("a", "b", 0.98, "flag", False, "fuzzy", 11, 0.97, False), ("a", "c", 0.96, "flag", False, "fuzzy", 11, 0.97, False), ("a", "d", 0.99, "flag", True, "fuzzy", 11, 0.97, False),
        ("a", "e", 1.0, "merge", False, "lei", 1, None, True), ("a", "e", 0.95, "flag", False, "name", 10, None, False), ("a", "f", 0.0, "noop", False, "fuzzy", 11, 0.97, False),
        ("a", "g", 0.9, "link", False, "l", 12, None, False), ("a", "g", 0.9, "flag", False, "m", 13, None, False), ("a", "h", 0.95, "flag", False, "x", 10, None, False), ("a", "h", 0.93, "flag", False, "y", 11, None, False), ("a", "a", 1.0, "enrich", False, "t", 5, None, False),
    ]
    off = outcomes(spark, rows)
    assert off["a", "b", "fuzzy"] == ("merge", "flag") and off["a", "c", "fuzzy"] == ("flag", "flag") and off["a", "d", "fuzzy"] == ("flag", "conflict")
    assert off["a", "e", "lei"] == ("merge", "auto_merge") and ("a", "e", "name") not in off and off["a", "f", "fuzzy"] == ("noop", "noop")
    assert off["a", "g", "l"][1] == "auto_link" and ("a", "g", "m") not in off and off["a", "h", "y"][1] == "flag" and off["a", "a", "t"][1] == "enrich"
    assert outcomes(spark, rows, True)["a", "b", "fuzzy"] == ("merge", "auto_merge")


def company(spark, rows):
    return rules.prepare(spark.createDataFrame(rows, "id string, name string, country string, lei string, cik string, vat string, active boolean, created_at string"))


L1, L2 = "5299" + "A" * 16, "5299" + "B" * 16


def test_company_rules(spark):
    df = company(spark, [("1", "Acme", "DEU", L1, None, "DE123456789", True, "2020"), ("2", "ACME!", "DEU", L2, None, None, False, "2019"), ("3", "Other", "FRA", L1, None, "DE987654321", True, None), ("4", "Acme", None, None, None, "1-2-3-4", None, ""), ("5", "", "DEU", "", "", "", None, None)])
    t, s = rules.Tables(df), Settings()
    pair = lambda f: {(r["source_id"], r["target_id"]): (r["action"], r["conflict_property"]) for r in f.collect()}
    assert pair(rules.exact_id("lei")(t, s)) == {("1", "3"): ("flag", "vat"), ("3", "1"): ("flag", "vat")}
    assert pair(rules.successor(t, s)) == {("1", "2"): ("merge", None)}
    assert pair(rules.name_country_company(t, s)) == {("1", "2"): ("flag", "lei"), ("2", "1"): ("flag", "lei")}
    fuzzy = pair(rules.fuzzy_company(t, s))
    assert fuzzy == {("1", "2"): ("noop", None), ("2", "1"): ("noop", None)}
    assert [r.name for r in rules.select("Company", "enrich_only")] == [] and len(rules.select("Company")) == 8 and len(rules.select("Company", exclude_prefix="gds_")) == 6
    assert rules.describe(spark).count() == 17
    with pytest.raises(ValueError, match="mode"):
        rules.select("Company", "x")


def test_summary_and_outcomes(spark):
    df = company(spark, [("1", "Acme", "DEU", L1, None, None, True, "2020"), ("2", "Acme GmbH", "DEU", L1, None, None, True, "2020"), ("9", "Lone", "DEU", None, None, None, True, None)])
    found = engine.candidates(rules.Tables(df), "Company", Settings())
    judged = engine.judge(found, Settings())
    done = engine.decide(found, Settings())
    ids = spark.createDataFrame([("1",), ("9",), ("zz",)], "id string")
    got = {r["id"]: r["outcome"] for r in engine.run_summary(ids, df, judged).collect()}
    assert got == {"1": "merged", "9": "no_match", "zz": "not_found"}
    assert engine.batch_summary(engine.run_summary(ids, df, judged), done).first()["merged"] == 2
    assert engine.candidates(rules.Tables(df), "Contract", Settings()).count() == 0


def test_greedy_merges_follow_the_order_of_sources(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("e", "d")]
    df = spark.createDataFrame([(*r, "auto_merge") for r in rows], "source_id string, target_id string, outcome string")
    # a takes b; b is gone; c takes d; e finds d gone.
    assert sorted(tuple(r) for r in engine.greedy_merges(df).collect()) == [("a", "b"), ("c", "d")]


def test_greedy_merges_end_only_when_nothing_is_open(spark):
    ids = [f"n{i:02}" for i in range(46)]
    df = spark.createDataFrame([(*r, "auto_merge") for r in zip(ids, ids[1:])], "source_id string, target_id string, outcome string")
    # Each source in turn takes the next, which then takes nothing: one merge a round, 23 in all.
    want = list(zip(ids[::2], ids[1::2]))
    assert sorted(tuple(r) for r in engine.greedy_merges(df.coalesce(1)).collect()) == want
    # The same where the component is too large for one task: rounds cut it first.
    assert sorted(tuple(r) for r in engine.greedy_merges(df.coalesce(1), together=20).collect()) == want


def test_greedy_pass_is_greedy_merges_of_its_decisions(spark):
    some = random.Random(7)
    pick = lambda *values: some.choice(values)
    rows = [(f"{some.randrange(70):02}", pick("Acme", "Acme GmbH", "Bolt", "", None), pick("DEU", "FRA", None), pick(L1, L2, "x", "", None), pick("0000000001", "2", None, None), pick("DE123456789", "FR1", None, None), pick(True, False, None), None) for _ in range(90)]
    entities = company(spark, [*rows, *rows[:3]])
    active, settings = [r for r in rules.select("Company") if r.priority in (1, 2, 3, 9, 10, 11)], Settings(auto_merge_enabled=True)
    t = rules.Tables(entities)
    for chosen in (active, active[:1], active[3:4], active[4:]):
        whole = engine.greedy_merges(engine.decide(engine.candidates(t, "Company", settings, rules=chosen), settings))
        assert sorted(map(tuple, engine.greedy_pass(t, "Company", settings, rules=chosen).collect())) == sorted(map(tuple, whole.collect()))
    # The least source of each target, against all pairs of the rule.
    for rule in active[:4]:
        pairs = [(r["target_id"], r["source_id"]) for r in rule.find(t, settings).filter("action = 'merge'").collect()]
        least = {}
        for target, by in rule.least(t, settings).select("target_id", "by").collect():
            least[target] = min(by, least.get(target, by))
        assert least == {target: min(by for x, by in pairs if x == target) for target, _ in pairs}


def test_fold_keeps_latest_and_sticky_flags(spark):
    rows = [("a", "b", "r1", 0.9, "d1", True, False, 1), ("a", "b", "r2", 0.95, "d2", False, True, 2), ("a", "b", "r1", 0.95, "d3", False, False, 3)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, rule string, confidence double, detected_at string, reviewed boolean, conflict boolean, seq int")
    r = apply.fold_detections(df).first()
    assert (r["rules"], r["confidences"], r["method"], r["detected_at"], r["reviewed"], r["conflict"]) == (["r2", "r1"], [0.95, 0.95], "r2", "d2", True, True)


def test_clusters_merge_and_contraction(spark):
    same = spark.createDataFrame([("A", "B", True, False, False), ("B", "C", True, False, False), ("D", "E", False, False, False), ("F", "G", True, True, False), ("H", "I", True, False, True)], "src string, dst string, reviewed boolean, conflict boolean, kept boolean")
    ents = company(spark, [(x, x, "DEU", L1 if x == "B" else None, None, None, True, None) for x in "ABCDEFGHI"])
    got = {r["id"]: r["canonical"] for r in graph.cluster_collapse(same, ents).collect()}
    assert got == {"A": "B", "B": "B", "C": "B", "H": "H", "I": "H"}
    assert "H" not in {r["id"] for r in graph.cluster_collapse(same, ents, exclude_kept=True).collect()}
    merges = spark.createDataFrame([("B", "A", "old"), ("B", "C", None), ("B", "zz", "x")], "canonical string, merged string, retired_lei string")
    left = {r["id"]: r["historic_leis"] for r in apply.collapse_entities(ents, merges).collect()}
    assert set(left) == set("BDEFGHI") and left["B"] == ["old"]
    edges = spark.createDataFrame([("A", "x", "1"), ("C", "x", "1"), ("A", "x", "B")], "src string, rel string, dst string")
    assert [tuple(r) for r in graph.contract(edges, merges).collect()] == [("B", "x", "1")]
    assert graph.connected_components(same.limit(0)).count() == 0


def test_resolver(spark):
    ents = company(spark, [("1", "Acme Industries", "DEU", L1, None, "DE123456789", True, None), ("2", "Acme Industries", "DEU", L2, None, None, True, None), ("3", "Unique Works", "FRA", None, "5", None, True, None)]).withColumn("registered_as", F.when(F.col("id") == "3", "R1"))
    asks = [(1, "Acme Industries", "Germany", L1.lower(), None, None, None), (2, "ACME industries", "DE", None, None, None, None), (3, "Acme Industries", None, None, None, None, None), (4, None, "FR", None, None, None, " R1 "), (5, "IBM", "DE", None, None, None, None), (6, None, None, None, None, "005", None), (7, None, None, None, None, None, None)]
    df = spark.createDataFrame(asks, "row_id int, name string, country string, lei string, vat string, cik string, registered_as string")
    got = {r["row_id"]: (r["hint"], r["tier"], r["match_id"]) for r in resolve.resolve(df, ents).collect()}
    assert got == {1: ("matched", "lei", "1"), 2: ("ambiguous", "name_country", None), 3: ("no_match", None, None), 4: ("matched", "registered_as", "3"), 5: ("no_match", None, None), 6: ("matched", "cik", "3"), 7: ("no_match", None, None)}


def test_review_and_enrichment(spark):
    with pytest.raises(ValueError, match="relation"):
        review.relationships_page(spark.range(0), "OTHER", F.lit(None))
    with pytest.raises(ValueError, match="limit"):
        review.decisions_page(spark.range(0), limit=1001)
    ents = spark.createDataFrame([("a", "Stad", "BEL", None)], "id string, name string, country string, name_lang string").withColumn("translations", F.create_map(F.lit("fr"), F.lit("Ville")))
    made = apply.offline_translations(ents)
    assert made.first()["source_lang"] == "nl" and len(made.first()["translations"]) == 22
    found = spark.createDataFrame([("a", {"de": "Stadt", "x1": "no"}, [1.0], None)], "id string, translations map<string,string>, embedding array<float>, encoder string")
    out = apply.enrich(ents, found.withColumn("embedding", F.lit(None).cast("array<float>"))).first()
    assert out["translations"] == {"fr": "Ville", "de": "Stadt"}
    with pytest.raises(Exception, match="embedding without encoder"):
        apply.enrich(ents.withColumns({"vector": F.lit(None).cast("array<float>"), "encoder": F.lit(None).cast("string")}), found).collect()


def test_metrics(spark):
    rows = [(True, True)] * 98 + [(False, True)] * 2 + [(True, False)] * 10 + [(False, False)] * 1000
    r = evaluate.confusion(spark.createDataFrame(rows, "same boolean, linked boolean")).first()
    assert (r["precision"], r["recall"]) == (0.98, 0.9074)
    assert evaluate.confusion(spark.createDataFrame([], "same boolean, linked boolean")).first()["precision"] == 1.0


def test_enrichment_broadcasts_no_translations(spark, sf_dir):
    from kinfold.plans.queries import QUERIES

    assert "Broadcast" not in QUERIES["enrich_apply"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_hot_key_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(rules, "DEALT", 4)
    ents = spark.createDataFrame([(f"e{i}", "x" if i < 40 else f"y{i // 2}", None, f"DE{i % 3:09d}") for i in range(60)], "id string, lei string, cik string, vat string").withColumn("name", F.lit("n"))
    found = rules.exact_id("lei")(rules.Tables(rules.prepare(ents)), Settings())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lei = {r["id"]: r["lei"] for r in ents.collect()}
    assert sorted((r["source_id"], r["target_id"]) for r in got) == sorted((a, b) for a in lei for b in lei if a != b and lei[a] == lei[b])
    assert len({r["task"] for r in got if lei[r["source_id"]] == "x"}) > 1


def test_greedy_pass_asks_again_instead_of_making_many_pairs(spark, sf_dir, monkeypatch):
    from kinfold.plans import queries

    made = []
    whole = engine.candidates
    t, settings = queries._once(spark, sf_dir), Settings(auto_merge_enabled=True)
    want = sorted(map(tuple, engine.greedy_merges(engine.decide(whole(t, "Company", settings, rules=queries.MATCH_RULES), settings)).collect()))
    monkeypatch.setattr(engine, "candidates", lambda *a, **k: made.append([r.name for r in k["rules"]]) or whole(*a, **k))
    monkeypatch.setattr(engine, "MADE", 0)
    assert sorted(map(tuple, engine.greedy_pass(t, "Company", settings, rules=queries.MATCH_RULES).collect())) == want
    assert made == [[r.name for r in queries.MATCH_RULES if not r.least]]


def test_fold_pass_is_the_fold_of_its_decisions(spark):
    some = random.Random(11)
    pick = lambda *values: some.choice(values)
    rows = [(f"{i:02}", pick("Acme", "Acme GmbH", "Bolt", "", None), pick("DEU", "FRA", None), pick(L1, L2, L1.lower(), "x", "", None), pick("0000000001", "1", "2", None), pick("DE123456789", "DE987654321", "FR1", None), pick(True, False, None), None) for i in range(90)]
    active, settings = [r for r in rules.select("Company") if r.priority in (1, 2, 3, 9, 10, 11)], Settings()
    shown = ["source_id", "target_id", "reviewed", "conflict", "rules", "confidences", "dates", "confidence", "method", "detected_at"]
    both = set()
    for entities, chosen in ((rows, active), ([*rows, *[(x[0], *y[1:]) for x, y in zip(rows[:9], rows[9:])]], active[:5]), (rows, [])):
        t = rules.Tables(company(spark, entities))
        decided = engine.decide(engine.candidates(t, "Company", settings, rules=chosen), settings, chosen).filter("outcome in ('flag', 'conflict')")
        want = apply.fold_detections(decided.select("source_id", "target_id", "rule", F.round("confidence", 6).alias("confidence"), F.lit("d").alias("detected_at"), F.lit(False).alias("reviewed"), "conflict", F.col("priority").alias("seq")))
        got = engine.fold_pass(t, "Company", settings, F.lit("d"), 6, rules=chosen)
        assert got.dtypes == want.select(*shown).dtypes
        got = sorted(map(tuple, got.collect()), key=str)
        assert got == sorted(map(tuple, want.select(*shown).collect()), key=str)
        both |= {(r[3], tuple(r[4])) for r in got}
    assert {x for x in both if len(x[1]) > 1} >= {(True, ("exact_lei_match", "exact_cik_match")), (True, ("exact_lei_match", "exact_name_country_match")), (False, ("exact_name_country_match", "fuzzy_name_same_country"))}


def test_pairs_in_conflict_are_folded_without_a_shuffle(spark, sf_dir, monkeypatch):
    from kinfold.plans.queries import QUERIES

    whole, shuffled = apply.fold_detections, []
    monkeypatch.setattr(apply, "fold_detections", lambda rows: shuffled.append(rows) or whole(rows))
    got = QUERIES["same_as_fold"](spark, sf_dir)
    assert not got.filter("conflict").isEmpty() and not got.filter("not conflict").isEmpty()
    assert len(shuffled) == 1 and shuffled[0].filter("conflict").isEmpty()
