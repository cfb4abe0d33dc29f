import duckdb

from kinfold.llm import mixing
from kinfold.llm.queries import ORACLES, QUERIES


def water(sizes, weights):
    """Targets by resharing until none is above its cap."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [3.0 * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if target[i] > 3 * sizes[i]} - capped
        if not over:
            return target
        capped |= over


def test_targets(spark):
    for sizes in ([10, 10, 10], [1, 500, 3, 0, 9], [7], [0, 0, 4], [1000, 1, 1, 1, 50, 2]):
        rows = [(f"s{i}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert all(abs(got[name] - w) < 1e-6 for (name, _), w in zip(rows, want, strict=True))


def check(rows, floor=True):
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(r["source"] if "source" in r.__fields__ else r["target"], [0, 0, r])
        x[0] += r["taken"]
        x[1] += r["size"]
    for taken, size, r in by.values():
        assert size == r["source_size"] and taken == int(r["target"] if size else 0)


def test_takes_the_targets_exactly_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), f"s{i % 7 if i % 3 else 0}", "x") for i in range(500)] + [(1000, "a b", None, "x"), (1001, None, None, "x"), (1001, None, None, "x"), (None, "c", "s1", "x"), (1002, "z " * 9000, "s2", "x"), (1003, "z", "s3", "x"), (1003, "z", "s3", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start string").repartition(5)
    out = mixing.mix(df, block=16).collect()
    assert len(out) == len(rows)
    check(out)
    key = lambda r: (str(r), )
    assert sorted(out, key=key) == sorted(mixing.mix(df.repartition(3), block=16).collect(), key=key)


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 50_000, 30_000.0), ("b", 50_000, 20_000.0), ("c", 9000, 10_000.0)], "source string, source_size long, target double")
    slots = [r["source"] for r in mixing.schedule(goals, 10).filter("slot is not null").orderBy("slot").collect()]
    for n in (100, 1000, 5000):
        for name, share in (("a", 0.5), ("b", 1 / 3), ("c", 1 / 6)):
            assert abs(slots[:n].count(name) - share * n) <= 6


def test_driver_table_and_empty_table(spark, sf_dir):
    rows = QUERIES["op2_low_discrepancy_mix"](spark, sf_dir).collect()
    assert len(rows) == 200 and sum(r["taken"] for r in rows) > 0.99 * sum(r["size"] for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_oracle(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(ORACLES["op2_low_discrepancy_mix"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op2_low_discrepancy_mix"](spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want
