import duckdb
from pyspark.sql import functions as F

from kinfold.llm import revisits
from kinfold.llm.queries import ORACLES, QUERIES

SCHEMA = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_canonical_url(spark):
    urls = ["HTTP://www.A.example:80/x/?utm_source=f&b=1#top", "https://a.example/x?b=1", "a.example/x/", None, "https://a.example?ref=1", "http://a.example/p?ref=x&q=2&utm_m=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["a.example/x?b=1", "a.example/x?b=1", "a.example/x", "", "a.example", "a.example/p?q=2"]


def test_resolution_against_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["http://h/x", "http://h/y#f", "http://h/hot", "http://h/hot", None]), base + dt.timedelta(minutes=rng.randrange(4000)) if rng.random() > 0.05 else None, rng.choice(["response", "revisit", "revisit", "request"]), rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "Mon", "Tue"]), rng.choice([None, "d1", "d2"]), rng.choice([None, {"etag": "x", "server": "s", "x": str(i)}])) for i in range(400)]
    got = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    key = lambda r: (r[2] is not None, r[2] or base, r[0])
    url = lambda u: (u or "").split("#")[0]
    bare = lambda e: e and e.removeprefix("W/")
    n = 0
    for r in rows:
        if r[3] != "revisit":
            continue
        n += 1
        earlier = [x for x in rows if x[3] == "response" and url(x[1]) == url(r[1]) and r[1] is not None and key(x) < key(r)]  # without a URL, none
        out = got[r[0]]
        if not earlier:
            assert out["status"] == "no_response" and out["refers_to"] is None
            continue
        x = max(earlier, key=key)
        checks = [a == b for a, b in ((bare(r[4]), bare(x[4])), (r[5], x[5]), (r[6], x[6])) if a and b]
        status = "mismatch" if False in checks else "resolved" if checks else "unchecked"
        assert (out["refers_to"], out["status"]) == (x[0], status)
        own, full = r[7] or {}, x[7] or {}
        assert out["headers"] == (own if status == "mismatch" else full | {k: v for k, v in own.items() if k in revisits.PERMITTED})
    assert len(got) == n
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(duckdb.sql(ORACLES["op7_revisit_resolution"]).fetchall(), key=str)
    got = QUERIES["op7_revisit_resolution"](spark, sf_dir).select("record_id", "canonical_url", "refers_to", "status", "content_type", "date")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
