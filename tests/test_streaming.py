from pyspark.sql import functions as F

from kinfold.streaming import dispatch, sweep


def test_stream_dispatches_each_entity_once_and_resumes(spark, tmp_path):
    rows = [(1, "UpsertCompany", {"gmr_id": "a"}), (2, "AssertSameAs", {}), (3, "UpsertFiling", {"gmr_id": "a"}), (4, "DeleteCompany", {"gmr_id": "a"}), (5, "UpsertAuthority", {}), (6, "UpsertContract", {"ted_notice_id": "n"})]
    events = spark.createDataFrame(rows, "seq long, event_type string, payload map<string,string>").select("seq", "event_type", F.lit("i").alias("iri"), F.lit("d").alias("domain"), "payload", F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("string").alias("producer"), F.lit(None).cast("timestamp").alias("ts"))
    status = {r["seq"]: r["status"] for r in dispatch.route(events).collect()}
    assert status == {1: "dispatch", 3: "dispatch", 4: "noop", 5: "missing_id", 6: "dispatch"}
    assert dispatch.route(events, upstream=3).count() == 2
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(source)
    for _ in range(2):
        dispatch.start(spark, source, str(tmp_path / "offsets"), dispatch.overwrite_batch(out)).awaitTermination()
    assert sorted((r["label"], r["entity_id"], r["n_events"]) for r in spark.read.parquet(out).collect()) == [("Company", "a", 2), ("Contract", "n", 1)]
    events.limit(1).withColumn("seq", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(source)
    dispatch.start(spark, source, str(tmp_path / "offsets"), dispatch.overwrite_batch(out)).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_sweep_takes_the_stalest_first(spark):
    df = spark.createDataFrame([("a", 50), ("b", None), ("c", 10), ("d", 20)], "id string, t int").select("id", F.timestamp_seconds("t").alias("last_consolidated_at"))
    assert [r["id"] for r in sweep.stalest(df, 3).collect()] == ["b", "c", "d"]
    pages = []
    after = sweep.sweep(df, lambda p: pages.append([r["id"] for r in p.collect()]), lambda k: F.timestamp_seconds(F.lit(100 + k)), 3, 2)
    assert pages == [["b", "c"], ["d", "a"], ["b", "c"]]
    assert sweep.rotation_lag(after, F.timestamp_seconds(F.lit(201))).first()["lag_seconds"] == 100


def test_pacer_spaces_slots_without_debt():
    p = sweep.Pacer(2)
    assert [p.delay(t) for t in (0.0, 0.0, 0.2)] == [0.0, 0.5, 0.8]
    assert p.delay(10.0) == 0.0 and p.delay(10.0) == 0.5
    assert sweep.Pacer(0).delay(1.0) == 0.0
