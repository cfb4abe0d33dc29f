"""The event log as a stream: which entities to consolidate again, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Entity events and what each re-evaluates: label and payload field; deletions none (fixed values).
TARGETS = {
    "UpsertCompany": ("Company", "gmr_id"), "UpsertContract": ("Contract", "ted_notice_id"), "UpsertAuthority": ("Authority", "authority_id"), "UpsertFiling": ("Company", "gmr_id"),
    "DeleteCompany": None, "DeleteContract": None, "DeleteAuthority": None, "DeleteFiling": None,
}
EVENT = "seq long, event_type string, iri string, domain string, payload map<string,string>, batch_id string, producer string, ts timestamp"


def route(events: DataFrame, upstream: int | None = None) -> DataFrame:
    """(seq, event_type, label, entity_id, status) of the entity events; own outputs and control marks are left out.

    status: dispatch; noop for deletions; missing_id for an upsert without its id. upstream: only events up to that seq.
    """
    rows = events.filter(F.col("event_type").isin(*TARGETS))
    if upstream is not None:
        rows = rows.filter(F.col("seq") <= upstream)
    known = [(k, *v) for k, v in TARGETS.items() if v]
    pick = lambda i: F.create_map(*[F.lit(x) for k in known for x in (k[0], k[i])])[F.col("event_type")]
    rows = rows.withColumn("label", pick(1)).withColumn("entity_id", F.col("payload")[pick(2)])
    status = F.when(F.col("label").isNull(), "noop").when(F.coalesce(F.col("entity_id"), F.lit("")) == "", "missing_id").otherwise("dispatch")
    return rows.select("seq", "event_type", "label", "entity_id", status.alias("status"))


def due(events: DataFrame, upstream: int | None = None) -> DataFrame:
    """(label, entity_id, first_seq, n_events) to consolidate: each entity once, however often it is named."""
    return route(events, upstream).filter("status = 'dispatch'").groupBy("label", "entity_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_events"))


def start(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str = EVENT, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 16) -> StreamingQuery:
    """Consumes a growing folder of Parquet events; handle(due, batch) runs for each micro-batch and must be idempotent.

    Offsets are Spark's checkpoint: a batch that fails is given again as a whole.
    """
    events = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
    return events.writeStream.foreachBatch(lambda df, batch: handle(due(df), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def overwrite_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch writes again in place: one folder for each batch."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
