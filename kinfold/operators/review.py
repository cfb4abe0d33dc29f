"""Review queues, the decision log, and what human decisions do to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = ("REPRESENTS", "SANCTIONED")


def _page(df: DataFrame, order: list[Column], limit: int, most: int) -> DataFrame:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return df.orderBy(*order).limit(limit)


def candidates_page(edges: DataFrame, entities: DataFrame, reviewed: bool = False, cursor: Column | None = None, limit: int = 50) -> DataFrame:
    """The newest edges (src, dst, confidence, method, detected_at, rules, confidences, dates, conflict, reviewed) with both ends' names.

    detections holds (rule, confidence, detected_at) without null rules; an edge without arrays has one from its summary.
    The cursor is strict; ties are ordered by ends.
    """
    rows = edges.filter(F.col("reviewed") == reviewed)
    if cursor is not None:
        rows = rows.filter(F.col("detected_at") < cursor)
    one = lambda arrays, value: F.coalesce(arrays, F.array(value))
    lists = F.arrays_zip(one(F.col("rules"), F.col("method")).alias("rule"), one(F.col("confidences"), F.col("confidence")).alias("confidence"), one(F.col("dates"), F.col("detected_at")).alias("detected_at"))
    top = _page(rows, [F.desc("detected_at"), F.col("src"), F.col("dst")], limit, 500)
    names = entities.select("id", "name")
    joined = top.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    return joined.select("src", "src_name", "dst", "dst_name", "confidence", F.col("method").alias("rule_name"), "detected_at", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.filter(lists, lambda x: x["rule"].isNotNull()).alias("detections"))


def relationships_page(edges: DataFrame, relation: str, as_of: Column, reviewed: bool = False, limit: int = 50) -> DataFrame:
    """The newest edges (edge_id, rel, src, dst, ...) of a relation; without a date they count as of ``as_of``."""
    if relation not in RELATIONS:
        raise ValueError(f"unsupported relation {relation}")
    return _page(edges.filter((F.col("rel") == relation) & (F.col("reviewed") == reviewed)), [F.coalesce("detected_at", as_of).desc(), F.col("edge_id")], limit, 500)


def decisions_page(log: DataFrame, entity_type: str | None = None, entity_id: str | None = None, rule_name: str | None = None, decision_type: str | None = None, since: Column | None = None, cursor: Column | None = None, limit: int = 100) -> DataFrame:
    """The newest rows of the decision log under the filters given; entity_id may stand on either side."""
    rows = log
    for column, value in (("entity_type", entity_type), ("rule_name", rule_name), ("decision_type", decision_type)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if entity_id is not None:
        rows = rows.filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))
    if since is not None:
        rows = rows.filter(F.col("decided_at") >= since)
    if cursor is not None:
        rows = rows.filter(F.col("decided_at") < cursor)
    return _page(rows, [F.desc("decided_at"), F.col("decision_id")], limit, 1000)


def _undirected(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def decide(edges: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after, merges (canonical, merged)). choices: (a, b, choice): merge, reject or keep_as_related, for a pair in either direction.

    reject deletes the pair's edges, keep_as_related marks them reviewed and kept, merge does the same as a merge of b into a
    and drops the edge with the node.
    """
    given = choices.select(*_undirected("a", "b"), "choice", "a", "b")
    rows = edges.withColumns({"low": F.least("src", "dst"), "high": F.greatest("src", "dst")}).join(given, ["low", "high"], "left")
    merges = rows.filter("choice = 'merge'").select(F.col("a").alias("canonical"), F.col("b").alias("merged")).distinct()
    kept = F.coalesce(F.col("choice") == "keep_as_related", F.lit(False))
    after = rows.filter("choice is null or choice = 'keep_as_related'").withColumns({"reviewed": F.col("reviewed") | kept, "kept": F.coalesce("kept", F.lit(False)) | kept})
    return after.select(*edges.columns), merges


def decide_relationships(edges: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after, log rows). choices: (edge_id, choice, reviewer): accept marks reviewed, reject deletes."""
    rows = edges.join(choices, "edge_id", "left")
    log = rows.filter("choice is not null").select("edge_id", F.concat(F.lit("manual_"), "choice").alias("decision_type"), F.coalesce("method", "rel").alias("rule_name"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "reviewer")
    after = rows.filter("coalesce(choice, '') <> 'reject'").withColumn("reviewed", F.col("reviewed") | F.coalesce(F.col("choice") == "accept", F.lit(False)))
    return after.select(*edges.columns), log
