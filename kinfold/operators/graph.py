"""Connected components as DataFrame joins (alternating large-star and small-star, Kiveris et al. 2014)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder; its lineage ends there, so a lost executor recomputes nothing.

    Only a session of one machine may do without spark.checkpoint.dir.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinfold-"))
    return df.checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above u to the least node of u's neighbourhood. edges: u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its neighbours below u to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


#: Links that one task joins up by itself; more go through rounds over the whole table. It steers work, never a result.
WHOLE = 200_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least one reachable by the links (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    kind = parts[0].schema.field(0).type
    sides = [[x for b in parts for x in b.column(c).to_pylist()] for c in (0, 1)]
    nodes, at = np.unique(np.array(sides[0] + sides[1], object if pa.types.is_string(kind) else None), return_inverse=True)
    label = least_labels(at[: len(sides[0])], at[len(sides[0]) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes.tolist(), kind), pa.array(nodes[label].tolist(), kind)], ["node", "component"])


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", whole: int = WHOLE) -> DataFrame:
    """(node, component) for every node of a link between two nodes; component is the least node reachable.

    Undirected; self-links, nulls and repeated links are ignored. A hub is never gathered in one task: minima are partial
    aggregates and the joins that follow can be split. Each round is checkpointed. Up to ``whole`` links are joined up by one task.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    now = settled(edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(high.alias("u"), low.alias("v")).distinct())
    if now.count() <= whole:
        kind = now.schema["u"].dataType.simpleString()
        return settled(now.coalesce(1).mapInArrow(_joined_up, f"node {kind}, component {kind}"))
    seen = None
    while True:  # ends: each round lowers some label
        # A forest of stars is a fixed point: no node is both a leaf and a centre, and no leaf has two centres.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = settled(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cluster_collapse(same_as: DataFrame, entities: DataFrame, exclude_kept: bool = False) -> DataFrame:
    """(id, component, canonical) of the entities in clusters of reviewed links without conflict.

    Canonical is the member with an LEI, then the oldest (no date counts as latest), then of least id. Only linked
    entities enter; singletons are never looked at.
    """
    kept = same_as.filter("reviewed and not coalesce(conflict, false)")
    if exclude_kept:
        kept = kept.filter("not coalesce(kept, false)")
    of = connected_components(kept, "src", "dst").withColumnRenamed("node", "id")
    lei = F.col("lei").isNotNull() if "lei" in entities.columns else F.lit(False)
    age = F.coalesce(F.when(F.col("created_at") != "", F.col("created_at")), F.lit("￿")) if "created_at" in entities.columns else F.lit("￿")
    members = of.join(entities.select("id", (~lei).alias("no_lei"), age.alias("age")), "id")
    best = members.groupBy("component").agg(F.min(F.struct("no_lei", "age", "id")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    return members.join(best, "component").select("id", "component", F.col("m.id").alias("canonical"))


#: So many of their rarest neighbours must two nodes share to be compared.
HEADS = 3


def node_similarity(neighbours: DataFrame, threshold: float, top_k: int) -> DataFrame:
    """(source_id, target_id, similarity): for each node the top_k others of Jaccard >= threshold over neighbours; ties to the lower id.

    Neighbours are ranked from rare to common; sets with Jaccard >= t share k of the first n - ceil(t * n) + k of each (k up
    to HEADS, as long as t * n is), so only those are joined, the common neighbours never make pairs, and pairs that share
    fewer are no candidates. The others are verified on the whole sets.
    """
    edges = neighbours.select("node", "neighbour").distinct()
    degree = edges.groupBy("neighbour").agg(F.count("*").alias("df"))
    ranked = edges.join(degree, "neighbour").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "neighbour"))).alias("s"))
    n = F.size("s")
    least = F.greatest(F.ceil(F.lit(threshold) * n - 1e-9).cast("int"), F.lit(1))
    sets = ranked.select("node", F.transform("s", lambda x: F.xxhash64(x["neighbour"])).alias("set"), n.alias("n"), F.least(least, F.lit(HEADS)).alias("k"), (n - least + F.least(least, F.lit(HEADS))).alias("head"))
    sets = settled(sets)
    heads = sets.select("node", "n", "k", F.explode(F.slice("set", F.lit(1), F.col("head"))).alias("neighbour"))
    met = heads.toDF("a", "na", "ka", "neighbour").join(heads.toDF("b", "nb", "kb", "neighbour"), "neighbour").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("ka", "kb")).alias("k")).filter("shared >= k").select("a", "b")
    whole = sets.select("node", "set")
    common = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b").select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    both = scored.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity").union(scored.select("b", "a", "similarity"))
    best = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return both.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top_k).drop("place")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges (src, rel, dst) with merged nodes replaced, loops dropped and repeats merged. mapping: (merged, canonical)."""
    m = mapping.select("merged", "canonical").distinct()
    out = edges
    for side in ("src", "dst"):
        out = out.join(m.toDF(side, "to"), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return out.filter("src <> dst").select("src", "rel", "dst").distinct()
