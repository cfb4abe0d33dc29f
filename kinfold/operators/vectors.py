"""Exact nearest neighbours by cosine, in tiles of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 2048


def nearest(vectors: DataFrame, k: int, id_col: str = "id", vector: str = "vector", tile: int = TILE) -> DataFrame:
    """(source_id, target_id, score, place): the k vectors of greatest cosine to each, itself included; ties go to the lower id.

    Blocks of sources meet blocks of vectors; a tile returns k rows for each source, never its pairs. Null vectors are left
    out; a zero vector has cosine 0 to all. Scores are rounded to 9 places before they are ranked.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // tile))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sides = rows.select("id", "v", F.col("b").alias("i"), every.alias("j"), F.lit(0).alias("role"))
    other = rows.select("id", "v", every.alias("i"), F.col("b").alias("j"), F.lit(1).alias("role"))

    def best(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role"))
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        flat = table.column("v").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        v = np.asarray(flat.values).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        right = right[np.argsort(ids[right], kind="stable")]  # so that ties fall to the lower id
        score = np.round(v[left] @ v[right].T, 9)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        n = top.shape[1] if len(left) else 0
        return pa.table({"source_id": pa.array(np.repeat(ids[left], n), pa.string()), "target_id": pa.array(ids[right][top.reshape(-1)], pa.string()), "score": pa.array(np.take_along_axis(score, top, 1).reshape(-1), pa.float64())})

    met = sides.union(other).groupBy("i", "j").applyInArrow(best, "source_id string, target_id string, score double")
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
