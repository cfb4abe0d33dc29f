"""Small Spark helpers: cut lineage, count partitions, rank without a single task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import settled

__all__ = ["documents", "partitions", "rank_within", "remainder", "settled", "written"]


def written(df: DataFrame) -> DataFrame:
    """Like settled, as a Parquet table in the same shared folder: for larger results, since columns compress."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        settled(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/kinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(of)


def rank_within(df: DataFrame, key: list[str], order: list[str], cell: Column, name: str) -> DataFrame:
    """Adds the 0-based rank by ``order`` within ``key``. ``cell`` must not fall where ``order`` rises.

    A hot key is cut into its cells: each (key, cell) is ranked by itself and then shifted by what the cells before it
    hold, so that no task sees more than a cell.
    """
    cells = df.withColumn("_cell", cell)
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy(*key, "_cell").agg(F.count("*").alias("_n"))
    shifts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = cells.withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_cell").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_cell") == F.col("_c")]
    joined = ranked.join(shifts, on, "inner")
    return joined.withColumn(name, F.col("_rank") + F.col("_shift")).drop("_rank", "_shift", "_cell", "_c", *[f"_k{i}" for i in range(len(key))])
