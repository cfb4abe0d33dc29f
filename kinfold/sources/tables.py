"""Reading entity tables from files and writing them in a layout that later joins can prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY = "id string, name string, country string, lei string, cik string, vat string, registered_as string, active boolean, created_at string, historic_leis array<string>, last_consolidated_at timestamp"
AUTHORITY = "id string, name string, country string, name_lang string, translations map<string,string>, vector array<float>, encoder string, last_consolidated_at timestamp"
EDGE = "src string, dst string, reviewed boolean, conflict boolean, kept boolean, confidence double, method string, detected_at timestamp"


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """An entity table of any of Spark's file formats; with a schema, columns that a file lacks are null."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by what it is joined on, so that joins on the key need no exchange."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def check_dimensions(vectors: DataFrame) -> DataFrame:
    """(encoder, dimensions) of encoders whose vectors differ in length: empty if all is well."""
    return vectors.filter("vector is not null").groupBy("encoder").agg(F.collect_set(F.size("vector")).alias("dimensions")).filter(F.size("dimensions") > 1)
