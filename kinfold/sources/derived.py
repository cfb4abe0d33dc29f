"""Entity tables derived by rule from the driver's TPC-H-like tables, in Spark and as SQL for the oracles.

Keys are cut into groups of four (key // 4) that share a name stem and identifiers, so that groups keep their size at any
scale. The SQL twins of the tables are common table expressions of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("DEU", "FRA", "IRL", "ESP", "POL")
EVENT_TYPES = {"signup": "UpsertCompany", "purchase": "UpsertFiling", "view": "UpsertAuthority", "click": "AssertSameAs", "error": "DeleteCompany"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, country, lei, cik, vat, registered_as, active, created_at, key)."""
    k = F.col("c_custkey")
    g = F.floor(k / 4)
    stems = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), "p_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey").withColumn("stem", g).join(stems, "stem", "left")
    stem = F.concat_ws(" ", F.coalesce("p_name", F.lit("unnamed")), g.cast("string"))
    name = F.when(k % 4 == 0, F.concat(stem, F.lit(" GmbH"))).when(k % 4 == 1, F.concat(F.upper(stem), F.lit(" GMBH."))).when(k % 4 == 2, F.concat(stem, F.lit("x Ltd"))).otherwise(F.concat(stem, F.lit(", S.A.")))
    hashed = F.upper(F.substring(F.md5(F.concat(F.lit("lei"), F.floor(k / 2).cast("string"))), 1, 16))
    lei = F.when(k % 3 != 0, F.concat(F.lpad((g % 7).cast("string"), 4, "5"), F.when(k % 8 == 5, F.lit("0000000000000000")).otherwise(hashed)))
    return rows.select(
        F.concat(F.lit("C"), k.cast("string")).alias("id"), name.alias("name"), _pick(COUNTRIES, F.when(k % 16 == 3, g + 1).otherwise(g) % 5).alias("country"), lei.alias("lei"),
        F.when(k % 2 == 0, F.lpad(F.floor(k / 6).cast("string"), 10, "0")).alias("cik"), F.when(k % 5 != 0, F.concat(F.lit("DE "), F.lpad(F.floor(k / 3).cast("string"), 9, "0"))).alias("vat"),
        F.when(k % 7 == 0, F.concat(F.lit("R"), F.floor(k / 14).cast("string"))).alias("registered_as"), (k % 4 != 1).alias("active"), F.when(k % 9 != 0, F.concat(F.lit("20"), F.lpad((k % 25).cast("string"), 2, "0"))).alias("created_at"), k.alias("key"),
    )


COMPANIES = """company AS (
  SELECT 'C' || k AS id,
         CASE k % 4 WHEN 0 THEN stem || ' GmbH' WHEN 1 THEN upper(stem) || ' GMBH.' WHEN 2 THEN stem || 'x Ltd' ELSE stem || ', S.A.' END AS name,
         ['DEU', 'FRA', 'IRL', 'ESP', 'POL'][((CASE WHEN k % 16 = 3 THEN g + 1 ELSE g END) % 5 + 1)::INT] AS country,
         CASE WHEN k % 3 <> 0 THEN lpad((g % 7)::VARCHAR, 4, '5') || CASE WHEN k % 8 = 5 THEN '0000000000000000' ELSE upper(substr(md5('lei' || (k // 2)), 1, 16)) END END AS lei,
         CASE WHEN k % 2 = 0 THEN lpad((k // 6)::VARCHAR, 10, '0') END AS cik,
         CASE WHEN k % 5 <> 0 THEN 'DE ' || lpad((k // 3)::VARCHAR, 9, '0') END AS vat,
         CASE WHEN k % 7 = 0 THEN 'R' || (k // 14) END AS registered_as,
         k % 4 <> 1 AS active, CASE WHEN k % 9 <> 0 THEN '20' || lpad((k % 25)::VARCHAR, 2, '0') END AS created_at, k AS key
  FROM (SELECT c_custkey AS k, c_custkey // 4 AS g, coalesce(p_name, 'unnamed') || ' ' || (c_custkey // 4) AS stem FROM customer LEFT JOIN part ON p_partkey = c_custkey // 4)
)"""


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, country, name_lang): one for each part, named by its type and the group of six that its key is in."""
    k = F.col("p_partkey")
    group = F.floor(k / 6).cast("string")
    kind = F.when(k % 5 == 0, F.concat(F.lit("Ministère "), "p_type")).when(k % 5 == 1, F.upper(F.concat(F.lit("Office: "), "p_type"))).otherwise(F.concat(F.lit("Office "), "p_type"))
    place = F.floor(k / 2) % 4
    country = F.when(k % 13 == 0, "BEL").when(k % 17 != 0, _pick(("IRL", "FRA", "DEU", "ESP"), place))
    lang = F.when(k % 3 == 0, _pick(("en", "fr", "de", "es"), place))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("A"), F.lpad(k.cast("string"), 12, "0")).alias("id"), F.concat_ws(" ", kind, group).alias("name"), country.alias("country"), lang.alias("name_lang"))


AUTHORITIES = """authority AS (
  SELECT 'A' || lpad(p_partkey::VARCHAR, 12, '0') AS id,
         CASE p_partkey % 5 WHEN 0 THEN 'Ministère ' || p_type WHEN 1 THEN upper('Office: ' || p_type) ELSE 'Office ' || p_type END || ' ' || (p_partkey // 6) AS name,
         CASE WHEN p_partkey % 13 = 0 THEN 'BEL' WHEN p_partkey % 17 <> 0 THEN ['IRL', 'FRA', 'DEU', 'ESP'][((p_partkey // 2) % 4 + 1)::INT] END AS country,
         CASE WHEN p_partkey % 3 = 0 THEN ['en', 'fr', 'de', 'es'][((p_partkey // 2) % 4 + 1)::INT] END AS name_lang
  FROM part
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, country, encoder, vector)."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("V"), v.cast("string")).alias("id"), F.concat(F.lit("Office of region "), (v % 40).cast("string")).alias("name"), _pick(COUNTRIES[:4], v % 4).alias("country"),
        F.concat(F.lit("enc"), (F.col("label") % 2).cast("string")).alias("encoder"), F.col("embedding").alias("vector"),
    )


VECTORS = """vectors AS (
  SELECT 'V' || vec_id AS id, 'Office of region ' || (vec_id % 40) AS name, ['DEU', 'FRA', 'IRL', 'ESP'][(vec_id % 4 + 1)::INT] AS country,
         'enc' || (label % 2) AS encoder, embedding::DOUBLE[] AS vector, vec_id
  FROM embeddings
)"""


def same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, reviewed, conflict, kept, detected_at): directed edges between companies of one group."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey").filter(k % 4 < 3)
    return rows.select(F.concat(F.lit("C"), k.cast("string")).alias("src"), F.concat(F.lit("C"), (k + 1 + (k % 12 == 0).cast("int")).cast("string")).alias("dst"), (k % 5 != 0).alias("reviewed"), (k % 11 == 0).alias("conflict"), (k % 10 == 1).alias("kept"), F.timestamp_seconds(F.lit(1_700_000_000) + k * 977 % 100_003).alias("detected_at"))


SAME_AS = """same_as AS (
  SELECT 'C' || k AS src, 'C' || (k + 1 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END) AS dst, k % 5 <> 0 AS reviewed, k % 11 = 0 AS conflict, k % 10 = 1 AS kept,
         1700000000 + k * 977 % 100003 AS detected_sec, k
  FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 < 3)
)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, neighbour): the parts that a group of three companies has to do with; each has nine tenths of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("k") - F.col("k") % 3).alias("k"), "p").distinct()
    every = bought.withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)]))).filter("(p + m) % 10 <> 0")
    return every.select(F.concat(F.lit("C"), (F.col("k") + F.col("m")).cast("string")).alias("node"), F.concat(F.lit("P"), F.col("p").cast("string")).alias("neighbour"))


NEIGHBOURS = """neighbours AS (
  SELECT 'C' || (k + m) AS node, 'P' || p AS neighbour
  FROM (SELECT DISTINCT o_custkey - o_custkey % 3 AS k, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey), (VALUES (0), (1), (2)) v(m)
  WHERE (p + m) % 10 <> 0
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_type, iri, domain, payload, batch_id, producer, ts)."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("event_type")]
    user = F.when(F.col("event_id") % 17 != 0, F.col("user_id").cast("string"))
    payload = F.map_filter(F.create_map(F.lit("gmr_id"), F.when(kind != "UpsertAuthority", user), F.lit("authority_id"), F.when(kind == "UpsertAuthority", user)), lambda k, v: v.isNotNull())
    return events.select(F.col("event_id").alias("seq"), kind.alias("event_type"), F.concat(F.lit("urn:entity/"), F.col("user_id").cast("string")).alias("iri"), F.lit("demo").alias("domain"), payload.alias("payload"), F.lit(None).cast("string").alias("batch_id"), F.lit("etl").alias("producer"), "ts")


EVENTS = """event_log AS (
  SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'UpsertCompany' WHEN 'purchase' THEN 'UpsertFiling' WHEN 'view' THEN 'UpsertAuthority' WHEN 'click' THEN 'AssertSameAs' WHEN 'error' THEN 'DeleteCompany' END AS event_type,
         CASE WHEN event_id % 17 <> 0 THEN user_id::VARCHAR END AS entity_id, user_id, ts
  FROM events
)"""

#: SQL of the scalar functions over the derived tables' characters.
CLEAN_SQL = "regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'ae'), 'Ö', 'oe'), 'Ü', 'ue'), 'ß', 'ss'))), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
