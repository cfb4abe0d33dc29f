"""Applying decisions: SAME_AS fold, merges, links, enrichment, audit rows and events, all as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N


def fold_detections(detections: DataFrame) -> DataFrame:
    """One row for each (source_id, target_id): detections by rule, summary, sticky flags.

    detections: (source_id, target_id, rule, confidence, detected_at, reviewed, conflict, seq). Of a rule the latest stays,
    at its latest place; the summary is the first of greatest confidence. seq orders detections.
    """
    folded = detections.groupBy("source_id", "target_id").agg(
        F.bool_or(F.coalesce("reviewed", F.lit(False))).alias("reviewed"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"),
        F.sort_array(F.collect_list(F.struct("seq", "rule", "confidence", "detected_at"))).alias("d"),
    )
    place = lambda i: F.slice(F.col("d")["rule"], i + 2, F.size("d"))  # noqa: E731  the rules of later detections
    folded = folded.withColumn("d", F.when(F.size("d") == 1, F.col("d")).otherwise(F.filter("d", lambda x, i: ~F.array_contains(place(i), x["rule"]))))
    top = F.array_max("confidences")
    best = lambda c: F.element_at(c, F.array_position("confidences", top).cast("int"))
    d = F.col("d")  # a field of an array of structs is the array of the fields
    arrays = folded.select("source_id", "target_id", "reviewed", "conflict", d["rule"].alias("rules"), d["confidence"].alias("confidences"), d["detected_at"].alias("dates"))
    return arrays.withColumns({"confidence": top, "method": best(F.col("rules")), "detected_at": best(F.col("dates"))})


def collapse_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entities without those merged away; the canonical one wins. merges: (canonical, merged[, retired_lei]).

    A merge counts only if both ends exist. With retired_lei, it is appended to the canonical's historic_leis.
    """
    there = entities.select("id")
    both = merges.join(there.toDF("canonical"), "canonical", "left_semi").join(there.toDF("merged"), "merged", "left_semi")
    left = entities.join(both.select(F.col("merged").alias("id")).distinct(), "id", "left_anti")
    if "retired_lei" not in merges.columns:
        return left
    retired = both.filter("retired_lei is not null").groupBy(F.col("canonical").alias("id")).agg(F.sort_array(F.collect_set("retired_lei")).alias("retired"))
    none = F.array().cast("array<string>")
    old = F.coalesce("historic_leis", none) if "historic_leis" in entities.columns else none
    return left.join(retired, "id", "left").withColumn("historic_leis", F.concat(old, F.coalesce("retired", none))).drop("retired")


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """links and new (source_id, rel, target_id, created_by_rule, confidence, created_at), the newest of each (source, rel, target)."""
    newest = Window.partitionBy("source_id", "rel", "target_id").orderBy(F.desc("created_at"), F.desc("confidence"))
    return links.unionByName(new).withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place")


def enrich(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entities with found (id, translations, embedding, encoder) put in; existing translations give way to new ones.

    Only alphabetic codes count; an embedding without an encoder is an error. found is as long as entities, and Spark takes maps and
    vectors for far smaller than they are: both sides are sorted, as a broadcast of them would not fit the driver.
    """
    bad = F.col("new_vector").isNotNull() & F.coalesce(F.col("new_encoder") == "", F.lit(True))
    new = found.select("id", F.map_filter("translations", lambda k, v: k.rlike("^[A-Za-z]+$") & v.isNotNull()).alias("new"), F.col("embedding").alias("new_vector"), F.col("encoder").alias("new_encoder"))
    new = new.withColumn("new_vector", F.when(bad, F.raise_error(F.lit("embedding without encoder"))).otherwise(F.col("new_vector")))
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce("translations", none) if "translations" in entities.columns else none
    keep = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("new", none)), k))
    out = entities.join(new.hint("merge"), "id", "left").withColumn("translations", F.map_concat(keep, F.coalesce("new", none)))
    if "vector" in entities.columns:
        out = out.withColumns({"vector": F.coalesce("new_vector", "vector"), "encoder": F.coalesce("new_encoder", "encoder")})
    return out.drop("new", "new_vector", "new_encoder")


def offline_translations(entities: DataFrame, country: str = "country", lang: str = "name_lang") -> DataFrame:
    """A deterministic stand-in for a translation service: `[code] name` for each missing language. (id, status, translations, source_lang)."""
    have = F.col("translations") if "translations" in entities.columns else F.create_map().cast("map<string,string>")
    missing = N.missing_langs(have, F.col(lang), F.col(country))
    made = F.map_from_arrays(missing, F.transform(missing, lambda c: F.concat(F.lit("["), c, F.lit("] "), F.col("name"))))
    ok = F.coalesce(F.col("name") != "", F.lit(False)) & (F.size(missing) > 0)
    return entities.select("id", F.when(ok, "enrich").otherwise("noop").alias("status"), F.when(ok, made).otherwise(F.create_map().cast("map<string,string>")).alias("translations"), N.source_lang(F.col(lang), F.col(country)).alias("source_lang"))


def _key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def audit(decisions: DataFrame, entity_type: str, as_of: Column, triggered_by: str = "batch") -> dict[str, DataFrame]:
    """Append-only rows: applications and decisions, with ids made from their content so that a rerun repeats them."""
    rows = decisions.withColumn("run_id", _key(F.lit(entity_type), F.col("source_id"), as_of.cast("string"))).withColumn("application_id", _key("run_id", "rule", "target_id"))
    applications = rows.select("application_id", "run_id", F.col("rule").alias("rule_name"), "confidence", "decided", as_of.alias("applied_at"), F.col("target_id").alias("candidate_id"), F.to_json(F.struct("conflict", "conflict_property", "outcome")).alias("details"))
    log = rows.select(_key("application_id", F.lit("d")).alias("decision_id"), "application_id", as_of.alias("decided_at"), F.col("outcome").alias("decision_type"), F.col("rule").alias("rule_name"), "confidence", "source_id", "target_id", F.lit(entity_type).alias("entity_type"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_note"), F.lit(triggered_by).alias("triggered_by"))
    return {"applications": applications, "decisions": log}


def same_as_events(decisions: DataFrame, label: str, prefix: str, as_of: Column) -> DataFrame:
    """An AssertSameAs event for each merge."""
    a, b = N.entity_iri(prefix, F.lit(label), F.col("source_id")), N.entity_iri(prefix, F.lit(label), F.col("target_id"))
    return decisions.filter("outcome = 'auto_merge'").select(F.lit("AssertSameAs").alias("event_type"), a.alias("iri"), F.create_map(F.lit("other"), b, F.lit("rule"), F.col("rule"), F.lit("confidence"), F.col("confidence").cast("string")).alias("payload"), as_of.alias("ts"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def not_done(ids: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Of a resumable scan: the ids that no batch has recorded under path yet."""
    return ids.join(spark.read.parquet(path).select("id").distinct(), "id", "left_anti")
