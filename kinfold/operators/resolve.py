"""Batch resolver: attributes -> entity, tier by tier, the first tier with a hit wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names as N
from . import fulltext

TIERS = (("lei", 1, 1.0), ("vat", 2, 0.99), ("cik", 3, 0.99), ("registered_as", 4, 0.98), ("name_country", 5, 0.95))


def resolve(requests: DataFrame, entities: DataFrame, label: str = "Company", settings: Settings | None = None) -> DataFrame:
    """(row_id, hint, tier, confidence, match_id, candidates, normalised_country), one row for each request.

    requests: row_id, name, country, lei, vat, cik, registered_as (any may be null). A null country never matches. A tier
    with one hit gives `matched`, with more `ambiguous` and the two of least id; names that only full text finds are always
    ambiguous, with up to five candidates.
    """
    s = settings or Settings()
    ask = requests.withColumn("iso", N.normalize_country(F.col("country"))).withColumn("asked_clean", N.clean(F.col("name")))
    full_name = F.coalesce(F.length("name") >= s.resolver_min_name, F.lit(False)) & F.col("iso").isNotNull()
    parts = []

    def tier(name: str, *keys: tuple) -> None:
        rank, conf = next((r, c) for n, r, c in TIERS if n == name)
        left, right = ask, entities
        for i, (a, b) in enumerate(keys):
            left, right = left.withColumn(f"_k{i}", a), right.withColumn(f"_k{i}", b)
        on = [f"_k{i}" for i in range(len(keys))]
        parts.append(left.select("row_id", *on).join(right.select("id", *on), on).select("row_id", "id", F.lit(name).alias("tier"), F.lit(rank).alias("rank"), F.lit(conf).alias("confidence")))

    if label == "Company":
        # Stored values are compared as they are; only what is asked is canonicalised.
        tier("lei", (N.canon_lei(F.col("lei")), F.col("lei")))
        tier("vat", (N.canon_vat(F.col("vat")), F.col("vat")))
        tier("cik", (N.canon_cik(F.col("cik")), F.col("cik")))
        tier("registered_as", (F.when(F.trim("registered_as") != "", F.trim("registered_as")), F.col("registered_as")), (F.col("iso"), F.col("country")))
    tier("name_country", (F.when(full_name, F.col("asked_clean")), F.col("name_clean")), (F.col("iso"), F.coalesce("country", F.lit(""))))
    hits = reduce(DataFrame.unionByName, parts)
    first = hits.withColumn("best", F.min("rank").over(Window.partitionBy("row_id"))).filter("rank = best")
    exact = first.groupBy("row_id", "tier", "confidence").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    exact = exact.select("row_id", "tier", "confidence", F.when(F.size("ids") == 1, "matched").otherwise("ambiguous").alias("hint"), F.when(F.size("ids") == 1, F.col("ids")[0]).alias("match_id"), F.slice("ids", 1, 2).alias("candidates"))
    # Full text only for what no tier found.
    text = N.query_text(F.col("name"))
    rest = ask.filter(full_name & (F.length(text) >= s.resolver_min_name)).join(exact.select("row_id"), "row_id", "left_anti").select(F.col("row_id").alias("id"), text.alias("text"), F.col("iso").alias("country"))
    docs = entities.select("id", N.query_text(F.col("name")).alias("text"), F.coalesce("country", F.lit("")).alias("country"))
    fuzzy = fulltext.retrieve(rest, docs, 5, ["country"], exclude_self=False, floor=s.resolver_fulltext_floor, max_df=s.fulltext_max_df)
    fuzzy = fuzzy.groupBy(F.col("source_id").alias("row_id")).agg(F.sort_array(F.collect_list(F.struct("place", "target_id", "score"))).alias("c"))
    fuzzy = fuzzy.select("row_id", F.lit("fuzzy").alias("tier"), F.least(F.lit(0.94), F.col("c")[0]["score"] / 10).alias("confidence"), F.lit("ambiguous").alias("hint"), F.lit(None).cast("string").alias("match_id"), F.transform("c", lambda x: x["target_id"]).alias("candidates"))
    found = exact.unionByName(fuzzy)
    return ask.select("row_id", F.col("iso").alias("normalised_country")).join(found, "row_id", "left").select("row_id", F.coalesce("hint", F.lit("no_match")).alias("hint"), "tier", "confidence", "match_id", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), "normalised_country")
