"""Full-text retrieval: BM25 over an inverted index of name tokens, exact for tokens of any frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

K1, B = 1.2, 0.75
#: Tokens in more names than this go by classes of names instead of postings. It steers the route, never the result.
POSTINGS = 64


def words(text: str | Column) -> Column:
    """Runs of lower-case letters and digits."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def _counted(df: DataFrame, by: list[str]) -> DataFrame:
    """(id, *by, length, token, tf) of df (id, text, *by)."""
    rows = df.select("id", *by, words("text").alias("words")).withColumn("length", F.size("words"))
    return rows.select("id", *by, "length", F.explode("words").alias("token")).groupBy("id", *by, "length", "token").agg(F.count("*").alias("tf"))


def _first(df: DataFrame, of: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*of).orderBy(*order))).filter(F.col(name) <= n)


def retrieve(queries: DataFrame, docs: DataFrame, limit: int, by: list[str], exclude_self: bool = True, floor: float | None = None, max_df: int | None = None) -> DataFrame:
    """(source_id, target_id, score, place): for each query (id, text, *by) the ``limit`` best documents (id, text, *by) that agree on ``by``.

    Filters come before the limit; ties go to the lower id, after the score is rounded to 6 places. With max_df, tokens in
    more documents are stop words.

    A token of at most POSTINGS documents meets its documents by a join. Documents that are equal in length and in their
    more common tokens score alike by those, so they form one class, and classes meet classes. A document that shares no
    rare token with a query can be among its best only if it is among the ``limit`` + 1 lowest ids of its class and its
    class among as many best ones of the query's: whatever lies before it there lies before it in the end, since rare
    tokens only add to a score. Queries whose rare tokens alone give enough documents above what common tokens can reach
    don't ask for classes at all.
    """
    more = limit + 1  # the query itself may be among them
    raw = settled(_counted(docs, by))
    sizes = raw.select("id", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    idf = raw.groupBy("token").agg(F.count("*").alias("df"))
    if max_df is not None:
        idf = idf.filter(F.col("df") <= max_df)
    idf = idf.crossJoin(F.broadcast(sizes)).select("token", "mean", (F.col("df") <= POSTINGS).alias("rare"), F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row
    idf = settled(idf)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    terms = raw.join(idf, "token").select("id", *by, "token", "rare", weight.alias("weight"))
    entry = F.when(~F.col("rare"), F.struct("token", "weight"))
    held = settled(terms.groupBy("id", *by).agg(F.sort_array(F.collect_list(entry)).alias("common"), F.sort_array(F.collect_list(F.when(F.col("rare"), F.struct("token", "weight")))).alias("rare")))
    asked = queries.select("id", *by, F.explode(F.array_distinct(words("text"))).alias("token")).join(idf.select("token", "rare", (F.col("idf") * (K1 + 1)).alias("most")), "token")
    asked = settled(asked.groupBy(F.col("id").alias("source_id"), *by).agg(F.sort_array(F.collect_list(F.when(~F.col("rare"), F.col("token")))).alias("q"), F.collect_list(F.when(F.col("rare"), F.col("token"))).alias("rare"), F.sum(F.when(~F.col("rare"), F.col("most"))).alias("bound")))

    # By postings: at most POSTINGS rows for each token asked.
    postings = held.select(F.col("id").alias("target_id"), *by, F.inline("rare"))
    met = asked.select("source_id", *by, F.explode("rare").alias("token")).join(postings, [*by, "token"]).groupBy("source_id", "target_id").agg(F.sum("weight").alias("part"))
    shared = F.aggregate(F.filter("common", lambda x: F.array_contains("q", x["token"])), F.lit(0.0), lambda s, x: s + x["weight"])
    scored = met.join(asked.select("source_id", "q"), "source_id").join(held.select(F.col("id").alias("target_id"), "common"), "target_id")
    scored = settled(scored.select("source_id", "target_id", F.round(F.col("part") + shared, 6).alias("score")))

    # By classes, for the queries that may find better documents there.
    enough = _first(scored.filter("source_id <> target_id") if exclude_self else scored, ["source_id"], [F.desc("score"), "target_id"], limit).filter(F.col("place") == limit).select("source_id", F.col("score").alias("last"))
    wanting = asked.filter(F.size("q") > 0).join(enough, "source_id", "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("bound") + 1e-5)).select("source_id", *by, "q")
    kinds = wanting.select(*by, "q").distinct().withColumn("kind", F.xxhash64(*by, "q"))
    lowest = settled(_first(held.filter(F.size("common") > 0).select("id", *by, "common"), [*by, "common"], ["id"], more))
    leads = lowest.filter("place = 1").select(*by, F.col("id").alias("lead"), F.inline("common"))
    pairs = kinds.select(*by, "kind", F.explode("q").alias("token")).join(leads, [*by, "token"]).groupBy(*by, "kind", "lead").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = _first(pairs, [*by, "kind"], [F.desc("score"), "lead"], more).drop("place")
    of = lowest.join(lowest.filter("place = 1").select(*by, "common", F.col("id").alias("lead")), [*by, "common"]).select("lead", F.col("id").alias("target_id"))
    reached = _first(best.join(of, "lead"), [*by, "kind"], [F.desc("score"), "target_id"], more).select(*by, "kind", "target_id", "score")
    classed = wanting.select("source_id", *by, F.xxhash64(*by, "q").alias("kind")).join(reached, [*by, "kind"]).select("source_id", "target_id", "score")

    total = scored.unionByName(classed)
    if exclude_self:
        total = total.filter("source_id <> target_id")
    if floor is not None:
        total = total.filter(F.col("score") > floor)
    # A document found both ways has its whole score by the postings, which is the greater.
    total = total.groupBy("source_id", "target_id").agg(F.max("score").alias("score"))
    return _first(total, ["source_id"], [F.desc("score"), "target_id"], limit)
