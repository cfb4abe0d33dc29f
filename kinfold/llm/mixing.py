"""Mixing sources to target weights by a low-discrepancy schedule (operator 2).

Slot k of the schedule has the point ``frac(k * golden ratio)``; the source in whose interval of cumulative target weights
the point falls gets the slot, so that any stretch of the schedule is close to the target weights. A source's slots are
ranked; the r-th one takes the r-th block of equal tokens of the source's shuffled documents, epoch after epoch. The last
slot of a source is cut where its target is reached; slots past it stay empty, and a source that the schedule gave too few
slots gets the missing ones at its end. Words taken from a source so equal its target, rounded down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions, rank_within, settled

BLOCK = 256
#: Greatest number of epochs: a target never exceeds this many times its source's size.
EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Cells of the unit interval by which points find their sources; a cell is met by few intervals.
CELLS = 4096
_GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    """Words of the text: runs outside the six blanks; the starts of such runs are counted."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " +"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): sizes has (source, source_size).

    With caps c_i = EPOCHS * size_i, the fixed point of resharing is min(c_i, level * w_i). In order of c_i / w_i, the level
    is (all - caps so far) / (weights left) at the first source that it doesn't fill.
    """
    ranked = sizes.withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1))
    cap = F.lit(EPOCHS) * F.col("source_size")
    rows = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    at = F.min(F.when(F.col("open"), F.struct("ratio", F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(at * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _order(id_: Column) -> Column:
    """The shuffle: 60 bits of a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|17"))), 1, 15), 16, 10).cast("long")


def placed(docs: DataFrame) -> DataFrame:
    """(id, size, source, start): where each document lies in its source's shuffled stream of words.

    The order within a source is that of a hash. A source is cut by leading bits of the hash into cells, so that a hot one
    is summed by many tasks.
    """
    cells = 64 * partitions(docs.sparkSession)
    rows = docs.withColumn("cell", F.floor(F.shiftright("order", 28) * cells / float(1 << 32)).cast("long"))
    sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("source", "cell").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(shift, _same("source", "s") & (F.col("cell") == F.col("c"))).select("id", "size", "source", (F.col("own") + F.col("shift")).alias("start"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, rank, slot, epoch, at, tokens): what each used slot takes: block ``at`` of the source, its first ``tokens`` words.

    slot is null for the slots added at a source's end. goals: (source, source_size, target).
    """
    spark = goals.sparkSession
    goals = goals.withColumn("words", F.floor("target").cast("long")).filter("source_size > 0 and words > 0")
    goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    rest = F.col("words") % F.col("source_size")
    goals = goals.withColumn("slots", F.floor(F.col("words") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block))
    total = goals.agg(F.sum("slots")).first()[0] or 0
    up = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.col("slots") / F.lit(float(max(total, 1)))
    cumulative = goals.withColumn("high", F.sum(share).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.coalesce(F.lag("high").over(up), F.lit(0.0)))
    cumulative = cumulative.withColumn("high", F.when(F.lead("high").over(up).isNull(), 1.0).otherwise(F.col("high")))
    cells = cumulative.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    # frac(k * golden), exact to the last bits for any k: the product is taken modulo 1 in 32-bit halves.
    k = F.col("slot")
    high, low = F.shiftright(k, 16), k.bitwiseAND(F.lit(0xFFFF))
    point = (high * F.lit(_GOLDEN * 65536 % 1) + low * F.lit(_GOLDEN)) % 1.0
    slots = spark.range(0, int(total), 1, partitions(spark)).toDF("slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    given = slots.join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("source", "slot")
    ranked = rank_within(given, ["source"], ["slot"], F.shiftright("slot", 16), "rank")
    got = given.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "s")
    lack = goals.join(got, _same("source", "s"), "left").select("source", "slots", F.coalesce("got", F.lit(0)).alias("got")).filter("got < slots")
    added = lack.select("source", F.lit(None).cast("long").alias("slot"), F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    every = ranked.select("source", "slot", "rank").unionByName(added).join(goals.withColumnRenamed("source", "s"), _same("source", "s")).filter("rank < slots")
    epoch, at = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block), F.col("source_size") - at * block)
    left = F.col("words") - epoch * F.col("source_size") - at * block
    return every.select("source", "rank", "slot", epoch.alias("epoch"), at.alias("at"), F.least(length, left).cast("long").alias("tokens")).filter("tokens > 0")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(id, size, source, source_size, target, taken) of each row of docs; reruns agree.

    Null and empty texts have size 0 and are never taken; a null source is a source, the last. Rows are told apart by place,
    so repeated rows each keep their own; ties in the shuffle are broken by id and size.
    """
    rows = docs.select(F.col(id_col).alias("id"), size_of(F.col(text)).alias("size"), F.col(source).alias("source"), _order(F.col(id_col)).alias("order"))
    rows = settled(rows)  # a few numbers for each row: texts are read once
    goals = settled(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    where = settled(placed(rows))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = where.filter("size > 0").withColumn("at", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("from", F.greatest(F.col("start") - F.col("at") * block, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("at") * block, F.lit(block)))
    # Slots of a block differ in length at most once, where the target cuts: uses by (block, length).
    uses = schedule(goals, block).groupBy("source", "at", "tokens").agg(F.count("*").alias("times")).withColumnRenamed("source", "s").withColumnRenamed("at", "a")
    words = F.greatest(F.least(F.col("to"), F.col("tokens")) - F.col("from"), F.lit(0)) * F.col("times")
    taken = pieces.join(uses, _same("source", "s") & (F.col("at") == F.col("a"))).groupBy("source", "start", "id", "size").agg(F.sum(words).alias("taken"))
    taken = taken.toDF("s", "st", "i", "z", "taken")
    full = where.join(taken, _same("source", "s") & (F.col("start") == F.col("st")) & _same("id", "i") & (F.col("size") == F.col("z")), "left").drop("s", "st", "i", "z")
    out = full.join(goals.withColumnRenamed("source", "s"), _same("source", "s"))
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same in SQL: a source's blocks, taken epoch after epoch up to its target, cover its shuffled stream cyclically, so a
#: document is taken once for each whole epoch and for what the last, partial one reaches of it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17'), 1, 15))::BIGINT AS ord
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source
), c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * w, cap::DOUBLE)) AS target FROM l
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size + greatest(0, least(start + size, floor(target)::BIGINT % source_size) - start) END::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
