"""Line dedup by winnowing over line hashes, in DataFrame functions only (operator 9).

A text is cut into pieces: lines, and within a line sentences, each with the blanks behind it, so that the pieces put
together are the text again. Hashes of two pieces in a row are winnowed: of each window of two, the least is a fingerprint;
a piece of half of ``min_words`` words or more is one by itself. Fingerprints are joined by position with their first
occurrence, in order of (doc_id, position), and with the one before in the same text. Matches of one alignment (the same
earlier text at the same distance) lie at most two pieces apart inside a repeated run, so they chain without gaps; at either
end a run takes in the piece beyond where that piece, too, equals the one beyond the earlier occurrence, by its whole hash.
Runs of ``min_words`` words or more are deleted; each of them is a run of an earlier text, or of the same text before.

Every such run whose fingerprints first occurred in one text is found: of three pieces or more one pair is a fingerprint, and
of one or two pieces with ``min_words`` words one piece has half of them. With ``min_words`` 0 each repeated line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

MIN_WORDS = 25
#: After a line feed; after the blank that follows a sentence's end.
CUT = r"(?<=\n)|(?<=[.!?][ \t])"
_BLANKS = " \t\r\n\x0b\f"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column computed once: a generator, which the optimizer doesn't copy into the lambdas that use the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _bare(pieces: Column) -> Column:
    """The pieces without the blanks around them."""
    return F.transform(pieces, lambda x: F.trim(x, F.lit(_BLANKS)))


def _words(bare: Column) -> Column:
    """Words of a bare piece, told by its blanks."""
    return F.when(bare == "", 0).otherwise(F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def _row_id(id_col: str, text: str) -> Column:
    return F.xxhash64(id_col, text)


def fingerprints(docs: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rid, at, g, span, left, right): the fingerprints, the pieces each covers, and hashes of the pieces beyond (null: none)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("rid", _row_id("id", "text"))
    df = _held(df, "bare", _bare(F.split("text", CUT))).select("id", "rid", "bare")
    df = _held(df, "h", F.transform("bare", lambda x: F.xxhash64(x)))
    none = F.array(F.lit(None).cast("long"))
    moved = lambda n: F.slice("h", n + 1, F.size("h"))
    rows = F.arrays_zip(
        F.sequence(F.lit(0), F.size("h") - 1).alias("at"), F.col("h").alias("h"), F.transform("bare", _words).alias("w"),
        F.concat(none, none, "h").alias("h_2"), F.concat(none, "h").alias("h_1"), moved(1).alias("h1"), moved(2).alias("h2"),
    )
    df = df.select("id", "rid", F.inline(rows)).filter("at is not null and h is not null")
    empty = F.xxhash64(F.lit(""))
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & ((F.col(a) != empty) | (F.col(b) != empty)), F.xxhash64(a, b))
    df = df.withColumns({"g": pair("h", "h1"), "before": pair("h_1", "h"), "after": pair("h1", "h2")})
    # The least of a window of two pairs, the left one of equals; a pair without neighbours is chosen as well.
    least = (F.col("g") <= F.col("after")) | (F.col("g") < F.col("before")) | (F.col("after").isNull() & F.col("before").isNull())
    both = F.stack(
        F.lit(2),
        F.when(F.coalesce(least, F.lit(False)), F.col("g")), F.lit(2), F.col("h_1"), F.col("h2"),
        F.when((F.col("w") >= max(1, (min_words + 1) // 2)), F.col("h")), F.lit(1), F.col("h_1"), F.col("h1"),
    )
    return df.select("id", "rid", "at", both.alias("g", "span", "left", "right")).filter("g is not null")


#: Fingerprints that make up more than this share of a sample of one document in SAMPLE are dealt out over SPREAD tasks.
HOT_SHARE, SAMPLE, SPREAD = 0.005, 128, 32


def _hot(docs: DataFrame, id_col: str, text: str, min_words: int) -> list[int]:
    """Fingerprints too common for one task: 1 / HOT_SHARE at most. Only their routing depends on this, never a result."""
    some = fingerprints(docs.filter(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(SAMPLE)) == 0), id_col, text, min_words).groupBy("g").agg(F.count("*").alias("n"))
    top = some.orderBy(F.desc("n"), "g").limit(int(1 / HOT_SHARE)).collect()
    total = some.agg(F.sum("n")).first()[0] or 0 if top and top[0]["n"] > 1 else 0
    return [r["g"] for r in top if r["n"] > max(10, HOT_SHARE * total)]


def repeated_runs(docs: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, first, last) of each run of pieces that occurred before as a run; runs may overlap."""
    hot = _hot(docs, id_col, text, min_words)
    keys = ["g", "salt"] if hot else ["g"]
    salt = F.when(F.col("g").isin(hot), F.pmod("rid", F.lit(SPREAD)) + 1).otherwise(0).cast("int")
    # The one exchange of the fingerprints; a window over it finds the first occurrence and the one before, without a join.
    marks = fingerprints(docs, id_col, text, min_words).withColumns({"salt": salt} if hot else {})
    here = F.struct("id", "rid", "at", "left", "right")
    up = Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_first(), "rid", "at")
    met = marks.select(*marks.columns, F.first(here).over(up).alias("f"), F.lag(F.struct("rid", "at", "left", "right")).over(up).alias("p"))
    if hot:
        met = written(met.filter("p is not null or salt > 0"))
        over = met.filter("salt > 0").groupBy("g").agg(F.min_by("f", F.struct(F.col("f.id"), F.col("f.rid"), F.col("f.at"))).alias("f_all"))
        met = met.join(F.broadcast(over), "g", "left").withColumn("f", F.coalesce("f_all", "f"))  # as few rows as hot
    first, again = F.col("f"), F.when(F.col("p.rid") == F.col("rid"), F.col("p"))
    self = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("rid") == F.col("f.rid")) & (F.col("at") == F.col("f.at"))
    more = lambda of, side: F.coalesce(of[side] == F.col(side), F.lit(False)).cast("int")
    span = lambda of: F.struct(of["rid"].alias("of"), (F.col("at") - of["at"]).alias("far"), (F.col("at") - more(of, "left")).alias("first"), (F.col("at") + F.col("span") - 1 + more(of, "right")).alias("last"))
    nearer = again.isNotNull() & ((again["rid"] != first["rid"]) | (again["at"] != first["at"]))
    spans = met.filter(~self).select("rid", F.explode(F.array(span(first), F.when(nearer, span(again)))).alias("s")).filter("s is not null")
    spans = spans.select("rid", "s.*").repartition("rid")
    aligned = Window.partitionBy("rid", "of", "far").orderBy("first", "last")
    reached = F.max("last").over(aligned.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int")
    chained = spans.withColumn("new", new).withColumn("run", F.sum("new").over(aligned.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("rid", "of", "far", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("rid", "first", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeats cut from the text, and `removed_words`, `removed_runs` of each row (0 where nothing was cut).

    A null text stays null, an empty one empty; rows that repeat both id and text are one document and get one result.
    Rows that tie on the id are ordered by a hash of their text; a null id comes first. A text whose pieces all occurred
    before becomes empty. Two or more runs that touch count as one.
    """
    own = "_rid"
    runs = repeated_runs(docs, id_col, text, min_words).distinct().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("_runs")).withColumnRenamed("rid", own)
    df = docs.withColumn(own, _row_id(id_col, F.coalesce(text, F.lit("")))).join(runs, own, "left")
    df = _held(df, "_pieces", F.when(F.col("_runs").isNotNull(), F.split(text, CUT)))
    df = _held(df, "_counts", F.transform(_bare(F.col("_pieces")), _words))
    total = lambda r: F.aggregate(F.slice("_counts", r["first"] + 1, r["last"] - r["first"] + 1), F.lit(0), lambda a, x: a + x)
    df = _held(df, "_cut", F.filter("_runs", lambda r: total(r) >= min_words))
    some = F.coalesce(F.size("_cut") > 0, F.lit(False))
    df = _held(df, "_gone", F.when(some, F.transform("_pieces", lambda x, i: F.exists("_cut", lambda r: (i >= r["first"]) & (i <= r["last"])))))
    kept = F.array_join(F.filter("_pieces", lambda x, i: ~F.get("_gone", i)), "")
    words = F.aggregate(F.zip_with("_counts", "_gone", lambda n, gone: F.when(gone, n).otherwise(0)), F.lit(0), lambda a, x: a + x)
    starts = F.size(F.filter("_gone", lambda x, i: x & ~F.coalesce(F.get("_gone", i - 1), F.lit(False))))
    df = df.withColumn(text, F.when(some, kept).otherwise(F.col(text))).withColumns({"removed_words": F.when(some, words).otherwise(0), "removed_runs": F.when(some, starts).otherwise(0)})
    return df.select(*docs.columns, "removed_words", "removed_runs")
