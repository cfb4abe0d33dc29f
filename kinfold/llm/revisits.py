"""WARC: resolution of not-modified revisits (operator 7).

A revisit record has no body; it stands for the latest earlier full response of the same canonical URL. The as-of join runs
in two levels, so that a hot URL is no single task: within (URL, stretch of time) by a window, and from earlier stretches
by what each ends with. Validators are checked, and the headers that a 304 may update replace the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may carry and that update the stored ones (RFC 9110, 15.4.5; RFC 9111, 3.2); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change the resource (fixed values).
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"
#: Seconds of a stretch of time.
STRETCH = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, no scheme, fragment, tracking parameters or trailing slash; '' for null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^[a-zA-Z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), f"([?&])({TRACKING})=[^&]*", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "^([^?&]*)&", "$1?"), "/+(\\?|$)", "$1"))


def _bare_etag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Of each revisit: record_id, canonical_url, ts, refers_to, status, headers.

    records: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest, headers (map, names in lower
    case). "Earlier" is by (ts, record_id); a record without ts comes before all others and only pairs among its like.
    status: `no_response` if there is none earlier; `mismatch` if a validator that both have differs (ETags compare weakly);
    `resolved` if one agrees; `unchecked` if they share none. headers: merged for resolved and unchecked, else the revisit's
    own. Rows that repeat a record_id are resolved apart. A record without URL stands for no other one than of its own id. Null maps count as empty; other kinds are left out.
    """
    fields = ("record_id", "etag", "last_modified", "digest", "headers")
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", "ts", "kind", "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        canonical_url(F.col("url")).alias("canonical_url"), F.when(F.col("url").isNull(), F.col("record_id").cast("string")).alias("lone"), F.coalesce(F.floor(F.col("ts").cast("double") / stretch), F.lit(-(1 << 60))).alias("stretch"),
    )
    full = F.when(F.col("kind") == "response", F.struct(*fields))
    here = Window.partitionBy("canonical_url", "lone", "stretch").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(full, ignorenulls=True).over(here)).filter("kind = 'revisit'")
    ends = rows.filter("lone is null").groupBy("canonical_url", "stretch").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical_url", "stretch", F.last("end", ignorenulls=True).over(before).alias("far"))
    joined = near.join(carried, ["canonical_url", "stretch"], "left").withColumn("r", F.coalesce("near", F.when(F.col("lone").isNull(), F.col("far"))))
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a == b)
    checks = F.array(both(_bare_etag(F.col("etag")), _bare_etag(F.col("r.etag"))), both(F.col("last_modified"), F.col("r.last_modified")), both(F.col("digest"), F.col("r.digest")))
    status = F.when(F.col("r").isNull(), "no_response").when(F.exists(checks, lambda x: x == F.lit(False)), "mismatch").when(F.exists(checks, lambda x: x), "resolved").otherwise("unchecked")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    out = joined.withColumn("status", status)
    return out.select("record_id", "canonical_url", "ts", F.col("r.record_id").alias("refers_to"), "status", F.when(F.col("status").isin("resolved", "unchecked"), merged).otherwise(F.col("headers")).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Four captures of each page as records: a response, a revisit, a changed or repeated capture, and a last revisit.

    The pages table has no crawl records; this derives them by rule, so that every status occurs.
    """
    tag = lambda k: F.substring(F.md5(F.concat_ws("|", F.lit("v"), F.col("page_id").cast("string"), k)), 1, 12)
    k, p = F.col("k"), F.col("page_id")
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    changed = F.when((k >= 2) & (p % 5 == 0), 1).otherwise(0)
    kind = F.when((k == 0) & (p % 7 != 3) | (k == 2) & (p % 5 == 0), "response").otherwise("revisit")
    etag = F.when(p % 11 == 4, None).otherwise(F.concat(F.when(k == 1, "W/").otherwise(""), tag(F.when((k == 3) & (p % 10 == 5), "0").otherwise(changed.cast("string")))))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + p * 60 + k * 10_000)
    headers = F.create_map(F.lit("etag"), F.coalesce(etag, F.lit("-")), F.lit("date"), ts.cast("long").cast("string"), F.lit("content-type"), F.when(k == 0, "text/html").otherwise("message/http"), F.lit("x-cache"), k.cast("string"))
    return rows.select((p * 4 + k).alias("record_id"), "url", ts.alias("ts"), kind.alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(p % 11 == 4, F.concat(F.col("body"), changed.cast("string"))).alias("digest"), headers.alias("headers"))


ORACLE = r"""
WITH captures AS (
  SELECT page_id AS p, k, md5(coalesce(html, '')) AS body, url,
         CASE WHEN k >= 2 AND page_id % 5 = 0 THEN 1 ELSE 0 END AS changed
  FROM pages, (VALUES (0), (1), (2), (3)) v(k)
), tagged AS (
  SELECT *, p * 4 + k AS record_id, 1700000000 + p * 60 + k * 10000 AS sec,
         CASE WHEN (k = 0 AND p % 7 <> 3) OR (k = 2 AND p % 5 = 0) THEN 'response' ELSE 'revisit' END AS kind,
         CASE WHEN p % 11 = 4 THEN NULL ELSE substr(md5('v|' || p || '|' || CASE WHEN k = 3 AND p % 10 = 5 THEN '0' ELSE changed::VARCHAR END), 1, 12) END AS etag,
         CASE WHEN p % 11 = 4 THEN body || changed END AS digest,
         regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[a-zA-Z]+://', '') AS bare
  FROM captures
), records AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') ||
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^([^?&]*)&', '\1?'), '/+(\?|$)', '\1', 'g') AS canonical_url
  FROM tagged
), found AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'digest': digest, 'k': k} END IGNORE NULLS)
            OVER (PARTITION BY canonical_url ORDER BY sec, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM records
)
SELECT record_id, canonical_url, r.id AS refers_to,
       CASE WHEN r IS NULL THEN 'no_response' WHEN etag <> r.etag OR digest <> r.digest THEN 'mismatch'
            WHEN etag = r.etag OR digest = r.digest THEN 'resolved' ELSE 'unchecked' END AS status,
       CASE WHEN r IS NOT NULL AND NOT coalesce(etag <> r.etag OR digest <> r.digest, FALSE)
            THEN CASE WHEN r.k = 0 THEN 'text/html' ELSE 'message/http' END ELSE CASE WHEN k = 0 THEN 'text/html' ELSE 'message/http' END END AS content_type,
       sec::VARCHAR AS "date"
FROM found WHERE kind = 'revisit'
"""
