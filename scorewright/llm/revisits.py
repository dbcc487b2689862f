"""Not-modified revisit records of a web archive, resolved to the full response that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: What a not-modified answer may update in the stored response; framing and content headers stay the response's own.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parameters that say where a visitor came from, never which page is meant.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)(=|$)"


def canonical(url: Column) -> Column:
    """The URL without scheme, www, default port, fragment, tracking and empty parameters, trailing slash and .html, its host in
    lower case and its parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(url, "#(?s:.*)$", ""), "^[a-zA-Z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*+", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*+([^?]*+)", 1), r"(/|/index\.html|\.html)$", "")
    own = F.filter(F.split(F.regexp_extract(bare, r"(?s)^[^?]*+\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(own), "&"))).otherwise(F.lit("")))


def earlier_response(keys: DataFrame) -> DataFrame:
    """keys(url, ts, response_id), one row for each url and ts -> (url, ts, ref_id), the last response_id before ts.

    Keys are range-partitioned by url and time, so a URL with a third of all rows spans as many partitions as its
    rows need. Inside a partition a running window finds the response; each partition's last one for a URL, one
    row, is carried to the partitions after it.
    """
    cut = checkpoint(keys.repartitionByRange("url", "ts").withColumn("part", F.spark_partition_id()))
    last = F.when(F.col("response_id").isNotNull(), F.struct("ts", "response_id"))
    ends = cut.groupBy("url", "part").agg(F.max(last).alias("end"))
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpoint(ends.select("url", "part", F.max("end").over(before)["response_id"].alias("carried")))
    own = Window.partitionBy("url", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("url", "ts", "part", F.last("response_id", ignorenulls=True).over(own).alias("inside"))
    return inside.join(carried, ["url", "part"]).select("url", "ts", F.coalesce("inside", "carried").alias("ref_id"))


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """records(record_id, url, ts, kind, headers) -> one row for each revisit: record_id, url, refers_to, outcome, headers.

    kind is 'response' (full) or 'revisit'; header names are lower case. outcome is 'resolved', 'mismatch' (a validator
    of the revisit differs from the response's; the ETag, compared weakly, decides where there is one, else
    Last-Modified), 'unverified' (the revisit has neither) or 'no-response'. headers are the response's with the
    permitted ones of the revisit on top where resolved, the revisit's own otherwise. A null url or ts has no
    response; of responses at one time the largest id counts; only an earlier time counts. Null headers are empty. Of
    responses with one record id, the one whose sorted headers come last stands for all; repeated revisits are resolved
    each on its own.
    """
    at = records.select("record_id", canonical(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    at = checkpoint(at)
    revisits, responses = at.where("kind = 'revisit'"), at.where("kind = 'response'")
    timed = at.where(F.col("url").isNotNull() & F.col("ts").isNotNull())
    keys = timed.groupBy("url", "ts").agg(F.max(F.when(F.col("kind") == "response", F.col("record_id"))).alias("response_id"))
    ref = checkpoint(earlier_response(keys))
    found = revisits.alias("r").join(ref.where("ref_id IS NOT NULL").alias("k"), ["url", "ts"], "left").select("record_id", "url", "headers", "ref_id")
    stored = responses.groupBy(F.col("record_id").alias("ref_id")).agg(F.map_from_entries(F.max(F.array_sort(F.map_entries("headers")))).alias("stored"))
    found = checkpoint(found).join(checkpoint(stored), "ref_id", "left")
    new, old = F.col("headers"), F.col("stored")
    differs = F.when(new["etag"].isNotNull(), ~strong(new["etag"]).eqNullSafe(strong(old["etag"]))).when(new["last-modified"].isNotNull(), ~new["last-modified"].eqNullSafe(old["last-modified"]))
    outcome = F.when(F.col("ref_id").isNull(), "no-response").when(differs.isNull(), "unverified").when(differs, "mismatch").otherwise("resolved")
    update = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return found.select("record_id", "url", F.col("ref_id").alias("refers_to"), outcome.alias("outcome"), F.when(outcome == "resolved", merged).otherwise(new).alias("headers"))


#: Three captures of each page: the response, and two revisits with validators that agree, differ or are weak or missing.
CAPTURE = {
    "record_id": "page_id * 4 + k",
    "ts": "page_id + k * 1000000",
    "kind": "CASE WHEN k = 0 THEN 'response' ELSE 'revisit' END",
    "etag": """CASE WHEN k = 2 AND page_id % 3 = 0 THEN NULL WHEN k = 1 AND page_id % 7 = 0 THEN '"stale"' WHEN k = 2 THEN 'W/"' || digest || '"' ELSE '"' || digest || '"' END""",
    "last_modified": "CASE WHEN k = 2 AND page_id % 15 = 0 THEN NULL WHEN k = 2 AND page_id % 5 = 0 THEN 'later' ELSE 'day ' || CAST(page_id % 28 AS STRING) END",
    "cache_control": "'max-age=' || CAST(60 * (k + 1) AS STRING)",
    "content_type": "CASE WHEN k = 0 THEN 'text/html' ELSE 'text/plain' END",
}
NAMES = {"cache_control": "cache-control", "content_type": "content-type", "etag": "etag", "last_modified": "last-modified"}


def captures(pages: DataFrame) -> DataFrame:
    """Archive records for the pages table, which holds none: a stand-in made by expressions alone."""
    each = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    flat = each.select("url", *(F.expr(v).alias(c) for c, v in CAPTURE.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for c, n in NAMES.items()))
    return flat.select(F.col("record_id").cast("long"), "url", F.col("ts").cast("long"), "kind", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("headers"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(read_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "url", "refers_to", "outcome", F.array_join(lines, "\n").alias("headers"))


ORACLE_OP7 = rf"""
WITH bare AS (SELECT page_id, html, regexp_extract(split_part(url, '#', 1), '^([a-zA-Z]+://)?(.*)$', 2, 's') AS b FROM pages WHERE url IS NOT NULL
    UNION ALL SELECT page_id, html, NULL FROM pages WHERE url IS NULL),
parts AS (SELECT page_id, html, split_part(split_part(b, '?', 1), '/', 1) AS host, split_part(b, '?', 1)[length(split_part(split_part(b, '?', 1), '/', 1)) + 1:] AS path,
    list_filter(string_split(CASE WHEN contains(b, '?') THEN b[position('?' IN b) + 1:] ELSE '' END, '&'), lambda p: p <> '' AND NOT (split_part(p, '=', 1) IN ('fbclid', 'gclid') OR regexp_full_match(split_part(p, '=', 1), 'utm_[a-z]+'))) AS params FROM bare),
named AS (SELECT page_id, md5(coalesce(html, '')) AS digest,
    regexp_replace(lower(host), '^www\.|:(80|443)$', '', 'g') || CASE WHEN ends_with(path, '/index.html') THEN path[:-12] WHEN ends_with(path, '.html') THEN path[:-6] WHEN ends_with(path, '/') THEN path[:-2] ELSE path END ||
    CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END AS url FROM parts),
each AS (SELECT page_id, url, digest, unnest([0, 1, 2]) AS k FROM named),
c AS (SELECT url, {", ".join(f"{v} AS {k}" for k, v in CAPTURE.items())} FROM each),
full_ AS (SELECT * FROM c WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY url, ts ORDER BY record_id DESC) = 1),
j AS (SELECT r.*, f.record_id AS refers_to, f.etag AS f_etag, f.last_modified AS f_modified, f.content_type AS f_type
      FROM (SELECT * FROM c WHERE kind = 'revisit') r ASOF LEFT JOIN full_ f ON r.url = f.url AND r.ts > f.ts),
o AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no-response'
      WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') IS DISTINCT FROM regexp_replace(f_etag, '^W/', '') THEN 'mismatch' ELSE 'resolved' END
      WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified IS DISTINCT FROM f_modified THEN 'mismatch' ELSE 'resolved' END
      ELSE 'unverified' END AS outcome FROM j)
SELECT record_id::BIGINT AS record_id, url, refers_to::BIGINT AS refers_to, outcome,
  concat_ws(chr(10), 'cache-control: ' || cache_control, 'content-type: ' || CASE WHEN outcome = 'resolved' THEN f_type ELSE content_type END,
    'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, f_etag) ELSE etag END,
    'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(last_modified, f_modified) ELSE last_modified END) AS headers
FROM o
"""
