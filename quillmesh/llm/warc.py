"""Not-modified revisit resolution for web-archive records, in DataFrame functions.

A revisit (304) is an as-of join by canonical URL to the latest earlier full response. Time is cut
into buckets: inside a bucket a window finds the latest response; from earlier buckets one row a
bucket is carried forward. A URL with a third of all captures is so spread over its buckets.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that do not name a resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
#: Fields that a 304 may replace in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url):
    """Without scheme, user, leading www., default port, fragment, tracking parameters and trailing
    slashes; host in lower case; parameters in order."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers):
    """The map with its names in lower case; of names that then are equal the last in order counts."""
    empty = F.create_map().cast("map<string,string>")
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"]))
    return F.aggregate(F.array_sort(F.map_entries(headers)), empty, put)


def _validator(headers, name):
    value = F.element_at(headers, name)
    return F.regexp_replace(value, "^W/", "") if name == "etag" else value


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86400, permitted=PERMITTED) -> DataFrame:
    """records: record_id, kind ('response' or 'revisit'), url, ts, status, headers (map;
    names count in any case and come out in lower case), digest. One row per revisit: record_id, url (canonical), response_id,
    response_ts, outcome, headers.

    The response is the latest full one (status 200) of the same canonical URL strictly earlier in
    time; equal times go to the larger record_id. outcome is 'resolved'; 'no_response' if there is
    none; else the first validator that both carry and that differs: 'etag' (weak comparison),
    'last-modified', 'digest'. Only resolved revisits get headers: those of the response with the
    ``permitted`` fields of the revisit in place of its own. Null urls and null times resolve to
    nothing; null headers are empty. Repeated revisits each get a row; other columns are ignored.
    """
    no_headers = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id",
        F.col("kind").alias("what"),
        canonical_url(F.col("url")).alias("url"),
        "ts",
        lower_names(F.coalesce("headers", no_headers)).alias("headers"),
        "digest",
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
    ).where("what = 'revisit' or full")
    rows = rows.withColumn("bucket", F.floor(F.unix_timestamp("ts") / bucket_seconds))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "headers", "digest"))
    known = rows.where("url is not null and ts is not null").withColumn("response", response)
    inside = (
        Window.partitionBy("url", "bucket").orderBy("ts", F.coalesce("full", F.lit(False)), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    recent = known.withColumn("recent", F.last("response", ignorenulls=True).over(inside)).where("what = 'revisit'")
    last = known.groupBy("url", "bucket").agg(
        F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last")
    )
    earlier = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    joined = recent.join(carried, ["url", "bucket"], "left").withColumn("r", F.coalesce("recent", "carried"))
    lost = rows.where("what = 'revisit' and (url is null or ts is null)")
    mine, theirs = F.col("headers"), F.col("r.headers")

    def differs(name):
        return _validator(mine, name) != _validator(theirs, name)

    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(differs("etag"), "etag")
        .when(differs("last-modified"), "last-modified")
        .when(F.col("digest") != F.col("r.digest"), "digest")
        .otherwise("resolved")
    )
    fresh = F.map_filter(mine, lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    resolved = F.col("outcome") == "resolved"
    return (
        joined.withColumn("outcome", outcome)
        .select(
            "record_id",
            "url",
            F.when(resolved, F.col("r.record_id")).alias("response_id"),
            F.when(resolved, F.col("r.ts")).alias("response_ts"),
            "outcome",
            F.when(resolved, merged).alias("headers"),
        )
        .unionByName(
            lost.select(
                "record_id", "url", F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"),
                F.lit(None).cast("timestamp").alias("response_ts"), F.lit("no_response").alias("outcome"),
                F.lit(None).cast("map<string,string>").alias("headers"),
            )
        )
    )


def header_text(headers):
    """The fields in order of name, a line each."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A capture history of ``pages``: each page is a full response (record 2n) and, some hours
    later, a revisit (record 2n + 1) whose validators fail now and then. Record times follow
    page_id, so pages that share a canonical URL interleave."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    page = F.col("page_id")
    at = start + page * 61
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select(page, F.col("url"), at.alias("at"), tag.alias("tag"))
    responses = base.select(
        (page * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        F.timestamp_seconds("at").alias("ts"),
        F.when(page % 13 == 4, 404).otherwise(200).alias("status"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit('"'), F.substring("tag", 1, 8), F.lit('"')), F.lit("content-type"), F.lit("text/html"),
            F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("tag").alias("digest"),
    )
    revisits = base.select(
        (page * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat("url", F.when(page % 2 == 0, "#again").otherwise("")).alias("url"),
        F.timestamp_seconds(F.col("at") + F.when(page % 11 == 5, -30).otherwise((page % 5 + 1) * 21600)).alias("ts"),
        F.lit(304).alias("status"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit('W/"'), F.when(page % 7 == 3, "changed").otherwise(F.substring("tag", 1, 8)), F.lit('"')),
            F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=90"),
        ).alias("headers"),
        F.when(page % 17 == 2, "other").otherwise(F.col("tag")).alias("digest"),
    )
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (
  SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, md5(coalesce(html, '')) AS tag,
         1704067200 + page_id * 61 AS t0 FROM pages),
p2 AS (SELECT *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
p3 AS (
  SELECT page_id, tag, t0,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS q
  FROM p2),
c AS (SELECT page_id, tag, t0, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM p3),
resp AS (SELECT page_id * 2 AS record_id, url, t0 AS ts, tag FROM c WHERE page_id % 13 <> 4),
rev AS (
  SELECT page_id, page_id * 2 + 1 AS record_id, url,
         t0 + CASE WHEN page_id % 11 = 5 THEN -30 ELSE (page_id % 5 + 1) * 21600 END AS ts,
         CASE WHEN page_id % 7 = 3 THEN 'changed' ELSE substr(tag, 1, 8) END AS etag,
         CASE WHEN page_id % 17 = 2 THEN 'other' ELSE tag END AS digest
  FROM c),
j AS (
  SELECT rev.*, resp.record_id AS rid, resp.tag AS rtag,
         row_number() OVER (PARTITION BY rev.record_id ORDER BY resp.ts DESC, resp.record_id DESC) AS n
  FROM rev LEFT JOIN resp ON rev.url = resp.url AND resp.ts < rev.ts),
o AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN etag <> substr(rtag, 1, 8) THEN 'etag'
                 WHEN digest <> rtag THEN 'digest' ELSE 'resolved' END AS outcome
  FROM j WHERE n = 1)
SELECT record_id, url, CASE WHEN outcome = 'resolved' THEN rid END AS response_id, outcome,
       CASE WHEN outcome = 'resolved'
            THEN 'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/"' || etag || '"' END AS headers
FROM o
"""
