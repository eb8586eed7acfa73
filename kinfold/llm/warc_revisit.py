"""Not-modified revisits of web archives resolved to full responses (operator 8). The join is of DataFrame functions only.

A revisit record says that its url's content was what an earlier capture had. It is joined, as of its time, to the
latest strictly earlier full response of the same canonical url; its validators are checked against that
response's, and the headers that a not-modified answer may renew are merged over the response's.

The as-of join never sorts a whole url in one task: time is cut into SEGMENTS spans that hold equal shares of all records
(at approximate quantiles, so that a few stray times, as 1970, don't make one span of all others). Within (url, span) a
running maximum finds the latest response; the latest of each earlier span comes from a table of one row for each (url,
span), at most SEGMENTS rows a url, combined before its shuffle. A url with a third of all records is up to SEGMENTS groups.

`read_warc` makes such records from WARC files.

Status: `resolved`; `validator_mismatch` if the latest earlier response has another entity tag (compared weakly), or
where one of the two has none, another Last-Modified; `unvalidated` if no validator could be compared, which
resolves by time alone; `no_earlier_response`.

Defined results: a null url or time finds no response; responses of one url and time: the greatest record_id counts;
an empty table gives an empty one; urls and headers of any length are compared whole; ports 80 and 443 are default
ports whatever the scheme, which is dropped; null headers count as none; header names are compared in lower case, and a name that occurs twice after that keeps
its last value; repeated revisits get a row each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import ship_package, written

SEGMENTS, FAN = 256, 16
#: The fields that a 304 answer carries to renew a stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, user, www., default port and fragment; host in lower case, parameters sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""), r"^[^/?@]*@", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    after = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_extract(after, r"^[^?]*", 0)
    query = F.regexp_replace(after, r"^[^?]*\??", "")
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def _lower_names(headers: Column) -> Column:
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def _span(us: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at or before a time, found in two steps of about FAN comparisons."""
    groups = [cuts[k : k + FAN] for k in range(0, len(cuts), FAN)]
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    if not groups:
        return F.lit(0)
    before = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c <= us))
    rest = F.coalesce(F.try_element_at(F.array(*map(longs, groups)), before + 1), longs([]))
    return F.when(us.isNotNull(), before * FAN + F.size(F.filter(rest, lambda c: c <= us)))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts, kind (`response` or `revisit`), headers map, digest, length.

    (record_id, canonical_url, ts, status, response_id, digest, length, headers), a row for each revisit."""
    r = records.select("record_id", canonical_url(records["url"]).alias("canonical_url"), "ts", "kind", _lower_names(records["headers"]).alias("h"), "digest", "length")
    r = r.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    r = written(r.withColumn("etag", F.regexp_replace(F.col("h")["etag"], "^W/", "")).withColumn("modified", F.col("h")["last-modified"]), "captures")
    shares = [k / SEGMENTS for k in range(1, SEGMENTS)]
    cuts = r.agg(F.percentile_approx("us", shares, 10 * SEGMENTS).alias("cuts")).first()["cuts"] or []
    r = r.withColumn("span", _span(F.col("us"), sorted(set(cuts))))
    known = r.where("canonical_url IS NOT NULL AND us IS NOT NULL")
    found = F.struct("us", "record_id", "etag", "modified", "digest", "length", F.map_entries("h").alias("entries"))
    response = F.when(F.col("kind") == "response", found)
    ends = known.where("kind = 'response'").groupBy("canonical_url", "span").agg(F.max(found).alias("end"))
    spans = known.select("canonical_url", "span").distinct().join(ends, ["canonical_url", "span"], "left")
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "span", F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("canonical_url", "span").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    at = known.withColumn("within", F.max(response).over(within)).where("kind = 'revisit'")
    at = at.join(carried, ["canonical_url", "span"], "left").withColumn("r", F.coalesce("within", "carried"))
    lost = r.where("kind = 'revisit' AND (canonical_url IS NULL OR us IS NULL)")
    both = at.unionByName(lost, allowMissingColumns=True)
    by_tag = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    by_time = F.col("modified").isNotNull() & F.col("r.modified").isNotNull()
    status = (
        F.when(F.col("r").isNull(), "no_earlier_response")
        .when(by_tag, F.when(F.col("etag") == F.col("r.etag"), "resolved").otherwise("validator_mismatch"))
        .when(by_time, F.when(F.col("modified") == F.col("r.modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    both = both.withColumn("status", status).withColumn("ok", F.col("status").isin("resolved", "unvalidated"))
    renewed = F.map_filter("h", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.map_from_entries("r.entries"), lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return both.select(
        "record_id", "canonical_url", "ts", "status", F.when(F.col("ok"), F.col("r.record_id")).alias("response_id"),
        F.when(F.col("ok"), F.col("r.digest")).alias("digest"), F.when(F.col("ok"), F.col("r.length")).alias("length"),
        F.when(F.col("ok"), F.map_concat(kept, renewed)).alias("headers"),
    )


def parse_warc(raw: bytes) -> Iterator[tuple]:
    """(record_id, url, ts, kind, headers, digest, length) of a WARC file's responses and revisits, gzipped or not.

    Raises ValueError at bytes that are no record. length: of the payload; headers: of the http message."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:  # each record is a member of its own
            d = zlib.decompressobj(31)
            parts += [d.decompress(raw), d.flush()]
            raw = d.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(head["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the WARC record at byte {at} is cut short")
        at = end + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if head.get("warc-type") in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])] if http.startswith(b"HTTP/") else []
            when = datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00")) if "warc-date" in head else None
            yield (head.get("warc-record-id", "").strip("<>") or None, head.get("warc-target-uri", "").strip("<>") or None, when, head["warc-type"], list(dict(fields).items()), head.get("warc-payload-digest"), len(body))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, for `resolve`. Files are read in parallel, each whole by one task (up to 2^31 bytes)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import warc_revisit as W

        kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
        for batch in batches:
            for raw in batch.column(0):
                rows = list(W.parse_warc(raw.as_py()))
                for k in range(0, len(rows), 4096):
                    columns = zip(*rows[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["record_id", "url", "ts", "kind", "headers", "digest", "length"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, url string, ts timestamp, kind string, headers map<string,string>, digest string, length long")


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl made from every page: its full response, a revisit a day later by another form of its url, whose
    tag is stale for every seventh page, and for every fifth page a revisit before the response."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select("page_id", "url", F.md5(text).alias("md5"), F.sha1(text).alias("digest"), F.octet_length(text).cast("long").alias("length"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    day = F.expr("INTERVAL 1 DAY")
    tag = F.concat(F.lit('"'), F.substring("md5", 1, 16), F.lit('"'))
    stale = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("etag"), stale, F.lit("date"), F.date_format(at + day, "yyyy-MM-dd HH:mm:ss"), F.lit("Server"), F.lit("other"))
    other = F.concat(F.col("url"), F.lit("#again"))
    none = F.lit(None)
    response = base.select((F.col("page_id") * 3).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), full.alias("headers"), "digest", "length")
    later = base.select((F.col("page_id") * 3 + 1).alias("record_id"), other.alias("url"), (at + day).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers"), none.cast("string").alias("digest"), none.cast("long").alias("length"))
    early = base.where("page_id % 5 = 0").select((F.col("page_id") * 3 + 2).alias("record_id"), "url", (at - day).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers"), none.cast("string").alias("digest"), none.cast("long").alias("length"))
    return response.unionByName(later).unionByName(early)


def report(pages: DataFrame) -> DataFrame:
    """resolve() over captures(), with the headers as lines in order of their names; -1 for no response."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolve(captures(pages)).select("record_id", "canonical_url", F.unix_micros("ts").alias("us"), "status", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "digest", F.coalesce("length", F.lit(-1)).alias("length"), lines.alias("headers"))


#: For DuckDB, over pages.
SQL = r"""
WITH b AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS md5, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS length,
         to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC' AS made, '"' || substring(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^[^/?@]*@', '') AS rest FROM b
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '^[^?]*') AS path, regexp_replace(regexp_replace(rest, '^[^/?]*', ''), '^[^?]*\??', '') AS query FROM u
), k AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical_url FROM c
), r AS (
  SELECT canonical_url, made, page_id * 3 AS response_id, digest, length, tag FROM k
  QUALIFY row_number() OVER (PARTITION BY canonical_url, made ORDER BY page_id DESC) = 1
), v AS (
  SELECT page_id * 3 + 1 AS record_id, canonical_url, made + INTERVAL 1 DAY AS ts, made + INTERVAL 1 DAY AS said, CASE WHEN page_id % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END AS tag FROM k
  UNION ALL
  SELECT page_id * 3 + 2, canonical_url, made - INTERVAL 1 DAY, made + INTERVAL 1 DAY, CASE WHEN page_id % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END FROM k WHERE page_id % 5 = 0
), j AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.said, v.tag, r.response_id, r.digest, r.length, r.tag AS old,
         CASE WHEN r.response_id IS NULL THEN 'no_earlier_response' WHEN regexp_replace(v.tag, '^W/', '') = r.tag THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM v ASOF LEFT JOIN r ON v.canonical_url = r.canonical_url AND v.ts > r.made
)
SELECT record_id, canonical_url, epoch_us(ts) AS us, status,
       CASE WHEN status = 'resolved' THEN response_id ELSE -1 END AS response_id, CASE WHEN status = 'resolved' THEN digest END AS digest, CASE WHEN status = 'resolved' THEN length ELSE -1 END AS length,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || strftime(said, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || tag END AS headers
FROM j
"""
