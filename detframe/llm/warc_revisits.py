"""Resolution of not-modified revisit records: as-of join by canonical URL to the latest earlier full response.

A revisit takes the response with the same canonical URL and the largest time before its own (of several at
one time, the one with the largest record id). Its validators are then checked as a cache would: an entity
tag, compared weakly, decides if the revisit has one; else the last-modified date; else the payload digest.
Where they agree, the response's headers are merged with those of the revisit that a 304 may update.

A URL may hold any share of all captures: times are first combined per (URL, time), a URL with many of them
is cut into chunks at quantiles of its times, the window runs within a chunk, and the last response of
earlier chunks is carried in from the small table of chunks.

Defined results: a null URL or time resolves with nothing (`no_response`) and is a base for nothing; a null
text, empty map or missing header is absent; equal revisits are answered one by one; records of other kinds
and responses other than 200 are no base; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, materialize, small, table

#: Headers of a 304 that replace those of the stored response (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
CHUNK = 100_000

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def canonical_url(url):
    """Host without case, www. or default port; path without trailing slashes; sorted parameters but utm_*; no scheme, no fragment."""
    u = F.regexp_replace(url, r"(?s)#.*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, _SCHEME + r"([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, _SCHEME + r"[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"(?s)\?(.*)", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _reached(cuts: str, value: str, size: int):
    """How many of the ascending cuts, fewer than `size`, are no larger than the value (0 without cuts), by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= F.col(value), at + step).otherwise(at))


def _in_chunks(points: DataFrame, counts: DataFrame, sent, chunk: int) -> DataFrame:
    """points with their chunk: the points of each key in counts are cut at quantiles of their times. sent: how counts and cuts travel."""
    most = counts.agg(F.max("n")).first()[0]
    if not most:
        return points.withColumn("chunk", F.lit(0))
    # As many cuts as the busiest key needs; each key's row has all of them.
    k = min(10_000, -(-most // chunk) + 1)
    hot = points.join(sent(counts.select("key")), "key", "left_semi")
    busy = hot.groupBy("key").agg(F.percentile_approx("ts", [i / k for i in range(1, k)], 100 * k).alias("cuts"))
    return points.join(sent(materialize(busy, "as-of-cuts")), "key", "left").withColumn("chunk", _reached("cuts", "ts", k)).drop("cuts")


def as_of_points(bases: DataFrame, asked: DataFrame, chunk: int = CHUNK, many: int = 1000) -> DataFrame:
    """key, ts of `asked`, with the value of the latest earlier row of bases (key, ts, value); one row a point."""
    points = bases.groupBy("key", "ts").agg(F.max("value").alias("value")).withColumn("want", F.lit(0))
    asked = asked.select("key", "ts").distinct().select("key", "ts", F.lit(None).cast(bases.schema["value"].dataType).alias("value"), F.lit(1).alias("want"))
    points = points.unionByName(asked).groupBy("key", "ts").agg(F.max("value").alias("value"), F.max("want").alias("want"))
    points = materialize(points, "as-of-points")
    counts = points.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where(F.col("n") > chunk), "as-of-hot")
    # Keys with a thousandth of all points are few, whatever the table, and always broadcast. Of the others none fills a
    # task, so their points may meet their cuts by a shuffle, should they be many.
    least = HEAVY * points.count()
    heavy = F.broadcast(counts.where(F.col("n") >= least).select("key"))
    medium = counts.where(F.col("n") < least)
    parts = _in_chunks(points.join(heavy, "key", "left_semi"), counts.where(F.col("n") >= least), F.broadcast, chunk)
    points = parts.unionByName(_in_chunks(points.join(heavy, "key", "left_anti"), medium, lambda d: small(d, many), chunk))
    by_key = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = points.where(F.col("value").isNotNull()).groupBy("key", "chunk").agg(F.max_by("value", "ts").alias("end"))
    every = points.select("key", "chunk").distinct().join(ends, ["key", "chunk"], "left")
    carried = every.withColumn("carried", F.last("end", ignorenulls=True).over(by_key)).select("key", "chunk", "carried")
    before = Window.partitionBy("key", "chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = points.withColumn("before", F.last("value", ignorenulls=True).over(before)).where("want = 1")
    return inside.join(carried, ["key", "chunk"]).select("key", "ts", F.coalesce("before", "carried").alias("value"))


def resolve_revisits(captures: DataFrame, chunk: int = CHUNK, permitted=PERMITTED) -> DataFrame:
    """captures: record_id, url, ts, type, status, headers (lower-case names), digest.

    One row a revisit: revisit_id, canonical_url, ts, response_id, outcome (resolved, no_response,
    validator_mismatch, no_validator), checked (etag, last-modified, digest), headers (merged, if resolved).
    """
    c = captures.withColumn("key", canonical_url(F.col("url")))
    full = c.where((F.col("type") == "response") & (F.col("status") == 200) & F.col("key").isNotNull() & F.col("ts").isNotNull())
    # Maps can't be compared; the entries, sorted, can.
    stored = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    bases = full.select("key", "ts", F.struct("record_id", stored.alias("entries"), "digest").alias("value"))
    revisits = materialize(c.where("type = 'revisit'").select("record_id", "key", "ts", "headers", "digest"), "revisits")
    points = as_of_points(bases, revisits.where("key IS NOT NULL AND ts IS NOT NULL"), chunk)
    r = revisits.join(points, ["key", "ts"], "left").withColumn("base", F.map_from_entries("value.entries"))
    tag = lambda m: F.regexp_replace(F.element_at(F.col(m), F.lit("etag")), "^W/", "")
    same_tag = tag("headers") == tag("base")
    date = lambda m: F.element_at(F.col(m), F.lit("last-modified"))
    has_tag, has_date = tag("headers").isNotNull(), date("headers").isNotNull()
    checked = F.when(has_tag, "etag").when(has_date, "last-modified").when(F.col("digest").isNotNull(), "digest")
    agrees = F.when(has_tag, same_tag).when(has_date, date("headers") == date("base")).when(F.col("digest").isNotNull(), F.col("digest") == F.col("value.digest"))
    outcome = F.when(F.col("value").isNull(), "no_response").when(checked.isNull(), "no_validator").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("validator_mismatch")
    r = r.withColumn("outcome", outcome).withColumn("checked", F.when(F.col("value").isNotNull(), checked))
    new = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("base", lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>"))))
    return r.select(F.col("record_id").alias("revisit_id"), F.col("key").alias("canonical_url"), "ts", F.col("value.record_id").alias("response_id"), "outcome", "checked", merged.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log from raw pages: of each page a full response, a later revisit, and one an hour before."""
    num = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    first = F.lit(1_700_000_000) + num * 600
    modified = (first - num % 90_000).cast("string")
    response = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("date"), first.cast("string"), F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=600"))
    p = pages.select("page_id", "url", tag.alias("tag"), first.alias("first"), modified.alias("modified"), response.alias("response"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"))

    def revisit(ts):
        etag = F.when(num % 7 == 0, '"changed"').when(num % 7 == 1, F.concat(F.lit("W/"), F.col("tag"))).when(num % 5 == 0, None).otherwise(F.col("tag"))
        entries = F.map_from_arrays(F.array(*map(F.lit, ("etag", "last-modified", "date", "cache-control", "content-length"))), F.array(etag, F.when(num % 3 == 0, F.col("modified")), ts.cast("string"), F.concat(F.lit("max-age="), (num % 10).cast("string")), F.lit("0")))
        return F.map_filter(entries, lambda k, v: v.isNotNull())

    kinds = [("response", 0, F.col("first"), F.lit(200), F.col("response")), ("revisit", 1, F.col("first") + 86_400 * (1 + num % 5), F.lit(304), None), ("revisit", 2, F.col("first") - 3600, F.lit(304), None)]
    out = None
    for kind, k, ts, status, headers in kinds:
        one = p.select((num * 3 + k).alias("record_id"), "url", ts.alias("ts"), F.lit(kind).alias("type"), status.alias("status"), (headers if headers is not None else revisit(ts)).alias("headers"), F.when(num % 15 != 5, F.col("digest")).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    r = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return r.select("revisit_id", "canonical_url", "ts", "response_id", "outcome", "checked", lines.alias("headers"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
                  1700000000 + page_id * 600 AS t0, regexp_replace(url, '(?s)#.*', '') AS u FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
             || regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS hp,
             list_sort([x FOR x IN string_split(regexp_extract(u, '(?s)\?(.*)', 1), '&') IF x <> '' AND NOT starts_with(x, 'utm_')]) AS params,
             CAST(t0 - page_id % 90000 AS VARCHAR) AS modified FROM p),
c AS (SELECT *, hp || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS k FROM q),
rv AS (SELECT page_id, page_id * 3 + j AS revisit_id, k, CASE j WHEN 1 THEN t0 + 86400 * (1 + page_id % 5) ELSE t0 - 3600 END AS ts, digest, page_id % 15 <> 5 AS has_digest,
              CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 7 = 1 THEN 'W/' || tag WHEN page_id % 5 = 0 THEN NULL ELSE tag END AS etag,
              CASE WHEN page_id % 3 = 0 THEN modified END AS lm, 'max-age=' || CAST(page_id % 10 AS VARCHAR) AS cc FROM c, (SELECT unnest([1, 2]) AS j)),
b AS (SELECT rv.*, c.page_id AS base, c.tag AS btag, c.modified AS blm, CASE WHEN c.page_id % 15 <> 5 THEN c.digest END AS bdigest, len(c.html) AS blen,
             row_number() OVER (PARTITION BY rv.revisit_id ORDER BY c.t0 DESC, c.page_id DESC) AS rn
      FROM rv LEFT JOIN c ON c.k = rv.k AND c.t0 < rv.ts),
o AS (SELECT *, CASE WHEN base IS NULL THEN NULL WHEN etag IS NOT NULL THEN 'etag' WHEN lm IS NOT NULL THEN 'last-modified' WHEN has_digest THEN 'digest' END AS checked,
             CASE WHEN base IS NULL THEN 'no_response'
                  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = btag THEN 'resolved' ELSE 'validator_mismatch' END
                  WHEN lm IS NOT NULL THEN CASE WHEN lm = blm THEN 'resolved' ELSE 'validator_mismatch' END
                  WHEN has_digest THEN CASE WHEN digest = bdigest THEN 'resolved' ELSE 'validator_mismatch' END
                  ELSE 'no_validator' END AS outcome FROM b WHERE rn = 1)
SELECT revisit_id, k AS canonical_url, ts, base * 3 AS response_id, outcome, checked,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || cc || chr(10) || 'content-length: ' || CAST(blen AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || CAST(ts AS VARCHAR) || chr(10) || 'etag: ' || coalesce(etag, btag) || chr(10) || 'last-modified: ' || blm END AS headers
FROM o
"""
