"""WARC revisits: not-modified responses resolved against the full responses they stand for.

A revisit (status 304) has no body.  It belongs to the latest earlier full response of the same
canonical URL, if their validators agree: entity tags, compared weakly, where both have one,
else last-modified dates, else payload digests.  The resolved response has the stored headers,
updated by those headers of the 304 that may be updated: none that describe a body.

The as-of join never gathers a URL's records in one task.  Records are cut into spans of time;
inside a span a running window finds the last response, and the last responses of earlier spans,
one row a span, are carried over.

Cases: a null or unparsable URL resolves to nothing; responses at the revisit's own time are not
earlier; of responses at one time that with the largest record_id is later; a null date
resolves to nothing; header names are compared in lower case, of names that differ in case alone the first value
in order counts, a null map has no headers;
repeated rows are records of their own; empty tables give empty results; other columns of the
records are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Headers that a 304 never changes: they describe the body stored or the hop.
FIXED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that track a visit.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Scheme, host and port in their plainest form; no fragment, tracking or final slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    parts = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    scheme = F.lower(F.regexp_extract(bare, parts, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, parts, 2)), "^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(bare, parts, 3), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, parts, 4), f"([?&])({TRACKING})=[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, "&&+", "&"), r"\?&", "?"), "[?&]+$", "")
    return F.when(bare.rlike(parts) & (host != ""), F.concat(scheme, F.lit("://"), host, path, query))


def header(name: str, headers: str = "headers") -> Column:
    return F.element_at(F.col(headers), name)


def plain_tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def resolved(records: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """Each revisit with the response it stands for.

    ``records``: ``record_id`` long, ``url``, ``date`` timestamp, ``status`` int, ``headers``
    map, ``digest`` string of the payload.  Returns ``record_id, canonical_url, response_id,
    verdict`` (resolved, validators_differ, no_earlier_response), ``headers`` and ``digest``,
    the last two merged and null unless resolved.
    """
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    lowered = F.map_from_entries(F.filter(entries, lambda e, i: ~F.get(entries, i - 1)["key"].eqNullSafe(e["key"])))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "date", "status", lowered.alias("headers"), "digest")
    rows = rows.where((F.col("status") == 304) | F.col("status").between(200, 299))
    full = (F.col("status") != 304) & F.col("canonical_url").isNotNull() & F.col("date").isNotNull()
    stored = F.when(full, F.struct("date", "record_id", "headers", "digest"))
    rows = rows.withColumn("stored", stored).withColumn("span", F.floor(F.unix_micros(F.col("date").cast("timestamp")) / (span_seconds * 1_000_000)))
    # Bodies are behind; what is left is read twice.
    rows = shared.written(rows, shared.work_folder(records.sparkSession), "records")
    # Those without a URL or a date, be they many, have nothing to meet and are not shuffled.
    lost = F.col("canonical_url").isNull() | F.col("date").isNull()
    alone, rows = rows.where(lost & (F.col("status") == 304)), rows.where(~lost)
    # The last response before each span that has records of a URL.
    spans = rows.groupBy("canonical_url", "span").agg(F.max_by("stored", F.when(full, F.struct("date", "record_id"))).alias("held"))
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "span", F.last("held", ignorenulls=True).over(before).alias("carried"))
    # Inside a span: strictly earlier by date, so equal dates share one frame.
    inside = Window.partitionBy("canonical_url", "span").orderBy(F.unix_micros(F.col("date").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(full, F.struct("date", "record_id", "headers_json", "digest"))).over(inside)
    ranked = rows.withColumn("headers_json", F.to_json("headers")).withColumn("near", latest).where("status = 304")
    ranked = ranked.join(carried, ["canonical_url", "span"], "left")
    known = F.coalesce(F.when(F.col("near").isNotNull(), F.struct(F.col("near.date").alias("date"), F.col("near.record_id").alias("record_id"), F.from_json("near.headers_json", "map<string,string>").alias("headers"), F.col("near.digest").alias("digest"))), "carried")
    found = ranked.select("record_id", "canonical_url", "headers", "digest", known.alias("r")).withColumn("r_headers", F.col("r.headers"))
    ours, theirs = header("etag"), header("etag", "r_headers")
    dated, their_date = header("last-modified"), header("last-modified", "r_headers")
    agrees = F.when(ours.isNotNull() & theirs.isNotNull(), plain_tag(ours) == plain_tag(theirs)).when(dated.isNotNull() & their_date.isNotNull(), dated == their_date).otherwise(F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(False)))
    verdict = F.when(F.col("r").isNull(), "no_earlier_response").when(agrees, "resolved").otherwise("validators_differ")
    updates = F.map_filter("headers", lambda k, v: ~k.isin(FIXED))
    kept = F.map_filter("r_headers", lambda k, v: ~F.map_contains_key(updates, k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, updates))))
    resolved_only = F.col("verdict") == "resolved"
    found = found.withColumn("verdict", verdict).select("record_id", "canonical_url", F.col("r.record_id").alias("response_id"), "verdict", F.when(resolved_only, merged).alias("headers"), F.when(resolved_only, F.col("r.digest")).alias("digest"))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("response_id", "headers", "digest")]
    return found.unionByName(alone.select("record_id", "canonical_url", F.lit("no_earlier_response").alias("verdict"), *none))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a page table: each page's full response, and a later revisit of it.

    A rule stands in for a crawl: the revisit comes 1 to 5 days later under another spelling of
    the URL; every seventh has changed since, every eleventh has no entity tag but a date.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("2023-11-"), F.lpad((F.pmod("page_id", F.lit(28)) + 1).cast("string"), 2, "0"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60"))
    response = F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url"), at.alias("date"), F.lit(200).alias("status"), headers.alias("headers"), F.col("digest"))
    changed = F.col("page_id") % 7 == 0
    shown = F.when(changed, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    undated = F.col("page_id") % 11 == 0
    news = F.when(undated, F.create_map(F.lit("Last-Modified"), day, F.lit("Content-Length"), F.lit("0"))).otherwise(F.create_map(F.lit("ETag"), shown, F.lit("Cache-Control"), F.lit("max-age=900"), F.lit("Content-Length"), F.lit("0")))
    spelled = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("#again"))).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^http://([^/]*)", "HTTP://$1:80")).otherwise(F.col("url"))
    later = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + 86_400 * (1 + F.col("page_id") % 5))
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("date"), F.lit(304).alias("status"), news.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return page.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")
