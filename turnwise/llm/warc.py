"""Archive records whose page had not changed, given back the body they refer to.

A revisit (an answer 304 without a body) takes the body of the latest earlier full response of the
same canonical URL, if its validators agree with that response, and the stored headers updated by
those that such an answer may update.

The as-of join runs in two levels: inside a (URL, span of time) a window finds the latest response,
and one row of each span carries it to later spans.  Only ids and validators take part in it; headers
and bodies are joined by record id afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

SPAN_SECONDS = 7 * 86_400
#: Headers of a 304 answer that replace stored ones.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
BREAK = "\r\n"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query of a URL: no scheme, user, ``www.``, default port, fragment,
    trailing slash or tracking parameter.  Null for null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:80|:443)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _headers(block: Column) -> Column:
    """Names (lower case) to values of a header block; repeated names are joined by commas."""
    lines = F.filter(F.split(block, BREAK), lambda x: x.rlike("^[^:]+:"))
    found = F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("value")))

    def by_name(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(
            F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), ", ")))

    # the lines are a value of the outer function, so they are split once and not once per name
    return F.transform(F.array(found), by_name)[0]


def parse_records(raw: DataFrame, name: str = "record") -> DataFrame:
    """Records (a header block, an HTTP header block and a body, parted by empty lines) as columns.

    record_id, target_uri, captured (seconds), kind, status, headers, payload.  A part that is not
    there gives nulls; a revisit has no payload.
    """
    gap = BREAK * 2
    text = raw.select(F.col(name).alias("record")).where("record IS NOT NULL")
    head = text.withColumn("head", F.substring_index("record", gap, 1))
    rest = head.withColumn("rest", F.expr(f"substr(record, length(head) + {len(gap) + 1})"))
    http = rest.withColumn("http", F.substring_index("rest", gap, 1)).withColumn("warc", _headers(F.col("head")))
    return http.select(
        F.col("warc")["warc-record-id"].alias("record_id"), F.col("warc")["warc-target-uri"].alias("target_uri"),
        F.unix_timestamp(F.try_to_timestamp(F.col("warc")["warc-date"], F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).alias("captured"),
        F.col("warc")["warc-type"].alias("kind"),
        F.expr("try_cast(nullif(regexp_extract(http, '^HTTP/[0-9.]+ ([0-9]+)', 1), '') AS INT)").alias("status"),
        _headers(F.col("http")).alias("headers"),
        F.when(F.col("warc")["warc-type"] == "response", F.expr(f"substr(rest, length(http) + {len(gap) + 1})")).alias("payload"))


def _agreement(one: Column, other: Column) -> Column:
    """True or False where both sides have the validator, else null."""
    return F.when(one.isNotNull() & other.isNotNull(), one == other)


def sources(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Revisits with canonical_url, source_id and outcome; their other columns but the payload stay.

    Outcomes: ``resolved``, ``unverified`` (no common validator), ``changed`` (a validator differs),
    ``orphan`` (nothing earlier, or no URL or time).  Of records of one time the smaller id is the
    earlier.  An entity tag is compared without its weak mark.
    """
    tag = F.regexp_replace(F.col("headers")["etag"], "^W/", "")
    narrow = records.select(
        "record_id", canonical_url(F.col("target_uri")).alias("canonical_url"), "captured", tag.alias("etag"),
        F.col("headers")["last-modified"].alias("modified"), F.coalesce(F.col("kind") == "response", F.lit(False)).alias("is_full"),
        F.when(F.coalesce(F.col("kind") != "response", F.lit(True)), F.struct("kind", "status", "headers")).alias("own"))
    narrow = narrow.withColumn("span", F.floor(F.col("captured") / span_seconds)).withColumn(
        "held", F.when(F.col("is_full") & F.col("captured").isNotNull(), F.struct("record_id", "etag", "modified")))
    narrow = written(narrow, "narrow")
    spans = narrow.groupBy("canonical_url", "span").agg(
        F.max_by("held", F.when(F.col("held").isNotNull(), F.struct("captured", "record_id"))).alias("latest"))
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "span", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical_url", "span").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("near", F.last("held", ignorenulls=True).over(inside)).where("NOT is_full").join(
        carried, ["canonical_url", "span"], "left")
    checked = placed.withColumn("source", F.coalesce("near", "carried")).withColumn("same", F.array(
        _agreement(F.col("etag"), F.col("source.etag")), _agreement(F.col("modified"), F.col("source.modified"))))
    known = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull() & F.col("source").isNotNull()
    outcome = (F.when(~known, "orphan").when(F.array_contains(F.array_compact("same"), False), "changed")
               .when(F.array_contains(F.array_compact("same"), True), "resolved").otherwise("unverified"))
    return checked.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured", "own.kind", "outcome",
        F.when(F.col("outcome").isin("resolved", "unverified"), F.col("source.record_id")).alias("source_id"), "own.status", "own.headers")


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Every record with its outcome; resolved revisits with the status, headers and body they stand for.

    Records are those of ``parse_records``.  Every kind but ``response`` counts as a revisit; a
    response's outcome is ``full``.  A revisit that is not resolved keeps its own status and headers.
    Ids of responses are taken to be unique.
    """
    full = records.where("kind = 'response'")
    whole = full.select("record_id", canonical_url(F.col("target_uri")).alias("canonical_url"), "captured", "kind",
                        F.lit("full").alias("outcome"), F.lit(None).cast("string").alias("source_id"), "status", "headers", "payload")
    revisits = written(sources(records, span_seconds), "revisits")
    stored = full.select(F.col("record_id").alias("source_id"), F.col("status").alias("full_status"),
                         F.col("headers").alias("full_headers"), "payload")
    updates = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full_headers", lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    resolved = revisits.where("source_id IS NOT NULL").join(stored, "source_id").select(
        "record_id", "canonical_url", "captured", "kind", "outcome", "source_id", F.col("full_status").alias("status"),
        merged.alias("headers"), "payload")
    left = revisits.where("source_id IS NULL").withColumn("payload", F.lit(None).cast("string"))
    return whole.unionByName(resolved).unionByName(left)


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records made of a table of pages (page_id, url, html), one ``record`` text each.

    Three of four pages give a full response at minute ``page_id``; every page gives a revisit at a
    later minute, under another spelling of its URL, every fifth with a tag that has changed.
    """
    base = pages.selectExpr(
        "CAST(page_id AS BIGINT) AS page_id", "coalesce(url, '') AS url", "coalesce(html, '') AS html").withColumn("tag", F.expr("substr(md5(html), 1, 16)"))
    at = "date_format(timestamp_seconds(1700000000 + 60 * ({m})), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    full = base.where("page_id % 4 <> 3").select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), F.expr("'f' || page_id"), F.lit("\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nWARC-Date: "), F.expr(at.format(m="page_id")), F.lit("\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: a\r\nETag: \""),
        "tag", F.lit("\"\r\nCache-Control: max-age=60\r\n\r\n"), "html").alias("record"))
    later = base.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: "), F.expr("'r' || page_id"), F.lit("\r\nWARC-Target-URI: "),
        F.expr("replace(url, 'http://', 'https://') || '#again'"), F.lit("\r\nWARC-Date: "),
        F.expr(at.format(m="page_id + 1000 + 997 * (page_id % 29)")),
        F.lit("\r\n\r\nHTTP/1.1 304 Not Modified\r\nServer: b\r\nETag: W/\""),
        F.expr("CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE tag END"), F.lit("\"\r\nExpires: "), F.expr("'' || page_id"), F.lit("\r\n\r\n")).alias("record"))
    return full.union(later)


def digests(resolved: DataFrame) -> DataFrame:
    """Records with their headers and bodies as digests."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(
        "record_id", "canonical_url", "captured", "kind", "outcome", "source_id", F.col("status").cast("long").alias("status"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"), F.sha2("payload", 256).alias("payload_sha256"),
        F.length("payload").cast("long").alias("payload_chars"))
