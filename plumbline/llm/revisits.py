"""Not-modified revisits of web captures.

A revisit says that a page was found unchanged. It is resolved by an as-of join on the canonical URL to
the latest earlier full response, if the validators of both agree; the headers that a 304 may change are
merged into those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import write_once
from .segments import SEGMENT, segmented

#: Headers of the stored response that a 304 leaves alone, and those of one hop.
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "content-md5", "transfer-encoding", "connection", "keep-alive", "trailer", "te", "upgrade")
#: Query parameters that do not change the page.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m., no scheme, port 80/443, fragment or tracking parameter, other parameters sorted,
    no final slash or .html; null for null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(\.html?|/)$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})=")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def merged(stored: Column, fresh: Column) -> Column:
    """Headers of the response with those of the revisit put over them, where permitted."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    new = F.map_filter(F.coalesce(fresh, none), lambda k, _: ~k.isin(*KEPT))
    old = F.map_filter(F.coalesce(stored, none), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, status, response_id, digest, headers.

    ``records``: record_id, kind (response or revisit), url, at, etag, last_modified, digest, headers (names in lower
    case). The latest response before (at, record_id) counts. status is ``resolved``, ``changed`` (both have an etag or else a date,
    and they differ), ``unproven`` (no validator in common) or ``orphan`` (no earlier response, a null URL or a null
    time); only resolved ones get digest and merged headers. Ties in time go by record_id; repeated revisits are
    resolved each; other kinds and other columns are not read; no rows, no rows.
    """
    cols = ["record_id", "kind", "at", "etag", "last_modified", "digest", "headers"]
    rows = records.where(F.col("kind").isin("response", "revisit")).select(*cols, canonical_url(F.col("url")).alias("url_key"))
    whole = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    lost = rows.where(~whole & (F.col("kind") == "revisit"))
    rows = segmented(rows.where(whole), "url_key", "at", "record_id", "kind", name="captures")
    order = F.struct("at", F.coalesce("record_id", F.lit(-1)).alias("record_id"))
    full = F.when(F.col("kind") == "response", F.struct(order.alias("key"), F.col("record_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"),
                                                       F.col("digest").alias("r_digest"), F.map_entries("headers").alias("r_headers")))
    last = rows.groupBy("url_key", SEGMENT).agg(F.max(full).alias("full"))
    before = Window.partitionBy("url_key").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = write_once(last.select("url_key", SEGMENT, F.max("full").over(before).alias("carried")).where("carried is not null"), "carried")
    inside = Window.partitionBy(SEGMENT, "url_key").orderBy("at", F.coalesce("record_id", F.lit(-1)), "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", F.last(full, ignorenulls=True).over(inside).alias("near")).where("kind = 'revisit'")
    found = near.join(carried, ["url_key", SEGMENT], "left").select("record_id", "url_key", "etag", "last_modified", "headers", F.coalesce("near", "carried").alias("f"))
    found = found.unionByName(lost.select("record_id", "url_key", "etag", "last_modified", "headers").withColumn("f", F.lit(None)))
    etag, date = F.col("etag").isNotNull() & F.col("f.r_etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("f.r_modified").isNotNull()
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.when(etag, weak(F.col("etag")) == weak(F.col("f.r_etag"))).when(date, F.col("last_modified") == F.col("f.r_modified"))
    status = F.when(F.col("f").isNull(), "orphan").when(same.isNull(), "unproven").when(same, "resolved").otherwise("changed")
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "url_key", "status", F.when(F.col("status") != "orphan", F.col("f.response_id")).alias("response_id"), F.when(ok, F.col("f.r_digest")).alias("digest"),
        F.when(ok, merged(F.map_from_entries("f.r_headers"), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records from ``pages``: each page is a response, and one more visit of its address some time later, which found
    it unchanged (most), with another etag (one in seven) or without a validator (one in eleven)."""
    page = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    text = lambda x: F.lit(x)
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("etag", etag)
    response = base.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 10).alias("at"), "etag", F.lit(None).cast("string").alias("last_modified"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.create_map(text("content-type"), text("text/html"), text("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), text("date"), (page * 10).cast("string"), text("etag"), F.col("etag")).alias("headers"))
    when = page * 10 + F.pmod(page * 7919, F.lit(50_000))
    fresh = F.when(page % 11 == 0, F.lit(None).cast("string")).when(page % 7 == 0, F.lit('"other"')).otherwise(F.col("etag"))
    revisit = base.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", when.alias("at"), fresh.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(text("date"), when.cast("string"), text("content-length"), text("0"), text("age"), (page % 60).cast("string")).alias("headers"))
    return response.unionByName(revisit)


def digest(found: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "status", "response_id", "digest", F.array_join(lines, "\n").alias("headers"))
