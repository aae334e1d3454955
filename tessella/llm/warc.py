"""Resolution of not-modified revisit records in web archives.

A revisit (HTTP 304) is given the payload of the latest earlier full response
(HTTP 200) of the same canonical URL, if its validators agree, and the stored
headers updated with those that a 304 may update. The as-of step is one window
over slim rows (ids, times and validators); payloads are joined afterwards for
resolved revisits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a stored response that a 304 must leave alone.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")

RECORD_COLUMNS = ("record_id", "record_type", "target_uri", "ts", "status", "etag", "last_modified", "headers", "payload")


def canonical_url(url: Column | str) -> Column:
    """Host in lower case without www. or m. and default ports, path without its last slash, query sorted and without utm_ parts; no scheme, no fragment. Null stays null."""
    u = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.regexp_replace(F.trim(u), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    front = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(front, "^([^/]*)", 1)), r"^(www|m)\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(front, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def strong(etag: Column) -> Column:
    """An entity tag without its weakness mark, for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_uri, ts, outcome, base_record_id, base_ts, headers, payload.

    records has RECORD_COLUMNS; others are ignored. outcome is
    no_base (no earlier full response), unverified (the two share no kind of
    validator), mismatch, or resolved; only resolved rows have headers and
    payload. Entity tags are compared weakly and, where both have one, decide
    alone; otherwise equal last_modified is needed. Earlier means a smaller ts; of
    several responses at one ts the greatest record_id counts. Repeated response
    rows (one record_id) count once. A null target_uri or ts never resolves
    (no_base); headers that are null are empty; header names are compared in
    lower case.
    """
    kind = F.when(F.col("record_type") == "revisit", 0).when((F.col("record_type") == "response") & (F.col("status") == 200), 1)
    slim = records.select(
        F.col("record_id").cast("bigint").alias("record_id"), kind.alias("kind"), canonical_url("target_uri").alias("canonical_uri"), "ts", strong(F.col("etag")).alias("tag"), "last_modified"
    ).where("kind is not null")
    # A revisit without URL or time cannot meet a response; its own key keeps such rows off one partition.
    usable = F.col("canonical_uri").isNotNull() & F.col("ts").isNotNull()
    slim = slim.where((F.col("kind") == 0) | usable).withColumn("lone", F.when(~usable, F.xxhash64("record_id", "ts", "canonical_uri")))
    w = Window.partitionBy("canonical_uri", "lone").orderBy("ts", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when((F.col("kind") == 1) & usable, F.struct("record_id", "ts", "tag", "last_modified")), ignorenulls=True).over(w)
    asof = slim.withColumn("base", base).where("kind = 0").drop("lone", "kind")
    tags, dates = F.col("tag").isNotNull() & F.col("base.tag").isNotNull(), F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    outcome = (
        F.when(F.col("base").isNull(), "no_base")
        .when(tags, F.when(F.col("tag") == F.col("base.tag"), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("base.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    asof = asof.select("record_id", "canonical_uri", "ts", outcome.alias("outcome"), F.col("base.record_id").alias("base_record_id"), F.col("base.ts").alias("base_ts"))
    return asof


def lower_names(headers: Column) -> Column:
    """A header map as entries with lower-case names, the last of equal names."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(entries, lambda e: e["key"].isNotNull())


def merged_headers(stored: Column, revisit: Column) -> Column:
    """Stored headers with the revisit's permitted ones in their place, as lines "name: value" sorted by name."""
    new = F.filter(lower_names(revisit), lambda e: ~e["key"].isin(*FIXED_HEADERS))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter(lower_names(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.array_join(F.array_sort(F.transform(F.concat(old, new), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


def with_payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """resolve_revisits() rows with the merged headers and the payload of their base.

    Of response rows that share a record_id the one with the least (payload,
    headers) counts, nulls first; of revisit rows that share record_id and ts the
    one with the least headers.
    """
    entries = F.array_sort(F.map_entries(F.col("headers")))
    headers_of = lambda c: F.map_from_entries(F.filter(c, lambda e: e["key"].isNotNull()))
    stored = records.where((F.col("record_type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()).groupBy(F.col("record_id").cast("bigint").alias("b_id")).agg(F.min(F.struct(F.col("payload").alias("p"), entries.alias("h"))).alias("least"))
    stored = stored.select("b_id", headers_of(F.col("least.h")).alias("b_headers"), F.col("least.p").alias("b_payload"))
    own = records.where(F.col("record_type") == "revisit").groupBy(F.col("record_id").cast("bigint").alias("r_id"), F.col("ts").alias("r_ts")).agg(F.min(F.struct(entries.alias("h"))).alias("least")).select("r_id", "r_ts", headers_of(F.col("least.h")).alias("r_headers"))
    wanted = F.when(F.col("outcome") == "resolved", F.col("base_record_id"))
    joined = resolved.join(own, F.col("record_id").eqNullSafe(F.col("r_id")) & F.col("ts").eqNullSafe(F.col("r_ts")), "left").join(stored, wanted == F.col("b_id"), "left")
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("b_headers"), F.col("r_headers")))
    return joined.select("record_id", "canonical_uri", "ts", "outcome", "base_record_id", "base_ts", headers.alias("headers"), F.col("b_payload").alias("payload"))
