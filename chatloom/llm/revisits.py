"""Not-modified revisit records of a crawl, resolved to the response they repeat.

A revisit stores no page. It is joined as of its time to the latest earlier full
response of the same canonical address; where its validators agree with that
response, the page is taken from there and the permitted headers of the revisit
replace the stored ones.

The as-of join works on narrow rows. Time is cut into buckets by quantiles; the
last response of each (address, bucket) is found by an aggregate, passed on to
later buckets, and only rows of one address and bucket meet in a window. So an
address with a third of all captures is cut into as many tasks as there are
buckets. Pages move once, by their record number.

Defined cases: a revisit without an earlier response is `unresolved`; one whose
validators contradict the response is `mismatch`, one without any validator in
common is `unverified` (both keep their own headers and have no page); a null
address or time can resolve nothing; captures of one time are ordered by record
number; captures of any other kind, or of none, stay with outcome `full` and resolve
nothing; null headers are an empty map, null values are kept as they are; header
names are compared without case; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import buckets_of, pinned, skewed_join

# Headers that a not-modified answer may update, and query
# parameters that only track the visitor.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

RECORD_COLUMNS = "record_id BIGINT, url STRING, fetched_at BIGINT, kind STRING, headers MAP<STRING, STRING>, page STRING"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, https for http, no default port, www. or
    mobile prefix, fragment, tracking parameter or closing slash; other query
    parameters in sorted order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.filter(query, lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).isin(*TRACKING))
    tail = F.array_join(F.sort_array(kept), "&")
    return F.when(host != "", F.concat(
        F.lit("https://"), host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")
    ))


def low_headers(headers: Column) -> Column:
    """Names in lower case, sorted; of a repeated name the first value stays."""
    entries = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")),
    )
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    first = lambda n: F.struct(n.alias("key"), F.get(F.filter(entries, lambda e: e["key"] == n), 0)["value"].alias("value"))
    return F.map_from_entries(F.transform(F.sort_array(names), first))


def _latest_before(narrow: DataFrame, buckets: int) -> DataFrame:
    """(record_id, address, source_id) of revisits; source_id null if none is earlier.

    ``narrow`` has record_id, address, fetched_at, full.
    """
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    # ``buckets`` - 1 numbers.
    bounds = narrow.agg(F.percentile_approx("fetched_at", shares, 100 * buckets)).first()[0] or []
    limits = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    rows = narrow.filter("address IS NOT NULL AND fetched_at IS NOT NULL").withColumn(
        "_bucket", F.size(F.filter(limits, lambda b: b <= F.col("fetched_at")))
    )
    at = F.struct("fetched_at", "record_id")
    lasts = rows.filter("full").groupBy("address", "_bucket").agg(F.max(at).alias("_at"))
    asked = rows.filter("NOT full").select("address", "_bucket").distinct()
    steps = lasts.unionByName(asked.withColumn("_at", F.lit(None).cast("struct<fetched_at:bigint,record_id:bigint>")))
    steps = steps.groupBy("address", "_bucket").agg(F.max("_at").alias("_at"))
    earlier = Window.partitionBy("address").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.select("address", "_bucket", F.max("_at").over(earlier).alias("_carry"))
    within = Window.partitionBy("address", "_bucket").orderBy("fetched_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.join(carry, ["address", "_bucket"], "left").withColumn(
        "_found", F.coalesce(F.max(F.when(F.col("full"), at)).over(within), F.col("_carry"))
    )
    return here.filter("NOT full").select("record_id", F.col("_found.record_id").alias("source_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """All captures, revisits resolved.

    ``records``: record_id (unique), url, fetched_at, kind (`response` or
    `revisit`), headers, page; further columns stay, but for those of the names
    added: address, source_id, outcome (`full`, `resolved`, `unverified`, `mismatch` or `unresolved`).
    """
    own = ["record_id", "url", "fetched_at", "kind", "headers", "page"]
    added = ["address", "source_id", "outcome"]
    more = [c for c in records.columns if c not in own + added]
    records = records.select(*own, F.struct(F.lit(True).alias("_"), *more).alias("_more"))
    rows = records.withColumns({"address": canonical_url(F.col("url")), "headers": low_headers(F.col("headers"))})
    narrow = pinned(rows.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("bigint").alias("record_id"), "address",
        F.col("fetched_at").cast("bigint").alias("fetched_at"), (F.col("kind") == "response").alias("full"),
    ))
    found = pinned(_latest_before(narrow, buckets_of(records.sparkSession)))
    # A response that answers many revisits is copied once per share of them, so
    # that they need not meet in one task.
    parts = buckets_of(records.sparkSession)
    wanted = found.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("_asked"))
    total = found.count()
    wanted = pinned(wanted.withColumn("_shares", F.ceil(F.col("_asked") * (4 * parts) / F.lit(total + 1)).cast("int")))
    share = F.pmod(F.xxhash64("record_id"), F.col("_shares")).cast("int").alias("_share")
    found = skewed_join(found, wanted, ["source_id"], "_asked").select("record_id", "source_id", share)
    copies = wanted.select("source_id", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    sources = rows.filter(F.col("kind") == "response").select(
        F.col("record_id").alias("source_id"), F.col("headers").alias("_headers"), F.col("page").alias("_page")
    ).join(copies, "source_id")
    fixed = rows.filter(~F.col("kind").eqNullSafe("revisit")).withColumns({
        "source_id": F.lit(None).cast("bigint"), "outcome": F.lit("full"),
    })
    asked = rows.filter(F.col("kind") == "revisit").join(found, "record_id", "left").join(sources, ["source_id", "_share"], "left")
    agree = lambda name: F.col("headers")[name] == F.col("_headers")[name]
    same, other = [], []
    for name in ("etag", "last-modified"):
        same.append(F.coalesce(agree(name), F.lit(False)))
        other.append(F.coalesce(~agree(name), F.lit(False)))
    outcome = (
        F.when(F.col("source_id").isNull(), "unresolved").when(other[0] | (other[1] & ~same[0]), "mismatch")
        .when(same[0] | same[1], "resolved").otherwise("unverified")
    )
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    stays = F.map_filter("_headers", lambda k, v: ~F.array_contains(F.map_keys(F.col("_update")), k))
    merged = F.map_from_entries(F.sort_array(F.concat(F.map_entries(stays), F.map_entries("_update"))))
    done = F.col("outcome") == "resolved"
    asked = asked.withColumn("outcome", outcome).withColumn("_update", update).withColumns({
        "headers": F.when(done, merged).otherwise(F.col("headers")),
        "page": F.when(done, F.col("_page")),
    })
    names = [*rows.columns, "source_id", "outcome"]
    both = fixed.select(*names).unionByName(asked.select(*names))
    return both.select(*own, *added, *[f"_more.{c}" for c in more])
