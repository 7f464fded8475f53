"""WARC not-modified revisits, resolved by an as-of join to the latest earlier full response of the canonical URL.

Records of a URL are ordered in blocks of time: inside a block the last response is carried along a window, between
blocks the last response of each block is carried over the list of blocks. So a URL with very many captures is spread
over as many windows as it has blocks. The revisit's validators are checked against the response it meets: entity tags
by weak comparison, dates where there is no tag. On a match the stored headers are updated with those that a 304
may change (RFC 9110, 15.4.5, and RFC 9111, 3.2) and the stored payload is attached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline.llm import kit

BLOCK_ROWS = 200_000
# fixed values: headers that a 304 may update, and query parameters that do not name a resource
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "vary", "warning")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slashes, other parameters sorted.

    Scheme, fragment and tracking parameters are dropped. Null gives the empty string.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    names = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(names) > 0, F.concat(F.lit("?"), F.concat_ws("&", names))).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^\s*W/", "")


def merged(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the revisit."""
    fresh = F.map_filter(update, lambda k, v: k.isin(*UPDATED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve(records: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for every revisit: ``record_id``, ``canonical_url``, ``ts``, ``outcome``, ``ref_id``, ``headers``, ``payload``.

    ``records`` has ``record_id``, ``kind`` ('response', 'revisit'; others are passed over), ``url``, ``ts`` (long), ``status``,
    ``headers`` (map, lower-case names) and ``payload``. A full response has status 200. "Earlier" is strictly so; of
    responses at one time the largest id counts, then the largest tag, date and payload digest. Outcomes: ``resolved``,
    ``no_earlier_response``, ``no_validator`` (the revisit names neither tag nor date), ``validator_mismatch``. Only resolved
    revisits get a payload and the stored headers; the others keep their own. Every revisit gives one row, whether its id is
    repeated or null; a null id sorts first. Records without an address have no earlier response. Null headers read as
    none; a null time is before all others; an empty table gives no rows.
    """
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    digest = F.coalesce(F.md5(F.col("payload").cast("binary")), F.lit("-"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical(F.col("url")).alias("canonical_url"), F.coalesce("ts", F.lit(-(1 << 62))).alias("_ts"), "ts",
        F.coalesce(full, F.lit(False)).alias("_is_full"), entries.alias("_own"), F.when(full, digest).alias("_digest"))
    lo, hi, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // max(1, -(-n // block_rows))))
    named = rows.withColumn("_tag", _tag(F.map_from_entries("_own"))).withColumn("_date", F.map_from_entries("_own")["last-modified"])
    facts = F.struct("_ts", "record_id", F.col("_tag").alias("tag"), F.col("_date").alias("date"), F.col("_digest").alias("digest"), F.col("_own").alias("stored"))
    slim = named.where("canonical_url <> ''").select(
        "canonical_url", "_ts", "ts", "record_id", "kind", F.floor((F.col("_ts") - (lo or 0)) / width).alias("_block"),
        F.when(F.col("_is_full"), facts).alias("_full"), "_tag", "_date", "_own")
    carry = slim.groupBy("canonical_url", "_block").agg(F.max("_full").alias("_last"))
    before = Window.partitionBy("canonical_url").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("canonical_url", "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("canonical_url", "_block").orderBy("_ts", F.col("_full").isNotNull(), "_full").rowsBetween(Window.unboundedPreceding, 0)
    local = slim.withColumn("_seen", F.last("_full", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    met = local.join(carry, ["canonical_url", "_block"]).withColumn("_met", F.coalesce("_seen", "_carried"))
    has = F.col("_tag").isNotNull() | F.col("_date").isNotNull()
    agrees = F.when(F.col("_tag").isNotNull(), F.col("_tag").eqNullSafe(F.col("_met.tag"))).otherwise(F.col("_date").eqNullSafe(F.col("_met.date")))
    outcome = (F.when(F.col("_met").isNull(), "no_earlier_response").when(~has, "no_validator").when(agrees, "resolved").otherwise("validator_mismatch"))
    judged = met.select("record_id", "canonical_url", "ts", outcome.alias("outcome"), F.col("_met.record_id").alias("ref_id"),
                        F.col("_met.digest").alias("_digest"), F.col("_met.stored").alias("_stored"), "_own")
    homeless = named.where("canonical_url = '' and kind = 'revisit'").select(
        "record_id", "canonical_url", "ts", F.lit("no_earlier_response").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("ref_id"),
        F.lit(None).cast("string").alias("_digest"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_stored"), "_own")
    judged = kit.materialize(judged.unionByName(homeless), "warc-judged")
    # a payload is known by its digest and the response's id; one that very many revisits meet is joined apart
    key = [F.coalesce(F.col("_ref").cast("string"), F.lit("")).alias("_id"), "_digest"]
    hits = judged.where("outcome = 'resolved'").withColumn("_ref", F.col("ref_id")).select("*", key[0]).drop("_ref")
    counts = hits.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_revisits"))
    payloads = records.where(full).withColumn("_ref", F.col("record_id")).select(key[0], digest.alias("_digest"), "payload")
    payloads = payloads.join(counts, ["_id", "_digest"]).groupBy("_id", "_digest", "_revisits").agg(F.any_value("payload").alias("payload"))
    done = kit.join_hot(hits, payloads, ["_id", "_digest"], "_revisits", n).select(
        "record_id", "canonical_url", "ts", "outcome", "ref_id", merged(F.map_from_entries("_stored"), F.map_from_entries("_own")).alias("headers"), "payload")
    rest = judged.where("outcome <> 'resolved'").select(
        "record_id", "canonical_url", "ts", "outcome", "ref_id", F.map_from_entries("_own").alias("headers"), F.lit(None).cast("string").alias("payload"))
    return done.unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """Two records for every page: its full response, and a later revisit by some form of the same address.

    Validators of the revisit, by the digest of the id: the page's tag, the same as a weak tag, its date, an outdated tag or none.
    """
    m = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    byte = lambda i: F.conv(F.substring(m, i, 2), 16, 10).cast("int")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 60).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"),
                     F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), (F.col("page_id") * 60).cast("string")).alias("headers"),
        F.coalesce("html", F.lit("")).alias("payload"))
    kind = byte(1) % 5
    later = F.col("page_id") * 60 + 30 + 3600 * (byte(3) % 8)
    form = byte(5) % 3
    address = F.when(form == 1, F.concat("url", F.lit("#part"))).when(form == 2, F.regexp_replace("url", "^https://", "http://")).otherwise(F.col("url"))
    own = F.map_filter(F.create_map(
        F.lit("etag"), F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 3, F.lit('"old"')),
        F.lit("last-modified"), F.when(kind == 2, date), F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"),
        F.lit("cache-control"), F.lit("max-age=3600")), lambda k, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), address.alias("url"), later.alias("ts"),
                           F.lit(304).alias("status"), own.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of all pages, its headers as sorted lines and its payload as digest and length.

    Without a reference ``ref_id`` and ``payload_chars`` are -1 and the digest is empty.
    """
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolve(captures(kit.table(spark, sf_dir, "pages"))).select(
        "record_id", "canonical_url", "ts", "outcome", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.concat_ws("\n", lines).alias("headers"),
        F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), F.lit("")).alias("payload_sha256"),
        F.coalesce(F.length("payload"), F.lit(-1)).cast("long").alias("payload_chars"))


QUERIES = {"op6_warc_revisits": op6_warc_revisits}
ORACLES = {"op6_warc_revisits": r"""
with p as (
  select page_id, url, coalesce(html, '') as html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag, 'day ' || (page_id % 97) as day,
         ('0x' || substr(md5(cast(page_id as varchar)), 1, 2))::int as b1, ('0x' || substr(md5(cast(page_id as varchar)), 3, 2))::int as b2,
         ('0x' || substr(md5(cast(page_id as varchar)), 5, 2))::int as b3 from pages),
v as (
  select page_id, page_id * 60 + 30 + 3600 * (b2 % 8) as ts, b1 % 5 as kind, tag, day,
         case b3 % 3 when 1 then url || '#part' when 2 then regexp_replace(url, '^https://', 'http://') else url end as url from p),
u as (
  select page_id, 0 as visit, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as rest from p
  union all
  select page_id, 1, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') from v),
q as (
  select page_id, visit, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as place,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) as names from u),
c as (select page_id, visit, place || case when len(names) > 0 then '?' || array_to_string(names, '&') else '' end as canonical_url from q),
r as (select c.canonical_url, p.page_id, p.page_id * 60 as ts, p.tag, p.day, p.html from p join c using (page_id) where c.visit = 0),
m as (
  select v.page_id, c.canonical_url, v.ts, v.kind, v.tag, v.day, max(r.page_id) as ref
  from v join c on c.page_id = v.page_id and c.visit = 1 left join r on r.canonical_url = c.canonical_url and r.ts < v.ts
  group by all),
j as (
  select m.*, r.tag as rtag, r.day as rday, r.html,
         case when ref is null then 'no_earlier_response' when kind = 4 then 'no_validator'
              when (kind in (0, 1) and m.tag = r.tag) or (kind = 2 and m.day = r.day) then 'resolved' else 'validator_mismatch' end as outcome
  from m left join r on r.page_id = m.ref)
select page_id * 2 + 1 as record_id, canonical_url, ts, outcome, coalesce(ref * 2, -1) as ref_id,
  case when outcome = 'resolved' then
    'cache-control: max-age=3600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
      || 'etag: ' || (case kind when 1 then 'W/' || tag when 0 then tag else rtag end) || chr(10) || 'last-modified: ' || rday
  else 'cache-control: max-age=3600' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts
      || case kind when 0 then chr(10) || 'etag: ' || tag when 1 then chr(10) || 'etag: W/' || tag when 2 then chr(10) || 'last-modified: ' || day
                   when 3 then chr(10) || 'etag: "old"' else '' end end as headers,
  case when outcome = 'resolved' then sha256(html) else '' end as payload_sha256, case when outcome = 'resolved' then length(html) else -1 end as payload_chars
from j
"""}
