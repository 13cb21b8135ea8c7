"""WARC: resolution of not-modified revisit records to the full response that they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Header fields that a 304 response may update; all others of the stored response stay.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Host and path in a form that capture variants share.

    Scheme, user, default port, a leading www. or m., the fragment, tracking parameters (utm_*, ref), an index.html or .html ending
    and closing slashes go; ASCII letters of the host are lower case; other parameters stay in their order.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^.*@", ""), upper, lower)
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "(/index)?[.]html?$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "[?](.*)$", 1), "(^|&)(utm_[^=&]*|ref)(=[^&]*)?", ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


_RESPONSE = pa.struct([("id", pa.int64()), ("at", pa.int64()), ("headers", pa.map_(pa.string(), pa.string()))])
_SCANNED = pa.schema([("tail", pa.bool_()), ("part", pa.int32()), ("url", pa.string()), ("record_id", pa.int64()), ("captured_at", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("response", _RESPONSE)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through a sorted partition with the last full response of the current URL in hand; at the end a tail row with it."""
    url, response, part, alone = None, None, None, True
    for batch in batches:
        out: list[tuple] = []
        for part, at_url, record_id, at, full, headers in zip(*(batch.column(c).to_pylist() for c in ("part", "url", "record_id", "captured_at", "full", "headers")), strict=True):
            if at_url != url:
                alone = url is None
                url, response = at_url, None
            if full:
                response = {"id": record_id, "at": at, "headers": headers}
            else:
                out.append((False, part, at_url, record_id, at, headers, response))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCANNED)], schema=_SCANNED)
    if url is not None:
        # record_id 1: the partition holds no other URL, so what comes before may go on through it
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((True, part, url, int(alone), None, None, response), _SCANNED)], schema=_SCANNED)


def _header(headers: str, name: str) -> Column:
    return F.try_element_at(F.col(headers), F.lit(name))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the last counts."""
    entries = F.map_entries(headers)
    unique = F.transform(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"].alias("value")))
    return F.map_from_entries(unique)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row per not-modified revisit: record_id, url, captured_at, response_id, response_at, verdict, merged_headers.

    records: record_id long, target_uri string, captured_at long, record_type ('response' or 'revisit'), status int, headers
    map<string,string>; payloads aren't read. The response is the latest full one (record_type response, status 200) of the same
    canonical URL that comes before in the order of (captured_at, record_id). verdict: 'no_response'; else 'match' or 'mismatch' by
    ETag (weak comparison) if both have one, else by Last-Modified if both have it; else 'no_validator'. merged_headers: the
    stored headers with the permitted fields of the revisit on top, for 'match' and 'no_validator'; otherwise null.

    The as-of join is one range sort by (url, captured_at, record_id) and a scan with one response in hand, so a URL with very many
    captures spreads over partitions. What crosses a partition's border is one response a partition: the driver matches digests of
    URLs, the responses themselves are joined.

    Null target_uri, captured_at or record_id: a revisit is 'no_response', a response is left out; an empty URL is one like any other.
    Null headers count as none, lists of any length are merged whole.
    Repeated rows keep a row each. An empty table gives no rows; other columns are ignored.
    """
    headers = F.coalesce(_lower_keys(F.col("headers")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = records.select(
        canonical_url(F.col("target_uri")).alias("url"), F.col("captured_at").cast("long").alias("captured_at"), F.col("record_id").cast("long").alias("record_id"),
        ((F.col("record_type") == "response") & (F.col("status") == 200)).alias("full"), (F.col("record_type") == "revisit").alias("revisit"), headers.alias("headers"),
    ).where("full or revisit").withColumn("full", F.coalesce("full", F.lit(False)))
    usable = F.col("url").isNotNull() & F.col("captured_at").isNotNull() & F.col("record_id").isNotNull()
    order = ["url", "captured_at", "record_id", "full"]
    ranged = rows.where(usable).drop("revisit").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    scanned = stored(ranged.mapInArrow(_scan, "tail boolean, part int, url string, record_id long, captured_at long, headers map<string,string>, response struct<id:long,at:long,headers:map<string,string>>"), "revisits")
    # what the driver sees of each partition's tail: numbers and a digest of its URL, neither the URL nor headers
    tails = scanned.where("tail").select("part", F.md5("url").alias("url_key"), (F.col("record_id") == 1).alias("alone"), F.col("response").isNotNull().alias("full"))
    carried, key, source = [], None, None
    for r in tails.orderBy("part").collect():
        if source is not None:
            carried.append((r["part"], key, source))
        if r["full"] or r["url_key"] != key or not r["alone"]:
            source = r["part"] if r["full"] else None
        key = r["url_key"]
    links = records.sparkSession.createDataFrame(carried, "part int, url_key string, source int")
    last = scanned.where("tail").select(F.col("part").alias("source"), F.col("response").alias("before"))
    before = links.join(last, "source").drop("source")
    # only rows without a response of their own partition look for one; a join by partition and URL, of the kind that Spark finds fit
    open_ = scanned.where("not tail and response is null").withColumn("url_key", F.md5("url")).join(before, ["part", "url_key"], "left")
    columns = ["url", "record_id", "captured_at", "headers", "response"]
    found = scanned.where("not tail and response is not null").select(columns).unionByName(open_.withColumn("response", F.col("before")).select(columns))
    lost = rows.where(~usable & F.col("revisit")).select("url", "record_id", "captured_at", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response"))
    found = found.unionByName(lost)
    found = found.withColumn("old", F.col("response.headers"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tag, tag_old, date, date_old = _header("headers", "etag"), _header("old", "etag"), _header("headers", "last-modified"), _header("old", "last-modified")
    verdict = (
        F.when(F.col("response").isNull(), "no_response")
        .when(tag.isNotNull() & tag_old.isNotNull(), F.when(weak(tag) == weak(tag_old), "match").otherwise("mismatch"))
        .when(date.isNotNull() & date_old.isNotNull(), F.when(date == date_old, "match").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    out = found.withColumn("verdict", verdict)
    return out.select(
        "record_id", "url", "captured_at", F.col("response.id").alias("response_id"), F.col("response.at").alias("response_at"), "verdict",
        F.when(F.col("verdict").isin("match", "no_validator"), merged).alias("merged_headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC records that the pages imply: a full response each and, for pages with an odd first digest digit, up to three revisits.

    All follows from page_id, url and the digest of the HTML: revisits use other spellings of the URL, some lack validators, some
    carry another ETag, and those of pages with a digest that begins with 'f' come before their response.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    page = pages.select("page_id", "url", digest.alias("digest")).withColumn("digit", F.conv(F.substring("digest", 1, 1), 16, 10).cast("int"))
    visits = page.withColumn("visit", F.explode(F.sequence(F.lit(0), F.when(F.col("digit") % 2 == 1, F.floor((F.col("digit") - 1) / 2) % 3 + 1).otherwise(0).cast("int"))))
    full = F.col("visit") == 0
    tag = F.when(full | (F.col("visit") == 1), F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))).when((F.col("visit") == 2) & (F.col("digit") % 3 == 0), F.concat(F.lit('W/"'), F.substring("digest", 3, 16), F.lit('"')))
    fields = {
        "ETag": tag,
        "Last-Modified": F.when(full | (F.col("visit") != 3), F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))),
        "Date": F.concat(F.lit("day "), (F.col("page_id") % 365 + F.col("visit")).cast("string")),
        "Content-Length": F.when(full, F.substring("digest", 1, 4)).otherwise("0"),
        "Cache-Control": F.when(F.col("visit") == 2, "max-age=60"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()))
    suffix = F.when(F.col("visit") == 1, "#part").when(F.col("visit") == 2, F.when(F.instr("url", "?") > 0, "&utm_campaign=x").otherwise("?utm_campaign=x")).otherwise("")
    return visits.select(
        (F.col("page_id") * 4 + F.col("visit")).alias("record_id"), F.when(F.instr("url", "#") > 0, F.col("url")).otherwise(F.concat("url", suffix)).alias("target_uri"),
        (F.col("page_id") * 10 + F.when(F.col("digit") == 15, -F.col("visit")).otherwise(F.col("visit") * 3)).alias("captured_at"),
        F.when(full, "response").otherwise("revisit").alias("record_type"), F.when(full, 200).otherwise(304).alias("status"),
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("headers"),
    )


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url", "captured_at", "response_id", "response_at", "verdict", text.alias("merged_headers"))


OP1_SQL = """
with page as (select page_id, url, md5(coalesce(html, '')) as digest from pages),
page2 as (select *, cast(('0x' || substr(digest, 1, 1)) as int) as digit from page),
visits as (
  select *, unnest(generate_series(0, case when digit % 2 = 1 then ((digit - 1) // 2) % 3 + 1 else 0 end)) as visit from page2),
records as (
  select page_id * 4 + visit as record_id,
    case when contains(url, '#') then url else url || case when visit = 1 then '#part'
      when visit = 2 then case when contains(url, '?') then '&utm_campaign=x' else '?utm_campaign=x' end else '' end end as uri,
    page_id * 10 + case when digit = 15 then -visit else visit * 3 end as captured_at, visit = 0 as is_full,
    case when visit <= 1 then '"' || substr(digest, 1, 16) || '"' when visit = 2 and digit % 3 = 0 then 'W/"' || substr(digest, 3, 16) || '"' end as etag,
    case when visit <> 3 then 'day ' || (page_id % 365) end as modified, 'day ' || (page_id % 365 + visit) as dated,
    case when visit = 0 then substr(digest, 1, 4) else '0' end as content_length, case when visit = 2 then 'max-age=60' end as cache
  from visits),
bare as (select *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from records),
parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^.*@', '')), ':(80|443)$', ''), '^(www|m)[.]', '') as host,
    regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '(/index)?[.]html?$', ''), '/+$', '') as path,
    regexp_replace(regexp_replace(regexp_extract(b, '[?](.*)$', 1), '(^|&)(utm_[^=&]*|ref)(=[^&]*)?', '', 'g'), '^&', '') as query
  from bare),
canon as (select * exclude (b, host, path, query), host || path || case when query <> '' then '?' || query else '' end as url from parts),
joined as (
  select v.*, r.record_id as response_id, r.captured_at as response_at, r.etag as old_tag, r.modified as old_modified, r.content_length as old_length, r.cache as old_cache
  from canon v left join canon r on r.is_full and r.url = v.url and (r.captured_at, r.record_id) < (v.captured_at, v.record_id)
  where not v.is_full
  qualify row_number() over (partition by v.record_id, v.captured_at order by r.captured_at desc nulls last, r.record_id desc) = 1),
judged as (
  select *, case when response_id is null then 'no_response'
    when etag is not null and old_tag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(old_tag, '^W/', '') then 'match' else 'mismatch' end
    when modified is not null and old_modified is not null then case when modified = old_modified then 'match' else 'mismatch' end
    else 'no_validator' end as verdict
  from joined)
select record_id, url, captured_at, response_id, response_at, verdict,
  case when verdict in ('match', 'no_validator') then array_to_string(list_sort(list_filter([
    'cache-control=' || coalesce(cache, old_cache), 'content-length=' || old_length, 'date=' || dated, 'etag=' || coalesce(etag, old_tag), 'last-modified=' || coalesce(modified, old_modified)],
    lambda x: x is not null)), ';') end as merged_headers
from judged
"""
