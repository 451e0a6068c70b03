"""WARC revisit resolution: an as-of join to the latest earlier full response.

A revisit record (a 304 answer) holds no body.  It is resolved to the latest
full response of the same canonical URL that was captured strictly earlier; of
responses at one time the one with the greatest record_id counts.  The
validators must agree: the entity tag if both have one (weak tags compare by
their value), else the modification time, else the payload digest; without a
common validator the match is not proven.  The merged headers are the
response's, with those a 304 may update (RFC 9110) taken from the revisit.

The as-of join is a window over (canonical URL, time span); a second one, over
the URL's spans, hands each span the last response before it, a row a span, so a
URL that holds a large share of all records is many tasks.  Bodies are not moved.

A null URL or time, or no earlier response, leaves a revisit unresolved; a null
record_id is the smallest.  Repeated records are resolved each.  An empty table
gives no rows.  Other columns of pages or records are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """Scheme, leading www, the scheme's default port, fragment, tracking parameters and a closing slash go; the host is in lower case."""
    u = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(u, "^[^/?]*", 0)), F.regexp_replace(u, "^[^/?]*", "")
    host = F.regexp_replace(host, "^www[0-9]*[.]", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(path, "[?&](utm_[a-z]+|ref)=[^&]*", "")
    path = F.regexp_replace(path, "^([^?&]*)&", "$1?")
    return F.concat(host, F.regexp_replace(path, "/$", ""))


def as_of(records: DataFrame, key: str, at: str, kind: Column, value: Column, tie: str, rows_per_span: int = 200_000) -> DataFrame:
    """Adds ``latest``: the value of the latest row of that kind with the same key and a strictly earlier time."""
    n, low, high = records.agg(F.count("*"), F.min(at).cast("double"), F.max(at).cast("double")).first()
    spans = max(1, n // rows_per_span)
    width = ((high or 0.0) - (low or 0.0)) / spans or 1.0
    span = F.least(F.floor((F.col(at).cast("double") - (low or 0.0)) / width), F.lit(spans - 1)) if spans > 1 else F.lit(0)
    rows = records.withColumn("__span", span).withColumn("__full", kind)
    # at one time, askers come before responses
    order = Window.partitionBy(key, "__span").orderBy(at, "__full", tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__here", F.last(F.when(F.col("__full"), value), ignorenulls=True).over(order))
    if spans > 1:
        # each (key, span) that has rows gets the last value of the spans before it
        ends = rows.groupBy(F.col(key).alias("__key"), F.col("__span").alias("__s")).agg(F.max_by(F.when(F.col("__full"), value), F.when(F.col("__full"), F.struct(at, tie))).alias("__end"))
        past = Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("__key", "__s", F.last("__end", ignorenulls=True).over(past).alias("__past"))
        rows = rows.join(carried, (F.col(key) == F.col("__key")) & (F.col("__span") == F.col("__s")), "left").withColumn("__here", F.coalesce("__here", "__past")).drop("__key", "__s", "__past")
    return rows.withColumnRenamed("__here", "latest").drop("__span", "__full")


def resolve(records: DataFrame) -> DataFrame:
    """The revisits among record_id, url, at, kind ('response' or 'revisit'), etag, last_modified, digest and headers (map), resolved.

    Returns record_id, canonical_url, response_id, status ('resolved',
    'mismatch', 'unproven' or 'no_response'), payload (the response's digest if
    resolved) and headers.
    """
    rows = records.withColumn("canonical_url", canonical(F.col("url")))
    held = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    timed = rows.where("canonical_url is not null and at is not null")
    met = as_of(timed, "canonical_url", "at", F.col("kind") == "response", held, "record_id").where("kind = 'revisit'")
    lost = rows.where("kind = 'revisit' and (canonical_url is null or at is null)").withColumn("latest", F.lit(None).cast(met.schema["latest"].dataType))
    both = met.unionByName(lost.select(met.columns))
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(strong(F.col("etag")) == strong(F.col("latest.etag")), F.col("last_modified") == F.col("latest.last_modified"), F.col("digest") == F.col("latest.digest"))
    status = F.when(F.col("latest").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unproven")
    updates = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(updates), F.lower)
    stay = F.map_filter(F.coalesce("latest.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(names, F.lower(k)))
    done = both.withColumn("status", status)
    return done.select(
        "record_id",
        "canonical_url",
        F.col("latest.record_id").alias("response_id"),
        "status",
        F.when(F.col("status") == "resolved", F.col("latest.digest")).alias("payload"),
        F.when(F.col("status") == "resolved", F.map_concat(stay, updates)).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Each page as WARC records: a full response, and two later revisits.

    The pages table has one capture of each page and no headers, so they follow
    from the page: the entity tag is the body's digest; revisits come under
    another spelling of the URL; every fifth page has changed since (another
    tag), every seventh sends no tag but a modification time.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    p = pages.select("page_id", "url", digest.alias("digest"), (F.col("page_id") * 10).alias("at"))
    tag = F.when(F.col("page_id") % 7 != 0, F.col("digest"))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 11).cast("string"))
    response = p.select((F.col("page_id") * 3).alias("record_id"), "url", "at", F.lit("response").alias("kind"), tag.alias("etag"), modified.alias("last_modified"), "digest", F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.coalesce(tag, F.lit("none")), F.lit("Expires"), F.lit("0")).alias("headers"))
    out = response
    for k in (1, 2):
        changed = (F.col("page_id") + k) % 5 == 0
        new_tag = F.when(F.col("page_id") % 7 != 0, F.when(changed, F.concat(F.lit("new-"), "digest")).otherwise(F.concat(F.lit("W/"), "digest")))
        new_url = F.regexp_replace("url", "^https?://", "https://WWW.") if k == 1 else F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
        out = out.union(p.select((F.col("page_id") * 3 + k).alias("record_id"), new_url.alias("url"), (F.col("at") + 35 * k).alias("at"), F.lit("revisit").alias("kind"), new_tag.alias("etag"), modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("expires"), F.lit(str(k)), F.lit("Content-Length"), F.lit("0")).alias("headers")))
    return out


def report(pages: DataFrame) -> DataFrame:
    """record_id, canonical_url, response_id, status, payload and headers (sorted, as text) of every revisit."""
    done = resolve(captures(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select("record_id", "canonical_url", "response_id", "status", "payload", text.alias("headers"))


ORACLE = r"""
with p as (
  select page_id, url, md5(coalesce(html, '')) as digest, page_id * 10 as tm,
         case when page_id % 7 <> 0 then md5(coalesce(html, '')) end as tag, 'day ' || (page_id % 11) as modified
  from pages),
r as (
  select page_id * 3 as record_id, url, tm, 'response' as kind, tag as etag, modified, digest, 0 as k from p
  union all
  select page_id * 3 + k, case when k = 1 then regexp_replace(url, '^https?://', 'https://WWW.') else regexp_replace(url, '#.*$', '') || '#again' end,
         tm + 35 * k, 'revisit', case when page_id % 7 <> 0 then case when (page_id + k) % 5 = 0 then 'new-' || digest else 'W/' || digest end end, modified, null, k
  from p, (values (1), (2)) t(k)),
u as (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as x from r),
c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?]*')), '^www[0-9]*[.]', ''), case lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) when 'http' then ':80$' when 'https' then ':443$' else '^$' end, '')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[^/?]*', ''), '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g'), '^([^?&]*)&', '\1?'), '/$', '') as canonical_url
  from u),
m as (
  select v.record_id, v.canonical_url, s.record_id as response_id, v.etag, s.etag as old_tag, v.modified, s.modified as old_modified, s.digest, v.k,
         row_number() over (partition by v.record_id order by s.tm desc nulls last, s.record_id desc nulls last) as n
  from c v left join c s on s.kind = 'response' and s.canonical_url = v.canonical_url and s.tm < v.tm
  where v.kind = 'revisit'),
d as (
  select *, case when response_id is null then 'no_response'
                 when coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(old_tag, '^W/', ''), modified = old_modified) then 'resolved'
                 when not coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(old_tag, '^W/', ''), modified = old_modified) then 'mismatch'
                 else 'unproven' end as status
  from m where n = 1)
select record_id, canonical_url, response_id, status, case when status = 'resolved' then digest end as payload,
       case when status = 'resolved' then 'Content-Type=text/html;ETag=' || coalesce(old_tag, 'none') || ';expires=' || k end as headers
from d
"""
