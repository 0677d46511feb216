"""Not-modified revisits of a crawl, resolved to the response that they confirm.

A record is ``record_id, url, ts, status, headers map<string, string>, body``. A record with status 304
takes its body and headers from the latest full response (status 200 with a body) of the same
canonical URL before it, if the validators agree: the entity tags (compared weakly) where both have
one, else the modification dates. Only ``PERMITTED`` headers of the revisit replace those of the
response.

The as-of join sorts slim rows by range of (URL, time), so a URL with a third of all records spreads
over tasks. A window looks back inside a task; URLs that span tasks, at most one per task border,
get the last response of earlier tasks from a small table. Bodies are joined at the end by ``row``, a key made
of all that a record says, so records that share an id and differ in URL, time or content stay apart.

Defined cases: a record without URL or time is neither resolved nor used; a response at the very
time of a revisit is not earlier; of responses at one time the largest record_id is the latest, of equal
ids the one with the longest body, then with the largest entity tag; a revisit without validators, or whose response has none in common, stays
unresolved; records that repeat an id, null too, are records each by itself; a header without a value is
absent; an empty table gives no rows; other columns of the records are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import stored

# The headers of a 304 response that update a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# End of fixed values.


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, query without
    tracking parameters and in order; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.concat_ws("&", F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"),
                                                   lambda p: (p != "") & ~p.startswith("utm_"))))
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last counts."""
    return F.map_from_entries(F.transform(
        F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k))),
        lambda k: F.struct(k.alias("key"), F.element_at(F.map_values(F.map_filter(headers, lambda name, _: F.lower(name) == k)), -1).alias("value"))))


def _confirms(revisit: Column, response: Column) -> Column:
    def tag(x: Column) -> Column:
        return F.regexp_replace(x["etag"], "^W/", "")
    dates = revisit["modified"] == response["modified"]
    return F.coalesce(F.when(revisit["etag"].isNotNull() & response["etag"].isNotNull(), tag(revisit) == tag(response)).otherwise(dates), F.lit(False))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, url_key, ts, status, headers, body, source_id, outcome``, a row for each record.

    ``outcome`` is ``kept`` (no revisit), ``resolved``, ``no response`` or ``changed``; only a resolved
    revisit gets status 200, a body and merged headers.
    """
    known = (records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "status",
                            _lower_names(F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())).alias("headers"), "body")
             .withColumn("full", F.coalesce((F.col("status") == 200) & F.col("body").isNotNull(), F.lit(False)))
             .withColumn("row", F.struct("record_id", F.xxhash64("url_key", "ts", "status", F.map_entries("headers"), "body").alias("rest"))))
    marks = F.struct("row", F.try_element_at("headers", F.lit("etag")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("modified"))
    slim = (known.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull() & (F.col("full") | (F.col("status") == 304)))
            .select("row.record_id", F.octet_length("body").alias("size"), "row", "url_key", "ts", "full", marks.alias("marks")))
    order = ["ts", "full", "record_id", "size", "marks.etag", "row"]
    placed = stored(slim.repartitionByRange("url_key", *order).withColumn("task", F.spark_partition_id()), "warc-events")
    response = F.when(F.col("full"), F.col("marks"))
    back = Window.partitionBy("task", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("url_key", "task").agg(F.max_by(response, F.when(F.col("full"), F.struct(*[c for c in order if c != "full"]))).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).where("carried is not null").select("url_key", "task", "carried")
    found = (placed.withColumn("inside", F.last(response, ignorenulls=True).over(back)).where("not full")
             .join(carried, ["url_key", "task"], "left").withColumn("source", F.coalesce("inside", "carried"))
             .select("row", F.col("source.row").alias("source"), _confirms(F.col("marks"), F.col("source")).alias("confirmed")).distinct())
    plain = known.where(~F.coalesce(F.col("status") == 304, F.lit(False))).select(
        "record_id", "url_key", "ts", "status", "headers", "body", F.lit(None).cast("long").alias("source_id"), F.lit("kept").alias("outcome"))
    sources = known.where("full").select(F.col("row").alias("source"), F.col("headers").alias("old"), F.col("body").alias("old_body")).dropDuplicates(["source"])
    outcome = F.when(F.col("confirmed"), "resolved").when(F.col("source").isNull(), "no response").otherwise("changed")
    new = F.map_filter("headers", lambda name, _: name.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda name, _: ~F.map_contains_key(new, name)), new)
    done = F.coalesce(F.col("confirmed"), F.lit(False))
    judged = known.where("status = 304").join(found, "row", "left").withColumn("outcome", outcome).withColumn("source_id", F.col("source.record_id"))
    resolved = (judged.where(done).join(sources, "source")
                .select("record_id", "url_key", "ts", F.lit(200).alias("status"), merged.alias("headers"), F.col("old_body").alias("body"), "source_id", "outcome"))
    return plain.unionByName(resolved).unionByName(judged.where(~done).select(*plain.columns))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of the pages: each page answers once, and is asked again before and after.

    The later visit names the URL in another spelling and carries, by page_id mod 4, the entity tag in
    weak form, the tag as it was, the tag of another version, or the modification date alone.
    """
    at, tag = F.col("page_id") * 3600, F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    kind = F.pmod("page_id", F.lit(4))

    def record(offset: int, url: Column, ts: Column, status: int, headers: list[Column], body: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + offset).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"),
                        F.create_map(*headers).alias("headers"), body.alias("body"))

    sent = [F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), at.cast("string")]
    asked = [F.lit("etag"), F.when(kind == 0, F.concat(F.lit("W/"), tag)).when(kind == 1, tag).when(kind == 2, F.lit('"other"')),
             F.lit("last-modified"), F.when(kind == 3, day), F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), (at + 5400).cast("string")]
    spelled = F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#later"))
    none = F.lit(None).cast("string")
    return pages.select(F.explode(F.array(
        record(0, F.col("url"), at, 200, sent, F.col("html")), record(1, F.regexp_replace(spelled, "^http:", "HTTPS:"), at + 5400, 304, asked, none),
        record(2, F.col("url"), at - 1800, 304, asked, none))).alias("r")).select("r.*")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """:func:`resolve_revisits` of :func:`captures`, with headers as text and bodies as digests."""
    text = F.concat_ws(";", F.array_sort(F.transform(F.map_entries(F.map_filter("headers", lambda _, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    return resolve_revisits(captures(pages)).select(
        "record_id", "url_key", "ts", "status", "source_id", "outcome", text.alias("headers"),
        F.octet_length("body").cast("long").alias("body_bytes"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


ORACLE = r"""
with c as (
  select *, page_id * 3600 as_at, '"' || md5(coalesce(html, '')) || '"' tag, 'day ' || page_id as day_text, ((page_id % 4) + 4) % 4 kind,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') bare from pages),
k as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as front,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))), '&') as q from c),
u as (select *, front || case when q <> '' then '?' || q else '' end as url_key from k),
responses as (
  select page_id * 4 record_id, url_key, as_at ts, tag, day_text, html from u),
bodies as (select distinct * from responses where html is not null),
visits as (
  select page_id * 4 + 1 record_id, url_key, as_at + 5400 ts, u.* exclude (url_key) from u
  union all select page_id * 4 + 2, url_key, as_at - 1800, u.* exclude (url_key) from u),
earlier as (
  select v.url_key, v.ts, max(struct_pack(ts := r.ts, id := r.record_id, size := strlen(r.html), tag := r.tag)) s
  from (select distinct url_key, ts from visits) v join bodies r on v.url_key = r.url_key and r.ts < v.ts group by 1, 2),
judged as (
  select v.*, r.record_id source_id, r.tag old_tag, r.day_text old_day, r.html old_html, r.ts old_ts,
    case when kind < 3 then coalesce(case when kind < 2 then v.tag else '"other"' end = r.tag, false) else coalesce(v.day_text = r.day_text, false) end ok
  from visits v left join earlier e using (url_key, ts)
    left join bodies r on r.url_key = e.url_key and r.record_id = e.s.id and r.ts = e.s.ts and r.tag = e.s.tag)
select record_id, url_key, ts, 200 status, cast(null as bigint) source_id, 'kept' outcome,
  'cache-control=max-age=60;content-type=text/html;date=' || ts || ';etag=' || tag || ';last-modified=' || day_text headers,
  strlen(html) body_bytes, md5(html) body_md5 from responses
union all
select record_id, url_key, ts, case when ok then 200 else 304 end, source_id,
  case when ok then 'resolved' when source_id is null then 'no response' else 'changed' end,
  case when ok then 'cache-control=max-age=600;content-type=text/html;date=' || (as_at + 5400) || ';etag='
         || case kind when 0 then 'W/' || tag when 1 then tag else old_tag end || ';last-modified=' || old_day
       else 'cache-control=max-age=600;content-type=text/plain;date=' || (as_at + 5400)
         || case kind when 0 then ';etag=W/' || tag when 1 then ';etag=' || tag when 2 then ';etag="other"' else ';last-modified=' || day_text end end,
  case when ok then strlen(old_html) end, case when ok then md5(old_html) end
from judged
"""
