"""WARC: resolve not-modified revisits by an as-of join to the latest earlier full response.

Records are keyed by canonical url. A revisit takes the latest response strictly before it; of
responses at one instant the largest record_id counts. Validators are checked: entity tags by weak
comparison if both have one, else last-modified dates if both have one. A resolved revisit's headers
are the response's, overlaid with those that a not-modified reply may change.

A url may hold a third of all records, and an instant too. Responses are first reduced to one for each
(url, instant). Instants are dealt to ranges between quantiles of time; each range's last response is a
grouped maximum, carried over ranges in a window of a few rows, and searched within the range, so no
task holds a url. Revisits themselves are only joined, on (url, instant).

Defined cases: what isn't a url (null, empty, no scheme or no host) has no canonical url, and no revisit to
it resolves; a null time never resolves; null headers count as none; a revisit without an earlier
response is an orphan; without shared validators it is unverified, and merged all the same; on a
mismatch nothing is merged; of responses that tie in instant and record_id the one of the
larger header text counts; repeated rows are resolved one by one; very long urls and headers are
whole values; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Header fields that a not-modified reply carries for the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """https, lower-case host, no default port, fragment, tracking parameters or closing slash; null for no url."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    u = F.regexp_replace(u, "(?<=[?&])(?:utm_[a-z]+|ref)=[^&]*(?:&|$)", "")
    u = F.regexp_replace(u, "[?&]+$", "")
    host = ascii_lower(F.regexp_replace(F.regexp_extract(u, "://([^/?]*)", 1), ":(?:80|443)$", ""))
    rest = F.regexp_replace(F.regexp_extract(u, "://[^/?]*(.*)$", 1), "/+$", "")
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?]"), F.concat(F.lit("https://"), host, rest))


def _range(ts: Column, borders: list[int]) -> Column:
    """How many of the borders, few and ascending, ts has reached."""
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= ts)) if borders else F.lit(0)


def resolve(records: DataFrame, ranges: int = 256) -> DataFrame:
    """Each revisit with its response.

    records: record_id, url, ts (long), kind (response or revisit), headers (map, lower-case names).
    Result: record_id, canonical_url, ts, target_id, target_ts, outcome, headers.
    """
    r = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    placed = r.where("canonical_url is not null and ts is not null")
    quantiles = records.agg(F.percentile_approx("ts", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges))).first()[0]
    full = placed.where("kind = 'response'").groupBy("canonical_url", "ts").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("record_id", header_text(F.col("headers")))).alias("_full"))
    asked = placed.where("kind = 'revisit'").select("canonical_url", "ts").distinct()
    times = asked.withColumn("_asked", F.lit(True)).join(full, ["canonical_url", "ts"], "full").withColumn("_range", _range(F.col("ts"), sorted(set(quantiles or []))))
    near = F.last("_full", ignorenulls=True).over(W.partitionBy("canonical_url", "_range").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    last = times.groupBy("canonical_url", "_range").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.col("ts"))).alias("_last"))
    carried = last.withColumn("_far", F.last("_last", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).select("canonical_url", "_range", "_far")
    found = times.withColumn("_near", near).where("_asked").join(carried, ["canonical_url", "_range"]).select("canonical_url", "ts", F.coalesce("_near", "_far").alias("_t"))
    met = r.where("kind = 'revisit'").join(found, ["canonical_url", "ts"], "left")
    target, own = F.col("_t.headers"), F.col("headers")
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    modified = lambda h: F.try_element_at(h, F.lit("last-modified"))
    same = F.coalesce(tag(target) == tag(own), modified(target) == modified(own))
    outcome = F.when(F.col("_t").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    news = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(target, lambda k, v: ~F.map_contains_key(news, k)), news)
    met = met.withColumn("outcome", outcome)
    return met.select("record_id", "canonical_url", "ts", F.col("_t.record_id").alias("target_id"), F.col("_t.ts").alias("target_ts"), "outcome", F.when(F.col("outcome").isin("resolved", "unverified"), merged).otherwise(own).alias("headers"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records of each page: a response, a revisit after it, and for every fourth page one before it.

    Every fifth page has changed by its revisit, so that its entity tag differs.
    """
    n, tag = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 12), F.lit('"'))
    date = lambda t: F.concat(F.lit("d"), t.cast("string"))
    first, later, before = n * 10, n * 10 + 5, n * 10 - 5
    head = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*kv.values()))
    response = F.struct((n * 4).alias("record_id"), "url", first.alias("ts"), F.lit("response").alias("kind"), head(content_type=F.lit("text/html"), date=date(first), etag=tag, server=F.lit("s1")).alias("headers"))
    new_tag = F.when(n % 5 == 0, F.lit('"new"')).when(n % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = lambda k, t: F.struct((n * 4 + k).alias("record_id"), "url", t.alias("ts"), F.lit("revisit").alias("kind"), head(date=date(t), etag=new_tag, expires=F.concat(F.lit("e"), t.cast("string")), x_cache=F.lit("hit")).alias("headers"))
    each = F.when(n % 4 == 0, F.array(response, revisit(1, later), revisit(2, before))).otherwise(F.array(response, revisit(1, later)))
    return pages.select(F.explode(each).alias("r")).select("r.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", "ts", "target_id", "target_ts", "outcome", header_text(F.col("headers")).alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS n, '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag,
    regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*(&|$)', '\1', 'g'), '[?&]+$', '') AS u
  FROM pages),
q AS (SELECT n, tag, 'https://' || lower(regexp_replace(regexp_extract(u, '://([^/?]*)', 1), ':(80|443)$', '')) || regexp_replace(regexp_extract(u, '://[^/?]*(.*)$', 1), '/+$', '') AS c FROM p),
resp AS (SELECT n * 4 AS id, c, n * 10 AS ts, tag FROM q),
rev AS (
  SELECT n * 4 + 1 AS id, c, n * 10 + 5 AS ts, n, tag FROM q
  UNION ALL SELECT n * 4 + 2, c, n * 10 - 5, n, tag FROM q WHERE n % 4 = 0),
v AS (SELECT id, c, ts, CASE WHEN n % 5 = 0 THEN '"new"' WHEN n % 2 = 0 THEN 'W/' || tag ELSE tag END AS tag FROM rev),
m AS (SELECT v.*, resp.id AS target_id, resp.ts AS target_ts, resp.tag AS target_tag FROM v ASOF LEFT JOIN resp ON v.c = resp.c AND v.ts > resp.ts),
o AS (SELECT *, CASE WHEN target_id IS NULL THEN 'orphan' WHEN regexp_replace(tag, '^W/', '') = target_tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM m)
SELECT id AS record_id, c AS canonical_url, ts, target_id, target_ts, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: d' || ts || chr(10) || 'etag: ' || tag || chr(10) || 'expires: e' || ts || chr(10) || 'server: s1'
  ELSE 'date: d' || ts || chr(10) || 'etag: ' || tag || chr(10) || 'expires: e' || ts || chr(10) || 'x-cache: hit' END AS headers
FROM o
"""
