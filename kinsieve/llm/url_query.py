"""The URL filter's query: captures of ``pages`` against a dated list derived from their hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .urls import filter_captures, host_of

START = "2024-01-01"


def captures(pages: DataFrame) -> DataFrame:
    """A page's fetch time: a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated entries: some hosts, domains and paths, by a hash of the host, are added on one day, removed on another and added again."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("host"), k, 4), 16, 10).cast("bigint")
    hosts = hosts.select("host", digit(1).alias("a"), digit(5).alias("b"), digit(9).alias("c"))
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")  # three labels at most
    kind = F.when(F.col("a") % 4 == 0, "domain").when(F.col("a") % 4 == 1, "path").otherwise("host")
    pattern = F.when(kind == "domain", domain).when(kind == "path", F.concat("host", F.lit("/en"))).otherwise(F.col("host"))
    category = F.when(F.col("b") % 3 == 0, "spam").when(F.col("b") % 3 == 1, "adult").otherwise("malware")
    first = F.col("b") % 200
    days = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), (first + 20 + F.col("c") % 60).alias("day")),
        F.struct(F.lit("add").alias("action"), (first + 100 + F.col("c") % 60).alias("day")),
    )
    rows = hosts.where("a % 8 < 6").select(kind.alias("kind"), pattern.alias("pattern"), category.alias("category"), F.explode(days).alias("d"))
    return rows.select("kind", "pattern", "category", "d.action", F.date_add(F.lit(START).cast("date"), F.col("d.day").cast("int")).alias("dated"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the entries active when it was fetched; a null URL, or one without a host, is matched by none and stays."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    got = filter_captures(captures(pages), list_events(pages))
    return got.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "category", "pattern", "blocked")


SQL = """
with cap as (
  select page_id, url, date '2024-01-01' + cast((page_id * 37) % 366 as int) as fetched,
    nullif(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.+$', ''), '') as host,
    regexp_extract(url, '^[^:/?#]+://[^/?#]*/([^/?#]*)', 1) as segment
  from pages
), h as (
  select distinct host, cast('0x' || substr(md5(host), 1, 4) as bigint) a, cast('0x' || substr(md5(host), 5, 4) as bigint) b,
    cast('0x' || substr(md5(host), 9, 4) as bigint) c
  from cap where host is not null
), e0 as (
  select case a % 4 when 0 then 'domain' when 1 then 'path' else 'host' end kind,
    case a % 4 when 0 then array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') when 1 then host || '/en' else host end pattern,
    case b % 3 when 0 then 'spam' when 1 then 'adult' else 'malware' end category, b % 200 as d, c % 60 as x
  from h where a % 8 < 6
), ev as (
  select kind, pattern, category, 1 as turn, d as day from e0
  union all select kind, pattern, category, 0, d + 20 + x from e0
  union all select kind, pattern, category, 1, d + 100 + x from e0
), per_day as (
  select kind, pattern, category, date '2024-01-01' + cast(day as int) as dated, min(turn) as turn from ev group by all
), chg as (
  select *, coalesce(lag(turn) over (partition by kind, pattern, category order by dated), 0) as was from per_day
), iv as (
  select kind, pattern, category, turn, dated as valid_from, lead(dated) over (partition by kind, pattern, category order by dated) as valid_to
  from chg where turn <> was
), hit as (
  select page_id, iv.* from cap join iv on iv.turn = 1 and fetched >= valid_from and (valid_to is null or fetched < valid_to)
    and case kind when 'host' then host = pattern when 'domain' then host = pattern or ends_with(host, '.' || pattern)
      else host || '/' || segment = pattern end
), best as (
  select page_id, count(*) as n_active,
    first(category order by -length(pattern), kind, pattern, category) as category, first(pattern order by -length(pattern), kind, pattern, category) as pattern
  from hit group by page_id
)
select cap.page_id, host, strftime(fetched, '%Y-%m-%d') as fetched, coalesce(n_active, 0) as n_active, category, pattern, coalesce(n_active, 0) > 0 as blocked
from cap left join best using (page_id)
"""
