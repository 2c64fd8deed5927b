"""Filtering captures of URLs by the list entries that were active when they were fetched.

A list is dated: an entry is added and may be removed and added again. The entries become
validity intervals, and an as-of join holds every capture against the intervals that hold
at its fetch time. All of it is DataFrame functions:

* intervals: the events of a pattern in time order, of which only real changes count;
* a capture's keys are its host, its host's parent domains, and its host with the first
  segment of its path. Each distinct (host, segment, time) is joined by key with the intervals
  that hold at its time, and what it meets is added up to one row; captures get that row by
  the same three columns. Keys of a hot host or domain are split by the adaptive skew join, a
  hot host's captures lie apart by segment and time, and no array grows with a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of patterns: a host alone, a domain with all below it, a host with the first segment of a path.
KINDS = ("host", "domain", "path")


def host_of(url: Column) -> Column:
    """Lower-case host of an http or https URL without user, port, query and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def first_segment(url: Column) -> Column:
    """The first segment of the path, as it stands; empty if there is none, null for a null URL."""
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*/([^/?#]*)", 1)


def parents(host: Column) -> Column:
    """A host and all its parent domains, down to the last label."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))


def plain_pattern(kind: Column, pattern: Column) -> Column:
    """A pattern as keys are written: the host in lower case without dots at its ends, a path's first segment as it stands; null if no host is left."""
    host = F.regexp_replace(F.lower(F.substring_index(pattern, "/", 1)), r"^\.+|\.+$", "")
    segment = F.regexp_extract(pattern, r"^[^/]*/([^/?#]*)", 1)
    return F.when(host != "", F.when(kind == "path", F.concat(host, F.lit("/"), segment)).otherwise(host))


def validity_intervals(events: DataFrame) -> DataFrame:
    """``(kind, pattern, category, valid_from, valid_to)`` of ``events(kind, pattern, category, action, dated)``; the last is open (null).

    The action is ``add`` or ``remove``. An entry holds from its day on and no longer on the day of its removal. If an entry is both added
    and removed on one day, the removal counts. Adding what holds and removing what doesn't change nothing. Rows with a null, without a host
    and unknown kinds or actions count for nothing. Patterns are taken as ``plain_pattern`` says; a domain may be one label.
    """
    events = events.select("kind", plain_pattern(F.col("kind"), F.col("pattern")).alias("pattern"), "category", "action", "dated")
    day = events.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("category").isNotNull() & F.col("dated").isNotNull())
    day = day.groupBy("kind", "pattern", "category", "dated").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("kind", "pattern", "category").orderBy("dated")
    change = day.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where(F.col("on") != F.col("was"))
    spans = change.withColumn("valid_to", F.lead("dated").over(w)).where("on")
    return spans.select("kind", "pattern", "category", F.col("dated").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``n_active`` (entries that hold at the fetch time), ``category`` and ``pattern`` of one of them, and ``blocked``.

    The one named is the most specific: the longest pattern, then the first by kind, pattern and category. One row for each row of
    ``captures``. A capture without a host or a fetch time is not blocked, with n_active 0. Columns of these names in ``captures`` are
    replaced. An empty list blocks nothing.
    """
    new = ["host", "n_active", "category", "pattern", "blocked"]
    keep = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c not in new]).alias("row")  # columns of any name
    base = captures.select(keep, host_of(F.col(url_col)).alias("host"), first_segment(F.col(url_col)).alias("_segment"), F.col(time_col).alias("_time"))
    probe = ["host", "_segment", "_time"]
    probes = base.select(*probe).where("host is not null and _time is not null").distinct()
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    own = F.array(key("host", F.col("host")), key("path", F.concat("host", F.lit("/"), "_segment")))
    keys = probes.select(*probe, F.explode(F.concat(own, F.transform(parents(F.col("host")), lambda d: key("domain", d)))).alias("_key")).select(*probe, "_key.kind", "_key.pattern")
    holds = (F.col("valid_from") <= F.col("_time")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    met = keys.join(validity_intervals(events), ["kind", "pattern"]).where(holds)
    best = F.min(F.struct((-F.length("pattern")).alias("rank"), "kind", "pattern", "category"))
    met = met.groupBy(*probe).agg(F.count("*").alias("n_active"), best.alias("_best")).select(*probe, "n_active", F.col("_best.category").alias("category"), F.col("_best.pattern").alias("pattern"))
    out = base.join(met, probe, "left").withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("bigint"))).withColumn("blocked", F.col("n_active") > 0)
    return out.select("row.*", *new)
