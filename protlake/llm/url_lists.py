"""URL filtering against dated lists, by an as-of join.

A list is a log of dated entries: a key (host or URL prefix) is put on the list with a verdict, or taken off. Per list and key
the log becomes validity intervals [dated, next entry), and a capture is held against the intervals that cover its fetch time. A URL's keys are
its host with all parent domains, and its host with every leading path: a number bounded by the URL, so the join is an equi-join on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and closing dots; '' if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment; '' if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``key``, ``verdict``, ``since``, ``until`` from entries ``list``, ``key``, ``action`` (add or remove), ``verdict``, ``dated``.

    A later entry of the same list and key ends the earlier one; without one the interval is open (null ``until``). Of entries with the same date,
    a removal counts last, then the verdict later in the alphabet. Rows with a null key or date are no entries; keys compare in lower case.
    """
    usable = entries.filter("key is not null and dated is not null and action in ('add', 'remove')").select(
        F.col("list"), F.lower("key").alias("key"), "action", "verdict", "dated").distinct()
    order = Window.partitionBy("list", "key").orderBy("dated", F.col("action") == "remove", "verdict")
    timed = usable.withColumn("until", F.lead("dated").over(order))
    return timed.filter("action = 'add' and (until is null or until > dated)").select("list", "key", "verdict", F.col("dated").alias("since"), "until")


def url_keys(host: Column, path: Column) -> Column:
    """Keys of a URL: '.'-parents of its host down to the top-level domain, and host + leading path segments."""
    labels, parts = F.split(host, r"\."), F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).when(path.rlike("[^/]"), F.array_distinct(F.concat(hosts, paths))).otherwise(hosts)


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (``page_id``, ``url``, ``fetched``) with the verdict of the lists at its fetch time.

    Adds ``host``, ``verdict`` ('block', 'allow' or null), ``matched`` (the key that decided) and ``active_entries`` (entries that matched). The longest matching key decides;
    of equal keys on several lists, 'block' does. A null URL, one without a host, or a null fetch time matches nothing. Equal captures are judged together and come back
    as often as they came; other columns are not read.
    """
    distinct = captures.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("times"))
    plain = distinct.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    keyed = plain.withColumn("key", F.explode_outer(url_keys(F.col("host"), F.coalesce(path_of(F.col("url")), F.lit("")))))
    spans = intervals(entries)
    hits = keyed.join(spans, (keyed["key"] == spans["key"]) & (spans["since"] <= keyed["fetched"]) & (spans["until"].isNull() | (keyed["fetched"] < spans["until"])), "left")
    best = F.max(F.when(spans["key"].isNotNull(), F.struct(F.length(spans["key"]).alias("n"), spans["key"].alias("key"), spans["verdict"].alias("verdict"))))
    out = hits.groupBy("page_id", "url", "fetched", "times", "host").agg(best.alias("best"), F.count(spans["key"]).alias("active_entries"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select("page_id", "url", "fetched", "host", F.col("best.verdict").alias("verdict"), F.col("best.key").alias("matched"), "active_entries"))
