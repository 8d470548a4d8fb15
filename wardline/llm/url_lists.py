"""Temporal list join: which entries of dated URL lists were active when a page was fetched.

List events (``add`` and ``remove``, dated) become validity intervals: an entry is active from its ``add`` until the next
event of the same list, action and key. A capture looks up the keys of its URL: its host, the domains above it, and its
host with the first parts of its path. The as-of join takes, of each key, the interval that holds at the fetch time.

DataFrame functions only. Both sides carry a period of ``PERIOD`` days in the join key, so that a key with a long history
or with a third of all captures is cut into many small groups; what is still uneven, an inner join, adaptive execution
splits. No more rows than one a capture, key and list come out.

Null URLs, URLs without a host and captures without a fetch time match nothing (verdict ``none``). Events without key, time or
action are left out. Of several events at the same time, ``remove`` comes last. Repeated captures are judged each; repeated events
count once. Extra columns of captures are kept; those named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded

PERIOD = 128
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"
RESULTS = ("verdict", "n_entries", "entry", "listed_since")


def period(time):
    return F.floor(F.unix_timestamp(time) / (PERIOD * 86_400)).cast("long")


def intervals(events: DataFrame) -> DataFrame:
    """list, verdict, key, valid_from and valid_to (null: until now) of every entry's time on a list."""
    clean = events.where("key is not null and at is not null and verdict is not null and event in ('add', 'remove')").select("list", "verdict", F.lower("key").alias("key"), "at", "event").distinct()
    w = Window.partitionBy("list", "verdict", "key").orderBy("at", "event")
    return (
        clean.withColumns({"valid_from": F.col("at"), "valid_to": F.lead("at").over(w)})
        .where("event = 'add' and (valid_to is null or valid_to > valid_from)").select("list", "verdict", "key", "valid_from", "valid_to")
    )


def keys(captures: DataFrame, depth: int, url: str = "url") -> DataFrame:
    """``captures`` with the array ``keys``: host and domains above it, and host with up to ``depth`` parts of the path."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(F.col("_host"), r"\.")
    parts = F.filter(F.slice(F.split(F.regexp_extract(url, PATH, 1), "/"), 1, max(depth, 1)), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.concat(F.col("_host"), F.lit("/"), F.lower(F.array_join(F.slice("_parts", F.lit(1), i), "/"))))
    return (
        captures.withColumn("_host", F.nullif(host, F.lit(""))).withColumn("_parts", parts)
        .withColumn("keys", F.when(F.col("_host").isNull(), F.array().cast("array<string>")).otherwise(F.concat(domains, F.when((F.size("_parts") > 0) & F.lit(depth > 0), paths).otherwise(F.array().cast("array<string>")))))
        .drop("_host", "_parts")
    )


def judge(captures: DataFrame, events: DataFrame, ids: str = "page_id", url: str = "url", time: str = "fetched_at") -> DataFrame:
    """``captures`` with verdict (``allow`` before ``block`` before ``none``), n_entries (active ones that match), entry and
    listed_since (key and start of the longest matching key of that verdict; ties to the smaller list, then the earlier start).
    """
    captures, names = shielded(captures.drop(*RESULTS), {"keys", "_host", "_parts", "_row", "_time", "_period", "_best"} - {ids, url, time})
    held = intervals(events)
    lo, hi, depth = (captures.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).crossJoin(held.agg(F.coalesce(F.max(F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))), F.lit(0)).alias("depth")))).first()
    row = F.struct(F.col(ids), F.xxhash64(*[F.col(c) for c in captures.columns if captures.schema[c].dataType.typeName() in ("string", "long", "integer", "timestamp")]))
    wanted = keys(captures, depth, url).withColumn("_row", row)
    looked = wanted.where(F.col(time).isNotNull()).select("_row", F.col(time).alias("_time"), period(time).alias("_period"), F.explode("keys").alias("key")).distinct()
    spread = held.where((F.col("valid_from") <= F.lit(hi)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(lo)))).withColumn(
        "_period", F.explode(F.sequence(period(F.greatest("valid_from", F.lit(lo))), period(F.least(F.coalesce("valid_to", F.lit(hi)), F.lit(hi)))))
    )
    hit = looked.join(spread, ["key", "_period"]).where((F.col("valid_from") <= F.col("_time")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to"))))
    best = F.min(F.struct((F.col("verdict") != "allow").alias("v"), (-F.length("key")).alias("n"), "key", "list", "valid_from"))
    found = hit.groupBy("_row").agg(F.count("*").alias("n_entries"), best.alias("_best"))
    return wanted.join(found, "_row", "left").select(
        *captures.columns,
        F.when(F.col("_best").isNull(), "none").when(F.col("_best.v"), "block").otherwise("allow").alias("verdict"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.col("_best.key").alias("entry"),
        F.col("_best.valid_from").alias("listed_since"),
    ).withColumnsRenamed(names)


def _number(x):
    return F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int")


def _day(n):
    return F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)


def fetched(pages: DataFrame) -> DataFrame:
    """pages with a fetch time: the table has none, so a day of the year 2024 follows from the page's id."""
    return pages.select("page_id", "url").withColumn("fetched_at", _day(F.pmod(_number(F.col("page_id").cast("string")), F.lit(365))))


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of ``pages``: the tables have none, so hosts, domains and days follow from a hash.

    Hosts are blocked, some are taken off again and some of these put back; the first part of a path is allowed on every second host;
    each domain of two labels is blocked for a part of the year.
    """
    host = F.lower(F.regexp_extract("url", HOST, 1))
    known = pages.select(host.alias("h"), F.lower(F.regexp_extract("url", PATH.replace("([^?#]*)", "([^/?#]*)"), 1)).alias("part")).where("h != ''").distinct().withColumn("n", _number(F.col("h")))
    hosts = known.select("h", "n").distinct()
    domains = hosts.select(F.substring_index("h", ".", -2).alias("h")).distinct().withColumn("n", _number(F.col("h")))
    first = F.pmod("n", F.lit(200))

    def rows(df, key, verdict, event, day, name):
        return df.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), key.alias("key"), _day(day).alias("at"), F.lit(event).alias("event"))

    return (
        rows(hosts, F.col("h"), "block", "add", first, "hosts")
        .unionAll(rows(hosts.where("n % 3 = 0"), F.col("h"), "block", "remove", first + 60 + F.pmod("n", F.lit(50)), "hosts"))
        .unionAll(rows(hosts.where("n % 6 = 0"), F.col("h"), "block", "add", first + 150, "hosts"))
        .unionAll(rows(known.where("n % 2 = 0 and part != ''"), F.concat("h", F.lit("/"), "part"), "allow", "add", F.pmod("n", F.lit(300)), "paths"))
        .unionAll(rows(domains, F.col("h"), "block", "add", F.lit(30) + F.pmod("n", F.lit(100)), "domains"))
        .unionAll(rows(domains, F.col("h"), "block", "remove", F.lit(180) + F.pmod("n", F.lit(100)), "domains"))
    )
