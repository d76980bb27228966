"""URL filters as a temporal list join.

Dated list entries (add or remove) become validity intervals; an as-of join
then evaluates every capture against the entries that were active at its fetch
time. A capture asks for its host, for suffixes of it and for path prefixes, of
the lengths that entries have, so the join is on equal keys and never compares
all entries with all URLs, and a URL of any length has few keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import let

#: Intervals that are broadcast; a larger list is joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALT = 16
ENTRIES = "list string, kind string, pattern string, action string, at timestamp"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and last dot; null where there is none."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), ":[0-9]*$", ""), "\\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


class Sizes(NamedTuple):
    """Numbers of labels of domain entries, and of path parts of prefix entries, each once."""

    domain: list[int]
    prefix: list[int]


def sizes_of(valid: DataFrame) -> Sizes:
    """The sizes that occur among intervals(); a few numbers of a whole list."""
    kind, rest = F.substring_index("key", ":", 1), F.regexp_extract("key", "^[a-z]+:(.*)$", 1)
    path = F.regexp_extract(rest, "/(.*)$", 1)
    size = F.when(kind == "domain", F.size(F.split(rest, "\\."))).when(kind == "prefix", F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))))
    found = {}
    for r in valid.select(kind.alias("kind"), size.alias("size")).where("size is not null").distinct().collect():
        found.setdefault(r.kind, []).append(r.size)
    return Sizes(*(sorted(found.get(k, [])) for k in Sizes._fields))


def keys_of(url: Column, sizes: Sizes) -> Column:
    """The keys that list entries of these sizes can have to name this URL."""
    given = lambda ns: F.array(*map(F.lit, ns)).cast("array<int>")

    def make(p: Column) -> Column:
        labels, parts = F.split(p["host"], "\\."), F.filter(F.split(p["path"], "/"), lambda s: s != "")
        domains = let(labels, lambda x: F.transform(F.filter(given(sizes.domain), lambda n: n <= F.size(x)), lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice(x, F.size(x) - n + 1, n), "."))))
        prefixes = let(parts, lambda x: F.transform(F.filter(given(sizes.prefix), lambda n: n <= F.size(x)), lambda n: F.concat(F.lit("prefix:"), p["host"], F.lit("/"), F.array_join(F.slice(x, F.lit(1), n), "/"))))
        return F.when(p["host"].isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), p["host"])), domains, prefixes)).otherwise(F.array().cast("array<string>"))

    return let(F.struct(host_of(url).alias("host"), path_of(url).alias("path")), make)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): an entry holds from its date until the next dated entry of its list and key.

    valid_to is null while nothing follows. Of an add and a remove at the same
    time the remove counts. Rows with a null are ignored, repeated rows count
    once.
    """
    key = F.concat(F.lower("kind"), F.lit(":"), F.regexp_replace(F.lower(F.trim("pattern")), "(?<!^)/+$", ""))
    key = F.when((F.lower("kind") == "prefix") & ~F.trim("pattern").contains("/"), F.concat(F.lower("kind"), F.lit(":"), F.lower(F.trim("pattern")), F.lit("/"))).otherwise(key)
    rows = entries.select("list", key.alias("key"), F.lower("action").alias("action"), F.col("at").cast("timestamp").alias("at")).dropna().where("action in ('add', 'remove')").distinct()
    w = Window.partitionBy("list", "key").orderBy("at", "action")
    return rows.select("list", "key", "action", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to")).where("action = 'add' and (valid_to is null or valid_to > valid_from)").drop("action")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per row of captures (page_id, url, fetched_at): host, blocked, n_lists and matches.

    matches joins list=key of the active entries in ascending order by a comma,
    and is empty where there are none. A null or unreadable URL, or a null
    fetched_at, matches nothing. Repeated captures come back as often as they
    came; empty tables give no rows or no matches. Other columns are not looked
    at.
    """
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    asked = rows.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    valid = intervals(entries)
    asked = asked.select("url", "fetched_at", F.explode(F.array_distinct(keys_of(F.col("url"), sizes_of(valid)))).alias("key"))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    if valid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hits = asked.join(F.broadcast(valid), "key").where(active)
    else:
        used = valid.join(asked.select("key").distinct(), "key", "left_semi")
        salted = used.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = asked.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"]).where(active)
    found = hits.groupBy("url", "fetched_at").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "list", "key"))), ",").alias("matches"), F.countDistinct("list").alias("n_lists"))
    out = rows.join(found, ["url", "fetched_at"], "left")
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("matches", F.lit("")).alias("matches"), F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"), F.col("matches").isNotNull().alias("blocked"))
