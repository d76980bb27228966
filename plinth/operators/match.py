"""Scored best match of request paths and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What stands for a hole within a part; no URL holds it.
HOLE = "\u0001"


def url_segments(path: Column, prefix: str = "") -> Column:
    """Parts of a path without prefix, query and fragment; `${…}` and `:name` parts count as holes `:`.

    A part that is partly a hole, as `note-${id}`, keeps HOLE in the hole's place.
    """
    bare = F.regexp_replace(F.regexp_replace(path, "\\$\\{[^}]*\\}", HOLE), "[?#].*$", "")
    bare = F.regexp_replace(bare, f"^/?{prefix}(/|$)", "/") if prefix else bare
    return F.transform(F.filter(F.split(bare, "/"), lambda s: s != ""), lambda s: F.when((s == HOLE) | s.startswith(":"), ":").otherwise(s))


def _score(a: Column, b: Column) -> Column:
    """Of a request's part and a route's: equal literals 2, hole and parameter 2, literal and parameter 1, hole and literal 1, else no match.

    A part with a hole in it has 1 with a parameter, and with a literal that it
    fits, of one character or more for each hole.
    """
    fits = F.concat(F.lit("^\\Q"), F.replace(F.replace(a, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(HOLE), F.lit("\\E.+\\Q")), F.lit("\\E$"))
    return F.when((a == ":") & (b == ":"), 2).when((a == ":") | (b == ":"), 1).when(a.contains(HOLE), F.when(F.regexp_like(b, fits), 1)).when(a == b, 2)


#: Parts of a path that join keys are made of; further parts are compared after the join.
KEYED = 5


def _keys(parts: Column, other: Column, hole: Column) -> Column:
    """Join keys of a path: each of its first KEYED parts as it stands, or as the other side may meet it.

    A literal part meets an equal literal, or `other`; a `:` part meets `:`, or
    `hole`, and so does a part with HOLE, whose fit is told after the join. The two sides swap these marks, so that a request and a route that
    fit have exactly one key in common.
    """
    start = F.array(F.size(parts).cast("string"))

    def step(keys: Column, part: Column) -> Column:
        ways = F.when((part == ":") | part.contains(HOLE), F.array(F.lit(":"), hole)).otherwise(F.array(part, other))
        return F.flatten(F.transform(keys, lambda k: F.transform(F.array_compact(ways), lambda w: F.concat(k, F.lit("/"), w))))

    return F.aggregate(F.slice(parts, F.lit(1), F.lit(KEYED)), start, step)


def bridge(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (call_id, verb, parts) with score, n_best, route_id and status.

    Routes (route_id, verb, parts) serve their verb or ALL. Requests and routes
    meet on verb and key, see _keys, so no request is compared with a route
    that its first parts exclude. status: matched by the only best route,
    ambiguous, unmatched, or unread where the call has no verb or path.
    """
    none, star = F.lit(None).cast("string"), F.lit("*")
    asked = calls.where("verb is not null and parts is not null").withColumn("__verb", F.explode(F.array("verb", F.lit("ALL")))).where("not (verb = 'ALL' and __verb <> verb)").distinct().withColumn("__key", F.explode(_keys(F.col("parts"), F.lit(":"), star)))
    served = routes.select("route_id", F.col("verb").alias("__verb"), F.col("parts").alias("__parts")).withColumn("__key", F.explode(_keys(F.col("__parts"), star, none)))
    scores = F.zip_with("parts", "__parts", _score)
    pairs = asked.join(served, ["__verb", "__key"]).withColumn("s", scores).where(~F.exists("s", lambda x: x.isNull()))
    scored = pairs.select("call_id", "route_id", F.aggregate("s", F.lit(0), lambda t, x: t + x).alias("score"))
    best = scored.groupBy("call_id").agg(F.max("score").alias("score"))
    of_best = scored.join(best, ["call_id", "score"]).groupBy("call_id").agg(F.max("score").alias("score"), F.count("*").alias("n_best"), F.min("route_id").alias("first"))
    joined = calls.join(of_best, "call_id", "left").withColumn("n_best", F.coalesce("n_best", F.lit(0)))
    status = F.when(F.col("verb").isNull() | F.col("parts").isNull(), "unread").when(F.col("n_best") == 0, "unmatched").when(F.col("n_best") == 1, "matched").otherwise("ambiguous")
    return joined.select("call_id", "score", "n_best", F.when(F.col("n_best") == 1, F.col("first")).alias("route_id"), status.alias("status"))


def served_or_not(calls: DataFrame, served: DataFrame, unregistered: DataFrame) -> DataFrame:
    """bridge() over served routes, and for calls that match none over unregistered ones: those have status unserved."""
    first = bridge(calls, served)
    lost = calls.join(first.where("status = 'unmatched'").select("call_id"), "call_id", "left_semi")
    second = bridge(lost, unregistered).where("n_best > 0").select("call_id", F.col("route_id").alias("__route"))
    out = first.join(second.withColumn("__found", F.lit(True)), "call_id", "left")
    return out.select("call_id", "score", "n_best", F.coalesce("route_id", "__route").alias("route_id"), F.when(F.col("__found"), "unserved").otherwise(F.col("status")).alias("status"))


def unreached(routes: DataFrame, bridged: DataFrame) -> DataFrame:
    return routes.join(bridged.where("status = 'matched'").select("route_id"), "route_id", "left_anti")


def grip(studs: DataFrame, by_brick: DataFrame, by_route: DataFrame, by_framework: DataFrame, key: str) -> DataFrame:
    """studs with grip: who calls them first of brick, route, framework; unseen if nobody does."""
    out = studs
    for name, held in (("brick", by_brick), ("route", by_route), ("framework", by_framework)):
        out = out.join(held.select(key).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
    kind = F.when(F.col("__brick"), "brick").when(F.col("__route"), "route").when(F.col("__framework"), "framework").otherwise("unseen")
    return out.select(*studs.columns, kind.alias("grip"))


def routed(studs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """studs (path, cls, method) with routes: the sorted `VERB route` of the endpoints (path, cls, handler, verb, route) that they handle, empty if none."""
    held = endpoints.groupBy("path", "cls", F.col("handler").alias("method")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "verb", "route"))).alias("routes"))
    return studs.join(held, ["path", "cls", "method"], "left").withColumn("routes", F.coalesce("routes", F.array().cast("array<string>")))
