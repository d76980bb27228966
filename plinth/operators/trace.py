"""Traces: the pre-order walk of calls from each start, over the cluster.

A walk visits a node once, by the call that comes first in pre-order, and calls
come in the order of their paths from the start. So the path of a node is the
least of its callers' own paths with the call added. Rounds compute that from
the paths of the round before, for all starts and nodes at once, until a round
changes nothing: a caller that is reached earlier after all takes its node's
path along, and paths that hung on the old one go within as many rounds as a
path is long. A round follows the calls of nodes that moved in the one before
and of no others. No start's graph is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.graph import written

#: Why a walk goes no further, besides depth-cap and body-not-found.
NOT_INJECTED, UNKNOWN_FIELD = "dep-not-injected", "field-unknown"
#: Rows of a round that are broadcast; more are shuffled.
FEW = 1000


def numbered(rows: DataFrame, group: str, *order: Column, without: Sequence[str] = ()) -> DataFrame:
    """rows with ord from 0 within each group, without a task that holds a group: places within range partitions, less the group's first. Columns named by without order the rows and are left out."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.drop(*without))
    part = F.shiftright("__at", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:  # a row per partition
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    places = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("__at", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
    firsts = written(places.groupBy(group).agg(F.min("__at").alias("__first")))
    return places.join(sized(firsts, firsts.count()), group).withColumn("ord", (F.col("__at") - F.col("__first")).cast("int")).drop("__part", "__before", "__at", "__first")


def sized(rows: DataFrame, n: int) -> DataFrame:
    """rows to be joined: broadcast if they are few, else sorted and merged, so that none go through the driver."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def _come(moved: DataFrame, n: int, one_size: bool, calls: DataFrame) -> DataFrame:
    """(start, root, node, new): the least path that moved nodes (start, root, node, path, at) give to those they call.

    Paths of one length compare as their places at, so these stand for them
    among the calls; of several lengths the paths of the least places compare.
    """
    callers = moved.select("start", "root", F.col("node").alias("src"), "at", F.size("path").alias("size"))
    sent = sized(callers, n).join(calls, "src").where(F.col("call.dst") != F.col("root"))
    least = sent.groupBy("start", "root", F.col("call.dst").alias("node"), "size").agg(F.min(F.struct("at", "call.ord")).alias("by"))
    least = least.select("start", "root", "node", F.col("by.at").alias("at"), F.struct("by.ord", F.col("node").alias("dst")).alias("call"))
    new = least.join(sized(moved.select("at", "path"), n), "at").select("start", "root", "node", F.concat("path", F.array("call")).alias("new"))
    return new if one_size else new.groupBy("start", "root", "node").agg(F.min("new").alias("new"))


def _gone(moved: DataFrame, n: int, calls: DataFrame) -> DataFrame:
    """(start, root, node, old): the least path that moved nodes (start, root, node, was) gave before."""
    callers = moved.select("start", "root", F.col("node").alias("src"), "was")
    sent = sized(callers, n).join(calls, "src").where(F.col("call.dst") != F.col("root"))
    return sent.groupBy("start", "root", F.col("call.dst").alias("node")).agg(F.min(F.concat("was", F.array("call"))).alias("old"))


def _again(lost: DataFrame, calls: DataFrame, now: DataFrame, max_depth: int) -> DataFrame:
    """lost nodes (start, root, node, was) with the least path that any caller gives, where that has changed."""
    at = now.where(F.size("path") <= max_depth).select("start", "root", F.col("node").alias("src"), "path").hint("merge")
    into = lost.select("start", "root", "node").hint("merge").join(calls, F.col("node") == F.col("call.dst")).join(at, ["start", "root", "src"])
    least = into.groupBy("start", "root", "node").agg(F.min(F.concat("path", F.array("call"))).alias("path"))
    return lost.join(least.hint("merge"), ["start", "root", "node"], "left").where("not (path <=> was)")


def paths(starts: DataFrame, calls: DataFrame, max_depth: int = 5, max_rounds: int = 10_000) -> DataFrame:
    """(start, node, path) of every node that the walk from a start (start, node) visits, the start itself left out.

    calls (src, ord, dst) are followed by ord, equal ones by dst; path holds
    (ord, dst) of each call. A node whose path has more than max_depth calls is
    visited but not expanded.

    A node takes the least path that its moved callers give, if its own is not
    less. If its own has gone with a caller's and what comes is no less, all its
    callers are looked at again: one that has not moved may give the least.
    """
    calls = written(calls.select("src", F.struct("ord", "dst").alias("call")).where("src is not null and call.dst is not null"))
    kind, key = f"array<{dict(calls.dtypes)['call']}>", ["start", "root", "node"]
    roots = starts.select("start", F.col("node").alias("root")).distinct()
    moved = written(roots.select("start", "root", F.col("root").alias("node"), F.lit(None).cast(kind).alias("was"), F.array().cast(kind).alias("path")))
    now = moved.select(*key, "path")
    opened = lambda path: F.col(path).isNotNull() & (F.size(path) <= max_depth)
    for _ in range(max_rounds):
        size = F.when(opened("path"), F.size("path"))
        n, held, shortest, longest = moved.agg(F.count(size), F.count(F.when(opened("was"), 1)), F.min(size), F.max(size)).first()
        ranked = written(moved.where(opened("path")).repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id()).select(*key, "path", "at"))
        come = _come(ranked, n, shortest == longest, calls)
        if held:
            come = come.join(_gone(moved.where(opened("was")), held, calls).hint("merge"), key, "full")
        else:
            come = come.withColumn("old", F.lit(None).cast(kind))
        met = come.join(now.withColumnRenamed("path", "was").hint("merge"), key, "left")
        better = F.col("new").isNotNull() & (F.col("was").isNull() | (F.col("new") < F.col("was")))
        lost = F.coalesce(F.col("old") == F.col("was"), F.lit(False)) & ~F.coalesce(F.col("new") <= F.col("was"), F.lit(False))
        met = written(met.where(better | lost).select(*key, "was", F.col("new").alias("path"), lost.alias("lost")))
        moved = met.where("not lost").drop("lost")
        if held and not met.where("lost").isEmpty():
            moved = written(moved.unionByName(_again(met.where("lost").select(*key, "was"), calls, now, max_depth)))
        if moved.isEmpty():
            break
        if not moved.where("was is not null").isEmpty():
            now = written(now.join(moved.select(*key).hint("merge"), key, "left_anti"))
        now = now.unionByName(moved.where("path is not null").select(*key, "path"))
    return now.where("node <> root").select("start", "node", "path")


def traces(starts: DataFrame, calls: DataFrame, max_depth: int = 5) -> DataFrame:
    """(start, ord, depth, node, stalled): the visited nodes in pre-order; those beyond max_depth stall."""
    found = numbered(paths(starts, calls, max_depth).withColumn("depth", F.size("path")), "start", F.asc("path"), without=["path"])
    return found.select("start", "ord", "depth", "node", (F.col("depth") > max_depth).alias("stalled"))


def targets(calls: DataFrame, injections: DataFrame, fields: DataFrame) -> DataFrame:
    """calls (file, method, ord, prop, callee) with dst, via_port, token, bound_in, via_field and reason.

    A property of injections (file, prop, type, dst, bound_to, token, bound_in)
    leads to the class that its port is bound to, else to its own file, and
    nowhere if it has neither. One of fields (file, prop, state, dst), of state
    follow, external or unknown, leads to its file or nowhere. Others are not
    injected. Of repeated calls of one method the first counts.
    """
    first = calls.groupBy("file", "method", "prop", "callee").agg(F.min("ord").alias("ord"))
    one = injections.groupBy("file", "prop").agg(F.min_by(F.struct("type", "dst", "bound_to", "token", "bound_in"), F.struct("type", "token")).alias("i"))
    held = fields.groupBy("file", "prop").agg(F.min(F.struct("state", "dst")).alias("f"))
    rows = first.join(one, ["file", "prop"], "left").join(held, ["file", "prop"], "left")
    injected, ported = F.col("i").isNotNull(), F.col("i.bound_to").isNotNull()
    by_field = ~injected & (F.col("f.state") == "follow")
    reason = F.when(injected | (F.col("f.state").isin("follow", "external")), None).when(F.col("f").isNull(), NOT_INJECTED).when(F.col("f.state") == "unknown", UNKNOWN_FIELD)
    only = lambda c: F.when(ported, F.col(c))
    return rows.select(
        "file", "method", "ord", "prop", "callee",
        F.when(injected, F.coalesce("i.bound_to", "i.dst")).when(by_field, F.col("f.dst")).alias("dst"),
        only("i.type").alias("via_port"), only("i.token").alias("token"), only("i.bound_in").alias("bound_in"),
        F.coalesce(by_field, F.lit(False)).alias("via_field"), reason.alias("reason"),
    )


def key(file: str, method: str) -> Column:
    return F.concat_ws("#", file, F.coalesce(method, F.lit("")))


def hops(starts: DataFrame, resolved: DataFrame, injections: DataFrame, data: DataFrame, max_depth: int = 5) -> DataFrame:
    """(start, ord, depth, file, method, prop, via_port, token, bound_in, via_field, inferred) of the walk from each start (start, file, method).

    resolved is what targets() gives. A start that calls nothing that can be
    followed gets a hop of depth 1 to each class that is injected there, marked
    inferred, but not to files of data (file), entities and the like.
    """
    calls = resolved.where("dst is not null")
    graph = calls.select(key("file", "method").alias("src"), "ord", key("dst", "callee").alias("dst"))
    found = paths(starts.select("start", key("file", "method").alias("node")), graph, max_depth)
    root = starts.select("start", key("file", "method").alias("__root"))
    rows = found.join(root, "start").select("start", "path", F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)["dst"]).otherwise(F.col("__root")).alias("src"), F.element_at("path", -1)["ord"].alias("call"), F.col("node").alias("to"))
    carried = calls.select(key("file", "method").alias("src"), F.col("ord").alias("call"), key("dst", "callee").alias("to"), F.col("dst").alias("file"), F.col("callee").alias("method"), "prop", "via_port", "token", "bound_in", "via_field")
    walked = rows.join(carried, ["src", "call", "to"]).withColumn("inferred", F.lit(False)).drop("src", "call", "to")
    idle = starts.join(found.select("start").distinct(), "start", "left_anti")
    held = injections.select("file", "prop", F.coalesce("bound_to", "dst").alias("to"), F.when(F.col("bound_to").isNotNull(), F.struct("type", "token", "bound_in")).alias("port")).where("to is not null")
    held = held.join(data.select(F.col("file").alias("to")).distinct(), "to", "left_anti")
    step = F.array(F.struct(F.lit(0).alias("ord"), F.concat_ws("#", "prop", "to").alias("dst"))).cast(dict(found.dtypes)["path"])
    guessed = idle.select("start", "file").join(held, "file").select("start", step.alias("path"), F.col("to").alias("file"), F.lit(None).cast("string").alias("method"), "prop", F.col("port.type").alias("via_port"), F.col("port.token").alias("token"), F.col("port.bound_in").alias("bound_in"), F.lit(False).alias("via_field"), F.lit(True).alias("inferred"))
    out = numbered(walked.unionByName(guessed).withColumn("depth", F.size("path")), "start", F.asc("path"), without=["path"])
    return out.select("start", "ord", "depth", "file", "method", "prop", "via_port", "token", "bound_in", "via_field", "inferred")


def stalls(starts: DataFrame, walked: DataFrame, resolved: DataFrame, bodies: DataFrame, ports: DataFrame, max_depth: int = 5) -> DataFrame:
    """(file, method, reason, depth): where walks end before their time, each once, with the least depth.

    depth-cap: a visited method beyond max_depth. body-not-found: one that is
    not among bodies (file, method). Both are no stall in files of ports (file),
    which have no bodies by design. Calls whose property leads nowhere stall for
    the reason that targets() gives.
    """
    seen = starts.select("file", "method", F.lit(0).alias("depth")).unionByName(walked.where("not inferred").select("file", "method", "depth"))
    seen = seen.groupBy("file", "method").agg(F.min("depth").alias("depth"), F.max("depth").alias("most"))
    own = seen.join(ports.select("file").distinct(), "file", "left_anti")
    capped = own.where(F.col("most") > max_depth).select("file", "method", F.lit("depth-cap").alias("reason"), F.greatest("depth", F.lit(max_depth + 1)).alias("depth"))
    expanded = seen.where(F.col("depth") <= max_depth)
    bare = own.where(F.col("depth") <= max_depth).join(bodies.select("file", "method").distinct(), ["file", "method"], "left_anti").select("file", "method", F.lit("body-not-found").alias("reason"), "depth")
    lost = expanded.join(resolved.where("reason is not null").select("file", "method", "reason").distinct(), ["file", "method"]).select("file", "method", "reason", "depth")
    return capped.unionByName(bare).unionByName(lost)
