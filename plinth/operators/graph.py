"""Graph operators over edge tables (src, dst): reachability and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-plinth-"))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative step by a checkpoint in the cluster's shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the checkpoint folder and read again.

    Unlike a checkpoint it also drops what the optimizer has inferred of the
    columns; over many rounds of joins of a table with itself that outgrows the
    data, and planning takes longer than the work.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged.

    Else each table below the limit for broadcasts goes through the driver, in
    every round and every join of it.
    """
    return df.hint("merge")


#: Rounds after which a search contracts the chains of what it has not visited, and edges from which components do.
PLAIN_ROUNDS, CONTRACTED_FROM = 8, 1000


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False, max_depth: int = 1_000_000) -> DataFrame:
    """(node, depth) for all that the seeds (node) reach, with the least depth; seeds have depth 0.

    Breadth first: each round joins only the newest nodes with the edges, leaves
    out what was visited, and is checkpointed. It ends when a round finds
    nothing. A search that goes on contracts the chains ahead of it, so a long
    one takes rounds with the logarithm of its length.
    """
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    visited = newest = settled(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, min(PLAIN_ROUNDS, max_depth) + 1):
        found = merged(newest.select(F.col("node").alias("src"))).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        newest = settled(found.join(merged(visited.select("node")), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            return visited
        visited = visited.union(newest)
    return visited if max_depth <= PLAIN_ROUNDS else visited.union(_farther(steps, visited, newest, max_depth))


def _farther(steps: DataFrame, visited: DataFrame, newest: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of what is reached from the newest nodes and was not visited before, over contracted chains."""
    visited, newest = written(visited), written(newest)
    gone = merged(visited.select("node"))
    open_ = written(steps.join(gone, steps.dst == gone.node, "left_anti").join(merged(gone.join(newest, "node", "left_anti")), F.col("src") == F.col("node"), "left_anti").select("src", "dst"))
    inner, edges, _ = chains(open_, newest.select("node"))
    known = front = newest.select("node", F.col("depth").cast("long").alias("depth"))
    while True:
        come = merged(front).join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth")).where(F.col("depth") <= max_depth)
        old = known.groupBy("node").agg(F.min("depth").alias("had"))
        front = written(come.join(merged(old), "node", "left").where("had is null or depth < had").select("node", "depth"))
        if front.isEmpty():
            break
        known = written(known.union(front).groupBy("node").agg(F.min("depth").alias("depth")))
    within = inner.join(merged(known.select(F.col("node").alias("head"), F.col("depth").alias("__at"))), "head").select("node", (F.col("__at") + F.col("dist")).alias("depth"))
    rest = known.join(merged(newest.select("node")), "node", "left_anti").unionByName(within).where(F.col("depth") <= max_depth)
    return written(rest.select("node", F.col("depth").cast("int").alias("depth")))


def chains(edges: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract the chains of distinct edges (src, dst): inner nodes, edges (src, dst, weight) between the others, and rings (node, comp).

    A node with one edge in and one out, not among fixed (node), is inner; it
    has head and tail, the nodes at its chain's ends, and dist from the head. A
    ring of inner nodes alone has no ends; comp is its smallest node. Pointers
    to the ends double their length each round.
    """
    ends = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("__out"), F.min("dst").alias("tail")).where("__out = 1")
    begun = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("__in"), F.min("src").alias("head")).where("__in = 1")
    one = F.lit(1).cast("long")
    now = written(ends.join(merged(begun), "node").join(merged(fixed.select("node")), "node", "left_anti").select("node", "head", one.alias("dist"), "tail", F.col("node").alias("least"), F.lit(True).alias("open")))
    for _ in range(max(now.count(), 1).bit_length() + 1):
        back = now.select(F.col("node").alias("head"), F.col("head").alias("__head"), F.col("dist").alias("__dist"), F.col("least").alias("__least"))
        ahead = now.select(F.col("node").alias("tail"), F.col("tail").alias("__tail"))
        new = now.join(merged(back), "head", "left").join(merged(ahead), "tail", "left")
        now = written(new.select("node", F.coalesce("__head", "head").alias("head"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"), F.coalesce("__tail", "tail").alias("tail"), F.least("least", F.coalesce("__least", "least")).alias("least"), (F.col("__head").isNotNull() | F.col("__tail").isNotNull()).alias("open")))
        if now.where("open").isEmpty():
            break
    inner = now.where("not open").select("node", "head", "dist", "tail")
    named = merged(now.select("node"))
    direct = edges.join(named, edges.src == named.node, "left_anti").join(named, F.col("dst") == F.col("node"), "left_anti").select("src", "dst", one.alias("weight"))
    both = direct.unionByName(_over(inner, edges)).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return inner, written(both), now.where("open").select("node", F.col("least").alias("comp"))


def _over(inner: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge for each chain, from its last inner node's distance."""
    last = merged(inner).join(edges, (inner["node"] == edges["src"]) & (inner["tail"] == edges["dst"]))
    return last.select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.col("dist") + 1).alias("weight"))


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that no root reaches; none where there are no roots."""
    if roots.isEmpty():
        return nodes.limit(0)
    return nodes.join(merged(reach(edges, roots).select("node")), "node", "left_anti")


def blast_radius(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of what depends on the seeds, without the seeds."""
    return reach(edges, seeds, reverse=True).where("depth > 0")


def components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, comp) of the strongly connected components with two or more nodes; comp is the smallest node.

    Chains are contracted first: their nodes are in a component if both ends are
    in the same one. Nodes without an incoming or outgoing edge are trimmed,
    again and again. Then every node takes the smallest label that reaches it,
    and the nodes that a label's own node is reached from, within the label, are
    its component; the rest goes round again. Self-loops make no component.
    """
    left = settled(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    if left.count() < CONTRACTED_FROM:
        return _components(left, max_rounds)
    inner, short, rings = chains(left, left.select(F.col("src").alias("node")).limit(0))
    outer = settled(_components(short.where("src <> dst").select("src", "dst"), max_rounds))
    at = lambda side: outer.select(F.col("node").alias(side), F.col("comp").alias(f"__{side}"))
    held = inner.join(merged(at("head")), "head", "left").join(merged(at("tail")), "tail", "left").where("head = tail or __head = __tail")
    # A chain back to its own head makes a component with it, if the head is in no larger one.
    held = held.select("node", F.coalesce("__head", "head").alias("comp"), F.col("head"))
    found = outer.unionByName(held.select("node", "comp")).unionByName(held.select(F.col("head").alias("node"), "comp")).unionByName(rings).distinct()
    least = found.groupBy("comp").agg(F.min("node").alias("least"))
    return found.join(merged(least), "comp").select("node", F.col("least").alias("comp"))


def _components(left: DataFrame, max_rounds: int) -> DataFrame:
    found = [left.select(F.col("src").alias("node"), F.col("src").alias("comp")).limit(0)]
    for _ in range(max_rounds):
        left = _trimmed(left)
        if left.isEmpty():
            break
        labels = _labels(left)
        inner = left.join(merged(labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))), "src").join(merged(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))), "dst").where("ls = ld").select("src", "dst", F.col("ls").alias("label"))
        inner = settled(inner)
        heads = inner.select(F.col("label").alias("node")).distinct()
        back = reach(inner.select("src", "dst"), heads, reverse=True)
        members = settled(labels.join(merged(back.select("node")), "node").select("node", F.col("label").alias("comp")))
        found.append(members.join(merged(members.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")), "comp", "left_semi").select("node", "comp"))
        gone = merged(members.select("node"))
        left = settled(left.join(gone, left.src == gone.node, "left_anti").join(gone, F.col("dst") == gone.node, "left_anti"))
    return reduce(DataFrame.union, found)


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those at nodes that have no way in or no way out."""
    n = edges.count()
    while True:
        kept = edges.join(merged(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        kept = settled(kept.join(merged(edges.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
        was, n, edges = n, kept.count(), kept
        if n == was:
            return kept


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which each node is reached, itself included."""
    now = settled(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("label", F.col("node")))
    while True:
        sent = edges.join(merged(now), edges.src == now.node).groupBy("dst").agg(F.min("label").alias("come"))
        new = settled(now.join(merged(sent), now.node == sent.dst, "left").select("node", F.least("label", F.coalesce("come", "label")).alias("label"), (F.col("come") < F.col("label")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        now = new.select("node", "label")


def affected(hops: DataFrame, changed: DataFrame, start: str = "start") -> DataFrame:
    """(start, via): starts of which a hop (start, node) has changed, with the changed nodes in order."""
    return hops.join(changed.select("node").distinct(), "node", "left_semi").groupBy(start).agg(F.array_sort(F.collect_set("node")).alias("via"))


def carve_outs(edges: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """(graph, src, dst): one copy of the edges for each (name, condition)."""
    out = None
    for name, condition in variants:
        part = edges.where(condition).select(F.lit(name).alias("graph"), "src", "dst")
        out = part if out is None else out.union(part)
    return out
