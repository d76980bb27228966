"""The trie of conversations' shared beginnings, with subtree totals by leaf peeling.

Every conversation's first d turns are named by a 128-bit fingerprint: the XOR
of one hash of (place, turn) for each turn, a running aggregate along the
conversation. Equal fingerprints of equal depth are one node.

Totals of subtrees go up by messages. A node belongs to the run of its longest
member (the smallest conv_id of equals), so every run is one stretch from a head
down to a leaf and all other children of its nodes are heads of runs. A run
holds a counter of side branches that remain. In a round, runs whose counter is
zero send their totals to the node that their head hangs on, whose run counts
down, until only the root's run finishes. A run in place of single nodes makes
the rounds depend on how branches nest, not on how long conversations are:
a conversation that was logged again after every turn is one run.

Running aggregates go by cells of CELL places, with the totals of the cells
before them, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import durable, python_workers

#: Places that one task takes of a conversation, and the span of ids in one piece of a list of ends.
CELL, SPAN = 1024, 4096
#: Turns that a conversation can take from another one.
HEAD = 5
NODE = ["depth", "a", "b"]
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NO_TURN = -(1 << 63)


def running(df: DataFrame, key: str, place: str, ties: list[str], back: bool, **sums: tuple[Callable, str]) -> DataFrame:
    """df with running aggregates (function, column) along `place` within `key`, from the last place up if `back`.

    A cell holds the rows of CELL consecutive places; rows that share a place
    are ordered by `ties` within their cell.
    """
    turned = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    df = df.withColumn("__cell", F.expr(f"`{place}` div {CELL}"))
    inside = Window.partitionBy(key, "__cell").orderBy(turned(place), *ties).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(turned("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "__cell").agg(*[f(c).alias(name) for name, (f, c) in sums.items()])
    totals = totals.select(key, "__cell", *[f(name).over(earlier).alias(f"__{name}") for name, (f, _) in sums.items()])
    both = {"sum": lambda x, y: x + y, "bit_xor": lambda x, y: x.bitwiseXOR(y)}
    out = df.withColumns({name: f(c).over(inside) for name, (f, c) in sums.items()}).join(totals, [key, "__cell"])
    return out.withColumns({name: both[f.__name__](F.col(name), F.coalesce(f"__{name}", F.lit(0))) for name, (f, _) in sums.items()}).drop("__cell", *[f"__{name}" for name in sums])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of every turn, pos from 1.

    Turns are in the order of `turn`, null first; turns that tie are in the order
    of the digest of role and text. Null role or text is as an empty one. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_NO_TURN)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    ).where("conv_id is not null")
    return running(rows.withColumn("one", F.lit(1).cast("long")), "conv_id", "turn", ["digest"], False, pos=(F.sum, "one")).select("conv_id", "pos", "digest", "chars")


def with_shared_heads(turns: DataFrame, period: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, chars, size) and conversations (conv_id, size), from the turns of ordered().

    The first h turns of a conversation are replaced by those of the conversation
    whose id is the next lower multiple of `period`, h = crc32(id) mod 6; with
    fewer turns there, or none, it takes what there is.
    """
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    donor = F.col("conv_id") - F.col("conv_id") % period
    given = own.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("donor"), F.least("n", F.lit(HEAD)).alias("there"))
    plan = own.withColumns({"donor": donor, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)}).join(given, "donor", "left")
    plan = plan.withColumn("got", F.least("h", F.coalesce("there", F.lit(0)).cast("long")))
    plan = durable(plan.withColumn("size", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "donor", "h", "got", "size"))
    heads = turns.where((F.col("conv_id") % period == 0) & (F.col("pos") <= HEAD)).withColumnRenamed("conv_id", "donor")
    taken = heads.join(plan, (heads.donor == plan.donor) & (F.col("pos") <= F.col("got"))).select("conv_id", "pos", "digest", "chars", "size")
    kept = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "chars", "size")
    return taken.unionByName(kept), plan.select("conv_id", "size")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, size, depth, a, b, pa, pb, chars): every beginning of every conversation, the empty one too, and the one before it."""
    hashed = turns.withColumns({"ha": F.xxhash64("pos", "digest"), "hb": F.xxhash64("digest", F.lit("b"), "pos")})
    found = running(hashed, "conv_id", "pos", [], False, a=(F.bit_xor, "ha"), b=(F.bit_xor, "hb"))
    found = found.select("conv_id", "size", F.col("pos").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "chars")
    zero = F.lit(0).cast("long")
    return found.unionByName(convs.select("conv_id", "size", *[zero.alias(c) for c in (*NODE, "pa", "pb", "chars")]))


def ends(found: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): the SHA-256 of the ascending ids of the conversations that end at a node.

    Ids are joined in pieces of SPAN ids first; one node's pieces then pass one
    task in order, which holds the state of the hash alone.
    """
    pieces = found.where("depth = size").groupBy(*NODE, F.expr(f"conv_id div {SPAN}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, out = zip(*[batch.column(c).to_pylist() for c in NODE]), []
            for key, ids in zip(keys, batch.column("ids")):
                if key == at:
                    state.update(b"," + ids.as_py().encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.as_py().encode())
            yield from _batch(out)
        if at is not None:
            yield from _batch([(*at, state.hexdigest())])

    python_workers(found.sparkSession)
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*NODE, "ends_sha256"])


def _peeled(nodes: DataFrame) -> DataFrame:
    """(depth, a, b, leaves, saved): per node, the totals of the side branches that hang on it."""
    heads = nodes.where("parent_run is null or parent_run <> run").select("run", "parent_run", F.expr("depth - 1").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    own = nodes.groupBy("run").agg(F.sum("own").alias("saved"))
    waits = heads.where("parent_run is not null").groupBy(F.col("parent_run").alias("run")).agg(F.count("*").alias("remaining"))
    # The last node of a run has no child, so each run brings one leaf of its own.
    live = durable(heads.join(own, "run").join(waits, "run", "left").withColumns({"remaining": F.coalesce("remaining", F.lit(0)), "leaves": F.lit(1).cast("long")}))
    sent: list[DataFrame] = []
    while not live.isEmpty():
        done = live.where("remaining = 0")
        sent.append(done.where("parent_run is not null").select(*NODE, "leaves", "saved"))
        told = done.groupBy(F.col("parent_run").alias("run")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        zero = F.lit(0)
        live = durable(
            live.where("remaining > 0")
            .join(told, "run", "left")
            .withColumns({"remaining": F.col("remaining") - F.coalesce("n", zero), "leaves": F.col("leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero)})
            .drop("n", "more_leaves", "more_saved")
        )
    if not sent:
        return nodes.where("false").select(*NODE, F.col("own").alias("leaves"), F.col("own").alias("saved"))
    return reduce(DataFrame.unionByName, sent).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """COLUMNS of every node of the trie of turns (conv_id, pos, digest, chars, size) and conversations (conv_id, size).

    conv_id is the smallest member. Conversations without turns are members of
    the root alone. No conversations give no node.
    """
    found = durable(prefixes(turns, convs))
    longest = F.max(F.struct("size", (-F.col("conv_id")).alias("minus")))
    nodes = found.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), longest.alias("run"), *[F.min(c).alias(c) for c in ("pa", "pb", "chars")])
    nodes = durable(nodes.withColumns({"run": -F.col("run.minus"), "own": (F.col("n_convs") - 1) * F.col("chars")}))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("parent_run"))
    nodes = durable(nodes.join(above, ["depth", "pa", "pb"], "left"))
    children = nodes.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    full = nodes.join(children, NODE, "left").join(_peeled(nodes), NODE, "left").join(ends(found), NODE, "left")
    full = full.withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    full = full.withColumns({"leaves": F.coalesce("leaves", zero) + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": F.coalesce("saved", zero) + F.col("own")})
    full = durable(full)  # read twice: for the totals of its cells and for its rows
    return running(full, "run", "depth", [], True, n_leaves=(F.sum, "leaves"), saved_tokens=(F.sum, "saved")).select(*COLUMNS)


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """trie() of the conversations with shared heads.

    Extra columns are ignored; repeated rows are turns of their own. An empty
    table gives an empty result.
    """
    return trie(*with_shared_heads(durable(ordered(conversations))))
