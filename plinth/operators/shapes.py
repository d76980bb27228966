"""Shapes of types: which fields a type expression has, folded over a table of its nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.change import SHAPE
from plinth.operators.graph import merged, written

#: Kinds that pass their child on, and those whose fields come from several children.
PASSING, MERGING = ("pass", "promise", "reference", "alias"), ("intersection", "record")
#: References and wrappers that a shape is followed through, unless the caller asks for all.
DEPTH = 8
#: Rounds after which their tables are written as one, so that the last plan stays small.
ROUNDS_KEPT = 32


def _shape(none: bool = False, array: bool = False, open: Column | None = None, fields: Column | None = None) -> Column:  # noqa: A002
    fields = F.lit(None) if fields is None else fields
    return F.struct(F.lit(none).alias("none"), F.lit(array).alias("array"), F.lit(False).alias("literal"), (F.lit(False) if open is None else open).alias("open"), fields.cast("map<string,boolean>").alias("fields")).cast(SHAPE)


def _own(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """nodes with own, the map of their fields; of a name given twice the last counts."""
    last = fields.where("name is not null").groupBy("node", "name").agg(F.max_by(F.coalesce("optional", F.lit(False)), F.struct("place", "optional")).alias("optional"))
    maps = last.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("name", "optional"))).alias("own"))
    return nodes.join(merged(maps), "node", "left").withColumn("own", F.coalesce("own", F.create_map().cast("map<string,boolean>")))


def _without_unions(nodes: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unions of one alternative beside null pass it on, others cannot be read; children without those of unions that are gone."""
    kinds = nodes.select(F.col("node").alias("child"), F.col("kind").alias("__kind"))
    unions = merged(nodes.where("kind = 'union'").select(F.col("node").alias("parent")))
    of_unions = children.join(unions, "parent", "left_semi")
    real = of_unions.join(merged(kinds), "child", "left").where("not (__kind <=> 'null')").groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("only"))
    one = real.where("n = 1").select(F.col("parent").alias("node"), "only")
    kind = F.when(F.col("kind") != "union", F.col("kind")).when(F.col("only").isNotNull(), "pass").otherwise("unread")
    links = children.join(unions, "parent", "left_anti").select("parent", "place", "child")
    return nodes.join(merged(one), "node", "left").withColumn("kind", kind).drop("only"), links.unionByName(one.select(F.col("node").alias("parent"), F.lit(0).cast(dict(links.dtypes)["place"]).alias("place"), F.col("only").alias("child")))


def _loosened(loose: Column, fields: Column) -> Column:
    return F.when(loose, F.transform_values(fields, lambda k, v: F.lit(True))).otherwise(fields)


def _merged(kids: Column) -> Column:
    """The fields of all kids by place, the later over the earlier."""
    later = lambda k, a, b: F.coalesce(b, a)
    by_place = F.array_sort(kids, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return F.aggregate(by_place, F.create_map().cast("map<string,boolean>"), lambda acc, kid: F.map_zip_with(acc, kid["fields"], later))


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, base, loose, steps): what the chain of pointers (node, base, loose) from each node ends at; in a circle, the node itself.

    Pointers double their length each round. The nearest to an end gets there in
    each, so a round in which none does leaves only circles and what leads there.
    """
    now, left = written(pointers.withColumns({"steps": F.lit(1).cast("long"), "open": F.lit(True)})), None
    while True:
        ahead = now.select(F.col("node").alias("base"), F.col("base").alias("__base"), F.col("loose").alias("__loose"), F.col("steps").alias("__steps"))
        met = now.where("open").join(merged(ahead), "base", "left")
        loose, steps = F.col("loose") | F.coalesce("__loose", F.lit(False)), F.col("steps") + F.coalesce("__steps", F.lit(0))
        moved = met.select("node", F.coalesce("__base", "base").alias("base"), loose.alias("loose"), steps.alias("steps"), F.col("__base").isNotNull().alias("open"))
        now = written(moved.unionByName(now.where("not open")))
        was, left = left, now.where("open").count()
        if left in (0, was):
            return now.select("node", F.when(F.col("open"), F.col("node")).otherwise(F.col("base")).alias("base"), "loose", "steps")


def _settled(kids: DataFrame) -> DataFrame:
    """A row a node of kids: settled, its open, fields and levels, fields null if a kid is no object; or what is known of the kids."""
    rows = kids.groupBy("node").agg(F.collect_list(F.struct("at", "base", "loose", "steps", "found", "open", "fields", "levels")).alias("kids"))
    lost, full = F.exists("kids", lambda k: k["found"] & k["fields"].isNull()), F.forall("kids", lambda k: k["found"])
    object_ = lambda c, name: F.when(~lost & full, c).alias(name)
    levels = F.array_max(F.transform("kids", lambda k: k["levels"] + k["steps"]))
    return rows.select("node", (lost | full).alias("settled"), F.when(~lost & ~full, F.col("kids")).alias("kids"), object_(F.exists("kids", lambda k: k["open"]), "open"), object_(_merged(F.col("kids")), "fields"), object_(levels, "levels"))


def _objects(kids: DataFrame) -> list[DataFrame]:
    """Tables (node, open, fields, levels) of the nodes that merge kids, in as many rounds as merges lie below each other.

    A node whose kids are all known is known, and one of whose kids is no object
    is none; both leave the rounds, and only they are looked up in the next. When
    none does, the rest lies on circles or above them and cannot be read.
    """
    done = []
    while True:
        state = written(_settled(kids))
        newest, waiting = state.where("settled").select("node", "open", "fields", "levels"), state.where("not settled").select("node", F.inline("kids"))
        done = [*done, newest] if len(done) < ROUNDS_KEPT else [written(reduce(DataFrame.union, done)), newest]
        if newest.isEmpty() or waiting.isEmpty():
            return done
        known = newest.select(F.col("node").alias("base"), F.lit(True).alias("__found"), F.col("open").alias("__open"), F.col("fields").alias("__fields"), F.col("levels").alias("__levels"))
        met = waiting.where("not found").join(merged(known), "base", "left")
        come = met.select("node", "at", "base", "loose", "steps", F.coalesce("__found", F.lit(False)).alias("found"), F.col("__open").alias("open"), _loosened(F.col("loose"), F.col("__fields")).alias("fields"), F.col("__levels").alias("levels"))
        kids = come.unionByName(waiting.where("found"))


def shapes(nodes: DataFrame, children: DataFrame, fields: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """(node, shape) of nodes (node, kind, open); shape is a change.SHAPE, null where a type cannot be read.

    children are rows (parent, place, child), fields (node, place, name,
    optional). Kinds: `object` has its fields; `record` its own over those of
    its bases, its children; `intersection` its children's, the later over the
    earlier; `partial` its child's, all optional; `array` an array of its child
    (the fields are the element's, null unless it is an object); `promise`,
    `reference`, `alias` and `pass` are their child; `none` and `null` are no
    value; `union` is its one child that is not `null`; any other kind, and a
    kind without the child it needs, cannot be read. What merges a part that
    has no fields cannot be read either, nor what leads into a circle, other
    than an array of it. With a depth, nodes more than that below the one asked
    for cannot be read; None follows all. A null name is no field, a null
    optional or open is false, repeated nodes and children count once; of
    several children where one is meant the first counts.

    Chains of nodes with one child are followed by pointers that double; the
    rest takes a round for each level of merges. Depth leaves out what lies too
    deep at the end. A node's children and fields stand in one declaration and
    are kept together; no other rows are.
    """
    kind, nothing = F.col("kind"), F.lit(None)
    flat = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct("kind", F.coalesce("open", F.lit(False)).alias("open"))).alias("__n")).select("node", "__n.*")
    flat, links = _without_unions(flat, children.where("parent is not null and child is not null").select("parent", "place", "child").distinct())
    typed = links.join(merged(flat.where(kind.isin(*PASSING, *MERGING, "partial", "array")).select(F.col("node").alias("parent"), "kind")), "parent")
    one = typed.where(~kind.isin(*MERGING)).groupBy("parent", "kind").agg(F.min(F.struct("place", "child")).alias("__c")).select("parent", "kind", "__c.*")
    links = written(typed.where(kind.isin(*MERGING)).select("parent", "kind", "place", "child").unionByName(one))
    held = links.select(F.col("parent").alias("node"), F.lit(True).alias("__held")).distinct()
    own = _own(flat.where(kind.isin("object", "record")), fields).select("node", F.col("own").alias("fields"))
    held_as = lambda *kinds: F.col("__held").isNotNull() & kind.isin(*kinds)
    start = flat.join(merged(own), "node", "left").join(merged(held), "node", "left")
    start = written(start.select("node", "kind", "open", "fields", held_as(*MERGING).alias("waits"), held_as(*PASSING, "partial").alias("points")))

    ends = _ends(links.where(kind.isin(*PASSING, "partial")).select(F.col("parent").alias("node"), F.col("child").alias("base"), (kind == "partial").alias("loose")))
    beyond = ends.select(F.col("node").alias("child"), F.col("base").alias("__base"), F.col("loose").alias("__loose"), F.col("steps").alias("__steps"))
    led = links.where(kind.isin(*MERGING, "array")).join(merged(beyond), "child", "left")
    led = written(led.select(F.col("parent").alias("node"), "kind", "place", "child", F.coalesce("__base", "child").alias("base"), F.coalesce("__loose", F.lit(False)).alias("loose"), (F.coalesce("__steps", F.lit(0)) + 1).cast("long").alias("steps")))

    # A record's own fields are a kid after all others; a base that does not wait is known, one that is in no table is no object.
    zero, merges = F.lit(0).cast("long"), led.where(kind.isin(*MERGING))
    at = F.struct(F.lit(False).alias("own"), "place", "child")
    found = ~F.coalesce("waits", F.lit(False))
    met = merges.join(merged(start.select(F.col("node").alias("base"), "waits", "open", "fields")), "base", "left")
    kids = met.select("node", at.alias("at"), "base", "loose", "steps", found.alias("found"), "open", F.when(found, _loosened(F.col("loose"), F.col("fields"))).alias("fields"), zero.alias("levels"))
    types = dict(led.dtypes)
    last = F.struct(F.lit(True).alias("own"), nothing.cast(types["place"]).alias("place"), nothing.cast(types["child"]).alias("child"))
    owned = start.where("waits and kind = 'record'").select("node", last.alias("at"), nothing.cast(types["base"]).alias("base"), F.lit(False).alias("loose"), zero.alias("steps"), F.lit(True).alias("found"), "open", "fields", zero.alias("levels"))
    leaves = start.where("not waits and fields is not null").select("node", "open", "fields", zero.alias("levels"))
    objects = reduce(DataFrame.union, [leaves, *_objects(kids.unionByName(owned))]).where("fields is not null")

    arrays = led.where("kind = 'array'").select("node", F.col("base").alias("source"), "loose", "steps")
    plain = start.where("not points").select("node", "kind").join(merged(arrays), "node", "left").select(F.col("node").alias("base"), "kind", F.coalesce("source", "node").alias("source"), F.coalesce("loose", F.lit(False)).alias("loose"), F.coalesce("steps", zero).alias("steps"))
    through = ends.select("node", "base", F.col("loose").alias("__loose"), F.col("steps").alias("__steps")).join(merged(plain), "base", "left").withColumn("source", F.coalesce("source", "node"))
    every = through.unionByName(plain.select(F.col("base").alias("node"), "*", F.lit(False).alias("__loose"), zero.alias("__steps")))
    rows = every.join(merged(objects.withColumnRenamed("node", "source")), "source", "left")
    near = lambda steps: F.lit(True) if depth is None else steps <= depth
    is_object, direct = F.col("fields").isNotNull(), near(F.col("__steps")) & ~F.col("__loose")
    element = is_object & near(F.col("__steps") + F.col("steps") + F.col("levels"))
    array = _shape(array=True, open=element & F.col("open"), fields=F.when(element, _loosened(F.col("loose"), F.col("fields"))))
    object_ = F.when(is_object & near(F.col("__steps") + F.col("levels")), _shape(open=F.col("open"), fields=_loosened(F.col("__loose"), F.col("fields"))))
    return rows.select("node", F.when(kind == "array", F.when(direct, array)).when(kind.isin("none", "null"), F.when(direct, _shape(none=True))).otherwise(object_).alias("shape"))
