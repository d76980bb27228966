"""Lookup joins: by priority, by token, by name, by ancestor, by span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.paths import directory, folded, segments
from plinth.operators.graph import settled


def resolve(imports: DataFrame, files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """imports (src, spec) with dst and pos: the first candidate path that a file (path) has.

    Candidates are the spec, folded against the folder of src, with each suffix
    in turn. dst is null where none exists.
    """
    base = folded(F.when(F.col("spec").startswith("."), F.concat_ws("/", directory(F.col("src")), F.col("spec"))).otherwise(F.col("spec")))
    rows = imports.withColumn("__base", base)
    tried = rows.select("src", "spec", F.posexplode(F.array(*[F.concat(F.col("__base"), F.lit(s)) for s in suffixes])).alias("pos", "path")).distinct()
    found = tried.join(files.select("path").distinct(), "path").groupBy("src", "spec").agg(F.min_by("path", "pos").alias("dst"), F.min("pos").alias("pos"))
    return rows.drop("__base").join(found, ["src", "spec"], "left")


def bind(tokens: DataFrame, bindings: DataFrame, token: str = "token", impl: str = "impl") -> DataFrame:
    """tokens with n, bound_to and status: bound to its only implementation, ambiguous, or unbound."""
    counts = bindings.groupBy(token).agg(F.countDistinct(impl).alias("n"), F.min(impl).alias("one"))
    joined = tokens.join(counts, token, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(*tokens.columns, "n", F.when(F.col("n") == 1, F.col("one")).alias("bound_to"), F.when(F.col("n") == 0, "unbound").when(F.col("n") == 1, "bound").otherwise("ambiguous").alias("status"))


def implicit_keys(columns: DataFrame, entities: DataFrame, key: Column, name: Column) -> DataFrame:
    """columns joined to the entity whose normalised name their own normalised name gives.

    Of entities with one normalised name the greatest name counts.
    """
    known = entities.withColumn("__name", name).groupBy("__name").agg(F.max("entity").alias("refers_to"))
    return columns.withColumn("__name", key).join(known, "__name").drop("__name")


def nearest_ancestor(rows: DataFrame, owners: DataFrame, path: str = "path") -> DataFrame:
    """rows with owner and depth of the longest owner folder (folder, owner) that holds their path.

    Each path asks for its own prefixes, so the join is on equal keys. Without
    an owner both are null.
    """
    parts = segments(F.col(path))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = rows.select(path).distinct().select(path, F.posexplode(prefixes).alias("depth", "folder"))
    found = asked.join(owners.select("folder", "owner"), "folder").groupBy(path).agg(F.max_by("owner", "depth").alias("owner"), F.max("depth").alias("depth"))
    return rows.join(found, path, "left")


def _cell(at: Column, width: Column) -> Column:
    return at - F.pmod(at, width)


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """points with the name of the narrowest span (by, lo, hi, name) that holds them, null if none does.

    Spans lie in one or two cells as wide as the next power of two, and a point
    asks for its own cell of each width that occurs (64 at most), so the join is
    on key, width and cell: a key with many spans is spread over its cells, and
    only near spans are compared. Of spans of one width the later start counts,
    then the greater name. points must have a key column `point_id`.
    """
    width = F.when(F.col("hi") - F.col("lo") <= 1, F.lit(1)).otherwise(F.lit(2) ** F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double")))).cast("long")
    held = spans.select(by, "lo", "hi", name, width.alias("__width")).where("lo < hi")
    held = held.withColumn("__cell", F.explode(F.array_distinct(F.array(_cell(F.col("lo"), F.col("__width")), _cell(F.col("hi"), F.col("__width"))))))
    widths = spans.sparkSession.createDataFrame([([r[0] for r in held.select("__width").distinct().collect()],)], "w array<bigint>")
    asked = points.select("point_id", by, F.col(at).alias("__at")).join(F.broadcast(widths)).withColumn("__width", F.explode("w")).drop("w")
    asked = asked.withColumn("__cell", _cell(F.col("__at"), F.col("__width")))
    inside = asked.join(held, [by, "__width", "__cell"]).where("lo <= __at and __at < hi")
    best = inside.groupBy("point_id").agg(F.min_by(name, F.struct(F.col("hi") - F.col("lo"), -F.col("lo"), F.col(name))).alias(name))
    return points.join(best, "point_id", "left")


def declared_in(uses: DataFrame, symbols: DataFrame, declarations: DataFrame) -> DataFrame:
    """uses (path, type) with file: that which the import of the name (path, local, file) gives, else the own one if it declares it."""
    own = declarations.select("path", F.col("name").alias("type")).distinct().withColumn("__own", F.col("path"))
    known = symbols.groupBy("path", F.col("local").alias("type")).agg(F.min("file").alias("__file"))
    out = uses.join(known, ["path", "type"], "left").join(own, ["path", "type"], "left")
    return out.select(*uses.columns, F.coalesce("__file", "__own").alias("file"))


#: Imports that a name is followed through.
CHAIN = 8


def scoped(uses: DataFrame, imports: DataFrame, declared: DataFrame) -> DataFrame:
    """uses (path, name) with file, declared, hops and status: where a name's meaning is declared, and under which name.

    imports (path, local, file, imported) lead from a name to the one that its
    file gives it, renamed or default ones too, and to a null file outside the
    tree; a file that passes a name on has a row for it. declared has (path,
    name). status: own or imported where the last file declares the name; unique
    where it does not but one file alone does; else ambiguous or unknown;
    external; deep after more than CHAIN imports, as in a circle. Of several
    imports of one name the least counts. Pointers double each round, so four
    rounds tell all.
    """
    step = imports.groupBy("path", F.col("local").alias("name")).agg(F.min(F.struct("file", "imported")).alias("to"))
    now = step.select("path", "name", F.col("to.file").alias("file"), F.col("to.imported").alias("declared"), F.lit(1).alias("hops"))
    for _ in range(CHAIN.bit_length()):
        then = now.select(F.col("path").alias("file"), F.col("name").alias("declared"), F.struct("file", "declared", "hops").alias("__to"))
        joined = now.join(then, ["file", "declared"], "left")
        ends = F.when(F.col("__to").isNotNull(), F.col("__to.file")).otherwise(F.col("file"))
        now = settled(joined.select("path", "name", ends.alias("file"), F.coalesce("__to.declared", "declared").alias("declared"), (F.col("hops") + F.coalesce("__to.hops", F.lit(0))).alias("hops")))
    found = uses.select("path", "name").distinct().join(now, ["path", "name"], "left")
    own = F.col("hops").isNull()
    found = found.select("path", "name", F.when(own, F.col("path")).otherwise(F.col("file")).alias("file"), F.coalesce("declared", "name").alias("declared"), F.coalesce("hops", F.lit(0)).alias("hops"))
    there = declared.select(F.col("path").alias("file"), F.col("name").alias("declared"), F.lit(True).alias("__there")).distinct()
    named = declared.distinct().groupBy(F.col("name").alias("declared")).agg(F.count("*").alias("__n"), F.min("path").alias("__only"))
    rows = found.join(there, ["file", "declared"], "left").join(named, "declared", "left")
    status = F.when(F.col("hops") > CHAIN, "deep").when(F.col("file").isNull(), "external").when(F.col("__there"), F.when(F.col("hops") == 0, "own").otherwise("imported")).when(F.col("__n") == 1, "unique").when(F.col("__n") > 1, "ambiguous").otherwise("unknown")
    rows = rows.withColumn("status", status)
    file = F.when(F.col("status").isin("own", "imported"), F.col("file")).when(F.col("status") == "unique", F.col("__only"))
    known = rows.select("path", "name", file.alias("file"), F.when(file.isNotNull(), F.col("declared")).alias("declared"), F.least("hops", F.lit(CHAIN + 1)).alias("hops"), "status")
    return uses.join(known, ["path", "name"])


def within_lines(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """points (by, point_id, line) with every span (by, first, last, name) whose lines, both included, hold them."""
    return points.join(spans, by).where((F.col("first") <= F.col("line")) & (F.col("line") <= F.col("last")))


def uncovered(points: DataFrame, spans: DataFrame, by: str, at: str) -> DataFrame:
    """points in no span of their key."""
    p, s = points.alias("p"), spans.alias("s")
    return p.join(s, (F.col(f"p.{by}") == F.col(f"s.{by}")) & (F.col("s.lo") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s.hi")), "left_anti")


def tests_of(sources: DataFrame, specs: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """(path, spec, strategy): spec files that a source's candidate paths name; strategy is the candidate's place."""
    asked = sources.select("path", F.posexplode(F.array(*candidates)).alias("strategy", "spec"))
    return asked.join(specs.select(F.col("path").alias("spec")).distinct(), "spec").groupBy("path", "spec").agg(F.min("strategy").alias("strategy"))
