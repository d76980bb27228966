"""Roll-ups of file, edge and test tables to folders, modules and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal; zero where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / whole, 1))


def samples(rows: DataFrame, by: Sequence[str], value: Column, k: int) -> DataFrame:
    """by and samples: the k smallest distinct values of each group, joined by commas.

    Rows beyond k are left out before the shuffle where they can be.
    """
    each = rows.select(*by, value.alias("__s")).distinct()
    best = each.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__s"))).where(F.col("__r") <= k)
    return best.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("__s")), ",").alias("samples"))


def _ends(edges: DataFrame, files: DataFrame, level: str) -> DataFrame:
    side = lambda k: files.select(F.col("path").alias(k), F.col(level).alias(f"{k}_{level}"), F.col("pattern").alias(f"{k}_pattern"))
    return edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")


def level_edges(edges: DataFrame, files: DataFrame, level: str, k: int, keep: Column | None = None) -> DataFrame:
    """(src, dst, w, crossing, samples): edges (src, dst) between the folders or modules of files (path, pattern, level).

    w counts occurrences; samples has k of the distinct edges. keep selects
    edges by src_pattern, dst_pattern and the levels of both ends.
    """
    rows = _ends(edges, files, level)
    rows = (rows if keep is None else rows.where(keep)).select(F.col(f"src_{level}").alias("__f"), F.col(f"dst_{level}").alias("__t"), F.concat_ws(">", "src", "dst").alias("__v"))
    counted = rows.groupBy("__f", "__t").agg(F.count("*").alias("w"))
    out = counted.join(samples(rows, ["__f", "__t"], F.col("__v"), k).withColumnsRenamed({"__f": "src", "__t": "dst"}), F.col("__f").eqNullSafe(F.col("src")) & F.col("__t").eqNullSafe(F.col("dst")))
    return out.select("src", "dst", "w", (F.col("src") != F.col("dst")).alias("crossing"), "samples")


def modules(files: DataFrame) -> DataFrame:
    """(module, files, folders) of files (path, module, folder)."""
    return files.groupBy("module").agg(F.count("*").alias("files"), F.countDistinct("folder").alias("folders"))


def shape(files: DataFrame) -> DataFrame:
    """(module, pattern, n)."""
    return files.groupBy("module", "pattern").agg(F.count("*").alias("n"))


def matrix_cells(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(m1, m2, a, b, degree): the strongest pair of each two modules; places has (item, module). Ties by a, then b."""
    side = lambda k: places.select(F.col("item").alias(k), F.col("module").alias(f"__{k}"))
    best = F.max_by(F.struct("a", "b", "degree"), F.struct("degree", -F.col("a"), -F.col("b")))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.groupBy(F.least("__a", "__b").alias("m1"), F.greatest("__a", "__b").alias("m2")).agg(best.alias("p")).select("m1", "m2", "p.a", "p.b", "p.degree")


def ratios(sources: DataFrame, tested: DataFrame, key: str, by: str) -> DataFrame:
    """(by, total, tested, ratio) of sources (key, by)."""
    rows = sources.join(tested.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count("__hit").alias("tested")).withColumn("ratio", F.round(F.col("tested") / F.col("total"), 3))


def claims(claimed: DataFrame, specs: DataFrame) -> DataFrame:
    """One row (specs, unmatched, reliable, strategy): how well tests find their sources.

    claimed has (path, spec, strategy), specs (spec). A spec is unmatched unless
    exactly one source claims it; the match is reliable if a quarter of the specs
    are unmatched at most; strategy is the one of most claims, then the lowest.
    """
    per = specs.select("spec").distinct().join(claimed.groupBy("spec").agg(F.countDistinct("path").alias("n")), "spec", "left")
    gate = per.agg(F.count("*").alias("specs"), F.count(F.when(F.coalesce("n", F.lit(0)) != 1, 1)).alias("unmatched"))
    best = claimed.groupBy("strategy").agg(F.count("*").alias("n")).agg(F.max_by("strategy", F.struct("n", -F.col("strategy"))).alias("strategy"))
    return gate.withColumn("reliable", F.col("unmatched") <= 0.25 * F.col("specs")).join(F.broadcast(best))  # one row each


def city(files: DataFrame, tiers: Sequence[int], endpoints: DataFrame, found: DataFrame) -> DataFrame:
    """(module, floors, missing, endpoints, findings): files (path, module, tier) with endpoints (module) and findings (src path)."""
    floors = files.groupBy("module").agg(F.count("*").alias("floors"), F.collect_set("tier").alias("__held"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, tiers)), "__held")).cast("array<string>"), ",")
    served = endpoints.groupBy("module").agg(F.count("*").alias("endpoints"))
    flagged = found.select(F.col("src").alias("path")).join(files.select("path", "module"), "path").groupBy("module").agg(F.count("*").alias("findings"))
    out = floors.withColumn("missing", missing).join(served, "module", "left").join(flagged, "module", "left")
    return out.select("module", "floors", "missing", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("endpoints", "findings")])


def inbound(nodes: DataFrame, edges: DataFrame, hub: int = 2) -> DataFrame:
    """nodes (node) with refs, their distinct sources, and kind: hub at `hub` or more, else leaf."""
    refs = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("refs"))
    out = nodes.join(refs, "node", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return out.withColumn("kind", F.when(F.col("refs") >= hub, "hub").otherwise("leaf"))


def tallies(rows: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """by and the number of rows of each status value."""
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(status) == v, 1)).alias(v) for v in values])


def by_tone(found: DataFrame) -> DataFrame:
    """(tone, findings, places): distinct findings of each tone and the places that they name."""
    return found.groupBy("tone").agg(F.countDistinct("finding").alias("findings"), F.count("*").alias("places"))


def extremes(scored: DataFrame, names: Sequence[str], item: str) -> DataFrame:
    """One row: for each named column the item with its largest value, the smallest item of equals."""
    return scored.agg(*[F.min_by(item, F.struct(-F.col(n), F.col(item))).alias(n) for n in names])


def containing(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """rows in which the columns, joined by blanks, contain text whatever its case."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def grip_counts(gripped: DataFrame) -> DataFrame:
    """One row (total, brick, route, framework, unseen) of studs (grip)."""
    return gripped.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("grip") == x, 1)).alias(x) for x in ("brick", "route", "framework", "unseen")])


def socket_counts(sockets: DataFrame) -> DataFrame:
    """One row (sockets, resolved, port, framework, unresolved) of sockets (status); ports and frameworks are resolved too."""
    n = lambda name, *kinds: F.count(F.when(F.col("status").isin(*kinds), 1)).alias(name)
    return sockets.agg(F.count("*").alias("sockets"), n("resolved", "resolved", "port", "framework"), n("port", "port"), n("framework", "framework"), n("unresolved", "unresolved"))


def data_model(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row (entities, columns, declared, inferred, crossing, untabled) of entities (tbl, columns array) and relations (declared, crossing)."""
    n = lambda rows: F.count(F.when(rows, 1))
    of = entities.agg(F.count("*").alias("entities"), F.coalesce(F.sum(F.size(F.coalesce("columns", F.array().cast(dict(entities.dtypes)["columns"])))), F.lit(0)).alias("columns"), n(F.col("tbl").isNull()).alias("untabled"))
    between = relations.agg(n(F.col("declared")).alias("declared"), n(~F.coalesce("declared", F.lit(False))).alias("inferred"), n(F.col("crossing")).alias("crossing"))
    return of.join(F.broadcast(between)).select("entities", "columns", "declared", "inferred", "crossing", "untabled")  # one row each


def totals(scored: DataFrame) -> DataFrame:
    """One row (files, most_changes, most_deps, lines, untested) of files (commits, deps, added, removed, untested); the most are null of no file."""
    lines = F.coalesce(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))), F.lit(0))
    return scored.agg(F.count("*").alias("files"), F.max("commits").alias("most_changes"), F.max("deps").alias("most_deps"), lines.alias("lines"), F.count(F.when(F.col("untested"), 1)).alias("untested"))
