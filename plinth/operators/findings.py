"""The finding catalogue: rules over file and edge tables, as one table (finding, tone, gate, src, dst)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph

#: Patterns that module graphs and ratios leave out.
NOISE = ("spec", "test-util", "migration", "bootstrap")


def placed(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst) with pattern, module and folder of both ends."""
    ends = files.select("path", "pattern", "module", "folder")
    a, b = (ends.select(F.col("path").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("pattern", "module", "folder")]) for k in ("src", "dst"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def _found(rows: DataFrame, finding: str, tone: str = "warn", gate: bool = True) -> DataFrame:
    return rows.select(F.lit(finding).alias("finding"), F.lit(tone).alias("tone"), F.lit(gate).alias("gate"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()


def cross_domain(edges: DataFrame, gateways: Sequence[str] = (), infra: Sequence[str] = ()) -> DataFrame:
    """Edges between modules whose target is no gateway, noise and infrastructure on either side left out."""
    e = edges.where("src_module <> dst_module").where(~F.col("dst_pattern").isin([*gateways, ""]))
    for side in ("src", "dst"):
        e = e.where(~F.col(f"{side}_pattern").isin([*NOISE, "module"]) & ~F.col(f"{side}_module").isin([*infra, ""]))
    return _found(e, "cross-domain")


def same_level(edges: DataFrame, listed: Sequence[str]) -> DataFrame:
    return _found(edges.where((F.col("src_pattern") == F.col("dst_pattern")) & F.col("src_pattern").isin(list(listed)) & (F.col("src_folder") != F.col("dst_folder"))), "no-same-level")


def upward(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a forbidden pair (from_pattern, to_pattern) names."""
    pairs = rules.select(F.col("from_pattern").alias("src_pattern"), F.col("to_pattern").alias("dst_pattern")).distinct()
    return _found(edges.join(pairs, ["src_pattern", "dst_pattern"], "left_semi"), "no-upward")


def skips(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that skip stations, named by their rule; the tone is the rule's severity."""
    pairs = rules.select("rule", "sev", F.col("from_pattern").alias("src_pattern"), F.col("to_pattern").alias("dst_pattern"))
    return edges.join(pairs, ["src_pattern", "dst_pattern"]).select(F.col("rule").alias("finding"), F.col("sev").alias("tone"), F.lit(True).alias("gate"), "src", "dst").distinct()


def naming(files: DataFrame, tests: Mapping[str, str]) -> DataFrame:
    """Files whose path a named pattern finds."""
    parts = [_found(files.where(F.col("path").rlike(p)).select(F.col("path").alias("src"), F.lit("").alias("dst")), f"naming-{k}") for k, p in tests.items()]
    return reduce(DataFrame.unionByName, parts)


def dead_shims(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path, text) that nobody imports and that hold one re-export of names in braces, nothing else."""
    only = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), ";$", "")
    names, module = F.regexp_extract(only, r"^export\s*\{([^}]*)\}", 0), F.regexp_extract(only, "\\bfrom\\s*([\"'][^\"']+[\"'])$", 0)
    shims = files.where((names != "") & (module != "") & (F.concat(names, module) == F.regexp_replace(only, r"\}\s*from", "}from"))).select(F.col("path").alias("src"))
    return _found(shims.join(edges.select(F.col("dst").alias("src")), "src", "left_anti").withColumn("dst", F.lit("")), "dead-shims")


def mixed_spelling(files: DataFrame, names: Sequence[str] = ("app", "apps")) -> DataFrame:
    """One ungated finding if folders of both spellings exist."""
    held = files.select(F.explode(F.array_intersect(F.split("path", "/"), F.array(*map(F.lit, names)))).alias("src")).distinct()
    both = held.agg(F.countDistinct("src").alias("n")).where(F.col("n") == len(names)).select(F.lit(names[0]).alias("src"), F.lit(names[1]).alias("dst"))
    return _found(both, "app-apps", gate=False)


def circular(edges: DataFrame) -> DataFrame:
    """A finding for each cycle of files: from its first member to the rest, joined by commas."""
    members = graph.components(edges).groupBy("comp").agg(F.array_sort(F.collect_set("node")).alias("m"))
    return _found(members.select(F.get("m", F.lit(0)).alias("src"), F.array_join(F.slice("m", F.lit(2), F.size("m")), ",").alias("dst")), "circular")


def orphaned(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    nodes = files.select(F.col("path").alias("node"))
    return _found(graph.orphans(nodes, edges, roots).select(F.col("node").alias("src"), F.lit("").alias("dst")), "orphans")


def broken_calls(calls: DataFrame, bridged: DataFrame) -> DataFrame:
    """Calls (call_id, path, verb, url) that no endpoint serves, or more than one best: from their file to `VERB url`.

    A call to an endpoint whose controller no module lists is broken too; one
    whose verb or URL could not be read is not.
    """
    lost = bridged.where("status in ('unmatched', 'ambiguous', 'unserved')").select("call_id")
    return _found(calls.join(lost, "call_id").select(F.col("path").alias("src"), F.concat_ws(" ", "verb", "url").alias("dst")), "http-broken")


def _noted(rows: DataFrame, finding: str) -> DataFrame:
    return _found(rows, finding, tone="note", gate=False)


def module_cycles(edges: DataFrame) -> DataFrame:
    """One ungated finding for each cycle of modules (src, dst)."""
    return circular(edges).withColumns({"finding": F.lit("dag"), "gate": F.lit(False)})


def unregistered(controllers: DataFrame, registered: DataFrame) -> DataFrame:
    """Controllers (path, cls) that no module's list (cls) has."""
    return _found(controllers.join(registered.select("cls").distinct(), "cls", "left_anti").select(F.col("path").alias("src"), F.col("cls").alias("dst")), "controller-unregistered")


def implicit_keys(relations: DataFrame) -> DataFrame:
    """Undeclared relations (cls, column, refers_to)."""
    return _noted(relations.select(F.concat_ws(".", "cls", "column").alias("src"), F.col("refers_to").alias("dst")), "implicit-fk")


def hotspots(top: DataFrame, item: str) -> DataFrame:
    return _noted(top.select(F.col(item).alias("src"), F.col("score").alias("dst")), "hotspots")


def coupled(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs (a, b, degree, imports) that change together without an import."""
    return _noted(pairs.where((F.col("degree") >= least) & (F.col("imports") == 0)).select(F.col("a").alias("src"), F.col("b").alias("dst")), "logical-coupling")


def test_ratios(ratios: DataFrame, gate: DataFrame, by: str) -> DataFrame:
    """The ratio of each pattern, if the one row of gate says that tests are reliable."""
    rows = ratios.join(F.broadcast(gate.where("reliable").select("reliable")))
    return _noted(rows.select(F.col(by).alias("src"), F.concat_ws("/", F.col("tested").cast("string"), F.col("total").cast("string")).alias("dst")), "test-ratio")


def untested_risk(top: DataFrame, item: str) -> DataFrame:
    """A warning without a gate for each untested hotspot."""
    return _found(top.select(F.col(item).alias("src"), F.col("score").alias("dst")), "untested-risk", gate=False)


def absent_patterns(absent: DataFrame, pattern: str) -> DataFrame:
    return _noted(absent.select(F.col(pattern).alias("src"), F.lit("").alias("dst")), "absent-patterns")


def contract_drift(contracts: DataFrame) -> DataFrame:
    """Contracts (call_key, status) that differ."""
    return _found(contracts.where("status = 'differ'").select(F.col("call_key").alias("src"), F.lit("").alias("dst")), "contract-drift", gate=False)


def catalogue(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
