"""The difference report: what a change reaches, what it risks, and what it breaks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.paths import fingerprint
from plinth.operators import change, graph, rules, sets
from plinth.operators.graph import merged
from plinth.operators.rollup import percent


def blast(base: DataFrame, head: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): what depends on the seeds (node) at the base or at the head, by the least depth, without the seeds."""
    reached = sets.union_least([graph.blast_radius(base, seeds), graph.blast_radius(head, seeds)], "node", "depth")
    return reached.join(merged(seeds.select("node").distinct()), "node", "left_anti")


@dataclass(frozen=True)
class Snapshot:
    """One end of a difference: files (path), edges (src, dst), endpoints (endpoint_id, path) and the files that they call, traced (endpoint_id, path)."""

    files: DataFrame
    edges: DataFrame
    endpoints: DataFrame
    traced: DataFrame


def file_counts(changes: DataFrame) -> DataFrame:
    """One row (total, added, modified, deleted, renamed) of changes (status, path, old_path); copies count as modified."""
    n = lambda *kinds: F.count(F.when(F.col("status").isin(*kinds), 1)).alias(kinds[0])
    return changes.agg(F.count("*").alias("total"), n("added"), n("modified", "copied"), n("deleted"), n("renamed"))


def changed_paths(changes: DataFrame) -> DataFrame:
    """(node) of every path that changes name, old ones too."""
    return changes.select(F.col("path").alias("node")).union(changes.select("old_path")).where("node is not null").distinct()


def blast_of(changes: DataFrame, base: Snapshot, head: Snapshot) -> DataFrame:
    """(node, depth) of what depends on the changed files, without these, by the least depth.

    A file is looked for where it exists: at the head by its path; at the base
    if it was deleted, or by the path it was renamed or copied from.
    """
    here = changes.select(F.col("path").alias("node")).join(merged(head.files.select(F.col("path").alias("node"))), "node", "left_semi")
    gone = changes.where("status = 'deleted'").select(F.col("path").alias("node")).union(changes.where("status in ('renamed', 'copied')").select("old_path"))
    gone = gone.join(merged(base.files.select(F.col("path").alias("node"))), "node", "left_semi")
    reached = sets.union_least([graph.blast_radius(head.edges, here), graph.blast_radius(base.edges, gone)], "node", "depth")
    return reached.join(merged(changed_paths(changes)), "node", "left_anti")


def endpoint_effects(changes: DataFrame, base: Snapshot, head: Snapshot) -> DataFrame:
    """(endpoint_id, effect, via): endpoints of the head that own or call a changed file, those files, and the endpoints of deleted files."""
    files = head.endpoints.select("endpoint_id", "path").union(head.traced.select("endpoint_id", "path").join(merged(head.endpoints.select("endpoint_id")), "endpoint_id", "left_semi"))
    met = files.join(merged(changed_paths(changes).withColumnRenamed("node", "path")), "path").groupBy("endpoint_id").agg(F.array_sort(F.collect_set("path")).alias("via"))
    lost = base.endpoints.join(merged(changes.where("status = 'deleted'").select("path")), "path", "left_semi").groupBy("endpoint_id").agg(F.array_sort(F.collect_set("path")).alias("via"))
    return met.select("endpoint_id", F.lit("affected").alias("effect"), "via").union(lost.select("endpoint_id", F.lit("removed"), "via"))


def difference(changes: DataFrame, base: Snapshot, head: Snapshot, found: tuple[DataFrame, DataFrame] | None = None, risk: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> Mapping[str, DataFrame]:
    """The report of changes (status, path, old_path) between two snapshots, as tables.

    Always: `summary`, one row of file_counts, scope and the numbers of affected
    and removed endpoints; `blast`; `endpoints`, of endpoint_effects. With found,
    the findings (fingerprint, rule, src, dst) of baseline and head: `added`,
    of change.violation_delta, and `fixed`. With risk, what `risks` takes after
    the changed nodes: `risks`.
    """
    reached, effects = graph.settled(blast_of(changes, base, head)), graph.settled(endpoint_effects(changes, base, head))
    n = lambda kind: F.count(F.when(F.col("effect") == kind, 1)).alias(kind)
    counts = effects.agg(n("affected"), n("removed"))
    # Each side of these joins is one row.
    out = {"summary": file_counts(changes).join(F.broadcast(scope(reached, head.files).withColumnRenamed("total", "tree"))).join(F.broadcast(counts.withColumnRenamed("removed", "endpoints_removed").withColumnRenamed("affected", "endpoints_affected"))), "blast": reached, "endpoints": effects}
    if found is not None:
        compared = rules.ratchet(*found)
        moves = changes.where("status = 'renamed'").select(F.col("old_path").alias("old"), F.col("path").alias("new"))
        added, fixed = (compared.where(F.col("status") == x).drop("status") for x in ("added", "fixed"))
        out["added"] = change.violation_delta(added, fixed, moves, changed_paths(changes).withColumnRenamed("node", "path"))
        moved = change.renamed(change.renamed(fixed, moves, "src"), moves, "dst")
        out["fixed"] = moved.join(added.select("rule", "src", "dst").distinct(), ["rule", "src", "dst"], "left_anti").select("fingerprint").join(fixed, "fingerprint")
    if risk is not None:
        out["risks"] = risks(changed_paths(changes), *risk)
    return out


def scope(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (direct, transitive, total, pct) of reached (node, depth) among all nodes."""
    sizes = nodes.agg(F.count("*").alias("total"))
    hit = reached.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count("*").alias("transitive"))
    return hit.join(F.broadcast(sizes)).withColumn("pct", percent(F.col("transitive"), F.col("total")))  # one row each


def risks(changed: DataFrame, ranked: DataFrame, pairs: DataFrame, tested: DataFrame, reliable: DataFrame) -> DataFrame:
    """(node, rank, missing, untested) of changed nodes that carry a risk.

    rank is that among hotspots (node, rank); missing has the partners of
    co-change pairs (a, b) that did not change with the node; untested holds
    where no test claims it and the one row of `reliable` says that tests can be
    trusted.
    """
    rows = changed.select("node").distinct()
    one = sets.one_sided(pairs, rows)
    near = F.when(F.col("a_changed"), F.col("a")).otherwise(F.col("b"))
    far = F.when(F.col("a_changed"), F.col("b")).otherwise(F.col("a"))
    missing = one.select(near.alias("node"), far.alias("other")).groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("missing"))
    out = rows.join(ranked.select("node", "rank"), "node", "left").join(missing, "node", "left")
    out = out.join(tested.select("node").distinct().withColumn("__tested", F.lit(True)), "node", "left").join(F.broadcast(reliable.select("reliable")))
    untested = F.col("reliable") & F.col("__tested").isNull()
    return out.select("node", "rank", F.size(F.coalesce("missing", F.array())).alias("missing"), untested.alias("untested")).where("rank is not null or missing > 0 or untested")


def violations(found: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(fingerprint, rule, src, dst, sev) of the gated warnings of a catalogue.

    Findings (finding, tone, gate, src, dst) count if their tone is warn or crit,
    their gate holds and they name a place. Equal fingerprints are one; sev is
    that of the skip rule (rule, sev) of the name, else warn.
    """
    rows = gated(found).select(F.col("finding").alias("rule"), "src", "dst").distinct()
    rows = rows.join(rules.select("rule", "sev").dropDuplicates(["rule"]), "rule", "left") if rules is not None else rows.withColumn("sev", F.lit(None).cast("string"))
    return rows.select(fingerprint(F.col("rule"), F.col("src"), F.col("dst")).alias("fingerprint"), "rule", "src", "dst", F.coalesce("sev", F.lit("warn")).alias("sev"))


def gated(found: DataFrame) -> DataFrame:
    return found.where("tone in ('warn', 'crit') and gate and src is not null")


def ungated(found: DataFrame) -> DataFrame:
    """(finding, n): warnings that no gate looks at."""
    return found.where("tone in ('warn', 'crit') and not (gate and src is not null)").groupBy("finding").agg(F.count("*").alias("n"))


def notes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(kept, dropped): how many notes of the previous baseline (fingerprint, note) the current findings take on."""
    noted = previous.where("note is not null").select("fingerprint").distinct().join(current.select("fingerprint").distinct().withColumn("__in", F.lit(True)), "fingerprint", "left")
    return noted.agg(F.count("__in").alias("kept"), (F.count("*") - F.count("__in")).alias("dropped"))


def parts(base: DataFrame, head: DataFrame) -> DataFrame:
    """(brick, part, status) of the parts of bricks that both snapshots (brick, part, body) have, without the unchanged."""
    both = base.select("brick").distinct().join(head.select("brick").distinct(), "brick")
    keyed = lambda rows: rows.join(both, "brick", "left_semi").select(F.struct("brick", "part").alias("k"), "body")
    found = change.statuses(keyed(base), keyed(head), "k", "body").where("status <> 'unchanged'")
    return found.select("k.brick", "k.part", "status")


def across(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """(src, dst, call): matched calls (brick, endpoint_id, call) as pairs of the frontend's and the backend's bricks."""
    rows = calls.join(handlers.select("endpoint_id", F.col("brick").alias("__to")), "endpoint_id")
    return rows.select(F.concat(F.lit("fe:"), "brick").alias("src"), F.concat(F.lit("be:"), "__to").alias("dst"), "call")
