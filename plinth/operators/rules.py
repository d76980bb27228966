"""Layering rules, violations, and the ratchet over their fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.paths import fingerprint


def skip_rules(spark: SparkSession, flow: Sequence[str]) -> DataFrame:
    """(rule, from_pattern, to_pattern, jump, sev) for every pair of stations that skips one or more between."""
    stations = spark.createDataFrame(list(enumerate(flow)), "i int, station string")
    a, b = stations.alias("a"), stations.alias("b")
    jump = F.col("b.i") - F.col("a.i") - 1
    pairs = a.join(b, F.col("b.i") >= F.col("a.i") + 2)  # a handful of stations
    return pairs.select(F.concat_ws(">", "a.station", "b.station").alias("rule"), F.col("a.station").alias("from_pattern"), F.col("b.station").alias("to_pattern"), jump.alias("jump"), F.when(jump >= 2, "crit").otherwise("warn").alias("sev"))


def stations(spark: SparkSession, flow: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(pattern, idx): the place in the flow of each station and of the patterns that stand for one."""
    place = {p: i for i, p in enumerate(flow)}
    rows = [*place.items(), *((a, place[p]) for a, p in (aliases or {}).items() if p in place and a not in place)]
    return spark.createDataFrame(rows, "pattern string, idx int")


def skip_tags(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (…, from_pattern, to_pattern) that skip stations, with jump and sev; aliases count as their station.

    Unlike findings of skip_rules(), which name patterns literally.
    """
    side = lambda k: F.broadcast(known.select(F.col("pattern").alias(f"{k}_pattern"), F.col("idx").alias(f"__{k}")))  # noqa: E731  # a row per pattern
    rows = edges.join(side("from"), "from_pattern").join(side("to"), "to_pattern").withColumn("jump", F.col("__to") - F.col("__from") - 1)
    return rows.where("jump >= 1").withColumn("sev", F.when(F.col("jump") >= 2, "crit").otherwise("warn")).drop("__from", "__to")


def severities(nodes: DataFrame, tagged: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (node) with severity: the worst of their out-links (src, sev), else flagged if a finding (src) names them, else none."""
    worst = tagged.groupBy(F.col("src").alias("node")).agg(F.max((F.col("sev") == "crit").cast("int")).alias("__crit"))
    flagged = found.select(F.col("src").alias("node")).distinct().withColumn("__flag", F.lit(True))
    out = nodes.join(worst, "node", "left").join(flagged, "node", "left")
    return out.select(*nodes.columns, F.when(F.col("__crit") == 1, "crit").when(F.col("__crit") == 0, "warn").when(F.col("__flag"), "flagged").otherwise("none").alias("severity"))


def expand_rules(spark: SparkSession, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(rule, from_pattern, to_pattern) of rules whose ends are lists."""
    rows = spark.createDataFrame([(r, list(a), list(b)) for r, a, b in rules], "rule string, f array<string>, t array<string>")
    return rows.select("rule", F.explode("f").alias("from_pattern"), "t").select("rule", "from_pattern", F.explode("t").alias("to_pattern")).distinct()


def rule_hits(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (…, from_pattern, to_pattern) that a rule names, one row for each edge and rule.

    The rule table is joined on the pattern pair, so it is a hash join whatever
    the number of rules.
    """
    return edges.join(rules, ["from_pattern", "to_pattern"])


def violations(hits: DataFrame, rule: str = "rule", source: str = "src", target: str = "dst") -> DataFrame:
    """(fingerprint, rule, src, dst): one row for each distinct finding."""
    keys = hits.select(F.col(rule).alias("rule"), F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst")).distinct()
    return keys.select(fingerprint(F.col("rule"), F.col("src"), F.col("dst")).alias("fingerprint"), "rule", "src", "dst")


def ratchet(baseline: DataFrame, current: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """(fingerprint, rule, src, dst, status): added, fixed or unchanged against the baseline.

    A list of rules limits what counts as added; fixed and unchanged rows are
    never limited.
    """
    old = baseline.select("fingerprint", "rule", "src", "dst")
    new = current.select("fingerprint", "rule", "src", "dst")
    added = new.join(old, "fingerprint", "left_anti").withColumn("status", F.lit("added"))
    if rules is not None:
        added = added.where(F.col("rule").isin(list(rules)))
    fixed = old.join(new, "fingerprint", "left_anti").withColumn("status", F.lit("fixed"))
    same = new.join(old, "fingerprint", "left_semi").withColumn("status", F.lit("unchanged"))
    return added.unionByName(fixed).unionByName(same)


def gate(compared: DataFrame, allow_new: int = 0) -> bool:
    """Whether no more findings than allowed are new."""
    return compared.where("status = 'added'").count() <= allow_new


def keep_notes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The next baseline: current findings with the notes that were written before."""
    return current.join(previous.select("fingerprint", "note").dropDuplicates(["fingerprint"]), "fingerprint", "left")
