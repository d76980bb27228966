"""Where files belong: users, single owners, and folders of one file's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.paths import directory


def own_folders(files: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """(folder, owner): folders with exactly one anchored file, its station, whose name begins with the station's stem.

    files has path, pattern and module, the module's root folder; a file is
    anchored if its pattern is in anchors. A module's root is nobody's own. The
    stem is the file's name up to its first dot.
    """
    rows = files.where(F.col("pattern").isin(list(anchors))).select(directory(F.col("path")).alias("folder"), "path", "module")
    single = rows.groupBy("folder").agg(F.count("*").alias("n"), F.min("path").alias("owner"), F.min("module").alias("module")).where("n = 1 and folder <> '' and not (folder <=> module)")
    name = F.element_at(F.split("folder", "/"), -1)
    return single.where(name.startswith(F.substring_index(F.element_at(F.split("owner", "/"), -1), ".", 1))).select("folder", "owner")


def users(edges: DataFrame, files: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """(path, users): the other files that import each, without those of ignored patterns."""
    kept = files.where(~F.col("pattern").isin(list(ignored))).select(F.col("path").alias("src"))
    return edges.where("src <> dst").join(kept, "src", "left_semi").groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("users"))


def placements(files: DataFrame, edges: DataFrame, anchors: Sequence[str], owned: Sequence[str] = (), ignored: Sequence[str] = ()) -> DataFrame:
    """(path, kind, owner, users) of the files whose pattern is not ignored.

    kind is anchored, owned or cohesive by the pattern. The owner is the station
    whose own folder holds the file, the nearest first; a station's own folder
    does not own the station itself, so it looks further up.
    """
    kind = F.when(F.col("pattern").isin(list(anchors)), "anchored").when(F.col("pattern").isin(list(owned)), "owned").otherwise("cohesive")
    rows = files.where(~F.col("pattern").isin(list(ignored))).select("path", kind.alias("kind"))
    own = own_folders(files, anchors)
    ups = rows.join(own.select(F.col("owner").alias("path"), F.col("folder").alias("own")), "path", "left")
    parts = F.split(directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = ups.select("path", "own", F.posexplode(above).alias("depth", "folder")).where("not (folder <=> own)")
    nearest = asked.join(own, "folder").groupBy("path").agg(F.max_by("owner", "depth").alias("owner"))
    out = rows.join(nearest, "path", "left").join(users(edges, files, ignored), "path", "left")
    return out.select("path", "kind", "owner", F.coalesce("users", F.array().cast("array<string>")).alias("users"))
