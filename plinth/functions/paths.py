"""Path and text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The non-empty parts of a slash-separated path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def folded(path: Column) -> Column:
    """A path without `.` and `..` parts; what climbs above the root stays at the root."""
    parts = F.aggregate(segments(path), F.array().cast("array<string>"), lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))))
    return F.array_join(parts, "/")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The last part without its extension."""
    return F.regexp_extract(path, "([^/]*?)(\\.[^./]*)?$", 1)


def module_of(path: Column, root: str = "(root)") -> Column:
    """The first folder, or root for a path without one."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(root))


def folder_of(path: Column, extension: str = "\\.tsx?$") -> Column:
    """Up to three levels: short paths fall into `<first>/(root)`, and a file as third part counts with its folder."""
    parts = segments(path)
    two = F.array_join(F.slice(parts, F.lit(1), F.lit(2)), "/")
    return F.when(F.size(parts) <= 2, F.concat(F.get(parts, F.lit(0)), F.lit("/(root)"))).when(F.get(parts, F.lit(2)).rlike(extension), two).otherwise(F.array_join(F.slice(parts, F.lit(1), F.lit(3)), "/"))


def line_count(text: Column) -> Column:
    """Lines as split at newlines: an empty text has one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def singular(name: Column) -> Column:
    """English plural endings off, one rule after the other."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "ies$", "y"), "ses$", "s"), "s$", "")


def plain_name(name: Column) -> Column:
    """A name as it is compared: lower case, letters and digits only, singular."""
    return singular(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits that name a finding: the head of sha1 over its parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)
