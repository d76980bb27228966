"""Pieces of TypeScript's grammar as patterns without recursion: arguments, decorators, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Za-z_$][\w$]*"
#: An argument list with two levels of brackets within; plain stretches are taken at once.
ARGUMENTS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
DECORATOR = rf"@{NAME}(?:\.{NAME})*+\s*+(?:{ARGUMENTS})?+\s*+"
MODIFIERS = r"(?:(?:public|private|protected|static|declare|override|readonly|abstract|async)\s++)*+"


def literal(arguments: Column, key: str) -> Column:
    """The text literal that an argument list begins with, or that its object has under key; null where there is neither."""
    quoted = "[\"'`]([^\"'`]*)[\"'`]"
    first = F.regexp_extract(arguments, rf"^\(?\s*{quoted}", 1)
    named = F.regexp_extract(arguments, rf"[{{,]\s*{key}\s*:\s*{quoted}", 1)
    return F.when(arguments.rlike(rf"^\(?\s*{quoted}"), first).when(arguments.rlike(rf"[{{,]\s*{key}\s*:\s*{quoted}"), named)


def decorators(text: Column) -> Column:
    """array<struct<marks, name, mark, type>> of decorated members with a type: all their decorators, name, `?` or `!`, and the type up to its end."""
    pattern = F.lit(rf"((?:{DECORATOR})++){MODIFIERS}({NAME})\s*+([?!]?+)\s*+:\s*+([^;=]++)")
    return F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(n) for k, n in enumerate(("marks", "name", "mark", "type"), 1)])


def arguments_of(text: Column, name: str) -> Column:
    """The argument list of the first decorator of that name, with its brackets; empty where there is none."""
    return F.regexp_extract(text, rf"@{name}\s*+({ARGUMENTS})", 1)
