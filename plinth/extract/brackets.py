"""Places in text: tokens with code-point offsets, brackets paired by running depth, and what encloses a place.

A text is read once, by one pattern: the gaps between matches and the matches
themselves become rows, and their summed lengths are the offsets. Comments and
string literals are matches of their own, so no bracket or mark in them counts.
Brackets of a kind that stand at one depth alternate between opening and
closing, so a bracket's partner is its neighbour among those of its depth.
Nothing walks a text from each bracket, so the work grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, and literals with escapes; a template literal counts whole, with what its holes hold.
COMMENTS = r"//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
LITERALS = r"""'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+"|`(?:[^`\\]++|\\[\s\S])*+`"""
BRACKETS = r"[()\[\]{}]"
#: Generics count as brackets in types; the arrow of a function does not close one.
ANGLES = r"=>|[<>]"


def scanned(files: DataFrame, marks: str = "", brackets: str = BRACKETS, passed: str = f"{COMMENTS}|{LITERALS}") -> DataFrame:
    """(path, ord, at, token, gap, role) of every match, in text order; role is mark, bracket, literal or comment.

    at is the code-point offset of the token, gap the text between it and the
    match before. A mark comes before a bracket or a passed stretch that begins
    at the same place; marks begin with no quote. A null text has no rows. path
    must be unique.
    """
    found = "|".join(x for x in (marks, passed, brackets) if x)
    both = F.arrays_zip(F.split("text", found, -1).alias("gap"), F.regexp_extract_all("text", F.lit(found), F.lit(0)).alias("token"))
    rows = files.select("path", F.posexplode(both).alias("ord", "m")).select("path", "ord", "m.token", "m.gap").where("token is not null")
    length = F.length("token")
    at = F.sum(F.length("gap") + length).over(Window.partitionBy("path").orderBy("ord")) - length
    role = F.when(F.col("token").rlike(rf"^(?:{brackets})$"), "bracket").when(F.col("token").rlike("^/[/*]"), "comment").when(F.col("token").rlike("^['\"`]"), "literal").otherwise("mark")
    return rows.select("path", "ord", at.alias("at"), "token", "gap", role.alias("role"))


def kind_and_step(token: Column) -> tuple[Column, Column]:
    """The opening bracket of a token's kind, and 1, -1 or, for what is no bracket, 0."""
    opening, closing = F.array(*map(F.lit, "([{<")), F.array(*map(F.lit, ")]}>"))
    at = F.array_position(closing, token)
    kind = F.when(at > 0, F.element_at(opening, F.when(at > 0, at.cast("int")).otherwise(1))).when(F.array_contains(opening, token), token)
    return kind, F.when(at > 0, -1).when(kind.isNotNull(), 1).otherwise(0)


def levels(tokens: DataFrame) -> DataFrame:
    """tokens (path, at, kind, step) with level: the depth within their kind that an opening one leads to and a closing one ends.

    For step 0 it is the depth that the place has. Closing brackets without an
    opening one lead to depths below zero.
    """
    depth = F.sum("step").over(Window.partitionBy("path", "kind").orderBy("at"))
    return tokens.withColumn("level", depth + F.when(F.col("step") < 0, 1).otherwise(0))


def pairs(tokens: DataFrame) -> DataFrame:
    """(path, kind, level, lo, hi): every bracket that is closed, from its offset to its partner's."""
    side = Window.partitionBy("path", "kind", "level").orderBy("at")
    rows = levels(tokens.where("step <> 0")).withColumns({"hi": F.lead("at").over(side), "then": F.lead("step").over(side)})
    return rows.where("step = 1 and then = -1").select("path", "kind", "level", F.col("at").alias("lo"), "hi")


def enclosing(tokens: DataFrame, kind: str) -> DataFrame:
    """tokens of step 0 with lo and hi of the innermost closed bracket of that kind round them; null where there is none."""
    rows = levels(tokens.where((F.col("step") == 0) | (F.col("kind") == kind)).withColumn("kind", F.lit(kind)))
    # Both ways as a running value: a frame that ends at the last row would be read anew for each row.
    nearest = F.last(F.when(F.col("step") != 0, F.struct("at", "step")), ignorenulls=True)
    back, ahead = (Window.partitionBy("path", "level").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    rows = rows.withColumns({"__last": nearest.over(back), "__next": nearest.over(ahead)}).where("step = 0")
    inside = (F.col("__last.step") == 1) & (F.col("__next.step") == -1)
    return rows.withColumns({"lo": F.when(inside, F.col("__last.at")), "hi": F.when(inside, F.col("__next.at"))}).drop("__last", "__next", "level")


def parents(found: DataFrame) -> DataFrame:
    """pairs() with up: the offset of the innermost pair of the same kind round each, null outermost."""
    up = found.select("path", "kind", (F.col("level") + 1).alias("level"), F.col("lo").alias("up"), F.col("hi").alias("__hi"))
    both = found.withColumn("__own", F.lit(True)).select("path", "kind", "level", F.col("lo").alias("at"), "lo", "hi", "__own")
    above = up.select("path", "kind", "level", F.col("up").alias("at"), F.struct("up", "__hi").alias("__up"))
    side = Window.partitionBy("path", "kind", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.unionByName(above, allowMissingColumns=True).withColumn("__up", F.last("__up", ignorenulls=True).over(side))
    return rows.where("__own").select("path", "kind", "level", "lo", "hi", F.when(F.col("__up.__hi") > F.col("hi"), F.col("__up.up")).alias("up"))


def cut(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (path, id, lo, hi) with their inner text, brackets at lo and hi left out.

    A file's spans go to its text, not the text to each span.
    """
    held = spans.groupBy("path").agg(F.collect_list(F.struct("id", "lo", "hi")).alias("spans"))
    inside = lambda s: F.struct(s["id"].alias("id"), F.substr(F.col("text"), (s["lo"] + 2).cast("int"), (s["hi"] - s["lo"] - 1).cast("int")).alias("inner"))
    return held.join(files.select("path", "text"), "path").select("path", F.explode(F.transform("spans", inside)).alias("s")).select("path", "s.id", "s.inner")


def split_top(rows: DataFrame, id: str = "id", text: str = "inner") -> DataFrame:
    """(id, ord, item): the parts of a text between commas that stand in no bracket, without comments; empty parts are left out. id must be unique."""
    rows = rows.withColumn(text, F.regexp_replace(text, f"({LITERALS})|{COMMENTS}", "$1"))
    tokens = scanned(rows.select(F.col(id).alias("path"), F.col(text).alias("text")), brackets=f"{ANGLES}|{BRACKETS}|,").where("role = 'bracket'")
    step = kind_and_step(F.col("token"))[1]
    depth = F.sum(step).over(Window.partitionBy("path").orderBy("at"))
    commas = tokens.withColumn("depth", depth).where("token = ',' and depth = 0").groupBy("path").agg(F.array_sort(F.collect_list("at")).alias("commas"))
    cutting = rows.select(F.col(id).alias("path"), F.col(text).alias("text")).join(commas, "path", "left").withColumn("commas", F.coalesce("commas", F.array().cast("array<bigint>")))
    starts = F.concat(F.array(F.lit(-1).cast("bigint")), F.col("commas"))
    ends = F.concat(F.col("commas"), F.array(F.length("text").cast("bigint")))
    items = F.zip_with(starts, ends, lambda a, b: F.trim(F.regexp_replace(F.substr(F.col("text"), (a + 2).cast("int"), (b - a - 1).cast("int")), r"\s+", " ")))
    return cutting.select(F.col("path").alias(id), F.posexplode(F.filter(items, lambda x: x != "")).alias("ord", "item"))
