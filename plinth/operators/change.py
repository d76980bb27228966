"""Structural comparison of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renamed(rows: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """rows with key moved by renames (old, new); of several renames of a key the smallest counts."""
    once = renames.groupBy("old").agg(F.min("new").alias("__new"))
    return rows.join(once, rows[key] == once["old"], "left").withColumn(key, F.coalesce("__new", key)).drop("old", "__new")


def statuses(base: DataFrame, head: DataFrame, key: str, body: str) -> DataFrame:
    """(key, status): added, removed, edited or unchanged by the body's digest."""
    a = base.select(F.col(key), F.sha2(F.col(body).cast("string"), 256).alias("__a"), F.lit(True).alias("__in_a"))
    b = head.select(F.col(key), F.sha2(F.col(body).cast("string"), 256).alias("__b"), F.lit(True).alias("__in_b"))
    status = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("edited")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def normalised(text: Column) -> Column:
    """Text whose lines have lost their trailing blanks, so that moving a part does not edit it."""
    return F.regexp_replace(text, "(?m)(?<![ \\t\\r])[ \\t\\r]++$", "")


def pair_classes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Calls (src, dst, call) of two snapshots as classes of their pairs.

    A new pair is a rewire (both ends existed), a graft (its source did), an
    attachment (its target did) or territory; a lost one is detached; one in
    both is kept if its calls differ, and not reported otherwise.
    """
    pairs = lambda rows, name: rows.groupBy("src", "dst").agg(F.array_sort(F.collect_set("call")).alias(name))
    ends = base.select(F.col("src").alias("end")).union(base.select("dst")).distinct()
    both = pairs(base, "old").join(pairs(head, "new"), ["src", "dst"], "full_outer")
    known = both.join(ends.select(F.col("end").alias("src"), F.lit(True).alias("__s")), "src", "left").join(ends.select(F.col("end").alias("dst"), F.lit(True).alias("__d")), "dst", "left")
    s, d = F.col("__s").isNotNull(), F.col("__d").isNotNull()
    kind = F.when(F.col("new").isNull(), "detached").when(F.col("old").isNotNull(), "kept").when(s & d, "rewire").when(s, "graft").when(d, "attachment").otherwise("territory")
    none = F.array().cast("array<string>")
    out = known.select("src", "dst", kind.alias("class"), F.array_except(F.coalesce("new", none), F.coalesce("old", none)).alias("new_calls"), F.array_except(F.coalesce("old", none), F.coalesce("new", none)).alias("gone_calls"))
    return out.where((F.col("class") != "kept") | (F.size("new_calls") > 0) | (F.size("gone_calls") > 0))


def breakage(base: DataFrame, head: DataFrame, key: list[str], bad: Column) -> DataFrame:
    """(key, change): broken where the head is bad and the base was not, fixed where it is the other way round.

    Keys that the head lacks are not reported, nor is what was bad already.
    """
    a = base.withColumn("__bad", bad).groupBy(*key).agg(F.max("__bad").alias("__was"))
    b = head.withColumn("__bad", bad).groupBy(*key).agg(F.max("__bad").alias("__is"))
    joined = b.join(a, key, "left")
    change = F.when(F.col("__is") & ~F.coalesce("__was", F.lit(False)), "broken").when(~F.col("__is") & F.coalesce("__was", F.lit(False)), "fixed")
    return joined.select(*key, change.alias("change")).where("change is not null")


def request_drift(calls: DataFrame) -> DataFrame:
    """calls (call_key, sent array, expected map<field, optional>) with extra, missing and status.

    A null on either side is unread, and never a difference.
    """
    extra = F.array_sort(F.array_except("sent", F.map_keys("expected")))
    missing = F.array_sort(F.array_except(F.map_keys(F.map_filter("expected", lambda k, optional: ~optional)), "sent"))
    status = F.when(F.col("sent").isNull() | F.col("expected").isNull(), "unread").when((F.size(extra) > 0) | (F.size(missing) > 0), "differ").otherwise("agree")
    return calls.select("call_key", extra.alias("extra"), missing.alias("missing"), status.alias("status"))


#: A message's shape: fields map a name to whether it is optional; literal tells keys that are sent from fields of a type.
SHAPE = "struct<none:boolean,array:boolean,literal:boolean,open:boolean,fields:map<string,boolean>>"


def _required(shape: Column) -> Column:
    return F.map_keys(F.map_filter(shape["fields"], lambda k, optional: ~optional))


def _verdict(unread: Column, agree: Column, differ: Column, lists: dict[str, Column]) -> list[Column]:
    """status and the lists; these are empty unless the status comes from them."""
    none = F.array().cast("array<string>")
    compared = ~(unread | agree | differ)
    kept = {k: F.when(compared, F.array_sort(v)).otherwise(none) for k, v in lists.items()}
    uneven = F.lit(False)
    for v in kept.values():
        uneven = uneven | (F.size(v) > 0)
    status = F.when(unread, "unread").when(agree, "agree").when(differ | uneven, "differ").otherwise("agree")
    return [status.alias("status"), *[v.alias(k) for k, v in kept.items()]]


def _is(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def request_contracts(calls: DataFrame) -> DataFrame:
    """(call_key, status, extra, missing, optional) of what a call sends (sent) and its endpoint reads (dto), both a SHAPE.

    extra is sent and not read, missing is required and not sent, optional is
    required and may be left out by the sender's type. A null shape or an array
    is unread; an open shape has no extra or missing fields.
    """
    sent, dto = F.col("sent"), F.col("dto")
    no_body, no_read = _is(sent["none"]), _is(dto["none"])
    unread = sent.isNull() | dto.isNull() | ~(no_body | no_read) & (_is(sent["array"]) | _is(dto["array"])) | (no_body & ~no_read & _is(dto["array"]))
    keys = F.when(no_body, F.array().cast("array<string>")).otherwise(F.map_keys(sent["fields"]))
    none = F.array().cast("array<string>")
    lists = {
        "extra": F.when(_is(dto["open"]), none).otherwise(F.array_except(keys, F.map_keys(dto["fields"]))),
        "missing": F.when(_is(sent["open"]), none).otherwise(F.array_except(_required(dto), keys)),
        "optional": F.when(_is(sent["literal"]) | no_body, none).otherwise(F.filter(_required(dto), lambda k: _is(F.element_at(sent["fields"], k)))),
    }
    return calls.select("call_key", *_verdict(unread, ~unread & no_body & no_read, ~unread & ~no_body & no_read, lists))


def response_contracts(calls: DataFrame) -> DataFrame:
    """(call_key, status, missing) of what a call expects back (expects) and its handler returns (returns), both a SHAPE.

    missing is required by the caller and not declared; fields that the caller
    ignores are no difference. Null shapes, or fields, are unread.
    """
    e, r = F.col("expects"), F.col("returns")
    known = e.isNotNull() & r.isNotNull()
    agree = known & _is(e["none"])
    uneven = known & ~_is(e["none"]) & (_is(r["none"]) | (_is(e["array"]) != _is(r["array"])))
    unread = ~known | ~agree & ~uneven & (e["fields"].isNull() | r["fields"].isNull())
    missing = F.when(_is(r["open"]), F.array().cast("array<string>")).otherwise(F.array_except(_required(e), F.map_keys(r["fields"])))
    return calls.select("call_key", *_verdict(unread, agree, uneven, {"missing": missing}))


def frames(base: DataFrame, later: DataFrame, key: str, body: str) -> DataFrame:
    """(frame, key, status) of what each frame of later (frame, key, body) changes against the base (key, body), not against the frame before."""
    digest = F.sha2(F.col(body).cast("string"), 256)
    old = base.select(F.col(key), digest.alias("__a"), F.lit(True).alias("__in_a"))
    new = later.select("frame", F.col(key), digest.alias("__b"))
    met = new.join(old, key, "left").where("__in_a is null or not (__a <=> __b)").select("frame", key, F.when(F.col("__in_a").isNull(), "added").otherwise("edited").alias("status"))
    # A frame that lacks a base key has removed it; a key lists the frames that have it, of a history's few.
    kind = dict(later.dtypes)["frame"]
    every = F.array(*[F.lit(r.frame) for r in later.select("frame").distinct().collect()]).cast(f"array<{kind}>")
    held = later.groupBy(key).agg(F.collect_set("frame").alias("__has"))
    lost = old.select(key).distinct().join(held, key, "left").select(F.explode(F.array_except(every, F.coalesce("__has", F.array().cast(f"array<{kind}>")))).alias("frame"), key)
    return met.unionByName(lost.withColumn("status", F.lit("removed")))


def port_pairs(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """(src, dst, calls): calls (src, dst, call) as pairs, and those to a port (port, cls) from the port on to its class."""
    direct = calls.select("src", "dst", "call")
    through = calls.join(bindings.select(F.col("port").alias("dst"), "cls").distinct(), "dst").select(F.col("dst").alias("src"), F.col("cls").alias("dst"), "call")
    return direct.union(through).groupBy("src", "dst").agg(F.array_sort(F.collect_set("call")).alias("calls"))


def summary(classed: DataFrame) -> DataFrame:
    """(class, brick, n, n_calls, calls): pairs by class and the existing brick they hang on.

    Grafts hang on their source, attachments on their target; other classes on
    their source. In order of class, most pairs, most new calls, brick.
    """
    brick = F.when(F.col("class") == "attachment", F.col("dst")).otherwise(F.col("src"))
    grouped = classed.groupBy("class", brick.alias("brick")).agg(F.count("*").alias("n"), F.sum(F.size("new_calls")).alias("n_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("new_calls")))).alias("calls"))
    return grouped.orderBy("class", F.desc("n"), F.desc("n_calls"), "brick")


def endpoint_delta(base: DataFrame, head: DataFrame, calls_base: DataFrame, calls_head: DataFrame) -> DataFrame:
    """(endpoint_id, change, callers): endpoints that came or went, with the callers that reach or reached them.

    Calls are rows (caller, endpoint_id).
    """
    came = head.select("endpoint_id").distinct().join(base.select("endpoint_id"), "endpoint_id", "left_anti").withColumn("change", F.lit("added"))
    went = base.select("endpoint_id").distinct().join(head.select("endpoint_id"), "endpoint_id", "left_anti").withColumn("change", F.lit("removed"))
    callers = calls_head.withColumn("change", F.lit("added")).unionByName(calls_base.withColumn("change", F.lit("removed"))).groupBy("endpoint_id", "change").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    return came.unionByName(went).join(callers, ["endpoint_id", "change"], "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))


def new_drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """Contracts (call_key, status, extra, missing) that differ at the head and not in the same way at the base."""
    same = base.where("status = 'differ'").select("call_key", F.to_json(F.struct("extra", "missing")).alias("__was"))
    rows = head.where("status = 'differ'").withColumn("__is", F.to_json(F.struct("extra", "missing")))
    return rows.join(same, "call_key", "left").where("__was is null or __was <> __is").drop("__was", "__is")


def violation_delta(added: DataFrame, fixed: DataFrame, renames: DataFrame, changed: DataFrame) -> DataFrame:
    """added (fingerprint, rule, src, dst) without what a rename explains, with in_diff.

    A finding whose ends, moved by renames (old, new), equal a fixed one's is
    the same finding. in_diff tells whether an end is among the changed paths.
    """
    moved = renamed(renamed(fixed.select("rule", "src", "dst"), renames, "src"), renames, "dst").distinct()
    left = added.join(moved, ["rule", "src", "dst"], "left_anti")
    paths = changed.select("path").distinct()
    touched = left.join(paths.select(F.col("path").alias("src")), "src", "left_semi").select("fingerprint").union(left.join(paths.select(F.col("path").alias("dst")), "dst", "left_semi").select("fingerprint")).distinct().withColumn("in_diff", F.lit(True))
    return left.join(touched, "fingerprint", "left").withColumn("in_diff", F.coalesce("in_diff", F.lit(False)))
