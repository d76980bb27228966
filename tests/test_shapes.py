"""Shapes by rounds against plain recursion, and the contracts that read them."""

import random

from pyspark.sql import functions as F

from plinth.operators import change
from plinth.operators.shapes import shapes

NODES, CHILDREN, FIELDS = "node long, kind string, open boolean", "parent long, place int, child long", "node long, place int, name string, optional boolean"


def plain(nodes, children, fields, node, depth=0):
    """(none, array, open, fields) by recursion over one node; None if unread."""
    if depth > 8 or node not in nodes:
        return None
    kind, is_open = nodes[node]
    kids = [c for _, c in sorted(children.get(node, []))]
    own = {name: optional for _, name, optional in sorted(fields.get(node, []))}
    down = lambda c: plain(nodes, children, fields, c, depth + 1)
    is_object = lambda s: s is not None and not s[0] and not s[1]
    if kind == "union":
        real = [c for c in kids if c not in nodes or nodes[c][0] != "null"]
        return down(real[0]) if len(real) == 1 else None
    if kind in ("none", "null"):
        return True, False, False, None
    if kind == "object":
        return False, False, is_open, own
    if kind == "array":
        s = down(kids[0]) if kids else None
        return (False, True, s[2], s[3]) if is_object(s) else (False, True, False, None)
    if kind in ("pass", "reference"):
        return down(kids[0]) if kids else None
    if kind == "partial":
        s = down(kids[0]) if kids else None
        return (False, False, s[2], dict.fromkeys(s[3], True)) if is_object(s) else None
    if kind in ("intersection", "record"):
        if kind == "intersection" and not kids:
            return None
        found = [down(c) for c in kids]
        if not all(map(is_object, found)):
            return None
        got = {}
        for s in found:
            got |= s[3]
        return False, False, any(s[2] for s in found) or kind == "record" and is_open, got | (own if kind == "record" else {})
    return None


def made(spark, nodes, children, fields, **more):
    rows = shapes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(children, CHILDREN), spark.createDataFrame(fields, FIELDS), **more).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.shape and (r.shape.none, r.shape.array, r.shape.open, r.shape.fields) for r in rows}


def test_random_graphs_equal_plain_recursion(spark):
    for seed in range(3):
        rng = random.Random(seed)
        kinds = ["object"] * 3 + ["union", "null", "none", "array", "pass", "reference", "partial", "intersection", "record", "record", "generic"]
        nodes = {i: (rng.choice(kinds), rng.random() < 0.2) for i in range(300)}
        children, fields = {}, {}
        for i, (kind, _) in nodes.items():
            n = rng.randint(0, 3) if kind in ("union", "intersection", "record") else rng.random() < 0.95
            # Most point upwards; some anywhere, so that circles and lost nodes occur.
            children[i] = [(p, rng.randint(0, 310) if rng.random() < 0.2 else min(310, i + rng.randint(1, 30))) for p in range(n)]
            fields[i] = [(p, rng.choice("abcdef"), rng.random() < 0.5) for p in range(rng.randint(0, 4))]
        got = made(spark, [(i, *v) for i, v in nodes.items()], [(i, *v) for i, vs in children.items() for v in vs], [(i, *v) for i, vs in fields.items() for v in vs])
        want = {i: plain(nodes, children, fields, i) for i in nodes}
        assert got == want
        assert sum(v is not None and bool(v[3]) for v in want.values()) > 60


def test_long_references_and_circles_are_unread(spark):
    nodes = [(i, "alias", False) for i in range(12)] + [(12, "object", False), (20, "reference", None), (21, "reference", None), (30, "array", None)]
    children = [(i, 0, i + 1) for i in range(12)] + [(20, 0, 21), (21, 0, 20), (30, 0, 30)]
    got = made(spark, nodes, children, [(12, 0, "a", None), (12, 1, None, True)])
    assert [i for i in range(13) if got[i] is None] == [0, 1, 2, 3]
    assert got[4] == (False, False, False, {"a": False}) and got[20] is None and got[21] is None and got[30] == (False, True, False, None)


def test_nulls_repeats_and_empty_tables(spark):
    assert made(spark, [], [], []) == {}
    nodes = [(1, "union", None), (1, "union", None), (2, "object", True), (3, "null", None), (4, None, None), (None, "object", None), (5, "array", None), (6, "record", None), (7, "intersection", None)]
    got = made(spark, nodes, [(1, 0, 2), (1, 0, 2), (1, 1, 3), (None, 0, 1), (4, 0, None)], [(2, 0, "x", True), (2, 1, "x", False), (None, 0, "y", True)])
    assert got == {1: (False, False, True, {"x": False}), 2: (False, False, True, {"x": False}), 3: (True, False, False, None), 4: None, 5: (False, True, False, None), 6: (False, False, False, {}), 7: None}


def test_shapes_feed_the_contracts(spark):
    # Promise<Partial<Note>[]> is expected; Note[] with fewer fields is returned; Note & { extra } is sent where Note is read.
    nodes = [(1, "promise", False), (2, "array", False), (3, "partial", False), (4, "record", False), (5, "array", False), (6, "object", False), (7, "intersection", False), (8, "object", False), (9, "array", False)]
    children = [(1, 0, 2), (2, 0, 3), (3, 0, 4), (5, 0, 6), (7, 0, 4), (7, 1, 8), (9, 0, 4)]
    fields = [(4, 0, "id", False), (4, 1, "text", False), (6, 0, "id", False), (8, 0, "extra", True)]
    found = shapes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(children, CHILDREN), spark.createDataFrame(fields, FIELDS))
    pairs = spark.createDataFrame([("loose", 1, 5), ("strict", 9, 5)], "call_key string, a long, b long")
    joined = pairs.join(found.select(F.col("node").alias("a"), F.col("shape").alias("expects")), "a").join(found.select(F.col("node").alias("b"), F.col("shape").alias("returns")), "b")
    assert {r.call_key: (r.status, r.missing) for r in change.response_contracts(joined).collect()} == {"loose": ("agree", []), "strict": ("differ", ["text"])}
    sent = spark.createDataFrame([("c", 7, 4)], "call_key string, a long, b long").join(found.select(F.col("node").alias("a"), F.col("shape").alias("sent")), "a").join(found.select(F.col("node").alias("b"), F.col("shape").alias("dto")), "b")
    assert [(r.status, r.extra, r.missing) for r in change.request_contracts(sent).collect()] == [("differ", ["extra"], [])]


def test_rounds_of_shapes_sort_and_merge_every_join(spark, monkeypatch):
    from plinth.operators import shapes as operator

    plans, kept = [], operator.written
    monkeypatch.setattr(operator, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    nodes = spark.createDataFrame([("a", "object", False), ("b", "reference", False), ("c", "array", False)], "node string, kind string, open boolean")
    children = spark.createDataFrame([("b", 0, "a"), ("c", 0, "b")], "parent string, place int, child string")
    found = operator.shapes(nodes, children, spark.createDataFrame([("a", 0, "x", False)], "node string, place int, name string, optional boolean"))
    assert {r.node: r["shape"]["fields"] for r in found.collect()} == {x: {"x": False} for x in "abc"}
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_without_a_depth_all_levels_are_read(spark):
    rng = random.Random(5)
    nodes, children, fields = {}, {}, {}
    for line in range(6):
        # Each line of 30 types ends in an object, and its merges have a second part.
        for i in range(line * 100, line * 100 + 30):
            kind = rng.choice(["pass", "reference", "partial", "record", "record", "intersection", "union"] + ["array"] * (line == 5))
            nodes[i], children[i] = (kind, rng.random() < 0.1), [(0, i + 1)]
            nodes[i + 50], fields[i + 50] = ("null" if kind == "union" else "object", False), [(0, f"part{i % 4}", rng.random() < 0.5)]
            if kind in ("record", "intersection", "union"):
                children[i].append((rng.randint(0, 1), i + 50))
            fields[i] = [(p, rng.choice("abcdef"), rng.random() < 0.5) for p in range(2)]
        nodes[line * 100 + 30], fields[line * 100 + 30] = ("object", line == 1), [(0, "end", False)]
    tables = [(i, *v) for i, v in nodes.items()], [(i, *v) for i, vs in children.items() for v in vs], [(i, *v) for i, vs in fields.items() for v in vs]
    got = made(spark, *tables, depth=None)
    assert got == {i: plain(nodes, children, fields, i, -100) for i in nodes}
    assert all("end" in got[line * 100][3] for line in range(5))
    assert made(spark, *tables, depth=3) == {i: plain(nodes, children, fields, i, 5) for i in nodes}


def test_without_a_depth_circles_and_what_leads_there_are_unread(spark, monkeypatch):
    from plinth.operators import shapes as operator

    monkeypatch.setattr(operator, "ROUNDS_KEPT", 2)
    # 1 and 2 refer to each other, 3 to 1; 4 merges itself, 5 merges 4; 6 is an array of 3, 7 refers to 6; 8 merges what is in no table.
    kinds = {1: "reference", 2: "reference", 3: "partial", 4: "intersection", 5: "record", 6: "array", 7: "alias", 8: "record", 9: "array"}
    children = [(1, 0, 2), (2, 0, 1), (3, 0, 1), (4, 0, 4), (4, 1, 20), (5, 0, 4), (6, 0, 3), (7, 0, 6), (8, 0, 99), (9, 0, 26)]
    records = [(i, 0, i - 1) for i in range(21, 27)]
    nodes = [(i, k, False) for i, k in kinds.items()] + [(20, "object", False)] + [(i, "record", i == 23) for i, _, _ in records]
    got = made(spark, nodes, children + records, [(i, 0, f"f{i}", i % 2 == 0) for i in range(20, 27)], depth=None)
    unread_array = (False, True, False, None)
    assert {i: got[i] for i in range(1, 9)} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: unread_array, 7: unread_array, 8: None}
    assert got[26] == (False, False, True, {f"f{i}": i % 2 == 0 for i in range(20, 27)}) and got[9] == (False, True, *got[26][2:])
