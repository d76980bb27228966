"""The composed difference report and the counters on small fixtures."""

from plinth.operators import change, match, report, rollup

CHANGES = "status string, path string, old_path string"


def snapshot(spark, files, edges, endpoints, traced=()):
    two = lambda rows, names: spark.createDataFrame(list(rows), names)
    return report.Snapshot(two([(x,) for x in files], "path string"), two(edges, "src string, dst string"), two(endpoints, "endpoint_id string, path string"), two(traced, "endpoint_id string, path string"))


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_difference(spark):
    # base: top > mid > old, top > gone, far > gone; head: old is now new, gone is deleted, plus is added.
    base = snapshot(spark, ["top", "mid", "old", "gone", "far"], [("top", "mid"), ("mid", "old"), ("top", "gone"), ("far", "gone")], [("GET /gone", "gone"), ("GET /top", "top")])
    head = snapshot(spark, ["top", "mid", "new", "far", "plus", "side"], [("top", "mid"), ("mid", "new"), ("side", "plus")], [("GET /top", "top"), ("GET /far", "far"), ("GET /plus", "plus")], [("GET /top", "mid"), ("GET /top", "new"), ("GET /far", "top"), ("GET /lost", "new")])
    changes = spark.createDataFrame([("renamed", "new", "old"), ("deleted", "gone", None), ("added", "plus", None)], CHANGES)
    kinds = "fingerprint string, rule string, src string, dst string"
    known = spark.createDataFrame([("1", "skip", "old", "far"), ("2", "up", "gone", "far"), ("3", "same", "top", "far")], kinds)
    now = spark.createDataFrame([("4", "skip", "new", "far"), ("5", "up", "plus", "top"), ("6", "up", "top", "far"), ("3", "same", "top", "far")], kinds)
    risk = (spark.createDataFrame([("new", 1), ("far", 2)], "node string, rank int"), spark.createDataFrame([("gone", "far"), ("new", "plus")], "a string, b string"), spark.createDataFrame([("new",)], "node string"), spark.createDataFrame([(False,)], "reliable boolean"))
    out = report.difference(changes, base, head, (known, now), risk)
    assert rows(out["blast"], "node", "depth") == [("far", 1), ("mid", 1), ("side", 1), ("top", 1)]
    assert out["summary"].first().asDict() == {"total": 3, "added": 1, "modified": 0, "deleted": 1, "renamed": 1, "direct": 4, "transitive": 4, "tree": 6, "pct": 66.7, "endpoints_affected": 2, "endpoints_removed": 1}
    assert rows(out["endpoints"], "endpoint_id", "effect", "via") == [("GET /gone", "removed", ["gone"]), ("GET /plus", "affected", ["plus"]), ("GET /top", "affected", ["new"])]
    assert rows(out["added"], "fingerprint", "in_diff") == [("5", True), ("6", False)]
    assert rows(out["fixed"], "fingerprint") == [("2",)]
    assert rows(out["risks"], "node", "rank", "missing", "untested") == [("gone", None, 1, False), ("new", 1, 0, False)]


def test_nothing_changed(spark):
    side = snapshot(spark, [], [], [])
    out = report.difference(spark.createDataFrame([], CHANGES), side, side)
    assert set(out) == {"summary", "blast", "endpoints"} and out["summary"].first().total == 0
    assert out["summary"].first().transitive == 0 and out["blast"].count() == 0 and out["endpoints"].count() == 0


def test_summary_in_order(spark):
    pairs = spark.createDataFrame([("a", "x", "graft", ["1"]), ("b", "y", "graft", ["2", "3"]), ("b", "z", "graft", ["2"]), ("c", "q", "attachment", ["1"]), ("c", "p", "attachment", ["1", "2"])], "src string, dst string, class string, new_calls array<string>")
    got = [tuple(r) for r in change.summary(pairs).collect()]
    assert got == [("attachment", "p", 1, 2, ["1", "2"]), ("attachment", "q", 1, 1, ["1"]), ("graft", "b", 2, 3, ["2", "3"]), ("graft", "a", 1, 1, ["1"])]


def test_handlers_and_counters(spark):
    studs = spark.createDataFrame([("f", "C", "get"), ("f", "C", "own"), ("g", "C", "get")], "path string, cls string, method string")
    served = spark.createDataFrame([("f", "C", "get", "GET", "/b"), ("f", "C", "get", "GET", "/a"), ("f", "D", "own", "GET", "/c")], "path string, cls string, handler string, verb string, route string")
    assert rows(match.routed(studs, served), "path", "method", "routes") == [("f", "get", ["GET /a", "GET /b"]), ("f", "own", []), ("g", "get", [])]
    one = lambda values, name: spark.createDataFrame([(x,) for x in values], f"{name} string")
    assert tuple(rollup.grip_counts(one(["brick", "route", "unseen", "unseen"], "grip")).first()) == (4, 1, 1, 0, 2)
    assert tuple(rollup.socket_counts(one(["resolved", "port", "framework", "unresolved", None], "status")).first()) == (5, 3, 1, 1, 1)
    entities = spark.createDataFrame([("notes", ["a", "b"]), (None, ["c"]), ("x", None)], "tbl string, columns array<string>")
    relations = spark.createDataFrame([(True, True), (False, None), (None, True)], "declared boolean, crossing boolean")
    assert tuple(rollup.data_model(entities, relations).first()) == (3, 3, 1, 2, 2, 1)
    scored = spark.createDataFrame([(3, 1, 10, None, True), (5, 0, 1, 2, False)], "commits int, deps int, added int, removed int, untested boolean")
    assert tuple(rollup.totals(scored).first()) == (2, 5, 1, 13, 1)
    assert tuple(rollup.totals(scored.limit(0)).first()) == (0, None, None, 0, 0)


def test_rounds_of_a_search_send_no_table_through_the_driver(spark, monkeypatch):
    from plinth.operators import graph

    plans, kept = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (kept(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 30)], "src long, dst long")
    found = graph.reach(edges, spark.createDataFrame([(0,)], "node long"), reverse=True)
    assert {(r.node, r.depth) for r in found.collect()} == {(i, i.bit_length()) for i in range(30)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
