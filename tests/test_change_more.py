"""Summaries, endpoint and drift deltas, rename folding, placement."""

from plinth.operators import change, placement, rules


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_summary_and_deltas(spark):
    make = lambda x: spark.createDataFrame(x, "src string, dst string, call string")
    classed = change.pair_classes(make([("a", "b", "m")]), make([("a", "b", "m"), ("a", "n", "x"), ("a", "o", "y"), ("n", "b", "z")]))
    assert rows(change.summary(classed), "class", "brick", "n", "calls") == [("attachment", "b", 1, ["z"]), ("graft", "a", 2, ["x", "y"])]
    ends = lambda x: spark.createDataFrame([(i,) for i in x], "endpoint_id string")
    calls = lambda x: spark.createDataFrame(x, "caller string, endpoint_id string")
    delta = change.endpoint_delta(ends("pq"), ends("qr"), calls([("c", "p"), ("c", "q")]), calls([("d", "r"), ("c", "r")]))
    assert rows(delta, "endpoint_id", "change", "callers") == [("p", "removed", ["c"]), ("r", "added", ["c", "d"])]


def test_drift_that_was_there_is_not_new(spark):
    make = lambda x: spark.createDataFrame(x, "call_key int, status string, extra array<string>, missing array<string>")
    base = make([(1, "differ", ["a"], []), (2, "agree", [], []), (3, "differ", ["a"], [])])
    head = make([(1, "differ", ["a"], []), (2, "differ", [], ["b"]), (3, "differ", ["c"], []), (4, "unread", None, None)])
    assert rows(change.new_drift(base, head), "call_key") == [(2,), (3,)]


def test_renames_explain_findings(spark):
    make = lambda x: rules.violations(spark.createDataFrame(x, "rule string, src string, dst string"))
    delta = change.violation_delta(make([("r", "new", "b"), ("r", "c", "d")]), make([("r", "old", "b")]), spark.createDataFrame([("old", "new")], "old string, new string"), spark.createDataFrame([("d",)], "path string"))
    assert rows(delta, "src", "dst", "in_diff") == [("c", "d", True)]


def test_placement(spark):
    """Own folders by the station's stem, none for a module's root, the next one up for the station itself; a deeper root still counts."""
    listed = [("m/card/card.tsx", "component"), ("m/card/parts/x.ts", "util"), ("m/card/parts/deep/y.css.ts", "style"), ("m/card/parts/list/list.tsx", "component"), ("m/a.tsx", "component"), ("m/b.tsx", "component"), ("m/u.ts", "util"), ("m/t.spec.ts", "spec"), ("m/ca/card2.tsx", "component"), ("m/ca/z.ts", "util")]
    files = spark.createDataFrame([(p, k, "m") for p, k in listed] + [("n/n.service.ts", "component", "n"), ("n/v.ts", "util", "n"), ("a/n/n.ts", "component", "a/n"), ("a/n/w.ts", "util", "a/n")], "path string, pattern string, module string")
    edges = spark.createDataFrame([("m/a.tsx", "m/u.ts"), ("m/b.tsx", "m/u.ts"), ("m/u.ts", "m/u.ts"), ("m/t.spec.ts", "m/a.tsx"), ("m/a.tsx", "m/b.tsx")], "src string, dst string")
    got = {r.path: (r.kind, r.owner, r.users) for r in placement.placements(files, edges, ["component"], ["style"], ["spec"]).collect()}
    assert got == {
        "m/card/card.tsx": ("anchored", None, []), "m/card/parts/x.ts": ("cohesive", "m/card/card.tsx", []), "m/card/parts/deep/y.css.ts": ("owned", "m/card/card.tsx", []), "m/card/parts/list/list.tsx": ("anchored", "m/card/card.tsx", []),
        "m/a.tsx": ("anchored", None, []), "m/b.tsx": ("anchored", None, ["m/a.tsx"]), "m/u.ts": ("cohesive", None, ["m/a.tsx", "m/b.tsx"]), "m/ca/card2.tsx": ("anchored", None, []), "m/ca/z.ts": ("cohesive", None, []),
        "n/n.service.ts": ("anchored", None, []), "n/v.ts": ("cohesive", None, []), "a/n/n.ts": ("anchored", None, []), "a/n/w.ts": ("cohesive", None, []),
    }
