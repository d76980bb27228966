"""Hand-computed cases and properties of the operators."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import paths
from plinth.operators import change, classify, graph, history, lookup, match, rules, sets, trace

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_four_stations_give_three_skip_rules(spark):
    assert rows(rules.skip_rules(spark, "abcd"), "rule", "jump", "sev") == [("a>c", 1, "warn"), ("a>d", 2, "crit"), ("b>d", 1, "warn")]


def test_fingerprint(spark):
    assert spark.range(1).select(paths.fingerprint(F.lit("a"), F.lit("b"), F.lit("c"))).first()[0] == "c74a3276c7e3" == hashlib.sha1(b"a|b|c").hexdigest()[:12]


def test_components_ignore_self_loops_and_bridges(spark):
    found = graph.components(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "x"), ("c", "x"), ("a", "b")]))
    assert rows(found) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def brute_components(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    while True:
        new = {n: reach[n] | {d for s, d in pairs if s in reach[n]} for n in nodes}
        if new == reach:
            break
        reach = new
    comps = {n: {m for m in nodes if m in reach[n] and n in reach[m]} for n in nodes}
    return sorted((n, min(c)) for n, c in comps.items() if len(c) > 1)


@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=14))
@QUIET
def test_components_against_mutual_reach(spark, pairs):
    assert rows(graph.components(edges(spark, pairs))) == brute_components(pairs)


def test_blast_radius_drops_the_seed(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert rows(graph.blast_radius(e, spark.createDataFrame([("d",)], "node string"))) == [("a", 3), ("b", 2), ("c", 1)]


def test_orphans_and_no_roots(spark):
    e = edges(spark, [("r", "a"), ("b", "c")])
    nodes = spark.createDataFrame([(x,) for x in "rabc"], "node string")
    assert rows(graph.orphans(nodes, e, nodes.where("node = 'r'"))) == [("b",), ("c",)]
    assert graph.orphans(nodes, e, nodes.limit(0)).count() == 0


def test_trace_is_depth_first_and_stalls(spark):
    calls = spark.createDataFrame([("s", 0, "a"), ("a", 0, "b"), ("b", 0, "c"), ("s", 1, "c"), ("c", 0, "s"), ("c", 1, "d")], "src string, ord int, dst string")
    starts = spark.createDataFrame([(1, "s"), (2, "zz")], "start int, node string")
    assert rows(trace.traces(starts, calls, max_depth=2)) == [(1, 0, 1, "a", False), (1, 1, 2, "b", False), (1, 2, 3, "c", True)]
    assert [r[:4] for r in rows(trace.traces(starts, calls))] == [(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 3, "c"), (1, 3, 4, "d")]


def test_cochange_degree_and_cap(spark):
    history_rows = [(f"c{i}", x) for i in range(5) for x in "ab"] + [("c5", "a"), ("c6", "b")] + [("big", x) for x in "abcdefgh"]
    found = history.cochange(spark.createDataFrame(history_rows, "sha string, path string"), "sha", "path", max_items=5, min_changes=5, min_degree=0.3)
    assert rows(found) == [("a", "b", 5, 6, 6, 0.714, 0.833, 0.833)]
    linked = history.explained(found, spark.createDataFrame([("b", "a")], "src string, dst string"))
    assert rows(linked, "imports") == [(1,)]


def test_pairs_within_modules_are_those_of_all_their_edges(spark):
    places = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 2), ("d", None), ("e", None), ("f", 3), (None, 1)], "item string, module int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "a"), ("d", "e"), ("a", "x"), ("x", "y"), ("b", "f")], "a string, b string")
    src, dst = places.withColumnRenamed("item", "src"), places.withColumnRenamed("item", "dst")
    want = rows(history.explained(pairs, src.join(dst, "module").where("src <> dst")))
    got = history.explained_within(pairs, places)
    assert rows(got) == want and [r[:2] for r in want if r[2]] == [("a", "b"), ("b", "c")]
    assert dict(got.dtypes)["imports"] == "int"


@pytest.mark.parametrize("name", ["q14b_explained", "q62_findings"])
def test_no_query_joins_all_suppliers_of_a_nation(spark, sf, name):
    from plinth.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "s_nationkey" in plan and not re.search(r"Join .*s_nationkey#\d+ = s_nationkey#\d+", plan)


def test_rows_weighed_at_once_are_hotspots(spark):
    li = spark.createDataFrame([("i", "s"), ("i", "s"), ("i", "t"), ("j", "s"), ("j", None), ("k", None)], "item string, src string")
    want = history.hotspots(li.groupBy("item").agg(F.count("*").alias("commits")), history.fan_in(li, "src", "item"), "item")
    got = history.weighed(li, "item", "src")
    assert rows(got) == rows(want) == [("i", 3, 2, 9), ("j", 2, 1, 4), ("k", 1, 0, 1)]
    assert got.dtypes == want.dtypes


def test_rank_equals_a_global_window(spark):
    scored = spark.createDataFrame([(f"i{k}", 7 - k % 4) for k in range(20)], "item string, score int")
    want = sorted((k, i + 1) for i, (_, k) in enumerate(sorted((-s, k) for k, s in map(tuple, scored.collect()))))
    assert rows(history.ranked(scored, "item"), "item", "rank") == want


def test_churn_of_binary_marks(spark):
    c = spark.createDataFrame([("f", "x", 1, "3", "-"), ("f", "y", 2, "-", "4"), ("f", "x", 3, "1", "1")], "path string, author string, at int, a string, r string")
    assert rows(history.churn(c, "path", "author", "at", F.col("a"), F.col("r"))) == [("f", 3, 4, 5, 1, 3, 2)]


def test_bridge_scores_and_ties(spark):
    routes = spark.createDataFrame([(1, "GET", "a/:id"), (2, "GET", "a/b"), (3, "ALL", ":x/c"), (4, "GET", "a/c"), (5, "POST", "a/c")], "route_id int, verb string, p string").select("route_id", "verb", match.url_segments(F.col("p")).alias("parts"))
    calls = spark.createDataFrame([(1, "GET", "/api/a/b?x=1"), (2, "GET", "a/${id}"), (3, "PUT", "z/c#h"), (4, "GET", "q"), (5, None, "a/b"), (6, "GET", None), (7, "GET", "a/c")], "call_id int, verb string, p string").select("call_id", "verb", F.when(F.col("p").isNotNull(), match.url_segments(F.col("p"), "api")).alias("parts"))
    found = match.bridge(calls, routes)
    assert [tuple(r) for r in found.orderBy("call_id").collect()] == [(1, 4, 1, 2, "matched"), (2, 4, 1, 1, "matched"), (3, 3, 1, 3, "matched"), (4, None, 0, None, "unmatched"), (5, None, 0, None, "unread"), (6, None, 0, None, "unread"), (7, 4, 1, 4, "matched")]
    assert rows(match.unreached(routes, found), "route_id") == [(5,)]
    tie = spark.createDataFrame([(1, "GET", ["a", ":"]), (2, "GET", [":", "b"])], "route_id int, verb string, parts array<string>")
    asked = spark.createDataFrame([(1, "GET", ["a", "b"])], "call_id int, verb string, parts array<string>")
    assert rows(match.bridge(asked, tie), "n_best", "status") == [(2, "ambiguous")]


def test_ratchet_parts_and_self_compare(spark):
    make = lambda pairs: rules.violations(spark.createDataFrame([("r", a, b) for a, b in pairs], "rule string, src string, dst string"))
    old, new = make([("a", "b"), ("c", "d"), ("c", "d")]), make([("c", "d"), ("e", "f")])
    assert rows(rules.ratchet(old, new), "src", "status") == [("a", "fixed"), ("c", "unchanged"), ("e", "added")]
    assert rows(rules.ratchet(old, new, rules=["other"]), "src", "status") == [("a", "fixed"), ("c", "unchanged")]
    assert not rules.gate(rules.ratchet(old, new)) and rules.gate(rules.ratchet(old, new), 1) and rules.gate(rules.ratchet(old, old))


def test_rule_hits_keep_occurrences(spark):
    e = spark.createDataFrame([("x", "y")] * 2 + [("y", "x")], "from_pattern string, to_pattern string")
    assert rules.rule_hits(e, rules.expand_rules(spark, [("r", ["x", "x"], ["y", "z"])])).count() == 2


def test_classify_is_ordered_and_checks_tiers(spark):
    df = spark.createDataFrame([("a.spec.ts",), ("b.ts",), (None,)], "path string")
    kinds = [classify.Rule("spec", 2, r"\.spec\.ts$"), classify.Rule("ts", 1, r"\.ts$")]
    assert [r.pattern for r in classify.classify(df, kinds, "path").collect()] == ["spec", "ts", "other"]
    with pytest.raises(ValueError):
        classify.classify(df, kinds, "path", tiers=[1])
    assert rows(classify.suffix_hint(df.where("path is not null"), "path")) == [(".ts", 2)]


def test_resolution_by_priority(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a/index.ts",), ("lib/b/index.ts",)], "path string")
    imports = spark.createDataFrame([("src/x.ts", "./a"), ("src/d/y.ts", "../../lib/./b"), ("src/x.ts", "react")], "src string, spec string")
    assert [tuple(r) for r in lookup.resolve(imports, files, ["", ".ts", "/index.ts"]).orderBy("spec").collect()] == [("src/d/y.ts", "../../lib/./b", "lib/b/index.ts", 2), ("src/x.ts", "./a", "src/a.ts", 1), ("src/x.ts", "react", None, None)]


def test_spans_owners_and_specs(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 5)], "point_id int, path string, at int")
    spans = spark.createDataFrame([("f", 0, 10, "outer"), ("f", 4, 8, "inner"), ("f", 5, 5, "empty")], "path string, lo int, hi int, name string")
    assert rows(lookup.innermost(points, spans, "path", "at", "name").fillna("-"), "point_id", "name") == [(1, "inner"), (2, "-"), (3, "-")]
    assert rows(lookup.uncovered(points, spans, "path", "at"), "point_id") == [(2,), (3,)]
    src = spark.createDataFrame([("a/b.ts",), ("a/c.ts",)], "path string")
    specs = spark.createDataFrame([("a/b.spec.ts",), ("test/c.ts",)], "path string")
    names = [F.regexp_replace("path", "\\.ts$", ".spec.ts"), F.concat(F.lit("test/"), paths.stem(F.col("path")), F.lit(".ts"))]
    assert rows(lookup.tests_of(src, specs, names)) == [("a/b.ts", "a/b.spec.ts", 0), ("a/c.ts", "test/c.ts", 1)]


def test_change_classes(spark):
    make = lambda x: spark.createDataFrame(x, "src string, dst string, call string")
    base = make([("a", "b", "m"), ("c", "d", "m"), ("e", "f", "m")])
    head = make([("a", "b", "n"), ("e", "f", "m"), ("a", "d", "m"), ("a", "new", "m"), ("new", "b", "m"), ("new", "new2", "m")])
    assert rows(change.pair_classes(base, head), "src", "dst", "class") == [("a", "b", "kept"), ("a", "d", "rewire"), ("a", "new", "graft"), ("c", "d", "detached"), ("new", "b", "attachment"), ("new", "new2", "territory")]
    assert change.pair_classes(base, base).count() == 0
    moved = change.renamed(base, spark.createDataFrame([("a", "z")], "old string, new string"), "src")
    assert rows(moved, "src") == [("c",), ("e",), ("z",)]


def test_statuses_of_nulls_and_trailing_blanks(spark):
    make = lambda x: spark.createDataFrame(x, "k string, body string").withColumn("body", change.normalised(F.col("body")))
    found = change.statuses(make([("a", "x  \ny"), ("b", None), ("c", "1"), ("d", "1")]), make([("a", "x\ny "), ("b", None), ("c", "2"), ("e", "1")]), "k", "body")
    assert rows(found) == [("a", "unchanged"), ("b", "unchanged"), ("c", "edited"), ("d", "removed"), ("e", "added")]


def test_drift_of_unread_sides(spark):
    calls = spark.createDataFrame([(1, ["a", "x"], {"a": False, "b": False, "c": True}), (2, None, {"a": False}), (3, ["a"], {"a": True})], "call_key int, sent array<string>, expected map<string,boolean>")
    assert [tuple(r) for r in change.request_drift(calls).orderBy("call_key").collect()] == [(1, ["x"], ["b"], "differ"), (2, None, None, "unread"), (3, [], [], "agree")]


def test_binding_states(spark):
    tokens = spark.createDataFrame([("A",), ("B",), ("C",)], "token string")
    b = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "x"), ("B", "y")], "token string, impl string")
    assert rows(lookup.bind(tokens, b), "token", "n", "status") == [("A", 1, "bound"), ("B", 2, "ambiguous"), ("C", 0, "unbound")]


def test_paths(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(paths.folded(F.lit("/a/./b/../c/../../../d"))) == "d"
    assert [f(paths.folder_of(F.lit(x))) for x in ("a", "a/b.ts", "a/b/c.ts", "a/b/c/d.ts")] == ["a/(root)", "a/(root)", "a/b", "a/b/c"]
    assert [f(paths.line_count(F.lit(x))) for x in ("", "a", "a\n", "\n\n")] == [1, 1, 2, 3]
    assert [f(paths.singular(F.lit(x))) for x in ("entities", "buses", "users", "class")] == ["entity", "bu", "user", "clas"]


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 3)], "k int, v int"), spark.createDataFrame([(1, 2)], "k int, v int")
    assert rows(sets.union_least([a, b], "k", "v")) == [(1, 2), (2, 3)]


def test_no_cartesian_products(spark):
    e = edges(spark, [("a", "b")])
    plan = lookup.resolve(e.select("src", F.col("dst").alias("spec")), e.select(F.col("src").alias("path")), ["", ".ts"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
