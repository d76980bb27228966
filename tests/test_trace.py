"""Traces against a plain depth-first walk, and what hops and stalls say."""

import random

from plinth.operators import graph
from plinth.operators import trace as T


def walk(graph, root, cap):
    out, seen = [], {root}

    def step(node, depth):
        for _, dst in sorted(graph.get(node, ())):
            if dst not in seen:
                seen.add(dst)
                out.append((len(out), depth, dst, depth > cap))
                if depth <= cap:
                    step(dst, depth + 1)

    step(root, 1)
    return out


def test_traces_equal_a_depth_first_walk(spark):
    """Cycles, shared nodes, repeated and self calls, ties, and nodes first met beyond the cap."""
    r = random.Random(11)
    calls, starts, want = [], [], []
    for g in range(40):
        n = r.randint(2, 14)
        graph = {}
        for _ in range(r.randint(1, 3 * n)):
            a, b = f"{g}n{r.randrange(n)}", f"{g}n{r.randrange(n)}"
            graph.setdefault(a, []).append((r.randint(0, 4), b))
            calls.append((a, graph[a][-1][0], b))
        for k in range(min(n, 3)):
            starts.append((g * 10 + k, f"{g}n{k}"))
            want += [(g * 10 + k, *x) for x in walk(graph, f"{g}n{k}", 3)]
    got = T.traces(spark.createDataFrame(starts, "start int, node string"), spark.createDataFrame([*calls, *calls[:9], (None, 1, "x"), ("0n0", 1, None)], "src string, ord int, dst string"), max_depth=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_numbers_of_large_groups(spark):
    rows = spark.range(5000).selectExpr("id % 7 = 0 as g", "cast(id * 7919 % 5000 as int) as x")
    got = {(r.g, r.x): r.ord for r in T.numbered(rows, "g", rows.x.asc()).collect()}
    for g in (True, False):
        assert [v for _, v in sorted((k[1], v) for k, v in got.items() if k[0] == g)] == list(range(sum(k[0] == g for k in got)))


INJECTIONS = "file string, prop string, type string, dst string, bound_to string, token string, bound_in string"
RESULT = ("start", "ord", "depth", "file", "method", "prop", "via_port", "via_field", "inferred")


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_hops_cross_ports_and_fields_and_stalls_are_told(spark):
    calls = table(
        spark, "file string, method string, ord int, prop string, callee string",
        ("ctl", "get", 0, "svc", "find"), ("ctl", "get", 1, "svc", "find"), ("ctl", "get", 2, "lost", "x"), ("ctl", "get", 3, "cache", "read"), ("ctl", "get", 4, "lib", "go"), ("ctl", "get", 5, "odd", "go"), ("ctl", "get", 6, "free", "go"),
        ("svc", "find", 0, "repo", "load"), ("svc", "find", 1, "ext", "call"), ("impl", "load", 0, "svc", "find"), ("port2", "ask", 0, "a", "b"),
    )
    injections = table(spark, INJECTIONS, ("ctl", "svc", "Svc", "svc", None, None, None), ("svc", "repo", "Repo", "port", "impl", "REPO", "m.module"), ("svc", "ext", "Ext", None, None, None, None), ("impl", "svc", "Svc", "svc", None, None, None), ("idle", "b", "B", "svc", None, None, None), ("idle", "e", "E", "entity", None, None, None), ("idle", "p", "P", "port", "impl", "REPO", "m.module"), ("alone", "q", "Q", "port", None, None, None), ("ctl2", "q", "Q", "port", None, None, None))
    fields = table(spark, "file string, prop string, state string, dst string", ("ctl", "cache", "follow", "cache"), ("ctl", "lib", "external", None), ("ctl", "odd", "unknown", None))
    more = table(spark, "file string, method string, ord int, prop string, callee string", ("ctl2", "ask", 0, "q", "run"))
    resolved = T.targets(calls.unionByName(more), injections, fields)
    assert {(r.file, r.prop, r.reason) for r in resolved.where("reason is not null").collect()} == {("ctl", "lost", "dep-not-injected"), ("ctl", "odd", "field-unknown"), ("ctl", "free", "dep-not-injected"), ("port2", "a", "dep-not-injected")}
    starts = table(spark, "start string, file string, method string", ("GET /", "ctl", "get"), ("GET /idle", "idle", "none"), ("GET /q", "ctl2", "ask"), ("GET /void", "void", "x"))
    data = table(spark, "file string", ("entity",))
    found = T.hops(starts, resolved, injections, data)
    assert sorted(map(tuple, found.select(*RESULT).collect())) == [
        ("GET /", 0, 1, "svc", "find", "svc", None, False, False), ("GET /", 1, 2, "impl", "load", "repo", "Repo", False, False), ("GET /", 2, 1, "cache", "read", "cache", None, True, False),
        ("GET /idle", 0, 1, "svc", None, "b", None, False, True), ("GET /idle", 1, 1, "impl", None, "p", "P", False, True), ("GET /q", 0, 1, "port", "run", "q", None, False, False),
    ]
    assert {(r.token, r.bound_in) for r in found.where("via_port is not null").collect()} == {("REPO", "m.module")}
    bodies = table(spark, "file string, method string", ("ctl", "get"), ("svc", "find"), ("impl", "load"), ("ctl2", "ask"))
    ports = table(spark, "file string", ("port",))
    told = {tuple(r) for r in T.stalls(starts, found, resolved, bodies, ports).collect()}
    assert told == {("cache", "read", "body-not-found", 1), ("idle", "none", "body-not-found", 0), ("void", "x", "body-not-found", 0), ("ctl", "get", "dep-not-injected", 0), ("ctl", "get", "field-unknown", 0)}
    short = T.hops(starts.where("file = 'ctl'"), resolved, injections, data, max_depth=1)
    assert [r.file for r in short.orderBy("ord").collect()] == ["svc", "impl", "cache"]
    assert ("impl", "load", "depth-cap", 2) in {tuple(r) for r in T.stalls(starts.where("file = 'ctl'"), short, resolved, bodies, ports, 1).collect()}


def plain_components(pairs):
    """Components by mutual reachability, each node's reach walked anew."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    far = {n: reached(n) for n in {x for p in pairs for x in p}}
    groups = {n: {m for m in far[n] if n in far[m]} | {n} for n in far}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


def test_components_of_contracted_graphs(spark, monkeypatch):
    """Rings, chains between components, chains back to their head, two chains between one pair, tails and random graphs."""
    monkeypatch.setattr(graph, "CONTRACTED_FROM", 1)
    r = random.Random(5)
    fixed = [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 12), (12, 20), (20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 20), (50, 50), (60, 61), (61, 62), (62, 63), (70, 71), (71, 72), (72, 70), (70, 73), (73, 74), (74, 70)]
    for extra in ([], [(24, 1)], *[[(r.randrange(100, 118), r.randrange(100, 118)) for _ in range(k)] for k in (20,)]):
        pairs = fixed + extra
        got = graph.components(spark.createDataFrame([*pairs, (None, 1), (1, None)], "src int, dst int"))
        assert {tuple(x) for x in got.collect()} == plain_components(pairs)


def test_reach_beyond_the_plain_rounds(spark, monkeypatch):
    """Least depths over chains with side branches, shortcuts and cycles, and a cap inside a chain."""
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", 2)
    r = random.Random(8)
    for _ in range(3):
        pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(100, 101), (101, 100)]
        after, depth, todo = {}, {0: 0}, [0]
        for a, b in pairs:
            after.setdefault(a, []).append(b)
        for n in todo:
            for m in after.get(n, ()):
                if m not in depth:
                    depth[m] = depth[n] + 1
                    todo.append(m)
        edges, seeds = spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(0,)], "node int")
        assert {tuple(x) for x in graph.reach(edges, seeds).collect()} == set(depth.items())
        assert {tuple(x) for x in graph.reach(edges, seeds, max_depth=9).collect()} == {x for x in depth.items() if x[1] <= 9}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, keep = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (rounds.append(1), keep(df))[1])
    monkeypatch.setattr(graph, "written", lambda df, keep=graph.written: (rounds.append(1), keep(df))[1])
    edges = spark.range(10_000).selectExpr("id as src", "id + 1 as dst")
    got = graph.reach(edges, spark.createDataFrame([(0,)], "node long"))
    assert got.selectExpr("count(*) as n", "max(depth) as d", "sum(depth - node) as wrong").first() == (10_001, 10_000, 0) and len(rounds) < 40
    rounds.clear()
    assert graph.components(edges).count() == 0 and len(rounds) < 40
    rounds.clear()
    ring = edges.union(spark.createDataFrame([(10_000, 0)], "src long, dst long"))
    assert graph.components(ring).selectExpr("count(*)", "max(comp)").first() == (10_001, 0) and len(rounds) < 40


def _fixpoint(root, calls, cap):
    """Paths by whole rounds over all nodes, as the definition has them."""
    now = {root: ()}
    while True:
        new = {root: ()}
        for src, ordinal, dst in calls:
            if src in now and len(now[src]) <= cap and dst != root:
                path = (*now[src], (ordinal, dst))
                new[dst] = min(new.get(dst, path), path)
        if new == now:
            return new
        now = new


def test_paths_of_random_graphs_with_nodes_that_move_and_are_lost(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(60):
        calls = {(f"{g}.{rng.randrange(9)}", rng.randrange(4), f"{g}.{rng.randrange(9)}") for _ in range(20)}
        rows += calls
        want |= {(g, node): path for node, path in _fixpoint(f"{g}.0", calls, 2).items() if path}
    starts = spark.createDataFrame([(g, f"{g}.0") for g in range(60)], "start int, node string")
    found = T.paths(starts, spark.createDataFrame(rows, "src string, ord int, dst string"), 2).collect()
    assert {(r.start, r.node): tuple((c.ord, c.dst) for c in r.path) for r in found} == want
    assert len(found) == len(want)


def test_rounds_follow_the_calls_of_moved_nodes_alone(spark, monkeypatch):
    sizes = []
    for name in ("settled", "written"):
        kept = getattr(T, name, None)
        if kept:
            monkeypatch.setattr(T, name, lambda df, kept=kept: (out := kept(df), sizes.append(out.count()))[0])
    calls = spark.createDataFrame([(str(i), 0, str(i + 1)) for i in range(12)], "src string, ord int, dst string")
    assert T.paths(spark.createDataFrame([(1, "0")], "start int, node string"), calls, 20).count() == 12
    assert sum(sizes) < 60  # whole rounds write 12 * 13 / 2 paths and more
