"""Plans of the ranking and matching operators, the debounced stream, and what queries don't show."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import history, lookup, match, report
from plinth.streaming import watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_has_no_global_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random() if i % 3 else 0.5) for i in range(3000)]
    got = history.ranked(spark.createDataFrame(rows, "item long, score double"), "item")
    assert "Window" not in plan(got)
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.item: r["rank"] for r in got.collect()} == want
    assert history.ranked(spark.createDataFrame([], "item long, score double"), "item").count() == 0


def test_innermost_against_brute_force(spark):
    rnd = random.Random(2)
    spans = [(rnd.randint(0, 2), lo := rnd.randint(-500, 500), lo + rnd.choice([0, 1, 2, 3, 7, 8, 64, 700]), f"s{k}") for k in range(200)]
    points = [(i, rnd.randint(0, 3), rnd.randint(-600, 1300)) for i in range(400)]
    got = lookup.innermost(spark.createDataFrame(points, "point_id long, by long, at long"), spark.createDataFrame(spans, "by long, lo long, hi long, name string"), "by", "at", "name")
    for r in got.collect():
        held = [(hi - lo, -lo, n) for b, lo, hi, n in spans if b == r.by and lo <= r["at"] < hi]
        assert r.name == (min(held)[2] if held else None)


def score(call, route):
    out = 0
    for a, b in zip(call, route):
        if a == ":" and b == ":" or a == b:
            out += 2
        elif ":" in (a, b):
            out += 1
        else:
            return None
    return out


def test_bridge_against_brute_force(spark):
    rnd = random.Random(3)
    path = lambda holes: [rnd.choice(["a", "b", ":"] if rnd.random() < holes else ["a", "b"]) for _ in range(rnd.choice([0, 1, 2, 3, 7]))]
    routes = [(k, rnd.choice(["GET", "POST", "ALL"]), path(0.6)) for k in range(40)]
    calls = [(i, rnd.choice(["GET", "POST", "ALL", None]), path(0.4) if rnd.random() < 0.95 else None) for i in range(400)]
    found = match.bridge(spark.createDataFrame(calls, "call_id long, verb string, parts array<string>"), spark.createDataFrame(routes, "route_id long, verb string, parts array<string>"))
    for r in found.collect():
        _, verb, parts = calls[r.call_id]
        if verb is None or parts is None:
            assert r.status == "unread"
            continue
        hits = [(s, k) for k, v, p in routes if len(p) == len(parts) and v in (verb, "ALL") and (s := score(parts, p)) is not None]
        best = [k for s, k in hits if s == max(hits)[0]]
        assert (r.n_best, r.score, r.status) == (len(best), max(hits)[0] if hits else None, {0: "unmatched", 1: "matched"}.get(len(best), "ambiguous"))
        assert r.route_id == (best[0] if len(best) == 1 else None)


def test_stream_of_bursts_publishes_and_stops_on_failure(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00"), (9, "2024-01-02 00:00:00")], "key long, at string").withColumn("at", F.to_timestamp("at"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen, pointer = [], {"current": "old"}

    def recompute(batch, number):
        seen.extend((r.key, r.n) for r in batch.collect())
        return f"result {number}"

    def failing(batch, number):
        raise ValueError("no result")

    bursts = watch.debounced(stream, "at", "key", "10 seconds", late="1 minute")
    with pytest.raises(Exception):
        watch.publish(bursts, failing, pointer, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert pointer["current"] == "old" and "no result" in pointer["error"] and not seen
    watch.publish(bursts, recompute, pointer, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(1, 2), (2, 1)] and pointer["current"].startswith("result") and "error" not in pointer


def test_notes_are_kept_or_dropped(spark):
    was = spark.createDataFrame([("a", "why"), ("b", "gone"), ("c", None)], "fingerprint string, note string")
    now = spark.createDataFrame([("a",), ("c",), ("d",)], "fingerprint string")
    assert tuple(report.notes(now, was).first()) == (1, 1)


def shape(**kw):
    return {"none": False, "array": False, "literal": False, "open": False, "fields": {}, **kw}


def test_request_and_response_contracts(spark):
    needs = shape(fields={"a": False, "b": True})
    sent = [shape(fields={"a": False}), shape(literal=True, fields={"a": False, "x": False}), shape(fields={"a": True}), shape(none=True), shape(none=True), shape(fields={"a": False}), None, shape(array=True), shape(open=True), shape(fields={"z": False})]
    reads = [needs, needs, needs, needs, shape(none=True), shape(none=True), needs, needs, needs, shape(open=True, fields={"a": False})]
    from plinth.operators import change

    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(sent, reads))], f"call_key long, sent {change.SHAPE}, dto {change.SHAPE}")
    got = {r.call_key: (r.status, *map(list, (r.extra, r.missing, r.optional))) for r in change.request_contracts(rows).collect()}
    none = ([], [], [])
    assert got == {0: ("agree", *none), 1: ("differ", ["x"], [], []), 2: ("differ", [], [], ["a"]), 3: ("differ", [], ["a"], []), 4: ("agree", *none), 5: ("differ", *none), 6: ("unread", *none), 7: ("unread", *none), 8: ("agree", *none), 9: ("differ", [], ["a"], [])}
    expects = [needs, needs, shape(none=True), needs, needs, None, shape(array=True, fields={"a": False}), needs]
    returns = [shape(fields={"a": True}), shape(fields={"b": False}), None, shape(none=True), shape(array=True, fields={"a": False}), needs, shape(array=True, fields={"a": False}), shape(open=True)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(expects, returns))], f"call_key long, expects {change.SHAPE}, returns {change.SHAPE}")
    got = {r.call_key: (r.status, list(r.missing)) for r in change.response_contracts(rows).collect()}
    assert got == {0: ("agree", []), 1: ("differ", ["a"]), 2: ("unread", []), 3: ("differ", []), 4: ("differ", []), 5: ("unread", []), 6: ("agree", []), 7: ("agree", [])}


def test_model_tables_and_baseline_are_kept(spark, tmp_path):
    from plinth.sources import model

    for snapshot, n in (("001", 1), ("002", 2)):
        model.save({"file": spark.range(n).toDF("path")}, str(tmp_path / "m"), snapshot)
    assert model.load(spark, str(tmp_path / "m"), ["file"], "001")["file"].count() == 1
    assert {r.snapshot_id for r in model.load(spark, str(tmp_path / "m"), ["file"])["file"].collect()} == {"001", "002"}
    now = spark.createDataFrame([("f1", "r", "a", "b"), ("f2", "r", "c", "d")], "fingerprint string, rule string, src string, dst string")
    model.write_baseline(now, str(tmp_path / "b"), spark.createDataFrame([("f1", "known")], "fingerprint string, note string"))
    assert {(r.fingerprint, r.note) for r in model.read_baseline(spark, str(tmp_path / "b")).collect()} == {("f1", "known"), ("f2", None)}


def test_lines_hold_points(spark):
    spans = spark.createDataFrame([("a", 1, 3, "x"), ("a", 3, 5, "y"), ("b", 1, 9, "z")], "path string, first int, last int, name string")
    points = spark.createDataFrame([(1, "a", 3), (2, "b", 9), (3, "b", 10)], "point_id int, path string, line int")
    assert {(r.point_id, r.name) for r in lookup.within_lines(points, spans, "path").collect()} == {(1, "x"), (1, "y"), (2, "z")}
