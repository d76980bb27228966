"""Rescans as a stream: one edited file of many is read again, and the tables are those of a full run."""

import os

from plinth.extract import imports as X
from plinth.sources.tree import read_tree
from plinth.streaming import rescan, watch


def test_one_edit_is_one_read(spark, tmp_path):
    root, home, events = tmp_path / "src", str(tmp_path / "home"), tmp_path / "events"
    (root / "deep").mkdir(parents=True)
    events.mkdir()
    for i in range(60):
        (root / ("deep" if i % 2 else ".") / f"f{i}.ts").write_text(f"import './f{i + 1}';\nimport 'react';\n")
    (root / "none.ts").write_text("export {}\n")
    counts, pointer = [], {}

    def recompute(batch, number):
        counts.append(rescan.rescan(spark, str(root), home, X.imports, "src"))
        return home

    def event(n):
        (events / f"{n}.json").write_text('{"path": "any"}\n')
        stream = spark.readStream.schema("path string").json(str(events))
        watch.publish(stream, recompute, pointer, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        full = X.imports(read_tree(spark, str(root)))
        assert sorted(map(tuple, rescan.extracted(spark, home).collect())) == sorted(map(tuple, full.collect()))

    def files():
        return {os.path.join(d, f) for d, _, fs in os.walk(home) for f in fs if f.endswith(".parquet")}

    event(1)
    assert counts[-1] == {"read": 61, "changed": 61, "removed": 0}
    before = files()
    (root / "f4.ts").write_text("import './other';\nimport './more';\n")
    event(2)
    assert counts[-1] == {"read": 1, "changed": 1, "removed": 0} and len(before - files()) == 1
    os.utime(root / "f6.ts", (1, 1))
    (root / "f8.ts").unlink()
    (root / "new.ts").write_text("import './f0';\n")
    event(3)
    assert counts[-1] == {"read": 2, "changed": 1, "removed": 1}
    event(4)
    assert counts[-1] == {"read": 1, "changed": 0, "removed": 0} and pointer["version"] == 4
    assert rescan.held(spark, home).where("path = 'none.ts' and size(rows) = 0").count() == 1
