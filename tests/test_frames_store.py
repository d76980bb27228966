"""Built trees with a clean and a conflicting commit; a store that reads unchanged sides once."""

import os
import subprocess

import pytest

from plinth.extract import imports as X
from plinth.operators import change
from plinth.sources import git as G
from plinth.sources import store
from plinth.sources.tree import read_tree


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """base; a: edits one.ts; b: edits the same line again; c: adds new.ts and renames two.ts."""
    top, shas = tmp_path_factory.mktemp("frames"), {}

    def commit(name):
        for a in (("add", "-A"), ("commit", "-qm", f"change {name}")):
            subprocess.run(["git", "-C", str(top), "-c", "user.name=Ann", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
        shas[name] = G.git(str(top), "rev-parse", "HEAD").decode().strip()

    subprocess.run(["git", "init", "-q", "-b", "main", str(top)], check=True)
    for i in range(4):
        (top / f"same{i}.ts").write_text(f"const x = {i};\n")
    (top / "one.ts").write_text("start\nmiddle\nend\n")
    (top / "two.ts").write_text("".join(f"line {i}\n" for i in range(20)))
    commit("base")
    (top / "one.ts").write_text("start\nmiddle a\nend\n")
    commit("a")
    (top / "one.ts").write_text("start\nmiddle a b\nend\n")
    commit("b")
    (top / "new.ts").write_text("new é\n")
    (top / "two.ts").rename(top / "deux.ts")
    commit("c")
    return str(top), shas


def frame(spark, repo, base, *commits, **more):
    G.register(spark)
    return spark.read.format("git_frame").options(repo=repo, base=base, apply=" ".join(commits), files="2", **more).load()


def test_frames_are_built_without_touching_the_repository(spark, repo):
    top, sha = repo
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs)
    got = {r.path: r for r in frame(spark, top, sha["base"], sha["c"]).collect()}
    assert set(got) == {"same0.ts", "same1.ts", "same2.ts", "same3.ts", "one.ts", "new.ts", "deux.ts"}
    assert got["new.ts"].text == "new é\n" and got["one.ts"].text == "start\nmiddle\nend\n"
    assert got["deux.ts"].old_path == "two.ts" and got["new.ts"].old_path is None
    # All commits in order are the head's tree; blobs have the names that git gives them.
    head = {(r.path, r.sha, r.text) for r in spark.read.format("git_tree").options(repo=top).load().collect()}
    assert {(r.path, r.sha, r.text) for r in frame(spark, top, sha["base"], sha["a"], sha["b"], sha["c"]).collect()} == head
    assert {(r.path, r.sha, r.text) for r in frame(spark, top, sha["a"], sha["b"], sha["c"], ignore="^same").collect()} == {r for r in head if not r[0].startswith("same")}
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs) == before


def test_a_first_commit_and_no_commit(spark, repo):
    top, sha = repo
    assert frame(spark, top, G.NOTHING, sha["base"]).count() == 6
    assert frame(spark, top, sha["base"]).count() == 6


def test_a_commit_that_needs_another_is_refused_by_name(spark, repo):
    top, sha = repo
    with pytest.raises(Exception, match=f"{sha['b'][:7]} change b does not apply"):
        frame(spark, top, sha["base"], sha["b"], sha["c"]).collect()


def test_frames_against_their_base(spark, repo):
    top, sha = repo
    G.register(spark)
    base = spark.read.format("git_tree").options(repo=top, ref=sha["base"]).load().select("path", "text")
    later = G.frames(spark, top, sha["base"], {"a": [sha["a"]], "ac": [sha["a"], sha["c"]]})
    got = {(r.frame, r.path, r.status) for r in change.frames(base, later.select("frame", "path", "text"), "path", "text").collect()}
    assert got == {("a", "one.ts", "edited"), ("ac", "one.ts", "edited"), ("ac", "new.ts", "added"), ("ac", "deux.ts", "added"), ("ac", "two.ts", "removed")}


def test_an_unchanged_side_is_not_read_again(spark, tmp_path):
    root, home, builds = tmp_path / "src", str(tmp_path / "home"), []
    root.mkdir()
    for i in range(5):
        (root / f"f{i}.ts").write_text(f"import './f{i + 1}';\n")

    def build():
        builds.append(1)
        return {"imports": X.imports(read_tree(spark, str(root))).select("src", "spec")}

    def run():
        made = store.keep(spark, home, store.tree_signature(spark, str(root)), build)
        return made, sorted(r.spec for r in store.tables(spark, home, ["imports"])["imports"].collect())

    assert store.current(spark, home) is None
    with pytest.raises(ValueError, match="nothing is published"):
        store.tables(spark, home, ["imports"])
    first = run()
    assert first[0] and len(first[1]) == 5 and len(builds) == 1
    # Another content under the same stamp shows that no source file is read.
    stamp = os.stat(root / "f0.ts")
    (root / "f0.ts").write_text("import './zz';\n")
    os.utime(root / "f0.ts", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert run() == (False, first[1]) and len(builds) == 1
    os.utime(root / "f0.ts", (1, 1))
    again = run()
    assert again[0] and "./zz" in again[1] and len(builds) == 2
    # Back to the first stamp: its snapshot is pointed to again.
    os.utime(root / "f0.ts", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert run() == (False, first[1]) and len(builds) == 2


def test_a_build_cut_off_is_no_snapshot(spark, tmp_path):
    home, rows = str(tmp_path / "home"), spark.createDataFrame([("a",)], "x string")

    def broken():
        store.model.save({"t": rows}, home, "s1")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.keep(spark, home, "s1", broken)
    assert store.current(spark, home) is None
    assert store.keep(spark, home, "s1", lambda: {"t": rows})
    store.keep(spark, home, "s2", lambda: {"t": rows.union(rows)}, side="fe")
    assert store.current(spark, home) == "s1" and store.tables(spark, home, ["t"])["t"].count() == 1
    assert store.tables(spark, home, ["t"], "fe")["t"].count() == 2


def test_equal_trees_have_one_signature(spark, repo, tmp_path):
    top, sha = repo
    assert store.commit_signature(top, "HEAD") == store.commit_signature(top, sha["c"]) != store.commit_signature(top, sha["a"])
    (tmp_path / "none").mkdir()
    assert store.tree_signature(spark, str(tmp_path / "none")) == store.tree_signature(spark, str(tmp_path / "none"))
