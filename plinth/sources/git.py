"""Git as Spark data sources: history (`git_log`), trees (`git_tree`), differences (`git_diff`) and built trees (`git_frame`).

Every source takes the option `repo`; filters (since, paths, extensions, ignore)
are options too, so they reach git before a blob is read.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def git(repo: str, *args: str, data: bytes | None = None, env: Mapping[str, str] | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, env=env and {**os.environ, **env})
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def moved_to(path: str) -> str:
    """The new path of numstat's rename notations `a => b` and `dir/{a => b}/c`."""
    if "{" in path:
        return re.sub(r"\{.*? => (.*?)\}", r"\1", path).replace("//", "/")
    return path.split(" => ")[-1]


class Range(InputPartition):
    def __init__(self, *items) -> None:
        self.items = items


class LogReader(DataSourceReader):
    """One partition per `commits` commits, so that a long history is read by many tasks."""

    def __init__(self, options) -> None:
        self.repo, self.ref = options["repo"], options.get("ref", "HEAD")
        self.since, self.paths, self.step = options.get("since"), options.get("paths", ""), int(options.get("commits", "2000"))

    def partitions(self):
        limits = ["--no-merges", *([f"--since={self.since}"] if self.since else [])]
        shas = git(self.repo, "rev-list", *limits, self.ref, "--", *self.paths.split()).decode().split()
        return [Range(*shas[i : i + self.step]) for i in range(0, len(shas), self.step)]

    def read(self, partition) -> Iterator[tuple]:
        raw = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "--numstat", "--format=%x00%H%x09%at%x09%an", data="\n".join(partition.items).encode())
        wanted = self.paths.split()
        for entry in raw.decode(errors="replace").split("\x00")[1:]:
            head, *lines = entry.strip("\n").split("\n")
            sha, seconds, author = head.split("\t", 2)
            for line in filter(None, lines):
                added, removed, path = line.split("\t", 2)
                path = moved_to(path)
                if not wanted or any(path == w or path.startswith(w.rstrip("/") + "/") for w in wanted):
                    yield sha, int(seconds) * 1000, author, path, added, removed


class GitLog(DataSource):
    """One row for each changed file of each commit; counts of binary files are `-`."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "sha string, ts_ms bigint, author string, path string, added string, removed string"

    def reader(self, schema):
        return LogReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo, self.ref, self.step = options["repo"], options.get("ref", "HEAD"), int(options.get("files", "500"))
        self.suffixes = tuple("." + x for x in options.get("extensions", "ts,tsx").split(","))
        self.ignore = [re.compile(x) for x in options.get("ignore", "").split("\n") if x]

    def partitions(self):
        if self.ref == ":index":
            rows = [(p, m.split()[1]) for m, p in self._lines("ls-files", "-s", "-z") if m.split()[2] == "0"]
        else:
            rows = [(p, m.split()[2]) for m, p in self._lines("ls-tree", "-r", "-z", self.ref)]
        return self._batches([r for r in rows if self._wanted(r[0])], Range)

    def _wanted(self, path: str) -> bool:
        return path.endswith(self.suffixes) and not any(x.search(path) for x in self.ignore)

    def _batches(self, rows: list, kind: type) -> list:
        return [kind(*rows[i : i + self.step]) for i in range(0, len(rows), self.step)]

    def _lines(self, *args: str) -> list[list[str]]:
        return [x.split("\t", 1) for x in git(self.repo, *args).decode(errors="replace").split("\0") if x]

    def read(self, partition) -> Iterator[tuple]:
        return self._blobs(partition, lambda *args, data: git(self.repo, *args, data=data))

    def _blobs(self, partition, run: Callable[..., bytes]) -> Iterator[tuple]:
        raw = run("cat-file", "--batch", data="\n".join(r[1] for r in partition.items).encode() + b"\n")
        at = 0
        for path, sha, *more in partition.items:
            end = raw.index(b"\n", at)
            size = int(raw[at:end].split()[-1])
            yield path, sha, raw[end + 1 : end + 1 + size].decode("utf-8", "replace"), *more
            at = end + 2 + size


class GitTree(DataSource):
    """The files of a commit, or of the index (`ref` :index), a batch of blobs to a partition."""

    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        return "path string, sha string, text string"

    def reader(self, schema):
        return TreeReader(self.options)


#: The tree without files, which a first commit is compared with.
NOTHING = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def first_parent(repo: str, sha: str) -> str:
    """The commit's first parent, the empty tree where it has none."""
    found = git(repo, "rev-list", "--parents", "-n", "1", sha).decode().split()
    return found[1] if len(found) > 1 else NOTHING


@contextmanager
def built(repo: str, base: str, commits: Sequence[str], root: str = ".") -> Iterator[Callable[..., bytes]]:
    """Git over the tree of base with what each of the commits changed below root, in the order given.

    The index and the new blobs lie in a folder that is this block's alone and
    goes with it; the repository is only read. A commit that does not apply
    without one left out raises, by name.
    """
    with tempfile.TemporaryDirectory(prefix="spark-frame-") as own:
        os.mkdir(f"{own}/objects")
        objects = git(repo, "rev-parse", "--path-format=absolute", "--git-path", "objects").decode().strip()
        env = {"GIT_INDEX_FILE": f"{own}/index", "GIT_OBJECT_DIRECTORY": f"{own}/objects", "GIT_ALTERNATE_OBJECT_DIRECTORIES": objects}
        run = lambda *args, data=None: git(repo, *args, data=data, env=env)
        run("read-tree", base)
        for sha in commits:
            patch = run("diff", "--binary", "--full-index", first_parent(repo, sha), sha, "--", root)
            try:
                if patch.strip():
                    run("apply", "--cached", "--whitespace=nowarn", data=patch)
            except RuntimeError as e:
                name = git(repo, "log", "-1", "--format=%h %s", sha).decode().strip()
                raise RuntimeError(f"commit {name} does not apply without commits left out: {str(e).splitlines()[0]}") from None
        yield run


class Changed(Range):
    """Files whose blobs the repository may lack: the task builds the frame again."""


class FrameReader(TreeReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.commits, self.root = options["apply"].split(), options.get("root", ".")
        self.base = options.get("base") or (first_parent(self.repo, self.commits[0]) if self.commits else "HEAD")

    def partitions(self):
        with built(self.repo, self.base, self.commits, self.root) as run:
            listed = [x.split("\t", 1) for x in run("ls-files", "-s", "-z", "--", self.root).decode(errors="replace").split("\0") if x]
            olds = {new: old for _, new, old in _statuses(run("diff-index", "-M", "-z", "--cached", "--name-status", self.base, "--", self.root))}
        rows = [(path, mark.split()[1], olds.get(path)) for mark, path in listed if self._wanted(path)]
        return self._batches([r for r in rows if r[0] not in olds], Range) + self._batches([r for r in rows if r[0] in olds], Changed)

    def read(self, partition) -> Iterator[tuple]:
        if not isinstance(partition, Changed):
            yield from super().read(partition)
            return
        with built(self.repo, self.base, self.commits, self.root) as run:
            yield from self._blobs(partition, run)


class GitFrame(DataSource):
    """The files of a built tree: `base` (the first commit's parent if not given) and what the commits named in `apply` changed.

    old_path is a renamed file's path in the base. Files that no commit changed
    are read as they lie in the repository, a batch to a partition.
    """

    @classmethod
    def name(cls):
        return "git_frame"

    def schema(self):
        return "path string, sha string, text string, old_path string"

    def reader(self, schema):
        return FrameReader(self.options)


def frames(spark: SparkSession, repo: str, base: str, sets: Mapping[str, Sequence[str]], **options: str) -> DataFrame:
    """(frame, path, sha, text, old_path) of several built trees over one base: rows for `change.frames`."""
    load = lambda name, commits: spark.read.format("git_frame").options(repo=repo, base=base, apply=" ".join(commits), **options).load().select(F.lit(name).alias("frame"), "*")
    return reduce(DataFrame.unionByName, [load(*x) for x in sets.items()])


KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}


def _statuses(raw: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(status, path, old path) of git's name-status output with -z."""
    parts = iter(raw.decode(errors="replace").split("\0"))
    for mark in parts:
        if mark:
            old = next(parts)
            new = next(parts) if mark[0] in "RC" else old
            yield KINDS.get(mark[0], "modified"), new, old if mark[0] in "RC" else None


class DiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo, self.base, self.head = options["repo"], options["base"], options.get("head", "HEAD")

    def read(self, partition) -> Iterator[tuple]:
        yield from _statuses(git(self.repo, "diff", "-M", "-C", "--name-status", "-z", self.base, *([] if self.head == ":tree" else ["--cached"] if self.head == ":index" else [self.head])))


class GitDiff(DataSource):
    """(status, path, old_path) between base and head; head may be `:tree` or `:index`."""

    @classmethod
    def name(cls):
        return "git_diff"

    def schema(self):
        return "status string, path string, old_path string"

    def reader(self, schema):
        return DiffReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitTree, GitDiff, GitFrame):
        spark.dataSource.register(source)
