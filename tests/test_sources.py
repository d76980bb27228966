"""Trees, git and extraction on a small repository made here."""

import subprocess

import pytest
from pyspark.sql import functions as F

from plinth.extract import imports as X
from plinth.operators import history
from plinth.sources import git as G
from plinth.sources import tree

FILES = {
    "src/a.ts": "import { B as Bee, type C } from './b';\nimport './side.css';\nexport * from 'react';\nconst x = import('./lazy');\n",
    "src/b.ts": "import x from '@lib/util';\nimport gone from './gone';\n",
    "src/lazy.tsx": "export {}\n",
    "lib/util/index.ts": "export const u = 1;\n",
    "src/note.entity.ts": "@Entity('notes')\nexport class Note {\n @PrimaryGeneratedColumn() id: number;\n @Column({ nullable: true }) userId?: number;\n @ManyToOne(() => Tag) tag: Tag;\n @Column() tagId: number;\n}\n",
    "src/user.entity.ts": "@Entity()\nexport class User {}\n",
    "src/tag.entity.ts": "@Entity('tags') export class Tag {}\n",
    "node_modules/z.ts": "import './b';\n",
    "README.md": "no",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")

    def run(*a):
        subprocess.run(["git", "-C", str(top), "-c", "user.name=Ann", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)

    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    run("init", "-q", "-b", "main")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "src/b.ts", "src/bee.ts")
    (top / "src/a.ts").write_text(FILES["src/a.ts"] + "// more\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    (top / "src/new.ts").write_text("x\n")
    run("add", "-A")
    return str(top)


def test_tree_with_ignore(spark, repo):
    got = {r.path: r.text for r in tree.read_tree(spark, repo, ignore=["^node_modules/"]).collect()}
    assert set(got) == {"src/a.ts", "src/bee.ts", "src/lazy.tsx", "lib/util/index.ts", "src/note.entity.ts", "src/user.entity.ts", "src/tag.entity.ts", "src/new.ts"}
    assert got["src/lazy.tsx"] == "export {}\n"


def test_git_sources(spark, repo):
    G.register(spark)
    log = spark.read.format("git_log").options(repo=repo, paths="src", commits="1").load()
    assert {r.path for r in log.collect()} >= {"src/a.ts", "src/bee.ts", "src/b.ts"}
    churn = {r.path: (r.commits, r.added) for r in history.churn(log, "path", "author", "ts_ms", F.col("added"), F.col("removed")).collect()}
    assert churn["src/a.ts"] == (2, 5) and churn["src/bee.ts"] == (1, 0)
    old = {r.path for r in spark.read.format("git_tree").options(repo=repo, ref="HEAD~1", ignore="^node_modules/", files="2").load().collect()}
    assert "src/b.ts" in old and "node_modules/z.ts" not in old
    staged = {r.path: r.text for r in spark.read.format("git_tree").options(repo=repo, ref=":index").load().collect()}
    assert staged["src/new.ts"] == "x\n"
    diff = {(r.status, r.path, r.old_path) for r in spark.read.format("git_diff").options(repo=repo, base="HEAD~1").load().collect()}
    assert diff == {("modified", "src/a.ts", None), ("renamed", "src/bee.ts", "src/b.ts")}
    assert [(r.status, r.path) for r in spark.read.format("git_diff").options(repo=repo, base="HEAD", head=":index").load().collect()] == [("added", "src/new.ts")]
    with pytest.raises(Exception):
        spark.read.format("git_tree").options(repo=repo, ref="nowhere").load().collect()


def test_rename_notation():
    assert [G.moved_to(x) for x in ("a => b", "d/{x => y}/f.ts", "d/{ => y}/f.ts", "d/{x => }/f.ts", "p")] == ["b", "d/y/f.ts", "d/y/f.ts", "d/f.ts", "p"]


def test_imports_and_symbols(spark):
    files = tree.from_mapping(spark, FILES).where("path not like 'node%'")
    got = {tuple(r) for r in X.edges(files, {"@lib": "lib"}, dynamic=True).collect()}
    assert got == {("src/a.ts", "./b", "src/b.ts", "resolved"), ("src/a.ts", "./side.css", None, "asset"), ("src/a.ts", "react", None, "external"), ("src/a.ts", "./lazy", "src/lazy.tsx", "resolved"), ("src/b.ts", "@lib/util", "lib/util/index.ts", "resolved"), ("src/b.ts", "./gone", None, "unresolved")}
    assert {tuple(r) for r in X.symbols(files).collect()} == {("src/a.ts", "Bee", "B", "./b"), ("src/a.ts", "C", "C", "./b")}


def test_class_names(spark):
    texts = {"a/b.ts": "class A {}\nexport  abstract class Base {}\nexport class C {}", "a/note.service.ts": "export const x = 1", "view.tsx": "", "d.ts": "reexport class D {}", "e.ts": "export " * 20_000 + " " * 100_000}
    rows = tree.from_mapping(spark, texts).unionByName(spark.createDataFrame([("none.ts", None)], tree.SCHEMA))
    got = {r.path: r.name for r in rows.select("path", X.class_name(F.col("path"), F.col("text")).alias("name")).collect()}
    assert got == {"a/b.ts": "Base", "a/note.service.ts": "note.service", "view.tsx": "view.tsx", "d.ts": "d", "e.ts": "e", "none.ts": "none"}


def test_entities(spark):
    found = X.entities(tree.from_mapping(spark, FILES))
    note = found.where("cls = 'Note'").first()
    assert (note.tbl, [c.name for c in note.columns], [tuple(r) for r in note.relations]) == ("notes", ["id", "userId", "tagId"], [("ManyToOne", "Tag", "tag")])
    assert [tuple(r) for r in X.implicit_relations(found).collect()] == [("Note", "userId", "User")]


def test_blank_lines_take_time_in_proportion(spark):
    import time

    from plinth.operators.change import normalised

    files = tree.from_mapping(spark, {"a.ts": "\n" * 200_000 + "import './b';\n" + " \t" * 100_000 + "x"})
    began = time.time()
    assert [r.spec for r in X.imports(files).collect()] == ["./b"] and X.clauses(files).count() == 0
    assert files.select(normalised(files.text).alias("t")).first().t.endswith("x")
    assert time.time() - began < 30


def test_assets_and_nullable_columns(spark):
    names = ["./a.md", "./b.TXT", "./c.html?raw", "./d.svg?url=1", "./e.woff2", "./f.mdx"]
    files = tree.from_mapping(spark, {"a.ts": "".join(f"import '{n}';\n" for n in names)})
    assert {r.spec: r.status for r in X.edges(files).collect()} == {**{n: "asset" for n in names[:5]}, "./f.mdx": "unresolved"}
    text = "@Entity()\nclass E {\n @Column({ nullable: true }) a: string;\n @Column() b?: Map<string, number>;\n @Column() c: Date |\n null = null;\n @Column() nullish!: string | nullable;\n}"
    (row,) = X.entities(tree.from_mapping(spark, {"e.ts": text})).collect()
    assert [(c.name, c.type, c.nullable) for c in row.columns] == [("a", "string", False), ("b", "Map<string, number>", True), ("c", "Date | null", True), ("nullish", "string | nullable", False)]


def test_import_clauses(spark):
    files = tree.from_mapping(spark, {"a.ts": "import React, { useState as use, type Ref } from 'react';\nimport * as path from \"path\"\nimport type { Only } from './only';\nimport def from './d'\n"})
    got = {tuple(r) for r in X.clauses(files).collect()}
    assert got == {("a.ts", "default", "React", "default", "react"), ("a.ts", "named", "use", "useState", "react"), ("a.ts", "named", "Ref", "Ref", "react"), ("a.ts", "namespace", "path", "*", "path"), ("a.ts", "named", "Only", "Only", "./only"), ("a.ts", "default", "def", "default", "./d")}


def test_relations_fold_into_their_declared_twins(spark):
    found = X.entities(tree.from_mapping(spark, FILES))
    note = found.where("cls = 'Note'").first()
    assert [(c.name, c.nullable, c.pk) for c in note.columns] == [("id", False, True), ("userId", True, False), ("tagId", False, False)]
    assert {tuple(r) for r in X.relations(found).collect()} == {("Note", "Tag", "ManyToOne", "tagId", True), ("Note", "User", "implicit", "userId", False)}


def test_long_declarations_are_read(spark):
    from plinth.extract import wiring as W

    many = ", ".join(f"private readonly p{i}: Service{i}" for i in range(3000))
    text = f"@Controller({{ path: 'big', version: '1' }})\nclass Big {{ constructor({many}) {{}}\n @Get(':id')\n @Guard(roles(1), all())\n async one(@Param('id') id: string) {{}}\n @Post(NAME)\n two() {{}}\n}}"
    files = tree.from_mapping(spark, {"big.ts": text, "odd.ts": "@Controller(PREFIX) class Odd { @Get() a() {} }"})
    assert W.injections(files).count() == 3000
    assert {tuple(r)[:5] for r in W.endpoints(files).collect()} == {("big.ts", "Big", "GET", "/big/:id", "one"), ("odd.ts", "Odd", "GET", "/", "a")}
    assert [tuple(r) for r in W.unread_routes(files).collect()] == [("big.ts", "@Post(NAME)")]
    assert [tuple(r) for r in W.unread_prefixes(files).collect()] == [("odd.ts", "(PREFIX)")]
