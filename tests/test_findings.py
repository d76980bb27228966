"""Wiring extraction and the finding catalogue on small hand-made trees."""

from pyspark.sql import functions as F

from plinth.extract import wiring as W
from plinth.operators import findings as N
from plinth.operators import rules
from plinth.sources.tree import from_mapping

BACK = {
    "notes/notes.controller.ts": """@Controller('notes')
export class NotesController {
  constructor(private readonly service: NotesService, @Inject('CLOCK') private clock: Clock) {}
  @Get()
  list() {}
  @Get(':id') @UseGuards(Auth(1))
  async one(@Param('id') id: string) {}
  @Post('bulk')
  make() {}
  @Get(PREFIX + 'x')
  odd() {}
}""",
    "notes/notes.module.ts": "providers: [{ provide: 'CLOCK', useClass: WallClock }, { provide: NotesService, useClass: A }, { provide: NotesService, useExisting: B }]",
}
FRONT = {"ui/api.ts": "api.get<Note[]>('/api/notes'); api.post(`/api/notes/bulk`, x); fetch(`/api/notes/${id}`); fetch('/api/gone', { method: 'DELETE' });", "ui/app.tsx": "<Route path='/n/:id' element={<NotePage />} />"}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_endpoints_injections_and_calls(spark):
    back, front = from_mapping(spark, BACK), from_mapping(spark, FRONT)
    assert rows(W.endpoints(back), "verb", "route", "handler", "cls") == [("GET", "/notes", "list", "NotesController"), ("GET", "/notes/:id", "one", "NotesController"), ("POST", "/notes/bulk", "make", "NotesController")]
    assert rows(W.unread_routes(back), "detail") == [("@Get(PREFIX + 'x')",)]
    assert rows(W.bound(back), "prop", "token", "n", "status") == [("clock", "CLOCK", 1, "bound"), ("service", "NotesService", 2, "ambiguous")]
    assert [r[1:] for r in rows(W.stack(front, back, "api").fillna("-"), "path", "verb", "url", "handler", "status")] == [("DELETE", "/api/gone", "-", "unmatched"), ("GET", "/api/notes", "list", "matched"), ("GET", "/api/notes/${id}", "one", "matched"), ("POST", "/api/notes/bulk", "make", "matched")]
    assert rows(W.ui_routes(front), "route", "component") == [("/n/:id", "NotePage")]


def test_broken_calls_are_kept_by_file_and_url(spark):
    calls = spark.createDataFrame([(1, "a.ts", "GET", "/x"), (2, "a.ts", "GET", "/x"), (3, "b.ts", "POST", "/y"), (4, "b.ts", "GET", "/z"), (5, "c.ts", "GET", "/ok"), (6, "c.ts", None, None)], "call_id int, path string, verb string, url string")
    states = spark.createDataFrame([(1, "unmatched"), (2, "unmatched"), (3, "ambiguous"), (4, "unserved"), (5, "matched"), (6, "unread")], "call_id int, status string")
    assert rows(N.broken_calls(calls, states), "src", "dst") == [("a.ts", "GET /x"), ("b.ts", "GET /z"), ("b.ts", "POST /y")]


def test_dead_shims_re_export_names_and_nothing_else(spark):
    texts = {"a": "export { A } from './a';", "b": "\n export {\n A,\n B as C } from \"./b\" \n", "c": "export * from './c'", "d": "export { A } from './a'; export const x = 1", "e": "export { A } from './a'; // done", "f": "export { A }", "g": "export {} from './g'", "used": "export { A } from './a'"}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert [r[0] for r in rows(N.dead_shims(files, spark.createDataFrame([("x", "used")], "src string, dst string")), "src")] == ["a", "b", "g"]


def test_parts_of_urls_with_holes(spark):
    from plinth.operators import match

    route = [(1, "GET", "/notes/note-5"), (2, "GET", "/notes/:id"), (3, "GET", "/files/a.json"), (4, "GET", "/files/b.json"), (5, "GET", "/only/x-1-y"), (6, "GET", "/only/x--y"), (7, "GET", "/dot/a+b")]
    call = [(1, "GET", "/notes/note-${id}"), (2, "GET", "/files/${id}.json"), (3, "GET", "/only/x-${n}-y"), (4, "GET", "/notes/${id}"), (5, "GET", "/files/${a}.css"), (6, "GET", "/dot/a+${c}"), (7, "GET", "/dot/a.${c}"), (8, "GET", "/notes/note-5?x=${y}")]
    parts = lambda rows_, k: spark.createDataFrame(rows_, f"{k} int, verb string, url string").select(k, "verb", match.url_segments(F.col("url")).alias("parts"))
    got = {r.call_id: (r.score, r.n_best, r.route_id, r.status) for r in match.bridge(parts(call, "call_id"), parts(route, "route_id")).collect()}
    assert got == {1: (3, 2, None, "ambiguous"), 2: (3, 2, None, "ambiguous"), 3: (3, 1, 5, "matched"), 4: (4, 1, 2, "matched"), 5: (None, 0, None, "unmatched"), 6: (3, 1, 7, "matched"), 7: (None, 0, None, "unmatched"), 8: (4, 1, 1, "matched")}


def test_catalogue(spark):
    files = spark.createDataFrame([("a/x.controller.ts", "controller", "a", "a", ""), ("b/y.service.ts", "service", "b", "b", ""), ("b/z.repo.ts", "repository", "b", "b", ""), ("b/s.ts", "service", "b", "b/s", "export { a } from './y';"), ("apps/q.ts", "other", "apps", "apps", ""), ("x/app/r.ts", "other", "x", "x", "")], "path string, pattern string, module string, folder string, text string")
    edges = spark.createDataFrame([("a/x.controller.ts", "b/z.repo.ts"), ("b/y.service.ts", "b/z.repo.ts"), ("b/z.repo.ts", "b/y.service.ts"), ("b/s.ts", "b/y.service.ts")], "src string, dst string")
    e = N.placed(edges, files)
    found = N.catalogue(
        N.cross_domain(e), N.same_level(e, ["service"]), N.upward(e, rules.expand_rules(spark, [("up", ["repository"], ["service"])])), N.skips(e, rules.skip_rules(spark, ["controller", "service", "repository"])),
        N.naming(files, {"repo": r"\.repo\.ts$"}), N.dead_shims(files, edges), N.mixed_spelling(files), N.circular(edges), N.orphaned(files, edges, spark.createDataFrame([("a/x.controller.ts",)], "node string")),
    )
    got = {}
    for r in found.collect():
        got.setdefault(r.finding, set()).add((r.src, r.dst))
    assert got["cross-domain"] == {("a/x.controller.ts", "b/z.repo.ts")}
    assert got["no-same-level"] == {("b/s.ts", "b/y.service.ts")}
    assert got["no-upward"] == {("b/z.repo.ts", "b/y.service.ts")}
    assert got["controller>repository"] == {("a/x.controller.ts", "b/z.repo.ts")}
    assert got["naming-repo"] == {("b/z.repo.ts", "")} and got["dead-shims"] == {("b/s.ts", "")} and got["app-apps"] == {("app", "apps")}
    assert got["circular"] == {("b/y.service.ts", "b/z.repo.ts")}
    assert {s for s, _ in got["orphans"]} == {"b/s.ts", "apps/q.ts", "x/app/r.ts"}
