"""Bracket matching against a walk over the text, and what extraction reads by it."""

import random
import time

from pyspark.sql import functions as F

from plinth.extract import brackets as B
from plinth.extract import wiring as W
from plinth.sources.tree import from_mapping


def tokens(files, marks=""):
    kind, step = B.kind_and_step(F.col("token"))
    return B.scanned(files, marks).where("role in ('mark', 'bracket')").withColumns({"kind": kind, "step": step})


def walked(text):
    """(kind, lo, hi, up) of brackets by one stack a kind; the text holds no literals."""
    out, opened = [], {k: [] for k in "([{"}
    for i, c in enumerate(text):
        if c in opened:
            opened[c].append(i)
        elif c in ")]}":
            k = "([{"[")]}".index(c)]
            if opened[k]:
                lo = opened[k].pop()
                out.append((k, lo, i, opened[k][-1] if opened[k] else None))
    closed = {(k, lo) for k, lo, _, _ in out}
    # A bracket that is never closed encloses nothing.
    up = lambda k, lo, hi: max((a for j, a, b, _ in out if j == k and a < lo and b > hi), default=None)
    return {(k, lo, hi, up(k, lo, hi)) for k, lo, hi, _ in out if (k, lo) in closed}


def test_pairs_equal_a_stack(spark):
    r = random.Random(4)
    texts = {str(i): "".join(r.choice("()[]{}aé😀 ") for _ in range(r.randint(0, 60))) for i in range(80)}
    got = {}
    for x in B.parents(B.pairs(tokens(from_mapping(spark, texts)))).collect():
        got.setdefault(x.path, set()).add((x.kind, x.lo, x.hi, x.up))
    assert all(got.get(k, set()) == walked(v) for k, v in texts.items())


def test_comments_and_literals_hide_brackets(spark):
    text = "f('(', \"{\", `[${x}]`) // )\n/* } ** / ) */ { a /* { */ }"
    got = {(x.kind, text[x.lo : x.hi + 1][:1], text[x.hi]) for x in B.pairs(tokens(from_mapping(spark, {"a": text}))).collect()}
    assert got == {("(", "(", ")"), ("{", "{", "}")}


def test_long_texts_take_seconds(spark):
    files = from_mapping(spark, {"big.ts": "x(){ y('a'); [1,2] }\n" * 50_000, "blank": "\n" * 40_000})
    began = time.time()
    assert B.pairs(tokens(files)).count() == 200_000 and time.time() - began < 60


def test_top_level_items(spark):
    rows = spark.createDataFrame([(1, "@A(x, y) a: Map<string, B<{c, d}>>, b = (x, y) => 3,, c: 'x,y'"), (2, ""), (3, " a ")], "id long, inner string")
    assert sorted(map(tuple, B.split_top(rows).collect())) == [(1, 0, "@A(x, y) a: Map<string, B<{c, d}>>"), (1, 1, "b = (x, y) => 3"), (1, 2, "c: 'x,y'"), (3, 0, "a")]


CONTROLLERS = """
@Controller('notes')
export class Notes {
  constructor(
    private readonly service: Service<Map<string, Note>>, // the ) one
    @Inject('CLOCK') clock: Clock = make({ a: 1 }),
  ) {}

      @Get(':id')
      @Guard(roles(1), { deep: () => [')'] })
      async one(@Param('id') id: string, @Query() query: { a: string, b: number }): Promise<Note[]> { return '}' }

  @Post()
  /* not ) here */
  make(@Body() body: NoteDto): Promise<{ id: string }> {
    return {}
  }
  @Put('x')
  field = 5;
  @Patch('y') arrow = async (a: A) => { };
  @Delete(':id') gone();
}
class Helper { constructor(helper: Help) {} }
@Controller({ path: 'tags', version: '1' })
export class Tags {
  constructor(private tags: TagService) {}
  @Get() all() { }
}
"""


def test_endpoints_have_parameters_and_types(spark):
    files = from_mapping(spark, {"a.controller.ts": CONTROLLERS})
    got = {r.handler: r for r in W.endpoints(files).collect()}
    assert {k: (r.cls, r.verb, r.route) for k, r in got.items()} == {"one": ("Notes", "GET", "/notes/:id"), "make": ("Notes", "POST", "/notes"), "arrow": ("Notes", "PATCH", "/notes/y"), "gone": ("Notes", "DELETE", "/notes/:id"), "all": ("Tags", "GET", "/tags")}
    assert [tuple(p) for p in got["one"].params] == [("Param", "id", "id", "string"), ("Query", "", "query", "{ a: string, b: number }")]
    assert (got["one"].ret, got["one"].dto, got["one"].returns) == ("Promise<Note[]>", None, "Note")
    assert (got["make"].ret, got["make"].dto, got["make"].returns) == ("Promise<{ id: string }>", "NoteDto", "id")
    assert (got["all"].params, got["all"].ret, got["gone"].ret) == ([], None, None)
    assert [tuple(r) for r in W.unresolved_handlers(files).collect()] == [("a.controller.ts", "@Put('x')")]


def test_every_constructor_is_read(spark):
    got = sorted(tuple(r)[1:] for r in W.injections(from_mapping(spark, {"a.ts": CONTROLLERS})).collect())
    assert got == [("Helper", 0, "helper", "Help", "Help"), ("Notes", 0, "service", "Service", "Service"), ("Notes", 1, "clock", "Clock", "CLOCK"), ("Tags", 0, "tags", "TagService", "TagService")]


def test_nested_providers(spark):
    text = """@Module({ providers: [
      { provide: 'A', useFactory: () => ({ provide: Inner, useClass: InnerImpl }), inject: [X] },
      { scope: { deep: { x: 1 } }, useClass: BImpl, provide: B },
      { provide: "C", /* useClass: Wrong, */ useExisting: CImpl }, { provide: D, multi: true }, 'provide: no' ] })"""
    files = from_mapping(spark, {"m.module.ts": text, "other.ts": text})
    assert {tuple(r) for r in W.bindings(files).collect()} == {("m.module.ts", "A", "useFactory", ""), ("m.module.ts", "Inner", "useClass", "InnerImpl"), ("m.module.ts", "B", "useClass", "BImpl"), ("m.module.ts", "C", "useExisting", "CImpl")}


def test_nested_ui_routes(spark):
    text = """<Routes>
      <Route element={<Shell a={() => 1} />}>
        <Route path="/notes/" element={<Notes/>}>
          <Route path=":id" element={<Note />}><Route path={`edit`} element={<Edit/>} /></Route>
          {cond && <Route path="new" element={<New/>} />}
          <Route path={PATHS.x} element={<X/>}><Route path="sub" /><Route path="/abs" /></Route>
        </Route>
        <Route path='/' element={<Home/>} />
      </Route>
      <Route path="*" element={<Lost />} />
    </Routes>"""
    got = {(r.route, r.component, r.layout, text[r.parent : r.parent + 40].split("=", 1)[1][:8] if r.parent is not None else None) for r in W.ui_routes(from_mapping(spark, {"a.tsx": text})).collect()}
    assert got == {
        ("/", "Shell", True, None), ("/notes/", "Notes", False, "{<Shell "), ("/notes/:id", "Note", False, '"/notes/'), ("/notes/:id/edit", "Edit", False, '":id" el'), ("/notes/new", "New", False, '"/notes/'),
        (None, "X", False, '"/notes/'), (None, None, False, "{PATHS.x"), ("/abs", None, False, "{PATHS.x"), ("/", "Home", False, "{<Shell "), ("/*", "Lost", False, None),
    }
