"""Endpoints, bindings, injections and HTTP calls of TypeScript sources, by expressions that stay in the JVM.

Declarations come from the token rows of extract.brackets: what belongs to what
is settled by depths and neighbours, not by indentation or by patterns that have
to span a whole declaration. What cannot be read comes out with a status, never
as a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.extract import brackets as B
from plinth.extract.grammar import NAME, literal
from plinth.operators.graph import settled
from plinth.operators.lookup import bind
from plinth.operators.match import bridge, url_segments

#: The decorators of routes.
VERBS = ("Get", "Post", "Put", "Patch", "Delete", "Head", "Options", "All")
#: Type names that a return type wraps or that need no reading.
PLAIN_TYPES = ("Promise", "Array", "void", "string", "number", "boolean", "any")
MODIFIER = r"(?:public|private|protected|static|declare|override|readonly|abstract|async)\s++"
CLASS = rf"\bclass\s++{NAME}"
DECORATOR = rf"@{NAME}(?:\.{NAME})*+"
METHOD = rf"\b(?:{MODIFIER})*+{NAME}(?:\s*+<[^<>()]*+>)?+(?=\s*+\()|\b(?:{MODIFIER})*+{NAME}\s*+=\s*+(?:async\s*+)?+(?=\()"
PARAMETER = rf"(?:{MODIFIER})*({NAME})\s*[?!]?\s*:\s*(.+?)(?:\s*=[^>].*)?$"
PROVIDE = rf"""\bprovide\s*+:\s*+(?:{NAME}|'[^']*+'|"[^"]*+")"""
USE = rf"\b(?:useClass|useExisting|useValue|useFactory)\s*+:\s*+(?:{NAME})?+"
CALL = r"""\b(?:\w+)\.(get|post|put|patch|delete)(?:<[^>(]*>)?\(\s*['"`]([^'"`]+)['"`]"""
FETCH = r"""\bfetch\(\s*['"`]([^'"`]+)['"`]\s*(?:,\s*\{[^}]*?method:\s*['"`](\w+)['"`])?"""
ROUTE_TAG = r"<Route(?=[\s/>])|</Route\s*+>|/>|(?<!=)>"


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


def _matches(files: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """path, ord and the named groups of every match, in text order."""
    zipped = F.arrays_zip(*[_all(pattern, g).alias(k) for k, g in groups.items()])
    return files.select("path", F.posexplode(zipped).alias("ord", "m")).select("path", "ord", *[F.col(f"m.{k}").alias(k) for k in groups])


def _outside(kind: str) -> Column:
    """The depth that a token stands at in brackets of a kind; a bracket of that kind stands outside itself."""
    named, step = B.kind_and_step(F.col("token"))
    own = (F.col("role") == "bracket") & (named == kind)
    depth = F.sum(F.when(own, step).otherwise(0)).over(Window.partitionBy("path").orderBy("ord"))
    return depth - F.when(own & (step == 1), 1).otherwise(0)


def members(files: DataFrame) -> DataFrame:
    """(path, ord, at, token, what, cls, cls_ord, flaws, lo, hi, body, body_end, body2): classes, decorators, methods and constructors.

    lo and hi are the offsets of the brackets of the argument list right after
    it, body and body_end those of the braces that come next on its level, body2
    where the second pair opens. flaws counts what stands before it on its level
    and is neither blank nor one of these, so a decorator and a method of equal
    flaws have nothing but decorators between them. cls is the class last named.
    """
    rows = B.scanned(files, marks="|".join((CLASS, METHOD, DECORATOR))).where("role <> 'comment'")
    rows = rows.withColumns({"round": _outside("("), "curly": _outside("{")})
    level = Window.partitionBy("path", "round", "curly").orderBy("ord")
    held = F.col("token").isin("(", ")", "{", "}") & (F.col("role") == "bracket")
    flaw = ((F.trim("gap") != "") & ~F.col("token").isin(")", "}")) | (F.col("role") == "literal") | F.col("token").isin("[", "]", "{", "}")
    blank = F.regexp_replace("gap", r"\s+", "") == ""
    flaw = F.when(F.col("role") == "mark", ~blank).otherwise(flaw & ~((F.col("token") == "(") & blank))
    rows = rows.withColumn("flaws", F.sum(F.when(flaw, 1).otherwise(0)).over(level)).where((F.col("role") == "mark") | held)
    what = F.when(F.col("role") != "mark", "").when(F.col("token").rlike(rf"^{CLASS}$"), "class").when(F.col("token").startswith("@"), "decorator").when(F.col("token").rlike(r"\bconstructor$"), "constructor").otherwise("method")
    rows = rows.withColumn("what", what)
    brace = F.when(F.col("token") == "{", F.col("at"))
    back = Window.partitionBy("path", "round", "curly").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(brace.isNotNull(), F.struct("at", F.lead("at").over(level).alias("end"), F.lead("at", 2).over(level).alias("second"), F.lead("token", 2).over(level).alias("kind"))), ignorenulls=True)
    follows = lambda n, token: F.when(F.lead("token", n).over(level) == token, F.lead("at", n).over(level))
    rows = rows.withColumns({"lo": follows(1, "("), "hi": follows(2, ")"), "opened": opened.over(back)})
    named = F.last(F.when(F.col("what") == "class", F.struct(F.regexp_extract("token", rf"({NAME})$", 1).alias("cls"), "ord")), ignorenulls=True)
    rows = rows.withColumn("named", named.over(Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("what <> ''").select(
        "path", "ord", "at", "token", "what", F.coalesce("named.cls", F.lit("")).alias("cls"), F.col("named.ord").alias("cls_ord"), "round", "curly", "flaws", "lo", "hi",
        F.col("opened.at").alias("body"), F.col("opened.end").alias("body_end"), F.when(F.col("opened.kind") == "{", F.col("opened.second")).alias("body2"),
    )


def _id(kind: str) -> Column:
    return F.concat_ws("#", "path", F.lit(kind), F.col("ord").cast("string"))


def _handlers(found: DataFrame) -> DataFrame:
    """Route decorators of members() with their method, null where something else follows or nothing."""
    ahead = Window.partitionBy("path", "round", "curly").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    method = F.struct("ord", "token", "flaws", "lo", "hi", "body", "body2")
    rows = found.withColumn("m", F.last(F.when(F.col("what").isin("method", "constructor"), method), ignorenulls=True).over(ahead))
    rows = rows.where(F.col("token").rlike(rf"^@(?:{'|'.join(VERBS)})$") & F.col("lo").isNotNull())
    return rows.withColumn("m", F.when((F.col("m.flaws") == F.col("flaws")) & F.col("m.hi").isNotNull(), F.col("m")))


def _read_routes(files: DataFrame, found: DataFrame) -> DataFrame:
    rows = _handlers(found).withColumn("id", _id("route"))
    return rows.join(B.cut(files, rows.select("path", "id", "lo", "hi")).select("id", F.trim(F.regexp_replace("inner", r"\s+", " ")).alias("argument")), "id", "left")


def _plain(argument: Column) -> Column:
    """The text of an argument that is absent or one plain string; null else."""
    return F.when(argument == "", "").when(argument.rlike("^[\"'`][^\"'`]*[\"'`]$"), F.substr(argument, F.lit(2), F.length(argument) - 2))


def _prefixes(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, cls, cls_ord, detail, prefix) of the classes that a @Controller before them marks."""
    ahead = Window.partitionBy("path").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    named = F.last(F.when(F.col("what") == "class", F.struct("cls", "ord")), ignorenulls=True)
    rows = found.withColumn("of", named.over(ahead)).where("token = '@Controller' and lo is not null and of is not null").withColumn("id", _id("controller"))
    rows = rows.join(B.cut(files, rows.select("path", "id", "lo", "hi")).drop("path"), "id")
    given = F.concat(F.lit("("), "inner", F.lit(")"))
    prefix = F.when(F.trim("inner") == "", "").otherwise(F.coalesce(_plain(F.trim("inner")), F.when(F.trim("inner").startswith("{"), literal(given, "path"))))
    return rows.select("path", F.col("of.cls").alias("cls"), F.col("of.ord").alias("cls_ord"), given.alias("detail"), prefix.alias("prefix"))


def endpoints(files: DataFrame) -> DataFrame:
    """(path, cls, verb, route, handler, params, ret, dto, returns): routes of controllers, their prefix before each.

    params have deco, arg, name and type; ret is the declared return type, null
    where there is none; dto names the type of the @Body parameter, returns the
    first type in ret that is not a wrapper or primitive.
    """
    found = settled(members(files))
    rows = _read_routes(files, found).withColumn("sub", _plain(F.col("argument"))).where("m is not null and sub is not null")
    held = _prefixes(files, found).select("path", "cls_ord", F.coalesce("prefix", F.lit("")).alias("prefix"))
    rows = rows.join(held, ["path", "cls_ord"])
    span = lambda kind, lo, hi: rows.where(f"{hi} is not null").select("path", F.concat_ws("|", F.lit(kind), "id").alias("id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    texts = B.cut(files, span("params", "m.lo", "m.hi").unionByName(span("one", "m.hi", "m.body")).unionByName(span("two", "m.hi", "m.body2")))
    part = lambda kind: texts.where(F.col("id").startswith(f"{kind}|")).select(F.substring_index("id", "|", -1).alias("id"), F.col("inner").alias(kind))
    deco = F.regexp_extract("item", r"@(\w+)\(([^)]*)\)", 1)
    bare = F.trim(F.regexp_replace("item", r"@\w+\([^)]*\)", ""))
    typed = bare.rlike(rf"^{PARAMETER}")
    one = F.struct(
        F.when(deco != "", deco).alias("deco"),
        F.when(deco != "", F.regexp_replace(F.regexp_extract("item", r"@(\w+)\(([^)]*)\)", 2), "['\"]", "")).alias("arg"),
        F.when(typed, F.regexp_extract(bare, rf"^{PARAMETER}", 1)).otherwise(bare).alias("name"),
        F.when(typed, F.regexp_extract(bare, rf"^{PARAMETER}", 2)).otherwise("").alias("type"),
    )
    params = B.split_top(part("params"), text="params").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("p")))), lambda x: x["p"]).alias("params"))
    rows = rows.join(params, "id", "left").join(part("one"), "id", "left").join(part("two"), "id", "left")
    # A brace in a type argument opens no body: as many angles must have closed before it, arrows apart.
    angles = F.regexp_replace("one", "=>|[^<>]", "")
    even = F.length(F.replace(angles, F.lit("<"), F.lit(""))) * 2 == F.length(angles)
    tail = F.when(F.col("one").contains(";"), None).when(even, F.col("one")).otherwise(F.col("two"))
    ret = F.trim(F.regexp_replace(F.regexp_extract(tail, r"(?s):\s*(.+)", 1), r"\s+", " "))
    rows = rows.withColumns({"params": F.coalesce("params", F.array().cast("array<struct<deco:string,arg:string,name:string,type:string>>")), "ret": F.when(ret != "", ret)})
    word = F.lit(r"([A-Za-z_]\w*)")
    body = F.get(F.filter("params", lambda p: p["deco"] == "Body"), F.lit(0))["type"]
    dto = F.regexp_extract(body, r"[A-Za-z_]\w*", 0)
    named = F.get(F.filter(F.regexp_extract_all("ret", word, F.lit(1)), lambda w: ~w.isin(*PLAIN_TYPES)), F.lit(0))
    route = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", "prefix", "sub"), "/"), lambda s: s != ""), "/"))
    handler = F.regexp_extract(F.col("m.token"), rf"({NAME})(?:\s*<[^<>()]*>)?(?:\s*=\s*(?:async\s*)?)?$", 1)
    return rows.select("path", "cls", F.upper(F.substr("token", F.lit(2))).alias("verb"), route.alias("route"), handler.alias("handler"), "params", "ret", F.when(dto != "", dto).alias("dto"), named.alias("returns"))


def unread_routes(files: DataFrame) -> DataFrame:
    """(path, detail): route decorators whose argument is no plain string."""
    rows = _read_routes(files, members(files)).where(_plain(F.col("argument")).isNull())
    return rows.select("path", F.concat("token", F.lit("("), "argument", F.lit(")")).alias("detail"))


def unresolved_handlers(files: DataFrame) -> DataFrame:
    """(path, detail): route decorators that no method declaration follows."""
    rows = _read_routes(files, members(files)).where("m is null").where(_plain(F.col("argument")).isNotNull())
    return rows.select("path", F.concat("token", F.lit("("), "argument", F.lit(")")).alias("detail"))


def unread_prefixes(files: DataFrame) -> DataFrame:
    """(path, detail): controllers whose prefix is neither absent nor a plain string."""
    return _prefixes(files, members(files)).where("prefix is null").select("path", "detail")


def bindings(files: DataFrame) -> DataFrame:
    """(path, token, via, impl) of provider objects in module files, however deep they stand.

    A provider is what one pair of braces holds: its token and the first way of
    use after the same opening brace.
    """
    modules = files.where(F.col("path").rlike(r"\.module\.ts$"))
    kind, step = B.kind_and_step(F.col("token"))
    tokens = B.scanned(modules, marks=f"{PROVIDE}|{USE}").where("role in ('mark', 'bracket')").withColumns({"kind": kind, "step": F.when(F.col("role") == "mark", 0).otherwise(step)})
    rows = B.enclosing(tokens, "{").where("lo is not null and role = 'mark'").withColumns({"key": F.regexp_extract("token", r"^(\w+)", 1), "value": F.regexp_replace(F.regexp_extract("token", r"(?s)^\w+\s*:\s*(.*)$", 1), "^['\"]|['\"]$", "")})
    used = rows.where("key <> 'provide'").groupBy("path", "lo").agg(F.min_by(F.struct("key", "value"), "at").alias("used"))
    impl = F.when(F.col("used.key").isin("useClass", "useExisting", "useValue", "useFactory"), F.col("used.value"))
    return rows.where("key = 'provide'").join(used, ["path", "lo"]).select("path", F.col("value").alias("token"), F.col("used.key").alias("via"), impl.alias("impl"))


def injections(files: DataFrame) -> DataFrame:
    """(path, cls, ord, prop, type, token): parameters of every constructor; token is the @Inject name or the type.

    The type is its name, without type arguments.
    """
    rows = members(files).where("what = 'constructor' and hi is not null").withColumn("id", _id("constructor"))
    items = B.split_top(B.cut(files, rows.select("path", "id", "lo", "hi")))
    bare = F.trim(F.regexp_replace("item", r"@\w+\([^)]*\)", ""))
    named = F.regexp_extract("item", r"""@Inject\(\s*['"`]?([\w.$]+)['"`]?\s*\)""", 1)
    read = items.select("id", "ord", F.regexp_extract(bare, rf"^{PARAMETER}", 1).alias("prop"), F.regexp_extract(F.regexp_extract(bare, rf"^{PARAMETER}", 2), r"^[\w.$]+", 0).alias("type"), named.alias("named")).where("prop <> ''")
    token = F.when(F.col("named") == "", F.col("type")).otherwise(F.col("named"))
    return read.join(rows.select("id", "path", "cls"), "id").select("path", "cls", "ord", "prop", "type", token.alias("token"))


def bound(files: DataFrame) -> DataFrame:
    """injections with n, bound_to and status by the providers of their token."""
    return bind(injections(files), bindings(files))


def http_calls(files: DataFrame) -> DataFrame:
    """(path, ord, verb, url, parts) of client and fetch calls with a literal URL."""
    client = _matches(files, CALL, verb=1, url=2)
    fetched = _matches(files, FETCH, verb=2, url=1).select("path", (F.col("ord") + 1_000_000).alias("ord"), F.when(F.col("verb") == "", "GET").otherwise(F.col("verb")).alias("verb"), "url")
    rows = client.unionByName(fetched).where(F.col("url").contains("/"))
    return rows.select("path", "ord", F.upper("verb").alias("verb"), "url")


def ui_routes(files: DataFrame) -> DataFrame:
    """(path, at, route, component, layout, parent): JSX routes, paths joined to those of the routes round them.

    A route without a path is a layout: it has the path of what holds it. A
    computed path is null, and so are relative ones below it; paths from `/` on
    stand for themselves. parent is the place of the route round it.
    """
    tokens = B.scanned(files, marks=ROUTE_TAG).where("role in ('mark', 'bracket')").withColumn("curly", _outside("{"))
    level = Window.partitionBy("path", "curly").orderBy("ord")
    tags = tokens.where("role = 'mark'").withColumns({"end": F.lead("at").over(level), "close": F.lead("token").over(level)})
    tags = tags.where(F.col("token").startswith("<")).withColumns({"kind": F.lit("Route"), "step": F.when(F.col("token").startswith("</"), -1).when(F.col("close") == "/>", 0).otherwise(1)})
    opened = B.pairs(tags)
    spans = opened.select("path", F.col("lo").alias("at"), "hi").unionByName(tags.where("step = 0").select("path", "at", F.col("at").alias("hi")))
    inner = B.cut(files, tags.where("step >= 0 and end is not null").select("path", F.concat_ws("#", "path", F.col("at").cast("string")).alias("id"), (F.col("at") + 5).alias("lo"), F.col("end").alias("hi")))
    given = F.regexp_extract("inner", r"""\bpath\s*=\s*(?:\{\s*)?(['"`])([^'"`]*)\1""", 2)
    has, plain = F.col("inner").rlike(r"\bpath\s*="), F.col("inner").rlike(r"""\bpath\s*=\s*(?:\{\s*)?(['"`])([^'"`$]*)\1""")
    element = F.regexp_extract("inner", r"\belement\s*=\s*\{\s*<([A-Z][\w$]*)", 1)
    routes = inner.select("path", F.substring_index("id", "#", -1).cast("long").alias("at"), F.when(plain, given).when(~has, "").alias("own"), (~has).alias("layout"), F.when(element != "", element).alias("component")).join(spans, ["path", "at"])
    above = routes.select("path", F.col("at").alias("up"), F.col("hi").alias("up_hi"), F.col("own").alias("up_own"), F.col("layout").alias("up_layout"))
    held = routes.join(above, "path").where("up < at and up_hi > hi").groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("up", "up_own"))).alias("ups"))
    rows = routes.join(held, ["path", "at"], "left").withColumn("ups", F.coalesce("ups", F.array().cast("array<struct<up:bigint,up_own:string>>")))

    def joined(parent: Column, own: Column) -> Column:
        below = F.regexp_replace(F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), own), "/+", "/")
        return F.when(own.isNull(), None).when((own == "") | own.startswith("/"), F.when(own == "", parent).otherwise(own)).otherwise(below)

    route = F.aggregate(F.concat(F.transform("ups", lambda x: x["up_own"]), F.array("own")), F.lit(""), joined)
    return rows.select("path", "at", F.when(route == "", "/").otherwise(route).alias("route"), "component", "layout", F.get("ups.up", F.size("ups") - 1).alias("parent"))


def stack(frontend: DataFrame, backend: DataFrame, prefix: str = "") -> DataFrame:
    """(path, verb, url, handler, status): each frontend call with the endpoint that serves it best."""
    served = endpoints(backend).withColumn("route_id", F.concat_ws(" ", "verb", "route"))
    calls = http_calls(frontend).withColumn("call_id", F.concat_ws("#", "path", F.col("ord").cast("string"))).withColumn("parts", url_segments(F.col("url"), prefix))
    routes = served.select("route_id", "verb", url_segments(F.col("route")).alias("parts")).dropDuplicates(["route_id"])
    found = bridge(calls.select("call_id", "verb", "parts"), routes)
    return calls.join(found, "call_id").join(served.select("route_id", "handler").dropDuplicates(["route_id"]), "route_id", "left").select("path", "verb", "url", "handler", "status")
