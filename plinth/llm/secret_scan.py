"""Secret scan in DataFrame operations only.

Base kinds are patterns. The method adds spans of kind "entropy": candidate
strings are runs of token characters, each belongs to one character class, and
a window of WINDOW characters slides over it. Counts per character change by
one step in and one step out, and with them the sum of c*log2(c) from which the
window's Shannon entropy follows. Windows at or above the class's threshold are
merged to spans; candidates that an allow-list pattern matches are suppressed,
and so are spans that a base span covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import let

#: The contract's patterns, with the least length that each must have.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Class of a candidate: pattern, alphabet, least entropy of a window in bits (of at most log2(20) = 4.32).
CHARACTER_CLASSES = (
    ("hex", "[0-9a-fA-F]+", "0123456789abcdefABCDEF", 3.0),
    ("alnum", "[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.9),
    ("base64", "[A-Za-z0-9+/_=-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: A candidate that one of these finds is no secret: no digit or no letter, runs of the alphabet, documentation samples, paths, UUIDs, counted hex.
PATH, NAME = "^(/[a-z0-9_-]+)+/?$", "^[a-z]+([_-][a-z]+)*[_-]?[0-9]{0,4}$"
ALLOW = ("^[^0-9]*$", "^[^A-Za-z]*$", "(?i)abcdefghijklmnop", "(?i)example", "(?i)placeholder", "(?i)x{8}", "0123456789", PATH, "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", NAME)
#: Matches whose places are summed in one block; bounds the copying in prefix sums.
BLOCK = 256
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(op(F.coalesce(F.get(a, F.size(a) - 1), F.lit(zero)), x))))


def _in_blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def prefixes(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Running op of an array of int from zero, in blocks so that long arrays stay cheap."""

    def blocked(v: Column) -> Column:
        whole = lambda b: F.aggregate(b, F.lit(zero), op)
        with_base = let(_in_blocks(v), lambda bs: let(_running(F.transform(bs, whole), zero, op), lambda up: F.transform(bs, lambda b, k: F.transform(_running(b, zero, op), lambda x: op(x, F.coalesce(F.get(up, k - 1), F.lit(zero)))))))
        return F.flatten(with_base)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, blocked))


def prefix_sums(values: Column) -> Column:
    return prefixes(values, 0, lambda a, x: a + x)


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end and value of group for each match, left to right without overlap, in code points.

    Splitting gives the text between the matches; lengths of both add up to the places.
    """
    p = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))

    def place(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m))
        return let(prefix_sums(steps), lambda ends: F.transform(x["found"], lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), F.get(x["value"], k).alias("value"))))

    return F.when(text.rlike(pattern), let(parts, place)).otherwise(F.array().cast(_SPANS))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def high_windows(value: Column, alphabet: str, least: float) -> Column:
    """Merged (start, end) within value of the windows whose entropy reaches least.

    The state holds a count for each character of the alphabet, the sum of
    c*log2(c), the open span and the closed ones; a step moves the window on by
    one character. Letters are numbered once, so a step does not depend on the
    length of value.
    """
    size = len(alphabet)
    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))
    numbered = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)

    def slide(letters: Column) -> Column:
        def step(st: Column, i: Column) -> Column:
            def move(m: Column) -> Column:
                came, went = m["came"], m["went"]
                n_in = F.get(st["n"], came)
                s = st["s"] + _weight(n_in + 1) - _weight(n_in)
                n_out = F.get(st["n"], went) + F.when(came == went, 1).otherwise(0)
                s = F.when(went >= 0, s - _weight(n_out) + _weight(n_out - 1)).otherwise(s)
                n = F.transform(st["n"], lambda c, k: c + F.when(k == came, 1).otherwise(0) - F.when(k == went, 1).otherwise(0))
                return F.struct(n.alias("n"), s.alias("s"))

            def close(m: Column) -> Column:
                high = (i >= WINDOW) & (F.round(F.log2(F.lit(float(WINDOW))) - m["s"] / WINDOW, 9) >= least)
                joins = high & (st["a"] >= 0) & (i - WINDOW <= st["b"])
                return F.struct(m["n"].alias("n"), m["s"].alias("s"), F.when(joins | ~high, st["a"]).otherwise(i - WINDOW).alias("a"), F.when(high, i).otherwise(st["b"]).alias("b"), F.when(high & ~joins & (st["a"] >= 0), F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b"))))).otherwise(st["done"]).alias("done"))

            both = F.struct(F.get(letters, i - 1).alias("came"), F.when(i > WINDOW, F.get(letters, i - 1 - WINDOW)).otherwise(-1).alias("went"))
            return let(let(both, move), close)

        def finish(st: Column) -> Column:
            return F.when(st["a"] >= 0, F.concat(st["done"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b"))))).otherwise(st["done"])

        return F.aggregate(F.sequence(F.lit(1), F.size(letters)), start, step, finish)

    return let(numbered, slide)


def allowed(value: Column) -> Column:
    """Whether an ALLOW pattern finds value.

    Two of them repeat a group, which the JVM's matcher does by recursion, a
    frame for each repetition. They are asked as a run of their characters
    without two separators in a row, which is the same.
    """
    steps = {PATH: value.rlike("^/[a-z0-9_/-]+$") & ~value.contains("//"), NAME: value.rlike("^[a-z][a-z_-]*[0-9]{0,4}$") & ~value.rlike("[_-]{2}")}
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | steps.get(pattern, value.rlike(pattern))
    return out


def entropy_spans(text: Column) -> Column:
    """Merged high-entropy spans of the candidates that no allow-list pattern matches."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def judge(c: Column) -> Column:
        found = F.when(allowed(c["value"]), none)
        for _, pattern, alphabet, least in CHARACTER_CLASSES:
            found = found.when(c["value"].rlike(f"^{pattern}$"), high_windows(c["value"], alphabet, least))
        return F.transform(found.otherwise(none), lambda w: F.struct((c["start"] + w["a"]).alias("start"), (c["start"] + w["b"]).alias("end")))

    return F.flatten(F.transform(spans_of(text, CANDIDATE), judge))


def scan(docs: DataFrame) -> DataFrame:
    """docs' columns plus secret_spans array<struct<start,kind,end>> by start, then kind as in KINDS.

    kind is the index in KINDS; places are code points and end is exclusive. A
    null text is an empty one and has no spans. A column of docs named
    secret_spans is replaced. An empty table gives an empty result; repeated
    rows come back as often as they came.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = lambda kind, found: F.transform(F.filter(found, lambda x: F.length(x["value"]) >= LEAST[kind]), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    # A run of HEX is as long as it can be, so asking for the least length in the pattern drops the same runs.
    base = F.concat(kept("assign", spans_of(text, ASSIGN, 2)), kept("access", spans_of(text, ACCESS)), kept("hex", spans_of(text, f"[0-9a-f]{{{LEAST['hex']},}}")))

    def merged(b: Column) -> Column:
        more = F.filter(entropy_spans(text), lambda e: ~F.exists(b, lambda x: (x["start"] <= e["start"]) & (e["end"] <= x["end"])))
        return F.sort_array(F.concat(b, F.transform(more, lambda e: F.struct(e["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), e["end"].alias("end")))))

    return docs.withColumn("secret_spans", let(base, merged))


def span_list(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text) the number of spans of each base kind, their digest, and all spans as text."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < KINDS.index("entropy"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secret_spans")).alias("spans"), count(3).alias("n_entropy"))


def without(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of every span of spans, which are sorted by start; overlapping ones become one mark.

    Each block of spans is cut out of its own stretch of the text, so that a text
    with many spans is not read from its start for each.
    """

    def cut(x: Column) -> Column:
        all_spans, ends = x["spans"], x["ends"]
        until = lambda k: F.coalesce(F.get(ends, k), F.lit(0))

        def block(b: Column) -> Column:
            first, last = until(b * BLOCK - 1), F.get(ends, F.least(F.size(ends), (b + 1) * BLOCK) - 1)

            def piece(stretch: Column) -> Column:
                def gap(s: Column, k: Column) -> Column:
                    return let(until(b * BLOCK + k - 1), lambda at: F.when(s["start"] >= at, F.concat(F.substr(stretch["text"], at - stretch["first"] + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))

                return F.array_join(F.transform(F.slice(all_spans, b * BLOCK + 1, F.lit(BLOCK)), gap), "")

            return let(let(first, lambda at: F.struct(at.alias("first"), F.substr(text, at + 1, last - at).alias("text"))), piece)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substr(text, F.get(ends, F.size(ends) - 1) + 1, F.length(text)))

    ends = prefixes(F.transform(spans, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(spans.alias("spans"), ends.alias("ends")), cut))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span replaced by mark; overlapping spans become one mark.

    Columns stay as they are, but n_chars, where it exists, is the new length of
    a text that changed. A null text stays null. A column of docs named
    secret_spans or __text is kept as it is.
    """
    names = docs.columns
    spans = scan(docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")))
    changed = F.size("secret_spans") > 0
    columns = {c: F.col("row").getField(c) for c in names} | {"text": F.when(changed, without(F.col("text"), F.col("secret_spans"), mark)).otherwise(F.col("row.text"))}
    cut = spans.select("row", changed.alias("changed"), columns["text"].alias("text"))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    columns["text"] = F.col("text")
    return cut.select(*[columns[c].alias(c) for c in names])
