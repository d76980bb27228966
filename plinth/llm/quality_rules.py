"""Quality rules by distribution divergence, in DataFrame operations only.

Each language's reference holds the shares of character classes and of the
language's common words, counted over all its documents that pass the base rules. A document is compared
with the reference of its language by the Jensen-Shannon distance (base 2).
Documents under MIN_WORDS words and languages under MIN_REFERENCE words are not
judged by distance. Languages without a word list get their COMMON most frequent
words, counted over all their documents first.

Then every text is read once: what is counted of it (a few numbers, and the runs
of its common words) goes to the shared folder, and the references and verdicts
are made of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import durable, let

#: Common words of the languages that have a list.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are at from or an this not have but they which you his her".split(),
    "de": "der die und in den von zu das sich mit auf für des ist im dem ein eine nicht als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour par avec qui dans sur il au ne pas ce se plus sont son aux ou mais".split(),
    "es": "de la que el en y los se las del un por con no una para su al lo como más o pero sus le ha me sin sobre este".split(),
}
MIN_WORDS = 50
#: Words that are counted for a language without a list.
COMMON = 50
MIN_REFERENCE = 1000
#: Languages whose references are broadcast, by number of documents; the others' are joined by shuffle.
LANGUAGES = 256
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.31
#: For counted words, which take a larger and less even part of a text than listed ones.
MAX_COUNTED_DISTANCE = 0.45
WINDOW = 5
MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20

BLANK = "[\\x20\\x09-\\x0D]+"
CLASSES = ("lower", "upper", "digit", "symbol", "blank", "other")
#: Fixed value: the contract's symbols.
SYMBOL = "[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _count(text: Column, pattern: str) -> Column:
    """Code points of text in runs of pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words (an array) that lie in a WINDOW-word window found twice or more.

    Equal windows have equal hashes, so distinct hashes prove that none
    repeats; otherwise the windows themselves are sorted and compared.
    """

    def places(windows: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.get(windows, k)["w"] == F.get(windows, other)["w"]

        last = F.size(windows) - 1
        hits = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & F.coalesce(same(k, k - 1), F.lit(False))) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.sort_array(F.transform(hits, lambda k: F.get(windows, k)["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def each(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(ws, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(ws) - WINDOW + 1, F.lit(0).cast("long")).otherwise(let(let(windows, places), covered))

    return let(words, lambda ws: F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(each(ws)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def counted_words(docs: DataFrame, common_words: dict[str, list[str]]) -> DataFrame:
    """(lang, docs, vocab array) of each language with enough words and no list: its COMMON most frequent words with a letter."""
    rows = _rows(docs).where(~F.col("lang").isin(list(common_words)))
    counts = durable(rows.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    enough = counts.groupBy("lang").agg(F.sum("n").alias("all_words")).where(F.col("all_words") >= MIN_REFERENCE).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("word").rlike("\\p{L}")).withColumn("rank", rank).where(F.col("rank") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("vocab"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs")).join(enough, "lang").join(top, "lang")


def measures(docs: DataFrame, common_words: dict[str, list[str]], counted: DataFrame | None = None) -> DataFrame:
    """doc_id and lang of every row of docs, with the contract's base measures.

    n_chars is the text's length, CLASSES are counts of its code points, and runs
    its words that some list has, or its language's vocab in counted, as (word, n).
    """
    listed = sorted({w for ws in common_words.values() for w in ws})
    rows = _rows(docs)
    if counted is not None:
        rows = by_language(rows, counted, ~F.col("lang").isin(list(common_words)))
    rows = rows.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    common = F.sort_array(F.filter("words", lambda w: w.isin(listed))) if listed else F.array().cast("array<string>")
    if counted is not None:
        common = F.when(F.col("vocab").isNull(), common).otherwise(F.sort_array(F.filter("words", lambda w: F.array_contains("vocab", w))))
    counts = {"n_chars": F.length("text"), "n_words": F.size("words"), "word_chars": F.length(F.array_join("words", "")), "n_symbols": _count(F.col("text"), SYMBOL), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeated_words(F.col("words")), "lower": _count(F.col("text"), "\\p{Ll}+"), "upper": _count(F.col("text"), "\\p{Lu}+"), "digit": _count(F.col("text"), "[0-9]+")}
    rows = rows.select("doc_id", "lang", *[v.cast("long").alias(k) for k, v in counts.items()], let(common, _runs).alias("runs"))
    rows = rows.withColumns({"symbol": F.col("n_symbols"), "blank": F.col("n_chars") - F.col("word_chars")}).withColumn("other", F.col("n_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("symbol") - F.col("blank"))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _runs(ws: Column) -> Column:
    """(word, n) of each distinct word of a sorted array."""
    firsts = F.filter(F.sequence(F.lit(0), F.size(ws)), lambda k: (k == 0) | (k == F.size(ws)) | (F.get(ws, k) != F.get(ws, k - 1)))
    some = let(firsts, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda k, j: F.struct(F.get(ws, k).alias("word"), (F.get(at, j + 1) - k).cast("long").alias("n"))))
    return F.when(F.size(ws) == 0, F.array().cast("array<struct<word:string,n:bigint>>")).otherwise(some)


def references(measured: DataFrame, common_words: dict[str, list[str]], counted: DataFrame | None = None) -> DataFrame:
    """(lang, docs, ref_chars array, ref_words map) of each language with enough words in rows that pass the base rules.

    ref_words is null without a list or counted words.
    """
    spark = measured.sparkSession
    measured = measured.where(~F.col("base_failed"))
    lists = spark.createDataFrame([(k, w) for k, ws in common_words.items() for w in dict.fromkeys(ws)], "lang string, word string")
    if counted is not None:
        lists = lists.union(counted.select("lang", F.explode("vocab")))
    totals = measured.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("all_words"), F.sum("n_chars").alias("all_chars"), *[F.sum(k).alias(k) for k in CLASSES]).where(F.col("all_words") >= MIN_REFERENCE)
    counts = measured.select("lang", F.explode("runs").alias("r")).groupBy("lang", F.col("r.word").alias("word")).agg(F.sum("r.n").alias("n"))
    words = lists.join(counts, ["lang", "word"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n")))).alias("top"))
    found = totals.join(words, "lang", "left")
    return found.select("lang", "docs", F.array(*[F.col(k) / F.col("all_chars") for k in CLASSES]).alias("ref_chars"), F.when(F.col("top").isNotNull(), F.map_from_entries(F.transform("top", lambda t: F.struct(t["word"], t["n"] / F.col("all_words"))))).alias("ref_words"))


def by_language(rows: DataFrame, known: DataFrame, wanted: Column) -> DataFrame:
    """rows with the columns of known (lang, docs, ...); null where a language has none or a row is not wanted.

    The LANGUAGES with most documents are broadcast. Each of the others has a
    small part of the documents, so a join on lang has no hot key.
    """
    known = durable(known)
    names = [c for c in known.columns if c not in ("lang", "docs")]
    if known.count() <= LANGUAGES:
        return rows.join(F.broadcast(known.drop("docs")), "lang", "left")
    head = durable(known.orderBy(F.desc("docs"), "lang").limit(LANGUAGES))
    out = rows.join(F.broadcast(head.withColumn("__head", F.lit(True)).drop("docs")), "lang", "left")
    other = F.col("__head").isNull() & F.coalesce(wanted, F.lit(False))
    tail = known.join(F.broadcast(head.select("lang")), "lang", "left_anti").drop("docs")
    rest = out.where(other).drop("__head", *names).join(tail, "lang", "left")
    return out.where(~other).drop("__head").unionByName(rest)


def _term(p: Column, q: Column) -> Column:
    """p's and q's part of the divergence; a share of zero has none."""
    half = lambda x: F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def char_distance(shares: Column, reference: Column) -> Column:
    return _root(_total(F.zip_with(shares, reference, _term)))


def word_distance(runs: Column, n_words: Column, reference: Column) -> Column:
    """Distance of the histograms over the reference's words and all other words."""
    found = F.filter(F.transform(runs, lambda r: F.struct(F.element_at(reference, r["word"]).alias("q"), (r["n"] / n_words).alias("p"))), lambda x: x["q"].isNotNull())

    def distance(x: Column) -> Column:
        p, q = _total(F.transform(x, lambda i: i["p"])), _total(F.transform(x, lambda i: i["q"]))
        all_q = _total(F.map_values(reference))
        return _root(_total(F.transform(x, lambda i: _term(i["p"], i["q"]))) + 0.5 * (all_q - q) + _term(1 - p, 1 - all_q))

    return let(found, distance)


def quality_rules(docs: DataFrame, common_words: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, lang) the base measures, distances and verdict.

    A null text is an empty one; a null lang is a language of its own. Texts
    with no words have base_failed true. js_chars and js_words are null where no
    distance is taken (few words, no reference); such rows are kept
    unless base_failed or too far by the other distance. Repeated rows come back
    as often as they came; an empty table gives an empty result; other columns
    are not looked at.
    """
    lists = COMMON_WORDS if common_words is None else common_words
    counted = durable(counted_words(docs, lists))
    counted = None if counted.isEmpty() else counted
    rows = durable(measures(docs, lists, counted))
    shares = F.array(*[F.col(k) / F.col("n_chars") for k in CLASSES])
    judged = (F.col("n_words") >= MIN_WORDS) & ~F.col("base_failed")
    out = by_language(rows, references(rows, lists, counted), judged)
    out = out.withColumns({"js_chars": F.when(judged & F.col("ref_chars").isNotNull(), char_distance(shares, F.col("ref_chars"))), "js_words": F.when(judged & F.col("ref_words").isNotNull(), word_distance(F.col("runs"), F.col("n_words").cast("double"), F.col("ref_words")))})
    far = F.coalesce(F.col("js_chars") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("js_words") > F.when(F.col("lang").isin(list(lists)), MAX_WORD_DISTANCE).otherwise(MAX_COUNTED_DISTANCE), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "js_chars", "js_words")
