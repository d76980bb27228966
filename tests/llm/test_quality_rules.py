"""op7 against a brute-force version."""

import math
import re
from collections import Counter, defaultdict

from plinth.llm import quality_rules as Q
from plinth.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base(text):
    w = WORD.findall(text or "")
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def kinds(text):
    import regex

    found = {"lower": len(regex.findall(r"\p{Ll}", text)), "upper": len(regex.findall(r"\p{Lu}", text)), "digit": len(re.findall("[0-9]", text)), "symbol": len(re.findall(r"[#*$%&|<>]", text)), "blank": len(re.findall(r"[\x20\x09-\x0d]", text))}
    return [*found.values(), len(text) - sum(found.values())]


def distance(p, q):
    out = 0.0
    for a, b in zip(p, q):
        out += sum(0.5 * x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0)
    return math.sqrt(max(out, 0.0))


def fails(b):
    return b[0] < 10 or 100 * b[4] > 20 * b[0]


def common_words(rows):
    """The listed words of a language, or its most frequent ones with a letter."""
    import regex

    counts = defaultdict(Counter)
    for _, lang, text in rows:
        counts[lang or ""].update(WORD.findall(text or ""))
    for lang, words in counts.items():
        top = sorted((w for w in words if regex.search(r"\p{L}", w)), key=lambda w: (-words[w], w))[: Q.COMMON]
        if lang in Q.COMMON_WORDS or sum(words.values()) >= Q.MIN_REFERENCE and top:
            yield lang, Q.COMMON_WORDS.get(lang, top)


def brute(rows):
    chars, words = defaultdict(lambda: [0] * 6), defaultdict(Counter)
    for _, lang, text in rows:
        if not fails(base(text)):
            chars[lang or ""] = [a + b for a, b in zip(chars[lang or ""], kinds(text or ""))]
            words[lang or ""].update(WORD.findall(text or ""))
    out, lists = {}, dict(common_words(rows))
    for lang, counts in words.items():
        total = sum(counts.values())
        if total >= Q.MIN_REFERENCE:
            listed = lists.get(lang)
            out[lang] = ([x / sum(chars[lang]) for x in chars[lang]], listed and {w: counts[w] / total for w in listed})
    for i, lang, text in rows:
        b = base(text)
        failed, far = fails(b), False
        if not failed and b[0] >= Q.MIN_WORDS and (ref := out.get(lang or "")):
            counts = Counter(WORD.findall(text))
            far = distance([x / len(text) for x in kinds(text)], ref[0]) > Q.MAX_CHAR_DISTANCE
            if ref[1]:
                p, q = [counts[w] / b[0] for w in ref[1]], list(ref[1].values())
                far = far or distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]) > (Q.MAX_WORD_DISTANCE if lang in Q.COMMON_WORDS else Q.MAX_COUNTED_DISTANCE)
        yield (i, *b, failed, not failed and not far)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()]
    got = sorted(map(tuple, QUERIES["op7_quality_rules"](spark, sf).collect()))
    assert got == sorted(brute(rows))
    assert any(not r[-1] and not r[-2] for r in got) and any(r[-1] for r in got)


def test_edges(spark):
    rows = [(1, None, None), (None, "en", ""), (1, None, None), (3, "en", "a b c d e f a b c d e g"), (4, "en", "x " * 4), (5, "en", "x\n\nx\n \nx y\n"), (6, "en", "w " * 50000), (7, "en", " ".join(map(str, range(3000)))), (8, "zz", "#|<&> é Ü\v\f\r q")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, lang string, text string, words int, chars int")
    key = lambda r: str(r)
    assert sorted((tuple(r)[:8] for r in Q.quality_rules(docs).collect()), key=key) == sorted(brute(rows), key=key)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_quality_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op7_quality_rules"](spark, d).join(labels, "doc_id").where("not base_failed and quality = 1").collect()
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)
