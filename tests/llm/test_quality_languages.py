"""op7 with many languages, and with languages that have no word list."""

import random

from plinth.llm import quality_rules as Q


def prose(rnd, vocab, n=200):
    return " ".join(rnd.choice(vocab) for _ in range(n))


def test_every_language_is_judged(spark, monkeypatch):
    rnd = random.Random(7)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    good = [(10 * k + i, f"l{k}", prose(rnd, vocab)) for k in range(6) for i in range(8 - k // 3)]
    bad = [(1000 + k, f"l{k}", " ".join(f"{x}#{x}%" for x in range(100))) for k in range(6)]
    docs = spark.createDataFrame(good + bad, "doc_id long, lang string, text string")
    found = {}
    for n in (256, 2):
        monkeypatch.setattr(Q, "LANGUAGES", n)
        found[n] = {r.doc_id: (r.kept, round(r.js_chars, 9)) for r in Q.quality_rules(docs).collect()}
    assert found[2] == found[256] and len(found[2]) == len(good) + len(bad)
    assert all(found[2][i][0] == (i < 1000) for i in found[2])


def test_short_documents_and_unlisted_languages(spark):
    rnd = random.Random(8)
    vocab, other = ([f"{x}{a}{b}" for a in "abc" for b in "kl"] * 20 + [f"{x}{a}{b}" for a in "abcdef" for b in "klmnop"] for x in "vw")
    for lang in ("EN", None, "xx"):
        rows = [(i, lang, prose(rnd, vocab, 60)) for i in range(40)] + [(99, lang, prose(rnd, other, 60)), (98, lang, prose(rnd, vocab, 49))]
        got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
        assert not got[99].kept and got[99].js_words > Q.MAX_COUNTED_DISTANCE
        assert all(r.kept and r.js_words is not None for i, r in got.items() if i < 98) and got[98].js_words is None


def test_lower_case_is_a_class_of_its_own(spark):
    rnd = random.Random(9)
    rows = [(i, "xx", prose(rnd, [a + b for a in "abcdef" for b in "klmnop"])) for i in range(40)] + [(99, "xx", prose(rnd, [a + b for a in "日本語文字列" for b in "一二三四五六"]))]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got[99].js_chars > Q.MAX_CHAR_DISTANCE and not got[99].kept and sum(r.kept for r in got.values()) == 40
