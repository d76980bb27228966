"""op11 against a plain trie, op12 against the sentencepiece library, op13 against a list of units."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import fill_in_middle as fim
from plinth.llm import piece_bpe, prefix_trie
from plinth.llm.queries import ORACLE_SQL, QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    new = {c: convs.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :] for c, v in convs.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
            leaves[n[:d]] += kids[n] == 0
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(str(c) for c in sorted(m) if len(new[c]) == len(n)))) for n, m in members.items()]


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def test_trie_of_odd_conversations(spark, monkeypatch):
    """Nulls, ties, repeated rows, turnless members, deep spines, logs after every turn, a hot conversation of several cells."""
    monkeypatch.setattr(prefix_trie, "CELL", 16)
    monkeypatch.setattr(prefix_trie, "SPAN", 8)
    r, base = random.Random(3), [("u", f"t{i}") for i in range(40)]
    rows = []
    for c in range(230):
        turns = base[: r.randint(0, 30)] + [("u", str(r.randint(0, 2))) for _ in range(r.randint(0, 4))]
        rows += [(c, i if r.random() < 0.97 else None, *t) for i, t in enumerate(turns)]
    rows += [(300 + k, i, "a", f"log{i}") for k in range(20) for i in range(k)]
    rows += [(500, i, "u", f"t{i}") for i in range(90)] + [(None, 1, "u", "x"), (7, 1, None, None), (7, 1, None, None), (7, 1, "u", "tie"), (1203, 4, "u", "alone")]
    got = prefix_trie.shared_beginnings(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as a"))
    assert got.columns[:8] == list(prefix_trie.COLUMNS)
    assert by_key(got.collect()) == by_key(plain_trie(rows))
    assert any(n[1] == 0 and n[7] != sha("") for n in plain_trie(rows))  # a turnless conversation


def test_empty_tables(spark):
    assert prefix_trie.shared_beginnings(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_bpe.digests(docs, MODEL).collect() == [] and fim.digests(docs).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    assert by_key(got.collect()) == by_key(con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall())


@pytest.fixture(scope="module")
def cuts():
    return piece_bpe._Cuts(piece_bpe.PieceBpe(MODEL))


ODD = ["", " ", "   ", "▁x ▁▁", "<s> </s> <unk> <0x41>", "日本語 😀 執", "\n\n  \n a", "x" * 5000, " " * 3000 + "a", "ab" * 4000, "\t\tfoo\r\n bar", "\x00 \x1c\x85 a", "é�"]


@given(st.text(max_size=60) | st.text("ab  \n▁é日😀0.,(<>'", max_size=60) | st.sampled_from(ODD))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library(cuts, text):
    want = cuts.bpe.library.encode(text, add_eos=True)
    assert cuts.encode(text).tolist() == want and cuts.check([text]) == [True]
    assert cuts.bpe.decode(np.array(want)) == cuts.bpe.library.decode(want)


def test_a_wrong_cut_is_found(cuts):
    own = piece_bpe._Cuts(cuts.bpe)
    own.encode("some words")
    own.made["▁words"] = "5 6"
    assert own.check(["some words", "some", "words, too"]) == [False, True, False]


@given(st.lists(st.integers(2, 31999) | st.integers(3, 258) | st.just(2), max_size=12))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_in_the_library(cuts, ids):
    assert cuts.bpe.decode(np.array(ids, int)) == cuts.bpe.library.decode(ids)


def test_piece_query_equals_the_library(spark, sf, cuts):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_piece_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = cuts.bpe.library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.checked) == (len(ids), sha(" ".join(map(str, ids))), sha(cuts.bpe.library.decode(ids)), True)


def test_piece_operator_keeps_columns_and_takes_nulls(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "hello world", "b")], "doc_id long, text string, decoded string").selectExpr("*", "7 as extra")
    got = {(r.doc_id, r.decoded, r.extra, tuple(r.token_ids), r.checked) for r in piece_bpe.encode_decode(docs, MODEL).collect()}
    assert {g[:3] for g in got} == {(1, "", 7), (2, "hello world", 7)} and all(g[4] and g[3][-1] == 2 for g in got)


@given(st.text("ab Z9é😀\n.", max_size=80) | st.text(max_size=40), st.integers(1, 5), st.integers(1, 9), st.integers(0, 99))
@settings(max_examples=300, deadline=None)
def test_cuts_equal_a_list_of_units(text, every, block, k):
    text = text.encode("utf-8", "replace").decode()
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    index, k = fim.Index(text.encode(), every, block), min(k, len(units))
    head = "".join(units[:k])
    assert index.n == len(units) and index.cut(k) == (len(head.encode()), len(head))
    assert len(index.units) == max(1, -(-len(units) // every))


def test_fill_in_middle_restores_every_text(spark):
    texts = ["", None, "<", "<P", "a<S>b", "<<S <M <P>", "word", "x" * 3000, "a b" * 900, "é😀 z\n", "ends <S", "<"]
    docs = spark.createDataFrame([(i, t) for t in texts for i in range(60)] + [(None, "null key")], "doc_id long, text string").selectExpr("*", "'old' as output", "1 as n")
    rows = fim.fill_in_middle(docs, plain=100).withColumn("again", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert all(r.again == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "spm", "psm"}
    assert all(r.form == "plain" and r.prefix_chars is None for r in rows if not r.text or re.search("<[PSM]>", r.text))
    for r in rows:
        if r.form != "plain":
            p, m = r.text[: r.prefix_chars], r.text[r.prefix_chars : r.prefix_chars + r.middle_chars]
            s = r.text[len(p) + len(m) :]
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
