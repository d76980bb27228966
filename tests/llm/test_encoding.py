"""op3 and op6 against the tokenizers library, the transducer and the file format."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plinth.llm import bpe, tokenbin
from plinth.llm.lexicon import Lexicon, compile_lexicon
from plinth.llm.queries import QUERIES

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 3000, "x <|endoftext|> y<|startoftext|>", "ΑΣ ΣΑΣ", "é é", "͸a", "don't I'LL", "\x1c ​　", "漢字 １２", "\x00", "\n\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


@given(st.text(max_size=60) | st.sampled_from(ODD))
@settings(max_examples=300, deadline=None)
def test_merges_equal_the_library(text):
    own, want = bpe._Chunks(bpe.tokenizer(WORDS), None), bpe.tokenizer(WORDS).library
    ids = want.encode(text, add_special_tokens=False).ids
    assert own.text(text) == (" ".join(map(str, ids)), want.decode(ids, skip_special_tokens=False))


@given(st.dictionaries(st.binary(min_size=0, max_size=6), st.lists(st.integers(0, 60000), max_size=4), max_size=60), st.binary(max_size=6))
@settings(max_examples=100, deadline=None)
def test_transducer_holds_its_words_and_no_other(tmp_path_factory, words, other):
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    path.write_bytes(compile_lexicon(words.items()))
    held = Lexicon(str(path))
    assert all(held.get(w) == ids for w, ids in words.items())
    assert held.get(other) == words.get(other)


def test_transducer_shares_suffixes(tmp_path):
    (tmp_path / "l.bin").write_bytes(compile_lexicon((a + b"ations", [1]) for a in (b"n", b"r", b"f", b"l")))
    assert Lexicon(str(tmp_path / "l.bin")).states == 8


def test_op6_against_the_library(spark, sf, library):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_word_bpe"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = library[0].encode(want[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library[0].decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, ids string, decoded string")


def test_op6_edges(spark, library):
    docs = frame(spark, [(None, None), (1, ""), (1, ""), *((i, t) for i, t in enumerate(ODD))])
    for r in bpe.encode_decode(docs, WORDS).collect():
        assert list(r.token_ids) == library[0].encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library[0].decode(list(r.token_ids), skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), WORDS).count() == 0


def test_op3_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, sf).collect()}
    assert len(got) == len(docs)
    start = 0
    for d in docs:
        ids = np.array([*library[1].encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op3_edges(spark):
    docs = frame(spark, [(3, None), (None, "a b"), (3, "c"), (3, "c"), (-5, ""), (9, "d " * 90000)])
    rows = sorted(map(tuple, tokenbin.document_digests(docs, BYTES).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, -5, 3, 3, 3, 9]
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1]]
    assert tokenbin.document_digests(docs.limit(0), BYTES).count() == 0


def test_reader_opens_only_wanted_frames_and_sees_damage():
    w = tokenbin.Writer(frame_ids=10)
    given_ids = {i: np.arange(i, dtype=np.uint32) for i in range(12)}
    for i, ids in given_ids.items():
        w.add(i, ids)
    raw = w.finish()
    opened = []

    def read(at, n):
        opened.append(at)
        return raw[at : at + n]

    reader = tokenbin.Reader(read, len(raw))
    assert [(d, s, ids.tolist()) for d, s, ids in reader.documents([7])] == [(7, 21, list(range(7)))]
    assert sum(at in reader.starts[:-1] for at in opened) == 1
    assert [d for d, _, _ in reader.documents()] == list(given_ids)
    assert len(reader.seek) > 3
    bad = bytearray(raw)
    bad[int(reader.starts[1]) + 8] ^= 1
    broken = tokenbin.Reader(lambda at, n: bytes(bad[at : at + n]), len(bad))
    with pytest.raises(Exception):
        list(broken.documents())


def test_frames_are_plain_zstandard():
    import zstandard

    w = tokenbin.Writer()
    w.add(1, np.arange(5, dtype=np.uint32))
    raw = w.finish()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(20) == np.arange(5, dtype="<u4").tobytes()


def test_folders_are_named_as_arrow_does():
    from pyarrow import fs

    assert [tokenbin.arrow_uri(u) for u in ("s3a://b/x/y", "s3n://b", "s3://b", "hdfs://n/x", "file:///tmp", "/tmp/x")] == ["s3://b/x/y", "s3://b", "s3://b", "hdfs://n/x", "file:///tmp", "/tmp/x"]
    store, at = fs.FileSystem.from_uri(tokenbin.arrow_uri("s3a://bucket/x/y") + "?region=eu-west-1")
    assert store.type_name == "s3" and at == "bucket/x/y"
