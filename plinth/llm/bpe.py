"""BPE encoding and decoding with a transducer lexicon of frequent words.

The words of all documents are counted, the LEXICON most frequent are merged
once and compiled into a minimal acyclic transducer whose outputs are token
ids, and every executor maps that file. Words it does not hold are merged
exactly; nothing is capped, the lexicon only saves time.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Memory, durable, fresh_dir, hadoop_fs, held, python_workers
from plinth.llm.lexicon import Lexicon, compile_lexicon

#: Words that the transducer holds: a few MB of file, whatever the corpus.
LEXICON = 32768
#: Bytes of the chunks of text that a worker remembers of late, and chunks that it counts at once.
REMEMBERED = 64 << 20
COUNTED = 1 << 17
#: Longest word, in characters, that is counted for the lexicon.
WORD_CHARS = 64

#: White space of Unicode, and the vocabulary's word pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{_SPACE}]+")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


@cache
def unassigned() -> re.Pattern:
    """Characters without an assignment here; libraries of other Unicode versions may class them otherwise."""
    spans, start = [], None
    for c in range(sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


#: Marks that are pieces of their own after letters.
_MARKS = frozenset(".,;:!?)")
HIGH = re.compile("[Ͱ-\U0010ffff]")


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from 256."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Words, merges and tokens of a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.digits = {i: str(i) for i in tokens.values()}
        self.tokens = np.full(max(tokens.values()) + 1, "", object)
        for t, i in tokens.items():
            self.tokens[i] = t
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def merge(self, word: str) -> list[int]:
        """Ids of one normalised word by the vocabulary's merges."""
        if not (word.isascii() and word.isalpha()):
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if HIGH.search(text):
            if unassigned().search(text):
                t = self.library
                plain = t.normalizer.normalize_str(text)
                return [plain[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(plain)]
            text = text.replace("Σ", "σ")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _WORD.findall(_SPACES.sub(" ", text).lower())

    def pieces(self, text: str) -> list[str]:
        """Words, with special tokens as they stand."""
        low = text.lower()
        if low.isalpha() and (low.isascii() or not HIGH.search(low)):  # letters of old, composed already: one word
            return [low]
        if low[-1:] in _MARKS and (head := low[:-1]).isalpha() and not HIGH.search(head):
            return [head, low[-1]]
        if "<|" not in text:
            return self.words(text)
        out = []
        for piece in self.cut.split(text):
            out.extend([piece] if piece in self.special else self.words(piece) if piece else [])
        return out


def tokenizer(path: str) -> WordBpe:
    return held("bpe", path, lambda: WordBpe(path))


def chunks_of(text: str | None) -> list[str]:
    """The text cut at white space.

    Nothing reaches over white space: words hold none, and neither normal forms
    nor lower case look across it. Python's split also cuts at the separators
    U+001C to U+001F, which are none; texts with one are cut at common space alone.
    """
    text = text or ""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in re.split("[ \t\n\r]+", text) if x]
    return text.split()


def numbers(digits: str) -> np.ndarray:
    """Decimals that stand apart by spaces, as numbers."""
    return np.fromstring(digits, np.int32, sep=" ") if digits else np.zeros(0, np.int32)


class _Chunks(Memory):
    """One of chunks_of() -> its decimal ids, joined by spaces.

    A word goes to the transducer, then to the merges.
    """

    #: One string a chunk, no tuple: small, and nothing for the garbage collector to walk.
    ENTRY = 200

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None) -> None:
        super().__init__(REMEMBERED)
        self.bpe, self.lexicon = bpe, lexicon

    def ids(self, piece: str) -> list[int]:
        if (special := self.bpe.special.get(piece)) is not None:
            return [special]
        found = None if self.lexicon is None else self.lexicon.get(piece.encode("utf-8", "surrogatepass"))
        return self.bpe.merge(piece) if found is None else found

    def weigh(self, value: str) -> int:
        return len(value)

    def make(self, chunk: str) -> str:
        pieces = self.bpe.pieces(chunk)
        if len(pieces) == 2 and pieces[0].isascii() and (head := self.get(pieces[0])) is not None:  # a word of late with a mark
            return head + " " + " ".join([self.bpe.digits[i] for i in self.ids(pieces[1])])
        ids = self.ids(pieces[0]) if len(pieces) == 1 else [i for piece in pieces for i in self.ids(piece)]
        digits = self.bpe.digits
        return digits[ids[0]] if len(ids) == 1 else " ".join([digits[i] for i in ids])

    def encode(self, text: str | None) -> str:
        """Ids of a whole text, joined by spaces."""
        return " ".join(map(self.__getitem__, chunks_of(text)))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids, joined by spaces."""
        return " ".join(self.bpe.tokens[ids].tolist())

    def text(self, text: str | None) -> tuple[str, str]:
        """Ids and tokens of a whole text, both joined by spaces."""
        digits = self.encode(text)
        return digits, self.decode(numbers(digits))


def _memory(path: str, name: str | None) -> _Chunks:
    return held("bpe", (path, name), lambda: _Chunks(tokenizer(path), Lexicon(SparkFiles.get(name)) if name else None))


class _Counts:
    """Counts of words from counts of chunks; what it holds is bounded, long words are left out."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.chunks, self.words = bpe, Counter(), Counter()

    def add(self, text: str | None) -> None:
        found = chunks_of(text)
        if max(map(len, found), default=0) > WORD_CHARS:
            for chunk in found:
                if len(chunk) > WORD_CHARS:
                    self._count(chunk, 1)
            found = [x for x in found if len(x) <= WORD_CHARS]
        self.chunks.update(found)

    def _count(self, chunk: str, n: int) -> None:
        for w in self.bpe.pieces(chunk):
            if len(w) <= WORD_CHARS and w not in self.bpe.special:
                self.words[w] += n

    def full(self) -> bool:
        return len(self.chunks) + len(self.words) > COUNTED

    def take(self) -> pa.RecordBatch:
        for chunk, n in self.chunks.items():
            self._count(chunk, n)
        out = pa.RecordBatch.from_arrays([pa.array(self.words.keys(), pa.string()), pa.array(self.words.values(), pa.int64())], ["word", "n"])
        self.chunks.clear()
        self.words.clear()
        return out


def word_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """(word, n) over the whole texts of all documents; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(tokenizer(vocab))
        for b in batches:
            for text in b.column("text"):
                counts.add(text.as_py())
                if counts.full():
                    yield counts.take()
        yield counts.take()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> list[str]:
    """At most `size` words of the highest counts, and only those reach the driver.

    The counts' histogram tells above which count all words fit; equal counts
    are taken whole or not at all. Words that occur once are never frequent.
    """
    counts = durable(counts.where("n > 1"))
    room, least = size, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size).collect():
        if r.words > room:
            break
        room, least = room - r.words, r.n
    return [] if least is None else sorted(r.word for r in counts.where(F.col("n") >= least).select("word").collect())


def build_lexicon(docs: DataFrame, vocab: str, size: int = LEXICON) -> str | None:
    """Compile the `size` most frequent words, ship the file to all executors, and give its name."""
    spark = docs.sparkSession
    top = frequent(word_counts(docs, vocab), size)
    if not top:
        return None
    bpe = tokenizer(vocab)
    blob = compile_lexicon((w.encode("utf-8", "surrogatepass"), bpe.merge(w)) for w in top)
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}-{zlib.crc32(vocab.encode()):08x}.bin"
    fs, at = hadoop_fs(spark, f"{fresh_dir(spark, 'lexicon')}/{name}")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(blob))
    finally:
        stream.close()
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(str(at))
    return name


def encode_decode(docs: DataFrame, vocab: str, size: int = LEXICON) -> DataFrame:
    """docs' columns plus token_ids array<int> and decoded string.

    A null text is as an empty one: no ids and an empty decoded text. Texts of
    any length are encoded whole. Special tokens are recognised in the raw
    text. Columns of docs named token_ids or decoded are replaced. An empty
    table gives an empty result.
    """
    name = _prepare(docs, vocab, size)

    @F.arrow_udf("struct<token_ids:array<int>,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        ids, decoded, at = [], [], [0]
        for t in texts:
            memory = _memory(vocab, name)
            ids.append(numbers(memory.encode(t.as_py())))
            decoded.append(memory.decode(ids[-1]))
            at.append(at[-1] + len(ids[-1]))
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array(decoded, pa.string())], ["token_ids", "decoded"])

    return docs.withColumn("__bpe", run(F.col("text").cast("string"))).withColumns({"token_ids": F.col("__bpe.token_ids"), "decoded": F.col("__bpe.decoded")}).drop("__bpe")


def digests(docs: DataFrame, vocab: str, size: int = LEXICON) -> DataFrame:
    """Per document n_tokens and the digests of its ids and decoded text, made as they are encoded.

    The ids and texts are those of encode_decode; only their digests leave the task.
    """
    name = _prepare(docs, vocab, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, first, second = [], [], []
            memory = _memory(vocab, name)
            for text in b.column("text"):
                ids, tokens = memory.text(text.as_py())
                counts.append(ids.count(" ") + 1 if ids else 0)
                first.append(hashlib.sha256(ids.encode()).hexdigest())
                second.append(hashlib.sha256(tokens.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _prepare(docs: DataFrame, vocab: str, size: int) -> str | None:
    python_workers(docs.sparkSession)
    return build_lexicon(docs, vocab, size) if size else None
