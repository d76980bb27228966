"""Token ids in binary files of independent zstandard frames.

A file holds, in this order: frames of whole documents' ids as little-endian
unsigned 32-bit integers; a skippable frame with the document index (doc_id,
number of ids, frame); and a skippable frame with the seek table of
zstandard's public seekable format, which lists each frame's compressed size,
size and checksum (low 32 bits of XXH64). A reader takes the tables from the
end of the file and decompresses only frames that hold documents it wants.

Writing is a job of range-partitioned, sorted tasks. Each task writes its files
under a name of its own and renames them when they are whole, and the content
depends on the input alone, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.bpe import HIGH, byte_letters, unassigned
from plinth.llm.common import Memory, fresh_dir, held, python_workers

#: Fixed values of the seekable format: skippable-frame magic, table magic, checksum flag.
SKIPPABLE, DOCS_SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
END_ID = 0
FRAME_IDS = 1 << 16
FILE_BYTES = 32 << 20
NO_ID = -(1 << 63)
#: Bytes of the words, and of the pieces, that a worker remembers of late.
REMEMBERED_WORDS, REMEMBERED_PIECES = 112 << 20, 16 << 20
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("frame", "<u4")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def arrow_uri(uri: str) -> str:
    """A folder's URI as Arrow names it: Spark's s3a and s3n are s3 there."""
    scheme, mark, rest = uri.partition("://")
    return f"s3{mark}{rest}" if scheme in ("s3a", "s3n") else uri


class Writer:
    """Builds one file's bytes; documents must come in the order they shall have."""

    def __init__(self, frame_ids: int = FRAME_IDS) -> None:
        self.frame_ids, self.size, self.ids = frame_ids, 0, 0
        self._out: list[bytes] = []
        self._docs: list[tuple] = []
        self._seek: list[tuple] = []
        self._open: list[np.ndarray] = []
        self._held = 0
        self._zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((NO_ID if doc_id is None else doc_id, len(ids), len(self._seek)))
        self._open.append(ids)
        self._held += len(ids)
        self.ids += len(ids)
        if self._held >= self.frame_ids:
            self._close()

    def range(self) -> tuple[int, int]:
        """The first and the last document's doc_id."""
        return self._docs[0][0], self._docs[-1][0]

    def _close(self) -> None:
        raw = np.concatenate(self._open).astype("<u4").tobytes() if self._open else b""
        packed = self._zstd.compress(raw)
        self._out.append(packed)
        self.size += len(packed)
        self._seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._open, self._held = [], 0

    def finish(self) -> bytes:
        if self._open:
            self._close()
        docs = np.array(self._docs, dtype=_DOC).tobytes()
        seek = np.array(self._seek, dtype=_SEEK).tobytes() + struct.pack("<IBI", len(self._seek), CHECKED, SEEKABLE)
        return b"".join([*self._out, struct.pack("<II", DOCS_SKIPPABLE, len(docs)), docs, struct.pack("<II", SKIPPABLE, len(seek)), seek])


class Reader:
    """Random access to a file: read(start, length) gives bytes of it."""

    def __init__(self, read, size: int) -> None:
        self._read = read
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("not a seekable file with checksums")
        at = size - 9 - n * _SEEK.itemsize
        self.seek = np.frombuffer(read(at, n * _SEEK.itemsize), dtype=_SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        head = int(self.starts[-1])
        magic, length = struct.unpack("<II", read(head, 8))
        if magic != DOCS_SKIPPABLE:
            raise ValueError("the document index is missing")
        self.docs = np.frombuffer(read(head + 8, length), dtype=_DOC)
        #: Where each document's ids begin among all ids of the file.
        self.offsets = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])

    def frame(self, k: int) -> np.ndarray:
        packed = self._read(int(self.starts[k]), int(self.seek["packed"][k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.seek["size"][k])))
        if len(raw) != self.seek["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["check"][k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, dtype="<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of the wanted documents, or of all; other frames stay packed."""
        rows = np.arange(len(self.docs)) if wanted is None else np.flatnonzero(np.isin(self.docs["doc_id"], np.fromiter(wanted, np.int64)))
        first = np.searchsorted(self.docs["frame"], np.arange(len(self.seek)))
        k, ids = -1, None
        for r in rows.tolist():
            doc = self.docs[r]
            if doc["frame"] != k:
                k = int(doc["frame"])
                ids = self.frame(k)
            at = int(self.offsets[r] - self.offsets[first[k]])
            yield int(doc["doc_id"]), int(self.offsets[r]), ids[at : at + int(doc["n"])]


#: White space of Unicode, and the pattern that splits text before byte-level merges.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Marks that are pieces of their own after letters and before a space.
_MARKS = frozenset(".,;:!?)")


class _Pieces(Memory):
    """Piece between merges -> its ids, from the library's merges."""

    def __init__(self, library) -> None:
        super().__init__(REMEMBERED_PIECES)
        self.model, self.letters = library.model, dict(enumerate(byte_letters()))

    def weigh(self, value: bytes) -> int:
        return len(value)

    def make(self, piece: str) -> bytes:
        if piece[1:].isalpha() and piece.isascii():
            piece = piece.replace(" ", self.letters[32])
        else:
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


class _Words(Memory):
    """What stands between two single spaces -> ids of it and of the space before it."""

    ENTRY = 200

    def __init__(self, pieces: _Pieces) -> None:
        super().__init__(REMEMBERED_WORDS)
        self.pieces = pieces

    def weigh(self, value: bytes) -> int:
        return len(value)

    def make(self, word: str) -> bytes:
        if word.isalpha():  # letters after a space are one piece
            return self.pieces.make(" " + word)
        if word[-1:] in _MARKS and word[:-1].isalpha():  # and so is the mark
            head = self.get(word[:-1])  # a word of late
            return (self.pieces.make(" " + word[:-1]) if head is None else head) + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(" " + word)))


class Encoder:
    """Texts to ids, with the library's merges made once for each distinct piece.

    Pieces are independent, and a single space begins a piece, so words are
    remembered too. Texts with special tokens, or characters that are unassigned
    here (the library may class them by another version of Unicode), are given to
    the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.library)
        self.words = _Words(self.pieces)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, with the end id."""
        end = END_ID.to_bytes(4, "little")
        if "<|" in text or not text.isascii() and HIGH.search(text) and unassigned().search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
        if "  " in text:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text))) + end
        first, *rest = text.split(" ")
        head = b"".join(map(self.pieces.__getitem__, _PIECE.findall(first)))
        return head + b"".join(map(self.words.__getitem__, rest)) + end


def encoder(path: str) -> Encoder:
    return held("tokens", path, lambda: Encoder(path))


def _encoded(vocab: str, batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    encode = encoder(vocab).encode
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        yield doc_id, np.frombuffer(encode(text), dtype="<u4")


class Part(NamedTuple):
    """A file: its documents, ids, and least and largest doc_id (NO_ID for null)."""

    file: str
    docs: int
    ids: int
    low: int
    high: int


def write_tokens(docs: DataFrame, vocab: str, to: str) -> list[Part]:
    """Write the ids of docs (doc_id, text) in ascending doc_id order below the folder `to`.

    Gives the files in order; that list has a row per 32 MB of output. Null doc_ids come first; a null text counts as empty and
    still has its end id. Repeated doc_ids stay together, in the order of their
    texts' hashes. An empty table writes no files.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, done, writer, n = TaskContext.get().partitionId(), [], Writer(), 0
        store, base = fs.FileSystem.from_uri(arrow_uri(to))

        def save() -> None:
            nonlocal writer, n
            if n:
                name = f"part-{task:06d}-{len(done):04d}.tok"
                store.create_dir(base, recursive=True)
                draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(writer.finish())
                store.move(draft, f"{base}/{name}")
                done.append(Part(name, n, writer.ids, *writer.range()))
            writer, n = Writer(), 0

        for b in batches:
            for doc_id, ids in _encoded(vocab, b):
                writer.add(doc_id, ids)
                n += 1
                if writer.size >= FILE_BYTES:
                    save()
        save()
        yield pa.RecordBatch.from_pylist([p._asdict() for p in done], pa.schema([("file", pa.string()), *((k, pa.int64()) for k in Part._fields[1:])]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    return sorted(Part(*r) for r in rows.mapInArrow(run, "file string, docs long, ids long, low long, high long").collect())


def read_tokens(spark: SparkSession, folder: str, files: list[Part], each, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """Rows that each(doc_id, start, ids) makes of the files' documents; start counts all ids before.

    wanted limits the documents: files whose range has none of them are not
    opened, and of the others only their frames are read and decompressed.
    schema names and types the rows; a null doc_id is given as None. A task
    reads one file by ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                store, at = fs.FileSystem.from_uri(arrow_uri(f"{folder}/{name}"))
                with store.open_input_file(at) as f:

                    def read(start: int, n: int) -> bytes:
                        f.seek(start)
                        return f.read(n)

                    reader = Reader(read, f.size())
                    rows = [each(None if d == NO_ID else d, base + s, ids) for d, s, ids in reader.documents(wanted)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], columns)

    python_workers(spark)
    columns = [x.split()[0] for x in schema.split(",")]
    bases = accumulate((p.ids for p in files), initial=0)
    opened = [(p.file, base) for p, base in zip(files, bases) if wanted is None or any(p.low <= w <= p.high for w in wanted)]
    if not opened:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(opened, "file string, base long").repartition(len(opened)).mapInArrow(run, schema)


def document_digests(docs: DataFrame, vocab: str) -> DataFrame:
    """Write the documents' ids, read the files back, and give each document's start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    files = write_tokens(docs, vocab, folder)

    def each(doc_id, start, ids):
        return doc_id, start, len(ids), zlib.crc32(ids.tobytes())

    return read_tokens(spark, folder, files, each, "doc_id long, start long, n_tokens long, ids_crc32 long")
