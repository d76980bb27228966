"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Each segment
is decoded to the index of the nearest word of the perfect binary Golay code
[23, 12], and the three 12-bit indices form a key. Two fingerprints that
differ in at most two bits have a midpoint, one flip away from both. By the
pigeonhole principle one flip touches one segment, so a fingerprint emits its
own key and the keys in which one segment is replaced by the index of a nearby
codeword (about 16 keys), and two linked fingerprints always meet in a key.

Verification must not list all pairs of a large bucket. Within a bucket that
has several fingerprints, each fingerprint names its midpoints that decode to
the bucket; those that share a midpoint are linked to the smallest of them,
and the exact Hamming distance of every link is checked. That is linear in the
bucket and loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import durable, held, python_workers
from plinth.llm.components import components

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
SEED = 42


def golay_table() -> np.ndarray:
    """Index of the nearest codeword for each 23-bit word: the code is perfect, radius 3."""
    return held("simhash", "golay", _golay_table)


def _golay_table() -> np.ndarray:
    index = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, dtype=np.uint32)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, np.uint32(GOLAY << bit), np.uint32(0))
    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [x | y for i, x in enumerate(ones) for y in ones[:i]]
    errors += [x | y | z for i, x in enumerate(ones) for j, y in enumerate(ones[:i]) for z in ones[:j]]
    out = np.zeros(1 << 23, dtype=np.uint16)
    for e in errors:
        out[words ^ np.uint32(e)] = index
    return out


def golay_key(fp: np.ndarray) -> np.ndarray:
    """The 36-bit key of each unsigned 64-bit fingerprint."""
    t, key = golay_table(), np.zeros(fp.shape, dtype=np.int64)
    for at, width in SEGMENTS:
        key = key << 12 | t[(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)].astype(np.int64)
    return key


def midpoints(fp: np.ndarray) -> np.ndarray:
    """Each fingerprint and its 64 one-flip neighbours, a row of 65."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return fp[:, None] ^ flips[None, :]


def fingerprint(text: str | None) -> int:
    """The contract's 64-bit fingerprint; null is as the empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, block = np.zeros(64, np.int64), 65536
    for i in range(0, n, block):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i : i + block], stops[i : i + block])), np.uint64, min(block, n - i))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("tag"), pa.array(fps.view(np.int64))], ["doc_id", "tag", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keys = np.sort(golay_key(midpoints(fp)), axis=1)
        first = np.concatenate([np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.repeat(fp, first.sum(axis=1)).view(np.int64))], ["key", "fp"])


def _mids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        mids = midpoints(fp)
        here = golay_key(mids) == b.column("key").to_numpy(zero_copy_only=False)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(mids[here].view(np.int64)), pa.array(np.repeat(fp, here.sum(axis=1)).view(np.int64))], ["mid", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column fp at two bits or fewer."""
    keys = fps.mapInArrow(_keys, "key long, fp long")
    shared = keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("key")
    mids = durable(keys.join(shared, "key").mapInArrow(_mids, "mid long, fp long"))
    hubs = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a <> hi").select("mid", "a")
    found = mids.join(hubs, "mid").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    return found.where("bit_count(a ^ b) <= 2")


def _named(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), *columns)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, tag, fingerprint, root and component_id.

    tag is a hash of the text; fingerprint is 16 hex digits; root names the component by its smallest
    fingerprint; component_id is the smallest doc_id of the component. Null and
    wordless texts have fingerprint zero and link to each other. Rows with a
    null doc_id are grouped like others; component_id is null only where every
    doc_id of the component is. Repeated rows come back as often as they came.
    An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    python_workers(spark)
    prints = durable(_named(docs, F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, tag long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.select("fp", "root").join(lowest, "root")
    return prints.join(classes, "fp").select("doc_id", "tag", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each group, with docs' own columns: that with the smallest doc_id.

    A null doc_id comes after all others. Of different texts with the smallest
    doc_id the one with the smallest hash stays, of repeated rows any one. Other
    columns may have any name.
    """
    key = lambda doc_id: [doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col("tag")]
    kept = simhash_groups(docs).groupBy("root").agg(F.min(F.struct(*key(F.col("doc_id")))).alias("k")).select("k.*")
    rows = _named(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(*key(F.col("doc_id")), "row")
    names = ["nameless", "id", "tag"]
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
