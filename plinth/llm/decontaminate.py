"""Benchmark decontamination by CGK embedding and bit sampling.

The CGK walk reads a word sequence step by step and stays on a word or moves on
as a random bit of (step, word) says. Sequences at a small edit distance soon
walk in step again, so their outputs differ in few places: edit distance
becomes Hamming distance, and sampling a few output places is a locality
sensitive hash. A walk reads about half as many words as it has steps, and its
length goes by the size of the items: PLANS gives items of like size their
walks, samples and repeats. An item is indexed at every offset from which the
walk stays inside it, a document is asked at every word, and independent walks
give the recall. Every hit is verified by the exact word edit distance of the
item to its best window of the document.

All windows of a batch of documents are walked at once, from the last step back:
the hash at a word is that of the next step at this word or the one after it.
Words are code points between others, hashed as polynomials of prefix sums, so
no word becomes a Python object unless a candidate is verified.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import durable, held, python_workers

SIMILARITY = 0.8


class Plan(NamedTuple):
    """Walks for items of `least` words or more."""

    least: int
    steps: int
    sampled: int
    #: Words of an item that the sampled places of a walk must come from at least.
    spread: int
    repeats: int


#: Under five words one edit is more than SIMILARITY allows: equal words have equal walks, so one finds them.
PLANS = (Plan(1, 1, 1, 1, 1), Plan(2, 2, 2, 1, 1), Plan(3, 3, 3, 1, 1), Plan(4, 4, 4, 1, 1), Plan(5, 3, 3, 2, 6), Plan(7, 5, 5, 3, 8), Plan(10, 7, 4, 3, 8), Plan(20, 12, 4, 4, 8))
#: Words of benchmark items that are broadcast at once; more items go in further blocks.
BLOCK_WORDS = 2_000_000
#: Words that are hashed, and code points that are read, at once.
CHUNK = 1 << 16
SPAN = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_ODD = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def _letters() -> np.ndarray:
    """Whether a code point belongs to words."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of _ODD and of its inverse, modulo 2**64."""
    up, down = np.full(SPAN, _ODD, np.uint64), np.full(SPAN, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """The words of several texts: where each begins and ends in `text`, its hash, and the texts' first words."""

    def __init__(self, texts: list[str | None]) -> None:
        lower = [(t or "").lower() for t in texts]
        self.text = "\n".join(lower)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = held("decontaminate", "letters", _letters)[points]
        edges = np.flatnonzero(np.diff(inside))
        self.begin, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.begin, np.cumsum([0, *(len(t) + 1 for t in lower)]))
        self.hash = self._hashes(points)

    def _hashes(self, points: np.ndarray) -> np.ndarray:
        up, down = held("decontaminate", "powers", _powers)
        out, i = np.zeros(len(self.begin), np.uint64), 0
        while i < len(out):
            at = self.begin[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + SPAN, "right")))
            part = points[at : min(self.end[j - 1], at + SPAN)]  # of a longer word, what fits
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint32(1)) * up[: len(part)])])
            first, last = self.begin[i:j] - at, np.minimum(self.end[i:j] - at, len(part))
            out[i:j] = (sums[last] - sums[first]) * down[first]
            i = j
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(29)

    def symbols(self) -> np.ndarray:
        return (self.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def walk(self, r: int) -> np.ndarray:
        """Random bits of each word for the r-th walk: step j moves on where bit j is set."""
        x = self.hash + np.uint64(r * _ODD & (1 << 64) - 1)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        return (x * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.uint32)

    def words(self, a: int, b: int) -> list[str]:
        return [self.text[x:y] for x, y in zip(self.begin[a:b].tolist(), self.end[a:b].tolist())]


def samples(plan: Plan) -> np.ndarray:
    """For each walk of a plan the sampled steps, one in each of `sampled` stretches, as a row of booleans."""
    rnd = np.random.default_rng(11 + plan.least)
    cuts = np.linspace(0, plan.steps, plan.sampled + 1).astype(int)
    out = np.zeros((plan.repeats, plan.steps), bool)
    for row in out:
        row[[rnd.integers(a, b) for a, b in zip(cuts, cuts[1:])]] = True
    return out


def embed(symbol: np.ndarray, walk: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The sampled hash of the walk from each word."""
    n = len(symbol)
    h = np.zeros(n + 1, np.uint32)
    for j in range(int(np.flatnonzero(sampled)[-1]), -1, -1):
        on = -(walk >> np.uint32(j) & np.uint32(1))  # all bits where the walk moves on
        now = h[:-1] ^ ((h[1:] ^ h[:-1]) & on)
        if sampled[j]:
            now *= np.uint32(0x9E3779B1 + 2 * j)
            now += symbol
            now ^= now >> np.uint32(15)
        h[:-1] = now
    return h[:-1]


def visited(walk: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """For each word a row of the places that its walk samples, counted from the word."""
    n, out = len(walk), []
    at = np.arange(n)
    for j in range(int(np.flatnonzero(sampled)[-1]) + 1):
        if sampled[j]:
            out.append(at - np.arange(n))
        inside = np.minimum(at, n - 1)
        at = at + np.where(at < n, walk[inside] >> np.uint32(j) & np.uint32(1), 1)
    return np.stack(out, axis=1)


def best_window(item: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end) of the window of text nearest to item by edit distance, by bit-parallel columns."""
    n = len(item)
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Table:
    """Hashes of one walk: for each key the items that have it, with the least and the largest offset in the item."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        order = np.lexsort((offsets, items, keys))
        keys, items, offsets = keys[order], items[order], offsets[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])])) if len(keys) else np.zeros(0, int)
        self.keys, self.items = keys[first], items[first]
        self.low = offsets[first]
        self.high = np.maximum.reduceat(offsets, first) if len(first) else offsets
        self.bits = min(24, max(16, (128 * len(first)).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys & np.uint32((1 << self.bits) - 1)] = True

    def matches(self, h: np.ndarray) -> np.ndarray:
        """Rows of (place, item, least and largest place where the item would begin) for the hashes h."""
        at = np.flatnonzero(self.seen[h & np.uint32((1 << self.bits) - 1)])
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        place, first, n = np.repeat(at, hi - lo), np.repeat(lo, hi - lo), hi - lo
        row = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        return np.stack([place, self.items[row], place - self.high[row], place - self.low[row]], axis=1)


class Index:
    """The hashes of a block of items."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        self.items = [(i, w) for i, w in items if w]
        size = np.array([len(w) for _, w in self.items], int)
        read = Words([" ".join(w) for _, w in self.items])
        symbol = read.symbols()
        self.sets = [set(symbol[a:b].tolist()) for a, b in zip(read.first, read.first[1:])]
        group = np.searchsorted([p.least for p in PLANS], size, "right") - 1
        #: (plan, number of the walk, its sampled steps, its table), for the plans that the items need.
        self.walks: list[tuple[Plan, int, np.ndarray, Table]] = []
        for g in np.unique(group).tolist():
            plan = PLANS[g]
            for r, sampled in enumerate(samples(plan)):
                walk, found = read.walk(r), []
                for k in np.flatnonzero(group == g).tolist():
                    part = slice(read.first[k], read.first[k + 1])
                    places = visited(walk[part], sampled)
                    inside = np.flatnonzero((np.arange(size[k]) + places[:, -1] < size[k]) & (1 + (np.diff(places, axis=1) > 0).sum(axis=1) >= plan.spread))
                    inside = inside if allowed(size[k]) else inside[:1]
                    found.append((embed(symbol[part], walk[part], sampled)[inside], np.full(len(inside), k), inside))
                self.walks.append((plan, r, sampled, Table(*map(np.concatenate, zip(*found)))))

    def candidates(self, read: Words) -> np.ndarray:
        """Rows of (document, item, least and largest word of the document where the item would begin)."""
        symbol, out = read.symbols(), [np.zeros((0, 4), np.int64)]
        for r in sorted({r for _, r, *_ in self.walks}):
            walk = read.walk(r)
            for plan, _, sampled, table in (w for w in self.walks if w[1] == r):
                for at in range(0, len(symbol), CHUNK):
                    part = slice(at, at + CHUNK + plan.steps + 1)
                    out.append(table.matches(embed(symbol[part], walk[part], sampled)[:CHUNK]) + [at, 0, at, at])
        found = np.concatenate(out)
        doc = np.searchsorted(read.first, found[:, 0], "right") - 1
        return np.column_stack([doc, found[:, 1], found[:, 2:] - read.first[doc][:, None]])

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, end word) of the best verified window of each pair.

        Candidates of a pair that overlap are verified as one stretch, so no
        document is read more than once for an item.
        """
        if not self.walks:
            return []
        read = Words(texts)
        symbol, out = read.symbols(), {}
        found = self.candidates(read)
        for doc, k, lo, hi in self._stretches(found[np.lexsort(found.T[::-1])], np.diff(read.first)):
            item, slack = self.items[k][1], allowed(len(self.items[k][1]))
            at = read.first[doc]
            if len(self.sets[k].intersection(symbol[at + lo : at + hi].tolist())) < len(self.sets[k]) - slack:  # each edit loses one word at most
                continue
            near = read.words(at + lo, at + hi)
            distance, end = best_window(item, near)
            if distance <= slack and distance < out.get((doc, k), (slack + 1,))[0]:
                back, length = best_window(item[::-1], near[max(0, end - len(item) - slack) : end][::-1])
                out[doc, k] = (distance, lo + end - (length if back == distance else len(item)), lo + end)
        return [(*pair, *window) for pair, window in sorted(out.items())]

    def _stretches(self, found: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first, end) of the words that sorted candidates ask for, overlapping ones as one."""
        now = None
        for doc, k, low, high in found.tolist():
            n = len(self.items[k][1])
            slack = allowed(n)
            lo, hi = max(0, low - slack), min(int(sizes[doc]), high + n + slack)
            if now and now[:2] == (doc, k) and lo <= now[3]:
                now = (doc, k, now[2], max(hi, now[3]))
            else:
                if now:
                    yield now
                now = (doc, k, lo, hi)
        if now:
            yield now


def _blocks(items: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The distinct items in blocks of about BLOCK_WORDS words, each broadcast under a name of its own, and whether there are others.

    Where there are, a block's work is done when the next one is asked for, and
    its broadcast goes.
    """
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = tests.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r.item_id, words_of(r.text)) for r in part), key=str)))
        yield block, blocks > 1
        if blocks > 1:
            block.destroy()


class _Slot:
    """The one index that a worker holds: that of the block it worked on last."""

    key = index = None

    def get(self, key: str, items: list) -> Index:
        if self.key != key:
            self.index = None
            self.index, self.key = Index(items), key
        return self.index


def _index(block) -> Index:
    """The index of a broadcast block, built once in a worker, in place of any other."""
    return held("decontaminate", "index", _Slot).get(*block.value)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word): documents that hold an item at SIMILARITY or more.

    A document's words are its runs of letters and digits, in lower case. The
    similarity of an item of n words to a window is 1 - edits/n, so items under
    five words must occur word for word; items without words never match. Of
    several windows the nearest counts, then the first. Null texts have no
    words; null doc_ids and item_ids are carried. Repeated rows of docs come
    back as often as they match, repeated items once. Empty tables give an empty
    result; other columns are not looked at.

    Of more items than a block holds, each block is a job of its own whose hits
    are written to the shared folder, so neither tasks nor executors ever hold
    two blocks.
    """
    spark = docs.sparkSession
    python_workers(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, first_word long, end_word long"
    out = None
    for block, several in _blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index, ids = _index(block), b.column("doc_id").to_pylist()
                hits = index.hits(b.column("text").to_pylist())
                cols = list(zip(*((ids[d], index.items[k][0], *window) for d, k, *window in hits))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(map(_int, c), pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "first_word", "end_word"])

        found = rows.mapInArrow(run, schema)
        found = durable(found) if several else found
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def _int(x) -> int | None:
    return None if x is None else int(x)


def _holder(block: Broadcast):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        dirty = {d for d, *_ in _index(block).hits(texts.to_pylist())}
        return pa.array([i in dirty for i in range(len(texts))], pa.bool_())

    return holds


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item, with docs' own columns.

    Decided row by row, so no text is shuffled. A row with a null doc_id is
    decided like any other. Of more items than a block holds, each block is a
    job of its own over what the one before has kept, written to the shared
    folder.
    """
    python_workers(docs.sparkSession)
    out = docs
    for block, several in _blocks(items):
        out = out.where(~_holder(block)(F.col("text").cast("string")))
        out = durable(out) if several else out
    return out
