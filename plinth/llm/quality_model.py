"""Quality classifier: a second-order factorisation machine.

Features are hashed words (a block of unit length), one-hot bins of structure
statistics, and a bin of the n_chars metadata. Every pair of features interacts
through the product of their RANK-dimensional factors; with the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
a document is scored in time linear in its features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Memory, held, python_workers
from plinth.llm.labelled import held_out, sample
from plinth.llm.toxicity import sigmoid

#: Labelled rows that the model is fitted on; the only bounded part.
SAMPLE = 8000
#: Bytes of the words that a worker remembers of late.
REMEMBERED = 16 << 20
WORD_BUCKETS = 1 << 13
RANK = 6
EPOCHS = 12
THRESHOLD = 0.3
#: Bin edges of each statistic; a value at an edge is in the upper bin.
EDGES = {
    "words": (1, 5, 10, 20, 50, 100, 200, 500, 1000, 5000),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 10),
    "upper": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.001, 0.005, 0.01, 0.03, 0.1, 0.3),
    "symbols": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "shouts": (0.001, 0.005, 0.02, 0.05, 0.1),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99),
    "top_word": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.25, 0.5),
    "repeats": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "repeated_lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "pipes": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "same_next": (0.005, 0.01, 0.02, 0.05, 0.2, 0.5),
    "n_chars": (1, 50, 100, 200, 500, 1000, 2000, 5000, 20000),
}
_OFFSETS = dict(zip(EDGES, np.cumsum([WORD_BUCKETS, *(len(e) + 2 for e in EDGES.values())]).tolist()))
SIZE = WORD_BUCKETS + sum(len(e) + 2 for e in EDGES.values())


class _Buckets(Memory):
    def make(self, word: str) -> int:
        return crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def _memory() -> _Buckets:
    return held("quality", "words", lambda: _Buckets(REMEMBERED))


def statistics(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """Shares and sizes of a text's structure."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    share = lambda letters: sum(map(text.count, letters)) / chars
    return {
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "upper": sum(map(str.isupper, text)) / chars,
        "digits": share("0123456789"),
        "symbols": share("#*$%&<>"),
        "shouts": share("!"),
        "distinct": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n,
        "repeats": 1 - len(set(grams)) / len(grams) if grams else 0.0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "pipes": counts["|"] / n,
        "same_next": sum(map(str.__eq__, words, words[1:])) / n,
    }


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text and its metadata; null metadata have a bin of their own."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = statistics(text, words, counts)
    known = _memory()
    block: dict[int, float] = {}
    for word, n in counts.items():
        at = known[word]
        block[at] = block.get(at, 0.0) + n
    value = np.sqrt(np.fromiter(block.values(), float, len(block)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    bins = [_OFFSETS[k] + (0 if x is None else 1 + int(np.searchsorted(EDGES[k], x, side="right"))) for k, x in (stats | {"n_chars": n_chars}).items()]
    return np.concatenate([np.fromiter(block.keys(), np.int64, len(block)), bins]).astype(np.int32), np.concatenate([value, np.ones(len(bins))]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """One score per row; every row has features, so no segment is empty."""
        at = ptr[:-1]
        vx = self.factors[idx] * val[:, None]
        both = np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)
        return self.bias + np.add.reduceat(self.linear[idx] * val, at) + 0.5 * both.sum(axis=1)


def fit(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.05, ridge: float = 1e-4) -> Machine:
    """AdaGrad on the log loss in fixed batches: the same rows in the same order give the same machine."""
    rnd = np.random.default_rng(7)
    m = Machine(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(SIZE, np.float32), rnd.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    gl, gf, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            sizes = ptr[rows + 1] - ptr[rows]
            take = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            i, x, p = idx[take], val[take], np.concatenate([[0], np.cumsum(sizes)])
            vx = m.factors[i] * x[:, None]
            sums = np.add.reduceat(vx, p[:-1])
            z = m.bias + np.add.reduceat(m.linear[i] * x, p[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, p[:-1])).sum(axis=1)
            r = np.repeat((sigmoid(z) - y[rows]) / len(rows), sizes)
            at, inv = np.unique(i, return_inverse=True)
            dl = np.bincount(inv, weights=r * x) + ridge * m.linear[at]
            df = (r * x)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            df = np.column_stack([np.bincount(inv, weights=df[:, f]) for f in range(RANK)]) + ridge * m.factors[at]
            gl[at] += dl**2
            gf[at] += df**2
            m.linear[at] -= rate * dl / np.sqrt(gl[at])
            m.factors[at] -= rate * df / np.sqrt(gf[at])
            d = float(r.sum() and (sigmoid(z) - y[rows]).mean())
            gb += d * d
            m.bias -= rate * d / gb**0.5
    return m


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y_quality"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["doc_id", "y_quality", "idx", "val"])


def _meta(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine | None:
    """The machine fitted on labels' doc_id and quality, without held-out rows; None if there is nothing to learn."""
    python_workers(docs.sparkSession)
    chosen = sample(docs.select("doc_id", "text", _meta(docs).alias("n_chars")), labels, ["quality"], rows, keep=("n_chars",))
    found = chosen.select("doc_id", "y_quality", "text", "n_chars").mapInArrow(_extract, "doc_id long, y_quality int, idx array<int>, val array<float>").toArrow()
    if not found.num_rows:
        return None
    idx, val = found["idx"].combine_chunks(), found["val"].combine_chunks()
    order = np.lexsort((np.array([float(x.values.to_numpy().sum()) for x in val]), found["doc_id"].to_numpy()))
    parts = [(idx[int(i)].values.to_numpy(), val[int(i)].values.to_numpy()) for i in order]
    ptr = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])])
    return fit(ptr, np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts]), found["y_quality"].to_numpy()[order].astype(float))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted; without a machine every score is 0.5."""
    spark = docs.sparkSession
    python_workers(spark)
    sent = spark.sparkContext.broadcast(machine)  # SIZE * (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            p = np.full(len(found), 0.5)
            if found and sent.value is not None:
                ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])])
                p = sigmoid(sent.value.logits(ptr, np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found])).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _meta(docs).alias("n_chars"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels and score every row of docs (doc_id, text, n_chars); see score.

    A null text is an empty one; null or absent n_chars are a bin of their own;
    a null doc_id has a null held_out. Repeated rows come back as often as they
    came; an empty table of documents gives an empty result.
    """
    return score(docs, train(docs, labels))
