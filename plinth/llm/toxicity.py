"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; the probabilities of earlier categories are
features of later models. In training those features are out-of-fold
predictions, so a later model learns from what an earlier one says of documents
it has not seen. Features are hashed words and word beginnings; each model is
logistic regression over the buckets that part the labels best.

The labels table has one toxicity label, so the query's categories are graded
by it: `insult` (toxic, with a telling word), `repeated` (toxic, with REPEATS
or more) and `toxic` itself. Which words tell is found anew without a fold's
rows for the models that predict that fold. fit_chain takes any categories.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Memory, held, python_workers
from plinth.llm.labelled import sample

#: Labelled rows that the models are fitted on; the only bounded part.
SAMPLE = 12000
#: Bytes of the words that a worker remembers of late.
REMEMBERED = 16 << 20
BUCKETS = 1 << 20
BEGINNING = 6
#: Buckets that a model looks at, and the fewest documents of the sample a bucket must have.
SELECTED = 3000
SUPPORT = 4
FOLDS = 4
TELLING = 150
REPEATS = 4
THRESHOLD = 0.3
CATEGORIES = ("insult", "repeated", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


class _Buckets(Memory):
    def make(self, word: str) -> tuple[int, ...]:
        h = (crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS,)
        return h + ((crc32(b"^" + word[:BEGINNING].encode("utf-8", "surrogatepass")) % BUCKETS,) if len(word) >= BEGINNING else ())


def _memory() -> _Buckets:
    return held("toxicity", "words", lambda: _Buckets(REMEMBERED))


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text, ascending."""
    known = _memory()
    found = {b for w in set(_WORD.findall((text or "").lower())) for b in known[w]}
    return np.array(sorted(found), dtype=np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """Sparse rows: row r has the buckets idx[ptr[r]:ptr[r + 1]]."""

    ptr: np.ndarray
    idx: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]), np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))


def telling(rows: Rows, y: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` buckets by chi-square against y, best first; ties by bucket."""
    ids, inverse = np.unique(rows.idx, return_inverse=True)
    n, p = len(rows), max(y.sum(), 1e-9)
    total = np.bincount(inverse, minlength=len(ids)).astype(float)
    hit = np.bincount(inverse, weights=y[rows.owners()], minlength=len(ids))
    expected = total * p / n
    score = np.where(total >= SUPPORT, (hit - expected) ** 2 / np.maximum(expected * (1 - p / n), 1e-9), -1.0)
    order = np.lexsort((ids, -score))[:most]
    return ids[order[score[order] > 0]]


@dataclass
class Linear:
    """Logistic regression over selected buckets and a few dense columns."""

    at: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.at, rows.idx)
        place[place == len(self.at)] = 0
        hit = self.at[place] == rows.idx if len(self.at) else np.zeros(len(rows.idx), bool)
        out = np.bincount(rows.owners()[hit], weights=self.weights[place[hit]], minlength=len(rows)) if hit.any() else np.zeros(len(rows))
        return out + dense @ self.dense + self.bias


def fit_linear(rows: Rows, dense: np.ndarray, y: np.ndarray, steps: int = 250, ridge: float = 2e-4) -> Linear:
    """Full-batch Adam on the ridge-regularised log loss, from zero: the same rows give the same model."""
    at = np.sort(telling(rows, y, SELECTED))
    place = np.searchsorted(at, rows.idx)
    place[place == len(at)] = 0
    hit = at[place] == rows.idx if len(at) else np.zeros(len(rows.idx), bool)
    cols, own = place[hit], rows.owners()[hit]
    k, d = len(at), dense.shape[1]
    w, m, v = np.zeros(k + d + 1), np.zeros(k + d + 1), np.zeros(k + d + 1)
    for t in range(1, steps + 1):
        z = np.bincount(own, weights=w[cols], minlength=len(y)) + dense @ w[k : k + d] + w[-1]
        r = (sigmoid(z) - y) / max(len(y), 1)
        g = np.concatenate([np.bincount(cols, weights=r[own], minlength=k), dense.T @ r, [r.sum()]])
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(at, w[:k], w[k : k + d], float(w[-1]))


def _part(rows: Rows, keep: np.ndarray) -> Rows:
    return Rows.of([rows.idx[rows.ptr[i] : rows.ptr[i + 1]] for i in np.flatnonzero(keep)])


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray, by_fold: dict[int, np.ndarray] | None = None) -> list[Linear]:
    """One model per column of labels; folds numbers each row's fold.

    by_fold has for each fold the labels that its out-of-fold models learn, where
    they are made from the rows themselves: then without that fold's.
    """
    chain, seen = [], np.zeros((len(rows), 0))
    for c, y in enumerate(labels.T.astype(float)):
        chain.append(fit_linear(rows, seen, y))
        out = np.zeros(len(rows))
        for f in np.unique(folds).tolist():
            inside, outside = folds == f, folds != f
            learned = y if by_fold is None else by_fold[f][:, c].astype(float)
            model = fit_linear(_part(rows, outside), seen[outside], learned[outside])
            out[inside] = sigmoid(model.logits(_part(rows, inside), seen[inside]))
        seen = np.column_stack([seen, out])
    return chain


def predict_chain(chain: list[Linear], rows: Rows) -> np.ndarray:
    """A column of probabilities for each category, each fed to the next."""
    seen = np.zeros((len(rows), 0))
    for model in chain:
        seen = np.column_stack([seen, sigmoid(model.logits(rows, seen))])
    return seen


def graded(rows: Rows, toxic: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The columns of CATEGORIES for a single toxicity label; what tells is learned from the rows of `among` alone."""
    known = np.sort(telling(_part(rows, among), toxic[among].astype(float), TELLING))
    place = np.searchsorted(known, rows.idx)
    place[place == len(known)] = 0
    hit = known[place] == rows.idx if len(known) else np.zeros(len(rows.idx), bool)
    hits = np.bincount(rows.owners()[hit], minlength=len(rows))
    return np.column_stack([toxic & (hits >= 1), toxic & (hits >= REPEATS), toxic]).astype(float)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [buckets(t).tolist() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y_toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y_toxic", "idx"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[Linear]:
    """The chain for a labels table with doc_id and toxic; an empty list where there is nothing to learn."""
    python_workers(docs.sparkSession)
    found = sample(docs, labels, ["toxic"], rows, train_only=False).select("doc_id", "y_toxic", "text").mapInArrow(_features, "doc_id long, y_toxic int, idx array<int>").toArrow()
    if not found.num_rows:
        return []
    order = np.lexsort((np.array([hash(tuple(x)) for x in found["idx"].to_pylist()]), found["doc_id"].to_numpy()))
    idx = found["idx"].combine_chunks()
    parts = [idx[int(i)].values.to_numpy() for i in order]
    given, toxic = found["doc_id"].to_numpy()[order], found["y_toxic"].to_numpy()[order] == 1
    folds = np.array([crc32(str(d).encode()) // 5 % FOLDS for d in given])
    data = Rows.of(parts)
    by_fold = {f: graded(data, toxic, folds != f) for f in np.unique(folds).tolist()}
    return fit_chain(data, graded(data, toxic, np.ones(len(data), bool)), folds, by_fold)


def score(docs: DataFrame, chain: list[Linear]) -> DataFrame:
    """docs' columns plus p_<category> of each of CATEGORIES and is_toxic.

    A null text is an empty one. Without a chain (nothing to learn from) the
    probabilities are 0 and nothing is toxic. Columns of docs with those names
    are replaced.
    """
    spark = docs.sparkSession
    python_workers(spark)
    sent = spark.sparkContext.broadcast(chain)  # SELECTED weights for each category

    @F.arrow_udf(f"struct<{','.join(f'{c}:double' for c in CATEGORIES)}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = Rows.of([buckets(t.as_py()) for t in texts])
        p = predict_chain(sent.value, rows) if sent.value else np.zeros((len(rows), len(CATEGORIES)))
        return pa.StructArray.from_arrays([pa.array(x) for x in p.T], list(CATEGORIES))

    names = {f"p_{c}": F.col(f"__chain.{c}") for c in CATEGORIES}
    out = docs.withColumn("__chain", run(F.col("text").cast("string"))).withColumns(names).drop("__chain")
    return out.withColumn("is_toxic", F.col(f"p_{CATEGORIES[-1]}") >= THRESHOLD)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels and score every row of docs; see score.

    Repeated rows come back as often as they came; an empty table of documents
    gives an empty result, an empty table of labels one in which nothing is
    toxic. Null doc_ids are scored, never learned from.
    """
    return score(docs, train(docs, labels))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the chain rejects, with docs' own columns, whatever their names; see toxicity."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = score(packed, train(docs, labels)).where(~F.col("is_toxic"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
