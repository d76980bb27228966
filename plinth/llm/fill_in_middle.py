"""Fill-in-middle: documents cut in three and put together in another order.

A text counts in units (a run of ASCII letters, or one other code point). While
the units are counted, block by block, a sparse index keeps the byte and
code-point offset of every EVERY-th unit. A cut is found by binary search in
the index and a short scan from the checkpoint before it, so no list of all
units is held, however long the text is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import python_workers

#: Units between checkpoints, and bytes counted at once.
EVERY, BLOCK = 256, 1 << 18
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xbf][\x80-\xbf]*")
SCHEMA = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


class Index:
    """Number of units of a UTF-8 text, and the offsets of every `every`-th of them."""

    def __init__(self, data: bytes, every: int = EVERY, block: int = BLOCK) -> None:
        self.data, self.every = data, every
        self.units, self.bytes, self.points = ([], [], []) if data else ([0], [0], [0])
        self.n = points = 0
        after_letter = False
        for at in range(0, len(data), block):
            part = np.frombuffer(data, np.uint8, min(block, len(data) - at), at)
            letter = ((part | 32) - np.uint8(97)) < 26
            lead = (part & 0xC0) != 0x80
            opens = letter.copy()
            opens[1:] &= ~letter[:-1]
            opens[0] &= not after_letter
            opens |= lead & ~letter
            where = np.flatnonzero(opens)
            first = -self.n % every
            if picked := where[first::every].tolist():
                before = np.cumsum(lead) - lead
                self.units.extend(range(self.n + first, self.n + len(where), every))
                self.bytes.extend(at + x for x in picked)
                self.points.extend((points + before[picked]).tolist())
            self.n += len(where)
            points += int(np.count_nonzero(lead))
            after_letter = bool(letter[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first `units` units."""
        k = bisect_right(self.units, units) - 1
        at = end = self.bytes[k]
        for _ in range(units - self.units[k]):
            end = _UNIT.match(self.data, end).end()
        return end, self.points[k] + len(self.data[at:end].decode())


class Transformed(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(text: str, draws: tuple[int, int, int, int], plain: int = 90, spm: int = 20) -> Transformed:
    """One text cut after draws[0] and draws[1] mod n + 1 units; draws[2] and draws[3], of 100, choose the form."""
    index = Index(text.encode("utf-8", "surrogatepass"))
    if not text or draws[2] % 100 >= plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Transformed(index.n, "plain", None, None, text)
    (_, a), (_, b) = (index.cut(u) for u in sorted(d % (index.n + 1) for d in draws[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return Transformed(index.n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Transformed(index.n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def draws(key: str, seed: str = "1") -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the seed and the key alone."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain: int = 90, spm: int = 20) -> DataFrame:
    """docs' columns plus n, form, prefix_chars, middle_chars and output, the transformed text.

    The form is plain, the text as it is, for an empty text, one that contains a
    mark already, and where the third draw of 100 reaches `plain`; of the others,
    `spm` of 100 put the suffix first. Draws follow from the key, so equal keys
    give equal draws and rows that repeat give equal rows. A null text is as an
    empty one, a null key as an empty key. Columns of docs with the names of the
    new ones are replaced. An empty table gives an empty result.
    """
    python_workers(docs.sparkSession)

    @F.arrow_udf(SCHEMA)
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        out = [transform(t.as_py() or "", draws(k.as_py() or "", seed), plain, spm) for k, t in zip(keys, texts)]
        columns = list(zip(*out)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], list(Transformed._fields))

    made = docs.withColumn("__fim", run(F.col(key).cast("string"), F.col(text).cast("string")))
    return made.withColumns({c: F.col(f"__fim.{c}") for c in Transformed._fields}).drop("__fim")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the transformed one and its form: each mark stands once, as no part contains one."""

    def parts(second: str) -> tuple[Column, Column]:
        mark = F.lit(second)
        return F.substr(F.split_part(output, mark, F.lit(1)), F.lit(len(PREFIX) + 1)), F.split_part(F.split_part(output, mark, F.lit(2)), F.lit(MIDDLE), F.lit(1))

    (prefix, suffix), (suffix_first, prefix_last) = parts(SUFFIX), parts(PREFIX)
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Per document the counts of fill_in_middle, and the SHA-256 of its output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))
