"""SentencePiece encoding and decoding with merge-type vocabularies.

Text becomes symbols, one a character, and an agenda holds all pairs of
neighbours that together are a piece. The pair of the best score, the leftmost
of equals, is merged, its new neighbours' pairs join the agenda, and pairs
whose symbols have changed meanwhile are passed over. What no piece covers
falls back to bytes. Texts are cut where no piece can reach across, which the
vocabulary tells, and the ids of short cuts are remembered, so the agenda runs
once for most words.

The sentencepiece library checks every Arrow batch: it encodes all cuts that
the agenda has merged for the batch and decodes the ids of every text. Column
`checked` says whether both agree; a cut that was remembered has been checked
when it was merged.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.bpe import numbers
from plinth.llm.common import Memory, held, python_workers

#: What stands for a space in pieces (a fixed value).
SPACE = "▁"
#: Bytes of the cuts that a worker remembers of late, twice.
REMEMBERED = 112 << 20
#: Symbols up to which an agenda is a list, and the rank of no piece.
FEW, _NONE = 48, 1 << 62
#: Letters; numerals that are none of the decimal digits can stand in pieces with marks.
_LETTER = r"[^\W\d_¹²³¼-¾]"


class PieceBpe:
    """Pieces, scores and byte ids of a sentencepiece model of merge type without a text normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = m = SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        best = {score: k for k, score in enumerate(sorted({m.get_score(i) for i in plain}, reverse=True))}
        #: A piece's place by score, in the high bits of a number whose low bits take a place in the text.
        self.ranks = {self.pieces[i]: best[m.get_score(i)] << 32 for i in plain}
        self.end = m.eos_id()
        byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if m.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError(f"{path} has no byte fallback")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.bytes = {i: b for b, i in byte_ids.items()}
        self.silent = {i for i in range(len(self.pieces)) if m.is_control(i)}
        # What an id spells; parts of a character have to be taken together, see decode().
        self.spelt = np.array(["" if i in self.silent else chr(self.bytes[i]) if i in self.bytes else p for i, p in enumerate(self.pieces)], object)
        self.partial = np.array([self.bytes.get(i, 0) > 127 for i in range(len(self.pieces))])
        self._check(path)
        longer = [p for p in self.ids if len(p) > 1]
        joined = set("".join(longer))
        # Characters that no longer piece holds stand alone; a space mark begins a cut, unless another stands before it;
        # letters end before a mark that no piece holds right after a letter.
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        after = {y for p in longer for x, y in zip(p, p[1:]) if re.match(_LETTER, x)}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in after)
        letters = [f"{SPACE}*{_LETTER}+(?=[{marks}])"] if marks else []
        starts = all(SPACE not in p.lstrip(SPACE) for p in longer)
        rest = [f"{SPACE}*[^{SPACE}{alone}]+", f"{SPACE}+"] if starts else [f"[^{alone}]+"]
        self.cuts = re.compile("|".join(([f"[{alone}]"] if alone else []) + (letters if starts else []) + rest))
        #: A character that merges with nothing, and its ids at the beginning of a text.
        self.guard = next(c for c in "\n\ue000" if c not in joined)
        self.guard_ids = m.encode(self.guard)

    def _check(self, path: str) -> None:
        """Refuses models whose normaliser changes text, so that nothing is encoded otherwise than the library does."""
        for text in ("a  b ", " a", "ﬁ①ÅÅ​\t\n", ""):
            if self.library.decode(self.library.encode(text)) != text:
                raise ValueError(f"{path} normalises text")
        if self.library.encode("a") != self.library.encode("a", add_bos=False, reverse=False) or self.library.encode("a", out_type=str)[0][:1] != SPACE:
            raise ValueError(f"{path} has other settings")

    def merge(self, cut: str) -> list[int]:
        """Ids of one cut by the agenda of its pairs: a list in text order for few symbols, a heap for many."""
        return self._ids(self._few(list(cut)) if len(cut) <= FEW else self._many(cut))

    def _few(self, symbols: list[str]) -> list[str]:
        rank = self.ranks.get
        agenda = [rank(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < _NONE:
            left = agenda.index(best)
            symbols[left] += symbols.pop(left + 1)
            del agenda[left]
            if left < len(agenda):
                agenda[left] = rank(symbols[left] + symbols[left + 1], _NONE)
            if left:
                agenda[left - 1] = rank(symbols[left - 1] + symbols[left], _NONE)
        return symbols

    def _many(self, cut: str) -> list[str]:
        ranks, symbols = self.ranks, list(cut)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = [ranks[pair] + k for k, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in ranks]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            # A pair is out of date when either symbol has been merged since: what stands there has another rank.
            if right < 0 or ranks.get(pair := symbols[left] + symbols[right]) != entry - left:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = follow = after[right]
            after[right] = -1
            if follow >= 0:
                before[follow] = left
                if (rank := ranks.get(pair + symbols[follow])) is not None:
                    heappush(agenda, rank + left)
            if (lead := before[left]) >= 0 and (rank := ranks.get(symbols[lead] + pair)) is not None:
                heappush(agenda, rank + lead)
        return [x for x in symbols if x]

    def _ids(self, symbols: list[str]) -> list[int]:
        try:
            return [self.ids[x] for x in symbols]
        except KeyError:
            return [i for x in symbols for i in ([self.ids[x]] if x in self.ids else [self.byte_ids[b] for b in x.encode()])]

    def cut(self, text: str) -> list[str]:
        return self.cuts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def agrees(self, cuts: list[str], digits: list[str]) -> list[bool]:
        """Whether the library gives each cut these ids, after a character that merges with nothing."""
        n = len(self.guard_ids)
        theirs = self.library.encode([self.guard + c.replace(SPACE, " ") for c in cuts], num_threads=1)
        return [t[:n] == self.guard_ids and " ".join(map(str, t[n:])) == d for t, d in zip(theirs, digits)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: runs of byte ids as UTF-8, invalid bytes as U+FFFD each, the first piece without its leading space."""
        spelt = self.spelt[ids].tolist()
        if (partial := self.partial[ids]).any():
            where = np.flatnonzero(partial)
            for run in np.split(where, np.flatnonzero(np.diff(where) != 1) + 1):
                spelt[run[0]] = _utf8(bytes(map(ord, spelt[run[0] : run[-1] + 1])))
                spelt[run[0] + 1 : run[-1] + 1] = [""] * (len(run) - 1)
        first = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        if first is not None and self.pieces[ids[first]].startswith(SPACE):
            spelt[first] = spelt[first][1:]
        return "".join(spelt).replace(SPACE, " ")


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        return "".join(_one(run))


def _one(run: bytes) -> Iterator[str]:
    """Whole characters, and U+FFFD for each byte that begins none."""
    at = 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                yield run[at : at + size].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            yield "�"
        at += size


class _Cuts(Memory):
    """A cut -> its decimal ids, joined by spaces."""

    ENTRY = 200

    def __init__(self, bpe: PieceBpe) -> None:
        super().__init__(REMEMBERED)
        self.bpe, self.made, self.wrong = bpe, {}, set()

    def weigh(self, value: str) -> int:
        return len(value)

    def make(self, cut: str) -> str:
        self.made[cut] = out = " ".join(map(str, self.bpe.merge(cut)))
        return out

    def check(self, texts: list[str]) -> list[bool]:
        """Have the library encode what was merged since the last call; whether each text's cuts have all agreed."""
        same = self.bpe.agrees(list(self.made), list(self.made.values()))
        self.wrong.update(c for c, ok in zip(self.made, same) if not ok)
        self.made.clear()
        return [not self.wrong or self.wrong.isdisjoint(self.bpe.cut(t)) for t in texts]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, with the end id last."""
        return numbers(" ".join([*map(self.__getitem__, self.bpe.cut(text)), str(self.bpe.end)]))


def memory(path: str) -> _Cuts:
    return held("piece_bpe", path, lambda: _Cuts(PieceBpe(path)))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """docs' columns plus token_ids array<int>, with an end id, decoded string and checked boolean.

    A null text is as an empty one: the end id alone and an empty decoded text.
    Texts of any length are encoded whole; `checked` tells that the library gave
    the same ids for its cuts and the same text. Columns of docs with the new names are replaced. An
    empty table gives an empty result.
    """
    python_workers(docs.sparkSession)

    @F.arrow_udf("struct<token_ids:array<int>,decoded:string,checked:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        cuts = memory(model)
        plain = [t or "" for t in texts.to_pylist()]
        ids = [cuts.encode(t) for t in plain]
        decoded = [cuts.bpe.decode(i) for i in ids]
        theirs = cuts.bpe.library.decode([i.tolist() for i in ids], num_threads=1)
        same = [a and b == c for a, b, c in zip(cuts.check(plain), decoded, theirs)]
        at = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at), flat), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["token_ids", "decoded", "checked"])

    made = docs.withColumn("__piece", run(F.col("text").cast("string")))
    return made.withColumns({c: F.col(f"__piece.{c}") for c in ("token_ids", "decoded", "checked")}).drop("__piece")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document n_tokens, the digests of its ids and decoded text, and whether the library agrees."""
    made = encode_decode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "checked")
