"""op4 against a plain search by edit distance."""

import random
import time

import pytest

from plinth.llm import decontaminate as D
from plinth.llm.queries import QUERIES


def distance(item, text):
    """Least edit distance of item to any window of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = set()
    for i, text in docs:
        words = D.words_of(text)
        for k, item in items:
            n = D.words_of(item)
            allowed = int(len(n) * (1 - D.SIMILARITY) + 1e-9)
            if n and len(set(n) & set(words)) >= len(set(n)) - allowed and (e := distance(n, words)) <= allowed:
                out.add((i, k, e))
    return out


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = QUERIES["op4_decontaminate"](spark, d).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == brute(docs, items) and got


def test_recall_of_edited_passages(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "a"] * 40
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(9, 60)))) for k in range(60)]
    docs = []
    for i in range(400):
        words = items[rnd.randrange(60)][1].split()
        for _ in range(rnd.randint(0, len(words) // 5)):
            p = rnd.randrange(len(words))
            words[p : p + rnd.randint(0, 1)] = [rnd.choice(vocab)] if rnd.random() < 0.7 else []
        noise = [rnd.choice(vocab) for _ in range(rnd.randint(0, 300))]
        p = rnd.randint(0, len(noise))
        docs.append((i, " ".join([*noise[:p], *words, *noise[p:]])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in D.contamination(*frames).collect()}
    want = brute(docs, items)
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len({x[:2] for x in got}) >= 0.97 * len({x[:2] for x in want})
    assert {r.doc_id for r in D.clean(*frames).collect()} == {i for i, _ in docs} - {x[0] for x in got}


def test_edges(spark):
    item = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None, 0), (None, f"A, {item.upper()}!", 0), (2, "", 0), (3, "tiny item here", 0), (3, "tiny item here", 0), (4, "w " * 150000 + item, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (None, "Tiny item", 1)], "item_id long, text string, doc_id int")
    got = sorted((tuple(r)[:3] for r in D.contamination(docs, items).collect()), key=str)
    assert got == sorted([(None, 7, 0), (3, None, 0), (3, None, 0), (4, 7, 0)], key=str)
    assert D.contamination(docs.limit(0), items).count() == 0 and D.contamination(docs, items.limit(0)).count() == 0
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert D.clean(docs, items.limit(0)).count() == 6


def test_many_blocks_find_the_same(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, D.contamination(docs, items).collect()))
    words = sum(len(r.text.split()) for r in items.distinct().collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", words // 20)
    sent, gone = [], []
    monkeypatch.setattr(D.Index, "__init__", lambda self, found, make=D.Index.__init__: (sent.append(1), make(self, found))[1])
    for b, several in D._blocks(items):
        assert several
        slot = D.held("decontaminate", "index", D._Slot)
        slot.get(*b.value)
        gone.append(b)
    assert len(gone) >= 20 and len(sent) == len(gone) and sum(isinstance(x, D.Index) for x in vars(slot).values()) == 1
    monkeypatch.undo()
    monkeypatch.setattr(D, "BLOCK_WORDS", words // 20)
    assert sorted(map(tuple, D.contamination(docs, items).collect())) == one and one
    dirty = {r[0] for r in one}
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in dirty)
    # Workers are reused by all blocks: none holds more than one index, and a block's broadcast can no longer be read.

    def held_indexes(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Index" and hasattr(x, "walks") for x in gc.get_objects())], pa.int64())], ["n"])

    assert max(r.n for r in spark.range(64, numPartitions=16).mapInArrow(held_indexes, "n long").collect()) == 1
    with pytest.raises(Exception):
        spark.range(1).mapInArrow(lambda bs, b=gone[0]: (b.value and x for x in bs), "id long").collect()


def edited(lengths, seed, each=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    items, docs = [], []
    for n in lengths:
        for _ in range(each):
            words = [rnd.choice(vocab) for _ in range(n)]
            items.append((len(items), " ".join(words)))
            for _ in range(int(n * (1 - D.SIMILARITY) + 1e-9)):
                p = rnd.randrange(len(words))
                words[p : p + rnd.randint(0, 1)] = [rnd.choice(vocab)] if rnd.random() < 0.7 else []
            noise = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
            p = rnd.randint(0, len(noise))
            docs.append((len(docs), " ".join([*noise[:p], *words, *noise[p:]])))
    return docs, items


def test_recall_at_the_most_edits_by_size():
    for n in [*range(1, 26), 29, 30, 34, 40, 49, 59]:
        docs, items = edited([n], n, 300)
        hits = {h[:2] for h in D.Index([(i, D.words_of(t)) for i, t in items]).hits([t for _, t in docs])}
        assert sum((i, i) in hits for i in range(300)) >= 0.99 * 300, n


def test_short_items_against_brute_force(spark):
    docs, items = edited(range(1, 20), 6, 30)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in D.contamination(*frames).collect()}
    want = brute(docs, items)
    assert got <= want and len(got) >= 0.99 * len(want) and any(e for *_, e in got)


def test_one_word_repeated_takes_time_in_proportion():
    index = D.Index([(0, ["la"] * 60), (1, ["la"] * 7), (2, ["la"] * 3), (3, ["lo"] * 12)])
    took = {}
    for n in (4000, 64000):
        began = time.process_time()
        assert [h[:3] for h in index.hits(["lo la " * 8, "la " * n])] == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]
        took[n] = time.process_time() - began
    assert took[64000] < 40 * took[4000] + 1


def test_words_are_those_of_the_pattern():
    texts = ["Ab_c d-é 12३ ΑΣ 漢字x", None, "", "x" * (D.SPAN + 5) + " " + "x" * (D.SPAN + 5) + " y", "İstanbul e\u0301 \ud800a"]
    read = D.Words(texts)
    for i, t in enumerate(texts):
        assert read.words(read.first[i], read.first[i + 1]) == D.words_of(t)
    by_word = {}
    for word, h in zip(read.words(0, len(read.hash)), read.hash.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
