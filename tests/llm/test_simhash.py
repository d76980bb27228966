"""op5 against a brute-force search."""

import random

import numpy as np
import xxhash

from plinth.llm import simhash
from plinth.llm.components import components
from plinth.llm.queries import QUERIES


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    """(doc_id, fingerprint, component_id) by comparing every pair."""
    prints = [plain_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, f"{p:016x}", low[top(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_simhash"](spark, sf).collect()), key=str) == brute(rows)


def test_near_copies_and_edges(spark):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghij") * rnd.randint(1, 5) for _ in range(120)]
    rows = [(100 + i, " ".join([*base[:i], "zz", *base[i + 1 :]])) for i in range(60)]
    rows += [(5, None), (None, ""), (6, " \t "), (7, "one"), (7, "one"), (None, "two words"), (8, "ONE"), (9, "x" * 200000)]
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, fp string, root string")
    got = sorted(map(tuple, simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute(rows)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = {(d if d is None else c) for d, _, c in brute(rows)}
    assert {d for d, _ in found} == want and len(found) == len({(f if c is None else c) for _, f, c in brute(rows)})
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_keys_meet_for_every_pair_of_two_bits():
    rnd = np.random.default_rng(1)
    fp = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    for a in range(0, 64, 3):
        for b in range(0, 64, 5):
            other = fp ^ np.uint64(1 << a) ^ (np.uint64(1 << b) if a != b else np.uint64(0))
            one, two = (simhash.golay_key(simhash.midpoints(x)) for x in (fp, other))
            assert all(set(x) & set(y) for x, y in zip(one.tolist(), two.tolist()))
    assert max(len(set(r)) for r in simhash.golay_key(simhash.midpoints(fp)).tolist()) <= 25


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}
