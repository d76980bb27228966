"""Renames against all pairs and a greedy choice."""

import random
from collections import Counter

from plinth.operators.renames import renames, similar
from plinth.sources.tree import from_mapping


def ratio(a, b):
    x, y = (Counter(s.rstrip(" ") for s in t.split("\n") if s.strip(" ")) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def test_renames_equal_brute_force(spark):
    r = random.Random(2)
    line = lambda: r.choice(["}", "{", "", "return x;", *[f"const a{i} = {i};" for i in range(30)]])
    old = {f"old/{i}.ts": "\n".join(line() for _ in range(r.randint(1, 14))) for i in range(25)}
    new = {}
    for i, t in enumerate(old.values()):
        parts = t.split("\n")
        for _ in range(r.randint(0, 6)):
            parts.insert(r.randint(0, len(parts)), line()) if r.random() < 0.5 else parts and parts.pop(r.randrange(len(parts)))
        new[f"new/{i}.ts"] = "\n".join(parts)
    new |= {"new/blank.ts": "\n \n", "new/empty.ts": "", "new/copy.ts": old["old/3.ts"]}
    want = sorted(((ratio(a, b), o, n) for o, a in old.items() for n, b in new.items() if ratio(a, b) >= 0.5), key=lambda p: (-p[0], p[1], p[2]))
    a, b = from_mapping(spark, old), from_mapping(spark, new)
    assert {(x.old, x.new, round(x.similarity, 9)) for x in similar(a, b).collect()} == {(o, n, round(s, 9)) for s, o, n in want}
    seen, greedy = set(), set()
    for _, o, n in want:
        if o not in seen and n not in seen:
            seen |= {o, n}
            greedy.add((o, n))
    assert {(x.old, x.new) for x in renames(a, b).collect()} == greedy and greedy
    assert renames(a.limit(0), b).count() == 0


def test_no_plan_of_all_pairs(spark):
    files = from_mapping(spark, {"a": "x\n}", "b": "y\n}"})
    plan = similar(files, files)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
