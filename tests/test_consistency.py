"""Rules to a fixpoint: chains of any length, rings, sums, examples, against plain loops."""

import json
import random

from mendframe.operators import consistency as C

BOUNDS, RULES = "schema_id string, path string, lo double, hi double", "schema_id string, a string, op string, b string"


def brute(bounds, rules):
    """Bounds and strict rings of one schema, by relaxation and a search from every field."""
    edges = {}
    for a, op, b in rules:
        pair = {"lt": (a, b, 1), "lte": (a, b, 0), "gt": (b, a, 1), "gte": (b, a, 0)}.get(op)
        if pair:
            edges[pair[:2]] = max(edges.get(pair[:2], 0), pair[2])

    def reach(start):
        seen, todo = {}, [(start, 0)]
        while todo:
            at, strict = todo.pop()
            for (x, y), gap in edges.items():
                s = max(strict, gap)
                if x == at and seen.get(y, -1) < s:
                    seen[y] = s
                    todo.append((y, s))
        return seen

    ways = {x: reach(x) for e in edges for x in e}
    now = dict(bounds)
    while True:
        was = dict(now)
        for (x, y), gap in edges.items():
            gap = 0 if x in ways[y] else gap
            (lo, hi), (lo2, hi2) = now.get(x, (None, None)), now.get(y, (None, None))
            if lo is not None and (lo2 is None or lo2 < lo + gap):
                now[y] = (lo + gap, hi2)
            if hi2 is not None and (hi is None or hi > hi2 - gap):
                now[x] = (lo, hi2 - gap)
        if now == was:
            return now, {x for x in ways if ways[x].get(x) == 1}


def test_random_rules(spark):
    r = random.Random(4)
    bounds, rules = [], []
    for s in range(25):
        names = [f"f{i}" for i in range(r.randrange(2, 7))]
        bounds += [(f"s{s}", n, float(r.randrange(10)) if r.random() < 0.6 else None, float(r.randrange(5, 20)) if r.random() < 0.6 else None) for n in names]
        rules += [(f"s{s}", r.choice(names), r.choice(["lt", "lte", "gt", "gte", "odd"]), r.choice(names)) for _ in range(r.randrange(7))]
    names = [f"c{i:02}" for i in range(23)]  # a chain longer than any count of passes
    bounds += [("chain", n, 0.0 if n == "c00" else None, 30.5 if n == "c22" else None) for n in names]
    rules += [("chain", a, "lt", b) for a, b in zip(names, names[1:])] + [("chain", None, "lt", "c01"), (None, "a", "lt", "b")]
    held, rings = C.solved(spark.createDataFrame(bounds, BOUNDS), spark.createDataFrame(rules, RULES))
    got, ring = {}, {}
    for x in held.collect():
        got.setdefault(x.schema_id, {})[x.path] = (x.lo, x.hi)
    for x in rings.collect():
        ring.setdefault(x.schema_id, set()).add(x.path)
    for s in {b[0] for b in bounds}:
        want, wanted = brute({p: (lo, hi) for k, p, lo, hi in bounds if k == s}, [x[1:] for x in rules if x[0] == s and x[1]])
        assert got[s] == want and ring.get(s, set()) == wanted, s
    assert got["chain"]["c22"] == (22.0, 30.5) and got["chain"]["c00"] == (0.0, 8.5)


def test_conflicts_and_examples(spark):
    bounds = [("sum", "total", 0.0, 10.0), ("sum", "a", 50.0, 100.0), ("sum", "b", 50.25, 100.0), ("less", "d", 5.0, None), ("less", "a", 0.0, 3.0), ("less", "b", 1.0, 9.0), ("fine", "x", None, 4.0), ("fine", "y", 1.0, None), ("fine", "z", None, None), ("own", "x", 100.0, 50.0)]
    rules = [("sum", "total", "eq", "a + b"), ("less", "d", "eq", "a - b"), ("fine", "x", "eq", "y + nowhere"), ("ring", "p", "lt", "q"), ("ring", "q", "lt", "p")]
    b, r = spark.createDataFrame(bounds, BOUNDS), spark.createDataFrame(rules, RULES)
    got = sorted((x.schema_id, x.reason) for x in C.conflicts(b, r).collect())
    assert got == [
        ("less", "arithmetic infeasibility: a - b maximum possible value (2) < d.min (5)"), ("own", "range conflict: x requires min(100) <= max(50)"),
        ("ring", "cycle conflict: strict ordering cycle through p"), ("ring", "cycle conflict: strict ordering cycle through q"), ("sum", "arithmetic infeasibility: a + b minimum possible value (100.25) > total.max (10)"),
    ]
    types = spark.createDataFrame([("fine", "x", "integer"), ("fine", "y", "number"), ("fine", "z", "string"), ("own", "x", "number")], "schema_id string, path string, type string")
    assert {x.schema_id: json.loads(x.example) for x in C.examples(b, r, types).collect()} == {"fine": {"x": 3, "y": 2.0, "z": 0.0}}
    assert C.conflicts(b.limit(0), r.limit(0)).count() == 0
