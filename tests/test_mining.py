"""Consistency, structure, patterns and rules against literal versions on small fixtures."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from mnemion.operators import consistency as con
from mnemion.operators import patterns as pat
from mnemion.operators import structure as stc

REL = "src long, dst long, rel string"


def reach(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        todo, seen = list(near[n]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out[n] = seen
    return out


def test_cycles_and_transitivity_equal_search(spark, monkeypatch):
    monkeypatch.setattr(con, "TRIMS", 2)
    monkeypatch.setattr(con, "WIDE", 2)
    rng = random.Random(7)
    relations = [(k, k + 1, rng.choice(con.ORDERING)) for k in range(40) if k % 9] + [(14, 10, "BEFORE"), (22, 25, "AFTER"), (25, 22, "AFTER"), (31, 31, "CAUSES"), (3, 2, "DURING"), (None, 4, "BEFORE")]
    relations += [(rng.randrange(60, 80), rng.randrange(60, 80), "BEFORE") for _ in range(22)]
    times = [(k, None if k % 10 == 0 else (k if k % 7 else k - 4) * 10) for k in range(80) if k != 33]
    pairs = {(b, a) if r == "AFTER" else (a, b) for a, b, r in relations if a is not None and r != "DURING"}
    ways = reach(pairs)
    r, e = spark.createDataFrame(relations, REL), spark.createDataFrame(times, "id long, t long")
    on = {a: min(b for b in ways[a] if a in ways[b]) for a in ways if a in ways[a]}
    want = {(a, min(a, c), sum(v == c for v in on.values())) for a, c in on.items()}
    assert {tuple(x) for x in con.cycles(r).collect()} == want and len({c for _, c, _ in want}) >= 3
    t = {k: x for k, x in times if x is not None}
    bad = {(a, b, t[a], t[b]) for a in ways for b in ways[a] if a != b and a in t and b in t and t[a] >= t[b]}
    assert {tuple(x) for x in con.transitive_violations(r, e).collect()} == bad and bad
    assert con.cycles(r.limit(0)).count() == con.transitive_violations(r.limit(0), e).count() == 0


def test_single_relations(spark):
    events = spark.createDataFrame([(1, 100, 50), (2, 120, 0), (3, 200, None), (4, None, 5), (5, 150, 10), (6, 100, None)], "id long, t long, duration long")
    rows = {
        (1, 2, "CAUSES"): None, (2, 1, "CAUSES"): ("causal_order", "error"), (1, 6, "PREVENTS"): ("causal_order", "error"), (1, 9, "ENABLES"): ("unknown_event", "warning"), (4, 1, "TRIGGERS"): ("missing_time", "error"),
        (2, 1, "DURING"): None, (5, 1, "DURING"): None, (3, 1, "DURING"): ("interval", "warning"), (3, 2, "DURING"): None, (1, 5, "CONTAINS"): None, (1, 3, "CONTAINS"): ("interval", "warning"), (3, 1, "CONTAINS"): None,
        (1, 6, "SIMULTANEOUS"): None, (1, 2, "SIMULTANEOUS"): ("interval", "warning"), (1, 4, "SIMULTANEOUS"): None, (2, 1, "BEFORE"): None, (9, 1, "DURING"): None,
    }
    relations = spark.createDataFrame(list(rows), REL)
    found = con.pair_violations(relations, events)
    assert {((r.src, r.dst, r.rel), (r.violation, r.severity)) for r in found.collect()} == {x for x in rows.items() if x[1]}
    kinds = {r.violation: (r.errors, r.warnings) for r in con.report(con.violations(relations, events, strict=False)).collect()}
    assert kinds["missing_time"] == (0, 1) and kinds["causal_order"] == (2, 0) and kinds["cycle"] == (2, 0) and kinds["transitivity"] == (3, 0)


def test_structure_of_a_known_chain(spark):
    """a leads to b and b to c; d stands apart: a and c are independent given b only."""
    rng = random.Random(1)
    rows = []
    for day in range(60):
        for entity in range(40):
            a = rng.random() < 0.4
            b = rng.random() < (0.8 if a else 0.1)
            c = rng.random() < (0.8 if b else 0.1)
            rows += [(entity, f"2024-{1 + day // 28:02}-{1 + day % 28:02} 10:00:00", t) for t, x in (("a", a), ("b", b), ("c", c), ("d", rng.random() < 0.3)) for _ in range(2) if x]
    events = spark.createDataFrame(rows, "entity long, ts string, type string").withColumn("ts", F.col("ts").cast("timestamp"))
    order = spark.createDataFrame([("b", "a", 3), ("a", "b", 9), ("c", "b", 5)], "src_type string, dst_type string, n long")
    found = {(r.cause, r.effect): (r.linked, r.size, r.undecided) for r in stc.causal_structure(events, order, alpha=0.001).collect()}
    assert found[("a", "b")] == (True, None, False) and found[("c", "b")] == (True, None, False)
    assert found[("a", "c")] == (False, 1, True) and all(not found[p][0] and found[p][1] == 0 for p in found if "d" in p)
    patterns = stc.presence(events, ["a", "b", "c", "d"])
    assert patterns.agg(F.sum("n")).first()[0] == 40 * 64  # of 64 days, four without a draw
    # Given two others, by hand.
    n = {r.pattern: r.n for r in patterns.collect()}
    g = 0.0
    for s in (0, 2, 8, 10):
        at = lambda x, y: sum(v for p, v in n.items() if p & 10 == s and bool(p & 1) == x and bool(p & 4) == y)  # noqa: B023, E731
        whole = sum(at(x, y) for x in (0, 1) for y in (0, 1))
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if v := at(x, y):
                g += 2 * v * math.log(v * whole / ((at(x, 0) + at(x, 1)) * (at(0, y) + at(1, y))))
    r = stc.independence(patterns, spark.createDataFrame([(1, 4, 10)], "a long, b long, given long")).first()
    assert abs(r.g - g) < 1e-6 and r.dof == 4 and abs(r.p_value - math.exp(-g / 2) * (1 + g / 2)) < 1e-9


def test_tests_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    patterns = spark.createDataFrame([(k, rng.randrange(1, 50)) for k in range(32)], "pattern long, n long")
    tests = spark.createDataFrame([(1 << a, 1 << b, 1 << c) for a, b in combinations(range(5), 2) for c in range(5) if c not in (a, b)], "a long, b long, given long")
    want = sorted(map(tuple, stc.independence(patterns, tests).select("a", "b", "given", F.round("g", 8)).collect()))
    monkeypatch.setattr(stc, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, stc.independence(patterns, tests).select("a", "b", "given", F.round("g", 8)).collect())) == want


def literal_patterns(edges, label, size, least):
    near = defaultdict(set)
    for a, b, r in edges:
        near[a].add((r, b))

    def trees(node, k, after=""):
        """{(tree text without label, ways)} of k edges at node; ways counted."""
        if k == 0:
            return {"": 1}
        out = defaultdict(int)
        for rel in {r for r, _ in near[node] if r > after}:
            for j in range(k):
                planted = defaultdict(int)
                for r, b in near[node]:
                    if r == rel:
                        for t, n in trees(b, j).items():
                            planted[label[b] + (f"[{t}]" if t else "")] += n
                for t, n in planted.items():
                    for rest, m in trees(node, k - 1 - j, rel).items():
                        out[f"{rel}>{t}" + (f",{rest}" if rest else "")] += n * m
        return out

    found = defaultdict(lambda: [0, 0])
    for k in range(1, size + 1):
        for node in label:
            for t, n in trees(node, k).items():
                row = found[f"{label[node]}[{t}]", k]
                row[0] += 1
                row[1] += n
    return {(s, k, *v) for (s, k), v in found.items() if v[0] >= least}


def test_patterns_equal_enumeration(spark):
    rng = random.Random(9)
    label = {f"{x}{k}": x for x in "abc" for k in range(6)}
    ids = list(label)
    edges = list({(rng.choice(ids), rng.choice(ids), rng.choice(["R", "S", "T"])) for _ in range(40)})
    found = pat.frequent_patterns(spark.createDataFrame(edges + edges[:5], "src string, dst string, rel string"), spark.createDataFrame(list(label.items()), "id string, label string"), 3, 2)
    want = literal_patterns(edges, label, 3, 2)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20


def test_rules_by_hand(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice(["R", "S", "T"])) for _ in range(60)]
    rules = [("one", ["R"], "T"), ("two", ["R", "S"], "T"), ("three", ["S", "S", "R"], "T"), ("none", ["X", "R"], "T"), ("never", ["R"], "Y")]
    near = lambda rel: {(a, b) for a, b, r in edges if r == rel}
    metrics, missing = set(), set()
    for name, path, conclusion in rules:
        pairs = near(path[0])
        for rel in path[1:]:
            pairs = {(a, d) for a, b in pairs for c, d in near(rel) if b == c}
        known = near(conclusion)
        tp, fp, fn = len(pairs & known), len(pairs - known), len(known - pairs)
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        metrics.add((name, tp + fp, tp, fp, fn, round(p, 9), round(r, 9), round(2 * p * r / (p + r) if p + r else 0.0, 9)))
        missing |= {(name, a, conclusion, b) for a, b in pairs - known}
    e, t = spark.createDataFrame(edges, "src string, dst string, rel string"), spark.createDataFrame(rules, "rule string, path array<string>, conclusion string")
    assert {(*r[:5], *[round(x, 9) for x in r[5:]]) for r in pat.rule_metrics(e, t).collect()} == metrics
    assert {tuple(r) for r in pat.missing_edges(e, t).collect()} == missing
