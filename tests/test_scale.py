"""Operators in the small pieces that they take at scale: lists cut short, hubs dealt over tasks, few rows at once."""

from __future__ import annotations

import random
import re
from itertools import combinations
from math import log

import numpy as np

from mnemion.operators import communities, graph, knowledge, patterns, relations, retrieval
from mnemion.sources.staging import setting


def test_rules_in_short_lists(spark, monkeypatch):
    monkeypatch.setattr(patterns, "LISTED", 1)
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("RS")) for _ in range(60)] + [("n1", None, "S"), (None, "n2", "R")]
    paths = {"many": ["R", "S", "R"], "hub": ["S", "R"], "one": ["S"]}
    want = set()
    for name, path in paths.items():
        pairs = {(a, b) for a, b, r in edges if r == path[0]}
        for rel in path[1:]:
            pairs = {(a, d) for a, b in pairs for c, d, r in edges if r == rel and b == c and b is not None}
        want |= {(name, a, b) for a, b in pairs}
    rules = spark.createDataFrame([(n, p, "R") for n, p in paths.items()], "rule string, path array<string>, conclusion string")
    assert {tuple(r) for r in patterns.path_pairs(spark.createDataFrame(edges, "src string, dst string, rel string"), rules).collect()} == want


def test_shared_neighbours_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph, "MET", 4)
    rng = random.Random(5)
    near = {a: {rng.randrange(6) for _ in range(4)} for a in range(14)}
    n = {m: sum(m in s for s in near.values()) for m in range(6)}
    want = {(a, b): (len(near[a] & near[b]), round(sum(1 / log(n[m]) for m in near[a] & near[b]), 6)) for a, b in combinations(near, 2) if near[a] & near[b]}
    scores = graph.shared_neighbours(spark.createDataFrame([(a, m) for a, s in near.items() for m in s], "src long, dst long"))
    assert {(r.a, r.b): (r.shared, round(r.adamic, 6)) for r in scores.collect()} == want
    groups = spark.createDataFrame([(a, a % 3 if a != 5 else None) for a in near], "id long, group long")
    new = {(r.a, r.b) for r in graph.predict_links(scores, groups=groups).collect()}
    assert new == {(a, b) for a, b in want if a % 3 != b % 3 or 5 in (a, b)}


def test_shared_neighbours_shuffle_no_pairs(spark, monkeypatch):
    """Lists go to blocks of nodes, pairs are counted there and their degrees are sent to them; ids may be negative, far apart or names."""
    monkeypatch.setattr(graph, "MET", 40)
    rng = random.Random(8)
    near = {a * 10**15: {rng.randrange(30) for _ in range(rng.randrange(1, 9))} for a in range(-6, 7)} | {a: {rng.randrange(30) for _ in range(6)} for a in range(1, 90, 3)}
    n = {m: sum(m in s for s in near.values()) for m in range(30)}
    want = {(a, b): (len(near[a] & near[b]), round(len(near[a] & near[b]) / len(near[a] | near[b]), 9), round(sum(1 / log(n[m]) for m in near[a] & near[b]), 6)) for a, b in combinations(sorted(near), 2) if near[a] & near[b]}
    edges = spark.createDataFrame([(a, m) for a, s in near.items() for m in s] + [(3, None), (None, 4)], "src long, dst long").where("src is null or dst is not null")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found = graph.shared_neighbours(edges)
        assert not re.search(r"hashpartitioning\([ab]#", found._jdf.queryExecution().executedPlan().toString())
        rows = lambda df: {(r.a, r.b): (r.shared, round(r.jaccard, 9), round(r.adamic, 6)) for r in df.collect()}
        assert rows(found) == want
    named = graph.shared_neighbours(edges.selectExpr("concat('n', src) as src", "dst"))
    assert rows(named) == {tuple(sorted((f"n{a}", f"n{b}"))): v for (a, b), v in want.items()}
    monkeypatch.setattr(graph, "NODES", 3, raising=False)
    assert rows(graph.shared_neighbours(edges)) == want


def test_predicted_links_write_no_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name, put=graph.stage: written.append(name) or put(df, name))
    scores = spark.createDataFrame([(1, 2, 3, 0.5, 4.0), (1, 3, 20, 0.2, 2.0), (2, 3, 1, 0.1, 1.0), (2, 4, 5, 0.25, 0.5)], "a long, b long, shared long, jaccard double, adamic double")
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (2, 8), (3, None)], "id long, group long")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found = graph.predict_links(scores, groups=groups)
        assert not re.search(r"hashpartitioning\([ab]#", found._jdf.queryExecution().executedPlan().toString())
        assert {(r.a, r.b): round(r.score, 9) for r in found.collect()} == {(1, 3): round((1 + 0.2 + 1) / 3, 9), (2, 4): round((0.5 + 0.25 + 0.25) / 3, 9)}
    assert written == ["groups"]


def test_sharing_is_all_pairs_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 3, raising=False)
    monkeypatch.setattr(graph, "PAIRS", 50, raising=False)
    edges = [(f"p{i}", "hub") for i in range(20)] + [(f"p{i}", f"s{i % 9}") for i in range(30)] + [("p1", "hub")]
    found = graph.sharing(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted({(a, b) for a, s in edges for b, t in edges if s == t and a != b})


def test_labels_in_short_lists(spark, monkeypatch):
    rng = random.Random(6)
    edges = spark.createDataFrame([(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(25)], "src string, dst string")
    whole = {tuple(r) for r in graph.label_propagation(edges).collect()}
    monkeypatch.setattr(graph, "NEAR", 1)
    assert {tuple(r) for r in graph.label_propagation(edges).collect()} == whole


def test_split_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(communities, "MEMBERS", 3)
    rng = np.random.default_rng(2)
    v = {i: rng.normal(size=3) for i in range(24)}
    want, leaders = {}, []
    for i in v:
        cos = [(j, v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])) for j in leaders]
        want[i] = next((j for j, c in cos if c >= 0.7), i)
        leaders += [i] * (want[i] == i)
    found = communities.split_by_meaning(spark.createDataFrame([(i, "c") for i in v], "id long, community string"), spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, vector array<double>"), block=4)
    assert {r.id: r.leader for r in found.collect()} == want


def test_searches_hold_few_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS", 40)
    monkeypatch.setattr(retrieval, "AT_ONCE", 50)
    seen, distances = [], retrieval._distances
    monkeypatch.setattr(retrieval, "_distances", lambda x, c: seen.append(len(x) * len(c)) or distances(x, c))
    x = np.random.default_rng(1).normal(size=(150, 4))
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, v array<double>")
    asked = rows.where("id % 10 = 0").selectExpr("id as query_id", "v as qv")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(rows, asked, 3, "l2").collect()}
    order = {q: [i for i in np.argsort(np.linalg.norm(x - x[q], axis=1)) if i != q][:3] for q in range(0, 150, 10)}
    assert got == {(q, k + 1): i for q, o in order.items() for k, i in enumerate(o)}


def test_sketches_beside_exact_counts(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), (None, 7, 2.0), (None, None, 2.0), ("b", None, None)], "type string, k long, v double")
    df = knowledge.approximate(rows, ["type"], "k", "v")
    assert {tuple(r) for r in df.collect()} == {("a", 2, 3.0, 2), (None, 1, 2.0, 1), ("b", 0, None, 0)}
    assert "approx_count_distinct" not in next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "count(" in line)


def test_texts_of_one_file_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relations, "DEALT", 5, raising=False)
    texts = spark.createDataFrame([(i, f"red box. blue {i} red box. tin") for i in range(60)], "id long, text string").coalesce(1)
    found = relations.phrase_mentions(texts, spark.createDataFrame([("red box",), ("tin",)], "name string"))
    assert re.search(r"hashpartitioning\(id#\d+L?, 13\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.id, r.name, r.at) for r in found.collect()) == sorted((i, n, k) for i in range(60) for n, k in (("red box", 1), ("red box", 5), ("tin", 7)))


def test_edges_are_counted_where_a_node_is(spark):
    """No table by id and community is held by the tasks that read the edges."""
    edges = spark.createDataFrame([(i % 7, 100 + i % 5) for i in range(70)], "src long, dst long")
    found = communities.joined_communities(edges, spark.createDataFrame([(100 + i, i) for i in range(5)], "id long, community long"), spark.createDataFrame([(i,) for i in range(7)], "id long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "repartition_by_num" in plan.lower() and not re.search(r"hashpartitioning\(id#\d+L?, community#", plan)
    assert {(r.id, r.community, round(r.share, 6)) for r in found.collect()} == {(i, None, 0.2) for i in range(7)}


def test_patterns_from_lists_of_sources(spark, monkeypatch):
    """The edges of a hub are several lists, and a level moves lists, not edges."""
    monkeypatch.setattr(patterns, "LISTED", 4)
    monkeypatch.setattr(patterns, "DEALT", 10, raising=False)
    edges = [(f"c{i}", "n", "IN") for i in range(30)] + [(f"c{i}", f"o{i}{j}", "PLACED") for i in range(30) for j in range(2)] + [("n", "r", "PART")] + [("c1", "n", "IN"), (None, "n", "IN"), ("c1", None, "IN")]
    nodes = [(x, {"c": "C", "o": "O", "n": "N", "r": "R"}[x[0]]) for x in {e for edge in edges for e in edge[:2] if e}]
    graph_edges = spark.createDataFrame(edges, "src string, dst string, rel string")
    found = patterns.frequent_patterns(graph_edges, spark.createDataFrame(nodes, "id string, label string"), 3, 2)
    assert sorted(tuple(r) for r in found.collect()) == [("C[IN>N,PLACED>O]", 2, 30, 60), ("C[IN>N[PART>R],PLACED>O]", 3, 30, 60), ("C[IN>N[PART>R]]", 2, 30, 30), ("C[IN>N]", 1, 30, 30), ("C[PLACED>O]", 1, 30, 60)]
    lists = patterns._sources(graph_edges).where("dst = 'n'").collect()
    assert len(lists) > 3 and sorted(x for r in lists for x in r.sources) == sorted({f"c{i}" for i in range(30)})
