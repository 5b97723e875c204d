"""Kinds renamed and merged, agreement of schemas and bulk relationships against literal versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemion.operators import alignment as op
from mnemion.plans import alignment as plan
from tests.compare import TESTDATA, assert_same


@pytest.mark.parametrize("name", sorted(plan.SQL))
def test_equals_sql(spark, name):
    assert_same(spark, plan.QUERIES[name], plan.SQL[name])


def greedy(pairs, least):
    found, reference, out = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs if s is not None and s >= least):
        if a not in found and b not in reference:
            found.add(a)
            reference.add(b)
            out.add((a, b, -s))
    return out


def test_alignment_equals_one_pass(spark):
    rng = random.Random(5)
    for size in (0, 1, 12):
        pairs = [(f"a{i}", f"b{j}", rng.choice((0.2, 0.5, 0.6, 0.7, 0.9))) for i in range(size) for j in range(size) if rng.random() < 0.6]
        got = op.aligned(spark.createDataFrame(pairs, "found string, reference string, score double"), 0.5).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == greedy(pairs, 0.5)
    pairs = [tuple(r) for r in plan.kind_similarity(spark, TESTDATA).select("found", "reference", "score").collect()]
    assert set(map(tuple, plan.kind_alignment(spark, TESTDATA).collect())) == greedy(pairs, 0.3)


def test_renamed_and_merged_kinds(spark):
    old = [("person", "email", "works"), ("person", "phone", "works"), ("paper", "doi", "cites"), ("note", "tag", "links"), (None, "doi", "cites"), ("paper", None, "cites")]
    new = [("human", "email", "works"), ("human", "phone", "works"), ("text", "doi", "cites"), ("text", "tag", "links"), ("text", "doi", "cites")]  # text: of paper and note
    a, b = (op.profiles(spark.createDataFrame(x, "kind string, attribute string, rel string"), "kind", attribute=F.col("attribute"), rel=F.col("rel")) for x in (new, old))
    pairs = {(r.found, r.reference): r.score for r in op.kind_similarity(a, b, {"attribute": 1.0, "rel": 3.0}).collect()}
    assert pairs == {("human", "person"): 1.0, ("text", "paper"): pytest.approx(2 / 3), ("text", "note"): pytest.approx(1 / 3)}
    got = {(r.found, r.reference) for r in op.aligned(op.kind_similarity(a, b, {"attribute": 1.0, "rel": 3.0}), 0.3).collect()}
    assert got == {("human", "person"), ("text", "paper")}


SCHEMA = "part string, owner string, name string, temporal boolean, causal boolean"


def test_agreement_with_renames(spark):
    found = [("entity", "", "human", False, False), ("entity", "", "paper", False, False), ("property", "paper", "doi", False, False), ("relationship", "human", "works", True, False), ("relationship", "paper", "cites", False, False), ("entity", "", "paper", False, False)]
    reference = [("entity", "", "person", False, False), ("entity", "", "paper", False, False), ("property", "paper", "doi", False, False), ("property", "paper", "year", False, False), ("relationship", "person", "works", True, False), ("relationship", "paper", "cites", True, False)]
    f, r = (spark.createDataFrame(x, SCHEMA) for x in (found, reference))
    got = op.schema_agreement(f, r, spark.createDataFrame([("human", "person")], "found string, reference string")).first()
    assert (got.entity_coverage, got.relationship_coverage, got.entity_matches, got.relationship_matches, got.property_alignment, got.temporal_correctness, got.causal_correctness) == (0.5, 0.5, 1.0, 1.0, 0.5, 0.0, 1.0)
    assert got.agreement == pytest.approx(0.15 + 0.15 + 0.1 + 0.1 + 0.05 + 0.05) and not got.passes
    same = op.schema_agreement(r, r).first()
    assert same.agreement == 1.0 and same.passes
    nothing = op.schema_agreement(f.limit(0), r.limit(0)).first()
    assert nothing.agreement == 1.0


def test_edges_and_sets_of_nothing(spark):
    edges = spark.createDataFrame([(1, 2, "R"), (1, 2, "R"), (1, None, "R"), (None, 2, "R"), (3, 2, "R"), (1, 4, "R")], "src long, dst long, rel string")
    ids = spark.createDataFrame([(1,), (2,), (4,), (None,)], "id long")
    got = {(r.src, r.dst): (r.n, r.outcome) for r in op.edge_outcomes(edges, ids, ids, edges.where("dst = 4")).collect()}
    assert got == {(1, 2): (2, "created"), (1, None): (1, "missing_target"), (None, 2): (1, "missing_source"), (3, 2): (1, "missing_source"), (1, 4): (1, "exists")}
    sets = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", None), ("z", 3)], "key string, item int")
    assert {tuple(r) for r in op.set_overlap(sets, sets.where("item = 2")).collect()} == {("x", 1, 1, 0, 0.5), ("z", 0, 1, 0, 0.0)}
