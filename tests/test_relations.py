from __future__ import annotations

import random
import re

import numpy as np

from mnemion.operators import attention as att
from mnemion.operators import relations as rel

WORD = re.compile(r"[^\W]+")


def test_names_of_several_words(spark):
    rng = random.Random(3)
    vocabulary = ["Red", "ring", "the", "Big", "bolt", "ÉTÉ", "x_1"]
    texts = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(12))) + rng.choice(["", ".", "! ring"])) for k in range(40)] + [(90, None), (91, "")]
    names = ["red ring", "RING", "the big bolt", "été", "bolt", "ring, ring", "no such name", "", None]
    found = rel.phrase_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names + names[:2]], "name string"))
    want = set()
    for i, t in texts:
        ws = WORD.findall((t or "").lower())
        for n in names:
            if n and (key := WORD.findall(n.lower())):
                want |= {(i, n, k + 1, len(key)) for k in range(len(ws)) if ws[k : k + len(key)] == key}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 30
    assert rel.phrase_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_causal_sentences_by_hand(spark):
    day = 86_400_000_000
    text = "The budget meeting led to the launch. Launch and budget meeting. The launch caused the outage of all of the services that we offer here. Review was due to launch. The outage triggered the review"
    events = [(1, "Budget meeting", 0), (1, "launch", day), (1, "Outage", 2 * day), (1, "review", 900 * day), (1, "party", 5), (2, "launch", 0), (1, "services", None)]
    found = rel.causal_candidates(spark.createDataFrame([(1, text), (2, "A launch caused a party.")], "id long, text string"), spark.createDataFrame(events, "id long, name string, t long"))
    rows = {(r.id, r.cause, r.effect): (r.relation, r.confidence, r.evidence) for r in found.collect()}
    assert rows == {
        (1, "Budget meeting", "launch"): ("LEADS_TO", 0.9, "The budget meeting led to the launch"),
        (1, "launch", "Outage"): ("CAUSES", 1.0, "The launch caused the outage of all of the services that we offer here"),
    }
    far = rel.causal_candidates(spark.createDataFrame([(1, text)], "id long, text string"), spark.createDataFrame(events, "id long, name string, t long"), most_days=10_000)
    assert {(r.cause, r.effect): r.relation for r in far.collect()}["Outage", "review"] == "TRIGGERS" and {(r.cause, r.effect): r.confidence for r in far.collect()}["launch", "review"] == 0.7


def test_attention_between_all_parts_of_a_supplier(spark, tmp_path):
    """Neither part 2 nor 3 is the least of supplier 7, and they are neighbours."""
    lines = [(2, 7), (3, 7), (1, 7), (1, 7), (100, 8), (3, 8), (2, 9), (4, 9), (50, 9), (200, 1)]
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=5) for i in (1, 2, 3, 4, 100, 200, 300)}
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = lambda x: x / np.linalg.norm(x)
    own = {i: unit(v) for i, v in vectors.items()}
    near = {(a, b) for a, s in lines for b, t in lines if s == t and a != b and a in own and b in own}
    assert (2, 3) in near
    want = {}
    for k in (100, 200, 300):
        q, at = own[k], {k: own[k]}
        for _ in range(2):
            inbox = {}
            for a, b in near:
                if a in at:
                    inbox.setdefault(b, []).append((np.exp((at.get(b, own[b]) + q) @ (at[a] + q) / 5**0.5), at[a]))
            at = at | {b: unit((at.get(b, own[b]) + sum(e * v for e, v in m) / sum(e for e, _ in m)) / 2) for b, m in inbox.items()}
        want |= {(k, f"p{i}"): round(float(v @ q), 6) for i, v in at.items()}
    from mnemion.plans import mining

    assert {(r["query"], r.id): round(r.score, 6) for r in mining.graph_attention(spark, str(tmp_path)).collect()} == want


def test_attention_in_small_groups(spark, monkeypatch):
    for name in ("LISTED", "TARGETS", "SOURCES", "AT_ONCE"):
        monkeypatch.setattr(att, name, 2)
    test_attention_equals_numpy(spark)


def test_attention_equals_numpy(spark):
    rng = np.random.default_rng(1)
    d, n = 6, 20
    vectors = {i: rng.normal(size=d) for i in range(n)}
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(n, size=60), rng.integers(n, size=60), rng.normal(size=60) * 0.3, strict=True)]
    queries = {k: rng.normal(size=d) for k in range(3)}
    seeds = [(k, int(i)) for k in queries for i in rng.integers(n, size=3)]
    unit = lambda x: x / np.linalg.norm(x)
    want = {}
    for k, q in queries.items():
        q, own = unit(q), {i: unit(v) for i, v in vectors.items()}
        at = {i: own[i] for s, i in seeds if s == k}
        for _ in range(2):
            inbox = {}
            for a, b, w in edges:
                if a in at:
                    dv = at.get(b, own[b])
                    inbox.setdefault(b, []).append((np.exp((dv + q) @ (at[a] + q) / d**0.5 + w), at[a]))
            at = at | {b: unit((at.get(b, own[b]) + sum(e * v for e, v in m) / sum(e for e, _ in m)) / 2) for b, m in inbox.items()}
        want |= {(k, i): (v, v @ q) for i, v in at.items()}
    frame = lambda x, names: spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], names)
    found = att.attention(frame(queries, "query long, vector array<double>"), spark.createDataFrame(seeds, "query long, id long"), spark.createDataFrame(edges, "src long, dst long, bias double"), frame(vectors, "id long, vector array<double>"))
    rows = {(r["query"], r.id): r for r in found.collect()}
    assert set(rows) == set(want)
    assert all(np.allclose(r.vector, want[k][0]) and abs(r.score - want[k][1]) < 1e-9 for k, r in rows.items())
