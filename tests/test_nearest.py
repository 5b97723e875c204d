from __future__ import annotations

import numpy as np
import pytest

from mnemion.operators import retrieval as op


def literal(vectors, queries, k, metric):
    out = set()
    for q, y in queries:
        scored = []
        for i, x in vectors:
            if i != q:
                with np.errstate(all="ignore"):
                    s = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if metric == "cosine" else 1 / (1 + np.linalg.norm(x - y))
                if np.isfinite(s):
                    scored.append((-round(float(s), 9), i))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("metric", "spread"), [("cosine", 0.05), ("l2", 0.05), ("cosine", 3.0), ("l2", 3.0)])
def test_cells_lose_nothing_and_spare_work(spark, monkeypatch, metric, spread):
    monkeypatch.setattr(op, "VECTORS", 25)
    monkeypatch.setattr(op, "QUERIES", 7)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [(i, centres[0 if i % 3 == 0 else rng.integers(12)] + rng.normal(size=8) * spread) for i in range(500)]
    vectors += [(600, np.zeros(8)), (601, vectors[3][1]), (602, vectors[3][1] * 2)]
    queries = [(i, x) for i, x in vectors if i % 12 == 0] + [(1000, rng.normal(size=8))]
    visits, real = [], op._searched

    def spy(rows, asked, *more):
        visits.append(asked.count())
        return real(rows, asked, *more)

    monkeypatch.setattr(op, "_searched", spy)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in vectors], "id long, v array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in queries], "query_id long, qv array<double>")
    found = {(r.query_id, r["rank"], r.id, round(r.score, 9)) for r in op.nearest(v, q, 6, metric).collect()}
    assert found == literal(vectors, queries, 6, metric)
    if spread < 1:
        assert sum(visits) < 30 * len(queries)  # of some 80 cells, of which a third are within one cluster
