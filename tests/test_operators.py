from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemion.functions import stats, text
from mnemion.operators import documents, graph, knowledge, operations, ranking, retrieval, temporal
from mnemion.operators.components import connected_components
from mnemion.sources import tables


def literal_matches(a, b, least, most):
    used, out = set(), []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if j not in used and least <= y - x <= most:
                used.add(j)
                out.append((i, j))
                break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.lists(st.integers(0, 40), max_size=12), st.integers(1, 5), st.integers(0, 12))
def test_matching_is_the_literal_loop(a, b, least, more):
    a, b = np.array(sorted(a), int), np.array(sorted(b), int)
    assert temporal.match_one_to_one(a, b, least, least + more) == literal_matches(a, b, least, least + more)


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, entity long, type string, t long").withColumn("ts", F.timestamp_micros("t"))


def test_time_range_bounds_and_error(spark):
    e = spark.sql("select 1L id, 1L entity, 'a' type, timestamp_ntz'2024-01-01 00:00:00' ts, 0L t union all select 2, 1, 'a', timestamp_ntz'2024-01-02 00:00:00', 1")
    assert temporal.time_range(e, "2024-01-01", "2024-01-02").count() == 2
    with pytest.raises(ValueError):
        temporal.time_range(e, "2024-01-02", "2024-01-01")


def test_decay(spark):
    got = spark.sql("select explode(array(-5.0, 0.0, 30.0)) d").select(F.round(stats.decay(F.col("d").cast("double")), 9).alias("x")).collect()
    assert [r.x for r in got] == [1.0, 1.0, 0.5]


def test_sequences_take_the_earliest_in_gap_and_share_candidates(spark):
    s = temporal.SECOND
    e = events(spark, [(1, 1, "a", 0), (2, 1, "a", s), (3, 1, "b", 2 * s), (4, 1, "b", 3 * s), (5, 1, "c", 3 * s), (6, 1, "c", 12 * s), (7, 2, "a", 0), (8, 2, "b", 0)])
    got = {(r.id_0, r.id_1, r.id_2) for r in temporal.sequences(e, ["a", "b", "c"], 9).collect()}
    assert got == {(1, 3, 5), (2, 3, 5)}


def test_ngrams_skip_null_types_and_short_entities(spark):
    e = events(spark, [(1, 1, "a", 1), (2, 1, None, 2), (3, 1, "b", 3), (4, 1, "c", 4), (5, 2, "a", 1)])
    assert {r.pattern for r in temporal.ngrams(e, 2, 1).collect()} == {"b>c"}


def test_corrections_with_ties(spark):
    p = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.04)], "type_a string, type_b string, p_value double")
    got = temporal.corrected(p, ["type_a", "type_b"]).orderBy("rank").collect()
    assert [round(r.fdr, 9) for r in got] == [0.03, 0.06, 0.06] and [r.bonferroni_significant for r in got] == [True, False, False]
    got = temporal.corrected(p, ["type_a", "type_b"], method="standard").orderBy("rank").collect()
    assert [round(r.fdr, 9) for r in got] == [0.03, 0.04, 0.04]


def test_precedence_counts_ties_as_b_before_a(spark):
    s = temporal.SECOND
    e = events(spark, [(1, 1, "a", 0), (2, 1, "b", 0), (3, 1, "b", s)])
    (r,) = temporal.precedence(e, 10, least=1).collect()
    assert (r.type_a, r.type_b, r.pairs, r.p_ab) == ("a", "b", 2, 0.5)


def test_paths_repeat_no_edge_and_default_confidence(spark):
    e = spark.createDataFrame([(1, 2, "CAUSES", 0.9), (2, 1, "CAUSES", None), (2, 3, "CAUSES", 0.5)], "src long, dst long, rel string, confidence double")
    start = spark.createDataFrame([(1,)], "id long")
    got = {tuple(r.nodes) for r in graph.paths(e, start, 5).collect()}
    assert got == {(1, 2), (1, 2, 1), (1, 2, 3)}
    assert graph.shortest(e, 1, 3).first().nodes == [1, 2, 3]
    assert graph.shortest(e, 3, 1).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert connected_components(e.limit(0)).count() == 0


def test_components_of_stars_take_one_round(spark, monkeypatch):
    from mnemion.operators import components

    staged = []
    monkeypatch.setattr(components, "stage", lambda df, name, f=components.stage: (staged.append(name), f(df, name))[1])
    star = spark.createDataFrame([(i, i % 3) for i in range(3, 200)], "a long, b long")
    got = {r.id: r.component for r in connected_components(star, distinct=True).collect()}
    assert got == {i: i % 3 for i in range(200)}
    assert staged == ["edges", "edges", "edges", "nodes"]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] * 2, "a long, b long")
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_label_propagation_is_the_literal_loop(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    label = {x: x for x in near}
    for _ in range(3):
        label = {x: min(({label[y] for y in near[x]}), key=lambda c: (-sum(label[y] == c for y in near[x]), c)) for x in near}
    got = graph.label_propagation(spark.createDataFrame(edges, "src string, dst string"), 3).collect()
    assert {r.id: r.community for r in got} == label


@pytest.mark.parametrize("body", ["", "  \n\n ", "abc", "a" * 10, "aa\n\nbb\n\ncc", "a" * 25 + "\n\nb"])
def test_chunks_and_packing(spark, body):
    got = spark.createDataFrame([(body,)], "x string").select(text.chunks(F.col("x"), 10).alias("c"), text.packed(F.col("x"), 4).alias("p")).first()
    assert got.c == [body[i : i + 10] for i in range(0, len(body), 10)]
    want, held, n = [], [], 0
    for part in [p.strip(" ") for p in __import__("re").split(r"\n\s*\n", body)]:
        if part.strip() == "":
            continue
        if held and n + len(part) > 4:
            want.append("\n\n".join(held))
            held, n = [], 0
        held.append(part)
        n += len(part)
    assert got.p == want + (["\n\n".join(held)] if held else [])


def test_words_and_subject(spark):
    got = spark.createDataFrame([("Élan vital_2 x-y\nz",)], "x string").select(text.n_words(F.col("x")).alias("w"), text.n_lines(F.col("x")).alias("l"), text.subject(F.lit("Re: FWD: re[2]: Plan ")).alias("s")).first()
    assert (got.w, got.l, got.s) == (5, 2, "Plan")


def test_fusion_zero_weights_and_one_side(spark):
    a = spark.createDataFrame([(1, 0.4), (1, 0.8), (2, 0.6)], "id long, score double")
    b = spark.createDataFrame([(2, 0.2), (3, 1.0)], "id long, score double")
    got = {r.id: (round(r.score, 9), r.source) for r in retrieval.weighted_fusion(a, b, 0, 0).collect()}
    assert got == {1: (0.4, "vector"), 2: (0.4, "hybrid"), 3: (0.5, "graph")}


def test_schema_versions(spark):
    r = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate((5, 4, 2, 1))], "id long, schema_version int, score double")
    assert {x.id: x.score for x in retrieval.compatible(r, 5).collect()} == {0: 1.0, 1: 0.95, 2: 0.85}


def test_audit_and_empty_log(spark):
    from hashlib import sha256

    h = lambda p, x: sha256(f"{p}|{x}".encode()).hexdigest()
    good = [(1, 1, "a", "", h("", "a")), (1, 2, "b", h("", "a"), h(h("", "a"), "b"))]
    log = spark.createDataFrame(good + [(1, 3, "c", "zz", h("zz", "c")), (1, 4, "x", h("zz", "c"), "bad")], "stream long, seq long, payload string, prev_hash string, chain_hash string")
    assert {(r.seq, r.tampered, r.unlinked) for r in operations.audit_breaks(log).collect()} == {(3, False, True), (4, True, False)}
    assert operations.audit_breaks(log.limit(0)).count() == 0


def test_upsert_append_and_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "id long, name string")
    assert {(r.id, r.name) for r in tables.append_new(old, new, "id").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {(r.id, r.name) for r in tables.upsert(old, new.distinct(), "id").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    edges = spark.createDataFrame([(1, 2, "x")], "src long, dst long, rel string")
    n, e = tables.cascade_delete(old, edges, spark.createDataFrame([(2,)], "id long"))
    assert n.count() == 1 and e.count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("# T\n[[Other|x]] #tag ü")
    (tmp_path / "b.txt").write_text("no")
    f = tables.text_files(spark, str(tmp_path))
    assert [(r.format, r.content) for r in f.select("format", "content").collect()] == [("md", "# T\n[[Other|x]] #tag ü")]
    links = documents.links(f.select(F.lit(7).alias("doc_id"), F.col("content").alias("text")))
    assert {(r.src, r.dst, r.rel) for r in links.collect()} == {("7", "Other", "links_to"), ("7", "tag", "tagged"), ("Other", "7", "linked_from")}


def test_streams(spark, tmp_path):
    from mnemion.streaming import events as ev

    rows = pd.DataFrame({"event_id": range(8), "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:05:00", "2024-01-01 00:05:00", "2024-01-01 01:00:00", "2024-01-01 03:00:00", "2024-01-01 09:00:00"]), "user_id": [1, 1, 1, 1, 1, 1, 1, 2], "event_type": ["view", "view", "buy", "buy", "buy", "view", "buy", "view"], "value": 1.0})
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = lambda: ev.read_events(spark, str(tmp_path / "in"), schema)
    counts = run(ev.windowed_counts(stream(), "event_type"), "counts", "complete")
    assert {(str(r.start), r.event_type): r.n for r in counts}["2024-01-01 00:00:00", "buy"] == 3
    bursts = run(ev.debounced(stream(), "user_id"), "bursts")
    assert sorted(r.n for r in bursts)[:3] == [1, 1, 2]
    assert len(run(ev.distinct_events(stream(), ["event_type", "ts"]), "distinct")) == 7
    joined = run(ev.followed_by(stream().where("event_type = 'view'"), stream().where("event_type = 'buy'"), "user_id", "10 minutes"), "joined")
    assert len(joined) == 6
    pairs = run(ev.one_to_one(stream(), "view", "buy", "user_id", 600), "pairs")
    assert {(r.a_id, r.b_id) for r in pairs} == {(0, 2), (1, 3)}
    q = stream().writeStream.foreachBatch(ev.merge_into(str(tmp_path / "latest"), "user_id", "ts")).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "latest" / "0")).collect()} == {(1, 6), (2, 7)}


def random_events(spark, n=400, seed=3):
    import random

    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), rng.choice("abcd"), rng.randrange(200) * temporal.SECOND) for i in range(n)]
    return rows, events(spark, rows)


def literal_pairs(rows, pairs, least, most):
    out = []
    for entity in sorted({r[1] for r in rows}):
        for a, b in pairs:
            mine = sorted((t, i, k) for i, e, k, t in rows if e == entity)
            x, y = [(t, i) for t, i, k in mine if k == a], [(t, i) for t, i, k in mine if k == b]
            for i, j in literal_matches([t for t, _ in x], [t for t, _ in y], least, most):
                out.append((entity, a, b, x[i][1], y[j][1], (y[j][0] - x[i][0]) / temporal.SECOND))
    return out


def test_greedy_pairs_stream_as_the_literal_loop(spark):
    rows, e = random_events(spark)
    pairs = [("a", "b"), ("b", "a"), ("c", "d")]
    for gap in (3, 20):
        got = {(r.entity, r.type_a, r.type_b, r.id_a, r.id_b, r.gap_s) for r in temporal.greedy_pairs(e.repartition(3), pairs, gap).collect()}
        assert got == set(literal_pairs(rows, pairs, 1, gap * temporal.SECOND))


def test_correlations_lags_and_bootstrap_are_of_the_literal_matches(spark):
    rows, e = random_events(spark)
    every = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    found = literal_pairs(rows, every, 1, 10 * temporal.SECOND)
    by = {}
    for _, a, b, _, _, g in found:
        by.setdefault((a, b), []).append(g)
    got = {(r.type_a, r.type_b): r for r in temporal.correlations(e, 10).collect()}
    assert set(got) == {k for k, g in by.items() if len(g) >= 2}
    for k, r in got.items():
        g = np.array(by[k])
        even = max(0.0, 1 - min(g.std(ddof=1) / g.mean(), 1.0))
        assert r.n == len(g) and abs(r.avg_gap - g.mean()) < 1e-9 and abs(r.consistency - even) < 1e-9
        assert r.causal == (len(g) >= 4 and even >= 0.5)
    matches = temporal.greedy_pairs(e, [("a", "b")], 10)
    lags = {r.bucket_s: r for r in temporal.lag_buckets(matches, 1, 2).collect()}
    g = by["a", "b"]
    want = {}
    for x in g:
        want[1 + (x - 1) // 2 * 2] = want.get(1 + (x - 1) // 2 * 2, 0) + 1
    assert {k: r.n for k, r in lags.items()} == want and all(abs(r.share - r.n / len(g)) < 1e-12 for r in lags.values())
    [b] = temporal.bootstrap_mean(matches, ["type_a", "type_b"], "gap_s").collect()
    half = 1.96 * np.std(g) / len(g) ** 0.5
    assert b.low < np.mean(g) < b.high and 0.5 * half < (b.high - b.low) / 2 < 1.7 * half


def test_causal_order_is_by_hand(spark):
    m = lambda rows: spark.createDataFrame([(a, b, 10, p, 1 - p, "a->b" if p >= 0.6 else "b->a" if p <= 0.4 else "none") for a, b, p in rows], "type_a string, type_b string, pairs int, p_ab double, p_ba double, edge string")
    assert temporal.causal_order(m([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.5)])) == (["b", "a", "c"], 1.0)
    order, confidence = temporal.causal_order(m([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.1), ("c", "d", 0.8)]))
    assert order == ["a", "b", "c", "d"] and abs(confidence - 5 / 6) < 1e-12


def test_following_counts_are_all_pairs(spark):
    rows, e = random_events(spark, 300)
    got = {(r.id, r.type_b): (r.after, r.ties) for r in temporal.following(e, 7).collect()}
    for i, entity, k, t in rows:
        for other in "abcd":
            if other != k:
                later = [u - t for _, en, kk, u in rows if en == entity and kk == other]
                assert got[i, other] == (sum(0 < x <= 7 * temporal.SECOND for x in later), sum(x == 0 for x in later))


def test_a_correlation_remains_in_the_whole_scan(spark):
    day = 86_400 * temporal.SECOND
    rows = []
    for k in range(40):
        rows += [(3 * k, k, "cause", k * day), (3 * k + 1, k, "effect", k * day + 600 * temporal.SECOND), (3 * k + 2, k, "noise", (k * 7919 % 40) * day)]
    e = events(spark, rows)
    out = temporal.scanned(e, 3600).collect()
    assert {(r.type_a, r.type_b) for r in out} == {("cause", "effect")} and out[0].observed == 40 and out[0].causal
    s = temporal.summary(temporal.correlations(e, 3600)).collect()[0]
    assert s.total >= 1 and s.strongest == "cause > effect"
    assert temporal.summary(temporal.correlations(e.limit(0), 3600)).collect()[0].total == 0


def test_diverse_is_the_literal_loop(spark):
    rng = np.random.default_rng(4)
    x, score = rng.normal(size=(30, 4)), rng.random(30)
    rows = [(7, i, float(score[i]), x[i].tolist()) for i in range(30)]
    got = [r.id for r in retrieval.diverse(spark.createDataFrame(rows, "query_id long, id long, score double, v array<double>"), 8).orderBy("place").collect()]
    u, chosen = x / np.linalg.norm(x, axis=1, keepdims=True), []
    while len(chosen) < 8:
        value = lambda i: 0.8 * score[i] - 0.2 * max([u[i] @ u[j] for j in chosen] + [0])
        chosen.append(max((i for i in range(30) if i not in chosen), key=value))
    assert got == chosen


def test_strategies_and_weights_by_hand():
    costs = {"a": (100.0, 0.0, 1.0, 1.0), "b": (50.0, 0.0, 1.0, 0.6), "c": (2000.0, 0.0, 1.0, 1.0)}
    assert retrieval.strategy(costs) == "a" and retrieval.strategy({"b": costs["b"], "c": costs["c"]}) == "b"
    assert retrieval.adjusted_weights("causal", 3, 20) == pytest.approx((0.35 / 1.1, 0.75 / 1.1))


def test_fusion_weights_are_those_of_the_scalar(spark):
    rows = [(i, a, b) for i in ("causal", "temporal", "lookup", "exploratory") for a in (3, 20) for b in (3, 20)]
    df = spark.createDataFrame(rows, "intent string, nv int, ng int")
    for r in df.select("*", *retrieval.fusion_weights(F.col("intent"), F.col("nv"), F.col("ng"))).collect():
        assert (r.wv, r.wg) == pytest.approx(retrieval.adjusted_weights(r.intent, r.nv, r.ng))


def test_exact_percentiles_and_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 301)] + [("b", 4.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in ranking.percentiles(df, "k", "v", (0.5, 0.95, 0.0, 1.0)).collect()}
    a = [v for k, v in rows if k == "a"]
    assert set(got) == {"a", "b"} and got["b"].p == [4.0] * 4 and got["a"].p == pytest.approx(np.percentile(a, [50, 95, 0, 100]).tolist())
    ranks = {(r.k, r.i): r.rank for r in ranking.global_rank(spark.createDataFrame([("x", i) for i in range(500)], "k string, i int").repartition(7), F.desc("i")).collect()}
    assert all(ranks["x", i] == 500 - i for i in range(500))


def test_threads_with_orphans_and_circles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 5), (6, 7), (7, 6), (8, 6)] + [(100 + i, 99 + i if i else None) for i in range(40)]
    got = {r.id: (r.root, r.depth) for r in knowledge.threads(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0)} | {100 + i: (100, i) for i in range(40)}
    assert knowledge.threads(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_titles_keep_the_headings_above(spark):
    text = "before\n# A\none\n### C\ntwo\n## B\nthree\n# D\n\n## E\nfour"
    got = [(r.title, r.path, r.content) for r in knowledge.by_title(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk").collect()]
    assert got == [("", [], "before"), ("A", ["A"], "one"), ("C", ["A", "C"], "two"), ("B", ["A", "B"], "three"), ("E", ["D", "E"], "four")]


def test_overlaps_are_all_pairs_once(spark):
    import random

    rng = random.Random(6)
    make = lambda: [(i, lo, lo + rng.randrange(0, 90) * temporal.SECOND) for i, lo in enumerate(rng.randrange(300) * temporal.SECOND for _ in range(60))]
    a, b = make(), make()
    got = [(r.id_a, r.id_b) for r in temporal.overlapping(*(spark.createDataFrame(x, "id long, lo long, hi long") for x in (a, b)), 20).collect()]
    assert sorted(got) == sorted((i, j) for i, lo, hi in a for j, lo2, hi2 in b if lo <= hi2 and lo2 <= hi)


def test_overlaps_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(temporal, "CELL", 16)
    monkeypatch.setattr(temporal, "PAIRS", 1000)
    rows = [(i, (5 + i % 7) * temporal.SECOND, (4 + i % 11) * temporal.SECOND) for i in range(200)] + [(999, None, 1)]  # some end before they start
    one, other = rows, [(1000 + i, lo, hi) for i, lo, hi in rows[:90]]
    found = temporal.overlapping(*(spark.createDataFrame(x, "id long, lo long, hi long") for x in (one, other)), 3600)
    assert len({r.p for r in found.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 8
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i, lo, hi in one[:200] for j, lo2, hi2 in other if lo <= hi2 and lo2 <= hi)
    assert temporal.overlapping(*(spark.createDataFrame([], "id long, lo long, hi long") for _ in "ab"), 20).count() == 0


def test_overlaps_of_a_bucket_are_cells_of_both_sides(spark, monkeypatch):
    """Neither the starts nor the intervals of a crowded bucket are all in one task."""
    monkeypatch.setattr(temporal, "CELL", 16)
    monkeypatch.setattr(temporal, "PAIRS", 100)
    one, other = [(i, 5, 6 + i % 3) for i in range(20)], [(1000 + i, 4, 5 + i % 3) for i in range(300)]
    rows = temporal.overlapping(*(spark.createDataFrame(x, "id long, lo long, hi long") for x in (one, other)), 3600).select("id_a", "id_b", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.id_a, r.id_b) for r in rows) == [(i, j) for i, *_ in one for j, *_ in other]
    assert max(len({r.id_b for r in rows if r.p == p and r.id_a == a}) for p, a in {(r.p, r.id_a) for r in rows}) < 200


def test_shared_neighbours_of_a_hub_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 4)
    edges = [(i, 0) for i in range(30)] + [(i, 1 + i % 3) for i in range(30)]
    got = {(r.a, r.b): r.shared for r in graph.shared_neighbours(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(a, b): 1 + (a % 3 == b % 3) for a in range(30) for b in range(a + 1, 30)}
