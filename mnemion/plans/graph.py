"""Graph and causal queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.operators import graph as op
from mnemion.operators import temporal
from mnemion.plans.temporal import EDGES, TESTED, E
from mnemion.sources.tables import causal_edges, event_nodes, knowledge_edges, table

K = """k AS (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'PLACED' AS rel, o_orderdate AS valid_from FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', l_shipdate FROM lineitem UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', l_shipdate FROM lineitem)"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """The customers of one nation."""
    return table(spark, d, "customer").where("c_nationkey = 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))


def one_hop_out(spark: SparkSession, d: str) -> DataFrame:
    return op.one_hop(knowledge_edges(spark, d), _customers(spark, d), "out")


def one_hop_in(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    return op.one_hop(knowledge_edges(spark, d), suppliers, "in")


def one_hop_both(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return op.one_hop(knowledge_edges(spark, d), parts, "both")


def optional_match(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the number of orders, also without any."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def _events(spark: SparkSession, d: str, kind: str = "signup") -> DataFrame:
    return event_nodes(spark, d).where(F.col("type") == kind).select("id")


def causal_chain(spark: SparkSession, d: str) -> DataFrame:
    p = op.paths(causal_edges(spark, d), _events(spark, d), 4, rels=["CAUSES", "ENABLES", "TRIGGERS"])
    return p.select("start", "end", "hops", F.round(op.product("confidences"), 6).alias("confidence"))


def find_effects(spark: SparkSession, d: str) -> DataFrame:
    p = op.paths(causal_edges(spark, d), _events(spark, d, "purchase"), 3, min_confidence=0.6)
    return p.select("start", "end", "hops", F.round(F.array_min("confidences"), 6).alias("confidence"))


def find_causes(spark: SparkSession, d: str) -> DataFrame:
    p = op.paths(op.reversed_edges(causal_edges(spark, d)), _events(spark, d, "purchase"), 3, min_confidence=0.6)
    return p.select("start", "end", "hops", F.round(F.array_min("confidences"), 6).alias("confidence"))


def _path_sql(kind: str, hops: int, conf: float, back: bool, aggregate: str) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""WITH RECURSIVE {EDGES}, f AS (SELECT {a} AS x, {b} AS y, confidence AS c FROM g WHERE confidence >= {conf}),
p AS (SELECT f.x AS start, f.y AS "end", 1 AS hops, [f.c] AS cs FROM f JOIN e ON e.id = f.x AND e.type = '{kind}' UNION ALL SELECT p.start, f.y, p.hops + 1, list_append(p.cs, f.c) FROM p JOIN f ON f.x = p."end" WHERE p.hops < {hops})
SELECT start, "end", hops::INTEGER AS hops, round({aggregate}, 6) AS confidence FROM p"""


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From the first event that starts a chain of two edges to its end."""
    e = causal_edges(spark, d)
    found = op.paths(e, _events(spark, d), 2, 2).agg(F.min(F.struct("start", "end")).alias("m")).first().m
    start, end = (found.start, found.end) if found else (-1, -1)  # without a chain there is no path
    return op.shortest(e, start, end).select(F.col("nodes")[0].alias("start"), F.element_at("nodes", -1).alias("end"), "hops", F.round("confidence", 6).alias("confidence"))


def path_validity(spark: SparkSession, d: str) -> DataFrame:
    found = op.paths(causal_edges(spark, d), _events(spark, d), 3, 2)
    return op.path_validity(found, event_nodes(spark, d).select("id", "t")).select("start", "end", "valid")


def chain_scores(spark: SparkSession, d: str) -> DataFrame:
    found = op.paths(causal_edges(spark, d), _events(spark, d), 3)
    out = op.chain_scores(found, event_nodes(spark, d).select("id", "t"))
    return out.select("start", "end", "hops", *[F.round(c, 6).alias(c) for c in ("temporal", "structural", "statistical", "score")])


def mediators(spark: SparkSession, d: str) -> DataFrame:
    return op.mediators(causal_edges(spark, d)).select("a", "m", "b", F.round("confidence", 6).alias("confidence"))


def confounders(spark: SparkSession, d: str) -> DataFrame:
    e = causal_edges(spark, d)
    pairs = e.where("src_type = 'click'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return op.common_causes(e, pairs, 2)


def _supplied(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def shared_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = op.shared_neighbours(_supplied(spark, d))
    return s.select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("adamic", 6).alias("adamic"))


SHARED = """s AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), deg AS (SELECT src, count(*) AS d FROM s GROUP BY 1), w AS (SELECT dst, 1 / ln(count(*)) AS w FROM s GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT x.src AS a, y.src AS b, count(*) AS shared, sum(w.w) AS adamic FROM s x JOIN s y ON x.dst = y.dst AND x.src < y.src JOIN w ON w.dst = x.dst GROUP BY 1, 2),
j AS (SELECT a, b, shared, shared / (p.d + q.d - shared) AS jaccard, adamic FROM t JOIN deg p ON p.src = a JOIN deg q ON q.src = b)"""


def predicted_links(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"))
    return op.predict_links(op.shared_neighbours(_supplied(spark, d)), groups=nations).select("a", "b", F.round("score", 6).alias("score"))


def pattern_support(spark: SparkSession, d: str) -> DataFrame:
    return op.pattern_support(knowledge_edges(spark, d))


def missing_relation(spark: SparkSession, d: str) -> DataFrame:
    """Customers who placed no order in the last year of the table."""
    customers = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return op.missing_relation(customers, knowledge_edges(spark, d).where("valid_from >= '2001-01-01'"), "PLACED")


def schema_stats(spark: SparkSession, d: str) -> DataFrame:
    return knowledge_edges(spark, d).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    m = op.memory_decay(knowledge_edges(spark, d).where("rel = 'SUPPLIED_BY'"), "1998-12-31")
    return m.select("id", "days", F.round("decay", 9).alias("decay"), F.round("importance", 9).alias("importance"), F.round("recall", 9).alias("recall"), "reinforce")


def components(spark: SparkSession, d: str) -> DataFrame:
    return op.components(causal_edges(spark, d))


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation; edges by lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"))
    edges = table(spark, d, "lineitem").join(o, "l_orderkey").select("src", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("community"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("community"))
    return edges, c.unionByName(s)


def community_links(spark: SparkSession, d: str) -> DataFrame:
    out = op.community_links(*_communities(spark, d))
    return out.select("community", "size", "internal", "external", F.round("ratio", 9).alias("ratio"), F.round("density", 9).alias("density"), "isolated")


def label_communities(spark: SparkSession, d: str) -> DataFrame:
    """Iterative; tests hold it against a literal loop."""
    return op.label_propagation(_supplied(spark, d).select(F.concat(F.lit("s"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("dst").cast("string")).alias("dst")))


def spread_relevance(spark: SparkSession, d: str) -> DataFrame:
    seeds = _events(spark, d).select("id", F.lit(1.0).alias("score"))
    return op.spread(causal_edges(spark, d), seeds, 2).select("id", F.round("score", 9).alias("score"))


def bradford_hill(spark: SparkSession, d: str) -> DataFrame:
    events = event_nodes(spark, d)
    tested = temporal.significance(temporal.cooccurrence(events, 3600), 3600 / 86400, 30.0)
    near = temporal.nearest_following(events, 3600)
    causes = tested.groupBy("type_b").agg(F.count("*").alias("causes"))
    effects = tested.groupBy("type_a").agg(F.count("*").alias("effects"))
    pairs = tested.join(near, ["type_a", "type_b"]).join(causes, "type_b").join(effects, "type_a").withColumn("strength", F.col("observed") / F.col("n_a")).withColumnRenamed("observed", "n")
    # What more is known of a pair: how well it is supported, whether the opposite direction is as frequent, a dose and response.
    back = tested.select(F.col("type_a").alias("type_b"), F.col("type_b").alias("type_a"), F.col("observed").alias("n_back"))
    pairs = pairs.join(back, ["type_a", "type_b"], "left").withColumns({"data_support": F.least(F.lit(1.0), F.col("n") / 100), "contradicted": F.coalesce(F.col("n_back") > F.col("n"), F.lit(False)), "monotonic": F.col("n") > F.col("expected"), "mechanism": F.col("effect_label") != "negligible"})
    out = op.bradford_hill(pairs)
    return out.select("type_a", "type_b", *[F.round(c, 5).alias(c) for c in ("bh_strength", "bh_consistency", "bh_specificity", "bh_temporality", "bh_gradient", "bh_plausibility", "bh_coherence", "bh_analogy", "score")], "verdict")


QUERIES = {f.__name__: f for f in (one_hop_out, one_hop_in, one_hop_both, optional_match, causal_chain, find_effects, find_causes, shortest_path, path_validity, chain_scores, mediators, confounders, shared_neighbours, predicted_links, pattern_support, missing_relation, schema_stats, memory_decay, components, community_links, label_communities, spread_relevance, bradford_hill)}

COMMUNITIES = """m AS (SELECT 'c' || c_custkey AS id, c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
x AS (SELECT a.community AS ca, b.community AS cb FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN m a ON a.id = 'c' || o_custkey JOIN m b ON b.id = 's' || l_suppkey),
i AS (SELECT ca AS community, count(*) AS internal FROM x WHERE ca = cb GROUP BY 1), o AS (SELECT community, count(*) AS external FROM (SELECT ca AS community FROM x WHERE ca != cb UNION ALL SELECT cb FROM x WHERE ca != cb) GROUP BY 1),
z AS (SELECT m.community, count(*) AS size, coalesce(any_value(internal), 0) AS internal, coalesce(any_value(external), 0) AS external FROM m LEFT JOIN i ON i.community = m.community LEFT JOIN o ON o.community = m.community GROUP BY 1),
r AS (SELECT *, CASE WHEN internal + external > 0 THEN external / (internal + external) ELSE 0 END AS ratio0, CASE WHEN size > 1 THEN internal / (size * (size - 1) / 2) ELSE 0 END AS density0 FROM z)"""

SQL = {
    "one_hop_out": f"WITH {K} SELECT DISTINCT src AS id, dst AS neighbour, rel FROM k JOIN customer ON src = 'customer:' || c_custkey WHERE c_nationkey = 3",
    "one_hop_in": f"WITH {K} SELECT DISTINCT dst AS id, src AS neighbour, rel FROM k JOIN supplier ON dst = 'supplier:' || s_suppkey",
    "one_hop_both": f"WITH {K} SELECT src AS id, dst AS neighbour, rel FROM k JOIN part ON src = 'part:' || p_partkey UNION SELECT dst, src, rel FROM k JOIN part ON dst = 'part:' || p_partkey",
    "optional_match": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "causal_chain": _path_sql("signup", 4, 0.0, False, "list_product(cs)"),
    "find_effects": _path_sql("purchase", 3, 0.6, False, "list_min(cs)"),
    "find_causes": _path_sql("purchase", 3, 0.6, True, "list_min(cs)"),
    "shortest_path": f"""WITH RECURSIVE {EDGES}, p AS (SELECT src AS start, dst AS "end", 1 AS hops, confidence AS c FROM g JOIN e ON e.id = src AND e.type = 'signup' UNION ALL SELECT start, g.dst, hops + 1, least(c, g.confidence) FROM p JOIN g ON g.src = p."end" WHERE hops < 2)
        SELECT start, "end", hops::INTEGER AS hops, round(c, 6) AS confidence FROM p WHERE hops = 2 ORDER BY start, "end" LIMIT 1""",
    "path_validity": f"""WITH RECURSIVE {EDGES}, p AS (SELECT src AS start, dst AS "end", 1 AS hops FROM g JOIN e ON e.id = src AND e.type = 'signup' UNION ALL SELECT start, g.dst, hops + 1 FROM p JOIN g ON g.src = p."end" WHERE hops < 3) SELECT start, "end", true AS valid FROM p WHERE hops >= 2""",
    "chain_scores": f"""WITH RECURSIVE {EDGES}, p AS (SELECT src AS start, dst AS "end", 1 AS hops, confidence AS s FROM g JOIN e ON e.id = src AND e.type = 'signup' UNION ALL SELECT start, g.dst, hops + 1, s + g.confidence FROM p JOIN g ON g.src = p."end" WHERE hops < 3)
        SELECT start, "end", hops::INTEGER AS hops, 1.0::DOUBLE AS temporal, round(0.5 + 0.5 * s / hops, 6) AS structural, round(0.3 + 0.7 * s / hops, 6) AS statistical, round(0.4 + 0.3 * (0.5 + 0.5 * s / hops) + 0.3 * (0.3 + 0.7 * s / hops), 6) AS score FROM p""",
    "mediators": f"WITH {EDGES} SELECT x.src AS a, x.dst AS m, y.dst AS b, round(least(x.confidence, y.confidence), 6) AS confidence FROM g x JOIN g y ON y.src = x.dst WHERE x.src != y.dst",
    "confounders": f"""WITH {EDGES}, u AS (SELECT dst AS id, src AS cause FROM g UNION SELECT x.dst, y.src FROM g x JOIN g y ON y.dst = x.src)
        SELECT DISTINCT g.src AS a, g.dst AS b, p.cause FROM g JOIN u p ON p.id = g.src JOIN u q ON q.id = g.dst AND q.cause = p.cause WHERE g.src_type = 'click' AND p.cause != g.src AND p.cause != g.dst""",
    "shared_neighbours": f"WITH {SHARED} SELECT a, b, shared, round(jaccard, 9) AS jaccard, round(adamic, 6) AS adamic FROM j",
    "predicted_links": f"""WITH {SHARED}, n AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey = a AND y.s_suppkey = b)),
        m AS (SELECT greatest(1.0, max(adamic)) AS top FROM n) SELECT a, b, round((least(1.0, shared / 10) + jaccard + adamic / top) / 3, 6) AS score FROM n, m""",
    "pattern_support": f"WITH {K} SELECT split_part(src, ':', 1) AS src_label, rel, split_part(dst, ':', 1) AS dst_label, count(*) AS support FROM k GROUP BY 1, 2, 3",
    "missing_relation": "SELECT 'customer:' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01')",
    "schema_stats": f"WITH {K} SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM k GROUP BY 1",
    "memory_decay": f"""WITH {K}, n AS (SELECT id, count(*) AS degree, max(valid_from) AS last FROM (SELECT src AS id, valid_from FROM k WHERE rel = 'SUPPLIED_BY' UNION ALL SELECT dst, valid_from FROM k WHERE rel = 'SUPPLIED_BY') GROUP BY 1),
        d AS (SELECT id, date_diff('day', last::DATE, DATE '1998-12-31')::DOUBLE AS days, degree / max(degree) OVER () AS importance FROM n), r AS (SELECT *, exp(-0.693 * greatest(days, 0) / 30) AS decay FROM d)
        SELECT id, days, round(decay, 9) AS decay, round(importance, 9) AS importance, round(0.6 * decay + 0.4 * importance, 9) AS recall, decay < 0.3 AND importance > 0.5 AS reinforce FROM r""",
    "components": f"""WITH {EDGES}, c AS (SELECT id, entity, t, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, id)), n AS (SELECT *, sum(CASE WHEN gap > 0 AND gap <= 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY t, id) AS run FROM c)
        SELECT id, min(id) OVER (PARTITION BY entity, run) AS component FROM n QUALIFY count(*) OVER (PARTITION BY entity, run) > 1""",
    "community_links": f"WITH {COMMUNITIES} SELECT community, size, internal, external, round(ratio0, 9) AS ratio, round(density0, 9) AS density, ratio0 < 0.1 AND size >= 3 AS isolated FROM r",
    "spread_relevance": f"""WITH {EDGES}, s AS (SELECT id, 1.0 AS score FROM e WHERE type = 'signup'), d AS (SELECT g.src, g.dst, 0.85 / count(*) OVER (PARTITION BY g.src) AS w FROM g),
        a AS (SELECT id, sum(score) AS score FROM (SELECT dst AS id, w * score AS score FROM d JOIN s ON s.id = d.src UNION ALL SELECT id, (1 - 0.85) * score FROM s) GROUP BY 1),
        b AS (SELECT id, sum(score) AS score FROM (SELECT dst AS id, w * score AS score FROM d JOIN a ON a.id = d.src UNION ALL SELECT id, (1 - 0.85) * score FROM s) GROUP BY 1) SELECT id, round(score, 9) AS score FROM b""",
    "bradford_hill": f"""WITH {TESTED}, near AS (SELECT a.type AS type_a, b.type AS type_b, avg(b.t - a.t) / 1e6 AS avg_gap, min(b.t - a.t) / 1e6 AS min_gap FROM e a JOIN e b ON a.entity = b.entity AND b.t > a.t AND b.t - a.t <= 3600000000 AND a.type != b.type GROUP BY 1, 2),
        h AS (SELECT s.type_a, s.type_b, least(1.0, greatest(0.0, 0.4 * least(observed / n_a, 1.0) + CASE WHEN effect > 2 THEN .3 WHEN effect > 1.5 THEN .2 WHEN effect > 1 THEN .1 ELSE 0 END + CASE WHEN p_value < .001 THEN .3 WHEN p_value < .01 THEN .2 WHEN p_value < .05 THEN .15 ELSE 0 END))::DOUBLE AS st,
          (0.5 + CASE WHEN observed >= 20 THEN .3 WHEN observed >= 10 THEN .2 WHEN observed >= 5 THEN .1 ELSE -.2 END)::DOUBLE AS co,
          (0.5 + CASE WHEN nc > 5 THEN -.2 WHEN nc > 2 THEN -.1 ELSE .1 END + CASE WHEN ne > 5 THEN -.1 ELSE 0 END)::DOUBLE AS sp, CASE WHEN avg_gap > 0 AND min_gap >= 0 THEN 1.0 WHEN avg_gap > 0 THEN .8 ELSE .3 END::DOUBLE AS te,
          least(1.0, least(1.0, 0.5 + CASE WHEN observed > expected THEN .3 ELSE 0 END) + CASE WHEN effect > 1.5 THEN .1 ELSE 0 END)::DOUBLE AS gr,
          (0.5 + CASE WHEN effect_label != 'negligible' THEN .2 + CASE WHEN observed / n_a > .6 THEN .1 ELSE 0 END ELSE 0 END)::DOUBLE AS pl,
          least(1.0, greatest(0.0, 0.5 + CASE WHEN coalesce(n_back > observed, false) THEN -.3 ELSE .1 END + 0.2 * least(1.0, observed / 100)))::DOUBLE AS ch, 0.5::DOUBLE AS an
          FROM (SELECT s.*, count(*) OVER (PARTITION BY s.type_b) AS nc, count(*) OVER (PARTITION BY s.type_a) AS ne, k.observed AS n_back FROM s LEFT JOIN s k ON k.type_a = s.type_b AND k.type_b = s.type_a) s JOIN near n ON n.type_a = s.type_a AND n.type_b = s.type_b),
        r AS (SELECT *, (st + co + sp + 1.5 * te + gr + pl + ch + an) / 8.5 AS score0 FROM h)
        SELECT type_a, type_b, round(st, 5) AS bh_strength, round(co, 5) AS bh_consistency, round(sp, 5) AS bh_specificity, round(te, 5) AS bh_temporality, round(gr, 5) AS bh_gradient, round(pl, 5) AS bh_plausibility, round(ch, 5) AS bh_coherence, round(an, 5) AS bh_analogy, round(score0, 5) AS score,
          CASE WHEN te < .5 THEN 'not_causal' WHEN score0 >= .75 THEN 'strong' WHEN score0 >= .55 THEN 'moderate' WHEN score0 >= .4 THEN 'weak' WHEN score0 >= .25 THEN 'very_weak' ELSE 'not_causal' END AS verdict FROM r""",
}
