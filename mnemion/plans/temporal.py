"""Temporal queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.operators import temporal as op
from mnemion.sources.tables import causal_edges, event_nodes, table

T = "epoch_us(ts)"
E = f"SELECT event_id AS id, user_id AS entity, event_type AS type, ts, {T} AS t, value FROM events"


def time_range_decay_topk(spark: SparkSession, d: str) -> DataFrame:
    found = op.with_decay(op.time_range(event_nodes(spark, d), "2024-01-05 00:00:00", "2024-01-25 00:00:00", ["click", "purchase"]), "2024-01-31 00:00:00")
    return found.orderBy(F.desc("score"), "id").limit(100).select("id", "type", F.round("score", 9).alias("score"))


def events_before(spark: SparkSession, d: str) -> DataFrame:
    return op.relative_to(event_nodes(spark, d), 500, "before", 7200).select("id", "type", F.round("gap_s", 3).alias("gap_s"))


def events_after(spark: SparkSession, d: str) -> DataFrame:
    return op.relative_to(event_nodes(spark, d), 500, "after", 7200).select("id", "type", F.round("gap_s", 3).alias("gap_s"))


def events_simultaneous(spark: SparkSession, d: str) -> DataFrame:
    return op.relative_to(event_nodes(spark, d), 500, "simultaneous", 1800).select("id", "type", F.round("gap_s", 3).alias("gap_s"))


def _relative(where: str) -> str:
    return f"WITH e AS ({E}), r AS (SELECT t FROM e WHERE id = 500) SELECT e.id, e.type, round((e.t - r.t) / 1e6, 3) AS gap_s FROM e, r WHERE id != 500 AND {where}"


def weekday_pattern(spark: SparkSession, d: str) -> DataFrame:
    return op.weekdays(event_nodes(spark, d))


def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = op.gap_statistics(op.gaps(event_nodes(spark, d), ["entity", "type"]), ["type"])
    return g.select("type", "n", *[F.round(c, 4).alias(c) for c in ("avg_gap", "min_gap", "max_gap", "std_gap", "consistency", "strength")])


def recurring_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return op.ngrams(event_nodes(spark, d), 2)


def recurring_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return op.ngrams(event_nodes(spark, d), 3)


def sequence_match(spark: SparkSession, d: str) -> DataFrame:
    s = op.sequences(event_nodes(spark, d), ["view", "click", "purchase"], 86400)
    return s.select("entity", "id_0", "id_1", "id_2")


def pair_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows only in SQL's eyes: the matching is sequential; tests hold it against a literal loop."""
    return op.greedy_pairs(event_nodes(spark, d), [("view", "purchase"), ("click", "signup")], 86400)


def correlation_scan(spark: SparkSession, d: str) -> DataFrame:
    return op.correlations(event_nodes(spark, d), 86400)


def correlation_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole scan: matches, causal order, significance, correction; what doesn't remain is flagged."""
    out = op.scanned(event_nodes(spark, d), 86400, drop=False)
    return out.select("type_a", "type_b", "observed", *[F.round(c, 5).alias(c) for c in ("avg_gap", "consistency", "strength", "expected", "p_value", "fdr", "effect")], "causal", "remains").orderBy(F.desc("strength"), "type_a", "type_b")


def correlation_summary(spark: SparkSession, d: str) -> DataFrame:
    return op.summary(op.correlations(event_nodes(spark, d), 86400)).select("total", "causal", F.round("avg_strength", 6).alias("avg_strength"), "strongest")


def lag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return op.lag_buckets(op.greedy_pairs(event_nodes(spark, d), [("view", "purchase")], 7 * 86400, 3600), 3600, 86400)


def bootstrap_gap(spark: SparkSession, d: str) -> DataFrame:
    return op.bootstrap_mean(op.greedy_pairs(event_nodes(spark, d), [("view", "purchase")], 86400), ["type_a", "type_b"], "gap_s")


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return op.cooccurrence(event_nodes(spark, d), 3600)


COOCCURRENCE = f"""e AS ({E}), o AS (SELECT a.type AS type_a, b.type AS type_b, count(DISTINCT a.id) AS observed FROM e a JOIN e b ON a.entity = b.entity AND b.t > a.t AND b.t - a.t <= 3600000000 AND a.type != b.type GROUP BY 1, 2),
n AS (SELECT type, count(*) AS n FROM e GROUP BY 1),
c AS (SELECT o.type_a, o.type_b, x.n AS n_a, y.n AS n_b, o.observed FROM o JOIN n x ON x.type = o.type_a JOIN n y ON y.type = o.type_b)"""


def _tested(spark: SparkSession, d: str) -> DataFrame:
    return op.significance(op.cooccurrence(event_nodes(spark, d), 3600), 3600 / 86400, 30.0)


def significance(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d).select("type_a", "type_b", "observed", *[F.round(c, 5).alias(c) for c in ("expected", "chi", "p_value", "effect")], "effect_label", "significant")


TESTED = f"""{COOCCURRENCE},
x AS (SELECT *, greatest(0.1, n_a * least(1.0, n_b * (3600 / 86400.0) / 30.0)) AS expected, n_a + n_b < 20 OR observed < 5 AS few, greatest(0, n_b - observed) AS fb, greatest(0, n_a - observed) AS fc FROM c),
y AS (SELECT *, greatest(1, n_a + n_b - observed - fb - fc) AS fd FROM x),
z AS (SELECT *, CASE WHEN few THEN pow(observed - (observed + fb) * (observed + fc) / (observed + fb + fc + fd), 2) / ((observed + fb) * (observed + fc) / (observed + fb + fc + fd))
  ELSE pow(observed - expected, 2) / expected + CASE WHEN n_a > expected THEN pow((n_a - observed) - (n_a - expected), 2) / greatest(0.1, n_a - expected) ELSE 0 END END AS chi FROM y),
p AS (SELECT *, 1.0 / (1.0 + 0.3275911 * sqrt(chi) / sqrt(2.0)) AS u, sqrt(chi) / sqrt(2.0) AS v FROM z),
q AS (SELECT *, (((((1.061405429 * u - 1.453152027) * u) + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-v * v) AS p_value,
  CASE WHEN few THEN CASE WHEN fb * fc > 0 THEN least(100.0, observed * fd / (fb * fc)) WHEN observed > 0 THEN 100.0 ELSE 1.0 END ELSE sqrt(chi / (n_a + n_b)) END AS effect FROM p),
s AS (SELECT *, CASE WHEN few THEN CASE WHEN effect < 1.5 THEN 'negligible' WHEN effect < 2.5 THEN 'small' WHEN effect < 4 THEN 'medium' ELSE 'large' END
  ELSE CASE WHEN effect < .1 THEN 'negligible' WHEN effect < .3 THEN 'small' WHEN effect < .5 THEN 'medium' ELSE 'large' END END AS effect_label, p_value < 0.05 AND observed > expected AND effect >= 0.1 AS significant FROM q)"""


def corrections(spark: SparkSession, d: str) -> DataFrame:
    c = op.corrected(_tested(spark, d), ["type_a", "type_b"])
    return c.select("type_a", "type_b", "rank", F.round("bonferroni", 5).alias("bonferroni"), F.round("fdr", 5).alias("fdr"), "bonferroni_significant", "fdr_significant")


def fdr_standard(spark: SparkSession, d: str) -> DataFrame:
    c = op.corrected(_tested(spark, d), ["type_a", "type_b"], method="standard")
    return c.select("type_a", "type_b", "rank", F.round("fdr", 5).alias("fdr"))


CORRECTED = f"WITH {TESTED}, r AS (SELECT *, row_number() OVER (ORDER BY round(p_value, 9), type_a, type_b)::INTEGER AS rank, count(*) OVER () AS tests FROM s), w AS (SELECT *, least(1.0, p_value * tests / rank) AS raw FROM r)"


def precedence_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = op.precedence(event_nodes(spark, d), 72 * 3600)
    return m.select("type_a", "type_b", "pairs", F.round("p_ab", 9).alias("p_ab"), F.round("p_ba", 9).alias("p_ba"), "edge")


def causal_order(spark: SparkSession, d: str) -> DataFrame:
    order, confidence = op.causal_order(op.precedence(event_nodes(spark, d), 72 * 3600))
    return spark.createDataFrame([(i, t, float(confidence)) for i, t in enumerate(order)], "place int, type string, confidence double")


def _timed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive events of a user; every third edge has no time, the others that of their source."""
    e = causal_edges(spark, d)
    return e.select("src", "dst", "rel", F.when(F.col("rel") != "CAUSES", F.timestamp_micros("t_src")).alias("valid_from"))


def temporal_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Of all events, those next to them in the graph within ten minutes."""
    at = event_nodes(spark, d).select("id", "t")
    return op.neighbourhood(_timed_edges(spark, d), at, at, 600).select("centre", "neighbour", "rel", "way", F.round("decay", 9).alias("decay"))


def hybrid_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    at = event_nodes(spark, d).select("id", "t", "type", "value")
    near = op.neighbourhood(_timed_edges(spark, d), at, at, 600)
    values = lambda k: at.select(F.col("id").alias(k), F.col("value").alias(f"v_{k}"))
    pairs = near.select("centre", "neighbour").distinct().join(values("centre"), "centre").join(values("neighbour"), "neighbour")
    similar = pairs.where("v_centre is not null and v_neighbour is not null").select("centre", "neighbour", (1 / (1 + F.abs(F.col("v_centre") - F.col("v_neighbour")))).alias("similarity"))
    return op.hybrid_neighbourhood(near, similar).select("centre", "neighbour", F.round("score", 9).alias("score"))


def overlapping_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of users' days of purchases and errors that overlap in time, by the hours from a day's first to its last."""
    days = lambda kind: event_nodes(spark, d).where(F.col("type") == kind).groupBy("entity", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("n > 1").select(F.concat_ws(":", "entity", F.date_format("day", "yyyyMMdd")).alias("id"), "lo", "hi")
    return op.overlapping(days("purchase"), days("error"), 6 * 3600)


def rhythm(spark: SparkSession, d: str) -> DataFrame:
    r = op.rhythm(event_nodes(spark, d))
    return r.select("entity", "n", F.round("period_s", 3).alias("period_s"), F.round("cv", 6).alias("cv"), "cyclic", "trend", F.round("ratio", 6).alias("ratio"))


def unified_items(spark: SparkSession, d: str) -> DataFrame:
    """Events and documents by kind, with their number; a document's category follows its source."""
    e = event_nodes(spark, d).select(F.lit("event").alias("kind"), F.when(F.col("type") == "purchase", "decision").otherwise("activity").alias("category"), F.length("type").cast("long").alias("size"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.when(F.col("source").rlike("[02468]$"), "markdown_note").otherwise("pdf_document").alias("category"), F.col("n_chars").alias("size"))
    return e.unionByName(docs).groupBy("kind", "category").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def consistency_causal(spark: SparkSession, d: str) -> DataFrame:
    edges = causal_edges(spark, d)
    # Every edge is turned round as well: exactly those are violations.
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.col("t_dst").alias("t_src"), F.col("t_src").alias("t_dst"))
    return op.order_violations(edges.select(turned.columns).unionByName(turned)).select("src", "dst", "rel")


EDGES = f"""e AS ({E}), l AS (SELECT entity, id AS src, t AS t_src, type AS src_type, lead(id) OVER w AS dst, lead(t) OVER w AS t_dst, lead(type) OVER w AS dst_type FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, id)),
g AS (SELECT src, dst, CASE (t_dst - t_src) % 3 WHEN 0 THEN 'CAUSES' WHEN 1 THEN 'ENABLES' ELSE 'TRIGGERS' END AS rel, round(1.0 - (t_dst - t_src) / 7200000000.0, 6) AS confidence, t_src, t_dst, src_type, dst_type, entity FROM l WHERE t_dst - t_src > 0 AND t_dst - t_src <= 3600000000)"""


NEAR = f"""{EDGES}, w AS (SELECT src AS centre, dst AS neighbour, rel, CASE WHEN rel != 'CAUSES' THEN t_src END AS valid, t_src AS tc, t_dst AS tn, 'outgoing' AS way FROM g UNION ALL SELECT dst, src, rel, CASE WHEN rel != 'CAUSES' THEN t_src END, t_dst, t_src, 'incoming' FROM g),
h AS (SELECT centre, neighbour, rel, way, exp(-(ln(2) / 30) * (abs(tn - tc) / 86400000000.0)) AS decay FROM w WHERE valid IS NULL OR abs(valid - tc) <= 600000000 OR abs(tn - tc) <= 600000000)"""


def temporal_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("placed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(", billed "), F.date_format("o_orderdate", "d.M.yyyy")).alias("text"))
    return op.markers(rows).select("doc_id", "kind", "marker")


def ngram_sql(n: int) -> str:
    parts = ", ".join(f"lead(type, {i}) OVER w AS p{i}" for i in range(n))
    pattern = " || '>' || ".join(f"p{i}" for i in range(n))
    return f"WITH e AS ({E}), l AS (SELECT {parts} FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, id)) SELECT {pattern} AS pattern, count(*) AS n FROM l WHERE {pattern} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"


def relative_markers(spark: SparkSession, d: str) -> DataFrame:
    """Due dates told in relation to the orders' dates."""
    k = F.col("o_orderkey")
    told = F.expr("case o_orderkey % 6 when 0 then 'sent Yesterday' when 1 then 'due tomorrow' when 2 then 'due today' when 3 then concat('seen ', o_orderkey % 9, ' days ago') when 4 then concat('in ', o_orderkey % 5 + 1, ' weeks') else 'some day' end")
    return table(spark, d, "orders").select(k, told.alias("told"), F.to_date("o_orderdate").alias("reference")).select("o_orderkey", "told", F.date_format(op.relative_marker(F.col("told"), F.col("reference")), "yyyy-MM-dd").alias("date"))


QUERIES = {f.__name__: f for f in (time_range_decay_topk, events_before, events_after, events_simultaneous, weekday_pattern, event_gaps, recurring_bigrams, recurring_trigrams, sequence_match, pair_matches, correlation_scan, correlation_report, correlation_summary, lag_histogram, bootstrap_gap, cooccurrence, significance, corrections, fdr_standard, precedence_matrix, causal_order, temporal_neighbourhood, hybrid_neighbourhood, overlapping_sessions, rhythm, unified_items, consistency_causal, temporal_markers, relative_markers)}

SQL = {
    "time_range_decay_topk": f"WITH e AS ({E}) SELECT id, type, round(exp(-(ln(2) / 30) * ((epoch_us(TIMESTAMP '2024-01-31') - t) / 86400000000.0)), 9) AS score FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND type IN ('click', 'purchase') ORDER BY t DESC, id LIMIT 100",
    "events_before": _relative("e.t < r.t AND e.t >= r.t - 7200000000"),
    "events_after": _relative("e.t > r.t AND e.t <= r.t + 7200000000"),
    "events_simultaneous": _relative("abs(e.t - r.t) <= 1800000000"),
    "weekday_pattern": """WITH n AS (SELECT (isodow(ts) - 1)::INTEGER AS weekday, count(*) AS n FROM events GROUP BY 1), d AS (SELECT w::INTEGER AS weekday, coalesce(n.n, 0) AS n FROM range(7) r(w) LEFT JOIN n ON n.weekday = w), m AS (SELECT *, (n - sum(n) OVER () / 7.0) / (sum(n) OVER () / 7.0) * 100 AS x FROM d)
        SELECT weekday, n, round(x, 6) AS deviation, CASE WHEN x > 25 THEN 'peak' WHEN x < -25 THEN 'trough' ELSE 'normal' END AS kind FROM m""",
    "event_gaps": f"""WITH e AS ({E}), g AS (SELECT type, (t - lag(t) OVER (PARTITION BY entity, type ORDER BY t, id)) / 1e6 AS g FROM e), s AS (SELECT type, count(*) AS n, avg(g) AS a, min(g) AS lo, max(g) AS hi, coalesce(stddev_samp(g), 0) AS sd FROM g WHERE g IS NOT NULL GROUP BY 1),
        c AS (SELECT *, CASE WHEN a = 0 THEN 1.0 ELSE greatest(0.0, 1 - least(sd / a, 1.0)) END AS k FROM s) SELECT type, n, round(a, 4) AS avg_gap, round(lo, 4) AS min_gap, round(hi, 4) AS max_gap, round(sd, 4) AS std_gap, round(k, 4) AS consistency, round(k * least(1.0, n / 10.0), 4) AS strength FROM c""",
    "recurring_bigrams": ngram_sql(2),
    "recurring_trigrams": ngram_sql(3),
    "sequence_match": f"""WITH e AS ({E}), v AS (SELECT a.entity, a.id AS id_0, arg_min(b.id, (b.t, b.id)) AS id_1, min(b.t) AS t_1 FROM e a JOIN e b ON a.entity = b.entity AND b.type = 'click' AND b.t > a.t AND b.t - a.t <= 86400000000 WHERE a.type = 'view' GROUP BY 1, 2)
        SELECT v.entity, id_0, id_1, arg_min(c.id, (c.t, c.id)) AS id_2 FROM v JOIN e c ON c.entity = v.entity AND c.type = 'purchase' AND c.t > t_1 AND c.t - t_1 <= 86400000000 GROUP BY 1, 2, 3""",
    "cooccurrence": f"WITH {COOCCURRENCE} SELECT * FROM c",
    "significance": f"WITH {TESTED} SELECT type_a, type_b, observed, round(expected, 5) AS expected, round(chi, 5) AS chi, round(p_value, 5) AS p_value, round(effect, 5) AS effect, effect_label, significant FROM s",
    "corrections": f"{CORRECTED} SELECT type_a, type_b, rank, round(least(1.0, p_value * tests), 5) AS bonferroni, round(max(raw) OVER (ORDER BY rank), 5) AS fdr, p_value < 0.05 / tests AS bonferroni_significant, max(raw) OVER (ORDER BY rank) < 0.05 AS fdr_significant FROM w",
    "fdr_standard": f"{CORRECTED} SELECT type_a, type_b, rank, round(min(raw) OVER (ORDER BY rank DESC), 5) AS fdr FROM w",
    "precedence_matrix": f"""WITH e AS ({E}), p AS (SELECT a.type AS type_a, b.type AS type_b, count(*) AS pairs, count(*) FILTER (a.t < b.t) AS n FROM e a JOIN e b ON a.entity = b.entity AND a.type < b.type AND abs(a.t - b.t) <= 259200000000 GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT type_a, type_b, pairs, round(n / pairs, 9) AS p_ab, round(1 - n / pairs, 9) AS p_ba, CASE WHEN n / pairs >= 0.6 THEN 'a->b' WHEN 1 - n / pairs >= 0.6 THEN 'b->a' ELSE 'none' END AS edge FROM p""",
    "temporal_neighbourhood": f"WITH {NEAR} SELECT DISTINCT centre, neighbour, rel, way, round(decay, 9) AS decay FROM h",
    "hybrid_neighbourhood": f"WITH {NEAR}, m AS (SELECT centre, neighbour, max(decay) AS decay FROM h GROUP BY 1, 2) SELECT centre, neighbour, round(0.7 * decay + 0.3 * coalesce(1 / (1 + abs(x.value - y.value)), 0), 9) AS score FROM m JOIN e x ON x.id = centre JOIN e y ON y.id = neighbour",
    "overlapping_sessions": f"""WITH e AS ({E}), s AS (SELECT type, entity || ':' || strftime(ts, '%Y%m%d') AS id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1, 2 HAVING count(*) > 1) SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.type = 'purchase' AND b.type = 'error' AND a.lo <= b.hi AND b.lo <= a.hi""",
    "rhythm": f"""WITH e AS ({E}), g AS (SELECT entity, (t - lag(t) OVER w) / 1e6 AS g, row_number() OVER w AS k, count(*) OVER (PARTITION BY entity) AS m FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, id)),
        s AS (SELECT entity, count(*) + 1 AS n, avg(g) AS period, stddev_pop(g) AS sd, avg(g) FILTER (k - 1 <= (m - 1) // 2) AS early, avg(g) FILTER (k - 1 > (m - 1) // 2) AS late FROM g WHERE g IS NOT NULL GROUP BY 1),
        r AS (SELECT *, CASE WHEN period > 0 THEN sd / period ELSE 0 END AS cv, CASE WHEN late > 0 THEN early / late END AS ratio FROM s)
        SELECT entity, n, round(period, 3) AS period_s, round(cv, 6) AS cv, n >= 4 AND cv < 0.3 AS cyclic, CASE WHEN n < 5 OR ratio IS NULL THEN 'unknown' WHEN ratio > 1.3 THEN 'increasing' WHEN ratio < 0.7 THEN 'decreasing' ELSE 'stable' END AS trend, round(ratio, 6) AS ratio FROM r""",
    "unified_items": """WITH u AS (SELECT 'event' AS kind, CASE WHEN event_type = 'purchase' THEN 'decision' ELSE 'activity' END AS category, length(event_type) AS size FROM events
        UNION ALL SELECT 'document', CASE WHEN regexp_matches(source, '[02468]$') THEN 'markdown_note' ELSE 'pdf_document' END, n_chars FROM documents) SELECT kind, category, count(*) AS n, sum(size)::BIGINT AS size FROM u GROUP BY 1, 2""",
    "consistency_causal": f"WITH {EDGES} SELECT dst AS src, src AS dst, rel FROM g",
    "temporal_markers": "SELECT o_orderkey AS doc_id, 'iso' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS marker FROM orders UNION ALL SELECT o_orderkey, 'us', strftime(o_orderdate, '%-m/%-d/%Y') FROM orders UNION ALL SELECT o_orderkey, 'eu', strftime(o_orderdate, '%-d.%-m.%Y') FROM orders",
    "relative_markers": """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS r, CASE o_orderkey % 6 WHEN 0 THEN 'sent Yesterday' WHEN 1 THEN 'due tomorrow' WHEN 2 THEN 'due today' WHEN 3 THEN 'seen ' || o_orderkey % 9 || ' days ago' WHEN 4 THEN 'in ' || (o_orderkey % 5 + 1) || ' weeks' ELSE 'some day' END AS told,
        CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -(o_orderkey % 9) WHEN 4 THEN 7 * (o_orderkey % 5 + 1) END AS days FROM orders) SELECT o_orderkey, told, strftime(r + days::INT, '%Y-%m-%d') AS date FROM t""",
}
