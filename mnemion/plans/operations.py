"""Operational, insight and relational queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.operators import operations as op
from mnemion.operators.knowledge import consented
from mnemion.sources import tables as src
from mnemion.sources.tables import event_nodes, table

T = "epoch_us(ts)"


def audit_verify(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a hash-chained log, of which every 97th payload was changed and every 89th link cut, verified whole."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("seq"), F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("payload"))
    log = op.chained(o.withColumn("cut", F.col("seq") % 89 == 0))
    log = log.withColumn("payload", F.when(F.col("seq") % 97 == 0, F.lit("changed")).otherwise(F.col("payload")))
    return op.audit_breaks(log).select("stream", "seq", "tampered", "unlinked")


def sliding_violations(spark: SparkSession, d: str) -> DataFrame:
    return op.sliding_counts(event_nodes(spark, d).where("type = 'error'"), "entity", 600, 2)


def volume_spikes(spark: SparkSession, d: str) -> DataFrame:
    days = event_nodes(spark, d).groupBy("entity", F.to_date("ts").alias("day")).agg(F.sum("value").alias("volume"))
    return op.volume_spikes(days, "entity", "day", "volume").select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("volume", 4).alias("volume"), F.round("baseline", 4).alias("baseline"))


def queue_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("since"))


def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return op.illegal_transitions(states, [("O", "F"), ("F", "O"), ("P", "O"), ("O", "P")], "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "before", "after")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return op.latencies(event_nodes(spark, d), "type", "value").select("type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


def jain_fairness(spark: SparkSession, d: str) -> DataFrame:
    users = event_nodes(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    return op.fairness(users, "n").select("n", *[F.round(c, 9).alias(c) for c in ("jain", "cv", "ratio")])


def rapid_consent_changes(spark: SparkSession, d: str) -> DataFrame:
    """Grants and refusals of one entity, at least three within a day."""
    return op.sliding_counts(event_nodes(spark, d).where("type in ('signup', 'error')"), "entity", 1440, 3)


def unconsented_escalations(spark: SparkSession, d: str) -> DataFrame:
    """Purchases without what sign-ups grant and errors revoke."""
    e = event_nodes(spark, d)
    log = e.where("type in ('signup', 'error')").select("entity", "t", (F.col("type") == "signup").alias("granted"))
    return op.unconsented(consented(e.where("type = 'purchase'").select("id", "entity", "t"), log, 7 * 86400), "entity")


def search_rates(spark: SparkSession, d: str) -> DataFrame:
    s = event_nodes(spark, d).select("type", (F.col("id") % 3 == 0).alias("clicked"), (F.col("id") % 5 == 0).alias("refined"), (F.col("id") % 7).alias("results"))
    return op.search_rates(s, "type").select("type", "n", *[F.round(c, 9).alias(c) for c in ("click_rate", "refine_rate", "empty_rate", "trend")])


def bandit_scores(spark: SparkSession, d: str) -> DataFrame:
    h = event_nodes(spark, d).select("type", (F.col("value") / 1000).alias("q"), (F.col("id") % 4 != 0).alias("ok"))
    return op.bandit(h, "type", "q", "ok").select("type", "n", F.round("score", 6).alias("score"))


def prior_confidence(spark: SparkSession, d: str) -> DataFrame:
    return op.priors(event_nodes(spark, d).withColumn("ok", F.col("type") != "error"), "entity", "ok").select("entity", "successes", "failures", F.round("confidence", 9).alias("confidence"))


def missing_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return op.missing_synthesis(table(spark, d, "documents"), "source").select("source", "n", *[F.round(c, 9).alias(c) for c in ("severity", "gain", "priority")])


def type_preferences(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 1, "valuable").otherwise("dismiss").alias("rating"))
    return op.type_preferences(f, "lang", "rating").select("lang", "n", F.round("preference", 9).alias("preference"))


def insight_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = event_nodes(spark, d).groupBy("entity").agg(F.count("*").alias("n"), (F.avg("value") / 1000).alias("strength")).withColumn("p", (F.col("entity") % 20) / 100.0)
    return rows.select("entity", F.round(op.insight_confidence(F.col("n"), F.col("p"), F.col("strength")), 6).alias("confidence"), F.round(op.data_support(F.col("n"), F.col("p"), F.col("strength"), F.lit(0.5)), 6).alias("support"))


def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") == 5) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_mktsegment")


def name_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name")


def count_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "supplier", "part", "orders", "events", "documents"):
        n = table(spark, d, name).agg(F.lit(name).alias("label"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty, and whether there are more."""
    rows = table(spark, d, "customer")
    total = rows.count()
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", F.lit(150 < total).alias("has_more"))


def merged_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An older version of the whole table, without a segment, and changes to customers of another."""
    old = table(spark, d, "customer").where("c_mktsegment != 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select("c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return src.upsert(old, new, "c_custkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def cascade(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    n, e = src.cascade_delete(nodes.select("id"), src.knowledge_edges(spark, d).where("rel = 'PLACED'"), nodes.where("c_custkey % 4 = 0").select("id"))
    return n.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges")))  # two single rows


def append_new(spark: SparkSession, d: str) -> DataFrame:
    """An older version of the whole table, without a segment, and a newer one without customers in debt."""
    c = table(spark, d, "customer")
    old, new = c.where("c_mktsegment != 'BUILDING'"), c.where("c_acctbal >= 0")
    return src.append_new(old.select("c_custkey", "c_nationkey"), new.select("c_custkey", "c_nationkey"), "c_custkey")


def grouping_summary(spark: SparkSession, d: str) -> DataFrame:
    e = event_nodes(spark, d).withColumn("weekday", F.weekday("ts"))
    return e.cube("type", "weekday").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def distinct_partners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.max("l_shipdate").alias("latest")).select("l_suppkey", "parts", F.date_format("latest", "yyyy-MM-dd").alias("latest"))


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Sales by the customer's nation; the small sides are joined first, so the large one is shuffled once at most."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    sales = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(38,6)")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(sales).cast("double"), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (audit_verify, sliding_violations, volume_spikes, queue_order, status_counts, illegal_transitions, latency_percentiles, jain_fairness, rapid_consent_changes, unconsented_escalations, search_rates, bandit_scores, prior_confidence, missing_synthesis, type_preferences, insight_scores, entity_filter, name_contains, count_by_label, page_with_total, merged_upsert, cascade, append_new, grouping_summary, distinct_partners, revenue_by_nation)}

SQL = {
    "audit_verify": """WITH f AS (SELECT o_custkey AS stream, o_orderkey AS seq, o_orderkey % 97 = 0 AS tampered, o_orderkey % 89 = 0 AND o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey) AS unlinked FROM orders)
        SELECT * FROM f WHERE tampered OR unlinked""",
    "sliding_violations": f"""WITH e AS (SELECT event_id AS id, user_id AS entity, {T} AS t FROM events WHERE event_type = 'error'), c AS (SELECT *, count(*) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS in_window FROM e)
        SELECT entity, t // 3600000000 AS hour, id, in_window FROM c WHERE in_window >= 2 QUALIFY row_number() OVER (PARTITION BY entity, t // 3600000000 ORDER BY t, id) = 1""",
    "volume_spikes": """WITH d AS (SELECT user_id AS entity, ts::DATE AS day, sum(value) AS volume FROM events GROUP BY 1, 2), b AS (SELECT *, avg(volume) OVER w AS baseline, count(volume) OVER w AS n FROM d WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))
        SELECT entity, strftime(day, '%Y-%m-%d') AS day, round(volume, 4) AS volume, round(baseline, 4) AS baseline FROM b WHERE n >= 3 AND volume > 3 * baseline""",
    "queue_order": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 200",
    "status_counts": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS since FROM orders GROUP BY 1",
    "illegal_transitions": "WITH s AS (SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_orderstatus AS after FROM orders) SELECT * FROM s WHERE before IS NOT NULL AND (before, after) NOT IN (('O', 'F'), ('F', 'O'), ('P', 'O'), ('O', 'P'))",
    "latency_percentiles": "SELECT event_type AS type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "jain_fairness": "WITH u AS (SELECT count(*)::DOUBLE AS x FROM events GROUP BY user_id) SELECT count(*) AS n, round(sum(x) * sum(x) / (count(*) * sum(x * x)), 9) AS jain, round(stddev_pop(x) / avg(x), 9) AS cv, round(max(x) / min(x), 9) AS ratio FROM u",
    "rapid_consent_changes": f"""WITH e AS (SELECT event_id AS id, user_id AS entity, {T} AS t FROM events WHERE event_type IN ('signup', 'error')), c AS (SELECT *, count(*) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM e)
        SELECT entity, t // 3600000000 AS hour, id, in_window FROM c WHERE in_window >= 3 QUALIFY row_number() OVER (PARTITION BY entity, t // 3600000000 ORDER BY t, id) = 1""",
    "unconsented_escalations": f"""WITH e AS (SELECT event_id AS id, user_id AS entity, event_type AS type, {T} AS t FROM events), m AS (SELECT p.id, p.entity, p.t, max(c.t) AS last FROM e p LEFT JOIN e c ON c.entity = p.entity AND c.t <= p.t AND c.type IN ('signup', 'error') WHERE p.type = 'purchase' GROUP BY 1, 2, 3),
        a AS (SELECT m.*, coalesce(t - last <= 604800000000 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.entity = m.entity AND x.t = m.last AND x.type = 'error'), false) AS active FROM m)
        SELECT entity, t // 3600000000 AS hour, count(*) AS n, arg_min(id, (t, id)) AS first FROM a WHERE NOT active GROUP BY 1, 2""",
    "search_rates": """WITH s AS (SELECT event_type AS type, (event_id % 3 = 0)::INT AS c, (event_id % 5 = 0)::INT AS r, (event_id % 7 = 0)::INT AS z FROM events) SELECT type, count(*) AS n, round(avg(c), 9) AS click_rate, round(avg(r), 9) AS refine_rate, round(avg(z), 9) AS empty_rate, round(avg(c) - avg(r), 9) AS trend FROM s GROUP BY 1""",
    "bandit_scores": "WITH s AS (SELECT event_type AS type, count(*) AS n, avg(value / 1000) AS q, avg((event_id % 4 != 0)::INT) AS s FROM events GROUP BY 1) SELECT type, n, round(q * s + 1.4 * sqrt(ln(sum(n) OVER ()) / n), 6) AS score FROM s",
    "prior_confidence": "SELECT user_id AS entity, count(*) FILTER (event_type != 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type != 'error') / count(*), 9) AS confidence FROM events GROUP BY 1",
    "missing_synthesis": "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3), x AS (SELECT *, least(0.9, 0.4 + 0.05 * n)::DOUBLE AS sv, least(1.0, n / 10)::DOUBLE AS g FROM s) SELECT source, n, round(sv, 9) AS severity, round(g, 9) AS gain, round(0.4 * sv + 0.4 * g + 0.14, 9) AS priority FROM x",
    "type_preferences": "SELECT lang, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 THEN 1.0 ELSE -0.5 END), 9) AS preference FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "insight_scores": """WITH r AS (SELECT user_id AS entity, count(*) AS n, avg(value) / 1000 AS s, (user_id % 20) / 100.0 AS p FROM events GROUP BY 1)
        SELECT entity, round(least(1.0, 0.5 + CASE WHEN n >= 10 THEN .2 WHEN n >= 5 THEN .1 ELSE 0 END + CASE WHEN p <= .01 THEN .3 WHEN p <= .05 THEN .2 WHEN p <= .1 THEN .1 ELSE 0 END + 0.2 * s), 6) AS confidence,
          round(least(1.0, 0.3 + 0.3 * s + CASE WHEN p < .01 THEN .2 WHEN p < .05 THEN .15 WHEN p < .1 THEN .1 ELSE 0 END + CASE WHEN n >= 20 THEN .1 WHEN n >= 10 THEN .05 ELSE 0 END + 0.05), 6) AS support FROM r""",
    "entity_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 5 AND c_acctbal > 0",
    "name_contains": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')",
    "count_by_label": " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {n}" for n in ("customer", "supplier", "part", "orders", "events", "documents")),
    "page_with_total": "SELECT c_custkey, 150 < (SELECT count(*) FROM customer) AS has_more FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100",
    "merged_upsert": "SELECT c_custkey, CASE WHEN c_mktsegment != 'BUILDING' THEN c_name END AS c_name, round(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal FROM customer",
    "cascade": "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 4 != 0) AS nodes, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)) AS edges",
    "append_new": "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment != 'BUILDING' OR c_acctbal >= 0",
    "grouping_summary": "SELECT event_type AS type, (isodow(ts) - 1)::INTEGER AS weekday, count(*) AS n, (grouping(event_type) * 2 + grouping((isodow(ts) - 1)::INTEGER))::BIGINT AS level FROM events GROUP BY CUBE (event_type, (isodow(ts) - 1)::INTEGER)",
    "distinct_partners": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM lineitem GROUP BY 1",
    "revenue_by_nation": "SELECT n_name, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(28, 6))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
