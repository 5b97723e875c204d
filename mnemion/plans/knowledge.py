"""Queries on names, threads, chunks, consent and gaps, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.functions import vectors as v
from mnemion.operators import documents, graph, operations, temporal
from mnemion.operators import knowledge as op
from mnemion.operators import retrieval as vec
from mnemion.plans.graph import _communities
from mnemion.plans.retrieval import KNN, _queries, _vectors
from mnemion.plans.temporal import EDGES, E, ngram_sql
from mnemion.sources.tables import causal_edges, event_nodes, knowledge_edges, table


def entities_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The customers that events name, and whether they exist."""
    asked = event_nodes(spark, d).select(F.col("entity").alias("c_custkey")).distinct()
    found = table(spark, d, "customer").select("c_custkey", "c_name")
    return asked.join(found, "c_custkey", "left").select("c_custkey", "c_name", F.col("c_name").isNotNull().alias("found"))


def edges_between(spark: SparkSession, d: str) -> DataFrame:
    """Supplies from suppliers of a region's nations to parts of a brand."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("id")
    parts = table(spark, d, "part").where("p_size > 25").select(name("part", "p_partkey"))
    suppliers = table(spark, d, "supplier").where("s_nationkey < 12").select(name("supplier", "s_suppkey"))
    return op.edges_between(knowledge_edges(spark, d), parts, suppliers).groupBy("src", "dst").agg(F.count("*").alias("n"))


def entity_connections(spark: SparkSession, d: str) -> DataFrame:
    e = event_nodes(spark, d)
    return op.connections(causal_edges(spark, d), e.where("type = 'signup'").select("id"), e.where("type = 'purchase'").select("id"), 3)


def cascades(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three nodes or more whose confidence is enough."""
    found = graph.paths(causal_edges(spark, d), event_nodes(spark, d).where("type = 'error'").select("id"), 4, 2)
    return found.withColumn("score", graph.product("confidences")).where("score >= 0.4").select("start", "end", "hops", F.round("score", 6).alias("score"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Wikilinks of notes about suppliers, resolved to nations."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    notes = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("id")).select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("From [["), F.initcap("name"), F.lit("|there]], not [[Atlantis]] #supplier")).alias("text"))
    links = documents.links(notes).where("rel = 'links_to'").select("src", F.col("dst").alias("name"))
    return op.resolved(links, n)


def note_links(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("See [[n"), F.col("s_nationkey").cast("string"), F.lit("#top]] #tag/"), F.col("s_nationkey").cast("string")).alias("text"))
    return documents.links(notes)


def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(w,) for w in ("Ring", "bolt", "WIDGET", "red", "blue")], "name string")
    found = op.mentions(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), names)
    return found.groupBy("name").agg(F.count("*").alias("parts"), F.sum("n").alias("n"))


def message_threads(spark: SparkSession, d: str) -> DataFrame:
    """Every third turn replies to the conversation's first, the others to the turn before."""
    c = table(spark, d, "conversations")
    back = F.when(F.col("turn") % 3 == 2, F.lit(0)).otherwise(F.col("turn") - 1)
    return op.threads(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + back).alias("parent")))


def response_times(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events: their span in days, and the mean minutes between those at different times."""
    g = temporal.gaps(event_nodes(spark, d))
    out = g.groupBy("entity").agg(((F.max("t") - F.min("t")) / temporal.DAY).alias("span"), F.avg(F.when(F.col("gap_s") > 0, F.col("gap_s") / 60)).alias("minutes"))
    return out.select("entity", F.round("span", 6).alias("span"), F.round("minutes", 6).alias("minutes"))


def chunk_titles(spark: SparkSession, d: str) -> DataFrame:
    """Turns as markdown: a title, a section for the role, a subsection with the text."""
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("# Conversation\nOn it.\n## "), F.col("role"), F.lit("\n### Text\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n## End\nDone."))
    found = op.by_title(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "chunk", "title", F.array_join("path", " > ").alias("path"), F.length("content").alias("size"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("page", F.floor(F.col("turn") / 2))
    return op.by_page(c, "conv_id", "page", "turn").select("conv_id", "page", F.md5(F.col("content").cast("binary")).alias("digest"))


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of their conversation, from 200 to 1,000 characters."""
    c = table(spark, d, "conversations")
    return op.sized(c.withColumnRenamed("text", "content"), 200, 1000, "conv_id", "turn").select("conv_id", F.col("turn").alias("chunk"), F.length("content").alias("size"), F.md5(F.col("content").cast("binary")).alias("digest"))


def recurring_fourgrams(spark: SparkSession, d: str) -> DataFrame:
    return temporal.ngrams(event_nodes(spark, d), 4)


def recurring_fivegrams(spark: SparkSession, d: str) -> DataFrame:
    return temporal.ngrams(event_nodes(spark, d), 5)


def pattern_variants(spark: SparkSession, d: str) -> DataFrame:
    e = event_nodes(spark, d)
    return op.subsequences(temporal.ngrams(e, 2), temporal.ngrams(e, 3))


def consent_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups grant and errors revoke what purchases need, for a week."""
    e = event_nodes(spark, d)
    log = e.where("type in ('signup', 'error')").select("entity", "t", (F.col("type") == "signup").alias("granted"))
    return op.consented(e.where("type = 'purchase'").select("id", "entity", "t"), log, 7 * 86400).select("id", "active")


def off_hours_activity(spark: SparkSession, d: str) -> DataFrame:
    return op.off_hours(event_nodes(spark, d), "entity").select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def community_bridges(spark: SparkSession, d: str) -> DataFrame:
    return op.bridges(*_communities(spark, d), 100_000).select("a", "b", "links", F.round("gain", 9).alias("gain"))


def quality_trends(spark: SparkSession, d: str) -> DataFrame:
    h = event_nodes(spark, d).select("entity", F.struct("t", "id").alias("at"), (F.col("value") / 100).alias("q")).where("q is not null")
    return op.quality_trend(h, "entity", "at", "q").select("entity", "n", F.round("change", 6).alias("change"), "trend")


def insight_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = event_nodes(spark, d)
    prefs = e.groupBy("type").agg((F.avg(F.when(F.col("id") % 3 == 0, 1.0).otherwise(-0.5))).alias("preference"))
    ins = e.select("id", "type", ((F.col("id") % 10) / 10.0).alias("confidence"), ((F.col("id") % 7) / 7.0).alias("relevance"), ((F.col("id") % 4) / 4.0).alias("aspiration"), (F.col("id") % 90).alias("age_days"))
    return op.ranked_insights(ins, prefs).select("id", F.round("score", 9).alias("score"), "shown")


def type_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of user and type that came up or went away with the last days of the month."""
    e = event_nodes(spark, d).withColumn("kind", F.concat_ws(":", "entity", "type"))
    return op.schema_changes(e, "kind", F.col("ts") >= F.lit("2024-01-26").cast("timestamp_ntz"))


def document_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"has_text": F.length("text") > 0, "length_agrees": F.col("n_chars") == F.length("text"), "at_most_50_kb": F.octet_length("text") <= 50 * 1024, "has_source": F.col("source").isNotNull(), "known_language": F.col("lang").isin("en", "de", "fr")}
    return op.violations(table(spark, d, "documents"), rules)


def starved_users(spark: SparkSession, d: str) -> DataFrame:
    return op.starved(event_nodes(spark, d).groupBy("entity").agg(F.count("*").alias("n")), "entity", "n", 0.8)


def source_resources(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("largest"))


def complexity_distribution(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("text is not null").select(F.length("text").alias("x"))
    bucket = F.when(F.col("x") < 1000, "short").when(F.col("x") < 5000, "medium").otherwise("long")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg("x"), 6).alias("mean"))


def aggregation_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the number of purchases and their distinct whole values."""
    e = event_nodes(spark, d).where("type = 'purchase' and value is not null")
    return e.groupBy("entity").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.floor("value"))).cast("array<string>"), ",").alias("all_values"))


def approximate_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Whether sketches are within their bounds of the exact numbers."""
    a = op.approximate(event_nodes(spark, d), ["type"], "entity", "value")
    return a.select("type", "exact_distinct", (F.abs(F.col("distinct") - F.col("exact_distinct")) <= 0.1 * F.col("exact_distinct") + 1).alias("within"))


def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as nested JSON, read back with fallbacks."""
    j = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct("source", "n_chars").alias("file"))).alias("j"))
    get = lambda path, other: F.coalesce(F.get_json_object("j", path), F.lit(other))
    return j.select("doc_id", get("$.lang", "unknown").alias("lang"), get("$.file.source", "none").alias("source"), get("$.file.owner", "nobody").alias("owner"), F.from_json("j", "file struct<n_chars:long>")["file"]["n_chars"].alias("n_chars"))


def similar_recent(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors among those whose event is from noon of the first day on."""
    recent = event_nodes(spark, d).where(F.col("ts") >= F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select("id")
    mine = _vectors(spark, d).join(recent, "id", "left_semi").select("id", "v")
    return vec.nearest(mine, _queries(spark, d), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def combined_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector put before its double, padded to 160 and cut to 96 components."""
    x = F.concat("v", F.transform("v", lambda c: 2 * c))
    padded = F.concat(x, F.array_repeat(F.lit(0.0), 160 - 128))
    return _vectors(spark, d).select("id", F.size(padded).alias("size"), F.round(v.norm(padded), 6).alias("norm"), F.round(v.norm(F.slice(padded, 1, 96)), 6).alias("cut"))


def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Languages by the extensions of names; others are unknown."""
    kinds = F.create_map(*[F.lit(x) for kv in {"py": "python", "md": "markdown", "rs": "rust", "ts": "typescript"}.items() for x in kv])
    names = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("py", "md", "rs", "bin")]), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"))
    return names.select("p_partkey", F.coalesce(kinds[F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))], F.lit("unknown")).alias("language"))


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    """Each source against thresholds of its own documents: pass, warn or fail."""
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg((F.length("text") < 1000).cast("double")).alias("short"))
    return s.select("source", "n", F.round("short", 9).alias("short"), F.when(F.col("short") > 0.6, "fail").when(F.col("short") > 0.3, "warn").otherwise("pass").alias("gate"))


def failure_delays(spark: SparkSession, d: str) -> DataFrame:
    """Retry delays of failed orders by the number of failures before."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("failures"))
    return o.select("o_custkey", "failures", operations.retry_delay(F.col("failures").cast("double")).alias("delay"))


QUERIES = {f.__name__: f for f in (entities_by_id, edges_between, entity_connections, cascades, resolved_links, note_links, name_mentions, message_threads, response_times, chunk_titles, chunk_pages, chunk_sizes, recurring_fourgrams, recurring_fivegrams, pattern_variants, consent_checks, off_hours_activity, community_bridges, quality_trends, insight_ranking, type_changes, document_violations, starved_users, source_resources, complexity_distribution, aggregation_fusion, approximate_aggregates, metadata_json, similar_recent, combined_vectors, file_classes, quality_gates, failure_delays)}

SQL = {
    "entities_by_id": "SELECT u AS c_custkey, c_name, c_name IS NOT NULL AS found FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN customer ON c_custkey = u",
    "edges_between": "SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 25 JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 12 GROUP BY 1, 2",
    "entity_connections": f"""WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), p AS (SELECT e.id AS start, dst AS node, 1 AS hops FROM e JOIN b ON b.src = e.id WHERE type = 'signup' UNION SELECT start, b.dst, hops + 1 FROM p JOIN b ON b.src = p.node WHERE hops < 3)
        SELECT start, node AS "end", min(hops)::INTEGER AS hops FROM p JOIN e ON e.id = node AND e.type = 'purchase' WHERE start != node GROUP BY 1, 2""",
    "cascades": f"""WITH RECURSIVE {EDGES}, p AS (SELECT src AS start, dst AS "end", 1 AS hops, confidence AS c FROM g JOIN e ON e.id = src AND e.type = 'error' UNION ALL SELECT start, g.dst, hops + 1, c * g.confidence FROM p JOIN g ON g.src = p."end" WHERE hops < 4)
        SELECT start, "end", hops::INTEGER AS hops, round(c, 6) AS score FROM p WHERE hops >= 2 AND c >= 0.4""",
    "resolved_links": "WITH n AS (SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, n_nationkey AS id, n_nationkey FROM nation) SELECT s_suppkey::VARCHAR AS src, name, id FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey::VARCHAR, 'Atlantis', NULL FROM supplier",
    "note_links": "SELECT s_suppkey::VARCHAR AS src, 'n' || s_nationkey AS dst, 'links_to' AS rel FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'tag/' || s_nationkey, 'tagged' FROM supplier UNION ALL SELECT 'n' || s_nationkey, s_suppkey::VARCHAR, 'linked_from' FROM supplier",
    "name_mentions": "WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT unnest(['Ring', 'bolt', 'WIDGET', 'red', 'blue']) AS name) SELECT name, count(DISTINCT p_partkey) AS parts, count(*)::BIGINT AS n FROM w JOIN n ON w = lower(name) GROUP BY 1",
    "message_threads": "WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + CASE WHEN turn % 3 = 2 THEN 0 ELSE turn - 1 END AS parent, turn FROM conversations), r AS (SELECT id, id AS root, 0 AS depth FROM m WHERE turn = 0 UNION ALL SELECT m.id, root, depth + 1 FROM r JOIN m ON m.parent = r.id AND m.turn > 0) SELECT id, root, depth FROM r",
    "response_times": f"WITH e AS ({E}), g AS (SELECT entity, t, (t - lag(t) OVER (PARTITION BY entity ORDER BY t, id)) / 6e7 AS g FROM e) SELECT entity, round((max(t) - min(t)) / 86400000000.0, 6) AS span, round(avg(g) FILTER (g > 0), 6) AS minutes FROM g GROUP BY 1",
    "chunk_titles": """WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, role, length(trim(replace(text, '#', ''), ' ')) AS n FROM conversations)
        SELECT doc_id, 1::BIGINT AS chunk, 'Conversation' AS title, 'Conversation' AS path, 6 AS size FROM c UNION ALL SELECT doc_id, 3, 'Text', 'Conversation > ' || role || ' > Text', n FROM c WHERE n > 0 UNION ALL SELECT doc_id, 4, 'End', 'Conversation > End', 5 FROM c""",
    "chunk_pages": "SELECT conv_id, turn // 2 AS page, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2",
    "chunk_sizes": """WITH p AS (SELECT conv_id, turn, k, substr(text, k * 1000 + 1, 1000) AS s FROM (SELECT *, unnest(range(0, (length(text) + 999) // 1000)) AS k FROM conversations WHERE length(trim(text, ' ')) > 0)),
        r AS (SELECT *, length(s) < 200 AS short, sum((length(s) >= 200)::INT) OVER (PARTITION BY conv_id ORDER BY turn, k) AS longs, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS i FROM p),
        g AS (SELECT conv_id, min(i) AS i, string_agg(s, chr(10) || chr(10) ORDER BY i) AS content FROM r GROUP BY conv_id, CASE WHEN short THEN -longs - 1 ELSE i END)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i)::INTEGER - 1 AS chunk, length(content) AS size, md5(content) AS digest FROM g""",
    "recurring_fourgrams": ngram_sql(4),
    "recurring_fivegrams": ngram_sql(5),
    "pattern_variants": f"WITH s AS ({ngram_sql(2)}), l AS ({ngram_sql(3)}) SELECT s.pattern AS short, l.pattern AS long FROM s JOIN l ON string_split(l.pattern, '>')[1] || '>' || string_split(l.pattern, '>')[2] = s.pattern OR string_split(l.pattern, '>')[2] || '>' || string_split(l.pattern, '>')[3] = s.pattern OR string_split(l.pattern, '>')[1] || '>' || string_split(l.pattern, '>')[3] = s.pattern",
    "consent_checks": f"""WITH e AS ({E}), m AS (SELECT p.id, p.t, max(c.t) AS last FROM e p LEFT JOIN e c ON c.entity = p.entity AND c.t <= p.t AND c.type IN ('signup', 'error') WHERE p.type = 'purchase' GROUP BY 1, 2),
        r AS (SELECT m.id, m.t, last, bool_or(c.type = 'error') AS refused FROM m LEFT JOIN e p ON p.id = m.id LEFT JOIN e c ON c.entity = p.entity AND c.t = last AND c.type IN ('signup', 'error') GROUP BY 1, 2, 3) SELECT id, coalesce(NOT refused AND t - last <= 604800000000, false) AS active FROM r""",
    "off_hours_activity": "SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6 GROUP BY 1, 2 HAVING count(*) >= 3",
    "community_bridges": """WITH m AS (SELECT 'c' || c_custkey AS id, c_nationkey AS c FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier), x AS (SELECT a.c AS ca, b.c AS cb FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN m a ON a.id = 'c' || o_custkey JOIN m b ON b.id = 's' || l_suppkey),
        z AS (SELECT c, count(*) AS n FROM m GROUP BY 1), p AS (SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS links FROM x WHERE ca != cb GROUP BY 1, 2) SELECT a, b, links, round(least(x.n, y.n) / (least(x.n, y.n) + links), 9) AS gain FROM p JOIN z x ON x.c = a JOIN z y ON y.c = b WHERE links <= 100000""",
    "quality_trends": f"WITH e AS ({E}), q AS (SELECT entity, count(*) AS n, arg_max(value / 100, (t, id)) - arg_min(value / 100, (t, id)) AS c FROM e WHERE value IS NOT NULL GROUP BY 1) SELECT entity, n, round(c, 6) AS change, CASE WHEN c > .05 THEN 'improving' WHEN c < -.05 THEN 'degrading' ELSE 'stable' END AS trend FROM q",
    "insight_ranking": """WITH p AS (SELECT event_type AS type, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE -0.5 END) AS f FROM events GROUP BY 1)
        SELECT event_id AS id, round(least(1.0, greatest(0.0, 0.3 * (event_id % 10) / 10 + 0.25 * (event_id % 7) / 7 + 0.2 * (f + 1) / 2 + 0.15 * greatest(0.0, 1 - (event_id % 90) / 30 * 0.5) + 0.1 * (event_id % 4) / 4)), 9) AS score, (event_id % 10) / 10.0 >= CASE WHEN f < -.5 THEN .8 WHEN f > .5 THEN .4 ELSE .5 END AS shown FROM events JOIN p ON type = event_type""",
    "type_changes": "WITH k AS (SELECT user_id || ':' || event_type AS kind, bool_or(ts >= TIMESTAMP '2024-01-26') AS a, bool_or(ts < TIMESTAMP '2024-01-26') AS b FROM events GROUP BY 1) SELECT kind, CASE WHEN a THEN 'added' ELSE 'removed' END AS change FROM k WHERE a != b",
    "document_violations": "WITH d AS (SELECT count(*) FILTER (NOT coalesce(length(text) > 0, false)) AS a, count(*) FILTER (NOT coalesce(n_chars = length(text), false)) AS b, count(*) FILTER (NOT coalesce(strlen(text) <= 51200, false)) AS c, count(*) FILTER (source IS NULL) AS e, count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr'), false)) AS f FROM documents) SELECT 'has_text' AS rule, a AS n FROM d UNION ALL SELECT 'length_agrees', b FROM d UNION ALL SELECT 'at_most_50_kb', c FROM d UNION ALL SELECT 'has_source', e FROM d UNION ALL SELECT 'known_language', f FROM d",
    "starved_users": "WITH u AS (SELECT user_id AS entity, count(*) AS n FROM events GROUP BY 1) SELECT * FROM u WHERE n < 0.8 * (SELECT avg(n) FROM u)",
    "source_resources": "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean, max(n_chars) AS largest FROM documents GROUP BY 1",
    "complexity_distribution": "SELECT CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "aggregation_fusion": "SELECT user_id AS entity, count(*) AS n, array_to_string(list_sort(list_distinct(list(floor(value)::BIGINT))), ',') AS all_values FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1",
    "approximate_aggregates": "SELECT event_type AS type, count(DISTINCT user_id) AS exact_distinct, true AS within FROM events GROUP BY 1",
    "metadata_json": "SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'none') AS source, 'nobody' AS owner, n_chars FROM documents",
    "similar_recent": f"WITH {KNN}, r AS (SELECT query_id, id, cos, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 12) DESC, id)::INTEGER AS rank FROM s WHERE id IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 12:00:00')) SELECT query_id, id, rank, round(cos, 6) AS score FROM r WHERE rank <= 5",
    "combined_vectors": "WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, 160 AS size, round(sqrt(5 * list_dot_product(v, v)), 6) AS norm, round(sqrt(list_dot_product(v, v) + 4 * list_dot_product(v[1:32], v[1:32])), 6) AS cut FROM x",
    "file_classes": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'rust' ELSE 'unknown' END AS language FROM part",
    "quality_gates": "WITH s AS (SELECT source, count(*) AS n, avg((length(text) < 1000)::INT) AS x FROM documents GROUP BY 1) SELECT source, n, round(x, 9) AS short, CASE WHEN x > .6 THEN 'fail' WHEN x > .3 THEN 'warn' ELSE 'pass' END AS gate FROM s",
    "failure_delays": "SELECT o_custkey, count(*) AS failures, least(300.0, pow(2, count(*)))::DOUBLE AS delay FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
}
