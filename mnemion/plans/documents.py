"""Document queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.functions import text as t
from mnemion.operators import documents as op
from mnemion.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", op.content_hash(F.col("text")).alias("content_hash"), F.substring(op.content_hash(F.col("source")), 1, 16).alias("source_id"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return op.chunked(_docs(spark, d), 1000).select("doc_id", "chunk", F.length("content").cast("long").alias("size"), "chunk_hash")


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Packing is sequential; tests hold it against a literal loop."""
    docs = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return op.chunked(docs, 1500, packed=True).select("doc_id", "chunk", F.length("content").cast("long").alias("size"), "chunk_hash")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return op.enriched(_docs(spark, d)).select("doc_id", "content_hash", "chars", "words", "lines", "language", "kind")


def metadata_triples(spark: SparkSession, d: str) -> DataFrame:
    return op.triples(_docs(spark, d), {"lang": "has_language", "source": "from_source", "n_chars": "has_length"})


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _docs(spark, d).select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), op.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    old = rows.where("doc_id % 10 != 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    new = rows.where("doc_id % 11 != 0").select(F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "content_hash")
    return old, new


SNAPSHOTS = """r AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, doc_id FROM documents), o AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h FROM r WHERE doc_id % 10 != 0), n AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'moved/' || path ELSE path END AS path, h FROM r WHERE doc_id % 11 != 0)"""


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return op.changes(*_snapshots(spark, d))


def renames(spark: SparkSession, d: str) -> DataFrame:
    return op.renames(*_snapshots(spark, d))


def version_history(spark: SparkSession, d: str) -> DataFrame:
    """An order's status by line is taken as the content of a part's versions."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.concat_ws("|", F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber").alias("at"), F.concat("l_returnflag", "l_linestatus").alias("content"))
    return op.versions(rows, "part", "at", "content").select("part", "version", "content", "parent")


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), F.col("n_regionkey").alias("r"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # 25 nations
    return pairs.select("a", "b", F.round(op.similarity(F.col("x"), F.col("y"), F.lower("x"), F.concat(F.lower("x"), F.lit(" of region"))), 9).alias("likeness"))


def thread_statistics(spark: SparkSession, d: str) -> DataFrame:
    return op.thread_statistics(table(spark, d, "conversations"))


def subject_changes(spark: SparkSession, d: str) -> DataFrame:
    return op.subject_changes(table(spark, d, "conversations")).select("conv_id", "turn", F.round("likeness", 9).alias("likeness"), "change")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, "Re: Fwd:  ").when(F.col("turn") % 3 == 1, "RE: ").otherwise(""), F.substring("text", 1, 30)).alias("s"), "text")
    return rows.select("conv_id", "turn", t.subject(F.col("s")).alias("subject"))


def redacted(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(op.redacted(F.col("text")).cast("binary")).alias("digest"))


def complexity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(op.complexity(F.col("text")), 9).alias("complexity"))


def shared_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of languages that share a source, with the number of sources."""
    s = _docs(spark, d).select("lang", "source").distinct()
    return s.alias("a").join(s.alias("b"), "source").where("a.lang < b.lang").groupBy(F.col("a.lang").alias("a"), F.col("b.lang").alias("b")).agg(F.count("*").alias("n"))


def latest_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.desc("doc_id"))
    return _docs(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id", "r")


QUERIES = {f.__name__: f for f in (content_hashes, chunk_windows, chunk_paragraphs, enriched, metadata_triples, change_detection, renames, version_history, name_similarity, thread_statistics, subject_changes, subjects, redacted, complexity, shared_sources, latest_by_source)}

WORDS = "[\\p{L}\\p{N}_]+"
SQL = {
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash, sha256(source)[:16] AS source_id FROM documents",
    "chunk_windows": "WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS a FROM documents) SELECT doc_id, (a // 1000)::INTEGER AS chunk, length(substr(text, a + 1, 1000)) AS size, sha256(doc_id || ':' || a // 1000 || ':' || substr(text, a + 1, 1000)) AS chunk_hash FROM c",
    "enriched": f"""WITH h AS (SELECT *, text[:2000] AS head, length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS a, len(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda w: w IN ('the', 'and', 'of', 'to', 'in', 'is', 'that', 'for', 'with', 'as'))) AS c FROM documents)
        SELECT doc_id, sha256(text) AS content_hash, length(text) AS chars, len(regexp_extract_all(text, '{WORDS}')) AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, CASE WHEN a > 0.9 AND c > 5 THEN 'en' ELSE 'unknown' END AS language,
          CASE WHEN contains(head, 'def ') AND contains(head, 'import ') THEN 'python' WHEN contains(head, '```') THEN 'markdown_code' WHEN regexp_matches(head, '(?m)^#{{1,6}} ') THEN 'markdown' WHEN contains(head, ' | ') THEN 'table' ELSE 'text' END AS kind FROM h""",
    "metadata_triples": "SELECT DISTINCT 'document:' || doc_id AS subject, p AS predicate, o AS object FROM (SELECT doc_id, 'has_language' AS p, lang AS o FROM documents UNION ALL SELECT doc_id, 'from_source', source FROM documents UNION ALL SELECT doc_id, 'has_length', n_chars::VARCHAR FROM documents) WHERE o IS NOT NULL",
    "change_detection": f"WITH {SNAPSHOTS} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS change, o.h AS previous FROM n FULL JOIN o ON n.path = o.path",
    "renames": f"WITH {SNAPSHOTS}, g AS (SELECT h, min(path) AS previous FROM o WHERE path NOT IN (SELECT path FROM n) GROUP BY 1), c AS (SELECT h, min(path) AS path FROM n WHERE path NOT IN (SELECT path FROM o) GROUP BY 1) SELECT previous, path FROM g JOIN c USING (h)",
    "version_history": "WITH r AS (SELECT l_partkey AS part, strftime(l_shipdate, '%Y-%m-%d') || '|' || lpad(l_orderkey::VARCHAR, 12, '0') || '|' || l_linenumber AS pos, l_returnflag || l_linestatus AS content FROM lineitem), p AS (SELECT *, lag(content) OVER (PARTITION BY part ORDER BY pos) AS parent FROM r) SELECT part, row_number() OVER (PARTITION BY part ORDER BY pos)::INTEGER AS version, content, parent FROM p WHERE parent IS NULL OR parent != content",
    "name_similarity": """WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, lower(a.n_name) AS x, lower(b.n_name) AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
        s AS (SELECT *, list_distinct(string_split(x, '')) AS u, list_distinct(string_split(y, '')) AS v, list_distinct(regexp_extract_all(x, '[\\p{L}\\p{N}_]+')) AS w FROM p)
        SELECT a, b, round(0.4 * len(list_intersect(u, v)) / len(list_distinct(u || v)) + 0.6 * len(w) / len(list_distinct(w || ['of', 'region'])), 9) AS likeness FROM s""",
    "thread_statistics": "SELECT conv_id, count(*) AS size, count(DISTINCT role) AS participants, max(turn) AS depth, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
    "subject_changes": """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w),
        j AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(w || b)) > 0 THEN len(list_intersect(w, b)) / len(list_distinct(w || b)) ELSE 0 END AS j FROM p WHERE b IS NOT NULL) SELECT conv_id, turn, round(j, 9) AS likeness, CASE WHEN j > .7 THEN 'minor_edit' WHEN j > .3 THEN 'topic_shift' ELSE 'branch' END AS change FROM j""",
    "subjects": "SELECT conv_id, turn, trim(text[:30], ' ') AS subject FROM conversations",
    "redacted": "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+)', '[redacted]@\\1', 'g')) AS digest FROM documents",
    "complexity": """SELECT doc_id, round(0.25 * least(length(text) / 5000, 1) + 0.25 * least(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) / greatest(length(text) // 4, 1) * 1000 / 10, 1) + 0.30 * least(len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) / 10, 1) + 0.20 * least(len(regexp_extract_all(text, 'https?://|@')) / 5, 1), 9) AS complexity FROM documents""",
    "shared_sources": "WITH s AS (SELECT DISTINCT lang, source FROM documents) SELECT a.lang AS a, b.lang AS b, count(*) AS n FROM s a JOIN s b ON a.source = b.source AND a.lang < b.lang GROUP BY 1, 2",
    "latest_by_source": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INTEGER AS r FROM documents QUALIFY r <= 3",
}
