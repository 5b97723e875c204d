"""Readers of the model's tables, and sinks. Sources are Parquet tables unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone (UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def event_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, entity, type, ts, t, value): t in microseconds."""
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("type"), "ts", micros("ts").alias("t"), "value")


def causal_edges(spark: SparkSession, folder: str, max_gap_s: int = 3600) -> DataFrame:
    """(src, dst, rel, confidence, t_src, t_dst): consecutive events of one entity not further apart than max_gap_s."""
    from pyspark.sql import Window as W

    w = W.partitionBy("entity").orderBy("t", "id")
    e = event_nodes(spark, folder).select("entity", F.col("id").alias("src"), F.col("t").alias("t_src"), F.lead("id").over(w).alias("dst"), F.lead("t").over(w).alias("t_dst"), F.col("type").alias("src_type"), F.lead("type").over(w).alias("dst_type"))
    gap = F.col("t_dst") - F.col("t_src")
    rel = F.when(gap % 3 == 0, "CAUSES").when(gap % 3 == 1, "ENABLES").otherwise("TRIGGERS")
    return e.where((gap > 0) & (gap <= max_gap_s * 1_000_000)).select("src", "dst", rel.alias("rel"), F.round(1.0 - gap / (2.0 * max_gap_s * 1_000_000), 6).alias("confidence"), "t_src", "t_dst", "src_type", "dst_type", "entity")


def knowledge_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, rel, valid_from): typed ids; customers placed orders, orders contain parts, parts come from suppliers."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    placed = o.select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("rel"), F.col("o_orderdate").alias("valid_from"))
    contains = li.select(name("order", "l_orderkey").alias("src"), name("part", "l_partkey").alias("dst"), F.lit("CONTAINS").alias("rel"), F.col("l_shipdate").alias("valid_from"))
    supplied = li.select(name("part", "l_partkey").alias("src"), name("supplier", "l_suppkey").alias("dst"), F.lit("SUPPLIED_BY").alias("rel"), F.col("l_shipdate").alias("valid_from"))
    return placed.unionByName(contains).unionByName(supplied)


def text_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, modified, length, content, format) of local or remote files, for incremental scans by content hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("content"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A snapshot, one folder per value of `by`; rows of a value are dealt over tasks, so a hot one is several files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key; of columns that new leaves null the old value stays."""
    a, b = old.alias("a"), new.alias("b")
    columns = [F.coalesce(F.col(f"b.`{c}`"), F.col(f"a.`{c}`")).alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "full_outer").select(*columns)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key it hasn't; of equal new keys one stays."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def cascade_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, node_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the ids in `gone` and the edges that touch them."""
    ids = gone.select(F.col(node_id).alias("__gone")).distinct()
    rest = edges.join(ids, F.col("src") == F.col("__gone"), "left_anti").join(ids, F.col("dst") == F.col("__gone"), "left_anti")
    return nodes.join(ids, F.col(node_id) == F.col("__gone"), "left_anti"), rest
