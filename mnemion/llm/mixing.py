"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a target rate of repetition: its target share of the mixture over its share of the rows. A row's number of
copies is drawn from the Poisson distribution with that mean by inverting it at a uniform number hashed from the seed and
the row's id, so it does not depend on partitions, order or retries. Whole rows are exploded by their count and dealt out by a
hash of (seed, id, copy), then sorted by it inside each partition: a global shuffle in one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.llm.common import packed, stage

SEED = 20260
TEMPERATURE = 0.5
NONE = "\x00none"  # stands for a null source


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of a digest of the parts, as any SQL engine can compute it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """(source, n, rate, cdf): rows, target repetition rate and cumulative Poisson probabilities of each source.

    weights are target shares by source (sources not named get none); without them a source's share is its number of rows
    to the power `temperature`. `total` is the mixture's expected rows, by default as many as there are.
    """
    n = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)).alias("__source")).agg(F.count("*").cast("double").alias("__n"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k if k is not None else NONE, float(v)) for k, v in weights.items()], "__source string, __w double")
        n = n.join(given, "__source", "left").fillna(0.0, ["__w"])
    else:
        n = n.withColumn("__w", F.pow("__n", F.lit(float(temperature))))
    n = stage(n, "source-counts")
    all_w, all_n = n.agg(F.coalesce(F.sum("__w"), F.lit(0.0)), F.coalesce(F.sum("__n"), F.lit(0.0))).first()
    wanted = float(total) if total is not None else all_n
    rate = n.withColumn("__rate", F.lit(wanted) * F.col("__w") / F.lit(all_w or 1.0) / F.col("__n"))
    # Terms far beyond the mean that no 48-bit uniform number reaches are left off; the last count takes what is left.
    last = F.ceil(F.col("__rate") + 12 * F.sqrt("__rate") + 40).cast("int")
    terms = rate.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    w = W.partitionBy("__source", "__n", "__rate").orderBy("k")  # as many rows as the source's rate and a little more
    logf = F.sum(F.when(F.col("k") > 0, F.ln(F.greatest("k", F.lit(1)).cast("double"))).otherwise(0.0)).over(w)
    terms = terms.withColumn("logf", logf).withColumn("p", F.when(F.col("__rate") > 0, F.exp(F.col("k") * F.ln(F.col("__rate")) - F.col("__rate") - F.col("logf"))).otherwise((F.col("k") == 0).cast("double")))
    terms = terms.withColumn("c", F.sum("p").over(w))
    return terms.groupBy("__source", "__n", "__rate").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("t")).select("__source", "__n", "__rate", F.col("t.c").alias("__cdf"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows (__row, __id, __source) with __key, which tells rows apart that have no id: by their content, and equal ones by a number."""
    named = rows.where("__id is not null").select("*", F.col("__id").alias("__key"))
    others = rows.where("__id is null").groupBy(F.sha2(F.to_json("__row"), 256).alias("digest")).agg(F.first("__row").alias("__row"), F.first("__source").alias("__source"), F.count("*").alias("n"))
    others = others.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return named.unionByName(others.select("__row", F.lit(None).cast("string").alias("__id"), "__source", F.concat_ws("#", "digest", "i").alias("__key")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: int = SEED) -> DataFrame:
    """docs with each row repeated by its count and shuffled; `copy` (from 1), `copies`, `rate` and `shuffle_key` are added.

    Rows with a null source are a source of their own. Repeated rows with the same id get the same count, as the draw is by
    id; rows without an id each have a draw of their own. All columns are kept, whatever their names: an added column whose
    name is taken gets underscores. Whole texts travel as they are. An empty table gives an empty result.
    """
    added = {}
    for name in ("copy", "copies", "rate", "shuffle_key"):
        added[name] = name
        while added[name].lower() in [c.lower() for c in docs.columns]:
            added[name] += "_"
    by_source = stage(rates(docs, source_col, weights, temperature, total), "rates")  # its size is then known to the planner
    rows = docs.select(packed(docs).alias("__row"), F.col(f"`{id_col}`").cast("string").alias("__id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)).alias("__source"))
    drawn = _told_apart(rows).withColumn("__u", uniform(seed, F.col("__key"))).join(by_source, "__source")
    copies = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    copied = drawn.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    keyed = copied.select("__row", "__copy", "__copies", "__rate", uniform(seed + 1, F.col("__key"), F.col("__copy")).alias("__shuffle"))
    out = keyed.repartition("__shuffle").sortWithinPartitions("__shuffle")
    return out.select("__row.*", F.col("__copy").cast("int").alias(added["copy"]), F.col("__copies").cast("int").alias(added["copies"]), F.col("__rate").alias(added["rate"]), F.col("__shuffle").alias(added["shuffle_key"]))


def oracle(table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars, copy, copies, rate", seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The same in DuckDB, for default weights."""
    return f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '{NONE}') AS s, count(*)::DOUBLE AS n FROM {table} GROUP BY 1),
r AS (SELECT s, sum(n) OVER () * pow(n, {temperature}) / sum(pow(n, {temperature})) OVER () / n AS rate0 FROM n),
c AS (
  SELECT s, rate0, 0 AS k, 0.0::DOUBLE AS logf, exp(-rate0) AS cdf FROM r
  UNION ALL
  SELECT s, rate0, k + 1, logf + ln(k + 1), cdf + exp((k + 1) * ln(rate0) - rate0 - (logf + ln(k + 1))) FROM c WHERE k + 1 <= ceil(rate0 + 12 * sqrt(rate0) + 40)),
f AS (SELECT s, any_value(rate0) AS rate0, list(cdf ORDER BY k) AS cdf FROM c GROUP BY s),
d AS (
  SELECT t.*, f.rate0, len(list_filter(f.cdf, lambda x: x < (('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0))::INTEGER AS copies
  FROM {table} t JOIN f ON f.s = coalesce(t.source, '{NONE}')),
e AS (SELECT d.*, unnest(range(1, copies + 1))::INTEGER AS copy, round(rate0, 9) AS rate FROM d)
SELECT {columns} FROM e"""
