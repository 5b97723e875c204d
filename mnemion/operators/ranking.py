"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.sources.staging import stage


def global_rank(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in an order, which should be total.

    Rows are dealt out by ranges of the order and written down; a row's rank is its place in its range and the number of rows
    in the ranges before, of which there are as many as partitions.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))
    local = ranged.withColumn("__place", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return local.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def percentiles(rows: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, n, mean, p): exact percentiles of each group, with linear interpolation, by the places of its values in a global order."""
    known = rows.select(by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    ranked = global_rank(known, by, "__v", name="__rank")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.min("__rank").alias("__first"))
    at = ranked.join(sizes, by).withColumn("__at", F.col("__rank") - F.col("__first"))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = at.where(F.array_contains(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]), F.col("__at")))
    pick = lambda x: F.max(F.when(F.col("__at") == x.cast("long"), F.col("__v")))
    ends = [c for x in place for c in (pick(F.floor(x)), pick(F.ceil(x)))]
    out = wanted.groupBy(by, "n", "mean").agg(F.array(*ends).alias("__e"))
    p = [F.col("__e")[2 * i] + (x - F.floor(x)) * (F.col("__e")[2 * i + 1] - F.col("__e")[2 * i]) for i, x in enumerate(place)]
    return out.select(by, "n", "mean", F.array(*p).alias("p"))
