"""Changes of entities routed to a keyed table that is rewritten by touched buckets only.

Changes are rows of (entity_id, seq, op, entity_type and the fields below). The table's layout in a folder:

    data/version=N/bucket=B   the rows of bucket B as batch N left them
    commits/version=N         (bucket, version) of every bucket written so far; a batch counts once its row is here
    routes/version=N          (route, n): what became of the batch's changes

A reader takes the last commit and the versions that it names. A batch writes the buckets that its keys fall into, so what it
writes follows the batch. The row of the greatest seq stays, deletions as marks, so batches in any order and batches played
again give one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields whose change asks for a new embedding, and the kinds of entity that need a time.
SIGNIFICANT = ("name", "description", "timestamp", "event_type", "title", "content")
TEMPORAL = ("Event",)
KEY, ORDER = "entity_id", "seq"


def content(entity_type: Column | None = None) -> Column:
    """The text that is embedded: name, description, title if it isn't the name, content, and the kind of an event."""
    kind = F.col("entity_type") if entity_type is None else entity_type
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.when(~F.col("title").eqNullSafe(F.col("name")), some("title"))
    event = F.when(kind == "Event", F.concat(F.lit("["), some("event_type"), F.lit("]")))
    text = F.concat_ws(": ", some("name"), some("description"), title, some("content"), event)
    return F.when(F.trim(text) == "", F.concat(kind, F.lit(" entity"))).otherwise(text)


def route(changes: DataFrame) -> DataFrame:
    """changes with route: upsert, delete, ignored (relations and others), empty (nothing given) or failed (an event without a time)."""
    given = F.coalesce(*[F.col(c).cast("string") for c in SIGNIFICANT]).isNotNull()
    timeless = F.col("entity_type").isin(*TEMPORAL) & F.col("timestamp").isNull()
    written = F.col("op").isin("created", "updated")
    return changes.withColumn("route", F.when(F.col(KEY).isNull() | F.col(ORDER).isNull(), "failed").when(F.col("op") == "deleted", "delete").when(written & ~given, "empty").when(written & F.coalesce(timeless, F.lit(False)), "failed").when(written, "upsert").otherwise("ignored"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _commit(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """Bucket -> version by the last commit (of a version less than `below`); there are as many rows as buckets."""
    if not _exists(spark, f"{path}/commits"):
        return {}
    commits = spark.read.parquet(f"{path}/commits")
    if below is not None:
        commits = commits.where(F.col("version") < below)
    last = commits.agg(F.max("version")).first()[0]
    return {} if last is None else {r.bucket: r.held for r in commits.where(F.col("version") == last).select("bucket", "held").collect() if r.bucket >= 0}


def _rows(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.parquet(*folders) if folders else None


def read_table(spark: SparkSession, path: str, deleted: bool = False) -> DataFrame | None:
    """The table as of the last commit; None before the first. Marks of deletions are left out unless asked for."""
    rows = _rows(spark, path, _commit(spark, path))
    return rows if rows is None or deleted else rows.where(~F.col("deleted"))


def upsert_sink(path: str, embed: Callable[[Column], Column], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of changes. `embed` makes a vector (array of doubles) of a text column.

    A row is embedded anew only if one of the significant fields differs from the stored row's, or there is none that lives;
    otherwise its vector and embedded_seq stay. Choose `buckets` so that one is a task's worth of rows at the expected size.
    """
    fields = (*SIGNIFICANT, "entity_type")

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{path}/commits/version={version}"):
            return  # played again
        routed = route(batch).persist()
        bucket = F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")
        counts = routed.groupBy("route").agg(F.count("*").alias("n"))
        new = routed.where(F.col("route").isin("upsert", "delete"))
        row = F.struct(ORDER, (F.col("route") == "delete").alias("deleted"), *[F.col(c).cast("string").alias(c) for c in fields])
        new = new.groupBy(KEY).agg(F.max(row).alias("r")).select(KEY, "r.*").withColumn("bucket", bucket)
        held = _commit(spark, path, version)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` at most
        old = _rows(spark, path, {b: held[b] for b in touched if b in held})
        if touched:
            merged = _merged(new, old, bucket, fields, embed)
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/routes/version={version}")
        held |= dict.fromkeys(touched, version)
        # The commit comes last; a batch without keys leaves a row of no bucket.
        commit = spark.createDataFrame(sorted(held.items()) or [(-1, version)], "bucket int, held long")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")
        routed.unpersist()

    return write


def _merged(new: DataFrame, old: DataFrame | None, bucket: Column, fields: tuple[str, ...], embed: Callable[[Column], Column]) -> DataFrame:
    """The rows of the touched buckets: of each key that of the greatest seq, the stored one of equals."""
    if old is None:
        kept = new.sparkSession.createDataFrame([], f"{KEY} {new.schema[KEY].dataType.simpleString()}, {ORDER} {new.schema[ORDER].dataType.simpleString()}, deleted boolean, vector array<double>, embedded_seq {new.schema[ORDER].dataType.simpleString()}, bucket int, " + ", ".join(f"`{c}` string" for c in fields))
    else:
        kept = old.withColumn("bucket", bucket)
    a, b = new.alias("a"), kept.alias("b")
    both = a.join(b, F.col(f"a.{KEY}") == F.col(f"b.{KEY}"), "full_outer")
    wins = F.col(f"b.{KEY}").isNull() | (F.col(f"a.{ORDER}") > F.col(f"b.{ORDER}"))
    wins = F.col(f"a.{KEY}").isNotNull() & wins
    same = F.lit(True)
    for c in (*SIGNIFICANT, "entity_type"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    anew = wins & ~F.col("a.deleted") & ~(F.coalesce(~F.col("b.deleted"), F.lit(False)) & same)
    pick = lambda c: F.when(wins, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    gone = wins & F.col("a.deleted")
    vector, since = F.when(~anew & ~gone, F.col("b.vector")).alias("kept_vector"), F.when(anew, F.col(f"a.{ORDER}")).when(~gone, F.col("b.embedded_seq")).alias("embedded_seq")
    rows = both.select(F.coalesce(f"a.{KEY}", f"b.{KEY}").alias(KEY), pick(ORDER), pick("deleted"), *[pick(c) for c in fields], pick("bucket"), anew.alias("anew"), vector, since)
    return rows.withColumn("vector", F.when(F.col("anew"), embed(content())).otherwise(F.col("kept_vector"))).drop("anew", "kept_vector")


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(version, route, n) of all batches."""
    return spark.read.parquet(f"{path}/routes").select("version", "route", "n")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the data of versions of which the last commit names no bucket; the number of folders deleted."""
    held, gone = set(_commit(spark, path).values()), 0
    if not _exists(spark, f"{path}/data"):
        return 0
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name[8:]) not in held:
            gone += bool(files.delete(status.getPath(), True))
    return gone
