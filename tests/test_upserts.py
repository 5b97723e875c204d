from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemion.operators.operations import volume_spikes as batch_spikes
from mnemion.sources.staging import setting
from mnemion.streaming import baselines, upserts

SCHEMA = "entity_id long, seq long, op string, entity_type string, name string, description string, timestamp string, event_type string, title string, content string"


def embed(c):
    return F.array(F.length(c).cast("double"), F.crc32(c.cast("binary")).cast("double"))


def literal(changes):
    """Latest row of each entity by seq; deleted and empty ones as they come."""
    out = {}
    for c in sorted(changes, key=lambda c: c[1]):
        i, seq, op, kind, *data = c
        if op == "deleted":
            out[i] = None
        elif op in ("created", "updated") and any(x is not None for x in data) and not (kind == "Event" and data[2] is None):
            name, description, _, event_type, title, content = data
            parts = [x for x in (name, description, title if title != name else None, content) if x] + ([f"[{event_type}]"] if kind == "Event" and event_type else [])
            out[i] = (seq, kind, *data, ": ".join(parts) if "".join(parts).strip() else f"{kind} entity")
    return {i: v for i, v in out.items() if v}


def some_changes(n=120, seed=6):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "ann", "bob", "a long one"])
    return [(rng.randrange(25), k, rng.choice(["created", "updated", "updated", "deleted", "relationship_created"]), rng.choice(["Person", "Event", "Document"]), word(), word(), rng.choice([None, "2024-01-01"]), word(), word(), word()) for k in range(n)]


def stored(spark, path):
    rows = upserts.read_table(spark, path).withColumn("text", upserts.content()).withColumn("want", embed(F.col("text"))).collect()
    assert all(r.vector == r.want for r in rows)
    return {r.entity_id: (r.seq, r.entity_type, *[r[c] for c in upserts.SIGNIFICANT], r.text) for r in rows}


def test_batches_in_any_order_and_again_give_one_result(spark, tmp_path):
    changes = some_changes()
    parts = [changes[k : k + 30] for k in range(0, 120, 30)]
    for turn, order in enumerate(([0, 1, 2, 3], [2, 0, 3, 1])):
        path = str(tmp_path / str(turn))
        sink = upserts.upsert_sink(path, embed, buckets=8)
        for version, k in enumerate(order):
            sink(spark.createDataFrame(parts[k], SCHEMA), version)
            sink(spark.createDataFrame(parts[k], SCHEMA), version)
        assert stored(spark, path) == literal(changes)
        found = {(r.version, r.route): r.n for r in upserts.routes(spark, path).collect()}
        assert sum(found.values()) == len(changes) and sum(n for (_, r), n in found.items() if r == "ignored") == sum(c[2].startswith("rel") for c in changes)
        before = stored(spark, path)
        assert upserts.vacuum(spark, path) >= 0 and stored(spark, path) == before


def test_insignificant_updates_keep_the_vector_and_small_batches_write_little(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = upserts.upsert_sink(path, embed, buckets=8)
    row = lambda i, seq, op, name: (i, seq, op, "Person", name, None, None, None, None, None)
    sink(spark.createDataFrame([row(i, 1, "created", f"n{i}") for i in range(200)], SCHEMA), 0)
    sink(spark.createDataFrame([row(7, 2, "updated", "n7"), row(7, 3, "relationship_updated", "x")], SCHEMA), 1)
    first = {r.entity_id: r for r in upserts.read_table(spark, path).collect()}
    assert (first[7].seq, first[7].embedded_seq) == (2, 1) and len(first) == 200
    assert len(list((tmp_path / "t" / "data" / "version=1").glob("bucket=*"))) == 1
    sink(spark.createDataFrame([row(7, 4, "updated", "other"), row(8, 1, "deleted", None), row(9, 5, "deleted", None)], SCHEMA), 2)
    now = {r.entity_id: r for r in upserts.read_table(spark, path).collect()}
    assert now[7].embedded_seq == 4 and 8 in now and 9 not in now
    sink(spark.createDataFrame([row(9, 4, "updated", "late")], SCHEMA), 3)
    sink(spark.createDataFrame([], SCHEMA), 4)
    assert 9 not in {r.entity_id for r in upserts.read_table(spark, path).collect()}
    sink(spark.createDataFrame([row(9, 6, "created", "again")], SCHEMA), 5)
    back = {r.entity_id: r for r in upserts.read_table(spark, path).collect()}[9]
    assert (back.seq, back.embedded_seq, back.deleted) == (6, 6, False)


def test_stream_of_changes(spark, tmp_path):
    changes = some_changes(90, 8)
    for k in range(3):
        spark.createDataFrame(changes[k * 30 : k * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(upserts.upsert_sink(str(tmp_path / "t"), embed, 8)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and stored(spark, str(tmp_path / "t")) == literal(changes)


@pytest.mark.parametrize("files", [1, 5])
def test_moving_baseline_equals_the_batch(spark, tmp_path, files):
    rng = random.Random(3)
    rows = [(k, f"2024-01-{1 + k // 8:02} {rng.randrange(24):02}:30:00", rng.choice([1, 2, 3]), rng.choice([1.0, 2.0, 1.0, 40.0])) for k in range(200)]
    rows += [(500, "2024-03-01 00:00:00", 9, 0.0)]  # closes every window before it
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    days = df.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("volume"))
    want = {(r.user_id, str(r.day), round(r.volume, 6), round(r.baseline, 6), r.samples) for r in batch_spikes(days, "user_id", "day", "volume").collect()}
    step = -(-len(rows) // files)
    for k in range(files):
        df.where((F.col("event_id") >= k * step) & (F.col("event_id") < (k + 1) * step) | ((F.col("event_id") == 500) & F.lit(k == files - 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with setting(spark, *baselines.PROVIDER):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = baselines.volume_spikes(stream, "user_id", late="1 day").writeStream.format("memory").queryName(f"spikes{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = {(r.key, str(r.start)[:10], round(r.volume, 6), round(r.baseline, 6), r.samples) for r in spark.table(f"spikes{files}").collect()}
    assert got == want and want
