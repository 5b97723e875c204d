"""Threads of messages (message_id, in_reply_to, references, date, sender, subject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.operators.knowledge import threads
from mnemion.sources.staging import stage

#: Prefixes of replies, and what stands for a message that isn't there.
PREFIX = r"^((Re|RE|re|Fwd|FWD|fwd)(\[\d+\])?:\s*)+"
UNKNOWN, BEFORE_MINUTES = "unknown@unknown", 30


def plain_subject(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), PREFIX, ""))


def with_parents(messages: DataFrame) -> DataFrame:
    """messages, one row an id (the earliest), with parent: in_reply_to if it is there, else the last of references that is.

    Otherwise an in_reply_to that isn't there is adopted: it gets a row of its own, half an hour before its first reply and
    with that reply's subject, and all that reply to it are its children, so what a lost message held together stays so.
    """
    columns = ("message_id", "in_reply_to", "references", "date", "sender", "subject")
    rows = messages.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("date", "in_reply_to", "references", "sender", "subject")).alias("r")).select("message_id", "r.*").select(*columns)
    rows = stage(rows, "messages")
    named = F.concat(F.array("in_reply_to"), F.reverse(F.coalesce("references", F.array().cast("array<string>"))))
    asked = rows.select("message_id", F.posexplode(named).alias("rank", "candidate")).where("candidate is not null and candidate != message_id")
    found = asked.join(rows.select(F.col("message_id").alias("candidate")), "candidate", "left_semi").groupBy("message_id").agg(F.min(F.struct("rank", "candidate")).alias("b"))
    known = rows.join(found, "message_id", "left").withColumn("parent", F.coalesce("b.candidate", F.when(F.col("in_reply_to") != F.col("message_id"), F.col("in_reply_to")))).drop("b")
    known = stage(known.withColumn("placeholder", F.lit(False)), "parents")
    lost = known.where("parent is not null").join(rows.select(F.col("message_id").alias("parent")), "parent", "left_anti")
    first = lost.groupBy("parent").agg(F.min(F.struct("date", "message_id", "subject")).alias("f"))
    none = F.lit(None).cast("string")
    adopted = first.select(F.col("parent").alias("message_id"), none.alias("in_reply_to"), F.lit(None).cast("array<string>").alias("references"), (F.col("f.date") - F.expr(f"interval {BEFORE_MINUTES} minutes")).alias("date"), F.lit(UNKNOWN).alias("sender"), F.col("f.subject").alias("subject"), none.alias("parent"), F.lit(True).alias("placeholder"))
    return known.unionByName(adopted)


def placed(messages: DataFrame) -> DataFrame:
    """with_parents(messages) with thread (the id of its first message) and depth. What replies in a circle is in no thread and left out."""
    known = stage(with_parents(messages), "with-parents")
    at = threads(known.select(F.col("message_id").alias("id"), "parent")).select(F.col("id").alias("message_id"), F.col("root").alias("thread"), "depth")
    return stage(known.join(at, "message_id"), "placed")


def thread_table(messages: DataFrame) -> DataFrame:
    """(thread, subject, messages, participants, start, last, days, depth, branches, minutes_total, minutes_mean) of placed messages.

    Branches are messages with more than one reply; minutes are those from a message to its reply, where they are positive.
    """
    up = messages.select(F.col("message_id").alias("parent"), F.col("date").alias("parent_date"))
    children = messages.where("parent is not null").groupBy(F.col("parent").alias("message_id")).agg(F.count("*").alias("replies"))
    rows = messages.join(up, "parent", "left").join(children, "message_id", "left")
    minutes = (F.col("date").cast("double") - F.col("parent_date").cast("double")) / 60
    took = F.when(minutes > 0, minutes)
    root = F.max(F.when(F.col("depth") == 0, plain_subject(F.col("subject"))))
    out = rows.groupBy("thread").agg(
        root.alias("subject"), F.count("*").alias("messages"), F.count_distinct("sender").alias("participants"), F.min("date").alias("start"), F.max("date").alias("last"), F.max("depth").alias("depth"),
        F.count_if(F.col("replies") > 1).alias("branches"), F.sum(took).alias("minutes_total"), F.avg(took).alias("minutes_mean"),
    )
    return out.withColumn("days", (F.col("last").cast("double") - F.col("start").cast("double")) / 86400).select("thread", "subject", "messages", "participants", "start", "last", "days", "depth", "branches", "minutes_total", "minutes_mean")


def participants(messages: DataFrame) -> DataFrame:
    """(thread, sender, role, messages, first, last) of placed messages; who wrote a thread's first message is its initiator."""
    rows = messages.groupBy("thread", "sender").agg(F.count("*").alias("messages"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("depth").alias("least"))
    return rows.select("thread", "sender", F.when(F.col("least") == 0, "initiator").otherwise("participant").alias("role"), "messages", "first", "last")
