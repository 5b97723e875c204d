"""Audit of how filters overlap: every order in which five filters may run is replayed over the documents' flags.

A document's flags are made once, next to its text; from then on rows are a few bytes. Each row meets the 120 orders, which
are broadcast, takes their five steps, finds its first failure in the order, and is counted under (part, order, step). The
counts are combined in each task before anything is shuffled, so a part with most of the rows sends 600 rows a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.llm.common import salt, stage

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SALTS = 64  # of the rows of one text
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone: few words, repeated words, many capitals, signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals > 10 * F.length(text), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(__id, __part, A to E, __salt) of the rows of docs; E: a row of a smaller id has the same text.

    Texts are the same if their 256-bit digests are. A row without an id copies nothing and is nobody's original.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("__part"), text.alias("__text"))
    own = [c.alias(k) for k, c in own_failures(F.col("__text")).items()]
    rows = rows.select("__id", "__part", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("__sha"), *own)
    rows = stage(rows.withColumn("__salt", salt(F.struct("__id", "__part"), SALTS)), "audit-flags")
    # The least id of a text, by text and salt first and joined back by both, so the copies of one text are many tasks.
    part = rows.where("__id is not null").groupBy("__sha", "__salt").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"))
    whole = part.groupBy("__sha").agg(F.min("lo").alias("__least"), F.max("hi").alias("hi"), F.collect_list("__salt").alias("salts"))
    copied = whole.where("__least < hi").select("__sha", "__least", F.explode("salts").alias("__salt"))
    copy = F.coalesce(F.col("__id") > F.col("__least"), F.lit(False))
    return rows.join(copied, ["__sha", "__salt"], "left").select("__id", "__part", *"ABCD", copy.alias("E"), "__salt")


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic: does any label of their id say so? Rows without an id have none, and are spread over tasks."""
    named = labels.select(F.col(id_col).cast("long").alias("__id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("__id is not null")
    named = named.groupBy("__id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    spread = rows.withColumn("__salt", F.when(F.col("__id").isNull(), F.col("__salt")).otherwise(-1))
    found = spread.join(named.withColumn("__salt", F.lit(-1)), ["__id", "__salt"], "left")
    return found.select("__part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(rows: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts but for shapley) of rows (__part, A to E, good, toxic), by first failure in each order."""
    spark = rows.sparkSession
    orders = spark.createDataFrame([(i, list(p)) for i, p in enumerate(permutations(range(1, 1 + len(FILTERS))))], "nr int, seats array<int>")
    fails = rows.select("__part", F.array(*FILTERS).alias("fails"), sum(F.col(f).cast("int") for f in FILTERS).alias("n"), "good", "toxic")
    met = fails.crossJoin(F.broadcast(orders))
    step = lambda k: F.element_at("fails", F.element_at("seats", k))
    first = F.lit(len(FILTERS) + 1)
    for k in range(len(FILTERS), 0, -1):
        first = F.when(step(k), k).otherwise(first)
    steps = met.select("__part", "nr", "fails", "seats", "n", "good", "toxic", first.alias("first"), F.explode(F.array(*[F.lit(k) for k in range(1, 1 + len(FILTERS))])).alias("step"))
    here, own = F.col("first") == F.col("step"), F.element_at("fails", F.element_at("seats", F.col("step")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return steps.groupBy(F.col("__part").alias("part"), "nr", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"), count(here).alias("removed"), count(own & (F.col("first") < F.col("step"))).alias("redundant"),
        count(own & (F.col("n") == 1)).alias("unique_fails"), count(here & F.col("good")).alias("good_lost"), count(here & F.col("toxic")).alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts and parts count as empty, and an empty text fails A only (and E, where a smaller id's is empty too). Each row
    counts, repeated ones too; rows that repeat an id are no copies of one another. A row without an id has no labels and
    takes no part in E. Of labels that repeat an id one is enough. Very long texts are split in one row. An empty table
    gives an empty result; columns besides id, text and part (doc_id, quality and toxic of labels) are left aside.
    """
    replayed = replay(labelled(failures(docs, id_col, text_col, part_col), labels))
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(permutations(FILTERS))], "nr int, filter_order string")
    # At most 600 rows a part from here on.
    table = replayed.join(F.broadcast(names), "nr").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    table = table.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))
    return table.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def oracle() -> str:
    """DuckDB SQL of the audit over documents and labels."""
    seats = ", ".join(f"substr(o, {k}, 1)" for k in range(1, 6))
    return f"""
        WITH letters AS (SELECT unnest(['A','B','C','D','E']) AS l),
        orders AS (SELECT a.l||b.l||c.l||d.l||e.l AS o FROM letters a, letters b, letters c, letters d, letters e
          WHERE a.l NOT IN (b.l,c.l,d.l,e.l) AND b.l NOT IN (c.l,d.l,e.l) AND c.l NOT IN (d.l,e.l) AND d.l != e.l),
        x AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != '') AS ws FROM documents),
        f AS (SELECT x.*, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
            || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM x),
        m AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
        g AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN m USING (doc_id)),
        r AS (SELECT part, fails, good, toxic, o AS filter_order, list_position(list_transform([{seats}], lambda s: contains(fails, s)), true) AS first FROM g, orders),
        s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, fails, good, toxic, coalesce(nullif(first, 0), 6) AS first FROM r, (SELECT unnest([1,2,3,4,5])::INT AS step)),
        c AS (SELECT part, filter_order, step, filter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (contains(fails, filter) AND first < step) AS redundant,
            count(*) FILTER (fails = filter) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM c"""
