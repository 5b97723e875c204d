"""Linking of names, threads of messages, chunks by structure, consent, and reports on what a knowledge graph lacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.functions import text as t
from mnemion.sources.staging import discard, stage


def edges_between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from a node of a (id) to one of b (id)."""
    return edges.join(a.select(F.col("id").alias("src")), "src", "left_semi").join(b.select(F.col("id").alias("dst")), "dst", "left_semi")


def connections(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(start, end, hops): the least number of edges, walked either way, between starts (id) and ends (id), at most `most`.

    A level a hop; of several ways to a node from a start only the shortest goes on, so levels stay as small as the pairs reached.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    at = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen = at.withColumn("hops", F.lit(0))
    for hop in range(1, most + 1):
        step = at.join(both, at["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        at = stage(step.join(seen, ["start", "node"], "left_anti"), "reached")
        seen = seen.unionByName(at.withColumn("hops", F.lit(hop)))
    return seen.where("hops > 0").join(ends.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("start", F.col("node").alias("end"), "hops")


def resolved(links: DataFrame, names: DataFrame) -> DataFrame:
    """links (src, name) with the id that a name stands for in names (id, name), whatever its case; null where none does, the least of several."""
    keys = names.select(F.lower(F.trim("name")).alias("__key"), "id").groupBy("__key").agg(F.min("id").alias("id"))
    return links.withColumn("__key", F.lower(F.trim("name"))).join(keys, "__key", "left").drop("__key")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, n): how often each name (one word) is among the words of texts (id, text): an equi-join by word."""
    found = texts.select("id", F.explode(t.words(F.col("text"))).alias("__word")).groupBy("id", "__word").agg(F.count("*").alias("n"))
    keys = names.select("name", F.lower("name").alias("__word")).distinct()
    return found.join(keys, "__word").select("id", "name", "n")


def threads(messages: DataFrame) -> DataFrame:
    """(id, root, depth) of messages (id, parent): the message that a thread began with, and the number of replies from it.

    A parent that is not there, is null or is the message itself makes a root. Pointers are doubled, so a chain of n replies
    takes log n joins; what is in a circle has no root and is left out.
    """
    there = messages.select(F.col("id").alias("parent")).distinct()
    known = messages.select("id", "parent").join(there.withColumn("__there", F.lit(True)), "parent", "left")
    up = F.when(F.col("__there") & (F.col("parent") != F.col("id")), F.col("parent")).otherwise(F.col("id"))
    at = stage(known.select("id", up.alias("to")).groupBy("id").agg(F.min("to").alias("to")).withColumn("depth", (F.col("id") != F.col("to")).cast("int")), "threads")
    total = at.count()
    for _ in range(max(1, total.bit_length()) + 1):
        if at.join(at.where("id = to and depth = 0").select(F.col("id").alias("to")), "to", "left_anti").isEmpty():
            break  # all point to roots; what is in a circle, or replies to it, never does
        b = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("depth").alias("d2"))
        step = at.join(b, "to").select("id", F.col("to2").alias("to"), (F.col("depth") + F.when(F.col("id") != F.col("to"), F.col("d2")).otherwise(0)).cast("int").alias("depth"))
        last, at = at, stage(step, "threads")
        discard(last)
    return at.join(at.where("id = to and depth = 0").select(F.col("id").alias("to")), "to", "left_semi").select("id", F.col("to").alias("root"), "depth")


def by_title(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk, title, path, content) of markdown: the text under each heading, with the headings above it; text before any has none."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    heading = F.regexp_extract("s", r"^(#{1,6})\s+(.+)$", 1)
    lines = lines.withColumn("level", F.length(heading)).withColumn("head", F.trim(F.regexp_extract("s", r"^(#{1,6})\s+(.+)$", 2)))
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(W.partitionBy(id_col).orderBy("line")))
    parts = lines.groupBy(id_col, "section").agg(F.max("level").alias("level"), F.max("head").alias("title"), F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "s")))).alias("body"))
    # The heading above a level is the last one of it, unless a higher one came after.
    w = W.partitionBy(id_col).orderBy("section")
    above = [F.max(F.when(F.col("level") == k, F.struct("section", "title"))).over(w) for k in range(1, 7)]
    parts = parts.withColumn("above", F.array(*above)).withColumn("content", F.trim(F.array_join(F.col("body.s"), "\n")))
    kept = F.filter("above", lambda x, i: x.isNotNull() & (i < F.col("level")) & (x["section"] >= F.coalesce(F.array_max(F.transform(F.filter(F.slice("above", F.lit(1), i), lambda y: y.isNotNull()), lambda y: y["section"])), F.lit(0))))
    return parts.where("content != ''").select(id_col, F.col("section").alias("chunk"), "title", F.transform(kept, lambda x: x["title"]).alias("path"), "content")


def by_page(elements: DataFrame, id_col: str, page: str, order: str, text: str = "text") -> DataFrame:
    """(id, page, content): the texts of each page in order, joined by blank lines."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("s"))))
    return elements.where(F.col(text).isNotNull()).groupBy(id_col, page).agg(F.array_join(parts["s"], "\n\n").alias("content"))


def sized(chunks: DataFrame, least: int, most: int, id_col: str = "doc_id", order: str = "chunk", content: str = "content") -> DataFrame:
    """(id, chunk, content): blank chunks dropped, those above `most` characters split, runs of those below `least` joined."""
    rows = chunks.where(F.length(F.trim(content)) > 0).select(id_col, order, F.posexplode(t.chunks(F.col(content), most)).alias("piece", "s"))
    w = W.partitionBy(id_col).orderBy(order, "piece")
    rows = rows.withColumn("short", F.length("s") < least).withColumn("k", F.row_number().over(w)).withColumn("after", F.sum((~F.col("short")).cast("int")).over(w))
    # A run of short pieces lies between the same two long ones.
    group = F.when(F.col("short"), -F.col("after") - 1).otherwise(F.col("k"))
    joined = rows.groupBy(id_col, group.alias("g"), "short").agg(F.min("k").alias("k"), F.sort_array(F.collect_list(F.struct("k", "s"))).alias("all"))
    return joined.select(id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("k")) - 1).alias(order), F.array_join(F.col("all.s"), "\n\n").alias(content))


def consented(requests: DataFrame, log: DataFrame, valid_s: int) -> DataFrame:
    """requests (id, entity, t) with active: whether the last entry of log (entity, t, granted) before or at t grants, and not longer ago than valid_s.

    An as-of join: both are read in an entity's order of time, in frames that only grow.
    """
    both = log.select("entity", "t", F.lit(None).cast("long").alias("id"), F.struct("t", "granted").alias("last")).unionByName(requests.select("entity", "t", F.col("id").cast("long").alias("id"), F.lit(None).cast("struct<t:long,granted:boolean>").alias("last")))
    w = W.partitionBy("entity").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    # Of entries at one time a refusal holds.
    at = F.max(F.when(F.col("last").isNotNull(), F.struct(F.col("last.t").alias("t"), (~F.col("last.granted")).alias("refused")))).over(w)
    out = both.withColumn("at", at).where("id is not null")
    return out.select("id", "entity", "t", F.coalesce(~F.col("at.refused") & (F.col("t") - F.col("at.t") <= valid_s * 1_000_000), F.lit(False)).alias("active"))


def off_hours(events: DataFrame, by: str, start: int = 22, end: int = 6, least: int = 3) -> DataFrame:
    """(by, day, n): days with at least `least` events between the hours, the first and last of a night included."""
    hour = F.hour("ts")
    return events.where((hour >= start) | (hour < end)).groupBy(by, F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bridges(edges: DataFrame, membership: DataFrame, most: int) -> DataFrame:
    """(a, b, links, gain): pairs of communities with at most `most` links between them; gain falls with links and grows with sizes."""
    m = membership.select("id", "community")
    e = edges.select("src", "dst").join(m.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst").where("ca != cb")
    pairs = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("links")).where(F.col("links") <= most)
    sizes = m.groupBy("community").agg(F.count("*").alias("size"))
    pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return pairs.select("a", "b", "links", (F.least("na", "nb") / (F.least("na", "nb") + F.col("links"))).alias("gain"))


def quality_trend(history: DataFrame, by: str, order: str, value: str, margin: float = 0.05) -> DataFrame:
    """(by, n, change, trend): the last value less the first: improving, degrading or stable."""
    out = history.groupBy(by).agg(F.count("*").alias("n"), (F.max_by(value, order) - F.min_by(value, order)).alias("change"))
    return out.withColumn("trend", F.when(F.col("change") > margin, "improving").when(F.col("change") < -margin, "degrading").otherwise("stable"))


#: The weights of an insight's rank.
RANK_WEIGHTS = {"confidence": 0.30, "relevance": 0.25, "type_preference": 0.20, "recency": 0.15, "aspiration": 0.10}


def ranked_insights(insights: DataFrame, preferences: DataFrame) -> DataFrame:
    """insights (type, confidence, relevance, aspiration, age_days) with score and shown, by what users think of their type (type, preference from -1 to 1)."""
    rows = insights.join(preferences.select("type", "preference"), "type", "left").withColumn("preference", F.coalesce("preference", F.lit(0.0)))
    parts = {"confidence": F.col("confidence"), "relevance": F.col("relevance"), "type_preference": (F.col("preference") + 1) / 2, "recency": F.greatest(F.lit(0.0), 1 - F.col("age_days") / 30 * 0.5), "aspiration": F.col("aspiration")}
    score = sum(w * parts[k] for k, w in RANK_WEIGHTS.items())
    least = F.when(F.col("preference") < -0.5, 0.8).when(F.col("preference") > 0.5, 0.4).otherwise(0.5)
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).withColumn("shown", F.col("confidence") >= least)


def schema_changes(rows: DataFrame, kind: str, new: Column) -> DataFrame:
    """(kind, change): kinds that only the rows marked as new have (added), or only the others (removed)."""
    sides = rows.groupBy(kind).agg(F.bool_or(new).alias("after"), F.bool_or(~new).alias("before"))
    return sides.where("after != before").select(kind, F.when(F.col("after"), "added").otherwise("removed").alias("change"))


def violations(docs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of the rows that break each rule (true where it holds); rules nobody breaks are listed with 0."""
    sums = docs.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.*")


def starved(counts: DataFrame, by: str, value: str, share: float = 0.5) -> DataFrame:
    """(by, value): those with less than a share of the mean."""
    mean = counts.agg(F.avg(value).alias("mean"))  # one row
    return counts.join(F.broadcast(mean)).where(F.col(value) < share * F.col("mean")).select(by, value)


def subsequences(short: DataFrame, long: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(short, long): patterns (types joined by '>') whose types all are in a longer or equal one, in the same order.

    Each long pattern is taken apart into its ordered selections of as many types as a short one has, which are joined by
    equality: their number follows the patterns' length and not the number of patterns.
    """
    a = short.select(F.col(pattern).alias("short")).distinct()
    b = long.select(F.col(pattern).alias("long"), F.split(F.col(pattern), ">").alias("types")).distinct()
    found = None
    for n in sorted(r[0] for r in a.select(F.size(F.split("short", ">"))).distinct().collect()):  # a few lengths
        at = b.where(F.size("types") >= n).select("long", "types", F.lit(0).alias("k"), F.array().cast("array<string>").alias("some"))
        for i in range(n):  # the next type is further on, and leaves enough for those to come
            places = F.sequence(F.col("k") + 1, F.size("types") - (n - 1 - i))
            at = at.where(F.col("k") + 1 <= F.size("types") - (n - 1 - i)).select("long", "types", F.explode(places).alias("k"), "some")
            at = at.select("long", "types", "k", F.concat("some", F.array(F.element_at("types", F.col("k")))).alias("some"))
        met = at.select(F.array_join("some", ">").alias("short"), "long").distinct().join(a, "short")
        found = met if found is None else found.unionByName(met)
    return found if found is not None else a.join(b.select("long").limit(0))


def approximate(rows: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """(by, distinct, median, exact_distinct): sketched counts and medians beside the exact number, each from a pass of its own.

    Beside an exact distinct count in one aggregation, sketches would be kept for each key.
    """
    sketches = rows.groupBy(*by).agg(F.approx_count_distinct(key, 0.02).alias("distinct"), F.percentile_approx(value, 0.5, 10_000).alias("median"))
    exact = rows.select(*by, key).distinct().groupBy(*by).agg(F.count(key).alias("exact_distinct"))
    same = reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by))
    return sketches.alias("s").join(exact.alias("x"), same).select(*[F.col(f"s.{c}") for c in by], "distinct", "median", "exact_distinct")
