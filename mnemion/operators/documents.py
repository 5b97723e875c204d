"""Document processing: chunks, counts, classes, triples, versions, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.functions import text as t


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunked(docs: DataFrame, size: int, packed: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk, content, chunk_hash): fixed windows, or paragraphs packed up to a size; the hash is of id:index:content."""
    parts = t.packed(F.col(text), size) if packed else t.chunks(F.col(text), size)
    rows = docs.select(id_col, F.posexplode(parts).alias("chunk", "content"))
    return rows.withColumn("chunk_hash", content_hash(F.concat_ws(":", F.col(id_col).cast("string"), F.col("chunk").cast("string"), "content")))


def enriched(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with hash, characters, words, lines, language guess and content class."""
    c = F.col(text)
    ascii_share = F.length(F.regexp_replace(c, r"[^\x00-\x7f]", "")) / F.greatest(F.length(c), F.lit(1))
    common = F.size(F.filter(t.words(c), lambda w: w.isin("the", "and", "of", "to", "in", "is", "that", "for", "with", "as")))
    language = F.when((ascii_share > 0.9) & (common > 5), "en").otherwise("unknown")
    head = F.substring(c, 1, 2000)
    kind = F.when(head.contains("def ") & head.contains("import "), "python").when(head.contains("```"), "markdown_code").when(head.rlike(r"(?m)^#{1,6} "), "markdown").when(head.contains(" | "), "table").otherwise("text")
    return docs.withColumns({"content_hash": content_hash(c), "chars": F.length(c).cast("long"), "words": t.n_words(c), "lines": t.n_lines(c), "language": language, "kind": kind})


def triples(docs: DataFrame, columns: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """(subject, predicate, object) of a document's metadata; null values give none, and repeated triples one."""
    pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(c).cast("string").alias("object")) for c, p in columns.items()])
    rows = docs.select(F.concat(F.lit("document:"), F.col(id_col).cast("string")).alias("subject"), F.explode(pairs).alias("x"))
    return rows.select("subject", "x.predicate", "x.object").where("object is not null").distinct()


def changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, change, previous): new, changed, unchanged or deleted, by key and digest."""
    a = old.select(F.col(key).alias("__k"), F.col(digest).alias("previous"))
    both = new.join(a, F.col(key) == F.col("__k"), "full_outer")
    change = F.when(F.col("__k").isNull(), "new").when(F.col(key).isNull(), "deleted").when(F.col("previous") == F.col(digest), "unchanged").otherwise("changed")
    return both.select(F.coalesce(key, "__k").alias(key), change.alias("change"), "previous")


def renames(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(previous, key): a digest that left one place and came up in another; the smallest keys are paired, once each."""
    gone = old.join(new.select(key), key, "left_anti").groupBy(digest).agg(F.min(key).alias("previous"))
    come = new.join(old.select(key), key, "left_anti").groupBy(digest).agg(F.min(key).alias(key))
    return gone.join(come, digest).select("previous", key)


def versions(rows: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """(key, version, digest, parent): a row for each change of the digest, in order; parent is the digest before."""
    w = W.partitionBy(key).orderBy(order)
    changed = rows.withColumn("parent", F.lag(digest).over(w)).where(F.col("parent").isNull() | (F.col("parent") != F.col(digest)))
    return changed.withColumn("version", F.row_number().over(w)).select(key, "version", digest, "parent")


def similarity(name_a: Column, name_b: Column, body_a: Column, body_b: Column) -> Column:
    """0.4 of the names' likeness (as sets of characters) and 0.6 of the bodies' (as sets of words); 1 for equal bodies."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    return F.when(body_a == body_b, 1.0).otherwise(0.4 * t.jaccard(letters(name_a), letters(name_b)) + 0.6 * t.jaccard(F.array_distinct(t.words(body_a)), F.array_distinct(t.words(body_b))))


def thread_statistics(turns: DataFrame, thread: str = "conv_id") -> DataFrame:
    """(thread, size, participants, depth, chars) of conversations (turn, role, text)."""
    return turns.groupBy(thread).agg(F.count("*").alias("size"), F.count_distinct("role").alias("participants"), F.max("turn").alias("depth"), F.sum(F.length("text").cast("long")).alias("chars"))


def subject_changes(turns: DataFrame, thread: str = "conv_id", order: str = "turn", subject: str = "text") -> DataFrame:
    """(thread, order, change): likeness of each subject to the one before: minor_edit, topic_shift or branch."""
    w = W.partitionBy(thread).orderBy(order)
    own = F.array_distinct(t.words(t.subject(F.col(subject))))
    rows = turns.select(thread, order, own.alias("w")).withColumn("before", F.lag("w").over(w)).where("before is not null")
    like = t.jaccard(F.col("w"), F.col("before"))
    return rows.select(thread, order, like.alias("likeness"), F.when(like > 0.7, "minor_edit").when(like > 0.3, "topic_shift").otherwise("branch").alias("change"))


def redacted(c: Column) -> Column:
    """Text with the local part of addresses replaced by a mark; domains stay."""
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+)", "[redacted]@$1")


def complexity(c: Column) -> Column:
    """Between 0 and 1: length, capitalised words a thousand tokens, dates and references."""
    tokens = F.greatest(F.floor(F.length(c) / 4), F.lit(1))
    names = F.size(F.filter(F.regexp_extract_all(c, F.lit(t.WORD), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]+$")))
    dates = F.regexp_count(c, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"))
    refs = F.regexp_count(c, F.lit(r"https?://|@"))
    one = F.lit(1.0)
    return 0.25 * F.least(F.length(c) / 5000, one) + 0.25 * F.least(names / tokens * 1000 / 10, one) + 0.30 * F.least(dates / 10.0, one) + 0.20 * F.least(refs / 5.0, one)


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(src, dst, rel): wikilinks and tags of notes, and the links turned back."""
    wiki = docs.select(F.col(id_col).cast("string").alias("src"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("dst"), F.lit("links_to").alias("rel"))
    tags = docs.select(F.col(id_col).cast("string").alias("src"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/-]*)"), F.lit(1))).alias("dst"), F.lit("tagged").alias("rel"))
    back = wiki.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("linked_from").alias("rel"))
    return wiki.unionByName(tags).unionByName(back).distinct()
