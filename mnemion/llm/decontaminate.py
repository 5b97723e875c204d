"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows are its runs of ten words (a shorter item is one window). A window is a set of five-word shingles with their
places, and a text holds it only if it holds all of them; so by the prefix filter for full containment one shingle of each
window is the necessary prefix. The rarest is taken, as counted over the whole corpus.

1. One pass over the texts meets the documents' shingles with the items' shingles, word by word where numbers agree. The
   meetings (document, place, shingle) are a small table, and the texts aren't needed again.
2. Shingles are ordered by how many meetings they have. Windows with a shingle that has none can't occur and are dropped.
3. Meetings of prefixes are joined with their windows. A window that would start before the first word or end behind the last
   is out.
4. What remains is verified: shingles that cover the whole window must have been met at their places.

The items' shingles are broadcast while there are few enough; beyond that they are joined by shingle and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import discard, lower_ascii, stage

WINDOW = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of items' shingles or windows that are broadcast at most, some 60 MB; beyond them joins are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 16  # of one shingle's places in documents, in shuffled joins
KEY = ("__id", "__sha")
HEAD = 0  # the place of a document's own row in the table of meetings


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, items): the distinct windows and the ids, as strings, of the items that have them.

    Summed over windows the lists are no longer than the items' words. A null id counts as the empty string.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    rows = rows.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))).alias("at"))
    return rows.groupBy(F.slice("words", F.col("at"), size).alias("window")).agg(F.collect_set("item").alias("items"))


def _joined(left: DataFrame, right: DataFrame, key: str, small: bool) -> DataFrame:
    """Inner join; a right side that isn't small meets each salt of the left one."""
    if small:
        return left.join(F.broadcast(right), key)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    return salted.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [key, "__salt"]).drop("__salt")


def _gram(words: Column, at: Column, n: int) -> Column:
    """A number for the n words from a place, counted from 1."""
    return F.xxhash64(*[F.get(words, at + (i - 1)) for i in range(n)])


def _meetings(docs: DataFrame, shingles: DataFrame, small: bool) -> DataFrame:
    """(__id, __sha, place, n, shingle): where documents hold shingles (shingle, words), and each document's own row, at HEAD."""
    lengths = sorted(r[0] for r in shingles.select(F.size("words")).distinct().collect())  # five numbers at most
    gram = F.lit(None).cast("long")
    for k in lengths:
        gram = F.when(F.size("words") == k, _gram(F.col("words"), F.lit(1), k)).otherwise(gram)
    table = shingles.select(gram.alias("gram"), "shingle", F.col("words").alias("theirs"))
    n, place = F.size("words"), F.col("place")
    every = docs.select("*", F.explode(F.sequence(F.lit(HEAD), n)).alias("place"))
    each = [F.when(place.between(1, n - k + 1), _gram(F.col("words"), place, k)).alias(f"g{k}") for k in lengths]
    # Each place has its shingle of each length; a document's own row has one number only, which is that of the row put into the table.
    grams = [F.when(place == HEAD, 0).otherwise(each[0]) if each else F.when(place == HEAD, 0), *each[1:]]
    met = every.select("*", F.explode(F.array(*grams)).alias("gram") if len(grams) > 1 else grams[0].alias("gram")).where("gram is not null")
    same = F.slice("words", place, F.size("theirs")) == F.col("theirs")
    if small:
        own = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("gram"), F.lit(None).cast("long").alias("shingle"), F.lit(None).cast("array<string>").alias("theirs"))
        found = met.join(F.broadcast(table.unionByName(own)), "gram")
        return found.where(F.when(place == HEAD, F.col("shingle").isNull()).otherwise(same)).select(*KEY, "place", n.alias("n"), "shingle")
    # Beyond the bound a place takes its longest shingle's words along, and not those of the document.
    ahead = met.where(place > HEAD).select(*KEY, n.alias("n"), "place", "gram", F.slice("words", place, max(lengths)).alias("words"))
    found = _joined(ahead, table, "gram", False).where(F.slice("words", 1, F.size("theirs")) == F.col("theirs"))
    return found.select(*KEY, "place", "n", "shingle").unionByName(docs.select(*KEY, F.lit(HEAD).alias("place"), n.alias("n"), F.lit(None).cast("long").alias("shingle")))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.

    A word is hit if it lies in an occurrence of an item's window. Null and empty texts have no words, are never hit, and as
    items have no window. Items that share an id count once, one without an id as the empty string. Repeated documents each
    have their row; a null id is passed through. A very long text is one row of words and of hits. Without items nothing is
    hit; without documents the result is empty. Other columns are left aside.
    """
    windows = stage(item_windows(items, size, item_col, item_text_col).withColumn("nr", F.monotonically_increasing_id()), "windows")
    n = F.size("window")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), n - SHINGLE + 1))
    held = windows.select("nr", n.alias("len"), F.posexplode(F.transform(at, lambda i: F.slice("window", i, SHINGLE))).alias("off", "words"))
    shingles = stage(held.select("words").distinct().withColumn("shingle", F.monotonically_increasing_id()), "shingles")
    small = shingles.count() <= broadcast_rows
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("__id", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("__sha"), words_of(F.col("__text")).alias("words"))
    met = stage(_meetings(rows, shingles, small), "meetings")
    hits = met.where(F.col("place") > HEAD)
    # The order of rarity, and the rarest shingle of each window of which the corpus has all.
    seen = hits.groupBy("shingle").agg(F.count("*").alias("seen"))
    ranked = held.join(shingles, "words").join(seen, "shingle", "left").select("nr", "len", "off", "shingle", F.coalesce("seen", F.lit(0)).alias("seen"))
    ranked = stage(ranked, "ranked")
    rarest = F.min(F.struct("seen", "shingle", "off")).alias("p")
    prefixes = ranked.groupBy("nr", "len").agg(rarest).where("p.seen > 0").select("nr", "len", "p.shingle", F.col("p.off").alias("skip"))
    start = F.col("place") - F.col("skip")
    found = _joined(hits, prefixes, "shingle", small).select(*KEY, "nr", "len", "n", start.alias("start")).where("start >= 1 and start + len - 1 <= n").distinct()
    found = stage(found.select(*KEY, "nr", "len", "start"), "candidates")
    # Every fifth shingle and the last cover the window.
    cover = ranked.where((F.col("off") % SHINGLE == 0) | (F.col("off") == F.col("len") - SHINGLE)).select("nr", "off", "shingle")
    needed = cover.groupBy("nr").agg(F.count("*").alias("needed"))
    asked = _joined(_joined(found, needed, "nr", small), cover, "nr", small).withColumn("place", F.col("start") + F.col("off")).drop("off")
    places = hits.select(F.col("__id").alias("i"), F.col("__sha").alias("s"), "place", "shingle").distinct()
    held_all = asked.join(places, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__sha") == F.col("s")) & (asked["place"] == places["place"]) & (asked["shingle"] == places["shingle"]), "left_semi")
    true = held_all.groupBy(*KEY, "nr", "len", "start", "needed").agg(F.count("*").alias("got")).where("got = needed")
    with_items = _joined(true.select(*KEY, "nr", "len", "start"), windows.select("nr", "items"), "nr", small)
    hit = with_items.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Words in the union of the runs, by their starts.
    grown = lambda a, r: F.struct(F.greatest(a.end, r.start + r.len).alias("end"), (a.n + F.greatest(F.lit(0), r.start + r.len - F.greatest(a.end, r.start))).alias("n"))
    hit = stage(hit.select(F.col("__id").alias("i"), F.col("__sha").alias("s"), F.aggregate("runs", F.struct(F.lit(1).alias("end"), F.lit(0).alias("n")), grown).n.alias("hit"), "items"), "hit")
    heads = met.where(F.col("place") == HEAD)
    out = heads.join(hit, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__sha") == F.col("s")), "left")
    out = out.select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.coalesce(F.col("hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    discard(windows, shingles, ranked, found)
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def oracle(size: int = WINDOW) -> str:
    """DuckDB SQL over documents and benchmark."""
    words = lambda t: f"list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w != '')"
    return f"""
        WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words("text")} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item, least(len(ws), {size}) AS l, array_to_string(list_slice(ws, k, k + {size} - 1), ' ') AS win FROM b, unnest(range(1, greatest(2, len(ws) - {size} + 2))) AS u(k) WHERE len(ws) > 0),
        d AS (SELECT row_number() OVER () AS nr, doc_id, {words("text")} AS ws FROM documents),
        g AS (SELECT nr, k, l, array_to_string(list_slice(ws, k, k + l - 1), ' ') AS win FROM d, unnest(range(1, len(ws) + 1)) AS u(k), (SELECT DISTINCT l FROM w) WHERE k + l - 1 <= len(ws)),
        m AS (SELECT nr, k, l, item FROM g JOIN w USING (l, win)),
        h AS (SELECT nr, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT nr, k, l FROM m), unnest(range(k, k + l)) AS u(p) GROUP BY 1),
        i AS (SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT nr, item FROM m) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (nr) LEFT JOIN i USING (nr)"""
