"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

Each byte is eight binary decisions, and each decision has a context tree over the bytes before it, up to DEPTH of them,
whole and unreduced. Every node keeps a Krichevsky-Trofimov estimate; a node's weighted probability mixes its own with its
children's, half and half, so the mixture runs over all depths of all pruned trees. A text's end is a symbol of its own.

The tree is as large as the training texts make it, so it is never in one place. Texts are packed in slices; a slice sends
its distinct grams (DEPTH bytes and the one that follows) with their counts to groups of buckets, a bucket being the two
nearest bytes. There counts are merged, nodes weighted, and each gram gets its log-probability: a table that grows with the
corpus. The nodes above the buckets (at most 256 of depth one, and the root) are summed up from the buckets' own. Slices then
fetch the log-probabilities of their grams, group by group, and texts are scored by looking up their positions. Groups with
very many requests are dealt over several tasks; within a task requests stream past the group's table.

The unigram base needs the count of every word. Counts stay a table; the most frequent words, at most 2^18 of them by a
threshold from a histogram, are broadcast, and each text's other words are joined to the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log, log10, pi

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.llm.common import LOWER_BYTES, discard, schema, setting, stage

DEPTH = 6  # bytes of context; a gram of one more fits in 64 bits
TOP = 2  # bytes that name a bucket
END = 255  # no byte of UTF-8: ends a text, and stands before it
TOP_WORDS = 1 << 18
FLUSH_WORDS = 300_000  # words counted in a task before they are handed on
GROUPS = 256  # that buckets are dealt to
SLICE, SLICE_TEXTS = 8 << 20, 1 << 15  # bytes and texts packed together; a longer text is a slice of its own
PIECE = 4 << 20  # positions whose grams are sorted at once
LOOKED_UP = 1 << 20  # positions whose grams are looked up at once
RUN_TEXTS = 512  # texts whose words are handed on at once
PENDING = 1 << 20  # grams that wait to be merged
ASKED = 1 << 26  # grams requested of a bucket in one task
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def grams(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each byte of texts that end with END, its context (the nearest byte first) and itself as one number.

    first: of each byte, where its text begins. What is before a text counts as END.
    """
    bytes_ = data.astype(np.int64)
    out = bytes_.copy()
    for k in range(1, DEPTH + 1):
        out[k:] |= bytes_[:-k] << (8 * (DEPTH + 1 - k))
    # END has all bits set, so it can be put over whatever came from another text.
    at = np.arange(len(data)) - first
    near = np.flatnonzero(at < DEPTH)
    for k in range(1, DEPTH + 1):
        out[near[at[near] < k]] |= END << (8 * (DEPTH + 1 - k))
    return out


def whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ends, where each text begins)."""
    size = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8), starts


def pieces(data: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, number of each gram's text) of so many positions at a time."""
    for at in range(0, len(data), size):
        lo = max(0, at - DEPTH)
        text = np.searchsorted(starts, np.arange(lo, min(at + size, len(data))), "right") - 1
        yield grams(data[lo : at + size], starts[text] - lo)[at - lo :], text[at - lo :]


def counted(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams, their number in texts to learn from)."""
    parts = []
    for g, text in pieces(*whole(texts), PIECE):
        # One sort: a gram has 56 bits, and the one that is learned from carries a bit more.
        g <<= 1
        g |= train[text]
        g.sort()
        learned = g & 1
        g >>= 1
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        parts.append((g[starts], np.add.reduceat(learned, starts)))
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    u, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(u)
    u, n = u[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    return u[starts], np.add.reduceat(n, starts)


SMALL = 1 << 16


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The logarithms of gamma at k + 1/2 and at k + 1, for small k."""
    k = np.arange(SMALL)
    return lgamma(0.5) + np.concatenate(([0.0], np.cumsum(np.log(k[:-1] + 0.5)))), np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))


def _log_gamma(k: np.ndarray, shift: float) -> np.ndarray:
    """At k + shift, for shift 1/2 or 1: from the table, by Stirling's series beyond it."""
    table = _tables()[0 if shift == 0.5 else 1]
    small = table[np.minimum(k, SMALL - 1)]
    if k.size == 0 or k.max() < SMALL:
        return small
    x = k + shift
    return np.where(k < SMALL, small, (x - 0.5) * np.log(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log-probability that Krichevsky and Trofimov give to a sequence of so many zeros and ones."""
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - log(pi)


class Level:
    """Of one binary decision (the level-th bit of a byte) the nodes at all depths from DEPTH to `top` under some buckets.

    Grams are sorted. Nodes of a depth are (context, bits before); up[d] leads from those of depth d + 1 to those of depth d.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, level: int, top: int):
        symbol = keys & 255
        self.bit = symbol >> (7 - level) & 1
        node = keys >> 8 << 8 | symbol >> (8 - level)
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        self.of_gram = np.cumsum(np.concatenate(([0], (node[1:] != node[:-1]).astype(np.int64))))
        ones = np.add.reduceat(n * self.bit, starts)
        zeros = np.add.reduceat(n, starts) - ones
        node = node[starts]
        weight = log_kt(zeros, ones)
        self.up: dict[int, np.ndarray] = {}
        self.next: dict[int, np.ndarray] = {DEPTH: (ones + 0.5) / (zeros + ones + 1)}
        self.own: dict[int, np.ndarray] = {}
        self.reached: dict[int, np.ndarray] = {DEPTH: zeros + ones > 0}
        for depth in range(DEPTH - 1, top - 1, -1):
            node, back = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
            zeros, ones, below = (np.bincount(back, weights=x, minlength=len(node)) for x in (zeros, ones, weight))
            mine = log_kt(zeros, ones)
            weight, self.own[depth] = weighted(mine, below)
            self.up[depth], self.next[depth], self.reached[depth] = back, (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0
        self.context, self.bits, self.weight, self.zeros, self.ones = node >> 8, node & 255, weight, zeros, ones  # of depth `top`

    def probability(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(of each node of depth DEPTH the probability of a 1, mixed down from depth `top`; its node at that depth)."""
        q, at = self.next[DEPTH], np.arange(len(self.next[DEPTH]))
        for depth in range(DEPTH - 1, top - 1, -1):
            reached = self.reached[depth + 1][at]
            at = self.up[depth][at]
            # A node that was never reached has no say: its parent's estimate holds.
            own = self.own[depth][at]
            q = np.where(reached, own * self.next[depth][at] + (1 - own) * q, self.next[depth][at])
        return q, at


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate)."""
    both = np.logaddexp(own, children) - log(2)
    return both, np.exp(own - log(2) - both)


def tops_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(256, 3, 256): zeros, ones and log weighted probability of the buckets' own nodes, summed by the nearest byte."""
    out = np.zeros((256, 3, 256))
    for level in range(8):
        x = Level(keys, n, level, TOP)
        for row, values in enumerate((x.zeros, x.ones, x.weight)):
            np.add.at(out[:, row], (x.context >> 8, (1 << level) | x.bits), values)
    return out


def joined_tops(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From those (k, 3, 256) of children that (3, 256) of their parent, and (3, 256): next, own weight, reached."""
    zeros, ones, below = tops.sum(0)
    weight, own = weighted(log_kt(zeros, ones), below)
    return np.stack([zeros, ones, weight]), np.stack([(ones + 0.5) / (zeros + ones + 1), own, (zeros + ones > 0).astype(float)])


def logs_of(keys: np.ndarray, n: np.ndarray, first: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Log10 probabilities of grams; first: (256, 3, 256), root: (3, 256): next, own weight and reached of the nodes above the buckets."""
    total = np.zeros(len(keys))
    for level in range(8):
        x = Level(keys, n, level, TOP)
        q, at = x.probability(TOP)
        node, near, reached = (1 << level) | x.bits[at], x.context[at] >> 8, x.reached[TOP][at]
        for upper in (first[near, :, node].T, root[:, node]):
            q = np.where(reached, upper[1] * upper[0] + (1 - upper[1]) * q, upper[0])
            reached = upper[2] > 0
        p = q[x.of_gram]
        total += np.log10(np.where(x.bit == 1, p, 1 - p))
    return total


def group_of(keys: np.ndarray) -> np.ndarray:
    """The group of each gram, by a hash of its bucket."""
    bucket = (keys >> (8 * (DEPTH + 1 - TOP))).astype(np.uint64)
    return (bucket * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % GROUPS


def planes(x: np.ndarray) -> bytes:
    """Numbers of one width, compressed with their bytes apart."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def numbers(blob: bytes, kind: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


SLICED = "slice long, place int, ids array<long>, train array<boolean>, sizes array<int>, text binary, grams binary, n binary, held long"


def pack(rows: DataFrame) -> DataFrame:
    """Rows in slices: of each a row with ids and texts (place -1), and one a group with its distinct grams and their counts."""
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = [f.name for f in schema(SLICED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, train, held = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, train, held, number
            u, n = counted(texts, np.array(train, bool))
            text = zstandard.ZstdCompressor(1).compress(b"".join(texts))
            found = [(number, -1, ids, train, [len(x) for x in texts], text, None, None, 0)]
            ids, texts, train, held = [], [], [], 0
            group = group_of(u)
            order = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
            for g in range(GROUPS):
                if (at := order[bounds[g] : bounds[g + 1]]).size:
                    found.append((number, g, None, None, None, None, planes(np.diff(u[at], prepend=0)), planes(n[at].astype(np.uint32)), len(at)))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for b in batches:
            for i, x, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = (x or "").encode()
                if texts and (held + len(x) > SLICE or len(texts) >= SLICE_TEXTS):
                    yield from out()
                ids.append(i)
                texts.append(x)
                train.append(t)
                held += len(x)
        if texts:
            yield from out()

    return rows.mapInArrow(run, schema(SLICED))


#: Columns of the streams between tasks.
TYPES = {"place": pa.int32(), "salt": pa.int32(), "slice": pa.int64(), "grams": pa.binary(), "n": pa.binary(), "logs": pa.binary(), "near": pa.int32(), "top": pa.binary()}


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), TYPES[k]) for c, k in zip(zip(*rows, strict=True), names, strict=True)], list(names))


def grams_of(blob: bytes) -> np.ndarray:
    return np.cumsum(numbers(blob, np.int64))


def _flushed(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((place, salt), grams, counts) of sorted rows, merged as they come. wide: counts have 64 bits."""
    at, parts, held = None, [], 0
    for b in batches:
        for *key, u, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != at:
                if at is not None:
                    yield tuple(at), *merged(parts)
                at, parts, held = key, [], 0
            u = grams_of(u)
            parts.append((u, numbers(n, np.int64 if wide else np.uint32).astype(np.int64)))
            held += len(u)
            if held > PENDING and len(parts) > 1:
                parts, held = [merged(parts)], 0
    if at is not None:
        yield tuple(at), *merged(parts)


def merge(parts: DataFrame, *by: str, wide: bool) -> DataFrame:
    """(place, salt, grams, n): the grams of each group merged, in a stream of sorted rows that holds the distinct ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, salt), u, n in _flushed(batches, wide):
            yield _rows([(place, salt, planes(np.diff(u, prepend=0)), planes(n))], "place", "salt", "grams", "n")

    return parts.select("place", "salt", "grams", "n").repartition(*by).sortWithinPartitions("place", "salt").mapInArrow(run, schema("place int, salt int, grams binary, n binary"))


def build(parts: DataFrame, salts: DataFrame) -> DataFrame:
    """(place, grams, logs) of (place, salt, grams, n) rows: the log10 probability of each gram, by group.

    salts: of each place the number of salts. A group of one salt is whole once merged; those of several are merged again.
    """
    once = stage(merge(parts, "place", "salt", wide=False), "gram-counts")
    dealt = F.broadcast(salts.where("salts > 1").select("place"))  # at most GROUPS rows
    again = stage(merge(once.join(dealt, "place", "left_semi").withColumn("salt", F.lit(0)), "place", wide=True), "gram-counts")
    counts = once.join(dealt, "place", "left_anti").unionByName(again)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((256, 3, 256))
        for _, u, n in _flushed(batches, True):
            found += tops_of(u, n)
        seen = np.flatnonzero(found.any(axis=(1, 2)))
        if seen.size:
            yield _rows([(int(k), found[k].tobytes()) for k in seen], "near", "top")

    summed = np.zeros((256, 3, 256))
    for r in counts.mapInArrow(tops, schema("near int, top binary")).toLocalIterator():  # at most 256 rows of 6 KB a task
        summed[r.near] += np.frombuffer(r.top).reshape(3, 256)
    below = [joined_tops(x[None]) for x in summed]
    root = joined_tops(np.stack([x for x, _ in below]))[1]
    shared = counts.sparkSession.sparkContext.broadcast((np.stack([x for _, x in below]), root))  # 257 nodes, 6 KB each

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, _), u, n in _flushed(batches, True):
            yield _rows([(place, planes(np.diff(u, prepend=0)), planes(logs_of(u, n, *shared.value).astype(np.float32)))], "place", "grams", "logs")

    model = stage(counts.mapInArrow(logs, schema("place int, grams binary, logs binary")), "gram-logs")
    discard(once, again)
    return model


def answers(parts: DataFrame, model: DataFrame, salts: DataFrame) -> DataFrame:
    """(slice, place, logs): the log-probabilities of each slice's grams, in their order, by group."""
    tables = model.join(F.broadcast(salts), "place").select("place", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("slice"), "grams", "logs")
    asked = parts.select("place", "salt", "slice", "grams", F.lit(None).cast("binary").alias("logs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        for b in batches:
            out = []
            for place, _, number, g, logs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g = grams_of(g)
                if number < 0:
                    keys, values = g, numbers(logs, np.float32)
                else:
                    out.append((number, place, planes(values[np.searchsorted(keys, g)])))
            if out:
                yield _rows(out, "slice", "place", "logs")

    return tables.unionByName(asked).repartition("place", "salt").sortWithinPartitions("place", "salt", "slice").mapInArrow(run, schema("slice long, place int, logs binary"))


def scores(texts: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Log10 probabilities of texts; logs are those of their distinct grams, by group."""
    known = counted(texts, np.zeros(len(texts), bool))[0]
    of_gram = np.empty(len(known))
    of_gram[np.argsort(group_of(known), kind="stable")] = logs
    out = np.zeros(len(texts))
    for g, text in pieces(*whole(texts), LOOKED_UP):
        order = np.argsort(g)
        values = np.empty(len(g))
        values[order] = of_gram[np.searchsorted(known, g[order])]
        out += np.bincount(text, weights=values, minlength=len(texts))
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all `__text`: words and their number; the word '' counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            nonlocal words
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            words = Counter()
            return batch

        for b in batches:
            for x in b.column(0).to_pylist():
                words.update((x or "").encode().translate(LOWER_BYTES).split())
                words[b""] += 1
                if len(words) > FLUSH_WORDS:
                    yield out()
        if words:
            yield out()

    return texts.select("__text").mapInArrow(run, schema("word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int = TOP_WORDS) -> dict[bytes, int]:
    """The words whose count reaches a threshold that at most `most` of them do, by a histogram of the counts' logarithms."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred rows
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        least = r.level
    if least is None:
        return {}
    return {r.word.encode(): r.n for r in words.where(level >= least).select("word", "n").collect()}


def byte_logs(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, answers) by slice of (__id, __text, __train) rows, both staged."""
    with setting(spark, BATCH, "2000"):
        slices = stage(pack(rows), "slices")
    parts = slices.where("place >= 0").select("slice", "place", "grams", "n", "held")
    salts = stage(parts.groupBy("place").agg(F.ceil(F.sum("held") / ASKED).cast("int").alias("salts")), "salts")  # at most GROUPS rows
    parts = parts.join(F.broadcast(salts), "place").withColumn("salt", F.pmod(F.xxhash64("slice"), "salts").cast("int")).drop("salts")
    with setting(spark, BATCH, "64"):
        model = build(parts, salts)
        found = stage(answers(parts, model, salts), "answers")
    discard(model, salts)
    texts = stage(slices.where("place < 0").select("slice", "ids", "train", "sizes", "text"), "slice-texts")  # the grams have been answered
    discard(slices)
    return texts, found


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    `training` says which rows are learned from. The base is the add-one unigram model over A-Z-lower-cased words and an end
    token; score is the log10 probability that the context-tree model gives to the text's bytes and its end, bits_per_byte
    the same as a code length. Null counts as empty: one token, the end. Without training rows all probabilities are those
    of the empty model. Rows that repeat are each learned from and scored; null ids are passed through; other columns are
    left aside; whole texts are read, in pieces where they are long; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), F.coalesce(training, F.lit(False)).alias("__train"))
    counts = stage(count_words(rows.where("__train")), "word-counts")
    ends, n, v = counts.agg(F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where("word != ''")
    spark = docs.sparkSession
    texts, found = byte_logs(spark, rows)
    shared = spark.sparkContext.broadcast(frequent(words))  # at most TOP_WORDS words
    fields = "key long, __id long, held_out boolean, n_tokens long, known long, logs double, score double, size long, rare array<struct<word:string,n:int>>"
    names = schema(fields).names
    answered = found.select("slice", "place", "logs", *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("train", "array<boolean>"), ("sizes", "array<int>"), ("text", "binary"))])
    asking = texts.select("slice", F.lit(GROUPS).alias("place"), F.lit(None).cast("binary").alias("logs"), "ids", "train", "sizes", "text")
    both = answered.unionByName(asking).repartition("slice").sortWithinPartitions("slice", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        rare_kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

        def word_logs(x: bytes) -> tuple[int, int, float, list[dict]]:
            """Of a text: tokens, known words and the sum of their logarithms as far as they are frequent, and the other words."""
            counted_words = Counter(x.translate(LOWER_BYTES).split())
            n_known, total, others = 0, 0.0, []
            for w, k in counted_words.items():
                c = common.get(w)
                if c is None:
                    others.append({"word": w.decode(), "n": k})
                else:
                    n_known += k
                    total += k * log10(c + 1)
            return sum(counted_words.values()) + 1, n_known, total, others

        got: list[np.ndarray] = []
        for b in batches:
            for row in range(b.num_rows):
                if b.column(2)[row].is_valid:
                    got.append(numbers(b.column(2)[row].as_py(), np.float32))
                    continue
                ids, train, sizes, text = (b.column(c)[row].as_py() for c in range(3, 7))
                ends_at = np.cumsum(sizes)
                text = zstandard.ZstdDecompressor().decompress(text, max_output_size=int(ends_at[-1]) + 1)
                raw = [text[z - s : z] for s, z in zip(sizes, ends_at.tolist(), strict=True)]
                key = (b.column(0)[row].as_py() << 16) + np.arange(len(raw))
                score = scores(raw, np.concatenate(got))
                got = []
                # The words are counted after that, and handed on a run of texts at a time: what is held is one or the other.
                for lo in range(0, len(raw), RUN_TEXTS):
                    part = slice(lo, lo + RUN_TEXTS)
                    tokens, known, logs, rare = zip(*map(word_logs, raw[part]), strict=True)
                    columns = ((key[part], None), (ids[part], pa.int64()), ([not t for t in train[part]], pa.bool_()), (tokens, pa.int64()), (known, pa.int64()), (logs, pa.float64()), (score[part], pa.float64()), (sizes[part], pa.int64()), (rare, rare_kind))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names)

    with setting(spark, BATCH, "8"):
        scored = stage(both.mapInArrow(run, schema(fields)), "scored")
    discard(texts, found)
    others = scored.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times")).join(words, "word")
    others = others.groupBy("key").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1))).alias("more_logs"))
    whole_rows = scored.drop("rare").join(others, "key", "left").fillna(0, ["more"]).fillna(0.0, ["more_logs"])
    base = F.col("logs") + F.col("more_logs") + F.lit(log10(ends + 1)) - F.col("n_tokens") * F.lit(log10(n + v + 1))
    return whole_rows.select(
        F.col("__id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.col("more") + F.lit(1 if ends else 0)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / (F.col("size") + 1) / F.lit(log10(2))).alias("bits_per_byte"),
    )
