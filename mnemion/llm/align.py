"""Alignment of two tokenizers over a corpus: byte-level BPE (A) and pieces with byte fallback (B).

Both cut the same bytes. A two-pointer merge of their cumulative token ends gives the groups (bytes between ends that both have)
and the links (tokens whose bytes overlap): of every end in the merged order, the tokens that cover the bytes before it are one
link. No token of either side reaches from a word into the space behind it, so texts are cut there, and segments are encoded and
merged once a worker, many at a time in numpy, as both sides end wherever a segment does. A text's links leave the task once an
id pair, with the number of their places. Spark counts the texts of each pair, takes the largest count of each id on either
side, and joins both back to the texts' pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import sha256
from itertools import chain
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import schema, stage

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

#: Rows of the table of counts that are broadcast at once, some 64 MB; a larger table is joined in so many blocks.
BLOCK_ROWS = 1_000_000
SLICE_CHARS = 1 << 20  # of the texts that are handled at once
HELD_CHARS = 1 << 23  # of segments that a worker keeps
SPACE = "▁"  # stands for a space in pieces


class Pair:
    """Both tokenizers, and for each id its bytes, their number, and how it's written in a group."""

    def __init__(self, path_a: str, path_b: str):
        import json
        import re

        import numpy as np
        import sentencepiece
        import tiktoken

        from mnemion.llm.bpe import PATTERN, byte_symbols

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], byte_symbols()
        special = {t["content"] for t in spec.get("added_tokens", []) if t["special"]}
        bytes_a = {i: bytes(byte[c] for c in w) for w, i in vocab.items() if w not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of the byte-level vocabulary must be in the order of its merges")
        # Special tokens are left out, so their strings are ordinary text.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={w: i for i, w in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = max(vocab.values()) + 1, self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) and re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = [bytes_a.get(i, b"") for i in range(self.size_a)], bytes_b
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        written = lambda n, ends: np.array([[b"%d%s" % (i, end) for i in range(n)] for end in ends], object)
        self.text_a, self.text_b = written(self.size_a, (b",", b"|")), written(self.size_b, (b",", b";"))

        #: From a space to the next one behind a word, but for a single one at the end; whole texts, should a piece go on over such a space.
        self.segment = re.compile(r" .*" if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) else r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?", re.DOTALL)
        self.clear()

    def clear(self) -> None:
        """Forget the segments: their numbers, counts (n_a, n_b, n_groups, n_links), groups as written, and pairs."""
        import numpy as np

        self.number: dict[str, int] = {}
        self.held, self.whole, self.written = 0, np.empty(0, bool), []
        self.counts, self.first, self.pairs, self.times = np.empty((0, 4), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, segments: list[str]) -> None:
        """Encode and merge new segments, each of which starts with a space."""
        import numpy as np

        ids_a, ids_b = [self.a.encode_ordinary(x) for x in segments], self.b.encode([x[1:] for x in segments], num_threads=1)
        raw = [x.encode() for x in segments]
        whole = np.ones(len(segments), bool)
        for k, x in enumerate(raw):
            if b"".join([self.bytes_b[i] for i in ids_b[k]]) != x or b"".join([self.bytes_a[i] for i in ids_a[k]]) != x:
                ids_a[k], ids_b[k], whole[k] = [], [], False
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        of_a, of_b, at_a, at_b, common = merge(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        # Tokens in the order in which groups are written: a group's A tokens, then its B tokens.
        group, last = np.cumsum(common) - common, np.flatnonzero(common)
        upto_a, upto_b = np.append(0, of_a[last] + 1), np.append(0, of_b[last] + 1)  # tokens up to the end of each group, the first being none
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + upto_b[group[at_a]]] = self.text_a[common[at_a].astype(int), a]
        text[np.arange(len(b)) + upto_a[group[at_b] + 1]] = self.text_b[common[at_b].astype(int), b]
        stop = np.cumsum(n_a + n_b)
        self.written += [b"".join(text[s - n : s].tolist()) for s, n in zip(stop.tolist(), (n_a + n_b).tolist(), strict=True)]
        owner = np.repeat(np.arange(len(segments)), n_a)[of_a]  # the segment of each link
        n_links, n_groups = np.bincount(owner, minlength=len(segments)), np.bincount(owner[last], minlength=len(segments))
        space = self.size_a * self.size_b
        keys, times = np.unique(owner * space + a[of_a] * self.size_b + b[of_b], return_counts=True)
        ends = len(self.pairs) + np.searchsorted(keys, np.arange(1, len(segments) + 1) * space)
        self.number |= zip(segments, range(len(self.whole), len(self.whole) + len(segments)), strict=True)
        self.held += sum(map(len, segments))
        self.whole, self.counts = np.append(self.whole, whole), np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, n_links), 1)))
        self.first, self.pairs, self.times = np.append(self.first, ends), np.append(self.pairs, keys % space), np.append(self.times, times)


@lru_cache(1)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(of each link, its A token's number and its B token's; of each A token the place of its end among all ends; the same of B; are they common ends?)"""
    import numpy as np

    ends = np.concatenate((ends_a, ends_b))
    ends.sort(kind="stable")  # two sorted runs
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    at_a, at_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
    is_a, is_b = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    is_a[at_a], is_b[at_b] = 1, 1
    return np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, at_a, at_b, (is_a & is_b).astype(bool)


def aligned(pair: Pair, texts: list[str]) -> dict[str, list]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * size_b + b, distinct and sorted), times."""
    import numpy as np

    if pair.held > HELD_CHARS:
        pair.clear()
    cut = [pair.segment.findall(" " + x) if x else [] for x in texts]
    if new := {s: None for segments in cut for s in segments if s not in pair.number}:
        pair.add(list(new))
    numbers = [[pair.number[s] for s in segments] for segments in cut]
    sizes = np.array([len(x) for x in numbers], np.int64)
    every = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    # A text with a segment that isn't whole on both sides has no tokens.
    whole = np.bincount(text[~pair.whole[every]], minlength=len(texts)) == 0
    every, text = every[whole[text]], text[whole[text]]
    totals = np.stack([np.bincount(text, c, len(texts)).astype(np.int64) for c in pair.counts[every].T])
    digests = [sha256(b"".join([pair.written[i] for i in x])[:-1]).hexdigest() if x and ok else "" for x, ok in zip(numbers, whole.tolist(), strict=True)]
    # Distinct segments of each text, then their pairs.
    some, often = np.unique(text * len(pair.whole) + every, return_counts=True)
    owner, segment = some // max(1, len(pair.whole)), some % max(1, len(pair.whole))
    n = pair.first[segment + 1] - pair.first[segment]
    at = np.arange(n.sum()) + np.repeat(pair.first[segment] - (np.cumsum(n) - n), n)
    space = pair.size_a * pair.size_b
    keys, where = np.unique(np.repeat(owner, n) * space + pair.pairs[at], return_inverse=True)
    times = np.bincount(where, pair.times[at] * np.repeat(often, n), len(keys))
    cuts = np.searchsorted(keys, np.arange(1, len(texts)) * space)
    kind = np.int32 if space < 1 << 31 else np.int64
    names = ("n_a", "n_b", "n_groups", "n_links")
    return dict(zip(names, totals, strict=True)) | {"groups_sha256": digests, "pairs": np.split((keys % space).astype(kind), cuts), "times": np.split(times.astype(np.int32), cuts)}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts, none much longer than SLICE_CHARS unless it is one text."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x or "") > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(x or "") + 1
    if start < len(texts):
        yield start, len(texts)


def text_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        pair = load(path_a, path_b)
        for x in batches:
            texts = [t if isinstance(t, str) else "" for t in x["__text"]]
            for lo, hi in _slices(texts):
                yield pd.DataFrame({"__id": x["__id"].iloc[lo:hi].reset_index(drop=True)} | aligned(pair, texts[lo:hi]))

    code = "int" if _sizes(path_a, path_b) < 1 << 31 else "long"
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = f"__id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{code}>, times array<int>"
    return rows.mapInPandas(run, schema(kind)).withColumn("__id", F.col("__id").cast(docs.schema[id_col].dataType))


def _sizes(path_a: str, path_b: str) -> int:
    pair = load(path_a, path_b)
    return pair.size_a * pair.size_b


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best_a, best_b): the number of texts of each id pair; is it the largest of its A id, of its B id?

    The maxima have a row for each id of a vocabulary at most and are broadcast.
    """
    counts = stage(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a, b = F.floor(F.col("pair") / size_b), F.col("pair") % size_b
    top = lambda side, name: F.broadcast(counts.groupBy(side.alias(name)).agg(F.max("n").alias(f"top_{name}")))
    known = counts.select("*", a.alias("a"), b.alias("b")).join(top(a, "a"), "a").join(top(b, "b"), "b")
    return known.select("pair", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256.

    A is given a space and the text, B the text, to which it adds the space itself. Texts that are null or empty, or whose
    tokens' joined bytes differ from space and text, have no tokens: zeros and an empty digest. Special tokens' strings are
    plain text. n_best counts the links whose pair is in as many texts as any pair of its A id, n_best_b the same for B;
    count_sum adds up the counts. A very long text is merged at once, in memory proportional to it. Each of repeated rows
    counts as a text; null ids are passed through; an empty table gives an empty result; other columns are left aside.
    """
    links = stage(text_links(docs, path_a, path_b, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), "links")
    known = pair_counts(links, load(path_a, path_b).size_b)
    # A pair that isn't in the table is in one text and the best of neither id.
    known = stage(known.where("n > 1 or best_a or best_b"), "known-pairs")
    blocks = max(1, -(-known.count() // block_rows))
    every = links.select("__row", "times", F.posexplode("pairs").alias("i", "pair")).select("__row", "pair", F.get("times", F.col("i")).cast("long").alias("t"))
    met = []
    for k in range(blocks):
        block = known.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        found = every.join(F.broadcast(block), "pair")
        part = lambda c: F.sum(F.when(F.col(c), F.col("t")).otherwise(0))
        met.append(found.groupBy("__row").agg(part("best_a").alias("n_best"), part("best_b").alias("n_best_b"), F.sum(F.col("t") * (F.col("n") - 1)).alias("more")))
    sums = reduce(DataFrame.unionByName, met)
    if blocks > 1:
        sums = sums.groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "more")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = links.drop("pairs", "times").join(sums, "__row", "left")
    return out.select(F.col("__id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best").alias("n_best"), zero("n_best_b").alias("n_best_b"), (F.col("n_links") + zero("more")).alias("count_sum"), "groups_sha256")
