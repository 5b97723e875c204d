"""Byte-level BPE by speculation and verification.

Words (pieces of the pre-tokenizer) are first split greedily, longest vocabulary entry first. A split is what BPE itself
would give exactly if every adjacent pair of its tokens is: so all adjacent pairs of a batch are tested at once by unwinding
both tokens' merges in numpy, and only words with a failing pair are merged exactly. Distinct words are split once a batch
and kept in a bounded cache of the worker; texts are then joined from their words' ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import schema

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000
SHORT = 40  # bytes of a word that is merged without a heap
CACHED_CHARS = 64  # longer words are split each time
ROWS = 256  # texts handled at once


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary in arrays.

    Inside, token numbers are ordered as they come to be: bytes, then merges by rank; `ids` maps them to the vocabulary's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        names = [s for s in sorted(symbols, key=symbols.get)]
        self.bytes_of = [bytes([symbols[s]]) for s in names]
        number = {s: i for i, s in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        self.merge: dict[int, int] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            n = number.setdefault(a + b, len(names))
            if n == len(names):
                names.append(a + b)
                self.bytes_of.append(self.bytes_of[number[a]] + self.bytes_of[number[b]])
                left.append(number[a])
                right.append(number[b])
            self.merge.setdefault(number[a] << 32 | number[b], n)
        self.ids = np.array([vocab[s] for s in names], np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        keys = np.array(sorted(self.merge), np.int64)
        self.keys, self.made = keys, np.array([self.merge[int(k)] for k in keys], np.int64)
        self.number_of = {x: i for i, x in enumerate(self.bytes_of)}
        self.longest = max(map(len, self.bytes_of))
        self.id_text = [str(i) for i in self.ids]
        special = [t for t in spec.get("added_tokens", []) if t["content"]]
        self.special = {t["content"]: t["id"] for t in special}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        # A trie over bytes: (node << 8 | byte) leads to a node, and entry[node] is the token that ends there.
        self.trie: dict[int, int] = {}
        self.entry = [-1]
        for n, x in enumerate(self.bytes_of):
            node = 0
            for byte in x:
                node = self.trie.setdefault(node << 8 | byte, len(self.entry))
                if node == len(self.entry):
                    self.entry.append(-1)
            if self.entry[node] < 0:
                self.entry[node] = n
        self.byte_token = [self.number_of[bytes([b])] for b in range(256)]
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (n := self.number_of.get(word)) is not None:
            return [n]
        step, entry, out, at, end = self.trie.get, self.entry, [], 0, len(word)
        while at < end:
            node, stop, best, found = 0, at, at, -1
            while stop < end and (node := step(node << 8 | word[stop])) is not None:
                stop += 1
                if entry[node] >= 0:
                    best, found = stop, entry[node]
            out.append(found)
            at = best
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair (a, b) of adjacent tokens: would BPE keep the boundary between them?

        BPE joins neighbours in the order of rank. Unwind the later-made of the two tokens, step by step: at each step the
        parts that touch the boundary existed together, and if they have a merge that ranks before the one just undone, BPE
        would have taken it across the boundary.
        """
        ok = np.ones(len(a), bool)
        if not len(a):
            return ok
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < limit)
            ok[live[crossed]] = False
            # On the left a merge that ranks equal comes first, so a tie unwinds the right token.
            undo_left = (x >= 256) & (x > y)
            undo_right = ~undo_left & (y >= 256)
            limit = np.where(undo_left, x, np.where(undo_right, y + 1, limit))
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_right, self.left[y], y)
            go = ~crossed & (undo_left | undo_right)
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return ok

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges of the lowest rank first, leftmost among equals, by a heap over a linked list."""
        if len(word) <= SHORT:
            return self._merge_short(word)
        token: list[int] = [self.number_of[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        end = len(token)
        heap = [(n, i) for i in range(end - 1) if (n := self.merge.get(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            n, i = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else end
            if j >= end or self.merge.get(token[i] << 32 | token[j]) != n:
                continue
            token[i], token[j], after[i] = n, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
                if (m := self.merge.get(n << 32 | token[after[j]])) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := self.merge.get(token[before[i]] << 32 | n)) is not None:
                heapq.heappush(heap, (m, before[i]))
        return [t for t in token if t >= 0]

    def _merge_short(self, word: bytes) -> list[int]:
        """The same for a few bytes, where looking at every pair again is cheaper than a heap."""
        merge, none = self.merge.get, len(self.bytes_of)
        token = [self.byte_token[b] for b in word]
        made = [merge(a << 32 | b, none) for a, b in zip(token, token[1:])]
        while made and (n := min(made)) < none:
            i = made.index(n)
            token[i : i + 2] = [n]
            del made[i]
            if i < len(made):
                made[i] = merge(n << 32 | token[i + 1], none)
            if i:
                made[i - 1] = merge(token[i - 1] << 32 | n, none)
        return token

    def split(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        raw = [w.encode() for w in words]
        guesses = [self.speculate(w) for w in raw]
        flat = np.fromiter((t for g in guesses for t in g), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        inner = owner[1:] == owner[:-1]
        bad = owner[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]
        for i in set(bad.tolist()):
            guesses[i] = self.merge_exactly(raw[i])
        return guesses

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """Of each text the words in order, each as (ids joined by commas, number of ids, bytes that the ids decode to)."""
        words = [self._words(x) for x in texts]
        new = list({w for ws in words for w in ws if w not in self.cache and w not in self.special})
        local = {}
        if new:
            for w, tokens in zip(new, self.split(new), strict=True):
                local[w] = (",".join([self.id_text[t] for t in tokens]), len(tokens), b"".join([self.bytes_of[t] for t in tokens]))
        for w in self.special:
            local[w] = (str(self.special[w]), 1, w.encode())
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            local.update({w: cache[w] for ws in words for w in ws if w in cache})
            cache.clear()
        cache.update(local)
        out = [[cache[w] for w in ws] for ws in words]
        for w in local:
            if len(w) > CACHED_CHARS or w in self.special:
                del cache[w]
        return out

    def _words(self, text: str) -> list[str]:
        find = word_pattern(is_latin(text)).findall
        if self.split_special is None or not any(s in text for s in self.special):
            return find(text)
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else find(part)
        return out


def is_latin(text: str) -> bool:
    """Is every character below U+0100?"""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(2)
def word_pattern(latin: bool = False) -> re.Pattern | regex.Pattern:
    """PATTERN; for texts of characters below U+0100 with its classes written out, for the faster library."""
    if not latin:
        return regex.compile(PATTERN)
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = "".join(re.escape(chr(c)) for c in range(256) if regex.match(r"\s", chr(c)))
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    `path` is a byte-level vocabulary file that every executor can open. Special tokens' strings in a text become their
    ids. Null and empty texts have no ids, and the digests of the empty string. A very long word is merged in n log n.
    Repeated rows are each encoded; null ids are passed through; other columns are left aside.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n, ids, decoded, size = [], [], [], []
                for ws in bpe.encode([x or "" for x in b.column(1).to_pylist()]):
                    own_ids, own_n, own_bytes = zip(*ws, strict=True) if ws else ((), (), ())
                    n.append(sum(own_n))
                    ids.append(sha256(",".join(own_ids).encode()).hexdigest())
                    raw = b"".join(own_bytes)
                    size.append(len(raw))
                    decoded.append(sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(size, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, schema(f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"))


def bpe_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = [[int(i) for w in ws for i in w[0].split(",")] for ws in bpe.encode([x or "" for x in b.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, schema(f"`{id_col}` long, ids array<int>"))


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts that token ids stand for; special tokens are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        table = {int(i): x for i, x in zip(bpe.ids, bpe.bytes_of, strict=True)} | {i: s.encode() for s, i in bpe.special.items()}
        for b in batches:
            texts = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, schema(f"`{id_col}` long, text string"))
