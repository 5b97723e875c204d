"""Filter audit, decontamination and tokenizer alignment against literal versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from mnemion.llm import align, decontaminate, filter_audit
from mnemion.llm.queries import tokenizer_path
from tests.llm.test_operators import EDGES, docs, lower

LABELS = "doc_id long, quality int, toxic int"


def audit_rows(spark, rows, labels, extra=False):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = d.withColumns({c: F.lit(1) for c in ("part", "step", "A", "fails", "__salt", "quality")}) if extra else d
    return filter_audit.filter_audit(d, spark.createDataFrame(labels, LABELS))


def literal_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        t = t or ""
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((part or "", f, i in good, i in toxic))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for order in permutations("ABCDE"):
        for part, f, g, x in fails:
            at = next((k for k, c in enumerate(order, 1) if f[c]), 6)
            for k, c in enumerate(order, 1):
                row = out[part, "".join(order), k]
                for j, v in enumerate((at > k, at == k, f[c] and at < k, f[c] and sum(f.values()) == 1, at == k and g, at == k and x)):
                    row[j] += v
                shapley[part, c] += at == k
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_replay_by_hand(spark):
    rng = random.Random(5)
    texts = [None, "", "same few words", "SHOUT HERE", "100% sure", " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k % 60}" for k in range(130)), " ".join(f"W{k}" for k in range(101)) + " #1", "tail not a space \x0b\x0c x"]
    rows = [(rng.choice([None, k, k % 7]), rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(60)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    want = literal_audit(rows, labels)
    for extra in (False, True):
        assert {tuple(r) for r in audit_rows(spark, rows, labels, extra).collect()} == want
    assert audit_rows(spark, [], labels).count() == 0
    assert {tuple(r) for r in audit_rows(spark, rows, []).collect()} == literal_audit(rows, [])


def literal_hits(documents, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[k : k + 10])].add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in documents:
        ws, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if got := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(ws), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_windows_found_as_by_hand(spark, broadcast_rows):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(["a", "b", "c", "É", "été9"], [6, 3, 1, 1, 1], k=n))
    items = [(k % 25, text(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 30]))) for k in range(40)] + [(None, "only this one, here"), (90, None), (91, ""), (92, "..."), (93, "x-y Z")]
    documents = [(k, text(rng.choice([0, 1, 5, 12, 60]))) for k in range(60)]
    long = [t for _, t in items if t and len(t.split()) > 9]
    documents += [(100 + k, f"{text(4)}. {rng.choice(long).upper()}! {rng.choice(long)[:-1]} {text(3)}") for k in range(40)]
    documents += [(300, "Only THIS one; here"), (300, "Only THIS one; here"), (None, "x y z"), (None, None), (301, "x_y_zz"), (302, "only this one here " * 300)]
    d = spark.createDataFrame(documents, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "place", "n", "gram", "items")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(2))
    found = decontaminate.contamination(d, b, broadcast_rows=broadcast_rows)
    assert sorted(map(tuple, found.collect()), key=str) == literal_hits(documents, items)
    assert sorted(map(tuple, decontaminate.contamination(d, b.limit(0), broadcast_rows=broadcast_rows).collect()), key=str) == literal_hits(documents, [])
    assert decontaminate.contamination(d.limit(0), b, broadcast_rows=broadcast_rows).count() == 0


def test_decontamination_edges(spark):
    items = [(1, "word and other word"), (2, "x" * 50_000)]
    for extra in (False, True):
        found = decontaminate.contamination(docs(spark, EDGES, extra), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, found.collect()), key=str) == literal_hits(EDGES, items)


def literal_links(texts):
    """Per text: counts, groups and links by two pointers over whole texts, with the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    byte = {c: b for c, b in __import__("mnemion.llm.bpe", fromlist=["byte_symbols"]).byte_symbols().items()}
    s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    size_a = lambda i: len(t.id_to_token(i))
    bytes_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, s.encode(x)) if x else ([], [])
        raw = (" " + (x or "")).encode()
        if not x or b"".join(map(bytes_b, b)) != raw or bytes(byte[c] for i in a for c in t.id_to_token(i)) != raw:
            out.append((0, 0, 0, [], ""))
            continue
        i = j = 0
        ends, links, groups, now = [size_a(a[0]), len(bytes_b(b[0]))], [], [], ([str(a[0])], [str(b[0])])
        while True:
            links.append((a[i], b[j]))
            step = ends[0] <= ends[1], ends[1] <= ends[0]
            if all(step):
                groups.append("|".join(map(",".join, now)))
                now = ([], [])
            i, j = i + step[0], j + step[1]
            if i == len(a):
                break
            if step[0]:
                ends[0] += size_a(a[i])
                now[0].append(str(a[i]))
            if step[1]:
                ends[1] += len(bytes_b(b[j]))
                now[1].append(str(b[j]))
        out.append((len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest()))
    return out


def literal_alignment(rows):
    found = literal_links([t for _, t in rows])
    count = Counter(p for *_, links, _ in found for p in set(links))
    top_a, top_b = Counter(), Counter()
    for (a, b), n in count.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    return sorted(
        ((i, n_a, n_b, n_g, len(links), sum(count[p] == top_a[p[0]] for p in links), sum(count[p] == top_b[p[1]] for p in links), sum(count[p] for p in links), sha) for (i, _), (n_a, n_b, n_g, links, sha) in zip(rows, found, strict=True)),
        key=str,
    )


HARD = [" two  spaces\n\n tab\t end ", "it's 'll 're\r\n  x", "<|endoftext|> <s></s><unk> <0x41>", "日本語 テスト\x00 \x85 é é", "literal ▁ mark", "　wide　 space\x1c end", " ", "\n", "x" * 3000 + " " * 200 + "y\n" * 50, "\U0001f600 \U0001f468‍\U0001f469", "a,b;c|d", "one space behind ", "two  ", "tab\t "]


@pytest.mark.parametrize("block_rows", [align.BLOCK_ROWS, 40])
def test_alignment_equals_two_pointers(spark, block_rows, monkeypatch):
    rng = random.Random(2)
    words = ["the", "The", "anatomy", "internationalisation", "zxq", "café", "12,5", "don't", "\n", "<s>", "über"]
    rows = EDGES + list(enumerate(HARD, 20)) + [(50 + k, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for k in range(60)]
    d = docs(spark, rows).withColumns({c: F.lit(1) for c in ("pair", "pairs", "n_a", "t", "i", "__row", "n")})
    found = align.align(d, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), block_rows=block_rows)
    assert sorted(map(tuple, found.collect()), key=str) == literal_alignment(rows)
    assert align.align(d.limit(0), tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(align, "SLICE_CHARS", 10)
    texts = ["a" * n for n in (3, 4, 9, 30, 0, 1)] + [None]
    bounds = list(align._slices(texts))
    assert [i for lo, hi in bounds for i in range(lo, hi)] == list(range(len(texts)))
    assert list(align._slices([])) == []
