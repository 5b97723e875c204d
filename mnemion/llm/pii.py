"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust.

Regular expressions propose spans. E-mail addresses, IP addresses, card numbers (Luhn) and international phone numbers are
always reported (the base kinds). Others, such as bank account numbers (mod 97), national numbers, and phone or card numbers
in looser forms, get a score from their pattern and checksum, raised or lowered by words near them, and are reported from
THRESHOLD on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import schema

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national", "local_phone", "passport")
THRESHOLD = 0.5
NEAR = 48  # characters on either side that are read as context

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits are taken whole, so that a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may be an account number and further words in capitals; `account` finds where it ends.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
#: Characters of an account number by country; others may have any length from 15 to 34.
IBAN_LENGTHS = dict(AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28, IE=22, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19, SK=24, TR=26)
NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")
#: (kind, pattern, score of the pattern alone, context words that add, words that take away)
PROPOSE = (
    ("iban", IBAN, 0.2, ("iban", "account", "bank", "konto", "compte", "cuenta"), ("isbn", "version")),
    ("national", NATIONAL, 0.3, ("ssn", "social", "security", "taxpayer", "tin"), ("part", "order", "isbn", "version")),
    ("local_phone", LOCAL_PHONE, 0.3, ("phone", "tel", "call", "mobile", "fax", "cell", "telefon"), ("order", "isbn", "part", "ref")),
    ("passport", PASSPORT, 0.1, ("passport", "reisepass", "passeport", "pasaporte"), ("model", "part", "order")),
)
BONUS, CHECKSUM, MALUS = 0.4, 0.6, 0.4
DIGITS = {ord(c): None for c in " ().-"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def account(text: str, start: int, end: int) -> int | None:
    """Where the account number that begins at start ends: the longest one up to end whose length and check digits are right."""
    wanted = IBAN_LENGTHS.get(text[start : start + 2])
    while end < len(text) and text[end].isascii() and text[end].isalnum():  # not within a word
        end = text.rfind(" ", start, end)
        if end < 0:
            return None
    while end > start:
        n = end - start - text.count(" ", start, end)
        if n < 15:
            return None
        if n == (wanted or n) and mod97(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return None


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost, non-overlapping search would find them, but starting from each @, so that long words cost once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, end)):
            yield start, (end := m.end())
            free = end
        elif start < at:
            free = max(free, at)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", a, z) for a, z in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(n := x.lstrip("0")) < 4 and int(n or 0) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(DIGITS)) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(m[0].translate(DIGITS)) - 1 <= 15]
    return out


DIGIT = re.compile("[0-9]")


def score(kind: str, prior: float, near: str, plus: tuple[str, ...], minus: tuple[str, ...]) -> float:
    """The pattern's score, with checksum and context. Context words count whole."""
    s = prior + CHECKSUM * (kind == "iban")  # whose check digits were tested
    words = set(re.findall(r"[a-z]+", near.lower()))
    return max(0.0, min(1.0, s + BONUS * any(w in words for w in plus) - MALUS * any(w in words for w in minus)))


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the further kinds that reach THRESHOLD and touch no base span."""
    out: list[tuple[str, int, int]] = []
    if not DIGIT.search(text):
        return out
    taken = merged([(a, z) for _, a, z in base])
    for kind, pattern, prior, plus, minus in PROPOSE:
        starts, new = [a for a, _ in taken], []
        for m in pattern.finditer(text):
            a, z = m.span()
            if kind == "iban" and (z := account(text, a, z)) is None:
                continue
            at = bisect_left(starts, z)  # the last one that begins before z
            if at and taken[at - 1][1] > a:
                continue
            near = text[max(0, a - NEAR) : a] + " " + text[z : z + NEAR]
            if score(kind, prior, near, plus, minus) >= THRESHOLD:
                out.append((kind, a, z))
                new.append((a, z))
        taken = merged(taken + new)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, entities.

    Counts and base_sha256 are of the base kinds; spans adds those of the method. entities has (kind, start, end, value).
    Null and empty texts have none (the digest is that of the empty string). Long texts are read once per kind. Repeated
    rows are each searched, null ids passed through, other columns left aside; an empty table gives an empty result.
    """
    names = [f"n_{k}" for k in BASE]
    kinds = {k: i for i, k in enumerate(BASE + ADDED)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, found = [[] for _ in BASE], [], [], []
            for x in b.column(1).to_pylist():
                base = base_spans(x) if x else []
                every = base + added_spans(x, base) if x else []
                every.sort(key=lambda s: (kinds[s[0]], s[1]))
                for n, k in zip(counts, BASE, strict=True):
                    n.append(sum(s[0] == k for s in base))
                digests.append(sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                found.append([{"kind": k, "start": a, "end": z, "value": x[a:z]} for k, a, z in every])
            entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(found, entity)], [id_col, *names, "base_sha256", "spans", "entities"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, schema(f"`{id_col}` long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, entities array<struct<kind:string,start:long,end:long,value:string>>"))
