"""Mail and note files as tables, in batch and as a stream: Spark lists, deals and reads the files, one row a file.

A file that can't be read as what it should be costs its own row: `error` says why and its other columns are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

ADDRESS = "struct<address:string,name:string>"
MAIL = f"""path string, message_id string, subject string, sender {ADDRESS}, recipients array<{ADDRESS}>, cc array<{ADDRESS}>, bcc array<{ADDRESS}>, reply_to array<{ADDRESS}>, date timestamp, in_reply_to string,
references array<string>, body string, attachments array<struct<filename:string,content_type:string,size:long,inline:boolean,content_id:string>>, error string"""
FIELDS = "path message_id subject sender recipients cc bcc reply_to date in_reply_to references body attachments error"
FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, glob: str, stream: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder. Spark's reader has no row for a file of no bytes."""
    reader = spark.readStream.schema(FILES) if stream else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _addresses(value: object) -> list[dict]:
    from email.header import decode_header, make_header
    from email.utils import getaddresses

    found = getaddresses([str(make_header(decode_header(str(value))))]) if value else []
    return [{"address": a.lower(), "name": n or None} for n, a in found if "@" in a]


def _plain(html: str) -> str:
    """The text of simple HTML mail, blocks on lines of their own."""
    import re
    from html import unescape

    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", html)
    html = re.sub(r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n", html)
    return unescape(re.sub(r"<[^<>]*>", "", html)).strip()


def _message(raw: bytes, when: object) -> dict:
    from email import message_from_bytes, policy
    from email.utils import parsedate_to_datetime
    from hashlib import sha256

    m = message_from_bytes(raw, policy=policy.default)
    if not any(m.get(h) for h in ("Message-ID", "From", "Date")):
        raise ValueError("no headers of a message")
    bare = lambda x: str(x or "").strip().strip("<>").strip()
    try:
        date = parsedate_to_datetime(str(m.get("Date")))
    except (TypeError, ValueError):
        date = when
    plain = html = None
    attachments = []
    for part in m.walk():
        kind, place, name = part.get_content_type(), part.get_content_disposition(), part.get_filename()
        if place in ("attachment", "inline") and name:
            size = len(part.get_payload(decode=True) or b"")
            attachments.append({"filename": name, "content_type": kind, "size": size, "inline": place == "inline", "content_id": bare(part.get("Content-ID")) or None})
        if place != "attachment" and kind in ("text/plain", "text/html"):
            text = (part.get_payload(decode=True) or b"").decode(_charset(part.get_content_charset()), "replace").replace("\r\n", "\n")
            if kind == "text/plain":
                plain = text if plain is None else plain
            else:
                html = text if html is None else html
    body = plain.strip() if plain is not None else _plain(html) if html is not None else ""
    return {
        "message_id": bare(m.get("Message-ID")) or f"generated-{sha256(raw).hexdigest()[:32]}@local", "subject": str(m.get("Subject") or "").strip() or None,
        "sender": (_addresses(m.get("From")) or [{"address": "unknown@unknown", "name": None}])[0], "recipients": _addresses(m.get("To")), "cc": _addresses(m.get("Cc")), "bcc": _addresses(m.get("Bcc")), "reply_to": _addresses(m.get("Reply-To")),
        "date": date, "in_reply_to": bare(m.get("In-Reply-To")) or None, "references": [r for r in map(bare, str(m.get("References") or "").split()) if r], "body": body, "attachments": attachments, "error": None,
    }


def _charset(name: str | None) -> str:
    import codecs

    try:
        return codecs.lookup(name or "utf-8").name
    except LookupError:
        return "utf-8"


def parse_mail(rows: DataFrame) -> DataFrame:
    """One row per row of (path, modificationTime, content): the message, or an error.

    A message without an id is named by its content's digest, so a file read again keeps its name; one without a valid date
    takes the file's time. Bodies prefer plain text. Attachments are described, not kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        names = FIELDS.split()
        for x in batches:
            out = []
            for path, when, raw in zip(x["path"], x["modificationTime"], x["content"], strict=True):
                try:
                    row = _message(bytes(raw), when)
                    row["date"] = pd.Timestamp(row["date"]).tz_localize("UTC") if pd.Timestamp(row["date"]).tzinfo is None else pd.Timestamp(row["date"]).tz_convert("UTC")
                except Exception as bad:  # whatever a broken file brings about is its row's error
                    row = dict.fromkeys(names) | {"error": f"{type(bad).__name__}: {bad}"}
                out.append(row | {"path": path})
            frame = pd.DataFrame(out, columns=names)
            frame["date"] = pd.to_datetime(frame["date"], utc=True)
            yield frame

    return rows.select("path", "modificationTime", "content").mapInPandas(run, MAIL)


#: What marks front matter, links, tags, tasks, callouts and headings in notes.
FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)"
LINK = r"(!?)\[\[([^\]]+?)\]\]"
TAG = r"(?U)(?:^|(?<=\s))#([\w-]+(?:/[\w-]+)*)"
TASK = r"(?m)^([ \t]*)[-*+][ \t]+\[([ xX])\][ \t]+(.+)$"
CALLOUT = r"(?m)^>[ \t]*\[!([\w-]+)\][ \t]*([+-]?)[ \t]*(.*)$"
HEADING = r"(?m)^(#{1,6})[ \t]+(.+)$"
ENTRY = r"(?m)^([A-Za-z_][\w -]*):[ \t]*(.*(?:\n[ \t]*-[ \t]+.*)*)$"


def _all(text: Column, pattern: str, /, **groups: int) -> Column:
    """Structs of the groups of every match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(k) for k, g in groups.items()]))


def _listed(value: Column) -> Column:
    """The items of a front matter value: [a, b], dashes on lines, or one."""
    lines = F.regexp_replace(F.regexp_replace(value, r"(?m)^[ \t]*-[ \t]+", "\u0001"), r"\n", "")
    inner = F.regexp_extract(value, r"^\[([\s\S]*)\]$", 1)
    items = F.when(F.rlike(value, F.lit(r"^\[[\s\S]*\]$")), F.split(inner, ",")).when(F.contains(lines, F.lit("\u0001")), F.split(lines, "\u0001")).otherwise(F.array(value))
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"'#]+|[\"'#]+$", "")))
    return F.filter(clean, lambda x: x != "")


def parse_notes(rows: DataFrame) -> DataFrame:
    """One row per row of (path, content): front matter, title, aliases, tags, links, tasks, callouts, headings, body, error.

    Built-in functions only. Front matter is entries of one line, [a, b] or lines of dashes; other keys than tags and aliases
    are in `front`. The title is that of the front matter, else the first heading, else the file's name. Content that isn't
    UTF-8 is an error.
    """
    text = F.decode("content", "UTF-8") if rows.schema["content"].dataType.typeName() == "binary" else F.col("content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    whole = F.when(valid, F.regexp_replace(text, r"\r\n", "\n"))
    raw = F.regexp_extract(F.col("__text"), FRONT, 1)
    body = F.regexp_replace(F.col("__text"), FRONT, "")
    kept = rows.select("path", valid.alias("__valid"), whole.alias("__text")).select("path", "__valid", raw.alias("__front"), body.alias("body"))
    entry = _all(F.col("__front"), ENTRY, k=1, v=2)
    value = lambda k: F.coalesce(F.get(F.filter(F.col("__entries"), lambda e: F.lower(e.k) == k), F.lit(0)).v, F.lit(""))
    kept = kept.withColumn("__entries", F.coalesce(entry, F.array().cast("array<struct<k:string,v:string>>")))
    part = lambda x, sep: F.trim(F.element_at(F.split(x, sep, 2), 1))
    rest = lambda x, sep: F.when(F.rlike(x, F.lit(sep)), F.trim(F.element_at(F.split(x, sep, 2), 2)))

    def link(m: Column) -> Column:
        inner = F.regexp_extract(m, LINK, 2)
        target = part(inner, r"\|")
        at = part(target, r"\^")
        return F.struct(part(at, "#").alias("target"), rest(inner, r"\|").alias("display"), (F.regexp_extract(m, LINK, 1) == "!").alias("embed"), rest(at, "#").alias("section"), rest(target, r"\^").alias("block"))

    links = F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(0)), link)
    tags = F.array_distinct(F.concat(_listed(value("tags")), F.regexp_extract_all("body", F.lit(TAG), F.lit(1))))
    tasks = F.transform(_all(F.col("body"), TASK, space=1, mark=2, text=3), lambda t: F.struct(F.trim(t.text).alias("text"), (F.lower(t.mark) == "x").alias("checked"), F.floor(F.length(t.space) / 2).cast("int").alias("level")))
    callouts = F.transform(_all(F.col("body"), CALLOUT, kind=1, fold=2, title=3), lambda c: F.struct(F.lower(c.kind).alias("kind"), c.fold.alias("fold"), F.trim(c.title).alias("title")))
    headings = F.transform(_all(F.col("body"), HEADING, marks=1, text=2), lambda h: F.struct(F.length(h.marks).alias("level"), F.trim(h.text).alias("text")))
    front = F.map_from_entries(F.transform(F.filter("__entries", lambda e: ~F.lower(e.k).isin("tags", "aliases")), lambda e: F.struct(F.lower(F.trim(e.k)).alias("key"), F.trim(e.v).alias("value"))))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = kept.select("path", front.alias("front"), _listed(value("aliases")).alias("aliases"), tags.alias("tags"), links.alias("links"), tasks.alias("tasks"), callouts.alias("callouts"), headings.alias("headings"), "body", value("title").alias("__title"), "__valid")
    out = out.withColumn("title", F.coalesce(F.nullif(F.get(_listed(F.col("__title")), F.lit(0)), F.lit("")), F.get("headings", F.lit(0)).text, stem))
    error = F.when(F.col("__valid"), F.lit(None)).otherwise("not UTF-8").alias("error")
    only = lambda c: F.when(F.col("__valid"), F.col(c)).alias(c)
    return out.select("path", *[only(c) for c in ("title", "front", "aliases", "tags", "links", "tasks", "callouts", "headings", "body")], error)
