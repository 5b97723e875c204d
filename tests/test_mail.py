from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from email.message import EmailMessage

from pyspark.sql import functions as F

from mnemion.operators import mail as op
from mnemion.sources import mail as src


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)


def mailbox(folder):
    m = EmailMessage()
    m["Message-ID"], m["From"], m["To"], m["Cc"] = "<a@x>", "Ann Öhm <Ann@X.org>", "bob@y.org, \"C, D\" <c@z.org>", "e@e.org"
    m["Subject"], m["Date"], m["References"], m["In-Reply-To"] = "Réunion lundi", "Mon, 01 Jan 2024 10:00:00 +0200", "<r1@x> <r2@x>", "<r2@x>"
    m.set_content("Plain body é\n")
    m.add_alternative("<p>Html</p>", subtype="html")
    m.add_attachment(b"12345", maintype="application", subtype="pdf", filename="f.pdf")
    write(folder, "a.eml", m.as_bytes())
    h = EmailMessage()
    h["From"] = "z@z.org"
    h.set_content("<div>One &amp; two</div><script>no</script><p>three</p>", subtype="html")
    write(folder, "b.eml", h.as_bytes())
    write(folder, "c.eml", bytes(range(256)) * 20)
    write(folder, "d.eml", b"\n\n")
    return folder


def test_mail_files(spark, tmp_path):
    folder = mailbox(tmp_path / "in")
    rows = {r.path.rsplit("/", 1)[1]: r for r in src.parse_mail(src.files(spark, str(folder), "*.eml")).collect()}
    a, b = rows["a.eml"], rows["b.eml"]
    assert (a.message_id, a.subject, a.sender.address, a.sender.name) == ("a@x", "Réunion lundi", "ann@x.org", "Ann Öhm")
    assert [x.address for x in a.recipients] == ["bob@y.org", "c@z.org"] and [x.address for x in a.cc] == ["e@e.org"] and a.recipients[1].name == "C, D"
    assert a.date == datetime(2024, 1, 1, 8) or a.date.astimezone(UTC) == datetime(2024, 1, 1, 8, tzinfo=UTC)
    assert (a.in_reply_to, a.references, a.body) == ("r2@x", ["r1@x", "r2@x"], "Plain body é")
    assert [tuple(x) for x in a.attachments] == [("f.pdf", "application/pdf", 5, False, None)]
    assert b.body == "One & two\nthree" and b.message_id.startswith("generated-") and b.date is not None
    assert all(rows[k].error and rows[k].message_id is None for k in ("c.eml", "d.eml")) and a.error is None
    q = src.parse_mail(src.files(spark, str(folder), "*.eml", stream=True)).writeStream.format("memory").queryName("mail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.message_id, r.error) for r in spark.table("mail").collect()} == {(r.path, r.message_id, r.error) for r in rows.values()}


NOTE = """---
title: "A note"
Tags: [#work, 'deep work', area/one]
aliases:
  - First
  - "Second one"
status: open
---
# Head *one*
Text with [[Target#Part|shown]], ![[image.png]] and [[Other^block1]] #inline #nested/tag not#tag
## Below
- [x] done
  - [ ] open one
> [!Warning]- Careful now
> body
"""


def test_notes(spark, tmp_path):
    folder = tmp_path / "notes"
    write(folder, "one.md", NOTE.encode())
    write(folder, "two words.md", b"no front matter\n")
    write(folder, "head.md", "\r\n".join(["---", "tags: solo", "---", "# Only head", "x"]).encode())
    write(folder, "bad.md", b"\xff\xfe\x00bad")
    write(folder, "empty.md", b"\n")
    rows = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in src.parse_notes(src.files(spark, str(folder), "*.md")).collect()}
    one = rows["one.md"]
    assert (one.title, one.aliases, one.front) == ("A note", ["First", "Second one"], {"title": '"A note"', "status": "open"})
    assert one.tags == ["work", "deep work", "area/one", "inline", "nested/tag"]
    assert [tuple(x) for x in one.links] == [("Target", "shown", False, "Part", None), ("image.png", None, True, None, None), ("Other", None, False, None, "block1")]
    assert [tuple(x) for x in one.tasks] == [("done", True, 0), ("open one", False, 1)] and [tuple(x) for x in one.callouts] == [("warning", "-", "Careful now")]
    assert [tuple(x) for x in one.headings] == [(1, "Head *one*"), (2, "Below")] and one.body.startswith("# Head")
    assert rows["two words.md"].title in ("two words", "two%20words") and rows["two words.md"].tags == [] and rows["head.md"].title == "Only head" and rows["head.md"].tags == ["solo"]
    assert rows["bad.md"].error == "not UTF-8" and rows["bad.md"].title is None and rows["empty.md"].error is None and rows["empty.md"].body == "\n"


def literal_threads(messages):
    """Message by message: parents by header, then references; lost parents adopted."""
    first = {}
    for m in sorted(messages, key=lambda m: (m[3], m[1] is not None, m[1] or "")):
        first.setdefault(m[0], m)
    parent = {}
    for i, reply, refs, *_ in first.values():
        named = [x for x in [reply, *reversed(refs or [])] if x is not None and x != i]
        parent[i] = next((x for x in named if x in first), reply if reply != i else None)
    date, sender, subject = ({i: m[k] for i, m in first.items()} for k in (3, 4, 5))
    for p in sorted({p for p in parent.values() if p is not None and p not in first}):
        d, _, s = min((date[i], i, subject[i]) for i in first if parent[i] == p)
        date[p], sender[p], subject[p], parent[p] = d - timedelta(minutes=30), "unknown@unknown", s, None
    out = {}
    for i in parent:
        at, depth, seen = i, 0, {i}
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
            if at in seen:
                break
            seen.add(at)
        else:
            out[i] = (at, depth)
    return out, parent, date, sender, subject


def test_threads_equal_literal_loop(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    messages = []
    for k in range(120):
        lost = rng.random() < 0.2
        reply = None if rng.random() < 0.2 else f"m{rng.randrange(max(1, k))}" if not lost else f"gone{rng.randrange(6)}"
        refs = [f"m{rng.randrange(120)}" if rng.random() < 0.5 else f"gone{rng.randrange(6)}" for _ in range(rng.randrange(3))]
        messages.append((f"m{k}", reply, refs if rng.random() < 0.8 else None, start + timedelta(minutes=rng.randrange(5000), seconds=k), f"p{rng.randrange(5)}@x", rng.choice(["Re: Re[2]: Plan", "Fwd: plan", "", "Reply"])))
    messages += [("c1", "c2", None, start, "q@x", "circle"), ("c2", "c1", None, start, "q@x", "circle"), ("self", "self", ["self"], start, "q@x", None), messages[5]]
    rows = spark.createDataFrame(messages, "message_id string, in_reply_to string, references array<string>, date timestamp, sender string, subject string")
    placed = op.placed(rows)
    want, parent, date, sender, subject = literal_threads(messages)
    assert {r.message_id: (r.thread, r.depth) for r in placed.collect()} == want
    table = {r.thread: r for r in op.thread_table(placed).collect()}
    people = {(r.thread, r.sender): (r.role, r.messages) for r in op.participants(placed).collect()}
    assert set(table) == {t for t, _ in want.values()}
    for t, r in table.items():
        mine = [i for i, (x, _) in want.items() if x == t]
        took = [(date[i] - date[parent[i]]).total_seconds() / 60 for i in mine if parent[i] and date[i] > date[parent[i]]]
        replies = [sum(parent[j] == i for j in want) for i in mine]
        assert (r.messages, r.participants, r.depth, r.branches) == (len(mine), len({sender[i] for i in mine}), max(want[i][1] for i in mine), sum(n > 1 for n in replies))
        assert abs((r.minutes_mean or 0) - (sum(took) / len(took) if took else 0)) < 1e-6 and (r.start, r.last) == (min(date[i] for i in mine), max(date[i] for i in mine))
        assert people[t, sender[t]][0] == "initiator"
    assert op.placed(rows.limit(0)).count() == 0
    subjects = spark.createDataFrame([("Re: Re[2]: Plan",), ("Fwd:plan",), (None,), ("Reply",)], "s string").select(op.plain_subject(F.col("s")).alias("s"))
    assert [r.s for r in subjects.collect()] == ["Plan", "plan", "", "Reply"]
