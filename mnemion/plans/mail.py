"""Queries of mail and notes, made of the conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.operators import mail as op
from mnemion.sources.mail import parse_mail, parse_notes
from mnemion.sources.tables import table

# Turns as messages. Every seventh replies to a message that isn't there; of these the even ones name the first turn as a reference.
MESSAGE = """format_string('c%d.%d@talk', conv_id, turn) AS id, format_string('c%d.0@talk', conv_id) AS root, turn % 7 = 6 AS lost,
timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(conv_id), int(turn * 10 - if(turn % 4 = 3, 25, 0)), 0) AS date"""
HEADERS = """concat('Message-ID: <', id, '>\nFrom: ', role, ' <', upper(role), '@talk.org>\nTo: all@talk.org\nSubject: Re: Fwd: Talk ', conv_id, '\nDate: ', date_format(date, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0000\n',
if(turn > 0, concat('In-Reply-To: <', if(lost, concat('gone', conv_id, '@talk'), if(turn % 3 = 2, root, format_string('c%d.%d@talk', conv_id, turn - 1))), '>\n'), ''), if(turn > 0 and (not lost or turn % 2 = 0), concat('References: <', root, '> <other', conv_id, '@talk>\n'), ''),
'Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n', coalesce(text, ''))"""


def _mail(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").selectExpr("*", *[x.strip() for x in _split(MESSAGE)])
    return parse_mail(m.select(F.col("id").alias("path"), F.col("date").alias("modificationTime"), F.expr(HEADERS).cast("binary").alias("content")))


def _split(text: str) -> list[str]:
    """The expressions of a select list: at commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def parsed_mail(spark: SparkSession, d: str) -> DataFrame:
    m = _mail(spark, d)
    return m.select("message_id", "in_reply_to", F.array_join("references", " ").alias("refs"), "subject", F.col("sender.address").alias("address"), F.col("sender.name").alias("name"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.length("body").cast("long").alias("size"), "error")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return op.placed(_mail(spark, d).select("message_id", "in_reply_to", "references", "date", F.col("sender.address").alias("sender"), "subject"))


def mail_threads(spark: SparkSession, d: str) -> DataFrame:
    t = op.thread_table(_placed(spark, d))
    return t.select("thread", "subject", "messages", "participants", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("days", 9).alias("days"), "depth", "branches", F.round("minutes_total", 6).alias("minutes_total"), F.round("minutes_mean", 6).alias("minutes_mean"))


def mail_participants(spark: SparkSession, d: str) -> DataFrame:
    p = op.participants(_placed(spark, d))
    return p.select("thread", "sender", "role", "messages", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")])


NOTE = """concat('---\ntitle: "Talk ', conv_id, '"\nTags: [#', role, ', ''talk/', conv_id, ''']\naliases:\n  - t', turn, '\n  - "turn ', turn, '"\nstatus: open\n---\n# Turn ', turn, '\nSee [[Talk ', conv_id, '#Turn ', turn - 1, '|before]], ![[img', turn, '.png]] and [[Other^b', turn, ']] #said #', role, '\n',
if(turn % 2 = 0, concat('- [x] read ', turn, '\n  - [ ] answer\n'), ''), '> [!Note]+ ', role, ' speaks\n', translate(coalesce(text, ''), '#[]>*+-\r', ''))"""


def parsed_notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.format_string("talk/c%d.%d.md", "conv_id", "turn").alias("path"), F.expr(NOTE).alias("content"))
    n = parse_notes(c)
    joined = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[p].cast("string") for p in parts])), ";")
    return n.select("path", "title", F.element_at("front", "status").alias("status"), F.array_join("aliases", ";").alias("aliases"), F.array_join("tags", ";").alias("tags"), joined("links", "target", "display", "embed", "section", "block").alias("links"), joined("tasks", "text", "checked", "level").alias("tasks"), joined("callouts", "kind", "fold", "title").alias("callouts"), joined("headings", "level", "text").alias("headings"), F.length("body").cast("long").alias("size"), "error")


QUERIES = {f.__name__: f for f in (parsed_mail, mail_threads, mail_participants, parsed_notes)}

M = """m AS (SELECT *, 'c' || conv_id || '.' || turn || '@talk' AS id, 'c' || conv_id || '.0@talk' AS root, turn % 7 = 6 AS lost, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes((turn * 10 - CASE WHEN turn % 4 = 3 THEN 25 ELSE 0 END)::INT) AS date FROM conversations),
n AS (SELECT *, CASE WHEN turn = 0 THEN NULL WHEN lost THEN 'gone' || conv_id || '@talk' WHEN turn % 3 = 2 THEN root ELSE 'c' || conv_id || '.' || (turn - 1) || '@talk' END AS reply, CASE WHEN turn > 0 AND (NOT lost OR turn % 2 = 0) THEN root || ' other' || conv_id || '@talk' ELSE '' END AS refs, lower(role) || '@talk.org' AS sender FROM m)"""
THREADS = f"""{M}, p AS (SELECT id, CASE WHEN lost AND turn % 2 = 0 AND turn > 0 THEN root ELSE reply END AS parent, date, sender, 'Talk ' || conv_id AS subject FROM n),
q AS (SELECT * FROM p UNION ALL SELECT parent, NULL, min(date) - INTERVAL 30 MINUTES, 'unknown@unknown', any_value(subject) FROM p WHERE parent LIKE 'gone%' GROUP BY parent),
r AS (SELECT id, id AS thread, 0 AS depth FROM q WHERE parent IS NULL UNION ALL SELECT q.id, thread, depth + 1 FROM r JOIN q ON q.parent = r.id)"""

SQL = {
    "parsed_mail": f"WITH {M} SELECT id AS message_id, reply AS in_reply_to, refs, 'Re: Fwd: Talk ' || conv_id AS subject, sender AS address, role AS name, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, length(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))) AS size, NULL AS error FROM n",
    "mail_threads": f"""WITH RECURSIVE {THREADS}, k AS (SELECT parent AS id, count(*) AS replies FROM q GROUP BY 1), t AS (SELECT r.thread, r.depth, q.*, k.replies, epoch(q.date - u.date) / 60 AS took FROM r JOIN q ON q.id = r.id LEFT JOIN q u ON u.id = q.parent LEFT JOIN k ON k.id = q.id)
        SELECT thread, any_value(subject) AS subject, count(*) AS messages, count(DISTINCT sender) AS participants, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS start, round(epoch(max(date) - min(date)) / 86400, 9) AS days, max(depth) AS depth, count(*) FILTER (replies > 1) AS branches,
        round(sum(took) FILTER (took > 0), 6) AS minutes_total, round(avg(took) FILTER (took > 0), 6) AS minutes_mean FROM t GROUP BY 1""",
    "mail_participants": f"""WITH RECURSIVE {THREADS} SELECT thread, sender, CASE WHEN min(depth) = 0 THEN 'initiator' ELSE 'participant' END AS role, count(*) AS messages, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last FROM r JOIN q ON q.id = r.id GROUP BY 1, 2""",
    "parsed_notes": """SELECT 'talk/c' || conv_id || '.' || turn || '.md' AS path, 'Talk ' || conv_id AS title, 'open' AS status, 't' || turn || ';turn ' || turn AS aliases, role || ';talk/' || conv_id || ';said' AS tags,
        'Talk ' || conv_id || '/before/false/Turn ' || (turn - 1) || ';img' || turn || '.png/true;Other/false/b' || turn AS links, CASE WHEN turn % 2 = 0 THEN 'read ' || turn || '/true/0;answer/false/1' ELSE '' END AS tasks, 'note/+/' || role || ' speaks' AS callouts, '1/Turn ' || turn AS headings,
        length('# Turn ' || turn || chr(10) || 'See [[Talk ' || conv_id || '#Turn ' || (turn - 1) || '|before]], ![[img' || turn || '.png]] and [[Other^b' || turn || ']] #said #' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN '- [x] read ' || turn || chr(10) || '  - [ ] answer' || chr(10) ELSE '' END
          || '> [!Note]+ ' || role || ' speaks' || chr(10) || translate(coalesce(text, ''), '#[]>*+-' || chr(13), '')) AS size, NULL AS error FROM conversations""",
}
