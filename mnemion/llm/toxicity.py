"""Toxicity by a weighted finite-state pattern grammar.

Words pass a lexical transducer that gives each a symbol (insult, threat, target, negation, report, quote, link, filler, stop,
other) and a weight. Small transducers read the symbols, each a table of states: words since a target, since a negation,
since a reporting verb and since another insult or threat, whether a quotation is open, and whether an insult would be a
predicate ("you are such a ..."). Their composition, built lazily state by state, runs over a clause from the left, and that
of those which also look ahead from the right. A hit's weight is scaled by the states that it meets: a target raises it,
negation and reported speech lower it, and a threat counts only with a target. A clause matches if one of its hits has a
target, is a predicate or stands beside another hit. Words without such company count only where they come back in several
clauses, so a word on its own decides nothing. The lexicon's seeds are fixed; further words and stems, in any language, are
learned from labelled texts by the ratio of their rates, and so are the weights of a text's features. Learning uses at most
2 * SAMPLE_ROWS labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import hashed_sample, schema, small_batches

SAMPLE_ROWS = 6000  # labelled rows that are learned from, chosen by a hash of their id
LEAST_TEXTS = 3  # toxic texts that a learned pattern is in
LEAST_GAIN = 14.0  # its log-likelihood gain over texts (G^2)
LEAST_RATIO = 4.0  # its rate in toxic texts over that in others
PATTERNS = 400
STEMS = range(4, 10)  # lengths of stems, in letters
SEED_WEIGHT = math.log(50.0)

#: Fixed seed lists.
INSULTS = "idiot moron imbecile stupid dumb fool loser scum trash garbage clown worthless pathetic disgusting vermin filth jerk dimwit bastard freak coward degenerate parasite".split()
THREATS = "kill hurt destroy beat smash shoot stab burn crush murder strangle".split()
TARGETS = "you your yours yourself u ur he she they them him her his their these those people".split()
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't won't can't cannot neither nor without hardly".split()
REPORTS = "said says say saying claimed claims wrote writes called calls quoted quotes told reported alleged according".split()
LINKS = "am is are was were be been being i'm you're he's she's it's they're we're bist ist sind seid es est êtes eres son sois".split()
FILLERS = "a an the such so very really just pure total complete utter absolute nothing but most more all ein eine so sehr un une des très muy tan una".split()
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP, LINK, FILLER, OTHER = range(10)
LEET = str.maketrans("013457@$", "oieastas")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]|[\"“”«»]")
CLAUSE_WORDS = 24  # in a longer clause a hit sees what is fewer words away, and matches are counted together that are


SLICE = 1 << 20  # characters whose words are listed at once
SYMBOLS = 10
WORD_SYMBOLS = [x for x in range(SYMBOLS) if x not in (QUOTE, STOP)]


def since(symbols: tuple[int, ...], far: int) -> np.ndarray:
    """A transducer whose state is the number of words since one of the symbols, at most far."""
    table = np.empty((far + 1, SYMBOLS), int)
    for state in range(far + 1):
        table[state] = min(state + 1, far)
        table[state, QUOTE] = state
        table[state, STOP] = far
        table[state, list(symbols)] = 0
    return table


def quotation() -> np.ndarray:
    """State 1 inside quotation marks; a stop ends them."""
    table = np.repeat([[0], [1]], SYMBOLS, axis=1)
    table[:, QUOTE] = 1, 0
    table[:, STOP] = 0
    return table


def predicate() -> np.ndarray:
    """State 1 after a target or link, also with fillers between: what follows is said of someone or something."""
    table = np.zeros((2, SYMBOLS), int)
    table[:, [TARGET, LINK]] = 1
    table[1, [FILLER, QUOTE, NEGATION]] = 1
    return table


BESIDE = 2  # words between two hits of one phrase, and one
NEGATED = 4  # words that a negation reaches


class Composition:
    """Transducers run side by side. States of the composition are made when they are first met."""

    def __init__(self, tables: list[np.ndarray], start: tuple[int, ...]):
        self.tables = [t.tolist() for t in tables]
        self.states = [start]
        self.number = {start: 0}
        self.steps: dict[int, int] = {}

    def step(self, state: int, symbol: int) -> int:
        key = state * SYMBOLS + symbol
        if (to := self.steps.get(key)) is None:
            target = tuple(t[s][symbol] for t, s in zip(self.tables, self.states[state], strict=True))
            to = self.number.setdefault(target, len(self.states))
            if to == len(self.states):
                self.states.append(target)
            self.steps[key] = to
        return to

    def pause(self, state: int, words: int) -> int:
        """After so many other words."""
        for _ in range(min(words, CLAUSE_WORDS)):
            if (to := self.step(state, OTHER)) == state:
                break
            state = to
        return state


#: From the left: target, report, another hit, negation, quotation, predicate. From the right: the first three.
AROUND = [since((TARGET,), CLAUSE_WORDS), since((REPORT,), CLAUSE_WORDS), since((INSULT, THREAT), BESIDE + 1)]
LEFT = Composition([*AROUND, since((NEGATION,), NEGATED + 1), quotation(), predicate()], (CLAUSE_WORDS, CLAUSE_WORDS, BESIDE + 1, NEGATED + 1, 0, 0))
RIGHT = Composition(AROUND, (CLAUSE_WORDS, CLAUSE_WORDS, BESIDE + 1))


@dataclass
class Match:
    """Hits of a clause that are less than CLAUSE_WORDS apart from the first: matched if one has company."""

    place: int
    score: float = 0.0
    mass: float = 0.0  # its hits, scaled alike
    names: list[str] = field(default_factory=list)
    matched: bool = False


@dataclass
class Grammar:
    """Weights of words and stems, and of the document features. learned: word, or stem followed by *."""

    learned: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()
    targeted: float = 1.25
    negated: float = 0.1
    reported: float = 0.2
    seen: dict[str, tuple[int, float, str]] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[int, float, str]:
        """(symbol, weight, pattern) of a lower-cased word."""
        if (found := self.seen.get(word)) is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[word] = self._symbol(word)
        return found

    def _symbol(self, word: str) -> tuple[int, float, str]:
        if len(word) == 1 and word in ".!?;:\n":
            return STOP, 0.0, ""
        if word in "\"“”«»":
            return QUOTE, 0.0, ""
        forms = [word] if word.isalpha() else [word, word.translate(LEET)]
        for w in forms:
            if w in self.learned:
                return INSULT, self.learned[w], w
            for n in STEMS:
                if len(w) >= n and (stem := w[:n] + "*") in self.learned:
                    return INSULT, self.learned[stem], stem
            single = w.removesuffix("s")
            for form in (w, single):
                if form in INSULTS:
                    return INSULT, SEED_WEIGHT, form
                if form in THREATS:
                    return THREAT, SEED_WEIGHT, form
        if word in TARGETS:
            return TARGET, 0.0, ""
        if word in NEGATIONS:
            return NEGATION, 0.0, ""
        return (REPORT if word in REPORTS else LINK if word in LINKS else FILLER if word in FILLERS else OTHER), 0.0, ""

    def _clause(self, events: list[tuple[int, int, float, str]], out: list[Match]) -> None:
        """Adds the matches of a clause's symbols (words before, symbol, weight, name) to out."""
        if not any(e[1] <= THREAT for e in events):
            return
        lefts, state = [], 0
        for gap, kind, _, _ in events:
            state = LEFT.pause(state, gap)
            lefts.append(state)
            state = LEFT.step(state, kind)
        rights, state = [], 0
        for gap, kind, _, _ in reversed(events):
            rights.append(state)
            state = RIGHT.pause(RIGHT.step(state, kind), gap)
        rights.reverse()
        place, group = 0, None
        for (gap, kind, weight, name), left, right in zip(events, lefts, rights, strict=True):
            place += gap + (kind != QUOTE)
            if kind > THREAT:
                continue
            target, report, hit, negation, quoted, says = LEFT.states[left]
            target_after, report_after, hit_after = RIGHT.states[right]
            # A word at a distance of n has n - 1 others between.
            targeted = min(target, target_after) < CLAUSE_WORDS - 1
            if kind == THREAT and not targeted:
                continue
            scale = self.targeted if targeted else 1.0
            if negation < NEGATED:
                scale *= self.negated
            if quoted or min(report, report_after) < CLAUSE_WORDS - 1:
                scale *= self.reported
            if group is None or place - group.place >= CLAUSE_WORDS:
                group = Match(place)
                out.append(group)
            group.score += weight * scale
            group.mass += scale
            group.names.append(name)
            group.matched |= bool(targeted or says or min(hit, hit_after) <= BESIDE)

    def matches(self, text: str) -> tuple[list[Match], int]:
        """(matches of all clauses in order, number of words)."""
        out: list[Match] = []
        events: list[tuple[int, int, float, str]] = []
        words = gap = 0
        symbol = self.symbol
        for piece in pieces(text):
            for word in TOKEN.findall(piece.lower()):
                kind, weight, name = symbol(word)
                if kind == OTHER:
                    gap += 1
                    words += 1
                elif kind == STOP:
                    if events:
                        self._clause(events, out)
                        events = []
                    gap = 0
                else:
                    words += kind != QUOTE
                    events.append((gap, kind, weight, name))
                    gap = 0
        self._clause(events, out)
        return out, words

    def clauses(self, text: str) -> tuple[list[tuple[float, int, str]], int]:
        """((score, hits, patterns) of each match, number of words)."""
        found, words = self.matches(text)
        return [(m.score, len(m.names), " ".join(m.names)) for m in found], words

    def features(self, text: str) -> list[float]:
        """Of a text: its matches' sum, largest, number and rate, and its length. Hits without company count half, and only if they come back."""
        found, words = self.matches(text)
        if len(found) == 1 and not found[0].matched:
            found = []
        total = sum(m.score * (1.0 if m.matched else 0.5) for m in found)
        n = sum(m.mass for m in found)
        return [1.0, math.log1p(total), max((m.score for m in found), default=0.0), math.log1p(n), min(10.0, 100.0 * n / max(words, 5)), math.log1p(words) / 8, float(n > 0), float(len({p for m in found for p in m.names}) > 1)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.coefficients, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that end at white space."""
    at = 0
    while len(text) - at > SLICE:
        m = re.compile(r"\s").search(text, at + SLICE)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def patterns_of(text: str) -> Counter:
    """How often each word and stem occurs."""
    words = Counter(w for piece in pieces(text) for w in TOKEN.findall(piece.lower()) if len(w) >= 3)
    out: Counter = Counter()
    for w, n in words.items():
        out[w] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(__text, label) of about `rows` labelled ids, at most twice as many; the ids are chosen first, so only their texts move.

    Of rows that share an id one text is learned from, the greatest, so the rows are bounded as well.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and __id is not null")
    ids = hashed_sample(ids.groupBy("__id").agg(F.max("label").alias("label")), "__id", rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = texts.join(F.broadcast(ids), "__id")  # at most 2 * rows pairs of numbers are broadcast
    return found.groupBy("__id", "label").agg(F.max("__text").alias("__text")).select("__text", "label")


def learn_patterns(sample: DataFrame) -> dict[str, float]:
    """Words and stems whose rate in toxic texts is well above that in others, with the logarithm of the ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, times, sizes = ({}, {}, [0, 0]), (Counter(), Counter()), [0, 0]
            df = (Counter(), Counter())
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = patterns_of(x)
                df[y].update(found.keys())
                # A pattern repeated in one text is one observation and a little more.
                times[y].update({k: 1.0 + math.log(n) for k, n in found.items()})
                sizes[y] += sum(n for k, n in found.items() if k[-1] != "*")
                texts[0].setdefault(y, 0)
                texts[0][y] += 1
            for y in (0, 1):
                keys = list(df[y])
                yield pa.RecordBatch.from_arrays([pa.array([*keys, ""], pa.string()), pa.array([y] * (len(keys) + 1), pa.int32()), pa.array([*(df[y][k] for k in keys), texts[0].get(y, 0)], pa.int64()), pa.array([*(times[y][k] for k in keys), sizes[y]], pa.float64())], ["pattern", "label", "texts", "times"])

    counts = sample.select("__text", "label").mapInArrow(count, schema("pattern string, label int, texts long, times double"))
    pick = lambda y, c: F.sum(F.when(F.col("label") == y, F.col(c)).otherwise(0))
    table = counts.groupBy("pattern").agg(pick(1, "texts").alias("t1"), pick(0, "texts").alias("t0"), pick(1, "times").alias("n1"), pick(0, "times").alias("n0")).where(f"t1 >= {LEAST_TEXTS} or pattern = ''").persist()
    try:
        whole = table.where("pattern = ''").first()
        if whole is None or not whole.t1 or not whole.t0:
            return {}
        n = whole.t1 + whole.t0
        t1, t0, term = F.col("t1").cast("double"), F.col("t0").cast("double"), lambda o, e: F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0)
        with_it, without = t1 + t0, n - t1 - t0
        gain = 2 * (term(t1, with_it * whole.t1 / n) + term(t0, with_it * whole.t0 / n) + term(whole.t1 - t1, without * whole.t1 / n) + term(whole.t0 - t0, without * whole.t0 / n))
        ratio = ((F.col("n1") + 0.5) / (whole.n1 + 1.0)) / ((F.col("n0") + 0.5) / (whole.n0 + 1.0))
        able = table.where("pattern != ''").withColumn("gain", gain).withColumn("ratio", ratio).where((F.col("gain") >= LEAST_GAIN) & (F.col("ratio") >= LEAST_RATIO))
        rank = F.col("gain") * F.least(F.lit(1.0), F.ln("ratio") / math.log(30.0))
        able = able.orderBy(F.desc(rank), F.length("pattern"), "pattern").limit(20 * PATTERNS).select("pattern", "ratio").collect()
    finally:
        table.unpersist()
    chosen: dict[str, float] = {}
    for r in able:
        stem = r.pattern.rstrip("*")
        if len(chosen) < PATTERNS and not any(stem.startswith(c.rstrip("*")) or c.startswith(stem) for c in chosen):
            chosen[r.pattern] = math.log(r.ratio)
    return chosen


def learn_coefficients(grammar: Grammar, sample: DataFrame, rounds: int = 30, ridge: float = 0.3) -> tuple[float, ...]:
    """Logistic regression on the features of the sample's texts (at most 2 * SAMPLE_ROWS rows of eight numbers)."""
    known = grammar.learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(known)
        for b in batches:
            rows = [g.features(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    rows = sample.select("__text", "label").mapInArrow(run, schema("x array<double>, label int")).collect()
    if not rows:
        return (-3.0, 1.0, 0.5, 0.5, 0.3, 0.0, 1.0, 0.0)
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    prior = np.array([-3.0, 0.5, 0.3, 0.5, 0.3, 0.0, 1.0, 0.0])  # what is assumed without labels: a match raises the score
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar learned from labelled texts. Labels other than 0 and 1, and ids without a text, are passed over."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows).persist()
    try:
        grammar = Grammar(learn_patterns(sample))
        return Grammar(grammar.learned, learn_coefficients(grammar, sample))
    finally:
        sample.unpersist()


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, columns in `keep`, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without matches. Repeated rows are each scored; null ids are passed
    through; long texts are read once, clause by clause; an empty table gives an empty result.
    """
    known, coefficients = grammar.learned, grammar.coefficients
    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(known, coefficients)
        for b in small_batches(batches):
            scores = [g.score(x or "") for x in b.column(1).to_pylist()]
            out = [b.column(0), *(b.column(2 + i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [id_col, *keep, "score", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, schema(", ".join([f"`{id_col}` long", *(f"`{k}` {types[k]}" for k in keep), "score double", "predicted int"])))


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, with all its columns, without the rows whose text scores `least` or more. Null and empty texts are scored as such."""
    known, coefficients = grammar.learned, grammar.coefficients
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(known, coefficients)
        for b in small_batches(batches):
            yield b.filter(pa.array([g.score(x or "") < least for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
