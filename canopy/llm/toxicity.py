"""Toxicity by a weighted finite-state grammar over clauses.

A chain of transducers, composed, rewrites the words of a clause. The lexicon turns a word into a symbol (an insult or an act
of violence with a strength, a target, a negation, a verb of reported speech, an intensifier, a word of intent, or another).
The insult transducer raises intensified insults, the threat transducer turns violence after a word of intent into a threat,
and those of negation and reported speech mark the insults and threats in their reach. The target transducer marks those
with a target before them, and, run over the clause backwards, those with one after them. What comes out is a label for each
match, and each label (the final arcs of the composition) has a weight; a document is scored by the strengths of its matched
clauses by label, and their density, through a logistic function. Clauses without a match are not walked.

Learned from labelled rows of the training part: which word beginnings mark insults (a word beginning, so that inflected
and compounded forms match; also those that tell only where a row has them in FORMS forms or more), their strengths, the
weight of each label and the bias. Weights are drawn towards those of the
built-in grammar (FACTORS), so a label that the rows do not show keeps its own. The fit uses at most SAMPLE_ROWS labelled
rows, the first by a hash of their id; scoring covers every document.

Defined cases: null and empty texts have no clauses and score what the bias gives; repeated rows score alike; rows whose
label is null are not used; without rows of both labels the built-in lexicon and weights apply; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_of_id, staged, trimmed, whole_rows

SAMPLE_ROWS = 6_000
HELD_OUT = (4, 2)
THRESHOLD = 0.3
REACH = 4
STEM_LENGTHS = range(4, 11)
FORMS = 3
_TOKEN = re.compile(r"\w+|[.!?;\n]+")
_WORD_CACHE = 200_000

# Seed words of the grammar, in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum loser trash worthless disgusting pathetic clown dumm dumb imbecile crétin abruti idiota estúpido basura".split()
THREATS = "kill hurt destroy töten umbringen tuer matar".split()
TARGETS = "you your yourself he she they them him her these those people du dich euch ihr sie vous toi tu ils elles tú usted ustedes ellos".split()
NEGATIONS = "not no never without nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say called calls wrote quoted reported claimed sagte nannte schrieb dit écrit dijo llamó escribió".split()
INTENTS = "will gonna shall must should werde soll vais va voy debe".split()
INTENSIFIERS = "total complete utter such absolute totaler echter complet vrai total completo puro".split()

Symbol = tuple[str, str]  # name and marks


class Transducer:
    """Reads symbols; step gives the next state and the symbol that it rewrites to."""

    def __init__(self, step: Callable[[int, Symbol], tuple[int, Symbol]], start: int = 0):
        self.start, self.step = start, step


def after(name: str, rewrite: Callable[[Symbol], Symbol], reach: int | None = REACH) -> Transducer:
    """Rewrites what comes within reach words after a symbol of the name, or anywhere after it."""

    def step(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        if symbol[0] == name:
            return (1 if reach is None else reach), symbol
        return (left if reach is None else max(0, left - 1)), rewrite(symbol) if left else symbol

    return Transducer(step)


def renamed(old: str, new: str) -> Callable[[Symbol], Symbol]:
    return lambda symbol: (new, symbol[1]) if symbol[0] == old else symbol


def marked(mark: str) -> Callable[[Symbol], Symbol]:
    """Marks matches, each mark once."""
    return lambda symbol: (symbol[0], symbol[1] + mark) if symbol[0] in FACTORS and mark not in symbol[1] else symbol


class Composition:
    """Transducers in a chain, each reading what the one before it writes; an arc is worked out when it is first walked."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.arcs: dict[tuple[tuple[int, ...], Symbol], tuple[tuple[int, ...], Symbol]] = {}

    def step(self, state: tuple[int, ...], symbol: Symbol) -> tuple[tuple[int, ...], Symbol]:
        if (arc := self.arcs.get((state, symbol))) is None:
            states, out = [], symbol
            for part, own in zip(self.parts, state, strict=True):
                own, out = part.step(own, out)
                states.append(own)
            arc = self.arcs[state, symbol] = (tuple(states), out)
        return arc

    def walk(self, symbols: Iterable[Symbol]) -> list[Symbol]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


#: Weights of the built-in grammar: of a match by its kind, and the factor of each mark (negated, reported, targeted).
FACTORS = {"insult": 1.6, "strong insult": 2.2, "violence": 0.4, "threat": 2.6}
MARKS = {"n": 0.25, "r": 0.4, "t": 1.5}
LABELS = [(kind, "".join(m)) for kind in FACTORS for n in range(len(MARKS) + 1) for m in combinations(MARKS, n)]
_LABEL_AT = {label: k for k, label in enumerate(LABELS)}
#: Bias, labels in order, density of matches.
BUILT_IN = (-2.5, *[FACTORS[kind] * math.prod(MARKS[m] for m in marks) for kind, marks in LABELS], 6.0)


@dataclass
class Grammar:
    stems: dict[str, float]
    weights: tuple[float, ...] = BUILT_IN
    words: dict[str, tuple[str, float]] = field(init=False, repr=False)

    def __post_init__(self):
        lists = {"target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "intent": INTENTS, "intensifier": INTENSIFIERS}
        self.words = {w: (name, 0.0) for name, words in lists.items() for w in words} | {w: ("violence", 1.0) for w in THREATS}
        self.fixed = dict(self.words)
        self.longest = max(map(len, self.stems), default=0)
        self.forwards = Composition(
            after("intensifier", renamed("insult", "strong insult")),
            after("intent", renamed("violence", "threat")),
            after("negation", marked("n")),
            after("report", marked("r"), None),
            after("target", marked("t")),
        )
        self.backwards = Composition(after("target", marked("t")))

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexicon transducer, which remembers the words it has read."""
        if (known := self.words.get(word)) is None:
            if len(self.words) > _WORD_CACHE:
                self.words = dict(self.fixed)
            known = ("other", 0.0)
            for n in range(min(len(word), self.longest), 2, -1):
                if (strength := self.stems.get(word[:n])) is not None:
                    known = ("insult", strength)
                    break
            else:
                if (strength := self.stems.get(word + "$")) is not None:
                    known = ("insult", strength)
            self.words[word] = known
        return known

    def clause(self, symbols: list[tuple[str, float]]) -> list[tuple[int, float]]:
        """Label number and strength of each match of a clause."""
        out = self.backwards.walk(reversed(self.forwards.walk((name, "") for name, _ in symbols)))
        return [(_LABEL_AT[label[0], "".join(m for m in MARKS if m in label[1])], strength) for label, (_, strength) in zip(reversed(out), symbols, strict=True) if strength]

    def features(self, text: str | None) -> np.ndarray:
        """For each label log(1 + strength of its matches), and matches a word."""
        sums = np.zeros(len(LABELS) + 1)
        tokens = _TOKEN.findall(text.lower()) if text else []
        symbol, known = self.symbol, self.words
        read = [known.get(t) or symbol(t) for t in tokens]
        count, done = 0, -1
        for i in [i for i, m in enumerate(read) if m[1]]:
            if i <= done:
                continue
            begin = done = i
            while begin and tokens[begin - 1][0] not in ".!?;\n":
                begin -= 1
            while done < len(tokens) and tokens[done][0] not in ".!?;\n":
                done += 1
            for label, strength in self.clause(read[begin:done]):
                sums[label] += strength
                count += 1
        sums = np.log1p(sums)
        sums[-1] = count / max(1, len(tokens))
        return sums

    def score(self, text: str | None) -> float:
        reached = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, reached))))


def _beginnings(text: str | None) -> set[str]:
    """The beginnings of a text's words, its whole words as `word$`, and as `beginning*` those that FORMS different words go on from."""
    words = set(_TOKEN.findall(text.lower())) if text else set()
    forms = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) > n)
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w + "$" for w in words if len(w) >= 3} | {s + "*" for s, n in forms.items() if n >= FORMS}


def _odds(p: int, n: int, toxic: int, clean: int) -> float:
    return math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Word beginnings that mark toxic rows, with their strengths: those that inflect first, by falling G statistic, none that a chosen one begins or continues.

    A beginning qualifies if rows that have it are toxic far more often than others, or rows that have it in several forms
    (an insult that inflects may occur in a clean row by chance, but once). Its strength is the log odds that one word tells.
    """
    ranked = []
    for entry, (p, n) in counts.items():
        several = entry.endswith("*")
        if p >= (2 if several else 4) and _odds(p, n, toxic, clean) >= 3:
            g = 2 * p * math.log(p * (toxic + clean) / ((p + n) * toxic))
            stem = entry.rstrip("*")
            strength = min(_odds(*counts.get(stem, (p, n)), toxic, clean), 6.0) / 4
            if g >= (8 if several else 20) and strength >= 0.25:
                ranked.append((not several, -g, -len(stem) if several else len(stem), stem, strength))
    chosen: dict[str, float] = {}
    for _, _, _, stem, strength in sorted(ranked):
        whole = stem.rstrip("$")
        if not any(whole.startswith(c.rstrip("$")) or c.startswith(whole) for c in chosen):
            chosen[stem] = strength
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...], ridge: float = 0.3, rounds: int = 50) -> tuple[float, ...]:
    """Bias and weights by Newton steps; weights are drawn towards the prior, the bias hardly."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w0 = np.array(prior)
    w = w0.copy()
    pull = np.full(len(w0), ridge)
    pull[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (pull * (v - w0) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull), x.T @ (y - p) - pull * (w - w0))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn a grammar from at most sample_rows labelled rows outside the held-out part."""
    parts, left_out = HELD_OUT
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    usable = usable.where(F.pmod(crc_of_id("id"), F.lit(parts)) != left_out).groupBy("id").agg(F.max("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(texts.join(F.broadcast(sample), "id").select("text", "label"), "labelled")

    def tally(batches):
        for batch in batches:
            by_label = (Counter(), Counter())
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                by_label[label].update(_beginnings(text))
            stems = [s for s, n in by_label[1].items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array([by_label[1][s] for s in stems], pa.int64()), pa.array([0] * len(stems), pa.int64())], names=["stem", "toxic", "clean"]
            )
            stems = list(by_label[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array([0] * len(stems), pa.int64()), pa.array([by_label[0][s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"]
            )

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    default = Grammar({w: 1.0 for w in INSULTS})
    if not sizes.get(0) or not sizes.get(1):
        return default
    counts = staged(rows.mapInArrow(trimmed(tally), "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n")), "stems")
    far = F.col("p") * sizes[0] >= 15 * F.col("n") * sizes[1]
    likely = counts.where(far & (F.col("p") >= F.when(F.col("stem").endswith("*"), 2).otherwise(4)))
    found = {r["stem"]: (r["p"], r["n"]) for r in likely.collect()}
    plain = [s[:-1] for s in found if s.endswith("*")]
    found |= {r["stem"]: (r["p"], r["n"]) for r in counts.where(F.col("stem").isin(plain)).collect()} if plain else {}
    learned = choose_stems(found, sizes[1], sizes[0])
    seeds = {w: 1.0 for w in INSULTS if not any(w.startswith(s.rstrip("$")) for s in learned)}
    grammar = Grammar(learned | seeds)
    shared = documents.sparkSession.sparkContext.broadcast(grammar.stems)

    def measure(batches):
        own = Grammar(shared.value)
        for batch in batches:
            found = [own.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    measured = sorted((r["label"], tuple(r["x"])) for r in rows.mapInArrow(trimmed(measure), "label int, x array<double>").collect())
    grammar.weights = fit_logistic(np.array([x for _, x in measured]), np.array([y for y, _ in measured], float), BUILT_IN)
    return grammar


def score(documents: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score)."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = _scored(source, grammar, "id", lambda batch: batch["text"])
    return scored.select(F.col("id").alias(id_col), "score")


def _scored(source: DataFrame, grammar: Grammar, keep: str, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast((grammar.stems, grammar.weights))
    schema = T.StructType([source.schema[keep], T.StructField("score", T.DoubleType())])

    def run(batches):
        own = Grammar(*shared.value)
        for batch in batches:
            found = pa.array([own.score(t) for t in texts(batch).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch[keep], found], names=[keep, "score"])

    return source.mapInArrow(trimmed(run), schema)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op7."""
    parts, left_out = HELD_OUT
    scored = score(documents, fit(documents, labels))
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(parts)) == left_out
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below the threshold, with their columns unchanged."""
    scored = _scored(whole_rows(documents), fit(documents, labels), "whole", lambda batch: batch["whole"].field("text"))
    return scored.where(F.col("score") < THRESHOLD).select("whole.*")
