"""Toxicity by a weighted finite-state grammar over clauses.

Tokens become symbols: insult, threat, intent, target, negation, report, quote, other.
Four small transducers rewrite and weigh the symbols of a clause: negation damps what
stands in its scope, reported speech damps what follows it, a target near an insult
strengthens it, a threat needs intent before and a target after it, and an insult
matches as it is.  They are composed once into one table; a clause's score is the
weight of its best path, not of single words.

The insult lexicon is the fixed list below and stems induced from labelled documents;
three features of the clause scores are calibrated by a logistic fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import bounded_sample, ddl, held_out, over_batches

FOLDS, HELD_OUT = 5, 0
FIT_ROWS = 20_000  # labelled rows that a fit looks at, chosen by hash; all when there are fewer
STEMS = (3, 9)  # lengths of induced stems
EVIDENCE = 12.0  # log-likelihood ratio a stem needs; covers some ten thousand candidates
PURITY = 0.5  # share of its documents that are toxic

# Fixed word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb fool fools loser losers scum trash pathetic worthless disgusting clown imbecile cretin vermin filth".split()
THREATS = "kill hurt destroy beat punch stab shoot burn strangle murder smash".split()
INTENTS = "will gonna going shall wanna ll must should".split()
TARGETS = "you your u ya they them he she him her these those people".split()
NEGATIONS = "not no never nobody isn aren wasn weren don doesn didn won cannot without".split()
REPORTS = "said says claimed claims wrote writes reported reports quoted quote called calls allegedly according".split()

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE = range(8)
SYMBOLS = 8
PAID, MORE = 8, 9  # written only: the target of the threats held so far, a further threat to hold
CLAUSE = re.compile(r"[.!?;:\n]+|,\s|\bbut\b")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")


@dataclass
class Transducer:
    """A deterministic weighted transducer; arcs that are not given copy their symbol with weight 1 and go to ``rest``."""

    arcs: dict[tuple[int, int], tuple[int, float, int]] = field(default_factory=dict)
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs.get((state, symbol), (symbol, 1.0, self.rest.get(state, state)))


def scope(opening: tuple[int, ...], weighed: tuple[int, ...], weight: float, reach: int) -> Transducer:
    """After an opening symbol, the next ``reach`` symbols that are ``weighed`` get the weight."""
    t = Transducer(rest={k: max(k - 1, 0) for k in range(reach + 1)})
    for state in range(reach + 1):
        for symbol in opening:
            t.arcs[state, symbol] = (symbol, 1.0, reach)
        if state:
            for symbol in weighed:
                t.arcs[state, symbol] = (symbol, weight, state - 1)
    return t


def threats(reach: int) -> Transducer:
    """A threat verb with intent within ``reach`` symbols before it is held and paid at a target within ``reach`` symbols after
    it; without intent it is an ordinary word, and without a target it is never paid."""
    wide = reach + 1  # a state is how far the intent reaches, times ``wide``, and how far the held threats do
    t = Transducer()
    for state in range(wide * wide):
        intent, held = max(state // wide - 1, 0) * wide, max(state % wide - 1, 0)
        t.rest[state] = intent + held
        t.arcs[state, INTENT] = (OTHER, 1.0, reach * wide + held)
        if state >= wide:
            t.arcs[state, THREAT] = (MORE if state % wide else THREAT, 1.0, intent + reach)
        else:
            t.arcs[state, THREAT] = (OTHER, 1.0, intent + held)
        if state % wide:
            t.arcs[state, TARGET] = (PAID, 1.0, intent)
    return t


@dataclass
class Grammar:
    """The composition of a cascade as tables: next state, output symbol and weight of each state and symbol."""

    goes: list[list[int]]
    gives: list[list[int]]
    weighs: list[list[float]]

    def clause(self, symbols: list[int], strengths: list[float]) -> float:
        """Weight of a clause's matched symbols; that of threats counts once their target is there."""
        state, total, held = 0, 0.0, 0.0
        for symbol, strength in zip(symbols, strengths, strict=True):
            given = self.gives[state][symbol]
            if given == INSULT:
                total += strength * self.weighs[state][symbol]
            elif given == THREAT:
                held = strength * self.weighs[state][symbol]
            elif given == MORE:
                held += strength * self.weighs[state][symbol]
            elif given == PAID:
                total += held
            state = self.goes[state][symbol]
        return total


def compose(cascade: list[Transducer]) -> Grammar:
    """Each transducer reads what the one before it writes; weights multiply; only reachable states are kept."""
    start = (0,) * len(cascade)
    names, queue, table = {start: 0}, [start], []
    while queue:
        states = queue.pop(0)
        row = []
        for symbol in range(SYMBOLS):
            weight, nexts = 1.0, []
            for machine, state in zip(cascade, states, strict=True):
                symbol, own, to = machine.step(state, symbol)
                weight *= own
                nexts.append(to)
            to = tuple(nexts)
            if to not in names:
                names[to] = len(names)
                queue.append(to)
            row.append((names[to], symbol, weight))
        table.append(row)
    return Grammar(*([[arc[k] for arc in row] for row in table] for k in range(3)))


def grammar() -> Grammar:
    matched = (INSULT, THREAT)
    return compose([
        scope((NEGATION,), matched, 0.5, 3),
        scope((REPORT, QUOTE), matched, 0.6, 12),
        scope((TARGET,), (INSULT,), 1.5, 4),
        threats(4),
    ])


@dataclass
class Lexicon:
    """Symbols and strengths of words: whole words and stems."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, float]
    longest: int = 0

    def __post_init__(self):
        self.longest = max(map(len, self.stems), default=0)

    def look(self, word: str) -> tuple[int, float]:
        hit = self.words.get(word)
        if hit is None:
            for k in range(min(len(word), self.longest), STEMS[0] - 1, -1):
                if word[:k] in self.stems:
                    return INSULT, self.stems[word[:k]]
            return OTHER, 0.0
        return hit


def lexicon(stems: dict[str, float] | None = None, known: float = 3.0) -> Lexicon:
    """The fixed lists, with induced stems; a stem that ends in a space is a whole word."""
    words: dict[str, tuple[int, float]] = {}
    for symbol, names in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (INTENT, INTENTS)):
        words |= dict.fromkeys(names, (symbol, 0.0))
    words |= dict.fromkeys(THREATS, (THREAT, known)) | dict.fromkeys(INSULTS, (INSULT, known)) | dict.fromkeys('"“”«»„', (QUOTE, 0.0))
    open_ = {}
    for stem, weight in (stems or {}).items():
        if stem.endswith(" "):
            words[stem[:-1]] = (INSULT, weight)
        else:
            open_[stem] = weight
    return Lexicon(words, open_)


class Scorer:
    """Clause features of texts: best clause, sum of clauses (logarithm), share of clauses that match."""

    def __init__(self, known: Lexicon):
        self.lexicon, self.grammar = known, grammar()
        self.finder = ahocorasick.Automaton()
        for text in [w for w, (s, _) in known.words.items() if s in (INSULT, THREAT)] + list(known.stems):
            self.finder.add_word(text, 1)
        self.finder.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, float]:
        lower = (text or "").lower()
        if next(self.finder.iter(lower), None) is None:
            return 0.0, 0.0, 0.0
        clauses = CLAUSE.split(lower)
        best = total = 0.0
        matched = 0
        for clause in clauses:
            if next(self.finder.iter(clause), None) is None:
                continue
            looked = [self.lexicon.look(word) for word in TOKEN.findall(clause)]
            score = self.grammar.clause([s for s, _ in looked], [w for _, w in looked])
            if score > 0:
                matched += 1
                total += score
                best = max(best, score)
        return best, float(np.log1p(total)), matched / len(clauses)


def _stems(text: str | None) -> set[str]:
    """Stems of a text's words, and the words themselves with a closing space."""
    found: set[str] = set()
    for word in {w for w in TOKEN.findall((text or "").lower()) if len(w) >= STEMS[0]}:
        found.add(word + " ")
        found.update(word[:k] for k in range(STEMS[0], min(len(word) - 1, STEMS[1]) + 1))
    return found


def _counted(rows: DataFrame) -> DataFrame:
    """(stem, n): documents of ``rows`` that hold each stem; pre-aggregated in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(_stems(text))
                if len(held) > 300_000:
                    yield pd.DataFrame(held.items(), columns=["stem", "n"])
                    held = Counter()
        yield pd.DataFrame(held.items(), columns=["stem", "n"])

    return rows.select("text").mapInPandas(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def induced_stems(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Stems that toxic documents hold and others hardly do, with their log odds; ``rows``: text, toxic."""
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    least = max(3, int(EVIDENCE / -np.log(base)))
    both = _counted(rows.filter("toxic = 1")).filter(F.col("n") >= least).withColumnRenamed("n", "a")
    both = both.join(_counted(rows.filter("toxic = 0")).withColumnRenamed("n", "b"), "stem", "left").fillna(0, "b")
    share = F.col("a") / (F.col("a") + F.col("b"))
    doubt = F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # Stems are weighed where they are counted; only accepted ones come to the driver.
    held = both.filter((share >= PURITY) & (F.col("a") * F.log(share / base) + doubt >= EVIDENCE)).collect()
    hits = {row["stem"]: row["a"] for row in held}
    good = {row["stem"]: float(np.log((row["a"] + 0.5) / (toxic + 1)) - np.log((row["b"] + 0.5) / (clean + 1))) for row in held}
    # The longest stem that keeps nearly all documents of a shorter one replaces it.
    replaced = {stem[:-1] for stem in good if hits[stem] >= 0.9 * hits.get(stem[:-1], np.inf)}
    return {stem: min(weight, 6.0) for stem, weight in good.items() if stem not in replaced}


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray  # of 1 and the three features


# Calibration in use until there are labels of both kinds: one plain insult (3.0) scores just over one half.
PRIOR = np.array([-3.0, 1.0, 0.2, 0.5])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Stems and calibration from labelled documents outside the held-out fold, ``rows`` of them at most.

    Labels other than 0 and 1 and labels without a document are ignored; several labels of a document count as their
    maximum.  With one kind of label only, the fixed lists and a fixed calibration are used."""
    own = labels.filter("toxic in (0, 1)").filter(~held_out("doc_id", FOLDS, HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = own.count()
    chosen = bounded_sample(own, "doc_id", rows, total)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").persist()
    counts = {row["toxic"]: row["n"] for row in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stems = induced_stems(texts, counts.get(1, 0), counts.get(0, 0))
    if len(counts) < 2:
        texts.unpersist()
        return Model(stems, PRIOR)
    measured = _features(texts, stems, "toxic").toPandas()
    texts.unpersist()
    return Model(stems, logistic(measured[["best", "total", "share"]].to_numpy(), measured["toxic"].to_numpy(np.float64)))


def _features(texts: DataFrame, stems: dict[str, float], *carry: str) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(lexicon(stems))
        for batch in batches:
            found = np.array([scorer.features(text) for text in batch["text"]], np.float64).reshape(-1, 3)
            yield {name: batch[name] for name in carry} | {"best": found[:, 0], "total": found[:, 1], "share": found[:, 2]}

    kept = texts.select(*carry)
    return over_batches(texts.select(*carry, "text"), run, ddl(kept, "best double", "total double", "share double"))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of 1 and the features by penalised Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from a half on), and the clause features.

    A null or empty text has no clauses and the score of a text without matches; repeated rows and null doc_ids are scored
    each; other columns are ignored; an empty table gives no rows."""
    w = [float(v) for v in model.weights]
    found = _features(docs.select("doc_id", "text"), model.stems, "doc_id")
    value = 1 / (1 + F.exp(-(F.lit(w[0]) + w[1] * F.col("best") + w[2] * F.col("total") + w[3] * F.col("share"))))
    return found.withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT)).withColumn("score", value).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("best").alias("best_clause"), F.col("share").alias("matched_clauses"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, that are not predicted toxic."""
    w = [float(v) for v in model.weights]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon(model.stems))
        for batch in batches:
            found = np.array([scorer.features(text) for text in batch.column(at).to_pylist()], np.float64).reshape(-1, 3)
            yield batch.filter(pa.array(w[0] + found @ np.array(w[1:]) < 0))

    return docs.mapInArrow(run, docs.schema)
