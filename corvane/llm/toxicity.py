"""Toxicity: a weighted finite-state pattern grammar over sentences.

A sentence's words and marks are read as symbols: insults and threats (the triggers; insult
stems are learned), targets, negations, reporting verbs, commas, colons, quotes, and words
that turn a sentence round. Each pattern is a transducer of its own, which hands the
symbols on and marks the triggers that it covers, with a weight for doing so:

* negation: covers what follows to the next comma, quote or "but"; behind a threat also
  what stands up to three words before it ("ich töte dich nicht");
* reported speech: covers what follows the reporting verb in its sentence, over colons,
  commas and quotes, and what stands before it in quotes or before a comma;
* target: covers triggers up to five words away on either side.

The transducers that look back are composed into one, and those that look ahead into one
that reads from right to left; `compose` makes the product automaton, whose arcs multiply
the weights of theirs. A sentence is read by both. Every trigger so gets an output class
(plain, targeted, reported, negated) and a mass; a document's masses go through a logistic
output. Insult stems and class weights are learned from labelled rows; the other words are
short lists for four languages, whose classes keep their prior weights where no label
speaks for or against them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.quality import fold, training_rows, with_score

#: Labelled rows that the grammar is fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 8000
THRESHOLD = 0.7
THREATS = frozenset("kill murder strangle shoot stab töten töte umbringen erschießen erstechen tuer tuerai égorger poignarder matar mataré asesinar apuñalar".split())
TARGETS = frozenset("you your yours u he she they them him her du dich dir dein deine euch ihr er sie tu t toi te vous votre ton ta il elle ils elles usted ustedes tú ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never cannot nicht kein keine keinen keinem keiner nie niemals pas jamais aucun aucune non nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say saying wrote writes told tells reported quoted claimed claims sagte sagt schrieb schreibt berichtete behauptete meinte dit disait écrit déclaré affirma dijo dice escribió afirmó".split())
TURNS = frozenset("but however aber doch sondern mais pero sino".split())
#: Output classes and their prior weights; what is negated or reported counts for less than what is meant.
CLASSES = ("insult", "insult_targeted", "insult_reported", "insult_negated", "threat", "threat_targeted", "threat_reported", "threat_negated")
PRIOR = np.array([5.0, 6.0, 1.0, 1.0, 1.0, 4.0, 0.5, 0.3])
BIAS = -3.5
#: Weights of the arcs that mark a trigger, and the steepness of a document's output in its mass.
COVERED, AIMED, STEEP = 0.3, 1.2, 2.5
#: Learned weight (log ratio of the shares of toxic and clean documents) at which an insult stem has half its mass.
SURE = 5.0
TARGET_REACH, BACK_REACH = 5, 3
STEM_MIN, STEM_MAX = 4, 8
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[,:\"“”„«»]")
#: A sentence ends here, unless a closing quote follows.
_END_OF_SENTENCE = re.compile(r"[.!?;\n](?![\"”»])")
_END = "$"

OTHER, TARGET, NEGATION, REPORT, COMMA, COLON, QUOTE, TURN = range(8)
INSULT, THREAT = 8, 16  # and the marks
NEGATED, REPORTED, TARGETED = 1, 2, 4
SYMBOLS = 24


def learn_stems(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Stem -> weight: whole words (ending in '$') and word beginnings that mark label 1 beyond chance."""
    toxic, clean, kept = Counter(), Counter(), []
    seen: set[int] = set()
    for t, y in zip(texts, labels):
        words = _WORD.findall(t.lower())
        least = sorted({crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:8]
        if len(seen.intersection(least)) * 4 < len(least):  # copies of a text are one witness, not many
            kept.append((set(words), y))
        seen.update(least)
    n1 = sum(int(y) for _, y in kept)
    n0 = len(kept) - n1
    if not n1 or not n0:
        return {}
    for words, y in kept:
        if y:
            toxic.update({s for w in words for s in _stems(w)})
    toxic = Counter({s: k for s, k in toxic.items() if k >= 3})
    for words, y in kept:
        if not y:
            clean.update({s for w in words for s in _stems(w) if s in toxic})
    base = n1 / (n0 + n1)
    tests = max(1, len(toxic))
    found = {}
    for s, k in toxic.items():
        m = k + clean[s]
        if k / m >= 0.8 and math.log(tests) + _log_tail(k, m, base) < math.log(0.05):
            found[s] = (k, math.log((k + 0.5) / (n1 + 1)) - math.log((clean[s] + 0.5) / (n0 + 1)))
    out: dict[str, float] = {}
    for s, (k, weight) in sorted(found.items(), key=lambda x: (-x[1][0] * x[1][1], -len(x[0]), x[0])):
        if not any(s != t and (s.startswith(t.rstrip(_END)) or t.startswith(s.rstrip(_END))) for t in out):
            out[s] = weight  # by documents times weight, the longest first; its extensions and beginnings go
    return out


def _stems(word: str) -> list[str]:
    return [word + _END, *[word[:n] for n in range(STEM_MIN, min(STEM_MAX, len(word)) + 1)]] if len(word) >= STEM_MIN else []


def _log_tail(k: int, m: int, p: float) -> float:
    """Upper bound of log P(Binomial(m, p) >= k) (Chernoff)."""
    q = k / m
    if q <= p:
        return 0.0
    return -m * ((q * math.log(q / p) if q else 0) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))


class Transducer:
    """Deterministic and complete: arcs[state][symbol] is (next state, output symbol, weight); state 0 is the start."""

    def __init__(self, arcs: list[list[tuple[int, int, float]]]):
        self.arcs = arcs

    @staticmethod
    def of(start: Hashable, step: Callable) -> "Transducer":
        """The states that step(state, symbol) -> (state, output, weight) reaches from start."""
        number, arcs, todo = {start: 0}, [], [start]
        for state in todo:  # grows
            row = []
            for symbol in range(SYMBOLS):
                to, out, weight = step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], out, weight))
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols: list[int], weights: list[float]) -> tuple[list[int], list[float]]:
        state, out, mass = 0, [], []
        for symbol, w in zip(symbols, weights):
            state, symbol, weight = self.arcs[state][symbol]
            out.append(symbol)
            mass.append(w * weight)
        return out, mass


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What second makes of first's output, as one transducer over the pairs of states; weights multiply."""

    def step(pair, symbol):
        a, middle, u = first.arcs[pair[0]][symbol]
        b, out, v = second.arcs[pair[1]][middle]
        return (a, b), out, u * v

    return Transducer.of((0, 0), step)


def _mark(symbol: int, mark: int, weight: float) -> tuple[int, float]:
    return (symbol, 1.0) if symbol & mark else (symbol | mark, weight)


def negation() -> Transducer:
    def step(on, symbol):
        if symbol >= INSULT:
            return (on, *(_mark(symbol, NEGATED, COVERED) if on else (symbol, 1.0)))
        return symbol == NEGATION or on and symbol not in (COMMA, COLON, QUOTE, TURN), symbol, 1.0

    return Transducer.of(False, step)


def negation_behind(reach: int = BACK_REACH) -> Transducer:
    """Read from right to left."""

    def step(left, symbol):
        if symbol >= INSULT:
            return (max(left - 1, 0), *(_mark(symbol, NEGATED, COVERED) if left and symbol >= THREAT else (symbol, 1.0)))
        return reach if symbol == NEGATION else 0 if symbol in (COMMA, COLON, QUOTE, TURN) else max(left - 1, 0), symbol, 1.0

    return Transducer.of(0, step)


def report() -> Transducer:
    def step(on, symbol):
        if symbol >= INSULT:
            return (on, *(_mark(symbol, REPORTED, COVERED) if on else (symbol, 1.0)))
        return on or symbol == REPORT, symbol, 1.0

    return Transducer.of(False, step)


def report_behind(reach: int = BACK_REACH) -> Transducer:
    """Read from right to left: the verb, up to `reach` words (who says it), then a comma or a quote before which the report stands."""

    def step(state, symbol):
        name, left = state
        if symbol >= INSULT:
            return (state if name != "verb" else ("none", 0), *(_mark(symbol, REPORTED, COVERED) if name in ("comma", "quote") else (symbol, 1.0)))
        if symbol == REPORT:
            state = ("verb", reach)
        elif symbol == QUOTE:
            state = ("quote", 0) if name in ("verb", "comma") else ("none", 0)
        elif name == "verb":
            state = ("comma", 0) if symbol == COMMA else ("verb", left - 1) if left else ("none", 0)
        return state, symbol, 1.0

    return Transducer.of(("none", 0), step)


def target(reach: int = TARGET_REACH) -> Transducer:
    """For either direction."""

    def step(left, symbol):
        if symbol >= INSULT:
            return (max(left - 1, 0), *(_mark(symbol, TARGETED, AIMED) if left else (symbol, 1.0)))
        return reach if symbol == TARGET else left if symbol in (COMMA, COLON, QUOTE) else max(left - 1, 0), symbol, 1.0

    return Transducer.of(0, step)


FORWARD = compose(compose(negation(), report()), target())
BACKWARD = compose(compose(negation_behind(), report_behind()), target())


def output_class(symbol: int) -> int:
    """Index in CLASSES of a trigger's symbol: negation counts before report, report before target."""
    kind = 4 if symbol >= THREAT else 0
    return kind + (3 if symbol & NEGATED else 2 if symbol & REPORTED else 1 if symbol & TARGETED else 0)


class Grammar:
    """The lexicon, the composed transducers and the logistic output."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray = PRIOR, bias: float = BIAS):
        self.stems, self.weights, self.bias = stems, np.asarray(weights, float), bias
        whole = [re.escape(s[:-1]) + r"(?!\w)" for s in stems if s.endswith(_END)] + [re.escape(t) + r"(?!\w)" for t in sorted(THREATS)]
        begin = [re.escape(s) for s in stems if not s.endswith(_END)]
        self.trigger = re.compile(_trie([*begin, *whole]))
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        """(symbol, weight) of a token: what the lexicon makes of the word, or of its parts about an apostrophe."""
        if token not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[token] = self._look_up(token)
        return self.memo[token]

    def _look_up(self, token: str) -> tuple[int, float]:
        if token in ",:":
            return (COMMA if token == "," else COLON), 1.0
        if len(token) == 1 and not token.isalpha():
            return QUOTE, 1.0
        parts = re.split("['’]", token)
        if len(parts) > 1 and parts[0] == "n" or parts[-1] == "t" and parts[-2:-1] and parts[-2].endswith("n"):
            return NEGATION, 1.0  # n'est, isn't
        for part in (token, parts[-1], parts[0]):
            if part in THREATS:
                return THREAT, 1.0
            weight = max([0.0, *[self.stems[s] for s in _stems(part) if s in self.stems]])
            if weight:
                return INSULT, 1 / (1 + math.exp(SURE - weight))
            for words, symbol in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TURNS, TURN), (TARGETS, TARGET)):
                if part in words:
                    return symbol, 1.0
        return OTHER, 1.0

    def clause(self, tokens: list[str]) -> list[tuple[str, float]]:
        """(output class, mass) of each trigger of a sentence, lower-cased."""
        symbols, weights = map(list, zip(*map(self.symbol, tokens))) if tokens else ([], [])
        symbols, weights = FORWARD.run(symbols, weights)
        symbols, weights = BACKWARD.run(symbols[::-1], weights[::-1])
        return [(CLASSES[output_class(s)], w) for s, w in zip(symbols[::-1], weights[::-1]) if s >= INSULT]

    def classes(self, text: str) -> np.ndarray:
        """Summed masses of each output class over the sentences of a whole text."""
        got = np.zeros(len(CLASSES))
        text = text.lower()
        done = 0
        for m in self.trigger.finditer(text):
            if m.start() < done:
                continue
            start = _sentence_start(text, m.start(), done)
            end = _END_OF_SENTENCE.search(text, m.start())
            done = end.start() + 1 if end else len(text)
            for k, v in self.clause(_TOKEN.findall(text, start, done)):
                got[CLASSES.index(k)] += v
        return got

    def score(self, classes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_saturated(classes) @ self.weights + self.bias, -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.score(np.array([self.classes(t.decode("utf-8", "replace")) for t in texts]).reshape(len(texts), len(CLASSES)))

    @staticmethod
    def fit(texts: list[str], labels: np.ndarray, rounds: int = 1500) -> "Grammar":
        """Stems, then class weights by penalised logistic regression about PRIOR, kept in a meant order. Without both labels: no stems, prior weights."""
        g = Grammar(learn_stems(texts, labels))
        if len(set(labels.tolist())) < 2:
            return g
        x = _saturated(np.array([g.classes(t) for t in texts]))
        w, b, y = PRIOR.copy(), BIAS, labels.astype(float)
        scale = 1 / len(y)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            w = np.clip(w + 2.0 * (x.T @ (y - p) * scale - 0.0005 * (w - PRIOR)), 0, 12)
            for i in (0, 4):
                w[i + 1], w[i + 2], w[i + 3] = max(w[i + 1], w[i]), min(w[i + 2], w[i]), min(w[i + 3], w[i])
            b += 2.0 * ((y - p).mean() - 0.0005 * (b - BIAS))
        return Grammar(g.stems, w, float(b))


def _saturated(masses: np.ndarray) -> np.ndarray:
    """One insult that is meant nearly settles a class; more of them add little."""
    return 1 - np.exp(-STEEP * masses)


def _sentence_start(text: str, at: int, least: int) -> int:
    """The end of the last sentence before at, not before least."""
    while True:
        found = max(text.rfind(c, least, at) for c in ".!?;\n")
        if found < 0:
            return least
        if _END_OF_SENTENCE.match(text, found):
            return found + 1
        at = found


def _trie(patterns: list[str]) -> str:
    r"""One regular expression for patterns at a word's start, grouped by first letter."""
    by: dict[str, list[str]] = {}
    for p in sorted(patterns):
        by.setdefault(p[0], []).append(p[1:])
    return r"(?<!\w)(?=[" + "".join(map(re.escape, by)) + r"])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> Grammar:
    """Grammar learned from at most train_rows rows of docs with a label `toxic`; null labels and doc_ids are left out, null texts are empty."""
    rows = training_rows(docs, labels, "toxic", allowed, train_rows)
    return Grammar.fit([r.text for r in rows], np.array([int(r.label) for r in rows], int))


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with score (0 to 1). Null and empty texts get the base score; repeated rows score alike; an empty table stays empty; beside a column score of docs' own it is _score."""
    return with_score(docs, grammar.scores)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document of `documents`, learned from `labels` outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = fit_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score_toxicity(docs.select("doc_id", "text"), grammar).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
