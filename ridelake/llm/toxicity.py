"""Toxicity by a weighted finite-state grammar over clauses.

Terminals are insults, threats, targets, negations and words of reported speech. One pass over a clause runs the composed
transducers: an insult or threat emits its weight, changed by the states the clause is in. A target in the
clause raises it (a threat counts only with one), a negation shortly before lowers it, reported speech lowers the rest of the
clause. A document's evidence is the sum over its matched clauses, taken also per word; a logistic curve turns both
into a score.

General words come with the grammar. Words and word stems that mark labelled toxic texts are learned with their
weights, and general words that do not are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.samples import smallest_hashes
from ridelake.plans.session import cut

# The general terminals.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns fool
    fools dumb jerk imbecile filth garbage vermin scumbag""".split()
THREATS = "kill hurt destroy beat punch stab shoot strangle smash burn".split()
TARGETS = "you your yours he she they them him her his their those these this that people".split()
NEGATIONS = "not never no nobody isn aren wasn don doesn didn nor neither without".split()
REPORTS = "said says say told claimed claims called calls quote quoted quotes wrote reported according".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;\n]")
TARGET_GAIN, NEGATED, REPORTED, NEGATION_REACH = 1.25, 0.4, 0.6, 3


@dataclass
class Grammar:
    """Terminals with weights: whole words, and stems that begin words; and the logistic curve's coefficients."""

    insults: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 1.0))
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for word in {**self.stems, **self.insults, **self.threats}:
            found.add_word(word, len(word))
        if not len(found):
            return None
        found.make_automaton()
        return found


def clause_score(grammar: Grammar, words: list[str]) -> float:
    """The weight a clause's words come to. States: words since a negation, reported speech, target seen."""
    has_target = any(w in _TARGETS for w in words)
    since_negation, reported, total = NEGATION_REACH + 1, False, 0.0
    for word in words:
        since_negation = 0 if word in _NEGATIONS else since_negation + 1
        reported = reported or word in _REPORTS
        weight = grammar.insults.get(word, 0.0)
        if not weight and word in grammar.threats:
            weight = grammar.threats[word] if has_target else 0.0
        if not weight and grammar.stems:
            weight = max((grammar.stems.get(word[:n], 0.0) for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1)), default=0.0)
        if weight:
            weight *= TARGET_GAIN if has_target else 1.0
            weight *= NEGATED if since_negation <= NEGATION_REACH else 1.0
            total += weight * (REPORTED if reported else 1.0)
    return total


_TARGETS, _NEGATIONS, _REPORTS = frozenset(TARGETS), frozenset(NEGATIONS), frozenset(REPORTS)
MIN_STEM, MAX_STEM = 4, 8


def matched_clauses(grammar: Grammar, automaton, text: str) -> list[tuple[int, int, float]]:
    """(begin, end, score) of the clauses of a lower-case text that hold a terminal with a weight."""
    found, done = [], -1
    if automaton is None:
        return found
    for last, size in automaton.iter(text):
        first = last - size + 1
        if last < done or (first and text[first - 1].isalpha()):
            continue  # within a clause that is scored already, or not at a word's beginning
        # Not before the clause scored last, so that the searches of a text add up to its length.
        since = max(done, 0)
        begin = max(since, *(text.rfind(mark, since, first) + 1 for mark in ".!?;\n"))
        end = _CLAUSE_END.search(text, last)
        end = end.start() if end else len(text)
        score = clause_score(grammar, _WORD.findall(text, begin, end))
        if score:
            found.append((begin, end, score))
        done = end
    return found


def _features(grammar: Grammar, automaton, body: str | None) -> tuple[float, float, list]:
    text = (body or "").lower()
    clauses = matched_clauses(grammar, automaton, text)
    total = sum(c[2] for c in clauses)
    return math.log1p(total), math.log1p(1000 * total / (len(text) + 200)), clauses


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.01 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        beta += np.linalg.solve(curve, slope)
    return tuple(float(b) for b in beta)


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    max_training: int = 3000, max_terms: int = 500, min_documents: int = 8,
) -> Grammar:
    """A grammar from labelled documents: the ``max_training`` of either label with the smallest hashed ids.

    A word, or a stem of 4 to 8 letters, becomes a terminal if documents of label 1 hold it much more often; of
    overlapping ones the most telling stays. Weights are log odds. ``labels`` must be the rows to learn from, one
    label per id (of several, the largest).
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.col(toxic).cast("int")).alias("y")
    )
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        some = smallest_hashes(known.where(F.col("y") == y), "id", max_training)
        picked = some if picked is None else picked.unionByName(some)
    # At most two times max_training narrow rows, so they are sent to every task. The sample is read four times, the documents once.
    sample = cut(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(picked), "id"))
    words = sample.select("id", "y", F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("ws"))
    stems = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.transform(
        F.sequence(F.lit(MIN_STEM), F.lit(MAX_STEM)),
        lambda n: F.when(F.length(w) >= n, F.concat(F.lit("^"), F.substring(w, F.lit(1), n))),
    ))))
    terms = words.select("y", F.explode(F.array_union("ws", F.array_compact(stems))).alias("term")).groupBy("term").agg(
        F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")
    )
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    rated = terms.withColumn("odds", odds)
    general = set(INSULTS) | set(THREATS)
    best = rated.where((F.col("bad") >= min_documents) & (F.col("odds") >= 2.0)).orderBy(
        (F.col("bad") * F.col("odds")).desc(), "term"
    ).limit(max_terms).collect()
    seen = {r.term: r for r in rated.where(F.col("term").isin(*general)).collect()}
    insults = {w: 1.5 for w in INSULTS if w not in seen or seen[w].odds >= 0.5}
    threats = {w: 1.0 for w in THREATS if w not in seen or seen[w].odds >= 0.5}
    stems_kept: dict[str, float] = {}
    for r in best:
        bare = r.term.lstrip("^")
        weight = min(float(r.odds), 6.0)
        if r.term[0] != "^":
            if not any(bare.startswith(s) for s in stems_kept):
                insults[bare] = weight
        elif not any(bare.startswith(s) or s.startswith(bare) for s in stems_kept) and not any(w.startswith(bare) for w in insults if w in INSULTS):
            stems_kept[bare] = weight
    grammar = Grammar(insults, stems_kept, threats)
    rows = _scan(sample.select("id", "y", "body"), grammar, 2).select("y", "x1", "x2").collect()  # bounded by the sample
    if len({r.y for r in rows}) < 2:
        return grammar
    x, y = np.array([(r.x1, r.x2) for r in rows]), np.array([r.y for r in rows], float)
    weight = np.where(y == 1, sizes[1] / max(n_bad, 1), sizes[0] / max(n_good, 1))
    grammar.curve = _fit_curve(x, y, weight / weight.mean())
    return grammar


def _scan(rows: DataFrame, grammar: Grammar, text_at: int) -> DataFrame:
    """The two leading columns (id, y) with the evidence of the text in column ``text_at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in batches:
            found = [_features(grammar, automaton, t.as_py()) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([[{"begin": a, "end": b, "score": s} for a, b, s in f[2]] for f in found],
                          pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                ["id", "y", "x1", "x2", "clauses"],
            )

    return rows.mapInArrow(run, "id long, y int, x1 double, x2 double, clauses array<struct<begin:int,end:int,score:double>>")


def score(
    docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, score, predicted, clauses) per row; whole texts, null counting as empty. Clauses are in code points of the lower-case text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.lit(None).cast("int").alias("y"), F.col(text).alias("body"))
    a, b, c = grammar.curve
    z = F.lit(a) + F.lit(b) * F.col("x1") + F.lit(c) * F.col("x2")
    value = 1 / (1 + F.exp(-z))
    return _scan(rows, grammar, 2).select(
        F.col("id").alias("doc_id"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"), "clauses"
    )
