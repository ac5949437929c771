"""Language identification: script ranges, per-word scores, and a Viterbi path over the words.

Training counts byte n-grams of words per language in hashed cells, and how many words of a language are written in
each script. A word's script narrows its candidates; each candidate scores the word by its
n-grams; the path through all words that pays a penalty per switch labels spans. A document's language is the one
with most words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.samples import smallest_hashes_per_group

UNKNOWN = "und"
CELLS, GRAMS = 1 << 16, (1, 2, 3, 4)
_WORD = regex.compile(r"\p{L}+")  # letters alone; superscripts, fractions and the like are none
_SLICE = 1 << 21  # code points labelled at once; a longer text is a slice of its own

# First code points of script ranges, each up to the next one's.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    points = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1]


def _cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word) of each byte n-gram of the words, which are taken with a blank on either side."""
    raw = [w.encode("utf-8", "replace") for w in words]
    flat = np.frombuffer(b" " + b" ".join(raw) + b" " + b"\0" * max(GRAMS), np.uint8).astype(np.uint32)
    lengths = np.array([len(w) for w in raw])
    ends = np.cumsum(lengths + 1)  # places of the blanks behind the words
    word = np.repeat(np.arange(len(raw)), lengths + 1)  # of the places from a word's first blank to its last byte
    place = np.arange(len(word))
    found, owners = [], []
    value = np.zeros(len(word), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        value = value * np.uint32(0x9E3779B1) + flat[n - 1:n - 1 + len(word)] + np.uint32(n)
        if n in GRAMS:
            inside = place + n - 1 <= ends[word]
            mixed = (value ^ value >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            found.append((mixed[inside] >> np.uint32(16)).astype(np.int64))
            owners.append(word[inside])
    return np.concatenate(found), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Model:
    """Scores of n-gram cells per language, and the candidates per script."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_words: np.ndarray, candidate_share: float):
        self.languages = languages
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * CELLS) if len(languages) else counts
        self.scores = np.ascontiguousarray(np.log(share).T.astype(np.float32)) if len(languages) else counts.T
        written = script_words / np.maximum(script_words.sum(axis=1, keepdims=True), 1)
        allowed = (written >= candidate_share).T  # script by language
        self.allowed = allowed | ~allowed.any(axis=1, keepdims=True)  # an unseen script narrows nothing

    def word_scores(self, words: list[str], floor: float) -> np.ndarray:
        """Per word and language: log-likelihood below the best candidate, ``floor`` at worst; non-candidates twice that."""
        cell, owner = _cells(words)
        total = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(owner, self.scores[:, k][cell], len(words))
        allowed = self.allowed[scripts_of(words)]
        total[~allowed] = -np.inf
        total -= total.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(total, floor), 2 * floor)


def train(rows: DataFrame, text: str, lang: str, candidate_share: float = 0.01) -> Model:
    """A model of all ``rows`` with text and language; take a bounded sample. Counts per language meet on the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                if words:
                    grams, scripts = held.setdefault(name, [np.zeros(CELLS, np.int64), np.zeros(len(_NAMES), np.int64)])
                    grams += np.bincount(_cells(words)[0], minlength=CELLS)
                    scripts += np.bincount(scripts_of(words), minlength=len(_NAMES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), *(pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1))],
            ["lang", "grams", "scripts"],
        )

    wanted = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals: dict[str, list] = {}
    # One row per language and task, of fixed size.
    for r in wanted.repartition(8).mapInArrow(count, "lang string, grams binary, scripts binary").toLocalIterator():
        grams, scripts = totals.setdefault(r.lang, [np.zeros(CELLS, np.int64), np.zeros(len(_NAMES), np.int64)])
        grams += np.frombuffer(r.grams, np.int64)
        scripts += np.frombuffer(r.scripts, np.int64)
    names = sorted(totals)
    counts = np.array([totals[n][0] for n in names]).reshape(len(names), CELLS)
    return Model(names, counts, np.array([totals[n][1] for n in names]).reshape(len(names), len(_NAMES)), candidate_share)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels for sequences laid end to end, all sequences step by step at once, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order] if len(lengths) else lengths
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")  # longer than each step
    best = np.zeros((len(lengths), scores.shape[1]), np.float32)
    stay, before = np.ones(scores.shape, bool), np.zeros(len(scores), np.int16)
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            now = best[:n]
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - penalty
            keep = now >= jump[:, None]
            stay[at], before[at] = keep, top
            best[:n] = np.where(keep, now, jump[:, None])
        best[:n] += scores[at]
        best[:n] -= best[:n].max(axis=1, keepdims=True)
    labels = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], before[at])
    return labels


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in their order, in runs of up to ``_SLICE`` code points or of one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > _SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def label_words(model: Model, texts: list[str | None], penalty: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all words of all texts, and the number of words per text. Memory: words by languages of one slice."""
    labels, lengths = [np.zeros(0, np.int16)], []
    for run in slices(texts):
        words = [words_of(t) for t in run]
        counts = np.array([len(w) for w in words], np.int64)
        lengths.append(counts)
        flat = pa.array(list(chain.from_iterable(words)), pa.string())
        if len(flat):
            coded = flat.dictionary_encode()
            by_word = model.word_scores(coded.dictionary.to_pylist(), floor)
            labels.append(viterbi(by_word[coded.indices.to_numpy()], counts, penalty))
    return np.concatenate(labels), np.concatenate([np.zeros(0, np.int64), *lengths])


def _spans(text: str, labels: np.ndarray, languages: list[str]) -> list[dict]:
    places = [m.span() for m in _WORD.finditer(text)]
    if len(places) != len(labels):  # lower-casing moved a word border: places of the lower-cased text
        places = [m.span() for m in _WORD.finditer(text.lower())]
    cut = np.flatnonzero(np.diff(labels)) + 1
    return [
        {"begin": places[a][0], "end": places[b - 1][1], "lang": languages[labels[a]]}
        for a, b in zip([0, *cut], [*cut, len(labels)], strict=True)
    ]


RESULT = "doc_id long, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"


def identify(
    docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    max_training: int = 1000, penalty: float = 12.0, floor: float = -8.0, with_spans: bool = False,
) -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row of ``docs``, its columns other than id and text unread.

    The model is fitted on the ``max_training`` rows of each language in ``training`` with the smallest hashed ids, so a rare
    language is learned too. ``score`` is the share of words
    labelled with the predicted language, ties going to the first by name. A null text, one without letters, or
    no training rows give ``und`` and 0. Spans (begin, end in code points, language) are null unless asked for.
    """
    sample = smallest_hashes_per_group(training, doc_id, lang, max_training)
    model = train(sample, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells by languages: a fixed size per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model.languages:
                labels, lengths = label_words(model, texts, penalty, floor)
            else:
                labels, lengths = np.zeros(0, np.int16), np.zeros(len(texts), np.int64)
            names, shares, spans = [], [], []
            at = 0
            for body, n in zip(texts, lengths.tolist(), strict=True):
                own = labels[at:at + n]
                at += n
                votes = np.bincount(own, minlength=1)
                names.append(model.languages[int(votes.argmax())] if n else UNKNOWN)
                shares.append(float(votes.max() / n) if n else 0.0)
                spans.append((_spans(body, own, model.languages) if n else []) if with_spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RESULT)
