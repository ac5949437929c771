import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ridelake.llm import langid
from ridelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 2
    found = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own = scores[at:at + n]
        value = lambda p, own=own: sum(own[i, s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert abs(value(best) - value(found[at:at + n])) < 1e-4
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op4_language_spans"](spark, SF).where("held_out").join(docs, "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_scripts_spans_and_empty_cases(spark):
    rng = random.Random(1)
    latin = ["the", "house", "water", "green", "and"]
    greek = ["και", "νερό", "σπίτι", "είναι"]
    rows = [(i, " ".join(rng.choice(latin if i % 2 else greek) for _ in range(30)), "en" if i % 2 else "el") for i in range(60)]
    train = spark.createDataFrame([*rows, (None, "x", "en"), (999, None, "en"), (998, "y", None)], "doc_id long, text string, lang string")
    tests = [(1, "the water and the green house 12 και νερό είναι σπίτι"), (2, None), (3, "12 !!"), (3, "12 !!"), (None, "house"), (4, "water " * 30_000)]
    df = spark.createDataFrame([(*t, 7) for t in tests], "doc_id long, text string, spans int")
    found = langid.identify(df, train, with_spans=True).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 6 and [s.lang for s in by[1].spans] == ["en", "el"] and by[1].lang_pred == "en"
    assert (by[2].lang_pred, by[2].score, by[3].lang_pred) == ("und", 0.0, "und") and by[4].score == 1.0
    assert {r.lang_pred for r in langid.identify(df, train.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), train).count() == 0


def test_numerals_are_no_letters(spark):
    train = spark.createDataFrame([(i, "the water and the house", "en") for i in range(20)], "doc_id long, text string, lang string")
    texts = [(1, "\u00bd \u00b2"), (2, "\u2167 12 _ \u0661"), (3, "water\u00b2"), (4, "\u6c34")]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), train).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "en", "en"]
    assert [found[i].score for i in (1, 2)] == [0.0, 0.0]


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the water and the green house", "en") for i in range(300)] + [(1000, "zzyx qwrk vvlk zzyx", "xx")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "qwrk zzyx vvlk qwrk"), (2, "green water")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, train, max_training=10).collect()}
    assert found == {1: "xx", 2: "en"}


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, (2, langid.CELLS))
    model = langid.Model(["a", "b"], counts, np.ones((2, len(langid._NAMES)), int), 0.01)
    texts = ["water house", None, "", "green " * 40, "the and the", "12", "house"]
    whole = langid.label_words(model, texts, 1.0, -8.0)
    monkeypatch.setattr(langid, "_SLICE", 12)
    assert [len(s) for s in langid.slices(texts)] == [3, 1, 1, 2]
    parts = langid.label_words(model, texts, 1.0, -8.0)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
