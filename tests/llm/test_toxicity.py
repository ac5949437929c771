import time

from pyspark.sql import functions as F

from ridelake.llm.queries import QUERIES
from ridelake.llm.toxicity import Grammar, clause_score, learn, matched_clauses, score

SF = "/root/testdata/sf0.1"


def test_clause_states():
    g = Grammar({"idiot": 1.0, "trash": 1.0}, {"grob": 2.0})
    plain = clause_score(g, ["an", "idiot"])
    assert plain == 1.0
    assert clause_score(g, ["you", "idiot"]) > plain > clause_score(g, ["not", "an", "idiot"])
    assert clause_score(g, ["she", "said", "idiot"]) < clause_score(g, ["she", "idiot"])
    assert clause_score(g, ["i", "kill", "time"]) == 0 < clause_score(g, ["i", "kill", "you"])
    assert clause_score(g, ["grobian"]) == 2.0 and clause_score(g, ["vergrob"]) == 0
    text = "all is well. an idiot, trash! an idiotic one\nno idiot"
    assert [(text[a:b].strip(), s) for a, b, s in matched_clauses(g, g.automaton(), text)] == [("an idiot, trash", 2.0), ("no idiot", 0.4)]


def test_held_out_precision_and_recall(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = QUERIES["op2_toxicity_grammar"](spark, SF).where("held_out").join(labels, "doc_id")
    hits, told, bad = found.agg(
        F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")
    ).first()
    assert hits / told > 0.85 and hits / bad > 0.8


def test_nulls_and_no_labels(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (None, "you idiot. " * 20_000, 1), (4, "fine", 1), (4, "fine", 1)], "doc_id long, text string, y int"
    )
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = score(df, learn(df, none)).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert max(found, key=lambda r: r.score).doc_id is None
    assert score(df.limit(0), Grammar({})).count() == 0


def test_long_texts_without_marks_take_linear_time():
    grammar = Grammar({"idiot": 1.0})
    automaton = grammar.automaton()
    text = "you idiot\n" * 200_000
    begin = time.perf_counter()
    found = matched_clauses(grammar, automaton, text)
    assert len(found) == 200_000 and found[1][:2] == (10, 19)
    assert time.perf_counter() - begin < 20  # minutes when each mark is looked for from the beginning
