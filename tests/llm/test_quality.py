from conftest import SF_DIR
from oracle_compare import compare, duck

from ridelake.llm import quality
from ridelake.llm.queries import QUERIES
from ridelake.llm.sql import QUALITY_SQL


def test_nulls_ties_and_long_texts(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "x y z x y z q", None), (3, "x y z x y z q", None), (None, "a\na\n \n\n#b| c", "b"),
        (4, "w " * 50_000, "c"), (5, " ".join(f"v{i}" for i in range(60)), None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    found = sorted(
        (tuple(r) for r in quality.document_measures(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()),
        key=repr,
    )
    assert found == sorted([
        (1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 7, 7, 0, 0, 6), (3, 7, 7, 0, 0, 6), (None, 3, 7, 2, 1, 0),
        (4, 50_000, 50_000, 0, 0, 50_000), (5, 60, 170, 0, 0, 0),
    ], key=repr)
    kept = {r.doc_id: r.kept for r in quality.apply_host_rules(df).collect()}
    assert kept[5] and not kept[4] and not kept[1] and not kept[3]


def test_a_failing_host_loses_all_documents(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(40)] + [(100, long, "bad")] + [(200 + i, long, f"good{i % 5}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.apply_host_rules(df).collect()}
    assert not kept[100] and all(kept[200 + i] for i in range(100))
    assert quality.apply_host_rules(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    assert compare(QUERIES["op3_host_quality"](spark, SF_DIR), duck(SF_DIR), QUALITY_SQL) == []
