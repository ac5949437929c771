import itertools
import random
import re

from conftest import SF_DIR, rows
from oracle_compare import compare, duck

from ridelake.llm import audit
from ridelake.llm.queries import QUERIES
from ridelake.llm.sql import AUDIT_SQL


def brute(docs, labels):
    """One document at a time through every order."""
    def words(text):
        return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]

    def fails(doc):
        key, text, _ = doc
        w, text = words(text or ""), text or ""
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs),
        }

    failed = [fails(d) for d in docs]
    out = []
    for part in {d[2] or "" for d in docs}:
        mine = [(d, f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        cut = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[letter]]
                left = [(d, f) for d, f in left if not f[letter]]
                lost = lambda i: sum(any(lab[0] == d[0] and lab[i] == 1 for lab in labels) for d, _ in gone)  # noqa: B023, E731
                cut[order, step] = (
                    len(left), len(gone), sum(f[letter] for _, f in mine) - len(gone),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in mine), lost(1), lost(2),
                )
        for (order, step), counts in cut.items():
            total = sum(c[1] for (o, s), c in cut.items() if o[s - 1] == order[step - 1])
            out.append((part, order, step, *counts, total))
    return sorted(out, key=repr)


def test_against_every_document_in_every_order(spark):
    rng = random.Random(11)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long + " #", "A B C", "", None, "a " * 300, ("Xy " * 260) + "$", long.upper(), "é| x", long + "\n"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(70)]
    docs += [(3, long, "en")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, None]]
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id int, text string, lang string, part int, mask boolean")
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, lang string")
    found = audit.interactions(df, marks)
    assert rows(found) == brute(docs, labels)
    assert found.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in (*audit.COUNTS, "shapley")]]


def test_empty_tables_and_a_long_text(spark):
    docs = "doc_id long, text string, lang string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(spark.createDataFrame([], docs), labels).count() == 0
    one = audit.interactions(spark.createDataFrame([(1, "v " * 400_000, "en")], docs), labels)
    assert one.where("filter_order = 'ABCDE'").orderBy("step").select("kept", "removed", "unique_fails").collect() == [
        (1, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)
    ]


def test_query_matches_sql(spark):
    assert compare(QUERIES["op11_filter_interactions"](spark, SF_DIR), duck(SF_DIR), AUDIT_SQL) == []
