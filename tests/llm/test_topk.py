import math
import random

import numpy as np
import pytest
from conftest import SF_DIR, rows
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from ridelake.llm import topk
from ridelake.llm.queries import QUERIES
from ridelake.llm.sql import TOP_K_SQL


def brute(table, asks, k, scale=64):
    good = []
    for key, vector in table:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((key, [math.floor(scale * x) for x in vector]))
    out = []
    for i, (query, q) in enumerate(good):
        if query is None or not asks(query):
            continue
        scored = [(sum(a * b for a, b in zip(q, c)), key) for j, (key, c) in enumerate(good) if j != i]
        scored = [(max(-(2**63), min(2**63 - 1, s)), key) for s, key in scored]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(query, rank, key, score) for rank, (score, key) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def _found(spark, table, k, kind="double", **sizes):
    df = spark.createDataFrame([(*t, 5, "x") for t in table], f"vec_id long, embedding array<{kind}>, row int, g string")
    return topk.nearest(df, F.col("vec_id") % 3 == 0, k=k, **sizes)


def _vectors(rng, n, width, spread):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [
        (i, [spread ** rng.random() * (x + rng.gauss(0, 0.2)) for x in rng.choice(centres)]) for i in range(n)
    ]


@pytest.mark.parametrize("spread", [1.0, 50.0])
def test_against_all_products(spark, spread):
    rng = random.Random(13)
    table = _vectors(rng, 300, 8, spread)
    table += [(301, table[3][1])] * 3 + [(None, table[6][1]), (900, None), (903, [1.0, None]), (906, [math.nan] * 8), (909, [math.inf])]
    table += [(912, []), (915, [0.0] * 8), (918, [-1.0] * 8), (921, [2.5, 1.0]), (0, table[0][1])]
    rng.shuffle(table)
    found = _found(spark, table, 5, bucket=32, query_block=16)
    assert rows(found) == brute(table, lambda i: i % 3 == 0, 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_few_rows_none_and_huge_components(spark):
    few = [(0, [1.0, 2.0]), (3, [0.5, -0.25])]
    assert rows(_found(spark, few, 20)) == brute(few, lambda i: i % 3 == 0, 20)
    assert _found(spark, few[:1], 20).count() == 0
    assert _found(spark, [], 20).count() == 0
    huge = [(i, [3.0e38 * s, 1.0, 1e16]) for i, s in enumerate([1, -1, 1, 0, 0.5])] + [(6, [2.0**50, 1.0, 3.0])]
    assert rows(_found(spark, huge, 2)) == brute(huge, lambda i: i % 3 == 0, 2)


def test_pruning_loses_nothing_and_spares_products():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    vectors = np.floor(64 * (centre[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))) * rng.uniform(0.2, 3, (4000, 1)))
    lengths = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    vectors, lengths, ids = vectors[order], lengths[order], np.arange(4000)
    asking = np.arange(0, 4000, 40)
    block = topk.Block(asking, asking, vectors[asking], lengths[asking], np.full(100, -np.inf), 10)
    for at in range(0, 4000, 250):
        part = slice(at, at + 250)
        block.meet(ids[part], ids[part], np.zeros(250, bool), vectors[part], lengths[part])
    for i, q in enumerate(asking):
        scores = (vectors @ vectors[q]).astype(np.int64)
        want = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != q)[:10]
        assert [(-s, j) for s, j in zip(block.best[i][0].tolist(), block.best[i][2].tolist(), strict=True)] == want
    assert block.pruned["skipped"] and block.pruned["coordinate"] and block.pruned["length"]
    assert block.pruned["verified"] < 0.7 * 100 * 4000


def test_query_matches_sql(spark):
    assert compare(QUERIES["op13_norm_bucketed_top_k"](spark, SF_DIR), duck(SF_DIR), TOP_K_SQL) == []
