import hashlib
import random

import numpy as np
import pytest
from conftest import SF_DIR, rows
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from ridelake.llm import merkle
from ridelake.llm.queries import QUERIES
from ridelake.llm.sql import MERKLE_SQL


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level):
    """The root of a list of digests, and for each the sibling of every level with its side ('' and 0: none)."""
    ways, spots = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, s in enumerate(spots):
            ways[i].append((level[s ^ 1] if s ^ 1 < len(level) else "", s & 1))
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        spots = [s // 2 for s in spots]
    return level[0], ways


def brute(docs):
    """(doc_id, text, lang, claimed): plain lists, one tree after another."""
    parts = sorted({d[2] for d in docs}, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in parts:
        mine = sorted([d for d in docs if d[2] == p], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d[0], d[1], d[2])))
        trees[p] = (mine, *climb([leaf(*d[:3]) for d in mine]))
    root, upper = climb([trees[p][1] for p in parts])
    out = []
    for p, above in zip(parts, upper, strict=True):
        mine, sub, ways = trees[p]
        for d, way in zip(mine, ways, strict=True):
            way = way + above
            end = leaf(*d[:3]) if d[3] is None else leaf(d[0], d[3], d[2])
            for other, side in way:
                end = H(other, end) if side else H(end, other)
            out.append((d[0], leaf(*d[:3]), sub, root, H(*[o for o, _ in way]), end, end == root))
    return sorted(out, key=repr)


def _proofs(spark, docs, edge):
    df = spark.createDataFrame([(*d, b"x", 1) for d in docs], "doc_id long, text string, lang string, claim string, digest binary, position int")
    fields = ("doc_id", "text", "lang")
    claimed = merkle.row_digest(F.col("doc_id"), F.coalesce("claim", "text"), F.col("lang"))
    return merkle.manifest(df, fields, claimed=claimed, edge=edge).proofs()


@pytest.mark.parametrize("edge", [1, 3, 12])
def test_against_plain_lists(spark, edge):
    rng = random.Random(edge)
    docs = [
        (rng.choice([None, *range(60)]), rng.choice(["", "a", "é", None, "b" * 5000]), rng.choice(["en", "de", "", None, "ü"]),
         rng.choice([None, None, "forged"]))
        for _ in range(45)
    ]
    docs = [d for d in docs if d[1] is not None or d[3] is None]
    docs += [(7, "twin", "en", None)] * 3 + [(1, "alone", "fr", None)]
    assert rows(_proofs(spark, docs, edge)) == brute(docs)


def test_one_row_and_none(spark):
    assert rows(_proofs(spark, [(1, "x", "en", None)], 2)) == brute([(1, "x", "en", None)])
    assert rows(_proofs(spark, [(1, "x", "en", "y")], 2))[0][-1] is False
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(empty).proofs().count() == 0


@pytest.mark.parametrize("levels", range(1, 14))
def test_addresses_are_a_permutation_with_aligned_subtrees(levels):
    places = [merkle.address(d, np.arange(1 << d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << levels) - 1))
    top = levels // 2
    if top:  # the top half comes first, each subtree below it lies in one piece
        assert max(p.max() for p in places[:top]) == (1 << top) - 2
        below = levels - top
        for root in range(1 << top):
            piece = np.concatenate([places[d][root << (d - top):(root + 1) << (d - top)] for d in range(top, levels)])
            assert piece.max() - piece.min() == (1 << below) - 2 and len(piece) == (1 << below) - 1


def test_blocks_of_a_tier_hold_at_most_their_size(spark):
    df = spark.range(1000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    forest = merkle.plant(df.select("tree", "id", F.unhex("h").alias("digest")), ["id"], edge=4)
    assert [t.count() for t in forest.tiers] == [63, 4, 1]
    assert max(r.n for r in forest.tiers[0].select(F.length("nodes").alias("n")).collect()) == 31 * 32
    assert forest.roots().first().digest.hex() == climb([hashlib.sha256(str(i).encode()).hexdigest() for i in range(1000)])[0]


def test_query_matches_sql(spark):
    assert compare(QUERIES["op12_merkle_manifest"](spark, SF_DIR), duck(SF_DIR), MERKLE_SQL) == []
