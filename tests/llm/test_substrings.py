import hashlib
import random

from ridelake.llm.substrings import WIDTH, remove_repeats


def brute(rows):
    """Per row: bytes, removed bytes, spans, digest of the rest, by a plain dictionary of all strings."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - WIDTH + 1):
                s = b[i:i + WIDTH]
                least[s] = min(d, least.get(s, d))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - WIDTH + 1):
                if least[b[i:i + WIDTH]] < d:
                    gone[i:i + WIDTH] = [True] * WIDTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        (tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr
    )


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "and", "of", "anea", "thün", "ß", "reing", "ontion", "x" * 30]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(rng.randint(8, 60)) for _ in range(5)] + ["a" * 120, "ab" * 40]
    rows = []
    for d in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else line(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        text = rng.choice(["", " ", "\n"]).join(parts)
        rows.append((rng.randint(0, n), text))
    rows += [(n + 1, None), (n + 2, ""), (None, shared[0]), (None, shared[0]), (n + 3, shared[0] * 40), rows[0], rows[1]]
    return rows


def test_against_all_strings(spark):
    for seed in (1, 2):
        rows = corpus(seed, 60)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(remove_repeats(df)) == brute(rows)


def test_border_lengths(spark):
    base = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(130))
    rows = [(1, base), (2, "??" + base[10:10 + WIDTH - 1] + "??"), (3, "!!" + base[10:10 + WIDTH] + "!!"), (4, base[40:]), (5, base)]
    assert found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    from ridelake.llm import substrings

    monkeypatch.setattr(substrings, "_PIECE", 64)
    rows = corpus(3, 10)
    docs = [r for r in rows if r[0] is not None]
    ids, bodies = zip(*sorted((d, (t or "").encode()) for d, t in docs), strict=True)
    import numpy as np

    small = substrings.Phrases(np.array(ids), list(bodies))
    covered = np.zeros(len(small.raw), bool)
    for a, b in zip(small.first, small.last, strict=True):
        assert not covered[a:b + 1].any()
        covered[a:b + 1] = True
    assert covered.sum() == sum(max(0, len(b) - WIDTH + 1) for b in bodies)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block int, payload string")
    assert remove_repeats(empty).count() == 0
    kept = remove_repeats(spark.createDataFrame([(1, "abc", 3, "p")], empty.schema), keep_text=True).collect()
    assert [(r.doc_id, bytes(r.kept), r.spans) for r in kept] == [(1, b"abc", [])]
