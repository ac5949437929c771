import random

from ridelake.llm.lines import chunks, cuts, remove_chunks


def brute(rows, divisor=3, least=2):
    texts = sorted((d, (t or "").encode(), i) for i, (d, t) in enumerate(rows) if d is not None)
    seen, out = set(), []
    for d, body, _ in texts:
        lines, gone = body.split(b"\n"), set()
        for low, high, text in chunks(body, divisor, least):
            if text in seen:
                gone.update(range(low, high))
            seen.add(text)
        out.append((d, b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(lines), len(gone)))
    out += [(None, t or "", len((t or "").split("\n")), 0) for d, t in rows if d is None]
    return sorted(out, key=repr)


def test_against_plain_loop(spark):
    rng = random.Random(2)
    lines = [f"line {i} ü" for i in range(40)] + ["", " "]
    passage = [[rng.choice(lines) for _ in range(rng.randint(2, 12))] for _ in range(6)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passage) if rng.random() < 0.5 else [f"own {rng.random()}" for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 100), "\n".join(parts)))
    rows += [(1000, None), (1001, ""), (None, "a\nb\nc"), (None, None), rows[0], rows[0], (1002, "\n".join(lines * 200))]
    df = spark.createDataFrame([(*r, k, "p") for k, r in enumerate(rows)], "doc_id long, text string, n long, kept_text string")
    found = remove_chunks(df.repartition(4), carry=("n",))
    got = sorted((tuple(r) for r in found.select("doc_id", "kept_text", "n_lines", "n_removed").collect()), key=repr)
    assert got == brute(rows)
    assert sorted(r.n for r in found.select("n").collect()) == list(range(len(rows)))
    assert remove_chunks(df.limit(0)).count() == 0


def test_boundaries_come_back_after_an_insertion():
    lines = [f"l{i}".encode() for i in range(200)]
    before = {lines[e - 1] for e in cuts(lines, 3)}
    after = {(lines[:50] + [b"new"] + lines[50:])[e - 1] for e in cuts(lines[:50] + [b"new"] + lines[50:], 3)}
    assert len(before ^ after) <= 3


def test_every_repeated_run_goes_whole(spark):
    rng, rows, whole = random.Random(5), [], {}
    own = iter(range(10**6))
    for n in range(2, 40):
        for gap in ("\n", "\n\n"):
            passage = gap.join(f"passage {n} {len(gap)} {i}" for i in range(n))
            for copy in range(3):
                around = [[f"own {next(own)}" for _ in range(rng.randint(1, 4))] for _ in range(2)]
                rows.append((len(rows), "\n".join([*around[0], passage, *around[1]])))
                whole[len(rows) - 1] = 0 if copy == 0 else passage.count("\n") + 1
    found = remove_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_removed for r in found} == whole
    assert all(len(r.removed) == (whole[r.doc_id] > 0) for r in found)


def test_repeats_that_overlap_or_differ(spark):
    rows = [(1, "a\na\na\na\na\nz"), (2, "x\na\na\na\ny"), (3, "one\nsingle\ntwo"), (4, "three\nsingle\nfour"), (5, "one\n\nsingle")]
    got = {r.doc_id: r.kept_text for r in remove_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].startswith("a\na\n") and got[2] == "x\ny"
    assert [got[k] for k in (3, 4, 5)] == [t for _, t in rows[2:]]
