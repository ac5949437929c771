import random

import numpy as np
import xxhash

from ridelake.llm import simhash
from ridelake.llm.graph import components


def brute_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [words[i:i + width] for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, keys, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    ids = {}
    for i, k in enumerate(keys):
        if k is not None:
            ids[find(i)] = min(k, ids.get(find(i), k))
    return [ids.get(find(i)) for i in range(len(prints))]


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_documents(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["É", "MiX", "a b"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 4, 5, 90]))) for _ in range(30)]
    rows = []
    for i in range(150):
        text = rng.choice(base)
        if rng.random() < 0.5:
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = rng.choice([" ", "\t", "\n \x0b"]).join(parts)
        rows.append((rng.randint(0, 200), text))
    rows += [(500, None), (501, ""), (499, " \n"), (None, base[0]), (None, "only here " * 9), (502, "x " * 70_000), rows[0]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = zip([d for d, _ in rows], [f"{p:016x}" for p in prints], brute_components(prints, [d for d, _ in rows]), strict=True)
    found = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_connect_as_all_distances_do(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = {near(rng, rng.choice(centres), rng.choice([0, 1, 2, 3, 4, 5, 6])) for _ in range(700)}
    prints = sorted(prints | {0, 2**64 - 1})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    wanted = brute_components(prints, signed)
    for segments in (2, 3):
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        found = components(simhash.links(df, 4, segments)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, []).append(r.node)
        least = {n: min(g) for g in groups.values() for n in g}
        assert [least.get(x, x) for x in signed] == wanted


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (7, None)]
    found = components(spark.createDataFrame(chain + star, "a long, b long")).collect()
    assert len(found) == 101 + 60
    assert len({r.root for r in found}) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
