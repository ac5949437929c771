"""Connected components, and registrations settled by them, against plain loops."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.plans import components as module
from ridelake.plans.components import components
from ridelake.sources import ingest


def _plain(links):
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return sorted(((n, find(n)) for n in root), key=repr)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(160)] + [(1000, 1000), (2000, 2001), (2000, 2001)]
    links += [(5000, 6000 + i) for i in range(50)]
    assert rows(components(spark.createDataFrame(links, "a long, b long"))) == _plain(links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    mark = module._mark
    monkeypatch.setattr(module, "_mark", lambda links: rounds.append(1) or mark(links))
    n = 2000
    chain = spark.range(n).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert components(chain).select("root").distinct().count() == 1
    assert len(rounds) <= 12  # log2(2000) and one to see the end


def _greedy(requests):
    emails, phones, won = set(), set(), []
    for email, phone, _, request in sorted(requests, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        if email not in emails and phone not in phones:
            emails.add(email)
            phones.add(phone)
            won.append((request,))
    return sorted(won, key=repr)


@pytest.mark.parametrize("rounds, largest", [(4, 100_000), (0, 100_000), (1, 5)])
def test_registrations_in_order(spark, rounds, largest):
    rng = random.Random(largest)
    requests = [(f"e{rng.randrange(60)}", f"p{rng.randrange(60)}", rng.choice([None, *range(30)]), i) for i in range(120)]
    requests += [(f"c{(i + 1) // 2}", f"d{i // 2}", i, 1000 + i) for i in range(40)]  # a chain
    requests += [("busy", f"x{i}", 5, 2000 + i) for i in range(30)] + [("own", "own", 1, 3000)]
    frame = spark.createDataFrame(requests, "email_key string, phone_key string, submitted_at int, request_id long")
    assert rows(ingest._first_come(frame, rounds, largest)) == _greedy(requests)
