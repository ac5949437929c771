import itertools
import random

from ridelake.llm.decontam import agreeing, contaminated
from ridelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ITEM = "If Anna walks 12 miles in 3 hours, then how many hours will Anna need to walk 24 miles along the river?"
TWICE = "Today Anna went to the old market with her mother and there Anna bought some apples for the whole family"


def test_templates_and_slots(spark):
    items = spark.createDataFrame([(7, ITEM, "x"), (8, None, "x"), (9, "too short", "x"), (7, ITEM, "x"), (11, TWICE, "x")], "item_id long, text string, doc_id string")
    rows = [
        (1, "Foo bar. " + ITEM + " Baz"), (2, "say " + ITEM.replace("Anna", "Boris").replace("12", "15").replace("24", "30")),
        (3, TWICE.replace("there Anna", "there Boris")), (12, TWICE.replace("Anna", "Boris")), (4, "the river is long and nobody walks along it in winter or in spring"),
        (5, None), (6, ""), (None, ITEM), (1, "other"), (10, "pad words here " * 20_000 + ITEM.upper()),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
    found = {r.doc_id: r for r in contaminated(df, items).collect()}
    assert set(found) == {1, 2, 3, None, 10, 12}  # 3: one slot with two values, but 12 tokens word for word
    assert not found[1].reparameterised and found[2].reparameterised and found[1].item_id == 7
    assert contaminated(df.limit(0), items).count() == 0 and contaminated(df, items.limit(0)).count() == 0


def test_query_finds_every_whole_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id for r in QUERIES["op5_template_decontamination"](spark, SF).collect()}
    held = {d.doc_id for d in docs if any(i in (d.text or "") for i in items)}
    part = {d.doc_id for d in docs if any(i[20:70] in (d.text or "") for i in items)}
    assert held and held <= found <= held | part


def test_slots_that_merge_clash_or_mix(spark):
    long = ITEM + " She rests beside the old stone bridge while Anna counts all of the boats that pass under it before lunch."
    sold = "The old farmer sold 12 of his sheep at the market and later bought 24 more of them from his kind neighbour"
    items = spark.createDataFrame([(7, ITEM), (8, long), (9, sold)], "item_id long, text string")
    rows = [
        (1, sold.replace("12", "15").replace("24", "15")),  # two item values become one
        (2, long.replace("while Anna", "while Boris")),  # one of three changed
        (None, ITEM), (None, ITEM.replace("12", "15").replace("Anna", "Boris")),
        (3, ITEM), (3, ITEM.replace("3 hours", "5 hours")),
    ]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.item_id == 7} >= {(2, 7), (None, 7), (3, 7)}
    assert {(1, 9), (2, 8)} <= {(r.doc_id, r.item_id) for r in found}
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})


def test_largest_agreeing_set():
    name = ("name", "anna")
    hits = [(0, {name: "anna"}), (1, {}), (20, {name: "boris"}), (28, {name: "boris"})]
    assert agreeing(hits, 8) == [hits[1], *hits[2:]]
    assert agreeing([(0, {name: "boris"}), (9, {name: "anna"})], 8) == [(9, {name: "anna"})]
    assert agreeing([], 8) == []


def test_agreeing_set_equals_all_subsets():
    rng = random.Random(5)
    for _ in range(150):
        hits = []
        for place in sorted(rng.sample(range(40), rng.randint(0, 9))):
            keys = rng.sample("abcd", rng.randint(0, 3))
            hits.append((place, {("name", k): rng.choice([k, "x", "y"]) for k in keys}))

        def score(some):
            cover = len({t for p, _ in some for t in range(p, p + 8)})
            return cover, len(some), sum(v == k[1] for _, s in some for k, v in s.items())

        def fits(some):
            seen = {}
            return all(seen.setdefault(k, v) == v for _, s in some for k, v in s.items())

        subsets = (s for n in range(len(hits) + 1) for s in itertools.combinations(hits, n) if fits(s))
        found = agreeing(hits, 8)
        assert fits(found) and score(found) == max(map(score, subsets))


def test_agreeing_set_of_many_contradictions():
    # 8 names, each twice in the item and with two values in the text: all open at the middle. Every other window overlaps nothing.
    twice = [(7 * i, {("name", str(i % 8)): f"{i // 8}"}) for i in range(16)]
    assert len(agreeing(twice, 8)) == 8
    # 60 slots, each contradicted by the next windows.
    near = [(3 * i, {("num", str(i // 2)): "xy"[i % 2], ("name", str(i // 3)): "uvw"[i % 3]}) for i in range(120)]
    found = agreeing(near, 8)
    assert len({(k, v) for _, s in found for k, v in s.items()}) == len({k for _, s in found for k in s}) and len(found) >= 40


def test_items_without_windows_and_runs(spark):
    runs = "In the summer Mary Ann planted twenty-five small trees behind the long wall while her brothers slept under the roof"
    items = [(1, "What is 7 times 8?"), (2, "3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (3, runs), (4, ""), (5, "?"), (6, "Paris")]
    rows = [
        (1, "He asked: what is 7 times 8? Nobody knew"), (2, "what is 7 times 9?"), (3, "0 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"),
        (4, "3 4 5 6 7 8 9 10 11 12 13 14 15 17"), (5, runs.replace("Mary Ann", "Bob").replace("twenty-five", "25")), (6, None),
        (7, "what is 7"), (8, "times 8"), (9, "in paris and Paris"),
    ]
    schema = "doc_id long, text string"
    found = contaminated(spark.createDataFrame(rows, schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(found) == len(got) and set(got) == {(1, 1), (3, 2), (5, 3), (9, 6)}
    assert got[1, 1].covered == 5 and got[3, 2].covered == 14 and got[5, 3].covered == 19 and got[5, 3].reparameterised
