"""What each filter of a cascade removes in every order of the cascade, with higher-order SQL functions only.

A document fails some of the filters A to E: its mask. Documents are counted by (part, mask), at most 32 cells a part. Each cell is
folded along every order with ``transform`` and ``aggregate``: one struct per (order, step), weighted by the cell's
counts. The cells' arrays of 600 structs are then added element by element, so the work after counting
depends on the number of parts, not of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.plans.session import cut

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
# The characters that part words, and those of filter D.
_SPACE, _SYMBOL = r"[ \t\n\x0B\f\r]+", r"[#$%&*|]"


def text_failures(text: Column, min_words: int, min_distinct_percent: int, max_upper_percent: int) -> Column:
    """Bits of the filters A to D that a text fails; its words are split once."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    own = F.when(100 * upper > max_upper_percent * F.length(text), 4).otherwise(0) + F.when(text.rlike(_SYMBOL), 8).otherwise(0)

    def of_words(words: Column) -> Column:
        few = F.when(F.size(words) < min_words, 1).otherwise(0)
        alike = F.when(100 * F.size(F.array_distinct(words)) < min_distinct_percent * F.size(words), 2).otherwise(0)
        return few + alike

    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return (own + F.transform(F.array(words), of_words)[0]).cast("int")


def judged(
    docs: DataFrame, labels: DataFrame, min_words: int = 200, min_distinct_percent: int = 50, max_upper_percent: int = 3,
) -> DataFrame:
    """One row per document: ``part``, ``mask``, ``good``, ``toxic``.

    E is failed by a document whose text (equal SHA-256 and length) has a row with a smaller doc_id, whatever else either
    fails; rows without id neither fail it nor make others fail it, rows of one id do not make each other fail it. A null
    text is empty, a null language the part ''. A document is good or toxic if any label row of its id says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.concat(F.unhex(F.sha2(text, 256)), F.encode(F.octet_length(text).cast("string"), "UTF-8")).alias("body"),
        text_failures(text, min_words, min_distinct_percent, max_upper_percent).alias("bits"),
    ))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    # One row per text that several documents share. Fixed, so that a join can split the documents of a busy one.
    first = cut(
        seen.groupBy("body").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("body", "first_id")
    )
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return seen.join(first, "body", "left").join(said, "doc_id", "left").select(
        "part", (F.col("bits") + F.when(later, 16).otherwise(0)).cast("int").alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def cells(documents: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by part and mask."""
    return documents.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"),
        F.sum(F.col("toxic").cast("long")).alias("n_toxic"),
    )


def _order_array() -> Column:
    """All orders, each an array of filter bits: a constant of 600 numbers that Spark ships with the plan."""
    return F.array(*[F.array(*[F.lit(1 << FILTERS.index(f)) for f in order]) for order in ORDERS])


def _step(mask: Column, bit: Column, alive: Column) -> Column:
    """What one step does to a cell: the weights of its documents, by the names of ``COUNTS``."""
    fails = mask.bitwiseAND(bit) != 0
    weigh = lambda hit, weight="n": F.when(hit, F.col(weight)).otherwise(F.lit(0)).cast("long")
    removed = alive & fails
    return F.struct(
        weigh(alive & ~fails).alias("kept"), weigh(removed).alias("removed"), weigh(fails & ~alive).alias("redundant"),
        weigh(mask == bit).alias("unique_fails"), weigh(removed, "n_good").alias("good_lost"),
        weigh(removed, "n_toxic").alias("toxic_lost"),
    )


def folded(cell_counts: DataFrame) -> DataFrame:
    """Each cell folded along every order: ``steps``, 600 structs in the order of (order, step)."""
    mask = F.col("mask")
    nothing = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def along(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("alive"), nothing.alias("steps"))

        def step(state: Column, bit: Column) -> Column:
            return F.struct(
                (state["alive"] & (mask.bitwiseAND(bit) == 0)).alias("alive"),
                F.concat(state["steps"], F.array(_step(mask, bit, state["alive"]))).alias("steps"),
            )
        return F.aggregate(order, start, step, lambda state: state["steps"])

    return cell_counts.select("part", F.flatten(F.transform(_order_array(), along)).alias("steps"))


def merged(arrays: DataFrame) -> DataFrame:
    """Element-by-element sums per part. A part has at most one array per mask, so 32 of them."""
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))

    def add(total: Column, one: Column) -> Column:
        return F.zip_with(total, one, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))

    return arrays.groupBy("part").agg(F.collect_list("steps").alias("all")).select(
        "part", F.aggregate("all", zero, add).alias("steps")
    )


def interactions(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Per part, order and step: documents kept, removed, failing but already gone, failing this filter only, good and
    toxic ones lost, and ``shapley``, the filter's removals summed over all orders.

    Every order and step of every part has a row, zeros included; an empty table has none. Columns beside doc_id, text
    and lang (labels: doc_id, quality, toxic) are not read.
    """
    parts = merged(folded(cells(judged(docs, labels, **limits))))
    names = F.array(*[F.lit(f) for order in ORDERS for f in order])
    removals = F.zip_with(F.col("steps"), names, lambda s, f: F.named_struct(F.lit("f"), f, F.lit("n"), s["removed"]))
    total = lambda name: F.aggregate(
        removals, F.lit(0).cast("long"), lambda a, r: a + F.when(r["f"] == name, r["n"]).otherwise(F.lit(0))
    )
    rows = parts.select("part", F.array(*[total(f) for f in FILTERS]).alias("totals"), F.posexplode("steps").alias("at", "s"))
    orders = F.array(*[F.lit(o) for o in ORDERS])
    named = rows.select(
        "part", "totals", "s", orders[F.floor(F.col("at") / len(FILTERS)).cast("int")].alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return named.select(
        "part", "filter_order", "step", *[F.col("s")[c].alias(c) for c in COUNTS],
        F.get("totals", F.instr(F.lit(FILTERS), letter) - 1).alias("shapley"),
    )
