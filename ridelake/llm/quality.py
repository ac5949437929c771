"""Quality rules with host verdicts, with built-in functions only.

Each document is measured by itself; the share of failing documents of a host is shrunk towards the
corpus by a beta prior fitted to all hosts, and a host whose shrunk share is above the limit fails as a
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.plans.session import cut

# The characters that part words, and those counted as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _covered(positions: Column, width: int) -> Column:
    """Number of words in windows of ``width`` words that begin at the sorted positions."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(
        positions, start,
        lambda s, p: F.struct(
            p.alias("last"), (s["total"] + F.least(F.lit(width), p - s["last"])).alias("total")
        ),
        lambda s: s["total"],
    )


def _repeated(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more. n log n: sorted, then compared with neighbours."""
    def flagged(s: Column) -> Column:
        same = lambda x, i: F.get(s, i)["h"].eqNullSafe(x["h"])
        hits = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return _covered(F.sort_array(F.transform(hits, lambda x: x["i"])), width)

    structs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.sort_array(structs), flagged)


def document_measures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", width: int = 3,
) -> DataFrame:
    """Per document: its host, counts of words, symbols, repeated lines and repeated words.

    A null text has no words and counts 0 throughout. Every row is measured, rows with equal or null ids too.
    Repeated windows are told by 64-bit hashes within one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), body.alias("body"), words_of(body).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
    )
    hashed = F.when(
        F.size("words") >= width,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - width),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    measured = parts.withColumn("windows", hashed)
    return measured.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0))
        .otherwise(_repeated(F.col("windows"), width)).cast("long").alias("n_repeat_words"),
    )


def base_rules(measures: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds ``base_failed``: too few words, or too many of them in repeated windows."""
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    return measures.withColumn("base_failed", failed)


def host_rates(rated: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the share of failures shrunk by a beta prior fitted to all hosts.

    The prior's mean is the corpus share m; its strength comes from the moments: the variance of the hosts'
    shares less the part that counting alone explains, held to 1..10,000 documents. Documents without
    host belong to none.
    """
    hosts = (
        rated.where(F.col("host").isNotNull()).groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
        .withColumn("share", F.col("failed") / F.col("n"))
    )
    m = F.sum("failed") / F.sum("n")
    prior = hosts.agg(
        m.alias("mean"),
        (m * (1 - m)).alias("within"),
        F.coalesce(F.var_pop("share"), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n")).alias("noise"),
    )
    between = F.greatest(F.col("spread") - F.col("within") * F.col("noise"), F.lit(1e-9))
    strength = F.least(F.greatest(F.col("within") / between - 1, F.lit(1.0)), F.lit(10000.0))
    mean, strength = prior.select("mean", strength).first()  # two numbers
    return hosts.select(
        "host", "n", "failed",
        ((F.col("failed") + F.lit(mean) * F.lit(strength)) / (F.col("n") + F.lit(strength))).alias("shrunk"),
    )


def apply_host_rules(docs: DataFrame, max_host_rate: float = 0.5, **columns: str) -> DataFrame:
    """Measures, ``base_failed``, the host's shrunk failure share, and ``kept`` per document.

    The texts are read once: the measures are narrow and are fixed before hosts are counted. A document of a
    failing host is not kept; one without host is judged by itself.
    """
    rated = cut(base_rules(document_measures(docs, **columns)))
    hosts = cut(host_rates(rated))  # fixed, so that the join may split the documents of a busy host
    joined = rated.join(hosts.select("host", F.col("shrunk").alias("host_rate")), "host", "left")
    bad_host = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad_host)
