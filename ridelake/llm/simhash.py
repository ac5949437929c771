"""SimHash near-duplicates by multi-index hashing.

Equal fingerprints are merged first. The 64 bits are cut into segments; two fingerprints within ``max_distance`` bits
differ by at most ``max_distance // segments`` bits in one of them. Each fingerprint is filed under its segment values
and looks up the small Hamming ball around each, so linked ones meet in a table entry, where the whole
distances are verified. Of two values one bit apart only the one with the bit set looks up the other's entry,
so each pair meets once. An entry gives its links as a forest (no more links than members), never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.graph import components
from ridelake.plans.session import cut

SEED, BITS = 42, 64
_CHUNK = 1 << 16


def fingerprint(body: bytes, width: int) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; 0 without words."""
    words = body.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-width] + 1)).tolist()
    ends = ends[width - 1:].tolist()
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), _CHUNK):
        spans = zip(begins[at:at + _CHUNK], ends[at:at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * total > len(begins)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long. Whole texts; a null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(b.as_py() or b"", width) for b in batch.column(1)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` segments that cover the 64 bits."""
    edges = [BITS * k // n for k in range(n + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def _entries(fp: Column, max_distance: int, segments: int) -> Column:
    """The table entries a fingerprint belongs to: its own values, and those reached by clearing up to r set bits.

    Values r bits apart have a common value below both; for a radius above 1 both clear their own part of
    the differing bits, so pairs may meet in more than one entry.
    """
    radius = max_distance // segments
    keys = []
    for k, (shift, width) in enumerate(_segments(segments)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for r in range(radius + 1):
            for bits in combinations(range(width), r):
                mask = F.lit(sum(1 << b for b in bits)).cast("long")
                kept = value.bitwiseAND(mask) == mask
                keys.append(F.when(kept, value.bitwiseXOR(mask) + F.lit(k << 60).cast("long")))
    return F.array_compact(F.array(*keys))


def forest(prints: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that connect the members of one entry as their distances do: one per member and component."""
    links, left = [], prints
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= max_distance
            if near.any():
                hits, left = left[near], left[~near]
                links += [(seed, h) for h in hits]
                queue += list(hits)
    return links


def _links_of(keys: np.ndarray, prints: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    a, b = [], []
    # Entries of two to four members pair by pair, all at once; larger ones as forests.
    for size in (2, 3, 4):
        at = starts[sizes == size]
        for i, j in combinations(range(size), 2):
            x, y = prints[at + i], prints[at + j]
            near = np.bitwise_count(x ^ y) <= max_distance
            a.append(x[near])
            b.append(y[near])
    for s, n in zip(starts[sizes > 4], sizes[sizes > 4], strict=True):
        links = forest(prints[s:s + n], max_distance)
        if links:
            x, y = zip(*links, strict=True)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def links(prints: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``max_distance`` bits.

    A partition holds whole entries, 16 bytes per member; members of an entry are distinct fingerprints that agree in
    a segment up to one bit, so copies do not add to it.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(f["key"].to_numpy(np.int64), f["fp"].to_numpy(np.int64).view(np.uint64)) for f in frames]
        if held:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = _links_of(keys, values, max_distance)
            yield pd.DataFrame({"a": a, "b": b})

    filed = prints.select("fp", F.explode(_entries(F.col("fp"), max_distance, segments)).alias("key"))
    return filed.repartition("key").mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    width: int = 4, max_distance: int = 4, segments: int = 3,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    ``component_id`` is the smallest document id reached over links of up to ``max_distance`` bits. A text without
    words (null, empty) has fingerprint 0, linked like any other. Rows with one id are judged each by its
    text. A row without id gets the component of its fingerprint, null if no row with an id is in it. Other columns
    are not read. ``segments``: as many as there are table bits wanted of 64; 3 suits up to some
    10 million distinct fingerprints an entry of 2**21, 2 (with its balls of 529 values) far more.
    """
    rows = cut(fingerprints(docs, doc_id, text, width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), max_distance, segments))
    named = roots.withColumnRenamed("node", "fp").join(classes, "fp")
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = cut(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"))
    labels = cut(classes.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    ))
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
