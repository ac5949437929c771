"""Line deduplication by content-defined chunks of lines and the shortest windows of lines.

A chunk ends behind a line if a rolling hash over the hashes of that line and the one before it hits the divisor, so
boundaries depend on nearby lines only and come back in step after an insertion. A passage need not hold a whole chunk, so
each two consecutive non-blank lines (with the blank ones between them) are looked up beside the chunks: these windows overlap, and
together they cover every repeated run of lines whole. Windows and chunks that occur more than once in the corpus are compared
byte by byte, and all but the first occurrence (smallest id, then place) are removed.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.llm import blocks

MIN_LINES, DIVISOR = 2, 3
_MASK = 2**64 - 1


def cuts(lines: list[bytes], divisor: int) -> list[int]:
    """Ends of the chunks of a text: number of lines up to and including each last line."""
    ends, before = [], 0
    for i, line in enumerate(lines):
        here = xxhash.xxh64_intdigest(line)
        rolled = (before * 0x9E3779B97F4A7C15 + here) & _MASK
        if (rolled ^ rolled >> 32) % divisor == 0 or i == len(lines) - 1:
            ends.append(i + 1)
        before = here
    return ends


def spans(body: bytes, divisor: int, min_lines: int) -> list[tuple[int, int, int, int]]:
    """(first line, end line, first byte, end byte) of the windows from each non-blank line to the ``min_lines``-th from it, and of
    the chunks that have as many lines with more than blanks, in the order of their places."""
    lines = body.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    if len(full) < min_lines:
        return []
    found = {(low, high + 1) for low, high in zip(full, full[min_lines - 1:])}
    low = 0
    before = list(accumulate((1 if x.strip() else 0 for x in lines), initial=0))
    for high in cuts(lines, divisor):
        if high - low >= min_lines and before[high] - before[low] >= min_lines:
            found.add((low, high))
        low = high
    begin = list(accumulate((len(x) + 1 for x in lines), initial=0))
    return [(low, high, begin[low], begin[high] - 1) for low, high in sorted(found)]


def chunks(body: bytes, divisor: int, min_lines: int) -> list[tuple[int, int, bytes]]:
    """(first line, end line, bytes) of the windows and chunks of a text."""
    return [(low, high, body[a:b]) for low, high, a, b in spans(body, divisor, min_lines)]


class _Chunks:
    """All windows and chunks of a block: row, line range, place of the bytes, and a hash."""

    def __init__(self, bodies: list[bytes], divisor: int, min_lines: int):
        found, hashes = [], []
        for r, body in enumerate(bodies):
            own = spans(body, divisor, min_lines)
            found += [(r, *s) for s in own]
            hashes += [xxhash.xxh3_64_intdigest(body[s[2]:s[3]]) for s in own]
        self.row, self.low, self.high, self.begin, self.end = np.array(found, np.int64).reshape(-1, 5).T
        self.hash = np.array(hashes, np.uint64)
        self._bodies = bodies

    def text(self, i: int) -> bytes:
        return self._bodies[self.row[i]][self.begin[i]:self.end[i]]

    def repeated(self, flags: np.ndarray) -> tuple[list[int], list[bytes], dict[bytes, int]]:
        """Those whose hash is flagged, with their texts, and the first of each text in the block, by (hash, text)."""
        hit = np.flatnonzero(flags[np.searchsorted(np.unique(self.hash), self.hash)]).tolist()
        texts, seen = [self.text(i) for i in hit], {}
        for i, text in zip(hit, texts, strict=True):  # rows and lines run upwards
            seen.setdefault(text, i)
        return hit, texts, dict(sorted(seen.items(), key=lambda x: (int(self.hash[x[1]]), x[0])))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of ranges that overlap or touch."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _settle_counts(asked: list[tuple]) -> list[np.ndarray]:
    hashes, several = (np.concatenate([x[i] for x in asked]) for i in range(2))
    _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = (count > 1) | (np.bincount(group, several) > 0)
    return blocks.split_by([len(x[0]) for x in asked], repeated[group])


def _settle_bytes(asked: list[tuple]) -> list[tuple]:
    """The first occurrence (id, row, line) of each text, compared by its bytes."""
    first: dict[bytes, tuple] = {}
    for texts, *place in asked:
        for text, at in zip(texts[0], zip(*(p.tolist() for p in place), strict=True), strict=True):
            first[text] = min(at, first.get(text, at))
    return [
        tuple(np.array([first[t][k] for t in texts[0]], np.int64) for k in range(3)) for texts, *_ in asked
    ]


def remove_chunks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
    divisor: int = DIVISOR, min_lines: int = MIN_LINES,
) -> DataFrame:
    """One row per row with an id: (doc_id, kept_text, n_lines, n_removed, removed line ranges, carried columns).

    Lines are parted by newlines; a removed run goes with its line breaks; ranges that meet are one. A copy of a window that overlaps the
    first one is part of it and stays. A null text counts as empty: one empty line. Of rows sharing an id
    the one whose text sorts first comes first. Rows without id are returned whole and are no source. Frequent chunks and windows
    cost one entry per block of documents; their bytes are sent once per block, and only if the hash is repeated.
    """
    n_blocks, n_buckets = blocks.sizes(docs, text)
    dealt = blocks.deal(docs.where(F.col(doc_id).isNotNull()), doc_id, text, n_blocks, carry)

    def count(block, ids, bodies, _, given):
        c = _Chunks(bodies, divisor, min_lines)
        hashes, n = np.unique(c.hash, return_counts=True)
        return blocks.frame_of(blocks.questions(block, 0, _buckets(hashes, n_buckets), (hashes, n > 1)))

    def compare(block, ids, bodies, _, given):
        c = _Chunks(bodies, divisor, min_lines)
        if not len(c.hash):
            return blocks.frame_of([])
        repeated = np.concatenate(given[0])
        seen = c.repeated(repeated)[2]
        texts, order = list(seen), np.array(list(seen.values()), np.int64)
        bucket = _buckets(c.hash[order], n_buckets)
        rows = [(block, 9, block % n_buckets, blocks.pack((np.packbits(repeated),)))]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if texts else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = order[a:b]
            data = ((texts[a:b],), ids[c.row[part]], c.row[part], c.low[part])
            rows.append((block, 1, int(bucket[a]), blocks.pack(data)))
        return blocks.frame_of(rows)

    names = ["doc_id", "kept_text", "n_lines", "n_removed", "removed", *carry]

    def drop(block, ids, bodies, extras, given):
        c = _Chunks(bodies, divisor, min_lines)
        gone: dict[int, list] = {}
        if 9 in given:
            flags = np.unpackbits(given[9][0][0], count=len(np.unique(c.hash))).astype(bool)
            hit, texts, seen = c.repeated(flags)
            answers = given.get(1, [])
            places = list(zip(*(np.concatenate([a[k] for a in answers]).tolist() for k in range(3)), strict=True)) if answers else []
            first = dict(zip(seen, places, strict=True))
            for i, body in zip(hit, texts, strict=True):
                row, low, high = int(c.row[i]), int(c.low[i]), int(c.high[i])
                *source, line = first[body]
                if source != [int(ids[row]), row] or low >= line + high - low:
                    gone.setdefault(row, []).append((low, high))
        rows = []
        for r, body in enumerate(bodies):
            lines = body.split(b"\n")
            cut_lines = merged(gone.get(r, []))
            kept, at = [], 0
            for low, high in cut_lines:
                kept += lines[at:low]
                at = high
            kept += lines[at:]
            removed = sum(b - a for a, b in cut_lines)
            rows.append((int(ids[r]), b"\n".join(kept).decode(), len(lines), removed, cut_lines, *extras[r]))
        return pd.DataFrame(rows, columns=names)

    schema = T.StructType.fromDDL(
        "doc_id long, kept_text string, n_lines long, n_removed long, removed array<struct<begin:long,end:long>>"
    )
    for name in carry:
        schema = schema.add(docs.schema[name])
    counted = blocks.answer(blocks.ask(dealt, count), {0: _settle_counts}, n_buckets, n_blocks)
    compared = blocks.answer(blocks.ask(dealt, compare, counted), {1: _settle_bytes}, n_buckets, n_blocks)
    found = blocks.ask(dealt, drop, compared, schema)
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), body.alias("kept_text"),
        F.size(F.split(body, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("removed"), *carry,
    )
    return found.unionByName(whole)


