"""Removal of repeated byte strings by prefix-free parsing.

Every byte covered by a ``WIDTH``-byte string that also starts in a document with a smaller id goes.

Triggers are rolling-hash minima: a 24-byte gram is a trigger if its hash is the least among the grams of some
``WIDTH``-byte window, the first of equals. The choice depends on the window's own bytes only, every window has its trigger,
and equal windows have it at the same place. (Triggers by a fixed modulus would leave windows without any.) Consecutive
windows with one trigger form a phrase, taken together with the bytes its last window reaches into the rest
of the parse. So:

1. *Parse.* Grams of triggers that occur in one document only are dropped; windows around them occur nowhere else.
2. *Dictionary.* The remaining phrases, once each, with the smallest document that holds them. An occurrence in a later
   document is removed as a whole.
3. *Suffixes.* Equal windows of different phrases agree in their trigger gram and in half of the bytes that can stand
   beside it, on the left or on the right. Where such a longer gram has several phrases, the suffixes of the dictionary phrases (their
   windows) with that half are bucketed by a hash and sorted within the bucket at depth ``WIDTH``; equal
   strings are neighbours and share the smallest document among them. No suffix array of the parse and no global order is formed.
4. *Texts.* Each document's removed windows are merged to spans and cut out.

Work behind step 1 grows with repeated text, and step 3 with the distinct borders of repeats, not with the number of copies.
Grams are told by 40 hash bits (a collision only adds work), phrases by 96, windows by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm import blocks

WIDTH, GRAM = 50, 24
_HALF = (WIDTH - GRAM) // 2
_NONE = np.uint64(2**64 - 1)
_PIECE = 1 << 18  # window starts handled at once
_POSITION = np.uint64((1 << 24) - 1)
_GRAM_BITS = 40
# Odd constants of the hash steps, the k-th from the golden ratio.
_K = [np.uint64(((k + 1) * 0x9E3779B97F4A7C15 | 1) & (2**64 - 1)) for k in range(10)]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _K[8]
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return _mix(a * _K[k] + b * _K[k + 1])


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (n - k + 7) // 8
        out[k::8] = raw[k:k + 8 * m].view("<u8")
    return out


def _window_hashes(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """From each position: 8 bytes, and hashes of ``GRAM``, of 32 and of ``WIDTH`` bytes."""
    h8 = _eights(raw)
    h16 = _pair(h8[:-8], h8[8:], 0)
    gram = _pair(h16[:-8], h8[16:], 2)
    h32 = _pair(h16[:-16], h16[16:], 4)
    return h8, gram, h32, _pair(h32[:32 - WIDTH], h32[WIDTH - 32:], 6)


def _even(gram: np.ndarray) -> np.ndarray:
    """The ``_GRAM_BITS`` numbers dealt anew, one to one: hashes chosen as minima crowd near zero."""
    mask = np.uint64((1 << _GRAM_BITS) - 1)
    gram = (gram ^ (gram >> np.uint64(20))) * _K[8] & mask
    gram = (gram ^ (gram >> np.uint64(17))) * _K[6] & mask
    return gram ^ (gram >> np.uint64(20))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    reach, low = 1, keys
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


class Phrases:
    """The phrases of a block: first and last window and trigger in the joined text, document, hashes.

    ``left`` and ``right`` are 40 hash bits of the trigger gram with ``_HALF`` bytes before it and with the other half
    behind it, where a window of the phrase has them all; ``a`` and ``b`` name the phrase.
    """

    def __init__(self, ids: np.ndarray, bodies: list[bytes]):
        self.lengths = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])) if len(bodies) else np.zeros(0, np.int64)
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        parts = [[] for _ in range(8)]
        n = len(self.raw) - WIDTH + 1
        for at in range(0, max(n, 0), _PIECE):
            here = min(_PIECE, n - at)
            for one, whole in zip(self._piece(at, here), parts, strict=True):
                whole.append(one)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.first, self.last, self.trigger = (join(x, np.int64) for x in parts[:3])
        self.gram, self.left, self.right, self.a, self.b = (join(x, np.uint64) for x in parts[3:])
        self.doc = ids[np.searchsorted(self.starts, self.first, "right") - 1] if len(ids) else np.zeros(0, np.int64)

    def _piece(self, at: int, here: int) -> tuple[np.ndarray, ...]:
        raw = self.raw[at:at + here + WIDTH - 1]
        h8, grams, h32, windows = _window_hashes(raw)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        least = _least(keys, WIDTH - GRAM + 1)
        inside = np.ones(here + 1, np.int32)
        # No window starts within the last bytes of a document.
        ends = self.starts + self.lengths
        near = (ends > at) & (self.starts < at + here + WIDTH)
        for start, end in zip(self.starts[near], ends[near], strict=True):
            low = max(start, end - WIDTH + 1) - at
            if low < here and end > at:
                inside[max(low, 0):max(min(end - at, here), 0)] = 0
        valid = np.flatnonzero(inside[:here])
        trigger = least[valid] & _POSITION
        cut = np.flatnonzero(np.diff(trigger)) + 1
        opens, closes = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(valid) - 1]))
        if not len(valid):
            opens = closes = np.zeros(0, np.int64)
        first, last = valid[opens], valid[closes]
        tail = _mix(windows[last] * _K[9] + (last - first).astype(np.uint64)) >> np.uint64(32)
        gram = _even(least[first] >> np.uint64(64 - _GRAM_BITS))
        place = (least[first] & _POSITION).astype(np.int64)
        left, right = np.full(len(first), _NONE), np.full(len(first), _NONE)
        some = np.flatnonzero(place - first >= _HALF)
        p = place[some] - _HALF
        left[some] = _pair(h32[p], h8[p + GRAM + _HALF - 8], 1) >> np.uint64(64 - _GRAM_BITS)
        some = np.flatnonzero(last > place - _HALF)
        p = place[some]
        right[some] = _pair(h32[p], h8[p + WIDTH - _HALF + 1 - 8], 3) >> np.uint64(64 - _GRAM_BITS)
        return first + at, last + at, place + at, gram, left, right, windows[first], tail


def _gram_buckets(gram: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the leading bits of 40, so that sorted grams have sorted buckets."""
    return ((gram >> np.uint64(_GRAM_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _hash_buckets(value: np.ndarray, n: int) -> np.ndarray:
    return ((value >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _group_ids(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start flags) that bring equal keys together, least first by the first key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def _least_per_group(order: np.ndarray, new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For sorted groups: the least value of each."""
    return np.minimum.reduceat(values[order], np.flatnonzero(new)) if len(order) else values[:0]


def _settle_grams(asked: list[tuple]) -> list[np.ndarray]:
    """Which grams occur in more than one document: asked by two blocks, or flagged by one."""
    grams = np.concatenate([g for g, _ in asked])
    flags = np.concatenate([f for _, f in asked])
    order, new = _group_ids(grams)
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, flags[order]) > 0)
    out = np.empty(len(grams), bool)
    out[order] = shared[group]
    return blocks.split_by([len(g) for g, _ in asked], out)


def _settle_variants(asked: list[tuple]) -> list[np.ndarray]:
    """Which longer grams have more than one phrase, from the least phrase name of each block, and how the largest differs."""
    grams, low, high = (np.concatenate([x[i] for x in asked]) for i in range(3))
    order, new = _group_ids(grams)
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = np.minimum.reduceat(low[order], at) != np.maximum.reduceat((low ^ high)[order], at)
    out = np.empty(len(grams), bool)
    out[order] = several[group]
    return blocks.split_by([len(x[0]) for x in asked], out)


def _settle_documents(asked: list[tuple]) -> list[np.ndarray]:
    """The smallest document per key; keys are the leading columns, documents the last."""
    *keys, docs = (np.concatenate([x[i] for x in asked]) for i in range(len(asked[0])))
    order, new = _group_ids(*keys)
    out = np.empty(len(docs), np.int64)
    out[order] = _least_per_group(order, new, docs)[np.cumsum(new) - 1]
    return blocks.split_by([len(x[0]) for x in asked], out)


def _settle_suffixes(asked: list[tuple]) -> list[np.ndarray]:
    """The smallest document per string: the strings are sorted bytewise, equal ones are neighbours."""
    texts = np.concatenate([t.view(f"V{WIDTH}") for t, _ in asked])
    docs = np.concatenate([d for _, d in asked])
    order, new = _sorted_strings(texts)
    out = np.empty(len(docs), np.int64)
    out[order] = _least_per_group(order, new, docs)[np.cumsum(new) - 1]
    return blocks.split_by([len(d) for _, d in asked], out)


def _sorted_strings(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of fixed-width strings: bytewise, by the big-endian numbers they consist of."""
    padded = np.zeros((len(texts), -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = texts.view(np.uint8).reshape(-1, WIDTH)
    words = padded.view(">u8").astype(np.uint64)
    return _group_ids(*(words[:, i] for i in range(words.shape[1])))


def _parse(block, ids, bodies, _, n_buckets):
    p = Phrases(ids, bodies)
    order, new = _group_ids(p.gram)
    if not len(order):
        return blocks.frame_of([])
    at = np.flatnonzero(new)
    docs = p.doc[order]
    several = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)
    grams = p.gram[order][at]
    return blocks.frame_of(blocks.questions(block, 0, _gram_buckets(grams, n_buckets), (grams, several)))


def _dictionary(block, ids, bodies, given, n_buckets):
    p = Phrases(ids, bodies)
    grams = np.unique(p.gram)
    if not len(grams):
        return blocks.frame_of([])
    shared = np.concatenate(given[0])
    keep = np.flatnonzero(shared[np.searchsorted(grams, p.gram)])
    a, b, doc = p.a[keep], p.b[keep], p.doc[keep]
    rows = [(block, 9, block % n_buckets, blocks.pack((np.packbits(shared),)))]
    if len(keep):
        longer = np.concatenate((p.left[keep], p.right[keep]))
        name = np.tile((a ^ b * _K[9]) >> np.uint64(16), 2)
        there = longer != _NONE
        longer, name = longer[there], name[there]
        order, new = _group_ids(longer)
        at = np.flatnonzero(new)
        some = longer[order][at]
        low, high = np.minimum.reduceat(name[order], at), np.maximum.reduceat(name[order], at)
        rows += blocks.questions(block, 1, _gram_buckets(some, n_buckets), (some, low, low ^ high))
        order, new = _group_ids(a, b)
        at = order[np.flatnonzero(new)]
        rows += blocks.questions(
            block, 2, _hash_buckets(a[at], n_buckets), (a[at], b[at], _least_per_group(order, new, doc))
        )
    return blocks.frame_of(rows)


def _suffixes(block, ids, bodies, given, n_buckets):
    p = Phrases(ids, bodies)
    if 9 not in given:
        return blocks.frame_of([])
    grams = np.unique(p.gram)
    shared = np.unpackbits(given[9][0][0], count=len(grams)).astype(bool)
    keep = np.flatnonzero(shared[np.searchsorted(grams, p.gram)])
    if not len(keep):
        return blocks.frame_of([])
    longer = np.unique(np.concatenate((p.left[keep], p.right[keep])))
    longer = longer[longer != _NONE]
    varied = np.append(np.concatenate(given[1]), False)
    order, new = _group_ids(p.a[keep], p.b[keep])
    least = np.empty(len(keep), np.int64)
    least[order] = np.concatenate(given[2])[np.cumsum(new) - 1]
    later = least < p.doc[keep]
    gone, own = keep[later], keep[~later]
    # One entry per dictionary phrase, in its first document: the suffixes of other occurrences are the same strings.
    has_left = (p.left[own] != _NONE) & varied[np.searchsorted(longer, p.left[own])]
    has_right = (p.right[own] != _NONE) & varied[np.searchsorted(longer, p.right[own])]
    l, r = own[has_left], own[has_right]
    open_ = np.concatenate((l, r))
    low = np.concatenate((p.first[l], np.maximum(p.first[r], p.trigger[r] - _HALF + 1)))
    high = np.concatenate((np.minimum(p.last[l], p.trigger[l] - _HALF), p.last[r]))
    width = high - low + 1
    places = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
    docs = np.repeat(p.doc[open_], width)
    view = np.lib.stride_tricks.sliding_window_view(p.raw, WIDTH)
    texts = np.ascontiguousarray(view[places]).view(f"V{WIDTH}").reshape(-1) if len(places) else np.zeros(0, f"V{WIDTH}")
    order, new = _sorted_strings(texts)
    at = order[np.flatnonzero(new)]
    strings, first_docs = texts[at], _least_per_group(order, new, docs)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    # Buckets by a hash of the string, so that no common beginning fills one.
    eight = strings.view(np.uint8).reshape(-1, WIDTH) if len(strings) else np.zeros((0, WIDTH), np.uint8)
    code = np.zeros(len(strings), np.uint64)
    for i in range(0, WIDTH - 7, 7):
        code = _mix(code * _K[3] + np.ascontiguousarray(eight[:, i:i + 8]).view("<u8").reshape(-1))
    bucket = _hash_buckets(code, n_buckets)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    note = (p.first[gone].astype(np.int32), p.last[gone].astype(np.int32), places.astype(np.int32), place[rank].astype(np.int32))
    rows = [(block, 9, block % n_buckets, blocks.pack(note))]
    rows += blocks.questions(block, 3, bucket[by], (strings[by], first_docs[by]))
    return blocks.frame_of(rows)


def _texts(block, ids, bodies, given, keep_text):
    lengths = np.array([len(b) for b in bodies], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    depth = np.zeros(len(raw) + 1, np.int32)
    if 9 in given:
        first, last, places, rank = given[9][0]
        low, high = first, last + WIDTH
        if len(places):
            doc = ids[np.searchsorted(starts, places, "right") - 1]
            hit = places[np.concatenate(given[3])[rank] < doc]
            low, high = np.concatenate((low, hit)), np.concatenate((high, hit + WIDTH))
        np.add.at(depth, low, 1)
        np.add.at(depth, high, -1)
    gone = np.cumsum(depth[:-1]) > 0
    rows = []
    for k, key in enumerate(ids.tolist()):
        cut = gone[starts[k]:starts[k + 1]]
        edges = np.diff(np.concatenate(([0], cut.view(np.int8), [0])))
        spans = np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), 1)
        kept = raw[starts[k]:starts[k + 1]][~cut].tobytes() if len(spans) else bodies[k]
        rows.append((
            key, len(bodies[k]), int(cut.sum()), len(spans), hashlib.sha256(kept).hexdigest(),
            [(int(a), int(b)) for a, b in spans], kept if keep_text else None,
        ))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


RESULT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<begin:long,end:long>>, kept binary"
)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: sizes, removed byte spans, digest of the rest, and the rest if asked for.

    A null or empty text has no bytes. Ids are integers; rows sharing one are separate texts of one document, so neither removes from the
    other. A row without id is neither searched nor a source: it is returned whole. Other columns are not read.
    """
    n_blocks, n_buckets = blocks.sizes(docs, text)
    dealt = blocks.deal(docs.where(F.col(doc_id).isNotNull()), doc_id, text, n_blocks)

    def bound(fn, value):
        return lambda block, ids, bodies, _, given: fn(block, ids, bodies, given, value)

    def answered(asked, settle):
        return blocks.answer(asked, settle, n_buckets, n_blocks)

    grams = answered(blocks.ask(dealt, bound(_parse, n_buckets)), {0: _settle_grams})
    phrases = answered(
        blocks.ask(dealt, bound(_dictionary, n_buckets), grams), {1: _settle_variants, 2: _settle_documents}
    )
    strings = answered(blocks.ask(dealt, bound(_suffixes, n_buckets), phrases), {3: _settle_suffixes})
    found = blocks.ask(dealt, bound(_texts, keep_text), strings, RESULT)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    whole = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(body, 256).alias("kept_sha256"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"),
        (body if keep_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return found.unionByName(whole)
