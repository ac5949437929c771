"""Benchmark decontamination by template windows.

A text becomes typed tokens: numbers, units behind a number, and capitalised words within a sentence turn into placeholders that keep their value
as a slot, a run of names or of number words into one; other words count in lower case. Windows of ``WINDOW`` tokens with enough literal words are hashed. Documents and benchmark items are
joined on the hashes. Hits of one document and item on one alignment are put together; the largest set of them in which each item value
has one document value counts if it covers enough tokens, so a question with other numbers or names is caught. Where values
contradict each other, the set must cover twice as much, or hold a stretch of the least cover word for word. An item without
a window of enough literal words (short, or dense in values) is looked up by one hash over all its words, without placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MIN_LITERALS, MIN_COVER = 8, 5, 12
_SLICE, _TABLE_BITS = 500, 24
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
# Units, and the words for small numbers.
UNITS = frozenset("""kg g mg km m cm mm mile miles metre metres meter meters gram grams kilogram kilograms litre litres
    liter liters hour hours minute minutes second seconds day days week weeks month months year years dollar dollars
    euro euros cent cents percent degrees""".split())
NUMBERS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
    sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
    million""".split())
_WORD, _NUMBER, _END, _CAPITAL, _UNIT = range(5)
_SLOT_NAMES = {_NUMBER: "num", _CAPITAL: "name", _UNIT: "unit"}
_SLOT_HASH = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{name}>")) for kind, name in _SLOT_NAMES.items()}
_K = np.uint64(0x9E3779B97F4A7C15)


def _kind(token: str) -> int:
    if token in ".!?\n":
        return _END
    if token[0].isdigit() or token.lower() in NUMBERS:
        return _NUMBER
    if token.lower() in UNITS:
        return _UNIT
    return _CAPITAL if token[0].isupper() and token[1:].islower() else _WORD


class Templates:
    """The typed tokens of some texts, laid end to end, and the hashes of their windows."""

    def __init__(self, texts: list[str | None], window: int, min_literals: int):
        found = [_TOKEN.findall(t or "") for t in texts]
        flat = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        self.words = flat.dictionary.to_pylist()
        kinds = np.array([_kind(w) for w in self.words], np.int8)
        hashes = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in self.words], np.uint64)
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        kind = kinds[code] if len(code) else np.zeros(0, np.int8)
        # A capital at the beginning of a text or sentence is no sign of a name.
        first = np.ones(len(code), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (kind[:-1] == _END)
        kind = np.where((kind == _CAPITAL) & first, _WORD, kind)
        kept = np.flatnonzero(kind != _END)
        code, doc, kind = code[kept], doc[kept], kind[kept]
        self.word_doc, self.word = doc, hashes[code] if len(code) else np.zeros(0, np.uint64)
        # A name behind a name, or a number word behind a number, belongs to the token before it.
        spelt = np.array([w.lower() in NUMBERS for w in self.words], bool)
        head = np.ones(len(code), bool)
        if len(code):
            head[1:] = (doc[1:] != doc[:-1]) | (np.diff(kept) > 1) | (kind[1:] != kind[:-1]) | ~(
                (kind[1:] == _CAPITAL) | (kind[1:] == _NUMBER) & spelt[code[1:]]
            )
        heads = np.flatnonzero(head)
        self.runs, self.run_code = np.append(heads, len(code)), code
        code, doc, kind = code[heads], doc[heads], kind[heads]
        after_number = np.zeros(len(code), bool)
        after_number[1:] = (doc[1:] == doc[:-1]) & (kind[:-1] == _NUMBER)
        kind = np.where((kind == _UNIT) & ~after_number, _WORD, kind)
        token = hashes[code] if len(code) else np.zeros(0, np.uint64)
        for slot, value in _SLOT_HASH.items():
            token[kind == slot] = value
        self.doc, self.kind = doc, kind
        self.starts = np.searchsorted(doc, np.arange(len(texts)))
        self.sizes = np.searchsorted(doc, np.arange(len(texts)), "right") - self.starts
        n = max(len(code) - window + 1, 0)
        value = np.zeros(n, np.uint64)
        for k in range(window):
            value = (value ^ value >> np.uint64(29)) * _K + token[k:k + n]
        literal = np.concatenate(([0], np.cumsum(kind == _WORD)))
        usable = (literal[window:window + n] - literal[:n] >= min_literals) & (doc[:n] == doc[window - 1:window - 1 + n])
        self.at = np.flatnonzero(usable)  # places of the usable windows
        self.hash = value[self.at]

    def value(self, at: int) -> str:
        return " ".join(self.words[c].lower() for c in self.run_code[self.runs[at]:self.runs[at + 1]])

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each sequence of ``length`` words within a text."""
        n = len(self.word) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, inverse = (
            np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(self.word) - 1, k, np.uint64))))
            for k in (_K, np.uint64(pow(int(_K), -1, 2**64)))
        )
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.word * power, dtype=np.uint64)))
        value = (total[length:] - total[:-length]) * inverse[:n] + np.uint64(length)
        value = (value ^ value >> np.uint64(32)) * _K
        value ^= value >> np.uint64(29)
        inside = np.flatnonzero(self.word_doc[:n] == self.word_doc[length - 1:])
        return self.word_doc[inside], value[inside]

    def slots(self, at: int, window: int) -> list[dict]:
        return [
            {"place": i, "kind": _SLOT_NAMES[int(self.kind[at + i])], "value": self.value(at + i)}
            for i in range(window) if int(self.kind[at + i]) in _SLOT_NAMES
        ]


_SLOTS = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
WINDOWS = "id long, row long, whole int, hash long, place int, size int, slots array<struct<place:int,kind:string,value:string>>"


def windows(rows: DataFrame, key: str, text: str, window: int, min_literals: int, wanted=None, lengths=None) -> DataFrame:
    """The template windows of the rows: (id, hash of the text, 0, hash, place, tokens in the text, slots).

    ``lengths``: sequences of so many words are added, each once per text, with the length as ``whole``; if None, the whole of each text
    without a window.
    ``wanted``: a broadcast table of bits by the leading hash bits; windows without their bit are left out. Extra bits only cost work.
    """
    def known(hashes: np.ndarray, bits) -> np.ndarray:
        if bits is None:
            return np.arange(len(hashes))
        head = hashes >> np.uint64(64 - _TABLE_BITS)
        return np.flatnonzero(bits[head >> np.uint64(3)] >> (head & np.uint64(7)).astype(np.uint8) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids), _SLICE):
                t = Templates(texts.slice(low, _SLICE).to_pylist(), window, min_literals)
                hit = known(t.hash, bits)
                at, doc = t.at[hit], t.doc[t.at[hit]]
                sizes = np.bincount(t.word_doc, minlength=len(t.sizes))
                bare = np.setdiff1d(np.flatnonzero(sizes), t.doc[t.at])
                whole = []  # (text, length, hash)
                for length in np.unique(sizes[bare]).tolist() if lengths is None else lengths:
                    owner, value = t.sequences(length)
                    some = known(value, bits)
                    if lengths is None:
                        some = some[np.isin(owner[some], bare[sizes[bare] == length])]
                    whole += sorted({(d, length, h) for d, h in zip(owner[some].tolist(), value[some].tolist(), strict=True)})
                extra = np.array([w[0] for w in whole], np.int64)
                doc, n = np.concatenate((doc, extra)), len(at)
                # Rows that share an id (or have none) are told apart by their texts.
                row = {d: xxhash.xxh3_64_intdigest(texts[low + d].as_py()) for d in np.unique(doc).tolist()}
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[low + d] for d in doc.tolist()], pa.int64()),
                    pa.array(np.array([row[d] for d in doc.tolist()], np.uint64).view(np.int64)),
                    pa.array([0] * n + [w[1] for w in whole], pa.int32()),
                    pa.array(np.concatenate((t.hash[hit], np.array([w[2] for w in whole], np.uint64))).view(np.int64)),
                    pa.array(np.concatenate((at - t.starts[doc[:n]], 0 * extra)).astype(np.int32)),
                    pa.array(t.sizes[doc].astype(np.int32)),
                    pa.array([t.slots(i, window) for i in at.tolist()] + [[]] * len(whole), _SLOTS),
                ], ["id", "row", "whole", "hash", "place", "size", "slots"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, WINDOWS)


def _bits(found: DataFrame) -> bytearray:
    """A table of 2**24 bits, whatever the number of hashes, with the leading bits of each set."""
    heads = found.select(F.shiftrightunsigned("hash", 64 - _TABLE_BITS).alias("head")).distinct()
    table = np.zeros(1 << _TABLE_BITS, bool)
    for part in heads.toLocalIterator():  # at most 2**24 numbers
        table[part.head] = True
    return bytearray(np.packbits(table, bitorder="little").tobytes())


def _covered(places: list[int], window: int) -> tuple[int, int]:
    """Tokens in windows at ``places``, and in the longest stretch of them without a gap."""
    total = longest = stretch = 0
    last = None
    for p in sorted(places):
        fresh = window if last is None else min(window, p - last)
        stretch = stretch + fresh if last is not None and p - last <= window else window
        total, longest, last = total + fresh, max(longest, stretch), p
    return total, longest


def _score(some: list[tuple[int, dict]], window: int, last: int | None = None) -> tuple[int, int, int, int]:
    """(tokens covered behind the window at ``last``, windows, values as in the item, minus other values) of sorted windows."""
    cover = same = other = 0
    for place, slots in some:
        cover += window if last is None else min(window, place - last)
        last = place
        equal = sum(v == k[1] for k, v in slots.items())
        same, other = same + equal, other + len(slots) - equal
    return cover, len(some), same, -other


def _first_come(hits: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    """The windows that agree with all taken before them."""
    held: dict[tuple, str] = {}
    some = []
    for hit in hits:
        if all(held.get(k, v) == v for k, v in hit[1].items()):
            held |= hit[1]
            some.append(hit)
    return some


def agreeing(hits: list[tuple[int, dict]], window: int) -> list[tuple[int, dict]]:
    """The windows (place, {item slot: document value}) of the largest cover in which each item slot has one value.

    Of equal covers the one with more windows, then with more values as in the item. Exact: the windows are taken or left in
    order, the best choice is kept for each set of values that later windows still ask for, and a choice goes once all later windows
    that agree with it cannot lift it above the best set known. The work may double with each contradicted slot open at one place.
    """
    hits = sorted(hits, key=lambda h: h[0])
    values: dict[tuple, set] = {}
    ends: dict[tuple, int] = {}
    for i, (_, slots) in enumerate(hits):
        for key, value in slots.items():
            values.setdefault(key, set()).add(value)
            ends[key] = i
    torn = {k for k, v in values.items() if len(v) > 1}
    if not torn:
        return hits
    asked = [{k: v for k, v in slots.items() if k in torn} for _, slots in hits]
    known = [[h for h in hits if all(v == k[1] for k, v in h[1].items())], _first_come(hits), _first_come(hits[::-1])[::-1]]
    best = max(known, key=lambda some: _score(some, window))
    floor = _score(best, window)

    def hopeless(state: tuple, score: tuple, at: int) -> bool:
        held = dict(state[0])
        rest = [h for h, a in zip(hits[at:], asked[at:], strict=True) if all(held.get(k, v) == v for k, v in a.items())]
        more = _score(rest, window, state[1])
        return tuple(x + y for x, y in zip(score[:3], more[:3], strict=True)) <= floor[:3]

    # (values of open torn slots, last place taken if it still overlaps) -> (score, windows taken, last first)
    states: dict[tuple, tuple] = {(frozenset(), None): ((0, 0, 0, 0), None)}
    for i, (place, slots) in enumerate(hits):
        after: dict[tuple, tuple] = {}

        def keep(fixed: dict, last: int | None, score: tuple, taken: tuple | None) -> None:
            state = (frozenset((k, v) for k, v in fixed.items() if ends[k] > i), last)
            if state not in after or score > after[state][0]:
                after[state] = (score, taken)

        for (held, last), (score, taken) in states.items():
            fixed = dict(held)
            if last is not None and place - last >= window:
                last = None
            fits = all(fixed.get(k, v) == v for k, v in asked[i].items())
            if fits:
                more = _score([hits[i]], window, last)
                keep(fixed | asked[i], place, tuple(x + y for x, y in zip(score, more, strict=True)), (i, taken))
            if not fits or asked[i].keys() - fixed.keys():
                keep(fixed, last, score, taken)
        states = {s: kept for s, kept in after.items() if not hopeless(s, kept[0], i + 1)}
    if not states:
        return best
    score, taken = max(states.values(), key=lambda s: s[0])
    found = []
    while taken:
        found.append(hits[taken[0]])
        taken = taken[1]
    return found[::-1]


RATED = "doc_id long, item_id long, n_windows long, covered long, reparameterised boolean"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_literals: int = MIN_LITERALS, min_cover: int = MIN_COVER,
) -> DataFrame:
    """(doc_id, item_id, n_windows, covered, reparameterised) per document and item it holds.

    ``covered`` is the number of tokens in windows that agree on the best alignment; it must reach ``min_cover``, or the whole
    item if that is shorter. If other windows of the alignment contradict them, it must reach twice ``min_cover``, or a stretch of
    ``min_cover`` tokens must be as in the item. ``reparameterised`` tells that a slot has another value than in the item. Rows sharing an
    id (or null) are judged one by one, the best counts. Items without a usable window must occur with all their words in order, case
    aside; ``covered`` is then their number. Null and empty items match nothing. Other columns are not read.
    """
    items = windows(benchmark, item_id, item_text, window, min_literals).select(
        F.col("id").alias("item_id"), F.col("row").alias("item_row"), "whole", "hash", F.col("place").alias("item_place"),
        F.col("size").alias("item_size"), F.col("slots").alias("item_slots"),
    )
    wanted = docs.sparkSession.sparkContext.broadcast(bytes(_bits(items)))
    lengths = sorted(r.whole for r in items.where("whole > 0").select("whole").distinct().collect())
    found = windows(docs, doc_id, text, window, min_literals, wanted, lengths)
    pairs = found.withColumnRenamed("id", "doc_id").join(items, ["hash", "whole"]).select(
        "doc_id", "row", "whole", "item_id", "item_row", "item_size", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
        F.zip_with("slots", "item_slots", lambda a, b: F.struct(
            a["kind"].alias("kind"), a["value"].alias("doc_value"), b["value"].alias("item_value"),
        )).alias("slots"),
    )
    # At most an item's windows per alignment.
    aligned = pairs.groupBy("doc_id", "row", "item_id", "item_row", "shift").agg(
        F.max("item_size").alias("item_size"), F.max("whole").alias("whole"), F.collect_set(F.struct("item_place", "slots")).alias("hits"),
    )

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rated = []
            for r in batch.to_pylist():
                if r["whole"]:
                    rated.append((r["doc_id"], r["item_id"], 1, r["whole"], False))
                    continue
                hits, clash = [], False
                for h in sorted(r["hits"], key=lambda h: h["item_place"]):
                    slots: dict[tuple, str] = {}
                    for s in h["slots"]:
                        slots.setdefault((s["kind"], s["item_value"]), s["doc_value"])
                    if all(slots[s["kind"], s["item_value"]] == s["doc_value"] for s in h["slots"]):
                        hits.append((h["item_place"], slots))
                    else:
                        clash = True
                some = agreeing(hits, window)
                clash = clash or len(some) < len(hits)
                covered = _covered([p for p, _ in some], window)[0]
                exact = _covered([p for p, s in hits if all(v == k[1] for k, v in s.items())], window)[1]
                if (covered >= 2 * min_cover or exact >= min_cover) if clash else covered >= min(min_cover, r["item_size"]):
                    changed = any(v != k[1] for _, s in some for k, v in s.items())
                    rated.append((r["doc_id"], r["item_id"], len(some), covered, changed))
            columns = list(zip(*rated, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "n_windows", "covered", "reparameterised"],
            )

    rated = aligned.select("doc_id", "item_id", "item_size", "whole", "hits").mapInArrow(rate, RATED)
    best = rated.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_windows", "reparameterised")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_windows", "m.covered", "m.reparameterised")
