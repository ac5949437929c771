"""Sum-of-squares packing of token sequences.

A document's tokens are cut into whole windows and a rest. The rest goes, online, to the fill level for which the sum of the squared
numbers of partly filled windows per level becomes least; the numbers stand in an array by level. At the end of a
task the emptiest windows are cut up to fill the others, and the last one is cut into powers of two, so no window keeps padding.
Open windows hold their ids in as few bytes as the vocabulary needs (2 for 49,000 ids), so a task never holds
more than that per token of its partition.

Each task packs the documents of its partition as they come: no shuffle, and no window spans tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID = 2048, 1
_MAX_PARTS = 800_000
_GROUP_BYTES = 8 << 20
_SEQUENCES_PER_TASK = 1 << 33


class WordIds:
    """Token ids of texts, for a tokenizer that drops white space and ends words with ``</w>``.

    Such a tokenizer never merges across blanks, so a text's ids are its blank-separated words' ids in order. A word of Latin
    letters, with or without punctuation behind it, is looked up as its lower-case letters and its punctuation; any
    other word as it stands. These parts are encoded once and kept, as bytes of 4 per id.
    """

    _SIMPLE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
    _CORE = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Makes sure that all ``parts`` are known."""
        if len(self.known) > _MAX_PARTS:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        cores = [p for p in new if self._CORE.fullmatch(p)]
        if cores:
            ids = self._encode([" ".join(cores)])[0]
            ends = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
            if len(ends) == len(cores):
                flat, begins = ids.tobytes(), [0, *ends[:-1].tolist()]
                self.known.update((c, flat[low:high]) for c, low, high in zip(cores, begins, ends.tolist(), strict=True))
        rest = [p for p in new if p not in self.known]
        self.known.update((p, i.tobytes()) for p, i in zip(rest, self._encode(rest), strict=True))

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids per text; a null has none. Each distinct word of ``texts`` is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), "[\t\n\r]", " "), " ")
        words = pc.list_flatten(split).dictionary_encode()
        found = pc.extract_regex(words.dictionary, self._SIMPLE)
        heads = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "core")), words.dictionary)
        marks = pc.fill_null(pc.struct_field(found, "marks"), "")
        parts = pa.concat_arrays([heads, marks]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        self._learn(names)
        ids = [self.known[p] for p in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        per_word = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # head, marks, head, marks, ...
        of_words = _gather(np.frombuffer(b"".join(ids), "<u4"), sizes, per_word)
        word_sizes = sizes[per_word].reshape(-1, 2).sum(axis=1)
        occurring = words.indices.to_numpy()
        flat = _gather(of_words, word_sizes, occurring)
        bounds = np.concatenate(([0], np.cumsum(word_sizes[occurring])))[split.offsets.to_numpy()].tolist()
        return [flat[low:high] for low, high in zip(bounds, bounds[1:])]


def _gather(flat: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The runs ``picked``, in order, of an array made of consecutive runs of the given sizes."""
    begins, lengths = (np.cumsum(sizes) - sizes)[picked], sizes[picked]
    shift = begins - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


def text_groups(texts: pa.Array, group_bytes: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of consecutive groups of texts that begin within the same ``group_bytes`` of the array."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // group_bytes)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    yield from ((low, high - low) for low, high in zip(bounds, bounds[1:]) if high > low)


class Packer:
    """Windows of one task. Finished pieces are in ``out``: (key, start, ids, document tokens, window, offset)."""

    def __init__(self, window: int, first: int, max_open: int | None = None):
        self.window, self.next, self.max_open = window, first, max_open
        self.level = np.zeros(window + 1, np.int64)  # number of open windows per fill level
        self.open: dict[int, list[list]] = {}  # pieces of the open windows, by fill level
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            self._emit([(key, at, ids[at:at + self.window], total)])
        if whole < total:
            self._place((key, whole, ids[whole:].copy(), total))
        if self.max_open is not None and self.n_open > self.max_open:
            self._settle()

    def best_level(self, size: int) -> int:
        """The level to put ``size`` tokens on; the fullest of equals. Squares change by 2 (N[to] - N[from] + 1)."""
        level, window = self.level, self.window
        gain = level[size:window] - level[:window - size] + 1  # from 0 .. window - size - 1 to a level below full
        gain[0] = level[size] + 0.5  # a new window leaves no level: half of (N + 1)**2 - N**2
        full = 0.5 - level[window - size]  # filling one up only leaves its level
        usable = level[:window - size] > 0
        usable[0] = True
        cost = np.where(usable, gain, np.inf)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return window - size if level[window - size] > 0 and full <= cost[best] else best

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        low = self.best_level(size)
        pieces = self.open[low].pop() if low else []
        if low:
            self.level[low] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if low + size == self.window:
            self._emit(pieces)
        else:
            self.open.setdefault(low + size, []).append(pieces)
            self.level[low + size] += 1
            self.n_open += 1

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _settle(self) -> list[tuple]:
        """Cuts up the emptiest open windows to fill the fullest; at most one stays open, whose pieces are returned."""
        windows = [w for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        rest: list[tuple] = []
        at, end = 0, len(windows)
        while at < end:
            target = windows[at]
            at += 1
            room = self.window - sum(len(p[2]) for p in target)
            while room and (rest or at < end):
                if not rest:
                    end -= 1
                    rest = windows[end]
                key, start, ids, total = rest.pop()
                target.append((key, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((key, start + room, ids[room:], total))
                room -= len(target[-1][2])
            if room:
                rest = target
            else:
                self._emit(target)
        if rest:
            fill = sum(len(p[2]) for p in rest)
            if fill >= self.window:
                raise AssertionError("a window is overfull")
            self.open[fill] = [rest]
            self.level[fill], self.n_open = 1, 1
        return rest

    def finish(self) -> None:
        """Closes all windows; the last is cut into windows whose lengths are powers of two."""
        pieces = self._settle()
        while pieces:
            size = 1 << (sum(len(p[2]) for p in pieces).bit_length() - 1)
            taken = []
            while size:
                key, start, ids, total = pieces.pop(0)
                taken.append((key, start, ids[:size], total))
                if len(ids) > size:
                    pieces.insert(0, (key, start + size, ids[size:], total))
                size -= len(taken[-1][2])
            self._emit(taken)
        self.open, self.n_open = {}, 0
        self.level[:] = 0


_WORDS: dict[str, WordIds] = {}  # per Python worker

PIECES = """doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,
    ids array<int>"""


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_ids: bool = False,
    max_open: int | None = None,
) -> DataFrame:
    """One row per piece: where its ids lie in its document and in its sequence, and their CRC-32.

    ``tokenizer`` is the path of a word-end BPE file on every executor. A document is its text's ids (null: none) and ``END_ID``. Rows
    with equal or null ids are packed each for itself. A sequence id is the task's number times 2**33 plus a
    running number. ``ids`` is null unless asked for. Other columns are not read.
    ``max_open`` trades the method for memory: once a task has more windows open, they are closed by cutting. By default none are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(tokenizer) or _WORDS.setdefault(tokenizer, WordIds(tokenizer))
        packer = Packer(window, TaskContext.get().partitionId() * _SEQUENCES_PER_TASK, max_open)
        kind = np.uint16 if max(len(words.is_end) - 1, END_ID) < 1 << 16 else np.uint32

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            longs = [
                [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows],
                [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
            ]
            kept = [r[2].astype(np.int32) if keep_ids else None for r in rows]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in longs] + [pa.array(kept, pa.list_(pa.int32()))], names
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, size in text_groups(texts, _GROUP_BYTES):
                for key, ids in zip(keys[at:at + size], words.encode(texts.slice(at, size)), strict=True):
                    packer.add(key, np.append(ids, END_ID).astype(kind))
                if len(packer.out) > 20_000:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)
