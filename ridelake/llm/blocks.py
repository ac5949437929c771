"""Documents in blocks, and questions from blocks to buckets of keys.

Several deduplication operators need the same exchange: every document looks up what the whole corpus knows
about its parts (lines, substrings), which are far more numerous than documents. Documents are dealt
once, by a hash of their id, to blocks of a few MB. A block asks about its distinct parts, one row of packed sorted arrays
per bucket; a bucket joins the questions of all blocks about the same keys, which are already one entry
per key and block, and answers each in the same order. A frequent part thus costs one entry per block, and no
group holds more than one bucket. The dealing is one shuffle, which all rounds of a plan reuse; nothing is
written outside Spark's shuffles, so lost executors are recomputed by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
_FLUSH_BYTES = 8 << 20

PAYLOAD = "block int, payload binary"
QUESTION = "block int, kind int, bucket int, data binary"


def pack(value) -> bytes:
    """A nest of arrays and plain values as bytes. Arrays go column of bytes by column of bytes, which packs sorted keys well."""
    def plain(v):
        if isinstance(v, np.ndarray) and v.dtype != object:
            flat = np.ascontiguousarray(v)
            return ("a", flat.dtype.str, len(flat), flat.view(np.uint8).reshape(len(flat), -1).T.tobytes())
        if isinstance(v, (tuple, list)):
            return ("t", [plain(x) for x in v])
        return ("v", v)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(plain(value), protocol=5))


def unpack(data: bytes):
    def full(v):
        if v[0] == "a":
            dtype = np.dtype(v[1])
            columns = np.frombuffer(v[3], dtype=np.uint8).reshape(dtype.itemsize, v[2])
            return np.ascontiguousarray(columns.T).reshape(-1).view(dtype)
        return tuple(full(x) for x in v[1]) if v[0] == "t" else v[1]
    return full(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))


def sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Numbers of blocks and buckets for the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return total // BLOCK_BYTES + 1, total // BUCKET_BYTES + 1


def deal(docs: DataFrame, doc_id: str, text: str, n_blocks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, payload) rows, dealt by block. Ids must be longs and not null; a null text is empty.

    Rows with one id meet in one block. Columns of ``carry`` travel with their row.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        size = 0

        def flush():
            blocks = sorted(held)
            blobs = [pack((np.array(held[b][0], np.int64), held[b][1], held[b][2])) for b in blocks]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], ["block", "payload"]
            )

        for batch in batches:
            more = zip(*(batch.column(i).to_pylist() for i in range(3, batch.num_columns)), strict=True)
            more = list(more) if carry else [()] * batch.num_rows
            for block, key, body, extra in zip(*(batch.column(i) for i in range(3)), more, strict=True):
                body = body.as_py() or b""
                ids, bodies, extras = held.setdefault(block.as_py(), ([], [], []))
                ids.append(key.as_py())
                bodies.append(body)
                extras.append(extra)
                size += len(body) + 100
                if size >= _FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).cast("binary").alias("body"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )
    return rows.mapInArrow(packed, PAYLOAD).repartition(n_blocks, "block")


def read_block(frame: pd.DataFrame) -> tuple[np.ndarray, list[bytes], list[tuple]]:
    """Ids, bodies and carried values of a block, ordered by (id, body), so in one order in all rounds."""
    ids, bodies, extras = [], [], []
    for payload in frame["payload"]:
        some, more, carried = unpack(payload)
        ids += some.tolist()
        bodies += list(more)
        extras += list(carried)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i], repr(extras[i])))
    return np.array([ids[i] for i in order], np.int64), [bodies[i] for i in order], [extras[i] for i in order]


def questions(block: int, kind: int, buckets: np.ndarray, columns: tuple[np.ndarray, ...]) -> list[tuple]:
    """One row per bucket; ``buckets`` must not fall, and the arrays of ``columns`` run along it."""
    if not len(buckets):
        return []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]))
    return [
        (block, kind, int(buckets[a]), pack(tuple(c[a:b] for c in columns)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "data"])


def answers_by_kind(frame: pd.DataFrame) -> dict[int, list]:
    """The unpacked answers of one block, by kind, in the order of the buckets."""
    found: dict[int, list] = {}
    for kind, _, data in sorted(zip(frame["kind"], frame["bucket"], frame["data"], strict=True), key=lambda r: r[:2]):
        found.setdefault(int(kind), []).append(unpack(data))
    return found


def ask(dealt: DataFrame, fn: Callable, answers: DataFrame | None = None, schema: str = QUESTION) -> DataFrame:
    """``fn(block, ids, bodies, carried values, answers by kind)`` for each block, giving a pandas frame of ``schema``."""
    if answers is None:
        def first(key, blocks):
            return fn(int(key[0]), *read_block(blocks), {})
        return dealt.groupBy("block").applyInPandas(first, schema)

    def later(key, blocks, given):
        return fn(int(key[0]), *read_block(blocks), answers_by_kind(given))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(later, schema)


def answer(asked: DataFrame, settle: dict[int, Callable], n_buckets: int, n_blocks: int) -> DataFrame:
    """Answers to questions, dealt back to their blocks.

    ``settle[kind]`` takes a list of the blocks' column tuples and gives an answer for each. Rows of other kinds
    are notes of a block to itself and come back as they are.
    """
    def settled(key, rows):
        kind = int(key[0])
        if kind not in settle:
            return rows
        rows = rows.sort_values("block", ignore_index=True)
        rows["data"] = [pack(a) for a in settle[kind]([unpack(d) for d in rows["data"]])]
        return rows

    grouped = asked.repartition(n_buckets, "kind", "bucket").groupBy("kind", "bucket")
    return grouped.applyInPandas(settled, QUESTION).repartition(n_blocks, "block")


def split_by(lengths: list[int], values: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(lengths)[:-1])
