"""Exact top-k inner products by length buckets.

Candidates are ordered by length and cut into buckets of equal size, longest first. A query whose k-th best product so far
is ``theta`` needs a cosine of ``theta / (its length * the bucket's longest length)`` in a bucket, its local threshold there. Above 1 the
bucket is skipped. A high threshold prunes by coordinates: a vector that close to the query must agree with it on the query's
heaviest coordinates. A lower one prunes by length: only the front of the bucket is long enough. What is left is verified by
exact products.

Queries are dealt to blocks and buckets to stripes; a task takes one (block, stripe) at a time and streams the buckets of the stripe, longest
first, past the block's queries, so memory is a block and a bucket whatever the size of the table. First thresholds come from
the longest bucket, which every block sees before the stripes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.llm.ranks import positions
from ridelake.plans.session import cut

BUCKET = 4096
QUERY_BLOCK = 16384
COORDINATES = 8  # the focus coordinates of a query
COORDINATE_FROM = 0.8  # local threshold from which coordinates prune
_SLACK = 1e-9  # bounds are computed in floating point; products are exact
_EXACT = 2.0**53
_CHUNK = 512  # queries whose products with a bucket are held at once

FOUND = "query_row long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integer_length(vector: Column, scale: int) -> Column:
    """Length of the vector of floors; used for bounds and order only."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.sqrt(F.aggregate(F.transform(vector, whole), F.lit(0.0), lambda a, y: a + y * y))


def floors(column: pa.ListArray, scale: int, width: int | None = None) -> np.ndarray:
    """The vectors as rows of whole numbers in doubles; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(flat * scale)
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles where every partial sum fits, else in Python's integers.

    The latter are held to the range of a long.
    """
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not width or not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    if np.abs(left).max() * np.abs(right).max() * width < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    exact = whole(left) @ whole(right).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def at_most(score: int) -> float:
    """A double not above a score."""
    value = float(score)
    return value if abs(value) < _EXACT else math.nextafter(value, -math.inf)


class Block:
    """The queries of a block with their best ``k`` candidates so far."""

    def __init__(self, rows, ids, vectors: np.ndarray, lengths: np.ndarray, theta: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.lengths, self.k = rows, ids, vectors, lengths, k
        self.group = None
        self.theta = theta  # least score that can matter, -inf where nothing is known
        self.best: list[tuple[np.ndarray, ...] | None] = [None] * len(rows)
        self.pruned = {"skipped": 0, "coordinate": 0, "length": 0, "verified": 0}

    def meet(self, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        """One bucket, longest vectors first; ``unnamed`` marks null ids."""
        reach = self.lengths * lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, self.theta / reach, np.where(self.theta > 0, np.inf, -np.inf))
        skipped = local > 1 + _SLACK
        closely = ~skipped & (local >= COORDINATE_FROM)
        broadly = np.flatnonzero(~skipped & ~closely)
        self.pruned["skipped"] += int(skipped.sum())
        for q in np.flatnonzero(closely).tolist():
            self.pruned["coordinate"] += 1
            near = np.flatnonzero(agreeing(self.vectors[q], self.lengths[q], vectors, lengths, self.theta[q]))
            self.pruned["verified"] += len(near)
            if len(near):
                self._merge(q, products(self.vectors[q : q + 1], vectors[near])[0], near, rows, ids, unnamed)
        broadly = broadly[np.argsort(-local[broadly], kind="stable")]  # alike thresholds have alike fronts
        for at in range(0, len(broadly), _CHUNK):
            some = broadly[at : at + _CHUNK]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.theta[some] > 0, self.theta[some] / self.lengths[some], 0) * (1 - _SLACK)
            front = int(np.searchsorted(-lengths, -least.min(), side="right"))
            self.pruned["length"] += len(some)
            self.pruned["verified"] += len(some) * front
            scores = products(self.vectors[some], vectors[:front])
            hit = scores >= self.theta[some][:, None]
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                near = np.flatnonzero(hit[i])
                self._merge(int(some[i]), scores[i, near], near, rows, ids, unnamed)

    def _merge(self, q: int, scores, near, rows, ids, unnamed) -> None:
        other = rows[near] != self.rows[q]
        scores, near = scores[other], near[other]
        if len(scores) > 4 * self.k:
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, near = scores[scores >= last], near[scores >= last]
        found = (scores, unnamed[near], ids[near])
        if self.best[q] is not None:
            found = tuple(np.concatenate(pair) for pair in zip(self.best[q], found, strict=True))
        order = np.lexsort((found[2], found[1], ~found[0]))[: self.k]
        self.best[q] = tuple(f[order] for f in found)
        if len(order) == self.k:
            self.theta[q] = max(self.theta[q], at_most(int(self.best[q][0][-1])))

    def found(self) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]
        for row, query, best in zip(self.rows.tolist(), self.ids.tolist(), self.best, strict=True):
            if best is None:
                continue
            scores, unnamed, ids = (b.tolist() for b in best)
            columns[0] += [row] * len(scores)
            columns[1] += [query] * len(scores)
            columns[2] += [None if u else i for u, i in zip(unnamed, ids, strict=True)]
            columns[3] += scores
            if len(columns[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "vec_id", "score"])
                columns = [[], [], [], []]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "vec_id", "score"])


def agreeing(query: np.ndarray, length: float, vectors: np.ndarray, lengths: np.ndarray, theta: float) -> np.ndarray:
    """Whether each vector can still reach ``theta``, by the query's heaviest coordinates.

    First each coordinate on its own: a vector within an angle of the query stands to the axis at the query's angle, give or
    take that one. Then all together: the product on these coordinates and, for the rest, that of the remaining
    lengths.
    """
    width = min(len(query), vectors.shape[1])
    focus = np.argsort(-np.abs(query[:width]), kind="stable")[:COORDINATES]
    cosine = np.divide(theta, length * lengths, out=np.full(len(lengths), np.inf), where=lengths > 0)
    alive = cosine <= 1 + _SLACK
    angle = np.arccos(np.clip(cosine, -1, 1))
    for f in focus[:2]:
        own = math.acos(max(-1.0, min(1.0, query[f] / length)))
        unit = np.divide(vectors[:, f], lengths, out=np.zeros(len(lengths)), where=lengths > 0)
        alive &= unit >= np.cos(np.minimum(own + angle, math.pi)) - _SLACK
        alive &= unit <= np.cos(np.maximum(own - angle, 0)) + _SLACK
    mine, theirs = query[focus], vectors[:, focus]
    rest = math.sqrt(max(length * length - float(mine @ mine), 0.0))
    others = np.sqrt(np.maximum(lengths * lengths - np.einsum("ij,ij->i", theirs, theirs), 0))
    bound = theirs @ mine + rest * others
    return alive & (bound + _SLACK * (1 + length * lengths) >= theta)


# --- over a table --------------------------------------------------------------------------------


def _stream(k: int, scale: int, bucket: int):
    """Queries and candidates, ordered by (group, kind, row), to the best candidates of each group's queries."""
    def lengths_of(batch: pa.Table) -> np.ndarray:
        return batch.column("length").to_numpy()

    def ids_of(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column("id")
        return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        at, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            """Take in what has been gathered: a block's queries, or one bucket."""
            nonlocal block, held
            part = pa.Table.from_batches(held).combine_chunks()
            held = []
            vectors = floors(part.column("vector").combine_chunks(), scale)
            rows, (ids, unnamed) = part.column("row").to_numpy(), ids_of(part)
            if at[1] == 0:
                if block:
                    yield from block.found()
                theta = part.column("theta").fill_null(-np.inf).to_numpy().copy()
                block = Block(rows, ids, vectors, lengths_of(part), theta, k)
            elif block and at[0] == block.group:
                block.meet(rows, ids, unnamed, vectors, lengths_of(part))
            if at[1] == 0:
                block.group = at[0]

        for batch in batches:
            group, kind, row = (batch.column(c).to_numpy() for c in ("g", "kind", "row"))
            front = np.where(kind == 0, 0, row // bucket)
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0) | (np.diff(front) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                key = (int(group[a]), int(kind[a]), int(front[a]))
                if held and key != at:
                    yield from settle()
                at = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle()
        if block:
            yield from block.found()

    return run


def _met(queries: DataFrame, candidates: DataFrame, tasks: int, k: int, scale: int, bucket: int) -> DataFrame:
    """Each group's queries past its candidates. A group is a task's work, streamed in order of length."""
    sent = ("g", "kind", "row", "id", "vector", "length", "theta")
    rows = queries.select(*sent).unionByName(candidates.select(*sent))
    return rows.repartition(tasks, "g").sortWithinPartitions("g", "kind", "row").mapInArrow(_stream(k, scale, bucket), FOUND)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding",
    bucket: int = BUCKET, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` largest products of each query row with the other rows: query_id, rank, vec_id, score.

    A component x becomes floor(scale * x) and products are exact integers, held to the range of a long. ``queries`` says which rows
    ask; a null is no. A row is no candidate of its own, but another row with its id is. Ties go to the smaller id, null ids
    last; null, and vectors with null or non-finite components, take no part; of vectors of different sizes the shorter is
    filled with zeros. Fewer than k others: all of them. Other columns are not read.
    """
    spark, vector = vectors.sparkSession, F.col(embedding)
    rows = vectors.where(usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), vector.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"),
        integer_length(vector, scale).alias("length"),
    ).withColumn("_short", -F.col("length"))
    placed = cut(positions(rows, [], ["_short", "id"]).drop("_short", "total").withColumnRenamed("position", "row"))
    n, n_asks = placed.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    none = F.lit(None).cast("double")
    asking = placed.where("asks").withColumn("theta", none).withColumn("kind", F.lit(0))
    held = placed.withColumn("theta", none).withColumn("kind", F.lit(1))
    tasks, n_buckets = _tasks(spark), -(-n // bucket)
    spread = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    fine = max(1, -(-n_asks // 1024))
    found = cut(_met(
        asking.withColumn("g", spread(fine)), held.where(F.col("row") < bucket).withColumn("g", each(fine)),
        min(fine, tasks), k, scale, bucket,
    ))
    if n_buckets > 1:
        first = found.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        known = first.where(F.col("n") == k).select("row", F.col("least").cast("double").alias("theta"))
        blocks = max(1, -(-n_asks // query_block))
        stripes = min(n_buckets - 1, -(-tasks // blocks))
        told = asking.drop("theta").join(known, "row", "left").withColumn("stripe", each(stripes))
        rest = held.where(F.col("row") >= bucket).withColumn("block", each(blocks))
        stripe = F.pmod(F.floor(F.col("row") / bucket), F.lit(stripes))
        found = found.unionByName(_met(
            told.withColumn("g", spread(blocks) * stripes + F.col("stripe")),
            rest.withColumn("g", F.col("block") * stripes + stripe), min(blocks * stripes, tasks), k, scale, bucket,
        ))
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
