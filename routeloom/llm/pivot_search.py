"""Exact top-k by inner product with a pivot table.

Vectors are stored in blocks, cut into cells by their nearest pivot; a cell keeps the least and the
largest distance of its vectors to each of a fixed number of pivots. For a query, how far d(q, p) lies
outside of that range bounds d(q, x) from below for every pivot p; the largest bound gives the most
that the inner product can be,
    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2.
Cells are taken in order of that bound; a query meets those whose bound its worst kept score does not
exceed: the rest cannot enter. Ties go to the smaller id, so only a bound strictly below stops.
A cell meets the queries left in one matrix product, in the narrowest type that is exact.

The stated query set meets the vectors in slabs of blocks: a task reads a slab, then one pack of
queries after another, and returns at most k + 1 rows a query, its own among them; a final ranking
drops that one and merges them. A slab holds SLAB blocks at most and a task meets PART packs at
most, so that what is sent is each query once a slab and each vector once a part: one of both grows
with the square of the table, by a factor of 1 / (SLAB * block_rows). Pivots come from a bounded
sample of vectors (``pivot_sample``), cut by hash before it is sent to the driver; any pivots give
exact results, they only set the work.

Null vectors, and those with null or non-finite components, take no part. Vectors
meet only those of their own length. Rows that repeat an id are each candidates; a
query row leaves out itself alone. Empty table: no rows. Other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch, small_batches


#: Bytes of a block or a pack at most, as 64-bit numbers; rows of a cell; blocks of a slab and packs that meet it in one task.
BLOCK_BYTES, CELL_ROWS, SLAB, PART = 1 << 21, 512, 64, 256
PACKED = "pack long, n long, ids binary, x binary, width int, cells binary, near binary, far binary, most binary"
FOUND = "query_id long, row long, vec_id long, score long, own boolean"


def _numbers(lists: pa.ChunkedArray | pa.Array) -> pa.Array:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return (pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists).flatten()


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, v array<long>): floor(scale * x) of the vectors that take part."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, sizes = _numbers(b["x"]), b["x"].value_lengths().to_numpy().astype(np.int64)
            y = x.to_numpy(zero_copy_only=False)  # null as NaN
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(y)], minlength=len(sizes)) > 0
            z = np.floor(y[np.repeat(~bad, sizes)] * scale)
            v = np.where(z >= 2.0**63, 2**63 - 1, np.clip(z, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(sizes[~bad])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["id"].filter(pa.array(~bad)), pa.array(sizes[~bad].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v))], names=["id", "dim", "v"])

    x = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    return x.mapInArrow(floors, f"id {x.schema['id'].dataType.simpleString()}, dim int, v array<bigint>")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    chosen = [sample[0]]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(sample[far.argmax()])
        far = np.minimum(far, np.linalg.norm(sample - chosen[-1], axis=1))
    return np.array(chosen)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _packed(batches: Iterator[pa.RecordBatch], dim: int, rows: int, pivots: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) as they come, so many in one, under a number that leaves room for one of each row. pivots: in cells by the nearest one, with each cell's distances and largest square."""
    parts, n, first = [], 0, (task.partitionId() if (task := TaskContext.get()) else 0) << 40

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        ids, x = t["id"].to_numpy().astype("<i8"), _numbers(t["v"]).to_numpy().astype("<i8").reshape(t.num_rows, dim)
        cells = np.zeros(0, "<i8")
        near = far = most = np.zeros(0)
        if pivots is not None:
            d = _distances(x.astype(float), pivots)
            home = d.argmin(axis=1)
            order = np.lexsort((d.min(axis=1), home))
            ids, x, d, home = ids[order], x[order], d[order], home[order]
            starts = [0]
            for at in [*(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]:
                while at - starts[-1] > CELL_ROWS:
                    starts.append(starts[-1] + CELL_ROWS)
                if at - starts[-1] >= CELL_ROWS // 2 and at < len(home):
                    starts.append(at)
            cells = np.array(starts, "<i8")
            near, far = np.minimum.reduceat(d, cells), np.maximum.reduceat(d, cells)
            most = np.maximum.reduceat((x.astype(float) ** 2).sum(axis=1), cells)
        width = next(w for w in (2, 4, 8) if w == 8 or -(1 << 8 * w - 1) <= x.min(initial=0) and x.max(initial=0) < 1 << 8 * w - 1)
        cols = [[first], [len(ids)], [ids.tobytes()], [x.astype(f"<i{width}").tobytes()], [width], *[[c.astype(k).tobytes()] for c, k in ((cells, "<i8"), (near, "<f8"), (far, "<f8"), (most, "<f8"))]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pack", "n", "ids", "x", "width", "cells", "near", "far", "most"])

    for b in batches:
        at = 0
        while at < b.num_rows:
            take = min(rows - n, b.num_rows - at)
            parts.append(b.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield one(parts)
                parts, n, first = [], 0, first + n
    if parts:
        yield one(parts)


class Block:
    """A packed block: ids, x, and its cells."""

    def __init__(self, row: dict, dim: int, n_pivots: int):
        self.ids, self.x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["x"], f"<i{row['width']}").reshape(row["n"], dim)
        self.most_x = max(abs(int(self.x.min(initial=0))), abs(int(self.x.max(initial=0))))
        self.cells = np.append(np.frombuffer(row["cells"], "<i8"), row["n"])
        self.near, self.far = (np.frombuffer(row[c], "<f8").reshape(-1, n_pivots) for c in ("near", "far"))
        self.most = np.frombuffer(row["most"], "<f8")


def pack_top_k(q: np.ndarray, blocks: list[Block], pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best in the blocks."""
    n, dim = q.shape
    q2, to_pivot = (q.astype(float) ** 2).sum(axis=1), _distances(q.astype(float), pivots)
    most_q = max(abs(int(q.min(initial=0))), abs(int(q.max(initial=0))))
    kinds = {t: q.astype(t) for t in (np.float32, np.float64)} | {np.int64: q.astype(np.int64)}
    row, ids, score = (np.zeros(0, np.int64) for _ in range(3))
    # the k-th score and its id, once there are k
    least, last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
    for b in blocks:
        whole = most_q * b.most_x * max(1, dim)
        kind = np.float32 if whole < 2**24 else np.float64 if whole < 2**52 else np.int64
        qf = kinds[kind]
        low = np.zeros((n, len(b.most)))
        for p in range(len(pivots)):
            d = to_pivot[:, p, None]
            np.maximum(low, np.maximum(b.near[:, p] - d, d - b.far[:, p]), out=low)
        slack = 1e-9 * (q2[:, None] + b.most) + 1e-6  # distances are in floating point
        bound = (q2[:, None] + b.most - low * low) / 2 + slack
        for c in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable").tolist():
            left = np.flatnonzero(bound[:, c] >= least)
            if not len(left):
                continue
            x, xid = b.x[b.cells[c] : b.cells[c + 1]], b.ids[b.cells[c] : b.cells[c + 1]]
            s = (qf if len(left) == n else qf[left]) @ x.astype(kind).T
            floor = least[left]
            if np.isinf(floor).any() and s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k].astype(float))
            # scores beyond 2**52 are compared rounded: none is lost, they are ranked whole
            at, col = np.nonzero((s if kind is np.float32 else s.astype(float)) >= floor[:, None].astype(np.float32 if kind is np.float32 else float))
            r, i, v = left[at], xid[col], s[at, col].astype(np.int64)
            if kind is not np.int64:
                enters = (v > least[r]) | (i < last[r])
                r, i, v = r[enters], i[enters], v[enters]
            if not len(r):
                continue
            # only queries with something new are ranked again
            new = np.zeros(n, bool)
            new[r] = True
            again = new[row]
            r, i, v = np.concatenate([row[again], r]), np.concatenate([ids[again], i]), np.concatenate([score[again], v])
            order = np.lexsort((i, -v, r))
            r, i, v = r[order], i[order], v[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            kth = place == k - 1
            least[r[kth]], last[r[kth]] = v[kth], i[kth]
            kept = place < k
            row, ids, score = np.concatenate([row[~again], r[kept]]), np.concatenate([ids[~again], i[kept]]), np.concatenate([score[~again], v[kept]])
    return row, ids, score


def _sample(own: DataFrame, n: int, dim: int, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those of the smallest hashes. A share of the hashes is cut off first, so that each task
    sends the driver its part of about four times as many rows, however many tasks there are."""
    h = F.xxhash64(F.lit(3), "id", "v")
    least = -(2**63) + (2**64 - 1) * min(4 * rows, n) // max(n, 1)
    found = own.where(h <= least).orderBy(h, "id").limit(rows).select("v").toPandas()["v"].tolist()
    return np.array(found or [r["v"] for r in own.select("v").limit(1).collect()], float).reshape(-1 if dim else len(found) or 1, dim)


def meetings(stored: DataFrame, asked: DataFrame, slabs: int, parts: int) -> DataFrame:
    """Each block, once a part, and each pack of queries (asks = 1), once a slab, with the task where they meet."""
    deal = lambda n: F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.withColumn("slab", deal(slabs)).withColumn("part", every(parts)).withColumn("asks", F.lit(0))
    right = asked.withColumn("part", deal(parts)).withColumn("slab", every(slabs)).withColumn("asks", F.lit(1))
    return left.unionByName(right).withColumn("task", F.col("slab") * parts + F.col("part"))


def _one_length(scratch: Scratch, ints: DataFrame, dim: int, n: int, is_query: Column, k: int, n_pivots: int, pivot_sample: int, block_rows: int, query_rows: int) -> DataFrame:
    """The k + 1 best of each slab for the vectors of one length, and whether a row is as the query's own."""
    own = ints.where(F.col("dim") == dim).select("id", "v")
    pivots = choose_pivots(_sample(own, n, dim, pivot_sample), n_pivots)
    fit = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    block_rows, query_rows = min(block_rows, fit), min(query_rows, fit)
    # rows as they lie, dealt by no key: copies of one row fill blocks as others do
    stored = scratch.save(own.mapInArrow(lambda batches: _packed(batches, dim, block_rows, pivots), PACKED), f"blocks-{dim}")
    queries = own.where(is_query)
    groups = max(1, -(-queries.count() // query_rows))
    asked = scratch.save(queries.repartition(groups).mapInArrow(lambda batches: _packed(batches, dim, query_rows, None), PACKED), f"queries-{dim}")
    (blocks,), (packs,) = (df.agg(F.count("*")).first() for df in (stored, asked))
    cores = ints.sparkSession.sparkContext.defaultParallelism
    slabs, parts = max(-(-blocks // SLAB), min(blocks, 4 * cores), 1), max(-(-packs // PART), 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["task"] != at:
                    at, held = row["task"], []
                if not row["asks"]:
                    held.append(Block(row, dim, len(pivots)))
                    continue
                q, qid = np.frombuffer(row["x"], f"<i{row['width']}").reshape(row["n"], dim).astype(np.int64), np.frombuffer(row["ids"], "<i8")
                r, x, s = pack_top_k(q, held, pivots, k + 1)
                self_score = (q * q).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (qid[r], row["pack"] + r, x, s, (x == qid[r]) & (s == self_score[r]))], names=["query_id", "row", "vec_id", "score", "own"])

    # blocks of a slab come before the packs that meet them
    return meetings(stored, asked, slabs, parts).repartitionById(slabs * parts, "task").sortWithinPartitions("task", "asks").mapInArrow(meet, FOUND)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, n_pivots: int = 32, pivot_sample: int = 2000, block_rows: int = 4096, query_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on the column ``id``."""
    spark = vectors.sparkSession
    small_batches(spark, 64)
    scratch = Scratch(spark, "pivots")
    ints = scratch.save(quantised(vectors, scale, id_col, vec_col), "vectors")
    counts = {r["dim"]: r["n"] for r in ints.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = [_one_length(scratch, ints, dim, n, is_query, k, n_pivots, pivot_sample, block_rows, query_rows) for dim, n in sorted(counts.items())]
    result = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)
    best = [F.desc("score"), F.col("vec_id")]
    # one row of a query is its own, whichever of equal ones
    owns = F.sum(F.col("own").cast("int")).over(Window.partitionBy("query_id", "row").orderBy(*best).rowsBetween(Window.unboundedPreceding, 0))
    others = result.repartition("query_id").withColumn("owns", owns).where(~F.col("own") | (F.col("owns") > 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
