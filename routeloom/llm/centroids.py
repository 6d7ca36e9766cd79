"""Centroid clustering in exact integers with an incremental distance matrix.

The vectors' state is a table: components, squared length and the dot product with
every centroid, all exact integers. A round does not form distances anew:

1. cluster sums by component give the new centroids, exact floor(sum / count);
2. of each centroid only the components that changed matter: a vector's dot product
   grows by its components there times the changes. A centroid that did not move costs
   nothing, and when none moved the rounds end early, as all that follow are alike;
3. distance = |v|^2 - 2 v.c + |c|^2, the least one wins, ties go to the smaller number.

The state is written each round to the shared folder and the one before is deleted, so a
lost executor costs a re-read. What reaches the driver are ``k`` rows of sums; what
goes to the tasks are ``k`` centroids. Cluster sums are combined before the shuffle, so a
cluster of any size is fine. The first centroids come from one bounded top-k.

Vectors null, of another length, or with null or non-finite components take no part.
Repeated ids are vectors of their own; among equal hashes the smaller components come
first, null ids last. Fewer vectors than ``k``: as many centroids. Empty table: no rows.
Other columns, whatever their names, play no part. Components of 2**27 or more in amount,
beyond which 64-bit sums could not be exact, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch

LARGEST = 1 << 27
STATE = "id {kind}, v array<int>, norm long, dots array<long>, cluster int, distance long"


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<int>): floor(scale * x) of the vectors that take part."""
    whole = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    small = F.when(F.forall("w", lambda e: F.abs(e) < LARGEST), F.transform("w", lambda e: e.cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")))
    return (
        vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda e: e.cast("double")).alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dims) & whole)
        .select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("w")).select("id", small.alias("v"))
    )


def _dots(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of integer rows; in floating point where every sum stays below 2**53."""
    if float(np.abs(v).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, v.shape[1]) < 2**53:
        return (v.astype(float) @ c.astype(float).T).astype(np.int64)
    return v @ c.T


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel(), kind))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _nearest(norm: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = norm[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None]
    at = far.argmin(axis=1)  # the first of equal ones
    return at, far[np.arange(len(at)), at]


def _batch(ids: pa.Array, v: np.ndarray, norm: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    at, far = _nearest(norm, dots, centroids)
    arrays = [ids, _lists(v, pa.int32()), pa.array(norm), _lists(dots, pa.int64()), pa.array(at, pa.int32()), pa.array(far)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "v", "norm", "dots", "cluster", "distance"])


def first_state(kept: DataFrame, centroids: np.ndarray, schema: str) -> DataFrame:
    """Dot products in full, once."""
    dims = centroids.shape[1]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column(1), dims)
            yield _batch(b.column(0), v, (v * v).sum(axis=1), _dots(v, centroids), centroids)

    return kept.mapInArrow(start, schema)


def next_state(state: DataFrame, before: np.ndarray, after: np.ndarray, schema: str) -> DataFrame:
    """Dot products moved by the components of centroids that changed."""
    k, dims = after.shape
    moved = after - before
    changes = [(j, np.flatnonzero(moved[j])) for j in range(k) if moved[j].any()]
    whole = [j for j, at in changes if 2 * len(at) > dims]
    sparse = [(j, at) for j, at in changes if 2 * len(at) <= dims]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dots = _rows(b.column(1), dims), _rows(b.column(3), k)
            if whole:
                dots[:, whole] += _dots(v, moved[whole])
            for j, at in sparse:
                dots[:, j] += _dots(v[:, at], moved[j : j + 1, at])[:, 0]
            yield _batch(b.column(0), v, b.column(2).to_numpy(), dots, after)

    return state.mapInArrow(move, schema)


def new_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the clusters' means; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("v")[d].cast("long")).alias(f"s{d}") for d in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [s // row["n"] for s in row[2:]]
    return out


def cluster(vectors: DataFrame, hashed: Column, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and the cluster's final ``centroid`` (array<long>).

    hashed: an expression over the column ``id``; the vectors smallest in it are the first centroids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = STATE.format(kind=kind)
    kept = scratch.save(kept_vectors(vectors, dims, scale, id_col, vec_col), "kept")
    first = kept.orderBy(F.asc_nulls_last(hashed), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r["v"] for r in first], np.int64)
    state, held = scratch.save(first_state(kept, centroids, schema), "round-0"), "round-0"
    scratch.drop("kept")
    for r in range(1, rounds + 1):
        after = new_centroids(state, centroids)
        if (after == centroids).all():
            break
        state = scratch.save(next_state(state, centroids, after, schema), f"round-{r}")
        scratch.drop(held)
        centroids, held = after, f"round-{r}"
    final = state.select("id", "cluster", "distance")
    totals = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(t["cluster_inertia"] for t in totals)
    known = spark.createDataFrame([(t["cluster"], t["cluster_inertia"], inertia, centroids[t["cluster"]].tolist()) for t in totals], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # k rows at most
    return final.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
