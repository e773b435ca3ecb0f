"""Clustering around centroids in whole numbers, with Ptolemy's inequality to spare distances.

Components become integers, so that distances, sums and means are exact and reruns agree. For a few
fixed pivots, each vector's distances are computed once and stored beside it; each round computes the
centroids' distances to the same pivots. For every pair of pivots (p, s), Ptolemy's inequality
``d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|`` bounds the distance from x to c from below
without touching their components. The bound is rounded down by far more than floating point can be off,
so a centroid that it rules out is farther than the best one known; the others are measured exactly.

A round sends one row of sums a cluster and task to a small aggregation; the driver holds k centroids
and nothing that grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

#: Components, the factor that makes them whole, centroids and rounds.
DIMS, FACTOR, CENTROIDS, ROUNDS = 64, 256.0, 40, 5
#: Fixed pivots among the first centroids.
PIVOTS = 6
#: Scaled components beyond this could overflow a squared distance in 64 bits; they are refused.
LARGEST = 1 << 27
#: What the bound is rounded down by; products and roots of doubles err by less than a thousandth of it.
SLACK = 1e-12
#: Vector and centroid pairs that are measured at once.
CHUNK = 1 << 15


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, factor: float = FACTOR) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` finite components as floor(factor * component); other rows are left out.

    A null id stays null, repeated rows stay repeated. A component beyond ``LARGEST`` is an error: distances would leave 64 bits.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.size("x") == dims)
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    far = F.exists("x", lambda c: F.abs(c) * factor > LARGEST)
    scaled = F.transform("x", lambda c: F.floor(c * factor).cast("long"))
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component times {factor} is beyond {LARGEST}"))).otherwise(scaled).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; null ids come last, ties go by components. At most k rows travel."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def pivots_of(centroids: np.ndarray, m: int = PIVOTS) -> np.ndarray:
    """Up to m different centroids, each the farthest from those before it, starting with the first."""
    chosen = [0]
    gap = _squares(centroids, centroids[:1])[:, 0]
    while len(chosen) < m and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _squares(centroids, centroids[chosen[-1:]])[:, 0])
    return centroids[chosen]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to the few rows of b."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def lower_bounds(to_x: np.ndarray, to_c: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each vector and centroid the greatest Ptolemaic bound over pairs of pivots, rounded down; 0 where none holds.

    to_x and to_c: distances of vectors and centroids to the pivots; between: the pivots' own.
    """
    out = np.zeros((len(to_x), len(to_c)))
    for p, s in combinations(range(len(between)), 2):
        one, two = to_x[:, p, None] * to_c[None, :, s], to_x[:, s, None] * to_c[None, :, p]
        low = (np.abs(one - two) - SLACK * (one + two)) / (between[p, s] * (1 + SLACK))
        np.maximum(out, low, out=out)
    return out


def nearest(v: np.ndarray, to_x: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, both exact, and how many distances were measured.

    The centroid of the least bound is measured first; then all whose bound does not exceed that distance.
    """
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    low = lower_bounds(to_x, np.sqrt(_squares(centroids, pivots)), np.sqrt(_squares(pivots, pivots)))
    rows = np.arange(len(v))
    guess = low.argmin(axis=1)
    found = np.full(low.shape, np.iinfo(np.int64).max)
    best = ((v - centroids[guess]) ** 2).sum(axis=1)
    found[rows, guess] = best
    maybe = low * low * (1 - SLACK) <= best[:, None] * (1 + SLACK)
    maybe[rows, guess] = False
    i, j = np.nonzero(maybe)
    for at in range(0, len(i), CHUNK):
        a, b = i[at : at + CHUNK], j[at : at + CHUNK]
        found[a, b] = ((v[a] - centroids[b]) ** 2).sum(axis=1)
    cluster = found.argmin(axis=1)  # of equal distances the first
    return cluster, found[rows, cluster], len(v) + len(i)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with their distances to the pivots, computed once and written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.sqrt(_squares(_matrix(b.column(1), np.int64, pivots.shape[1]), pivots))
            far = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(pivots)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), far], ["vec_id", "v", "far"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("far", T.ArrayType(T.DoubleType()))])
    return materialize(vectors.mapInArrow(run, schema), "pivot-distances")


def cluster_sums(placed: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each cluster's vectors and sums of components, and the distances measured: one row a cluster and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, measured = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), 0
        for b in batches:
            v = _matrix(b.column(0), np.int64, centroids.shape[1])
            cluster, _, n = nearest(v, _matrix(b.column(1), float, len(pivots)), centroids, pivots)
            np.add.at(sums, cluster, v)
            sizes += np.bincount(cluster, minlength=len(sizes))
            measured += n
        own = np.flatnonzero(sizes)
        columns = [pa.array(own), pa.array(sizes[own]), pa.array(list(sums[own]), pa.list_(pa.int64())), pa.array([measured if k == 0 else 0 for k in range(len(own))], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "size", "sums", "measured"])

    parts = placed.select("v", "far").mapInArrow(run, "cluster long, size long, sums array<long>, measured long")
    kept = [F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("measured").alias("measured"), *kept).collect()  # k rows at most
    sizes, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for r in rows:
        sizes[r["cluster"]] = r["size"]
        sums[r["cluster"]] = r[3:]
    return sizes, sums, sum(r["measured"] for r in rows)


def assign(placed: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid, of equal ones the smallest number, and the squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = nearest(_matrix(b.column(1), np.int64, centroids.shape[1]), _matrix(b.column(2), float, len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    schema = T.StructType([placed.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return placed.select("vec_id", "v", "far").mapInArrow(run, schema)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, measured: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): ``rounds`` of Lloyd's algorithm, then a last assignment.

    Rows whose vector is null, of another length, or not finite are left out; of fewer than k vectors all are
    centroids; no vectors give no rows. A cluster that is left empty keeps its centroid. Other columns of ``df`` are not read.
    measured, if given, receives for each round the vectors and the distances that were measured.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, dims)
    centroids = first_centroids(vectors, k, seed)
    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>").fields])
    if not len(centroids):
        return spark.createDataFrame([], schema)
    pivots = pivots_of(centroids)
    placed = with_pivot_distances(vectors, pivots)
    for _ in range(rounds):
        sizes, sums, n = cluster_sums(placed, centroids, pivots)
        if measured is not None:
            measured.append((int(sizes.sum()), n))
        centroids = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], centroids)
    found = materialize(assign(placed, centroids, pivots), "clusters")
    release(placed)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    rows = [(c, d, sum(inertia.values()), [int(x) for x in centroids[c]]) for c, d in sorted(inertia.items())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(*schema.names)
