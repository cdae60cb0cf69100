"""Clustering vectors around centroids, with a LAESA table of distances to pivots.

1. ``integer_vectors`` keeps the vectors with the right number of finite components and turns them into integers, so
   that every sum and distance is exact and no result depends on the order of rows.
2. The first centroids are the vectors whose ids have the least digests; the pivots are a few of them that lie far
   apart. They stay fixed. ``pivot_table`` stores the squared distances of every vector to the pivots, once.
3. In each round a task knows the centroids' distances to the pivots. The largest difference of two distances to one
   pivot is a lower bound of the distance of vector and centroid (triangle inequality). A vector meets the centroids in
   ascending order of their bounds, gets exact integer distances to them, and stops at the first bound above the best
   distance: no centroid that it leaves out can be nearer or as near.
4. A task gives out one row of sums per centroid; Spark adds these, and the driver holds the k new centroids only.

Memory: a task holds one Arrow batch of vectors, and its bounds against k centroids. k times the number of components,
both parameters, go to the driver and to every task.

Defined results: vectors that are null, of another length, or with a null, infinite or not-a-number component are left
out. Components beyond 2**27 in size after scaling are taken as 2**27, so that squared distances fit a long. Rows with
the same id are vectors of their own; among equal digests the one with the lesser components comes first. A null id is
written as ``-``. With fewer vectors than k, each is a centroid. Equal distances go to the smaller number. A table
without vectors gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.tables import kept

COMPONENTS, SCALE = 64, 256
CLUSTERS, ROUNDS, PIVOTS = 40, 5, 8
SEED = "2:"
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the vectors that are whole, each component as floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = vectors.where(F.col(vector).isNotNull()).where((F.size(x) == size) & finite)
    within = lambda c: F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    return whole.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(within(c)).cast("int")).alias("vec"))


def first_centroids(vecs: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the least digests of their ids, in the order of these."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("-"))), 256)
    rows = vecs.orderBy(digest, "vec").limit(k).select("vec").collect()
    return np.array([r["vec"] for r in rows], dtype=np.int64)


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all points."""
    out = np.empty((len(rows), len(points)), dtype=np.int64)
    for j, point in enumerate(points):
        apart = rows - point
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def spread_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n of the points, each the farthest from those chosen before it; the first point begins."""
    if not len(points):
        return points
    chosen = [0]
    far = squared(points, points[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _matrix(lists: pa.Array, kind: type = np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _rows_of(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1), kind))


def pivot_table(vecs: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, vec, to_pivots): the squared distances of every vector to the pivots, stored."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _rows_of(squared(_matrix(batch.column(1)), pivots), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), far], names=["vec_id", "vec", "to_pivots"])

    return kept(vecs.select("vec_id", "vec").mapInArrow(measure, "vec_id bigint, vec array<int>, to_pivots array<bigint>"), "pivots")


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of every row, and how many exact distances were taken."""
    reach, ends = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(squared(centroids, pivots).astype(np.float64))
    bound = np.zeros((len(rows), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(reach[:, p, None] - ends[None, :, p]), out=bound)
    # what rounding of the roots may add is taken off, so a bound is never above the distance
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0.0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(rows), np.iinfo(np.int64).max)
    at = np.zeros(len(rows), dtype=np.int64)
    left, taken = np.arange(len(rows)), 0
    for step in range(len(centroids)):
        next_ = order[left, step]
        left, next_ = (x[bound[left, next_] <= best[left]] for x in (left, next_))
        if not len(left):
            break
        apart = rows[left] - centroids[next_]
        far = np.einsum("ij,ij->i", apart, apart)
        better = (far < best[left]) | ((far == best[left]) & (next_ < at[left]))
        best[left[better]], at[left[better]] = far[better], next_[better]
        taken += len(left)
    return at, best, taken


def _sums(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0))
                at, _, _ = nearest(rows, _matrix(batch.column(1)), centroids, pivots)
                np.add.at(total, at, rows)
                count += np.bincount(at, minlength=len(centroids))
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), _rows_of(total[held], pa.int64())], names=["cluster", "n", "total"])

    return add


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; those without any stay."""
    part = table.select("vec", "to_pivots").mapInArrow(_sums(centroids, pivots), "cluster bigint, n bigint, total array<bigint>")
    size = centroids.shape[1]
    sums = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
    out = centroids.copy()
    for row in sums.collect():  # at most k rows
        out[row["cluster"]] = np.array(row["total"], dtype=np.int64) // row["n"]
    return out


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far, _ = nearest(_matrix(batch.column(1)), _matrix(batch.column(2)), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return table.select("vec_id", "vec", "to_pivots").mapInArrow(make, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS,
    size: int = COMPONENTS, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every whole vector, the final centroids)."""
    vecs = integer_vectors(vectors, vec_id, vector, size, scale)
    centroids = first_centroids(vecs, k, seed)
    if not len(centroids):
        return vecs.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids
    fixed = spread_pivots(centroids, pivots)
    table = pivot_table(vecs, fixed)
    for _ in range(rounds):
        centroids = moved(table, centroids, fixed)
    return assign(table, centroids, fixed), centroids


def told(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with the inertia of its cluster and of all, and a digest of its centroid."""
    assigned = kept(assigned, "assigned")
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    digests = assigned.sparkSession.createDataFrame(list(enumerate(names)), "of int, centroid_sha256 string")
    inertia = assigned.groupBy(F.col("cluster").alias("of_cluster")).agg(F.sum("distance").alias("cluster_inertia"))
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    each = inertia.crossJoin(F.broadcast(whole)).join(F.broadcast(digests), F.col("of_cluster") == F.col("of"))  # one row per cluster
    return assigned.join(F.broadcast(each), assigned["cluster"] == F.col("of_cluster")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT v.vec_id, any_value(v.w) AS w, arg_min(c.c, [c.d, c.c]) AS c, min(c.d) AS d
  FROM v JOIN LATERAL (
    SELECT c{i}.c, CAST(list_sum(list_transform(list_zip(v.w, c{i}.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM c{i}
  ) c ON true GROUP BY v.vec_id
)"""


def _move(i: int) -> str:
    return f"""
m{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w
  FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, w FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40
), {",".join(_round(i) + "," + _move(i) for i in range(ROUNDS))}, {_round(ROUNDS)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c
"""
