"""Sort-means: exact k-means in integers, with distances between centroids saving most others.

Each vector starts from the centroid it had before, ``a``, at squared distance ``d``. The
other centroids are looked at in order of their distance from ``a``; the scan stops at the
first with D > 4 d (squared), since by the triangle inequality that one and all after it are
farther than ``a``. At D = 4 d a centroid may tie, so the scan goes on there. Ties go to the
smaller number. Everything is integer arithmetic, so results don't depend on partitions.

The vectors, with the cluster of each, are a table in the shared folder; a round reads it for
sums by cluster (k rows a task, added up by Spark), then writes the next one and deletes the
last. The driver holds k centroids.

Defined cases: vectors that are null, of another length or with null or non-finite entries are
left out, as in the contract. Fewer than k kept vectors make as many centroids as there are
vectors; none give no rows. Repeated rows are rows like others; equal hashes are ordered by the
vector, so repeated rows may start two equal centroids, of which the larger stays empty. A null
id hashes as an empty string. Entries beyond FITS after scaling use unbounded integers; a
distance or inertia that no long holds is null. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ship_code, stored

SCALE, SIZE, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
#: Entries up to here have squared distances that fit a long, 4 times over, in up to 32,768 components.
FITS = 1 << 22
_LONG, _LIMB = (1 << 63) - 1, 60


def keep(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and v (doubles) of the whole vectors."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) == size) & finite).select("vec_id", v.alias("v"))


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v): longs where all are within FITS, else Python's integers."""
    if not v.size or np.abs(v).max() * scale < FITS:
        return np.floor(v * scale).astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale))
    return np.array([[whole(float(x)) for x in row] for row in v], object).reshape(v.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in longs if both sides have small entries."""
    if x.dtype == object or c.dtype == object or (c.size and np.abs(c).max() > FITS):
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(-1)


class Order:
    """Centroids with, for each, the others in order of distance from it."""

    def __init__(self, centroids: list[list[int]]):
        large = any(abs(v) > FITS for c in centroids for v in c)
        self.c = np.array(centroids, object if large else np.int64)
        k = len(centroids)
        self.between = [squared(self.c, self.c[a]) for a in range(k)]
        self.others = [sorted((j for j in range(k) if j != a), key=lambda j, a=a: (self.between[a][j], j)) for a in range(k)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row, and how many distances that took."""
        cluster, distance, taken = before.copy(), np.zeros(len(x), x.dtype if self.c.dtype != object else object), 0
        for a in np.unique(before):
            rows = np.flatnonzero(before == a)
            start = squared(x[rows], self.c[a])
            taken += len(rows)
            best, at = start.copy(), np.full(len(rows), a)
            open_ = np.arange(len(rows))
            for j in self.others[a]:
                open_ = open_[start[open_] * 4 >= self.between[a][j]]
                if not len(open_):
                    break
                taken += len(open_)
                d = squared(x[rows[open_]], self.c[j])
                nearer = (d < best[open_]) | ((d == best[open_]) & (j < at[open_]))
                best[open_[nearer]], at[open_[nearer]] = d[nearer], j
            cluster[rows], distance[rows] = at, best
        return cluster, distance, taken


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def assigned(table: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """vec_id, v, cluster and distance under these centroids, scanned from the cluster before."""
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(centroids)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), b.num_rows)
                cluster, distance, _ = order.assign(integers(v, scale), b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                long = distance if distance.dtype != object else [int(d) if d <= _LONG else None for d in distance]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(long, pa.int64())], schema=out)

    return table.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<double>, cluster int, distance long")


def sums(table: DataFrame, scale: int = SCALE) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster the count and the exact sums of its vectors.

    Tasks add up their batches and emit a few rows a cluster and component, in limbs of 60
    bits, which Spark adds up; the driver gets one row of each.
    """
    out = pa.schema([("cluster", pa.int32()), ("i", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            x = integers(_matrix(b.column("v"), b.num_rows), scale) if b.num_rows else np.zeros((0, 0))
            cluster = b.column("cluster").to_numpy(zero_copy_only=False)
            for j in np.unique(cluster):
                part = x[cluster == j]
                for i, s in enumerate([len(part), *part.sum(0)]):
                    total[int(j), i] = total.get((int(j), i), 0) + int(s)
        rows = []
        for (j, i), s in total.items():
            limb = 0
            while abs(s) >> _LIMB:
                rows.append((j, i, limb, s & ((1 << _LIMB) - 1)))
                s, limb = s >> _LIMB, limb + 1
            rows.append((j, i, limb, s))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, out)], schema=out)

    parts = table.select("v", "cluster").mapInArrow(run, "cluster int, i int, limb int, s long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        of = found.setdefault(r.cluster, {})
        of[r.i] = of.get(r.i, 0) + (int(r.s) << _LIMB * r.limb)
    return {j: (of[0], [of[i] for i in range(1, len(of))]) for j, of in found.items()}


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: str = SEED, scale: int = SCALE) -> list[list[int]]:
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(map(int, x)) for r in rows for x in integers(np.array([r.v], float), scale)]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """The kept vectors with cluster and distance (stored), and the final centroids."""
    spark = vectors.sparkSession
    ship_code(spark)
    kept = keep(vectors, size)
    centroids = first_centroids(kept, k, seed, scale)
    table = stored(kept.withColumn("cluster", F.lit(0)), "sort-means")
    for r in range(rounds + 1):
        if not centroids:
            return assigned(table, centroids, scale), []
        after = stored(assigned(table, centroids, scale), "sort-means")
        forget(spark, table.stored_at)
        table = after
        if r < rounds:
            for j, (n, s) in sums(table, scale).items():
                centroids[j] = [x // n for x in s]
    return table, centroids


def digest(vectors: DataFrame) -> DataFrame:
    table, centroids = cluster(vectors)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    exact = F.col("distance").cast("decimal(38,0)") if not centroids else F.expr("try_cast(distance AS decimal(38,0))")
    by = table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of"), F.bool_or(F.col("distance").isNull()).alias("lost")).collect()
    fit = lambda x: int(x) if x is not None and x <= _LONG else None
    each = {r.cluster: None if r.lost else r.of for r in by}
    total = None if None in each.values() else fit(sum(each.values()))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return table.select(
        "vec_id", "cluster", "distance",
        of([fit(each.get(j)) for j in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(sha, "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """Lloyd's rounds over all distances, one pair of tables a round."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept)
  QUALIFY k < {CLUSTERS})"""
    for r in range(ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT r, min((d, k)) AS best FROM (SELECT r, k, CAST({distance} AS BIGINT) AS d FROM kept, c{r}) GROUP BY r)"""
        if r < ROUNDS:
            out += f""",
s{r} AS MATERIALIZED (
  SELECT k, list(s ORDER BY i) AS c
  FROM (SELECT best[2] AS k, i, CAST(sum(v) AS BIGINT) AS t, count(*) AS n, (t - ((t % n) + n) % n) // n AS s
        FROM (SELECT r, unnest(x) AS v, unnest(range({SIZE})) AS i FROM kept) JOIN a{r} USING (r) GROUP BY best[2], i)
  GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (k))"""
    return f"""{out}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON k = best[2]"""


SQL = _sql()
