"""Centroid clustering by sort-means: from a vector's last centroid the others are met in the order of their distance from it, until one is more than twice as far from it as the vector is.

Everything is in whole numbers. Centroids (k * d numbers) go with the code; each round reads the vectors once, writes them with their new cluster, and sums them by cluster in one aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import forget, modest_batches, written

#: Components become floor(SCALE * x). With components of up to MOST a squared distance of WIDEST of them fits a long.
SCALE, MOST, WIDEST = 64, 1 << 27, 127


def integers(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, x (array<long>) of the rows whose vector has exactly dims components, none null, non-finite or beyond MOST."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: F.coalesce(F.abs(c * SCALE) < MOST, F.lit(False)) & ~F.isnan(c))  # NaN is the largest double
    return v.where((F.size("v") == dims) & fit).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors of smallest sha256 of 1:<vec_id>; a vec_id's rows come in the order of their components. Rows without a vec_id are none."""
    named = rows.where("vec_id is not null").withColumn("sha", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in named.orderBy("sha", "x").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    off = x - c
    return np.einsum("ij,ij->i", off, off)


def nearest(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared distance, scanning from its last one.

    A centroid of squared distance D from the last one can't be nearer than that one, nor as near, if D > 4 * (the vector's squared distance from it); an equal D may tie.
    As the order rises, those left to scan become ever fewer.
    """
    best, distance = last.copy(), np.empty(len(x), np.int64)
    for a in np.unique(last):
        rows = np.flatnonzero(last == a)
        own = squared(x[rows], centroids[a])
        distance[rows] = own
        apart = squared(centroids, centroids[a])
        for c in np.argsort(apart, kind="stable"):
            if c == a:
                continue
            left = apart[c] <= 4 * own
            rows, own = rows[left], own[left]
            if not len(rows):
                break
            d = squared(x[rows], centroids[c])
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
            best[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
    return best, distance


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, x, cluster: the last one) with their new cluster and their squared distance."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("x")
            x = vectors.flatten().to_numpy().reshape(len(batch), centroids.shape[1])
            best, distance = nearest(x, batch.column("cluster").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "x", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, x array<long>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' exact floor(sum / count) by component; one without vectors stays. Sums meet within tasks first, so a hot cluster is no hot task."""
    dims = centroids.shape[1]
    out = centroids.copy()
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect():
        out[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row of vectors (vec_id, embedding) that is kept.

    Kept are vectors of exactly dims components (at most WIDEST), none null, non-finite or of 2**21 and beyond (their squared distances may be no longs). Rows that share a vec_id
    stay separate rows; a null vec_id stays null and starts no centroid, unless no row has one: then all are in one cluster about the origin. Equal vectors have equal clusters; of equally near centroids the one of the smaller number
    counts. With fewer than k rows there are fewer centroids. Other columns are ignored. An empty table gives an empty result.
    """
    if dims > WIDEST:
        raise ValueError(f"more than {WIDEST} dimensions")
    modest_batches(vectors.sparkSession)
    kept = written(integers(vectors, dims), "integers")
    centroids = first_centroids(kept, k)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    rows = kept.withColumn("cluster", F.lit(0))
    before = kept
    for left in range(rounds, -1, -1):
        now = written(assigned(rows, centroids) if left else assigned(rows, centroids).drop("x"), "assigned")
        forget(before)
        rows = before = now
        if left:
            centroids = moved(rows, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # one row a centroid
    facts = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The same in DuckDB's SQL, by comparing each vector with each centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""met{r} as (
  select row, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance from kept v, centroids{r} c),
nearest{r} as materialized (select row, cluster, distance from met{r} qualify row_number() over (partition by row order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""sums{r} as (
  select cluster, i, sum(x[i])::bigint as s, count(*)::bigint as n from nearest{r} join kept using (row), range(1, {dims + 1}) of(i) group by cluster, i),
means{r} as (select cluster, list(((s - (s % n + n) % n) // n)::bigint order by i) as x from sums{r} group by cluster),
centroids{r + 1} as materialized (select cluster, coalesce(m.x, c.x) as x from centroids{r} c left join means{r} m using (cluster))""")
    return f"""
with numbered as (select vec_id, row_number() over () as row, embedding::double[] as v from embeddings),
kept as materialized (
  select vec_id, row, list_transform(v, lambda c: floor({SCALE} * c)::bigint) as x from numbered
  where len(v) = {dims} and len(list_filter(v, lambda c: c is not null and isfinite(c) and abs({SCALE} * c) < {MOST})) = {dims}),
centroids0 as materialized (
  select (row_number() over (order by sha, x) - 1)::int as cluster, x from (select sha256('1:' || vec_id::varchar) as sha, x from kept where vec_id is not null order by sha, x limit {k})),
{", ".join(steps)}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from nearest{rounds} join kept using (row) join centroids{rounds} c using (cluster)"""
