"""Embedding whitening: sums of centred products for every pair of dimensions as generated columns of one aggregation, the covariance decomposed with LAPACK.

Vectors of one length are a list of their own. Of each, only n, the sums S and the covariance (d * d doubles, whatever the number of rows) come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import forget, modest_batches, written

#: Entries become floor(SCALE * c) + SHIFT; from LIMIT on they would leave a long's room for n * x.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**21
#: Vectors of at most WHOLE dimensions have one column a pair of dimensions; longer ones one a pair of places in tiles of TILE.
WHOLE, TILE = 64, 32


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, d, x (array<long>) of each row whose vector has entries and no null, non-finite or enormous (LIMIT and beyond) ones."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)) & ~F.isnan(c))  # NaN is the largest double
    return v.where(fit & (F.size("v") > 0)).select("vec_id", F.size("v").alias("d"), F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def sums(rows: DataFrame, column: str, width: int) -> DataFrame:
    """d, n and the sums of an array column by dimension (s), of each length d up to width."""
    by = rows.groupBy("d").agg(F.count("*").alias("n"), *(F.sum(F.get(column, F.lit(i))).alias(f"s{i}") for i in range(width)))
    return by.select("d", "n", F.slice(F.array(*(f"s{i}" for i in range(width))), F.lit(1), F.col("d")).alias("s"))


def tile_pairs(width: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """The edge of tiles, the pairs of tiles of the upper triangle, and the pairs of places of which a tile has sums."""
    edge = width if width <= WHOLE else TILE
    count = -(-width // edge)
    tiles = [(a, b) for a in range(count) for b in range(a, count)]
    return edge, tiles, [(p, q) for p in range(edge) for q in range(p if count == 1 else 0, edge)]


def covariances(centred: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The covariance of y of each length d, from rows (d, y: centred doubles): one aggregation whose columns are generated, one a pair of dimensions.

    Long vectors are cut into tiles first; a tile of a row meets the sums of its task before anything is shuffled.
    """
    edge, tiles, places = tile_pairs(width)
    if len(tiles) == 1:
        cut = centred.select("d", F.lit(0).alias("t"), F.col("y").alias("a"), F.col("y").alias("b"))
    else:
        part = lambda t: F.slice("y", F.lit(t * edge + 1), F.lit(edge))
        each = F.array(*(F.struct(F.lit(i).alias("t"), part(a).alias("a"), part(b).alias("b")) for i, (a, b) in enumerate(tiles)))
        cut = centred.select("d", F.explode(each).alias("of")).select("d", "of.t", "of.a", "of.b").where("size(a) > 0 and size(b) > 0")
    at = cut.select("d", "t", *(F.get("a", F.lit(p)).alias(f"a{p}") for p in range(edge)), *(F.get("b", F.lit(p)).alias(f"b{p}") for p in range(edge)))
    products = [F.expr(f"sum(a{p} * b{q}) as p{p}_{q}") for p, q in places]
    out: dict[int, np.ndarray] = {}
    for r in at.groupBy("d", "t").agg(F.count("*").alias("n"), *products).collect():
        d, (a, b) = r["d"], tiles[r["t"]]
        v = out.setdefault(d, np.zeros((d, d)))
        for (p, q), total in zip(places, r[3:]):
            i, j = a * edge + p, b * edge + q
            if i < d and j < d and total is not None:
                v[i, j] = v[j, i] = total / r["n"]
    return out


def directions(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue, the first `most`. An eigenvalue that is no more than rounding is 0."""
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    e = np.where(e > len(e) * np.finfo(float).eps * max(e[0], 0.0), e, 0.0)
    return e[:most], w[:, :most]


def squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of longs; None where a sum is no long."""
    top = float(np.abs(y).max(initial=0))
    if top * top * y.shape[1] < 2.0**62:
        return (y * y).sum(1).tolist()
    exact = (sum(c * c for c in row) for row in y.tolist())
    return [s if s < 1 << 63 else None for s in exact]


def whitened_rows(rows: DataFrame, bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id, d, n, deviation, y (array<double>, null without variance) of rows (vec_id, d, n, off = n * x - S)."""

    def run(batches):
        for batch in batches:
            ids, n, dim = batch.column("vec_id"), batch.column("n").to_numpy(), batch.column("d").to_numpy()
            flat, ends = batch.column("off").flatten().to_numpy(), np.cumsum(dim)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                y = flat[(ends[at] - d)[:, None] + np.arange(d)]
                e, w = bases[int(d)]
                real = e > 0
                z = (y / n[at][:, None]) @ w[:, real] / np.sqrt(e[real])
                white = np.zeros((len(at), len(e)))
                white[:, real] = z
                gone = np.tile(~real, len(at))
                values = pa.array(white.ravel(), mask=gone)
                lists = pa.ListArray.from_arrays(np.arange(0, len(gone) + 1, len(e), dtype=np.int32), values)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(dim[at]), pa.array(n[at]), pa.array(squares(y), pa.int64()), lists], ["vec_id", "d", "n", "deviation", "y"]
                )

    return rows.select("vec_id", "d", "n", "off").mapInArrow(run, "vec_id long, d int, n long, deviation long, y array<double>")


def whitened(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of vectors (vec_id, embedding) and each of its first `most` components.

    Rows go whose vector is null, empty, or holds a null, a non-finite entry or one of 2**21 and beyond (no room is left for exact sums). Vectors of each length are a
    fit list of their own: n, sums, covariance, components and identity_error are those of it. Rows that share a vec_id stay separate rows, a null vec_id stays null, equal vectors have
    equal results. A component without variance (constant dimensions, fewer rows than dimensions) has no whitened value (null) and doesn't count in identity_error, which is null
    where no component has any; explained is null where no dimension has any. deviation is null where it exceeds a long. Components of equal eigenvalues are any basis of theirs. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(integers(vectors), "integers")
    width = rows.agg(F.max("d")).first()[0] or 1
    stats = F.broadcast(written(sums(rows, "x", width), "sums"))  # one row a length
    off = rows.join(stats, "d").select("vec_id", "d", "n", F.zip_with("x", "s", lambda x, s: x * F.col("n") - s).alias("off"))
    bases, explained = {}, {}
    for d, v in covariances(off.select("d", F.transform("off", lambda c: c / F.col("n")).alias("y")), width).items():
        bases[d] = directions(v, most)
        explained[d] = [float(e / np.trace(v)) if np.trace(v) > 0 else None for e in bases[d][0]]
    white = written(whitened_rows(off, bases), "whitened")
    forget(rows)
    wide = min(most, width)
    error = {}
    means = F.broadcast(sums(white, "y", wide))
    centre = white.select("d", "y").join(means, "d")
    for d, c in covariances(centre.select("d", F.zip_with("y", F.slice("s", F.lit(1), F.size("y")), lambda y, s: y - s / F.col("n")).alias("y")), wide).items():
        real = bases[d][0] > 0
        side = min(d, wide)
        gap = np.abs(c[:side, :side] - np.eye(side))[np.ix_(real, real)]
        error[d] = float(gap.max()) if gap.size else None
    facts = spark.createDataFrame([(d, explained[d], error[d]) for d in bases], "d int, explained array<double>, identity_error double")
    each = white.join(F.broadcast(facts), "d").select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("y").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
