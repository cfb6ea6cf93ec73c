"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct integer vectors with multiplicities.

Each vector of DIM finite components becomes floor(SCALE * x); components beyond +-LIMIT count as +-LIMIT, so that every
distance and partial sum is exact in 64 bits.  Equal vectors are one row with their number: a copied vector costs one distance
a round, however often it stands there.  A round assigns the distinct vectors in blocks (numpy), sums components and
multiplicities per task and centroid, and sends K * DIM exact sums per task; their total, K * DIM numbers, is all that reaches
the driver.  At the end assignments are joined back to the ids: the vectors of at least 1 / HOT of all rows (HOT at most) by
broadcast, so that no copied vector is a hot key, the others by a join on the vector.

Rows with a null vector, another length, or a null, NaN or infinite component are left out.  A null id counts as an empty one
when centroids are drawn; rows that repeat an id are drawn and assigned as often as they occur, ties in the draw going by the
vector.  With fewer than K kept vectors there are as many centroids as vectors; without any there are no rows.  Ties in distance: the
smaller number.  An empty cluster keeps its centroid.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, prepare

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
LIMIT = 1 << 27  # DIM * (2 * LIMIT)^2 = 2^62
HOT = 512
BLOCK = 8192
WIDTHS = {1: np.int8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)


def packed(v: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it; equal rows give equal bytes."""
    most = np.maximum(v.max(1), -1 - v.min(1)) if v.shape[1] else np.zeros(len(v), np.int64)
    out: list[bytes] = [b""] * len(v)
    for width, low in ((1, -1), (2, 1 << 7), (4, 1 << 15)):
        at = np.flatnonzero((most >= low) & (most < (1 << 8 * width - 1)))
        data, step = v[at].astype(WIDTHS[width]).tobytes(), width * v.shape[1]
        for j, i in enumerate(at):
            out[i] = data[j * step : (j + 1) * step]
    return out


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out, sizes = np.empty((len(rows), dim), np.int64), np.fromiter(map(len, rows), np.int64, len(rows))
    for width, kind in WIDTHS.items():
        at = np.flatnonzero(sizes == width * dim)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and the squared distance, both exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= 1 << 20:  # every term and sum is an integer below 2^53
        a, c = v.astype(float), centroids.astype(float)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
        at = d.argmin(1)
        return at, d[np.arange(len(v)), at].astype(np.int64)
    d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


def _blocks(batch: pa.RecordBatch, dim: int):
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        yield part, unpacked(part.column("q").to_pylist(), dim)


def vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the packed integer vector, of the rows that are kept."""

    def run(batches):
        for batch in batches:
            lists = batch.column("x").combine_chunks() if isinstance(batch.column("x"), pa.ChunkedArray) else batch.column("x")
            flat = np.asarray(lists.flatten().fill_null(np.nan), np.float64).reshape(-1, dim)
            good = np.isfinite(flat).all(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(packed(quantised(flat[good], scale)), pa.binary())], ["vec_id", "q"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    sized = rows.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return sized.mapInArrow(run, f"vec_id {kind}, q binary")


def drawn(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """The first centroids: the k rows whose `1:<vec_id>` has the smallest SHA-256."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return unpacked([bytes(r.q) for r in rows.select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()], dim)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """q, n, cluster, distance of distinct vectors."""

    def run(batches):
        for batch in batches:
            for part, v in _blocks(batch, centroids.shape[1]):
                at, d = nearest(v, centroids)
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("n"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "q binary, n long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round of Lloyd."""
    k, dim = centroids.shape

    def run(batches):
        sums, counts = [[0] * dim for _ in range(k)], [0] * k
        for batch in batches:
            for part, v in _blocks(batch, dim):
                n, (at, _) = np.asarray(part.column("n")), nearest(v, centroids)
                for c in np.unique(at):
                    own, times = v[at == c], n[at == c]
                    # a block's sums stay below 2^63 up to 2^23 copies of a vector; beyond, by Python's integers
                    exact = (own * times[:, None]).sum(0).tolist() if times.max() < 1 << 23 else [sum(a * b for a, b in zip(col, times.tolist(), strict=True)) for col in own.T.tolist()]
                    sums[c] = [a + b for a, b in zip(sums[c], exact, strict=True)]
                    counts[c] += int(times.sum())
        from decimal import Decimal

        rows = [(c, j, Decimal(sums[c][j]), counts[c]) for c in range(k) if counts[c] for j in range(dim)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.decimal128(28, 0), pa.int64()), strict=True)], ["cluster", "component", "total", "n"])

    found = distinct.select("q", "n").mapInArrow(run, "cluster int, component int, total decimal(28, 0), n long").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the kept rows (vec_id, embedding)."""
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    table = scratch.table(vectors(rows, dim, scale), "vectors")
    distinct = scratch.table(table.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    centroids = drawn(table, k, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    done = scratch.table(assigned(distinct, centroids), "assigned") if len(centroids) else spark.createDataFrame([], "q binary, n long, cluster int, distance long")
    cost = {r.cluster: (int(r.cost), r.n) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20, 0)") * F.col("n")).alias("cost"), F.sum("n").alias("n")).collect()}
    top = (1 << 63) - 1  # a sum that no long holds is given as the largest long
    total = min(top, sum(c for c, _ in cost.values()))
    facts = spark.createDataFrame([(c, min(top, cost[c][0]), digest(centroids[c])) for c in cost], "cluster int, cluster_inertia long, centroid_sha256 string")
    least = max(2, -(-sum(n for _, n in cost.values()) // HOT))
    hot = done.where(F.col("n") >= least).select("q", F.col("cluster").alias("c"), F.col("distance").alias("d"))  # HOT rows at most
    once = table.join(F.broadcast(hot), "q", "left")
    far = once.where("c IS NULL").drop("c", "d").join(done.where(F.col("n") < least).select("q", "cluster", "distance"), "q")
    out = once.where("c IS NOT NULL").select("vec_id", F.col("c").alias("cluster"), F.col("d").alias("distance")).unionAll(far.select("vec_id", "cluster", "distance"))
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
