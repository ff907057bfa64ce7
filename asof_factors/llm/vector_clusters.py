"""Centroid clustering over a VA-file.

Vectors of integers are compressed to a few bits per dimension: the number of
the cell, among equally wide ones between the dimension's smallest and largest
value.  For a centroid, lookup tables give the least and greatest squared
distance that each cell of each dimension can add; their sums are an interval
around the vector's distance.  A centroid whose interval begins beyond the
smallest end of any other's cannot be the nearest.  For those left the
interval of the difference to the likeliest one's distance is narrower, as
both vary alike over a cell.  Where one centroid is left the vector is
assigned from its cells alone; full vectors are fetched by a join only where
intervals overlap, and where a vector changes its cluster, to move it between
the clusters' sums.  So all rounds are exact.

Clusters' sums are aggregated in the tasks; the driver sees a row for each
cluster and task, and holds the centroids only.

Defined results: vectors of another size, or with a component that is null or
not finite, are left out; components beyond 2^26 in size after scaling count as
that.  Null ids stand last in the order of starting vectors; rows that repeat
are vectors of their own.  With fewer vectors than clusters each starts one.
Ties go to the smaller number, empty clusters keep their centroid.  An
empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Bits of a cell's number.
BITS = 6
#: Components are bounded by this, so that squared distances fit a long.
BOUND = 1 << 26
#: Rows that a join sends to all executors, at most.
BROADCAST_ROWS = 1_000_000


class Cells:
    """The cells of each dimension between its smallest and largest value."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.low, self.span, self.bits = low, high - low + 1, bits
        steps = np.arange((1 << bits) + 1)[:, None]
        ends = -(-steps * self.span >> bits) + low  # cells by dimensions
        self.least, self.most = ends[:-1], ends[1:] - 1

    def pack(self, vectors: np.ndarray) -> list[bytes]:
        cells = ((vectors - self.low) << self.bits) // self.span
        bits = cells[:, :, None] >> np.arange(self.bits - 1, -1, -1) & 1
        packed = np.packbits(bits.reshape(len(vectors), -1).astype(np.uint8), axis=1)
        return [x.tobytes() for x in packed]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(raw, axis=1)[:, : len(self.low) * self.bits].reshape(len(packed), len(self.low), self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference: dimension, cell, centroid."""
        below = self.least.T[:, :, None] - centroids.T[:, None, :]
        above = centroids.T[:, None, :] - self.most.T[:, :, None]
        least = np.maximum(0, np.maximum(below, above)) ** 2
        return least, np.maximum(below**2, above**2)


def candidates(cells: Cells, numbers: np.ndarray, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Vectors by centroids: whether a centroid can be the nearest."""
    n, dimensions = numbers.shape
    low = np.zeros((n, len(centroids)), dtype=np.int64)
    high = np.zeros_like(low)
    for d in range(dimensions):
        low += tables[0][d][numbers[:, d]]
        high += tables[1][d][numbers[:, d]]
    likely, every = high.argmin(axis=1), np.arange(dimensions)
    possible = low <= high.min(axis=1, keepdims=True)
    possible[np.arange(n), likely] = False
    squares = (centroids**2).sum(axis=1)
    row, c = np.nonzero(possible)
    for at in range(0, len(row), 65_536):
        r, k = row[at : at + 65_536], c[at : at + 65_536]
        other = centroids[likely[r]] - centroids[k]
        least = np.where(other > 0, cells.least[numbers[r], every], cells.most[numbers[r], every])
        possible[r, k] = 2 * (least * other).sum(axis=1) + squares[k] - squares[likely[r]] <= 0
    possible[np.arange(n), likely] = True
    return possible


def nearest(vectors: np.ndarray, possible: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest of each vector's possible centroids, the first among equals."""
    row, c = np.nonzero(possible)
    distance = np.full(possible.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), 65_536):
        r, k = row[at : at + 65_536], c[at : at + 65_536]
        distance[r, k] = ((vectors[r] - centroids[k]) ** 2).sum(axis=1)
    return distance.argmin(axis=1)


def blank(n: int) -> np.ndarray:
    """Nulls of any kind."""
    return np.full(n, None, dtype=object)


class Sums:
    """Counts and sums of the vectors that enter and leave clusters."""

    def __init__(self, k: int, dimensions: int):
        self.n, self.total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)

    def add(self, clusters: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.n, clusters, sign)
        np.add.at(self.total, clusters, sign * vectors)

    def rows(self, *nulls: str) -> pd.DataFrame:
        k = np.flatnonzero((self.n != 0) | (self.total != 0).any(axis=1))
        total = blank(len(k))
        total[:] = list(self.total[k])
        return pd.DataFrame({**{c: blank(len(k)) for c in nulls}, "cluster": k.astype(np.int32), "n": self.n[k], "total": total})


def stacked(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, dimensions), dtype=np.int64)


def finite_vectors(given: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and vec (integers) of the vectors that are kept."""

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(F.greatest(F.lit(-2.0 * BOUND), F.least(F.lit(2.0 * BOUND), x.cast("double") * scale))).cast("double"))).cast("int")

    v = F.col("v")
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return given.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(fine).select("vec_id", F.transform(v, whole).alias("vec"))


def moved(df: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all tasks' rows of sums."""
    sums = df.filter(F.col("n").isNotNull()).select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
    for r in sums:
        total[r.cluster, r["at"]], n[r.cluster] = r.x, r.n
    return n, total


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def cluster_vectors(given: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS, broadcast: int = BROADCAST_ROWS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each vector, and the final
    centroids."""
    vectors = saved(finite_vectors(given, id_col, vector_col, dimensions, scale).withColumn("row", F.monotonically_increasing_id()))
    order = (F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("vec"))
    first = vectors.orderBy(*order).limit(clusters).collect()
    centroids = np.array([r.vec for r in first], dtype=np.int64).reshape(len(first), dimensions)
    k = len(centroids)
    if k == 0:
        return vectors.selectExpr("vec_id", "CAST(row AS int) AS cluster", "row AS distance"), centroids
    ends = vectors.agg(*[f(F.get("vec", F.lit(i))) for f in (F.min, F.max) for i in range(dimensions)]).first()
    cells = Cells(np.array(ends[:dimensions], dtype=np.int64), np.array(ends[dimensions:], dtype=np.int64), bits)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells and first cluster of each vector, and the clusters' sums."""
        sums, bounds = Sums(k, dimensions), cells.tables(centroids)
        for b in batches:
            vec = stacked(b["vec"], dimensions)
            packed = cells.pack(vec)
            now = nearest(vec, candidates(cells, cells.unpack(packed), bounds, centroids), centroids)
            sums.add(now, vec)
            yield pd.DataFrame({"row": b["row"], "cells": packed, "cluster": now.astype(np.int32), "n": blank(len(b)), "total": blank(len(b))})
        yield sums.rows("row", "cells")

    schema = "row bigint, cells binary, cluster int, n bigint, total array<bigint>"
    found = saved(vectors.select("row", "vec").mapInPandas(begin, schema))
    n, total = moved(found, k, dimensions)
    state = found.filter("n IS NULL").select("row", "cells", "cluster")
    for _ in range(rounds):
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
        state, (dn, dtotal) = assign(vectors, state, cells, centroids, broadcast)
        n, total = n + dn, total + dtotal

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = centroids[b["cluster"].to_numpy()]
            yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": b["cluster"], "distance": ((stacked(b["vec"], dimensions) - own) ** 2).sum(axis=1)})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.join(state.select("row", "cluster"), "row").select("vec_id", "vec", "cluster").mapInPandas(distances, f"vec_id {kind}, cluster int, distance bigint"), centroids


def assign(vectors: DataFrame, state: DataFrame, cells: Cells, centroids: np.ndarray, broadcast: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The state (row, cells, cluster) after one more assignment, and how the
    clusters' counts and sums change."""
    k, dimensions = centroids.shape

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = cells.tables(centroids)
        for b in batches:
            possible = candidates(cells, cells.unpack(b["cells"].to_list()), bounds, centroids)
            yield b.assign(near=[np.flatnonzero(x).astype(np.int32) for x in possible])

    judged = saved(state.mapInPandas(judge, "row bigint, cells binary, cluster int, near array<int>"))
    need = judged.filter((F.size("near") > 1) | (F.get("near", F.lit(0)) != F.col("cluster"))).select("row", "cluster", "near")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums(k, dimensions)
        for b in batches:
            vec, before = stacked(b["vec"], dimensions), b["cluster"].to_numpy()
            possible = np.zeros((len(b), k), dtype=bool)
            possible[np.repeat(np.arange(len(b)), b["near"].map(len)), np.concatenate([*b["near"], np.zeros(0, dtype=np.int32)])] = True
            now = nearest(vec, possible, centroids)
            other = now != before
            sums.add(now[other], vec[other])
            sums.add(before[other], vec[other], -1)
            moving = int(other.sum())
            yield pd.DataFrame({"row": b["row"].to_numpy()[other], "cluster": now[other].astype(np.int32), "n": blank(moving), "total": blank(moving)})
        yield sums.rows("row")

    fetched = vectors.select("row", "vec").join(small(need, broadcast), "row")
    settled = saved(fetched.mapInPandas(settle, "row bigint, cluster int, n bigint, total array<bigint>"))
    changed = small(settled.filter("n IS NULL").select("row", F.col("cluster").alias("now")), broadcast)
    state = judged.join(changed, "row", "left").select("row", "cells", F.coalesce("now", "cluster").alias("cluster"))
    return state, moved(settled, k, dimensions)


def with_digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Inertia of the clusters and of all, and each centroid's hash."""
    session = found.sparkSession
    hashes = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    found = saved(found)
    within = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    known = within.join(F.broadcast(session.createDataFrame(hashes, "cluster int, centroid_sha256 string")), "cluster")
    known = known.crossJoin(F.broadcast(within.agg(F.sum("s").alias("all"))))  # one row
    known = known.select("cluster", F.col("s").try_cast("bigint").alias("cluster_inertia"), F.col("all").try_cast("bigint").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(*cluster_vectors(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The same rounds over rows of a vector and a dimension."""
    floor = "(total - ((total % n) + n) % n) // n"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings"
        f" WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"parts AS MATERIALIZED (SELECT r, unnest(vec) AS x, unnest(range({DIMENSIONS})) AS d FROM kept)",
        f"firsts AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN parts USING (r))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"d{k} AS (SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM parts p JOIN c{k} c USING (d) GROUP BY ALL)")
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{k} GROUP BY r)")
        if k < ROUNDS:
            parts.append(f"s{k} AS (SELECT c, d, sum(x)::BIGINT AS total, count(*) AS n FROM a{k} JOIN parts USING (r) GROUP BY ALL)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce({floor}, o.x)::BIGINT AS x FROM c{k} o LEFT JOIN s{k} s ON o.c = s.c AND o.d = s.d)")
    parts.append(f"hashes AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    parts.append(f"inner_sums AS (SELECT c, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{ROUNDS}) AS inertia, centroid_sha256"
        f"\nFROM a{ROUNDS} JOIN kept USING (r) JOIN hashes USING (c) JOIN inner_sums USING (c)"
    )


SQL = _sql()
