"""Centroid clustering: plain Lloyd rounds over integer vectors.

Vectors become integers floor(scale * x). Each round broadcasts the centroids, tasks compute
whole-number squared differences to every centroid in NumPy and take the lowest index of
the smallest, and hand on sums and counts of their own part for each cluster; these merge
through a groupBy. Only the k centroids ever reach the driver. Every round reads the vectors
anew from their table, so nothing is cached and a lost executor costs its tasks only.

Numbers are exact. Components of 2**26 at most take 64-bit arithmetic; a batch that holds
a larger one is worked out in Python's integers, and sums of such vectors travel in limbs of
24 bits. A distance or inertia beyond a long is returned as the largest long.

Defined results: a vector that is null, has another number of components, or a null or
non-finite one is left out; a null vec_id hashes as the empty text, and its row stays;
repeated rows each give a row, and may start as two equal centroids, of which the lower one
gets the vectors; fewer vectors than k give fewer centroids; no vectors give no rows;
further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Differences of components of this size, squared and summed over 1,024 components, fit in 64 bits.
SMALL = 1 << 26
LIMB = 24
LONGEST = (1 << 63) - 1


def whole(vectors: pd.Series, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are finite, their integers): int64, or Python's integers if one is beyond SMALL."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    fine = np.isfinite(x).all(axis=1)
    x = x[fine]
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if scaled.size and np.abs(scaled).max() > SMALL:
        wide = [[int(s) if np.isfinite(s) else int(v) * scale for v, s in zip(*row, strict=True)] for row in zip(x, scaled, strict=True)]
        return fine, np.array(wide, dtype=object).reshape(x.shape)
    return fine, scaled.astype(np.int64)


def limbs(sums: list[int]) -> Iterator[list[int]]:
    """Whole numbers as digits to the base 2**LIMB, lowest first; the last one has the sign."""
    while any(abs(s) >> LIMB for s in sums):
        yield [s & ((1 << LIMB) - 1) for s in sums]
        sums = [s >> LIMB for s in sums]
    yield sums


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centroid, squared distance) of each row of x; ties go to the lower index."""
    found = np.empty((len(centroids), len(x)), dtype=np.result_type(x, centroids))
    for i, c in enumerate(centroids):
        gap = x - c
        found[i] = (gap * gap).sum(axis=1)
    cluster = found.argmin(axis=0)
    return cluster, found[cluster, np.arange(len(x))]


def _table(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > SMALL for row in centroids for v in row)
    return np.array(centroids, dtype=object if wide else np.int64)


def _candidates(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows of the right length; values are looked at inside tasks."""
    return vectors.where(F.size(F.col(vector_col)) == dim).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def seeds(rows: DataFrame, clusters: int, scale: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash lowest; equal ones are ordered by their components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[whole(batch["v"], scale)[0]]

    h: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(h.alias("h"), "v").mapInPandas(run, "h string, v array<double>").orderBy("h", "v").limit(clusters).collect()
    return [[int(c) for c in row] for row in whole(pd.Series([np.array(r["v"]) for r in found]), scale)[1]] if found else []


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: how many, and their componentwise sum."""
    shared = rows.sparkSession.sparkContext.broadcast(_table(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            _, x = whole(batch["v"], scale)
            cluster, _ = nearest(x, table)
            for c in np.unique(cluster):
                own = x[cluster == c]
                sums = own.sum(axis=0)
                for limb, part in enumerate(limbs(sums.tolist()) if x.dtype == object else [sums]):
                    held = totals.setdefault((int(c), limb), np.zeros(dim + 1, np.int64))
                    held += np.append(np.asarray(part, np.int64), len(own) if limb == 0 else 0)
        if totals:
            yield pd.DataFrame({"cluster": [k[0] for k in totals], "limb": [k[1] for k in totals], "s": list(totals.values())})

    parts = rows.select("v").mapInPandas(run, "cluster int, limb int, s array<long>")
    merged = parts.groupBy("cluster", "limb").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim + 1)))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in merged.collect():  # a row for each cluster and limb
        n, sums = found.get(r[0], (0, [0] * dim))
        found[r[0]] = (n + r[2 + dim], [a + (b << (LIMB * r[1])) for a, b in zip(sums, r[2 : 2 + dim], strict=True)])
    return found


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each vector, the centroids they refer to)."""
    rows = _candidates(vectors, dim, id_col, vector_col)
    centroids = seeds(rows, clusters, scale, seed)
    for _ in range(rounds if centroids else 0):
        for i, (n, sums) in _sums(rows, centroids, dim, scale).items():
            centroids[i] = [s // n for s in sums]
    shared = rows.sparkSession.sparkContext.broadcast(_table(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(shared.value):
                fine, x = whole(batch["v"], scale)
                found, distance = nearest(x, shared.value)
                if distance.dtype == object:
                    distance = np.array([min(int(d), LONGEST) for d in distance], np.int64)
                yield pd.DataFrame({"vec_id": batch["vec_id"][fine], "cluster": found.astype(np.int32), "distance": distance})

    kind = dict(rows.dtypes)["vec_id"]
    # Ids go through pandas as text: a column of longs with nulls would lose digits there.
    made = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(run, "vec_id string, cluster int, distance long")
    return made.select(F.col("vec_id").cast(kind).alias("vec_id"), "cluster", "distance"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    found, centroids = cluster(vectors, **settings)
    found = materialise(found, "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r[0]: min(int(r[1]), LONGEST) for r in found.groupBy("cluster").agg(exact).collect()}  # a row for each centroid
    whole_inertia = min(int(found.agg(exact).first()[0] or 0), LONGEST)
    table = found.sparkSession.createDataFrame([(i, per[i], whole_inertia, digest(c)) for i, c in enumerate(centroids) if i in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The rounds unrolled; exact as long as all sums fit in 128 bits."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""v AS MATERIALIZED (SELECT row, vec_id, unnest(range({dim})) AS i, unnest([floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding]) AS x FROM e)""",
        f"""s AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c FROM e QUALIFY c < {clusters})""",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (row))",
    ]
    assign = "a{0} AS MATERIALIZED (SELECT row, c, d FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{0} k USING (i) GROUP BY v.row, k.c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"
    for r in range(rounds):
        steps.append(assign.format(r))
        steps.append(f"m{r} AS (SELECT c, i, sum(x) AS t, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (row) GROUP BY c, i)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, k.i, CASE WHEN n IS NULL THEN k.x ELSE ((t - ((t % n + n) % n)) // n)::BIGINT END AS x FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c AND m.i = k.i)")
    steps.append(assign.format(rounds))
    steps.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN e USING (row) JOIN h USING (c)"
