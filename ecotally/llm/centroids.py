"""Centroid clustering by progressive search on Walsh-Hadamard coefficients (operator 12).

A vector of 64 components is turned into integers and transformed once; the
transform is exact, and 64 times a squared distance is the squared distance of
the coefficients.  To find the nearest centroid, coefficient differences are added
up from the coarsest (fewest sign changes) to the finest, in steps of ``STEPS``.
What is added up so far, and the difference of the lengths that are left, give a
lower bound of each distance.  The centroid in front after a step is measured in
full; one whose lower bound lies above the least distance so measured is strictly
worse and goes.  Those left finish all 64 coefficients, and the smaller number wins
a tie.  Bounds only spare work.

Only sums per centroid reach the driver (64 numbers each), so a round is one pass
over the written coefficients, whatever the sizes of the clusters.  Sums are taken
of the coefficients, and transformed back exactly.

Defined results: vectors that are null, of another length, or with null or
non-finite components are left out; repeated rows are vectors of their own; vectors
whose start hashes are equal start in the order of their coefficients, a null vec_id
after all others; with fewer vectors than centroids every vector starts one; a
table without usable vectors gives no rows.  Integers are exact up to distances
that a long can hold, and beyond that an error is raised.  Other columns of any
name stay out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DIM = 64
CENTROIDS = 16
ROUNDS = 3
#: A component x becomes floor(SCALE * x).
SCALE = 64.0
#: Coefficients added up before each elimination.
STEPS = (1, 2, 4, 8, 16, 32, 64)
#: Vectors searched at a time.
ROWS = 2048
#: Sums of squares of differences of coefficients up to this size fit 64 bits.
_SAFE = 2**27


def _hadamard() -> np.ndarray:
    """The 64 x 64 Walsh-Hadamard matrix, rows from no sign change to 63."""
    h = np.ones((1, 1), np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1))]


H = _hadamard()


def integers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers or, where one is too large, Python's."""
    scaled = np.floor(SCALE * v)
    if not len(v) or np.abs(scaled).max() < _SAFE // DIM:
        return scaled.astype(np.int64)
    return np.array([[int(np.floor(x)) if np.isfinite(x) else int(y) * int(SCALE) for x, y in zip(a, b)] for a, b in zip(scaled, v)], object)


def transform(ints: np.ndarray) -> np.ndarray:
    """Coefficients, coarsest first."""
    return ints @ (H.T if ints.dtype != object else H.T.astype(object))


def restored(coefficients: list[int]) -> list[int]:
    """The integers of a row of coefficients, or of a sum of such rows."""
    return [sum(int(H[k, i]) * coefficients[k] for k in range(DIM)) // DIM for i in range(DIM)]


def _least_left(rest_x: np.ndarray, rest_c: np.ndarray) -> np.ndarray:
    """At most the squared distance of what is left: two vectors are as far apart as
    their lengths differ, or farther."""
    apart = np.sqrt(rest_x.astype(np.float64)) - np.sqrt(rest_c.astype(np.float64))
    return np.maximum(apart * apart * (1 - 1e-6) - 1, 0) if len(apart) else apart


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of coefficients ``x`` the number of the nearest row of ``c`` and the
    squared distance of the vectors; and how many coefficient differences it took."""
    if x.dtype == object or c.dtype == object or max(np.abs(x).max(), np.abs(c).max()) >= _SAFE:
        x, c = x.astype(object), c.astype(object)
    i, j = (a.ravel() for a in np.indices((len(x), len(c))))
    sums = np.zeros(len(i), x.dtype)
    rest_x, rest_c = (x * x).sum(1), (c * c).sum(1)
    leader, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)  # centroids whose distance is known, and the least one
    done = work = 0
    for upto in STEPS:
        part = slice(done, upto)
        diff = x[i, part] - c[j, part]
        sums = sums + (diff * diff).sum(1)
        work += diff.size
        done = upto
        if upto == DIM:
            break
        rest_x, rest_c = rest_x - (x[:, part] ** 2).sum(1), rest_c - (c[:, part] ** 2).sum(1)
        least = sums.astype(np.float64) + _least_left(rest_x[i], rest_c[j])
        # the centroid in front is measured in full; what is surely farther goes
        first = _first(i, least, j)
        front, new = j[first], j[first] != leader
        diff = x[new] - c[front[new]]
        full = (diff * diff).sum(1)
        work += diff.size
        best[new] = np.where((leader[new] < 0) | (full < best[new]), full, best[new])
        leader = front
        left = (sums <= best[i]).astype(bool) & (least * (1 - 1e-6) - 1 <= best[i].astype(np.float64))
        i, j, sums = i[left], j[left], sums[left]
    first = _first(i, sums, j)
    return j[first], sums[first] // DIM, work


def _first(i: np.ndarray, value: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each i where the least value stands, of equal ones that with the smallest j."""
    if value.dtype == object:
        order = np.array(sorted(range(len(i)), key=lambda r: (i[r], value[r], j[r])), np.int64)
    else:
        order = np.lexsort((j, value, i))
    return order[np.r_[True, np.diff(i[order]) != 0]] if len(order) else order


def coefficients(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows: their coefficients, coarsest first."""
    v = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        (F.size("v") == DIM) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )

    def transformed(batches):
        for b in batches:
            x = transform(integers(b.column("v").values.to_numpy(zero_copy_only=False)[_span(b.column("v"))].reshape(-1, DIM)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(x)], names=["vec_id", "x"])

    return usable.mapInArrow(transformed, "vec_id long, x array<long>")


def _span(lists: pa.ListArray) -> slice:
    return slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py())


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * DIM, pa.array(x.ravel().tolist() if x.dtype == object else x.ravel(), pa.int64()))


def _parts(batches, c: np.ndarray):
    """(rows, coefficients, nearest, distance) piece by piece."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            x = part.column("x").values.to_numpy()[_span(part.column("x"))].reshape(-1, DIM)
            yield part, x, *nearest(x, c)[:2]


def started(x: DataFrame, n: int = CENTROIDS) -> list[list[int]]:
    """The coefficients of the ``n`` vectors with the smallest hash of ``1:<vec_id>``."""
    hashed = x.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return [list(r["x"]) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "x").limit(n).collect()]


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < 2**62 for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(-1, DIM)


def moved(x: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids (as integers) after one round: every vector goes to the nearest
    one, and those with vectors become the floor of their vectors' mean."""
    c = transform(_array(centroids))

    def sums(batches):
        total, rows = {}, {}
        for _, part, at, _ in _parts(batches, c):
            for k in np.unique(at).tolist():
                mine = part[at == k]
                # Python's integers: no sum wraps
                now = mine.sum(0) if np.abs(mine).max() < 2**50 else mine.astype(object).sum(0)
                total[k] = [a + b for a, b in zip(total.get(k, [0] * DIM), now.tolist())]
                rows[k] = rows.get(k, 0) + len(mine)
        out = [(k, i, str(s), rows[k]) for k, t in total.items() for i, s in enumerate(t)]
        if out:
            k, i, s, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(s), pa.array(n, pa.int64())], names=["k", "i", "s", "n"])

    found = x.mapInArrow(sums, "k int, i int, s string, n long").groupBy("k", "i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    )
    centroids = [list(r) for r in centroids]
    total, rows = {}, {}
    for r in found.collect():  # DIM rows a centroid
        total.setdefault(r["k"], [0] * DIM)[r["i"]] = int(r["s"])
        rows[r["k"]] = r["n"]
    for k, t in total.items():
        centroids[k] = [s // rows[k] for s in restored(t)]
    return centroids


def clustered(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable row of ``vectors``, written, and the
    final centroids (integers) by number."""
    x = written(coefficients(vectors), "coefficients")
    centroids = [restored(r) for r in started(x, n)]
    if not centroids:
        return x.selectExpr("vec_id", "0 as cluster", "0L as distance"), []
    for _ in range(rounds):
        centroids = moved(x, centroids)
    c = transform(_array(centroids))

    def assigned(batches):
        for part, _, at, distance in _parts(batches, c):
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(at, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return written(x.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    every = [
        (k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids)
    ]
    facts = spark.createDataFrame(every, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(  # a row a centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round(k: int) -> str:
    return f"""
near{k} AS (
  SELECT row_no, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT row_no, x.v, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x.v, m.v)])::BIGINT AS d FROM kept x CROSS JOIN c{k} m) GROUP BY row_no),"""


def _moved(k: int) -> str:
    return f"""
means{k} AS (
  SELECT c, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS v
  FROM (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN means{k} m USING (c)),"""


ORACLE_SQL = rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS c, v
       FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM kept) QUALIFY c < 16),
{"".join(_round(k) + _moved(k) for k in range(ROUNDS))}{_round(ROUNDS).rstrip(",")},
final AS (SELECT k.vec_id, best.c AS cluster, best.d AS distance FROM near{ROUNDS} n JOIN kept k USING (row_no))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM final JOIN c{ROUNDS} m ON m.c = cluster
"""
