"""Embedding near-dedup with product quantisation (operator 6).

Vectors link when their cosine, in double precision, is at least ``COSINE``.

Index
    Unit vectors are dealt to coarse inverted lists (nearest centroid).  The lists
    grow in number with the table: beyond ``TOP_LISTS`` each is cut by a second,
    shared set of centroids of the residuals, as many as keep a list at ``LIST_SIZE``
    vectors.  The residual that is left is coded per subspace.  Centroids and
    codebooks are fitted on a bounded sample; every vector is indexed.
Search
    A vector probes each list whose boundary to its own list is near: linked
    vectors are at most ``r = sqrt(2 - 2 * COSINE)`` apart, and a gap of random
    direction has the share ``1/sqrt(d)`` of its length along the boundary's
    normal, so lists beyond ``SPREAD * r / sqrt(d)`` of it are left out, at either
    level (the only approximation; recall is measured in the tests).  In a list, a table
    of each query's distances to the codes gives the distance to every coded
    vector; a coded vector is passed if that distance, less its own coding
    error, is within r, which loses nothing.  Passed pairs are ranked again by
    the exact cosine.
Hot lists
    Lists are cut into blocks of members and of queries, and a pair of blocks
    is a unit.  A unit reports, per vector, the weight of its links and one edge
    to the smallest vector that it reaches within the unit: rows as many as
    vectors, never pairs.

Exact copies, told by two 64-bit hashes of different seeds, are indexed once.  Each
vector length has an index of its own; a table has few of them.  Vectors that are null, empty, zero or hold null
or non-finite components link with nothing; vectors of different lengths do not
link.  A null vec_id has no component.  Rows that repeat a vec_id count once
each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, batch, runs_of, table, written
from .components import components

COSINE = 0.95
#: Vectors (about) that centroids and codebooks are fitted on.
TRAIN_VECTORS = 16_384
#: Vectors a list should hold, and lists of the first level.
LIST_SIZE, TOP_LISTS = 512, 2_048
SUBSPACES, CODES = 8, 64
#: Standard deviations of a random gap's share along one direction.
SPREAD = 2.5
#: Most members and queries of a unit.
MEMBERS, SEEKERS = 1_024, 2_048


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def near(x: np.ndarray, centroids: np.ndarray, slack: float) -> np.ndarray:
    """Per vector and centroid: is it the nearest one, or lies the boundary to the nearest within ``slack``?"""
    squares = (centroids**2).sum(axis=1)
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + squares, 0)
    own = d.argmin(axis=1)
    gap = np.sqrt(np.maximum(squares[own][:, None] - 2 * (centroids[own] @ centroids.T) + squares, 0))
    return d - d[np.arange(len(x)), own][:, None] <= 2 * slack * gap + 1e-12


class Quantiser:
    """Coarse centroids, those of their residuals, and the codebooks of subspaces of what is left.

    List ``a * len(fine) + b`` holds the vectors nearest to coarse centroid a whose
    residual is nearest to fine centroid b."""

    def __init__(self, sample: np.ndarray, lists: int, top: int | None = None, subspaces: int = SUBSPACES, codes: int = CODES):
        self.dim = sample.shape[1]
        top = min(lists, top or TOP_LISTS)
        self.coarse = kmeans(sample, top)
        cells = -(-lists // top)
        self.fine = np.zeros((1, self.dim))
        if cells > 1:
            self.fine = kmeans(sample - self.coarse[self.nearest(sample, self.coarse)], cells)
        self.cuts = [(a[0], a[-1] + 1) for a in np.array_split(np.arange(self.dim), min(subspaces, self.dim))]
        rest = sample - self.centre(self.own(sample))
        self.books = [kmeans(rest[:, a:b], codes) for a, b in self.cuts]

    @staticmethod
    def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list that holds each vector."""
        top = self.nearest(x, self.coarse)
        return top * len(self.fine) + self.nearest(x - self.coarse[top], self.fine)

    def centre(self, lists) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def probes(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: each vector's own list and those whose boundary lies within ``slack``.

        What links with x in a list of another coarse centroid lies as near to x
        after that centroid is taken from both, so the second level is like the first."""
        rows, top = np.nonzero(near(x, self.coarse, slack))
        if len(self.fine) == 1:
            return rows, top
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for lo in range(0, len(rows), 1000):
            i, t = rows[lo : lo + 1000], top[lo : lo + 1000]
            a, b = np.nonzero(near(x[i] - self.coarse[t], self.fine, slack))
            found.append((i[a], t[a] * len(self.fine) + b))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the coding errors."""
        rest = x - self.centre(own)
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        error = np.zeros(len(x))
        for s, (a, b) in enumerate(self.cuts):
            part, book = rest[:, a:b], self.books[s]
            codes[:, s] = (part @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)
            error += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def looked_up(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances from queries to the coded vectors of list ``which``, by tables."""
        rest = queries - self.centre(which)
        total = np.zeros((len(queries), len(codes)))
        for s, (a, b) in enumerate(self.cuts):
            part, book = rest[:, a:b], self.books[s]
            lut = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)
            total += lut[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _sound(v: Column) -> Column:
    """Can the vector link?  Neither null, empty nor zero, and every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _rows(vectors: DataFrame) -> DataFrame:
    kept = dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>")
    v = F.col("embedding") if kept else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _stacked(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _listed(q: Quantiser, slack: float):
    """Rows of (list, member, cid): each vector once as a member of its list, and
    as a seeker in every list it probes."""
    schema = pa.schema([("list", pa.int32()), ("member", pa.bool_()), ("cid", pa.int64())])

    def listed(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                x = _unit(_stacked(part.column("v")))
                rows, lists = q.probes(x, slack)
                own = q.own(x)
                at = np.concatenate((np.arange(len(x)), rows))
                yield batch(
                    schema, list=np.concatenate((own, lists)).astype(np.int32),
                    member=np.arange(len(at)) < len(x), cid=part.column("cid").to_numpy()[at],
                )

    return listed


def reached(adjacent: np.ndarray, seekers: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides of a 0/1 link matrix the smallest id that each reaches."""
    far = np.iinfo(np.int64).max
    s, m = seekers.copy(), members.copy()
    while True:
        s2 = np.minimum(s, np.where(adjacent, m[None, :], far).min(axis=1))
        m2 = np.minimum(m, np.where(adjacent, s2[:, None], far).min(axis=0))
        if (s2 == s).all() and (m2 == m).all():
            return s, m
        s, m = s2, m2


def _joined(q: Quantiser, cosine: float):
    """Per unit and vector with links: cid, weight of the links found, smallest cid reached."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    schema = pa.schema([("cid", pa.int64()), ("weight", pa.int64()), ("least", pa.int64())])

    def joined(batches):
        for unit in runs_of(batches, ["list", "x", "y"]):
            member = unit.column("member").to_numpy()
            if member.all() or not member.any():
                continue
            cid, weight, v = unit.column("cid").to_numpy(), unit.column("weight").to_numpy(), _stacked(unit.column("v"))
            u = _unit(v)
            which = unit.column("list")[0].as_py()
            m, s = np.flatnonzero(member), np.flatnonzero(~member)
            codes, error = q.encode(u[m], np.full(len(m), which))
            passed = q.looked_up(u[s], which, codes) - error <= radius
            passed &= cid[s][:, None] < cid[m][None, :]  # each pair from its smaller side
            i, j = np.nonzero(passed)
            if not len(i):
                continue
            norm = np.sqrt((v * v).sum(axis=1))
            exact = np.empty(len(i))
            for lo in range(0, len(i), 1 << 16):
                a, b = s[i[lo : lo + (1 << 16)]], m[j[lo : lo + (1 << 16)]]
                exact[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
            ok = exact >= cosine
            if not ok.any():
                continue
            adjacent = np.zeros(passed.shape, bool)
            adjacent[i[ok], j[ok]] = True
            least_s, least_m = reached(adjacent, cid[s], cid[m])
            links_s, links_m = adjacent @ weight[m], weight[s] @ adjacent
            has_s, has_m = links_s > 0, links_m > 0
            yield batch(
                schema, cid=np.concatenate((cid[s][has_s], cid[m][has_m])),
                weight=np.concatenate((links_s[has_s], links_m[has_m])),
                least=np.concatenate((least_s[has_s], least_m[has_m])),
            )

    return joined


def _links_of(classes: DataFrame, cosine: float) -> DataFrame:
    """(cid, weight, least) rows of the classes (cid, weight, v) of one vector length."""
    n = classes.count()
    dim = classes.select(F.size("v")).first()[0]
    fitted = _stacked(pa.array([r["v"] for r in about(classes, "cid", TRAIN_VECTORS).select("v").collect()] or
                               [classes.select("v").first()["v"]], pa.list_(pa.float64())))
    q = Quantiser(_unit(fitted), max(1, n // LIST_SIZE))
    slack = np.sqrt(max(0.0, 2 - 2 * cosine)) * min(1.0, SPREAD / np.sqrt(dim))
    rows = written(
        classes.select("cid", "v").mapInArrow(_listed(q, slack), "list int, member boolean, cid long"), "lists"
    )
    sizes = rows.groupBy("list").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("s")).select(
        "list", F.expr(f"cast(ceil(m / {MEMBERS}) as int)").alias("m"), F.expr(f"cast(ceil(s / {SEEKERS}) as int)").alias("s")
    ).filter("m > 0")
    keys = ["list", "x", "y"]
    units = (
        rows.join(sizes, "list")
        .withColumn("own", F.expr("cast(pmod(xxhash64(cid), if(member, m, s)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, if(member, s, m) - 1)")))
        .select("list", F.expr("if(member, own, other)").alias("x"), F.expr("if(member, other, own)").alias("y"), "member", "cid")
        .join(classes, "cid")
    )
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _joined(q, cosine), "cid long, weight long, least long"
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    usable = _rows(vectors).filter(_sound(F.col("v"))).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    digests = usable.groupBy("h", "g").agg(
        F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("weight")
    ).filter("cid is not null")
    classes = written(
        usable.withColumnRenamed("vec_id", "cid").join(digests, ["h", "g", "cid"])
        .dropDuplicates(["cid", "h", "g"]).select("cid", "weight", "v"), "vectors"
    )
    found = None
    for r in classes.select(F.size("v").alias("d")).distinct().orderBy("d").toLocalIterator():
        part = _links_of(classes.filter(F.size("v") == r["d"]), cosine)
        found = part if found is None else found.unionByName(part)
    rows = _rows(vectors)
    if found is None:
        return rows.selectExpr("vec_id", "0L as n_links", "vec_id as component_id", "vec_id is not null as kept")
    found = written(found, "links")
    links = found.groupBy("cid").agg(F.sum("weight").alias("others"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    members = (
        digests.join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .select("h", "g", F.expr("weight - 1 + coalesce(others, 0)").alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    linked = usable.select("vec_id", "h", "g").join(members, ["h", "g"]).select("vec_id", "n_links", "component")
    alone = rows.filter(~_sound(F.col("v"))).selectExpr(
        "vec_id", "0L as n_links", "vec_id as component"
    )
    return linked.unionByName(alone).selectExpr(
        "vec_id", "n_links", "if(vec_id is null, null, component) as component_id",
        "coalesce(vec_id = component, false) as kept",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) r USING (vec_id)
"""
