"""Merkle dataset manifest with octopus multiproofs (operator 11).

A leaf is the SHA-256 of a document's fields.  The leaves of a source, in the
order of doc_id, are the lowest level of its tree; every three consecutive nodes
of a level have a parent on the next one, until one node is left, the subroot.
The subroots, in the order of their sources, are the leaves of the tree that ends
in the root.

Building: positions come from a range partitioning (``ordering.numbered``); a
block of ``3 ** DEPTH`` consecutive nodes is a leaf partition, whose task derives
``DEPTH`` levels at once.  The block roots are the nodes of the next round, so
there are log(leaves) / log(3 ** DEPTH) rounds.

Proving goes down the same rounds.  Every leaf partition works out the least set
of node coordinates that its proofs need and its own nodes do not give
(``missing``), fetches them in one row, derives the interiors that its leaves
share, and expands the proof of each leaf from the two.  The row it fetches is
the proof of its block root, which the round above has expanded: a node close to
the root is needed by every partition, and would be one hot key if each asked for
it by itself.

Defined results: a null doc_id comes first and is never tampered with; rows that
repeat a doc_id are leaves of their own, ordered by their hash; null and empty
texts differ (``-`` and ``0:``); a null source is a source of its own; an empty
table gives no rows.  Other columns of any name stay out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, runs_of, table, written
from .ordering import numbered

#: Children of a node (the contract's).
WIDTH = 3
#: Levels that one task derives from a block of WIDTH ** DEPTH nodes.
DEPTH = 6
SPAN = WIDTH**DEPTH
_HEX = 64

NODE = "tree long, at long, n long, hash string"
PATH = "tree long, at long, path string, subroot string"
PROOF = "doc_id long, leaf string, subroot string, proof string, proof_sha256 string, folded_root string"
_PATHS = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("path", pa.string()), ("subroot", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _above(n: int) -> int:
    return -(-n // WIDTH)


# ------------------------------------------------------------------- leaves
def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents whose text is ``text``."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def tampered_text() -> Column:
    """The text that is shown for a document: without its line feeds where 2
    divides the CRC of the doc_id, else as it is."""
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(bad, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, shown) of every row: the leaf, and the leaf of the row
    with the text ``shown`` where that is another one, else null."""
    own = leaf_of(F.col("text"))
    other = F.lit(None).cast("string") if shown is None else F.when(~shown.eqNullSafe(F.col("text")), leaf_of(shown))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       own.alias("leaf"), other.alias("shown"))


# -------------------------------------------------------------------- trees
def interiors(hashes: list[str], n: int) -> list[list[str]]:
    """The levels over a block of consecutive nodes of a level of ``n`` nodes, the
    block's own first: DEPTH more, fewer where the tree ends."""
    levels = [hashes]
    while n > 1 and len(levels) <= DEPTH:
        below, n = levels[-1], _above(n)
        levels.append([digest("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])
    return levels


def missing(known: list[int], n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index), lowest level first, of the nodes that the proofs
    of ``known`` (indexes in a level of ``n`` nodes) need and do not derive."""
    out, level = [], 0
    while n > 1:
        have, parents = set(known), sorted({i // WIDTH for i in known})
        out += [(level, i) for p in parents for i in range(p * WIDTH, min(n, (p + 1) * WIDTH)) if i not in have]
        known, n, level = parents, _above(n), level + 1
    return out


def fold(node: str, trees: list[tuple[int, int]], path: str) -> str:
    """The root that ``node`` leads to with the siblings ``path``; ``trees`` are its
    position and the number of nodes in each tree on the way."""
    used = 0
    for at, n in trees:
        while n > 1:
            left, others = at % WIDTH, min(WIDTH, n - at // WIDTH * WIDTH) - 1
            run = path[used : used + others * _HEX]
            used += others * _HEX
            node = digest(run[: left * _HEX] + node + run[left * _HEX :])
            at, n = at // WIDTH, _above(n)
    if used != len(path):
        raise ValueError("the proof is longer than the way to the root")
    return node


def _dealt(nodes: DataFrame, *first: str) -> DataFrame:
    """Rows block by block, in the order of ``first`` and their positions."""
    keys = ["tree", "block"]
    return nodes.repartition(*keys).sortWithinPartitions(*keys, *first, "at")


def _block_of(at: str = "at") -> Column:
    return F.floor(F.col(at) / SPAN).cast("long").alias("block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of (tree, at, n, hash): the given nodes, their block roots, and so on
    to the roots of all trees."""
    schema = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])

    def roots(batches):
        for t in runs_of(batches, ["tree", "block"]):
            tree, at, n = (t.column(c)[0].as_py() for c in ("tree", "block", "n"))
            top = interiors(t.column("hash").to_pylist(), n)[-1][0]
            yield batch(schema, tree=[tree], at=[at], n=[-(-n // SPAN)], hash=[top])

    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = rounds[-1].select("tree", "at", "n", "hash", _block_of())
        rounds.append(written(_dealt(below).mapInArrow(roots, NODE), "nodes"))
        most = -(-most // SPAN)
    return rounds


# ------------------------------------------------------------------- proofs
def _expand(t: pa.Table, top: int) -> tuple[list[int], list[str], str]:
    """Of one leaf partition, whose first row is what it fetches: the positions of its
    nodes, their siblings on the way to the root, and its subroot.  ``top`` is the
    number of subroots where the tree is a source's, else 0."""
    kinds = t.column("kind").to_pylist()
    if kinds[0] != 0 or len(kinds) > 1 and kinds[1] == 0:
        raise ValueError("a leaf partition needs one fetched row")
    tree, block, n = t.column("tree")[0].as_py(), t.column("block")[0].as_py(), t.column("n")[-1].as_py()
    path, subroot = t.column("path")[0].as_py(), t.column("subroot")[0].as_py()
    nodes = t.slice(1)
    at = nodes.column("at").to_pylist()
    needed = missing(at, n)
    # the nodes of the tree, then those of the tree of subroots
    if len(path) != _HEX * (len(needed) + (len(missing([tree], top)) if top else 0)):
        raise ValueError(f"leaf partition {block} of tree {tree} needs other nodes than it fetched")
    levels = interiors(nodes.column("hash").to_pylist(), n)
    proofs = []
    for i in at:
        own, k = [], i - block * SPAN
        for level in levels[:-1]:
            lo = k // WIDTH * WIDTH
            own += level[lo:k] + level[k + 1 : lo + WIDTH]
            k //= WIDTH
        proofs.append("".join(own) + path)
    return at, proofs, subroot


def _with_fetched(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Leaf partitions: the row to fetch (kind 0), then the nodes (kind 1)."""
    fetched = above.select("tree", F.col("at").alias("block"), F.lit(0).alias("kind"), "path", "subroot")
    own = nodes.withColumns({"kind": F.lit(1), "block": _block_of()})
    return _dealt(own.unionByName(fetched, allowMissingColumns=True), "kind")


def _way_down(rounds: list[DataFrame], above: DataFrame, top: int) -> DataFrame:
    """The leaf partitions of round 0 with what they fetch: ``above`` holds the paths
    of the tree roots, and each round expands those of its nodes."""

    def expanded(batches):
        for t in runs_of(batches, ["tree", "block"]):
            at, proofs, subroot = _expand(t, top)
            yield batch(_PATHS, tree=[t.column("tree")[0].as_py()] * len(at), at=at, path=proofs, subroot=[subroot] * len(at))

    for nodes in rounds[-2:0:-1]:
        above = written(_with_fetched(nodes, above).mapInArrow(expanded, PATH), "paths")
    return _with_fetched(rounds[0], above)


def _subroot_paths(tops: list[DataFrame]) -> DataFrame:
    """(tree, at = 0, path, subroot) for the tree of every source: what its root
    needs to reach the root of all."""

    def expanded(batches):
        for t in runs_of(batches, ["tree", "block"]):
            at, proofs, _ = _expand(t, 0)
            yield batch(_PATHS, tree=at, at=[0] * len(at), path=proofs, subroot=t.slice(1).column("hash").to_pylist())

    root = tops[-1].select("tree", "at", F.lit("").alias("path"), F.lit("").alias("subroot"))
    return written(_way_down(tops, root, 0).mapInArrow(expanded, PATH), "subroot-paths")


def manifest(docs: DataFrame, shown: Column | None = None, proofs: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof (the siblings' hashes
    on the way to the root, joined; null without ``proofs``), proof_sha256,
    folded_root (from the leaf of the row with the text ``shown``, and the proof)
    and verified."""
    base = numbered(written(leaves(docs, shown), "leaves"), ["doc_id", "leaf"], "leaves-in-order", "source").select(
        F.col("group_at").alias("tree"), "at", "n", F.col("leaf").alias("hash"), "doc_id", "shown"
    )
    base = written(base, "leaf-nodes")
    rounds = climb(base.select("tree", "at", "n", "hash"))
    top = rounds[-1].count()
    if not top:
        return base.selectExpr(
            "doc_id", "hash as leaf", "hash as subroot", "hash as root", "hash as proof", "hash as proof_sha256",
            "hash as folded_root", "true as verified",
        )
    tops = climb(rounds[-1].select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(top).cast("long").alias("n"), "hash"
    ))
    root = tops[-1].first()["hash"]
    names = ("leaf", "subroot", "proof", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names)])

    def proven(batches):
        for t in runs_of(batches, ["tree", "block"]):
            tree, n = t.column("tree")[0].as_py(), t.column("n")[-1].as_py()
            at, found, subroot = _expand(t, top)
            t = t.slice(1)
            own, other = t.column("hash").to_pylist(), t.column("shown").to_pylist()
            yield batch(
                schema, doc_id=t.column("doc_id").to_pylist(), leaf=own, subroot=[subroot] * len(at),
                proof=found if proofs else [None] * len(at), proof_sha256=list(map(digest, found)),
                folded_root=[fold(y or x, [(i, n), (tree, top)], p) for x, y, i, p in zip(own, other, at, found)],
            )

    rows = _way_down([base, *rounds[1:]], _subroot_paths(tops), top).mapInArrow(proven, PROOF)
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered_text(), proofs=False).drop("proof")


#: The CRC of a decimal doc_id before its last inversion, which DuckDB has no function
#: for: each character's code is taken in, then eight shifts follow (-1).
_CRC = """list_reduce([4294967295::BIGINT] || flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""


def _sized(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


ORACLE_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, text,
         {_sized("doc_id::VARCHAR")} || {_sized("source")} || {_sized("lang")} || {_sized("n_chars::VARCHAR")} AS head,
         CASE WHEN {_CRC} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS shown
  FROM documents),
leaves AS (
  SELECT row_no, doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, sha256(head || {_sized("text")}) AS leaf, sha256(head || {_sized("shown")}) AS other FROM given)),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
tops AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, h FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n),
around AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
around_tops AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT row_no, tree, 0 AS level, idx, n, other AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.row_no, w.tree, w.level + 1, w.idx // 3, (w.n + 2) // 3, sha256(a.before || w.h || a.after), w.proof || a.before || a.after
  FROM walk w JOIN around a ON a.tree = w.tree AND a.level = w.level AND a.idx = w.idx WHERE w.n > 1),
walk_tops AS (
  SELECT row_no, 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, h, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT w.row_no, w.level + 1, w.idx // 3, (w.n + 2) // 3, sha256(a.before || w.h || a.after), w.proof || a.before || a.after
  FROM walk_tops w JOIN around_tops a ON a.level = w.level AND a.idx = w.idx WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN walk_tops w ON w.row_no = l.row_no AND w.n = 1 JOIN nodes s ON s.tree = l.tree AND s.n = 1 JOIN tops r ON r.n = 1
"""
