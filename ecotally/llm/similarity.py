"""N-gram Jaccard join over signature trees (operator 1).

A document is the set of its distinct five-word shingles; two documents link
when ``100 * |intersection| >= 80 * |union|``.

How the search is dealt to tasks
    Documents with equal sets form one class, looked at once.  A class keeps
    the ``SKETCH`` smallest of its shingle hashes.  Hashes stand in one global
    order: those of a single class first, frequent ones last.  By the prefix
    principle, linked classes share one of the first ``prefix(size)`` hashes of
    both, and the ones of a single class can be no shared one, so a class is
    sent to the units of the others only.  Sets that fit the sketch are exact.
    For larger ones the sketch is a uniform sample of the union, of which at
    most a fifth is unshared; that ``prefix`` of it are has probability below
    1e-10, less than a collision of the 64-bit hashes that stand for shingles.
    Which hashes have one class only comes from a bitmap of fixed size: where
    it errs, a hash counts as shared, which costs a look and loses nothing.

Signature trees
    In a unit every class has a bitmap of its shingles, four bits a shingle or
    more, and its size.  Inner nodes hold the OR of their children's bitmaps
    and the range of their sizes.  A dual traversal starts from the roots and
    drops pairs of nodes whose sizes are too far apart or whose bitmaps cannot
    hold the overlap that their smallest members need.

Verification
    A first round emits for each class its best earlier partner in the units of
    its first two hashes; these pairs are verified on the whole sets and join
    most copies.  The second round looks at the units that still hold several
    components and emits every pair of different components that the trees
    leave, once, in the unit of the first hash both were sent to.  Verified
    pairs are the links of which connected components are taken.

Hot units
    Units are cut into blocks.  In the first round a block meets itself and the
    first block; in the second, classes outside the unit's largest component meet
    it and one another in pairs of blocks, while that component, which in a
    large group of copies holds most classes, does not meet itself.

Null and empty texts have an empty set and link with nothing; rows that repeat
a doc_id count as one document; a null doc_id has no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, SlotMap, batch, doc_bytes, runs_of, shingle_hashes, table, words_ws
from .components import components

#: Smallest hashes kept of a class, and how many of a full sketch can be unshared.
SKETCH, UNSHARED = 256, 99
#: A shingle is frequent from so many classes on; at most 2**18 are, whatever the input.
FREQUENT, FREQUENT_BITS = 64, 18
#: Slots (2**bits) of the map of hashes with more than one class.
SHARED_BITS = 26
#: Most classes of a block, and children of a tree's node.
BLOCK, FANOUT = 512, 8
BITS_A_SHINGLE = 4


def prefix(size: int) -> int:
    """How many first hashes of a set of ``size`` shingles must hold a shared one."""
    if 5 * size <= 4 * SKETCH:  # every set that it can link with fits the sketch too
        return size - (4 * size + 4) // 5 + 1
    return UNSHARED + 1


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set as 64-bit words; its width is a power of two."""
    width = 64
    while width < BITS_A_SHINGLE * len(hashes):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: bits that meet are ORed."""
    half = words.shape[-1] // 2
    return words[..., :half] | words[..., half:]


def _sketched(batches):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("sketch", pa.binary()), ("bits", pa.binary()),
    ])
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            out = []
            for raw in part.column("text").to_pylist():
                h = np.unique(shingle_hashes(words_ws(raw)))
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
                out.append((len(h), d1, d2, h[:SKETCH].tobytes(), signature(h).tobytes()))
            n, d1, d2, sketch, bits = zip(*out)
            yield batch(schema, doc_id=part.column("doc_id"), n=n, d1=d1, d2=d2, sketch=sketch, bits=bits)


def _hashes(batches):
    schema = pa.schema([("token", pa.int64())])
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            yield batch(schema, token=np.frombuffer(b"".join(b.column("sketch")[lo : lo + 1000].to_pylist()), np.int64))


def _sent(shared: SlotMap, frequent: np.ndarray):
    """The hashes whose units a class goes to, in the global order."""

    def chosen(batches):
        schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("sent", pa.binary()), ("bits", pa.binary())])
        for b in batches:
            out = []
            for n, raw in zip(b.column("n").to_pylist(), b.column("sketch").to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                several = shared.has(h)
                left = prefix(n) - int((~several).sum())
                if left <= 0:
                    out.append(None)
                    continue
                h = h[several]
                common = np.zeros(len(h), bool)
                if len(frequent):
                    common = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                out.append(np.concatenate((h[~common], h[common]))[:left].tobytes())
            keep = np.array([bool(x) for x in out], bool)
            part = b.filter(pa.array(keep))
            yield batch(schema, cid=part.column("cid"), n=part.column("n"), sent=[x for x in out if x], bits=part.column("bits"))

    return chosen


PLACE = "token long, rank int, cid long, comp long"


def _places(classes: DataFrame, slots: SlotMap | None = None) -> DataFrame:
    """Rows of (token, rank, cid, comp) from classes (cid, comp, sent): rank is the
    token's place in the class's order.  With ``slots`` only tokens of those slots."""

    def exploded(batches):
        schema = pa.schema([("token", pa.int64()), ("rank", pa.int32()), ("cid", pa.int64()), ("comp", pa.int64())])
        for b in batches:
            raws = b.column("sent").to_pylist()
            sizes = np.array([len(r) // 8 for r in raws], np.int64)
            if not sizes.sum():
                continue
            token = np.frombuffer(b"".join(raws), np.int64)
            rank = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cid, comp = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("cid", "comp"))
            if slots is not None:
                keep = slots.has(token)
                token, rank, cid, comp = token[keep], rank[keep], cid[keep], comp[keep]
            yield batch(schema, token=token, rank=rank.astype(np.int32), cid=cid, comp=comp)

    return classes.select("cid", "comp", "sent").mapInArrow(exploded, PLACE)


class Tree:
    """A signature tree over classes of one bitmap width: levels of sizes, bitmaps
    and surpluses (shingles less set bits) from the leaves up."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, own: np.ndarray):
        order = np.lexsort((own, sizes))
        self.own = own[order]
        lo = hi = sizes[order]
        words = words[order]
        extra = lo - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [(lo, hi, words, extra)]
        while len(lo) > FANOUT:
            cuts = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            words, extra = np.bitwise_or.reduceat(words, cuts, axis=0), np.maximum.reduceat(extra, cuts)
            self.levels.append((lo, hi, words, extra))


def _possible(a, b, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most overlap of node pairs, and whether it can reach the threshold."""
    (lo_a, hi_a, w_a, x_a), (lo_b, hi_b, w_b, x_b) = a, b
    fits = (5 * hi_a[i] >= 4 * lo_b[j]) & (5 * hi_b[j] >= 4 * lo_a[i])
    most = np.zeros(len(i), np.int64)
    at = np.flatnonzero(fits)
    step = max(1, (1 << 19) // w_a.shape[1])
    for k in range(0, len(at), step):
        p = at[k : k + step]
        both = np.bitwise_count(w_a[i[p]] & w_b[j[p]]).sum(axis=1, dtype=np.int64)
        most[p] = both + np.minimum(x_a[i[p]], x_b[j[p]])
    most = np.minimum(most, np.minimum(hi_a[i], hi_b[j]))
    # J >= 0.8 means an overlap of at least 4/9 of both sizes
    return most, fits & (9 * most >= 4 * (lo_a[i] + lo_b[j]))


def dual(a: Tree, b: Tree):
    """Leaf pairs that the bounds leave: positions in ``a.own`` and ``b.own``, most overlap.
    With ``a is b`` every pair comes once."""
    same = a is b
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[top_a][0])), np.arange(len(b.levels[top_b][0])), indexing="ij"))
    while True:
        if same:
            keep = i <= j if top_a else i < j
            i, j = i[keep], j[keep]
        most, ok = _possible(a.levels[top_a], b.levels[top_b], i, j)
        i, j, most = i[ok], j[ok], most[ok]
        if not top_a and not top_b:
            return i, j, most
        if top_a and (same or top_a >= top_b):
            i, j = _children(i, j, len(a.levels[top_a - 1][0]))
            top_a -= 1
            if same:
                j, i = _children(j, i, len(b.levels[top_b - 1][0]))
                top_b -= 1
        else:
            j, i = _children(j, i, len(b.levels[top_b - 1][0]))
            top_b -= 1


def _children(parent: np.ndarray, other: np.ndarray, below: int):
    child = (parent[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    return child[child < below], other[child < below]


def unit_pairs(sizes: np.ndarray, bits: list[bytes], side: np.ndarray | None = None):
    """Pairs of rows of a unit that its signature trees leave, with their most overlap.
    With ``side`` only pairs across the two sides."""
    words = [np.frombuffer(x, np.uint64) for x in bits]
    width = np.array([len(w) for w in words])
    rows = np.arange(len(words))
    found = []
    for w in np.unique(width):
        narrow, wide = rows[width == w], rows[width == 2 * w]

        def tree(own, fold=False):
            m = np.stack([words[r] for r in own])
            return Tree(sizes[own], folded(m) if fold else m, own)

        if side is None:
            t = tree(narrow)
            runs = [(t, t)]
            if len(wide):
                runs.append((t, tree(wide, True)))
        else:
            parts = {(s, f): o[side[o] == s] for s in (0, 1) for f, o in ((False, narrow), (True, wide))}
            trees = {k: tree(o, k[1]) for k, o in parts.items() if len(o)}
            pairs = (((0, False), (1, False)), ((0, False), (1, True)), ((0, True), (1, False)))
            runs = [(trees[x], trees[y]) for x, y in pairs if x in trees and y in trees]
        for x, y in runs:
            i, j, most = dual(x, y)
            if len(i):
                found.append((x.own[i], y.own[j], most))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _searched(every: bool):
    """Candidate pairs of every unit: each class's best earlier partner, or all
    pairs of different components in the first unit they share."""

    def searched(batches):
        for unit in runs_of(batches, ["token", "x", "y"]):
            if unit.num_rows < 2:
                continue
            cid, comp = unit.column("cid").to_numpy(), unit.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            x, y = unit.column("x")[0].as_py(), unit.column("y")[0].as_py()
            side = None if x == y else unit.column("side").to_numpy()
            if side is not None and (side == side[0]).all():
                continue
            i, j, most = unit_pairs(unit.column("n").to_numpy(), unit.column("bits").to_pylist(), side)
            keep = comp[i] != comp[j]
            i, j, most = i[keep], j[keep], most[keep]
            if not len(i):
                continue
            if every:
                sent = unit.column("before").to_pylist()
                before = {r: frozenset(np.frombuffer(sent[r], np.int64).tolist()) for r in {*i.tolist(), *j.tolist()}}
                keep = np.array([before[p].isdisjoint(before[q]) for p, q in zip(i.tolist(), j.tolist())])
                i, j = i[keep], j[keep]
            else:
                hi, lo = np.where(cid[i] > cid[j], i, j), np.where(cid[i] > cid[j], j, i)
                order = np.lexsort((cid[lo], -most / (unit.column("n").to_numpy()[i] + unit.column("n").to_numpy()[j] - most), hi))
                hi, lo = hi[order], lo[order]
                first = np.concatenate(([True], hi[1:] != hi[:-1]))
                i, j = lo[first], hi[first]
            yield batch(_PAIR, a=np.minimum(cid[i], cid[j]), b=np.maximum(cid[i], cid[j]))

    return searched


def _first_blocks(rows: DataFrame) -> DataFrame:
    """(x, y, side) of rows with ``size``: each block with itself and with block 0."""
    block = F.expr(f"cast(pmod(xxhash64(cid), ceil(size / {BLOCK})) as int)")
    own = "struct(block as x, block as y, 0 as side)"
    zero = (
        f"if(block > 0, array(struct(0 as x, block as y, 1 as side)),"
        f" transform(filter(sequence(0, cast(ceil(size / {BLOCK}) as int) - 1), k -> k > 0), k -> struct(0 as x, k as y, 0 as side)))"
    )
    return rows.withColumn("block", block).withColumn("at", F.explode(F.expr(f"concat(array({own}), {zero})"))).select(
        "token", "rank", "cid", "comp", "at.x", "at.y", "at.side"
    )


def _other_blocks(rows: DataFrame) -> DataFrame:
    """(x, y, side) of rows with ``main`` (the unit's largest component) and ``major``
    (its classes): blocks of other classes meet one another and the blocks of
    major ones (numbered behind them)."""
    p, q = f"cast(ceil((size - major) / {BLOCK}) as int)", f"cast(ceil(major / {BLOCK}) as int)"
    rows = rows.withColumns({"p": F.expr(p), "q": F.expr(q), "is_major": F.expr("comp = main")}).withColumn(
        "block", F.expr("cast(pmod(xxhash64(cid), if(is_major, q, p)) as int)")
    )
    majors = "transform(sequence(0, p - 1), k -> struct(k as x, p + block as y, 1 as side))"
    to_major = "transform(sequence(0, q - 1), k -> struct(block as x, p + k as y, 0 as side))"
    to_minor = "transform(sequence(0, p - 1), k -> struct(least(block, k) as x, greatest(block, k) as y, if(block < k, 0, 1) as side))"
    return rows.withColumn("at", F.explode(F.expr(f"if(is_major, {majors}, concat({to_major}, {to_minor}))"))).select(
        "token", "rank", "cid", "comp", "at.x", "at.y", "at.side"
    )


def _candidates(own: DataFrame, classes: DataFrame, scratch: Scratch, every: bool) -> DataFrame:
    """Candidate pairs (a, b) of the classes ``own`` (cid, comp, sent)."""
    if every:  # the component with most classes of the unit need not meet itself
        held = (
            _places(own).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("token").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
            .filter("comps > 1").select("token", "size", F.col("most.comp").alias("main"), F.col("most.n").alias("major"))
        )
    else:
        held = _places(own).groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    units = scratch.table(held, "units")
    rows = _places(own, SlotMap(units, "token")).join(units, "token")
    if every:
        body = classes.select("cid", "n", "bits", F.col("sent").alias("all"))
        # with what the class was sent to before this unit
        rows = _other_blocks(rows).join(body, "cid").withColumn("before", F.expr("substring(all, 1, rank * 8)")).drop("all")
    else:
        rows = _first_blocks(rows).join(classes.select("cid", "n", "bits"), "cid")
    keys = ["token", "x", "y"]
    return scratch.table(
        rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_searched(every), "a long, b long").distinct(), "pairs"
    )


def _whole(wanted: SlotMap):
    """Whole sets of the documents whose slot occurs."""

    def whole(batches):
        schema = pa.schema([("cid", pa.int64()), ("shingles", pa.binary())])
        for b in batches:
            at = np.flatnonzero(wanted.has(b.column("key").to_numpy()))
            for lo in range(0, len(at), 1000):
                part = b.take(pa.array(at[lo : lo + 1000]))
                out = [np.unique(shingle_hashes(words_ws(raw))).tobytes() for raw in part.column("text").to_pylist()]
                yield batch(schema, cid=part.column("doc_id"), shingles=out)

    return whole


def _linked(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= 80 * (len(p) + len(q) - both))
            keep = np.array(keep, bool)
            yield batch(_PAIR, a=b.column("a").to_numpy()[keep], b=b.column("b").to_numpy()[keep])


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets reach the threshold.

    The sets are made where the texts are; a slot map of the pairs' documents
    tells which, so no text is shuffled.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    wanted = SlotMap(ids.select(F.xxhash64("cid").alias("key")), "key")
    texts = doc_bytes(docs).filter("doc_id is not null").withColumn("key", F.xxhash64("doc_id"))
    sets = scratch.table(texts.mapInArrow(_whole(wanted), "cid long, shingles binary"), "sets")
    links = scratch.table(
        pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a")
        .mapInArrow(_linked, "a long, b long"),
        name,
    )
    scratch.drop("sets", "pairs", "units")
    return links


def similarity_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest doc_id with an
    equal set), component_id."""
    scratch = Scratch(docs.sparkSession)
    every = scratch.table(
        doc_bytes(docs).mapInArrow(_sketched, "doc_id long, n long, d1 long, d2 long, sketch binary, bits binary"), "sketches"
    )
    rows = scratch.table(every.select("doc_id", "n", "d1", "d2"), "rows", back=True)
    digests = scratch.table(
        rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("cid")).filter("cid is not null"), "digests"
    )
    picked = scratch.table(
        every.withColumnRenamed("doc_id", "cid").join(digests, ["cid", "d1", "d2"], "left_semi").select("cid", "n", "sketch", "bits"),
        "picked",
    )
    scratch.drop("sketches")
    counts = scratch.table(
        picked.select("sketch").mapInArrow(_hashes, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "counts",
    )
    total = rows.agg(F.sum(F.least("n", F.lit(SKETCH)))).first()[0] or 0
    often = counts.filter(F.col("n") >= max(FREQUENT, total >> FREQUENT_BITS)).select("token").collect()
    frequent = np.sort(np.array([r["token"] for r in often], np.int64).view(np.uint64))
    classes = scratch.table(
        picked.mapInArrow(
            _sent(SlotMap(counts, "token", SHARED_BITS), frequent), "cid long, n long, sent binary, bits binary"
        ),
        "classes",
    )
    scratch.drop("picked", "counts")

    own = classes.select("cid", "sent", F.col("cid").alias("comp"))
    first = _candidates(own.withColumn("sent", F.expr("substring(sent, 1, 16)")), classes, scratch, False)
    links = _verified(first, docs, scratch, "links")
    joined = components(links)
    known = scratch.table(
        own.drop("comp").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "sent", F.coalesce("component", "cid").alias("comp")),
        "known",
    )
    more = _verified(_candidates(known, classes, scratch, True), docs, scratch, "more")
    scratch.drop("known", "classes")
    joined = components(links.unionByName(more))
    members = scratch.table(
        digests.join(joined.withColumnRenamed("node", "cid"), "cid", "left").select(
            "d1", "d2", F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("component_id")
        ),
        "members", back=True,
    )
    scratch.drop("digests", "links", "more")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(members, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles",
        F.expr("if(doc_id is null, null, coalesce(class_id, doc_id))").alias("class_id"),
        F.expr("if(doc_id is null, null, coalesce(component_id, doc_id))").alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b
  WHERE 100 * p.n >= 80 * (u.n + v.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
