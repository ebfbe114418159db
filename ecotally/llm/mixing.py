"""Mixing sources to target weights with a splitting tree of block quotas (operator 13).

Sizes are words.  The words of a source, its documents in the order of a hash,
are cut into blocks of equally many words; the last one is shorter.  A source's
target in words makes its block quota: that many blocks of a permuted order, the
last one cut where the target is met, and a second permutation of all blocks after
the first one is used up.  So a document is taken at most twice, and what a
source gives is its target, rounded to a word.

Which output shard gets how many blocks of which source is drawn by a tree.  A
node holds the exact quotas of a range of shards; each source's quota is dealt to
``FAN`` ranges of shards by a multivariate hypergeometric draw on the places they
have left, which leaves exact quotas for the next level.  A node's sources are
streamed in order, so a task keeps ``FAN`` numbers, and a level is one pass over the
quotas that are not 0.  A shard's blocks of a source are consecutive places of the
permuted order; the permutation (a Feistel network) is inverted to find a place's
block, so nothing is sorted or matched to draw.  Inside a shard, blocks stand in
the order of a hash.

Every draw is seeded by what it is for: reruns agree, whatever the partitioning,
for the same rows, seed and parameters.

Defined results: null, empty and blank texts have size 0 and are never taken;
a null source is the last one; rows that repeat a doc_id are documents of their
own, and equal rows are interchangeable; a source without words has target 0; an
empty table gives no rows.  Other columns of any name stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs_of, table, written
from .ordering import numbered

#: Weights of the sources in order, repeating; the share of all words to take; the most of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 13
#: Words of a block, and at least so many blocks share the words where blocks grow
#: (a hypergeometric draw takes counts up to 10 ** 9).
BLOCK_WORDS, MOST_BLOCKS = 4096, 500_000_000
#: Words of an output shard, and the ranges that a tree node is split into.
SHARD_WORDS, FAN = 1 << 22, 16
_WORD = r"[^\x20\x09-\x0D]+"
_FEISTEL = 6


# -------------------------------------------------------------------- sizes
def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, h) of every row, written; h puts a source's rows in
    order.  ``row`` is the column ``key``, which tells the rows apart, or made here."""
    doc_id = F.col("doc_id").cast("long")
    return written(
        docs.select(
            (F.col(key) if key else F.monotonically_increasing_id()).alias("row"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(SEED), doc_id, F.col("text")).alias("h"),
        ),
        "sizes",
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, number, source_size, target) of every source, written.

    Targets share ``share`` of all sizes by the weights; one that exceeds ``most``
    times its source stops there, and the others share the excess by weight.  A
    level of words a weight is raised until no source newly stops, so a pass over
    the sources finds sums only.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    found = numbered(by_source, ["last", "source"], "sources").select(
        "source", F.col("at").alias("number"), "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(most)).alias("cap"),
    )
    found = written(found, "weights")
    wanted = (found.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, capped, free = found.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (wanted - (capped or 0.0)) / free, n
    return written(
        found.select("source", "number", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target")), "targets"
    )


# ------------------------------------------------------------- permutations
def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(places: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """The places that a keyed permutation of 0 .. n - 1 moves ``places`` to, or with
    ``back`` where it moves them from.  Element by element; walks on while outside."""
    x = np.array(places, np.uint64)
    n, key = np.broadcast_to(np.asarray(n, np.uint64), x.shape), np.broadcast_to(np.asarray(key, np.uint64), x.shape)
    half = np.ones(x.shape, np.uint64)  # bits of either half
    while (short := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half = half + short.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
        for r in range(_FEISTEL - 1, -1, -1) if back else range(_FEISTEL):
            turn = key[todo] + np.uint64((r + 1) * 0xD6E8FEB86659FD93 % 2**64)
            if back:
                left, right = right ^ (_mixed(left, turn) & m), left
            else:
                left, right = right, left ^ (_mixed(right, turn) & m)
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _key(seed: int, source, epoch) -> np.ndarray:
    return _mixed(np.atleast_1d(np.asarray(source, np.uint64)) * np.uint64(2) + np.asarray(epoch, np.uint64), np.uint64(seed))


# ------------------------------------------------------------------- quotas
def quota(words: int, size: int, block: int, source: int, seed: int) -> tuple[int, int]:
    """(blocks to take, words of the last one) that make ``words`` words of a source
    with ``size`` words, at most twice."""
    if words <= 0:
        return 0, 0
    blocks = -(-size // block)
    short = size - (blocks - 1) * block  # words of the last block
    epoch, rest = (1, words - size) if words > size else (0, words)
    at = int(permuted(np.array([blocks - 1]), blocks, _key(seed, source, epoch))[0])  # where the short block stands
    n = -(-rest // block)
    if n > at:
        n = -(-(rest + block - short) // block)
    before = (n - 1) * block - (block - short) * (n - 1 > at)
    return epoch * blocks + n, rest - before


def quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(source_no, blocks, quota, last): blocks of a source, how many to take, and the
    words of the last one; sources that give nothing are left out."""

    def found(batches):
        for b in batches:
            rows = []
            for no, size, target in zip(*(b.column(c).to_pylist() for c in ("number", "source_size", "target"))):
                n, last = quota(int(np.floor(target + 0.5)), size, block, no, seed)
                if n:
                    rows.append((no, -(-size // block), n, last))
            no, blocks, n, last = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (no, blocks, n, last)], names=["source_no", "blocks", "quota", "last"])

    return sources.select("number", "source_size", "target").mapInArrow(found, "source_no long, blocks long, quota long, last long")


def _range(total: int, shards: int, lo: int, hi: int) -> int:
    """Places of the shards ``lo`` to ``hi`` - 1 when ``total`` are dealt out evenly."""
    return total * hi // shards - total * lo // shards


def split(given: DataFrame, total: int, shards: int, seed: int, fan: int = FAN) -> DataFrame:
    """(source_no, shard, quota): the splitting tree over ``given`` (source_no, quota),
    level by level; ``total`` is the sum of the quotas.  Quotas of 0 are left out."""
    node = "lo long, hi long, source_no long, quota long"
    names = ["lo", "hi", "source_no", "quota"]

    def parted(batches):
        now, left, cuts, rng = None, None, None, None
        for b in batches:
            out = []
            for lo, hi, no, q in zip(*(b.column(c).to_pylist() for c in names)):
                if (lo, hi) != now:
                    now = lo, hi
                    k = min(fan, hi - lo)
                    cuts = [lo + (hi - lo) * i // k for i in range(k + 1)]
                    left = np.array([_range(total, shards, x, y) for x, y in zip(cuts, cuts[1:])], np.int64)
                    rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
                drawn = rng.multivariate_hypergeometric(left, q, method="marginals")
                left = left - drawn
                out += [(x, y, no, int(d)) for x, y, d in zip(cuts, cuts[1:], drawn) if d]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=names)

    nodes, widest = given.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "source_no", "quota"), shards
    while widest > 1:
        dealt = nodes.repartition("lo").sortWithinPartitions("lo", "hi", "source_no")
        nodes, widest = written(dealt.mapInArrow(parted, node), "quotas"), -(-widest // fan)
    return nodes.select("source_no", F.col("lo").alias("shard"), "quota")


# -------------------------------------------------------------------- draws
def draws(split_up: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(shard, source_no, block, epoch, words, turn): the blocks of every shard.
    ``words`` is null for whole blocks; ``turn`` orders a shard's blocks."""
    from pyspark.sql import Window

    upto = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = split_up.withColumn("first", F.sum("quota").over(upto) - F.col("quota"))
    places = first.join(sources.withColumnRenamed("quota", "all"), "source_no").select(
        "shard", "source_no", "blocks", "all", "last", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("place")
    )

    def drawn(batches):
        for b in batches:
            shard, no, blocks, every, last, place = (b.column(c).to_numpy() for c in ("shard", "source_no", "blocks", "all", "last", "place"))
            epoch = place // blocks
            block = permuted(place - epoch * blocks, blocks, _key(seed, no, epoch), back=True)
            turn = _mixed(_key(seed + 1, no, epoch) + block.astype(np.uint64), shard.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (shard, no, block, epoch)]
                + [pa.array(last, pa.int64(), mask=place != every - 1), pa.array(turn, pa.int64())],
                names=["shard", "source_no", "block", "epoch", "words", "turn"],
            )

    return places.mapInArrow(drawn, "shard long, source_no long, block long, epoch long, words long, turn long")


def pieces(sized: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(row, source_no, block, place, doc_from, doc_to): the words of each document in
    each of its blocks, ``place`` being where the piece starts in the block."""
    order = ["h", "doc_id", "size"]
    laid = numbered(sized.filter("size > 0").select("row", "source", *order), order, "documents-in-order", "source")
    # words before a document: first within runs of RUN documents, then over the runs of a source
    found = _words_before(laid.join(sources.select(F.col("source").alias("own"), F.col("number").alias("source_no")),
                                    F.col("source").eqNullSafe(F.col("own"))).select("row", "source_no", "at", "size"))
    first, end = F.col("before"), F.col("before") + F.col("size")
    cut = found.select("row", "source_no", "before", "size", F.explode(
        F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long"))).alias("block"))
    start = F.greatest(F.col("before"), F.col("block") * block)
    return cut.select(
        "row", "source_no", "block", (start - F.col("block") * block).alias("place"), (start - F.col("before")).alias("doc_from"),
        (F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * block) - F.col("before")).alias("doc_to"),
    )


#: Documents whose words are added up in one place.
RUN = 1024


def _words_before(laid: DataFrame) -> DataFrame:
    """``laid`` (row, source_no, at, size) with the words ``before`` in the source.

    A pyramid: sums of RUN consecutive documents, of RUN such sums, and so on; a
    place then adds what stands before it on each level."""
    from pyspark.sql import Window

    n = laid.agg(F.max("at")).first()[0]
    level = laid.withColumn("run", F.floor(F.col("at") / RUN).cast("long"))
    within = Window.partitionBy("source_no", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = level.withColumn("before", F.sum("size").over(within) - F.col("size"))
    if n is None or n < RUN:
        return here.drop("run")
    sums = level.groupBy("source_no", F.col("run").alias("at")).agg(F.sum("size").alias("size"))
    above = _words_before(sums).select("source_no", F.col("at").alias("run"), F.col("before").alias("more"))
    return here.join(above, ["source_no", "run"]).withColumn("before", F.col("before") + F.col("more")).drop("run", "more")


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, *, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, seed: int = SEED, key: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, sources, taken): the rows with their sizes, the sources with their
    targets, and what the mix takes, as (shard, turn, place, row, epoch, doc_from,
    doc_to) in words of the document; ``turn`` and ``place`` order a shard.

    ``most`` is 2 at the most, as a block is drawn once or twice.
    """
    if most > 2:
        raise ValueError("a source is taken twice at the most")
    sized = sizes(docs, key)
    sources = targets(sized, weights, share, most)
    words = int(sources.agg(F.coalesce(F.sum(F.floor(F.col("target") + 0.5)), F.lit(0))).first()[0])
    block = max(block_words, -(-words // MOST_BLOCKS))
    given = written(quotas(sources, block, seed), "source-quotas")
    total = int(given.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    shards = max(1, min(total, -(-words // shard_words)))
    chosen = draws(split(given, total, shards, seed), given, seed)
    taken = (
        written(chosen, "draws").join(pieces(sized, sources, block), ["source_no", "block"])
        .withColumn("doc_to", F.least("doc_to", F.col("doc_from") + F.coalesce(F.col("words"), F.lit(block)) - F.col("place")))
        .filter("doc_to > doc_from")
        .select("shard", "turn", "place", "row", "epoch", "doc_from", "doc_to")
    )
    return sized, sources, taken


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The mixed words as Parquet below ``path``, a folder a shard: doc_id, source, and
    the piece's text, its words joined by a space, in the shuffled order of the shard."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"), "mixed-documents")
    _, _, taken = mix(keyed, key="row", **options)
    texts = keyed.select("row", "doc_id", "source", F.regexp_extract_all("text", F.lit(f"({_WORD})")).alias("w"))
    cut = taken.join(texts, "row").select(
        "shard", "turn", "place", "doc_id", "source",
        F.array_join(F.slice("w", F.col("doc_from").cast("int") + 1, (F.col("doc_to") - F.col("doc_from")).cast("int")), " ").alias("text"),
    )
    (cut.repartition("shard").sortWithinPartitions("shard", "turn", "place").select("shard", "doc_id", "source", "text")
     .write.partitionBy("shard").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources, taken = mix(table(spark, sf_dir, "documents"))
    words = taken.groupBy("row").agg(F.sum(F.col("doc_to") - F.col("doc_from")).alias("taken"))
    facts = sources.select(F.col("source").alias("own"), "source_size", "target")
    return (
        sized.join(words, "row", "left").join(facts, F.col("source").eqNullSafe(F.col("own")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
