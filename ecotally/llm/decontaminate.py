"""Benchmark decontamination by size-partitioned MinHash containment (operator 10).

Test items are short and documents long, so the question is containment: what
share of an item's five-word shingles stands in the document.  Items are
partitioned by size.  An item of n shingles keeps the ``n - needed + 1``
smallest of their hashes, where ``needed`` shingles make up the threshold: a
document that contains the item must hold one of these minima, whatever it
misses, so the search loses nothing; partitions that need more shingles than a
document has are skipped.  Each candidate is then verified by exact shingle
containment.

Spark hashes the items into a written table, in blocks of ``BLOCK`` hashes by a
running sum.  A block at a time travels to the documents, which are never
shuffled for the search; what it finds is written, and the block released.  Words
are lower-cased runs of letters and digits, so punctuation does not hide a passage.

An item of fewer than five words is one shingle of its own length and is sought
at every place of a document.  Items without words, null texts and empty tables
match nothing.  Repeated rows are compared each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE, SHINGLE, as_long, batch, free_names, hash_words, mix64, shingle_hashes, table, text_bytes, words_alnum, written

#: Least share of an item's shingles.
CONTAINMENT = 0.8
#: Shingle hashes of items that travel to the documents at a time (16 bytes each).
BLOCK = 2_000_000


def needed(n: int, containment: float) -> int:
    return max(1, int(np.ceil(round(n * containment, 9))))


class ItemIndex:
    """Sketches, by size partition, and full shingle sets of a block of items.

    A partition holds the items of one shingle length whose sizes share a power
    of two.  Its sketches (the least hashes of each item, ``size - needed + 1`` of
    them) stand in one sorted table; a document with fewer shingles than any of
    its items needs skips it.  A bitmap over all tables lets most shingles pass by.
    """

    def __init__(self, items: list[tuple[int, int, np.ndarray]], containment: float = CONTAINMENT):
        """items: (item number, shingle length, distinct sorted shingle hashes)."""
        self.items = items
        self.need = [needed(len(h), containment) for _, _, h in items]
        members: dict[tuple[int, int], list[int]] = {}
        for at, (_, k, h) in enumerate(items):
            members.setdefault((k, int(len(h)).bit_length()), []).append(at)
        self.parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (k, _), own in sorted(members.items()):
            sketches = [items[at][2][: len(items[at][2]) - self.need[at] + 1] for at in own]
            owners = np.repeat(own, [len(x) for x in sketches])
            order = np.argsort(hashes := np.concatenate(sketches), kind="stable")
            least = min(self.need[at] for at in own)
            self.parts.setdefault(k, []).append((least, hashes[order], owners[order]))
        tables = [t[1] for parts in self.parts.values() for t in parts]
        bits = max(10, min(24, int(sum(map(len, tables)) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        for t in tables:
            self.maybe[(t >> self.shift).astype(np.int64)] = True

    def search(self, words: list[bytes]):
        """``(position in the block, shared shingles)`` of every item contained."""
        if not words or not self.items:
            return
        h = hash_words(words)
        for k, parts in self.parts.items():
            n = len(h) - k + 1
            if n < 1:
                continue
            s = h[:n] * PLACE[0]
            for i in range(1, k):
                s += h[i : i + n] * PLACE[i]
            s = mix64(s + np.uint64(k))
            hits = s[self.maybe[(s >> self.shift).astype(np.int64)]]
            candidates: set[int] = set()
            for least, hashes, owners in parts if len(hits) else ():
                if n >= least:
                    lo, hi = np.searchsorted(hashes, hits, "left"), np.searchsorted(hashes, hits, "right")
                    candidates.update(int(o) for a, b in zip(lo[hi > lo], hi[hi > lo]) for o in owners[a:b])
            if not candidates:
                continue
            own = np.unique(s)
            for at in sorted(candidates):
                item = self.items[at][2]
                pos = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[pos] == item).sum())
                if shared >= self.need[at]:
                    yield at, shared


def item_blocks(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The items with words, written: item_id, k (shingle length), hashes (distinct,
    in unsigned order) and block, a folder each.  A block holds ``block`` hashes, and
    what its last item has beyond them."""
    schema = pa.schema([
        ("item_id", pa.int64()), ("k", pa.int32()), ("hashes", pa.list_(pa.int64())), ("part", pa.int32()), ("before", pa.int64()),
    ])

    def hashed(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows = []
                for i, raw in zip(*(b.slice(lo, 1000).column(c).to_pylist() for c in ("item_id", "text"))):
                    words = words_alnum(raw)
                    h = np.unique(shingle_hashes(words))
                    if len(h):
                        rows.append((i, min(SHINGLE, len(words)), as_long(h), part, before))
                        before += len(h)
                yield batch(schema, **dict(zip(schema.names, zip(*rows) if rows else [[]] * len(schema))))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes())
    laid = written(rows.mapInArrow(hashed, "item_id long, k int, hashes array<long>, part int, before long"), "items")
    sums = laid.groupBy("part").agg(F.sum(F.size("hashes")).alias("n"))  # a row a partition
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select("part", (F.sum("n").over(upto) - F.col("n")).alias("start"))
    numbered = laid.join(starts, "part").withColumn("block", F.expr(f"cast((start + before) div {int(block)} as int)"))
    return written(numbered.select("item_id", "k", "hashes", "block"), "item-blocks", "block")


FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()),
    T.StructField("n_shared", T.LongType()), T.StructField("containment", T.DoubleType()),
]))


def row_hash() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def found_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, row_hash, items, block): per row of ``docs`` and block of items with a
    contained item, the items of the block that its text contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), text_bytes())
    kind = pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("items", pa.list_(kind))])
    out_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_hash", T.LongType()), T.StructField("items", FOUND)])
    blocks = item_blocks(items, block)
    out = None
    for r in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        held = [
            (x["item_id"], x["k"], np.array(x["hashes"], np.int64).view(np.uint64))
            for x in blocks.filter(F.col("block") == r["block"]).collect()  # bounded by block
        ]
        sent = spark.sparkContext.broadcast(held)

        def searched(batches, sent=sent):
            index = ItemIndex(sent.value, containment)
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    part = b.slice(lo, 1000)
                    ids, rows_of, found = [], [], []
                    for i, h, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_hash", "text"))):
                        hits = [
                            {"item_id": index.items[at][0], "n_item": len(index.items[at][2]), "n_shared": n, "containment": n / len(index.items[at][2])}
                            for at, n in index.search(words_alnum(raw))
                        ]
                        if hits:
                            ids.append(i), rows_of.append(h), found.append(hits)
                    if found:
                        yield batch(schema, doc_id=ids, row_hash=rows_of, items=found)

        one = written(rows.mapInArrow(searched, out_type).withColumn("block", F.lit(r["block"])), "contained")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], out_type.add("block", T.IntegerType())) if out is None else out


def marked(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = BLOCK, name: str = "items") -> DataFrame:
    """``docs`` with the array ``name``, which replaces a column of that name, of the items that each text contains."""
    own, own_hash, hits = free_names([*docs.columns, name], "own", "own_hash", "hits")
    # rows that repeat a document found the same items each; blocks found different ones
    found = found_items(docs, items, containment, block).distinct().groupBy("doc_id", "row_hash").agg(
        F.flatten(F.collect_list("items")).alias(hits)
    ).withColumnsRenamed({"doc_id": own, "row_hash": own_hash})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (row_hash() == F.col(own_hash))
    joined = docs.join(found, same, "left")
    return joined.withColumn(name, F.coalesce(hits, F.array().cast(FOUND))).drop(own, own_hash, hits)


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """A row (doc_id, item_id, n_item, n_shared, containment) per document row and
    item row whose containment reaches the threshold."""
    return found_items(docs, items, containment, block).select("doc_id", F.inline("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: k-word shingles for the k of each item; the whole tables, as the operator.
ORACLE_SQL = rf"""
WITH items AS (SELECT row_number() OVER () AS row_no, item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT row_no, item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT row_no, item_id, count(*) AS n FROM item_shingles GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS doc_no, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_no, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM item_shingles) WHERE len(w) >= k)),
shared AS (SELECT doc_no, doc_id, row_no, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n::DOUBLE AS containment
FROM shared JOIN sizes USING (row_no) WHERE 10 * n_shared >= 8 * n
"""
