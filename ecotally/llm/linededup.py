"""Line dedup over levelled sorted runs (operator 8); DataFrame functions only.

A line's key is the line without white space (space, U+0009-U+000D) at both
ends, A-Z lower-cased; two 64-bit hashes of different seeds stand for it.

Documents come in batches.  A batch's keys, counted and sorted, are merge-anti-
joined with the runs of the batches before it: the keys that no run holds become
a run of their own, a written table sorted by key, so no key stands in two runs;
the others only add to a key's count, and go to a table of updates.  When a
level holds ``FANOUT`` runs they are merged, with the updates so far, into one of
the next level, so a key is rewritten once per level, not once per batch.

``repeated`` finds the keys of at least so many documents: in a run's own counts,
or in those with its updates.  ``LineRuns.unseen`` leaves the keys of a batch that
no earlier one had.

Null and empty texts are one empty line.  Keys shorter than ``min_chars`` code
points are never dropped.  A doc_id counts once for a key however often the row
is repeated, and a null doc_id as one document.  Dropping lines costs time in
proportion to a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table, written

MIN_CHARS, MIN_DOCS = 1, 10
FANOUT = 4
#: Batches that the documents are dealt into, a run each; a batch reads the keys of those before it.
BATCHES = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\n\x0b\f\r"))
    # lower() is the same on ASCII, and much cheaper than translating every character
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def hashes_of(line: Column, min_chars: int) -> Column:
    """The key's hashes as a struct, null for a key that is too short.

    The hash of 1 is the seed of the second one, so that neither follows from the other."""
    key = key_of(line)
    return F.when(
        F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))
    )


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, keys) of rows of (doc_id, text): the hashes of each line in
    order; row_hash tells rows of one doc_id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_hash"),
        F.transform(lines_of(F.col("text")), lambda x: hashes_of(x, min_chars)).alias("keys"),
    )


def keys_of(keyed: DataFrame) -> DataFrame:
    """(doc_id, h, g) for the distinct keys of every row of ``line_keys``.

    Sorted, equal keys are neighbours: array_distinct compares all pairs of structs."""
    once = F.filter("sorted", lambda k, at: (at == 0) | ~k.eqNullSafe(F.get(F.col("sorted"), at - 1)))
    return (
        keyed.select("doc_id", F.array_sort("keys").alias("sorted")).select("doc_id", F.explode(once).alias("k"))
        .filter("k is not null").select("doc_id", "k.h", "k.g")
    )


class LineRuns:
    """Runs of (h, g, docs), level by level, and updates to their counts; each a
    written table sorted by key.  A key stands in one run only."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            self.compact(level)

    def _against_runs(self, counted: DataFrame) -> DataFrame:
        """``counted`` with the column ``seen``: does a run hold the key?  A merge join
        on the key; as no two runs share one, each row meets one row at most."""
        if not self.runs:
            return counted.withColumn("seen", F.lit(False))
        held = _together([run.select("h", "g") for run in self.runs]).withColumn("held", F.lit(True))
        joined = counted.join(held.hint("merge"), ["h", "g"], "left")
        return joined.withColumn("seen", F.col("held").isNotNull()).drop("held")

    def unseen(self, keyed: DataFrame) -> DataFrame:
        """(doc_id, h, g) of the keys of ``line_keys`` rows that no run holds."""
        return self._against_runs(keys_of(keyed)).filter(~F.col("seen")).select("doc_id", "h", "g")

    def add(self, keyed: DataFrame, repeats: bool = True) -> None:
        """Take in a batch of ``line_keys`` rows.  It shares no doc_id with earlier
        ones; ``repeats`` tells whether a doc_id may have several rows in it."""
        docs = F.count_distinct(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull()) if repeats else F.count(F.lit(1))
        counted = keys_of(keyed).groupBy("h", "g").agg(docs.alias("docs"))
        # both outcomes of the anti-join from one pass over the batch, a folder each
        split = written(self._against_runs(counted).sortWithinPartitions("seen", "h", "g"), "lines-0", "seen")
        fresh, known = (split.filter(F.col("seen") == x).select("h", "g", "docs") for x in (False, True))
        if self.runs:
            self.updates.append(known)
        self._put(0, fresh)

    def compact(self, level: int) -> None:
        """Merge a level's runs, and the updates of their keys, into one run of the next."""
        runs, self.levels[level] = self.levels[level], []
        merged = self._updated(_together(runs))
        if self.updates and self.runs:  # updates of keys in other runs stay
            other = _together(self.updates).join(_together(runs).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
            self.updates = [written(other.sortWithinPartitions("h", "g"), "line-updates")]
        else:
            self.updates = []
        self._put(level + 1, written(merged.repartition("h", "g").sortWithinPartitions("h", "g"), f"lines-{level + 1}"))

    def _updated(self, run: DataFrame) -> DataFrame:
        if not self.updates:
            return run
        more = _together(self.updates).groupBy("h", "g").agg(F.sum("docs").alias("more"))
        return run.join(more, ["h", "g"], "left").select("h", "g", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"))

    def counts(self) -> DataFrame:
        """(h, g, docs) of every key."""
        return self._updated(_together(self.runs))


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def repeated(keyed: DataFrame, min_docs: int, batches: int, fanout: int = FANOUT) -> DataFrame:
    """(h, g) of the keys found in at least ``min_docs`` documents.

    Rows of ``line_keys`` are dealt to the batches by doc_id; ``keyed`` has the batch
    in the column ``batch``, its folder."""
    runs = LineRuns(fanout)
    # a row gives a key once; only where a doc_id has several rows must they be told apart
    repeats = not keyed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    for k in range(batches):
        runs.add(keyed.filter(F.col("batch") == k), repeats)
    return written(runs.counts().filter(F.col("docs") >= min_docs).select("h", "g"), "repeated")


def drop_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
    names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the text without its repeated lines, the number of its lines
    and of those dropped, in the columns ``names``, which replace columns of that name.

    Texts are read twice, for the hashes of their lines and for the result; what
    is counted and joined in between are hashes.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    keyed = written(line_keys(docs, min_chars).select("*", batch), "line-keys", "batch")
    drop = repeated(keyed, min_docs, batches)
    own, own_hash, gone, lines, kept = free_names([*docs.columns, *names], "own", "own_hash", "gone", "lines", "left")
    row = F.struct("doc_id", "row_hash")
    dropped = (
        keyed.select(row.alias("row"), F.posexplode("keys").alias("at", "k")).filter("k is not null")
        .select("row", "at", "k.h", "k.g").join(drop, ["h", "g"], "left_semi")
        .groupBy("row").agg(F.collect_set("at").alias(gone))
        .select(F.col("row.doc_id").alias(own), F.col("row.row_hash").alias(own_hash), gone)
    )
    doc_id = F.col("doc_id").cast("long")
    joined = docs.join(
        dropped, doc_id.eqNullSafe(F.col(own)) & (F.xxhash64(doc_id, F.col("text")) == F.col(own_hash)), "left"
    ).withColumn(lines, lines_of(F.col("text")))
    # array_except looks places up in a hash set, so this takes time in proportion to the lines
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.transform(places, lambda at: F.get(F.col(lines), at))
    return (
        joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(rest))
        .withColumns({
            names[0]: F.array_join(kept, "\n"),
            names[1]: F.size(lines).cast("long"),
            names[2]: (F.size(lines) - F.size(kept)).cast("long"),
        })
        .drop(own, own_hash, gone, lines, kept)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_no, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
repeated AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, r.k IS NOT NULL AS gone FROM lines l LEFT JOIN repeated r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
