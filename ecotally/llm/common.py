"""Helpers shared by the training-data operators.

Texts travel to the Arrow functions as UTF-8 bytes: splitting and case folding
are then plain ``bytes`` operations and no code point is decoded unless an
operator needs it.  Null texts are empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecotally.session import delete_path, scratch_path

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; ASCII letters, digits and bytes of non-ASCII characters stay, the rest is a space.
ALNUM = bytes(
    LOWER[b] if b >= 128 or 48 <= b <= 57 or 97 <= LOWER[b] <= 122 else 32
    for b in range(256)
)

#: Odd multipliers that make the hash of a shingle depend on word order.
PLACE = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)
SHINGLE = 5


def words_ws(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of space and U+0009-U+000D."""
    return text.translate(LOWER).split()


def words_alnum(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps on overflow)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles in text order, with repeats.

    Fewer than ``k`` words: the whole sequence is the one shingle; no words:
    none.  A shingle's length enters its hash.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n] * PLACE[0]
    for i in range(1, k):
        out += h[i : i + n] * PLACE[i]
    return mix64(out + np.uint64(k))


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark longs, bit for bit."""
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias(col)


def doc_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text as bytes; other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read again,
    in a folder for each value of the columns ``folders``.

    Cuts the lineage: an executor lost later costs a read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of ``df``, also where a name holds a dot or a backtick."""
    return df.select([quoted(c) for c in like.columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Most rows of a batch that travels to Python in an operator's own session.
ROWS = 1000


class Scratch:
    """Written tables of one operator, and a session of its own to work on them.

    The session has the caller's settings, removes the shuffle files of each job when
    the job ends, and sends Python at most ``ROWS`` rows at a time (a row holds a text
    or whole sets, and both sides hold two batches); the caller's session is left as it is.
    """

    def __init__(self, spark: SparkSession):
        self.caller, self.work = spark, spark.newSession()
        for key, value in dict(spark.conf.getAll).items():
            if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
                self.work.conf.set(key, value)
        self.work.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))  # 0 and less: no limit
        self.work.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows if 0 < rows < ROWS else ROWS))
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str, back: bool = False) -> DataFrame:
        """``df`` written and read by the working session, or with ``back`` by the caller's."""
        self.drop(name)
        path = self.paths[name] = scratch_path(self.caller, f"llm-{name}")
        df.write.parquet(path)
        return (self.caller if back else self.work).read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read any more."""
        for name in names:
            if name in self.paths:
                delete_path(self.caller, self.paths.pop(name))


class SlotMap:
    """Which of 2**bits slots occur among keys: a bitmap of fixed size.

    A slot stands for many keys, so the map only spares work: what it lets
    through is checked exactly later.  It reaches the driver as rows of 4 KB,
    2**bits / 8 bytes in all, whatever the input.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 22):
        self.mask = (1 << bits) - 1
        c = F.col(column).bitwiseAND(F.lit(self.mask)) + 1  # the functions count from 1
        rows = keys.groupBy(F.bitmap_bucket_number(c).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("m"))
        self.packed = np.zeros((1 << bits) // 8, np.uint8)
        for r in rows.collect():
            m = np.frombuffer(bytes(r["m"]), np.uint8)
            at = (r["b"] - 1) * 4096
            self.packed[at : at + len(m)] = m

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Per key (64-bit integers) whether its slot occurs."""
        slot = keys.view(np.int64) & self.mask
        return (self.packed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def about(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, the same ones in every run: those whose
    hashed key falls below the fitting share.  All rows if there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def appended(df: DataFrame, fields: dict[str, T.DataType], fill, rows: int = 1000) -> DataFrame:
    """``df`` with the columns of ``fields`` (replaced where they exist), which
    ``fill`` returns as Arrow arrays for each batch of at most ``rows`` rows."""
    rest = df.drop(*fields)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, k) for n, k in fields.items())])

    def filled(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *fill(part)], names=[*part.schema.names, *fields])

    return rest.mapInArrow(filled, schema)


def utf8(column) -> list[bytes]:
    """The texts of a string column as bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; the input is sorted by the keys.

    Rows of one key may span batches; at most one key's rows are held back.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            held.append(b.slice(lo, hi - lo))
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)
