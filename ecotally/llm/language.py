"""Language identification by rank-order profiles (operator 7).

A text's letters, folded to lower case, form words between single separators;
its 1- to 3-grams ranked by frequency are its profile.  A language's profile is
ranked the same way over the training documents.  The distance to a language
is the sum, over the document's ranked n-grams, of how far each is out of
place there; n-grams that the language's profile lacks cost the profile's
length.  The nearest language wins, ties by name.

Null texts and texts without a letter are ``und`` with score 0.  With no
training document at all every text is ``und``.  Rows that repeat a document are
judged each; a null doc_id has a null held_out and is learned from by nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import about, appended, as_long, batch, table, text_bytes, utf8

#: Length of a language's and a document's profile.
PROFILE = 400
#: Labelled documents (about) that the profiles are learned from.
TRAIN_DOCS = 40_000
#: Each letter takes 21 bits of an n-gram's code, its order the top bits; 0 is the separator.
_BITS = np.uint64(21)


#: Code points whose folding is tabulated; those beyond it are rare and looked up singly.
_TABULATED = 0x20000


def _fold(c: int) -> int:
    """The code point's lower case if it is a letter, else 0."""
    ch = chr(c)
    if not ch.isalpha():
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


def letters() -> np.ndarray:
    """``_fold`` of the tabulated code points."""
    return np.fromiter(map(_fold, range(_TABULATED)), np.uint32, _TABULATED)


def grams(text: bytes, table: np.ndarray) -> np.ndarray:
    """Codes of the text's 1- to 3-grams; runs of other characters are one separator."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = table[np.minimum(points, _TABULATED - 1)]
    for at in np.flatnonzero(points >= _TABULATED):
        c[at] = _fold(int(points[at]))
    if not c.any():
        return np.empty(0, np.uint64)
    c = np.concatenate(([0], c, [0]))
    c = c[(c != 0) | np.concatenate(([True], c[:-1] != 0))].astype(np.uint64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    # the separator alone says nothing, and twice in a row it does not occur
    return np.concatenate((c[c != 0], two | np.uint64(1 << 63), three[c[1:-1] != 0]))


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(codes) > length:
        floor = np.partition(counts, len(counts) - length)[len(counts) - length]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:length]


def _counted(batches, folded):
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield batch(schema, lang=[lang] * len(codes), code=as_long(codes), n=n)
        held.clear()

    for b in batches:
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            g = grams(raw, folded)
            held.setdefault(lang, []).append(g)
            size += len(g)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, profile: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Ranked n-gram codes of each language, learned from rows with text and lang
    that are not held out.  ``profile`` rows per language reach the driver."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False))
    )
    folded = letters()
    counts = (
        about(labelled, "doc_id", train_docs).select("lang", text_bytes())
        .mapInArrow(lambda batches: _counted(batches, folded), "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    # equal counts: the smaller unsigned code first, as in ranked()
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code")
    best = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= profile)
    held: dict[str, dict[int, int]] = {}
    for r in best.select("lang", "place", "code").collect():
        held.setdefault(r["lang"], {})[r["place"]] = r["code"]
    return {
        lang: np.array([places[p] for p in sorted(places)], np.int64).view(np.uint64)
        for lang, places in sorted(held.items())
    }


class Profiles:
    """All languages' ranks over the union of their n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = PROFILE):
        self.langs, self.length, self.folded = sorted(profiles), length, letters()
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs] or [np.empty(0, np.uint64)]))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: bytes) -> tuple[str, float]:
        g = grams(text, self.folded)
        if not len(g) or not self.langs:
            return "und", 0.0
        g.sort()
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        codes = ranked(g[first], np.diff(np.append(first, len(g))), self.length)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == codes, self.ranks[:, at], -1)
        out = np.where(ranks >= 0, np.abs(ranks - np.arange(len(codes), dtype=np.int32)), self.length)
        distance = out.sum(axis=1) / (len(codes) * self.length)
        best = int(distance.argmin())
        return self.langs[best], float(1 - min(1.0, distance[best]))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], length: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its score (1 less the share of the
    worst distance, 0 to 1) in the columns ``names``."""
    model = Profiles(profiles, length)

    def fill(part):
        pairs = [model.predict(raw) for raw in utf8(part.column("text"))]
        return [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())]

    return appended(docs, dict(zip(names, (T.StringType(), T.DoubleType()))), fill)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(rows, train(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
