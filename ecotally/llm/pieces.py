"""SentencePiece encoding and decoding with a weighted transducer (operator 3).

The transducer is the composition of three machines compiled from the model:
the normaliser (spaces become U+2581, one stands before a non-empty text), the
pieces (a trie, one arc per piece), and byte fallback (a character without a
piece becomes the pieces of its UTF-8 bytes, the only arc there is then).  Composed with a text it is a lattice over the text's positions, and
the encoding is its shortest path in the tropical semiring.

The model at hand is a BPE model, whose result no sum of piece scores
describes.  What describes it is which pieces may stand side by side: a
sequence of pieces is the model's result exactly if merging each adjacent pair's
characters anew gives that pair back.  So the machine's states are last pieces,
and arcs between pieces that fail this test weigh infinity: one finite path is
left (the tests compare with the library, id by id).

No piece spans the place before a run of U+2581 or beside a character that
occurs in no longer piece, so the lattice falls into units there; paths of
short units are remembered per Python worker, in bounded number.

Null and empty texts have no ids; repeated rows are coded each.  Decoding drops the normaliser's prefix and
replaces byte sequences that are no UTF-8 by U+FFFD.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units (twice as many) and pairs that a worker remembers, and the longest unit remembered:
#: less than 60 MB in all.  Both numbers lie just below those at which a dict doubles.
REMEMBERED, REMEMBERED_PAIRS, LONGEST = 85_000, 340_000, 48


def read_model(path: str = MODEL) -> dict:
    """Pieces, ids and kinds of a model file; a few hundred kilobytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
    return {
        "pieces": [m.id_to_piece(i) for i in range(n)],
        "scores": [m.get_score(i) for i in range(n)],
        "bytes": {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)},
        "special": [i for i in range(n) if special[i]],
        "unknown": m.unk_id(),
    }


class Transducer:
    """The compiled machine; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, model: dict):
        self.bytes, self.unknown = model["bytes"], model["unknown"]
        apart = {*model["special"], *self.bytes.values()}
        self.text = model["pieces"]
        self.id = {p: i for i, p in enumerate(self.text) if i not in apart}
        order = sorted(self.id.values(), key=lambda i: -model["scores"][i])
        self.rank = {self.text[i]: r for r, i in enumerate(order)}
        self.trie: dict = {}
        for p, i in self.id.items():
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = i
        longer = [p for p in self.id if len(p) > 1]
        joining = {ch for p in longer for ch in p}
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds a space after other characters; units cannot be cut at spaces")
        inner = re.escape("".join(sorted(joining - {SPACE})))
        # a run of spaces with the joining characters behind it, or one character that joins nothing
        self.units = re.compile(rf"{SPACE}*[{inner}]+|{SPACE}+|.", re.S).findall if inner else re.compile(".", re.S).findall
        self.pairs: dict[int, bool] = {}  # by first piece * number of pieces + second
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is met again moves up
        self.surface = [
            b"" if i in set(model["special"]) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)
        ]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])

    def merged(self, s: str) -> list[str]:
        """The characters of ``s`` after all merges, best piece first, leftmost of equals."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, a: int, b: int) -> bool:
        """May piece b follow piece a?"""
        key = a * len(self.text) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def shortest_path(self, unit: str) -> list[int]:
        """Ids on the shortest path through the lattice of a unit.

        Depth first, longest piece first.  A place has one finite path from the
        start at most (the model's own result for the text before it), so a place
        that leads nowhere is closed for good and the first complete path is the
        shortest.
        """
        n, trie, pairs, many = len(unit), self.trie, self.pairs.get, len(self.text)
        places: list[int] = []  # where the pieces of the path so far begin
        ids: list[int] = []  # and those pieces, -1 for a character's bytes
        open_arcs: list[list[tuple[int, int]]] = []
        closed: set[int] = set()
        p, last, arcs = 0, -1, None
        while p < n:
            if arcs is None:
                node, q, arcs = trie, p, []
                for ch in unit[p:]:
                    node = node.get(ch)
                    if node is None:
                        break
                    q += 1
                    t = node.get("")
                    if t is not None:
                        arcs.append((q, t))
                if not arcs or arcs[0][0] != p + 1:
                    # byte fallback: no piece covers the character, so no cheaper path does
                    arcs.append((p + 1, -1))
            while arcs:
                q, t = arcs.pop()
                if q in closed:
                    continue
                if t < 0 or last < 0:
                    break
                fits = pairs(last * many + t)
                if fits or fits is None and self.side_by_side(last, t):
                    break
            else:
                closed.add(p)
                if not ids:
                    raise ValueError(f"no path through {unit!r}")
                p = places.pop()
                ids.pop()
                arcs = open_arcs.pop()
                last = ids[-1] if ids else -1
                continue
            places.append(p)
            ids.append(t)
            open_arcs.append(arcs)
            p, last, arcs = q, t, None
        if -1 not in ids:
            return ids
        out: list[int] = []
        for p, t in zip(places, ids):
            out += [t] if t >= 0 else [self.bytes.get(x, self.unknown) for x in unit[p].encode("utf-8", "surrogatepass")]
        return out

    def path(self, unit: str) -> bytes:
        found = self.paths.get(unit)
        if found is None:
            found = self.older.get(unit) or array("i", self.shortest_path(unit)).tobytes()
            if len(unit) <= LONGEST:
                if len(self.paths) >= REMEMBERED:
                    self.paths, self.older = {}, self.paths
                self.paths[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids as 32-bit integers in native byte order."""
        if not text:
            return b""
        known, path = self.paths.get, self.path
        return b"".join([known(u) or path(u) for u in self.units(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids: list[int]) -> str:
        surface, n = self.surface, len(self.surface)
        text = b"".join([surface[i] if 0 <= i < n else b"" for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _machine(sent) -> Transducer:
    """The worker's machine: it lives as long as the broadcast value it is kept in."""
    held = sent.value
    if "machine" not in held:
        held["machine"] = Transducer(held["model"])
    return held["machine"]


def encode(df: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array ``ids`` of the text's piece ids."""
    sent = df.sparkSession.sparkContext.broadcast({"model": read_model(model)})

    def fill(part):
        machine = _machine(sent)
        coded = [machine.encode(t or "") for t in part.column(text).to_pylist()]
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))]

    return appended(df, {ids: T.ArrayType(T.IntegerType())}, fill)


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the string ``text`` that the ids stand for; null and empty ids give an empty text."""
    sent = df.sparkSession.sparkContext.broadcast({"model": read_model(model)})

    def fill(part):
        machine = _machine(sent)
        column = part.column(ids)
        values, ends = column.values.fill_null(-1).to_numpy(), column.offsets.to_numpy()
        return [pa.array([machine.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())]

    return appended(df, {text: T.StringType()}, fill)


def encode_decode(df: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` into the column ``back``, in one pass."""
    sent = df.sparkSession.sparkContext.broadcast({"model": read_model(model)})

    def fill(part):
        machine = _machine(sent)
        coded = [machine.encode(t or "") for t in part.column(text).to_pylist()]
        values = np.frombuffer(b"".join(coded), np.int32)
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
        texts = [machine.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(texts, pa.string())]

    return appended(df, {ids: T.ArrayType(T.IntegerType()), back: T.StringType()}, fill)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = encode_decode(docs)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))).alias("round_trip"),
    )
