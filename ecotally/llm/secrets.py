"""Secret scans with character Markov models (operator 5).

Three patterns give the base spans.  Beside them every long run of credential
characters is scored by two first-order character models, one of random
strings and one of ordinary identifiers, and reported as ``markov`` when the
log-likelihood ratio speaks for random.  The labelled samples come from the
corpus: values that a base pattern found are the random strings, other words
the ordinary ones.

Null and empty texts have no spans.  Repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, batch, doc_bytes, table

ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is one match, so a shorter one only drops out
KINDS = ("assign", "access", "hex", "markov")

#: Characters of credentials; everything else ends a candidate.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Letters, digits and joiners of at least so many characters are candidates.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
PIECE = re.compile(r"[A-Za-z0-9]+")
#: Documents (about) that the two models are trained on.
TRAIN_DOCS = 20_000
#: Mean log-likelihood ratio per character from which a run counts as random.
LEAST_RATIO = 0.5

_CODE = np.full(256, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_STATES = len(ALPHABET) + 1  # the last is the start


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``(start, kind, end, value start, value end)`` of the base patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start(), m.end()))
    return sorted(found)


def transitions(s: str) -> np.ndarray:
    """Codes ``previous * states + next`` of a run's characters, the start included."""
    c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    prev = np.empty_like(c)
    prev[0], prev[1:] = len(ALPHABET), c[:-1]
    return prev * _STATES + c


def _counted(batches):
    """Transition counts of the partition: class (1 random), code, count."""
    schema = pa.schema([("random", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])
    counts = np.zeros((2, _STATES * _STATES), np.int64)
    for b in batches:
        for raw in b.column("text").to_pylist():
            text = raw.decode("utf-8")
            spans = [(s, e) for _, _, _, s, e in base_spans(text)]
            taken = 0
            for s, e in spans:
                run = "".join(c for c in text[s:e] if c in ALPHABET)
                if run:
                    counts[1] += np.bincount(transitions(run), minlength=_STATES * _STATES)
            words = []
            for m in ORDINARY.finditer(text):
                while taken < len(spans) and spans[taken][1] <= m.start():
                    taken += 1
                if taken == len(spans) or m.end() <= spans[taken][0]:
                    words.append(m.group())
            if words:
                # one pass over all words: a separator resets the state to the start
                c = _CODE[np.frombuffer(" ".join(words).encode("ascii"), np.uint8)]
                prev = np.concatenate(([len(ALPHABET)], c[:-1]))
                counts[0] += np.bincount((prev * _STATES + c)[c < len(ALPHABET)], minlength=_STATES * _STATES)
    for k in (0, 1):
        at = np.flatnonzero(counts[k])
        yield batch(schema, random=np.full(len(at), k, np.int32), code=at, n=counts[k][at])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of every transition.

    The counts, at most two per pair of characters, are all that reaches the driver.
    """
    sample = about(doc_bytes(docs), "doc_id", train_docs)
    rows = (
        sample.mapInArrow(_counted, "random int, code long, n long")
        .groupBy("random", "code").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.ones((2, _STATES * _STATES))
    for r in rows:
        counts[r["random"], r["code"]] += r["n"]
    # a sample without secrets: letters and digits of all kinds are alike in a random string
    counts[1] += 0.5
    by_state = counts.reshape(2, _STATES, _STATES)[:, :, :-1]
    logs = np.log(by_state / by_state.sum(axis=2, keepdims=True))
    ratio = np.zeros((_STATES, _STATES))
    ratio[:, :-1] = logs[1] - logs[0]
    return ratio.ravel()


def random_parts(s: str, ratio: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Parts of a run, of ``LEAST`` characters or more, whose mean ratio reaches ``least``:
    the whole run, or else the pieces between joiners, one or several in a row, that
    exceed it most, and so on beside them.  Joiners within such a part speak for
    neither side, and each piece starts anew."""
    if ratio[transitions(s)].mean() >= least:
        return [(0, len(s))]
    pieces = [m.span() for m in PIECE.finditer(s)]
    x = np.zeros(len(s))
    for lo, hi in pieces:
        x[lo:hi] = ratio[transitions(s[lo:hi])]
    sums = np.concatenate(([0.0], np.cumsum(x - least)))
    starts, ends = np.array(pieces, np.int64).reshape(-1, 2).T
    found, todo = [], [(0, len(pieces))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi or ends[hi - 1] - starts[lo] < LEAST:
            continue
        lows = np.minimum.accumulate(sums[starts[lo:hi]])
        fits = np.searchsorted(starts[lo:hi], ends[lo:hi] - LEAST, "right")  # starts far enough from each end
        gain = np.where(fits > 0, sums[ends[lo:hi]] - lows[fits - 1], -np.inf)
        last = int(gain.argmax())
        if gain[last] < 0:
            continue
        first = int(sums[starts[lo : lo + fits[last]]].argmin())
        start, end = int(starts[lo + first]), int(ends[lo + last])
        if not _plain(s[start:end]):
            found.append((start, end))
        todo += [(lo, lo + first), (lo + last + 1, hi)]
    return sorted(found)


def _plain(s: str) -> bool:
    """Letters of one case alone are words in some language, however rare their pairs."""
    return s.isalpha() and (s.islower() or s[1:].islower())


def markov_spans(text: str, base: list, ratio: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Random parts of the candidate runs and, where base spans lie in a run, of what is left beside them."""
    found = []
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        lo, k, pieces = m.start(), at, []
        while k < len(base) and base[k][0] < m.end():
            pieces.append((lo, base[k][0]))
            lo, k = max(lo, base[k][2]), k + 1
        for lo, hi in [*pieces, (lo, m.end())]:
            if hi - lo >= LEAST and not _plain(text[lo:hi]):
                found += [(lo + a, lo + b) for a, b in random_parts(text[lo:hi], ratio, least)]
    return found


def scan(docs: DataFrame, ratio: np.ndarray, least: float = LEAST_RATIO) -> DataFrame:
    """Per row ``doc_id`` and ``found``: array of (kind, start, end), by start, then kind as in ``KINDS``."""

    def scanned(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(span))])
        for b in batches:
            out = []
            for raw in b.column("text").to_pylist():
                text = raw.decode("utf-8")
                base = base_spans(text)
                spans = [(s, k, e) for s, k, e, _, _ in base]
                spans += [(s, 3, e) for s, e in markov_spans(text, base, ratio, least)]
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            yield batch(schema, doc_id=b.column("doc_id"), found=out)

    return doc_bytes(docs).mapInArrow(
        scanned, "doc_id long, found array<struct<kind:string,start:long,end:long>>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    line = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    n = "cast(size(filter(found, x -> x.kind = '{0}')) as long) as n_{0}"
    return found.selectExpr(
        "doc_id", *(n.format(k) for k in KINDS),
        f"sha2({line.format("filter(found, x -> x.kind != 'markov')")}, 256) as base_sha256",
        f"{line.format('found')} as spans",
    )


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """The base digest from spans in order; for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
