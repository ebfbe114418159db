"""Toxicity scores from a learned lexicon, misspellings and context (operator 2).

The lexicon comes from labelled rows: words, and word beginnings, that are far
more frequent in toxic documents.  A trie holds it; its intersection with the
Levenshtein automaton of an edit bound is a deterministic automaton whose
states are made when a word first needs them, so a word is looked up, exactly
or misspelled, by following its characters until the automaton has no state.
An edit adds, leaves out or replaces a character, or swaps two neighbours.

Every hit looks at its context: it counts as a quotation, in part, where it stands
between an opening mark and the closing one that belongs to it, and wholly where
a reporting word stands beside the quotation; further hits nearby speak for abuse.
A logistic model turns the summed evidence of a document into its score.  What
quoted evidence weighs is learned, starting from a share of the other's weight.
Texts without any hit, empty and null ones included, share the score of no evidence.

Rows that repeat a document are scored each; a null doc_id has a null held_out
and is learned from by nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from heapq import heapify, heappop, heappush
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, about, batch, table, text_bytes, words_alnum

#: Labelled rows (about) that lexicon and model are learned from.
TRAIN_DOCS = 40_000
#: A term must stand in so many toxic training documents, and be so much likelier there.
LEAST_DOCS, LEAST_ODDS = 4, 25.0
#: Lengths of the word beginnings that may become terms.
STEMS = (4, 5, 6, 7)
#: Characters of context on both sides of a hit or a quotation.
WINDOW = 60
#: Quotation marks that open, and what closes them.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
#: A mark without its like within so many characters opens nothing.
LONGEST_QUOTATION = 1_000
#: Share of a hit's weight that counts as quoted between marks alone; with a reporting word it is all.
QUOTED = 0.5
#: What quoted evidence weighs of the other before labelled rows say otherwise.
QUOTED_PRIOR = 0.25
REPORTING = frozenset(
    "said says quoted quote called wrote writes told claimed reported sagte schrieb zitat dit écrit citation dijo escribió cita".split()
)
#: Labelled misspellings that a term's own odds count for in the weight of its misspellings.
PRIOR_HITS = 1.0
#: Words whose verdict a task remembers.
REMEMBERED = 400_000
#: What a hit keeps of its weight per edit.
KEPT_AN_EDIT = 0.8
FEATURES = ("direct", "quoted", "dense", "strongest")


def edits_allowed(term: str) -> int:
    """Short terms must match as they are; each further four characters admit an edit, two at most."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The trie of the terms intersected with Levenshtein automata.

    A state is a set of (trie node, edits spent, character owed): after the second
    of two swapped characters the first is owed, and nothing else may follow.
    Transitions are computed once and kept.  Terms ending in ``*`` match every word
    that begins with them, without edits.  ``fuzzy`` has the weights of misspelled
    terms, a term's own if it is not there; a misspelling that weighs nothing is no match.
    """

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, float] | None = None):
        self.children: list[dict[str, int]] = [{}]
        # weight, edits allowed, is a stem, term, weight misspelled
        self.ends: list[tuple[float, int, bool, str, float] | None] = [None]
        self.most: list[int] = [0]  # edits that any term below allows
        for term, weight in sorted(terms.items()):
            stem = term.endswith("*")
            word = term.rstrip("*")
            allowed, node = 0 if stem else edits_allowed(word), 0
            for ch in word:
                self.most[node] = max(self.most[node], allowed)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][ch]
            self.most[node] = max(self.most[node], allowed)
            if self.ends[node] is None or not stem:
                self.ends[node] = (weight, allowed, stem, term, (fuzzy or {}).get(term, weight))
        self.alphabet = {ch for c in self.children for ch in c}
        self._reset()

    def _reset(self):
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.verdict: list[tuple[float, int, str] | None] = []
        self.stem: list[tuple[float, int, str] | None] = []
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, pairs: set) -> frozenset:
        """With the edits that skip a character of the term; the least edits of a node suffice."""
        least: dict[tuple[int, str], int] = {}
        todo = list(pairs)
        while todo:
            node, e, owed = todo.pop()
            if e > self.most[node] or least.get((node, owed), 9) <= e:
                continue
            least[node, owed] = e
            if not owed:
                todo.extend((child, e + 1, "") for child in self.children[node].values())
        return frozenset((node, e, owed) for (node, owed), e in least.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs in self.number:
            return self.number[pairs]
        self.number[pairs] = k = len(self.states)
        self.states.append(pairs)
        self.step.append({})
        full = [
            (-e, x[4] if e else x[0], x[3]) for n, e, owed in pairs
            if not owed and (x := self.ends[n]) and not x[2] and e <= x[1] and (not e or x[4] > 0)
        ]
        stems = [(x[0], x[3]) for n, e, owed in pairs if not owed and (x := self.ends[n]) and x[2] and e == 0]
        self.verdict.append((max(full)[1], -max(full)[0], max(full)[2]) if full else None)
        self.stem.append((max(stems)[0], 0, max(stems)[1]) if stems else None)
        return k

    def _next(self, state: int, ch: str) -> int:
        pairs = set()
        for node, e, owed in self.states[state]:
            if owed:
                if ch == owed:
                    pairs.add((node, e, ""))
                continue
            pairs.add((node, e + 1, ""))  # ch is too many
            for c, child in self.children[node].items():
                pairs.add((child, e if c == ch else e + 1, ""))
                if c != ch and ch in self.children[child]:  # ch and c are swapped
                    pairs.add((self.children[child][ch], e + 1, c))
        closed = self._closed(pairs)
        return self._state(closed) if closed else -1

    def match(self, word: str) -> tuple[float, int, str] | None:
        """Weight and edits of the closest term, and the term; None if there is none."""
        if len(self.states) > 50_000:
            self._reset()
        state, stem = 0, None
        for ch in word:
            known = self.step[state]
            symbol = ch if ch in self.alphabet else ""
            state = known[symbol] if symbol in known else known.setdefault(symbol, self._next(state, symbol))
            if state < 0:
                return stem
            stem = self.stem[state] or stem
        found = self.verdict[state]
        return stem if found is None or stem and found[1] else found


class _Remembered(dict):
    """Verdicts of words, computed on first sight; ``ordinary`` words are no misspellings."""

    def __init__(self, lexicon: FuzzyLexicon, ordinary: frozenset = frozenset()):
        super().__init__()
        self.lexicon, self.ordinary = lexicon, ordinary

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        s = word.decode("utf-8", "replace").lower()
        found = self.lexicon.match(s)
        if found and found[1] and s in self.ordinary:
            found = None
        self[word] = found
        return found


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


_MARK = re.compile(f"[{''.join(CLOSING)}{''.join(set(''.join(CLOSING.values())))}]")
_PLAIN = re.compile(r"\w+")


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the opening and closing marks of each quotation, in order.

    A mark between two letters is an apostrophe.  Marks that look alike on both sides
    open before a character that is no space and close behind one.
    """
    found, opened = [], None
    for m in _MARK.finditer(text):
        mark, at = m[0], m.start()
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if before.isalpha() and after.isalpha():
            continue
        alike = CLOSING.get(mark) == mark
        closes = opened is not None and mark in CLOSING[text[opened]] and at - opened <= LONGEST_QUOTATION
        if closes and not (alike and before.isspace()):
            found.append((opened, at))
            opened = None
        elif mark in CLOSING and not before.isalnum() and not (alike and (not after or after.isspace())):
            opened = at
    return found


def quoted_share(text: str, spans: list[tuple[int, int]], starts: list[int], at: int) -> float:
    """How far the hit at ``at`` is a quotation: not outside of quotations, ``QUOTED``
    inside, wholly with a reporting word within the window around the quotation."""
    k = bisect_right(starts, at) - 1
    if k < 0 or spans[k][1] < at:
        return 0.0
    start, end = spans[k]
    around = f"{text[max(0, start - WINDOW) : start]} {text[end + 1 : end + 1 + WINDOW]}".lower()
    return QUOTED if REPORTING.isdisjoint(_PLAIN.findall(around)) else 1.0


def evidence(text: bytes, known: _Remembered) -> list[float]:
    """The features of a text: evidence of hits that abuse and of hits in quotations,
    hits with another hit in their window, and the strongest hit."""
    words = words_alnum(text)
    if not any([known[w] for w in words]):
        return [0.0] * len(FEATURES)
    whole = text.decode("utf-8", "replace")
    spans = quotations(whole)
    starts = [s for s, _ in spans]
    direct, quoted, dense, strongest, last = 0.0, 0.0, 0, 0.0, None
    for m in _WORD.finditer(whole):
        found = known[m.group().encode().translate(LOWER)]
        if found is None:
            continue
        weight = found[0] * KEPT_AN_EDIT ** found[1]  # found: weight, edits, term
        share = quoted_share(whole, spans, starts, m.start())
        quoted += weight * share
        direct += weight * (1 - share)
        strongest = max(strongest, weight * (1 - share))
        if last is not None and m.start() - last <= WINDOW:
            dense += 1
        last = m.end()
    return [log1p(direct), log1p(quoted), log1p(dense), strongest]


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Text and label of about ``train_docs`` labelled rows that are not held out."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sample = about(marks, "doc_id", train_docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).join(
        F.broadcast(sample), "doc_id"  # bounded by train_docs
    ).select("text", "toxic")


def terms_of(words: set[bytes]) -> set[str]:
    """A document's candidate terms: its words and their beginnings."""
    out = set()
    for w in words:
        s = w.decode("utf-8", "replace").lower()
        if len(s) < 3 or s.isdigit():
            continue
        out.add(s)
        out.update(s[:k] + "*" for k in STEMS if len(s) > k)
    return out


def _term_counts(rows: DataFrame, toxic: int) -> DataFrame:
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def counted(batches):
        n: Counter[str] = Counter()
        for b in batches:
            for raw in b.column("text").to_pylist():
                n.update(terms_of(set(words_alnum(raw))))
                if len(n) > 1_000_000:
                    yield batch(schema, term=list(n), n=list(n.values()))
                    n.clear()
        yield batch(schema, term=list(n), n=list(n.values()))

    return (
        rows.filter(F.col("toxic") == toxic).select("text").mapInArrow(counted, "term string, n long")
        .groupBy("term").agg(F.sum("n").alias("n"))
    )


def learn_lexicon(rows: DataFrame, least_docs: int = LEAST_DOCS, least_odds: float = LEAST_ODDS) -> dict[str, float]:
    """Terms and weights (log odds).  Spark counts all terms; those that are likely
    enough reach the driver, bounded by the training rows."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return {}
    both = _term_counts(rows, 1).filter(F.col("n") >= least_docs).join(
        _term_counts(rows, 0).withColumnRenamed("n", "n_clean"), "term", "left"
    )
    ratio = ((F.col("n") + 0.5) / (toxic + 1)) / ((F.coalesce("n_clean", F.lit(0)) + 0.5) / (clean + 1))
    likely = both.select("term", ratio.alias("ratio")).filter(F.col("ratio") >= least_odds)
    odds = {r["term"]: log(r["ratio"]) for r in likely.collect()}
    kept = explaining(_held_terms(rows, frozenset(odds)), odds, least_docs)
    if kept:
        # words that explain no document alone, but are as telling as the chosen ones
        level = sorted(odds[t] for t in kept)[len(kept) // 2] - log(2)
        chosen = set(kept)
        kept += [t for t in sorted(odds) if odds[t] >= level and t not in chosen and not t.endswith("*")]
    return {t: odds[t] for t in kept}


def neighbours(rows: DataFrame, lexicon: dict[str, float]) -> tuple[frozenset, frozenset, dict[str, float]]:
    """Words of clean training documents that only look like misspelled terms, those
    of them that several clean documents have, and the weights of misspelled terms.

    A weight is the log odds of the misspellings that a document would show if it
    alone had not been seen: words of no other clean document.  The term's own odds
    count for ``PRIOR_HITS`` of them.
    """
    schema = pa.schema([("word", pa.string()), ("term", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def seen(batches):
        known, found = _Remembered(FuzzyLexicon(lexicon)), Counter()
        for b in batches:
            for raw, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found.update({(w.lower(), x[2], toxic) for w in set(words_alnum(raw)) if (x := known[w]) and x[1]})
        yield batch(
            schema, word=[w.decode("utf-8", "replace").lower() for w, _, _ in found], term=[t for _, t, _ in found],
            toxic=[y for _, _, y in found], n=list(found.values()),
        )

    docs, hits = Counter(), Counter()
    looks = (
        rows.mapInArrow(seen, "word string, term string, toxic long, n long")
        .groupBy("word", "term", "toxic").agg(F.sum("n").alias("n")).collect()
    )
    for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        docs[int(r["toxic"] == 1)] += r["n"]
    clean = {r["word"]: r["n"] for r in looks if r["toxic"] == 0}
    for r in looks:
        if r["toxic"] == 1 and r["word"] not in clean:
            hits[r["term"], 1] += r["n"]
        elif r["toxic"] == 0 and r["n"] == 1:
            hits[r["term"], 0] += 1
    base, fuzzy = (docs[1] + 1) / (docs[0] + 1), {}
    for term in {t for t, _ in hits}:
        share = 1 / (1 + exp(-lexicon[term]) / base)  # of toxic documents among the term's own
        odds = (hits[term, 1] + PRIOR_HITS * share) / (hits[term, 0] + PRIOR_HITS * (1 - share))
        fuzzy[term] = min(lexicon[term], log(odds / base))
    return frozenset(clean), frozenset(w for w, n in clean.items() if n > 1), fuzzy


def _held_terms(rows: DataFrame, terms: frozenset) -> list[list[str]]:
    """The terms that each toxic training document holds, documents with the same
    words once; bounded by the training rows."""
    schema = pa.schema([("words", pa.int64()), ("terms", pa.list_(pa.string()))])

    def held(batches):
        for b in batches:
            sets = [set(words_alnum(t)) for t in b.column("text").to_pylist()]
            yield batch(
                schema, words=[xxhash.xxh3_64_intdigest(b" ".join(sorted(w))) >> 1 for w in sets],
                terms=[sorted(terms & terms_of(w)) for w in sets],
            )

    found = rows.filter("toxic = 1").select("text").mapInArrow(held, "words long, terms array<string>")
    return [r["terms"] for r in found.filter("size(terms) > 0").dropDuplicates(["words"]).collect()]


def explaining(held: list[list[str]], odds: dict[str, float], least_docs: int) -> list[str]:
    """Terms that cover the documents greedily: next the one with most evidence
    in documents without a chosen term, while it is new to ``least_docs`` of them.

    Words that stand beside a chosen term by chance explain nothing and stay out.
    """
    where: dict[str, set[int]] = {}
    for at, terms in enumerate(held):
        for t in terms:
            where.setdefault(t, set()).add(at)
    order = {t: k for k, t in enumerate(sorted(where, key=lambda t: (not t.endswith("*"), t)))}
    # a term's evidence only falls, so the first one that is still up to date is the best
    queue = [(-len(docs) * odds[t], -order[t], t) for t, docs in where.items() if len(docs) >= least_docs]
    heapify(queue)
    chosen: list[str] = []
    covered: set[int] = set()
    while queue:
        old, rank, t = heappop(queue)
        where[t] -= covered
        now = -len(where[t]) * odds[t]
        if now == old:
            chosen.append(t)
            covered |= where[t]
        elif len(where[t]) >= least_docs:
            heappush(queue, (now, rank, t))
    return chosen


def _features(
    rows: DataFrame, lexicon: dict[str, float], near: tuple[frozenset, frozenset, dict[str, float]], key: str, kind: str
) -> DataFrame:
    arrow = pa.int64() if kind == "long" else pa.int32()
    schema = pa.schema([(key, arrow), ("features", pa.list_(pa.float64()))])
    training = key == "toxic"
    common, several, fuzzy = near

    def featured(batches):
        fuzzily = FuzzyLexicon(lexicon, fuzzy)
        known = _Remembered(fuzzily, common)
        # a clean training document is read as if its own words had not made the list
        own = _Remembered(fuzzily, several) if training else known
        for b in batches:
            rows = zip(b.column(key).to_pylist(), b.column("text").to_pylist())
            yield batch(schema, **{
                key: b.column(key), "features": [evidence(t, own if training and k == 0 else known) for k, t in rows]
            })

    return rows.select(key, "text").mapInArrow(featured, f"{key} {kind}, features array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40, prior: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept.  Weights
    that the rows say nothing of are those of ``prior`` (0)."""
    x = np.column_stack((x, np.ones(len(x))))
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict, tuple, np.ndarray]:
    """Lexicon, its neighbours and weights.  ``train_docs`` rows of a few numbers reach the driver."""
    rows = training_rows(docs, labels, train_docs)
    lexicon = learn_lexicon(rows)
    near = neighbours(rows, lexicon)
    seen = _features(rows, lexicon, near, "toxic", "int").collect()
    if not seen:
        return lexicon, near, np.zeros(len(FEATURES) + 1)
    x, y = np.array([r["features"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    prior = np.zeros(len(FEATURES) + 1)
    prior[FEATURES.index("quoted")] = QUOTED_PRIOR * max(0.0, fit(x, y)[FEATURES.index("direct")])
    return lexicon, near, fit(x, y, prior=prior)


def score(docs: DataFrame, lexicon: dict[str, float], near: tuple[frozenset, frozenset, dict[str, float]], weights: np.ndarray) -> DataFrame:
    """Per row doc_id, features and score (0 to 1)."""
    w = [float(x) for x in weights]
    line = " + ".join(f"features[{i}] * {x!r}D" for i, x in enumerate(w[:-1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return _features(rows, lexicon, near, "doc_id", "long").withColumn(
        "score", F.expr(f"1D / (1D + exp(-({line} + {w[-1]!r}D)))")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
