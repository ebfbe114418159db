"""License scans as an exact set-similarity join (operator 9).

Templates are small token sets, text blocks are lines and, across line breaks,
windows of ``WIDTH`` times a template's words.  A block meets a template when it
holds at least ``CONTAINMENT`` of the template's tokens.  The tokens of each template stand in one global order, rarest in the corpus first,
so a block that meets it must hold one of its first ``size - needed + 1``
tokens (prefix filter), must have ``needed`` tokens at all (length filter), and
the first match must leave enough tokens behind it (positional filter).  What
passes is counted exactly.

Base phrases are found at every place where their words stand consecutively.
Null and empty texts have no words and no labels; rows that repeat a document, or
lack a doc_id, are scanned each.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, batch, doc_bytes, table, words_alnum

#: Base phrases and their labels (fixed values).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Wordings of well-known notices; the labels they add start with ``notice:``.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "copyright": "copyright all rights reserved",
}
CONTAINMENT = 0.85
#: Words of a window across line breaks, by words of the template.
WIDTH = 2


def needed(size: int, containment: float) -> int:
    """Least number of a template's tokens that a block must hold."""
    return max(1, -int(-size * containment // 1))


def token_counts(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many rows of ``docs`` each template token stands (a row per token comes back)."""
    vocabulary = {w.encode() for t in templates.values() for w in t.split()}

    def counted(batches):
        schema = pa.schema([("token", pa.string()), ("n", pa.int64())])
        n: Counter[bytes] = Counter()
        for b in batches:
            for raw in b.column("text").to_pylist():
                n.update(vocabulary.intersection(words_alnum(raw)))
        yield batch(schema, token=[w.decode() for w in n], n=list(n.values()))

    rows = doc_bytes(docs).mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"].encode(): r["n"] for r in rows.collect()}


class TemplateIndex:
    """Prefix postings of the templates under the global order."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], containment: float = CONTAINMENT):
        self.sets, self.needed, self.postings, self.width = {}, {}, {}, {}
        for label, wording in templates.items():
            tokens = sorted({w.encode() for w in wording.split()}, key=lambda w: (counts.get(w, 0), w))
            least = needed(len(tokens), containment)
            self.sets[label], self.needed[label] = frozenset(tokens), least
            self.width[label] = WIDTH * len(wording.split())
            for place, token in enumerate(tokens[: len(tokens) - least + 1]):
                self.postings.setdefault(token, []).append((label, place))
        self.prefix = frozenset(self.postings)

    def blocks(self, text: bytes):
        """``(line, label, containment)`` of every line and template that meet, and of
        every window across line breaks, by the line it begins on."""
        lines = [line.translate(ALNUM).split() for line in text.split(b"\n")]
        met: dict[str, set[int]] = {}
        for number, line in enumerate(lines):
            block = set(line)
            seen: dict[str, int] = {}
            for token in self.prefix & block:
                for label, place in self.postings[token]:
                    seen[label] = min(place, seen.get(label, place))
            for label, place in seen.items():
                own, least = self.sets[label], self.needed[label]
                if len(block) >= least and len(own) - place >= least:
                    held = len(own & block)
                    if held >= least:
                        met.setdefault(label, set()).add(number)
                        yield number, label, held / len(own)
        every = set().union(*lines)
        for label in sorted({label for token in self.prefix & every for label, _ in self.postings[token]}):
            own = self.sets[label]
            if len(lines) > 1 and len(own & every) >= self.needed[label]:
                for number, held in self._wrapped(lines, label, met.get(label, set())):
                    yield number, label, held / len(own)

    def _wrapped(self, lines: list[list[bytes]], label: str, met: set[int]):
        """``(line, tokens held)`` of the windows that meet the template without the
        lines ``met``, which do so alone; of windows that overlap,
        the one that holds most, the shortest of these."""
        own, least, width = self.sets[label], self.needed[label], self.width[label]
        places, before = [], 0
        for number, line in enumerate(lines):
            if number not in met:
                places += [(before + i, w, number) for i, w in enumerate(line) if w in own]
            before += len(line)
        inside: Counter[bytes] = Counter()
        left, best, rank, end = 0, None, (0, 0), 0
        for at, token, _ in places:
            inside[token] += 1
            while at - places[left][0] >= width or inside[places[left][1]] > 1:
                gone = places[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if best and places[left][0] > end:
                yield best
                best = None
            now = len(inside), places[left][0] - at
            if len(inside) >= least and (best is None or now > rank):
                best, rank, end = (places[left][2], len(inside)), now, at
        if best:
            yield best


def phrase_starts(words: list[bytes], phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively."""
    line, sought = b" " + b" ".join(words) + b" ", f" {phrase} ".encode()
    starts, at = [], line.find(sought)
    while at >= 0:
        starts.append(line.count(b" ", 0, at))
        at = line.find(sought, at + 1)
    return starts


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, ``places`` (phrase label, start word) and
    ``blocks`` (line number, template, containment)."""
    templates = TEMPLATES if templates is None else templates
    index = TemplateIndex(templates, token_counts(docs, templates), containment)
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    block = pa.struct([("line", pa.int64()), ("template", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("blocks", pa.list_(block))])
    firsts = {p: frozenset(w.encode() for w in p.split()) for p in PHRASES}

    def scanned(batches):
        for b in batches:
            n, places, blocks = [], [], []
            for raw in b.column("text").to_pylist():
                words = words_alnum(raw)
                held = set(words)
                n.append(len(words))
                places.append([
                    {"label": PHRASES[p], "word": at}
                    for p in PHRASES if firsts[p] <= held for at in phrase_starts(words, p)
                ])
                blocks.append([
                    {"line": i, "template": label, "containment": c} for i, label, c in index.blocks(raw)
                ] if not index.prefix.isdisjoint(held) else [])
            yield batch(schema, doc_id=b.column("doc_id"), n_words=n, places=places, blocks=blocks)

    return doc_bytes(docs).mapInArrow(
        scanned,
        "doc_id long, n_words long, places array<struct<label:string,word:long>>,"
        " blocks array<struct<line:long,template:string,containment:double>>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words",
        "cast(size(places) as long) as n_base",
        "array_min(transform(places, x -> x.word)) as first_word",
        "array_max(transform(places, x -> x.word)) as last_word",
        "concat_ws(',', array_sort(array_distinct(transform(places, x -> x.label)))) as base_labels",
        "concat_ws(',', array_sort(array_distinct(concat(transform(places, x -> x.label),"
        " transform(blocks, x -> concat('notice:', x.template)))))) as labels",
        "cast(coalesce(array_max(transform(blocks, x -> x.containment)), if(size(places) > 0, 1.0, 0.0)) as double) as score",
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Lines, and windows that end at each of a template's tokens in the other lines, all
#: compared with all templates: no filter and no index.
ORACLE_SQL = rf"""
WITH phrases(phrase, label) AS (VALUES {_values(PHRASES.items())}),
templates(label, token) AS (VALUES {_values((label, w) for label, t in TEMPLATES.items() for w in sorted(set(t.split())))}),
sizes(label, least, size, width) AS (VALUES {_values((label, needed(len(set(t.split())), CONTAINMENT), len(set(t.split())), WIDTH * len(t.split())) for label, t in TEMPLATES.items())}),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_no, line, regexp_extract_all(translate(lines[line], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS line FROM docs)),
words AS (
  SELECT row_no, line, w[i] AS token, before + i - 1 AS pos
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY row_no ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines))),
follow AS (
  SELECT row_no, pos, token, lead(token, 1) OVER o AS t1, lead(token, 2) OVER o AS t2 FROM words WINDOW o AS (PARTITION BY row_no ORDER BY pos)),
places AS (
  SELECT f.row_no, f.pos, p.label FROM follow f JOIN phrases p
  ON p.phrase = concat_ws(' ', token, t1) OR p.phrase = concat_ws(' ', token, t1, t2)),
base AS (
  SELECT row_no, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM places GROUP BY row_no),
held AS (SELECT row_no, line, t.label, count(DISTINCT token) AS n FROM words JOIN templates t USING (token) GROUP BY ALL),
met AS (SELECT row_no, line, label, n, size FROM held JOIN sizes USING (label) WHERE n >= least),
spread AS (
  SELECT w.row_no, w.pos, w.token, t.label FROM words w JOIN templates t USING (token)
  WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.row_no = w.row_no AND m.line = w.line AND m.label = t.label)),
windows AS (
  SELECT a.row_no, a.label, a.pos, count(DISTINCT b.token) AS n FROM spread a JOIN spread b ON a.row_no = b.row_no AND a.label = b.label
  JOIN sizes s ON s.label = a.label AND b.pos <= a.pos AND b.pos > a.pos - s.width GROUP BY ALL),
blocks AS (
  SELECT row_no, label, n / size::DOUBLE AS containment FROM met
  UNION ALL SELECT row_no, label, n / size::DOUBLE FROM windows JOIN sizes USING (label) WHERE n >= least),
notices AS (SELECT row_no, list(DISTINCT 'notice:' || label) AS more, max(containment) AS score FROM blocks GROUP BY row_no)
SELECT d.doc_id, (SELECT count(*) FROM words x WHERE x.row_no = d.row_no) AS n_words, coalesce(n_base, 0) AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_concat(coalesce(own, []), coalesce(more, []))), ','), '') AS labels,
       coalesce(score, CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM docs d LEFT JOIN base USING (row_no) LEFT JOIN notices USING (row_no)
"""
