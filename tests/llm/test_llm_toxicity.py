"""Operator 2: quotations, and its whole score against a plain version."""
import math
import random

import pytest
from llm_helpers import docs, prose, words_alnum
from test_llm_models import edits, toxic_corpus

from ecotally.llm import toxicity


@pytest.mark.parametrize("text,quoted", [
    ("you idiot", False), ('he "idiot" x', True), ("“you idiot” x", True), ("„du idiot“ x", True), ("« idiot »", True), ("»idiot«", True),
    ("‘an idiot’ x", True), ("don’t be an idiot, you can’t win", False), ('"Hi" he went. You idiot! "Bye" he left', False),
    ('a 5" screen, idiot, and a 7" one', False), ('say "one" idiot "two"', False), ('"open idiot', False), ('idiot" x', False),
    ("“one” idiot “two”", False), ("it’s the dogs’ idiot, isn’t it’s", False), ('(“idiot”)', True), ('"a" "b idiot c" "d"', True),
    ('"' + "x " * 600 + "idiot" + '"', False),
])
def test_quotations(text, quoted):
    at = text.index("idiot")
    spans = toxicity.quotations(text)
    share = toxicity.quoted_share(text, spans, [s for s, _ in spans], at)
    assert share == (toxicity.QUOTED if quoted else 0.0)


def test_reporting_words_make_quotations_whole():
    text = "She said: “you idiot”."
    spans = toxicity.quotations(text)
    assert toxicity.quoted_share(text, spans, [s for s, _ in spans], text.index("idiot")) == 1.0


def test_marks_without_end_take_linear_time():
    assert toxicity.quotations('"x ' * 300_000) == []


def plain_score(text, model):
    """The score, with every term compared to every word and quotations looked up per hit."""
    lexicon, (common, _, fuzzy), weights = model
    whole, hits = text or "", []
    place = 0
    for w in words_alnum(whole):
        place = whole.lower().index(w, place)
        best = None
        for term, weight in lexicon.items():
            if term.endswith("*"):
                continue
            e = edits(w, term)
            value = fuzzy.get(term, weight) if e else weight
            if e <= toxicity.edits_allowed(term) and (not e or value > 0):
                best = max(best, (-e, value, term)) if best else (-e, value, term)
        stems = [weight for term, weight in lexicon.items() if term.endswith("*") and w.startswith(term[:-1])]
        if stems and (best is None or best[0] < 0):
            # the longest beginning is the one that counts
            best = (0, lexicon[max((t for t in lexicon if t.endswith("*") and w.startswith(t[:-1])), key=len)], "")
        if best and best[0] and w in common:
            best = None
        if best:
            hits.append((place, place + len(w), best[1] * toxicity.KEPT_AN_EDIT ** -best[0]))
        place += len(w)
    spans = toxicity.quotations(whole)
    direct = quoted = strongest = dense = 0
    for k, (start, end, weight) in enumerate(hits):
        share = toxicity.quoted_share(whole, spans, [s for s, _ in spans], start)
        quoted, direct, strongest = quoted + weight * share, direct + weight * (1 - share), max(strongest, weight * (1 - share))
        dense += bool(k and start - hits[k - 1][1] <= toxicity.WINDOW)
    features = [math.log1p(direct), math.log1p(quoted), math.log1p(dense), strongest, 1.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(features, weights))))


def test_scores_equal_a_plain_version(spark):
    """Learned from misspellings and quotations, over texts with both."""
    rnd = random.Random(11)
    rows, marks = toxic_corpus(rnd)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert model[2][toxicity.FEATURES.index("quoted")] > 0  # no row has a quotation: the prior stands
    shapes = ["{}", "“{}”", 'she said "{}" to him', "don’t {} can’t", "{} {}", "«{}» {}"]
    test = [(0, None), (1, ""), (2, "é " * 200)]
    for i in range(3, 120):
        words = []
        for _ in range(2):
            w = list(rnd.choice(["blockhead", "nitwit", "dunderhead", "w7"]))
            for _ in range(rnd.randrange(3)):
                k = rnd.randrange(max(1, len(w)))
                w[k : k + 2] = rnd.choice([w[k : k + 2][::-1], ["x"], [], w[k : k + 2]])
            words.append("".join(w) or "w1")
        test.append((i, f"{prose(rnd, 6)} {rnd.choice(shapes).format(*words)} {prose(rnd, rnd.choice([2, 30]))} {words[1] if i % 4 == 0 else ''}"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, test), *model).collect()}
    assert set(got) == {i for i, _ in test}
    for i, t in test:
        assert got[i] == pytest.approx(plain_score(t, model), abs=1e-9), t
    # abuse beside apostrophes and other quotations is abuse; the same words quoted are less
    pair = [(1, "don’t be a blockhead, you can’t win"), (2, '"Hi" he went. You blockhead! "Bye" he left'), (3, "she said “you blockhead” there")]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, pair), *model).collect()}
    assert found[1] >= 0.5 and found[2] >= 0.5 and found[3] < min(found[1], found[2])


def test_lexicon_has_no_cap(spark):
    """More terms than any fixed number would keep: each toxic row has one of 2,500."""
    word = lambda k: "z" + "".join(chr(97 + k // 26**p % 26) for p in range(3))  # noqa: E731 - too short for a beginning
    rows = [(i, f"plain words here {word(i // 4)} {i}") for i in range(10_000)] + [(20_000 + i, "plain words here") for i in range(9_000)]
    frame = spark.createDataFrame([(t.encode(), int(i < 20_000)) for i, t in rows], "text binary, toxic int")
    assert sum(not t.endswith("*") for t in toxicity.learn_lexicon(frame, least_odds=5.0)) == 2_500


def test_greedy_cover_equals_the_plain_one():
    rnd = random.Random(3)
    for _ in range(30):
        odds = {f"t{k}" + "*" * (k % 3 == 0): rnd.choice([3.0, 4.0, 5.5]) for k in range(25)}
        held = [rnd.sample(sorted(odds), rnd.randrange(1, 6)) for _ in range(60)]
        where = {t: {k for k, h in enumerate(held) if t in h} for t in odds}
        want = []
        while where:
            best = max(where, key=lambda t: (len(where[t]) * odds[t], not t.endswith("*"), t))
            gone = where.pop(best)
            if len(gone) < 3:
                where.pop(best, None)
                continue
            want.append(best)
            where = {t: x - gone for t, x in where.items()}
        assert toxicity.explaining(held, odds, 3) == want
