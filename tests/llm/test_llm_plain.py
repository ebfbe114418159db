"""Operators 5, 7, 8, 9 and 10 and the pipeline: plain versions of whole results, repeated rows,
null ids, long texts and clashing columns."""
import random
import time
from collections import Counter

import numpy as np
import pytest
from llm_helpers import contained_items, docs, dropped_lines, prose

import corpus_pipeline
from ecotally.llm import decontaminate, language, licenses, linededup, secrets
from ecotally.llm.common import free_names, table

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------ secrets
def plain_parts(s, ratio, least):
    """As ``random_parts``: the piece range that exceeds ``least`` most, tried out one by one."""
    if ratio[secrets.transitions(s)].mean() >= least:
        return [(0, len(s))]
    pieces = [m.span() for m in secrets.PIECE.finditer(s)]
    gain = np.zeros(len(s)) - least
    for a, b in pieces:
        gain[a:b] += ratio[secrets.transitions(s[a:b])]

    def search(lo, hi):
        best = None
        for last in range(lo, hi):
            for first in range(lo, last + 1):
                a, b = pieces[first][0], pieces[last][1]
                if b - a >= secrets.LEAST and (best is None or gain[a:b].sum() > best[0] + 1e-9):
                    best = (gain[a:b].sum(), first, last)
        if best is None or best[0] < 0:
            return []
        a, b = pieces[best[1]][0], pieces[best[2]][1]
        own = [] if secrets._plain(s[a:b]) else [(a, b)]
        return own + search(lo, best[1]) + search(best[2] + 1, hi)

    return sorted(search(0, len(pieces)))


def test_markov_parts_equal_a_plain_search(spark):
    rnd = random.Random(8)
    chars = secrets.ALPHABET[:62]
    key = lambda n: "".join(rnd.choice(chars) for _ in range(n))
    words = ["static", "documents", "customerReports", "download", "archive", "x", "some", "Long", "NAME", "ab12"]
    ratio = secrets.train(docs(spark, [(i, f"{prose(rnd, 40)} some_long_name customerReports/archive token={key(24)}") for i in range(150)]))
    seen = 0
    for _ in range(400):
        run = rnd.choice("/_-=+").join(rnd.choice([rnd.choice(words), key(rnd.randrange(1, 24))]) for _ in range(rnd.randrange(1, 9)))
        if len(run) >= secrets.LEAST:
            got = secrets.random_parts(run, ratio, secrets.LEAST_RATIO)
            assert got == plain_parts(run, ratio, secrets.LEAST_RATIO), run
            seen += bool(got) and got != [(0, len(run))]
    assert seen > 40


def test_secret_models_equal_plain_counts(spark):
    rnd = random.Random(9)
    rows = [(i, f"word and-other w{i} secret={''.join(rnd.choice('abcXYZ019') for _ in range(20))} tail") for i in range(30)] + [(None, None), (7, "")]
    counts = {0: Counter(), 1: Counter()}
    for _, t in rows:
        spans = [(s, e) for _, _, _, s, e in secrets.base_spans(t or "")]
        for a, b in spans:
            counts[1].update(zip(["", *t[a:b]], t[a:b]))
        for m in secrets.ORDINARY.finditer(t or ""):
            if not any(a < m.end() and m.start() < b for a, b in spans):
                counts[0].update(zip(["", *m[0]], m[0]))
    ratio = secrets.train(docs(spark, rows)).reshape(secrets._STATES, secrets._STATES)
    places = {c: k for k, c in enumerate(secrets.ALPHABET)} | {"": len(secrets.ALPHABET)}
    for before in ["", "a", "X", "w", "0"]:
        sums = [sum(n for (p, _), n in counts[k].items() if p == before) + (1 + 0.5 * k) * len(secrets.ALPHABET) for k in (0, 1)]
        for after in "abXw09":
            share = [(counts[k][before, after] + 1 + 0.5 * k) / sums[k] for k in (0, 1)]
            assert ratio[places[before], places[after]] == pytest.approx(np.log(share[1] / share[0]))


def test_secrets_of_repeated_rows_and_null_ids(spark):
    text = "token=abcdefABCDEF0123 x"
    d = docs(spark, [(1, text), (1, text), (None, text), (None, None)])
    got = [(r["doc_id"], len([x for x in r["found"] if x["kind"] == "assign"])) for r in secrets.scan(d, secrets.train(d)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (None, 1), (None, 0)], key=repr)


# ----------------------------------------------------------------- language
def plain_profile(texts, length):
    """Codes of the most frequent 1- to 3-grams of the letters, by number, then code."""
    n = Counter()
    for text in texts:
        folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
        padded = " " + " ".join(folded.split()) + " "
        if not padded.strip():
            continue
        point = [0 if c == " " else ord(c) for c in padded]
        for k, c in enumerate(point):
            if c:
                n[c] += 1
            if k + 1 < len(point):
                n[c << 21 | point[k + 1] | 1 << 63] += 1
            if k + 2 < len(point) and point[k + 1]:
                n[(c << 42 | point[k + 1] << 21 | point[k + 2]) & (1 << 64) - 1] += 1
    return sorted(n, key=lambda g: (-n[g], g))[:length]


def plain_language(text, profiles, length):
    own = plain_profile([text or ""], length)
    if not own or not profiles:
        return "und", 0.0
    ranks = {lang: {g: k for k, g in enumerate(p)} for lang, p in profiles.items()}
    far = {lang: sum(abs(r[g] - k) if g in r else length for k, g in enumerate(own)) for lang, r in ranks.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - min(1.0, far[best] / (len(own) * length))


def test_language_equals_a_plain_version(spark):
    rnd = random.Random(12)
    vocabulary = {"aa": ["the", "house", "garden", "İx", "é"], "bb": ["das", "Haus", "Gärten", "straße", "und"], "cc": ["日本語", "東京", "a", "𠀀𠀁"]}
    rows = [(i, lang, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i, (lang, words) in enumerate(sorted(vocabulary.items()) * 40)]
    d = spark.createDataFrame([(i, t, lang) for i, lang, t in rows] + [(None, "house", "cc"), (900, None, "aa"), (901, "das", None)], "doc_id long, text string, lang string")
    train = {r["doc_id"] for r in d.filter("doc_id is not null").filter(~language.held_out()).collect()}
    profiles = {lang: plain_profile([t for i, x, t in rows if x == lang and i in train], 50) for lang in vocabulary}
    learned = language.train(d, profile=50)
    assert {lang: p.tolist() for lang, p in learned.items()} == profiles
    test = [(i, t) for i, _, t in rows] + [(500, None), (501, ""), (502, "1 2 ?"), (503, "the und 日本語"), (503, "the und 日本語"), (None, "das"), (504, "the house " * 60_000)]
    got = language.identify(docs(spark, test), learned, 50, ("l", "s")).select("doc_id", "text", "l", "s").collect()
    assert len(got) == len(test)
    for r in got:
        want = plain_language(r["text"], profiles, 50)
        assert (r["l"], pytest.approx(r["s"])) == (want[0], want[1])


# --------------------------------------------------------------- line dedup
@pytest.mark.parametrize("batches,fanout", [(1, 4), (9, 2), (7, 3)])
def test_line_dedup_over_many_batches_and_levels(spark, monkeypatch, batches, fanout):
    """Every batch is held against the runs before it; counts come from runs and updates."""
    rnd = random.Random(batches)
    rows = [(i, "\n".join(f"line {min(rnd.randrange(400), rnd.randrange(400))}" for _ in range(rnd.randrange(30)))) for i in range(150)]
    rows += [(3, rows[3][1]), (3, "other\nline 399"), (None, "line 7"), (None, "line 7\nline 8"), (200, None), (201, "")]
    seen, runs = [], []
    real, added = linededup.LineRuns._against_runs, linededup.LineRuns.add
    monkeypatch.setattr(linededup.LineRuns, "_against_runs", lambda self, x: seen.append(len(self.runs)) or real(self, x))
    monkeypatch.setattr(linededup.LineRuns, "add", lambda self, *a: (added(self, *a), runs.append(self))[0])
    monkeypatch.setattr(linededup.LineRuns.__init__, "__defaults__", (fanout,))
    monkeypatch.setattr(linededup.repeated, "__defaults__", (fanout,))
    got = linededup.drop_lines(docs(spark, rows).repartition(3), batches=batches).select("doc_id", "n_lines", "n_dropped", "kept")
    assert rows_of(got) == sorted(dropped_lines(rows), key=repr)
    assert len(seen) == batches and (batches == 1 or max(seen) > 0)
    last = runs[-1]
    if batches > fanout:
        assert len(last.levels) > 1 and any(last.levels[1:])
    keys = [tuple(r) for run in last.runs for r in run.select("h", "g").collect()]
    assert len(keys) == len(set(keys))  # no key in two runs


def test_long_repeated_texts_take_linear_time(spark):
    text = "\n".join(f"line {k}" for k in range(200_000))
    d = docs(spark, [(i, text) for i in range(10)] + [(20, "own\nline 5")])
    start = time.time()
    got = linededup.drop_lines(d).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert time.time() - start < 60
    assert {tuple(r) for r in got} == {(i, 200_000, 200_000, "") for i in range(10)} | {(20, 2, 1, "own")}


def test_line_hashes_are_independent(spark):
    """Equal first hashes do not bring about equal second ones: the seeds differ."""
    row = spark.sql("select 'a' as line").select(linededup.hashes_of(linededup.F.col("line"), 1).alias("k")).select("k.*").first()
    assert row["g"] != spark.sql(f"select xxhash64({row['h']}L) as x").first()["x"] != row["h"]
    assert row["g"] == spark.sql("select xxhash64(1, 'a') as x").first()["x"]


# ------------------------------------------------------------ licences, leaks
def test_licences_of_repeated_rows_and_null_ids(spark):
    text = "Released under\nthe MIT License. cc by"
    got = [(r["doc_id"], len(r["places"]), [b["template"] for b in r["blocks"]]) for r in licenses.scan(docs(spark, [(1, text), (1, text), (None, text), (None, None)])).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, ["mit"])] * 2 + [(None, 1, ["mit"]), (None, 0, [])], key=repr)


def test_item_blocks_hold_all_items_within_the_bound(spark):
    rnd = random.Random(1)
    items = spark.createDataFrame([(i, prose(rnd, rnd.randrange(0, 60))) for i in range(200)], "item_id long, text string").repartition(5)
    blocks = decontaminate.item_blocks(items, 100).collect()
    sizes = Counter()
    for r in blocks:
        sizes[r["block"]] += len(r["hashes"])
    assert len(blocks) == sum(bool(r["text"]) for r in items.collect()) and len(sizes) > 10
    assert max(sizes.values()) < 100 + 60 and sorted(sizes) == list(range(len(sizes)))


@pytest.mark.parametrize("block", [2_000_000, 9])
def test_marked_keeps_rows_and_columns(spark, block):
    """Repeated rows, null ids, repeated items in several blocks, and columns named like the operator's own."""
    passage = "one two three four five six seven eight"
    rows = [(1, f"x {passage} y"), (1, f"x {passage} y"), (None, passage), (2, None), (3, "none of it")]
    frame = spark.createDataFrame([(i, t, "a", 1, 2.5, [1]) for i, t in rows], "doc_id long, text string, own string, hits int, row_hash double, items array<int>")
    items = spark.createDataFrame([(k, passage) for k in (5, 5, 6, 7)] + [(8, "unrelated words that stand nowhere else")], "item_id long, text string")
    got = decontaminate.marked(frame, items, block=block, name="leaks")
    assert got.columns == [*frame.columns, "leaks"]
    assert sorted((r["doc_id"], sorted(x["item_id"] for x in r["leaks"])) for r in got.filter("doc_id is not null").collect()) == [
        (1, [5, 5, 6, 7]), (1, [5, 5, 6, 7]), (2, []), (3, [])]
    assert [[*r[:6]] for r in got.filter("doc_id = 2").collect()] == [[2, None, "a", 1, 2.5, [1]]]
    flat = decontaminate.contained(frame, items, block=block).select("doc_id", "item_id", "n_item", "n_shared")
    assert rows_of(flat) == contained_items(rows, [(r["item_id"], r["text"]) for r in items.collect()])


# ----------------------------------------------------------------- pipeline
NAMES = ("_score _lang _text _dropped _items _own _own_hash _gone _lines _kept _before found_lang FOUND_SCORE kept_text lines_dropped benchmark_items "
         "own gone lines left hits row at k h g batch seen").split() + ["two words", "ü"]


def test_free_names():
    assert free_names(["a", "_A", "b"], "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]


def test_stages_leave_columns_of_any_name_alone(spark):
    good = "the and of in is that thing with for was on are this by from " * 6
    rows = [(1, good, "en", "s", len(good)), (2, "one two three four five six seven " + good, None, "s", 9), (3, None, "en", None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    values = {n: (str(k) if k % 2 else k) for k, n in enumerate(NAMES)}
    d = plain.select("*", *(linededup.F.lit(v).alias(n) for n, v in values.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.dtypes == d.dtypes, name
        got = {r["doc_id"]: r.asDict() for r in out.collect()}
        bare = {r["doc_id"]: r.asDict() for r in stage(spark, plain, SF).collect()}
        assert set(got) == set(bare) >= {1, 2}
        assert all({k: v for k, v in r.items() if k not in values} == bare[i] for i, r in got.items()), name
        assert all(r[n] == v for r in got.values() for n, v in values.items()), name


def test_decontamination_query_rows_are_those_of_the_table(spark):
    assert decontaminate.query(spark, SF).select("doc_id").distinct().join(table(spark, SF, "documents"), "doc_id", "left_anti").count() == 0
