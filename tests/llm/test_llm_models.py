"""Operators 2, 3, 4 and 6, and the pipeline."""
import random
import sys

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import components, contained_items, docs, dropped_lines, jaccard_components, prose

import corpus_pipeline
from ecotally.llm import catalog, html, language, neardup_vectors, pieces, toxicity
from ecotally.llm.common import table

SF = "/root/testdata/sf0.01"


# ----------------------------------------------------------------- toxicity
def edits(a, b):
    """Characters added, left out, replaced, or swapped with their neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_lexicon_equals_edit_distance():
    rnd = random.Random(1)
    terms = {"idiot": 3.0, "scum": 2.0, "disgusting": 5.0, "disgust": 1.0, "worthless": 4.0, "lowe*": 6.0}
    lexicon = toxicity.FuzzyLexicon(terms)
    words = list(terms) + ["lowering", "lower", "low", "", "scums", "idiotic", "xyz"]
    for _ in range(3000):
        w = list(rnd.choice(list(terms)).rstrip("*"))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "s", "i"])
            if rnd.randrange(2):
                w[k : k + 2] = w[k : k + 2][::-1]
        words.append("".join(w))
    words += ["idoit", "diiot", "scmu", "worhtless", "wrothelss", "dsigusting"]
    for w in words:
        full = [(edits(w, t), -x) for t, x in terms.items() if not t.endswith("*") and edits(w, t) <= toxicity.edits_allowed(t)]
        best = (-min(full)[1], min(full)[0]) if full else None
        if w.startswith("lowe") and (best is None or best[1] > 0):
            best = (6.0, 0)
        found = lexicon.match(w)
        assert (found and found[:2]) == best, w


def toxic_corpus(rnd):
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 1
        w = prose(rnd, rnd.randrange(8, 60)).split()
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["blockhead", "nitwit", "dunderhead"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_learns_misspellings_and_quotations(spark):
    rnd = random.Random(2)
    rows, marks = toxic_corpus(rnd)
    labels = spark.createDataFrame([(i, 1, x) for i, x in marks] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert set(model[0]) >= {"blockhead", "nitwit", "dunderhead"}
    test = [
        (1, prose(rnd, 30)), (2, f"{prose(rnd, 9)} BLOCKHEAD {prose(rnd, 9)}"), (3, f"{prose(rnd, 9)} blokhead {prose(rnd, 9)}"),
        (4, f'{prose(rnd, 3)} she said "you blockhead" and {prose(rnd, 3)}'), (5, None), (6, ""), (7, "é " * 20_000), (2, prose(rnd, 5)), (None, "x"),
    ]
    got = {}
    for r in toxicity.score(docs(spark, test), *model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert all(0 <= s <= 1 for x in got.values() for s in x)
    assert got[1][0] < 0.5 and got[5][0] < 0.5 and got[5] == got[6] == got[7]
    assert max(got[2]) >= 0.5 and min(got[2]) < 0.5 and got[3][0] >= 0.5
    assert got[4][0] < max(got[2])
    untrained = toxicity.score(docs(spark, test), *toxicity.train(docs(spark, rows), labels.limit(0))).collect()
    assert {r["score"] for r in untrained} == {0.5}
    assert toxicity.score(docs(spark, []), *model).count() == 0


def test_toxicity_misspellings_of_terms_with_ordinary_neighbours(spark):
    """Ordinary words beside a term are no misspellings, and leave the others of it alone;
    a term that unseen clean words look like weighs little when misspelled."""
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 1
        own = rnd.choice(["clown", "qwertasdf"]) if toxic else rnd.choice(["crown", "blown", "flown", "cloan", "clowd"])
        if not toxic and i % 5 == 2:  # a word that no other document has
            own = "".join("qwertasdf"[:k] + c + "qwertasdf"[k + 1 :] for k, c in [(i % 9, chr(0x100 + i))])
        rows.append((i, f"{prose(rnd, 12)} {own} {prose(rnd, 12)}"))
        labels.append((i, int(toxic)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model[0]) >= {"clown", "qwertasdf"}
    test = ["clown", "klown", "cloown", "clwn", "qwertasdf", "crown", "blown", "flown", "clowd", "qwertusdf", "w5"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [(i, f"{prose(rnd, 12)} {w} w1") for i, w in enumerate(test)]), *model).collect()}
    assert [got[i] >= 0.5 for i in range(len(test))] == [True] * 5 + [False] * 6


def test_toxicity_query_on_the_given_labels(spark):
    rows = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in rows)
    out = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert len(out) > 400 and sum(p == t for p, t in out) >= 0.97 * len(out)
    assert sum(p and not t for p, t in out) <= 0.01 * len(out)


# ------------------------------------------------------------ sentencepiece
@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(pieces.read_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="abeinorst aeT.\n▁é日", max_size=80))
def test_pieces_equal_the_library(machine, library, text):
    ids = np.frombuffer(machine.encode(text), np.int32).tolist()
    assert ids == library.encode(text)
    assert machine.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_pieces_in_spark(spark, library):
    rows = [(1, "Hello  world\nagain\t🙂"), (2, None), (3, ""), (1, "x"), (4, "ab " * 60_000), (5, "q" * 3000), (None, " lead")]
    back = pieces.decode(pieces.encode(docs(spark, rows))).collect()
    assert sorted((r["ids"] for r in back)) == sorted(library.encode(t or "") for _, t in rows)
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    both = pieces.encode_decode(docs(spark, rows)).collect()
    assert sorted((r["ids"], r["decoded"]) for r in both) == sorted((r["ids"], r["decoded"]) for r in back)
    assert pieces.decode(pieces.encode(docs(spark, []))).count() == 0
    odd = spark.createDataFrame([([1, 2, 99_999_999, -1, None],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode(odd).collect()] == ["", ""]


def test_piece_paths_choose_other_pieces_than_greed(machine, library):
    """Units whose longest first piece is not the model's choice."""
    rnd = random.Random(3)
    inventory = [p for p in machine.id if p.isascii() and p.isalpha()]
    for _ in range(3000):
        unit = "".join(rnd.choice(inventory)[: rnd.randrange(1, 6)] for _ in range(rnd.randrange(1, 6)))
        assert np.frombuffer(machine.encode(unit), np.int32).tolist() == library.encode(unit)


def test_piece_memos_stay_small(monkeypatch):
    """What a worker remembers at most, filled up: executors hold several workers."""
    m = pieces.Transducer(pieces.read_model())
    monkeypatch.setattr(m, "shortest_path", lambda unit: [1, 2, 3])
    monkeypatch.setattr(m, "merged", lambda s: [])
    most = 0
    for i in range(320_000):
        assert m.path(f"▁{i:08d}") == b"".join(x.to_bytes(4, sys.byteorder) for x in (1, 2, 3))
        most = max(most, len(m.paths) + len(m.older))
    for i in range(pieces.REMEMBERED_PAIRS):
        m.side_by_side(300 + i % 1000, 300 + i // 1000)
    assert most == 2 * pieces.REMEMBERED and len(m.pairs) == pieces.REMEMBERED_PAIRS
    size = sys.getsizeof
    units = 2 * pieces.REMEMBERED * (size("▁00000000") + size(bytes(12))) + size(m.paths) + size(m.older)
    assert units + size(m.pairs) + sum(map(size, m.pairs)) < 60e6


# --------------------------------------------------------------------- html
def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>"
        f"<header>Site</header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><div class='cookie-notice'>We use cookies</div>{extra}"
        f"{body}<aside>Side {i}</aside><section id=comments><p>Nice post {i}</p></section><form><p>Name</p></form>"
        f"<footer>&copy; site</footer></body></html>"
    )


def test_html_by_hand():
    body = "<article><h1>A &amp; B</h1><p>one\n  <b>two</b>&nbsp;three<br>four<p>five &lt;x&gt; <!-- no --> six<ul><li>seven<li>eight</ul></article>"
    assert html.main_text(page(1, body)) == "A & B\none two three four\nfive <x> six\nseven\neight"
    assert html.main_text("") == "" and html.main_text("plain text") == "plain text"
    assert html.main_text("<article><p>open <b>never closed<p>next") == "open never closed\nnext"
    assert html.main_text("<article>a < b and c<d title=\"x>y\">e</d></article>") == "a < b and ce"
    assert html.main_text("<article><script>x</article>") == ""


def test_html_template_slot_without_article(spark):
    """No article element: the slot that varies from page to page is the main text,
    and what the template repeats is not."""
    rnd = random.Random(6)
    rows, want = [], {}
    for i in range(30):
        text = [prose(rnd, 30) for _ in range(3)]
        body = "<div class=wrap><div class=box><p>Read this site daily</p>" + "".join(f"<p>{t}</p>" for t in text) + "</div></div>"
        rows.append((i, f"https://h{i % 2}.example.com/{i}", page(i, body)))
        want[i] = "\n".join(text)
    rows += [(90, "https://h0.example.com/x", None), (91, None, page(91, "<article><p>alone</p></article>")), (92, "https://h1.example.com/y", ""), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], "page_id long, url string, html string, host string, text string")
    got = html.extract(pages.repartition(3)).collect()
    assert len(got) == len(rows)
    found = {r["page_id"]: r["text"] for r in got}
    assert {i: found[i] for i in want} == want
    assert found[90] == found[92] == "" and found[91] == "alone"
    assert html.extract(pages.limit(0)).count() == 0


def test_html_keeps_every_open_element(spark):
    """Thousands of tags that are never closed, and deep nesting."""
    many = "".join(f"<a name=x><div>text {i}</div>" for i in range(3000))
    body = f"<article>{many}<nav><p>menu</p></nav><p>end</p></article><p>outside</p>"
    assert html.main_text(body).split("\n") == [f"text {i}" for i in range(3000)] + ["end"]
    deep = "<div>" * 3000 + "<aside><p>side</p></aside><article>deepest</article>" + "</div>" * 3000
    assert html.main_text(deep) == "deepest"
    rows, want = [], {}
    for i in range(8):
        text = [f"page {i} block {k}" for k in range(700)]
        body = "<div id=main>" + "".join(f"<font size=2><div>{t}</div>" for t in text) + f"</div><div id=rest>own {i}</div>"
        rows.append((i, f"https://deep.example.com/{i}", page(i, body)))
        want[i] = "\n".join(text)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(pages.repartition(3)).collect()} == want


def test_html_query_gives_articles(spark):
    rows = html.query(spark, SF).collect()
    assert len(rows) == 250 and all(r["n_chars"] == len(r["text"]) for r in rows)
    texts = {" ".join(r["text"].split()) for r in table(spark, SF, "documents").collect()}
    # below its headline, a page's article is a document
    assert all(" ".join(r["text"].partition("\n")[2].split()) in texts for r in rows)


# ------------------------------------------------------------------ vectors
def vector_rows(seed, n=600, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = [(i, (centres[i % 40] + rng.normal(scale=rng.choice([0.02, 0.2, 0.35, 1.0]), size=dim)).tolist()) for i in range(n)]
    hot = rng.normal(size=dim)
    rows += [(n + i, (hot * rng.uniform(0.5, 2)).tolist()) for i in range(50)] + [(2 * n + i, rows[3][1]) for i in range(20)]
    rows += [(5000, None), (5001, [0.0] * dim), (5002, [float("nan")] * dim), (5003, [1.0, None] * (dim // 2)),
             (5004, []), (5005, [float("inf")] + [1.0] * (dim - 1)), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e-200] * dim)]
    return rows


def all_links(rows, cosine=0.95):
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for k, (i, a) in enumerate(sound):
        for j, b in sound[k + 1 :]:
            if len(a) == len(b) and i != j and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                out.add((i, j))
    return out


@pytest.mark.parametrize("small_units", [False, True])
def test_vector_links_recall(spark, monkeypatch, small_units):
    rows = [r for r in vector_rows(1) if r[0] != 5008]
    if small_units:
        monkeypatch.setattr(neardup_vectors, "MEMBERS", 7)
        monkeypatch.setattr(neardup_vectors, "SEEKERS", 11)
        monkeypatch.setattr(neardup_vectors, "LIST_SIZE", 40)
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df).collect()}
    links = all_links(rows)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows) and all(got[i]["n_links"] <= n[i] for i in n)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n.values())
    want = components(n, links)
    assert sum(got[i]["component_id"] == want[i] for i in n) >= 0.97 * len(n)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (5000, 5001, 5002, 5003, 5004, 5005))
    assert got[5007]["component_id"] == 5006


@pytest.mark.parametrize("n,dim,size,top", [(1500, 32, 60, 2048), (6000, 32, 60, 2048), (6000, 64, 30, 20), (12000, 32, 40, 16)])
def test_vector_recall_with_many_lists(spark, monkeypatch, n, dim, size, top):
    """Clusters whose pairs lie around the threshold, over 25 to 300 lists, also of two levels;
    all pairs by numpy.  Growing tables get more lists, not longer ones."""
    monkeypatch.setattr(neardup_vectors, "LIST_SIZE", size)
    monkeypatch.setattr(neardup_vectors, "TOP_LISTS", top)
    rng = np.random.default_rng(n + dim)
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.2, 0.25, 0.4], size=(n, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    quantiser = neardup_vectors.Quantiser(unit, n // size)
    lists = len(quantiser.coarse) * len(quantiser.fine)
    assert n // size <= lists <= 1.2 * (n // size) + 1 and (len(quantiser.fine) > 1) == (n // size > top)
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df.repartition(4)).collect()}
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    count = links.sum(axis=1)
    assert count.sum() > n and all(got[i]["n_links"] <= count[i] for i in range(n))
    recall = sum(r["n_links"] for r in got.values()) / count.sum()
    assert recall >= 0.99
    want = components(range(n), np.argwhere(links).tolist())
    assert sum(got[i]["component_id"] == want[i] for i in range(n)) >= 0.97 * n


def test_vectors_repeated_null_ids_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, None, 0)]
    got = sorted(map(tuple, neardup_vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, False), (2, 0, 2, True), (None, 0, None, False)], key=repr)
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0


# ----------------------------------------------------------------- pipeline
def test_pipeline_equals_plain_python(spark, library):
    """run() on a small table against the stages written out."""
    sf = "/root/testdata/sf0.001"
    source = table(spark, sf, "documents").collect()
    profiles = language.Profiles(language.train(table(spark, sf, "documents")))
    rows = [(r["doc_id"], r["text"]) for r in source]
    rows = [(i, t) for i, t in rows if (p := profiles.predict(t.encode()))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    rows = [(i, kept) for i, _, _, kept in dropped_lines(rows)]
    found = jaccard_components(rows)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaked = {x[0] for x in contained_items(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaked]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library.encode(t) for i, t in rows}
    assert len(got) == len(rows) < len(source) and all(r["round_trip"] for r in got)


def test_pipeline_stages_on_awkward_documents(spark):
    """Nulls, empty and repeated rows, an empty table, and columns with clashing names."""
    good = "the and of in is that thing with for was on are this by from " * 6
    awkward = docs(spark, [(1, good), (1, good), (2, None), (3, ""), (None, good + "end"), (4, "?!"), (5, good + " \n\n")])
    empty = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, awkward, SF), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "sentencepiece":
            assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
        ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
        want = {"language_id": [1, 1, 5, None], "ngram_join": [1, 1, 2, 3, 4, None]}
        assert ids == sorted(want.get(name, [1, 1, 2, 3, 4, 5, None]), key=repr), name


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
