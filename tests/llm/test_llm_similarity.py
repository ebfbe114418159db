"""Operator 1 and connected components against brute force."""
import random

import numpy as np
import pytest
from llm_helpers import components as brute_components
from llm_helpers import docs, jaccard_components, near_copy, prose

from ecotally.llm import similarity
from ecotally.llm.common import ROWS, Scratch, shingle_hashes, words_ws
from ecotally.llm.components import components


def corpus(seed):
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.choice([0, 1, 3, 4, 5, 6, 30, 200]))) for i in range(60)]
    base, passage = prose(rnd, 150), prose(rnd, 60)
    rows += [(100 + i, near_copy(rnd, base, rnd.randrange(0, 6))) for i in range(60)]  # borderline copies of one text
    rows += [(200 + i, base) for i in range(20)]  # exact copies
    rows += [(300 + i, prose(rnd, 40) + " " + passage + " " + prose(rnd, 10)) for i in range(60)]  # a shared passage
    rows += [(400, base.upper()), (401, "  " + base.replace(" ", "\n\t")), (402, None), (403, ""), (404, " \n\t ")]
    rows += [(500 + i, prose(rnd, 900, 5000)) for i in range(3)]
    rows += [(510 + i, near_copy(rnd, rows[-1][1], 15)) for i in range(6)]
    rnd.shuffle(rows)
    return rows


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("block", [256, 8])
def test_equals_all_pairs(spark, monkeypatch, block):
    """Also with units cut into many blocks, and with frequent shingles."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    if block == 8:
        monkeypatch.setattr(similarity, "FREQUENT", 10)
    rows = corpus(block)
    assert found(similarity.similarity_classes(docs(spark, rows).repartition(4))) == jaccard_components(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(7, text), (7, text), (9, text), (None, text), (None, None), (8, "z")]
    got = sorted(map(tuple, similarity.similarity_classes(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(7, 4, 7), (7, 4, 7), (9, 4, 7), (None, 4, None), (None, 0, None), (8, 1, 8)], key=repr)
    assert similarity.similarity_classes(docs(spark, [])).count() == 0


def test_tree_loses_no_pair():
    """Whatever the trees drop is below the threshold."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    texts = [near_copy(rnd, base, rnd.randrange(12)) for _ in range(70)] + [prose(rnd, rnd.randrange(5, 400)) for _ in range(40)]
    sets = [np.unique(shingle_hashes(words_ws(t.encode()))) for t in texts]
    sizes, bits = np.array([len(s) for s in sets]), [similarity.signature(s).tobytes() for s in sets]
    linked = {
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (sizes[a] + sizes[b] - n)
    }
    i, j, most = similarity.unit_pairs(sizes, bits)
    pairs = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(pairs) == len(i) and linked <= pairs and len(pairs) < 0.5 * len(sets) ** 2 / 2
    side = np.array([k % 2 for k in range(len(sets))], np.int8)
    i, j, _ = similarity.unit_pairs(sizes, bits, side)
    across = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert {p for p in linked if side[p[0]] != side[p[1]]} <= across <= pairs


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for e in edges for x in e}
    assert {n: got.get(n, n) for n in nodes} == brute_components(nodes, edges)
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("callers,own", [("10000", ROWS), ("100", 100), ("0", ROWS), ("-1", ROWS)])
def test_own_session_sends_small_batches(spark, callers, own):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    session = spark.newSession()
    session.conf.set(key, callers)
    work = Scratch(session).work
    assert int(work.conf.get(key)) == own and session.conf.get(key) == callers
    sizes = work.range(0, 2500, 1, 1).mapInArrow(
        lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long"
    ).collect()
    assert max(r["n"] for r in sizes) == own and sum(r["n"] for r in sizes) == 2500
