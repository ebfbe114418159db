"""Operator 11 against a plain-Python Merkle tree."""
import hashlib
import random
import zlib

import pytest
from llm_helpers import docs

from ecotally.llm import manifest


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, at):
    """(before, after) hashes, level by level."""
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars); sorted result tuples."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        members.append(mine)
        trees.append(levels_of([leaf(r, r[1]) for r in mine]))
    top = levels_of([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for k, (tree, mine) in enumerate(zip(trees, members)):
        for at, r in enumerate(mine):
            way = siblings(tree, at) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if bad else r[1])
            for before, after in way:
                node = H("".join(before) + node + "".join(after))
            proof = "".join("".join(b + a) for b, a in way)
            out.append((r[0], tree[0][at], tree[-1][0], root, H(proof), node, node == root))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(4)
    rows = [(i, f"text {i}\n" * rnd.randrange(3), "en", "hot", 5) for i in rnd.sample(range(10_000), 170)]
    rows += [(20_000 + i, f"a\nb {i}", None, f"s{i % 7}", None) for i in range(40)]
    rows += [(30_000, "x", "de", "single", 1), (None, "no\nid", "en", "s1", 5), (None, None, None, None, None), (30_001, "", "", "", 0)]
    rows += [(30_002, "ünïcode\nß", "fr", "é", 9), (30_003, None, "fr", None, 9), (7, "same\n", "en", "hot", 5), (7, "same\n", "en", "hot", 5), (7, "other", "en", "hot", 5)]
    rows += [(30_004, "word\n" * 300_000, "en", "s2", 1_500_000)]
    rnd.shuffle(rows)
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, at int")
    got = manifest.manifest(df.repartition(5), manifest.tampered_text())
    assert all(H(r["proof"]) == r["proof_sha256"] for r in got.collect())
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.select(names).collect()), key=repr)


@pytest.mark.parametrize("depth", [6, 1, 2])
def test_equals_plain_trees(spark, monkeypatch, depth):
    """Also in many rounds: blocks of 3 and 9 leaves."""
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "SPAN", 3**depth)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_single_rows_and_empty_table(spark):
    one = [(5, "a\nb", "en", "s", 3)]
    assert found(spark, one) == brute(one)
    assert found(spark, []) == []
    assert manifest.manifest(docs(spark, [])).count() == 0


def test_missing_is_what_cannot_be_derived():
    for n in (1, 2, 3, 4, 10, 28, 100):
        rnd = random.Random(n)
        for k in range(1, min(n, 6) + 1):
            known = sorted(rnd.sample(range(n), k))
            have, want, level, width = set(known), [], 0, n
            while width > 1:
                parents = {i // 3 for i in have}
                want += [(level, i) for i in range(width) if i // 3 in parents and i not in have]
                have, width, level = parents, -(-width // 3), level + 1
            assert manifest.missing(known, n) == want
    assert manifest.missing(list(range(27)), 27) == []
