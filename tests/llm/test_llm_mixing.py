"""Operator 13: targets against plain water filling, quotas and draws against their definitions."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import docs, prose, words_ws

from ecotally.llm import mixing


def plain_targets(size_of):
    """source -> target, the excess reshared step by step."""
    order = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), 1.5 * sum(size_of.values())
    while left > 1e-9:
        free = [s for s in order if target[s] < 2 * size_of[s]]
        if not free:
            break
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * size_of[s]) for s in free)
        for s in free:
            target[s] = min(target[s], 2.0 * size_of[s])
    return target


def corpus(seed=3):
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.choice([0, 1, 7, 30, 120])), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(240)]
    rows += [(500, prose(rnd, 6000), "s1"), (501, None, "s2"), (502, "", None), (503, " \n\t ", "blank"), (504, prose(rnd, 40), None)]
    rows += [(505, "only one", "tiny"), (506, "same text here", "s3"), (506, "same text here", "s3"), (None, "no id at all", "s3"), (None, "no id at all", None)]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, 1.0, "x") for r in rows], "doc_id long, text string, source string, size int, target double, row string").repartition(6)


def mixed(spark, rows, **options):
    sized, sources, taken = mixing.mix(table(spark, rows), **options)
    size = {r["row"]: (r["doc_id"], r["source"], r["size"]) for r in sized.collect()}
    return size, {r["source"]: (r["source_size"], r["target"]) for r in sources.collect()}, taken.collect()


@pytest.mark.parametrize("block,shard,fan", [(16, 500, 3), (4096, 1 << 22, 16), (7, 200, 2)])
def test_targets_are_met_and_nothing_is_taken_three_times(spark, monkeypatch, block, shard, fan):
    monkeypatch.setattr(mixing.split, "__defaults__", (fan,))
    rows = corpus()
    size, sources, taken = mixed(spark, rows, block_words=block, shard_words=shard)
    by_source = defaultdict(int)
    for _, t, s in rows:
        by_source[s] += len(words_ws(t))
    assert sorted(v[2] for v in size.values()) == sorted(len(words_ws(t)) for _, t, _ in rows)
    want = plain_targets(by_source)
    assert {s: n for s, (n, _) in sources.items()} == dict(by_source)
    assert all(abs(t - want[s]) < 1e-6 for s, (_, t) in sources.items())
    got, epochs = defaultdict(int), Counter()
    for r in taken:
        doc_id, s, n = size[r["row"]]
        assert 0 <= r["doc_from"] < r["doc_to"] <= n and r["epoch"] in (0, 1)
        got[s] += r["doc_to"] - r["doc_from"]
        for w in range(r["doc_from"], r["doc_to"]):
            epochs[r["row"], r["epoch"], w] += 1
    assert max(epochs.values()) == 1  # no word twice in an epoch
    assert {s: got[s] for s in by_source} == {s: int(np.floor(t + 0.5)) for s, (_, t) in sources.items()}
    # a second epoch begins only when the first one has taken every word
    for s, (n, t) in sources.items():
        first = sum(r["doc_to"] - r["doc_from"] for r in taken if size[r["row"]][1] == s and r["epoch"] == 0)
        assert first == min(n, int(np.floor(t + 0.5)))
    shards = Counter(r["shard"] for r in taken)
    assert len(shards) == max(1, min(len(shards), -(-int(sum(t for _, t in sources.values())) // shard)))


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(8)

    def digest(df):
        sized, _, taken = mixing.mix(df, block_words=32, shard_words=2000)
        return sorted(map(tuple, taken.join(sized, "row").select("shard", "turn", "place", "doc_id", "epoch", "doc_from", "doc_to").collect()), key=repr)

    assert digest(table(spark, rows)) == digest(table(spark, rows[::-1]).coalesce(1))


def test_written_shards_hold_the_mixed_words(spark, tmp_dir):
    rows = corpus(5)
    mixing.write_shards(table(spark, rows), f"{tmp_dir}/shards", block_words=32, shard_words=2000)
    back = spark.read.parquet(f"{tmp_dir}/shards").collect()
    _, sources, taken = mixed(spark, rows, block_words=32, shard_words=2000)
    assert sum(len(r["text"].split(" ")) for r in back) == sum(r["doc_to"] - r["doc_from"] for r in taken)
    assert Counter(int(r["shard"]) for r in back) == Counter(r["shard"] for r in taken)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(" ".join(words_ws(t)))
    assert all(any(r["text"] in t for t in texts[r["doc_id"]]) for r in back)


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, []))[2].count() == 0
    sized, sources, taken = mixing.mix(docs(spark, [(1, None), (2, " ")]))
    assert taken.count() == 0 and sized.count() == 2 and [r["target"] for r in sources.collect()] == [0.0]


def test_permutation_and_quota():
    for n in (1, 2, 3, 5, 64, 100, 1000):
        p = mixing.permuted(np.arange(n), n, 77)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, n, 77, back=True) == np.arange(n)).all()
    for size, block in ((1, 4), (10, 4), (12, 4), (1000, 7), (5, 100)):
        blocks = -(-size // block)
        short = size - (blocks - 1) * block
        for words in range(2 * size + 1):
            n, last = mixing.quota(words, size, block, 3, 13)
            order = [int(x) for e in (0, 1) for x in mixing.permuted(np.arange(blocks), blocks, mixing._key(13, 3, e), back=True)]
            whole = [short if b == blocks - 1 else block for b in order[:n]]
            assert sum(whole[:-1]) + last == words and (not n or 0 < last <= whole[-1])


def test_tree_deals_exact_quotas(spark):
    quota = {0: 500, 1: 3, 2: 0, 3: 97, 4: 1}
    given = spark.createDataFrame([(k, q) for k, q in quota.items() if q], "source_no long, quota long")
    total, shards = sum(quota.values()), 23
    cells = [tuple(r) for r in mixing.split(given, total, shards, 1, 4).collect()]
    per_source, per_shard = Counter(), Counter()
    for s, k, q in cells:
        assert q > 0
        per_source[s] += q
        per_shard[k] += q
    assert dict(per_source) == {k: q for k, q in quota.items() if q}
    assert set(per_shard.values()) <= {total // shards, total // shards + 1} and len(per_shard) == shards


def test_tree_draws_like_a_hypergeometric_one(spark):
    """Of a source with a third of the blocks, each of 8 shards gets about a third of its places."""
    given = spark.createDataFrame([(0, 2000), (1, 4000)], "source_no long, quota long")
    share = [r["quota"] / 750 for r in mixing.split(given, 6000, 8, 5, 2).filter("source_no = 0").collect()]
    assert len(share) == 8 and all(0.25 < x < 0.42 for x in share) and len(set(share)) > 1
