import random
from collections import Counter

import numpy as np
import pytest

from strataloom.llm.mixing import mix_sources, permuted, shard_counts
from strataloom.llm.packing import best_fit, fill_containers
from strataloom.llm.tokens import encoding, token_counts


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_as_good_as_item_by_item(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 100), r.randint(1, 9), 50]) for _ in range(r.randint(1, 400))]
    plan, made = best_fit(Counter(sizes), 100)
    load = Counter()
    done = Counter()
    for size, rank, n, first, each in plan:
        assert rank == done[size]
        done[size] += n
        for i in range(n):
            load[first + i // each] += size
    assert done == Counter(sizes) and max(load.values()) <= 100 and set(load) == set(range(made))
    assert made == plain_best_fit(sizes, 100)


def test_containers(spark):
    r = random.Random(1)
    rows = [(i, r.randint(1, 40), "x") for i in range(500)] + [(900, 250, "x"), (901, 100, "x"), (902, 0, "x"), (903, None, "x"), (None, 7, "x"), (900, 250, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n long, container string")
    got = fill_containers(df, "doc_id", "n", 100).collect()
    load, per = Counter(), Counter()
    for g in got:
        if g.container is not None:
            load[g.container] += g.n_tokens
            per[g.key] += g.n_tokens
    assert max(load.values()) <= 100
    assert per[900] == 500 and per[901] == 100 and per[None] == 7 and all(per[k] == n for k, n, _ in rows[:500])
    assert sorted((g.piece, g.offset) for g in got if g.key == 900) == [(0, 0), (0, 0), (1, 100), (1, 100), (2, 200), (2, 200)]
    assert {g.key for g in got if g.container is None} == {902, 903}
    assert sum(load.values()) / (100 * len(load)) > 0.97
    assert fill_containers(df.limit(0), "doc_id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, "doc_id", "n", 0)


def test_mixture(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "A ", "b", "b", "b", "c", None, "other"]), r.randint(0, 300)) for i in range(900)] + [(5000, "a", None)]
    df = spark.createDataFrame(rows, "key long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4), ("gone", 0.4, 2), ("zero", 0.0, 3)], "source string, target_share double, max_repeats int")
    m = mix_sources(df, t, block=16, slots_per_shard=64)
    s = {x.source: x for x in m.shares.collect()}
    for k, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s[k].reached_share - want) < 0.005 and s[k].uses <= s[k].max_repeats
    assert s["gone"].reached_share == 0 and s["zero"].n_tokens == 0
    rowsel = m.selection.collect()
    size = {k: n for k, _, n in rows}
    used = Counter()
    for x in rowsel:
        assert x.from_token + x.n_tokens <= size[x.key]
        used[(x.source, x.key)] += x.n_tokens
    cap = {"a": 2, "b": 1, "c": 4}
    assert all(n <= cap[src] * size[k] for (src, k), n in used.items())
    per_slot = Counter((x.shard, x.slot) for x in {(y.shard, y.slot, y.source, y.block, y.repeat): y for y in rowsel}.values())
    assert set(per_slot.values()) == {1}
    assert max(Counter((x.source, x.block, x.repeat) for x in {(y.shard, y.slot): y for y in rowsel}.values()).values()) == 1
    assert mix_sources(df.limit(0), t).selection.count() == 0
    assert mix_sources(df, t.limit(0)).shares.count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "a b " * 50000, "x")], "doc_id long, text string, n_tokens string")
    got = {r.key: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] == len(encoding().encode_ordinary("a b " * 50000))


@pytest.mark.parametrize("m", [1, 2, 3, 64, 1000, 4097])
def test_permutations(m):
    for key in (1, 2):
        assert sorted(permuted(np.arange(m), m, key).tolist()) == list(range(m))
    if m >= 1000:  # no arithmetic progression
        assert len(set(np.diff(permuted(np.arange(m), m, 3)).tolist())) > m // 3


@pytest.mark.parametrize("slots", [[10, 0, 3], [4096], [5000, 70, 1], [10**12, 3 * 10**11, 17]])
def test_counts_of_shards(slots):
    slots = np.array(slots, np.int64)
    shards = -(-int(slots.sum()) // 64)
    every = list(shard_counts(slots, 64, 0, min(shards, 200), 3))
    at = np.zeros_like(slots)
    for k, (shard, before, own) in enumerate(every):
        assert shard == k and (before == at).all() and (own >= 0).all()
        assert own.sum() == min(64, slots.sum() - 64 * k)
        at = at + own
    if shards <= 200:
        assert (at == slots).all()
    # a task in the middle finds the same counts
    part = list(shard_counts(slots, 64, 3, 5, 3))
    assert [(s, b.tolist(), o.tolist()) for s, b, o in part] == [(s, b.tolist(), o.tolist()) for s, b, o in every[3:5]]
