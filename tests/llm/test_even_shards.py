import itertools
import random
from collections import Counter

import pytest

from tickloom.llm import sharding

rng = random.Random(8)


def shares(spark, texts, n_shards=8):
    got = sharding.shard_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_shards).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    return [size[k] for k in range(n_shards)]


def test_a_hot_group_leaves_no_shard_empty(spark):
    small = [f"{k} " + "x" * rng.randint(50, 140) for k in range(1000)]
    rest = sum(len(t) + 1 for t in small)
    hot = "h" * 99
    copies = [hot] * (rest // 200)  # a third of all bytes
    got = shares(spark, small + copies)
    assert max(got) == 100 * len(copies)
    assert min(got) > 0.75 * rest / 7 and sorted(got)[-2] < 1.25 * rest / 7


@pytest.mark.parametrize("n", [8, 9, 12])
def test_no_shard_is_empty_while_groups_suffice(spark, n):
    assert min(shares(spark, ["y" * 50_000, *[str(k) for k in range(n - 1)]])) > 0


@pytest.mark.parametrize("hot", [0, 100, 199])
def test_even_cuts_equal_brute_force(spark, hot):
    sizes = [rng.randint(1, 50) for _ in range(200)]
    sizes[hot] = 2500
    cum = list(itertools.accumulate(sizes))
    groups = spark.createDataFrame(list(zip(sizes, cum, strict=True)), "g_size long, cum_size long")
    capacity, ends = sharding.smallest_capacity(groups, 4)
    got = sharding.even_ends(groups, capacity, ends, 4)
    cost = lambda e: sum((b - a) ** 2 for a, b in itertools.pairwise([0, *e]))
    near = [c for c in cum if c != cum[-1]]
    want = min(
        (cost((*e, cum[-1])) for e in itertools.combinations(near, 3) if all(b - a <= capacity for a, b in itertools.pairwise([0, *e, cum[-1]]))),
    )
    assert got[-1] == cum[-1] and all(0 < b - a <= capacity for a, b in itertools.pairwise([0, *got]))
    assert cost(got) <= 1.01 * want
