import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from prefmine.operators import longmine, patterns


def brute(pairs, support, confidence):
    baskets = {}
    for u, i in pairs:
        baskets.setdefault(u, set()).add(i)
    n, least = len(baskets), max(1, math.ceil(support * len(baskets)))
    level = [frozenset([i]) for i in {i for _, i in pairs}]
    sets = {}
    while level:
        counts = {c: sum(c <= b for b in baskets.values()) for c in level}
        own = {c: k for c, k in counts.items() if k >= least}
        sets |= own
        level = list({a | b for a, b in itertools.combinations(own, 2) if len(a | b) == len(a) + 1})
    rules = {}
    for c, k in sets.items():
        for i in c:
            if len(c) > 1 and k / sets[c - {i}] >= confidence:
                rules[(c - {i}, i)] = (round(k / sets[c - {i}], 9), round(k / sets[c - {i}] / (sets[frozenset([i])] / n), 9), round(k / n, 9))
    return sets, rules


def got(itemsets, rules):
    return ({frozenset(r["items"]): r.freq for r in itemsets.collect()},
            {(frozenset(r.antecedent), r.consequent[0]): (round(r.confidence, 9), round(r.lift, 9), round(r.support, 9)) for r in rules.collect()})


def planted(seed, users=90):
    rng = random.Random(seed)
    groups = [["a", "b", "c", "d"], ["c", "e"], ["f", "g", "h"]]
    pairs = set()
    for u in range(users):
        for g in groups:
            if rng.random() < 0.4:
                pairs |= {(u, i) for i in g if rng.random() < 0.9}
        pairs |= {(u, rng.choice("abcdefghijklm")) for _ in range(rng.randint(1, 3))}
    return sorted(pairs)


@pytest.mark.parametrize("seed,limit", [(0, 1 << 21), (1, 40), (2, 12)])
def test_equals_brute_force(spark, seed, limit):
    pairs = planted(seed)
    df = spark.createDataFrame(pairs, "user_id long, item string")
    assert got(*longmine.mine_rows(df, 0.1, 0.3, partition_rows=limit)) == brute(pairs, 0.1, 0.3)


def test_a_user_with_a_third_of_all_rows(spark):
    """The hot user's rows never meet in one partition, and their itemsets count."""
    pairs = planted(3) + [(1000, f"only{i}") for i in range(200)] + [(1000, i) for i in "abcde"]
    df = spark.createDataFrame(pairs, "user_id long, item string")
    least = math.ceil(0.1 * len({u for u, _ in pairs}))
    assert got(*longmine.mine_rows(df, 0.1, 0.3, partition_rows=30)) == brute(pairs, 0.1, 0.3) and least > 1
    coded = df.selectExpr("user_id", "user_id AS user", "hash(item) AS code")
    degrees = df.groupBy("user_id").count().withColumnRenamed("count", "n")
    rows, hot, parts = longmine.split_users(coded, degrees, 30)
    assert hot == 1 and rows.where("user_id = 1000").count() == 0
    assert max(Counter(r.part for r in rows.collect()).values()) <= 60 and parts >= 10


def test_same_as_baskets(spark):
    df = spark.createDataFrame(planted(4, 200), "user_id long, item string")
    a, b = got(*longmine.mine_rows(df, 0.05, 0.2, partition_rows=64)), got(*patterns.mine(patterns.baskets(df), 0.05, 0.2))
    assert a == b


def test_edges(spark):
    none = spark.createDataFrame([], "user_id long, item string")
    assert got(*longmine.mine_rows(none, 0.1, 0.1)) == ({}, {})
    one = spark.createDataFrame([("u", 7)], "who string, what long")
    assert got(*longmine.mine_rows(one, 1.0, 0.1, "who", "what")) == ({frozenset([7]): 1}, {})


def test_local_itemsets():
    users, codes = np.array([1, 1, 1, 2, 2, 3, 3, 3]), np.array([0, 1, 2, 0, 1, 0, 1, 2])
    assert sorted(longmine.local_itemsets(users, codes, 2)) == [[0, 1], [0, 1, 2], [0, 2], [1, 2]]
    assert longmine.local_itemsets(users, codes, 3) == [[0, 1]]
