"""Frequent itemsets from long rows (user, item), without an array per user.

Two passes, after the items' own counts:

1. Candidates.  Users are dealt by hash to partitions of about half a bound of rows.  Each
   partition holds, for every locally frequent item, a bitmap of its users, and
   walks the itemsets depth first by intersecting bitmaps.  An itemset that is frequent
   over all partitions reaches its share of the threshold in at least one of them.
2. Exact counts.  The candidates form a prefix tree.  Level by level the rows (user,
   itemset) are joined with the tree's edges and, by (user, item), with the pairs;
   what is left is counted by a combined aggregate.

Users with more rows than a partition may hold take no part in the first pass; there
are few of them, so the threshold is lowered by their number instead, and no
candidate is lost.  In the second pass their rows are spread by (user, item).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.operators.indexing import global_position
from prefmine.session import materialize, release

# Rows (user, item) that one partition of the first pass may hold.
PARTITION_ROWS = 1 << 21


def local_itemsets(users: np.ndarray, codes: np.ndarray, least: int) -> list[list[int]]:
    """All itemsets (rising codes, two or more) that at least ``least`` of the users hold."""
    _, place = np.unique(users, return_inverse=True)
    n = int(place.max(initial=-1)) + 1
    order = np.argsort(codes, kind="stable")
    items, first = np.unique(codes[order], return_index=True)
    maps, kept = [], []
    for item, own in zip(items.tolist(), np.split(place[order], first[1:])):
        if len(own) >= least:
            bits = np.zeros(n, bool)
            bits[own] = True
            maps.append(np.packbits(bits))
            kept.append(item)
    out: list[list[int]] = []
    # A node: an itemset, its users, and the items that may follow.
    stack = [([item], maps[i], list(range(i + 1, len(kept)))) for i, item in enumerate(kept)]
    while stack:
        prefix, own, after = stack.pop()
        found = []
        for j in after:
            both = own & maps[j]
            if int(np.bitwise_count(both).sum()) >= least:
                found.append((j, both))
        for at, (j, both) in enumerate(found):
            out.append([*prefix, kept[j]])
            stack.append((out[-1], both, [k for k, _ in found[at + 1 :]]))
    return out


def split_users(coded: DataFrame, degrees: DataFrame, limit: int) -> tuple[DataFrame, int, int]:
    """(rows, n_hot, n_parts): the rows of users with at most ``limit`` rows, each with its
    partition ``part``; how many users have more; how many partitions there are."""
    sizes = degrees.agg(F.count_if(F.col("n") > limit).alias("hot"),
                        F.sum(F.when(F.col("n") <= limit, F.col("n"))).alias("rows")).first()
    parts = max(1, math.ceil(2 * (sizes.rows or 0) / limit))
    cold = coded.join(degrees.where(F.col("n") > limit).select("user_id"), "user_id", "left_anti")
    return cold.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")), sizes.hot, parts


def candidates(rows: DataFrame, n_users: int, least: int) -> DataFrame:
    """(items): the itemsets of two or more codes that reach ``least`` * (users of a partition)
    / ``n_users`` in one of the partitions; ``rows`` (part, user_id, code)."""
    def mine(t: pa.Table) -> pa.Table:
        users, codes = (np.asarray(t[c].combine_chunks()) for c in ("user", "code"))
        share = max(1, math.ceil(least * len(np.unique(users)) / n_users - 1e-9))
        return pa.table([pa.array(local_itemsets(users, codes, share), pa.list_(pa.int64()))], names=["items"])

    return rows.groupBy("part").applyInArrow(mine, "items array<long>").distinct()


def mine_rows(pairs: DataFrame, min_support: float, min_confidence: float, user: str = "user_id", item: str = "item",
              partition_rows: int = PARTITION_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(itemsets, rules)`` of distinct pairs (user, item), as ``patterns.mine`` gives them for
    the users' baskets: itemsets (items, freq) held by at least ceil(``min_support`` * users), rules
    (antecedent, consequent, confidence, lift, support) with one consequent.  Both are written tables.
    """
    pairs = pairs.select(F.col(user).alias("user_id"), F.col(item).alias("item"))
    degrees = materialize(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "degrees", users=F.count(F.lit(1)))
    n_users = degrees.metrics["users"]
    least = max(1, math.ceil(min_support * n_users))
    # Frequent items get numbers, the rarest first: prefixes of itemsets then have few rows.
    often = global_position(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least), ["freq", "item"], "code")
    codes = materialize(often, "codes")
    numbered = materialize(global_position(degrees.select("user_id"), ["user_id"], "user"), "users")
    coded = materialize(pairs.join(codes.select("item", "code"), "item").join(numbered, "user_id").select("user_id", "user", "code"), "coded")
    rows, n_hot, _ = split_users(coded, degrees, partition_rows)
    # What hot users may add to a count is taken off the threshold.
    cand = materialize(candidates(rows, max(1, n_users - n_hot), max(1, least - n_hot)), "candidates", longest=F.max(F.size("items")))
    edges = cand.select(F.expr("slice(items, 1, size(items) - 1)").alias("node"), F.expr("items[size(items) - 1]").alias("code"), "items")
    pairs_at = coded.select("user", "code")
    level, found, made = pairs_at.select("user", F.array("code").alias("node")), [], []
    for size in range(2, (cand.metrics["longest"] or 1) + 1):
        own = edges.where(F.size("items") == size)
        met = materialize(level.join(own, "node").join(pairs_at, ["user", "code"]).select("user", F.col("items").alias("node")), "level")
        counts = materialize(met.groupBy("node").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least), "counts")
        found.append(counts)
        made.append(met)
        level = met.join(counts.select("node"), "node", "left_semi")
    sets = codes.select(F.array("code").alias("node"), "freq")
    for counts in found:
        sets = sets.unionByName(counts)
    itemsets = materialize(_named(sets, codes), "itemsets")
    rules = materialize(rules_of(itemsets, n_users, min_confidence), "rules")
    release(degrees, numbered, coded, cand, codes, *made, *found)
    return itemsets, rules


def _named(sets: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes back to items: (items, freq), items sorted."""
    each = sets.select("node", "freq", F.explode("node").alias("code")).join(codes.select("code", "item"), "code")
    return each.groupBy("node").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("freq").alias("freq")).select("items", "freq")


def rules_of(itemsets: DataFrame, n_users: int, min_confidence: float) -> DataFrame:
    """Rules with one consequent: every item of an itemset against the others, whose count is
    found by a join on the sorted items."""
    whole = itemsets.where(F.size("items") > 1).select("items", F.col("freq").alias("both"), F.explode("items").alias("one"))
    parts = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("left"))
    ones = itemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("one"), F.col("freq").alias("right"))
    r = (whole.select(F.array_remove("items", F.col("one")).alias("antecedent"), "one", "both").join(parts, "antecedent").join(ones, "one")
         .withColumn("confidence", F.col("both") / F.col("left")).where(F.col("confidence") >= min_confidence))
    return r.select("antecedent", F.array("one").alias("consequent"), "confidence",
                    (F.col("confidence") / (F.col("right") / F.lit(n_users))).alias("lift"), (F.col("both") / F.lit(n_users)).alias("support"))
