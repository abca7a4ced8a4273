"""Item similarity kept up to date batch by batch.

A pair's dot product, both co-rated norms and its number of common users are sums
over users, so a batch of new reviews changes them by sums too.  The store holds
additive parts only:

reviews    (user_id, item_id, total, n)               one folder per batch
pairs      (item_a, item_b, dot, na, nb, n_common)    one folder per batch
neighbors  (item_id, neighbor_id, similarity, n_common, rank)   replaced

A batch is joined with the stored ratings of its own users only: every rating that
it changes meets all ratings of that user once (new with old, old with new, new with
new), and the join row carries the difference between the pair's terms after and
before.  The all-pairs join is never repeated.  Neighbours are ranked when they are asked
for, once for all batches since, and only for items of a changed pair.  ``compact`` folds the parts of a table into one.

A batch is committed as one version (:mod:`prefmine.sources.versions`): it is there
whole or not at all, and applying a batch name again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.functions.columns import cosine
from prefmine.operators.itemcf import DEFAULT_CHUNK, hot_users, range_waves, top_neighbors
from prefmine.session import materialize, release
from prefmine.sources.versions import Versions

REVIEW_KEYS, REVIEW_SUMS = ["user_id", "item_id"], ["total", "n"]
PAIR_KEYS, PAIR_SUMS = ["item_a", "item_b"], ["dot", "na", "nb", "n_common"]


def _summed(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


# Rows of pairs that are folded and pairs that are formed at once, at least; and the most waves of them.
WAVE_ROWS, WAVE_PAIRS, MOST_WAVES = 1 << 24, 1 << 26, 8


def summed_in_waves(pairs: DataFrame) -> list[DataFrame]:
    """The pairs' sums as frames of ranges of ``item_a``, to be written one after the other: what is shuffled at
    once is a wave, not the table.  An item's pairs stay together, so ranking them sends few rows."""
    quantiles = [i / 64 for i in range(1, 64)]
    known = pairs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("item_a", quantiles, 6400).alias("q")).first()
    waves = max(1, min(MOST_WAVES, -(-known.n // WAVE_ROWS)))
    cuts = sorted({known.q[i * 64 // waves - 1] for i in range(1, waves)})
    out, a = [], F.col("item_a")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        some = pairs if lo is None else pairs.where(a > lo)
        some = some if hi is None else some.where(a <= hi)
        out.append(_summed(some.repartitionByRange("item_a"), PAIR_KEYS, PAIR_SUMS))
    return out


def changed_pairs(rows: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(item_a, item_b, dot, na, nb, n_common): by how much a batch changes the pairs' sums.

    ``rows`` (user_id, item_id, before, after) holds every rating of the users that a
    batch touches: ``before`` is null for a new rating, ``after`` differs from it for a
    changed one.  Pairs are formed and summed in the range of their smaller item
    (``itemcf.range_pairs``), so no pair row is shuffled.  A user with more
    than ``chunk`` ratings is cut into buckets of items, and each pair of buckets is a
    join group of its own, so no task forms more than about ``chunk`` squared pairs of one user.
    """
    return _changed(rows, chunk, 1)[0][0]


def _changed(rows: DataFrame, chunk: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """:func:`changed_pairs` as at most ``most`` frames without a common pair, and tables to release when they are written."""
    hot, n_hot, n_pairs = hot_users(rows, ["user_id"], chunk)
    plain = rows.join(hot, "user_id", "left_anti") if n_hot else rows
    changed = lambda s: F.col(f"before_{s}").isNull() | (F.col(f"before_{s}") != F.col(f"after_{s}"))
    waves = 1 if n_hot else max(1, min(most, int(n_pairs // WAVE_PAIRS) + 1))
    frames = range_waves(plain, [], ["before", "after"], n_pairs, waves)
    out = [_summed(_terms(met.where(changed("a") | changed("b")), "_range"), ["_range", *PAIR_KEYS], PAIR_SUMS).drop("_range") for met in frames]
    if n_hot:
        out = [_summed(out[0].unionByName(_hot_terms(rows.join(hot, "user_id"))), PAIR_KEYS, PAIR_SUMS)]
    return out, [f for f in frames[:1] if hasattr(f, "_table_path")]


def _terms(met: DataFrame, *more: str) -> DataFrame:
    """The pair's terms after less those before, for rows with before and after of ``item_a`` < ``item_b``."""
    was = F.col("before_a").isNotNull() & F.col("before_b").isNotNull()
    less = lambda x, y: F.col(f"after_{x}") * F.col(f"after_{y}") - F.when(was, F.col(f"before_{x}") * F.col(f"before_{y}")).otherwise(0.0)
    return met.select(*more, *PAIR_KEYS, less("a", "b").alias("dot"), less("a", "a").alias("na"), less("b", "b").alias("nb"),
                      F.when(was, 0).otherwise(1).cast("bigint").alias("n_common"))


def _hot_terms(rows: DataFrame) -> DataFrame:
    own = F.pmod(F.xxhash64("item_id"), F.col("n_salt")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1))
    side = lambda s: [F.col("item_id").alias(f"item_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("before", "after", "changed")]]
    rows = rows.withColumn("changed", F.col("before").isNull() | (F.col("before") != F.col("after")))
    left = rows.select("user_id", *side("a"), own.alias("bl"), every.alias("br"))
    right = rows.select("user_id", *side("b"), own.alias("br"), every.alias("bl"))
    return _terms(left.join(right, ["user_id", "bl", "br"]).where("item_a < item_b AND (changed_a OR changed_b)"))


class SimilarityStore:
    """Ratings, pair sums and neighbour lists below ``base``, kept up to date by batches of reviews."""

    def __init__(self, spark: SparkSession, base: str, n_neighbors: int = 10, chunk: int = DEFAULT_CHUNK):
        self.versions, self.n, self.chunk = Versions(spark, base), n_neighbors, chunk

    def apply(self, name: str, reviews: DataFrame) -> bool:
        """Take in a batch of reviews (user_id, item_id, rate); False if the batch ``name`` was
        applied before.  A rating is the mean of all its reviews so far; rows with a null
        in a key or rate are no reviews."""
        _, manifest = self.versions.latest()
        if name in manifest.get("batches", []):
            return False
        batch = materialize(reviews.dropna(subset=["user_id", "item_id", "rate"]).groupBy(*REVIEW_KEYS).agg(
            F.sum(F.col("rate").cast("double")).alias("total"), F.count(F.lit(1)).alias("n")), "batch")
        stored = self.versions.read("reviews", manifest)
        rows = batch.select(*REVIEW_KEYS, F.lit(None).cast("double").alias("before"), (F.col("total") / F.col("n")).alias("after"))
        if stored is not None:
            # Only the users of the batch, with all their ratings.
            old = stored.join(batch.select("user_id").distinct(), "user_id", "left_semi")
            rows = (old.withColumn("was", F.lit(1)).unionByName(batch.withColumn("was", F.lit(0))).groupBy(*REVIEW_KEYS).agg(
                F.sum(F.when(F.col("was") == 1, F.col("total"))).alias("t0"), F.sum(F.when(F.col("was") == 1, F.col("n"))).alias("n0"),
                F.sum("total").alias("t"), F.sum("n").alias("n"))
                .select(*REVIEW_KEYS, F.try_divide("t0", "n0").alias("before"), (F.col("t") / F.col("n")).alias("after")))
        rows = materialize(rows, "batch-users")
        # Written once, in the version itself; its items are ranked when lists are asked for.
        changed, held = _changed(rows, self.chunk, MOST_WAVES)
        self.versions.commit(append={"reviews": batch, "pairs": changed},
                             batches=[*manifest.get("batches", []), name], ranked=_ranked_parts(manifest))
        release(batch, rows, *held)
        return True

    def _rank(self) -> None:
        """Bring the neighbour lists up to the newest version: items of a pair changed since they were
        ranked from the sums of their pairs, all others as they were."""
        manifest = self.versions.latest()[1]
        parts, done = manifest.get("tables", {}).get("pairs", []), _ranked_parts(manifest)
        if done == len(parts):
            return
        mine, before = self.versions.read("pairs", manifest), self.versions.read("neighbors", manifest)
        cols = ["item_id", "neighbor_id", "similarity", "n_common", "rank"]
        if not done:  # every pair is new
            sums = mine if len(parts) == 1 else _summed(mine, PAIR_KEYS, PAIR_SUMS)
            lists = top_neighbors(_cosines(sums, []), self.n).select(*cols)
        else:
            late = self.versions.read("pairs", {"tables": {"pairs": parts[done:]}})
            lists = self._ranked(mine, late.select(F.explode(F.array(*PAIR_KEYS)).alias("item_id")).distinct(), before, cols)
        self.versions.commit(replace={"neighbors": lists}, ranked=len(parts))

    def _ranked(self, mine: DataFrame, touched: DataFrame, before: DataFrame, cols: list[str]) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("item_a").alias("item_id")), F.struct(F.col("item_b").alias("item_id")))).alias("end")
        # A pair is needed if one of its ends is touched; ranked only for that end.
        near = mine.select("*", ends).select(*PAIR_KEYS, *PAIR_SUMS, "end.item_id").join(touched, "item_id", "left_semi")
        sums = near.groupBy("item_id", *PAIR_KEYS).agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])
        lists = top_neighbors(_cosines(sums, ["item_id"]), self.n, one_sided=True)
        return lists.select(*cols).unionByName(before.join(touched, "item_id", "left_anti").select(*cols))

    def similarity(self) -> DataFrame:
        """(item_a, item_b, similarity, n_common) of all pairs with a common user, as
        ``itemcf.item_similarity`` of the ratings so far."""
        pairs = self.versions.read("pairs")
        if pairs is None:
            raise ValueError("no batch was applied")
        return _cosines(_summed(pairs, PAIR_KEYS, PAIR_SUMS), [])

    def neighbors(self) -> DataFrame:
        """(item_id, neighbor_id, similarity, n_common, rank) after all batches so far; lists that batches
        changed since the last call are ranked and committed first."""
        self._rank()
        return self.versions.read("neighbors")

    def ratings(self) -> DataFrame:
        """(user_id, item_id, rating): the mean of all reviews so far."""
        return _summed(self.versions.read("reviews"), REVIEW_KEYS, REVIEW_SUMS).select(
            *REVIEW_KEYS, (F.col("total") / F.col("n")).alias("rating"))

    def compact(self) -> None:
        """Fold the parts of reviews and pairs into one folder each and delete the old ones.
        Due when the parts of a table outweigh its sum, not after every batch."""
        manifest = self.versions.latest()[1]
        reviews, pairs = self.versions.read("reviews", manifest), self.versions.read("pairs", manifest)
        # One part has no note of what is ranked: lists behind the batches are ranked anew from it.
        current = _ranked_parts(manifest) == len(manifest["tables"]["pairs"])
        self.versions.commit(replace={"reviews": _summed(reviews, REVIEW_KEYS, REVIEW_SUMS), "pairs": summed_in_waves(pairs)}, ranked=int(current))
        self.versions.vacuum()
        self._rank()
        self.versions.vacuum()


def _ranked_parts(manifest: dict) -> int:
    """How many parts of the pairs the neighbour lists follow (all, where an older store does not say)."""
    tables = manifest.get("tables", {})
    return manifest.get("ranked", len(tables.get("pairs", [])) if "neighbors" in tables else 0)


def _cosines(sums: DataFrame, more: list[str]) -> DataFrame:
    return sums.where("n_common > 0").select(*more, *PAIR_KEYS, cosine("dot", "na", "nb").alias("similarity"), "n_common")
