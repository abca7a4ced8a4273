"""Item-based collaborative filtering.

similarity   cosine of two items over the users who rated both
neighbors    top-N most similar items per item (optionally zero-padded)
predict      weighted mean of the user's ratings on an item's neighbours
evaluate     RMSE and coverage against actual ratings

The all-pairs similarity is an equi self-join on the user: only pairs with a
common user are ever formed (sum over users of deg^2/2 rows, not items^2).  Pairs are
formed where they are summed: items are cut into ranges, a user's sorted list goes once
to every range that holds one of its items, and all pairs whose smaller item lies in a range are
built and added up there; no pair row is shuffled.  Users with more than ``chunk`` ratings are salted: their
ratings are split into ``ceil(deg/chunk)`` buckets by item hash and every
bucket pair becomes its own join group, so no task builds more than about
``chunk^2`` pairs of one user.

Every function takes ``by``: grouping columns (e.g. ``city_term``) that make
independent models per group in the same job.  Similarities, neighbours and
predictions never cross groups, exactly as if each group's ratings had been
run separately, but all groups share one set of shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from prefmine.functions.columns import cosine, rmse, safe_ratio, weighted_mean
from prefmine.operators.skew import hot_keys, salted_join, salts_of

# Ratings a user may have before the pair join salts it.
DEFAULT_CHUNK = 2048

# Pairs that one task forms, about; and the most ranges of items.
RANGE_PAIRS, MOST_RANGES = 1 << 20, 8192


def _std(ratings: DataFrame, user: str, item: str, rating: str, by: Sequence[str]) -> DataFrame:
    return ratings.select(*by, F.col(user).alias("user_id"), F.col(item).alias("item_id"),
                          F.col(rating).cast("double").alias("rating"))


def item_similarity(ratings: DataFrame, user: str = "user_id", item: str = "item_id",
                    rating: str = "rating", chunk: int = DEFAULT_CHUNK,
                    by: Sequence[str] = (), joined: bool = False, within=None) -> DataFrame:
    """``(*by, item_a, item_b, similarity, n_common)`` for every pair ``a < b``
    with at least one common user.

    similarity = sum(ra*rb) / sqrt(sum(ra^2) * sum(rb^2)), sums over common
    users; 0 when a norm is 0.  Expects one rating per (group, user, item),
    which ``build_ratings`` guarantees.

    Users with more than ``chunk`` ratings are hot: ordinary users' lists go to the ranges of
    their items (:func:`range_pairs`), hot users' ratings take the salted self-join.  The list of hot users is a small
    written table that both sides are joined with; where it is empty, adaptive
    execution drops the salted side.  ``joined``: ordinary users take the plain self-join, which
    ratings stored in buckets by user need no shuffle for.  ``within`` (a condition on ``item_a``) asks for some of the pairs.
    """
    some = (lambda pairs: pairs) if within is None else (lambda pairs: pairs.where(within))
    by = list(by)
    ukey = by + ["user_id"]
    r = _std(ratings, user, item, rating, by)
    hot, n_hot, n_pairs = hot_users(r, ukey, chunk)
    plain = r.join(hot, ukey, "left_anti") if n_hot else r
    key = [*by, "item_a", "item_b"]
    if not joined and isinstance(r.schema["item_id"].dataType, NumericType):
        pairs = range_pairs(plain, by, ["rating"], n_pairs).withColumnsRenamed({"rating_a": "ra", "rating_b": "rb"})
        agg = some(pairs).groupBy("_range", *key).agg(*_sums()).drop("_range")
    else:
        agg = some(_plain_pairs(plain, by)).groupBy(*key).agg(*_sums())
    if n_hot:
        more = some(_salted_pairs(r.join(hot, ukey), by)).groupBy(*key).agg(*_sums())
        agg = agg.unionByName(more).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("_dot", "_na", "_nb", "n_common")])
    return agg.select(*by, "item_a", "item_b", cosine("_dot", "_na", "_nb").alias("similarity"),
                      "n_common")


def hot_users(r: DataFrame, ukey: list[str], chunk: int) -> tuple[DataFrame, int, float]:
    """The written table (*ukey, n_salt) of users with more than ``chunk`` ratings, their
    number, and the number of pairs of all others."""
    seen = Observation()
    each = F.col("_rows").cast("double")
    counts = r.groupBy(*ukey).agg(F.count(F.lit(1)).alias("_rows")).observe(
        seen, F.sum(F.when(F.col("_rows") <= chunk, each * (each - 1) / 2)).alias("pairs"), F.count_if(F.col("_rows") > chunk).alias("hot"))
    return salts_of(counts, "_rows", chunk), seen.get["hot"], seen.get["pairs"] or 0


def _sums() -> list:
    return [F.sum(F.col("ra") * F.col("rb")).alias("_dot"), F.sum(F.col("ra") * F.col("ra")).alias("_na"),
            F.sum(F.col("rb") * F.col("rb")).alias("_nb"), F.count(F.lit(1)).alias("n_common")]


def range_pairs(r: DataFrame, by: list[str], values: list[str], n_pairs: float) -> DataFrame:
    """:func:`range_waves` in one frame."""
    return range_waves(r, by, values, n_pairs, 1)[0]


def range_waves(r: DataFrame, by: list[str], values: list[str], n_pairs: float, waves: int) -> list[DataFrame]:
    """``(_range, *by, item_a, item_b, v_a, v_b...)`` with both sides' ``values`` for a < b rated by
    the same user, in the partition of the range of ``item_a``: a sum by range and pair needs
    no further shuffle.

    Ranges hold about equally many ratings, about ``RANGE_PAIRS`` pairs each.  A range gets a
    user's list from its first item in that range on: at worst a list tail per rating, half
    the user's list on average, and one list per user where near ids share their raters.

    The pairs come as at most ``waves`` frames of successive ranges: where these are written one after the
    other, the lists of one wave are on disk at a time.  The users' lists are written for them (``._table_path`` of the first).
    """
    r = r.dropna(subset=[*by, "user_id", "item_id"])
    # Small inputs: some tasks, not a range per item.
    n = int(min(MOST_RANGES, max(n_pairs // RANGE_PAIRS + 1, min(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pairs // 65536 + 1))))
    cuts = r.agg(F.percentile_approx("item_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    ends = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(ends) > 2:
        r = Bucketizer(splits=ends, inputCol="item_id", outputCol="_range").transform(r).withColumn("_range", F.col("_range").cast("int"))
    else:
        r = r.withColumn("_range", F.lit(0))
    held = {c: f"_{c}s" for c in ("item_id", *values)}
    lists = r.groupBy(*by, "user_id").agg(F.array_sort(F.collect_list(F.struct(*held, "_range"))).alias("_l"))
    lists = lists.where(F.size("_l") > 1).select(*by, *[F.col(f"_l.{c}").alias(h) for c, h in held.items()], F.col("_l._range").alias("_at"))
    waves = min(waves, n)
    if waves > 1:
        from prefmine.session import materialize
        lists = materialize(lists, "user-lists")
    borders = [n * i // waves for i in range(waves + 1)]
    out = [_range_wave(lists, by, held, values, n, None if waves == 1 else (lo, hi)) for lo, hi in zip(borders, borders[1:])]
    if waves > 1:
        out[0]._table_path = lists._table_path
    return out


def _range_wave(lists: DataFrame, by: list[str], held: dict, values: list[str], n: int, wave) -> DataFrame:
    """The pairs of the ranges ``wave`` (first, end), of all if None, from users' lists; ``_range`` counts from the first."""
    lo, hi = wave or (0, n)
    here = F.array_distinct("_at") if wave is None else F.array_distinct(F.filter("_at", lambda a: (a >= lo) & (a < hi)))
    sent = lists.select("*", F.explode(here).alias("_here")).withColumn("_range", F.col("_here") - lo)
    first = F.array_position("_at", F.col("_here")).cast("int")
    sent = sent.select("_range", *by, *[F.slice(h, first, F.size("_at")).alias(h) for h in held.values()],
                       F.size(F.filter("_at", lambda a: a == F.col("_here"))).alias("_own"))
    n_here, at = F.size("_item_ids"), lambda h, i, name: F.element_at(h, F.col(i)).alias(name)
    sent = sent.where(n_here > 1).repartitionById(hi - lo, F.col("_range"))
    one = sent.select("*", F.explode(F.sequence(F.lit(1), F.least("_own", n_here - 1))).alias("_i"))
    one = one.select("*", at("_item_ids", "_i", "item_a"), *[at(held[v], "_i", f"{v}_a") for v in values])
    two = one.select("*", F.explode(F.sequence(F.col("_i") + 1, n_here)).alias("_j"))
    return (two.select("_range", *by, "item_a", at("_item_ids", "_j", "item_b"), *[f"{v}_a" for v in values], *[at(held[v], "_j", f"{v}_b") for v in values])
            .where(F.col("item_a") < F.col("item_b")))


def _plain_pairs(r: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, item_a, item_b, ra, rb)`` for a < b rated by the same user;
    both join sides are the same subtree, so their shuffle is shared."""
    left = r.select(*by, "user_id", F.col("item_id").alias("item_a"), F.col("rating").alias("ra"))
    right = r.select(*by, "user_id", F.col("item_id").alias("item_b"), F.col("rating").alias("rb"))
    return (left.join(right, by + ["user_id"]).where(F.col("item_a") < F.col("item_b"))
            .select(*by, "item_a", "item_b", "ra", "rb"))


def _salted_pairs(r: DataFrame, by: list[str]) -> DataFrame:
    """Same pairs for ratings carrying ``n_salt``: a user's ratings split into
    ``n_salt`` item-hash buckets and every bucket pair joined as its own key."""
    r = r.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("n_salt")).cast("int"))
    fan = F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1))
    left = r.select(*by, "user_id", F.col("item_id").alias("item_a"), F.col("rating").alias("ra"),
                    F.col("_b").alias("_bl"), fan.alias("_br"))
    right = r.select(*by, "user_id", F.col("item_id").alias("item_b"), F.col("rating").alias("rb"),
                     fan.alias("_bl"), F.col("_b").alias("_br"))
    return (left.join(right, by + ["user_id", "_bl", "_br"])
            .where(F.col("item_a") < F.col("item_b"))
            .select(*by, "item_a", "item_b", "ra", "rb"))


def symmetric(similarity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both directions of every pair: ``(*by, item_id, neighbor_id, similarity, n_common)``."""
    both = F.array(
        F.struct(F.col("item_a").alias("item_id"), F.col("item_b").alias("neighbor_id")),
        F.struct(F.col("item_b").alias("item_id"), F.col("item_a").alias("neighbor_id")))
    return (similarity.select(*by, F.explode(both).alias("_p"), "similarity", "n_common")
            .select(*by, "_p.item_id", "_p.neighbor_id", "similarity", "n_common"))


def rank_key(similarity_col: str = "similarity"):
    """Similarity rounded to 9 places: equal cosines computed in different
    orders tie, and ties go to the smaller neighbour id."""
    return F.col(similarity_col).cast("decimal(18,9)")


def top_neighbors(similarity: DataFrame, n: int, pad_zero: bool = False,
                  items: DataFrame | None = None, by: Sequence[str] = (), one_sided: bool = False) -> DataFrame:
    """The ``n`` most similar neighbours per item with their ``rank`` (1-based).

    Order: similarity (9 places) descending, neighbour id ascending.  The
    window is a ``row_number() <= n`` filter, which Spark plans as a partial
    per-partition top-n before the shuffle (``WindowGroupLimit``), so a popular
    item never sends all its pairs to one task.

    ``pad_zero=True`` gives every item of ``items`` (``item_id`` column, plus
    the ``by`` columns; all rated items) exactly ``min(n, |items|-1)``
    neighbours: all other items are candidates, those without a common user with
    similarity 0 (and ``n_common`` 0), ahead of negative similarities.

    ``one_sided``: ``similarity`` also names the ``item_id`` (one of the pair) whose
    list a row belongs to.
    """
    by = list(by)
    if one_sided:
        other = F.when(F.col("item_a") == F.col("item_id"), F.col("item_b")).otherwise(F.col("item_a"))
        sym = similarity.select(*by, "item_id", other.alias("neighbor_id"), "similarity", "n_common")
    else:
        sym = symmetric(similarity, by)
    if pad_zero:
        if items is None:
            raise ValueError("pad_zero needs the item universe")
        # Both the ranking and the padding read the pairs.
        from prefmine.session import materialize
        return _padded(materialize(sym, "pairs"), items.select(*by, "item_id").distinct(), n, by)
    return _top(sym, n, by)


def _top(sym: DataFrame, n: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "item_id").orderBy(rank_key().desc(), F.col("neighbor_id").asc())
    return sym.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _padded(pairs: DataFrame, universe: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The ``n`` best of an item's real neighbours and of all other items of its group at similarity 0.

    Only items with fewer than ``n`` neighbours of positive similarity need any zeros, and no more than
    they lack.  Zeros tie, so the smallest ids win; an item that lacks m finds them among the
    m + 1 + t smallest ids of its group, where t of its real neighbours are among these (itself and the
    t fall out).  An item is one row with its n best real neighbours, its t ids and the zeros, merged
    there: no candidate is shuffled, and real pairs are joined with the smallest ids only.
    """
    from prefmine.session import materialize
    key = [*by, "item_id"]
    have = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_d"), F.count_if(rank_key() > 0).alias("_k"))
    most = (have.where(F.col("_k") < n).agg(F.max("_d")).first()[0] or 0) + n + 1
    universe = universe.where(F.col("item_id").isNotNull())
    smallest = Window.partitionBy(*by).orderBy("item_id")
    # Filtered row numbers: each partition sends its own smallest ids only.
    ids = materialize(universe.withColumn("_at", F.row_number().over(smallest)).where(F.col("_at") <= most)
                      .select(*by, F.col("item_id").alias("neighbor_id")), "smallest-items")
    lists = materialize(ids.groupBy(*by).agg(F.array_sort(F.collect_list("neighbor_id")).alias("_small")), "smallest-lists")
    real = F.struct((-rank_key()).alias("o"), "neighbor_id", "similarity", F.col("n_common").cast("bigint").alias("n_common"))
    best = _top(pairs, n, by).groupBy(*key).agg(F.collect_list(real).alias("_real"))
    taken = pairs.join(ids, [*by, "neighbor_id"]).groupBy(*key).agg(F.collect_list("neighbor_id").alias("_taken"))
    rows = universe.join(best, key, "full").join(taken, key, "left")
    rows = rows.join(lists, by, "left") if by else rows.crossJoin(lists)
    none = F.array().cast(lists.schema["_small"].dataType)
    rows = rows.select(*key, F.coalesce("_real", F.array().cast(best.schema["_real"].dataType)).alias("_real"),
                       F.coalesce("_taken", none).alias("_taken"), F.coalesce("_small", none).alias("_small"))
    rows = rows.withColumn("_lack", F.lit(n) - F.size(F.filter("_real", lambda x: x["o"] < 0)))
    free = F.array_except(F.slice("_small", 1, F.col("_lack") + 1 + F.size("_taken")), F.array_append("_taken", F.col("item_id")))
    zero = lambda i: F.struct(F.lit(0).cast("decimal(18,9)").alias("o"), i.alias("neighbor_id"), F.lit(0.0).alias("similarity"),
                              F.lit(0).cast("bigint").alias("n_common"))
    merged = F.slice(F.sort_array(F.concat("_real", F.transform(F.slice(free, 1, F.col("_lack")), zero))), 1, n)
    return rows.select(*key, F.posexplode(merged).alias("_at", "_x")).select(
        *key, "_x.neighbor_id", "_x.similarity", "_x.n_common", (F.col("_at") + 1).alias("rank"))


# Rows that one task of a scoring join may hold of one item before it is salted.
SCORE_CHUNK = 1 << 20


# Ratings from which a user's predictions are spread over tasks, and items in one list under a neighbour.
HOT_USER, LISTED = 1 << 16, 256


def predict_all(neighbors: DataFrame, ratings: DataFrame, user: str = "user_id",
                item: str = "item_id", rating: str = "rating", by: Sequence[str] = ()) -> DataFrame:
    """Every (user, item) where the user rated at least one of the item's
    neighbours: ``sum(sim * r) / sum(sim)`` over those neighbours (0 when the
    similarities add up to 0).  Covers items the user rated too.  The ratings of a
    hot item are salted over several tasks.

    A rating takes the list of items that it is a neighbour of to its user: one row per rating is
    shuffled, not one per rating and item, and the predictions are added up at the user.  Users with more than
    ``HOT_USER`` ratings are added up by (user, item)."""
    by = list(by)
    ukey, key = [*by, "user_id"], [*by, "neighbor_id"]
    r = _std(ratings, user, item, rating, by).withColumnRenamed("item_id", "neighbor_id")
    nb = neighbors.select(*key, "item_id", "similarity")
    hot, n_hot, _ = hot_users(r, ukey, HOT_USER)
    few = r.join(hot, ukey, "left_anti") if n_hot else r
    met = salted_join(few, item_lists(nb, key), key, SCORE_CHUNK, hot_keys(r, key, SCORE_CHUNK))
    out = _weigh(at_user(met.select(*ukey, "rating", "_ids", "_sims"), ukey), by)
    if n_hot:
        out = out.unionByName(_weigh(salted_join(r.join(hot.select(*ukey), ukey, "left_semi"), nb, key, SCORE_CHUNK), by))
    return out


def item_lists(nb: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, _ids, _sims)``: under a neighbour the items that it is one of, in lists of at most ``LISTED``."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("item_id"))
    lists = nb.withColumn("_part", F.floor((nth - 1) / LISTED)).groupBy(*key, "_part").agg(F.collect_list(F.struct("item_id", "similarity")).alias("_l"))
    # Plain arrays, not one of structs: fewer bytes.
    return lists.select(*key, F.col("_l.item_id").alias("_ids"), F.col("_l.similarity").alias("_sims"))


def at_user(met: DataFrame, ukey: list[str]) -> DataFrame:
    """Rows with lists ``_ids`` and ``_sims`` dealt by user and unpacked there into ``item_id`` and ``similarity``."""
    rest = [c for c in met.columns if c not in ("_ids", "_sims")]
    rows = met.repartition(*ukey).select(*rest, F.posexplode("_ids").alias("_i", "item_id"), "_sims")
    return rows.select(*rest, "item_id", F.element_at("_sims", F.col("_i") + 1).alias("similarity"))


# Ratings and requests, together, that a user may have for the rated list to go along with each request.
CARRIED = 512


def _neighbor_ratings(neighbors: DataFrame, ratings: DataFrame, requests: DataFrame,
                      user: str, item: str, rating: str, by: list[str]) -> DataFrame:
    """A row for every requested pair and neighbour that the user rated; ``neighbors`` names
    a neighbour once per item.

    A request takes the list of its user's ratings to the item's list of neighbours and is matched
    there: one row per request is shuffled, whatever the number of neighbours.  Users with more than ``CARRIED``
    rows would repeat long lists, so their requests take a row per neighbour, joined by (user, neighbour).
    The requests for a hot item are salted."""
    ukey, key = [*by, "user_id"], [*by, "item_id"]
    r = _std(ratings, user, item, rating, by).withColumnRenamed("item_id", "neighbor_id").dropna(subset=[*ukey, "neighbor_id"])
    req = requests.select(*ukey, "item_id").dropna()
    near = ["neighbor_id", "similarity", *[c for c in ("rank",) if c in neighbors.columns]]
    nb = neighbors.select(*key, *near)
    both = r.unionByName(req, allowMissingColumns=True)
    hot, n_hot, _ = hot_users(both, ukey, CARRIED)
    few = both.join(hot, ukey, "left_anti") if n_hot else both
    rated = F.when(F.col("neighbor_id").isNotNull(), F.struct("neighbor_id", "rating"))
    users = few.groupBy(*ukey).agg(F.collect_list(rated).alias("_rated"), F.collect_set("item_id").alias("_asked"))
    # Plain arrays, not one of structs: fewer bytes.
    users = users.where(F.size("_rated") > 0).select(*ukey, F.col("_rated.neighbor_id").alias("_ids"), F.col("_rated.rating").alias("_ratings"), "_asked")
    asked = users.select(*ukey, "_ids", "_ratings", F.explode("_asked").alias("item_id"))
    lists = nb.groupBy(*key).agg(F.collect_list(F.struct(*near)).alias("_near")).select(*key, *[F.col(f"_near.{c}").alias(f"_{c}") for c in near])
    met = salted_join(asked, lists, key, SCORE_CHUNK, hot_keys(req, key, SCORE_CHUNK))
    met = met.select("*", F.posexplode("_ids").alias("_i", "_id")).withColumn("_at", F.array_position("_neighbor_id", F.col("_id")).cast("int"))
    met = met.where(F.col("_at") > 0).select(*ukey, "item_id", *[F.element_at(f"_{c}", F.col("_at")).alias(c) for c in near],
                                             F.element_at("_ratings", F.col("_i") + 1).alias("rating"))
    if n_hot:
        many = salted_join(req.join(hot.select(*ukey), ukey, "left_semi").distinct(), nb, key, SCORE_CHUNK)
        met = met.unionByName(many.join(r.join(hot.select(*ukey), ukey, "left_semi"), [*ukey, "neighbor_id"]))
    return met


def predict_pairs(neighbors: DataFrame, ratings: DataFrame, requests: DataFrame,
                  user: str = "user_id", item: str = "item_id", rating: str = "rating",
                  by: Sequence[str] = ()) -> DataFrame:
    """Predictions for the requested ``(user_id, item_id)`` pairs only (those
    covered by at least one rated neighbour), equal to ``predict_all``
    restricted to them.  Starts from the requests: requests x n neighbours,
    then an equi-join on (user, neighbour), instead of scoring every pair."""
    by = list(by)
    return _weigh(_neighbor_ratings(neighbors, ratings, requests, user, item, rating, by), by)


def predict_pairs_each(neighbors: DataFrame, ratings: DataFrame, requests: DataFrame, ns: Sequence[int],
                       by: Sequence[str] = ()) -> DataFrame:
    """``predict_pairs`` for several neighbour counts in one pass: a column
    ``prediction_<n>`` for each, from sums over the neighbours of rank <= n (NULL if
    none is rated).  ``neighbors`` holds max(ns) neighbours per item."""
    by = list(by)
    rows = _neighbor_ratings(neighbors, ratings, requests, "user_id", "item_id", "rating", by)
    sums = []
    for n in ns:
        near = F.col("rank") <= n
        sums += [F.sum(F.when(near, F.col("similarity") * F.col("rating"))).alias(f"_sr{n}"),
                 F.sum(F.when(near, F.col("similarity"))).alias(f"_s{n}")]
    agg = rows.groupBy(*by, "user_id", "item_id").agg(*sums)
    return agg.select(*by, "user_id", "item_id", *[
        F.when(F.col(f"_s{n}").isNotNull(), weighted_mean(f"_sr{n}", f"_s{n}")).alias(f"prediction_{n}") for n in ns])


def _weigh(rows: DataFrame, by: list[str]) -> DataFrame:
    agg = rows.groupBy(*by, "user_id", "item_id").agg(
        F.sum(F.col("similarity") * F.col("rating")).alias("_sr"),
        F.sum("similarity").alias("_s"))
    return agg.select(*by, "user_id", "item_id", weighted_mean("_sr", "_s").alias("prediction"))


def evaluate(predictions: DataFrame, actuals: DataFrame, user: str = "user_id",
             item: str = "item_id", rating: str = "rating", by: Sequence[str] = ()) -> DataFrame:
    """Per group (one row without ``by``): ``rmse`` over the actual pairs that
    have a prediction (NULL if none), ``n_covered``, ``n_actual``, ``coverage``."""
    by = list(by)
    a = _std(actuals, user, item, rating, by)
    j = a.join(predictions.select(*by, "user_id", "item_id", "prediction"),
               by + ["user_id", "item_id"], "left")
    return j.groupBy(*by).agg(rmse("rating", "prediction").alias("rmse"),
                              F.count("prediction").alias("n_covered"),
                              F.count(F.lit(1)).alias("n_actual")).select(
        *by, "rmse", "n_covered", "n_actual", safe_ratio("n_covered", "n_actual").alias("coverage"))


def fit_neighbors(train: DataFrame, n: int, pad_zero: bool = False, chunk: int = DEFAULT_CHUNK,
                  by: Sequence[str] = (), write: bool = True) -> DataFrame:
    """The item CF model: top-``n`` neighbours from ``train``.

    ``write=True`` stores the model in the shared checkpoint folder and
    returns the stored table.  Scoring then reads a small table with real
    file sizes: Catalyst can broadcast it when it is small, and the scoring
    join and aggregate get their own parallelism instead of inheriting the
    few partitions AQE gives the compact neighbour shuffle.
    """
    sim = item_similarity(train, chunk=chunk, by=by)
    nb = top_neighbors(sim, n, pad_zero=pad_zero, items=train.select(*by, "item_id"), by=by)
    if not write:
        return nb
    from prefmine.session import materialize
    return materialize(nb, "neighbors")
