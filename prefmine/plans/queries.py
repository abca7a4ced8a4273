"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables (whole tables, no row caps) and returns
plain columns; computed doubles are rounded to 9 places through DECIMAL(38,9) so the DuckDB
oracle in :mod:`prefmine.plans.oracle` can compare them exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.operators import itemcf, ratings as R, splits
from prefmine.plans import params as P
from prefmine.session import materialize, release
from prefmine.sources import testdata as T

Query = Callable[[SparkSession, str], DataFrame]


def fx(c, name: str | None = None):
    """Double rounded to 9 places (through DECIMAL(38,9), exact in both engines)."""
    col = F.col(c) if isinstance(c, str) else c
    out = col.cast("decimal(38,9)").cast("double")
    return out.alias(name or (c if isinstance(c, str) else "value"))


# ---------------------------------------------------------------- ratings

def q_ratings_build(spark, sf):
    r = T.ratings_supp(spark, sf)
    return r.select("user_id", "item_id", "city", fx("rating"))


def q_city_filter(spark, sf):
    # The term is resolved against the business dimension, not tested per rating.
    r = R.city_filter(T.ratings_supp(spark, sf), P.CITY_TERM, cities=T.business(spark, sf))
    return r.select("user_id", "item_id", "city", fx("rating"))


def q_city_fanout(spark, sf):
    r = R.city_fanout(T.ratings_supp(spark, sf), P.CITY_TERMS)
    return r.select("city_term", "user_id", "item_id", "city", fx("rating"))


def q_city_counts(spark, sf):
    return R.city_counts(T.ratings_supp(spark, sf), P.CITY_TERMS)


def q_json_ratings(spark, sf):
    return T.ratings_events(spark, sf).select("user_id", "item_id", fx("rating"))


# ---------------------------------------------------------------- item CF

def _supp_split(spark, sf):
    # The split flag is computed once and stored with the rating table: the
    # train and test sides are scanned several times each.
    r = materialize(splits.mark_split(T.ratings_supp(spark, sf), ["user_id", "item_id"],
                                      P.TEST_FRACTION, P.SEED), "ratings_supp")
    return splits.split_marked(r)


def q_item_similarity(spark, sf):
    sim = itemcf.item_similarity(materialize(T.ratings_part(spark, sf), "ratings_part"))
    return sim.select("item_a", "item_b", fx("similarity"), "n_common")


def q_item_similarity_symmetric(spark, sf):
    r = materialize(T.ratings_events(spark, sf), "ratings_events")
    sim = itemcf.symmetric(itemcf.item_similarity(r))
    return sim.select("item_id", "neighbor_id", fx("similarity"), "n_common")


def q_item_neighbors(spark, sf):
    train, _ = _supp_split(spark, sf)
    nb = itemcf.top_neighbors(itemcf.item_similarity(train), P.N_NEIGHBORS)
    return nb.select("item_id", "neighbor_id", fx("similarity"), "n_common", "rank")


def q_item_neighbors_padded(spark, sf):
    """Padded neighbours of every city's sparse part ratings, a model per city."""
    r = materialize(T.ratings_part_city(spark, sf), "ratings_part_city")
    nb = itemcf.fit_neighbors(r, P.N_NEIGHBORS, pad_zero=True, by=["city"])
    return nb.select("city", "item_id", "neighbor_id", fx("similarity"), "n_common", "rank")


def _padded(spark, sf):
    r = materialize(splits.mark_split(T.ratings_part_city(spark, sf), ["user_id", "item_id", "city"],
                                      P.TEST_FRACTION, P.SEED), "ratings_part_city")
    train, test = splits.split_marked(r)
    nb = itemcf.fit_neighbors(train, P.N_NEIGHBORS, pad_zero=True, by=["city"])
    return test, itemcf.predict_pairs(nb, train, test, by=["city"])


def q_itemcf_predictions_padded(spark, sf):
    """Predictions for the held-out pairs from padded neighbours: a neighbour without a
    common user weighs 0, so a pair covered by such neighbours alone is predicted 0."""
    _, pred = _padded(spark, sf)
    return pred.select("city", "user_id", "item_id", fx("prediction"))


def q_itemcf_rmse_padded(spark, sf):
    test, pred = _padded(spark, sf)
    return itemcf.evaluate(pred, test, by=["city"]).select("city", fx("rmse"), "n_covered", "n_actual", fx("coverage"))


QUERIES: dict[str, Query] = {
    "ratings_build": q_ratings_build,
    "city_filter": q_city_filter,
    "city_fanout": q_city_fanout,
    "city_counts": q_city_counts,
    "json_ratings": q_json_ratings,
    "item_similarity": q_item_similarity,
    "item_similarity_symmetric": q_item_similarity_symmetric,
    "item_neighbors": q_item_neighbors,
    "item_neighbors_padded": q_item_neighbors_padded,
    "itemcf_predictions_padded": q_itemcf_predictions_padded,
    "itemcf_rmse_padded": q_itemcf_rmse_padded,
}


# ------------------------------------------------- indexes and splits

def q_dense_user_index(spark, sf):
    from prefmine.operators.indexing import dense_index
    cust = T.table(spark, sf, "customer").select("c_name")
    return dense_index(cust, ["c_name"], "user_index")


def _open_city_pairs(spark, sf, city=P.OPEN_CITY, open_only=True):
    from prefmine.operators.patterns import distinct_pairs
    rv = T.reviews(spark, sf, "supp").select(F.col("item_key").alias("item_id"),
                                              F.col("user_key").alias("user_id"))
    return distinct_pairs(rv, T.business(spark, sf), city, open_only)


def q_first_seen_index(spark, sf):
    from prefmine.operators.indexing import first_seen_index
    return first_seen_index(_open_city_pairs(spark, sf), "user_id", ["item_id", "user_id"],
                            "user_index")


def q_first_seen_business_index(spark, sf):
    from prefmine.operators.indexing import first_seen_index
    return first_seen_index(_open_city_pairs(spark, sf), "item_id", ["item_id", "user_id"], "business_index")


def q_first_seen_index_all(spark, sf):
    """Users numbered by first appearance over the pairs of all businesses."""
    from prefmine.operators.indexing import first_seen_index
    return first_seen_index(_open_city_pairs(spark, sf, None, False), "user_id", ["item_id", "user_id"], "user_index")


def q_split_80_20(spark, sf):
    train, test = _supp_split(spark, sf)
    return (train.select("user_id", "item_id", F.lit(False).alias("is_test"))
            .unionByName(test.select("user_id", "item_id", F.lit(True).alias("is_test"))))


def _brand_marked(spark, sf):
    """The brand pairs with the exact split's flag, written once."""
    return splits.mark_exact_split(T.brand_pairs(spark, sf), ["user_id", "item"], P.BASKET_TEST_FRACTION, P.SEED)


def q_split_exact_tenth(spark, sf):
    return _brand_marked(spark, sf).select("user_id", "item", "is_test")


# ---------------------------------------------- item CF predictions

def _supp_neighbors(spark, sf, n=P.N_NEIGHBORS):
    train, test = _supp_split(spark, sf)
    return train, test, itemcf.fit_neighbors(train, n)


def q_itemcf_predictions(spark, sf):
    train, _, nb = _supp_neighbors(spark, sf)
    return itemcf.predict_all(nb, train).select("user_id", "item_id", fx("prediction"))


def _eval_cols(df):
    return df.select(fx("rmse"), "n_covered", "n_actual", fx("coverage"))


def q_itemcf_rmse_train(spark, sf):
    train, _, nb = _supp_neighbors(spark, sf)
    return _eval_cols(itemcf.evaluate(itemcf.predict_pairs(nb, train, train), train))


def q_itemcf_rmse_test(spark, sf):
    train, test, nb = _supp_neighbors(spark, sf)
    return _eval_cols(itemcf.evaluate(itemcf.predict_pairs(nb, train, test), test))


def q_itemcf_coverage(spark, sf):
    """Test coverage and RMSE per city."""
    train, test, nb = _supp_neighbors(spark, sf)
    pred = itemcf.predict_pairs(nb, train, test)
    t = test.join(pred, ["user_id", "item_id"], "left")
    return (t.groupBy("city").agg(F.count(F.lit(1)).alias("n_actual"),
                                  F.count("prediction").alias("n_covered"),
                                  F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"))
            .select("city", "n_actual", "n_covered",
                    fx(F.col("n_covered") / F.col("n_actual"), "coverage"), fx("rmse")))


# -------------------------------------------------- pattern mining

def q_distinct_pairs(spark, sf):
    return _open_city_pairs(spark, sf)


def q_user_baskets(spark, sf):
    from prefmine.operators.patterns import baskets, itemset_key
    b = baskets(T.brand_pairs(spark, sf))
    return b.select("user_id", itemset_key("items").alias("items_key"),
                    F.size("items").alias("n_items"))


def q_basket_stats(spark, sf):
    from prefmine.operators.patterns import basket_stats
    return basket_stats(T.brand_pairs(spark, sf)).select(
        "n_pairs", "n_users", "n_items", "max_basket", fx("mean_basket"))


def _mine(marked, support=P.MIN_SUPPORT, confidence=P.MIN_CONFIDENCE):
    from prefmine.operators.patterns import baskets, mine
    itemsets, rules = mine(baskets(marked.where("NOT is_test")), support, confidence)
    return marked, itemsets, rules


def _mined(spark, sf):
    return _mine(_brand_marked(spark, sf))


def _open_city_mined(spark, sf):
    """The whole mining procedure on the open-city query's output: users' baskets of
    businesses, exact split, rules."""
    pairs = _open_city_pairs(spark, sf).select("user_id", F.col("item_id").cast("string").alias("item"))
    return _mine(splits.mark_exact_split(pairs, ["user_id", "item"], P.BASKET_TEST_FRACTION, P.SEED))


def q_frequent_itemsets(spark, sf):
    from prefmine.operators.patterns import itemset_key
    _, itemsets, _ = _mined(spark, sf)
    return itemsets.select(itemset_key("items").alias("items_key"),
                           F.size("items").alias("size"), "freq")


def _rule_cols(rules):
    from prefmine.operators.patterns import itemset_key
    return rules.select(itemset_key("antecedent").alias("antecedent_key"),
                        itemset_key("consequent").alias("consequent_key"),
                        fx("confidence"), fx("lift"), fx("support"))


def q_association_rules(spark, sf):
    _, _, rules = _mined(spark, sf)
    return _rule_cols(rules)


def q_distinct_antecedents(spark, sf):
    from prefmine.operators.patterns import distinct_antecedents
    _, _, rules = _mined(spark, sf)
    return distinct_antecedents(rules).select("antecedent_key", "ante_size", "n_rules")


def q_rule_predictions(spark, sf):
    from prefmine.operators.patterns import fire_rules
    marked, _, rules = _mined(spark, sf)
    # Brand pairs are distinct by construction.
    return fire_rules(marked.where("NOT is_test"), rules, assume_distinct=True)


def q_rule_tp_fp_fn(spark, sf):
    from prefmine.operators.patterns import score_marked
    marked, _, rules = _mined(spark, sf)
    return score_marked(marked, rules)


def _precision_recall(marked, rules):
    from prefmine.operators.patterns import precision_recall, score_marked
    pr = precision_recall(score_marked(marked, rules))
    return pr.select("n_matched", "tp", "fp", "fn", fx("precision"), fx("recall"))


def q_rule_precision_recall(spark, sf):
    marked, _, rules = _mined(spark, sf)
    return _precision_recall(marked, rules)


def q_open_city_rules(spark, sf):
    _, _, rules = _open_city_mined(spark, sf)
    return _rule_cols(rules)


def q_open_city_precision_recall(spark, sf):
    marked, _, rules = _open_city_mined(spark, sf)
    return _precision_recall(marked, rules)


QUERIES.update({
    "dense_user_index": q_dense_user_index,
    "first_seen_index": q_first_seen_index,
    "first_seen_business_index": q_first_seen_business_index,
    "first_seen_index_all": q_first_seen_index_all,
    "open_city_rules": q_open_city_rules,
    "open_city_precision_recall": q_open_city_precision_recall,
    "split_80_20": q_split_80_20,
    "split_exact_tenth": q_split_exact_tenth,
    "itemcf_predictions": q_itemcf_predictions,
    "itemcf_rmse_train": q_itemcf_rmse_train,
    "itemcf_rmse_test": q_itemcf_rmse_test,
    "itemcf_coverage": q_itemcf_coverage,
    "distinct_pairs": q_distinct_pairs,
    "user_baskets": q_user_baskets,
    "basket_stats": q_basket_stats,
    "frequent_itemsets": q_frequent_itemsets,
    "association_rules": q_association_rules,
    "distinct_antecedents": q_distinct_antecedents,
    "rule_predictions": q_rule_predictions,
    "rule_tp_fp_fn": q_rule_tp_fp_fn,
    "rule_precision_recall": q_rule_precision_recall,
})


# ------------------------------------------------------------------ ALS
#
# A factorisation's numbers are its own, so these queries publish what SQL can
# derive (which pairs can be scored, counts, grid points) and flags that hold for
# any correct fit (finite predictions, equal after reload).  The operators in
# prefmine.operators.als return the RMSE and seconds themselves.

ALS_ARGS = {"rank": P.ALS_RANK, "max_iter": P.ALS_MAX_ITER, "reg_param": P.ALS_REG, "num_blocks": P.ALS_BLOCKS}


def _finite(c):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def q_als_predictions(spark, sf):
    """The held-out pairs that can be scored (known user and item)."""
    from prefmine.operators import als
    train, test = _supp_split(spark, sf)
    model = als.fit(train, **ALS_ARGS)
    scored = als.score(model, test)
    als.release_model(model)
    return scored.select("user_id", "item_id", fx(F.col("rating").cast("double"), "rating"), _finite("prediction").alias("finite"))


def _mark_by(df, seed):
    return splits.mark_split(df, ["user_id", "item_id"], P.TEST_FRACTION, seed)


def q_als_holdout_mean(spark, sf):
    """Three fresh hash splits (seeds 0..2): per-run rows and their mean, the mean of RMSE and
    seconds included (``rmse_finite`` and ``timed`` of that row say that they lie within the
    runs' least and greatest)."""
    from prefmine.operators import als
    rows = als.holdout_runs(materialize(T.ratings_supp(spark, sf), "ratings_supp"), _mark_by, runs=P.ALS_RUNS, **ALS_ARGS)
    table = als.holdout_table(spark, rows)
    among = lambda c: F.col(c).between(min(r[c] for r in rows) * (1 - 1e-12), max(r[c] for r in rows) * (1 + 1e-12))
    return table.select("run", *[F.floor(c).cast("bigint").alias(c) for c in ("n_train", "n_test", "n_scored")],
                        (_finite("rmse") & among("rmse")).alias("rmse_finite"),
                        ((F.col("train_s") > 0) & (F.col("test_s") > 0) & among("train_s") & among("test_s")).alias("timed"))


def q_als_certificate(spark, sf):
    """A fit with the original settings, saved and reloaded, certified: the reloaded user factors solve
    their normal equations (``stationary``), and the RMSE recomputed from the factors is
    the evaluator's (``rmse_equal``) on the held-out pairs that can be scored."""
    from prefmine.operators import als
    train, test = _supp_split(spark, sf)
    model = als.fit(train, **ALS_ARGS)
    path = _scratch(spark, "models")
    als.save(model, path)
    row = als.certificate(als.load(path), train, test, P.ALS_REG)
    told = als.rmse_evaluator().evaluate(als.score(model, test))
    return row.select("n_users", "n_train", "n_scored", (F.col("worst") < 1e-3).alias("stationary"),
                      (F.abs(F.col("test_rmse") - F.lit(told)) < 1e-5 * F.lit(told)).alias("rmse_equal"),
                      (F.col("train_rmse") < F.col("test_rmse")).alias("train_fits_better"))


GRID_POINTS = [{"rank": r, "regParam": g} for r in P.ALS_GRID_RANKS for g in P.ALS_GRID_REGS]


def _grid_frame(spark, table):
    return spark.createDataFrame([(r["rank"], r["reg_param"], r["avg_rmse"], r["is_best"]) for r in table],
                                 "rank int, regParam double, avg_rmse double, is_best boolean")


def q_als_grid(spark, sf):
    """Cross-validated rank x regParam grid; the fitted model is saved, reloaded and
    scored.  ``n_best``: points marked best; ``best_is_least``: the mark is on the
    smallest average RMSE; ``train_below_deviation``: the best model's train RMSE is
    below the ratings' deviation; ``reloaded_equal``: test RMSE before and after reload."""
    from prefmine.operators import als
    train, test = _supp_split(spark, sf)
    cv = als.grid_search(train, P.ALS_GRID_RANKS, P.ALS_GRID_REGS, num_folds=P.ALS_FOLDS,
                         parallelism=4, max_iter=P.ALS_MAX_ITER)
    path = _scratch(spark, "models")
    als.save(cv, path)
    again = als.load(path, cv=True)
    before, after = (als.scored_rmse(m.bestModel, test) for m in (cv, again))
    als.release_model(cv.bestModel)
    below = als.scored_rmse(again.bestModel, train) < train.agg(F.stddev_pop("rating")).first()[0]
    table = als.grid_table(cv)
    led, data = _ledger(spark, sf, *RATING_TABLES)
    if led.missing(data, "als grid", GRID_POINTS):
        led.record(data, "als grid", GRID_POINTS, _grid_frame(spark, table), ["avg_rmse", "is_best"])
    best = [r for r in table if r["is_best"]]
    least = min(r["avg_rmse"] for r in table)
    rows = [(r["rank"], r["reg_param"], r["avg_rmse"] > 0, len(best), best[0]["avg_rmse"] == least, bool(below),
             abs(before - after) < 1e-6) for r in table]
    return spark.createDataFrame(rows, "rank int, reg_param double, scored boolean, n_best int, best_is_least boolean, "
                                       "train_below_deviation boolean, reloaded_equal boolean")


def q_als_save_load(spark, sf):
    """Fit, save to the shared checkpoint folder, load, score the test split twice."""
    from prefmine.operators import als
    train, test = _supp_split(spark, sf)
    model = als.fit(train, **ALS_ARGS)
    path = _scratch(spark, "models")
    als.save(model, path)
    again = als.score(als.load(path), test).select("user_id", "item_id", F.col("prediction").alias("p"))
    both = als.score(model, test).join(again, ["user_id", "item_id"], "full")
    return both.select("user_id", "item_id", fx(F.col("rating").cast("double"), "rating"),
                       F.coalesce(F.col("prediction") == F.col("p"), F.lit(False)).alias("same"))


# ------------------------------------------------------- experiments

def q_neighbor_sweep(spark, sf):
    from prefmine.plans.experiments import neighbor_sweep
    train, test = _supp_split(spark, sf)
    return neighbor_sweep(train, test, P.NEIGHBOR_SWEEP).select(
        "n_neighbors", fx("rmse"), "n_covered", "n_actual", fx("coverage"))


SUPPORT_METRICS = ("n_itemsets", "n_rules", "n_matched", "tp", "fp", "fn", "precision", "recall")


def _supports(spark, sf):
    """Ledger rows of the support sweep, as a row per support."""
    from prefmine.plans import ledger as L
    from prefmine.plans.experiments import support_sweep
    led, data = _ledger(spark, sf, "lineitem", "part")
    rows = led.sweep(data, "rules by support", [{"support": s} for s in P.SUPPORT_SWEEP],
                     lambda points: support_sweep(_brand_marked(spark, sf), [p["support"] for p in points], P.MIN_CONFIDENCE),
                     SUPPORT_METRICS, together=True)
    wide = L.wide_rows(rows, ["support"], SUPPORT_METRICS)
    return wide.select("support", *[F.col(c).cast("bigint").alias(c) for c in SUPPORT_METRICS[:6]], "precision", "recall")


def q_support_sweep(spark, sf):
    return _supports(spark, sf).select(
        fx("support"), "n_itemsets", "n_rules", "n_matched", "tp", "fp", "fn",
        fx("precision"), fx("recall"))


def _ledger(spark, sf, *tables):
    """(ledger of the shared folder, name of the input tables): queries on the same inputs share it."""
    from prefmine.plans import ledger as L
    from prefmine.session import checkpoint_dir
    return (L.Ledger(spark, f"{checkpoint_dir(spark).rstrip('/')}/ledger"),
            L.data_id(spark, [f"{sf.rstrip('/')}/{t}.parquet" for t in tables]))


RATING_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")


def _cf_ledger(spark, sf, experiment, sweep, city):
    led, data = _ledger(spark, sf, *RATING_TABLES)

    def fit(points):
        train, test = _supp_split(spark, sf)
        return sweep(train, test, [p["n_neighbors"] for p in points])

    # The counts of a sweep share one model and one scoring pass.
    return led.sweep(data, experiment, [{"n_neighbors": n} for n in P.NEIGHBOR_SWEEP], fit,
                     ["rmse", "n_covered", "n_actual", "coverage"], city, together=True)


def _one_model(spark, sf):
    """Ledger rows: one item CF model, its test RMSE per city of the item."""
    from prefmine.plans.experiments import neighbor_sweep
    return _cf_ledger(spark, sf, "itemcf", lambda tr, te, ns: neighbor_sweep(tr, te, ns, by_city=True), "city")


def _city_models(spark, sf):
    """Ledger rows: a model per city term."""
    from prefmine.plans.experiments import city_neighbor_sweep
    return _cf_ledger(spark, sf, "itemcf by city", lambda tr, te, ns: city_neighbor_sweep(tr, te, P.CITY_TERMS, ns), "city_term")


def q_metric_filter(spark, sf):
    from prefmine.plans import ledger as L
    from prefmine.plans.experiments import select_rows
    m = select_rows(L.long_rows(_one_model(spark, sf), "n_neighbors"), param_value=10.0, metric="rmse")
    return m.select("experiment", "city", "run", "param", "param_value", "metric", fx("value"))


def q_metric_pivot(spark, sf):
    from prefmine.plans import ledger as L
    from prefmine.plans.experiments import pivot
    wide = L.wide_rows(_one_model(spark, sf), ["n_neighbors"], ["rmse"])
    p = pivot(wide.withColumn("n_neighbors", F.col("n_neighbors").cast("int")), "city", "n_neighbors", "rmse", P.NEIGHBOR_SWEEP, "rmse_n")
    return p.select("city", *[fx(f"rmse_n{n}") for n in P.NEIGHBOR_SWEEP])


def _compare(train, test, by, seed=0):
    """(*by, rmse_itemcf, n_als, rmse_als): item CF and ALS on the same split."""
    from prefmine.operators import als
    nb = itemcf.fit_neighbors(train, P.N_NEIGHBORS)
    rmse = F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))
    cf = (test.join(itemcf.predict_pairs(nb, train, test), ["user_id", "item_id"])
          .groupBy(*by).agg(rmse.alias("rmse_itemcf")))
    model = als.fit(train, rank=P.ALS_COMPARE_RANK, max_iter=P.ALS_MAX_ITER, reg_param=P.ALS_REG, seed=seed)
    preds = als.score(model, test)
    als.release_model(model)
    a = preds.drop("rating").join(test, ["user_id", "item_id"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n_als"), rmse.alias("rmse_als"))
    out = materialize(cf.join(a, by, "full").select(*by, "rmse_itemcf", F.coalesce("n_als", F.lit(0)).alias("n_als"), "rmse_als"), "compared")
    als.release_scored(preds)
    release(nb)
    return out


def _compared(rows, *by):
    return rows.select(*by, fx("rmse_itemcf"), F.col("n_als").cast("bigint").alias("n_als"), _finite("rmse_als").alias("als_finite"))


def q_metric_compare(spark, sf):
    """Per city: item CF (10 neighbours) and ALS on the same split."""
    return _compared(_compare(*_supp_split(spark, sf), ["city"]), "city")


COMPARED = ("rmse_itemcf", "n_als", "rmse_als")


def _compare_runs(spark, sf):
    """Ledger rows of five fresh splits, as a row per run."""
    from prefmine.plans import ledger as L
    led, data = _ledger(spark, sf, *RATING_TABLES)
    ratings = functools.cache(lambda: materialize(T.ratings_supp(spark, sf), "ratings_supp"))  # once, if any run is missing

    def fit(points):
        run = int(points[0]["split"])
        marked = materialize(splits.mark_split(ratings(), ["user_id", "item_id"], P.TEST_FRACTION, run)
                             .withColumn("split", F.lit(run)), "run")
        out = _compare(*splits.split_marked(marked), ["split"], seed=run)
        release(marked)
        return out

    rows = led.sweep(data, "itemcf and als", [{"split": i} for i in range(P.COMPARE_RUNS)], fit, COMPARED)
    return L.wide_rows(rows.drop("run").withColumn("run", F.lit(0)), ["split"], COMPARED)


def q_metric_compare_runs(spark, sf):
    """The same over five fresh splits, a row per run."""
    return _compared(_compare_runs(spark, sf).drop("run").withColumn("run", F.col("split").cast("int")), "run")


QUERIES.update({
    "als_predictions": q_als_predictions,
    "als_holdout_mean": q_als_holdout_mean,
    "als_certificate": q_als_certificate,
    "als_grid": q_als_grid,
    "als_save_load": q_als_save_load,
    "neighbor_sweep": q_neighbor_sweep,
    "support_sweep": q_support_sweep,
    "metric_filter": q_metric_filter,
    "metric_pivot": q_metric_pivot,
    "metric_compare": q_metric_compare,
    "metric_compare_runs": q_metric_compare_runs,
})


def q_itemcf_city_sweep(spark, sf):
    """Item CF trained per city term, for each neighbour count."""
    from prefmine.plans.experiments import city_neighbor_sweep
    train, test = _supp_split(spark, sf)
    return city_neighbor_sweep(train, test, P.CITY_TERMS, P.NEIGHBOR_SWEEP).select(
        "city_term", "n_neighbors", fx("rmse"), "n_covered", "n_actual", fx("coverage"))


CF_TIMES = ("n_train", "n_test", "rmse", "train_s", "test_s")


def _cf_times(spark, sf):
    """Ledger rows of item CF per city and neighbour count, each trained and timed by itself, as a row each."""
    from prefmine.plans import ledger as L
    from prefmine.plans.experiments import cf_times
    led, data = _ledger(spark, sf, *RATING_TABLES)

    def fit(points):
        train, test = _supp_split(spark, sf)
        rows = cf_times(train, test, P.ALS_CITY_TERMS, [int(p["n_neighbors"]) for p in points])
        return spark.createDataFrame([tuple(r[c] for c in ("city_term", "n_neighbors", *CF_TIMES)) for r in rows],
                                     "city_term string, n_neighbors int, n_train bigint, n_test bigint, rmse double, train_s double, test_s double")

    rows = led.sweep(data, "itemcf times", [{"n_neighbors": n} for n in P.NEIGHBOR_SWEEP if n > P.N_NEIGHBORS], fit, CF_TIMES, "city_term", together=True)
    wide = L.wide_rows(rows, ["n_neighbors"], CF_TIMES)
    return wide.select(F.col("city").alias("city_term"), F.col("n_neighbors").cast("int").alias("n_neighbors"),
                       F.col("n_train").cast("bigint").alias("n_train"), F.col("n_test").cast("bigint").alias("n_test"), "rmse", "train_s", "test_s")


def q_itemcf_city_times(spark, sf):
    """Item CF per city and neighbour count, each trained and timed by itself."""
    return _cf_times(spark, sf).select("city_term", "n_neighbors", "n_train", "n_test", fx("rmse"),
                                       ((F.col("train_s") > 0) & (F.col("test_s") > 0)).alias("timed"))


ALS_CITY_METRICS = ("n_train", "n_test", "n_scored", "rmse", "train_s", "test_s")


def _als_cities(spark, sf, ranks=P.ALS_CITY_RANKS):
    """Ledger rows of ALS per city term and rank; each rank's fits are committed together."""
    from prefmine.plans.experiments import als_city_sweep
    led, data = _ledger(spark, sf, *RATING_TABLES)
    split = functools.cache(lambda: _supp_split(spark, sf))  # once, if any rank is missing

    def fit(points):
        train, test = split()
        return materialize(als_city_sweep(train, test, P.ALS_CITY_TERMS, [p["rank"] for p in points], P.ALS_MAX_ITER, P.ALS_REG), "als-cities")

    return led.sweep(data, "als by city", [{"rank": r} for r in ranks], fit, ALS_CITY_METRICS, "city_term")


def _als_city_rows(spark, sf, ranks=P.ALS_CITY_RANKS):
    from prefmine.plans import ledger as L
    rows = L.wide_rows(_als_cities(spark, sf, ranks), ["rank"], ALS_CITY_METRICS)
    return rows.select(F.col("city").alias("city_term"), F.col("rank").cast("int").alias("rank"),
                       *[F.col(c).cast("bigint").alias(c) for c in ("n_train", "n_test", "n_scored")], "rmse", "train_s", "test_s")


def _als_city_flags(rows):
    return rows.select("city_term", "rank", "n_train", "n_test", "n_scored",
                       (_finite("rmse") | (F.col("n_scored") == 0)).alias("finite"), (F.col("train_s") > 0).alias("timed"))


def q_als_city_sweep(spark, sf):
    """ALS per city term and rank, each fitted and timed by itself."""
    return _als_city_flags(_als_city_rows(spark, sf))


def q_als_rank_rows(spark, sf):
    """The rows of one rank of that table, from the ledger."""
    from prefmine.plans.experiments import select_rows
    return _als_city_flags(select_rows(_als_city_rows(spark, sf, [100]), rank=100))


QUERIES.update({
    "itemcf_city_sweep": q_itemcf_city_sweep,
    "als_city_sweep": q_als_city_sweep,
    "als_rank_rows": q_als_rank_rows,
    "itemcf_city_times": q_itemcf_city_times,
})


def q_mining_counts(spark, sf):
    from prefmine.operators.patterns import mining_counts
    marked, itemsets, rules = _mined(spark, sf)
    return mining_counts(marked.where("NOT is_test"), itemsets, rules, assume_distinct=True)


def _city_long(spark, sf):
    from prefmine.plans import ledger as L
    rows = L.long_rows(_city_models(spark, sf), "n_neighbors").where(F.col("metric").isin("rmse", "coverage"))
    return rows.withColumn("experiment", F.lit("itemcf"))


def q_metric_head(spark, sf):
    """First five rows of the per-city CF metric table (by metric, city, n)."""
    from prefmine.plans.experiments import head
    h = head(_city_long(spark, sf), ["metric", "city", "param_value"], 5)
    return h.select("experiment", "city", "param_value", "metric", fx("value"))


def q_metric_slice(spark, sf):
    """Rows 5..9 of the same table in the same order."""
    from prefmine.plans.experiments import slice_rows
    s = slice_rows(_city_long(spark, sf), ["metric", "city", "param_value"], 5, 10)
    return s.select("experiment", "city", "param_value", "metric", fx("value"))


def q_metric_threshold(spark, sf):
    """Per-city CF rows with coverage above one half."""
    from prefmine.plans.experiments import threshold_rows
    m = threshold_rows(_city_long(spark, sf).where(F.col("metric") == "coverage"), "value", ">", 0.5)
    return m.select("experiment", "city", "param_value", "metric", fx("value"))


QUERIES.update({
    "mining_counts": q_mining_counts,
    "metric_head": q_metric_head,
    "metric_slice": q_metric_slice,
    "metric_threshold": q_metric_threshold,
})


def q_ratings_from_files(spark, sf):
    """The file pipeline end to end: review / user / business JSON lines
    (written from the tables, users and businesses in key order) -> CSV with
    header -> explicit-schema reads -> file-order ids -> averaged ratings."""
    import uuid

    from prefmine.session import checkpoint_dir
    from prefmine.sources import files
    base = f"{checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"
    rv = T.reviews(spark, sf, "supp").select(
        F.col("user_key").cast("string").alias("user_id"),
        F.col("item_key").cast("string").alias("business_id"), F.col("rate").alias("stars"))
    us = (T.table(spark, sf, "customer").orderBy("c_custkey")
          .select(F.col("c_custkey").cast("string").alias("user_id")))
    bs = (T.business(spark, sf).orderBy("item_key")
          .select(F.col("item_key").cast("string").alias("business_id"), "city"))
    for kind, df in (("review", rv), ("user", us), ("business", bs)):
        df.write.mode("overwrite").json(f"{base}/{kind}.json")
        files.convert_json(spark, f"{base}/{kind}.json", kind, f"{base}/{kind}.csv")
    reviews, users, business = files.read_review_tables(
        spark, f"{base}/review.csv", f"{base}/user.csv", f"{base}/business.csv")
    r = R.build_ratings(reviews, users, business)
    return r.select("user_id", "item_id", "city", fx("rating"))


QUERIES["ratings_from_files"] = q_ratings_from_files


def _scratch(spark, what: str) -> str:
    import uuid

    from prefmine.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}/{uuid.uuid4().hex}"


def q_city_files_roundtrip(spark, sf):
    """City selections written in one partitioned job, read back per folder."""
    path = _scratch(spark, "cities")
    R.write_city_files(T.ratings_supp(spark, sf), path, P.CITY_TERMS)
    back = spark.read.parquet(path)
    return back.groupBy("city_term").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_distinct("item_id").alias("n_items"))


def q_ratings_csv_roundtrip(spark, sf):
    """The rating table as header-less CSV with the positional 4-column schema (rating
    narrows to float): built once, then reused by a second call whose build must not
    run."""
    from prefmine.sources import files
    path = _scratch(spark, "allRate")

    def no_build():
        raise AssertionError("a finished table was built again")

    for build in (lambda: T.ratings_supp(spark, sf).select("user_id", "item_id", "city", "rating"), no_build):
        back = files.read_or_build(spark, path, build, fmt="csv", schema=files.RATING_CSV)
    return back.select("user_id", "item_id", "city",
                       fx(F.col("rating").cast("double"), "rating"))


def q_metric_csv_roundtrip(spark, sf):
    """Support sweep written as the two metric CSV layouts (counts; TP / FP /
    FN / precision / recall), read back with their schemas, joined on support."""
    from prefmine.sources import files
    sweep = _supports(spark, sf)
    base = _scratch(spark, "metrics")
    files.write_csv(sweep.select("support", F.col("n_itemsets").alias("numFreqItemsets"),
                                 F.col("n_rules").alias("numAssociateRules")),
                    f"{base}/freNum.csv", header=True)
    files.write_csv(sweep.select("support", F.col("tp").alias("TP"), F.col("fp").alias("FP"),
                                 F.col("fn").alias("FN"), "precision", "recall"),
                    f"{base}/freqResult.csv", header=True)
    counts = files.read_metric_csv(spark, f"{base}/freNum.csv", "freNum")
    quality = files.read_metric_csv(spark, f"{base}/freqResult.csv", "freqResult")
    j = counts.join(quality, "support")
    return j.select(fx("support"), "numFreqItemsets", "numAssociateRules", "TP", "FP", "FN",
                    fx("precision"), fx("recall"))


def q_best_csv_roundtrip(spark, sf):
    """Each city's best item-CF RMSE over the neighbour counts, written in the layout of
    the best-result table and read back."""
    from prefmine.sources import files
    best = _one_model(spark, sf).where(F.col("metric") == "rmse").groupBy("city").agg(F.min("value").alias("RMSE"))
    path = f"{_scratch(spark, 'metrics')}/bestResultForItem.csv"
    files.write_csv(best.select("RMSE"), path, header=True)
    return files.read_metric_csv(spark, path, "bestResultForItem").select(fx("RMSE"))


QUERIES.update({
    "best_csv_roundtrip": q_best_csv_roundtrip,
    "city_files_roundtrip": q_city_files_roundtrip,
    "ratings_csv_roundtrip": q_ratings_csv_roundtrip,
    "metric_csv_roundtrip": q_metric_csv_roundtrip,
})


def q_stream_ratings(spark, sf):
    """The rating build as a stream: review JSON files (from the tables) run
    through the stateful streaming aggregate into the parquet sink; the
    current table is the newest row per key."""
    from prefmine.streaming import ratings as S
    base = _scratch(spark, "stream")
    rv = T.reviews(spark, sf, "supp").select(
        F.col("user_key").cast("string").alias("user_id"),
        F.col("item_key").cast("string").alias("business_id"), F.col("rate").alias("stars"))
    rv.write.mode("overwrite").json(f"{base}/in")
    users = T.users(spark, sf).select(F.col("user_key").cast("string").alias("user_key"), "user_id")
    biz = T.business(spark, sf).select(F.col("item_key").cast("string").alias("item_key"),
                                       "item_id", "city")
    q = S.start(S.running_ratings(S.review_stream(spark, f"{base}/in", max_files_per_trigger=4),
                                  users, biz),
                f"stream_ratings_{base.rsplit('/', 1)[-1]}", path=f"{base}/out",
                trigger_once=True, checkpoint_location=f"{base}/ckpt")
    # availableNow stops by itself once the files present at start are done.
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    cur = S.latest(f"{base}/out", spark)
    return cur.select("user_id", "item_id", "city", fx("rating"))


QUERIES["stream_ratings"] = q_stream_ratings


# ------------------------------------------------- similarity by batches

def _review_batches(spark, sf, item):
    """Reviews in three batches by ship year; a pair reviewed in several of them changes
    its rating with each."""
    li = T.table(spark, sf, "lineitem").select("l_orderkey", item, "l_quantity", "l_shipdate")
    od = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rv = materialize(li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col(item).alias("item_id"), F.col("l_quantity").alias("rate"),
        F.pmod(F.coalesce(F.year("l_shipdate"), F.lit(0)), F.lit(3)).alias("batch")), "review-batches")
    return {f"year-{b}": rv.where(F.col("batch") == b).drop("batch") for b in range(3)}


def _by_batches(spark, sf, item):
    from prefmine.operators.increments import SimilarityStore
    store = SimilarityStore(spark, _scratch(spark, "similarity"), P.N_NEIGHBORS)
    for name, reviews in _review_batches(spark, sf, item).items():
        store.apply(name, reviews)
        store.apply(name, reviews)  # a repeated batch changes nothing
    return store


def q_similarity_by_batches(spark, sf):
    """All co-rated pairs after three batches of reviews, from stored sums and their changes."""
    return _by_batches(spark, sf, "l_partkey").similarity().select("item_a", "item_b", fx("similarity"), "n_common")


def q_neighbors_by_batches(spark, sf):
    """Neighbour lists after the same batches by supplier, then compacted."""
    store = _by_batches(spark, sf, "l_suppkey")
    store.compact()
    return store.neighbors().select("item_id", "neighbor_id", fx("similarity"), "n_common", "rank")


QUERIES.update({
    "similarity_by_batches": q_similarity_by_batches,
    "neighbors_by_batches": q_neighbors_by_batches,
})


# ------------------------------------------------ co-located rating tables

def _colocated(spark, sf):
    from prefmine.operators import colocated
    train, test = _supp_split(spark, sf)
    r = colocated.store(train, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return r, test, colocated.fit_neighbors(r, P.N_NEIGHBORS)


def q_colocated_predictions(spark, sf):
    """All predictions from bucketed tables: neither the pair join nor the scoring join shuffles ratings."""
    from prefmine.operators import colocated
    r, _, nb = _colocated(spark, sf)
    return colocated.predict_all(nb, r).select("user_id", "item_id", fx("prediction"))


def q_colocated_rmse_test(spark, sf):
    from prefmine.operators import colocated
    r, test, nb = _colocated(spark, sf)
    return _eval_cols(colocated.evaluate(nb, r, test))


QUERIES.update({
    "colocated_predictions": q_colocated_predictions,
    "colocated_rmse_test": q_colocated_rmse_test,
})


# ----------------------------------------------- mining from long rows

def _mined_from_rows(spark, sf):
    from prefmine.operators.longmine import mine_rows
    marked = _brand_marked(spark, sf)
    return mine_rows(marked.where("NOT is_test"), P.MIN_SUPPORT, P.MIN_CONFIDENCE)


def q_itemsets_from_rows(spark, sf):
    """The frequent itemsets of the train pairs, mined without building baskets."""
    from prefmine.operators.patterns import itemset_key
    itemsets, _ = _mined_from_rows(spark, sf)
    return itemsets.select(itemset_key("items").alias("items_key"), F.size("items").alias("size"), "freq")


def q_rules_from_rows(spark, sf):
    return _rule_cols(_mined_from_rows(spark, sf)[1])


QUERIES.update({
    "itemsets_from_rows": q_itemsets_from_rows,
    "rules_from_rows": q_rules_from_rows,
})


# ---------------------------- versioned reuse, quarantine, growing ids, city codes

def q_ratings_rebuilt(spark, sf):
    """The rating table of a folder of review files, reused while the folder stays as it is
    and rebuilt after more files arrive."""
    from prefmine.sources import files
    base = _scratch(spark, "versioned")
    rv = T.reviews(spark, sf, "supp").withColumn("late", F.pmod(F.xxhash64("user_key", "item_key", "rate"), F.lit(2)) == 1)
    rv = materialize(rv, "reviews")
    users, business = T.users(spark, sf), T.business(spark, sf).drop("is_open")

    def ratings(build):
        return files.read_or_build(spark, f"{base}/ratings", build, fmt="parquet", inputs=[f"{base}/reviews"], city="all")

    def build():
        return R.build_ratings(spark.read.parquet(f"{base}/reviews"), users, business)

    def no_build():
        raise AssertionError("an up-to-date table was built again")

    rv.where("NOT late").drop("late").write.parquet(f"{base}/reviews")
    ratings(build)
    ratings(no_build)
    rv.where("late").drop("late").write.mode("append").parquet(f"{base}/reviews")
    ratings(build)
    return ratings(no_build).select("user_id", "item_id", "city", fx("rating"))


def _flawed_reviews(spark, sf):
    """Folder of review JSON lines made from the tables, some of them bad by their number: cut short, without
    a user, with a word for the stars; a blank line after some."""
    path = _scratch(spark, "flawed")
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    od = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rv = li.join(od, li.l_orderkey == od.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_suppkey").cast("string").alias("business_id"), F.col("l_quantity").alias("stars"))
    flaw = F.pmod("review_id", F.lit(P.FLAWED))
    whole = F.to_json(F.struct("review_id", "user_id", "business_id", "stars"))
    line = (F.when(flaw == 0, F.expr("substring(whole, 1, length(whole) - 3)"))
            .when(flaw == 1, F.to_json(F.struct("review_id", "business_id", "stars")))
            .when(flaw == 2, F.to_json(F.struct("review_id", "user_id", "business_id", F.lit("many").alias("stars"))))
            .when(flaw == 3, F.concat("whole", F.lit("\n  "))).otherwise(F.col("whole")))
    rv.withColumn("whole", whole).select(line.alias("value")).write.text(path)
    return path


def _bad_columns(bad):
    return bad.select(F.regexp_extract("line", r'"review_id":(\d+)', 1).cast("bigint").alias("review_id"), "reason", (F.col("line_number") > 0).alias("placed"))


def _quarantined(spark, sf):
    from prefmine.sources import files, quarantine
    return quarantine.read_json(spark, _flawed_reviews(spark, sf), files.REVIEW_JSON, ["user_id", "business_id", "stars"],
                                _scratch(spark, "quarantine"), max_bad_share=0.5)


def q_quarantine_good(spark, sf):
    """The good rows of flawed review files."""
    good, _, _ = _quarantined(spark, sf)
    return good.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("business_id").cast("bigint").alias("business_id"), fx("stars"))


def q_quarantine_bad(spark, sf):
    """Their bad lines with the reason; the line number is that of the file."""
    return _bad_columns(_quarantined(spark, sf)[1])


def q_quarantine_stream(spark, sf):
    """Bad lines of the same files read as a stream."""
    from prefmine.sources import files, quarantine
    out = _scratch(spark, "quarantine")
    q = quarantine.start_stream(spark, _flawed_reviews(spark, sf), files.REVIEW_JSON, ["user_id", "business_id", "stars"], out,
                                f"quarantine_{out.rsplit('/', 1)[-1]}", max_bad_share=0.5, max_files_per_trigger=4, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return _bad_columns(quarantine.bad_lines(spark.read.parquet(out)))


def q_user_ids_by_batches(spark, sf):
    """User ids from a dictionary that three batches of pairs extend, in order of appearance."""
    from prefmine.operators.iddict import KeyDictionary
    pairs = materialize(_open_city_pairs(spark, sf, None, False), "pairs", most=F.max("item_id"))
    third = F.floor(F.col("item_id") * 3 / F.lit((pairs.metrics["most"] or 0) + 1))
    ids = KeyDictionary(spark, _scratch(spark, "ids"), "user_id", "user_index")
    for b in range(3):
        for _ in range(2):  # a repeated batch changes nothing
            ids.append(f"items-{b}", pairs.where(third == b), ["item_id", "user_id"])
    return ids.ids()


def q_city_fanout_coded(spark, sf):
    """The city selections from ratings stored by city code; names are matched on the dictionary alone."""
    codes = R.city_codes(T.business(spark, sf))
    path = _scratch(spark, "by-city-code")
    R.write_by(R.coded_ratings(T.ratings_supp(spark, sf), codes), path, "city_code")
    out = R.fanout_by_code(spark.read.parquet(path), R.matching_codes(codes, P.CITY_TERMS))
    return out.select("city_term", "user_id", "item_id", "city", fx("rating"))


def q_split_random(spark, sf):
    """Spark's own random split of the rating table: nothing lost, nothing on both sides, the same rows
    again, sizes around the weights."""
    r = materialize(T.ratings_supp(spark, sf), "ratings_supp", n=F.count(F.lit(1)))
    key = ["user_id", "item_id", "city"]
    (a, b), (a2, b2) = splits.random_split(r, (0.8, 0.2), P.SEED), splits.random_split(r, (0.8, 0.2), P.SEED)
    sides = None
    for bit, df in enumerate((a, b, a2, b2)):
        own = df.select(*key, F.lit(1 << bit).alias("side"))
        sides = own if sides is None else sides.unionByName(own)
    # 5: first side both times, 10: second side both times.
    marks = sides.groupBy(*key).agg(F.sum("side").alias("mark"))
    one = marks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") == 5).alias("train"), F.count_if(F.col("mark") == 10).alias("test"))
    spread = 6 * F.sqrt(F.col("n") * F.lit(0.16))
    return one.select(F.lit(r.metrics["n"]).cast("bigint").alias("n_rows"), (F.col("train") + F.col("test") == F.col("n")).alias("disjoint_and_repeated"),
                      (F.abs(F.col("test") - 0.2 * F.col("n")) <= spread).alias("near_weights"))


QUERIES.update({
    "ratings_rebuilt": q_ratings_rebuilt,
    "quarantine_good": q_quarantine_good,
    "quarantine_bad": q_quarantine_bad,
    "quarantine_stream": q_quarantine_stream,
    "user_ids_by_batches": q_user_ids_by_batches,
    "city_fanout_coded": q_city_fanout_coded,
    "split_random": q_split_random,
})


# ------------------------------------------- all ten metric tables as files

def _metric_tables(spark, sf):
    """Layout name -> its table, from the ledger (missing points are run)."""
    from prefmine.operators import als
    from prefmine.plans import ledger as L
    led, data = _ledger(spark, sf, *RATING_TABLES)

    def grid(points):
        train, _ = _supp_split(spark, sf)
        cv = als.grid_search(train, P.ALS_GRID_RANKS, P.ALS_GRID_REGS, num_folds=P.ALS_FOLDS, parallelism=4, max_iter=P.ALS_MAX_ITER)
        als.release_model(cv.bestModel)
        return _grid_frame(spark, als.grid_table(cv))

    points = L.wide_rows(led.sweep(data, "als grid", GRID_POINTS, grid, ["avg_rmse", "is_best"], together=True), ["rank", "regParam"], ["avg_rmse"])
    neighbors = _cf_ledger(spark, sf, "itemcf all cities", _neighbor_sweep, None)
    runs, cities, times, supports = _compare_runs(spark, sf), _als_city_rows(spark, sf), _cf_times(spark, sf), _supports(spark, sf)
    # A city none of whose test pairs can be scored has no best result.
    best = lambda rows, city, rmse: rows.groupBy(city).agg(F.min(rmse).alias("RMSE")).where("RMSE IS NOT NULL").select("RMSE")
    return {
        "alsRMSE": points.select("regParam", F.col("rank").cast("int").alias("rankValue"), F.col("avg_rmse").alias("RMSE")),
        "itemRMSE": L.wide_rows(neighbors, ["n_neighbors"], ["rmse"]).select(F.col("n_neighbors").cast("int").alias("neighbor_number"), F.col("rmse").alias("RMSE")),
        "alsItem": runs.select(F.col("rmse_als").alias("RMSE_ALS"), F.col("rmse_itemcf").alias("RMSE_Item")),
        "freNum": supports.select("support", F.col("n_itemsets").alias("numFreqItemsets"), F.col("n_rules").alias("numAssociateRules")),
        "freqResult": supports.select("support", F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("fn").alias("FN"), "precision", "recall"),
        "alsRst": cities.select(F.col("rank").alias("rankOfALS"), F.col("city_term").alias("cityName"), F.col("n_train").alias("DataSize"),
                                F.col("rmse").alias("RMSE"), F.col("train_s").alias("trainTime")),
        "clRst": times.select(F.col("n_neighbors").alias("neighborNumber"), F.col("city_term").alias("cityName"), F.col("rmse").alias("RMSE"),
                              F.col("train_s").alias("trainTime"), F.col("test_s").alias("testTime")),
        "singleMachineTestTime": cities.where("rank = 100 AND train_s IS NOT NULL").select(F.col("train_s").alias("trainTime")),
        "bestResultForALS": best(cities, "city_term", "rmse"),
        "bestResultForItem": best(_one_model(spark, sf).where("metric = 'rmse'"), "city", "value"),
    }


def _neighbor_sweep(train, test, ns):
    from prefmine.plans.experiments import neighbor_sweep
    return neighbor_sweep(train, test, ns)


def q_metric_layouts(spark, sf):
    """All ten metric tables written as files and read back by their layouts: rows, and whether
    every value came back (both sides counted row by row)."""
    from prefmine.sources import files
    base, out = _scratch(spark, "layouts"), None
    for name, table in _metric_tables(spark, sf).items():
        table = materialize(table, name)
        files.write_csv(table, f"{base}/{name}.csv", header=True)
        back = files.read_metric_csv(spark, f"{base}/{name}.csv", name)
        sides = table.select(*back.columns, F.lit(1).alias("_side")).unionByName(back.withColumn("_side", F.lit(-1)))
        same = sides.groupBy(*back.columns).agg(F.sum("_side").alias("d"), F.count_if(F.col("_side") == 1).alias("n"))
        row = same.agg(F.lit(name).alias("layout"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), (F.coalesce(F.max(F.abs("d")), F.lit(0)) == 0).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["metric_layouts"] = q_metric_layouts
