"""ALS on the customer x supplier ratings: shapes and sanity."""

from pyspark.sql import functions as F

from conftest import SF001
from prefmine.operators import als, splits
from prefmine.sources import testdata as T


def test_als_fit_score_save_load(spark, tmp_dir):
    r = T.ratings_supp(spark, SF001)
    train, test = splits.hash_split(r, ["user_id", "item_id"], 0.2, 0)
    m = als.fit(train, rank=5, max_iter=3, reg_param=0.1)
    p = als.score(m, test)
    n = p.count()
    assert 0 < n <= test.count()
    assert p.where(F.isnan("prediction")).count() == 0   # cold-start rows dropped
    err = als.rmse(p)
    assert err is not None and err > 0
    als.save(m, tmp_dir + "/m")
    again = als.score(als.load(tmp_dir + "/m"), test)
    a = {(x.user_id, x.item_id): x.prediction for x in p.collect()}
    b = {(x.user_id, x.item_id): x.prediction for x in again.collect()}
    assert a == b


def test_als_grid_marks_best(spark):
    r = T.ratings_supp(spark, SF001)
    cv = als.grid_search(r, ranks=(2, 3), reg_params=(0.1,), num_folds=2, parallelism=2, max_iter=2)
    table = als.grid_table(cv)
    assert len(table) == 2 and sum(t["is_best"] for t in table) == 1
    best = min(table, key=lambda t: t["avg_rmse"])
    assert best["is_best"]


def test_id_range_check(spark):
    import pytest
    df = spark.createDataFrame([(2**40, 1, 1.0)], "user_id bigint, item_id bigint, rating double")
    with pytest.raises(Exception, match="integer range"):
        als.to_als_input(df).collect()
    assert als.to_als_input(df.limit(0)).count() == 0


def test_cv_model_save_load(spark, tmp_dir):
    r = T.ratings_supp(spark, SF001)
    cv = als.grid_search(r, ranks=(2,), reg_params=(0.1,), num_folds=2, parallelism=1, max_iter=2)
    als.save(cv, tmp_dir + "/cv")
    again = als.load(tmp_dir + "/cv", cv=True)
    assert als.rmse(als.score(again.bestModel, r)) == als.rmse(als.score(cv.bestModel, r))


def test_blocks_do_not_follow_the_cluster():
    e = als.als_estimator()
    assert (e.getNumUserBlocks(), e.getNumItemBlocks(), e.getRank(), e.getMaxIter()) == (10, 10, 200, 20)


def test_cities_in_one_fit_are_separate_models(spark):
    """A city's factors do not depend on which other cities share the fit."""
    from prefmine.plans.experiments import als_city_sweep
    train, test = splits.hash_split(T.ratings_supp(spark, SF001), ["user_id", "item_id"], 0.2, 0)
    both = als_city_sweep(train, test, ["nation_1", "nation_2"], [3], 5, 0.1, num_blocks=2).collect()
    assert {r.city_term for r in both} == {"nation_1", "nation_2"}
    for r in both:
        one = train.where(F.lower("city").contains(r.city_term))
        assert r.n_train == one.count() and r.n_scored <= r.n_test and r.rmse > 0


def _tiny(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(30) for i in range(12) if rng.random() < 0.5] + [(5, i + 100, 2.0) for i in range(40)]
    return rows, spark.createDataFrame(rows, "user_id int, item_id int, rating double")


def test_certificate_against_an_independent_solver(spark, tmp_dir):
    import numpy as np
    rows, df = _tiny(spark)
    m = als.fit(df, rank=4, max_iter=6, reg_param=0.1, num_blocks=2)
    y = {r.id: np.array(r.features) for r in m.itemFactors.collect()}
    x = {r.id: np.array(r.features) for r in m.userFactors.collect()}
    for u in {r[0] for r in rows}:
        own = [(i, v) for w, i, v in rows if w == u]
        a = sum(np.outer(y[i], y[i]) for i, _ in own) + 0.1 * len(own) * np.eye(4)
        assert np.allclose(np.linalg.solve(a, sum(v * y[i] for i, v in own)), x[u], atol=1e-4)
    res = {r.user_id: r for r in als.normal_equation_residuals(m, df, 0.1).collect()}
    assert max(r.residual / r.scale for r in res.values()) < 1e-4
    assert {u: r.n for u, r in res.items()} == {u: sum(w == u for w, _, _ in rows) for u in res}
    one = als.certificate(m, df, df.limit(50), 0.1).first()
    want = np.sqrt(np.mean([(x[u] @ y[i] - v) ** 2 for u, i, v in rows]))
    assert abs(one.train_rmse - want) < 1e-6 and one.worst < 1e-4 and one.n_scored == 50 and one.n_users == 30


def test_a_wrong_model_has_no_certificate(spark):
    _, df = _tiny(spark)
    m = als.fit(df, rank=4, max_iter=6, reg_param=0.1, num_blocks=2)
    assert als.certificate(m, df, df, 0.5).first().worst > 1e-3          # another regularisation
    assert als.certificate(m, df.withColumn("rating", F.col("rating") + 1), df, 0.1).first().worst > 1e-3


def test_holdout_means_and_observed_sizes(spark):
    r = T.ratings_supp(spark, SF001)
    mark = lambda df, seed: splits.mark_split(df, ["user_id", "item_id"], 0.2, seed)
    runs = als.holdout_runs(r, mark, runs=2, rank=3, max_iter=2, num_blocks=2)
    for run in runs:
        train, test = splits.hash_split(r, ["user_id", "item_id"], 0.2, run["run"])
        assert (run["n_train"], run["n_test"]) == (train.count(), test.count())
    table = {t.run: t for t in als.holdout_table(spark, runs).collect()}
    for c in ("rmse", "train_s", "test_s", "n_scored"):
        assert abs(table["mean"][c] - sum(t[c] for t in runs) / 2) < 1e-9


def test_blocks_follow_ratings_and_rank():
    assert als.blocks_for(1000, 10) == 4 and als.blocks_for(10**12, 200) == 400
    assert als.blocks_for(10**7, 200) == 60


def test_few_ratings_are_solved_by_the_small_system():
    import numpy as np
    from prefmine.operators.alsblocks import solve
    rng = np.random.default_rng(1)
    y, k = rng.normal(size=(40, 6)).astype(np.float32), 6
    counts = np.array([1, 6, 30, 3, 7, 1])      # below, at and above the rank
    at, r = np.concatenate([rng.choice(40, n, replace=False) for n in counts]), rng.normal(size=counts.sum()).astype(np.float32)
    x, lo = solve(y, at, r, counts, 0.1), 0
    for j, n in enumerate(counts):
        g = y[at[lo:lo + n]].astype(float)
        assert np.allclose(x[j], np.linalg.solve(g.T @ g + 0.1 * n * np.eye(k), g.T @ r[lo:lo + n]), atol=1e-5)
        lo += n


def test_factors_do_not_depend_on_the_blocks(spark):
    import numpy as np
    _, df = _tiny(spark)
    one, many = ({(s, r.id): r.features for s, t in (("u", m.userFactors), ("i", m.itemFactors)) for r in t.collect()}
                 for m in (als.fit(df, rank=4, max_iter=3, num_blocks=n) for n in (1, 5)))
    assert one.keys() == many.keys() and len(one) == 30 + 52
    assert all(np.allclose(one[k], many[k], atol=1e-3) for k in one)


def test_a_fit_without_ratings_says_so(spark):
    import pytest
    with pytest.raises(ValueError, match="no ratings"):
        als.fit(_tiny(spark)[1].limit(0), rank=2, max_iter=1)


def _written(spark):
    import glob

    from prefmine.session import checkpoint_dir
    return set(glob.glob(checkpoint_dir(spark).removeprefix("file:").removeprefix("//") + "/tables/*"))


def test_waves_blocks_and_one_task_give_the_same_model(spark, monkeypatch):
    """Messages cut into waves, half-steps chained, and a whole fit in one task; only the model's tables stay."""
    import numpy as np
    from prefmine.operators import alsblocks
    _, df = _tiny(spark)
    got, before = [], _written(spark)
    for here, wave in ((3e11, 256 << 20), (0, 256 << 20), (0, 1), (0, 4000)):
        monkeypatch.setattr(alsblocks, "HERE_WORK", here)
        monkeypatch.setattr(alsblocks, "WAVE_BYTES", wave)
        monkeypatch.setattr(alsblocks, "WAVE_PER_RATING", 0)
        m = als.fit(df, rank=4, max_iter=4, num_blocks=5)
        assert len(_written(spark) - before) == 2
        got.append({(s, r.id): r.features for s, t in (("u", m.userFactors), ("i", m.itemFactors)) for r in t.collect()})
        pairs = df.unionByName(spark.createDataFrame([(5, 9999, 1.0), (9999, 3, 1.0), (5, 3, 2.0)], df.schema))
        mine = als.score(m, pairs)
        ml = {(r.user_id, r.item_id): r.prediction for r in super(alsblocks.BlockedALSModel, m)._transform(als.to_als_input(pairs)).collect()}
        assert mine.columns == ["user_id", "item_id", "rating", "prediction"] and mine.count() == df.count() + 1
        assert {(r.user_id, r.item_id) for r in mine.collect()} == set(ml)
        assert all(abs(r.prediction - ml[r.user_id, r.item_id]) < 1e-4 for r in mine.collect())
        res = als.normal_equation_residuals(m, df, 0.1).collect()
        assert len(res) == 30 and max(r.residual / r.scale for r in res) < 1e-4
        als.release_scored(mine)
        als.release_model(m)
        before = _written(spark)
    assert len(got[0]) == 30 + 52
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(np.allclose(other[k], got[0][k], atol=1e-3) for k in other)


def test_scoring_nothing_and_strangers(spark):
    _, df = _tiny(spark)
    m = als.fit(df, rank=4, max_iter=2, num_blocks=2)
    strangers = spark.createDataFrame([(777, 888, 1.0)], df.schema)
    assert als.score(m, df.limit(0)).count() == 0 and als.score(m, strangers).count() == 0
    one = als.certificate(m, df, strangers, 0.1).first()
    assert one.n_scored == 0 and one.test_rmse is None


def test_a_grid_keeps_the_best_model_only(spark):
    before = _written(spark)
    cv = als.grid_search(_tiny(spark)[1], ranks=(2, 3), reg_params=(0.1,), num_folds=2, parallelism=2, max_iter=2)
    assert len(_written(spark) - before) == 2
    assert cv.bestModel.userFactors.count() == 30


def test_small_city_fits_run_side_by_side_under_their_own_tags(spark, monkeypatch):
    """Every fit of the table is at work at the same time, each thread with its own job tag only."""
    import threading
    from prefmine.plans import experiments
    train, test = splits.hash_split(T.ratings_supp(spark, SF001), ["user_id", "item_id"], 0.2, 0)
    fit, seen, met = als.fit, [], threading.Barrier(4, timeout=60)

    def meeting(*a, **k):
        met.wait()
        seen.append(set(spark.sparkContext.getJobTags()))
        return fit(*a, **k)

    monkeypatch.setattr(als, "fit", meeting)
    got = experiments.als_city_sweep(train, test, ["nation_1", "nation_2"], [2, 3], 2, 0.1).collect()
    assert [(r.city_term, r["rank"]) for r in got] == [(c, k) for c in ("nation_1", "nation_2") for k in (2, 3)]
    assert all(r.rmse > 0 and r.train_s > 0 for r in got)
    assert sorted(map(sorted, seen)) == sorted([experiments.als_tag(c, k)] for c in ("nation_1", "nation_2") for k in (2, 3))
