"""Edge rows: zero ratings, single user, test-only users, baskets that fire
nothing, duplicate reviews in the pair input."""


from conftest import rows
from prefmine.operators import itemcf, patterns, splits


def _ratings(spark, triples):
    return spark.createDataFrame(triples, "user_id bigint, item_id bigint, rating double")


def test_all_zero_ratings_give_zero_similarity_and_prediction(spark):
    r = _ratings(spark, [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 0.0)])
    sim = itemcf.item_similarity(r).collect()
    assert [(s.item_a, s.item_b, s.similarity, s.n_common) for s in sim] == [(1, 2, 0.0, 2)]
    nb = itemcf.top_neighbors(itemcf.item_similarity(r), 5)
    preds = {(p.user_id, p.item_id): p.prediction for p in itemcf.predict_all(nb, r).collect()}
    assert preds == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 0.0}


def test_single_user_and_single_rating_items(spark):
    r = _ratings(spark, [(7, 1, 2.0), (7, 2, 4.0), (7, 3, 1.0)])
    sim = rows(itemcf.item_similarity(r), "item_a", "item_b", "similarity", "n_common")
    assert sim == [(1, 2, 1.0, 1), (1, 3, 1.0, 1), (2, 3, 1.0, 1)]
    one = _ratings(spark, [(1, 1, 5.0)])
    assert itemcf.item_similarity(one).count() == 0
    padded = itemcf.top_neighbors(itemcf.item_similarity(one), 3, pad_zero=True,
                                  items=one.select("item_id"))
    assert padded.count() == 0


def test_user_only_in_test_is_not_covered(spark):
    train = _ratings(spark, [(1, 1, 3.0), (1, 2, 4.0), (2, 1, 5.0), (2, 2, 1.0)])
    test = _ratings(spark, [(1, 2, 4.0), (9, 1, 2.0)])
    nb = itemcf.top_neighbors(itemcf.item_similarity(train), 2)
    ev = itemcf.evaluate(itemcf.predict_pairs(nb, train, test), test).collect()[0]
    assert (ev.n_covered, ev.n_actual, ev.coverage) == (1, 2, 0.5)


def test_basket_matching_no_rule_gets_nothing(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "z")], "user_id bigint, item string")
    rules = spark.createDataFrame([(["a"], ["b"], 1.0, 1.0, 0.5)],
                                  "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    assert rows(patterns.fire_rules(pairs, rules)) == [(1, "b")]
    test = spark.createDataFrame([(2, "y"), (1, "b")], "user_id bigint, item string")
    assert rows(patterns.score_rules(pairs, rules, test)) == [(1, 1, 0, 0)]


def test_duplicate_pairs_do_not_fake_containment(spark):
    # user 1 has item a twice but not b: rule {a, b} -> c must not fire
    pairs = spark.createDataFrame([(1, "a"), (1, "a")], "user_id bigint, item string")
    rules = spark.createDataFrame([(["a", "b"], ["c"])], "antecedent array<string>, consequent array<string>")
    assert patterns.fire_rules(pairs, rules).count() == 0


def test_zero_test_fraction_and_empty_test(spark):
    r = _ratings(spark, [(1, 1, 3.0), (2, 2, 4.0)])
    train, test = splits.exact_split(r, ["user_id", "item_id"], 0.1, 0)
    assert test.count() == 0 and train.count() == 2
    empty = r.where("false")
    ev = itemcf.evaluate(itemcf.predict_all(itemcf.top_neighbors(itemcf.item_similarity(r), 2), r), empty)
    got = ev.collect()[0]
    assert got.rmse is None and got.n_actual == 0 and got.coverage is None
