"""Baskets, FP-Growth rules, division-based rule firing, TP/FP/FN."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from prefmine.operators import patterns
from prefmine.sources import testdata as T


def _pairs(spark, data):
    return spark.createDataFrame(data, "user_id bigint, item string")


def test_division_equals_fpgrowth_transform(spark):
    pairs = T.brand_pairs(spark, SF001)
    b = patterns.baskets(pairs)
    m = patterns.fit_fpgrowth(b, 0.01, 0.1)
    ours = rows(patterns.fire_rules(pairs, m.associationRules), "user_id", "item")
    ref = (m.transform(b).select("user_id", F.explode("prediction").alias("item")))
    assert ours == rows(ref, "user_id", "item")
    assert len(ours) > 0


def test_fire_rules_subset_and_owned_items(spark):
    pairs = _pairs(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "c")])
    rules = spark.createDataFrame(
        [(["a", "b"], ["c"], 0.5, 1.0, 0.1), (["a"], ["b"], 0.5, 1.0, 0.1), (["c"], ["a"], 0.5, 1.0, 0.1)],
        "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    got = rows(patterns.fire_rules(pairs, rules), "user_id", "item")
    # user 1 owns a, b -> fires {a,b}->c and a->b (b owned); user 2 fires a->b; user 3 fires c->a
    assert got == [(1, "c"), (2, "b"), (3, "a")]


def test_tp_fp_fn_only_users_with_predictions(spark):
    pred = _pairs(spark, [(1, "a"), (1, "b"), (2, "c")])
    test = _pairs(spark, [(1, "a"), (1, "d"), (3, "x")])
    per = rows(patterns.tp_fp_fn(pred, test), "user_id", "tp", "fp", "fn")
    assert per == [(1, 1, 1, 1)]
    everyone = rows(patterns.tp_fp_fn(pred, test, all_test_users=True), "user_id", "tp", "fp", "fn")
    assert everyone == [(1, 1, 1, 1), (3, 0, 0, 1)]
    t = patterns.precision_recall(patterns.tp_fp_fn(pred, test)).collect()[0]
    assert (t.tp, t.fp, t.fn, t.precision, t.recall) == (1, 1, 1, 0.5, 0.5)


def test_precision_recall_no_overlap_is_null(spark):
    pred = _pairs(spark, [(1, "a")])
    test = _pairs(spark, [(2, "b")])
    t = patterns.precision_recall(patterns.tp_fp_fn(pred, test)).collect()[0]
    assert t.n_matched == 0 and t.precision is None and t.recall is None


def test_basket_stats_and_distinct_antecedents(spark):
    pairs = _pairs(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "a"), (3, "b")])
    s = patterns.basket_stats(pairs).collect()[0]
    assert (s.n_pairs, s.n_users, s.n_items, s.max_basket) == (6, 3, 3, 3)
    rules = spark.createDataFrame([(["b", "a"], ["c"]), (["a", "b"], ["d"]), (["a"], ["b"])],
                                  "antecedent array<string>, consequent array<string>")
    got = rows(patterns.distinct_antecedents(rules), "antecedent_key", "ante_size", "n_rules")
    assert got == [("a", 1, 1), ("a,b", 2, 2)]


def test_distinct_pairs_city_and_accents(spark):
    review = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, 12)], "item_id bigint, user_id bigint")
    business = spark.createDataFrame([(1, "Montréal", 1), (2, "Montreal", 1), (3, "Montréal", 0)],
                                     "item_id bigint, city string, is_open int")
    exact = rows(patterns.distinct_pairs(review, business, "Montréal"))
    assert exact == [(1, 10)]
    folded = rows(patterns.distinct_pairs(review, business, "Montréal", accent_insensitive=True))
    assert folded == [(1, 10), (2, 11)]


def test_score_rules_equals_fire_then_tp_fp_fn(spark):
    from prefmine.operators import splits
    pairs = T.brand_pairs(spark, SF001)
    train, test = splits.exact_split(pairs, ["user_id", "item"], 0.1, 0)
    _, rules = patterns.mine(patterns.baskets(train), 0.01, 0.1)
    fused = rows(patterns.score_rules(train, rules, test))
    composed = rows(patterns.tp_fp_fn(patterns.fire_rules(train, rules), test))
    assert fused == composed and len(fused) > 0
    fused_all = rows(patterns.score_rules(train, rules, test, all_test_users=True))
    composed_all = rows(patterns.tp_fp_fn(patterns.fire_rules(train, rules), test, all_test_users=True))
    assert fused_all == composed_all


def test_score_rules_with_longer_antecedents(spark):
    pairs = _pairs(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "q"), (4, "a")])
    test = _pairs(spark, [(1, "c"), (1, "z"), (2, "b"), (3, "y"), (5, "c")])
    rules = spark.createDataFrame(
        [(["a"], ["b"], 0.5, 1.0, 0.1), (["a", "b"], ["c"], 0.5, 1.0, 0.1), (["a"], ["d"], 0.5, 1.0, 0.1)],
        "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    for everyone in (False, True):
        want = rows(patterns.tp_fp_fn(patterns.fire_rules(pairs, rules), test, all_test_users=everyone))
        assert rows(patterns.score_rules(pairs, rules, test, all_test_users=everyone)) == want
    # user 1: predicted c, d -> tp 1 (c), fp 1 (d), fn 1 (z); user 2: b, d vs b; user 4: b, d vs nothing
    assert rows(patterns.score_rules(pairs, rules, test)) == [(1, 1, 1, 1), (2, 1, 1, 0)]


def test_fire_rules_equals_brute_force(spark):
    import random
    rng = random.Random(3)
    baskets = {u: {rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))} for u in range(40)}
    rules = [(sorted(rng.sample("abcdefgh", rng.randint(1, 4))), [rng.choice("abcdefghxyz")]) for _ in range(30)]
    pairs = _pairs(spark, [(u, i) for u, items in baskets.items() for i in items] * 2)  # repeated pairs
    got = rows(patterns.fire_rules(pairs, spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>")))
    assert got == sorted({(u, c[0]) for u, items in baskets.items() for a, c in rules if set(a) <= items and c[0] not in items})


def test_rules_stand_under_their_rarest_item(spark):
    pairs = _pairs(spark, [(1, "a"), (2, "a"), (3, "a"), (1, "b"), (2, "b"), (1, "c")])
    rules = spark.createDataFrame([(["a", "b"], ["x"]), (["a"], ["y"]), (["a", "b", "c"], ["z"]), (["a", "q"], ["x"])],
                                  "antecedent array<string>, consequent array<string>")
    counts = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ante, then = patterns.rules_by_item(rules, counts)
    got = {(r.key, r.item, *sorted(r.others)) for r in ante.collect()}
    assert got == {("a", "a"), ("a,b", "b", "a"), ("a,b,c", "c", "a", "b"), ("a,q", "q", "a")}
    named = {r.rule: r.key for r in ante.collect()}
    got = {(named[r.rule], r.item, r.alone, r.consequent) for r in then.collect()}
    assert got == {("a", "a", True, "y"), ("a,b", "b", False, "x"), ("a,b,c", "c", False, "z"), ("a,q", "q", False, "x")}
    assert ante.metrics["longer"] == 3


@pytest.mark.parametrize("broadcast", [-1, 10 << 20])
def test_hot_items_and_hot_antecedents_are_salted(spark, broadcast):
    """An item and an antecedent that a third of all rows hold, cut into chunks of three rows."""
    import random
    rng = random.Random(7)
    baskets = {u: {"hot"} | {rng.choice("abcdef") for _ in range(2)} for u in range(60)}
    rules = [(["hot"], ["z"]), (["hot"], ["a"]), (["hot", "a"], ["b"]), (["hot", "a"], ["y"]), (["a", "b", "hot"], ["c"]), (["no"], ["a"])]
    pairs = _pairs(spark, [(u, i) for u, items in baskets.items() for i in items] + [(None, "hot"), (9, None)])
    marked = pairs.withColumn("is_test", F.lit(False))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        table = spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>")
        got = patterns._flags(marked, table, chunk=3).where("rec = 1 AND own = 0 AND user_id IS NOT NULL")
        got = rows(got, "user_id", "item")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted({(u, c[0]) for u, items in baskets.items() for a, c in rules if set(a) <= items and c[0] not in items})


def test_no_rules_and_no_pairs_fire_nothing(spark):
    rules = spark.createDataFrame([(["a"], ["b"])], "antecedent array<string>, consequent array<string>")
    pairs = _pairs(spark, [(1, "a")])
    assert rows(patterns.fire_rules(pairs, rules.where("false"))) == []
    assert rows(patterns.fire_rules(pairs.where("false"), rules)) == []


def test_suggestions_are_merged_where_the_users_rows_are(spark, monkeypatch):
    """Dealt once by user, a task for so many suggestions; hot users and large rule tables are spread."""
    import random
    rng = random.Random(11)
    baskets = {u: {rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))} for u in range(50)}
    baskets[100] = set("abcdefgh")
    rules = [(sorted(rng.sample("abcdefgh", k)), [rng.choice("abcdefghxyz")], k) for k in (1, 1, 1, 2, 2, 3, 4) for _ in range(6)]
    table = spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>, level int")
    pairs = _pairs(spark, [(u, i) for u, items in baskets.items() for i in items])
    marked = pairs.withColumn("is_test", F.lit(False)).unionByName(
        _pairs(spark, [(1, "x"), (1, "q"), (200, "a"), (None, "a")]).withColumn("is_test", F.lit(True)))
    want = {(u, i): (1, 0, 0) for u, items in baskets.items() for i in items} | {(1, "x"): (0, 1, 0), (1, "q"): (0, 1, 0), (200, "a"): (0, 1, 0), (None, "a"): (0, 1, 0)}
    for u, items in baskets.items():
        for a, c, level in rules:
            if set(a) <= items:
                own, test, rec = want.get((u, c[0]), (0, 0, 0))
                want[(u, c[0])] = own, test, max(rec, level)

    def flags(chunk=1 << 18):
        df = patterns._flags(marked, table, chunk=chunk)
        return df, {(r.user_id, r.item): (r.own, r.test, r.rec) for r in df.collect()}

    monkeypatch.setattr(patterns, "FIRED_ROWS", 20)
    df, got = flags()
    assert got == want
    assert df.rdd.getNumPartitions() > 10
    final = df._jdf.queryExecution().toString().split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(user_id") == 1
    assert flags(chunk=7)[1] == want  # user 100 is hot
    monkeypatch.setattr(patterns, "EVERYWHERE_ROWS", 3)
    assert flags()[1] == want


def test_support_sweep_mines_and_fires_once(spark, monkeypatch):
    import random

    from prefmine.plans.experiments import support_sweep
    rng = random.Random(5)
    groups = ["abcd", "ce", "fgh"]
    pairs = {(u, i, rng.random() < 0.2) for u in range(120) for g in groups if rng.random() < 0.5 for i in g}
    pairs |= {(u, f"z{u % 40}", True) for u in range(0, 150, 3)}
    pairs = {(u, i): t for u, i, t in sorted(pairs)}
    marked = spark.createDataFrame([(u, i, t) for (u, i), t in pairs.items()], "user_id long, item string, is_test boolean")
    supports = (0.3, 0.02, 0.1, 0.9)
    want = []
    for s in supports:
        itemsets, rules = patterns.mine(patterns.baskets(marked.where("NOT is_test")), s, 0.3)
        t = patterns.precision_recall(patterns.score_marked(marked, rules)).first()
        want.append((s, itemsets.count(), rules.count(), *t))
    assert len({w[2] for w in want}) == 4 and want[-1][2:] == (0, 0, 0, 0, 0, None, None)
    fits, fit = [], patterns.fit_fpgrowth
    monkeypatch.setattr(patterns, "fit_fpgrowth", lambda *a: fits.append(a) or fit(*a))
    got = [tuple(r) for r in support_sweep(marked, supports, 0.3).collect()]
    assert sorted(got) == sorted(want) and len(fits) == 1


def test_an_exact_split_stores_half_the_order_key(spark):
    """The md5 as 16 bytes; the rest of the order key is made from the row where it is needed."""
    from prefmine.operators import splits
    from prefmine.session import materialize
    written = []

    def note(df, name="table", **metrics):
        written.append((name, df.schema))
        return materialize(df, name, **metrics)

    import prefmine.session as session
    before, session.materialize = session.materialize, note
    try:
        df = spark.createDataFrame([("a", 1)] * 7 + [("b", 2), (None, 3)], "k string, v int")
        marked = splits.mark_exact_split(df, ["k"], 0.5)
    finally:
        session.materialize = before
    assert [f.dataType.typeName() for f in dict(written)["split"] if f.name != "row"] == ["binary", "long"]
    assert marked.where("is_test").count() == 4 and marked.count() == 9
