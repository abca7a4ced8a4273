"""Rating build, city selection, splits, dense indexes."""

from pyspark.sql import functions as F

from conftest import SF001, rows
from prefmine.operators import indexing, ratings as R, splits
from prefmine.sources import testdata as T


def test_build_ratings_averages_and_null_city(spark):
    reviews = spark.createDataFrame([("u1", "b1", 4.0), ("u1", "b1", 2.0), ("u2", "b2", 5.0),
                                     ("u3", "b1", 1.0), ("u9", "b1", 3.0)],
                                    "user_key string, item_key string, rate double")
    users = spark.createDataFrame([("u1", 0), ("u2", 1), ("u3", 2)], "user_key string, user_id int")
    business = spark.createDataFrame([("b1", 0, "Montréal"), ("b2", 1, None)],
                                     "item_key string, item_id int, city string")
    got = rows(R.build_ratings(reviews, users, business), "user_id", "item_id", "city", "rating")
    assert got == [(0, 0, "Montréal", 3.0), (1, 1, None, 5.0), (2, 0, "Montréal", 1.0)]


def test_city_fanout_overlapping_terms(spark):
    r = spark.createDataFrame([(1, 1, "NATION_1", 1.0), (2, 2, "NATION_12", 2.0), (3, 3, None, 3.0),
                               (4, 4, "Montréal", 4.0)],
                              "user_id bigint, item_id bigint, city string, rating double")
    fan = rows(R.city_fanout(r, ["nation_1", "NATION_12", "montr"]), "city_term", "user_id")
    assert fan == [("NATION_12", 2), ("montr", 4), ("nation_1", 1), ("nation_1", 2)]
    counts = dict(rows(R.city_counts(r, ["nation_1", "zzz"]), "city_term", "n_rows"))
    assert counts == {"nation_1": 2, "zzz": 0}
    assert rows(R.city_filter(r, "NATION_1"), "user_id") == [(1,), (2,)]


def test_write_city_files_partitioned(spark, tmp_dir):
    r = T.ratings_supp(spark, SF001)
    R.write_city_files(r, tmp_dir + "/cities", ["nation_1", "NATION_24"])
    back = spark.read.parquet(tmp_dir + "/cities")
    one = back.where(F.col("city_term") == "NATION_24")
    assert one.count() == R.city_filter(r, "NATION_24").count()
    assert back.count() == R.city_fanout(r, ["nation_1", "NATION_24"]).count()


def test_hash_split_partitions_input(spark):
    r = T.ratings_supp(spark, SF001)
    train, test = splits.hash_split(r, ["user_id", "item_id"], 0.2, seed=3)
    n, a, b = r.count(), train.count(), test.count()
    assert a + b == n and 0.1 < b / n < 0.3
    assert rows(train.unionByName(test)) == rows(r)


def test_exact_split_size(spark):
    p = T.brand_pairs(spark, SF001)
    train, test = splits.exact_split(p, ["user_id", "item"], 0.1, seed=7)
    n = p.count()
    assert test.count() == int(n * 0.1)
    assert rows(train.unionByName(test)) == rows(p)


def test_global_position_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    pos = indexing.global_position(df, ["k"], "pos", num_partitions=7)
    got = rows(pos, "k", "pos")
    assert [p for _, p in got] == list(range(5000))


def test_dense_index_key_and_first_seen(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("c", 0)], "u string, biz int")
    assert rows(indexing.dense_index(df, ["u"], "ix"), "u", "ix") == [("a", 0), ("b", 1), ("c", 2)]
    # rows read in (biz, u) order: (c,0) (a,1) (b,1) (b,2) -> c first, then a, then b
    fs = rows(indexing.first_seen_index(df, "u", ["biz", "u"], "ix"), "u", "ix")
    assert fs == [("a", 1), ("b", 2), ("c", 0)]


def test_dense_index_file_order_keeps_duplicates(spark, tmp_dir):
    path = tmp_dir + "/users.json"
    with open(path, "w") as f:
        for u in ["zed", "amy", "zed", "bob"]:
            f.write('{"user_id": "%s"}\n' % u)
    df = spark.read.schema("user_id string").json(path)
    got = sorted((r.ix, r.user_id) for r in indexing.dense_index(df, ["user_id"], "ix", order="file").collect())
    assert got == [(0, "zed"), (1, "amy"), (2, "zed"), (3, "bob")]


def test_ratings_events_parses_json_item(spark):
    e = T.ratings_events(spark, SF001)
    assert e.where(F.col("item_id").isNull()).count() == 0
    assert e.count() > 0


def test_city_filter_via_dimension_prunes_partitions(spark, tmp_dir):
    r = T.ratings_supp(spark, SF001)
    R.write_ratings_by_city(r, tmp_dir + "/by_city")
    stored = spark.read.parquet(tmp_dir + "/by_city")
    cities = T.business(spark, SF001)
    fast = R.city_filter(stored, "nation_1", cities=cities)
    slow = R.city_filter(stored, "nation_1")
    assert rows(fast.select("user_id", "item_id", "city")) == rows(slow.select("user_id", "item_id", "city"))
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "LeftSemi" in plan


def test_folders_hold_few_files(spark, tmp_dir):
    import glob
    r = T.ratings_supp(spark, SF001).repartition(20)
    R.write_city_files(r, tmp_dir + "/c", ("nation_1", "nation_2"))
    assert len(glob.glob(tmp_dir + "/c/*/*.parquet")) <= 4


def test_exact_split_multi_level_matches_sorted_order(spark):
    import hashlib
    df = spark.range(0, 3000).select((F.col("id") * 37 % 3001).alias("u"), F.lit("x").alias("i"))
    train, test = splits.exact_split(df, ["u", "i"], 0.37, seed=5)
    keys = sorted((hashlib.md5(f"{u}|x|5".encode()).hexdigest(), u) for u in
                  [r.u for r in df.collect()])
    want = sorted(u for _, u in keys[:int(3000 * 0.37)])
    assert sorted(r.u for r in test.collect()) == want
    assert train.count() == 3000 - len(want)


def test_salted_rating_build_equals_plain(spark):
    # user u0 holds a third of all reviews, business b0 half of them
    rv = [("u0", f"b{i % 3}", float(i % 5 + 1)) for i in range(40)]
    rv += [(f"u{j}", f"b{j % 7}", float(j % 4 + 1)) for j in range(1, 81)]
    reviews = spark.createDataFrame(rv, "user_key string, item_key string, rate double")
    users = spark.createDataFrame([(f"u{j}", j) for j in range(81)], "user_key string, user_id int")
    business = spark.createDataFrame([(f"b{i}", i, f"City{i % 2}") for i in range(7)],
                                     "item_key string, item_id int, city string")
    plain = rows(R.build_ratings(reviews, users, business))
    salted = rows(R.build_ratings(reviews, users, business, skew_chunk=5))
    assert plain == [r[:3] + (r[3],) for r in salted]
    assert len(plain) > 0


def test_random_split_seeded_and_complete(spark):
    r = T.ratings_supp(spark, SF001)
    a1, b1 = splits.random_split(r, (0.8, 0.2), seed=0)
    a2, b2 = splits.random_split(r, (0.8, 0.2), seed=0)
    assert rows(b1) == rows(b2)
    assert rows(a1.unionByName(b1)) == rows(r)
    assert 0.1 < b1.count() / r.count() < 0.3


def test_mark_split_equals_hash_split(spark):
    r = T.ratings_supp(spark, SF001)
    a, b = splits.hash_split(r, ["user_id", "item_id"], 0.2, seed=4)
    c, d = splits.split_marked(splits.mark_split(r, ["user_id", "item_id"], 0.2, seed=4))
    assert rows(a) == rows(c) and rows(b) == rows(d)


def test_exact_split_with_repeats_and_nulls(spark):
    repeated = spark.createDataFrame([(i % 5, "x") for i in range(50)], "u bigint, i string")
    train, test = splits.exact_split(repeated, ["u", "i"], 0.5)
    assert (train.count(), test.count()) == (25, 25)
    nulls = spark.createDataFrame([(None if i % 4 == 0 else i, None) for i in range(40)], "u bigint, i string")
    train, test = splits.exact_split(nulls, ["u", "i"], 0.5)
    assert (train.count(), test.count()) == (20, 20)
    assert sorted(map(str, train.unionByName(test).collect())) == sorted(map(str, nulls.collect()))
    train, test = splits.exact_split(nulls, ["u", "i"], 1.0)
    assert (train.count(), test.count()) == (0, 40)
