"""JSON / CSV sources and sinks, read-or-build, JDBC options, streaming."""

import os

import pytest

from conftest import rows
from prefmine.operators.ratings import build_ratings
from prefmine.sources import files, jdbc
from prefmine.streaming import ratings as S


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_review_json_tab_in_string_and_errors(spark, tmp_dir):
    good = tmp_dir + "/good.json"
    _write(good, ['{"user_id": "u\t1", "business_id": "b1", "stars": 4, "text": "x"}',
                  '{"user_id": "u2", "business_id": "b2", "stars": 3.5}'])
    got = rows(files.read_reviews_json(spark, good), "userID", "businessID", "rate")
    assert got == [("u\t1", "b1", 4.0), ("u2", "b2", 3.5)]
    bad = tmp_dir + "/bad.json"
    _write(bad, ['{"user_id": "u1", "business_id": "b1", "stars": 4}',
                 '{"user_id": "u2", "stars": 3}',
                 '{"user_id": "u3", "business_id": "b3", "stars": ',
                 '{"user_id": "u4", "business_id": "b4", "stars": 2}'])
    kept = rows(files.read_reviews_json(spark, bad, on_error="drop"), "userID")
    assert kept == [("u1",), ("u4",)]
    with pytest.raises(Exception):
        files.read_reviews_json(spark, bad, on_error="fail").select("userID").collect()


def test_json_to_csv_pipeline_to_ratings(spark, tmp_dir):
    d = tmp_dir
    _write(d + "/review.json", ['{"user_id": "amy", "business_id": "x", "stars": 5}',
                                '{"user_id": "amy", "business_id": "x", "stars": 3}',
                                '{"user_id": "bob", "business_id": "y", "stars": 2}'])
    _write(d + "/user.json", ['{"user_id": "bob"}', '{"user_id": "amy"}'])
    _write(d + "/business.json", ['{"business_id": "y", "city": "Montréal"}',
                                  '{"business_id": "x", "city": "Las Vegas"}'])
    for kind in ("review", "user", "business"):
        files.convert_json(spark, f"{d}/{kind}.json", kind, f"{d}/{kind}.csv")
    rv, us, bs = files.read_review_tables(spark, d + "/review.csv", d + "/user.csv", d + "/business.csv")
    assert rows(us) == [("amy", 1), ("bob", 0)]
    r = build_ratings(rv, us, bs)
    assert rows(r, "user_id", "item_id", "city", "rating") == [(0, 0, "Montréal", 2.0), (1, 1, "Las Vegas", 4.0)]
    files.write_ratings_csv(r, d + "/allRate")
    back = files.read_ratings_csv(spark, d + "/allRate")
    assert rows(back) == rows(r.select("user_id", "item_id", "city", "rating"))


def test_read_or_build_builds_once(spark, tmp_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    p = tmp_dir + "/t"
    assert files.read_or_build(spark, p, build).count() == 3
    assert files.read_or_build(spark, p, build).count() == 3
    assert len(calls) == 1


def test_metric_csv_schema(spark, tmp_dir):
    p = tmp_dir + "/freNum.csv"
    _write(p, ["support,numFreqItemsets,numAssociateRules", "0.01,325,584"])
    r = files.read_metric_csv(spark, p, "freNum").collect()[0]
    assert (r.support, r.numFreqItemsets, r.numAssociateRules) == (0.01, 325, 584)


def test_unfinished_folder_is_built_again(spark, tmp_dir):
    p = tmp_dir + "/t"
    os.makedirs(p + "/_temporary/0")
    build = lambda: spark.range(1)
    assert files.read_or_build(spark, p, build, schema=spark.range(1).schema).count() == 1
    assert files.read_or_build(spark, p, lambda: 1 / 0).count() == 1


def test_best_result_layouts_round_trip(spark, tmp_dir):
    for layout, column in (("singleMachineTestTime", "trainTime"), ("bestResultForALS", "RMSE"), ("bestResultForItem", "RMSE")):
        files.write_csv(spark.createDataFrame([(0.1,), (2.5,)], f"{column} double"), f"{tmp_dir}/{layout}", header=True)
        assert rows(files.read_metric_csv(spark, f"{tmp_dir}/{layout}", layout), column) == [(0.1,), (2.5,)]


def test_jdbc_table_options():
    o = jdbc.table_options("jdbc:any", "review", column="id", lower=1, upper=9, num_partitions=4, user="u")
    assert o == {"url": "jdbc:any", "dbtable": "review", "fetchsize": "1000", "user": "u", "partitionColumn": "id",
                 "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    with pytest.raises(ValueError):
        jdbc.table_options("jdbc:any", "review", column="id")


def test_pairs_of_tables_take_any_city_text(spark):
    review = spark.createDataFrame([("b1", "amy"), ("b1", "amy"), ("b2", "bob"), ("b3", "cat")], "business_id string, user_id string")
    business = spark.createDataFrame([("b1", "L'Isle\\", 1), ("b2", "Other", 1), ("b3", "L'Isle\\", 0)], "id string, city string, is_open int")
    assert rows(jdbc.pairs_of(review, business, "L'Isle\\")) == [("b1", "amy")]


def test_streaming_running_average_equals_batch(spark, tmp_dir):
    src = tmp_dir + "/in"
    os.makedirs(src)
    _write(src + "/a.json", ['{"user_id": "amy", "business_id": "x", "stars": 5}',
                             '{"user_id": "bob", "business_id": "x", "stars": 1}'])
    _write(src + "/b.json", ['{"user_id": "amy", "business_id": "x", "stars": 2}',
                             '{"user_id": "amy", "business_id": "y"}'])  # lacks its stars
    users = spark.createDataFrame([("amy", 0), ("bob", 1)], "user_key string, user_id int")
    biz = spark.createDataFrame([("x", 0, "Tempe"), ("y", 1, None)], "item_key string, item_id int, city string")
    q = S.start(S.running_ratings(S.review_stream(spark, src, 1), users, biz), "ratings_bad", path=tmp_dir + "/bad",
                trigger_once=True, checkpoint_location=tmp_dir + "/ckpt-bad")
    with pytest.raises(Exception, match="bad JSON line"):
        q.awaitTermination(120)
    q = S.start(S.running_ratings(S.review_stream(spark, src, 1, on_error="drop"), users, biz), "ratings_test", sink="memory",
                trigger_once=True, checkpoint_location=tmp_dir + "/ckpt")
    q.awaitTermination(120)
    got = rows(spark.table("ratings_test"), "user_id", "item_id", "rating")
    assert got == [(0, 0, 3.5), (1, 0, 1.0)]


def test_streaming_parquet_sink_latest_value(spark, tmp_dir):
    src = tmp_dir + "/in2"
    os.makedirs(src)
    users = spark.createDataFrame([("amy", 0)], "user_key string, user_id int")
    biz = spark.createDataFrame([("x", 0, None)], "item_key string, item_id int, city string")
    _write(src + "/a.json", ['{"user_id": "amy", "business_id": "x", "stars": 4}'])
    _write(src + "/b.json", ['{"user_id": "amy", "business_id": "x", "stars": 2}'])
    q = S.start(S.running_ratings(S.review_stream(spark, src, 1), users, biz), "ratings_pq",
                sink="parquet", path=tmp_dir + "/out", trigger_once=True,
                checkpoint_location=tmp_dir + "/ckpt2")
    q.awaitTermination(120)
    got = S.latest(tmp_dir + "/out", spark).collect()
    assert [(r.user_id, r.item_id, r.city, r.n_reviews, r.rating) for r in got] == [(0, 0, None, 2, 3.0)]
    last = S.compact(spark, tmp_dir + "/out", tmp_dir + "/compact")
    again = S.latest(tmp_dir + "/compact", spark).collect()
    assert [(r.user_id, r.n_reviews, r.rating, r.batch_id) for r in again] == [(0, 2, 3.0, last)]
