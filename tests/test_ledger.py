"""The experiment ledger, task times from the event log, versioned reuse, quarantine, growing ids, city codes."""

import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT, SF001, rows
from pyspark.sql import functions as F

from prefmine.operators import iddict, indexing, ratings as R
from prefmine.plans import ledger, tasktime
from prefmine.sources import files, quarantine
from prefmine.sources import testdata as T

POINTS = [{"rank": 2, "regParam": 0.1}, {"rank": 3, "regParam": 0.1}, {"rank": 3, "regParam": 0.5}]


def fake_fit(spark, calls, die_at=None):
    def fit(points):
        calls.append(points)
        if die_at is not None and len(calls) == die_at:
            raise KeyboardInterrupt("killed")
        return spark.createDataFrame([("x", int(p["rank"]), float(p["regParam"]), p["rank"] * 10.0, 1) for p in points],
                                     "city string, rank int, regParam double, rmse double, n long")
    return fit


def test_a_killed_sweep_resumes(spark, tmp_dir):
    led, calls = ledger.Ledger(spark, f"{tmp_dir}/l"), []
    with pytest.raises(KeyboardInterrupt):
        led.sweep("d1", "als", POINTS, fake_fit(spark, calls, die_at=3), ["rmse", "n"], "city")
    assert led.missing("d1", "als", POINTS) == [POINTS[2]]
    again = []
    out = led.sweep("d1", "als", POINTS, fake_fit(spark, again), ["rmse", "n"], "city")
    assert again == [[POINTS[2]]]  # nothing is fitted twice
    wide = ledger.wide_rows(out, ["rank", "regParam"], ["rmse", "n"])
    assert rows(wide, "city", "rank", "regParam", "rmse", "n") == [("x", 2.0, 0.1, 20.0, 1.0), ("x", 3.0, 0.1, 30.0, 1.0), ("x", 3.0, 0.5, 30.0, 1.0)]
    led.sweep("d1", "als", POINTS[:2], fake_fit(spark, again), ["rmse"], "city")
    assert len(again) == 1
    # other data, run or experiment: other points
    assert led.missing("d2", "als", POINTS) == led.missing("d1", "als", POINTS, run=1) == led.missing("d1", "cf", POINTS) == POINTS
    assert rows(ledger.long_rows(led.select("d1", "als", POINTS[:1]), "rank"), "param", "param_value", "metric", "value") == [
        ("rank", 2.0, "n", 1.0), ("rank", 2.0, "rmse", 20.0)]


def test_points_that_share_work_are_one_call(spark, tmp_dir):
    led, calls = ledger.Ledger(spark, f"{tmp_dir}/l"), []
    led.sweep("d", "e", POINTS[:1], fake_fit(spark, calls), ["rmse"], together=True)
    led.sweep("d", "e", POINTS, fake_fit(spark, calls), ["rmse"], together=True)
    led.sweep("d", "e", POINTS, fake_fit(spark, calls), ["rmse"], together=True)
    assert calls == [POINTS[:1], POINTS[1:]]


def test_a_point_without_rows_is_not_run_again(spark, tmp_dir):
    led = ledger.Ledger(spark, f"{tmp_dir}/l")
    none = spark.createDataFrame([], "rank int, rmse double")
    assert led.sweep("d", "e", [{"rank": 1}], lambda p: none, ["rmse"]).count() == 0
    assert led.missing("d", "e", [{"rank": 1}]) == []


def test_task_seconds_by_tag(spark, tmp_dir):
    log = f"{tmp_dir}/events"
    os.makedirs(log)
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.dir", "file://{log}").getOrCreate())
from prefmine.operators import splits
from prefmine.plans.experiments import als_city_sweep, als_tag
from prefmine.sources import testdata as T
train, test = splits.hash_split(T.ratings_supp(s, {SF001!r}), ["user_id", "item_id"], 0.2, 0)
out = als_city_sweep(train, test, ["nation_1", "nowhere"], [2, 3], 2, 0.1, num_blocks=2).collect()
assert [(r.city_term, r.rank) for r in out] == [("nation_1", 2), ("nation_1", 3)] and all(r.train_s > 0 and r.test_s > 0 for r in out)
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    got = {r.tag: r for r in tasktime.task_seconds(spark, log).collect()}
    for rank in (2, 3):
        mine = got[f"als nation_1 {rank}"]
        assert mine.n_tasks > 10 and mine.task_s > 0 and mine.cpu_s > 0


def test_table_is_rebuilt_when_its_inputs_change(spark, tmp_dir):
    src, out, built = f"{tmp_dir}/in", f"{tmp_dir}/out", []
    spark.range(5).write.parquet(src)

    def get(**params):
        def build():
            built.append(1)
            return spark.read.parquet(src)
        return files.read_or_build(spark, out, build, inputs=[src], **params).count()

    assert (get(), get(), len(built)) == (5, 5, 1)
    spark.range(2).write.mode("append").parquet(src)
    assert (get(), get(), len(built)) == (7, 7, 2)
    assert (get(rank=1), get(rank=1), len(built)) == (7, 7, 3)  # another parameter
    os.remove(f"{out}/_inputs.json")                              # as an interrupted write leaves it
    assert (get(rank=1), len(built)) == (7, 4)


LINES = ['{"user_id":"u1","business_id":"b1","stars":4}', "", '{"user_id":"u2","business_id":"b1"}', "not json", "   ",
         '{"user_id":"u3","business_id":"b\t2","stars":"many"}', '{"business_id":"b1","stars":1.5}', '{"user_id":"u4","business_id":"b4","stars":2.5,"x":[1]}',
         '["a"]', '{"user_id":null,"business_id":"b1","stars":3}']
WANT = [(3, "missing stars"), (4, "malformed"), (6, "malformed"), (7, "missing user_id"), (9, "malformed"), (10, "missing user_id")]


def test_quarantine_keeps_bad_lines_with_place_and_reason(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for name, lines in (("a", LINES), ("b", LINES[:3]), ("c", [])):
        open(f"{tmp_dir}/in/{name}.json", "w").write("\n".join(lines))
    need = ["user_id", "business_id", "stars"]
    good, bad, counts = quarantine.read_json(spark, f"{tmp_dir}/in", files.REVIEW_JSON, need, f"{tmp_dir}/out", max_bad_share=0.9)
    assert rows(good) == [("u1", "b1", 4.0), ("u1", "b1", 4.0), ("u4", "b4", 2.5)] and counts == {"lines": 10, "bad": 7}
    got = sorted((r.file.rsplit("/", 1)[1], r.line_number, r.reason) for r in bad.collect())
    assert got == [("a.json", n, why) for n, why in WANT] + [("b.json", 3, "missing stars")]
    assert {r.line for r in bad.where("reason = 'malformed'").collect()} == {LINES[3], LINES[5], LINES[8]}
    with pytest.raises(quarantine.TooManyBadLines, match="7 of 10"):
        quarantine.read_json(spark, f"{tmp_dir}/in", files.REVIEW_JSON, need, f"{tmp_dir}/out2", max_bad_share=0.5)


def test_line_numbers_go_on_over_the_blocks_of_a_file(spark, tmp_dir):
    rng = random.Random(0)
    lines = [rng.choice([LINES[0], LINES[2], "", "x" * rng.randint(1, 60)]) for _ in range(3000)]
    open(f"{tmp_dir}/one.json", "w").write("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        good, bad, _ = quarantine.read_json(spark, f"{tmp_dir}/one.json", files.REVIEW_JSON, ["stars"], f"{tmp_dir}/out")
        got = sorted((r.line_number, r.line) for r in bad.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, x) for i, x in enumerate(lines) if x not in ("", LINES[0])]
    assert good.count() == lines.count(LINES[0])


def test_quarantine_of_a_stream(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for i in range(3):
        open(f"{tmp_dir}/in/{i}.json", "w").write("\n".join(LINES))
    need = ["user_id", "business_id", "stars"]

    def run(out, share):
        q = quarantine.start_stream(spark, f"{tmp_dir}/in", files.REVIEW_JSON, need, out, "q" + out[-1], share, 1, f"{out}-ckpt", available_now=True)
        q.awaitTermination()

    run(f"{tmp_dir}/out1", 0.9)
    table = spark.read.parquet(f"{tmp_dir}/out1")
    assert quarantine.good_rows(table, files.REVIEW_JSON).count() == 6
    assert sorted((r.line_number, r.reason) for r in quarantine.bad_lines(table).collect()) == sorted(WANT * 3)
    with pytest.raises(Exception, match="lines are bad"):
        run(f"{tmp_dir}/out2", 0.1)


def test_ids_grow_and_never_change(spark, tmp_dir):
    rng = random.Random(1)
    whole = [(at, rng.choice("abcdefghijklmnop")) for at in range(60)] + [(7, None)]
    d = iddict.KeyDictionary(spark, f"{tmp_dir}/ids", "key", "id")
    seen = {}
    for b in range(3):
        part = [r for r in whole if r[0] // 20 == b]
        df = spark.createDataFrame(part, "at int, key string")
        assert d.append(f"b{b}", df, ["at"]) and not d.append(f"b{b}", df, ["at"])
        now = {r.key: r.id for r in d.ids().collect()}
        assert seen.items() <= now.items() and sorted(now.values()) == list(range(len(now)))
        seen = now
    once = indexing.first_seen_index(spark.createDataFrame(whole[:-1], "at int, key string"), "key", ["at"], "id")
    assert {r.key: r.id for r in once.collect()} == seen
    d.compact()
    assert {r.key: r.id for r in d.ids().collect()} == seen
    d.append("more", spark.createDataFrame([(0, "zz")], "at int, key string"), ["at"])
    assert {r.key: r.id for r in d.ids().collect()} == {**seen, "zz": len(seen)}
    assert d.encode(spark.createDataFrame([("zz", 1), ("??", 2)], "key string, v int")).count() == 1


def test_coded_cities_equal_the_fanout_and_search_no_ratings(spark, tmp_dir):
    r = T.ratings_supp(spark, SF001).unionByName(spark.createDataFrame([(1, 1, None, 2.0)], "user_id long, item_id long, city string, rating double"))
    codes = R.city_codes(T.business(spark, SF001))
    R.write_by(R.coded_ratings(r, codes), f"{tmp_dir}/r", "city_code")
    out = R.fanout_by_code(spark.read.parquet(f"{tmp_dir}/r"), R.matching_codes(codes, ["nation_1", "NATION_2"]))
    cols = ["city_term", "user_id", "item_id", "city", "rating"]
    assert rows(out, *cols) == rows(R.city_fanout(r, ["nation_1", "NATION_2"]), *cols)
    # The text search is on the dictionary's scan; the ratings' scan is pruned by the joined codes.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    scan = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "rating" in x]
    assert "dynamicpruning" in plan.lower() and scan and all("ontains(" not in x.split("DataFilters")[-1] for x in scan)
