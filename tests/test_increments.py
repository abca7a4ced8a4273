import math
import random

import pytest
from conftest import rows

from prefmine.operators import increments, itemcf
from prefmine.sources.versions import Versions, fingerprint


def batches(seed, n=3, users=25, items=12):
    """Batches of reviews: new pairs, further reviews of known pairs, a hot user."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        b = [(rng.randrange(users), rng.randrange(items), float(rng.randint(0, 5))) for _ in range(90)]
        out.append(b + [(0, i, float(rng.randint(1, 5))) for i in range(items) if rng.random() < 0.6])
    return out


def brute(reviews):
    """{(a, b): (cosine, common users)} of the mean ratings."""
    acc = {}
    for u, i, r in reviews:
        acc.setdefault((u, i), []).append(r)
    by_user = {}
    for (u, i), rs in acc.items():
        by_user.setdefault(u, {})[i] = sum(rs) / len(rs)
    sums = {}
    for own in by_user.values():
        for a in own:
            for b in own:
                if a < b:
                    s = sums.setdefault((a, b), [0, 0, 0, 0])
                    for k, x in enumerate((own[a] * own[b], own[a] ** 2, own[b] ** 2, 1)):
                        s[k] += x
    return {k: (s[0] / math.sqrt(s[1] * s[2]) if s[1] * s[2] > 0 else 0.0, s[3]) for k, s in sums.items()}


@pytest.mark.parametrize("seed,chunk", [(0, 2048), (1, 4)])
def test_batches_equal_the_full_build(spark, tmp_dir, seed, chunk):
    store = increments.SimilarityStore(spark, f"{tmp_dir}/store", n_neighbors=3, chunk=chunk)
    seen = []
    for k, b in enumerate(batches(seed)):
        df = spark.createDataFrame(b + [(None, 1, 2.0), (1, None, 2.0), (1, 1, None)], "user_id long, item_id long, rate double")
        assert store.apply(f"b{k}", df) and not store.apply(f"b{k}", df)
        seen += b
        want = brute(seen)
        got = {(r.item_a, r.item_b): (r.similarity, r.n_common) for r in store.similarity().collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)
        full = itemcf.top_neighbors(store.similarity(), 3)
        cols = ["item_id", "neighbor_id", "n_common", "rank"]
        assert rows(store.neighbors(), *cols) == rows(full, *cols)
    before = rows(store.neighbors())
    store.compact()
    assert {k: len(v) for k, v in store.versions.latest()[1]["tables"].items()} == {"reviews": 1, "pairs": 1, "neighbors": 1}
    assert rows(store.neighbors()) == before and store.similarity().count() == len(brute(seen))
    assert store.ratings().count() == len({(u, i) for u, i, _ in seen})


def test_only_touched_items_are_ranked_again(spark, tmp_dir):
    store = increments.SimilarityStore(spark, f"{tmp_dir}/store", n_neighbors=2)
    cols = "user_id long, item_id long, rate double"
    store.apply("one", spark.createDataFrame([(u, i, float(u + i)) for u in range(4) for i in range(6)], cols))
    store.apply("two", spark.createDataFrame([(99, 0, 1.0), (99, 1, 5.0)], cols))
    _, manifest = store.versions.latest()
    changed = spark.read.parquet(f"{store.versions.base}/{manifest['tables']['pairs'][-1]}")
    assert rows(changed, "item_a", "item_b", "n_common") == [(0, 1, 1)]


def test_a_single_review_changes_no_pair(spark, tmp_dir):
    store = increments.SimilarityStore(spark, f"{tmp_dir}/store")
    store.apply("one", spark.createDataFrame([(1, 1, 3.0)], "user_id long, item_id long, rate double"))
    store.apply("none", spark.createDataFrame([], "user_id long, item_id long, rate double"))
    assert store.similarity().count() == 0 and store.neighbors().count() == 0 and rows(store.ratings()) == [(1, 1, 3.0)]


def test_an_interrupted_version_does_not_exist(spark, tmp_dir):
    v = Versions(spark, f"{tmp_dir}/v")
    assert v.latest() == (0, {}) and v.read("t") is None
    v.commit(append={"t": spark.range(3)}, note="first")
    spark.range(50).write.parquet(f"{tmp_dir}/v/v2/t")  # no manifest
    assert v.latest()[0] == 1 and v.read("t").count() == 3
    m = v.commit(append={"t": spark.range(5)}, replace={"u": spark.range(1)})
    assert m["version"] == 2 and m["note"] == "first" and v.read("t").count() == 8
    v.commit(replace={"t": spark.range(2)})
    v.vacuum()
    assert v.files.names(f"{tmp_dir}/v/v1") in ([], ["_manifest.json"]) and v.read("t").count() == 2 and v.read("u").count() == 1


def test_fingerprint_follows_files_and_parameters(spark, tmp_dir):
    path = f"{tmp_dir}/in"
    spark.range(10).write.parquet(path)
    one = fingerprint(spark, [path], rank=3)
    assert fingerprint(spark, [path], rank=3) == one != fingerprint(spark, [path], rank=4)
    spark.range(11).write.mode("append").parquet(path)
    assert fingerprint(spark, [path], rank=3) != one
    assert fingerprint(spark, [f"{tmp_dir}/nothing"]) != fingerprint(spark, [f"{tmp_dir}/other"])


def test_lists_are_ranked_when_asked_for(spark, tmp_dir):
    store = increments.SimilarityStore(spark, f"{tmp_dir}/store", n_neighbors=2)
    for k, b in enumerate(batches(5)):
        store.apply(f"b{k}", spark.createDataFrame(b, "user_id long, item_id long, rate double"))
    assert "neighbors" not in store.versions.latest()[1]["tables"]      # three batches, no ranking yet
    store.compact()
    assert rows(store.neighbors(), "item_id", "neighbor_id", "rank") == rows(itemcf.top_neighbors(store.similarity(), 2), "item_id", "neighbor_id", "rank")


def test_waves_of_pairs_equal_one(spark, tmp_dir, monkeypatch):
    """Pairs formed and folded in several writes, each with its own shuffles, are the pairs of one; no list stays."""
    from test_als import _written
    before = _written(spark)
    schema, bs = "user_id int, item_id int, rate double", [b[:90] for b in batches(3, users=40, items=30)]
    monkeypatch.setattr(increments, "WAVE_ROWS", 40)
    monkeypatch.setattr(increments, "WAVE_PAIRS", 1)
    monkeypatch.setattr(itemcf, "RANGE_PAIRS", 20)
    store, written = increments.SimilarityStore(spark, tmp_dir + "/s", 3), []
    commit = store.versions.commit

    def counted(append=None, replace=None, **remember):
        written.append(len((append or replace)["pairs"]) if "pairs" in (append or replace) else 0)
        return commit(append, replace, **remember)

    monkeypatch.setattr(store.versions, "commit", counted)
    for i, b in enumerate(bs):
        assert store.apply(f"b{i}", spark.createDataFrame(b, schema))
    want = brute([r for b in bs for r in b])

    def check():
        got = {(r.item_a, r.item_b): (r.similarity, r.n_common) for r in store.similarity().collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)

    check()
    assert written[0] > 3 and written[2] == 8
    store.compact()
    check()
    pairs = store.versions.read("pairs")
    assert written[3] > 3 and pairs.count() == pairs.select("item_a", "item_b").distinct().count()
    sim = itemcf.item_similarity(store.ratings())
    assert rows(store.neighbors(), "item_id", "neighbor_id", "rank") == rows(itemcf.top_neighbors(sim, 3), "item_id", "neighbor_id", "rank")
    assert not [t for t in _written(spark) - before if "/user-lists" in t or "/batch" in t]
