import random
import re
from collections import defaultdict

import pytest
from llm_fixtures import SF001, messy, nothing  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from prefmine.llm import mixing, packing, queries
from prefmine.llm.common import Scratch


def sized(spark, sizes, text="word "):
    """Documents (id, source, number of words)."""
    return spark.createDataFrame([(i, text * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again what is cut off."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 5000]) + rng.randint(0, 9) for i in range(9)} | {None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "src string, size long")
    got = {r.src: r.target for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_taken_words_come_near_their_target(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randint(1, 60)) for _ in range(400)] + [(f"s{i % 5}", rng.randint(1, 60)) for i in range(200)] + [(None, 30)] * 7
    p = mixing.plan(sized(spark, rows), ["doc_id"]).collect()
    assert len(p) == len(rows)
    by = defaultdict(list)
    for r in p:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"] and len(r.positions) == r.copies
        assert all(0 <= t < 1 for t in r.positions)
        by[r.src].append(r)
    for rs in by.values():
        assert {r.source_size for r in rs} == {sum(r["size"] for r in rs)}
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2
    again = mixing.plan(sized(spark, rows), ["doc_id"]).repartition(3).collect()
    assert sorted((r.kept.doc_id, r.copies, r.positions) for r in p) == sorted((r.kept.doc_id, r.copies, r.positions) for r in again)


def test_training_time_inverts_the_integral(spark):
    df = spark.range(301).select((F.col("id") / 300).alias("q"))
    for i, knots in enumerate(mixing.SCHEDULES):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for q, t in df.select("q", mixing.training_time(F.col("q"), F.lit(i))).collect():
            done = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                u = min(max(t - t0, 0), t1 - t0)
                done += u * w0 + u * u * (w1 - w0) / (t1 - t0) / 2
            assert abs(done / area - q) < 1e-9


def test_mix_follows_the_schedule(spark):
    rows = [("a", 10)] * 600 + [("b", 10)] * 600 + [("c", 10)] * 600
    out = mixing.mix(sized(spark, rows)).select("source", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    early, late = out[: len(out) // 4], out[-len(out) // 4:]
    share = lambda rs, s: sum(r.source == s for r in rs) / len(rs)
    assert share(early, "a") > share(late, "a") and share(early, "c") < share(late, "c")


def test_messy_and_empty(spark, messy, nothing):
    p = mixing.plan(messy, ["doc_id"]).collect()
    assert len(p) == messy.count() and {r.src for r in p} == {"src0", "src1", "src2", "src3", None}
    assert mixing.mix(messy).columns == messy.columns
    assert mixing.mix(messy).count() == sum(r.copies for r in p)
    assert mixing.plan(nothing, ["doc_id"]).count() == mixing.mix(nothing).count() == packing.pack(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in mixing.plan(empty, ["doc_id"]).collect()] == [(0, 0, 0.0)] * 2


def brute_best_fit(lengths, sources, clusters, capacity, per_source):
    """Looks at every bin for every piece; the tightest compatible one, ties to the older."""
    bins, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b, x in enumerate(bins) if x["room"] >= lengths[i] and x["src"].count(sources[i]) < per_source
                and (clusters[i] < 0 or clusters[i] not in x["dup"])]
        if fits:
            b = min(fits, key=lambda b: (bins[b]["room"], b))
        else:
            b = len(bins)
            bins.append({"room": capacity, "src": [], "dup": []})
        where[i] = (b, capacity - bins[b]["room"])
        bins[b]["room"] -= lengths[i]
        bins[b]["src"].append(sources[i])
        bins[b]["dup"].append(clusters[i])
    return [where[i][0] for i in range(len(lengths))], [where[i][1] for i in range(len(lengths))], len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 300)
    args = ([rng.randint(1, 100) for _ in range(n)], [min(rng.randrange(9), rng.randrange(9)) for _ in range(n)],
            [rng.choice([-1, rng.randrange(80)]) for _ in range(n)], 100, rng.randint(1, 3))
    assert packing.best_fit(*args) == brute_best_fit(*args)


def check_packing(rows, docs, capacity, per_source):
    """docs: id -> list of (words, source, cluster)."""
    bins, words = defaultdict(list), defaultdict(int)
    for r in rows:
        words[r.doc_id] += r.n_words
        if r.bin is not None:
            assert 0 < r.n_words <= capacity
            bins[r.bin].append(r)
    for i, copies in docs.items():
        assert words[i] == sum(n for n, _, _ in copies)
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        ends = [r.bin_offset + r.n_words for r in rs]
        assert [r.bin_offset for r in rs] == [0, *ends[:-1]] and ends[-1] <= capacity
        for what, most in ((1, per_source), (2, 1)):
            held = [docs[r.doc_id][0][what] for r in rs]
            assert max(held.count(x) for x in held) <= most


def test_packing_keeps_all_words_and_conflicts(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", rng.choice([0, 1, 7, 30, 99, 100, 101, 350])) for _ in range(500)]
    df = sized(spark, rows).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id").cast("string")).otherwise("x")))
    docs = {r.doc_id: [(len(r.text.split()), r.source, r.text)] for r in df.collect()}
    out = packing.pack(df, capacity=100, per_source=2, block_rows=150).collect()
    check_packing(out, docs, 100, 2)
    full = sum(r.n_words for r in out) / 100
    assert len({r.bin for r in out if r.bin is not None}) < 1.35 * full


def test_packing_of_the_documents(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = {r.doc_id: [(len(r.text.split()), r.source, r.text)] for r in df.collect()}
    out = packing.pack(df).collect()
    check_packing(out, docs, 2048, 4)
    assert len({r.bin for r in out}) <= 1.1 * sum(n for (n, _, _), in docs.values()) / 2048


def test_packing_of_messy_rows(messy):
    out = packing.pack(messy, capacity=64).collect()
    assert sum(r.n_words for r in out) == sum(len((r.text or "").split()) for r in messy.collect())
    empty = [r for r in out if r.bin is None]
    assert len(empty) == sum(not (r.text or "").split() for r in messy.collect())
    assert all((r.part, r.n_words) == (0, 0) for r in empty)


def test_bins_follow_the_schedule(spark):
    """Through the pipeline's stages: another schedule gives another order of bins."""
    docs = sized(spark, [(s, 600) for s in "abc"] * 300)
    for schedules, sign in ((mixing.SCHEDULES, 1), (mixing.SCHEDULES[::-1], -1)):
        mixed = Scratch(spark, "t").write(mixing.mix(docs, schedules=schedules))
        out = corpus_pipeline.sequences(spark, mixed, "").join(docs.select("doc_id", "source"), "doc_id").orderBy("bin").collect()
        share = lambda rs, s: sum(r.source == s for r in rs) / len(rs)
        early, late = out[: len(out) // 4], out[-len(out) // 4:]
        assert sign * (share(early, "a") - share(late, "a")) > 0.1 and sign * (share(early, "c") - share(late, "c")) < -0.05


@pytest.mark.parametrize("written", [True, False])
def test_blocks_are_ranges_of_the_order(spark, written):
    """Bins of later blocks hold later rows; none is lost, ties and nulls included."""
    rng = random.Random(8)
    rows = [(i, "word " * rng.choice([0, 1, 30, 99, 250]), f"s{i % 9}", rng.choice([None, *range(40)])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at long").repartition(5)
    df = Scratch(spark, "t").write(df) if written else df
    out = packing.pack(df, capacity=100, block_rows=64, order=[F.col("at")]).collect()
    assert sum(r.n_words for r in out) == sum(len(t.split()) for _, t, _, _ in rows) and {r.doc_id for r in out} == set(range(700))
    at = {i: -1 if a is None else a for i, _, _, a in rows}
    blocks = defaultdict(list)
    for r in out:
        if r.bin is not None:
            blocks[r.bin >> packing.BIN_BITS].append(at[r.doc_id])
    assert sorted(blocks) == list(range(11))
    assert all(max(blocks[b]) <= min(blocks[b + 1]) for b in range(10))


def test_near_copies_do_not_share_a_bin(spark):
    """op4 as registered: no bin holds two documents of one SimHash component."""
    from prefmine.llm import simhash

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    prints = Scratch(spark, "t").write(simhash.with_fingerprint(docs).select("doc_id", "fingerprint"))
    member = {r.fingerprint: r.component for r in simhash.near_duplicates(prints, k=2).collect()}
    of = {r.doc_id: member[r.fingerprint] for r in prints.collect()}
    rows = queries.QUERIES["op4_packing"](spark, SF001).collect()
    assert sorted({r.doc_id for r in rows}) == sorted(of)
    held = [(r.bin, of[r.doc_id]) for r in rows if r.bin is not None]
    assert len(held) == len(set(held)) and len(set(of.values())) < len(of)
    assert sum(r.n_words for r in rows) == sum(len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())


def test_rows_of_one_id_are_spread(spark):
    """Equal rows, and rows without an id: exact sums before each, in windows of a bounded size."""
    from prefmine.llm.common import running_sums

    rows = [(1, "k", 3)] * 4000 + [(2, f"x{i}", i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o string, v long").withColumn("row", F.monotonically_increasing_id())
    out = running_sums(df, ["g"], ["o", "row"], "v", "before", Scratch(spark, "t"))
    got = sorted((r.g, r.o, r.row, r.v, r.before) for r in out.collect())
    want, sums = [], {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.o, r.row)):
        want.append((r.g, r.o, r.row, r.v, sums.get(r.g, 0)))
        sums[r.g] = sums.get(r.g, 0) + r.v
    assert got == want
    same = spark.createDataFrame([(None, "one text here", "s", 0)] * 3000 + [(7, "two words", "s", 0)], "doc_id long, text string, source string, n int")
    p = mixing.plan(same, keep=["doc_id"]).collect()
    assert len(p) == 3001 and sum(r.taken for r in p) == sum(r.size for r in p) == 9002
