import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_fixtures import SF001, messy, nothing  # noqa: F401
from pyspark.sql import functions as F

from prefmine.llm import collocations, common, queries

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least, top):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "New", "York", "of", "über", "café", "x", "AÀ", " ", "a|b", "漢字", "ÿ", "new-york", "'s"] + [f"w{i}" for i in range(30)]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";\n", " ! ", "\r\n", ":", "?"])
    out = []
    for _ in range(n):
        t = "".join((rng.choice(words[: rng.choice([5, 14, 44])]) if rng.random() < 0.8 else "over the hills") + gap() for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), t))
    return out + [("en", None), (None, None), ("fr", ""), ("fr", " .\n"), ("en", "new york new york"), ("en", "new york new york")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, min_count=4, top=50, bits=15, partition_mass=500)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 50)


def test_long_texts_are_read_whole(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(3000))), ("en", "." .join(rng.choice("abcdefgh") for _ in range(2000))),
            ("en", "no gap in this one ".replace(" ", "") * 200)]
    whole = [list(collocations.chunks(iter([batch(rows)]), size)) for size in (97, 1 << 21)]
    assert len(whole[0]) > 100 and len(whole[1]) == 1
    grams = [Counter(tuple(w[i : i + n]) for _, w, old in runs for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)
                     if i + n > old and collocations.END not in w[i : i + n]) for runs in whole]
    assert grams[0] == grams[1]
    long = [("en", ("alpha beta gamma delta epsilon. " * 70000) + "the end")] * 2  # over CHUNK_BYTES
    got = collocations.collocations(spark.createDataFrame(long, "lang string, text string"), min_count=30, top=50)
    assert sorted(map(tuple, got.collect())) == brute(long, 30, 50)


def batch(rows):
    return pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.zipf(1.3, 20000) % 5000, np.repeat(rng.integers(5000, 9000, 40), 30)]).astype(np.uint64)
    rng.shuffle(data)
    true = Counter(data.tolist())
    parts = []
    for own in np.array_split(data, 37):
        s = collocations.MisraGries(len(data) // 30 + 1)
        s.merge(*np.unique(own, return_counts=True))
        parts.append(s)
    whole = collocations.MisraGries(len(data) // 30 + 1)
    for s in parts:
        whole.merge(s.keys, s.counts)
    assert len(whole.keys) <= whole.capacity < len(true) and 0 < whole.error <= len(data) / (whole.capacity + 1) < 30
    kept = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    for k, n in true.items():
        assert kept.get(k, 0) <= n <= kept.get(k, 0) + whole.error
        assert n < 30 or k in kept


@pytest.mark.parametrize("bits", [15, 20])
def test_bitmap_misses_no_hash(spark, bits):
    words = [f"w{i}" for i in range(3000)]
    h = spark.createDataFrame([("dé", w) for w in words], "lang string, word string").select(F.xxhash64("lang", "word").alias("h"))
    bm = collocations.bitmap(h, bits)
    seed = xxhash.xxh64_intdigest("dé".encode(), 42)
    mine = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in words], np.uint64)
    assert len(bm) == 1 << bits - 3 and collocations.held_in(bm, mine).all()
    other = np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2)
    assert collocations.held_in(bm, other).mean() < (0.06 if bits == 15 else 0.01)


def test_packed_numbers_round_trip():
    for v in ([], [0], [255, 1], [256], [1 << 40, 3], [(1 << 64) - 1]):
        a = np.array(v, np.uint64)
        assert common.unpacked(common.packed(a)).tolist() == v


def test_messy_and_empty_tables(spark, messy, nothing):
    rows = [(r.lang, r.text) for r in messy.collect()]
    got = collocations.collocations(messy, min_count=5, top=100, bits=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 100)
    assert collocations.collocations(nothing).count() == 0
    clash = messy.select("text", "lang", F.lit(1).alias("phrase"), F.lit(2).alias("n"), F.lit(3).alias("rank"))
    assert collocations.collocations(clash, min_count=5, top=100, bits=16).count() == len(got.collect())


def test_counts_beyond_64_bits_in_products(spark):
    big = 1 << 61
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big - 1)], "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 7), ("en", "c", big)], "lang string, word string, f long")
    got = [tuple(r) for r in collocations.ranked(phrases, words, 30, 10, 80).collect()]
    n = 3 * big + 12
    assert got == [("en", 1, "a b c", big - 1, big, big, n, 2000000 * (big - 1) // (2 * big))]


def test_query(spark):
    got = queries.QUERIES["op11_collocations"](spark, SF001)
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint",
                                "n": "bigint", "score": "bigint"}
    rows = [(r.lang, r.text) for r in queries.read(spark, SF001, "documents").select("lang", "text").collect()]
    assert sorted(map(tuple, got.collect())) == brute(rows, 30, 2000)
