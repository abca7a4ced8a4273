import math
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from llm_fixtures import SF001, messy, nothing  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefmine.llm import kd_shards, queries, token_counts
from prefmine.llm.common import pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, messy, library):
    got = token_counts.count_tokens(messy, PATH, sample_docs=20, table_size=50).collect()
    assert len(got) == messy.count()
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.kept in ("k", None)


def test_special_strings_and_odd_characters(library):
    c = token_counts.TextCounter(PATH, {"the": 1})
    for t in ("a<|endoftext|>b <|startoftext|><|startoftext|>", "İstanbul ΣΑΣ ẞ Ⅷ ½ 가 é \x85\xa0x", "'S 'RE it's''s", "<|", "\x00\x1c\x7f",
              "A" * 3000, "日本語のテキスト", "x́" * 50):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_cache_generations_do_not_change_counts(library):
    c = token_counts.TextCounter(PATH, {})
    c.lengths.limit = 3
    t = "one two three four five six seven one two three"
    assert [c.count(t) for _ in range(3)] == [len(library.encode(t, add_special_tokens=False).ids)] * 3
    assert len(c.lengths) <= 4


def test_pieces_cut_before_white_space():
    t = "ab cde\tf " * 50
    cut = list(pieces(t, 7))
    assert "".join(cut) == t and len(cut) > 5
    assert all(p[0] in " \t" for p in cut[1:] if p)


def test_empty_table(spark, nothing):
    assert token_counts.count_tokens(nothing, PATH).count() == 0
    assert kd_shards.shard_documents(nothing, ["source"], n_shards=4).count() == 0


def test_op1_contract(spark, library):
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        n = len(library.encode(d.text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 2048)


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def test_shards_hold_near_equal_bytes_and_gapless_slots(messy):
    rows = kd_shards.shard_documents(messy.where("doc_id IS NULL OR doc_id <> 500"), ["source", "lang", "n_chars"], n_shards=5).collect()
    assert len(rows) == messy.count() - 1
    by = shards(rows)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert sorted(by) == list(range(5))
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
        assert abs(sum(r["size"] for r in group) - total / 5) <= 2 * largest
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)


def test_repeated_rows_are_split(spark):
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    by = shards(kd_shards.shard_documents(same, ["source"], n_shards=4).collect())
    assert [abs(len(v) - 1000) < 40 for v in by.values()] == [True] * 4


def test_tree_splits_the_widest_dimension_first(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("abcdefghi").alias("text"),
                                  F.when(F.col("id") < 1000, 1).otherwise(10**6).alias("n_chars"))
    by = shards(kd_shards.shard_documents(df, ["n_chars"], n_shards=2).collect())
    assert [{r.n_chars for r in by[i]} for i in (0, 1)] == [{1}, {10**6}]


def test_target_bytes_sets_the_number_of_leaves(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("123456789").alias("text"), F.col("id").alias("n"))
    by = shards(kd_shards.shard_documents(df, ["n"], target_bytes=1500).collect())
    assert len(by) == 7 and max(len(v) for v in by.values()) <= 150


def test_op2_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op2_kd_shards(spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sums = defaultdict(int)
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        sums[r.shard] += r["size"]
    mean, largest = sum(sums.values()) / 8, max(r["size"] for r in rows)
    assert sorted(sums) == list(range(8)) and all(abs(s - mean) <= max(largest, 0.02 * mean) for s in sums.values())
    for group in shards(rows).values():
        assert sorted(r.slot for r in group) == list(range(len(group)))


def test_slots_of_repeated_rows_are_spread(spark):
    """4,000 equal rows use many prefix buckets, and slots stay gapless."""
    df = spark.createDataFrame([(1, "same text", 9, "en", "s")] * 4000, "doc_id long, text string, n_chars long, lang string, source string")
    out = kd_shards.shard_documents(df, ["n_chars", "lang", "source"], n_shards=4).collect()
    for shard in range(4):
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own))) and len(own) in range(990, 1011)
    at = df.withColumn("copy_", F.monotonically_increasing_id()).select(F.shiftrightunsigned(F.xxhash64("copy_"), 52).alias("b"))
    assert at.distinct().count() > 1000


def brute_tree(rows, k, dims):
    """Leaf of each row (size, coordinates, tie) by a plain k-d tree: split along the widest dimension (by the
    whole table's widths) where the weights before come nearest to the left share, in the order of
    (coordinate, tie)."""
    width = [max(r[1][d] for r in rows) - min(r[1][d] for r in rows) for d in range(dims)]
    leaf = {}

    def split(own, first, m):
        if m == 1 or not own:
            leaf.update({r[3]: first for r in own})
            return
        spread = [(max(r[1][d] for r in own) - min(r[1][d] for r in own)) / width[d] for d in range(dims)]
        d = max(range(dims), key=lambda i: (spread[i], -i))
        order = sorted(own, key=lambda r: (r[1][d], r[2]))
        want, sums, at = sum(r[0] for r in own) * (m // 2) / m, 0, 0
        while at < len(order) and abs(sums + order[at][0] - want) <= abs(sums - want):
            sums += order[at][0]
            at += 1
        split(order[:at], first, m // 2)
        split(order[at:], first + m // 2, m - m // 2)

    split(rows, 0, k)
    return leaf


@pytest.mark.parametrize("seed", range(3))
def test_shards_equal_a_brute_force_tree(spark, seed):
    """Every shard's bytes are those of a plain k-d tree up to a document at each cut, and rows of different
    coordinates lie in the same leaf in all but the documents at the cuts."""
    import random

    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([5, 60, 200]), rng.randrange(1000), rng.randrange(50)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, m long")
    got = {r.doc_id: r.shard for r in kd_shards.shard_documents(df, ["n_chars", "m"], n_shards=8, tolerance=0.0).collect()}
    want = brute_tree([(len(t) + 1, (math.log1p(a), math.log1p(b)), i, i) for i, t, a, b in rows], 8, 2)  # lengths are on a logarithmic scale
    moved = sum(got[i] != want[i] for i in got)
    assert moved <= 0.03 * len(rows)
    size = {i: len(t) + 1 for i, t, *_ in rows}
    sums = [[sum(size[i] for i in got if of[i] == s) for s in range(8)] for of in (got, want)]
    assert all(abs(a - b) <= 3 * 201 for a, b in zip(*sums))
