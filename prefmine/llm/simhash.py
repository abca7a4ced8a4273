"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints within ``k`` bits are found by cutting the 64 bits into fewer
segments than plain pigeonholing needs, so that one segment differs by at most
one bit (two segments of 32 bits for k = 2 or 3).  Every distinct fingerprint is
indexed under each segment's one-wildcard variants (the segment with one bit
deleted); an equality join on the variants gives the candidates, and the whole
distance verifies them.  Connected components over the verified links follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, file_place, free_name, pieces

# Distinct fingerprints under one variant beyond which its pairs are found
# through a second variant instead of pair by pair.
WIDE = 64


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
    text's ``n``-word shingles, repeats included; no words: 0."""
    import xxhash

    counts, total, tail = np.zeros(64, np.int64), 0, []
    h, words = xxhash.xxh64_intdigest, []
    for piece in pieces(text or ""):
        # bytes.lower() changes A-Z alone; bytes.split() cuts at the six white-space bytes
        words = tail + piece.encode("utf-8", "surrogatepass").lower().split()
        m = len(words) - n + 1
        if m > 0:
            grams = zip(*[words[i:] for i in range(n)])
            hashes = np.fromiter((h(b" ".join(g), 42) for g in grams), np.uint64, m)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += m
        tail = words[max(0, len(words) - n + 1) :]
    if not total:
        if not words:
            return 0
        return h(b" ".join(words), 42)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a signed long (replacing a column ``name``).
    Null or empty texts have fingerprint 0.  Long texts are read piece by piece."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.fromiter((fingerprint(t if isinstance(t, str) else None, shingle) for t in s),
                                        np.uint64, len(s)).view(np.int64))

    tmp = free_name(docs.columns, "simhash_")
    return docs.withColumn(tmp, simhash(F.col(text))).drop(name).withColumnRenamed(tmp, name)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _segments(k: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: so many that one differs by at most one bit."""
    m = k // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(points: DataFrame, k: int) -> DataFrame:
    """(key, fp): a row for each segment and wildcard position.  The key packs the
    position (its bit in the fingerprint) and the segment without that bit."""
    masks = [(shift + i, ((1 << width) - 1) << shift & ~(1 << (shift + i)))
             for shift, width in _segments(k) for i in range(width)]
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    table = F.array(*[F.struct(F.lit(p).alias("at"), F.lit(sign(m)).cast("long").alias("mask")) for p, m in masks])
    v = points.select("fp", F.explode(table).alias("v"))
    return v.select(F.col("v.at").alias("at"), F.col("fp").bitwiseAND(F.col("v.mask")).alias("key"), "fp")


def links(points: DataFrame, k: int, scratch: Scratch, wide: int = WIDE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct
    fingerprints ``fp`` within ``k`` bits; every link is verified.

    A variant with at most ``wide`` fingerprints is joined with itself.  In a wider
    one (its members agree in a whole segment but for one bit) a chain of pairs
    through shared midpoints takes the place of the pair-by-pair join: see
    :func:`_wide_links`.  Both are exact, so ``wide`` only bounds the work.
    """
    v = variants(points, k)
    # Counted by a combined aggregate and joined back, not by a window: a variant that
    # very many fingerprints share is then never one task's work.  The counts grow with
    # the corpus, so the join is a sort-merge join at every size, whose hot variants
    # adaptive execution splits.
    often = scratch.write(v.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.write(v.hint("merge").join(often, ["at", "key"]))
    narrow = shared.where(F.col("n") <= wide)
    pairs = (narrow.select("at", "key", F.col("fp").alias("a"))
             .join(narrow.select("at", "key", F.col("fp").alias("b")), ["at", "key"])
             .where((F.col("a") < F.col("b")) & (_distance("a", "b") <= k)).select("a", "b"))
    big = shared.where(F.col("n") > wide)
    return scratch.write(pairs.unionByName(_wide_links(big, k)).distinct())


def _wide_links(members: DataFrame, k: int) -> DataFrame:
    """Links inside variants with many members, without forming their pairs.

    Two fingerprints of distance d <= k are joined by a path that flips their
    differing bits one by one; its middle is within ceil(d/2) flips of one and
    floor(d/2) of the other.  So each member stands under every fingerprint within
    floor(k/2) flips, and for odd k also one flip further as a guest.  Members
    that share a middle are within k: all are linked to the smallest of them, and
    guests to it as well if they meet a host there.
    """
    distinct = members.select("fp").distinct()
    r, odd = k // 2, k % 2
    flip = F.array(*[F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(64)])
    ball = distinct.select("fp", F.col("fp").alias("mid"), F.lit(0).alias("d"))
    last = ball
    for step in range(1, r + odd + 1):
        last = (last.select("fp", F.explode(flip).alias("bit"), "mid")
                .select("fp", F.col("mid").bitwiseXOR(F.col("bit")).alias("mid"), F.lit(step).alias("d")).distinct())
        ball = ball.unionByName(last)
    host = ball.groupBy("mid").agg(F.min(F.when(F.col("d") <= r, F.col("fp"))).alias("host"))
    return (ball.join(host.where("host IS NOT NULL"), "mid").where(F.col("fp") != F.col("host"))
            .where(_distance("fp", "host") <= k)
            .select(F.least("fp", "host").alias("a"), F.greatest("fp", "host").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node it reaches.

    Alternates large stars (every node hands its greater neighbours to its least
    neighbour) and small stars (the same for the lesser ones) until no edge moves;
    the number of rounds grows with the logarithm of the longest path.  Each step
    is written, so nothing is recomputed if an executor is lost.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = (e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large
                else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        j = both.join(low, "a")
        if large:
            moved = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = j.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        out = scratch.write(moved.where(F.col("a") != F.col("b")).distinct())
        scratch.drop(low)
        return out

    def state(e: DataFrame) -> tuple:
        # Which edges there are, in one row: count and an order-free sum of hashes.
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
                           F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())

    now, before = edges, None
    while (mark := state(now)) != before:
        before = mark
        mid = star(now, large=True)
        nxt = star(mid, large=False)
        scratch.drop(mid, *([now] if now is not edges else []))
        now = nxt
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def near_duplicates(prints: DataFrame, k: int = 2, id_col: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """(fingerprint, component, component_id) for every distinct fingerprint in
    ``prints``: ``component`` is the same for fingerprints joined by links of at most
    ``k`` differing bits, ``component_id`` the smallest id among their rows.

    ``prints`` should be a written table.  Rows with a null id take part (a component
    of null ids alone has component_id null), rows with a null fingerprint do not.
    Equal fingerprints are one node, however many rows share it.  An empty table
    gives no rows.
    """
    scratch = Scratch(prints.sparkSession, "simhash")
    nodes = scratch.write(prints.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("fp"))
                          .agg(F.min(id_col).alias("least")))
    roots = components(links(nodes, k, scratch), scratch)
    tagged = scratch.write(nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    least = scratch.write(tagged.groupBy("root").agg(F.min("least").alias("component_id")))
    return scratch.write(tagged.join(least, "root").select(
        F.col("fp").alias(name), F.col("root").alias("component"), "component_id"))


def one_of_each(docs: DataFrame, k: int = 2, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for every component of near duplicates: its smallest id
    (null after all others), among rows of that id the one with the smallest hash, and among
    rows equal in that (repeated rows, rows that differ in a map column alone) the first in the files.
    All columns are kept.  A row is named by its file, its place in it and its hash, so no row is
    lost to a collision of hashes; a table that was not read from files is written first.
    Null and empty texts are near duplicates of each other; texts of any length are read whole;
    an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    if file_place(docs) is None:
        docs = scratch.write(docs)
    columns, (path, index) = docs.columns, file_place(docs)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row, file, at = name = [free_name(columns, n) for n in ("row_", "file_", "index_")]
    docs = docs.select("*", F.xxhash64(*hashed).alias(row), path.alias(file), index.alias(at))
    prints = scratch.write(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.struct(*name).alias("row"),
                                                        F.col(text).alias("text")), "text", "fp", shingle).drop("text"))
    member = near_duplicates(prints, k, "id", "fp").select("fp", "component")
    first = (prints.join(member, "fp").groupBy("component")
             .agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first"))
             .select(F.col("first.row").alias("row")).select("row.*").distinct())
    return docs.join(scratch.write(first), name, "left_semi").dropDuplicates(name).select(*columns)
