"""Phrase collocations from mergeable Misra-Gries summaries.

A first pass over the texts deals n-gram hashes to hash partitions; every partition
merges the summaries of all tasks into one with more counters than its mass divided
by the threshold, so every n-gram that reaches the threshold keeps a counter.  The
surviving hashes become a bitmap of fixed size, and a second pass over the texts counts
exactly (by the words themselves) what the bitmap lets through.  The bitmap may let
more through, never less, so results do not depend on its size.

Before both passes the words are counted; an n-gram with a word below the threshold
cannot reach it and is left out early, by a second bitmap of the same kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, packed, unpacked

LONGEST = 4  # words of a phrase
NO_LANG = "und"
# Bytes in lower case (A-Z alone); what ends a piece becomes 0xFF, which no UTF-8 text has.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(0xFF if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\xff"
GAP = re.compile(rb"[ \t" + re.escape(ENDS) + rb"]")

# Bits of each bitmap: 2^27 are 16 MB, the fixed size of what is broadcast.
BITMAP_BITS = 27
# N-gram occurrences a hash partition is meant to hold.
PARTITION_MASS = 1 << 22
CHUNK_BYTES = 1 << 21
# N-gram hashes a task gathers before it sums them up, and counters it holds before it hands them on.
GATHERED = 1 << 21
HELD = 1 << 17


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case, and END where a piece ends."""
    return text.translate(FOLD).replace(END, b" " + END + b" ").split()


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, list[bytes], int]]:
    """(lang, words, old): the texts of a language in runs of about ``size`` bytes, however
    long a text is.  The first ``old`` words were the last of the run before; only phrases
    that reach past them are new."""
    waiting: dict[bytes, list] = {}
    for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        for lang, text in zip(b["lang"].cast(pa.binary()).to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
            if not text:
                continue
            if len(text) > size:
                at, last = 0, []
                while at < len(text):
                    cut = GAP.search(text, min(at + size, len(text)))
                    cut = cut.start() if cut else len(text)
                    words = last + words_of(text[at:cut])
                    yield lang, words, len(last)
                    last, at = words[-(LONGEST - 1):], cut
                continue
            own = waiting.setdefault(lang, [0])
            own.append(text)
            own[0] += len(text)
            if own[0] >= size:
                yield lang, words_of(b"\n".join(own[1:])), 0
                del waiting[lang]
    for lang, own in waiting.items():
        yield lang, words_of(b"\n".join(own[1:])), 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): occurrences of every word, summed up in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            keys = list(held)
            out = pa.record_batch([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary()),
                                   pa.array(list(held.values()), pa.int64())], names=["lang", "word", "f"])
            held.clear()
            return out

        for lang, words, old in chunks(batches):
            own = Counter(words[old:])
            own.pop(END, None)
            for w, n in own.items():
                held[lang, w] += n
            if len(held) >= HELD:
                yield told()
        if held:
            yield told()

    return (docs.mapInArrow(count, "lang binary, word binary, f long")
            .groupBy(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f")))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set at two places for every hash ``h``; 2^(bits - 3) bytes, however many
    hashes there are.  Slices of 4 KB are made by Spark and put together here."""
    places = hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("at"))
    slices = places.groupBy(F.shiftright("at", 15).alias("slot")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).toArrow()
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8).reshape(-1, 4096)
    for slot, data in zip(slices["slot"].to_pylist(), slices["bits"].to_pylist()):
        out[slot] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _places(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(F.shiftleft(h, 64 - bits - 16), 64 - bits)]


def held_in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each hash (no hash it was made of is missed)."""
    width = int(len(bits)).bit_length() + 2
    out = np.ones(len(h), bool)
    for at in (h >> np.uint64(64 - width), (h << np.uint64(64 - width - 16)) >> np.uint64(64 - width)):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class Vocabulary(dict):
    """Word -> number, with the words' hashes (0 where the bitmap rules a word out).
    It forgets everything when it holds more than ``limit`` words."""

    def __init__(self, lang: bytes, bits: np.ndarray, limit: int = 1 << 16):
        import xxhash

        self.digest, self.seed, self.bits, self.limit = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang, 42), bits, limit
        self.fresh: list[int] = []
        self.known = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.known) + len(self.fresh)
        # As Spark's xxhash64(lang, word).
        self.fresh.append(0 if word == END else self.digest(word, self.seed))
        return at

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.limit:
            self.clear()
            self.fresh, self.known = [], np.empty(0, np.uint64)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            h = np.array(self.fresh, np.uint64)
            self.known = np.append(self.known, np.where((h != 0) & held_in(self.bits, h), h, np.uint64(0)))
            self.fresh = []
        return ids, self.known[ids]


def gram_hashes(h: np.ndarray, old: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) for n = 2 to LONGEST: the n-grams of words with a hash that
    reach past the first ``old`` words.  The low 16 bits of a hash are zero."""
    there = h != 0
    ok, run = there, h
    for n in range(2, LONGEST + 1):
        if len(run) < 2:
            return
        ok = ok[:-1] & there[n - 1 :]
        run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        starts = np.flatnonzero(ok)
        starts = starts[starts + n > old]
        x = run[starts]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, starts, (x ^ (x >> np.uint64(29))) & np.uint64(0xFFFFFFFFFFFF0000)


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters, each below the true count by
    at most ``error`` <= mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add a summary (or part of the data) with distinct keys in rising order."""
        both, sums = np.append(self.keys, keys), np.append(self.counts, counts)
        order = np.argsort(both, kind="stable")
        both, sums = both[order], sums[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
        self.keys, self.counts = both[first], np.add.reduceat(sums, first) if len(first) else sums
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            less = int(np.partition(self.counts, at)[at])
            keep = self.counts > less
            self.keys, self.counts, self.error = self.keys[keep], self.counts[keep] - less, self.error + less


def surviving_grams(docs: DataFrame, words, mass: int, min_count: int, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(h): hashes of n-grams, among them all that occur ``min_count`` times or more.

    ``words`` is the broadcast bitmap of frequent words, ``mass`` a bound on the n-gram
    occurrences; with it the hash partitions, and so what a task holds, keep their size
    while the corpus grows.  A group is one hash partition: equal n-grams arrive
    as one counter for each run of a task, so a frequent one makes no large group.
    """
    bits = max(0, (mass // partition_mass).bit_length())

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Vocabulary] = {}
        held, n = [], 0

        def told() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys >>= np.uint64(16)
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48 - bits))
            rows = [(p, int(c.sum()), packed(np.diff(k, prepend=np.uint64(0))), packed(c))
                    for p, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))) if len(k)]
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in
                                    enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "mass", "keys", "counts"])

        for lang, words_, old in chunks(batches):
            own = known.get(lang) or known.setdefault(lang, Vocabulary(lang, words.value))
            for _, _, h in gram_hashes(own.numbered(words_)[1], old):
                held.append(h)
                n += len(h)
            if n >= GATHERED:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    def merged(t: pa.Table) -> pa.Table:
        own = MisraGries(sum(t["mass"].to_pylist()) // min_count + 1)
        for keys, counts in zip(t["keys"], t["counts"]):
            own.merge(np.cumsum(unpacked(keys.as_py()), dtype=np.uint64), unpacked(counts.as_py()).astype(np.int64))
        keep = own.counts + own.error >= min_count
        return pa.table([pa.array((own.keys[keep] << np.uint64(16)).view(np.int64))], names=["h"])

    return (docs.mapInArrow(summaries, "part long, mass long, keys binary, counts binary")
            .groupBy("part").applyInArrow(merged, "h long"))


def phrase_counts(docs: DataFrame, words, grams, mass: int, min_count: int, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(lang, phrase, size, f): exact counts of the phrases of 2 to LONGEST words that occur
    ``min_count`` times or more in a language; phrases are space-joined.

    Tasks sum up what both bitmaps let through and hand it on as one row for each of the
    hash partitions of :func:`surviving_grams`, where the sums of all tasks meet."""
    bits = max(0, (mass // partition_mass).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Vocabulary] = {}
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            keys = sorted(held)
            parts = np.array([k[0] for k in keys], np.int64)
            ends = pa.array(np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, kind)) for c, kind in
                     (([k[1] for k in keys], pa.binary()), ([k[2] for k in keys], pa.binary()), ([held[k] for k in keys], pa.int64()))]
            held.clear()
            return pa.record_batch([pa.array(np.unique(parts)), *lists], names=["part", "langs", "phrases", "f"])

        for lang, words_, old in chunks(batches):
            own = known.get(lang) or known.setdefault(lang, Vocabulary(lang, words.value))
            ids, h = own.numbered(words_)
            before = ids  # numbers of the (n-1)-grams by place, -1 where one was let through by neither bitmap
            for n, starts, hashes in gram_hashes(h, 0):
                through = held_in(grams.value, hashes)
                if n > 2:  # both parts of a frequent phrase are frequent
                    through &= (before[starts] >= 0) & (before[starts + 1] >= 0)
                starts, hashes = starts[through], hashes[through]
                # A number for each different n-gram, from those of its first part and its last word.
                _, first, own_no = np.unique(before[starts] << 32 | ids[starts + n - 1], return_index=True, return_inverse=True)
                times = np.bincount(own_no[starts + n > old], minlength=len(first))
                new = times > 0
                parts = hashes[first[new]] >> np.uint64(64 - bits) if bits else np.zeros(new.sum(), np.uint64)
                for part, at, f in zip(parts.tolist(), starts[first[new]].tolist(), times[new].tolist()):
                    held[part, lang, b" ".join(words_[at : at + n])] += f
                before = np.full(len(ids), -1, np.int64)
                before[starts] = own_no
            if len(held) >= HELD:
                yield told()
        if held:
            yield told()

    def summed(t: pa.Table) -> pa.Table:
        flat = pa.table([t[c].combine_chunks().flatten() for c in ("langs", "phrases", "f")], names=["lang", "phrase", "f"])
        f = flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        return f.filter(pc.greater_equal(f["f_sum"], min_count)).select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    return (docs.mapInArrow(count, "part long, langs array<binary>, phrases array<binary>, f array<long>")
            .groupBy("part").applyInArrow(summed, "lang binary, phrase binary, f long")
            .select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")
            .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, held_share: int = 80, lang: str = "lang",
                 text: str = "text", bits: int = BITMAP_BITS, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Texts are lower-cased (A-Z) and cut at .,;:!? and line ends into pieces, those at spaces
    and tabs into words.  A candidate is a phrase of 2 to 4 words with a >= ``min_count``
    occurrences within pieces; cut after k words, l and r are the counts of its parts and
    floor(2000000 a / (l + r)) the cut's score.  The lowest-scoring cut counts (at a tie
    the smallest k).  Candidates inside a longer one that has ``held_share`` percent of
    their occurrences or more are left out.  n is the language's number of words.  Ranked by
    score, then a (both falling), then phrase in the order of its bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count
    each time; texts of any length are read whole, in runs; other columns are not read.
    Without candidates, or without rows, the result is empty.  All counts are exact and
    cover all rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").alias("text"))
    words = scratch.write(word_counts(docs))
    often = words.where(F.col("f") >= min_count)
    mass = (LONGEST - 1) * (often.agg(F.sum("f")).first()[0] or 0)
    frequent = spark.sparkContext.broadcast(bitmap(often.select(F.xxhash64("lang", "word").alias("h")), bits))
    grams = scratch.write(surviving_grams(docs, frequent, mass, min_count, partition_mass))
    through = spark.sparkContext.broadcast(bitmap(grams, bits))
    phrases = scratch.write(phrase_counts(docs, frequent, through, mass, min_count, partition_mass))
    scratch.drop(grams)
    return ranked(phrases, words, min_count, top, held_share)


def ranked(phrases: DataFrame, words: DataFrame, min_count: int, top: int, held_share: int) -> DataFrame:
    """The scored and ranked result of exact phrase and word counts."""
    whole = "decimal(20,0)"
    f = words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases.select("lang", "phrase", "f"))
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = (phrases.select("lang", "phrase", "f", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
            .withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
            .join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
            .withColumn("score", F.expr(f"CAST(f AS {whole}) * 2000000BD div (CAST(l AS {whole}) + CAST(r AS {whole}))")))
    best = cuts.groupBy("lang", "phrase").agg(F.max("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every part of two words or more of a longer candidate, with the longer one's count.
    held = (phrases.where("size > 2").select("lang", "f", F.split("phrase", " ").alias("w"), F.explode(F.expr(
                "filter(flatten(transform(sequence(1, size - 1), at -> transform(sequence(2, size - 1), n -> struct(at, n)))), "
                "x -> x.at + x.n <= size + 1)")).alias("x"))
            .groupBy("lang", F.array_join(F.slice("w", F.col("x.at"), F.col("x.n")), " ").alias("phrase")).agg(F.max("f").alias("longer")))
    left = best.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast(whole) * 100 < F.col("a").cast(whole) * held_share))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top).join(total, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
