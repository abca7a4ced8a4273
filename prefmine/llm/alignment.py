"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens.  Offsets where tokens of both end cut
the text into groups, found by divide and conquer: in an interval the common end nearest
its middle is located by bisecting the other tokenizer's ends, then both halves are cut
in the same way; an interval without a common end inside is a group.  All intervals of
many texts are probed together, level by level.

Every token of A is linked with every token of B in its group.  How many documents hold
an id pair is counted over the whole corpus: tasks work through blocks of documents, a
block tells each of its pairs once with its documents, the sums go back to the blocks
that asked, and each block weighs its own documents.  So a pair that every document
holds costs a row per block, never one per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, packed, unpacked

# Text tokenized together, and links of different documents and pairs that make a block.
CHUNK_BYTES = 1 << 20
BLOCK_LINKS = 1 << 21
# Probes next to the middle of an interval before all its ends are bisected at once.
PROBES = 24
# Links of a group beyond which equal tokens in it are counted before they are paired.
WIDE = 1 << 12

# Texts of these characters alone are cut alike by both implementations of the byte-level
# pattern; all others go to the file's own library.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
# The byte-level pattern, as published with that kind of tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte-level letter -> byte: printable Latin-1 stands for itself, the other bytes for
    the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A ``tokenizers`` file of the byte-level kind; special strings are plain text."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.fast = self._ranked(json.load(open(path, encoding="utf-8")))

    def _ranked(self, spec: dict):
        """The same tokenizer as ranks, where the file says that merges come in the order of
        their ids and nothing else happens to a text; else None."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        ids = model["vocab"]
        if (spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
                or model.get("dropout") or model.get("ignore_merges") or any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(merges))):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def encode(self, texts: list[str]) -> list:
        plain = [self.fast is not None and PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(others).ids for t, p in zip(texts, plain)]


class Pieces:
    """A ``sentencepiece`` model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(i) for i in range(self.size))]

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


@cache
def tokenizers_of(path_a: str, path_b: str) -> tuple:
    """One pair per worker, with the lengths of all tokens and, for A and B together, the
    texts of ids followed by each separator."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
    size = max(a.size, b.size)
    return a, b, lengths, size, [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(size)]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places in ``ends_a`` and ``ends_b`` of the ends that both have.

    Both are rising offsets; ``last`` are the places in ``ends_a`` of ends known to be
    common (each text's last one), which make the first intervals.
    """
    found = [(last, np.searchsorted(ends_b, ends_a[last]))]
    low, high = np.append(0, last[:-1] + 1), last  # ends inside an interval: places low to high - 1
    while len(low):
        inside = high > low
        low, high = low[inside], high[inside]
        cut = np.full(len(low), -1, np.int64)
        middle, open_ = (low + high - 1) // 2, np.arange(len(low))
        for step in range(PROBES):
            # Outward from the middle, above and below in turn.
            at = middle[open_] + ((step + 1) // 2 if step % 2 else -(step // 2))
            ok = (at >= low[open_]) & (at < high[open_])
            tried, at = open_[ok], at[ok]
            to = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[np.minimum(to, len(ends_b) - 1)] == ends_a[at]
            cut[tried[hit]] = at[hit]
            found.append((at[hit], to[hit]))
            open_ = open_[(cut[open_] < 0) & (high[open_] - low[open_] > step + 1)]
            if not len(open_):
                break
        for i in open_:  # no common end near the middle: bisect for all ends of the interval
            own = ends_a[low[i] : high[i]]
            to = np.searchsorted(ends_b, own)
            hits = np.flatnonzero(ends_b[np.minimum(to, len(ends_b) - 1)] == own)
            if len(hits):
                best = hits[np.argmin(np.abs(hits + low[i] - middle[i]))]
                cut[i] = best + low[i]
                found.append((cut[i : i + 1].copy(), to[best : best + 1]))
        split = cut >= 0
        low, high, cut = low[split], high[split], cut[split]
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])
    at, to = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at)
    return at[order], to[order]


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] numbers), then the same from first[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, with the sums of their counts (1 each by default)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Aligned:
    """The groups and links of some texts: arrays over all their tokens."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        self.a, self.b, lengths, self.size, self.text = tokenizers_of(path_a, path_b)
        there = [i for i, t in enumerate(texts) if t]
        ids = [[None] * len(texts) for _ in "ab"]
        for i, x, y in zip(there, self.a.encode([" " + texts[i] for i in there]), self.b.encode([texts[i] for i in there])):
            whole = b" " + texts[i].encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == whole and b"".join(map(self.b.bytes.__getitem__, y)) == whole:
                ids[0][i], ids[1][i] = x, y
        self.n = [np.array([len(x) if x else 0 for x in own], np.int64) for own in ids]
        self.ids = [np.fromiter((t for x in own if x for t in x), np.int64, int(n.sum())) for own, n in zip(ids, self.n)]
        ends = [np.cumsum(size[x]) for size, x in zip(lengths, self.ids)]
        last = np.cumsum(self.n[0])[self.n[0] > 0] - 1
        self.cuts = shared_cuts(*ends, last) if len(last) else (np.empty(0, np.int64),) * 2
        # Of each group: tokens (of A, of B) and the places of the first ones.
        self.width = [np.diff(c, prepend=-1) for c in self.cuts]
        self.first = [c + 1 - w for c, w in zip(self.cuts, self.width)]
        self.text_of_group = np.repeat(np.arange(len(texts)), self.n[0])[self.cuts[0]]
        self.n_groups = np.bincount(self.text_of_group, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.text_of_group, self.width[0] * self.width[1])

    def groups(self) -> list[str]:
        """A's ids, then B's, of every group: ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        codes = np.empty(sum(len(x) for x in self.ids), np.int64)
        for side, own in enumerate(self.ids):
            sep = np.zeros(len(own), np.int64)
            sep[self.cuts[side]] = 1 + side
            if side:
                sep[np.cumsum(self.n[1])[self.n[1] > 0] - 1] = 3
            before = np.repeat(self.first[1] if side == 0 else self.first[0] + self.width[0], self.width[side])
            codes[np.arange(len(own)) + before] = sep * self.size + own
        ends = np.cumsum(self.n[0] + self.n[1])
        return ["".join(map(self.text.__getitem__, codes[e - n : e].tolist())) for e, n in zip(ends, self.n[0] + self.n[1])]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, times) of every text and id pair that a group of the text links; the key packs
        the text's place, then :func:`pair_of` the ids."""
        shift = pair_bits(self.a.size, self.b.size)
        wide = self.width[0] * self.width[1] > WIDE
        narrow = np.repeat(~wide, self.width[0])
        times = np.repeat(self.width[1], self.width[0])[narrow]
        head = (np.repeat(self.text_of_group, self.width[0]) << sum(shift) | self.ids[0] << shift[1])[narrow]
        keys, counts = summed(np.repeat(head, times) | self.ids[1][_spread(np.repeat(self.first[1], self.width[0])[narrow], times)])
        more = []
        for g in np.flatnonzero(wide):
            (x, m), (y, n) = (np.unique(own[f[g] : f[g] + w[g]], return_counts=True) for own, f, w in zip(self.ids, self.first, self.width))
            more.append(((int(self.text_of_group[g]) << sum(shift) | x[:, None] << shift[1] | y[None, :]).ravel(), np.outer(m, n).ravel()))
        return summed(*(np.concatenate(c) for c in zip((keys, counts), *more))) if more else (keys, counts)


def pair_bits(size_a: int, size_b: int) -> tuple[int, int]:
    """Bits of an id of A and of B in a pair."""
    return (size_a - 1).bit_length(), (size_b - 1).bit_length()


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None,
          digest: bool = False, chunk_bytes: int = CHUNK_BYTES, block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of an alignment of a byte-level file ``path_a`` with a sentencepiece
    model ``path_b`` (paths that every executor has).

    documents: the columns ``keep`` (all but the text by default) and n_a, n_b (tokens), n_groups,
    n_links (all A-B pairs of token occurrences that share a group), n_best (links whose pair
    is held by as many documents as any pair of their A id, ties included), count_sum (documents that
    hold a link's pair, summed over links) and groups (``a1,a2|b1;...``; with ``digest``
    its SHA-256 as groups_sha256; '' without tokens).  pairs: a, b and count, the documents (rows) that
    hold the pair linked.

    A is given the text with a space in front, B puts one there itself.  Null and empty texts, and texts whose
    tokens do not give back these bytes, have no tokens: zeros and ''.  Repeated rows count
    each time.  A text of any length is tokenized and aligned as a whole.  Columns of ``keep`` called like
    a result are left out.  An empty table gives two empty ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    shown = "groups_sha256" if digest else "groups"
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", shown]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results and (keep is not None or c != text)]
    # What is kept travels in a struct, so its names clash with nothing.
    told = docs.select((F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))).alias("rest"), F.col(text).cast("string").alias("text"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    rest = told.schema["rest"].dataType.simpleString()
    form = (f"block long, pairs array<long>, held array<int>, rest {rest}, " + ", ".join(f"{c} long" for c in numbers)
            + ", shown string, at binary, times binary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, waiting = TaskContext.get().partitionId(), 0, Block()
        for rows, texts in runs(batches, chunk_bytes):
            waiting.add(rows, Aligned(texts, path_a, path_b), digest)
            if waiting.size >= block_links:
                yield waiting.record(part << 32 | made, shift)
                made, waiting = made + 1, Block()
        if waiting.rows:
            yield waiting.record(part << 32 | made, shift)

    own = tokenizers_of(path_a, path_b)
    shift = pair_bits(own[0].size, own[1].size)
    found = scratch.write(told.mapInArrow(blocks, form))
    heads = found.where("pairs IS NOT NULL").select(F.col("block").alias("asker"), F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select(
        "asker", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = scratch.write(heads.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", shift[1])))
    # One row for each id of A at most.
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    asked = (heads.drop("held").join(counts, "pair").join(best, "a")
             .select("asker", "place", "count", (F.col("count") == F.col("most")).alias("best")))

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        count, good = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = np.asarray(right["place"].combine_chunks())
        count[place], good[place] = np.asarray(right["count"].combine_chunks()), right["best"].to_numpy()
        sums: list[tuple[int, int]] = []
        for at, times in zip(left["at"], left["times"]):
            at, times = np.cumsum(unpacked(at.as_py()).astype(np.int64)), unpacked(times.as_py()).astype(np.int64)
            sums.append((int(times @ good[at]), int(times @ count[at])))
        out = left.drop_columns(["block", "at", "times"])
        for i, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return out

    bodies = found.where("pairs IS NULL").drop("pairs", "held")
    weighed = bodies.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(
        weigh, f"rest {rest}, " + ", ".join(f"{c} long" for c in numbers) + ", shown string, n_best long, count_sum long")
    documents = weighed.select(*[F.col("rest").getField(c).alias(c) for c in keep], *numbers, "n_best", "count_sum", F.col("shown").alias(shown))
    pairs = counts.select(F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << shift[1]) - 1)).cast("int").alias("b"), "count")
    return documents, pairs


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(rest, texts) of rows in order, about ``size`` characters together (a longer text alone)."""
    rows, texts, n = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            rows.append(part["rest"])
            texts += part["text"].to_pylist()
            n += sum(len(t) for t in texts[-part.num_rows :] if t)
            if n >= size:
                yield pa.concat_arrays(rows), texts
                rows, texts, n = [], [], 0
    if texts:
        yield pa.concat_arrays(rows), texts


class Block:
    """Documents of one task whose pairs share a dictionary."""

    def __init__(self):
        self.rows, self.numbers, self.shown, self.keys, self.counts, self.size, self.texts = [], [], [], [], [], 0, 0

    def add(self, rows: pa.Array, own: Aligned, digest: bool) -> None:
        shift = sum(pair_bits(own.a.size, own.b.size))
        keys, counts = own.links()
        self.keys.append(keys + (self.texts << shift))
        self.counts.append(counts)
        self.size += len(keys)
        self.texts += len(rows)
        self.rows.append(rows)
        self.numbers.append(np.stack([*own.n, own.n_groups, own.n_links]))
        groups = own.groups()
        self.shown += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups

    def record(self, block: int, shift: tuple[int, int]) -> pa.RecordBatch:
        """A row with the dictionary (the most held pairs first), then one for each document
        with its places in the dictionary, as packed differences, and how often each is linked."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        text, pair = keys >> sum(shift), keys & ((1 << sum(shift)) - 1)
        pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-held, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        place = rank[place]
        sort = np.argsort(text * max(1, len(pairs)) + place)
        place, counts = place[sort], counts[sort]
        cuts = np.searchsorted(text[sort], np.arange(1, self.texts))
        at = [packed(np.diff(p, prepend=0)) for p in np.split(place, cuts)]
        times = [packed(c) for c in np.split(counts, cuts)]
        n = self.texts
        rest = pa.concat_arrays(self.rows)
        whole = lambda values, kind: pa.array([values, *[None] * n], kind)
        columns = [pa.array([block] * (n + 1), pa.int64()), whole(pairs[order], pa.list_(pa.int64())), whole(held[order].astype(np.int32), pa.list_(pa.int32())),
                   pa.concat_arrays([pa.nulls(1, rest.type), rest]), *[pa.array([None, *c], pa.int64()) for c in np.concatenate(self.numbers, axis=1).tolist()],
                   pa.array([None, *self.shown], pa.string()), pa.array([None, *at], pa.binary()), pa.array([None, *times], pa.binary())]
        return pa.record_batch(columns, names=["block", "pairs", "held", "rest", "n_a", "n_b", "n_groups", "n_links", "shown", "at", "times"])
