"""Best-fit packing under conflicts.

Documents are packed into sequences (bins) of ``capacity`` words.  Bins are held in
the order of their residual room and carry bitmaps of the sources and duplicate
clusters they hold; a document goes to the tightest bin that has room and no
conflict, found by walking up from the first bin with enough room.  Bins are made
in independent blocks of a bounded number of documents, one task each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, places
from prefmine.llm.mixing import word_count

BIN_BITS = 32


def best_fit(lengths: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int,
             per_source: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of every piece and the number of bins, for pieces of 1 to
    ``capacity`` words, longest first.  A bin takes at most ``per_source`` pieces of
    a source and one of a duplicate cluster."""
    order: list[int] = []  # residual * 2^32 + bin, ascending
    planes: list[list[int]] = []  # bin -> for n = 1.. per_source: bitmap of the sources with n pieces
    dups: list[int] = []  # bin -> bitmap of clusters
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, s, c = lengths[i], 1 << sources[i], 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(order, need << BIN_BITS)
        while at < len(order):  # successor search: the next larger residual until one is compatible
            b = order[at] & ((1 << BIN_BITS) - 1)
            if not planes[b][-1] & s and not dups[b] & c:
                room = order.pop(at) >> BIN_BITS
                break
            at += 1
        else:
            b, room = len(dups), capacity
            planes.append([0] * per_source)
            dups.append(0)
        for p in range(per_source):
            if not planes[b][p] & s:
                planes[b][p] |= s
                break
        dups[b] |= c
        bins[i], offsets[i] = b, capacity - room
        if room > need:
            insort(order, (room - need) << BIN_BITS | b)
    return bins, offsets, len(dups)


def _codes(values: pd.Series, shared_only: bool) -> list[int]:
    """Small consecutive numbers; -1 for values that occur once, if ``shared_only``."""
    codes = pd.Series(pd.factorize(values, use_na_sentinel=False)[0])
    if shared_only:
        often = codes.map(codes.value_counts()) > 1
        codes = pd.Series(pd.factorize(codes.where(often, -1))[0]).where(often, -1)
    return codes.tolist()


def _along(bins: Sequence[int], words: Sequence[int], rows: Sequence[int]) -> dict[int, int]:
    """New numbers of the bins: by the mean row of their words."""
    held: dict[int, list[int]] = {}
    for b, n, i in zip(bins, words, rows):
        h = held.setdefault(b, [0, 0])
        h[0] += n * i
        h[1] += n
    return {b: k for k, b in enumerate(sorted(held, key=lambda b: (held[b][0] / held[b][1], b)))}


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text: str = "text", source: str = "source",
         cluster: str | None = None, per_source: int = 4, block_rows: int = 4096,
         order: Sequence[Column] | None = None, words: str | None = None) -> DataFrame:
    """A row for every piece: (id, part, start_word, n_words, bin, bin_offset).

    A document longer than ``capacity`` words is cut into full pieces, which fill a
    bin each, and a rest.  No bin holds more than ``per_source`` pieces of a source
    (null is a source) or two pieces of one duplicate cluster: equal ``cluster``
    values, by default equal texts; null clusters conflict with nothing, null texts
    have no words.  A document without words gives one row with null bin.  Repeated
    rows are packed one by one, as duplicates of each other.

    ``words`` names a column with the number of words, for tables without the text (then ``cluster`` is
    needed).  Other columns, whatever their names, take no part; an empty table gives no rows.

    Rows are dealt to blocks of about ``block_rows`` by a hash of their place in a
    written table, so neither a source nor a group of copies can fill a block; bins
    never span blocks.  Bin ids are unique, not consecutive.

    With ``order`` (columns; none: the rows as they stand) the blocks are contiguous
    ranges of that order instead, ties as the rows stand, and bin ids ascend along it:
    block by block, and in a block by the mean place of the words in the bin.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    dup = F.xxhash64(text) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), (F.col(words).cast("long") if words else word_count(text)).alias("n"), F.col(source).alias("src"),
                                     dup.alias("dup"), F.monotonically_increasing_id().alias("row"),
                                     *[c.alias(f"order{i}") for i, c in enumerate(order or [])]))
    count = rows.count()
    blocks, ordered = max(1, -(-count // block_rows)), order is not None
    if not ordered:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    else:
        rows = places(rows, [*[f"order{i}" for i in range(len(order))], "row"], "place", scratch)
        rows = rows.select("id", "n", "src", "dup", F.col("place").alias("row"),
                           F.floor(F.col("place") * blocks / max(1, count)).alias("block"))
    id_type = rows.schema["id"].dataType.simpleString()

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        base = int(pdf["block"].iloc[0]) << BIN_BITS
        rest = pdf["n"] % capacity
        some = pdf.index[rest > 0]
        bins, offsets, used = best_fit(rest[some].tolist(), _codes(pdf["src"][some], False),
                                       _codes(pdf["dup"][some], True), capacity, per_source)
        placed = dict(zip(some, zip(bins, offsets)))
        out, at = [], []
        for i, (ident, n) in enumerate(zip(pdf["id"], pdf["n"])):
            full = n // capacity
            for part in range(full):
                out.append((ident, part, part * capacity, capacity, used, 0))
                at.append(i)
                used += 1
            if i in placed:
                b, offset = placed[i]
                out.append((ident, full, full * capacity, n - full * capacity, b, offset))
                at.append(i)
            elif not n:
                out.append((ident, 0, 0, 0, None, None))
                at.append(i)
        if ordered:
            filled = [(r[4], r[3], i) for r, i in zip(out, at) if r[4] is not None]
            number = _along(*zip(*filled)) if filled else {}
            out = [(*r[:4], number.get(r[4]), r[5]) for r in out]
        out = [(*r[:4], None if r[4] is None else base + r[4], r[5]) for r in out]
        out = pd.DataFrame(out, columns=["id", "part", "start_word", "n_words", "bin", "bin_offset"])
        return out.astype({"bin": "Int64", "bin_offset": "Int64", **({"id": "Int64"} if id_type == "bigint" else {})})

    packed = rows.groupBy("block").applyInPandas(
        pack_block, f"id {id_type}, part int, start_word long, n_words long, bin long, bin_offset long")
    return packed.withColumnRenamed("id", id_col)
