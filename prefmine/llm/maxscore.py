"""Exact top-k inner products by MaxScore.

The terms of a query are its components; the posting list of a term holds the
vectors whose component has the same sign, so that only they can gain from it.  A
term's bound is the largest gain in a block of vectors.  Terms in falling order of
bound are essential until the bounds of the rest no longer reach the score that a
result needs: only vectors in essential postings are candidates; the other terms
are probed one after another while a candidate can still compete.  Vectors are cut
into shards, whose results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch

# Components of this size (after scaling) do not fit a long.
TOO_LARGE = float(1 << 63)
NO_ID = (1 << 63) - 1


def integer_vector(v: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null for a vector that is null,
    or holds a null or non-finite component.  A finite component that fits no long fails the job."""
    d = F.transform(v, lambda x: x.cast("double"))
    ok = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    floor = lambda x: F.when(F.abs(x * F.lit(scale)) < F.lit(TOO_LARGE), F.floor(x * F.lit(scale)).cast("long")).otherwise(
        F.raise_error(F.lit("a component times the scale does not fit a long")).cast("long"))
    return F.when(ok, F.transform(d, floor))


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


class Block:
    """Vectors with the posting lists of each signed component and their bounds."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = x, ids, rows
        self.high, self.low = np.maximum(x.max(0, initial=0), 0), np.maximum(-x.min(0, initial=0), 0)
        self.gain = [np.flatnonzero(x[:, d] > 0) for d in range(x.shape[1])]
        self.loss = [np.flatnonzero(x[:, d] < 0) for d in range(x.shape[1])]

    def scores(self, q: np.ndarray, need: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of every vector that can have a score of ``need`` or more."""
        if need is None:  # too few results yet: every vector competes
            return np.arange(len(self.x)), self.x @ q
        bound = np.where(q > 0, q * self.high, -q * self.low)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[i]: bounds of order[i:]
        essential = int(np.argmax(rest < need)) if (rest < need).any() else len(order)
        if essential == 0:  # no vector of the block can reach the needed score
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if rest[-1] >= need:  # zero is enough: also vectors in no posting compete
            at = np.arange(len(self.x))
        else:
            hit = np.zeros(len(self.x), bool)
            for d in order[:essential]:
                hit[self.gain[d] if q[d] > 0 else self.loss[d]] = True
                if hit.all():
                    break
            at = np.flatnonzero(hit)
        dims = order[:essential]
        score = self.x[np.ix_(at, dims)] @ q[dims]
        for i in range(essential, len(order), 4):
            keep = score + rest[i] >= need
            at, score = at[keep], score[keep]
            if not len(at):
                break
            dims = order[i : i + 4]
            score = score + self.x[np.ix_(at, dims)] @ q[dims]
        keep = score >= need
        return at[keep], score[keep]


def shard_top(blocks: list[Block], q: np.ndarray, own_row: int, k: int) -> list[tuple[int, int, int]]:
    """The k best (score, id, row) of a shard, ties to the smaller id, then row."""
    best: list[tuple[int, int, int]] = []
    for b in blocks:
        at, score = b.scores(q, best[k - 1][0] if len(best) >= k else None)
        if len(at) > 4 * k:  # all that ties with the block's own k-th best or is above it, the query's row aside
            floor = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            at, score = at[score >= floor], score[score >= floor]
            top = np.lexsort((b.rows[at], b.ids[at], -score))[: k + 1]
            at, score = at[top], score[top]
        best += [(int(s), int(b.ids[i]), int(b.rows[i])) for i, s in zip(at, score) if b.rows[i] != own_row]
        best = sorted(best, key=lambda t: (-t[0], t[1], t[2]))[:k]
    return best


def wide_rows(m: np.ndarray) -> np.ndarray:
    """Rows with a component so large that a sum of products could leave the range of a long."""
    limit = math.isqrt(((1 << 63) - 1) // max(1, m.shape[1]))
    return ((m > limit) | (m < -limit)).any(1)


def wide_top(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own_row: int, k: int) -> list[tuple[int, int, int]]:
    """As :func:`shard_top`, in whole numbers of any size, vector by vector."""
    query = [int(c) for c in q]
    found = [(sum(int(a) * b for a, b in zip(v, query)), int(i), int(r)) for v, i, r in zip(x, ids, rows) if r != own_row]
    return sorted(found, key=lambda t: (-t[0], t[1], t[2]))[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0, shard_rows: int = 8192, block_rows: int = 2048, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``is_query`` the ``k``
    highest integer inner products with all other rows, ties to the smaller id.

    All rows are compared; only a row itself is left out, so repeated rows find each
    other.  Vectors that :func:`integer_vector` finds null take no part, shorter
    vectors count as filled up with zeros; rows with a null id are found (after the
    others at a tie, with vec_id null).  Vectors so large that a sum might leave the range of a
    long are scored in whole numbers of any size; a score among the results that fits no long
    fails the job.  Columns other than ``id_col`` and ``vec_col``, whatever their names, take no part.  Shards and query blocks hold a bounded
    number of rows, dealt by a hash of the row's place in a written table, and every
    pair of a shard and a query block is one task; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "maxscore")
    rows = scratch.write(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        integer_vector(F.col(vec_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where("v IS NOT NULL"))
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-asking // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    docs = rows.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
                       every(parts).alias("part"))
    asks = rows.where("asks").select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")
                                     .alias("part"), every(shards).alias("shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(right["v"]), _matrix(left["v"])
            width = max(q.shape[1], x.shape[1])
            q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
            ids, places = (np.asarray(left[c].combine_chunks()) for c in ("id", "row"))
            wide, ask_wide = wide_rows(x), wide_rows(q)
            first = np.flatnonzero(~wide)
            first = first[np.argsort(-np.abs(x[first]).sum(1), kind="stable")]  # large vectors raise the needed score early
            blocks = [Block(x[i], ids[i], places[i]) for i in np.array_split(first, max(1, -(-len(first) // block_rows))) if len(i)]
            for vector, large, ident, own in zip(q, ask_wide, right["id"].to_pylist(), right["row"].to_pylist()):
                best = wide_top(x, ids, places, vector, own, k) if large else shard_top(blocks, vector, own, k)
                if wide.any() and not large:
                    best = sorted([*best, *wide_top(x[wide], ids[wide], places[wide], vector, own, k)], key=lambda t: (-t[0], t[1], t[2]))[:k]
                out += [(own, ident, *t) for t in best]
        names = ("query_row", "query_id", "score", "vec_id", "row")
        return pa.table({c: pa.array([t[i] for t in out], pa.int64()) for i, c in enumerate(names)})

    found = docs.groupBy("shard", "part").cogroup(asks.groupBy("shard", "part")).applyInArrow(
        search, "query_row long, query_id long, score long, vec_id long, row long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
