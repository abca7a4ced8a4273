"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Every distinct vector has a home cell, that of the centroid with the highest
cosine.  A link may cross the border of two cells, so a vector also visits those
cells of a lower number in which a vector within the threshold's angle could be at
home; the bounds below prove that all others hold none, so no link is lost and each
pair meets in exactly one cell.  In a cell, blocks of a bounded number of rows are
multiplied; a block reports, for each of its vectors, how many links it has there
and the least vector it is connected with, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from prefmine.llm.common import Scratch, free_name
from prefmine.llm.simhash import components

# Shares of a vector's best cosine at which visited() cuts off the centroids it weighs.
CUTS = (0.5, 0.7)


def usable(v: Column) -> Column:
    """``v`` if it has a direction (not null, no null or non-finite component, not zero)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(F.forall(v, fine) & F.exists(v, lambda x: x != 0), v)


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as doubles of length one, filled up with zeros to ``width``.  They are
    scaled by their largest component first, so squares neither overflow nor vanish."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(lists.flatten(), dtype=np.float64)
    out /= np.abs(out).max(1, initial=0, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x`` (fewer, if there are fewer rows).  A cell
    left empty, or whose rows cancel out, keeps its centroid."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        np.add.at(sums, np.argmax(x @ centroids.T, axis=1), x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def visited(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, may): the home cell of each unit row, and where a row within the threshold
    of it may be at home.

    If y is at home in c, y.c >= y.j for every centroid j, so for any weights w >= 0 the
    direction d = sum w_j (j - c) has y.d <= 0.  With cosine(x, y) >= t, x lies within the
    same angle of the half-space, so x.d <= sqrt(1 - t^2) |d|; a cell that breaks this for
    some weights cannot hold y.  Tried are the home centroid alone and the centroids
    near x, weighted by their excess over a share of the best cosine.
    """
    if threshold <= 0:  # wider than a right angle: the bound below says nothing
        return np.argmax(x @ centroids.T, axis=1), np.ones((len(x), len(centroids)), bool)
    sine, gram, s = np.sqrt(max(0.0, 1 - threshold * threshold)), centroids @ centroids.T, x @ centroids.T
    home, best = np.argmax(s, axis=1), s.max(axis=1, keepdims=True)
    weights = [np.eye(len(centroids))[home]] + [np.maximum(0, s - cut * best) for cut in CUTS]
    may = np.ones(s.shape, bool)
    for w in weights:
        total, wg = w.sum(1, keepdims=True), w @ gram
        d2 = (w * wg).sum(1, keepdims=True) - 2 * total * wg + total * total * np.diag(gram)[None, :]
        may &= (w * s).sum(1, keepdims=True) - total * s <= sine * np.sqrt(np.maximum(d2, 0)) + 1e-6 * np.maximum(total, 1)
    return home, may


def _roots(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label of the connected component of each row and column of a matrix of links."""
    while True:
        low_left = np.minimum(left, np.where(links, right[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        low_right = np.minimum(right, np.where(links, low_left[:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (low_left == left).all() and (low_right == right).all():
            return left, right
        left, right = low_left, low_right


def block_links(x: np.ndarray, y: np.ndarray | None, names: tuple, copies: tuple, threshold: float, step: int = 2048) -> tuple:
    """(name, links, root) of the rows of ``x`` (and of ``y``) that have a link between them,
    or among the rows of ``x`` where ``y`` is None; links count a row's copies."""
    same = y is None
    if same:
        y, names, copies = x, (names[0], names[0]), (copies[0], copies[0])
    linked = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(y), step):
        linked[:, a : a + step] = x @ y[a : a + step].T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked = linked[np.ix_(rows, cols)]
    out = [names[0][rows]], [linked @ copies[1][cols]], []
    roots = _roots(linked, names[0][rows], names[1][cols])
    out[2].append(roots[0])
    if not same:
        out[0].append(names[1][cols]), out[1].append(copies[0][rows] @ linked), out[2].append(roots[1])
    return tuple(np.concatenate(c) for c in out)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                 cell_rows: int = 1024, max_cells: int = 1024, sample_per_cell: int = 32, block_rows: int = 1024,
                 guest_rows: int = 8192) -> DataFrame:
    """``vectors`` without ``vec_col``, and with n_links (other rows whose cosine with the
    row's vector, in double precision, is at least ``threshold``), component_id (the least
    id among the rows that links reach from it, itself included) and kept (id =
    component_id: one representative of each group).

    All rows take part whatever else they hold, and all links count.  Rows whose vector is
    null, zero, empty or holds a null or non-finite component link with nothing and are
    their own component.  Shorter vectors count as filled up with zeros.  Equal vectors are
    compared once; their rows link with each other.  Rows with a null id link like others, a
    component of such rows alone has component_id null, and rows with a null id are not
    kept; rows that share the least id of their component are all kept.  Input columns
    called n_links, component_id or kept are replaced.  An empty table gives no rows.

    The centroids are fitted on at most ``sample_per_cell`` * ``max_cells`` distinct vectors
    (the smallest seeded hashes); that sample decides only where work is done, never a
    result.  There is a cell for every ``cell_rows`` distinct vectors, ``max_cells`` at
    most (so centroids sent to tasks have a bounded size); fuller cells are more blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    spare = [c for c in vectors.columns if c not in (vec_col, "n_links", "component_id", "kept")]
    kept = [c for c in spare if c != id_col]
    # The other columns travel in a struct, so their names clash with nothing.
    wide = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                          (F.struct(*kept) if kept else F.lit(None)).alias("rest"), usable(F.col(vec_col)).alias("v"))
    if not isinstance(wide.schema["v"].dataType, ArrayType):
        raise TypeError(f"{vec_col} is not an array of numbers")
    rows = scratch.write(wide)
    nodes = scratch.write(rows.where("v IS NOT NULL").groupBy("v").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n:
        cells = min(max_cells, -(-n // cell_rows))
        drawn = nodes.orderBy(F.xxhash64(F.lit(0), "node"), "node").limit(sample_per_cell * cells).select("v").toArrow()
        centroids = spherical_k_means(unit_rows(drawn["v"], width), cells)
        found = _links(nodes, scratch, spark.sparkContext.broadcast(centroids), width, threshold, block_rows, guest_rows)
    else:
        found = spark.createDataFrame([], "node long, links long, root long")
    links = scratch.write(found.groupBy("node").agg(F.sum("links").alias("links")))
    edges = scratch.write(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    whole = (nodes.drop("v").join(links, "node", "left").join(components(edges, scratch).withColumnRenamed("node", "at"),
                                                              F.col("node") == F.col("at"), "left")
             .select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    whole = scratch.write(whole)
    lowest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    told = scratch.write(whole.join(lowest, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    # Back to the rows by the vector itself: equal vectors are one node.
    named = nodes.select("v", "node").join(told, "node").select("v", "n_links", "component_id", F.lit(True).alias("valid"))
    out = rows.join(named, "v", "left").select(
        F.col("id").alias(id_col), *[F.col("rest").getField(c).alias(c) for c in kept],
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _links(nodes: DataFrame, scratch: Scratch, centroids, width: int, threshold: float, block_rows: int,
           guest_rows: int) -> DataFrame:
    """(node, links, root): a row for each vector and block in which it has links."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                home, may = visited(unit_rows(part["v"], width), centroids.value, threshold)
                may &= np.arange(may.shape[1])[None, :] < home[:, None]
                ends = np.append(0, np.cumsum(may.sum(1))).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(may)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), visits],
                                                 names=["v", "node", "copies", "cell", "visits"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = scratch.write(nodes.select("v", "node", "copies").mapInArrow(
        assign, f"v {kind}, node long, copies long, cell int, visits array<int>"))
    # One row per cell (at most max_cells): how many blocks its rows and its guests take.
    inside = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("homes"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / guest_rows).cast("int").alias("rooms"))
    sizes = scratch.write(inside.join(guests, "cell", "left").select("cell", "homes", F.coalesce("rooms", F.lit(0)).alias("rooms")))
    each = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    deal = lambda m: F.pmod(F.xxhash64("node"), F.col(m)).cast("int")
    # A task is (cell, first, second): home blocks first <= second, or home block first and
    # guest block -1 - second.  Sides: 0 the first block, 1 the other one.
    home = placed.drop("visits").join(sizes, "cell").withColumn("block", deal("homes"))
    own = home.select("cell", "v", "node", "copies", "block", F.explode(each("homes")).alias("other")).select(
        "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "v", "node", "copies")
    host = home.where("rooms > 0").select("cell", F.col("block").alias("first"), F.explode(each("rooms")).alias("other"), "v", "node", "copies").select(
        "cell", "first", (-1 - F.col("other")).alias("second"), F.lit(0).alias("side"), "v", "node", "copies")
    guest = (placed.select("v", "node", "copies", F.explode("visits").alias("cell")).join(sizes, "cell")
             .withColumn("block", deal("rooms")).select("cell", F.explode(each("homes")).alias("first"),
                                                        (-1 - F.col("block")).alias("second"), F.lit(1).alias("side"), "v", "node", "copies"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        side, node, copies = (np.asarray(t[c].combine_chunks()) for c in ("side", "node", "copies"))
        x, a, b = unit_rows(t["v"], width), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = key[1].as_py() == key[2].as_py()
        got = block_links(x[a], None if within else x[b], (node[a], node[b]), (copies[a], copies[b]), threshold)
        return pa.table([pa.array(c.astype(np.int64)) for c in got], names=["node", "links", "root"])

    return scratch.write(own.unionByName(host).unionByName(guest).groupBy("cell", "first", "second").applyInArrow(
        compare, "node long, links long, root long"))
