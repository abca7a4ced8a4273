"""Sharding by a k-d tree over document metadata.

The documents are split recursively at a weighted median (the weight is the
document's bytes) along the dimension of the metadata that is widest among the
documents of the node, until every leaf has the target bytes.  Documents with
like metadata land in the same shard and the shards' bytes are near equal.

Medians are found without sorting: every pass sums bytes over a few hundred bins
of each node's remaining interval, and the next pass looks into the bin that
holds the median.  Only those sums and the tree (one split for each inner node,
fewer than leaves) are on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.common import PREFIX_BUCKETS, Scratch, local_table, prefix_sums

# Bits of a coordinate and of the tie-break that orders equal coordinates.
BITS = 52
BIN_BITS = 9


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def coordinate(df: DataFrame, column: str) -> Column:
    """A column as a long in [0, 2^52): numbers keep their order (on a signed
    logarithmic scale, as lengths are), other values are hashed, so equal values
    meet.  Null, NaN: 0."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        x = F.least(F.greatest(c.cast("double"), F.lit(-1e300)), F.lit(1e300))
        log = F.signum(x) * F.log1p(F.abs(x))  # within +-691
        code = ((log + 700.0) * float((1 << BITS) / 1400)).cast("long")
        return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(0)).otherwise(code).cast("long")
    return F.when(c.isNull(), F.lit(0)).otherwise(
        F.shiftrightunsigned(F.xxhash64(c.cast("string")), 64 - BITS)).cast("long")


def _medians(points: DataFrame, nodes: dict[int, dict], tolerance: float) -> None:
    """Finds for every node the cut (value, tie): a point goes left when its
    (coordinate, tie) is below it.  A pass serves all nodes whose cut is open and
    brings one row for each of them to the driver."""
    spark = points.sparkSession
    for n in nodes.values():
        n |= {"by_tie": False, "value": 0, "low": n["min"], "bits": max(1, (n["max"] - n["min"]).bit_length()),
              "need": n["bytes"] * n["left_share"], "cut": None}
    while open_ := {k: n for k, n in nodes.items() if n["cut"] is None}:
        q = local_table(spark, [(k, n["dim"], n["by_tie"], n["value"], n["low"], n["bits"],
                                 max(0, n["bits"] - BIN_BITS), n["need"]) for k, n in open_.items()],
                        "node_ long, dim int, by_tie boolean, value long, low long, bits int, shift int, need double")
        v = F.element_at("coords_", F.col("dim") + 1)
        x = F.when(F.col("by_tie"), F.col("tie_")).otherwise(v) - F.col("low")
        bins = (points.join(q, "node_").where(~F.col("by_tie") | (v == F.col("value")))
                .withColumn("x_", x).where((F.col("x_") >= 0) & F.expr("shiftright(x_, bits) = 0"))
                .groupBy("node_", "need", F.expr("shiftright(x_, shift)").alias("bin"))
                .agg(F.sum("size_").alias("s")))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("node_").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        found = (bins.withColumn("before", before)
                 .where((F.col("before") < F.col("need")) & (F.col("before") + F.col("s") >= F.col("need"))))
        for r in found.select("node_", "bin", "before", "s").collect():
            n = nodes[r.node_]
            shift = max(0, n["bits"] - BIN_BITS)
            low = n["low"] + (r.bin << shift)
            off, cut = min((n["need"] - r.before, low), (r.before + r.s - n["need"], low + (1 << shift)))
            if off <= tolerance or (n["by_tie"] and shift == 0):
                n["cut"] = (n["value"], cut) if n["by_tie"] else (cut, 0)
            elif shift == 0:  # one value holds the median: its points are ordered by the tie-break
                n |= {"by_tie": True, "value": low, "low": 0, "bits": BITS, "need": n["need"] - r.before}
            else:
                n |= {"low": low, "bits": shift, "need": n["need"] - r.before}


def shard_documents(docs: DataFrame, dims: Sequence[str], id_col: str = "doc_id", text: str = "text",
                    target_bytes: int | None = None, n_shards: int | None = None,
                    keep: Sequence[str] | None = None, tolerance: float = 0.001) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: all) with ``size`` (bytes of the
    text plus 1), ``shard`` (0 to shards-1, leaves from left to right) and ``slot``
    (gapless from 0 in each shard); columns of these names are replaced.

    Give ``target_bytes`` (shards = total / target, rounded up) or ``n_shards``.
    A cut is within ``tolerance`` of a shard's bytes, or one document, of the
    weighted median.  Equal coordinates are ordered by a hash of id, text and
    metadata, and rows equal in all of these by their place in the table, so ties
    and repeated rows split evenly.  Null metadata has the smallest coordinate; a
    null or empty text has size 1, texts of any length are only measured.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("size", "shard", "slot")]
    coords = F.array(*[coordinate(docs, c) for c in dims])
    row_hash = F.xxhash64(id_col, text, *dims)
    compact = docs.select(size_of(text).alias("size_"), coords.alias("coords_"), row_hash.alias("row_"),
                          F.struct(*[F.col(c) for c in names]).alias("kept_"))
    # Wholly equal rows are told apart by their place in the written table, which
    # no longer changes once it is written.
    compact = scratch.write(compact.withColumn("copy_", F.monotonically_increasing_id()))
    tie = (F.shiftrightunsigned("row_", 64 - BITS + 12) * 4096
           + F.shiftrightunsigned(F.xxhash64("copy_"), 52))
    points = compact.withColumn("tie_", tie)
    total = points.agg(F.sum("size_").alias("s")).first().s or 0
    k = n_shards or max(1, -(-total // (target_bytes or total or 1)))

    # shards: number of leaves still to be made under the node, from `first` on
    spans, leaves = {1: (0, k)}, {}
    points = points.withColumn("node_", F.lit(1).cast("long"))
    lens = [f"{f}(coords_[{i}]) AS {f}{i}" for i in range(len(dims)) for f in ("min", "max")]
    width = None
    while True:
        leaves |= {n: first for n, (first, m) in spans.items() if m == 1}
        spans = {n: x for n, x in spans.items() if x[1] > 1}
        if not spans or not total:
            break
        stats = points.groupBy("node_").agg(F.sum("size_").alias("bytes"), *[F.expr(e) for e in lens]).collect()
        stats = [r for r in stats if r.node_ in spans]
        if width is None:
            width = [max(1, stats[0][f"max{i}"] - stats[0][f"min{i}"]) for i in range(len(dims))]
        nodes = {}
        for r in stats:
            first, m = spans[r.node_]
            dim = max(range(len(dims)), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / width[i], -i))
            nodes[r.node_] = {"dim": dim, "min": r[f"min{dim}"], "max": r[f"max{dim}"], "bytes": r.bytes,
                              "left_share": (m // 2) / m}
        _medians(points, nodes, tolerance * total / k)
        cuts = [(n, x["dim"], *x["cut"]) for n, x in nodes.items()]
        cuts = local_table(spark, cuts, "node_ long, dim int, cut long, cut_tie long")
        at = F.element_at("coords_", F.col("dim") + 1)
        right = (at > F.col("cut")) | ((at == F.col("cut")) & (F.col("tie_") >= F.col("cut_tie")))
        points = (points.join(cuts, "node_", "left")
                  .withColumn("node_", F.when(F.col("dim").isNull(), F.col("node_"))
                              .otherwise(F.col("node_") * 2 + right.cast("long")))
                  .drop("dim", "cut", "cut_tie"))
        spans = {c: s for n, (first, m) in spans.items()
                 for c, s in ((2 * n, (first, m // 2)), (2 * n + 1, (first + m // 2, m - m // 2)))}
    leaf = local_table(spark, list(leaves.items()) or [(1, 0)], "node_ long, shard int")
    # Slots follow a hash of the row's place, so repeated rows are spread like all others.
    points = points.join(leaf, "node_").select("kept_", "size_", "shard", F.xxhash64("copy_").alias("at_"), "copy_", F.lit(1).cast("long").alias("one_"))
    bucket = F.shiftrightunsigned(F.col("at_"), 64 - PREFIX_BUCKETS.bit_length() + 1).cast("int")
    # An order by the unsigned hash, whose first bits are the bucket.
    points = points.withColumn("at_", F.col("at_").bitwiseXOR(F.lit(-(1 << 63))))
    out = prefix_sums(points, ["shard"], ["at_", "copy_"], "one_", "slot", bucket)
    return out.select("kept_.*", F.col("size_").alias("size"), "shard", "slot")
