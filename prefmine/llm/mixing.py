"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix is its target; when in training its words are used
follows its weight schedule over time.  The integral of the schedule is the
source's cumulative demand for words; inverting it turns a document's place in
its source (words before it, in a seeded hash order) into a training position in
[0, 1), and the mix is the documents range-sorted by position.  Everything is
DataFrame work; a source with a third of all rows, or rows that share one id, are
spread over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.common import WORD, Scratch, file_place, free_name, running_sums

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Relative weight over training time for each place in the cycle of weights, as
# (time, weight) knots joined by straight lines: broad sources fade out, small
# ones come in late.
SCHEDULES = (((0.0, 1.4), (0.6, 1.0), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.4, 1.0), (1.0, 1.4)))


def word_count(text: str) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size, place, weight, target) from rows (src, size).

    Sources in code point order, null last, take the weights in turn.  The targets
    share the sum of all sizes by weight; no target is above ``max_epochs`` times
    its source's size, and what is cut off is shared again by weight.  Filled like
    water: in the order of cap per weight, the first source that its share of the
    rest does not fill sets the level for itself and all later ones.  One row per
    source, so the windows here see sources, not documents.
    """
    by_name = Window.orderBy(F.col("src").isNull(), "src")
    s = (sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
         .withColumn("place", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                            (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = (s.withColumn("rest", rest).withColumn("free", free).withColumn("turn", F.row_number().over(fill))
         .withColumn("open", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("free")))
    level = F.min(F.when(F.col("open"), F.struct("turn", (F.col("rest").cast("double") / F.col("free")).alias("level")))).over(every)
    s = s.withColumn("level", level)
    target = F.when(F.col("open"), F.col("weight") * F.col("level.level")).otherwise(F.col("cap").cast("double"))
    return s.select("src", "source_size", "place", "weight", target.alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(end of demand, its start, start time, start weight, slope) of each straight
    piece, the demand being the schedule's integral scaled to 1 in all."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        end = done + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((end, done, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        done = end
    out[-1] = (float("inf"), *out[-1][1:])
    return out


def training_time(demand: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches the share ``demand``."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        inner = out
        for end, start, t0, w0, slope in reversed(_segments(knots)):
            r = F.greatest(demand - F.lit(start), F.lit(0.0))
            t = F.lit(t0) + 2 * r / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * F.lit(slope) * r, F.lit(0.0))))
            inner = t if end == float("inf") else F.when(demand < F.lit(end), t).otherwise(inner)
        out = F.when(place % len(schedules) == i, inner).otherwise(out)
    return out


def _rows(docs: DataFrame, keep: Sequence[str], id_col: str, text: str, source: str, seed: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(source).alias("src"),
                       word_count(text).alias("size"), order.alias("order"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))


def _placed(rows: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their source's target columns and ``before``: the words that come
    before them in their source."""
    t = targets.withColumnRenamed("src", "t_src")
    rows = rows.join(t, rows.src.eqNullSafe(t.t_src)).drop("t_src")
    return running_sums(rows, ["place"], ["order", "size", "tie", "row"], "size", "before", scratch).drop("row")


def _choose(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, filled, extra) per source for the last, broken epoch: the words of the
    documents that end before ``need``, and the ``before`` of the one document after
    them whose size comes nearest to what is then missing (null: none is nearer
    than nothing)."""
    inside = F.col("before") + F.col("size") <= F.col("need")
    # Written, so that the join below sees how small it is, or can split a hot source.
    filled = scratch.write(placed.groupBy("place").agg(
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("filled")))
    off = F.abs(F.col("size") - (F.col("need") - F.col("filled")))
    return (placed.where((F.col("size") > 0) & ~inside).join(filled, "place")
            .groupBy("place", "filled", "need").agg(F.min(F.struct(off.alias("off"), F.col("before").alias("extra"))).alias("best"))
            .select("place", "filled", F.when(F.col("best.off") < F.col("need") - F.col("filled"),
                                              F.col("best.extra")).alias("extra")))


def plan(docs: DataFrame, keep: Sequence[str], id_col: str = "doc_id", text: str = "text", source: str = "source",
         weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, seed: int = 0) -> DataFrame:
    """One row per document: ``kept`` (a struct of the ``keep`` columns), src, size,
    source_size, target, copies (how often the mix takes it), taken (copies * size)
    and ``positions`` (a training position in [0, 1) for every copy).

    Whole epochs first; in the last, broken epoch the documents that fit before the
    target, in the order of a seeded MD5 of the id, and one more whose size fits the
    remainder best.  So a source's taken words miss its target by less than half
    a document, and reruns agree.  Rows with the same id are ordered by size and
    text; wholly equal rows are exchangeable.  Null sources are a source; null or
    empty texts have size 0 and are taken with the words around them; a text of any length is one document.  An empty table
    gives no rows.  The kept columns are sorted and written with the sizes, so keep what
    names a row (as :func:`mix` does), not its text.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    compact = scratch.write(_rows(docs, keep, id_col, text, source, seed))
    targets = source_targets(compact.select("src", "size"), weights, max_epochs)
    whole = F.coalesce(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))),
                               F.lit(max_epochs)), F.lit(0))
    targets = targets.withColumn("whole", whole.cast("int"))
    targets = scratch.write(targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    placed = scratch.write(_placed(compact, targets, scratch))
    targets = scratch.write(targets.join(_choose(placed, scratch), "place", "left"))
    placed = placed.join(targets.select("place", "filled", "extra"), "place")
    extra = F.coalesce((F.col("before") == F.col("extra")) & (F.col("size") > 0), F.lit(False))
    last = (F.col("before") + F.col("size") <= F.col("need")) & (F.col("need") > 0)
    rows = placed.withColumn("copies", F.col("whole") + F.when(last | extra, 1).otherwise(0))
    at = F.when(extra, F.col("filled")).otherwise(F.col("before"))

    def position(copy: Column) -> Column:
        start = F.when(copy == F.col("whole"), at).otherwise(F.col("before")) + F.col("size") / 2
        demand = F.coalesce(F.try_divide(copy * F.col("source_size") + start, F.col("target")), F.lit(0.0))
        return F.least(training_time(demand, F.col("place"), schedules), F.lit(1.0 - 2.0**-53))

    positions = F.transform(F.sequence(F.lit(0), F.lit(max_epochs)), position)
    return rows.select("kept", "src", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"),
                       F.slice(positions, F.lit(1), F.col("copies")).alias("positions"),
                       F.coalesce(F.try_divide(F.col("before"), F.col("source_size")), F.lit(0.0)).alias("place_in_source"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: the columns of ``docs``, a row for every copy, range-sorted
    by training position (partition i holds positions before partition i + 1).
    Options are those of :func:`plan`.

    Positions are found on compact rows, which name a document by its file and the row in it
    (a table that was not read from files is written first), and joined back to the texts:
    these are shuffled for that join and for the order, and nowhere else."""
    if file_place(docs) is None:
        docs = Scratch(docs.sparkSession, "mix").write(docs)
    columns, (path, index) = docs.columns, file_place(docs)
    f, i = free_name(columns, "file_"), free_name(columns, "index_")
    named = docs.select("*", path.alias(f), index.alias(i))
    p = plan(named, keep=[f, i], **options)
    at = free_name(columns, "position_")
    copies = p.select(F.col(f"kept.{f}").alias(f), F.col(f"kept.{i}").alias(i), F.explode("positions").alias(at))
    return named.join(copies, [f, i]).repartitionByRange(at).sortWithinPartitions(at).select(*columns)


def written_order(mixed: DataFrame) -> list[Column]:
    """Columns that put a table written from :func:`mix` back into training order: the
    number of the partition that wrote the file, the file's number in it, and the row's
    place in the file.  None for a table that was not read from files, whose rows
    stand in training order as they are."""
    if file_place(mixed) is None:
        return []
    meta = mixed.metadataColumn("_metadata")
    name = meta["file_name"]
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"),
            name, meta["row_index"]]
