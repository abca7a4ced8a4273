"""URL filters: rules first, then a path-template tree for each host.

Variable path segments (numbers, hashes, dates, long mixed names) are generalised
into wildcards; on the way down the tree, sibling branches are merged where their
shares of bad labelled pages do not differ statistically: those like the pool of all
siblings into one wildcard branch, those worse (or better) than it with each other.
The remaining templates are rejected by their smoothed share of bad pages.
Everything is DataFrame work on counts, so a host with a third of all pages is
counted in parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)

def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))

def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))

def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.  ``rules`` are
    (verdict, host/path) pairs; one fits its host and all subdomains if the path
    starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict

def generalised(segment: Column) -> Column:
    """A variable segment as a wildcard of its kind; its file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    name = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    kind = (F.when(name.rlike(r"^\d{4}[-_]\d{2}([-_]\d{2})?$"), "{date}").when(name.rlike(r"^\d+$"), "{number}")
            .when(name.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}")
            .when(name.rlike(r"^(?=.*\d)[0-9a-fA-F]{8,}$"), "{hash}")
            .when(name.rlike(r"\d") & (F.length(name) >= 12), "{mixed}"))
    return F.when(kind.isNotNull(), F.concat(kind, ending)).otherwise(segment)

def segments_of(path: Column) -> Column:
    """Generalised segments, however many; a closing slash becomes an empty last segment."""
    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/", -1), generalised)

def branches(child: DataFrame, z: float) -> DataFrame:
    """(host, node, child, branch) for the children (host, node, child, cn, cb: labelled and bad
    pages) that stay out of their node's wildcard branch.

    A child deviates if its bad pages differ from what the pooled share of all siblings lets expect by
    more than ``z`` standard deviations (half a page of continuity taken off, so one or two labels
    rarely set a branch apart).  The deviating ones of a side, in the order of their bad share, are merged
    with the next one unless the two shares differ by more than ``z`` standard errors.
    Children of equal counts are one row of that window, so it is short however many
    children a node has.  A branch of one child keeps its name.
    """
    parent = child.groupBy("host", "node").agg(F.sum("cn").alias("pn"), F.sum("cb").alias("pb"))
    p = F.col("pb") / F.col("pn")
    over = F.col("cb") - F.col("cn") * p
    apart = child.join(parent, ["host", "node"]).where(
        (F.col("cn") > 0) & (F.col("pb") > 0) & (F.col("pb") < F.col("pn"))).where(
        F.abs(over) - 0.5 > z * F.sqrt(F.col("cn") * p * (1 - p))).select(
        "host", "node", "child", "cn", "cb", F.when(over > 0, "+").otherwise("-").alias("side"))
    classes = apart.groupBy("host", "node", "side", "cn", "cb").agg(F.count(F.lit(1)).alias("kids"), F.min("child").alias("name"))
    order = Window.partitionBy("host", "node", "side").orderBy("share", "cn")
    classes = (classes.withColumn("share", F.col("cb") / F.col("cn"))
               .withColumn("n0", F.lag("cn").over(order)).withColumn("b0", F.lag("cb").over(order)))
    both = (F.col("cb") + F.col("b0")) / (F.col("cn") + F.col("n0"))
    error = F.sqrt(both * (1 - both) * (1 / F.col("cn") + 1 / F.col("n0")))
    new = F.when(F.col("share") - F.col("b0") / F.col("n0") > z * error, 1).otherwise(0)
    run = Window.partitionBy("host", "node", "side", "run")
    runs = (classes.withColumn("new", new).withColumn("run", F.sum("new").over(order))
            .withColumn("all_kids", F.sum("kids").over(run)).withColumn("only", F.min("name").over(run)))
    label = F.when(F.col("all_kids") == 1, F.replace("only", F.lit("*"), F.lit("%2A"))).otherwise(F.concat(F.lit("*"), "side", (F.col("run") + 1).cast("string")))
    return apart.join(runs.select("host", "node", "side", "cn", "cb", label.alias("branch")), ["host", "node", "side", "cn", "cb"]).select(
        "host", "node", "child", "branch")

def template_purity(pages: DataFrame, scratch: Scratch, z: float, smoothing: float) -> DataFrame:
    """(host, raw, template, bad_share) for every distinct (host, ``raw``: generalised
    path) of ``pages`` (host, segments, bad: boolean, null if unlabelled).

    The tree is walked level by level to its deepest path; paths that have ended, and nodes with
    one path left, drop out (a lone path's further segments are wildcards).  Siblings are
    merged as :func:`branches` says, all others become the branch ``*``.  The bad share of a
    template is smoothed towards its host's, and the host's towards that of all pages, with the
    weight of ``smoothing`` labelled pages.
    """
    counts = scratch.write(pages.groupBy("host", "segments").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("b")))
    tree, done, level = counts.withColumn("node", F.lit("")), [], 0
    while True:
        left = F.greatest(F.size("segments") - level, F.lit(0))
        alone = tree.groupBy("host", "node").agg(F.count(F.lit(1)).alias("paths"))
        marked = scratch.write(tree.join(alone, ["host", "node"]).withColumn("over", (left == 0) | (F.col("paths") == 1)).drop("paths"))
        done.append(marked.where("over").select("host", "segments", "n", "b", F.concat("node", F.repeat(F.lit("/*"), left)).alias("node")))
        tree = marked.where("NOT over").drop("over").withColumn("child", F.get("segments", F.lit(level)))
        if tree.isEmpty():
            break
        child = scratch.write(tree.groupBy("host", "node", "child").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb")))
        apart = scratch.write(branches(child, z))
        tree = scratch.write(tree.join(apart, ["host", "node", "child"], "left").select(
            "host", "segments", "n", "b", F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*"))).alias("node")))
        level += 1
    tree = done[0]
    for d in done[1:]:
        tree = tree.unionByName(d)
    tree = scratch.write(tree)
    every = tree.agg(F.sum("b"), F.sum("n")).first()
    prior = (every[0] or 0) / every[1] if every[1] else 0.0
    smooth = lambda b, n, to: (F.col(b) + F.lit(smoothing) * to) / (F.col(n) + F.lit(smoothing))
    hosts = scratch.write(tree.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
                          .select("host", smooth("hb", "hn", F.lit(prior)).alias("host_share")))
    leaves = scratch.write(tree.groupBy("host", "node").agg(F.sum("b").alias("tb"), F.sum("n").alias("tn")))
    leaves = scratch.write(leaves.join(hosts, "host").select(
        "host", "node", smooth("tb", "tn", F.col("host_share")).alias("bad_share")))
    return scratch.write(tree.join(leaves, ["host", "node"]).select(
        "host", F.array_join("segments", "/").alias("raw"), F.col("node").alias("template"), "bad_share"))

def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", bad: str = "bad",
                z: float = 2.58, smoothing: float = 8.0, reject: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and bad_share (columns of these
    names are replaced).  ``bad`` is a boolean column, null for unlabelled pages.

    The verdict is that of the longest rule that fits; else ``block`` if the template's
    smoothed bad share is at least ``reject``, else ``allow``.  A null url, or one
    without ``://``, has empty host and path and is judged with its likes.  Unlabelled
    hosts have the share of all pages.  Repeated rows are judged alike; paths may be of any length
    and depth (a level of the deepest shared path is a pass over the paths still open); an empty table
    gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    made = ("host", "path", "rule", "verdict", "template", "bad_share")
    kept = [c for c in pages.columns if c.lower() not in made]
    u = F.col(url)
    h, p, raw, template, share = (free_name(pages.columns, n) for n in ("h_", "p_", "raw_", "t_", "s_"))
    tagged = pages.withColumn(h, host_of(u)).withColumn(p, path_of(u))
    split = scratch.write(tagged.select(F.col(h).alias("host"), segments_of(F.col(p)).alias("segments"),
                                        F.col(bad).alias("bad")))
    judged = template_purity(split, scratch, z, smoothing)
    judged = judged.select(F.col("host").alias(h), F.col("raw").alias(raw), F.col("template").alias(template),
                           F.col("bad_share").alias(share))
    rule, verdict = rule_of(F.col(h), F.col(p), rules)
    out = tagged.withColumn(raw, F.array_join(segments_of(F.col(p)), "/")).join(judged, [h, raw])
    own = F.when(F.col(share) >= reject, "block").otherwise("allow")
    return out.select(*[F.col(c) for c in kept], F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"),
                      F.coalesce(verdict, own).alias("verdict"), F.col(template).alias("template"),
                      F.col(share).alias("bad_share"))
