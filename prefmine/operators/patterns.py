"""Frequent patterns and association-rule suggestions.

pairs -> baskets -> FP-Growth (Spark ML) -> rules -> rule firing -> metrics.

Rules fire by containment, not in a loop over antecedents: for rules B -> c the
suggestions for a user U are {c : B subset of U, c not in U}, the same set the
one-antecedent-at-a-time procedure (union over antecedents A subset of U of the
consequents of rules B subset of A) yields, since A = B is among the choices.
Rules never pass through the driver.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefmine.functions.columns import safe_ratio
from prefmine.operators.skew import salted_join, salts_of

# Rows of one item (or of users who meet one antecedent) that one join task may hold; users
# with more rows are hot.
RULE_CHUNK = 1 << 18

# Suggestions, repeated ones too, that one task forms, about; and rows of a rule table that goes to every task.
FIRED_ROWS, EVERYWHERE_ROWS = 1 << 21, 1 << 16


def distinct_pairs(review: DataFrame, business: DataFrame, city: str | None = None,
                   open_only: bool = True, accent_insensitive: bool = False) -> DataFrame:
    """Distinct ``(item_id, user_id)`` of reviews whose business is in ``city``
    (equality) and open.

    review   (item_id, user_id)
    business (item_id, city, is_open)
    ``accent_insensitive`` compares under the UNICODE_CI_AI collation
    (so 'Montreal' matches 'Montréal'), like a database with such a collation.
    """
    b = business
    if city is not None:
        c = F.col("city")
        if accent_insensitive:
            b = b.where(F.collate(c, "UNICODE_CI_AI") == F.collate(F.lit(city), "UNICODE_CI_AI"))
        else:
            b = b.where(c == F.lit(city))
    if open_only:
        b = b.where(F.col("is_open") == 1)
    return (review.join(b.select("item_id"), "item_id")
            .select("item_id", "user_id").distinct())


def baskets(pairs: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """``(user_id, items)``: the set of items per user (a transaction).

    ``collect_set`` is combined map-side; a basket holds at most one copy of
    each distinct item, so its size is bounded by the item vocabulary.
    """
    return (pairs.groupBy(F.col(user).alias("user_id"))
            .agg(F.array_sort(F.collect_set(item)).alias("items")))


def basket_stats(pairs: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """One row: pairs, users, items, largest and mean basket size."""
    per_user = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    nul = F.lit(None).cast("bigint")
    by_user = per_user.agg(F.count(F.lit(1)).alias("n_users"), F.max("_n").alias("max_basket"),
                           F.sum("_n").alias("n_pairs"), nul.alias("n_items"))
    items = pairs.agg(nul.alias("n_users"), nul.alias("max_basket"), nul.alias("n_pairs"),
                      F.count_distinct(item).alias("n_items"))
    # Two one-row aggregates stacked and merged: no join needed.
    one = by_user.unionByName(items).agg(*[F.max(c).alias(c) for c in
                                           ("n_pairs", "n_users", "n_items", "max_basket")])
    return one.select("n_pairs", "n_users", "n_items", "max_basket",
                      safe_ratio("n_pairs", "n_users").alias("mean_basket"))


def fit_fpgrowth(basket_df: DataFrame, min_support: float, min_confidence: float,
                 num_partitions: int | None = None) -> FPGrowthModel:
    """Spark ML FP-Growth; an itemset is frequent with at least
    ``ceil(min_support * n_baskets)`` baskets."""
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    # The conditional-transaction shuffle follows the cluster's parallelism
    # rather than however many partitions the basket aggregate ended with.
    n = num_partitions or basket_df.sparkSession.sparkContext.defaultParallelism
    fp = fp.setNumPartitions(n)
    return fp.fit(basket_df.select("items"))


def mine(basket_df: DataFrame, min_support: float, min_confidence: float,
         num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(itemsets, rules)`` mined once and written to the shared checkpoint
    folder.

    ``FPGrowthModel.freqItemsets`` / ``associationRules`` are not cached by
    Spark: every action on them re-runs the FP-tree mining.  Writing both
    tables once makes later rule firing, counting and evaluation read files.
    """
    from prefmine.session import materialize
    # The fit caches its input only while fitting, and the itemsets are mined
    # lazily afterwards; rule generation then reads ``freqItemsets``.  Keep
    # the baskets and the itemsets cached until both tables are written, so
    # the baskets are built once and the FP-tree mining runs once.
    baskets_in = basket_df.select("items").persist()
    try:
        m = fit_fpgrowth(baskets_in, min_support, min_confidence, num_partitions)
        fi = m.freqItemsets.persist()
        try:
            itemsets = materialize(fi, "itemsets")
            rules = materialize(m.associationRules, "rules")
        finally:
            fi.unpersist()
    finally:
        baskets_in.unpersist()
    return itemsets, rules


def itemset_key(col) -> "F.Column":
    """Order-free text form of an item array: sorted items joined by ','."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.array_sort(c), ",")


def distinct_antecedents(rules: DataFrame) -> DataFrame:
    """``(antecedent_key, antecedent, ante_size, n_rules)`` per distinct antecedent."""
    return (rules.groupBy(itemset_key("antecedent").alias("antecedent_key"))
            .agg(F.first(F.array_sort("antecedent")).alias("antecedent"),
                 F.count(F.lit(1)).alias("n_rules"))
            .select("antecedent_key", "antecedent", F.size("antecedent").alias("ante_size"),
                    "n_rules"))


def rules_by_item(rules: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(antecedents, consequents)``, long rows: ``(item, rule, others)`` for each distinct
    antecedent under its rarest item, the one with the smallest ``n`` of ``counts`` (item, n), and
    ``(item, rule, alone, consequent, level)`` for each of its rules.

    A user can only fire an antecedent if they have its rarest item, so a frequent
    item fans out to few antecedents.  ``rule`` is the antecedent's number, unique and not dense;
    ``others`` are its other items, as few as the longest itemset has; ``alone`` says that there are none.
    ``level`` is that of ``rules``, 1 if they have none.
    What grows with the rules (the antecedents of an item, the consequents of an antecedent) is
    rows, never an array.  Both are written: real file sizes.
    """
    from prefmine.session import materialize
    one = F.count(F.lit(1))
    key = itemset_key("antecedent").alias("key")
    ante = rules.groupBy(key).agg(F.first(F.array_sort("antecedent")).alias("antecedent"))
    each = ante.select("key", F.explode("antecedent").alias("item"))
    rarest = (each.join(counts, "item", "left").groupBy("key")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("r")))
    placed = ante.join(rarest, "key").select(
        F.col("r.item").alias("item"), F.monotonically_increasing_id().alias("rule"),
        F.array_remove("antecedent", F.col("r.item")).alias("others"), "key")
    # The numbers stand once the table is written.
    placed = materialize(placed, "rules-by-item", longer=F.count_if(F.size("others") > 0), others=F.sum(F.size("others")), rows=one)
    level = F.col("level") if "level" in rules.columns else F.lit(1)
    then = (rules.select(key, F.explode("consequent").alias("consequent"), level.cast("int").alias("level"))
            .groupBy("key", "consequent").agg(F.max("level").alias("level")).join(placed, "key")
            .select("item", "rule", (F.size("others") == 0).alias("alone"), "consequent", "level"))
    return placed, materialize(then, "consequents", rows=one)


def _flags(marked: DataFrame, rules: DataFrame, chunk: int = RULE_CHUNK) -> DataFrame:
    """``(user_id, item, own, test, rec)`` per (user, item): in the user's train rows,
    in their test rows, the highest level of a rule that their train rows fire and whose
    consequent it is (0: none; 1 where rules have no levels).

    A rule table of at most ``EVERYWHERE_ROWS`` rows goes to the users' rows, which are dealt by user
    once (:func:`_fire_in_place`).  Users with more than ``chunk`` rows, if there are
    any, and larger rule tables take joins that spread every key (:func:`_fire_spread`).
    """
    from prefmine.session import materialize
    is_train = F.count_if(~F.col("is_test"))
    counts = materialize(marked.groupBy("item").agg(is_train.alias("n"), F.count(F.lit(1)).alias("_rows")), "item-counts",
                         largest=F.max("n"), items=F.count(F.lit(1)), rows=F.sum("_rows"))
    ante, then = rules_by_item(rules, counts)
    if max(then.metrics["rows"], ante.metrics["rows"] + (ante.metrics["others"] or 0)) > EVERYWHERE_ROWS:
        return _fire_spread(marked, counts, ante, then, chunk)
    if 2 * counts.metrics["items"] <= chunk:  # an item is at most once in a user's train rows and once in the test rows
        return _fire_in_place(marked, counts, ante, then)
    hot = materialize(marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("user_id"),
                      "hot-users", n=F.count(F.lit(1)))
    if not hot.metrics["n"]:
        return _fire_in_place(marked, counts, ante, then)
    same = marked["user_id"].eqNullSafe(hot["user_id"])
    return (_fire_in_place(marked.join(hot, same, "left_anti"), counts, ante, then)
            .unionByName(_fire_spread(marked.join(hot, same, "left_semi"), counts, ante, then, chunk)))


def _fire_in_place(marked: DataFrame, counts: DataFrame, ante: DataFrame, then: DataFrame) -> DataFrame:
    """:func:`_flags` with the rows dealt by user, a task for every ``FIRED_ROWS`` suggestions or so.

    A row stands for itself and, in the train rows, for the consequents of its item: a
    user's suggestions are formed and merged where their rows are, and no suggestion is shuffled.
    Longer antecedents are looked for first, in the same way: a train row asks for the other items of the
    antecedents under its item, and what is met, few rows (user, rule), is dealt with the others.
    """
    from prefmine.session import materialize
    one = F.count(F.lit(1))
    rows = marked.select("user_id", "item", "is_test", F.lit(None).cast("bigint").alias("rule"))
    fired = _sum_over(counts, then.where("alone"), "item", F.col("n")) + (counts.metrics["rows"] or 0)
    if ante.metrics["longer"]:
        asked = ante.where(F.size("others") > 0).select("item", "rule", F.size("others").alias("want"), F.explode("others").alias("other"))
        train = rows.where("NOT is_test").drop("rule")
        dealt = _deal(train, _sum_over(counts, asked, "item", F.col("n")) + (counts.metrics["rows"] or 0))
        met = (_with_own(dealt, asked, ["item"])
               .select("user_id", F.when(F.col("fires"), F.col("other")).otherwise(F.col("item")).alias("item"), "rule", "want", "fires")
               .withColumn("held", F.max(~F.col("fires")).over(Window.partitionBy("user_id", "item"))).where("fires AND held")
               .groupBy("user_id", "rule", "want").agg(one.alias("n")).where("n = want"))
        met = materialize(met.select("user_id", "rule"), "met-rules")
        rows = rows.unionByName(met.select("user_id", F.lit(None).cast(marked.schema["item"].dataType).alias("item"),
                                           F.lit(False).alias("is_test"), "rule"))
        fired += _sum_over(met, then.where("NOT alone"), "rule", F.lit(1))
    table = then.where("NOT alone OR item IS NOT NULL").select(
        F.expr("IF(alone, item, NULL)").alias("item"), F.expr("IF(alone, NULL, rule)").alias("rule"), "consequent", "level")
    fires = F.col("fires")
    own = ~fires & F.col("rule").isNull()
    return _merge(_with_own(_deal(rows, fired), table, ["item", "rule"]).where(fires | own).select(
        "user_id", F.when(fires, F.col("consequent")).otherwise(F.col("item")).alias("item"),
        (own & ~F.col("is_test")).cast("int").alias("own"), (own & F.col("is_test")).cast("int").alias("test"),
        F.when(fires, F.col("level")).otherwise(F.lit(0)).alias("rec")))


def _sum_over(rows: DataFrame, table: DataFrame, key: str, times) -> int:
    """How many rows a join of ``rows``, each standing for ``times`` rows, with ``table`` gives."""
    fan = table.groupBy(key).agg(F.count(F.lit(1)).alias("fan"))
    return rows.join(F.broadcast(fan), key).agg(F.sum(times * F.col("fan"))).first()[0] or 0


def _deal(rows: DataFrame, fired: int) -> DataFrame:
    n = max(rows.sparkSession.sparkContext.defaultParallelism, fired // FIRED_ROWS + 1)
    return rows.repartition(n, "user_id")


def _with_own(dealt: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``dealt`` once as it is (``fires`` false) and, unless it is a test row, once for
    each row of the small ``table`` with the same ``keys`` (``fires`` true)."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in keys]
    own = table.select(*keys).distinct().select("*", *blank, F.lit(False).alias("fires"))
    small = own.unionByName(table.withColumn("fires", F.lit(True))).withColumnsRenamed({k: f"_{k}" for k in keys})
    meets = ~F.col("fires") | ~F.col("is_test")
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = dealt.join(F.broadcast(small), meets, "left")
    return met.withColumn("fires", F.coalesce("fires", F.lit(False))).drop(*[f"_{k}" for k in keys])


def _fire_spread(marked: DataFrame, counts: DataFrame, ante: DataFrame, then: DataFrame, chunk: int) -> DataFrame:
    """:func:`_flags` by joins that spread every key.

    The train rows meet the antecedents under their item; the rows of an item that more than
    ``chunk`` users have are salted, so a hot item is spread over tasks whatever adaptive
    execution does.  One-item antecedents bring their consequents at once.  Longer
    antecedents, if there are any, are tried only for users who have their rarest item: a
    request for every other item is joined with the train rows by (user, item), and antecedents with
    all requests met meet their consequents, hot antecedents salted too.  Requests are keyed by (user,
    item) or (user, rule), so a user with a huge basket is spread over many tasks.
    """
    from prefmine.session import materialize
    train = marked.where(~F.col("is_test")).select("user_id", "item")
    hot = salts_of(counts.select("item", "n"), "n", chunk) if (counts.metrics["largest"] or 0) > chunk else None

    def meet(by_item: DataFrame) -> DataFrame:
        return train.join(by_item, "item") if hot is None else salted_join(train, by_item, "item", chunk, hot)

    one, zero = F.lit(1), F.lit(0)
    is_test = F.col("is_test").cast("int")
    flags = marked.select("user_id", "item", (1 - is_test).alias("own"), is_test.alias("test"), zero.alias("rec"))
    fired = meet(then.where("alone").select("item", "consequent", "level")).select("user_id", "consequent", "level")
    if ante.metrics["longer"]:
        asked = (meet(ante.where(F.size("others") > 0).select("item", "rule", "others"))
                 .select("user_id", "rule", F.size("others").alias("want"), F.explode("others").alias("item")))
        met = materialize(asked.join(train, ["user_id", "item"]).groupBy("user_id", "rule", "want")
                          .agg(F.count(one).alias("n")).where("n = want").select("user_id", "rule"), "met-rules")
        late = salted_join(met, then.where("NOT alone").select("rule", "consequent", "level"), "rule", chunk)
        fired = fired.unionByName(late.select("user_id", "consequent", "level"))
    rec = fired.select("user_id", F.col("consequent").alias("item"), zero.alias("own"), zero.alias("test"), F.col("level").alias("rec"))
    return _merge(flags.unionByName(rec))


def _merge(flags: DataFrame) -> DataFrame:
    return flags.groupBy("user_id", "item").agg(*[F.max(c).alias(c) for c in ("own", "test", "rec")])


def _user_items(pairs: DataFrame, user: str, item: str, assume_distinct: bool = False) -> DataFrame:
    """``(user_id, item)`` rows, de-duplicated unless the caller guarantees
    distinct pairs (a repeated pair would meet a request twice)."""
    p = pairs.select(F.col(user).alias("user_id"), F.col(item).alias("item"))
    return p if assume_distinct else p.distinct()


def fire_rules(pairs: DataFrame, rules: DataFrame, user: str = "user_id",
               item: str = "item", assume_distinct: bool = False) -> DataFrame:
    """Suggestions ``(user_id, item)``: consequents of every rule whose antecedent
    is contained in the user's items, minus items the user has.  Users whose basket
    fires nothing get no rows."""
    p = _user_items(pairs, user, item, assume_distinct).withColumn("is_test", F.lit(False))
    return _flags(p, rules).where("rec > 0 AND own = 0").select("user_id", "item")


def score_rules(train_pairs: DataFrame, rules: DataFrame, test_pairs: DataFrame,
                user: str = "user_id", item: str = "item",
                all_test_users: bool = False, assume_distinct: bool = False) -> DataFrame:
    """``tp_fp_fn(fire_rules(train_pairs, rules), test_pairs)`` in one go."""
    marked = (_user_items(train_pairs, user, item, assume_distinct).withColumn("is_test", F.lit(False))
              .unionByName(_user_items(test_pairs, user, item, assume_distinct).withColumn("is_test", F.lit(True))))
    return score_marked(marked, rules, all_test_users)


def score_marked(marked: DataFrame, rules: DataFrame, all_test_users: bool = False) -> DataFrame:
    """Per user ``(user_id, tp, fp, fn)`` from one table (user_id, item, is_test) of
    distinct pairs, train and test together (``splits.mark_exact_split`` writes it)."""
    flags = _flags(marked.select("user_id", "item", "is_test"), rules)
    return _per_user(flags.select("user_id", ((F.col("rec") > 0) & (F.col("own") == 0)).cast("int").alias("_p"), F.col("test").alias("_t")),
                     all_test_users)


def fired(marked: DataFrame, rules: DataFrame) -> DataFrame:
    """``(user_id, item, level, is_test)`` per (user, item) suggested or in the test rows: ``level``
    is the highest of the rules that suggest it, 0 if none does or the user has the item."""
    f = _flags(marked.select("user_id", "item", "is_test"), rules)
    return (f.select("user_id", "item", F.when(F.col("own") == 0, F.col("rec")).otherwise(0).alias("level"), (F.col("test") == 1).alias("is_test"))
            .where("level > 0 OR is_test"))


def precision_recall_levels(suggested: DataFrame, levels: int) -> DataFrame:
    """``(level, *)`` with the columns of :func:`precision_recall` for each level from 1 to ``levels``,
    where the rules of that level and above suggest; ``suggested`` from :func:`fired`."""
    test = F.col("is_test")
    per, totals = [], []
    for k in range(1, levels + 1):
        p = F.col("level") >= k
        per += [F.count_if(p & test).alias(f"tp{k}"), F.count_if(p & ~test).alias(f"fp{k}"), F.count_if(~p & test).alias(f"fn{k}"),
                F.max(p).alias(f"has{k}")]
        sums = [F.coalesce(F.sum(F.when(F.col(f"has{k}"), F.col(f"{c}{k}"))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
        totals.append(F.struct(F.lit(k).alias("level"), F.count_if(f"has{k}").alias("n_matched"), *sums))
    users = suggested.groupBy("user_id").agg(*per, F.max(test).alias("tested")).where("tested")
    t = users.agg(F.array(*totals).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    return t.select("*", safe_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))


def tp_fp_fn(predicted: DataFrame, actual: DataFrame, user: str = "user_id",
             item: str = "item", all_test_users: bool = False) -> DataFrame:
    """Per user ``(user_id, tp, fp, fn)`` for users with both a prediction and
    a test basket (``all_test_users=True``: every test user; users without a
    prediction then count their whole test basket as FN).

    One tagged union of both sides is grouped by (user, item), then by user:
    two map-side-combined aggregates, no per-user arrays.
    """
    pr = predicted.select(F.col(user).alias("user_id"), F.col(item).alias("item"),
                          F.lit(1).alias("_p"), F.lit(0).alias("_t"))
    ac = actual.select(F.col(user).alias("user_id"), F.col(item).alias("item"),
                       F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    flags = (pr.unionByName(ac).groupBy("user_id", "item")
             .agg(F.max("_p").alias("_p"), F.max("_t").alias("_t")))
    return _per_user(flags, all_test_users)


def _per_user(flags: DataFrame, all_test_users: bool) -> DataFrame:
    """``(user_id, _p, _t)`` flags per (user, item) -> per-user TP / FP / FN."""
    per_user = flags.groupBy("user_id").agg(
        F.sum(F.col("_p") * F.col("_t")).alias("tp"),
        F.sum(F.col("_p") * (1 - F.col("_t"))).alias("fp"),
        F.sum((1 - F.col("_p")) * F.col("_t")).alias("fn"),
        F.max("_p").alias("_has_p"), F.max("_t").alias("_has_t"))
    keep = F.col("_has_t") == 1
    if not all_test_users:
        keep = keep & (F.col("_has_p") == 1)
    return per_user.where(keep).select("user_id", *[F.col(c).cast("bigint").alias(c)
                                                     for c in ("tp", "fp", "fn")])


def precision_recall(per_user: DataFrame) -> DataFrame:
    """Micro totals: ``(n_matched, tp, fp, fn, precision, recall)``; NULL
    precision / recall on a zero denominator."""
    t = per_user.agg(F.count(F.lit(1)).alias("n_matched"),
                     F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
                     F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"),
                     F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"))
    return t.select("n_matched", "tp", "fp", "fn",
                    safe_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))


def mining_counts(train_pairs: DataFrame, itemsets: DataFrame, rules: DataFrame,
                  user: str = "user_id", item: str = "item",
                  assume_distinct: bool = False) -> DataFrame:
    """One row of pipeline counts: rules, distinct antecedents, itemsets,
    antecedents that yield a suggestion when taken as a basket, and
    users with at least one suggestion."""
    ante = distinct_antecedents(rules)
    # Each antecedent as a basket of its own items.
    ante_pairs = ante.select(F.col("antecedent_key").alias("user_id"),
                             F.explode("antecedent").alias("item"))
    nul = F.lit(None).cast("bigint")
    parts = [
        rules.agg(F.count(F.lit(1)).alias("n_rules")),
        ante.agg(F.count(F.lit(1)).alias("n_antecedents")),
        itemsets.agg(F.count(F.lit(1)).alias("n_itemsets")),
        # An antecedent's items are distinct.
        fire_rules(ante_pairs, rules, assume_distinct=True)
        .agg(F.count_distinct("user_id").alias("n_antecedents_predicting")),
        fire_rules(train_pairs, rules, user, item, assume_distinct)
        .agg(F.count_distinct("user_id").alias("n_users_predicted")),
    ]
    names = ["n_rules", "n_antecedents", "n_itemsets", "n_antecedents_predicting", "n_users_predicted"]
    stacked = None
    for df in parts:
        full = df.select(*[F.col(n) if n in df.columns else nul.alias(n) for n in names])
        stacked = full if stacked is None else stacked.unionByName(full)
    # One-row parts stacked and merged: no join needed.
    return stacked.agg(*[F.max(n).alias(n) for n in names])
