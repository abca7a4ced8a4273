"""DuckDB SQL equal to each registered query (tables are pre-registered views)."""

from __future__ import annotations

from prefmine.functions.columns import hex_threshold
from prefmine.plans import params as P


def fx(expr: str, name: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,9)) AS DOUBLE) AS {name}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------- views (CTEs)

RATINGS_SUPP = """
ratings_supp AS (
  SELECT c.c_custkey AS user_id, s.s_suppkey AS item_id, n.n_name AS city,
         avg(CAST(l.l_quantity AS DOUBLE)) AS rating
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY c.c_custkey, s.s_suppkey, n.n_name)"""

RATINGS_PART = """
ratings_part AS (
  SELECT c.c_custkey AS user_id, p.p_partkey AS item_id,
         avg(CAST(l.l_quantity AS DOUBLE)) AS rating
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY c.c_custkey, p.p_partkey)"""

RATINGS_PART_CITY = """
ratings_part_city AS (
  SELECT c.c_custkey AS user_id, l.l_partkey AS item_id, n.n_name AS city,
         avg(CAST(l.l_quantity AS DOUBLE)) AS rating
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY c.c_custkey, l.l_partkey, n.n_name)"""

RATINGS_EVENTS = """
ratings_events AS (
  SELECT CAST(user_id AS BIGINT) AS user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         avg(value) AS rating
  FROM events
  WHERE json_extract_string(props, '$.k') IS NOT NULL
  GROUP BY 1, 2)"""


def hash_unit(cols: list[str], seed: int) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 8)"


def supp_split() -> str:
    th = hex_threshold(P.TEST_FRACTION)
    hu = hash_unit(["user_id", "item_id"], P.SEED)
    return f"""
supp_train AS (SELECT user_id, item_id, rating FROM ratings_supp WHERE NOT ({hu} < '{th}')),
supp_test AS (SELECT user_id, item_id, rating FROM ratings_supp WHERE {hu} < '{th}')"""


def _by(by, alias: str = "") -> str:
    return "".join(f"{alias}{c}, " for c in by)


def _on(by, a: str, b: str) -> str:
    return "".join(f"{a}.{c} = {b}.{c} AND " for c in by)


def similarity(src: str, name: str = "sim", by=()) -> str:
    """Co-rated cosine for a < b over ``src(*by, user_id, item_id, rating)``."""
    return f"""
{name} AS (
  SELECT {_by(by, 'a.')}a.item_id AS item_a, b.item_id AS item_b,
         coalesce(sum(a.rating * b.rating) / nullif(sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)), 0), 0.0) AS similarity,
         count(*) AS n_common
  FROM {src} a JOIN {src} b ON {_on(by, 'a', 'b')}a.user_id = b.user_id AND a.item_id < b.item_id
  GROUP BY {_by(by, 'a.')}a.item_id, b.item_id)"""


def symmetric(sim: str, name: str = "sym", by=()) -> str:
    return f"""
{name} AS (
  SELECT {_by(by)}item_a AS item_id, item_b AS neighbor_id, similarity, n_common FROM {sim}
  UNION ALL
  SELECT {_by(by)}item_b AS item_id, item_a AS neighbor_id, similarity, n_common FROM {sim})"""


def neighbors(sym: str, n: int, name: str = "nb", by=()) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT {_by(by)}item_id, neighbor_id, similarity, n_common,
           row_number() OVER (PARTITION BY {_by(by)}item_id
                              ORDER BY CAST(similarity AS DECIMAL(18,9)) DESC, neighbor_id) AS rank
    FROM {sym}) t
  WHERE rank <= {n})"""


def padded_neighbors(src: str, sym: str, n: int, name: str = "nb") -> str:
    """Brute force, per city: every other item of the city is a candidate; a pair
    without a common user scores 0."""
    return f"""
{name}_items AS (SELECT DISTINCT city, item_id FROM {src}),
{name}_all AS (
  SELECT a.city, a.item_id, b.item_id AS neighbor_id, coalesce(s.similarity, 0.0) AS similarity,
         coalesce(s.n_common, 0) AS n_common
  FROM {name}_items a JOIN {name}_items b ON a.city IS NOT DISTINCT FROM b.city AND a.item_id <> b.item_id
  LEFT JOIN {sym} s ON s.city = a.city AND s.item_id = a.item_id AND s.neighbor_id = b.item_id),
{neighbors(name + "_all", n, name, ("city",)).strip()}"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip("\n") for c in ctes)


# ---------------------------------------------------------------- queries

def oracle() -> dict[str, str]:
    terms = ", ".join(_q(t) for t in P.CITY_TERMS)
    fan = f"""
terms AS (SELECT unnest([{terms}]) AS city_term),
fan AS (
  SELECT t.city_term, r.* FROM ratings_supp r JOIN terms t
    ON r.city IS NOT NULL AND contains(lower(r.city), lower(t.city_term)))"""
    sql = {
        "ratings_build": with_(RATINGS_SUPP) + f"""
SELECT user_id, item_id, city, {fx('rating', 'rating')} FROM ratings_supp""",
        "city_filter": with_(RATINGS_SUPP) + f"""
SELECT user_id, item_id, city, {fx('rating', 'rating')} FROM ratings_supp
WHERE contains(lower(city), lower({_q(P.CITY_TERM)}))""",
        "city_fanout": with_(RATINGS_SUPP, fan) + f"""
SELECT city_term, user_id, item_id, city, {fx('rating', 'rating')} FROM fan""",
        "city_counts": with_(RATINGS_SUPP, fan) + """
SELECT t.city_term, CAST(count(f.user_id) AS BIGINT) AS n_rows
FROM terms t LEFT JOIN fan f ON f.city_term = t.city_term GROUP BY t.city_term""",
        "json_ratings": with_(RATINGS_EVENTS) + f"""
SELECT user_id, item_id, {fx('rating', 'rating')} FROM ratings_events""",
        "item_similarity": with_(RATINGS_PART, similarity("ratings_part")) + f"""
SELECT item_a, item_b, {fx('similarity', 'similarity')}, n_common FROM sim""",
        "item_similarity_symmetric": with_(RATINGS_EVENTS, similarity("ratings_events"),
                                           symmetric("sim")) + f"""
SELECT item_id, neighbor_id, {fx('similarity', 'similarity')}, n_common FROM sym""",
        "item_neighbors": with_(RATINGS_SUPP, supp_split(), similarity("supp_train"),
                                symmetric("sim"), neighbors("sym", P.N_NEIGHBORS)) + f"""
SELECT item_id, neighbor_id, {fx("similarity", "similarity")}, n_common, CAST(rank AS INTEGER) AS rank FROM nb""",
    }
    sql.update(_padded())
    sql.update(_more())
    sql.update(_sweeps())
    sql.update(_city_models())
    sql.update(_counts())
    sql.update(_files())
    sql.update(_als())
    sql.update(_roundtrips(sql))
    sql.update(_kept(sql))
    # The streamed rating table equals the batch build.
    sql["stream_ratings"] = sql["ratings_build"]
    return sql


def _padded() -> dict[str, str]:
    by = ("city",)
    hu = hash_unit(["user_id", "item_id", "city"], P.SEED)
    th = hex_threshold(P.TEST_FRACTION)
    whole = (RATINGS_PART_CITY, similarity("ratings_part_city", "sim", by), symmetric("sim", "sym", by),
             padded_neighbors("ratings_part_city", "sym", P.N_NEIGHBORS))
    held = (RATINGS_PART_CITY, f"""
ptr AS (SELECT * FROM ratings_part_city WHERE NOT ({hu} < '{th}')),
pte AS (SELECT * FROM ratings_part_city WHERE {hu} < '{th}')""",
            similarity("ptr", "sim", by), symmetric("sim", "sym", by), padded_neighbors("ptr", "sym", P.N_NEIGHBORS),
            predict_all("nb", "ptr", "pred", by))
    on = "a.city = p.city AND a.user_id = p.user_id AND a.item_id = p.item_id"
    return {
        "item_neighbors_padded": with_(*whole) + f"""
SELECT city, item_id, neighbor_id, {fx("similarity", "similarity")}, n_common, CAST(rank AS INTEGER) AS rank FROM nb""",
        "itemcf_predictions_padded": with_(*held) + f"""
SELECT a.city, a.user_id, a.item_id, {fx("p.prediction", "prediction")} FROM pte a JOIN pred p ON {on}""",
        "itemcf_rmse_padded": with_(*held) + f"""
SELECT a.city, {fx("sqrt(avg(power(a.rating - p.prediction, 2)))", "rmse")}, count(p.prediction) AS n_covered,
       count(*) AS n_actual, {fx("CAST(count(p.prediction) AS DOUBLE) / count(*)", "coverage")}
FROM pte a LEFT JOIN pred p ON {on} GROUP BY a.city""",
    }


# ------------------------------------------- CF predictions, splits, mining

def predict_all(nb: str, train: str, name: str = "pred", by=()) -> str:
    return f"""
{name} AS (
  SELECT {_by(by, 'r.')}r.user_id, n.item_id,
         CASE WHEN sum(n.similarity) <> 0 THEN sum(n.similarity * r.rating) / sum(n.similarity)
              ELSE 0.0 END AS prediction
  FROM {nb} n JOIN {train} r ON {_on(by, 'r', 'n')}r.item_id = n.neighbor_id
  GROUP BY {_by(by, 'r.')}r.user_id, n.item_id)"""


def evaluate(actual: str, pred: str) -> str:
    return f"""
SELECT {fx('sqrt(avg(power(a.rating - p.prediction, 2)))', 'rmse')},
       count(p.prediction) AS n_covered, count(*) AS n_actual,
       {fx('CAST(count(p.prediction) AS DOUBLE) / nullif(count(*), 0)', 'coverage')}
FROM {actual} a LEFT JOIN {pred} p ON a.user_id = p.user_id AND a.item_id = p.item_id"""


BRAND_PAIRS = """
bp AS (SELECT DISTINCT l.l_orderkey AS user_id, p.p_brand AS item
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def brand_split(src: str = "bp") -> str:
    h = f"md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item AS VARCHAR), '{P.SEED}'))"
    return f"""
bp_h AS (SELECT user_id, item,
                row_number() OVER (ORDER BY {h}, user_id, item) - 1 AS pos,
                count(*) OVER () AS n
         FROM {src}),
bp_split AS (SELECT user_id, item, pos < floor(n * {P.BASKET_TEST_FRACTION}) AS is_test FROM bp_h),
tr AS (SELECT user_id, item FROM bp_split WHERE NOT is_test),
te AS (SELECT user_id, item FROM bp_split WHERE is_test)"""


def itemsets(src: str, support: float, suffix: str = "") -> str:
    """Frequent itemsets of any size: all sub-sets of every basket, counted (baskets
    here are small), and the rules with one consequent."""
    s = suffix
    return f"""
nbk{s} AS (SELECT count(DISTINCT user_id) AS n FROM {src}),
sub{s}(user_id, k, last, size) AS (
  SELECT user_id, item, item, 1 FROM {src}
  UNION ALL
  SELECT b.user_id, b.k || ',' || x.item, x.item, b.size + 1
  FROM sub{s} b JOIN {src} x ON x.user_id = b.user_id AND x.item > b.last),
fs{s} AS (SELECT k, size, count(*) AS freq FROM sub{s} GROUP BY k, size
          HAVING count(*) >= (SELECT ceil(CAST({support!r} AS DOUBLE) * n) FROM nbk{s})),
cand{s} AS (SELECT k, freq, unnest(string_split(k, ',')) AS cons FROM fs{s} WHERE size > 1),
rules_all{s} AS (
  SELECT c.ante AS antecedent_key, c.cons AS consequent_key,
         CAST(c.freq AS DOUBLE) / fa.freq AS confidence,
         (CAST(c.freq AS DOUBLE) / fa.freq) / (CAST(fc.freq AS DOUBLE) / (SELECT n FROM nbk{s})) AS lift,
         CAST(c.freq AS DOUBLE) / (SELECT n FROM nbk{s}) AS support
  FROM (SELECT *, trim(replace(',' || k || ',', ',' || cons || ',', ','), ',') AS ante FROM cand{s}) c
  JOIN fs{s} fa ON fa.k = c.ante JOIN fs{s} fc ON fc.k = c.cons AND fc.size = 1)"""


def rules(min_conf: float, suffix: str = "") -> str:
    s = suffix
    return f"""
rules{s} AS (SELECT * FROM rules_all{s} WHERE confidence >= {min_conf!r})"""


def fire(train: str, rules_t: str, test: str, suffix: str = "") -> str:
    s = suffix
    return f"""
ante{s} AS (SELECT antecedent_key, count(*) AS n_rules FROM {rules_t} GROUP BY antecedent_key),
ante_items{s} AS (SELECT antecedent_key, unnest(string_split(antecedent_key, ',')) AS item,
                         len(string_split(antecedent_key, ',')) AS ante_size FROM ante{s}),
fired{s} AS (SELECT t.user_id, a.antecedent_key
             FROM {train} t JOIN ante_items{s} a ON t.item = a.item
             GROUP BY t.user_id, a.antecedent_key, a.ante_size HAVING count(*) = a.ante_size),
rec{s} AS (SELECT DISTINCT f.user_id, r.consequent_key AS item
           FROM fired{s} f JOIN {rules_t} r ON f.antecedent_key = r.antecedent_key),
rpred{s} AS (SELECT user_id, item FROM rec{s}
             EXCEPT SELECT user_id, item FROM {train}),
flags{s} AS (SELECT user_id, item, max(p) AS p, max(t) AS t FROM (
               SELECT user_id, item, 1 AS p, 0 AS t FROM rpred{s}
               UNION ALL SELECT user_id, item, 0 AS p, 1 AS t FROM {test}) u
             GROUP BY user_id, item),
per_user{s} AS (SELECT user_id, CAST(sum(p * t) AS BIGINT) AS tp,
                       CAST(sum(p * (1 - t)) AS BIGINT) AS fp,
                       CAST(sum((1 - p) * t) AS BIGINT) AS fn
                FROM flags{s} GROUP BY user_id HAVING max(p) = 1 AND max(t) = 1),
totals{s} AS (SELECT count(*) AS n_matched, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp,
                     CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp,
                     CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn FROM per_user{s})"""


def _split_cte(seed: int, suffix: str = "") -> str:
    hu, th = hash_unit(["user_id", "item_id"], seed), hex_threshold(P.TEST_FRACTION)
    return f"""
tr{suffix} AS (SELECT * FROM ratings_supp WHERE NOT ({hu} < '{th}')),
te{suffix} AS (SELECT * FROM ratings_supp WHERE {hu} < '{th}'),
known{suffix} AS (SELECT t.* FROM te{suffix} t SEMI JOIN (SELECT DISTINCT user_id FROM tr{suffix}) u ON u.user_id = t.user_id
                  SEMI JOIN (SELECT DISTINCT item_id FROM tr{suffix}) i ON i.item_id = t.item_id)"""


def _als() -> dict[str, str]:
    """What follows from the data alone: the pairs with a known user and item, counts,
    grid points; flags that hold for every correct fit are true."""
    rating = fx("CAST(CAST(rating AS FLOAT) AS DOUBLE)", "rating")
    runs = ", ".join(_split_cte(i, f"_{i}").strip("\n") for i in range(P.ALS_RUNS))
    hold = "\nUNION ALL ".join(
        f"SELECT '{i}' AS run, (SELECT count(*) FROM tr_{i}) AS n_train, (SELECT count(*) FROM te_{i}) AS n_test, "
        f"(SELECT count(*) FROM known_{i}) AS n_scored" for i in range(P.ALS_RUNS))
    grid = ", ".join(f"({r}, CAST({g} AS DOUBLE))" for r in P.ALS_GRID_RANKS for g in P.ALS_GRID_REGS)
    ranks = ", ".join(f"({r})" for r in P.ALS_CITY_RANKS)
    terms = ", ".join(_q(t) for t in P.ALS_CITY_TERMS)
    of_city = "contains(lower({}.city), lower(t.city_term))"
    city = (RATINGS_SUPP, _split_cte(P.SEED), f"""
terms AS (SELECT unnest([{terms}]) AS city_term),
ctr AS (SELECT t.city_term, r.* FROM tr r JOIN terms t ON {of_city.format('r')}),
cte AS (SELECT t.city_term, r.* FROM te r JOIN terms t ON {of_city.format('r')}),
ck AS (SELECT c.* FROM cte c WHERE EXISTS (SELECT 1 FROM ctr x WHERE x.city_term = c.city_term AND x.user_id = c.user_id)
                                AND EXISTS (SELECT 1 FROM ctr x WHERE x.city_term = c.city_term AND x.item_id = c.item_id)),
cn AS (SELECT t.city_term, (SELECT count(*) FROM ctr c WHERE c.city_term = t.city_term) AS n_train,
              (SELECT count(*) FROM cte c WHERE c.city_term = t.city_term) AS n_test,
              (SELECT count(*) FROM ck c WHERE c.city_term = t.city_term) AS n_scored FROM terms t)""")

    def compare(by: str, suffix: str, seed: int) -> tuple[list[str], str]:
        x = suffix
        ctes = [_split_cte(seed, x), similarity(f"tr{x}", f"sim{x}"), symmetric(f"sim{x}", f"sym{x}"),
                neighbors(f"sym{x}", P.N_NEIGHBORS, f"nb{x}"), predict_all(f"nb{x}", f"tr{x}", f"pred{x}")]
        head, group = ("city", "city") if by == "city" else (f"CAST({seed} AS INTEGER) AS run", "true")
        return ctes, f"""
SELECT {head}, {fx('rmse_itemcf', 'rmse_itemcf')}, n_als, n_als > 0 AS als_finite FROM (
  SELECT {'a.city,' if by == 'city' else ''} sqrt(avg(power(a.rating - p.prediction, 2))) AS rmse_itemcf,
         count(*) FILTER (WHERE k.user_id IS NOT NULL) AS n_als
  FROM te{x} a LEFT JOIN pred{x} p ON a.user_id = p.user_id AND a.item_id = p.item_id
  LEFT JOIN known{x} k ON a.user_id = k.user_id AND a.item_id = k.item_id
  {'GROUP BY a.city' if by == 'city' else ''}) z"""

    one, one_sql = compare("city", "", P.SEED)
    parts = [compare("run", f"_r{i}", i) for i in range(P.COMPARE_RUNS)]
    times_by = ("city_term",)
    times, sels = [similarity("ctr", "csim", times_by), symmetric("csim", "csym", times_by)], []
    for n in [n for n in P.NEIGHBOR_SWEEP if n > P.N_NEIGHBORS]:
        times += [neighbors("csym", n, f"cnb{n}", times_by), predict_all(f"cnb{n}", "ctr", f"cpred{n}", times_by)]
        sels.append(f"""
SELECT cn.city_term, {n} AS n_neighbors, cn.n_train, cn.n_test, {fx('z.rmse', 'rmse')}, true AS timed
FROM cn LEFT JOIN (SELECT a.city_term, sqrt(avg(power(a.rating - p.prediction, 2))) AS rmse
                   FROM cte a LEFT JOIN cpred{n} p ON a.city_term = p.city_term AND a.user_id = p.user_id AND a.item_id = p.item_id
                   GROUP BY a.city_term) z ON z.city_term = cn.city_term""")
    return {
        "als_predictions": with_(RATINGS_SUPP, _split_cte(P.SEED)) + f"""
SELECT user_id, item_id, {rating}, true AS finite FROM known""",
        "als_save_load": with_(RATINGS_SUPP, _split_cte(P.SEED)) + f"""
SELECT user_id, item_id, {rating}, true AS same FROM known""",
        "als_holdout_mean": with_(RATINGS_SUPP, runs) + f""",
h AS ({hold})
SELECT run, n_train, n_test, n_scored, true AS rmse_finite, true AS timed FROM h
UNION ALL SELECT 'mean', CAST(floor(avg(n_train)) AS BIGINT), CAST(floor(avg(n_test)) AS BIGINT),
                 CAST(floor(avg(n_scored)) AS BIGINT), true, true FROM h""",
        "als_certificate": with_(RATINGS_SUPP, _split_cte(P.SEED)) + """
SELECT (SELECT count(DISTINCT user_id) FROM tr) AS n_users, (SELECT count(*) FROM tr) AS n_train,
       (SELECT count(*) FROM known) AS n_scored, true AS stationary, true AS rmse_equal, true AS train_fits_better""",
        "als_grid": f"""
SELECT rank, reg_param, true AS scored, 1 AS n_best, true AS best_is_least, true AS train_below_deviation,
       true AS reloaded_equal FROM (VALUES {grid}) g(rank, reg_param)""",
        "als_city_sweep": with_(*city) + f"""
SELECT city_term, rank, n_train, n_test, n_scored, true AS finite, true AS timed FROM cn, (VALUES {ranks}) g(rank)
WHERE n_train + n_test > 0""",
        "metric_layouts": with_(*city) + f"""
SELECT layout, CAST(n AS BIGINT) AS n_rows, true AS same FROM (
  SELECT unnest(['alsRMSE', 'itemRMSE', 'alsItem', 'freNum', 'freqResult']) AS layout,
         unnest([{len(P.ALS_GRID_RANKS) * len(P.ALS_GRID_REGS)}, {len(P.NEIGHBOR_SWEEP)}, {P.COMPARE_RUNS}, {len(P.SUPPORT_SWEEP)}, {len(P.SUPPORT_SWEEP)}]) AS n
  UNION ALL SELECT 'alsRst', count(*) FROM cn, (VALUES {ranks}) g(rank) WHERE n_train + n_test > 0
  UNION ALL SELECT 'clRst', count(*) * {len([n for n in P.NEIGHBOR_SWEEP if n > P.N_NEIGHBORS])} FROM cn
  UNION ALL SELECT unnest(['singleMachineTestTime', 'bestResultForALS']), unnest([count(*) FILTER (WHERE n_train > 0), count(*) FILTER (WHERE n_scored > 0)]) FROM cn
  UNION ALL SELECT 'bestResultForItem', BEST_OF_ITEM) z""",
        "als_rank_rows": with_(*city) + """
SELECT city_term, CAST(100 AS INTEGER) AS rank, n_train, n_test, n_scored, true AS finite, true AS timed FROM cn
WHERE n_train + n_test > 0""",
        "itemcf_city_times": with_(*city, *times) + "\nUNION ALL".join(sels),
        "metric_compare": with_(RATINGS_SUPP, *one) + one_sql,
        "metric_compare_runs": with_(RATINGS_SUPP, *[c for ctes, _ in parts for c in ctes]) + "\nUNION ALL".join(q for _, q in parts),
    }


def _files() -> dict[str, str]:
    return {"ratings_from_files": """
WITH ui AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS user_index FROM customer),
bi AS (SELECT s.s_suppkey, row_number() OVER (ORDER BY s.s_suppkey) - 1 AS business_index, n.n_name AS city
       FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT CAST(ui.user_index AS INTEGER) AS user_id, CAST(bi.business_index AS INTEGER) AS item_id, bi.city,
       """ + fx("avg(CAST(CAST(l.l_quantity AS FLOAT) AS DOUBLE))", "rating") + """
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN ui ON ui.c_custkey = o.o_custkey
JOIN bi ON bi.s_suppkey = l.l_suppkey
GROUP BY ui.user_index, bi.business_index, bi.city"""}


def _roundtrips(sql: dict[str, str]) -> dict[str, str]:
    terms = ", ".join(_q(t) for t in P.CITY_TERMS)
    sweep = sql["support_sweep"]
    return {
        "city_files_roundtrip": with_(RATINGS_SUPP, f"""
terms AS (SELECT unnest([{terms}]) AS city_term),
fan AS (SELECT t.city_term, r.* FROM ratings_supp r JOIN terms t
          ON r.city IS NOT NULL AND contains(lower(r.city), lower(t.city_term)))""") + """
SELECT city_term, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM fan GROUP BY city_term""",
        "ratings_csv_roundtrip": with_(RATINGS_SUPP) + f"""
SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id, city,
       {fx('CAST(CAST(rating AS FLOAT) AS DOUBLE)', 'rating')} FROM ratings_supp""",
        "metric_csv_roundtrip": f"""
SELECT support, n_itemsets AS numFreqItemsets, n_rules AS numAssociateRules,
       tp AS TP, fp AS FP, fn AS FN, precision, recall
FROM ({sweep}) s""",
    }


def _counts() -> dict[str, str]:
    mining = (BRAND_PAIRS, brand_split(), itemsets("tr", P.MIN_SUPPORT), rules(P.MIN_CONFIDENCE),
              fire("tr", "rules", "te"))
    ante_basket = """
abk AS (SELECT antecedent_key AS user_id, unnest(string_split(antecedent_key, ',')) AS item
        FROM ante),
abk_te AS (SELECT * FROM abk WHERE false)"""
    return {"mining_counts": with_(*mining, ante_basket, fire("abk", "rules", "abk_te", "_a")) + """
SELECT (SELECT count(*) FROM rules) AS n_rules, (SELECT count(*) FROM ante) AS n_antecedents,
       (SELECT count(*) FROM fs) AS n_itemsets,
       (SELECT count(DISTINCT user_id) FROM rpred_a) AS n_antecedents_predicting,
       (SELECT count(DISTINCT user_id) FROM rpred) AS n_users_predicted"""}


OPEN_PAIRS = f"""
all_pairs AS (
  SELECT DISTINCT l.l_suppkey AS item_id, o.o_custkey AS user_id, n.n_name AS city,
         CAST(s.s_acctbal > 0 AS INTEGER) AS is_open
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
open_pairs AS (SELECT item_id, user_id FROM all_pairs WHERE city = {_q(P.OPEN_CITY)} AND is_open = 1)"""


def _more() -> dict[str, str]:
    sup, conf = P.MIN_SUPPORT, P.MIN_CONFIDENCE
    mining = (BRAND_PAIRS, brand_split(), itemsets("tr", sup), rules(conf))
    cf = (RATINGS_SUPP, supp_split(), similarity("supp_train"), symmetric("sim"),
          neighbors("sym", P.N_NEIGHBORS))
    open_mining = (OPEN_PAIRS, """
ob AS (SELECT user_id, CAST(item_id AS VARCHAR) AS item FROM open_pairs)""", brand_split("ob"), itemsets("tr", sup), rules(conf))
    th = hex_threshold(P.TEST_FRACTION)
    hu = hash_unit(["user_id", "item_id"], P.SEED)
    return {
        "dense_user_index": """
SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS user_index
FROM (SELECT DISTINCT c_name FROM customer) t""",
        "first_seen_index": with_(OPEN_PAIRS) + """
SELECT user_id, row_number() OVER (ORDER BY first_item, user_id) - 1 AS user_index
FROM (SELECT user_id, min(item_id) AS first_item FROM open_pairs GROUP BY user_id) t""",
        "first_seen_business_index": with_(OPEN_PAIRS) + """
SELECT item_id, row_number() OVER (ORDER BY item_id, first_user) - 1 AS business_index
FROM (SELECT item_id, min(user_id) AS first_user FROM open_pairs GROUP BY item_id) t""",
        "first_seen_index_all": with_(OPEN_PAIRS) + """
SELECT user_id, row_number() OVER (ORDER BY first_item, user_id) - 1 AS user_index
FROM (SELECT user_id, min(item_id) AS first_item FROM all_pairs GROUP BY user_id) t""",
        "open_city_rules": with_(*open_mining) + f"""
SELECT antecedent_key, consequent_key, {fx('confidence', 'confidence')}, {fx('lift', 'lift')},
       {fx('support', 'support')} FROM rules""",
        "open_city_precision_recall": with_(*open_mining, fire("tr", "rules", "te")) + f"""
SELECT n_matched, tp, fp, fn,
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fp, 0)', 'precision')},
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fn, 0)', 'recall')}
FROM totals""",
        "split_80_20": with_(RATINGS_SUPP) + f"""
SELECT user_id, item_id, {hu} < '{th}' AS is_test FROM ratings_supp""",
        "split_exact_tenth": with_(BRAND_PAIRS, brand_split()) + """
SELECT user_id, item, is_test FROM bp_split""",
        "itemcf_predictions": with_(*cf, predict_all("nb", "supp_train")) + f"""
SELECT user_id, item_id, {fx('prediction', 'prediction')} FROM pred""",
        "itemcf_rmse_train": with_(*cf, predict_all("nb", "supp_train")) + evaluate("supp_train", "pred"),
        "itemcf_rmse_test": with_(*cf, predict_all("nb", "supp_train")) + evaluate("supp_test", "pred"),
        "itemcf_coverage": with_(*cf, predict_all("nb", "supp_train")) + f"""
SELECT a.city, count(*) AS n_actual, count(p.prediction) AS n_covered,
       {fx('CAST(count(p.prediction) AS DOUBLE) / count(*)', 'coverage')},
       {fx('sqrt(avg(power(a.rating - p.prediction, 2)))', 'rmse')}
FROM (SELECT t.user_id, t.item_id, t.rating, r.city FROM supp_test t
      JOIN ratings_supp r ON r.user_id = t.user_id AND r.item_id = t.item_id) a
LEFT JOIN pred p ON a.user_id = p.user_id AND a.item_id = p.item_id
GROUP BY a.city""",
        "distinct_pairs": with_(OPEN_PAIRS) + """
SELECT item_id, user_id FROM open_pairs""",
        "user_baskets": with_(BRAND_PAIRS) + """
SELECT user_id, string_agg(item, ',' ORDER BY item) AS items_key, CAST(count(*) AS INTEGER) AS n_items
FROM bp GROUP BY user_id""",
        "basket_stats": with_(BRAND_PAIRS) + f"""
SELECT count(*) AS n_pairs, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items,
       (SELECT max(c) FROM (SELECT count(*) AS c FROM bp GROUP BY user_id) t) AS max_basket,
       {fx('CAST(count(*) AS DOUBLE) / count(DISTINCT user_id)', 'mean_basket')}
FROM bp""",
        "frequent_itemsets": with_(*mining) + """
SELECT k AS items_key, CAST(size AS INTEGER) AS size, freq FROM fs""",
        "association_rules": with_(*mining) + f"""
SELECT antecedent_key, consequent_key, {fx('confidence', 'confidence')}, {fx('lift', 'lift')},
       {fx('support', 'support')} FROM rules""",
        "distinct_antecedents": with_(*mining) + """
SELECT antecedent_key, CAST(len(string_split(antecedent_key, ',')) AS INTEGER) AS ante_size,
       count(*) AS n_rules FROM rules GROUP BY antecedent_key""",
        "rule_predictions": with_(*mining, fire("tr", "rules", "te")) + """
SELECT user_id, item FROM rpred""",
        "rule_tp_fp_fn": with_(*mining, fire("tr", "rules", "te")) + """
SELECT user_id, tp, fp, fn FROM per_user""",
        "rule_precision_recall": with_(*mining, fire("tr", "rules", "te")) + f"""
SELECT n_matched, tp, fp, fn,
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fp, 0)', 'precision')},
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fn, 0)', 'recall')}
FROM totals""",
    }


def _sweeps() -> dict[str, str]:
    base_cf = (RATINGS_SUPP, supp_split(), similarity("supp_train"), symmetric("sim"))
    cf_parts, sel_all, sel_city = [], [], []
    for n in P.NEIGHBOR_SWEEP:
        cf_parts += [neighbors("sym", n, f"nb{n}"), predict_all(f"nb{n}", "supp_train", f"pred{n}")]
        j = f"""supp_test a LEFT JOIN pred{n} p ON a.user_id = p.user_id AND a.item_id = p.item_id"""
        sel_all.append(f"""
SELECT {n} AS n_neighbors, {fx('sqrt(avg(power(a.rating - p.prediction, 2)))', 'rmse')},
       count(p.prediction) AS n_covered, count(*) AS n_actual,
       {fx('CAST(count(p.prediction) AS DOUBLE) / count(*)', 'coverage')}
FROM {j}""")
        sel_city.append(f"""
SELECT {n} AS n_neighbors, r.city, sqrt(avg(power(a.rating - p.prediction, 2))) AS rmse
FROM {j} JOIN ratings_supp r ON r.user_id = a.user_id AND r.item_id = a.item_id
GROUP BY r.city""")
    city_cte = "city_sweep AS (" + "\nUNION ALL".join(sel_city) + ")"
    out = {
        "neighbor_sweep": with_(*base_cf, *cf_parts) + "\nUNION ALL".join(sel_all),
        "metric_filter": with_(*base_cf, *cf_parts, city_cte) + f"""
SELECT 'itemcf' AS experiment, city, 0 AS run, 'n_neighbors' AS param,
       CAST(n_neighbors AS DOUBLE) AS param_value, 'rmse' AS metric, {fx('rmse', 'value')}
FROM city_sweep WHERE n_neighbors = 10""",
        "best_csv_roundtrip": with_(*base_cf, *cf_parts, city_cte) + f"""
SELECT {fx('min(rmse)', 'RMSE')} FROM city_sweep GROUP BY city""",
        "metric_pivot": with_(*base_cf, *cf_parts, city_cte) + """
SELECT city, """ + ", ".join(
            fx(f"max(CASE WHEN n_neighbors = {n} THEN rmse END)", f"rmse_n{n}")
            for n in P.NEIGHBOR_SWEEP) + """
FROM city_sweep GROUP BY city""",
    }
    ctes, sels = [BRAND_PAIRS, brand_split()], []
    for i, s in enumerate(P.SUPPORT_SWEEP):
        x = f"_s{i}"
        ctes += [itemsets("tr", s, x), rules(P.MIN_CONFIDENCE, x), fire("tr", f"rules{x}", "te", x)]
        sels.append(f"""
SELECT {fx(repr(s), 'support')}, (SELECT count(*) FROM fs{x}) AS n_itemsets,
       (SELECT count(*) FROM rules{x}) AS n_rules, n_matched, tp, fp, fn,
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fp, 0)', 'precision')},
       {fx('CAST(tp AS DOUBLE) / nullif(tp + fn, 0)', 'recall')}
FROM totals{x}""")
    out["support_sweep"] = with_(*ctes) + "\nUNION ALL".join(sels)
    return out


def _city_models() -> dict[str, str]:
    terms = ", ".join(_q(t) for t in P.CITY_TERMS)
    by = ("city_term",)
    ctes = [RATINGS_SUPP, supp_split(), f"""
terms AS (SELECT unnest([{terms}]) AS city_term),
ctrain AS (SELECT t.city_term, s.user_id, s.item_id, s.rating
           FROM supp_train s JOIN ratings_supp r ON r.user_id = s.user_id AND r.item_id = s.item_id
           JOIN terms t ON contains(lower(r.city), lower(t.city_term))),
ctest AS (SELECT t.city_term, s.user_id, s.item_id, s.rating
          FROM supp_test s JOIN ratings_supp r ON r.user_id = s.user_id AND r.item_id = s.item_id
          JOIN terms t ON contains(lower(r.city), lower(t.city_term)))""",
            similarity("ctrain", "csim", by), symmetric("csim", "csym", by)]
    sels = []
    for n in P.NEIGHBOR_SWEEP:
        ctes += [neighbors("csym", n, f"cnb{n}", by), predict_all(f"cnb{n}", "ctrain", f"cpred{n}", by)]
        sels.append(f"""
SELECT a.city_term, {n} AS n_neighbors, {fx('sqrt(avg(power(a.rating - p.prediction, 2)))', 'rmse')},
       count(p.prediction) AS n_covered, count(*) AS n_actual,
       {fx('CAST(count(p.prediction) AS DOUBLE) / count(*)', 'coverage')}
FROM ctest a LEFT JOIN cpred{n} p
  ON a.city_term = p.city_term AND a.user_id = p.user_id AND a.item_id = p.item_id
GROUP BY a.city_term""")
    sweep = "city_sweep AS (" + "\nUNION ALL".join(sels) + ")"
    long_ = f"""
city_long AS (
  SELECT 'itemcf' AS experiment, city_term AS city, CAST(n_neighbors AS DOUBLE) AS param_value,
         'rmse' AS metric, CAST(rmse AS DOUBLE) AS value FROM city_sweep
  UNION ALL
  SELECT 'itemcf', city_term, CAST(n_neighbors AS DOUBLE), 'coverage', CAST(coverage AS DOUBLE)
  FROM city_sweep)"""
    cols = f"experiment, city, param_value, metric, {fx('value', 'value')}"
    order = "metric, city, param_value"
    return {
        "itemcf_city_sweep": with_(*ctes) + "\nUNION ALL".join(sels),
        "metric_head": with_(*ctes, sweep, long_) + f"""
SELECT {cols} FROM (SELECT * FROM city_long ORDER BY {order} LIMIT 5) t""",
        "metric_slice": with_(*ctes, sweep, long_) + f"""
SELECT {cols} FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM city_long) t
WHERE pos >= 5 AND pos < 10""",
        "metric_threshold": with_(*ctes, sweep, long_) + f"""
SELECT {cols} FROM city_long WHERE metric = 'coverage' AND value > 0.5""",
    }


def _kept(sql: dict[str, str]) -> dict[str, str]:
    """Tables kept up to date batch by batch, coded or rebuilt equal those built at once."""
    lines = """
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS review_id, o_custkey, l_suppkey, l_quantity
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
    bad = lines + f"""
SELECT review_id, CASE review_id % {P.FLAWED} WHEN 1 THEN 'missing user_id' ELSE 'malformed' END AS reason, true AS placed
FROM r WHERE review_id % {P.FLAWED} < 3"""
    return {
        "metric_layouts": sql["metric_layouts"].replace("BEST_OF_ITEM", f"(SELECT count(RMSE) FROM ({sql['best_csv_roundtrip']}) b)"),
        "ratings_rebuilt": sql["ratings_build"],
        "city_fanout_coded": sql["city_fanout"],
        "user_ids_by_batches": sql["first_seen_index_all"],
        "quarantine_good": lines + f"""
SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(l_suppkey AS BIGINT) AS business_id, {fx('l_quantity', 'stars')}
FROM r WHERE review_id % {P.FLAWED} >= 3""",
        "quarantine_bad": bad,
        "quarantine_stream": bad,
        "split_random": with_(RATINGS_SUPP) + """
SELECT count(*) AS n_rows, true AS disjoint_and_repeated, true AS near_weights FROM ratings_supp""",
        "colocated_predictions": sql["itemcf_predictions"],
        "colocated_rmse_test": sql["itemcf_rmse_test"],
        "itemsets_from_rows": sql["frequent_itemsets"],
        "rules_from_rows": sql["association_rules"],
        "similarity_by_batches": sql["item_similarity"],
        "neighbors_by_batches": with_(RATINGS_SUPP, similarity("ratings_supp"), symmetric("sim"), neighbors("sym", P.N_NEIGHBORS)) + f"""
SELECT item_id, neighbor_id, {fx("similarity", "similarity")}, n_common, CAST(rank AS INTEGER) AS rank FROM nb""",
    }
