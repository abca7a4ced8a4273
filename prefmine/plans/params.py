"""Fixed parameters of the registered queries."""

# City terms of the registered city queries, as many as the library's own list.
# 'nation_1' and 'nation_2' also match NATION_10.., so overlaps are exercised.
CITY_TERM = "nation_1"
CITY_TERMS = ("nation_1", "nation_2", "nation_3", "nation_5", "nation_7", "nation_9", "NATION_0", "NATION_15",
              "NATION_20", "NATION_24")
# Cities of the ALS rank x city table (five positions).
ALS_CITY_TERMS = ("NATION_0", "nation_3", "nation_7", "NATION_15", "NATION_24")

N_NEIGHBORS = 10
NEIGHBOR_SWEEP = (10, 15, 20, 30)
TEST_FRACTION = 0.2      # hash split of rating tables
SEED = 0
COMPARE_RUNS = 5         # fresh splits of the ALS versus item CF comparison

BASKET_TEST_FRACTION = 0.1   # exact split of (user, item) basket pairs
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.1
SUPPORT_SWEEP = (0.005, 0.01, 0.02)

OPEN_CITY = "NATION_1"       # city of the distinct-pairs query (equality)

ALS_RANK = 200
ALS_MAX_ITER = 20
ALS_REG = 0.1
ALS_BLOCKS = 16          # factor blocks: two waves of tasks on eight cores
ALS_RUNS = 3
ALS_FOLDS = 3
ALS_GRID_RANKS = (50, 100, 200)
ALS_GRID_REGS = (0.1, 0.02)
ALS_CITY_RANKS = (20, 50, 100, 200, 300)
ALS_COMPARE_RANK = 50

FLAWED = 97              # of so many review lines one is cut short, one has no user, one no number
