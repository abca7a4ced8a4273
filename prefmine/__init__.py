"""prefmine: preference mining on Spark.

Turns review / order tables into averaged user-item ratings, predicts ratings
with item-based collaborative filtering and ALS, mines frequent itemsets and
association rules from user baskets, and scores everything with RMSE,
coverage, precision and recall.  Every operator is a function from DataFrames
to DataFrames built from native column expressions, joins, windows and Spark ML.
"""

__version__ = "0.1.0"
