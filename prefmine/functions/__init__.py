from prefmine.functions.columns import (  # noqa: F401
    cosine, hash_key, hash_unit, rmse, safe_ratio, weighted_mean,
)
