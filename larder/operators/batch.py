"""Row batches: the first n by key, a filtered batch, a random sample."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.predicates import Filter, apply_filters


def get_batch(df: DataFrame, count: int, *filters: Filter, query: dict[str, Any] | None = None,
              key: str = "recipe_id") -> DataFrame:
    """The first ``count`` rows by ``key`` that pass the filters; 0 gives an empty frame of the same schema."""
    if count < 0:
        raise ValueError("count must not be negative")
    found = apply_filters(df, *filters, query=query)
    return found.limit(0) if count == 0 else found.orderBy(key).limit(count)


def select_rows(df: DataFrame, count: int, mode: str = "random", seed: int = 42, key: str = "recipe_id") -> DataFrame:
    """Exactly ``count`` rows (all, if there are fewer): ``random`` without replacement, or the ``first`` by ``key``.

    Either is a top-k: each task keeps at most ``count`` rows. The random sample takes the smallest digests of seed and
    key, so a seed names the same keys from any partitioning, and samples of parts merge to the sample of the whole."""
    if count < 0:
        raise ValueError("count must not be negative")
    if mode == "first":
        return df.orderBy(key).limit(count)
    if mode != "random":
        raise ValueError("mode must be random or first")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), key).limit(count)
