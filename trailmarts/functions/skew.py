"""Joins whose many-side has keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
HOT_SHARE = 0.001  # at most 1 / HOT_SHARE keys can hold this share, so the hot list is bounded
FLOOR = 100_000  # a key with no more rows than this needs no spreading


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, floor: int = FLOOR) -> DataFrame:
    """Keys that hold more than ``share`` of the rows (and more than ``floor`` rows)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return (
        counts.where(F.col("__n") > floor)
        .join(F.broadcast(total), F.col("__n") > F.col("__total") * share)  # total is one row
        .select(*keys, F.lit(True).alias("__hot"))
    )


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    spread: Column | None = None,
    salts: int = SALTS,
    share: float = HOT_SHARE,
    floor: int = FLOOR,
) -> DataFrame:
    """Join ``many`` to ``one`` on ``keys`` with the hot keys of ``many`` spread over ``salts`` tasks.

    The rows of ``one`` under a hot key are repeated once per salt; all other
    rows are not. ``how`` is ``inner`` or ``left``. The list of hot keys has at
    most ``1 / share`` rows, hence the broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps the many-side: use inner or left")
    keys = list(keys)
    hot = F.broadcast(hot_keys(many, keys, share, floor))
    spread = spread if spread is not None else F.xxhash64(*many.columns)
    left = (
        many.join(hot, keys, "left")
        .withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .drop("__hot")
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = (
        one.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
