"""Keyed registry: null-preserving upsert, deletes, lookups with fallback, fan-out joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collated import collated, join


def upsert(old: DataFrame, new: DataFrame, key: str, attributes: Sequence[str], now: str, collation: str | None = None) -> DataFrame:
    """New attributes win unless null; ``last_active_at`` of upserted rows becomes ``now``.

    Under a ``collation`` keys that differ in spelling alone are one, and a row keeps the
    spelling that it was inserted with. Both sides have one row a key (``collated.one_each``).
    """
    o, n = (collated(df, [key], collation).alias(name) for df, name in ((old, "o"), (new, "n")))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(
        F.coalesce(f"o.{key}", f"n.{key}").cast(old.schema[key].dataType).alias(key),
        *(F.coalesce(f"n.{a}", f"o.{a}").alias(a) for a in attributes),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        F.when(F.col(f"n.{key}").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("o.last_active_at")).alias("last_active_at"),
    )


def delete(df: DataFrame, gone: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    if collation is not None:
        return join(df, gone.select(key).distinct(), [key], "left_anti", collation)
    return df.join(gone.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(name))


def lookup(users: DataFrame, stores: Sequence[DataFrame], key: str, value: str, default: str) -> DataFrame:
    """The first store that knows the key, else ``default``."""
    out = users.select(key).distinct()
    names = []
    for i, s in enumerate(stores):
        out = out.join(s.select(key, F.col(value).alias(f"_{i}")), key, "left")
        names.append(f"_{i}")
    return out.select(key, F.coalesce(*names, F.lit(default)).alias(value))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row that was registered first, per key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fan_out(base: DataFrame, key: str, branches: dict[str, DataFrame]) -> DataFrame:
    """Left joins with branches that have one row per key; a missing branch is null."""
    out = base
    for name, df in branches.items():
        rest = [c for c in df.columns if c != key]
        out = out.join(df.select(key, F.struct(*rest).alias(name)), key, "left")
    return out
