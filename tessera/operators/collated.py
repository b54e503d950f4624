"""Keys compared as a case-, accent- and trailing-space-insensitive database compares them.

Spark's own collations do the work: a collated column joins, groups and filters by its
collation key, in shuffles as in code. Comparison is binary unless a caller asks for one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLATION = "UNICODE_CI_AI_RTRIM"


def collated(df: DataFrame, columns: Sequence[str], collation: str | None = COLLATION) -> DataFrame:
    """``df`` with text ``columns`` under ``collation``; other types and None stay as they are."""
    if collation is None:
        return df
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.collate(c, collation) for c in texts}) if texts else df


def plain(df: DataFrame) -> DataFrame:
    """All texts compared by their bytes again, as they are written and returned."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.dataType != T.StringType()]
    return df.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else df


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", collation: str | None = COLLATION) -> DataFrame:
    """An equi-join on collated keys, spelled as in ``left``. ``how``: inner, left, left_semi or left_anti."""
    own = collated(left, on, collation)
    other = collated(right, on, collation).withColumnsRenamed({c: f"_{c}_2" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c) == F.col(f"_{c}_2")
    return plain(own.join(other, same, how).drop(*(f"_{c}_2" for c in on)))


def one_each(df: DataFrame, key: str, attributes: Sequence[str], order: str, collation: str | None = COLLATION) -> DataFrame:
    """A row for each key: of each attribute the newest value that is not null, and the key as it was spelled first."""
    spelled = df.select(F.col(key).cast("string").alias("_spelled"), *dict.fromkeys([key, *attributes, order]))
    rows = collated(spelled, [key], collation).groupBy(key).agg(
        F.min_by("_spelled", order).alias("_spelled"),
        *(F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes),
        F.min(order).alias("_since"),
    )
    return rows.select(F.col("_spelled").alias(key), *attributes, "_since")
