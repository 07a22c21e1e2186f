"""Column-level operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_subset_columns(df: DataFrame, keys: Sequence[str], reject: bool = False) -> DataFrame:
    """P1 on a row: keep (or with ``reject`` drop) columns."""
    keys = set(keys)
    return df.select(*[c for c in df.columns if (c in keys) != reject])


def key_subset_map(m: Column | str, keys: Sequence[str], reject: bool = False) -> Column:
    """P1 on a map column: keep (or drop) the given keys."""
    m = F.col(m) if isinstance(m, str) else m
    wanted = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    if reject:
        return F.map_filter(m, lambda k, v: ~F.array_contains(wanted, k))
    return F.map_filter(m, lambda k, v: F.array_contains(wanted, k))


def apply_column(df: DataFrame, func: Callable[..., Column], columns, new_name: str = "") -> DataFrame:
    """``new_name`` (default: the first input column) =
    ``func(*columns)``.  ``func`` builds a Column expression, or is a
    ``pandas_udf`` for logic that has no built-in equivalent."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    return df.withColumn(new_name or cols[0], func(*[F.col(c) for c in cols]))


def drop_index_columns(df: DataFrame, marker: str = "__index_level_0__") -> DataFrame:
    """Drop pandas index artefacts (columns whose name contains the marker)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if marker not in c])
