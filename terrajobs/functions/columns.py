"""Names of columns that do not clash, and joins on values that may be null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def free_names(wanted: list[str], taken: list[str], suffix: str = "_new") -> dict[str, str]:
    """Each wanted name, with the suffix as often as it takes not to be one of those taken (in any case)."""
    used, out = {t.lower() for t in taken}, {}
    for name in wanted:
        free = name
        while free.lower() in used:
            free += suffix
        used.add(free.lower())
        out[name] = free
    return out


def keyed(small: DataFrame, keys: list[str], mark: str = "_key") -> DataFrame:
    """``small`` with its key columns under names of their own: _key0, _key1, ..."""
    return small.withColumnsRenamed({k: f"{mark}{i}" for i, k in enumerate(keys)})


def meets(keys: list[str | Column], mark: str = "_key") -> Column:
    """Keys of a left side equal those of a ``keyed`` right side, null meeting null."""
    return reduce(and_, ((F.col(k) if isinstance(k, str) else k).eqNullSafe(F.col(f"{mark}{i}")) for i, k in enumerate(keys)))


def attach(df: DataFrame, on: list[Column], small: DataFrame, keys: list[str], values: dict[str, Column], otherwise: dict[str, Column] | None = None, nulls_meet: bool = False) -> DataFrame:
    """All rows and columns of ``df``, whatever their names, with ``values`` of the row of ``small`` whose ``keys`` equal ``on``.

    ``small`` has a row per key. Where none meets, a value is null or what ``otherwise`` says. Nulls meet only where ``nulls_meet``.
    """
    own = df.select(*(df[c].alias(f"_own{i}") for i, c in enumerate(df.columns)), *(e.alias(f"_on{i}") for i, e in enumerate(on)))
    right = small.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(v.alias(f"_value{i}") for i, v in enumerate(values.values())))
    equal = [F.col(f"_on{i}").eqNullSafe(F.col(f"_key{i}")) if nulls_meet else F.col(f"_on{i}") == F.col(f"_key{i}") for i in range(len(on))]
    filled = [F.coalesce(f"_value{i}", (otherwise or {}).get(n, F.lit(None))).alias(n) for i, n in enumerate(values)]
    return own.join(right, reduce(and_, equal), "left").select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)), *filled)


def rows_that(df: DataFrame, on: list[Column], small: DataFrame, keys: list[str], meet: bool = True) -> DataFrame:
    """The rows of ``df``, all columns, whatever their names, for which ``on`` equals the ``keys`` of some row of ``small`` (or of none). Nulls meet."""
    own = df.select(*(df[c].alias(f"_own{i}") for i, c in enumerate(df.columns)), *(e.alias(f"_on{i}") for i, e in enumerate(on)))
    right = small.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    equal = reduce(and_, (F.col(f"_on{i}").eqNullSafe(F.col(f"_key{i}")) for i in range(len(on))))
    return own.join(right, equal, "left_semi" if meet else "left_anti").select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)))
