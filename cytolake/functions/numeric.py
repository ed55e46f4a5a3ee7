"""Column helpers with the null, zero and tie rules that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def need(df: DataFrame, *cols: str) -> None:
    """Raises ValueError for a column that ``df`` lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def minus_log(p: Column) -> Column:
    """-ln(p); infinity at 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.ln(p))


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Ascending rank with ties averaged; null for null, and nulls don't count."""
    ordered = W.partitionBy(*by, value.isNull()).orderBy(value)
    ties = W.partitionBy(*by, value)
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def zscore(value: Column, by: Sequence[str], ddof: int = 1, limit: float | None = None, constant: float | None = None) -> Column:
    """(x - mean) / sd within the groups. sd 0: null, or ``constant`` in its place; ``limit`` cuts from above."""
    w = W.partitionBy(*by)
    sd = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(w)
    if constant is not None:
        sd = F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(constant)).otherwise(sd)
    z = ratio(value - F.avg(value).over(w), sd)
    return F.least(z, F.lit(limit)) if limit is not None else z


def rescale(value: Column, by: Sequence[str]) -> Column:
    """To [0, 1] within the groups; 0 where all are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNotNull(), F.coalesce(ratio(value - low, high - low), F.lit(0.0)))


def star(p: Column, levels: Sequence[tuple[float, str]] = ((0.001, "***"), (0.01, "**"), (0.05, "*"))) -> Column:
    """The label of the smallest level that p meets; empty if none."""
    out = F.lit("")
    for level, label in sorted(levels, reverse=True):
        out = F.when(p <= level, F.lit(label)).otherwise(out)
    return out
