"""Running counts and positions over one order, taken in two steps: within ranges of values, and over the ranges' sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that an order is cut into.
RANGES = 200


def ranged(df: DataFrame, by: Sequence[str], value: str, name: str = "_range") -> DataFrame:
    """Adds the range of each value: how many of its family's ``RANGES`` quantiles are below it. Equal values share a range; null is range 0."""
    marks = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    edges = df.groupBy(*by).agg(F.approx_percentile(F.col(value).cast("double"), marks, F.lit(10_000)).alias("_edges"))
    edges = edges.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_edges")
    found = F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col(value)))
    if not by:
        return df.crossJoin(F.broadcast(edges)).withColumn(name, F.coalesce(found, F.lit(0))).drop("_edges")  # one row
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.join(edges, same).withColumn(name, F.coalesce(found, F.lit(0))).drop("_edges", *[f"_by{i}" for i in range(len(by))])


def running(df: DataFrame, by: Sequence[str], value: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the family with a smaller value; values are distinct within a family."""
    rows = ranged(df, by, value)
    return before(rows, by, [F.col(value)], F.col(amount), name).drop("_range")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], times: str | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours, as ``percentile`` has them) of each family, a column for each share; nulls go.

    ``times`` is how often each row's value stands.

    Values are counted first, then looked up by running counts in two steps, so no task holds the values of a family.
    """
    often = F.col(times).cast("long") if times else F.lit(1).cast("long")
    counts = df.select(*by, F.col(value).cast("double").alias("_q"), often.alias("_c")).dropna(subset=["_q"]).groupBy(*by, "_q").agg(F.sum("_c").alias("_c")).filter("_c > 0")
    ahead = running(counts, by, "_q", "_c", "_ahead")
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n")).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    rows = ahead.join(sizes, same) if by else ahead.crossJoin(F.broadcast(sizes))  # one row
    there = lambda at: F.max(F.when((F.col("_ahead") <= at) & (at < F.col("_ahead") + F.col("_c")), F.col("_q")))
    picks = []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * share
        low, part = there(F.floor(place)), F.max(place - F.floor(place))
        picks.append((low + part * (there(F.ceil(place)) - low)).alias(name))
    return rows.groupBy(*by).agg(*picks)


def before(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows ahead in ``order``, of rows that have their ``_range``."""
    sums = rows.groupBy(*by, "_range").agg(F.sum(amount).alias("_s"))
    ahead = W.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # RANGES rows for each family
    firsts = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_first"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = rows.withColumn("_within", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return within.join(firsts, same).withColumn(name, F.col("_first") + F.col("_within")).drop("_within", "_first", "_r", *[f"_by{i}" for i in range(len(by))])


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Positions from 1 over the whole table: groups in order of their keys, rows of a group in ``order``. A task holds a group at most."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(F.lit(0)).orderBy(*groups).rowsBetween(W.unboundedPreceding, -1)  # a row for each group
    firsts = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(groups)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = df.withColumn("_own", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    return own.join(firsts, same).withColumn(name, (F.col("_own") + F.col("_first")).cast("long")).drop("_own", "_first", *[f"_by{i}" for i in range(len(groups))])
