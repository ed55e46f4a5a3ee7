"""Multiplicity adjustment of p-values within groups; nulls stay null and do not count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numeric import need
from .order import before, ranged

METHODS = ("bh", "by", "bonferroni", "holm", "hochberg", "none")


def _factors(method: str, i: Column, n: Column) -> tuple[Column, str | None]:
    """What a p-value is multiplied by at rank i of n, and which way its running extreme goes."""
    if method in ("bh", "by"):
        harmonic = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1.0)), F.lit(float(_EXACT))).cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
        # beyond _EXACT terms by the Euler-Maclaurin series, which is exact to the last digits there
        rest = F.when(n > _EXACT, F.ln(n / _EXACT) + (1 / n - 1.0 / _EXACT) / 2 - (1 / (n * n) - 1.0 / _EXACT**2) / 12).otherwise(0.0)
        return n / i * (harmonic + rest if method == "by" else F.lit(1.0)), "down"
    if method in ("hochberg", "holm"):
        return n - i + 1, "down" if method == "hochberg" else "up"
    return (n if method == "bonferroni" else F.lit(1.0)), None


_EXACT = 1000


def adjust(df: DataFrame, p: str, method: str = "bh", by: Sequence[str] = (), out: str = "p_adj", tie: str | None = None) -> DataFrame:
    """Adds adjusted p-values. ``by`` are the families, each ranked by one task; with none, the whole table is one family,
    and ranks and running extremes are taken in two steps over ranges of p-values."""
    need(df, p, *by)
    method = {"fdr": "bh"}.get(method.lower(), method.lower())
    if method not in METHODS:
        raise ValueError(f"method {method!r}; there are {', '.join(METHODS)}")
    x = F.col(p).cast("double")
    order = [x] + ([F.col(tie)] if tie else [])
    if by:
        family = W.partitionBy(*by, F.col(p).isNull())
        df = df.withColumn("_n", F.count(p).over(family).cast("double")).withColumn("_i", F.row_number().over(family.orderBy(*order)).cast("double"))
        factor, way = _factors(method, F.col("_i"), F.col("_n"))
        value = x * factor
        if way == "down":
            value = F.min(value).over(family.orderBy(F.col("_i").desc()).rowsBetween(W.unboundedPreceding, 0))
        elif way == "up":
            value = F.max(value).over(family.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), value))).drop("_n", "_i")
    known = ranged(df.filter(F.col(p).isNotNull()), [], p)
    n = known.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = before(known, [], order, F.lit(1), "_i").crossJoin(F.broadcast(n))  # one row
    factor, way = _factors(method, F.col("_i") + 1.0, F.col("_n"))
    rows = rows.withColumn("_v", x * factor)
    value = F.col("_v")
    if way:
        pick, best = (F.min, F.least) if way == "down" else (F.max, F.greatest)
        whole = rows.groupBy("_range").agg(pick("_v").alias("_e"))
        beyond = W.partitionBy(F.lit(0)).orderBy(F.col("_range").desc() if way == "down" else F.col("_range")).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows
        ends = whole.select(F.col("_range").alias("_r"), pick("_e").over(beyond).alias("_e"))
        own = W.partitionBy("_range").orderBy(F.col("_i").desc() if way == "down" else F.col("_i")).rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("_own", pick("_v").over(own)).join(F.broadcast(ends), F.col("_range") == F.col("_r"))
        value = best("_own", F.coalesce("_e", "_own"))
    kept = rows.select(*df.columns, F.least(F.lit(1.0), value).alias(out))
    return kept.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
