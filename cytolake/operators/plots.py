"""Plot tables: what a renderer would be handed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import need, ratio
from ..functions.order import positions, quantiles
from .cluster import ordered_levels


def _number(df: DataFrame, order: list, name: str, by: list[str] | None = None) -> DataFrame:
    """Numbers levels from 1; a row per level, not per observation."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long"))


def first_appearance(df: DataFrame, level: str, order: str, name: str = "idx") -> DataFrame:
    """Levels numbered by where they appear first."""
    return _number(df.groupBy(level).agg(F.min(order).alias("_o")), ["_o", level], name).drop("_o")


def linked_layout(links: DataFrame, left: str, right: str, order: str, align: str = "bottom") -> tuple[DataFrame, DataFrame]:
    """Points (side, name, y) of both columns and segments (y1, y2); heights are shares of the longer side, from 0."""
    need(links, left, right, order)
    a, b = first_appearance(links, left, order), first_appearance(links, right, order)
    n = a.agg(F.count(F.lit(1)).alias("_l1")).crossJoin(b.agg(F.count(F.lit(1)).alias("_l2"))).withColumn("_l", F.greatest("_l1", "_l2"))
    i, l1, l2, whole = F.col("idx") - 1, F.col("_l1") - 1, F.col("_l2") - 1, F.col("_l").cast("double")
    shift = {"bottom": F.lit(0.0), "top": (l1 - l2).cast("double"), "center": (l1 - l2) / 2.0}
    if align not in shift:
        raise ValueError(f"align {align!r}")
    pa = a.crossJoin(F.broadcast(n)).select(F.lit("left").alias("side"), F.col(left).alias("name"), (i / whole).alias("y"))
    pb = b.crossJoin(F.broadcast(n)).select(F.lit("right").alias("side"), F.col(right).alias("name"), ((i + shift[align]) / whole).alias("y"))
    segments = links.select(left, right).distinct().join(pa.select(F.col("name").alias(left), F.col("y").alias("y1")), left).join(pb.select(F.col("name").alias(right), F.col("y").alias("y2")), right)
    return pa.unionByName(pb), segments.select(F.col(left).alias("left"), F.col(right).alias("right"), F.lit(2).alias("x1"), F.lit(3).alias("x2"), "y1", "y2")


def colour_stops(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Minimum, n points spaced evenly from the 1st to the 99th percentile, maximum; also rescaled to [0, 1]."""
    s = quantiles(df, [], value, {"lo": 0.0, "q1": 0.01, "q9": 0.99, "hi": 1.0})
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("q1") + (F.col("q9") - F.col("q1")) * k / max(1, n - 1))
    stops = F.concat(F.array("lo"), inner, F.array("hi"))
    return s.select("lo", "hi", F.posexplode(stops).alias("stop", "value")).select(F.col("stop").cast("long").alias("stop"), "value", F.coalesce(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("scaled"))


def sunburst(df: DataFrame, dims: list[str], value: str, radii: list[float] | None = None) -> DataFrame:
    """(ring, dim, level, ymin, ymax, xmin, xmax): rings by rising cardinality, levels in first appearance of the sorted rows, angles cumulated."""
    need(df, value, *dims)
    card = df.agg(*[F.countDistinct(d).alias(d) for d in dims]).first()
    order = sorted(dims, key=lambda d: card[d])
    rows = df.groupBy(*order).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_v"))  # one row per combination
    rows = _number(rows, order, "_o")
    radii = radii or [1.0] * len(order)
    out = None
    for k, d in enumerate(order):
        level = rows.groupBy(F.col(d).cast("string").alias("level")).agg(F.sum("_v").cast("double").alias("_n"), F.min("_o").alias("_f"))
        top = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(W.unboundedPreceding, 0))
        one = level.select(F.lit(k + 1).alias("ring"), F.lit(d).alias("dim"), "level", (top - F.col("_n")).alias("ymin"), top.alias("ymax"), F.lit(float(sum(radii[:k]))).alias("xmin"), F.lit(float(sum(radii[: k + 1]))).alias("xmax"))
        out = one if out is None else out.unionByName(one)
    return out


def circular_layout(nodes: DataFrame, node: str, community: str, radius: float = 20.0, k: float = 0.5) -> DataFrame:
    """Communities 1..C on a circle, their m nodes on a circle of radius k m around its centre."""
    c = nodes.agg(F.max(community).alias("_c"))
    own = W.partitionBy(community)
    j, m = F.row_number().over(own.orderBy(node)), F.count(F.lit(1)).over(own)
    rows = nodes.select(node, community, j.alias("_j"), m.alias("_m")).crossJoin(F.broadcast(c))
    centre, angle = 2 * F.pi() * (F.col(community) - 1) / F.col("_c"), 2 * F.pi() * (F.col("_j") - 1) / F.col("_m")
    at = lambda f: radius * f(centre) + k * F.col("_m") * f(angle)
    return rows.select(node, community, at(F.cos).alias("x"), at(F.sin).alias("y"))


def condition_matrix(df: DataFrame, x: str, group: str, variable: str, value: str) -> DataFrame:
    """Rows named x_group in order of x, then group, with the mean of each variable; long, for a pivot at the sink."""
    g = df.groupBy(x, group, variable).agg(F.avg(value).alias("value"))
    levels = _number(g.select(x, group).distinct(), [x, group], "row_order")
    return g.join(levels, [x, group]).select(F.concat_ws("_", F.col(x).cast("string"), F.col(group).cast("string")).alias("row_key"), "row_order", F.col(variable).cast("string").alias("variable"), "value")


def wide(long: DataFrame, row: str, column: str, value: str, columns: list, fill: float | None = None) -> DataFrame:
    """Pivot over given levels; ``fill`` for empty cells."""
    out = long.groupBy(row).pivot(column, columns).agg(F.first(value))
    return out.fillna(fill) if fill is not None else out


def annotated_order(df: DataFrame, item: str, *annotations: str) -> DataFrame:
    """Items numbered by their annotation columns; a task holds the items that share all annotations."""
    return positions(df.select(item, *annotations).distinct(), list(annotations), [F.col(item)])


def ordered_plot(df: DataFrame, x: str, y: str, value: str, cluster_var: str | None = None, rows: bool = True, columns: bool = True, method: str = "complete") -> DataFrame:
    """(axis, item, position): the order of the levels of ``y`` and of ``x``, by trees over each other's levels, or over those of ``cluster_var``."""
    if not rows and not columns:
        raise ValueError("neither rows nor columns are ordered")
    out = None
    for axis, own, other in (("row", y, x), ("column", x, y)):
        if rows if axis == "row" else columns:
            one = ordered_levels(df, own, cluster_var or other, value, method).select(F.lit(axis).alias("axis"), "item", "position")
            out = one if out is None else out.unionByName(one)
    return out


def selected(df: DataFrame, gene: str, chosen: list) -> DataFrame:
    return df.withColumn("selected", F.col(gene).isin(*chosen))


def title(column: Column) -> Column:
    return F.initcap(column)
