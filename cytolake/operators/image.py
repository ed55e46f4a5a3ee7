"""Images as long pixels (image, channel, row, col, v) and label masks (image, row, col, label; 0 is background)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import need, ratio, rescale, zscore

_AT = ["image", "row", "col"]


def zonal_mean(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean of each channel over each object."""
    need(mask, *_AT, "label")
    return pixels.join(mask.filter("label <> 0"), _AT).groupBy("image", "label", "channel").agg(F.avg("v").alias("mean_v"))


def region_props(mask: DataFrame) -> DataFrame:
    """Area, centroid, axes and eccentricity of each object, from second central moments."""
    g = mask.filter("label <> 0").groupBy("image", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"), F.var_pop("row").alias("_a"), F.var_pop("col").alias("_c"), F.covar_pop("row", "col").alias("_b")
    )
    root = F.sqrt(F.pow(F.col("_a") - F.col("_c"), F.lit(2.0)) + 4 * F.col("_b") * F.col("_b"))
    g = g.withColumn("_l1", (F.col("_a") + F.col("_c") + root) / 2).withColumn("_l2", F.greatest(F.lit(0.0), (F.col("_a") + F.col("_c") - root) / 2))
    ecc = F.when(F.col("_l1") == 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide("_l2", "_l1"))))
    return g.select("image", "label", "area", "centroid_row", "centroid_col", (4 * F.sqrt("_l1")).alias("major_axis"), (4 * F.sqrt("_l2")).alias("minor_axis"), ecc.alias("eccentricity"))


def _hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of pixel squares, by the monotone chain over their corners."""
    pts = np.unique(np.concatenate([points + d for d in ((-0.5, -0.5), (-0.5, 0.5), (0.5, -0.5), (0.5, 0.5))]), axis=0)

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(pts) + half(pts[::-1]))
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def solidity(mask: DataFrame) -> DataFrame:
    """Area over the area of the convex hull of the pixel squares. Only both ends of each row of an object and their count meet in its group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([pdf[["row", "_lo"]].to_numpy(float), pdf[["row", "_hi"]].to_numpy(float)])
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "label": [int(pdf["label"].iloc[0])], "solidity": [pdf["_n"].sum() / _hull_area(ends)]})

    rows = mask.filter("label <> 0").groupBy("image", F.col("label").cast("int").alias("label"), "row").agg(F.min("col").alias("_lo"), F.max("col").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("image", "label").applyInPandas(run, "image string, label int, solidity double")


def boundary(mask: DataFrame) -> DataFrame:
    """Adds ``boundary``: an object's pixel with a 4-neighbour of another label; the image's edge is no boundary."""
    across, down = W.partitionBy("image", "row").orderBy("col"), W.partitionBy("image", "col").orderBy("row")

    def differs(w, at: str, lag) -> Column:
        side = F.lag if lag else F.lead
        step = -1 if lag else 1
        return F.coalesce((side("label").over(w) != F.col("label")) & (side(at).over(w) == F.col(at) + step), F.lit(False))

    edge = differs(across, "col", True) | differs(across, "col", False) | differs(down, "row", True) | differs(down, "row", False)
    return mask.withColumn("boundary", (F.col("label") != 0) & edge)


def _cut(df: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """Percentile of the non-zero values of each channel, to nine decimals: between two equal values it is that value."""
    return df.groupBy(*keys).agg(F.round(F.expr(f"percentile(CASE WHEN v <> 0 THEN v END, {q})"), 9).alias(name))


def denoise(pixels: DataFrame, percentile: float = 0.98) -> DataFrame:
    """Caps each channel at the percentile of its non-zero values, then zeroes what is below the opposite percentile, taken anew."""
    keys = ["image", "channel"]
    capped = pixels.join(_cut(pixels, keys, percentile, "_hi"), keys).withColumn("v", F.least("v", F.coalesce("_hi", "v"))).drop("_hi")
    low = _cut(capped, keys, 1 - percentile, "_lo")
    return capped.join(low, keys).withColumn("v", F.when(F.col("v") < F.coalesce("_lo", F.lit(0.0)), 0.0).otherwise(F.col("v"))).drop("_lo")


def two_channels(pixels: DataFrame, groups: Mapping[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Nuclear and membrane images: channels rescaled to [0, 1], summed by group, groups rescaled if there are several, summed."""
    several = [out for out, gs in groups.items() if len(gs) > 1]
    named = [(c, out, k) for out, gs in groups.items() for k, g in enumerate(gs) for c in g]
    table = pixels.sparkSession.createDataFrame(named, "channel string, out string, grp int")
    scaled = pixels.withColumn("_s", rescale(F.col("v"), ["image", "channel"])).join(F.broadcast(table), "channel")  # as many rows as the groups name
    by_group = scaled.groupBy("image", "row", "col", "out", "grp").agg(F.sum("_s").alias("_v"))
    again = by_group.withColumn("_v", F.when(F.col("out").isin(*several), rescale(F.col("_v"), ["image", "out", "grp"])).otherwise(F.col("_v")))
    return again.groupBy("image", "row", "col", "out").agg(F.sum("_v").alias("v"))


#: The colours that a channel can be drawn in, as shares of red, green and blue.
COLOURS = {"red": (1, 0, 0), "green": (0, 1, 0), "blue": (0, 0, 1), "yellow": (1, 1, 0), "magenta": (1, 0, 1), "cyan": (0, 1, 1), "white": (1, 1, 1)}


def pseudo_colour(pixels: DataFrame, colours: Mapping[str, str], high: float = 0.99, low: float = 0.1) -> DataFrame:
    """Red, green and blue of each pixel: log2(v + 1), capped and floored at percentiles of non-zero values, to 255, truncated."""
    keys = ["image", "channel"]
    logs = pixels.filter(F.col("channel").isin(*colours)).withColumn("v", F.log2(F.col("v") + 1))
    capped = logs.join(_cut(logs, keys, high, "_hi"), keys).withColumn("v", F.least("v", F.coalesce("_hi", "v"))).drop("_hi")
    floored = capped.join(_cut(capped, keys, low, "_lo"), keys).withColumn("v", F.when(F.col("v") <= F.coalesce("_lo", F.lit(0.0)), 0.0).otherwise(F.col("v")))
    shade = F.coalesce(ratio(F.col("v"), F.max("v").over(W.partitionBy(*keys))), F.lit(0.0)) * 255
    part = F.create_map(*[F.lit(x) for c, name in colours.items() for x in (c, ",".join(map(str, COLOURS[name])))])
    rgb = floored.withColumn("_s", shade).withColumn("_c", F.split(F.element_at(part, F.col("channel")), ","))
    return rgb.groupBy(*_AT).agg(*[F.sum(F.col("_s") * F.get("_c", F.lit(k)).cast("int")).cast("int").alias(n) for k, n in enumerate(("r", "g", "b"))])


def hex_rgb(colour: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3))


def painted(mask: DataFrame, cells: DataFrame, colours: DataFrame, outline: bool = True) -> DataFrame:
    """Colour code (cluster, code) of each pixel's object; background and unknown are 0, boundaries 255."""
    code = cells.join(colours, "cluster").select("image", "label", "code")
    rows = (boundary(mask) if outline else mask.withColumn("boundary", F.lit(False))).join(code, ["image", "label"], "left")
    return rows.select(*_AT, "label", F.when(F.col("boundary"), 255).otherwise(F.coalesce("code", F.lit(0))).cast("int").alias("code"))


def painted_values(mask: DataFrame, cells: DataFrame, value: str, high: float = 0.99, low: float = 0.0) -> DataFrame:
    """Each pixel with its object's value, and whether it is on a boundary; background and unknown are 0.

    Values are capped at the ``high`` quantile of those other than 0; then those up to the ``low`` quantile, taken anew,
    become 0, so the smallest value always does.
    """
    need(cells, "image", "label", value)
    v = cells.select("image", "label", F.col(value).alias("v"))
    capped = v.join(_cut(v, ["image"], high, "_hi"), "image").withColumn("v", F.least("v", F.coalesce("_hi", "v"))).drop("_hi")
    floored = capped.join(_cut(capped, ["image"], low, "_lo"), "image").select("image", "label", F.when(F.col("v") <= F.coalesce("_lo", F.lit(0.0)), 0.0).otherwise(F.col("v")).alias("value"))
    return boundary(mask).join(floored, ["image", "label"], "left").select(*_AT, "label", F.coalesce("value", F.lit(0.0)).alias("value"), "boundary")


def compartments(pixels: DataFrame, cell: DataFrame, nucleus: DataFrame, q: float = 0.99) -> DataFrame:
    """Means over background, cytoplasm and nuclei: each pixel clipped at its own quantile over channels and scaled, then each channel scaled over the three."""
    at = W.partitionBy(*_AT)
    v = pixels.withColumn("v", F.least("v", F.percentile("v", F.lit(q)).over(at)))
    v = v.withColumn("_z", zscore(F.col("v"), _AT, ddof=0))
    region = F.when(F.col("_nuc") != 0, "nuclei").when(F.col("_cell") != 0, "cytoplasm").otherwise("background")
    marked = v.join(cell.select(*_AT, F.col("label").alias("_cell")), _AT).join(nucleus.select(*_AT, F.col("label").alias("_nuc")), _AT)
    g = marked.groupBy("image", "channel", region.alias("region")).agg(F.avg("_z").alias("mean_z"))
    return g.withColumn("z", zscore(F.col("mean_z"), ["image", "channel"], ddof=0))


def without_channels(pixels: DataFrame, removed: Sequence[str]) -> DataFrame:
    """Zeroes the channels and flags what stays for analysis."""
    gone = F.col("channel").isin(*removed)
    return pixels.withColumn("v", F.when(gone, 0.0).otherwise(F.col("v"))).withColumn("for_analysis", ~gone)
