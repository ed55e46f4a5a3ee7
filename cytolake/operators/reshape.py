"""Reshaping of tables, sets of names, and tables of annotated objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import need
from ..functions.order import positions


def melt(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row for each cell of the given columns, as doubles; nulls stay rows."""
    need(wide, *ids, *columns)
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), variable, value)


def transposed(long: DataFrame, row: str, column: str) -> DataFrame:
    """A long matrix with rows and columns exchanged: their names change places."""
    need(long, row, column)
    return long.select(*[F.col({row: column, column: row}.get(c, c)).alias(c) for c in long.columns])


def replicated(df: DataFrame, count: str, copy: str = "copy") -> DataFrame:
    """Every row as often as its count says, numbered from 1; a count below 1 or null gives none."""
    need(df, count)
    return df.filter(F.col(count) >= 1).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def _names(tables: Sequence[tuple[DataFrame, str]]) -> list[DataFrame]:
    return [df.select(F.col(c).cast("string").alias("name")).dropna() for df, c in tables]


def all_names(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct names that any of the (table, column) holds."""
    return reduce(DataFrame.unionByName, _names(tables)).distinct()


def common_names(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct names that all of the (table, column) hold."""
    return reduce(DataFrame.intersect, _names(tables))


def names_without(table: tuple[DataFrame, str], *others: tuple[DataFrame, str]) -> DataFrame:
    """Distinct names of the first that none of the others holds."""
    return reduce(lambda a, b: a.join(b, "name", "left_anti"), _names(others), _names([table])[0].distinct())


def flagged(df: DataFrame, column: str, chosen: Sequence, name: str = "highly_variable") -> DataFrame:
    """A flag for the rows whose value is among the chosen; false for null."""
    return df.withColumn(name, F.coalesce(F.col(column).isin(*chosen), F.lit(False)))


def ordered_by_cluster(labels: DataFrame, item: str = "item", cluster: str = "cluster") -> DataFrame:
    """Items numbered from 1, cluster after cluster. A task holds one cluster's items at most."""
    need(labels, item, cluster)
    return positions(labels.select(item, cluster), [cluster], [F.col(item)])


def totals(df: DataFrame, size: Column, key: str) -> DataFrame:
    """One row: bytes in all, rows, and distinct keys."""
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_distinct"))


def augmented(obs: DataFrame, var: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """Metadata of cells with their identity as ``Idents``, and of features with the genome 1."""
    return obs.withColumn("Idents", F.col(ident).cast("string")), var.withColumn("genome", F.lit(1))


def array_coordinates(spots: DataFrame) -> DataFrame:
    """Array coordinates of spots, under the names that the toolbox gives them: its array_row is the column, its array_col the row."""
    return spots.select("cell_id", F.col("col").alias("array_row"), F.col("row").alias("array_col"))


def spatial_coordinates(images: Mapping[str, DataFrame]) -> DataFrame:
    """(image, cell_id, spatial_0, spatial_1) of all images, one after another, with both coordinates exchanged."""
    parts = [df.select(F.lit(name).alias("image"), "cell_id", F.col("y").alias("spatial_0"), F.col("x").alias("spatial_1")) for name, df in images.items()]
    return reduce(DataFrame.unionByName, parts)


def scale_factors(images: DataFrame) -> DataFrame:
    """Scale factors of an image under their common names; a spot is 0.6196 of the fiducial's diameter."""
    fiducial = F.col("fiducial").cast("double")
    return images.select("image", fiducial.alias("fiducial_diameter_fullres"), F.col("hires").alias("tissue_hires_scalef"), F.col("lowres").alias("tissue_lowres_scalef"), (0.6196 * fiducial).alias("spot_diameter_fullres"))
