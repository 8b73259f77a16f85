"""One-hectare grids of trees and limits on them; sparse cells, so empty ground costs nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(points: DataFrame, volume: Column, basal: Column, side: float = 100.0) -> DataFrame:
    """Trees, volume and basal area (whole numbers) of each occupied cell, by column and row of the grid."""
    keyed = points.select(F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"), volume.alias("v"), basal.alias("b"))
    return keyed.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sum("v").alias("volumen"), F.sum("b").alias("area_basal"))


def cell_statistics(grid: DataFrame) -> DataFrame:
    """Occupied cells, sums and maxima."""
    return grid.agg(F.count("*").alias("celdas"), F.sum("n").alias("n"), F.sum("volumen").alias("volumen"), F.max("n").alias("n_max"), F.max("volumen").alias("volumen_max"))


def cell_means(grid: DataFrame, side: float = 100.0) -> DataFrame:
    """Means a hectare over occupied cells, and the hectares that they cover."""
    ha = side * side / 10000.0
    return grid.agg((F.count("*") * ha).alias("hectareas"), F.bround(F.avg(F.col("n") / ha), 4).alias("densidad"), F.bround(F.avg(F.col("volumen") / ha), 4).alias("intensidad"))


def exceedance(grid: DataFrame, most_volume: int, most_trees: int) -> DataFrame:
    """Cells over a limit, the excess, and the larger of the relative excesses in ten-thousandths; a limit of 0 is off."""
    def over(c: str, limit: int) -> Column:
        return F.greatest(F.col(c) - limit, F.lit(0)) if limit > 0 else F.lit(0).cast("long")

    v, n = over("volumen", most_volume), over("n", most_trees)
    relative = F.greatest(F.floor(v * 10000 / max(most_volume, 1)), F.floor(n * 10000 / max(most_trees, 1)))
    return grid.select("gx", "gy", v.alias("exceso_volumen"), n.alias("exceso_n"), relative.alias("excedencia")).where("exceso_volumen > 0 or exceso_n > 0")


def removed_share(points: DataFrame, basal: Column, harvest: Column, least_cm: int = 30) -> DataFrame:
    """Basal area of trees of at least ``least_cm``, all and harvested, and the share in ten-thousandths."""
    t = points.where(F.col("dap_cm") >= least_cm).select(basal.alias("b"), harvest.alias("h"))
    a, h = F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h"), F.col("b"))), F.lit(0))
    return t.agg(a.alias("total"), h.alias("extraida")).select("total", "extraida", F.floor(F.col("extraida") * 10000 / F.greatest("total", F.lit(1))).alias("parte"))


def abundance(points: DataFrame, hectares: int, least_per_1000_ha: int, least_cm: int = 20) -> DataFrame:
    """Species with fewer trees of at least ``least_cm`` than the limit per 1000 ha."""
    g = points.where(F.col("dap_cm") >= least_cm).groupBy("especie").agg(F.count("*").alias("n"))
    return g.where(F.col("n") * 1000 < least_per_1000_ha * hectares)
