"""Problem 1: missing measurements filled from similar trees by hierarchical group statistics.

Medians are taken over values on a fixed grid, so each partition sends of a group its distinct steps with their counts, before
any shuffle; no group of rows is ever gathered in one task, however large it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.functions.text import ACCENTED, PLAIN
from silvara.runtime import cut

#: Largest real height in metres and volume in cubic metres.
LIMITS = {"altura_m": 45.0, "volumen_m3": 200.0}


@dataclass(frozen=True)
class FillConfig:
    """Least support of a group, and the grid on which values are counted.

    A filled height is a median on a 0.1 m grid; a filled volume a median on a grid of 2 % steps.
    """

    support: int = 8
    height_step: float = 0.1
    volume_step: float = 0.02


def usable(c: Column, limit: float) -> Column:
    """True where a measurement is not null, not NaN, above 0 and within its real limit."""
    return F.coalesce(~F.isnan(c) & (c > 0) & (c <= limit), F.lit(False))


#: From fine to coarse: comparable trees of the census, of the species, of the census at large, of the month, of all.
LEVELS: tuple[tuple[str, ...], ...] = (("_c", "_e", "_d"), ("_e", "_d"), ("_c", "_e"), ("_e",), ("_c",), ("_m",), ())
FINEST = ("_c", "_e", "_d", "_m")
FIELDS = ("altura_m", "volumen_m3", "volumen_calculado")


def _keyed(tree: DataFrame, cfg: FillConfig) -> DataFrame:
    """fid, the group keys of each tree, and its three values as steps of their grids, null where they are missing."""
    dap = F.when(~F.isnan("dap_m") & (F.col("dap_m") > 0) & (F.col("dap_m") <= 3.5), F.floor(F.col("dap_m") * 10))
    height, volume = F.col("altura_m"), F.col("volumen_m3")
    return tree.select(
        "fid",
        F.coalesce(F.col("censo_id"), F.lit(-1).cast("long")).alias("_c"),
        F.coalesce(F.trim(F.lower(F.translate("especie", ACCENTED + "ñÑ", PLAIN + "nn"))), F.lit("")).alias("_e"),
        F.coalesce(dap, F.lit(-1)).cast("int").alias("_d"),
        F.coalesce(F.year("registrado_ts") * 100 + F.month("registrado_ts"), F.lit(-1)).alias("_m"),
        F.when(usable(height, LIMITS["altura_m"]), F.floor(height / cfg.height_step + 0.5)).cast("int").alias("_altura_m"),
        F.when(usable(volume, LIMITS["volumen_m3"]), F.floor(F.log(volume) / math.log(1 + cfg.volume_step))).cast("int").alias("_volumen_m3"),
        F.col("volumen_calculado").cast("int").alias("_volumen_calculado"),
    )


def _statistics(rows: DataFrame, keys: tuple[str, ...], level: int, support: int) -> DataFrame:
    """One row per group: for each field a struct of its median step (for the flag the more frequent value, true on a tie) and support, null below the least support."""
    middle = {f: F.expr(f"percentile(_{f}, 0.5)") for f in LIMITS} | {"volumen_calculado": F.round(F.avg("_volumen_calculado"))}
    out = rows.groupBy(*keys).agg(*[x for f in FIELDS for x in (middle[f].cast("double").alias(f"_x{f}"), F.count(f"_{f}").alias(f"_n{f}"))])
    least = support if keys else 1
    pick = [F.when(F.col(f"_n{f}") >= least, F.struct(F.col(f"_x{f}").alias("step"), F.lit(level).alias("nivel"), F.col(f"_n{f}").alias("soporte"))).alias(f"_{level}{f}") for f in FIELDS]
    return out.select(*keys, *pick)


def _value(f: str, step: Column, cfg: FillConfig) -> Column:
    """A step of a field's grid as a value."""
    return {"altura_m": step * cfg.height_step, "volumen_m3": F.pow(F.lit(1 + cfg.volume_step), step + 0.5)}.get(f, step)


def fill_cells(tree: DataFrame, cfg: FillConfig = FillConfig()) -> DataFrame:
    """The missing cells of ``tree`` with the value that fills each.

    Columns: fid, campo, valor (double; 1.0 or 0.0 for the flag), nivel (0 the finest group), soporte. A cell takes the median
    or mode of the first of LEVELS with at least ``cfg.support`` usable values; the last level, all rows, needs one.
    Null keys form groups of their own. An empty table gives no rows; a field without any usable value gives its
    cells no row, as nothing can fill them. Extra columns are ignored.
    """
    rows = cut(_keyed(tree, cfg).drop("fid"))
    lacking = F.greatest(*[F.col(f"_{f}").isNull() for f in FIELDS])
    groups = rows.where(lacking).select(*FINEST).distinct()
    for i, keys in enumerate(LEVELS):
        stats = _statistics(rows, keys, i, cfg.support)
        groups = groups.join(stats, list(keys), "left") if keys else groups.join(F.broadcast(stats), how="left")  # one row
    resolved = groups.select(*FINEST, *[F.coalesce(*[f"_{i}{f}" for i in range(len(LEVELS))]).alias(f"_p{f}") for f in FIELDS])
    incomplete = ~usable(F.col("altura_m"), LIMITS["altura_m"]) | ~usable(F.col("volumen_m3"), LIMITS["volumen_m3"]) | F.col("volumen_calculado").isNull()
    missing = _keyed(tree.where(incomplete), cfg).join(resolved, list(FINEST))
    cells = [F.when(F.col(f"_{f}").isNull() & F.col(f"_p{f}").isNotNull(), F.struct(F.lit(f).alias("campo"), _value(f, F.col(f"_p{f}.step"), cfg).alias("valor"), F.col(f"_p{f}.nivel").alias("nivel"), F.col(f"_p{f}.soporte").alias("soporte"))) for f in FIELDS]
    return missing.select("fid", F.explode(F.array_compact(F.array(*cells))).alias("_x")).select("fid", "_x.campo", "_x.valor", "_x.nivel", "_x.soporte")


def fill_table(tree: DataFrame, cfg: FillConfig = FillConfig()) -> DataFrame:
    """``tree`` with its three fields filled, and <field>_lleno and <field>_nivel that mark each filled value.

    All rows and columns of ``tree`` are kept; columns of these names that it already has are replaced. A cell that nothing
    can fill becomes null with a false mark. ``fid`` must be unique.
    """
    cells = fill_cells(tree, cfg)
    wide = cells.groupBy(F.col("fid").alias("_fid")).agg(*[F.first(F.when(F.col("campo") == f, F.struct("valor", "nivel")), ignorenulls=True).alias(f"_fill_{f}") for f in FIELDS])
    out = tree.join(wide, tree["fid"] == wide["_fid"], "left")
    cols = {}
    for f in FIELDS:
        fill = F.col(f"_fill_{f}")
        own = F.when(usable(F.col(f), LIMITS[f]), F.col(f)) if f in LIMITS else F.col(f)
        value = fill["valor"] if f in LIMITS else fill["valor"] == 1.0
        cols[f] = F.coalesce(own, value)
        cols[f"{f}_lleno"] = fill.isNotNull()
        cols[f"{f}_nivel"] = fill["nivel"]
    return out.withColumns(cols).drop("_fid", *[f"_fill_{f}" for f in FIELDS])
