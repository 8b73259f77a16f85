"""Raster algebra on cell tables (r, c, value): neighbour joins, distances and cost surfaces."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.runtime import ship

# Cost of crossing a stream by its order, and above the table.
CROSSING_COST = {1: 20.0, 2: 60.0, 3: 200.0, 4: 800.0}
CROSSING_ABOVE = 1500.0


RING = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
#: Cells on a side of a tile.
TILE = 512


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``cells`` by tile (_tr, _tc), those at a tile's rim also in the tiles beside it."""
    places = lambda v: F.array_distinct(F.array(*[F.floor((F.col(v) + k) / tile) for k in (0, -1, 1)]))
    return cells.withColumn("_tr", F.explode(places("r"))).withColumn("_tc", F.explode(places("c")))


def laid(pdf: pd.DataFrame, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights of a tile with a rim of one cell, NaN where there is no cell, and the place of each row."""
    i, j = (pdf["r"] - pdf["_tr"] * tile + 1).to_numpy(), (pdf["c"] - pdf["_tc"] * tile + 1).to_numpy()
    z = np.full((tile + 2, tile + 2), np.nan)
    z[i, j] = pdf["z"]
    return z, i, j


def around(a: np.ndarray, di: int, dj: int) -> np.ndarray:
    """Of each cell within the rim, what the neighbour has."""
    return a[1 + di : a.shape[0] - 1 + di, 1 + dj : a.shape[1] - 1 + dj]


def neighbours(cells: DataFrame, value: str, offsets: Iterable[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """r, c, ``value`` of each cell with ``n``: an array of what its neighbours have, by place in ``offsets`` (of one cell at most), null where there is none. One shuffle by tiles, in which only the cells at rims go twice."""
    offsets = list(offsets)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j = laid(pdf, tile)
        mine = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
        i, j = i[mine], j[mine]
        near = {f"n{k}": z[i + di, j + dj] for k, (di, dj) in enumerate(offsets)}
        return pd.DataFrame({"r": pdf.loc[mine, "r"].to_numpy(), "c": pdf.loc[mine, "c"].to_numpy(), "z": pdf.loc[mine, "z"].to_numpy()} | near)

    src = cells.select("r", "c", F.col(value).cast("double").alias("z"))
    got = ship(tiled(src, tile)).groupBy("_tr", "_tc").applyInPandas(lambda pdf: run(pdf), "r long, c long, z double, " + ", ".join(f"n{k} double" for k in range(len(offsets))))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return got.select("r", "c", clean("z").alias(value), F.array(*[clean(f"n{k}") for k in range(len(offsets))]).alias("n"))


def horn_slope(dem: DataFrame, cell: float) -> DataFrame:
    """Slope in percent by the eight neighbours; a missing one counts as the cell itself. A cell without a height, null or NaN, has none."""
    dem = dem.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    z = {o: F.coalesce(F.get("n", F.lit(k)), F.col("z")) for k, o in enumerate(RING)}
    p = (z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])
    q = (z[1, -1] + 2 * z[1, 0] + z[1, 1]) - (z[-1, -1] + 2 * z[-1, 0] + z[-1, 1])
    p, q = p / (8 * cell), q / (8 * cell)
    return neighbours(dem, "z", RING).select("r", "c", F.when(F.col("z").isNotNull(), F.bround(F.sqrt(p * p + q * q) * 100, 6)).alias("pendiente"))


def wetness_index(dem: DataFrame, accumulation: DataFrame, cell: float) -> DataFrame:
    """R2: ln(max(|accumulation|, 1) * cell / max(slope, 0.001)) with slopes by central differences, one-sided at edges."""
    cross = [(0, -1), (0, 1), (-1, 0), (1, 0)]
    n = [F.get("n", F.lit(k)) for k in range(4)]

    def gradient(a: Column, b: Column) -> Column:
        steps = F.when(a.isNotNull(), 1).otherwise(0) + F.when(b.isNotNull(), 1).otherwise(0)
        return F.when(steps > 0, (F.coalesce(b, F.col("z")) - F.coalesce(a, F.col("z"))) / (steps * cell)).otherwise(0.0)

    gx, gy = gradient(n[0], n[1]), gradient(n[2], n[3])
    slope = F.greatest(F.sqrt(gx * gx + gy * gy), F.lit(0.001))
    j = neighbours(dem, "z", cross).join(accumulation.select("r", "c", "acumulacion"), ["r", "c"])
    return j.select("r", "c", F.bround(F.ln(F.greatest(F.abs("acumulacion"), F.lit(1)) * cell / slope), 6).alias("twi"))


def ramp(v: Column, full: float, none: float) -> Column:
    """1 up to ``full``, 0 from ``none``, straight between."""
    return F.least(F.greatest((none - v) / (none - full), F.lit(0.0)), F.lit(1.0))


def proximity(cells: DataFrame, mask: DataFrame, cell: float, band: float) -> DataFrame:
    """1 on the mask, falling straight to 0 at ``band`` from it. Mask cells are sent to the cells that the band reaches, and meet by minimum, so partial minima shrink the shuffle."""
    k = int(band // cell)
    reach = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(dr * dr + dc * dc).alias("d2")) for dr in range(-k, k + 1) for dc in range(-k, k + 1) if (dr * dr + dc * dc) * cell * cell <= band * band])
    near = mask.select("r", "c", F.explode(reach).alias("o")).groupBy((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).agg(F.min("o.d2").alias("d2"))
    decay = 1 - F.sqrt("d2") * cell / band if band > 0 else F.when(F.col("d2") == 0, 1.0).otherwise(0.0)
    return cells.select("r", "c").join(near, ["r", "c"], "left").select("r", "c", F.bround(F.coalesce(decay, F.lit(0.0)), 6).alias("cercania"))


def role_surfaces(layers: DataFrame) -> DataFrame:
    """Strongest of the weighted layers of each role in each cell; a veto counts whole. Columns r, c, rol, peso, valor."""
    v = F.when(F.col("rol") == "veto", F.when(F.col("valor") >= 1, 1.0).otherwise(0.0)).otherwise(F.col("valor") * F.col("peso"))
    return layers.groupBy("rol", "r", "c").agg(F.max(F.bround(v, 6)).alias("valor"))


def _ring_edges(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """key, x0, y0, x1, y1 of each side of a ring of three corners or more."""
    p = F.col(ring)
    edges = polygons.where(F.size(p) >= 3).select(key, F.posexplode(ring).alias("i", "a"), p.alias("_p"))
    edges = edges.select(key, F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.element_at("_p", F.pmod(F.col("i") + 1, F.size("_p")) + 1).alias("b"))
    return edges.select(key, "x0", "y0", F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def rasterize(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """Cells (r, c) whose centre lies in a polygon, by rows: the crossings of a row's centre line with the edges, in order, bound the runs of cells."""
    edges = _ring_edges(polygons, key, ring).where("y0 <> y1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low / cell - 0.5), F.ceil(high / cell - 0.5) - 1
    rows = edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x = F.col("x0") + ((F.col("r") + 0.5) * cell - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    runs = rows.groupBy(key, "r").agg(F.array_sort(F.collect_list(x)).alias("xs"))  # as many as a ring's edges on one row
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")), lambda i: F.struct(F.ceil(F.get("xs", 2 * i) / cell - 0.5).alias("a"), (F.ceil(F.get("xs", 2 * i + 1) / cell - 0.5) - 1).alias("b")))
    spans = runs.where(F.size("xs") >= 2).select(key, "r", F.explode(pairs).alias("s")).where("s.a <= s.b")
    return spans.select(key, "r", F.explode(F.sequence("s.a", "s.b")).alias("c")).distinct()


def rasterize_touched(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """Cells (r, c) whose square a polygon touches: those that its sides pass through, and those inside, which the centre test finds.

    A square has its lower and left sides and not the others, so each point lies in one cell.
    """
    edges = _ring_edges(polygons, key, ring)
    up = F.col("y0") <= F.col("y1")
    edges = edges.select(key, *[F.when(up, F.col(f"{v}{i}")).otherwise(F.col(f"{v}{1 - i}")).alias(f"{v}{i}") for v in "xy" for i in (0, 1)])
    rows = edges.withColumn("r", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    tall = F.col("y1") - F.col("y0")

    def at(y: Column, end: Column) -> Column:
        return F.coalesce(F.col("x0") + F.try_divide((y - F.col("y0")) * (F.col("x1") - F.col("x0")), tall), end)

    top = (F.col("r") + 1) * cell
    onward = F.col("y1") >= top  # the side goes on in the next row: its place there is not of this one
    rows = rows.select(key, "r", at(F.greatest("y0", F.col("r") * cell), F.col("x0")).alias("a"), at(F.least("y1", top), F.col("x1")).alias("b"), onward.alias("_o"))
    last = F.when(F.col("_o") & (F.col("b") > F.col("a")), F.greatest(F.ceil(F.col("b") / cell) - 1, F.floor(F.col("a") / cell))).otherwise(F.floor(F.greatest("a", "b") / cell))
    rim = rows.select(key, "r", F.explode(F.sequence(F.floor(F.least("a", "b") / cell), last)).alias("c"))
    return rasterize(polygons, key, ring, cell).unionByName(rim).distinct()


def slope_cost(slope: Column, limit: float, weight: float = 1.0, steep: float = 25.0) -> Column:
    """1 + w (s / limit)^2, times ``steep`` above the limit."""
    s = slope / max(limit, 0.1)
    return (1 + weight * s * s) * F.when(slope > limit, steep).otherwise(1.0)


def crossing_cost(order: Column) -> Column:
    """Cost by stream order; above the table the highest, below it the lowest order's."""
    low = min(CROSSING_COST)
    table = reduce(lambda acc, kv: acc.when(order == kv[0], kv[1]), CROSSING_COST.items(), F.when(order > max(CROSSING_COST), CROSSING_ABOVE))
    return F.when(order.isNotNull(), table.otherwise(CROSSING_COST[low])).otherwise(0.0)


def cost_surface(
    slope: DataFrame, wet: DataFrame, exclusion: DataFrame, streams: DataFrame, limit: float = 8.0, ceiling: float = 100000.0,
    area: DataFrame | None = None, veto: DataFrame | None = None, ridge: DataFrame | None = None, outside: float = 6.0, ridge_weight: float = 0.0,
) -> DataFrame:
    """Slope, wetness (x (1 + 1.5 h)), nearness of exclusions (x 8 inside, x (1 + 4 d) around), cells out of ``area`` (x ``outside``, the ceiling if it is as high),
    cells of ``veto`` (the ceiling), nearness of ridges (/ (1 + w d), unless more than 60 % of the cells have over 0.5) and stream crossings (added), kept within 0.01 and
    ``ceiling``. A cell without a slope or cost, null or NaN, has the ceiling.

    Inputs share the grid: pendiente, humedad, cercania, orden; area and veto list cells, ridge has cercania. The order is the reference's, so the ridge discount reaches
    vetoed cells too. Its statistics, warnings and errors, and the finding of ridges with their limit of relief, are not here.
    """
    j = slope.join(wet, ["r", "c"], "left").join(exclusion, ["r", "c"], "left").join(streams, ["r", "c"], "left")
    part = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    near, valid = part("cercania"), F.col("pendiente").isNotNull() & ~F.isnan("pendiente")
    v = slope_cost(F.col("pendiente"), limit) * (1 + 1.5 * F.least(F.greatest(part("humedad"), F.lit(0.0)), F.lit(1.0)))
    v = v * F.when(near >= 1, 8.0).otherwise(1 + 4 * near)
    if area is not None:
        j = j.join(area.select("r", "c", F.lit(True).alias("_in")).distinct(), ["r", "c"], "left")
        v = F.when(F.col("_in").isNotNull(), v).otherwise(F.lit(ceiling) if outside >= ceiling else v * outside)
    if veto is not None:
        j = j.join(veto.select("r", "c", F.lit(True).alias("_veto")).distinct(), ["r", "c"], "left")
        v = F.when(F.col("_veto").isNotNull(), ceiling).otherwise(v)
    if ridge is not None and ridge_weight > 0:
        j = j.join(ridge.select("r", "c", F.col("cercania").alias("_ridge")), ["r", "c"], "left")
        crest = F.least(F.greatest(part("_ridge"), F.lit(0.0)), F.lit(1.0))
        j = j.crossJoin(F.broadcast(j.agg((F.count_if(valid & (crest > 0.5)) <= 0.6 * F.count_if(valid)).alias("_tells"))))
        v = F.when(F.col("_tells"), v / (1 + ridge_weight * crest)).otherwise(v)
    v = v + crossing_cost(F.col("orden"))
    v = F.when(valid & v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.01)), F.lit(ceiling))).otherwise(ceiling)
    return j.select("r", "c", F.bround(v, 4).alias("costo"))


def wet_fusion(
    hand: DataFrame, thematic: DataFrame, twi: DataFrame | None = None, full: float = 2.0, none: float = 8.0, hand_weight: float = 0.6, thematic_weight: float = 1.0,
    hand_floor: float = 0.55, thematic_floor: float = 0.80, twi_from: float = 10.0, twi_weight: float = 0.3,
) -> DataFrame:
    """Wetness and confidence of each cell from terrain and maps: r, c, humedad (0 to 1), nivel (0 none, 1 terrain alone, 2 maps alone, 3 both).

    Terrain falls from 1 at ``full`` metres above drainage to 0 at ``none``; a cell without such a height has 0. ``twi`` adds ``twi_weight`` of a ramp of 4 above ``twi_from``. Maps
    (cercania, already weighted) count 0 where they are missing. Both agree at one half; agreement gives 1, one alone at least its floor.
    """
    j = hand.join(thematic.select("r", "c", "cercania"), ["r", "c"], "left")
    height = F.col("hand")
    land = F.when(height.isNotNull() & ~F.isnan(height), ramp(height, full, none)).otherwise(0.0)
    if twi is not None:
        j = j.join(twi.select("r", "c", "twi"), ["r", "c"], "left")
        land = F.least(F.greatest(land + twi_weight * F.coalesce(ramp(-F.col("twi"), -twi_from - 4.0, -twi_from), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    told = F.coalesce(F.col("cercania"), F.lit(0.0))
    level = (land >= 0.5).cast("int") + 2 * (told >= 0.5).cast("int")
    both = F.greatest(land * hand_weight, told * thematic_weight)
    floor = F.when(level == 3, 1.0).when(level == 2, thematic_floor).when(level == 1, hand_floor).otherwise(0.0)
    return j.select("r", "c", F.bround(F.least(F.greatest(both, floor), F.lit(1.0)), 6).alias("humedad"), level.alias("nivel"))


def wet_summary(fused: DataFrame, hand: DataFrame, cell: float) -> DataFrame:
    """Cells and hectares (3 decimals) of each level, and the median height above drainage of all cells that have one."""
    middle = hand.where(~F.isnan("hand")).agg(F.bround(F.percentile("hand", F.lit(0.5)), 6).alias("hand_mediana"))
    return fused.groupBy("nivel").agg(F.count("*").alias("celdas")).withColumn("hectareas", F.bround(F.col("celdas") * (cell * cell / 10000.0), 3)).join(middle)  # one row


def cost_findings(cost: DataFrame, slope: DataFrame, exclusion: DataFrame, veto: DataFrame, limit: float = 8.0, ceiling: float = 100000.0) -> DataFrame:
    """One row of statistics of a cost surface and its avisos: exclusions over 25 % of the cells (over 60 % an error), vetoes over 40 % (an error), costs that vary by less than 0.15 of
    their mean, slopes over the limit on more than 40 %. Vetoed cells count in the shares and not in the statistics."""
    inside = exclusion.select("r", "c", (F.col("cercania") >= 1).alias("_x"))
    j = cost.join(slope, ["r", "c"], "left").join(inside, ["r", "c"], "left").join(veto.select("r", "c", F.lit(True).alias("_v")).distinct(), ["r", "c"], "left")
    open_ = F.col("costo") < ceiling
    v = F.when(open_, F.col("costo"))
    share = lambda cond: F.count_if(F.coalesce(cond, F.lit(False))) / F.count("*")
    s = j.agg(
        F.count("*").alias("celdas"), F.count_if(~open_).alias("vetadas"), F.min(v).alias("costo_min"), F.max(v).alias("costo_max"), F.bround(F.avg(v), 4).alias("costo_medio"),
        share(F.col("_x")).alias("_px"), share(F.col("_v")).alias("_pv"), share(F.col("pendiente") > limit).alias("_ps"), F.avg(v).alias("_m"),
    )
    spread = F.try_divide(F.col("costo_max") - F.col("costo_min"), F.col("_m"))
    told = [
        F.when(F.col("_px") > 0.6, "error: exclusiones").when(F.col("_px") > 0.25, "exclusiones"), F.when(F.col("_pv") > 0.4, "error: veto"),
        F.when(spread < 0.15, "costo uniforme"), F.when(F.col("_ps") > 0.4, "pendiente"),
    ]
    return s.select("celdas", "vetadas", "costo_min", "costo_max", "costo_medio", F.bround(spread, 4).alias("variacion"), F.array_join(F.array_compact(F.array(*told)), "; ").alias("avisos"))


def grid_template(cells: DataFrame, cell: float) -> DataFrame:
    """The grid that holds all cells: fila0, columna0, filas, columnas, x0, y0 (lower left corner), lado."""
    g = cells.agg(F.min("r").alias("fila0"), F.min("c").alias("columna0"), (F.max("r") - F.min("r") + 1).alias("filas"), (F.max("c") - F.min("c") + 1).alias("columnas"))
    return g.select("*", (F.col("columna0") * cell).alias("x0"), (F.col("fila0") * cell).alias("y0"), F.lit(float(cell)).alias("lado"))


def coregistered(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two rasters fit: comunes, solo_a, solo_b (cells), coinciden. A full join of cells, so nothing that one of them lacks is passed over in silence."""
    j = a.select("r", "c", F.lit(True).alias("_a")).distinct().join(b.select("r", "c", F.lit(True).alias("_b")).distinct(), ["r", "c"], "full_outer")
    both, left, right = F.count_if(F.col("_a") & F.col("_b")), F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return j.agg(both.alias("comunes"), left.alias("solo_a"), right.alias("solo_b"), ((left == 0) & (right == 0)).alias("coinciden"))


def strip_cells(segments: DataFrame, width: str, cell: float) -> DataFrame:
    """Cells (r, c) whose centre lies within half a ``width`` of any segment, each once: strips dissolved. Their number times the cell's area is the real area, to the grain of the cells."""
    reach = F.col(width) / 2
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = segments.withColumn("r", F.explode(F.sequence(F.floor((F.least(y1, y2) - reach) / cell), F.floor((F.greatest(y1, y2) + reach) / cell))))
    # Of a row of cells only the columns that the strip can reach there.
    dy = y2 - y1
    lo, hi = F.col("r") * cell - reach, (F.col("r") + 1) * cell + reach
    at = lambda y: F.coalesce(x1 + F.least(F.greatest(F.try_divide(y - y1, dy), F.lit(0.0)), F.lit(1.0)) * (x2 - x1), x1)
    left = F.when(dy == 0, F.least(x1, x2)).otherwise(F.least(at(lo), at(hi))) - reach
    right = F.when(dy == 0, F.greatest(x1, x2)).otherwise(F.greatest(at(lo), at(hi))) + reach
    cells = rows.withColumn("c", F.explode(F.sequence(F.floor(left / cell), F.floor(right / cell))))
    px, py, dx = (F.col("c") + 0.5) * cell, (F.col("r") + 0.5) * cell, x2 - x1
    l2 = dx * dx + dy * dy
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, l2), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    d2 = (px - x1 - t * dx) * (px - x1 - t * dx) + (py - y1 - t * dy) * (py - y1 - t * dy)
    return cells.where(d2 <= reach * reach).select("r", "c").distinct()
