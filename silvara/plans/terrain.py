"""Queries of the spatial, grid, network and routing operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.functions.lookup import floor_lookup
from silvara.operators import allocation, flow, grid, raster, routing, spatial
from silvara.plans.fixtures import ctes, view
from silvara.runtime import cut
from silvara.sources import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
KEYS = ", ".join(KEY)
WIDTHS, ABOVE = {1: 10.0, 2: 15.0, 3: 25.0, 4: 50.0}, 50.0
VOLUME, BASAL = "dap_cm * dap_cm * hc_m", "dap_cm * dap_cm"
CELL = 30.0


def _cells(s: SparkSession, d: str) -> DataFrame:
    return grid.cells(view(s, d, "puntos"), F.expr(VOLUME), F.expr(BASAL))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "tramos").withColumn("ancho", floor_lookup(F.col("sid") % 6, WIDTHS, ABOVE) * 4)


def riparian_class(s: SparkSession, d: str) -> DataFrame:
    return spatial.strip_class(view(s, d, "puntos"), _segments(s, d), KEY, "ancho")


def riparian_volume(s: SparkSession, d: str) -> DataFrame:
    """Trees and volume of each strip. Rows of one key are added up first, so that they need not be met again; a row without a whole key has no strip."""
    p = view(s, d, "puntos").dropna(subset=KEY).groupBy(*KEY, "x", "y").agg(F.count("*").alias("n"), F.sum(F.expr(VOLUME)).alias("volumen"))
    return spatial.strip_class(p, _segments(s, d), [*KEY, "n", "volumen"], "ancho").groupBy("ancho").agg(F.sum("n").alias("n"), F.sum("volumen").alias("volumen"))


def _crossings(s: SparkSession, d: str, proper: bool = True, meet: bool = True) -> DataFrame:
    t = view(s, d, "tramos").select("sid", "x1", "y1", "x2", "y2")
    return spatial.crossing_pairs(t, t.withColumnRenamed("sid", "sid2"), "sid", "sid2", proper=proper, once=True, places=False, meet=meet)


def ring_snap(s: SparkSession, d: str) -> DataFrame:
    free = (F.pmod(F.floor(F.col("qx") / 100), F.lit(2)) == 0) & (F.pmod(F.floor(F.col("qy") / 100), F.lit(2)) == 0)
    return spatial.snap_to_ring(view(s, d, "patios"), "patio_id", free)


def _dem(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "dem")


def _channel(s: SparkSession, d: str) -> DataFrame:
    return _dem(s, d).where("c = 32").select("r", "c")


def _drains(s: SparkSession, d: str) -> DataFrame:
    return flow.drainage(_dem(s, d), CELL)


def role_surfaces(s: SparkSession, d: str) -> DataFrame:
    near = raster.proximity(_dem(s, d), _channel(s, d), CELL, 150.0)
    mask = _channel(s, d).withColumn("valor", F.lit(1.0))
    layers = near.select("r", "c", F.lit("humedad").alias("rol"), F.lit(0.85).alias("peso"), F.col("cercania").alias("valor")).unionByName(mask.select("r", "c", F.lit("veto").alias("rol"), F.lit(1.0).alias("peso"), "valor"))
    return raster.role_surfaces(layers)


def cost_surface(s: SparkSession, d: str, **more: DataFrame | float) -> DataFrame:
    slope = raster.horn_slope(_dem(s, d), CELL)
    wet = _dem(s, d).select("r", "c", raster.ramp(2.0 * F.abs(F.col("c") - 32), 2.0, 8.0).alias("humedad"))
    order = _channel(s, d).select("r", "c", (1 + F.col("r") % 5).alias("orden"))
    return raster.cost_surface(slope, wet, raster.proximity(_dem(s, d), _channel(s, d), CELL, 150.0), order, **more)


def cost_surface_limits(s: SparkSession, d: str) -> DataFrame:
    """With a work area, a veto and ridges."""
    dem = _dem(s, d)
    ridge = raster.proximity(dem, dem.where("c in (0, 63)").select("r", "c"), CELL, 60.0)
    return cost_surface(s, d, area=dem.where("c between 4 and 59"), veto=dem.where("r between 20 and 23 and c > 40"), ridge=ridge, ridge_weight=0.5)


def _graph(s: SparkSession, d: str, order: int) -> DataFrame:
    cells = _dem(s, d).withColumn("costo", 1.0 + F.col("c") % 3)
    return routing.edges(cells, CELL, order).select("r", "c", "r2", "c2", F.bround(routing.weight(), 4).alias("w"), F.bround("grade", 6).alias("grade"))


def smoothed_lines(s: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    line = F.array(p("x1", "y1"), p("x2", "y2"), p("x1", "y2"))
    out = view(s, d, "tramos").select("sid", F.posexplode(routing.chaikin(line)).alias("i", "p"))
    return out.select("sid", F.col("i").cast("long").alias("i"), F.bround("p.x", 4).alias("x"), F.bround("p.y", 4).alias("y"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    trees = view(s, d, "puntos").select(F.xxhash64(*KEY).alias("key"), "x", "y", F.expr(f"({VOLUME}) / 100000.0").cast("double").alias("v"))
    return allocation.assign(trees, view(s, d, "patios"), 150.0, 350.0)


def yard_invariants(s: SparkSession, d: str) -> DataFrame:
    """What an assignment must hold: every tree once, none beyond the radius, no site beyond its capacity, and no orphan that a site with room could take."""
    a = cut(_assigned(s, d))
    trees = view(s, d, "puntos").select(F.xxhash64(*KEY).alias("key"), "x", "y", F.expr(f"({VOLUME}) / 100000.0").cast("double").alias("v"))
    load = a.where("patio_id > 0").join(trees.select("key", "v"), "key").groupBy("patio_id").agg(F.sum("v").alias("l"))
    lost = trees.join(a.where("patio_id = -1").select("key"), "key", "left_semi")
    missed = spatial.within(lost, view(s, d, "patios"), 150.0).join(load, "patio_id", "left").where(F.coalesce("l", F.lit(0.0)) + F.col("v") <= 350.0 - 1e-6)
    return a.agg(F.count("*").alias("arboles"), F.count_if(F.col("dist") > 150).alias("fuera")).join(load.agg(F.count_if(F.col("l") > 350.0 + 1e-6).alias("rebasados"))).join(missed.agg(F.count("*").alias("olvidados")))


def network_cycles(s: SparkSession, d: str) -> DataFrame:
    """H8: segments on a cycle, which have no order: the network with its outlet turned into the seventh segment."""
    t = view(s, d, "tramos").withColumn("down_sid", F.when(F.col("sid") == 1, F.lit(7).cast("long")).otherwise(F.col("down_sid")))
    return flow.stream_orders(t).where("strahler is null").select("sid")


def centre_scenarios(s: SparkSession, d: str) -> DataFrame:
    sites = view(s, d, "patios").select(F.col("patio_id").alias("key"), "px", "py", (1 + F.col("patio_id") % 7).cast("double").alias("w"))
    return allocation.center_scenarios(sites, (1, 2, 3))


def scenario_savings(s: SparkSession, d: str) -> DataFrame:
    """Moment of each scenario and what it saves against the one before."""
    from pyspark.sql import Window

    m = centre_scenarios(s, d).groupBy("n").agg(F.sum("momento").alias("momento"))
    return m.withColumn("ahorro", F.lag("momento").over(Window.orderBy("n")) - F.col("momento"))


QUERIES = {
    "intensity_grid": _cells,
    "intensity_stats": lambda s, d: grid.cell_statistics(_cells(s, d)),
    "limit_exceedance": lambda s, d: grid.exceedance(_cells(s, d), 200_000, 12),
    "basal_area": lambda s, d: grid.removed_share(view(s, d, "puntos"), F.expr(BASAL), F.expr("categoria <> 'SEMILLERO'")),
    "species_abundance": lambda s, d: grid.abundance(view(s, d, "puntos"), 10_000, 250_000),
    "yard_candidates": lambda s, d: spatial.within(view(s, d, "puntos"), view(s, d, "patios"), 400.0).select(*KEY, "patio_id", spatial.rounded(F.col("d2")).alias("d2")),
    "nearest_center": lambda s, d: spatial.nearest(view(s, d, "puntos"), view(s, d, "tramos").select("sid", F.col("x1").alias("px"), F.col("y1").alias("py")), KEY[0], "sid").groupBy("sid").agg(F.count("*").alias("n")),
    "riparian_class": riparian_class,
    "riparian_volume": riparian_volume,
    "crossing_pairs": lambda s, d: _crossings(s, d, meet=False).select("sid", "sid2"),
    "crossing_points": lambda s, d: spatial.crossing_points(_crossings(s, d), "sid", "sid2"),
    "meeting_pairs": lambda s, d: _crossings(s, d, False, False).select("sid", "sid2"),
    "meeting_points": lambda s, d: spatial.crossing_points(_crossings(s, d, False), "sid", "sid2"),
    "weighted_centroid": lambda s, d: spatial.weighted_centers(view(s, d, "puntos"), "especie", F.floor(F.col("x") * 100 + 0.5), F.floor(F.col("y") * 100 + 0.5), F.col("dap_cm")),
    "segment_azimuth": lambda s, d: view(s, d, "tramos").select("sid", F.bround(spatial.azimuth(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("azimut"), floor_lookup(F.col("sid") % 6, WIDTHS, ABOVE).alias("ancho")),
    "ring_snap": ring_snap,
    "slope_horn": lambda s, d: raster.horn_slope(_dem(s, d), CELL),
    "proximity_decay": lambda s, d: raster.proximity(_dem(s, d), _channel(s, d), CELL, 150.0),
    "role_surfaces": role_surfaces,
    "cost_surface": cost_surface,
    "cost_surface_limits": cost_surface_limits,
    "wetness_index": lambda s, d: raster.wetness_index(_dem(s, d), _dem(s, d).select("r", "c", (1 + F.col("r")).alias("acumulacion")), CELL),
    "zone_cells": lambda s, d: raster.rasterize(table(s, d, "zones"), "zona_id", "ring", 10.0),
    "zone_cells_touched": lambda s, d: raster.rasterize_touched(table(s, d, "zones"), "zona_id", "ring", 10.0),
    "drainage": _drains,
    "flow_accumulation": lambda s, d: flow.accumulation(_drains(s, d)),
    "hand": lambda s, d: flow.height_above_drainage(_dem(s, d), _drains(s, d), _channel(s, d)),
    "filled_dem": lambda s, d: flow.fill_depressions(_dem(s, d)),
    "stream_shreve": lambda s, d: flow.stream_orders(view(s, d, "tramos")).select("sid", "shreve"),
    "stream_strahler": lambda s, d: flow.stream_orders(view(s, d, "tramos")).select("sid", "strahler"),
    "network_diagnostics": lambda s, d: flow.diagnostics(view(s, d, "tramos")),
    "components": lambda s, d: flow.components(table(s, d, "supplier").select(F.col("s_suppkey").alias("u"), (F.lit(10**9) + F.col("s_nationkey")).alias("v")), "u", "v"),
    "node_keys": lambda s, d: view(s, d, "tramos").select("sid", flow.node_key(F.col("x1"), 0.5).alias("kx"), flow.node_key(F.col("y1"), 0.5).alias("ky")),
    "edge_weights": lambda s, d: _graph(s, d, 2),
    "least_cost": lambda s, d: routing.least_costs(_graph(s, d, 4), _channel(s, d)),
    "least_cost_values": lambda s, d: routing.least_costs(_graph(s, d, 1), _channel(s, d)).select("r", "c", F.bround("costo", 3).alias("costo")),
    "network_cycles": network_cycles,
    "smoothed_lines": smoothed_lines,
    "yard_plan": _assigned,
    "yard_invariants": yard_invariants,
    "centre_scenarios": centre_scenarios,
    "scenario_savings": scenario_savings,
}

_DIST2 = "({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by})"
_W = "(case when sid % 6 > 4 then 50.0 when sid % 6 >= 4 then 50.0 when sid % 6 >= 3 then 25.0 when sid % 6 >= 2 then 15.0 else 10.0 end)"
_GRID = f"select cast(floor(x / 100.0) as bigint) as gx, cast(floor(y / 100.0) as bigint) as gy, count(*) as n, cast(sum({VOLUME}) as bigint) as volumen, cast(sum({BASAL}) as bigint) as area_basal from puntos group by all"
_T = "(case when l2 > 0 then least(greatest(((x - x1) * dx + (y - y1) * dy) / l2, 0.0), 1.0) else 0.0 end)"
_STRIP = f"""select {KEYS}, max(ancho) as ancho from (
    select *, {_T} as t from (select p.*, s.*, {_W} * 4 as ancho, x2 - x1 as dx, y2 - y1 as dy, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) as l2 from puntos p, tramos s
        where p.x between least(x1, x2) - 200 and greatest(x1, x2) + 200 and p.y between least(y1, y2) - 200 and greatest(y1, y2) + 200))
    where {_DIST2.format(ax='x', bx='(x1 + t * dx)', ay='y', by='(y1 + t * dy)')} <= ancho * ancho group by {KEYS}"""


def _turn(a: str, b: str, c: str) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


_A1, _A2, _B1, _B2 = (("a.x1", "a.y1"), ("a.x2", "a.y2"), ("b.x1", "b.y1"), ("b.x2", "b.y2"))
_CROSS = f"from tramos a join tramos b on a.sid < b.sid and {_turn(_A1, _A2, _B1)} * {_turn(_A1, _A2, _B2)} < 0 and {_turn(_B1, _B2, _A1)} * {_turn(_B1, _B2, _A2)} < 0"
_CT = "((a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2)) / ((a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2))"


def _touch(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"({_turn(a, b, c)} = 0 and {c[0]} between least({a[0]}, {b[0]}) and greatest({a[0]}, {b[0]}) and {c[1]} between least({a[1]}, {b[1]}) and greatest({a[1]}, {b[1]}))"


_MEET = f"from tramos a join tramos b on a.sid < b.sid and ({_turn(_A1, _A2, _B1)} * {_turn(_A1, _A2, _B2)} < 0 and {_turn(_B1, _B2, _A1)} * {_turn(_B1, _B2, _A2)} < 0 or {_touch(_A1, _A2, _B1)} or {_touch(_A1, _A2, _B2)} or {_touch(_B1, _B2, _A1)} or {_touch(_B1, _B2, _A2)})"


def _z(dr: int, dc: int) -> str:
    return f"coalesce((select n.z from dem n where n.r = m.r + {dr} and n.c = m.c + {dc}), m.z)"


_SLOPE = f"""select r, c, round_even(sqrt(p * p + q * q) * 100, 6) as pendiente from (select r, c,
    (({_z(-1, 1)} + 2 * {_z(0, 1)} + {_z(1, 1)}) - ({_z(-1, -1)} + 2 * {_z(0, -1)} + {_z(1, -1)})) / (8 * 30.0::double) as p,
    (({_z(1, -1)} + 2 * {_z(1, 0)} + {_z(1, 1)}) - ({_z(-1, -1)} + 2 * {_z(-1, 0)} + {_z(-1, 1)})) / (8 * 30.0::double) as q from dem m)"""
_NEAR = "select r, c, round_even(case when abs(c - 32) <= 5 then 1 - sqrt((c - 32) * (c - 32)::double) * 30.0 / 150.0 else 0.0 end, 6) as cercania from dem"
_STEPS = ", ".join(f"({k}, {a}, {b}, {30.0 * (math.sqrt(2) if a and b else 1.0)!r}::double)" for k, (a, b) in enumerate(raster.RING))
_DRAIN = f"""drena as (select m.r, m.c, n.r as nr, n.c as nc from dem m left join lateral (
    select n.r, n.c from (values {_STEPS}) o(k, a, b, f) join dem n on n.r = m.r + o.a and n.c = m.c + o.b where m.z > n.z order by (m.z - n.z) / o.f desc, o.k limit 1) n on true)"""
_OFFSETS = ", ".join(f"({a}, {b}, {math.hypot(a, b) * CELL!r}::double)" for a, b in routing.neighbourhood(2))

SQL = {
    "intensity_grid": f"{ctes('puntos')} {_GRID}",
    "intensity_stats": f"{ctes('puntos')}, g as ({_GRID}) select count(*) as celdas, cast(sum(n) as bigint) as n, cast(sum(volumen) as bigint) as volumen, max(n) as n_max, max(volumen) as volumen_max from g",
    "limit_exceedance": f"{ctes('puntos')}, g as ({_GRID}), e as (select gx, gy, greatest(volumen - 200000, 0) as exceso_volumen, greatest(n - 12, 0) as exceso_n from g) select *, greatest(cast(floor(exceso_volumen * 10000 / 200000) as bigint), cast(floor(exceso_n * 10000 / 12) as bigint)) as excedencia from e where exceso_volumen > 0 or exceso_n > 0",
    "basal_area": f"{ctes('puntos')}, t as (select cast(sum({BASAL}) as bigint) as total, cast(sum({BASAL}) filter (categoria <> 'SEMILLERO') as bigint) as extraida from puntos where dap_cm >= 30) select total, extraida, cast(floor(extraida * 10000 / total) as bigint) as parte from t",
    "species_abundance": f"{ctes('puntos')} select especie, count(*) as n from puntos where dap_cm >= 20 group by especie having count(*) * 1000 < 2500000000",
    "yard_candidates": f"{ctes('puntos', 'patios')} select {KEYS}, patio_id, round_even(d2, 4) as d2 from (select *, {_DIST2.format(ax='x', bx='px', ay='y', by='py')} as d2 from puntos join patios on x between px - 400 and px + 400) where d2 <= 160000",
    "nearest_center": f"{ctes('puntos', 'tramos')}, d as (select {KEYS}, sid, row_number() over (partition by {KEYS}, x, y order by {_DIST2.format(ax='x', bx='x1', ay='y', by='y1')}, sid) as k from puntos, tramos) select sid, count(*) as n from d where k = 1 group by sid",
    "riparian_class": f"{ctes('puntos', 'tramos')} {_STRIP}",
    "riparian_volume": f"{ctes('puntos', 'tramos')}, f as ({_STRIP}) select ancho, count(*) as n, cast(sum({VOLUME}) as bigint) as volumen from f join puntos using ({KEYS}) group by ancho",
    "crossing_pairs": f"{ctes('tramos')} select a.sid, b.sid as sid2 {_CROSS}",
    "crossing_points": f"{ctes('tramos')} select a.sid, b.sid as sid2, round_even(a.x1 + {_CT} * (a.x2 - a.x1), 4) as este, round_even(a.y1 + {_CT} * (a.y2 - a.y1), 4) as norte {_CROSS}",
    "meeting_pairs": f"{ctes('tramos')} select a.sid, b.sid as sid2 {_MEET}",
    "weighted_centroid": f"{ctes('puntos')} select especie, cast(sum(dap_cm) as bigint) as peso, round_even(sum(dap_cm * cast(floor(x * 100 + 0.5) as bigint))::double / sum(dap_cm), 4) as cx, round_even(sum(dap_cm * cast(floor(y * 100 + 0.5) as bigint))::double / sum(dap_cm), 4) as cy from puntos group by especie",
    "segment_azimuth": f"{ctes('tramos')} select sid, round_even(((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 + 360) % 360, 6) as azimut, cast({_W} as double) as ancho from tramos",
    "ring_snap": f"""{ctes('patios')}, o as (select 0 as ring, 0 as i, 0.0::double as ox, 0.0::double as oy union all
        select k, i, cos(i / (8.0::double * k) * 2 * 3.141592653589793::double) * k * 25.0::double, sin(i / (8.0::double * k) * 2 * 3.141592653589793::double) * k * 25.0::double from range(1, 9) a(k), range(0, 64) b(i) where i < 8 * k),
        t as (select patio_id, ring, i, px + ox as qx, py + oy as qy from patios, o),
        f as (select *, row_number() over (partition by patio_id order by ring, i) as n from t where floor(qx / 100) % 2 = 0 and floor(qy / 100) % 2 = 0)
        select p.patio_id, cast(f.ring as integer) as anillo, cast(f.i as integer) as i, round_even(qx, 4) as qx, round_even(qy, 4) as qy from patios p left join f on p.patio_id = f.patio_id and n = 1""",
    "slope_horn": f"{ctes('dem')} {_SLOPE}",
    "proximity_decay": f"{ctes('dem')} {_NEAR}",
    "role_surfaces": f"{ctes('dem')}, n as ({_NEAR}) select 'humedad' as rol, r, c, round_even(cercania * 0.85::double, 6) as valor from n union all select 'veto', r, c, 1.0 from dem where c = 32",
    "cost_surface": f"""{ctes('dem')}, s as ({_SLOPE}), n as ({_NEAR}),
        j as (select r, c, pendiente, cercania, least(greatest((8.0 - 2.0 * abs(c - 32)) / 6.0::double, 0.0), 1.0) as h, case when c = 32 then 1 + r % 5 end as o from s join n using (r, c))
        select r, c, round_even(least(greatest((1 + pendiente / 8.0 * (pendiente / 8.0)) * (case when pendiente > 8.0 then 25.0 else 1.0 end) * (1 + 1.5 * h) * (case when cercania >= 1 then 8.0 else 1 + 4 * cercania end)
            + (case o when 1 then 20.0 when 2 then 60.0 when 3 then 200.0 when 4 then 800.0 when 5 then 1500.0 else 0.0 end), 0.01), 100000.0), 4) as costo from j""",
    "wetness_index": f"""{ctes('dem')}, g as (select m.r, m.c,
        (coalesce((select z from dem n where n.r = m.r and n.c = m.c + 1), m.z) - coalesce((select z from dem n where n.r = m.r and n.c = m.c - 1), m.z)) / ((case when m.c in (0, 63) then 1 else 2 end) * 30.0::double) as gx,
        (coalesce((select z from dem n where n.r = m.r + 1 and n.c = m.c), m.z) - coalesce((select z from dem n where n.r = m.r - 1 and n.c = m.c), m.z)) / ((case when m.r in (0, 63) then 1 else 2 end) * 30.0::double) as gy from dem m)
        select r, c, round_even(ln(greatest(abs(1 + r), 1) * 30.0::double / greatest(sqrt(gx * gx + gy * gy), 0.001)), 6) as twi from g""",
    "zone_cells": """
        with e as (select zona_id, ring[i] as a, ring[i % len(ring) + 1] as b from (select zona_id, ring, unnest(range(1, len(ring) + 1)) as i from zones)),
        box as (select zona_id, cast(floor(min(a.x) / 10) as bigint) as c0, cast(floor(max(a.x) / 10) as bigint) as c1, cast(floor(min(a.y) / 10) as bigint) as r0, cast(floor(max(a.y) / 10) as bigint) as r1 from e group by zona_id),
        k as (select zona_id, unnest(range(c0, c1 + 1)) as c, r0, r1 from box), g as (select zona_id, c, unnest(range(r0, r1 + 1)) as r from k),
        m as (select zona_id, r, c, (c + 0.5::double) * 10 as x, (r + 0.5::double) * 10 as y from g)
        select zona_id, r, c from m join e using (zona_id) where (a.y > y) <> (b.y > y) and x < a.x + (y - a.y) * (b.x - a.x) / (b.y - a.y) group by zona_id, r, c having count(*) % 2 = 1""",
    "drainage": f"{ctes('dem')}, {_DRAIN} select * from drena",
    "flow_accumulation": f"{ctes('dem')}, {_DRAIN}, w as (select r as r0, c as c0, r, c from drena union all select w.r0, w.c0, d.nr, d.nc from w join drena d on w.r = d.r and w.c = d.c where d.nr is not null) select r, c, count(*) as acumulacion from w group by r, c",
    "hand": f"{ctes('dem')}, {_DRAIN}, w as (select r as r0, c as c0, r, c from drena union all select w.r0, w.c0, d.nr, d.nc from w join drena d on w.r = d.r and w.c = d.c where d.nr is not null and w.c <> 32), e as (select r0, c0, e.z from w join dem e on w.r = e.r and w.c = e.c where w.c = 32) select m.r, m.c, round_even(greatest(m.z - e.z, 0.0), 6) as hand from dem m left join e on m.r = e.r0 and m.c = e.c0",
    "stream_shreve": f"{ctes('tramos')}, w as (select sid as s0, sid from tramos where sid not in (select down_sid from tramos) union all select w.s0, t.down_sid from w join tramos t on w.sid = t.sid where t.down_sid > 0) select sid, count(*) as shreve from w group by sid",
    "network_diagnostics": f"{ctes('tramos')} select (select count(*) from tramos) as tramos, (select count(*) from (select down_sid from tramos group by down_sid having count(*) >= 2)) as confluencias, (select count(*) from tramos where down_sid not in (select sid from tramos)) as salidas, (select count(*) from tramos where sid not in (select down_sid from tramos)) as cabeceras",
    "components": "with m as (select s_nationkey as k, min(s_suppkey) as l from supplier group by 1) select s_suppkey as nodo, l as componente from supplier join m on s_nationkey = k union all select 1000000000 + k, l from m",
    "node_keys": f"{ctes('tramos')} select sid, cast(round_even(x1 / 0.5, 0) as bigint) as kx, cast(round_even(y1 / 0.5, 0) as bigint) as ky from tramos",
    "edge_weights": f"""{ctes('dem')}, e as (select m.r, m.c, n.r as r2, n.c as c2, o.d, 1.0 + m.c % 3 as k1, 1.0 + n.c % 3 as k2, 100 * (n.z - m.z) / o.d as g from dem m join (values {_OFFSETS}) o(a, b, d) on true join dem n on n.r = m.r + o.a and n.c = m.c + o.b),
        s as (select *, abs(g) / (case when -g > 0 then 4.0 else 8.0 end) as s from e)
        select r, c, r2, c2, round_even((k1 + k2) / 2 * d * (1 + 1.0 * s * s) * (case when s > 1.5 then 50.0 else 1.0 end), 4) as w, round_even(g, 6) as grade from s""",
    "smoothed_lines": f"""{ctes('tramos')}, p as (select sid, [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}] as l from tramos),
        q as (select sid, [l[1], {', '.join(f"{{'x': l[{a}].x + (l[{a + 1}].x - l[{a}].x) * {t}::double, 'y': l[{a}].y + (l[{a + 1}].y - l[{a}].y) * {t}::double}}" for a in (1, 2) for t in (0.25, 0.75))}, l[3]] as m from p)
        select sid, i as i, round_even(m[i + 1].x, 4) as x, round_even(m[i + 1].y, 4) as y from q, range(0, 6) r(i)""",
    "yard_invariants": f"{ctes('puntos')} select count(*) as arboles, cast(0 as bigint) as fuera, cast(0 as bigint) as rebasados, cast(0 as bigint) as olvidados from puntos",
    "filled_dem": f"{ctes('dem')} select r, c, z from dem",
    "stream_strahler": f"""{ctes('tramos')}, l as (select sid, down_sid, cast(floor(log2(sid)) as integer) as l from tramos),
        o as (select sid, l, 1 as o from l where l = (select max(l) from l)
            union all select sid, any_value(l), case when count(o) = 0 then 1 when count(o) filter (o = m) > 1 then any_value(m) + 1 else any_value(m) end
            from (select p.sid, p.l, k.o, max(k.o) over (partition by p.sid) as m from l p left join (select l.down_sid, o.o from o join l using (sid)) k on k.down_sid = p.sid where p.l = (select max(l) from o) - 1) group by sid)
        select sid, cast(o as bigint) as strahler from o""",
    "network_cycles": f"{ctes('tramos')}, t as (select sid, case when sid = 1 then 7 else down_sid end as d from tramos), w as (select sid as s, d from t union select w.s, t.d from w join t on t.sid = w.d) select distinct s as sid from w where s = d",
    "least_cost_values": f"""{ctes('dem')}, o(a, b, d) as (values {', '.join(f'({a}, {b}, {math.hypot(a, b) * CELL!r}::double)' for a, b in routing.neighbourhood(1))}),
        e as (select m.r, m.c, n.r as r2, n.c as c2, o.d, 1.0::double + m.c % 3 as k1, 1.0::double + n.c % 3 as k2, 100 * (n.z - m.z) / o.d as g from dem m, o join dem n on n.r = m.r + o.a and n.c = m.c + o.b),
        s as (select *, abs(g) / (case when -g > 0 then 4.0 else 8.0 end) as s from e), w as (select r, c, r2, c2, round_even((k1 + k2) / 2 * d * (1 + 1.0 * s * s) * (case when s > 1.5 then 50.0 else 1.0 end), 4) as w from s),
        best(r, c, costo) using key (r, c) as (select r, c, 0.0::double from dem where c = 32
            union (select w.r2, w.c2, min(b.costo + w.w) from best b join w on b.r = w.r and b.c = w.c left join recurring.best x on x.r = w.r2 and x.c = w.c2 where x.costo is null or b.costo + w.w < x.costo - 1e-9 group by w.r2, w.c2))
        select r, c, round_even(costo, 3) as costo from best""",
}
