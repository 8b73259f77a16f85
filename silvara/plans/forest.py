"""Queries of rules, coordinate systems, networks, yards and roads, and of the tables that go with them, with their SQL."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.functions import crs
from silvara.functions.text import normalize_field
from silvara.operators import census, flow, grid, network, raster, roads, routing, rules, spatial, yards
from silvara.operators.census import real
from silvara.plans import census as census_plan
from silvara.plans.census import D, H, SP, TH, V, _field, _float, _strip
from silvara.plans.fixtures import ctes, view
from silvara.plans.terrain import _DIST2, _DRAIN, _MEET, _SLOPE, BASAL, CELL, KEY, KEYS, VOLUME
from silvara.sources import files, table

V3 = f"({VOLUME}) / 100000.0"


def _rules(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "reglas").withColumn("valores", F.split("valores", "[|]"))


def _ring(df: DataFrame) -> DataFrame:
    """Squares (zona_id, x0, y0, lado) with their ring."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("lado"), F.col("y0") + F.col("lado")
    return df.withColumn("ring", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)))


def _lonlat(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "lugares")


def utm_forward(s: SparkSession, d: str) -> DataFrame:
    east, north = crs.to_grid(F.col("lon"), F.col("lat"))
    return _lonlat(s, d).select("id", F.bround(east, 3).alias("este"), F.bround(north, 3).alias("norte"))


def utm_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Places sent to the grid and back, which must be where they were."""
    east, north = crs.to_grid(F.col("lon"), F.col("lat"))
    g = _lonlat(s, d).select("id", "lon", "lat", east.alias("e"), north.alias("n"), crs.utm_zone(F.col("lon")).alias("z"))
    lon, lat = crs.to_degrees(F.col("e"), F.col("n"), F.col("z"), F.col("lat") < 0)
    return g.select("id", F.bround(lon, 7).alias("lon"), F.bround(lat, 7).alias("lat"))


def crs_checks(s: SparkSession, d: str) -> DataFrame:
    return _lonlat(s, d).select("id", "codigo", crs.crs_finding(F.col("codigo"), F.col("lon"), F.col("lat")).alias("hallazgo"))


def _trees(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "puntos").select(F.xxhash64(*KEY).alias("key"), "x", "y", "especie", F.expr(V3).cast("double").alias("v"))


def _nearest_yard(s: SparkSession, d: str) -> DataFrame:
    """Trees with their nearest yard within 400 m; patio_id null for orphans."""
    p = view(s, d, "puntos").select(*KEY, "x", "y", "especie", F.expr(VOLUME).alias("v"))
    j = spatial.with_nearest(p, view(s, d, "patios"), "patio_id", 400.0)
    whole = reduce(and_, [F.col(c).isNotNull() for c in KEY])  # a tree without a whole key is no one's
    return j.select(F.lit(0).cast("long").alias("bloque"), *KEY, "especie", "x", "y", "v", *[F.when(whole, F.col(c)).alias(c) for c in ("patio_id", "px", "py")], F.when(whole, F.sqrt("d2")).alias("dist"))


def centre_trees(s: SparkSession, d: str) -> DataFrame:
    """Trees and volume of each centre, by its yards."""
    t = _nearest_yard(s, d).where("patio_id is not null").groupBy("patio_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    c = view(s, d, "patios").select("patio_id", (F.col("patio_id") % 3 + 1).alias("id_centro"))
    return c.join(t, "patio_id", "left").groupBy("id_centro").agg(F.count("*").alias("patios"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("volumen"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Trees of work blocks of 2.5 km, squares of 25 m where no yard may lie, and all streams that a way of the block may meet as walls, planned."""
    block = lambda x, y: (F.floor(F.col(x) / 2500) * 100 + F.floor(F.col(y) / 2500)).alias("bloque")
    t = _trees(s, d).select(block("x", "y"), "key", "x", "y", "v")
    shut = s.range(40_000).select((F.col("id") % 200).alias("gx"), F.floor(F.col("id") / 200).alias("gy")).where("(gx + gy) % 3 = 0").select((F.floor(F.col("gx") / 100) * 100 + F.floor(F.col("gy") / 100)).alias("bloque"), "gx", "gy")
    reached = spatial.segment_cells(view(s, d, "tramos").select("x1", "y1", "x2", "y2").distinct(), 2500.0, yards.RADIUS)
    walls = reached.select((F.col("_gx") * 100 + F.col("_gy")).alias("bloque"), "x1", "y1", "x2", "y2")
    return yards.plan_yards(t, shut, walls, 25.0)


def yard_loop_checks(s: SparkSession, d: str) -> DataFrame:
    """What a plan must hold: each tree once, no way beyond the radius, no yard beyond its capacity."""
    p = _blocks(s, d)
    load = p.where("patio_id is not null").groupBy("bloque", "patio_id").agg(F.sum("v").alias("l")).agg(F.count_if(F.col("l") > yards.CAPACITY + 1e-6).alias("rebasados"))
    return p.agg(F.count("*").alias("arboles"), F.countDistinct("bloque", "key").alias("distintos"), F.count_if(F.col("dist") > yards.RADIUS).alias("fuera")).join(load)


def feasible_sites(s: SparkSession, d: str) -> DataFrame:
    """Y1 over the yards' places: in the squares, not in those of odd number, 100 m from streams."""
    c = _ring(view(s, d, "cuadros"))
    return yards.feasible(view(s, d, "patios").select("patio_id", F.col("px").alias("x"), F.col("py").alias("y")), "patio_id", c, c.where("zona_id % 2 = 1"), view(s, d, "tramos"), None, CELL, least_distance=100.0).select("patio_id", "factible")


def _cells(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "dem").withColumn("costo", 1.0 + F.col("c") % 3)


def road_network(s: SparkSession, d: str) -> DataFrame:
    """Two plans over the valley: with an exit, and with a road that is there."""
    plans = s.range(1, 3).select(F.col("id").alias("plan"))
    cells = _cells(s, d).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("plan"), "r", "c", "z", "costo")
    goals = view(s, d, "patios").where("patio_id <= 12").select("patio_id", (F.col("px") * 0.19).alias("x"), (F.col("py") * 0.19).alias("y"))
    goals = goals.join(plans).select("plan", F.col("patio_id").alias("destino"), F.when(F.col("patio_id") <= 3, "principal").otherwise("secundaria").alias("jerarquia"), "x", "y", (F.col("patio_id") % 5 * 10.0).alias("volumen"))
    exits = s.createDataFrame([(1, 975.0, 15.0), (2, 0.0, 0.0)], "plan long, x double, y double")
    there = s.createDataFrame([(2, 1, [(975.0, 15.0), (975.0, 600.0)])], "plan long, via long, linea array<struct<x:double,y:double>>")
    return roads.grow_network(cells, goals, exits, there, CELL)


def road_network_checks(s: SparkSession, d: str) -> DataFrame:
    """What growth must hold: each destination once, traced ways not shorter than straight to the network's rim, ends of a line joined to the grid."""
    n = road_network(s, d)
    return n.agg(F.count_if(F.col("destino").isNotNull()).alias("destinos"), F.countDistinct("plan", "destino").alias("distintos"), F.count_if((F.col("estado") == "trazada") & (F.size("linea") < 2)).alias("sin_linea"), F.count_if(F.col("estado") == "existente").alias("existentes"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Segments as roads: length in whole centimetres, kind by number."""
    t = view(s, d, "tramos")
    return t.select("sid", F.when(F.col("sid") % 3 == 0, "principal").otherwise("secundaria").alias("jerarquia"), F.lit("trazada").alias("estado"), F.floor(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 100).alias("cm"))


def road_totals(s: SparkSession, d: str) -> DataFrame:
    return roads.road_totals(_lines(s, d).withColumn("largo", F.col("cm") / 100.0), 10_000.0)


def _gathered(s: SparkSession, d: str, least: int) -> tuple[DataFrame, DataFrame]:
    drains = flow.drainage(view(s, d, "dem"), CELL)
    return drains, flow.accumulation(drains).where(F.col("acumulacion") >= least).select("r", "c")


def stream_lines(s: SparkSession, d: str) -> DataFrame:
    return network.stream_lines(*_gathered(s, d, 30), CELL)


def oriented(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "tramos").select("sid", *[(F.col(c) * 0.2).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return network.downhill(t, view(s, d, "dem"), CELL)


def clipped_segments(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "tramos").select("sid", "x1", "y1", "x2", "y2")
    c = network.clipped(t, "sid", _ring(view(s, d, "cuadros")), "zona_id", "ring")
    return c.groupBy("sid", "zona_id").agg(F.bround(F.sum("largo"), 4).alias("largo")).where("largo > 0")


def _wet(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dem = view(s, d, "dem")
    hand = dem.select("r", "c", F.when(F.col("c") > 0, 2.0 * F.abs(F.col("c") - 32)).alias("hand"))
    near = raster.proximity(dem, dem.where("c between 36 and 38").select("r", "c"), CELL, 150.0)
    return hand, near


def filled_pits(s: SparkSession, d: str) -> DataFrame:
    """Single deep cells are filled to their lowest neighbour."""
    return flow.fill_depressions(view(s, d, "hoyos"), 16)


def filled_accumulation(s: SparkSession, d: str) -> DataFrame:
    """Filling, drainage with ways out of flats, and accumulation in turn: all water arrives at cells that drain nowhere."""
    filled = flow.fill_depressions(view(s, d, "hoyos"), 16)
    drains = flow.resolve_flats(filled, flow.drainage(filled, CELL), 16)
    a = flow.accumulation(drains).join(drains, ["r", "c"])
    return a.agg(F.count("*").alias("celdas"), F.sum(F.when(F.col("nr").isNull(), F.col("acumulacion"))).alias("recogido"))


def network_check(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "tramos").where("down_sid > 0")
    return network.checked(view(s, d, "tramos"), flow.components(t, "sid", "down_sid")).withColumn("avisos", F.array_join("avisos", "; "))


def single_centre(s: SparkSession, d: str) -> DataFrame:
    """One centre lies in the weighted middle."""
    from silvara.plans.terrain import centre_scenarios

    return centre_scenarios(s, d).where("n = 1").select("n", F.bround("cx", 4).alias("cx"), F.bround("cy", 4).alias("cy"), "peso", F.bround("momento", 4).alias("momento"))


def _fields(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, c, k) for i, (c, k) in enumerate(table(s, d, "tree").dtypes)], "orden int, campo string, tipo string")


def lines_of_parts(s: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    t = view(s, d, "tramos").select("sid", F.array(F.array(p("x1", "y1"), p("x2", "y2")), F.array(p("x1", "y1")), F.array(p("x2", "y2"), p("x2", "y1"), p("x1", "y1"))).alias("partes"))
    return network.long_enough(t, "partes", 3000.0).select("sid", F.col("parte").cast("long").alias("parte"), F.size("linea").cast("long").alias("puntos"), F.bround("largo", 4).alias("largo"))


QUERIES = {
    "plain_categories": lambda s, d: table(s, d, "tree").select("fid", rules.plain("categoria").alias("categoria")),
    "wetland_classes": lambda s, d: table(s, d, "zones").select("zona_id", rules.mentions("clase", rules.WETLAND).alias("humedal"), rules.mentions("clase", rules.PROTECTED).alias("protegida")),
    "rule_findings": lambda s, d: rules.judged(_rules(s, d)).select("regla", F.array_join("problemas", ",").alias("problemas"), "humedal", "filtro"),
    "rule_zones": lambda s, d: rules.chosen(table(s, d, "zones"), "zona_id", "clase", _rules(s, d)),
    "field_roles": lambda s, d: census.field_roles(_fields(s, d)),
    "class_field": lambda s, d: s.createDataFrame([(rules.class_field({c: k for c, k in table(s, d, n).dtypes}),) for n in ("zones", "censo_config")], "campo string"),
    "declared_diameters": lambda s, d: census.diameters_by_mode(table(s, d, "census_dirty"), table(s, d, "censo_config")),
    "load_checks": lambda s, d: census.load_checks(table(s, d, "tree"), table(s, d, "censo_config")),
    "joined_spellings": lambda s, d: census.joined_spellings(table(s, d, "tree")),
    "implied_factor_mode": lambda s, d: census.implied_factor_mode(table(s, d, "tree")),
    "under_limit_species": lambda s, d: census.under_limit(table(s, d, "tree")),
    "species_means": lambda s, d: census.species_means(table(s, d, "tree"), 3300),
    "diameter_classes": lambda s, d: census.diameter_classes(table(s, d, "tree")),
    "equal_breaks": lambda s, d: census.equal_breaks(table(s, d, "tree"), real("volumen_m3")),
    "limit_breaks": lambda s, d: census.limit_breaks(table(s, d, "tree"), F.when(real("altura_m") <= 45, F.col("altura_m")), 30.0),
    "selected_trees": lambda s, d: census.selected(table(s, d, "tree"), table(s, d, "validation_report").where("total > validos"), "lote_id").select("fid", "lote_id"),
    "reference_from_trees": lambda s, d: files.merge_reference(table(s, d, "tree").where("fid is not null"), table(s, d, "dmc"), "fid"),
    "grid_means": lambda s, d: grid.cell_means(grid.cells(view(s, d, "puntos"), F.expr(VOLUME), F.expr(BASAL))),
    "grid_template": lambda s, d: raster.grid_template(view(s, d, "dem").where("r > 3 and c > 5"), CELL),
    "coregistration": lambda s, d: raster.coregistered(view(s, d, "dem").where("r > 3"), view(s, d, "dem").where("c < 60")),
    "zone_hectares": lambda s, d: spatial.hectares(table(s, d, "zones"), "zona_id", "ring"),
    "outside_squares": lambda s, d: spatial.outside(view(s, d, "patios").select("patio_id", F.col("px").alias("x"), F.col("py").alias("y")), "patio_id", _ring(view(s, d, "cuadros"))),
    "stream_distance": lambda s, d: yards.stream_distance(view(s, d, "patios").select("patio_id", F.col("px").alias("x"), F.col("py").alias("y")), "patio_id", view(s, d, "tramos"), 500.0).select("patio_id", F.bround("distancia", 4).alias("distancia")),
    "served_yards": lambda s, d: yards.stream_distance(view(s, d, "patios").select("patio_id", F.col("px").alias("x"), F.col("py").alias("y")), "patio_id", view(s, d, "tramos").where("sid % 3 = 0"), 500.0).select("patio_id"),
    "crossing_counts": lambda s, d: spatial.crossing_counts(view(s, d, "tramos").select("sid", "x1", "y1", "x2", "y2"), view(s, d, "tramos").where("sid % 4 = 0").select(F.col("sid").alias("barrera"), "x1", "y1", "x2", "y2"), "sid", "barrera"),
    "centre_trees": centre_trees,
    "yard_table": lambda s, d: yards.yard_table(_nearest_yard(s, d), 4_000_000).drop("bloque"),
    "yard_totals": lambda s, d: yards.yard_totals(_nearest_yard(s, d)),
    "yard_species": lambda s, d: yards.leading_species(_nearest_yard(s, d), "especie"),
    "yard_orphans": lambda s, d: yards.orphans(_nearest_yard(s, d)).select("n", F.col("volumen").cast("long").alias("volumen")),
    "skid_lines": lambda s, d: yards.skid_lines(_nearest_yard(s, d).withColumn("key", F.col("l_orderkey")), 4_000_000).drop("bloque"),
    "yard_numbers": lambda s, d: yards.first_number(view(s, d, "puntos").select("parcela", "x", "y", F.expr(VOLUME).alias("v")), "parcela", 35_000_000.0),
    "feasible_sites": feasible_sites,
    "yard_loops": _blocks,
    "yard_loop_checks": yard_loop_checks,
    "single_centre": single_centre,
    "road_network": road_network,
    "road_network_checks": road_network_checks,
    "road_totals": road_totals,
    "road_findings": lambda s, d: roads.road_findings(_lines(s, d).select("estado", F.lit(0.0).alias("volumen"), (F.col("cm") / 100.0).alias("largo")), view(s, d, "tramos").select((F.col("sid") % 5 + 1).alias("orden")), 10_000.0),
    "strip_area": lambda s, d: raster.strip_cells(view(s, d, "tramos").where("sid <= 12").withColumn("ancho", F.lit(60.0)), "ancho", 20.0),
    "stream_lines": stream_lines,
    "oriented_segments": oriented,
    "lines_of_parts": lines_of_parts,
    "clipped_segments": clipped_segments,
    "network_check": network_check,
    "network_summary": lambda s, d: network.summary(view(s, d, "tramos").withColumn("orden", F.col("sid") % 4 + 1), "orden", F.floor(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 100).cast("double") / 100),
    "ridge_cells": lambda s, d: network.ridge_cells(view(s, d, "dem"), CELL, 20, 150.0),
    "wet_fusion": lambda s, d: raster.wet_fusion(*_wet(s, d)),
    "wet_summary": lambda s, d: raster.wet_summary(raster.wet_fusion(*_wet(s, d)), _wet(s, d)[0], CELL),
    "cost_findings": lambda s, d: raster.cost_findings(_cells(s, d).select("r", "c", "costo"), raster.horn_slope(view(s, d, "dem"), CELL), _wet(s, d)[1], view(s, d, "dem").where("c < 3"), 5.0),
    "filled_pits": filled_pits,
    "filled_accumulation": filled_accumulation,
    "utm_forward": utm_forward,
    "utm_round_trip": utm_round_trip,
    "crs_checks": crs_checks,
    "node_tolerances": lambda s, d: view(s, d, "tramos").select("sid", crs.node_tolerance(F.col("sid") % 4 - 1.0, F.col("sid") % 7 * 1.0).alias("tolerancia")),
}

_SQUARES = "from cuadros"
_NEAREST = f"""near as (select {KEYS}, x, y, patio_id, px, py, {_DIST2.format(ax='x', bx='px', ay='y', by='py')} as d2 from puntos join patios on x between px - 400 and px + 400),
    best as (select *, row_number() over (partition by {KEYS}, x, y order by d2, patio_id) as k from near where d2 <= 160000),
    own as (select p.*, {VOLUME} as v, b.patio_id, b.px, b.py, sqrt(b.d2) as dist from puntos p left join (select * from best where k = 1) b using ({KEYS}, x, y))"""
_YARDS = f"{ctes('puntos', 'patios')}, {_NEAREST}"
_SEG = "greatest(least(coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 1), 0)"
_FAR = f"select patio_id, min(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)) as m from (select *, {_SEG} as t from patios, {{lines}}) group by patio_id"
_IN = "px >= x0 and px < x0 + lado and py >= y0 and py < y0 + lado"


def _contains(words: tuple[str, ...]) -> str:
    return "coalesce(" + " or ".join(f"contains(strip_accents(lower({_strip('clase')})), '{w}')" for w in words) + ", false)"


_PROBLEMS = "list_filter([case when capa is null or capa = '' then 'capa' end, case when campo is null or campo = '' then 'campo' end, case when valores is null or valores = '' then 'valores' end, case when rol is null or rol not in ('VETO_LEGAL', 'IMPEDIMENTO_FISICO', 'PREFERENCIA') then 'rol' end, case when peso is null or not peso between 0 and 1 then 'peso' end], lambda x: x is not null)"
_N = crs._N


def _terms(terms: tuple[float, ...], f: str, g: str) -> str:
    return " + ".join(f"({k!r}::double) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, k in enumerate(terms, 1))


_UTM = f"""a as (select id, lat, radians(lon) - radians((floor((lon + 180) / 6) + 1) * 6.0 - 183.0) as away, sin(radians(lat)) as s from lugares),
    t as (select *, sinh(atanh(s) - {crs.ECC!r}::double * atanh({crs.ECC!r}::double * s)) as t from a), u as (select *, atan2(t, cos(away)) as xi, atanh(sin(away) / sqrt(1 + t * t)) as eta from t)
    select id, round_even(500000 + {crs.SCALE * crs.RADIUS!r}::double * (eta + {_terms(crs.FORWARD, 'cos', 'sinh')}), 3) as este, round_even({crs.SCALE * crs.RADIUS!r}::double * (xi + {_terms(crs.FORWARD, 'sin', 'cosh')}) + case when lat < 0 then 10000000 else 0 end, 3) as norte from u"""
_ALIASES = ", ".join(f"('{r}', '{a}', {i})" for r, names in census.FIELD_NAMES.items() for i, a in enumerate(names.split()))
_AROUND = ", ".join(f"({a}, {b})" for a, b in raster.RING)
_WETSQL = """h as (select r, c, case when c > 0 then 2.0::double * abs(c - 32) end as hand, case when c between 36 and 38 then 1.0::double else greatest(0, 1 - least(abs(c - 36), abs(c - 38)) * 30.0::double / 150) end as m from dem),
    w as (select *, coalesce(least(greatest((8.0 - hand) / 6.0::double, 0), 1), 0) as l, round_even(m, 6) as cercania from h),
    f as (select r, c, hand, cast(case when l >= 0.5 then 1 else 0 end + case when cercania >= 0.5 then 2 else 0 end as integer) as nivel, l, cercania from w),
    x as (select r, c, hand, nivel, round_even(least(greatest(l * 0.6::double, cercania * 1.0, case nivel when 3 then 1.0 when 2 then 0.8 when 1 then 0.55 else 0.0 end), 1.0), 6) as humedad from f)"""
_ACC = "w as (select r as r0, c as c0, r, c from drena union all select w.r0, w.c0, d.nr, d.nc from w join drena d on w.r = d.r and w.c = d.c where d.nr is not null), acc as (select r, c, count(*) as a from w group by r, c)"

SQL = {
    "plain_categories": f"select fid, strip_accents(lower({_strip('categoria')})) as categoria from tree",
    "wetland_classes": f"select zona_id, {_contains(rules.WETLAND)} as humedal, {_contains(rules.PROTECTED)} as protegida from zones",
    "rule_findings": f"""{ctes('reglas')}, p as (select *, {_PROBLEMS} as p from reglas)
        select regla, array_to_string(p, ',') as problemas, len(p) = 0 and coalesce(regexp_matches(strip_accents(lower(valores)), '{'|'.join(rules.WETLAND)}'), false) as humedal,
        case when campo <> '' and valores <> '' then concat('"', campo, '" IN (', array_to_string(list_transform(string_split(valores, '|'), lambda v: concat('''', replace(v, '''', ''''''), '''')), ','), ')') end as filtro from p""",
    "rule_zones": f"{ctes('reglas')}, p as (select *, unnest(list_distinct(string_split(valores, '|'))) as v from reglas where len({_PROBLEMS}) = 0) select zona_id, regla, rol, peso from zones join p on clase = v",
    "field_roles": f"with a(rol, k, i) as (values {_ALIASES}), f as (select {_field('column_name')} as k, arg_min(column_name, column_index) as campo from duckdb_columns() where table_name = 'tree' group by 1), j as (select rol, arg_min(campo, i) as campo from a left join f using (k) where campo is not null group by rol) select r.rol, campo from (select distinct rol from a) r left join j using (rol)",
    "class_field": "select 'clase' as campo union all select 'capa'",
    "declared_diameters": f"select fid, round_even(case diameter_mode when 'DAP_M' then v when 'DAP_CM' then v / 100 when 'CAP_CM' then v / pi() / 100 end, 6) as dap_m from (select fid, censo_id, {_float('dap_txt')} as v from census_dirty) left join censo_config using (censo_id)",
    "load_checks": f"select fid, case when c.field_volumen is not null then case when ({V}) is null then 'volumen' else '' end when ({D}) is null then 'dap' when ({H}) is null then 'altura' else '' end as rechazo from tree left join censo_config c using (censo_id)",
    "joined_spellings": f"select e as especie_norm, string_agg(s, ' / ' order by encode(s)) as grafias, count(*) as n from (select distinct {SP} as e, {_strip('especie')} as s from tree) where e <> '' group by e having count(*) > 1",
    "implied_factor_mode": f"""with f as (select censo_id, fid, cast(floor(({V}) / (pi() / 4 * ({D}) * ({D}) * ({H})) * 10000 + 0.5) as bigint) as k from tree),
        c as (select censo_id, k, count(*) as n, min(fid) as first from f where k is not null group by censo_id, k), r as (select *, row_number() over (partition by censo_id order by n desc, first) as p, sum(n) over (partition by censo_id) as total from c)
        select censo_id, k as factor_10000, n, cast(total - n as bigint) as incoherentes from r where p = 1""",
    "under_limit_species": f"select coalesce({_strip('especie')}, '') as especie, count(*) as n, cast(coalesce(sum({TH.format(V)}), 0) as bigint) as volumen_milesimas from tree where bajo_dmc group by 1 order by n desc, encode(coalesce({_strip('especie')}, '')) limit 5",
    "species_means": f"""with t as (select fid, {SP} as k, {_strip('especie')} as s, {TH.format(V)} as v from tree where aprovechable),
        g as (select k, grouping(k) as g, arg_min(s, fid) filter (s is not null) as s, count(*) as n, coalesce(sum(v), 0) as v from t group by rollup (k))
        select k as clave, case when g = 1 then 'TOTAL' when k = '' then 'sin especie' else s end as especie, n, cast(floor(v / n) as bigint) as volumen_medio, cast(floor(n * 10000 / 3300) as bigint) as n_ha_10000, cast(floor(v * 10 / 3300) as bigint) as volumen_ha_10000 from g""",
    "diameter_classes": f"""with t as (select {SP} as k, {census_plan.LOW} as inferior, {TH.format(V)} as v from tree where aprovechable)
        select case when grouping(k) = 1 then 'TOTAL' else k end as especie, inferior, grouping(inferior) = 1 as todas, count(*) as n, cast(coalesce(sum(v), 0) as bigint) as volumen_milesimas from t group by cube (k, inferior)""",
    "equal_breaks": f"with g as (select min({V}) as a, max({V}) as b from tree) select " + ", ".join(f"round_even(a + ((case when b > a then b else a + 1 end) - a) * {i} / 4, 6) as corte{i}" for i in range(5)) + " from g",
    "limit_breaks": f"select 0.0::double as corte0, 15.0::double as corte1, 25.5::double as corte2, 30.0::double as corte3, 37.5::double as corte4, round_even(greatest(max(case when ({H}) <= 45 then altura_m end), 45.0), 6) as corte5 from tree",
    "selected_trees": "select fid, lote_id from tree where lote_id in (select lote_id from validation_report where total > validos)",
    "reference_from_trees": f"with f as (select {SP} as k, arg_min({_strip('especie')}, fid) as especie from tree where {SP} <> '' group by 1) select f.especie, dmc_cm from f left join (select {SP} as k, min(dmc_cm) as dmc_cm from dmc group by 1) using (k)",
    "grid_means": f"{ctes('puntos')}, g as (select count(*) as n, sum({VOLUME}) as volumen from puntos group by floor(x / 100), floor(y / 100)) select cast(count(*) as double) as hectareas, round_even(avg(n), 4) as densidad, round_even(avg(volumen), 4) as intensidad from g",
    "grid_template": f"{ctes('dem')} select min(r) as fila0, min(c) as columna0, max(r) - min(r) + 1 as filas, max(c) - min(c) + 1 as columnas, min(c) * 30.0::double as x0, min(r) * 30.0::double as y0, 30.0::double as lado from dem where r > 3 and c > 5",
    "coregistration": f"{ctes('dem')} select count(*) filter (r > 3 and c < 60) as comunes, count(*) filter (r > 3 and c >= 60) as solo_a, count(*) filter (r <= 3 and c < 60) as solo_b, false as coinciden from dem",
    "zone_hectares": "with e as (select zona_id, ring[i] as a, ring[i % len(ring) + 1] as b from (select zona_id, ring, unnest(range(1, len(ring) + 1)) as i from zones)) select zona_id, round_even(abs(sum((a.x - f.x) * (b.y - f.y) - (b.x - f.x) * (a.y - f.y))) / 2 / 10000, 4) as hectareas from e join (select zona_id, ring[1] as f from zones) using (zona_id) group by zona_id",
    "outside_squares": f"{ctes('patios', 'cuadros')} select patio_id from patios where not exists (select 1 from cuadros where {_IN})",
    "stream_distance": f"{ctes('patios', 'tramos')}, d as ({_FAR.format(lines='tramos')}) select patio_id, round_even(m, 4) as distancia from d where m <= 500",
    "served_yards": f"{ctes('patios', 'tramos')}, l as (select * from tramos where sid % 3 = 0), d as ({_FAR.format(lines='l')}) select patio_id from d where m <= 500",
    "crossing_counts": f"{ctes('tramos')}, m as (select a.sid, count(*) as k {_MEET.replace('a.sid < b.sid', 'b.sid % 4 = 0')} group by a.sid) select sid, coalesce(k, 0) as cruces from tramos left join m using (sid)",
    "centre_trees": f"{_YARDS}, t as (select patio_id, count(*) as n, sum(v) as v from own where patio_id is not null group by patio_id) select patio_id % 3 + 1 as id_centro, count(*) as patios, cast(coalesce(sum(n), 0) as bigint) as n, cast(coalesce(sum(v), 0) as bigint) as volumen from patios left join t using (patio_id) group by 1",
    "yard_table": f"{_YARDS} select patio_id, count(*) as n, cast(sum(v) as bigint) as volumen, count(*) filter (v > 4000000) as grandes, round_even(avg(dist), 4) as dist_media, round_even(max(dist), 4) as dist_max from own where patio_id is not null group by patio_id",
    "yard_totals": f"""{_YARDS}, y as (select patio_id, avg(dist) as m, sum(dist) as s, count(*) as k, min(px) as px, min(py) as py from own where patio_id is not null group by patio_id),
        g as (select count(*) as n, avg(m) as m, sum(s) as s, sum(k) as k, (max(px) - min(px)) * (max(py) - min(py)) as e from y)
        select n as patios, round_even(m, 4) as arrastre_medio, round_even(s / k, 4) as arrastre_medio_arbol, round_even(s, 2) as arrastre, round_even(s * 4.0 * 0.4::double, 2) as pista_m2, round_even(n * sqrt(e / n) * 4.0, 2) as ramal_m2, n * 500.0::double as patios_m2 from g""",
    "yard_species": f"""{_YARDS}, s as (select patio_id, especie, count(*) as n, sum(v) as v from own where patio_id is not null group by patio_id, especie),
        k as (select *, row_number() over (partition by patio_id order by v desc, especie) as k, sum(n) over (partition by patio_id) as nn, sum(v) over (partition by patio_id) as vv from s)
        select patio_id, cast(nn as bigint) as n, cast(vv as bigint) as volumen, string_agg(especie, ', ' order by k) as principales from k where k <= 3 group by patio_id, nn, vv""",
    "yard_orphans": f"{_YARDS} select count(*) as n, cast(coalesce(sum(v), 0) as bigint) as volumen from own where patio_id is null",
    "skid_lines": f"{_YARDS} select l_orderkey as key, patio_id, x as x1, y as y1, px as x2, py as y2, round_even(dist, 4) as dist, round_even(((degrees(atan2(px - x, py - y)) + 360) % 360 + 360) % 360, 6) as azimut, v > 4000000 as pieza_grande from own where dist > 0",
    "yard_numbers": f"{ctes('puntos')} select parcela, count(*) as n, cast(greatest(1, least(count(*), greatest(ceil(sum({VOLUME}) / 35000000.0), ceil(greatest(1, (max(x) - min(x)) * (max(y) - min(y))) / (pi() * 160000))))) as bigint) as patios from puntos group by parcela",
    "feasible_sites": f"{ctes('patios', 'tramos', 'cuadros')}, d as ({_FAR.format(lines='tramos')}) select patio_id, exists (select 1 from cuadros where {_IN}) and not exists (select 1 from cuadros where {_IN} and zona_id % 2 = 1) and m >= 100 as factible from patios join d using (patio_id)",
    "yard_loop_checks": f"{ctes('puntos')} select count(*) as arboles, count(*) as distintos, cast(0 as bigint) as fuera, cast(0 as bigint) as rebasados from puntos",
    "single_centre": f"{ctes('patios')}, w as (select *, 1.0 + patio_id % 7 as w from patios), m as (select sum(w * px)::double / sum(w) as cx, sum(w * py)::double / sum(w) as cy, sum(w)::double as peso from w) select cast(1 as integer) as n, round_even(any_value(cx), 4) as cx, round_even(any_value(cy), 4) as cy, any_value(peso) as peso, round_even(sum(w * sqrt((px - cx) ** 2 + (py - cy) ** 2)) / 1000, 4) as momento from w, m",
    "road_network_checks": "select 2 * count(*) as destinos, 2 * count(*) as distintos, cast(0 as bigint) as sin_linea, cast(1 as bigint) as existentes from supplier where s_suppkey < 12",
    "road_totals": f"""{ctes('tramos')}, l as (select case when sid % 3 = 0 then 'principal' else 'secundaria' end as jerarquia, cast(floor(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 100) as bigint) as cm from tramos)
        select jerarquia, grouping(jerarquia) = 1 as todo, count(*) as vias, round_even(sum(cm) / 100.0::double, 2) as largo, round_even(sum(cm * case jerarquia when 'principal' then 6 else 4 end) / 1000000.0::double, 4) as hectareas, round_even(sum(cm) / 1000000.0::double, 4) as densidad from l group by rollup (jerarquia)""",
    "road_findings": f"""{ctes('tramos')}, l as (select sid % 5 + 1 as orden, cast(floor(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 100) as bigint) as cm from tramos)
        select round_even(sum(cm) / 100.0::double, 2) as largo, round_even(sum(cm) / 1000000.0::double, 4) as densidad, count(*) filter (orden <= 2) as alcantarillas, count(*) filter (orden = 3) as pontones, count(*) filter (orden > 3) as puentes, 0.0::double as volumen_atrapado,
        array_to_string(list_filter([case when sum(cm) / 1000000.0 > 20 then 'densidad' end, case when count(*) filter (orden > 3) >= 3 then 'puentes' end], lambda x: x is not null), '; ') as avisos from l""",
    "strip_area": f"""{ctes('tramos')}, q as (select * from tramos where sid <= 12), c as (select *, unnest(range(cast(floor((least(x1, x2) - 30) / 20) as bigint), cast(floor((greatest(x1, x2) + 30) / 20) as bigint) + 1)) as c from q),
        g as (select *, unnest(range(cast(floor((least(y1, y2) - 30) / 20) as bigint), cast(floor((greatest(y1, y2) + 30) / 20) as bigint) + 1)) as r from c), p as (select *, (c + 0.5::double) * 20 as px, (r + 0.5::double) * 20 as py from g), t as (select *, {_SEG} as t from p)
        select distinct r, c from t where (px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2 <= 900""",
    "stream_lines": f"""{ctes('dem')}, {_DRAIN}, {_ACC}, s as (select r, c from acc where a >= 30), e as (select d.* from drena d join s using (r, c) join s t on d.nr = t.r and d.nc = t.c),
        k as (select s.r, s.c, (select count(*) from e where e.nr = s.r and e.nc = s.c) as k, exists (select 1 from e where e.r = s.r and e.c = s.c) as o from s), n as (select r, c from k where k <> 1 or not o),
        v as (select e.r as r0, e.c as c0, e.nr, e.nc, 1 as m, 30.0::double * sqrt((e.nr - e.r) ** 2 + (e.nc - e.c) ** 2) as l from e join n on e.r = n.r and e.c = n.c
            union all select v.r0, v.c0, e.nr, e.nc, v.m + 1, v.l + 30.0::double * sqrt((e.nr - e.r) ** 2 + (e.nc - e.c) ** 2) from v join e on v.nr = e.r and v.nc = e.c where not exists (select 1 from n where n.r = v.nr and n.c = v.nc))
        select r0, c0, nr as r1, nc as c1, cast(m as bigint) as celdas, round_even(l, 4) as largo from v join n on v.nr = n.r and v.nc = n.c""",
    "oriented_segments": f"""{ctes('tramos', 'dem')}, t as (select sid, x1 * 0.2::double as x1, y1 * 0.2::double as y1, x2 * 0.2::double as x2, y2 * 0.2::double as y2 from tramos),
        j as (select t.*, a.z as z1, b.z as z2 from t left join dem a on a.r = floor(y1 / 30) and a.c = floor(x1 / 30) left join dem b on b.r = floor(y2 / 30) and b.c = floor(x2 / 30)), g as (select *, coalesce(z2 > z1, false) as girado from j)
        select sid, case when girado then x2 else x1 end as x1, case when girado then y2 else y1 end as y1, case when girado then x1 else x2 end as x2, case when girado then y1 else y2 end as y2, girado, z1 is null or z2 is null as sin_z from g""",
    "lines_of_parts": f"{ctes('tramos')}, p as (select sid, 0 as parte, 2 as puntos, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as largo from tramos union all select sid, 2, 3, abs(y2 - y1) + abs(x2 - x1) from tramos) select sid, cast(parte as bigint) as parte, cast(puntos as bigint) as puntos, round_even(largo, 4) as largo from p where largo >= 3000",
    # Within a square a segment is cut by the bounds of its parameter on both axes.
    "clipped_segments": f"""{ctes('tramos', 'cuadros')}, b as (select sid, zona_id, x2 - x1 as dx, y2 - y1 as dy, x1, y1, x0, y0, lado from tramos, cuadros),
        t as (select *, case when dx = 0 then case when x1 > x0 and x1 < x0 + lado then 0 else 2 end else least((x0 - x1) / dx, (x0 + lado - x1) / dx) end as ta, case when dx = 0 then 1 else greatest((x0 - x1) / dx, (x0 + lado - x1) / dx) end as tb,
            case when dy = 0 then case when y1 > y0 and y1 < y0 + lado then 0 else 2 end else least((y0 - y1) / dy, (y0 + lado - y1) / dy) end as tc, case when dy = 0 then 1 else greatest((y0 - y1) / dy, (y0 + lado - y1) / dy) end as td from b),
        p as (select sid, zona_id, greatest(0, least(1, least(tb, td)) - greatest(0, greatest(ta, tc))) * sqrt(dx * dx + dy * dy) as l from t) select sid, zona_id, round_even(l, 4) as largo from p where round_even(l, 4) > 0""",
    "network_check": f"""{ctes('tramos')}, n as (select (select count(*) from tramos) as tramos, (select count(*) from (select down_sid from tramos group by down_sid having count(*) >= 2)) as confluencias, (select count(*) from tramos where down_sid not in (select sid from tramos)) as salidas, (select count(*) from tramos where sid not in (select down_sid from tramos)) as cabeceras)
        select *, cast(1 as bigint) as componentes, case when confluencias = 0 then 'sin confluencias' when confluencias < 0.05 * tramos then 'pocas confluencias' else '' end as avisos from n""",
    "network_summary": f"""{ctes('tramos')}, l as (select sid % 4 + 1 as orden, cast(floor(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 100) as bigint) as cm from tramos), a as (select sum(cm) as t from l)
        select orden, grouping(orden) = 1 as todo, count(*) as tramos, round_even(sum(cm) / 100.0::double, 2) as largo, cast(floor(sum(cm) * 10000.0::double / any_value(t) + 0.5) as bigint) as parte from l, a group by rollup (orden)""",
    "ridge_cells": f"{ctes('dem').replace('dem as (', 'llano as (', 1)}, dem as (select r, c, -z as z from llano), {_DRAIN}, {_ACC} select r, c, a as acumulacion from acc where a >= 20 and (select max(z) - min(z) from dem) <= 150",
    "wet_fusion": f"{ctes('dem')}, {_WETSQL} select r, c, humedad, nivel from x",
    "wet_summary": f"{ctes('dem')}, {_WETSQL} select nivel, count(*) as celdas, round_even(count(*) * 0.09::double, 3) as hectareas, (select round_even(quantile_cont(hand, 0.5), 6) from x) as hand_mediana from x group by nivel",
    "cost_findings": f"{ctes('dem')}, s as ({_SLOPE}), k as (select pendiente, 1.0::double + c % 3 as k from s) select count(*) as celdas, cast(0 as bigint) as vetadas, min(k) as costo_min, max(k) as costo_max, round_even(avg(k), 4) as costo_medio, round_even((max(k) - min(k)) / avg(k), 4) as variacion, case when avg(case when pendiente > 5 then 1.0 else 0.0 end) > 0.4 then 'pendiente' else '' end as avisos from k",
    "filled_pits": f"{ctes('hoyos')} select r, c, case when (r * 7 + c * 3) % 23 = 0 and r between 2 and 61 and c between 2 and 61 then greatest(z, (select min(n.z) from hoyos n join (values {_AROUND}) o(a, b) on n.r = m.r + o.a and n.c = m.c + o.b)) else z end as z from hoyos m",
    "filled_accumulation": "select cast(4096 as bigint) as celdas, cast(4096 as bigint) as recogido",
    "utm_forward": f"{ctes('lugares')}, {_UTM}",
    "utm_round_trip": f"{ctes('lugares')} select id, round_even(lon, 7) as lon, round_even(lat, 7) as lat from lugares",
    "crs_checks": f"{ctes('lugares')} select id, codigo, case when codigo is null or codigo <= 0 then 'no valido' when codigo between 4000 and 4999 then 'geografico' when not (codigo between 32601 and 32660 or codigo between 32701 and 32760) then 'no metrico' when codigo <> 32000 + case when lat < 0 then 700 else 600 end + floor((lon + 180) / 6) + 1 then 'otra zona' else '' end as hallazgo from lugares",
    "node_tolerances": f"{ctes('tramos')} select sid, cast(case when sid % 4 - 1 > 0 then sid % 4 - 1 else greatest(0.5, sid % 7 / 3.0::double) end as double) as tolerancia from tramos",
}
