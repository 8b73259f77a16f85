"""Rules, coordinate systems, networks, yards and roads on cases whose answers are known."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvara import runtime
from silvara.functions import crs, lookup
from silvara.operators import allocation, census, flow, network, raster, roads, rules, spatial, yards
from silvara.plans import forest
from silvara.sources import files, sinks

SEGMENT = "sid long, x1 double, y1 double, x2 double, y2 double"


def test_filled_flats_drain(spark):
    """A filled bowl and a plain drain whole, also across tiles; a pit that is not filled keeps its nulls."""
    bowl = spark.createDataFrame([(r, c, 1.0 if (r, c) == (7, 7) else 5.0 + (0 if 0 < r < 14 and 0 < c < 14 else 1)) for r in range(15) for c in range(15)], "r long, c long, z double")
    filled = flow.fill_depressions(bowl, 4)
    drains = flow.resolve_flats(filled, flow.drainage(filled, 1.0), 4)
    rim = lambda r, c: r in (0, 14) or c in (0, 14)
    got = {(r.r, r.c): (r.nr, r.nc) for r in drains.collect()}
    assert len(got) == 225 and all(rim(*p) for p, q in got.items() if q[0] is None)
    water = {(r.r, r.c): r.acumulacion for r in flow.accumulation(drains).collect()}
    assert sum(water[p] for p, q in got.items() if q[0] is None) == 225
    raw = flow.resolve_flats(bowl, flow.drainage(bowl, 1.0), 4).where("r = 7 and c = 7").collect()[0]
    assert raw.nr is None
    ring = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 0, 0)], "r long, c long, nr long, nc long")
    for run in (flow.accumulation, lambda d: flow.outlets(d, d.select("r", "c").limit(0))):
        with pytest.raises(ValueError):
            run(ring)


def test_nearest_passes_over_places_that_are_missing(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 1000.0, 1000.0)], "k long, x double, y double")
    s = spark.createDataFrame([(7, 1.0, 0.0), (8, None, 0.0), (9, 9.0, 0.0), (6, 11.0, 0.0)], "sitio long, px double, py double")
    want = {(1, 7, 1.0), (2, 6, 1.0), (5, 6, (989.0**2 + 1e6))}
    assert {tuple(r) for r in spatial.nearest(p, s, "k", "sitio").collect()} == want
    assert {tuple(r) for r in spatial.nearest(p, s, "k", "sitio", most_sites=2).collect()} == want  # met in cells
    assert spatial.nearest(p, s.limit(0), "k", "sitio").count() == 0


def test_broadcasts_and_checkpoints(spark, monkeypatch):
    assert "broadcast" in runtime.small(spark.range(10))._jdf.queryExecution().toString().lower()
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert "broadcast" not in runtime.small(wide, most_bytes=5000)._jdf.queryExecution().toString().lower()
    t = runtime.cut(spark.range(3))
    runtime.drop(t, spark.range(1))
    with pytest.raises(Exception):
        t.count()

    class Far:
        class sparkContext:
            master = "spark://far:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Far)


def test_projection_and_codes(spark):
    """A place whose grid coordinates are published, one that goes there and back, and none."""
    df = spark.createDataFrame([(2.2945, 48.8583), (-69.2, -12.6), (None, 1.0)], "lon double, lat double")
    e, n = crs.to_grid(F.col("lon"), F.col("lat"))
    lon, lat = crs.to_degrees(e, n, crs.utm_zone(F.col("lon")), F.col("lat") < 0)
    a, b, c = df.select(e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat")).collect()
    assert (a.e, a.n) == (pytest.approx(448251.9, abs=1), pytest.approx(5411943.8, abs=1)) and (b.lon, b.lat) == (pytest.approx(-69.2, abs=1e-9), pytest.approx(-12.6, abs=1e-9))
    assert c.e is None
    codes = spark.createDataFrame([(32719,), (4326,), (3857,), (None,), (32619,)], "k int")
    assert [r[0] for r in codes.select(crs.crs_finding(F.col("k"), F.lit(-69.2), F.lit(-12.6))).collect()] == ["", "geografico", "no metrico", "no valido", "otra zona"]


def test_rules(spark):
    df = spark.createDataFrame([(" AGUAJAL Mixto ",), ("Área Natural Protegida",), (None,), ("",), ("ＡＢ",)], "t string")
    assert [tuple(r) for r in df.select(rules.plain("t"), rules.mentions("t", rules.WETLAND), rules.mentions("t", rules.PROTECTED)).collect()][:4] == [("aguajal mixto", True, False), ("area natural protegida", False, True), (None, False, False), ("", False, False)]
    assert rules.class_field({"id": "bigint", "Descripción": "string", "x": "string"}) == "Descripción" and rules.class_field({"n": "int", "a": "string"}) == "a" and rules.class_field({"n": "int"}) is None
    r = spark.createDataFrame([(1, "a", "c", ["x", "o'y"], "VETO_LEGAL", 1.0), (2, None, " ", [], "?", float("nan")), (3, "a", "c", None, "PREFERENCIA", 0.5)], "regla int, capa string, campo string, valores array<string>, rol string, peso double")
    got = {x.regla: x for x in rules.judged(r).collect()}
    assert got[1].problemas == [] and got[1].filtro == "\"c\" IN ('x','o''y')" and got[2].problemas == ["capa", "campo", "valores", "rol", "peso"] and got[3].problemas == ["valores"] and got[3].filtro is None
    f = spark.createDataFrame([(1, "x", 9), (2, "X", 9), (3, None, 9)], "k long, v string, regla int")
    assert [tuple(x) for x in rules.chosen(f, "k", "v", r).collect()] == [(1, 1, "VETO_LEGAL", 1.0)]


def test_typed_parameters():
    assert lookup.width_table([("1", "10"), ("2", "15,5"), ("x", "3"), ("4", ""), (" 3 ", " 25.0 ")]) == {1: 10.0, 2: 15.5, 3: 25.0}
    assert lookup.scenario_numbers("3; 1,x,0,-2, 3") == (1, 3) and lookup.scenario_numbers("") == (1, 2, 3) == lookup.scenario_numbers(None)
    assert lookup.exit_point(0, 0) is None is lookup.exit_point(None, 1) and lookup.exit_point(0, 5) == (0.0, 5.0)


def test_clipped_lines(spark):
    ring = [(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10)]  # a U
    region = spark.createDataFrame([(1, [dict(x=float(x), y=float(y)) for x, y in ring])], "zona_id long, ring array<struct<x:double,y:double>>")
    s = spark.createDataFrame([(1, -5.0, 7.0, 15.0, 7.0), (2, 1.0, 1.0, 2.0, 2.0), (3, 20.0, 20.0, 30.0, 30.0), (4, 5.0, 12.0, 5.0, 2.0)], SEGMENT)
    inside = {}
    for r in network.clipped(s, "sid", region, "zona_id", "ring").collect():
        inside[r.sid] = inside.get(r.sid, 0) + r.largo
    assert inside == pytest.approx({1: 8.0, 2: math.sqrt(2), 4: 2.0})
    out = network.clipped(s, "sid", region, "zona_id", "ring", outside=True).groupBy("sid").agg(F.sum("largo").alias("l"))
    assert {r.sid: r.l for r in out.collect()} == pytest.approx({1: 12.0, 4: 8.0})


def test_strips_count_their_ground_once(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 500.0, 0.0, 1500.0, 0.0), (3, 700.0, 0.0, 700.0, 0.0)], SEGMENT).withColumn("w", F.lit(20.0))
    area = raster.strip_cells(s, "w", 2.0).count() * 4
    assert area == pytest.approx(1500 * 20 + math.pi * 100, rel=0.01)


def yards_of(rng, n=150):
    return np.column_stack([rng.uniform(0, 1500, n), rng.uniform(0, 1500, n)]), rng.uniform(0.5, 8, n)


def test_yard_loops():
    rng = np.random.default_rng(2)
    xy, v = yards_of(rng)
    walls = np.array([[750.0, -10.0, 750.0, 1510.0]])
    blocked = {(i, j) for i in range(60) for j in range(60) if (i + j) % 2}
    sites, own, crossing = yards.plan(xy, v, blocked, walls, 25.0)
    load = np.bincount(own[own >= 0], weights=v[own >= 0])
    d = np.sqrt(((xy - sites[np.maximum(own, 0)]) ** 2).sum(1))
    assert (own >= 0).all() and load.max() <= yards.CAPACITY and d.max() <= yards.RADIUS and len(sites) == len(load) and (load > 0).all()
    straight = (xy[:, 0] - 750) * (sites[own, 0] - 750) < 0
    assert (crossing == straight).all()
    # One tree a yard may not be merged away if that would leave it alone.
    lone = np.array([[0.0, 0.0], [5000.0, 0.0]])
    sites, own, _ = yards.plan(lone, np.array([1.0, 1.0]), set(), np.zeros((0, 4)), 25.0)
    assert len(sites) == 2 and sorted(own.tolist()) == [0, 1]


def test_planned_yards_of_blocks(spark):
    rng = np.random.default_rng(3)
    xy, v = yards_of(rng, 60)
    rows = [(b, i, float(x), float(y), float(w)) for b in (1, 2) for i, ((x, y), w) in enumerate(zip(xy, v))] + [(1, 900, 1.0, 1.0, 0.0)]
    t = spark.createDataFrame(rows, "bloque long, key long, x double, y double, v double")
    none = spark.createDataFrame([], "bloque long, gx long, gy long"), spark.createDataFrame([], "bloque long, x1 double, y1 double, x2 double, y2 double")
    p = yards.plan_yards(t, *none, 25.0)
    got = {(r.bloque, r.key): (r.patio_id, r.px, r.py) for r in p.collect()}
    assert len(got) == 120 and all(got[1, k] == got[2, k] for k in range(60))  # no volume, no part; equal blocks, equal plans
    assert yards.plan_yards(t.limit(0), *none, 25.0).count() == 0


def test_road_growth(spark):
    cells = spark.createDataFrame([(1, r, c, 0.0, 1.0) for r in range(20) for c in range(20) if not (9 <= c <= 12 and r != 3)] + [(2, r, c, 0.0, 1.0) for r in range(5) for c in range(5)], "plan long, r long, c long, z double, costo double")
    goal = spark.createDataFrame([(1, 1, "principal", 195.0, 105.0, 5.0), (1, 2, "secundaria", 165.0, 35.0, 9.0), (1, 3, "principal", 999.0, 5.0, 7.0), (1, 4, "principal", 105.0, 105.0, 1.0), (2, 1, "principal", 45.0, 45.0, 3.0)], "plan long, destino long, jerarquia string, x double, y double, volumen double")
    start = spark.createDataFrame([(1, 5.0, 105.0), (2, 0.0, 0.0)], "plan long, x double, y double")
    none = spark.createDataFrame([], "plan long, via long, linea array<struct<x:double,y:double>>")
    got = {(r.plan, r.destino): r for r in roads.grow_network(cells, goal, start, none, 10.0, served=80.0).collect()}
    assert {k: r.estado for k, r in got.items()} == {(1, 1): "trazada", (1, 2): "servida", (1, 3): "fuera", (1, 4): "fuera", (2, 1): "inalcanzable"}
    assert got[1, 1].largo >= 2 * math.hypot(95, 70) * 0.99 and (got[1, 1].linea[0].x, got[1, 1].linea[-1].x) == (5.0, 195.0)
    f = roads.road_findings(roads.grow_network(cells, goal, start, none, 10.0, served=80.0), spark.createDataFrame([(1,), (4,)], "orden int"), 100.0).collect()[0]
    assert f.volumen_atrapado == 11.0 and f.avisos == "volumen atrapado" and (f.alcantarillas, f.puentes) == (1, 1)


def test_terrain_marks_and_measures():
    import pandas as pd

    land = roads.Terrain(pd.DataFrame([(r, c, 10.0 * c, 100.0) for r in range(30) for c in range(30)], columns=["r", "c", "z", "costo"]), 10.0)
    land.mark([(15, 15)], 6.0, 0.001)
    assert land.cost[15, 15] == 0.001 and land.cost[15, 20] == 40.0 and land.cost[15, 25] == 100.0
    m = land.measured([(0, 0), (0, 1), (0, 2)])
    assert (m["largo"], m["rasante_max"], m["desnivel"], m["sobre_limite"], m["excede"]) == (20.0, 100.0, 20.0, 2, False)
    assert land.at(-1.0, 5.0) is None and land.at(5.0, 5.0) == (0, 0)


def test_scenarios_are_chosen_and_applied(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 10.0, 0.0, 1.0)], "key long, px double, py double, w double")
    s = spark.createDataFrame([(2, 1, 0.0, 0.0), (2, 2, 10.0, 0.0), (1, 1, 5.0, 0.0)], "n int, centro long, cx double, cy double")
    assert {(r.key, r.centro, r.saca) for r in allocation.chosen_scenario(s, sites).collect()} == {(1, 1, 5.0), (2, 1, 5.0)}
    assert {(r.key, r.centro, r.saca) for r in allocation.chosen_scenario(s, sites, 2).collect()} == {(1, 1, 0.0), (2, 2, 0.0)}


def test_layers_grids_and_lists(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", dict(x=1.5, y=2.0), [[dict(x=0.0, y=0.0), dict(x=1.0, y=0.0), dict(x=0.0, y=1.0)]]), (2, None, None, None)], "id long, t string, g struct<x:double,y:double>, p array<array<struct<x:double,y:double>>>")
    rows = [json.loads(r.value) for r in sinks.features(p, "g", ["id", "t"]).collect()]
    assert rows[0] == {"type": "Feature", "properties": {"id": 1, "t": "a"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}} and rows[1]["geometry"] is None
    ring = json.loads(sinks.features(p, "p", ["id"]).collect()[0].value)["geometry"]
    assert ring["type"] == "Polygon" and ring["coordinates"][0][0] == ring["coordinates"][0][-1] and len(ring["coordinates"][0]) == 4
    body = "\n".join(" ".join(str(r * 50 + c) if (r, c) != (2, 3) else "-9999" for c in range(50)) for r in range(400))
    (tmp_path / "g.asc").write_text(f"ncols 50\nnrows 400\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n{body}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cells = files.ascii_grid(spark, str(tmp_path / "g.asc"))
        assert cells.count() == 19_999 and cells.where(F.col("v") != F.col("r") * 50 + F.col("c")).count() == 0
        assert cells.select("grid.*").distinct().collect()[0].asDict() == {"x0": 10.0, "y0": 20.0, "cell": 5.0, "ncols": 50}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sinks.write_reference_csv(spark.createDataFrame([("ñandí", 41.5)], "especie string, dmc_cm double"), str(tmp_path / "d"))
    text = next((tmp_path / "d").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfespecie;dmc_cm") and [tuple(r) for r in files.reference_csv(spark, str(tmp_path / "d")).collect()] == [("ñandí", 41.5)]
    assert [sinks.column_letters(i) for i in (0, 25, 26, 51, 701, 702)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    t = spark.createDataFrame([(1, "Pino rojo"), (2, "PINO ROJO"), (3, ""), (4, None)], "fid long, especie string")
    assert [tuple(r) for r in files.merge_reference(t, spark.createDataFrame([("pino rojo", 41.0)], "especie string, dmc_cm double"), "fid").collect()] == [("Pino rojo", 41.0)]


def test_fields_and_modes(spark):
    fields = spark.createDataFrame([(0, "OBJECTID"), (1, "D.A.P."), (2, "dap_cm"), (3, "HC"), (4, "Especie")], "orden int, campo string")
    got = {r.rol: r.campo for r in census.field_roles(fields).collect()}
    assert got == {"id": None, "especie": "Especie", "categoria": None, "dap": "dap_cm", "altura": "HC", "volumen": None, "parcela": None}
    v = spark.range(1).select(*[census.to_metres(F.lit(314.159265), F.lit(m)) for m in ("DAP_M", "DAP_CM", "CAP_CM", "otro")]).collect()[0]
    assert v[0] == 314.159265 and v[1] == pytest.approx(3.14159265) and v[2] == pytest.approx(1.0) and v[3] is None


def test_nearest_yard_is_found_for_each_tree_alone(spark, data):
    """ties go to the smaller number, the radius counts, rows stay as they are, without a join of trees and yards; any number of yards gives the same."""
    rng = np.random.default_rng(5)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-30, 130, (400, 2)))]
    p = spark.createDataFrame([*places, places[0], (900, None, 1.0), (901, float("nan"), 1.0), (902, 5000.0, 0.0)], "k long, x double, y double")
    sites = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(60), rng.integers(0, 100, (60, 2)))]
    s = spark.createDataFrame([*sites, (99, None, 0.0)], "sitio long, px double, py double")
    want = {}
    for k, x, y in places:
        d2, site = min(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in sites)
        want[k] = (site, d2) if d2 <= 15.0**2 else (None, None)
    assert any(v[0] is None for v in want.values()) and any(v[0] is not None for v in want.values())
    for most in (1000, 10):
        got = spatial.with_nearest(p, s, "sitio", 15.0, most_sites=most).collect()
        assert len(got) == 404 and all((r.sitio, r.d2) == want.get(r.k, (None, None)) for r in got)
        assert all((r.sitio, r.px, r.py) in sites for r in got if r.sitio is not None)
    assert {r.sitio for r in spatial.with_nearest(p, s.limit(0), "sitio", 15.0).collect()} == {None}
    assert forest._nearest_yard(spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # of trees and species only


@pytest.mark.parametrize(("query", "joins"), [("skid_lines", 1), ("yard_species", 1), ("yard_orphans", 1), ("yard_table", 1), ("yard_totals", 1)])
def test_queries_of_nearest_yards_pair_no_trees(spark, data, query, joins):
    """F8: trees meet their species once and no table of pairs."""
    assert forest.QUERIES[query](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Join") == joins


def test_pairs_of_segments_come_once(spark, monkeypatch):
    """segments of all lengths, each pair in one cell only and without a table of what was met; as arrays and as a join alike."""
    rng = np.random.default_rng(7)
    ends = rng.integers(0, 60, (80, 4)).astype(float)
    ends[40:, 2:] = ends[40:, :2] + rng.integers(-3, 4, (40, 2))
    rows = [(i, *map(float, e)) for i, e in enumerate(ends)] + [(90, None, 0.0, 60.0, 60.0), (91, 0.0, 0.0, float("nan"), 9.0)]
    t = spark.createDataFrame(rows, SEGMENT)
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    between = lambda a, b, c: side(a, b, c) == 0 and all(min(u, v) <= w <= max(u, v) for u, v, w in zip(a, b, c))
    want = {True: [], False: []}
    for i, j in ((i, j) for i in range(80) for j in range(i + 1, 80)):
        a, b, c, d = ends[i, :2], ends[i, 2:], ends[j, :2], ends[j, 2:]
        crossing = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
        want[True] += [(i, j)] * bool(crossing)
        want[False] += [(i, j)] * bool(crossing or between(a, b, c) or between(a, b, d) or between(c, d, a) or between(c, d, b))
    assert 0 < len(want[True]) < len(want[False])
    for most in (spatial.BOX_ROWS, 0):
        monkeypatch.setattr(spatial, "BOX_ROWS", most)
        for proper in (True, False):
            p = spatial.crossing_pairs(t, t.withColumnRenamed("sid", "sid2"), "sid", "sid2", 5.0, proper, once=True)
            assert sorted((r.sid, r.sid2) for r in p.collect()) == want[proper]
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Deduplicate" not in plan


def test_cells_inside_strips_need_no_segments(spark):
    """a cell that a strip holds whole keeps only wider strips, and classes are those of every point against every segment."""
    rng = np.random.default_rng(11)
    seg = [(*map(float, e), float(w)) for e, w in zip(rng.integers(0, 1000, (60, 4)), rng.choice([5.0, 40.0, 120.0], 60))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-100, 1100, (500, 2)))]
    want = {}
    for i, x, y in pts:
        for a, b, c, d, w in seg:
            l2 = (c - a) ** 2 + (d - b) ** 2
            t = min(max(((x - a) * (c - a) + (y - b) * (d - b)) / l2, 0.0), 1.0) if l2 else 0.0
            if (x - a - t * (c - a)) ** 2 + (y - b - t * (d - b)) ** 2 <= w * w:
                want[i] = max(want.get(i, 0.0), w)
    p, s = spark.createDataFrame(pts, "k long, x double, y double"), spark.createDataFrame(seg, "x1 double, y1 double, x2 double, y2 double, ancho double")
    for side in (50.0, 400.0):
        assert dict(map(tuple, spatial.strip_class(p, s, ["k"], "ancho", side).collect())) == want
    assert {40.0, 120.0} <= set(want.values())
    seen = []
    kept = spatial.small
    try:
        spatial.small = lambda df: seen.append(df.count()) or kept(df)
        spatial.strip_class(p, s, ["k"], "ancho", 50.0)
    finally:
        spatial.small = kept
    assert seen[-1] < 0.8 * spatial.segment_cells(s, 50.0, F.col("ancho")).count()


def test_volumes_of_strips_meet_no_trees_again(spark, data):
    """trees meet their species and the strips, not themselves."""
    from silvara.plans import terrain

    plan = terrain.riparian_volume(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_assignment_by_batches_is_that_by_pairs(spark):
    """trees that come sorted and look up their sites get what all pairs at once give; a tree without a place or volume has no site."""
    rng = np.random.default_rng(13)
    trees = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(zip(rng.integers(0, 300, 900), rng.integers(0, 300, 900), rng.integers(1, 9, 900)))]
    trees += [(1000, None, 1.0, 1.0), (1001, 5.0, 5.0, None), (1002, 9000.0, 0.0, 1.0)]
    t = spark.createDataFrame(trees, "key long, x double, y double, v double")
    s = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 300, (40, 2)), 1)] + [(50, 2000.0, 0.0)], "patio_id long, px double, py double")
    want = sorted(map(tuple, allocation.assign(t, s, 40.0, 60.0, most_sites=0).collect()), key=lambda r: r[0])
    got = sorted(map(tuple, allocation.assign(t, s, 40.0, 60.0).collect()), key=lambda r: r[0])
    clean = lambda rows: [(k, p, None if d is None or d != d else d) for k, p, d in rows]
    assert len(got) == 903 and clean(got) == clean(want) and len({p for _, p, _ in got}) > 10
    plan = allocation.assign(t, s, 40.0, 60.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert {r.patio_id for r in allocation.assign(t, s.limit(0), 40.0, 60.0).collect()} == {-1}


def test_yard_plan_pairs_no_trees(spark, data):
    """F16: the plan of yards has the join of trees and species only."""
    from silvara.plans import terrain

    assert terrain.QUERIES["yard_plan"](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_trees_choose_as_one_by_one(monkeypatch):
    """the choices of a block are those of trees one after another, with what a crossing costs, without a table of all distances."""
    rng = np.random.default_rng(17)
    xy, v, sites = rng.integers(0, 900, (400, 2)).astype(float), rng.integers(1, 20, 400).astype(float), rng.integers(0, 900, (12, 2)).astype(float)
    crosses = rng.random((400, 12)) < 0.4
    d = np.sqrt(((xy[:, None] - sites[None]) ** 2).sum(2))
    for walls in (None, crosses):
        load, own = np.zeros(12), np.full(400, -1)
        for i in np.lexsort((-v, (d <= 300).sum(1))):
            price = d[i] + (np.where(walls[i], yards.CROSSING, 0.0) if walls is not None else 0.0)
            for s in np.argsort(price, kind="stable"):
                if d[i, s] <= 300 and load[s] + v[i] <= 250:
                    load[s] += v[i]
                    own[i] = s
                    break
        got = yards._assigned(xy, v, sites, 300.0, 250.0, walls)
        assert (got[0] == own).all() and (got[1] == load).all() and (own < 0).any()


def test_meeting_pairs_keep_no_doubles(spark, data):
    """nothing is gathered to drop doubles."""
    from silvara.plans import terrain

    plan = terrain.QUERIES["meeting_pairs"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_pairs_within_keep_points_in_their_partitions(spark, monkeypatch):
    """sites in their cells go to all executors and points are not shuffled; west and south of the origin, and by a join of both sides, the pairs are the same."""
    rng = np.random.default_rng(19)
    at, sites = [[tuple(map(float, x)) for x in rng.integers(-100, 100, (n, 2))] for n in (150, 40)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(at)], "k long, x double, y double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "sitio long, px double, py double")
    want = sorted((i, j) for i, a in enumerate(at) for j, b in enumerate(sites) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 400)
    for most, hint in ((spatial.BOX_ROWS, True), (0, False)):
        monkeypatch.setattr(spatial, "BOX_ROWS", most)
        near = spatial.within(p, s, 20.0)
        assert sorted((r.k, r.sitio) for r in near.collect()) == want
        assert ("strategy=broadcast" in near._jdf.queryExecution().optimizedPlan().toString()) == hint


def test_rounding_without_decimals(spark):
    """coordinates of crossings are rounded as by bround, ties, large and missing numbers included."""
    v = [0.00005, 0.00015, -0.00005, -0.00001, 1.00025, 123456.78905, 1e13 + 0.5, 2.5e8 + 0.00005, float("nan"), float("inf"), -0.0, None, *np.random.default_rng(23).uniform(-1e5, 1e5, 2000).tolist()]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select(F.bround("v", 4).cast("string").alias("a"), spatial.rounded(F.col("v")).cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and len(rows) == len(v)


def test_meeting_points_keep_no_doubles(spark, data):
    """places come with the pairs, and rounding is by whole multiples."""
    from silvara.plans import terrain

    plan = terrain.QUERIES["meeting_points"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "rint" in plan.lower()


def test_meeting_points_come_from_the_pass(spark, data, monkeypatch):
    """places are worked out where segments are compared, so no ends leave the pass; by a join, and where cells share a hash, pairs and places are the same to the last bit."""
    import re

    from silvara.plans import terrain

    plan = terrain.QUERIES["meeting_points"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    given = re.findall(r"MapInArrow .*?\)#\d+, \[(.*?)\]", plan)
    assert given and all("este" in x and "norte" in x and "x1" not in x for x in given)
    rng = np.random.default_rng(29)
    at = np.concatenate([rng.integers(-20, 20, (120, 4)).astype(float), rng.uniform(-20, 20, (60, 4)), np.round(rng.uniform(-20, 20, (60, 4)), 1)])
    at[:30, 3] = at[:30, 1]  # level ones, with stretches in common
    rows = [(i, *map(float, x)) for i, x in enumerate(at)] + [(240, *map(float, at[0])), (None, 0.0, 0.0, 9.0, 9.0)]
    t = spark.createDataFrame(rows, "sid long, x1 double, y1 double, x2 double, y2 double")

    def found(most, hashed, proper, once):
        monkeypatch.setattr(spatial, "BOX_ROWS", most)
        monkeypatch.setattr(spatial, "_box_cells", hashed)
        d = t if once else t.dropna()
        p = spatial.crossing_pairs(d, d.withColumnRenamed("sid", "sid2"), "sid", "sid2", 5.0, proper, once, meet=True)
        return sorted((r.sid, r.sid2, r.este.hex(), r.norte.hex()) for r in p.collect())

    cells = spatial._box_cells
    for proper, once in ((False, True), (True, False)):
        want = found(0, cells, proper, once)
        assert len(want) > 1000 and found(600_000, cells, proper, once) == want
        assert found(600_000, lambda *a: cells(*a).withColumn("_h", F.lit(7).cast("long")), proper, once) == want


def test_yard_loops_know_all_streams(spark, tmp_path):
    """every stream is a wall in all blocks that its ways may come to, not the first twenty; the same as by a comparison of each way with each stream."""
    from silvara.plans.fixtures import view

    at = "/root/testdata/sf0.01"
    spark.read.parquet(f"{at}/lineitem.parquet").where("l_orderkey % 40 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("part", "supplier"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    lines = np.array([tuple(map(float, r)) for r in view(spark, str(tmp_path), "tramos").select("x1", "y1", "x2", "y2").collect()])
    rows = forest.QUERIES["yard_loops"](spark, str(tmp_path)).where("patio_id is not null").toPandas()
    assert len(lines) == 100 and len(rows) > 1000 and rows["bloque"].nunique() == 16
    assert list(rows["cruza"]) == [bool(_met_by_any(*w, lines)) for w in rows[["x", "y", "px", "py"]].to_numpy()]


def _met_by_any(ax, ay, bx, by, lines):
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    cx, cy, dx, dy = lines.T
    o1, o2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    return ((o1 * o2 <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0) & ~((o1 == 0) & (o2 == 0))).any()


def test_walls_of_cells_are_all_walls():
    """walls in cells stop the same ways as all of them one by one, be they few or many, upright, level, points, doubled, missing or outside, and touched in whole numbers."""
    rng = np.random.default_rng(31)
    for n, size in ((0, 100), (1, 3000), (40, 2500), (900, 700)):
        for grain in (0, 25):
            w, a = rng.uniform(-size, 2 * size, (n, 4)), rng.uniform(0, size, (400, 2))
            w[::3, 2:] = w[::3, :2] + rng.uniform(-50, 50, w[::3, 2:].shape)
            w[1::7, 2], w[2::7, 3], w[5::19, 2:], w[6::30] = w[1::7, 0], w[2::7, 1], w[5::19, :2], np.nan
            b = a + rng.uniform(-300, 300, a.shape)
            b[:40, 0], b[40:80, 1], b[80:85] = a[:40, 0], a[40:80, 1], a[80:85]
            if grain:
                w, a, b = (np.round(c / grain) * grain for c in (w, a, b))
            ends = np.vstack([a, b])
            w = np.vstack([w, w[:3]])
            assert yards.Walls(w, ends.min(0), ends.max(0)).met(a, b).tolist() == [bool(_met_by_any(*p, *q, w)) for p, q in zip(a, b)]


def test_yards_are_planned_without_pairs(monkeypatch):
    """the passes of a plan make no table of all pairs in reach, and starting places are drawn from sums of chunks; what is chosen is the same as tree by tree and draw by draw."""
    rng = np.random.default_rng(37)
    made = []
    within = spatial.Index.within
    monkeypatch.setattr(spatial.Index, "within", lambda self, x, y: made.append(len(x)) or within(self, x, y))
    xy, v = yards_of(rng, 3000)
    sites, own, _ = yards.plan(xy, v, set(), np.zeros((0, 4)), 25.0)
    assert not made and len(sites) > 20 and (own >= 0).any()
    for grain in (0, 30):
        xy, s, v = rng.uniform(0, 1500, (2500, 2)), rng.uniform(0, 1500, (40, 2)), rng.integers(1, 30, 2500) / 3
        if grain:
            xy, s, v = np.round(xy / grain) * grain, np.round(s / grain) * grain, np.round(v)
        d = np.sqrt(((xy[:, None] - s[None]) ** 2).sum(2))
        assert (yards.Reach(xy, 300.0).count(s) == (d <= 300).sum(1)).all()
        ids, step = rng.permutation(40) * 3 + 5, 128
        index = spatial.Index(ids, s[:, 0], s[:, 1], 300.0)
        d = np.sqrt((xy[:, None, 0] - index.sx) ** 2 + (xy[:, None, 1] - index.sy) ** 2)
        most, load, place = float(round(v.sum() / 44)), np.zeros(40), np.full(2500, -1)
        for i in range(2500):
            for k in np.lexsort((index.ids, d[i])):
                if d[i, k] <= 300 and load[k] + v[i] <= most:
                    load[k] += v[i]
                    place[i] = k
                    break
        got = np.zeros(40)
        at, far = allocation.settled(index, xy[:, 0], xy[:, 1], v, most, got, step=step)
        assert (at == place).all() and (got == load).all() and (place < 0).any() and (far[at >= 0] == d[at >= 0, at[at >= 0]]).all() and np.isnan(far[at < 0]).all()
        whole = allocation.seeds(xy, v, 300, 5)
        monkeypatch.setattr(allocation, "MANY", 0)
        assert (allocation.seeds(xy, v, 300, 5) == whole).all()
        monkeypatch.setattr(allocation, "MANY", 20_000)


def test_crossings_are_asked_for_where_they_decide():
    """with the most that a crossing costs, sites further than that beyond the nearest are not asked about, and trees get the same sites at the same price."""
    rng = np.random.default_rng(41)
    for grain in (0, 30):
        xy, s, v = rng.uniform(0, 1500, (2500, 2)), rng.uniform(0, 1500, (60, 2)), rng.integers(1, 30, 2500) / 3
        if grain:
            xy, s, v = np.round(xy / grain) * grain, np.round(s / grain) * grain, np.round(v)
        index, crosses = spatial.Index(rng.permutation(60) * 3 + 5, s[:, 0], s[:, 1], 600.0), rng.random((2500, 60)) < 0.5
        for most in (float(round(v.sum() / 66)), 1e6):
            out, asked = [], []
            for told in (None, 60.0):
                n, load = [], np.zeros(60)
                out.append((*allocation.settled(index, xy[:, 0], xy[:, 1], v, most, load, lambda i, k: n.append(len(i)) or np.where(crosses[i, k], 60.0, 0.0), 128, told), load))
                asked.append(sum(n))
            assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(*out)) and (most < 1e6) == bool((out[0][0] < 0).any())
            assert most < 1e6 or asked[1] < 0.5 * asked[0]
