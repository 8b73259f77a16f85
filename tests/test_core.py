"""Operators of the census, grids, networks and routes on cases whose answers are known."""

import heapq
import json
import math
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from silvara.functions.lookup import floor_lookup, threshold_cells, utm_epsg
from silvara.functions.text import as_float, normalize_field, normalize_species
from silvara.operators import allocation, census, flow, raster, routing, spatial
from silvara.plans.fixtures import view
from silvara.sources import files, sinks
from silvara.streaming import census as arriving


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def test_texts_and_numbers(spark):
    assert one(spark, normalize_species(F.lit("  Árbol  del Ñandú ")), normalize_field(F.lit(" D.A.P. (cm)º ")), normalize_species(F.lit(None).cast("string"))) == ("arbol del nandu", "d_a_p_(cm)", "")
    got = one(spark, *[as_float(F.lit(x)) for x in ("1,5", " 2 ", "1,234.5", "NA", "nan", "-3", "1e2", "inf")])
    assert got == (1.5, 2.0, None, None, None, -3.0, 100.0, None)


def test_lookups(spark):
    table = {1: 10.0, 2: 15.0, 3: 25.0, 4: 50.0}
    assert one(spark, *[floor_lookup(F.lit(v), table, 50.0) for v in (0, 1, 3, 4, 5)]) == (10.0, 10.0, 25.0, 50.0, 50.0)
    assert one(spark, *[raster.crossing_cost(F.lit(v)) for v in (0, 2, 4, 5)]) == (20.0, 60.0, 800.0, 1500.0)
    assert one(spark, utm_epsg(F.lit(-69.2), F.lit(-12.6)))[0] == 32719 and threshold_cells(22.5, 30) == 250


def test_orders_and_neighbourhoods(spark):
    assert [len(routing.neighbourhood(k)) for k in (1, 2, 3, 4)] == [8, 16, 32, 48]
    net = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (5, 0), (8, 9), (9, 8)], "sid long, down_sid long")
    got = {r.sid: (r.strahler, r.shreve) for r in flow.stream_orders(net).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 2), 4: (1, 1), 5: (2, 3), 8: (None, None), 9: (None, None)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 1)], "a long, b long")
    assert {tuple(r) for r in flow.components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_orders_of_a_long_main_stem(spark):
    n = 1200  # segments of the stem, each but the first with a source of its own
    net = spark.createDataFrame([(i, i + 1 if i < n else 0) for i in range(1, n + 1)] + [(10_000 + i, i) for i in range(2, n + 1)], "sid long, down_sid long")
    got = {r.sid: (r.strahler, r.shreve) for r in flow.stream_orders(net).collect()}
    assert got == {1: (1, 1)} | {i: (2, i) for i in range(2, n + 1)} | {10_000 + i: (1, 1) for i in range(2, n + 1)}
    with pytest.raises(ValueError):
        routing.least_costs(spark.createDataFrame([(0, 0, 0, 1, -1.0)], "r long, c long, r2 long, c2 long, w double"), spark.createDataFrame([(0, 0)], "r long, c long"))


def test_plane_slope_and_filled_pits(spark):
    plane = spark.createDataFrame([(r, c, 0.3 * 30 * c) for r in range(6) for c in range(6)], "r long, c long, z double")
    inner = raster.horn_slope(plane, 30.0).where("r between 1 and 4 and c between 1 and 4")
    assert {r.pendiente for r in inner.collect()} == {30.0}
    bowl = spark.createDataFrame([(r, c, 1.0 if (r, c) == (2, 2) else 5.0 + (0 if 0 < r < 4 and 0 < c < 4 else 1)) for r in range(5) for c in range(5)], "r long, c long, z double")
    assert flow.fill_depressions(bowl).where("r = 2 and c = 2").collect()[0].z == 6.0


def test_depressions_across_tiles(spark):
    cells = {(r, c): float((r * 37 + c * 61 + r * c * 13) % 23) for r in range(-3, 17) for c in range(19) if (r, c) != (14, 12)}
    for r in range(0, 12):  # a basin over several seams of tiles, with one way out at 30
        for c in range(4, 16):
            if (r, c) in cells and (r in (0, 11) or c in (4, 15)):
                cells[r, c] = 30.0 if (r, c) == (6, 15) else 50.0
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    want = {k: z for k, z in cells.items() if any((k[0] + a, k[1] + b) not in cells for a, b in ring)}
    heap = [(z, k) for k, z in want.items()]
    heapq.heapify(heap)
    while heap:
        z, (r, c) = heapq.heappop(heap)
        for k in ((r + a, c + b) for a, b in ring):
            if k in cells and k not in want:
                want[k] = max(z, cells[k])
                heapq.heappush(heap, (want[k], k))
    df = spark.createDataFrame([(*k, z) for k, z in cells.items()], "r long, c long, z double")
    for tile in (4, 512):
        assert {(x.r, x.c): x.z for x in flow.fill_depressions(df, tile).collect()} == want
    assert want[6, 9] == 30.0


def test_cost_of_cells_without_data_area_veto_and_ridges(spark):
    def costs(slopes, **more):
        k = len(slopes)
        slope = spark.createDataFrame([(0, c, v) for c, v in enumerate(slopes)], "r long, c long, pendiente double")
        none = lambda name, kind: spark.createDataFrame([], f"r long, c long, {name} {kind}")
        order = spark.createDataFrame([(0, 1, 2)], "r long, c long, orden int")
        more = {n: spark.createDataFrame([(0, *x) for x in v], "r long, c long" + ", cercania double" * (n == "ridge")) if isinstance(v, list) else v for n, v in more.items()}
        got = {x.c: x.costo for x in raster.cost_surface(slope, none("humedad", "double"), none("cercania", "double"), order, **more).collect()}
        return [got[c] for c in range(k)]

    assert costs([8.0, 0.0, None, math.nan]) == [2.0, 61.0, 100000.0, 100000.0]
    assert costs([8.0, 0.0, 0.0], area=[(0,), (1,)]) == [2.0, 61.0, 6.0]
    assert costs([8.0, 0.0, 0.0], area=[(0,), (1,)], outside=100000.0)[2] == 100000.0
    assert costs([8.0, 0.0, 0.0], veto=[(0,), (1,)]) == [100000.0, 100000.0, 1.0]
    assert costs([8.0, 0.0, 0.0], ridge=[(0, 1.0), (1, 1 / 3)], ridge_weight=1.0) == [1.0, 60.75, 1.0]
    assert costs([8.0, 0.0, 0.0], ridge=[(0, 1.0), (1, 0.8)], ridge_weight=1.0) == [2.0, 61.0, 1.0]  # ridges nearly everywhere tell nothing
    dem = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else 1.0 * c) for r in range(5) for c in range(5)], "r long, c long, z double")
    assert [(x.r, x.c) for x in raster.horn_slope(dem, 30.0).where("pendiente is null").collect()] == [(2, 2)]


def test_least_cost_is_dijkstras(spark):
    cells = [(r, c, float((r * 7 + c * 3) % 5), 1.0 + (r * c) % 4) for r in range(6) for c in range(6)]
    g = routing.edges(spark.createDataFrame(cells, "r long, c long, z double, costo double"), 30.0, 2).withColumn("w", routing.weight())
    links = {}
    for e in g.collect():
        links.setdefault((e.r, e.c), []).append((e.w, (e.r2, e.c2)))
    best, heap = {}, [(0.0, (0, 0)), (0.0, (5, 5))]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for w, v in links[u]:
                heapq.heappush(heap, (d + w, v))
    got = routing.least_costs(g, spark.createDataFrame([(0, 0), (5, 5)], "r long, c long")).collect()
    assert {(x.r, x.c): pytest.approx(x.costo) for x in got} == best


def test_lines(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))])
    cut, far = one(spark, routing.chaikin(line), routing.length(line))
    assert len(cut) == 6 and (cut[0].x, cut[-1].y) == (0.0, 10.0) and far == 20.0
    assert routing.simplify([(0, 0), (5, 0.1), (10, 0)], 1) == [(0, 0), (10, 0)]
    assert routing.without_spikes([(0, 0), (100, 0), (60, 1), (200, 0)]) == [(0, 0), (60, 1), (200, 0)]


def test_rings_and_directions(spark):
    site = spark.createDataFrame([(1, 5.0, 5.0)], "k long, px double, py double")
    assert spatial.snap_to_ring(site, "k", F.lit(False)).collect()[0].anillo is None
    got = spatial.snap_to_ring(site, "k", F.col("qx") > 40).collect()[0]
    assert (got.anillo, got.i, got.qx) == (2, 0, 55.0)
    assert one(spark, spatial.azimuth(F.lit(-1.0), F.lit(0.0)))[0] == 270.0


def test_segments_that_touch_meet(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 500.0, 100.0, 500.0, 900.0)], "ka long, x1 double, y1 double, x2 double, y2 double")
    rows = [
        (1, 4.0, -3.0, 4.0, 5.0, 4.0, 0.0),  # crosses
        (2, 3.0, 0.0, 3.0, 7.0, 3.0, 0.0),  # ends on it
        (3, 10.0, 0.0, 20.0, 5.0, 10.0, 0.0),  # end to end
        (4, 6.0, 0.0, 30.0, 0.0, 8.0, 0.0),  # a stretch in common
        (5, 10.0, 0.0, 15.0, 0.0, 10.0, 0.0),  # in line, end to end
        (6, 11.0, 0.0, 15.0, 0.0, None, None),  # in line, apart
        (7, 4.0, 1.0, 4.0, 5.0, None, None),
        (8, 2.0, 0.0, 2.0, 0.0, 2.0, 0.0),  # a point on it
        (9, 300.0, 500.0, 500.0, 500.0, 500.0, 500.0),  # ends on the other at a border of cells
    ]
    b = spark.createDataFrame([r[:5] for r in rows], "kb long, x1 double, y1 double, x2 double, y2 double")
    pairs = spatial.crossing_pairs(a, b, "ka", "kb")
    got = {(r.ka, r.kb): (r.este, r.norte) for r in spatial.crossing_points(pairs, "ka", "kb").collect()}
    assert got == {(2 if r[0] == 9 else 1, r[0]): r[5:] for r in rows if r[5] is not None}
    assert [r.kb for r in spatial.crossing_pairs(a, b, "ka", "kb", proper=True).collect()] == [1]


def test_zone_cells_by_brute_force(spark):
    ring = [(3.0, 2.0), (47.0, 9.0), (41.0, 44.0), (25.0, 21.0), (8.0, 39.0)]
    df = spark.createDataFrame([(1, [dict(x=x, y=y) for x, y in ring])], "k long, ring array<struct<x:double,y:double>>")
    got = {(r.r, r.c) for r in raster.rasterize(df, "k", "ring", 5.0).collect()}

    def inside(px, py):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    assert got == {(r, c) for r in range(12) for c in range(12) if inside((c + 0.5) * 5, (r + 0.5) * 5)}


def test_touched_cells_of_thin_and_small_polygons(spark):
    shapes = {
        1: [(1.0, 5.5), (29.0, 5.5), (29.0, 7.0), (1.0, 7.0)],  # a strip between two centre lines
        2: [(11.0, 11.0), (12.0, 11.0), (12.0, 12.0)],  # smaller than a cell
        3: [(3.0, 2.0), (47.0, 9.0), (41.0, 44.0), (25.0, 21.0), (8.0, 39.0)],
        4: [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)],  # along cell borders
        5: [(-7.0, -3.0), (13.0, 17.0), (-2.0, 14.0)],
    }
    df = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in ring]) for k, ring in shapes.items()], "k long, ring array<struct<x:double,y:double>>")
    got = {(r.k, r.r, r.c) for r in raster.rasterize_touched(df, "k", "ring", 5.0).collect()}

    def meets(ring, r, c):
        """Whether a side passes through the half-open square, by clipping it in fractions, or the centre lies inside."""
        odd, px, py = False, (c + 0.5) * 5, (r + 0.5) * 5
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
            cuts = {Fraction(0), Fraction(1)}
            for p, q, k in ((x0, x1, c), (y0, y1, r)):
                cuts |= {t for v in (5 * k, 5 * k + 5) if p != q and 0 <= (t := (v - Fraction(p)) / (Fraction(q) - Fraction(p))) <= 1}
            cuts = sorted(cuts)
            for t in cuts + [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]:
                if (math.floor((Fraction(x0) + t * (Fraction(x1) - Fraction(x0))) / 5), math.floor((Fraction(y0) + t * (Fraction(y1) - Fraction(y0))) / 5)) == (c, r):
                    return True
        return odd

    assert got == {(k, r, c) for k, ring in shapes.items() for r in range(-3, 12) for c in range(-3, 12) if meets(ring, r, c)}
    assert {(r, c) for k, r, c in got if k == 1} == {(1, c) for c in range(6)} and not raster.rasterize(df.where("k < 3"), "k", "ring", 5.0).count()


def test_assignment_keeps_capacity(spark):
    trees = spark.createDataFrame([(i, float(i), 0.0, 10.0) for i in range(30)] + [(99, 900.0, 0.0, 1.0)], "key long, x double, y double, v double")
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 25.0, 0.0)], "patio_id long, px double, py double")
    out = allocation.assign(trees, sites, 20.0, 100.0).collect()
    assert len(out) == 31 and max(sum(1 for r in out if r.patio_id == p) for p in (1, 2)) == 10 and all(r.dist <= 20 for r in out if r.patio_id > 0)
    assert {r.patio_id for r in out if r.key == 99} == {-1}


def test_middle_value_of_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 2.0)] + [("b", -1.0)], "g string, v double")
    assert [tuple(r) for r in census.middle_value(df, "g", "v").collect()] == [("a", 2.0, 4)]


def test_files(spark, tmp_path, data):
    (tmp_path / "d.csv").write_text("﻿especie;dmc_cm\ncedro;65\n moena ;46,5\n;3\n", encoding="utf-8")
    ref = files.reference_csv(spark, str(tmp_path / "d.csv"))
    assert sorted(map(tuple, ref.collect())) == [("cedro", 65.0), ("moena", 46.5)]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n1 2\n-9999 4.5\n")
    grid = files.ascii_grid(spark, str(tmp_path / "g.asc"))
    assert sorted((r.r, r.c, r.v) for r in grid.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.5)]
    assert [r.linea for r in sinks.ascii_grid_lines(grid, "v", 2).orderBy("r").collect()] == ["1.0 2.0", "-9999.0 4.5"]
    sinks.write_workbook(str(tmp_path / "w.xlsx"), {"a/b": ref, "c": ref.limit(0)})
    assert "moena" in zipfile.ZipFile(tmp_path / "w.xlsx").read("xl/worksheets/sheet1.xml").decode()
    sinks.write_docx(str(tmp_path / "w.docx"), "t", [("h", "x < y", ref)])
    assert "x &lt; y" in zipfile.ZipFile(tmp_path / "w.docx").read("word/document.xml").decode()
    assert "<td>65.00</td>" in sinks.html_report("t", [("h", "p", ref)])
    prints = files.fingerprints(spark, str(tmp_path / "*.asc"))
    assert json.loads(sinks.manifest(prints, {"a": 1}, spark.range(1)))["metricas"] == {"id": 0}
    assert (sinks.column_letters(0), sinks.column_letters(27), sinks.sheet_name("a:b" * 20)[:3]) == ("A", "AB", "a-b")


def test_running_checks_equal_the_batch(spark, tmp_path, data):
    t = spark.read.parquet(f"{data}/tree.parquet")
    (tmp_path / "in").mkdir()
    t.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = arriving.running_checks(arriving.arriving(spark, str(tmp_path / "in"), t), late="36500 days").writeStream.format("memory").queryName("checks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("checks").collect()} == {tuple(r) for r in arriving.running_checks(t).collect()}


def test_views_have_rows(spark, data):
    assert view(spark, data, "dem").count() == 4096 and view(spark, data, "patios").count() > 0


def test_volume(spark):
    t = spark.createDataFrame([(1, 1, 1.0, 10.0, 5.105088)], "fid long, censo_id long, dap_m double, altura_m double, volumen_m3 double")
    got = census.volumes(t, spark.createDataFrame([(1, 0.65)], "censo_id long, form_factor double")).collect()[0]
    assert got.volumen_calc == pytest.approx(5.1051) and got.factor == 0.65 and math.isclose(one(spark, census.basal(F.lit(2.0)))[0], math.pi)
