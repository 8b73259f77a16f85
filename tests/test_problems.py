"""Problems 1, 3 and 4 against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from silvara.operators import impute, proximity, units

TREE = "fid long, censo_id long, codigo string, x double, y double, especie string, dap_m double, altura_m double, volumen_m3 double, volumen_calculado boolean, registrado_ts timestamp, valor string, campo string, soporte long"
WHEN = dt.datetime(2024, 5, 1)


def tree(spark, rows):
    """Rows are dicts; the columns valor, campo and soporte clash with names that the operators use."""
    names = [c.split()[0] for c in TREE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TREE)


def test_fill_takes_the_finest_group_with_support(spark):
    rows = [dict(fid=i, censo_id=1, especie="Tamborí", dap_m=0.5, altura_m=10.0, volumen_m3=2.0, volumen_calculado=True, registrado_ts=WHEN) for i in range(8)]
    rows += [dict(fid=100 + i, censo_id=2, especie="otro", dap_m=0.5, altura_m=20.0, volumen_m3=5.0, volumen_calculado=False, registrado_ts=WHEN) for i in range(30)]
    rows += [dict(fid=200, censo_id=1, especie=" tambori", dap_m=0.51, altura_m=99.0, volumen_m3=-9999.0, registrado_ts=WHEN)]
    rows += [dict(fid=201, censo_id=3, altura_m=float("nan"), volumen_m3=0.0, volumen_calculado=True)]
    got = {(r.fid, r.campo): r for r in impute.fill_cells(tree(spark, rows)).collect()}
    assert set(got) == {(200, "altura_m"), (200, "volumen_m3"), (200, "volumen_calculado"), (201, "altura_m"), (201, "volumen_m3")}
    assert got[200, "altura_m"].valor == pytest.approx(10.0) and got[200, "altura_m"].nivel == 0
    assert got[200, "volumen_m3"].valor == pytest.approx(2.0, rel=0.02)
    assert got[200, "volumen_calculado"].valor == 1.0
    assert got[201, "altura_m"].nivel == len(impute.LEVELS) - 1 and got[201, "altura_m"].valor == pytest.approx(20.0)


def test_fill_table_keeps_rows_and_marks(spark):
    rows = [dict(fid=i, censo_id=1, especie="a", altura_m=10.0 if i else None, volumen_m3=1.0, volumen_calculado=True, valor="x") for i in range(12)]
    out = impute.fill_table(tree(spark, rows)).orderBy("fid").collect()
    assert len(out) == 12 and out[0].altura_m == pytest.approx(10.0) and out[0].altura_m_lleno and not out[1].altura_m_lleno and out[0].valor == "x"
    assert impute.fill_cells(tree(spark, [])).count() == 0
    assert impute.fill_cells(tree(spark, [dict(fid=1)])).count() == 0  # nothing can fill it


def test_pairs_and_regions_against_brute_force(spark):
    random.seed(5)
    rows = [dict(fid=i, x=round(random.uniform(-60, 60), 2), y=round(random.uniform(-60, 60), 2)) for i in range(400)]
    rows += [dict(fid=1000, x=0.0, y=0.0), dict(fid=1001, x=None, y=1.0), dict(fid=1002, x=float("nan"), y=1.0), dict(fid=1003, x=3.0, y=4.0), dict(fid=1004, x=3.0, y=4.0), dict(fid=1005, x=5.5, y=4.0)]
    points = proximity.located(tree(spark, rows), "fid")
    ok = [(r["fid"], round(r["x"] * 100), round(r["y"] * 100)) for r in rows if r["x"] is not None and r["x"] == r["x"] and (r["x"], r["y"]) != (0.0, 0.0)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[:i] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 250**2}
    got = proximity.pairs_within(points, 2.5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and (1003, 1004) in want and (1003, 1005) in want
    rings = {
        1: [(-40.005, -40.005), (40.005, -40.005), (40.005, 40.005), (0.005, 0.005), (-40.005, 40.005)],
        2: [(10.005, 10.005), (10.005, 30.005), (30.005, 30.005), (30.005, 10.005), (10.005, 10.005)],
        3: [(1.0, 1.0), (2.0, 2.0)],
    }
    zones = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in v], "c") for k, v in rings.items()] + [(4, None, None)], "zona_id long, ring array<struct<x:double,y:double>>, id_a string")

    def inside(px, py, ring):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    want = {(f, k) for f, x, y in ok for k, r in rings.items() if k < 3 and inside(x / 100, y / 100, r)}
    assert {tuple(r) for r in proximity.points_in_regions(points, zones).collect()} == want
    assert proximity.pairs_within(proximity.located(tree(spark, []), "fid"), 2.5).count() == 0


def test_codes_agree(spark):
    import numpy as np

    a = np.array([0, 1, -1, 5000, -70000]), np.array([0, 3, -9, 123456, 7])
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(*a)], "c long, r long")
    assert [r[0] for r in df.select(proximity.z_code(F.col("c"), F.col("r"))).collect()] == proximity.z_codes(*a).tolist()


READINGS = {
    "51,9": (51.9, None), " 0.258 ": (0.258, None), "1,234.5": None, "#REF!": None, "": None, "-": None, "0": None, "218mm": (218.0, "mm"), "242 MM": (242.0, "mm"),
    "24,2 cm": (24.2, "cm"), "0.28 mts": (0.28, "m"), "1.40 metros": (1.4, "m"), '11.1"': (11.1, "in"), "10,3''": (10.3, "in"), "12.3 pulg.": (12.3, "in"), "10.6 in": (10.6, "in"),
    "100.8 CAP": (100.8, "circ_cm"), "C=104.3 cm": (104.3, "circ_cm"), "104,0 cm perímetro": (104.0, "circ_cm"), "101,8 (circ.)": (101.8, "circ_cm"), "23.0 cm DAP": (23.0, "cm"),
}


def test_readings(spark):
    df = spark.createDataFrame([(k,) for k in READINGS] + [(None,)], "t string")
    got = {r.t: (r.v, r.unit) for r in units.with_reading(df, "t").collect()}
    assert got == {k: v for k, v in READINGS.items() if v}


def test_units_of_sources(spark):
    rng = random.Random(3)
    rows, dirty = [], []
    fid = 0
    for censo, per in ((1, 100.0), (2, 1.0), (3, 100 * math.pi), (4, 1000 / 25.4), (5, 100.0)):
        for i in range(40):
            d, h = rng.uniform(0.3, 0.9), rng.uniform(8, 20)
            v = math.pi / 4 * d * d * h * 0.65
            fid += 1
            if censo == 5:
                v = None  # no volumes: sizes of shared species must do
            rows.append(dict(fid=fid, censo_id=censo, codigo=f"c{fid}", especie="a", altura_m=h, volumen_m3=v, dap_m=round(d * per / 100, 4)))
            dirty.append((fid, censo, f"{d * per:.3f}"))
    dirty.append((fid + 1, 1, "0.412"))  # metres in a census of centimetres
    rows.append(dict(fid=fid + 1, censo_id=1, codigo="z", especie="a", altura_m=10.0, volumen_m3=math.pi / 4 * 0.412**2 * 10 * 0.65, dap_m=0.00412))
    cfg = spark.createDataFrame([(c, "diam", "DAP_CM", 0.65, None) for c in range(1, 6)], "censo_id long, field_dap string, diameter_mode string, form_factor double, observacion string")
    t, dd = tree(spark, rows), spark.createDataFrame(dirty, "fid long, censo_id long, dap_txt string")
    unit = {r.fid: r.unidad for r in units.diameters(t, dd, cfg).collect()}
    by = {c: {unit[r["fid"]] for r in rows if r["censo_id"] == c and r["fid"] <= fid} for c in range(1, 6)}
    assert by == {1: {"cm"}, 2: {"m"}, 3: {"circ_cm"}, 4: {"in"}, 5: {"cm"}} and unit[fid + 1] == "m"
    wrong = {r.fid for r in units.wrong_units(t, dd, cfg).collect()}
    assert fid + 1 in wrong and not wrong & {r["fid"] for r in rows if r["censo_id"] == 1 and r["fid"] <= fid}
    assert units.wrong_units(tree(spark, []), dd, cfg).count() == 0 and units.wrong_units(t, dd.limit(0), cfg).count() == 0


def test_half_up(spark):
    rows = [dict(fid=1, censo_id=1, especie="a", dap_m=0.125)]
    cfg = spark.createDataFrame([(1, "d", "DAP_CM", 0.65, None)], "censo_id long, field_dap string, diameter_mode string, form_factor double, observacion string")
    dirty = spark.createDataFrame([(1, 1, "12.5 in")], "fid long, censo_id long, dap_txt string")
    assert [tuple(r) for r in units.wrong_units(tree(spark, rows), dirty, cfg).collect()] == [(1, 318)]


def test_cover_is_exact_for_large_and_long_regions(spark):
    """Squares of several tiers, with rings beyond half a kilometre and thin ones, against the even-odd rule."""
    rng = random.Random(9)
    star = [(2500 + (2000 if k % 2 else 700) * math.cos(k * math.pi / 7) + 0.005, 2500 + (2000 if k % 2 else 700) * math.sin(k * math.pi / 7) + 0.005) for k in range(14)]
    rings = {1: star, 2: [(10.005, 10.005), (4990.005, 4000.005), (4990.005, 4003.005), (10.005, 13.005)], 3: [(0.005, 0.005), (5000.005, 0.005), (5000.005, 5000.005), (0.005, 5000.005)]}
    rows = [dict(fid=i, x=round(rng.uniform(-100, 5100), 2), y=round(rng.uniform(-100, 5100), 2)) for i in range(3000)]
    rows += [dict(fid=5000 + i, x=round(10 + 4980 * i / 300, 2), y=round(12 + 3990 * i / 300, 2)) for i in range(300)]
    zones = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in v]) for k, v in rings.items()], "zona_id long, ring array<struct<x:double,y:double>>")
    ranges = proximity.region_ranges(zones, "zona_id", "ring", 8.0)
    assert {r.tier for r in ranges.select("tier").distinct().collect()} >= {0, 1}
    want = set()
    for r in rows:
        for k, ring in rings.items():
            odd = False
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 > r["y"]) != (y1 > r["y"]) and r["x"] < x0 + (r["y"] - y0) * (x1 - x0) / (y1 - y0):
                    odd = not odd
            if odd:
                want.add((r["fid"], k))
    got = [tuple(r) for r in proximity.points_in_regions(proximity.located(tree(spark, rows), "fid"), zones).collect()]
    assert len(got) == len(set(got)) and set(got) == want


CONFIG = "censo_id long, field_dap string, diameter_mode string, form_factor double, observacion string"


def test_units_pass_along_a_chain_of_sources(spark):
    """Census 1 has volumes; 2 shares a species with it, and 3 only with 2: it is reached in the second round."""
    rng = random.Random(4)
    rows, dirty = [], []
    for censo, per, species in ((1, 100.0, "a"), (2, 1000.0, "a"), (2, 1000.0, "b"), (3, 1.0, "b")):
        for _ in range(30):
            d, h, fid = rng.uniform(0.45, 0.55), 12.0, len(rows)
            rows.append(dict(fid=fid, censo_id=censo, codigo=f"c{fid}", especie=species, altura_m=h, volumen_m3=math.pi / 4 * d * d * h * 0.65 if censo == 1 else None, dap_m=d))
            dirty.append((fid, censo, f"{d * per:.3f}"))
    cfg = spark.createDataFrame([(c, "diam", "DAP_CM", 0.65, None) for c in (1, 2, 3)], CONFIG)
    readings = units._readings(tree(spark, rows), spark.createDataFrame(dirty, "fid long, censo_id long, dap_txt string"), cfg)
    assert {r.censo_id: (r.unit, r.via) for r in units.source_graph(readings, cfg).collect()} == {1: ("cm", "volumen"), 2: ("mm", "especie"), 3: ("m", "especie")}


def test_offsets_and_whole_numbers(spark):
    rng = random.Random(5)
    rows, dirty = [], []
    for censo in (1, 2):
        for _ in range(60):
            d, h, fid = rng.uniform(0.3, 0.9), rng.uniform(8, 20), len(rows)
            rows.append(dict(fid=fid, censo_id=censo, codigo="igual", especie="a", altura_m=h, volumen_m3=math.pi / 4 * d * d * h * 0.65, dap_m=d))
            dirty.append((fid, censo, f"{100 * (d + 0.1):.2f}" if censo == 1 else f"{100 * d:.0f}"))  # 1: a tape that starts at 10 cm
    rows.append(dict(fid=999, censo_id=2, codigo=None, especie="a", dap_m=1.8))
    dirty.append((999, 2, "180"))  # a census of whole centimetres may hold a thick tree
    cfg = spark.createDataFrame([(c, "diam", "DAP_CM", 0.65, None) for c in (1, 2)], CONFIG)
    t, dd = tree(spark, rows), spark.createDataFrame(dirty, "fid long, censo_id long, dap_txt string")
    graph = {r.censo_id: r for r in units.source_graph(units._readings(t, dd, cfg), cfg).collect()}
    assert graph[1].unit == graph[2].unit == "cm" and graph[1].offset_m == pytest.approx(0.1, abs=0.01) and graph[2].offset_m == 0 and not graph[2].tenths
    got = {r.fid: r for r in units.diameters(t, dd, cfg).collect()}
    assert got[999].unidad == "cm" and all(abs(got[r["fid"]].dap_mm - 1000 * r["dap_m"]) < 12 for r in rows if r["censo_id"] == 1)


def test_fill_error_on_hidden_values(spark):
    """Values hidden from the operator come back nearer than by the median of all."""
    import pandas as pd

    t = pd.read_parquet("/root/testdata/sf0.01/tree.parquet").drop_duplicates("fid")
    good = t[(t.altura_m > 0) & (t.altura_m <= 45) & (t.volumen_m3 > 0) & (t.volumen_m3 <= 200)]
    hidden = good.iloc[::20]
    t.loc[hidden.index, ["altura_m", "volumen_m3"]] = None
    df = spark.createDataFrame(t[["fid", "censo_id", "especie", "dap_m", "altura_m", "volumen_m3", "volumen_calculado", "registrado_ts"]])
    got = {(r.fid, r.campo): r.valor for r in impute.fill_cells(df).collect()}
    error = {}
    for f in ("altura_m", "volumen_m3"):
        real, rest = hidden[f].to_numpy(), good.drop(hidden.index)[f].median()
        mine = pd.Series([got[k, f] for k in hidden.fid]).to_numpy()
        error[f] = (float(pd.Series(abs(mine - real) / real).median()), float(pd.Series(abs(rest - real) / real).median()))
    print("fill error, by groups and by the median of all:", error)
    assert all(a < 0.9 * b for a, b in error.values())


def test_unit_expressions_stay_short(spark, data, monkeypatch):
    """p4_found: no step's plan holds expressions many times over, which took the driver's memory and grew beyond what Java compiles."""
    from silvara.plans import training

    lengths = []
    monkeypatch.setattr(units, "cut", lambda df, cut=units.cut: (lengths.append(len(df._jdf.queryExecution().optimizedPlan().toString())), cut(df))[1])
    found = training.QUERIES["p4_found"](spark, data)
    lengths.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert len(lengths) >= 7 and max(lengths) < 20_000, lengths
