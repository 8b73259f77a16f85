"""Queries of the general training-data problems (1, 3, 4) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.operators import impute, proximity, units
from silvara.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every cell that the fill operator fills."""
    return impute.fill_cells(table(spark, d, "tree")).select("fid", "campo")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """The whole tree table, filled and marked."""
    return impute.fill_table(table(spark, d, "tree"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of trees within 2.5 m and the zones each tree lies in."""
    points = proximity.located(table(spark, d, "tree"), "fid")
    trees = proximity.pairs_within(points, 2.5).select(F.lit("arbol").alias("tipo"), "id_a", "id_b")
    zones = proximity.points_in_regions(points, table(spark, d, "zones")).select(F.lit("zona").alias("tipo"), "id_a", "id_b")
    return trees.unionByName(zones)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Trees whose stored diameter is off by its unit."""
    return units.wrong_units(*[table(spark, d, n) for n in ("tree", "census_dirty", "censo_config")])


def p4_diameters(spark: SparkSession, d: str) -> DataFrame:
    """Every reading in metres of diameter, with the unit it was taken in."""
    out = units.diameters(*[table(spark, d, n) for n in ("tree", "census_dirty", "censo_config")])
    return out.select("fid", F.round(F.col("dap_mm") / 1000, 4).alias("dap_m"), "unidad", "via")


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p3_found": p3_found, "p4_found": p4_found, "p4_diameters": p4_diameters}

#: p3's twin joins all positions by a bound on one coordinate and tries every zone whose box holds a tree.
_EDGES = "select zona_id, ring[i] as a, ring[i % len(ring) + 1] as b from (select zona_id, ring, unnest(range(1, len(ring) + 1)) as i from zones)"
SQL = {
    "p1_found": """
        select fid, 'altura_m' as campo from tree where not coalesce(not isnan(altura_m) and altura_m > 0 and altura_m <= 45, false)
        union all
        select fid, 'volumen_m3' from tree where not coalesce(not isnan(volumen_m3) and volumen_m3 > 0 and volumen_m3 <= 200, false)
        union all
        select fid, 'volumen_calculado' from tree where volumen_calculado is null
    """,
    "p3_found": f"""
        with p as (select fid, cast(round(x * 100) as bigint) as px, cast(round(y * 100) as bigint) as py from tree where not isnan(x) and not isnan(y) and not (x = 0 and y = 0)),
        e as ({_EDGES}), box as (select zona_id, min(a.x) as x0, max(a.x) as x1, min(a.y) as y0, max(a.y) as y1 from e group by zona_id),
        near as (select fid, px / 100.0::double as x, py / 100.0::double as y, zona_id from p join box on px / 100.0::double between x0 and x1 and py / 100.0::double between y0 and y1)
        select 'arbol' as tipo, s.fid as id_a, t.fid as id_b from p s join p t on t.px between s.px - 250 and s.px + 250 and s.fid < t.fid and (s.px - t.px) * (s.px - t.px) + (s.py - t.py) * (s.py - t.py) <= 62500
        union all
        select 'zona', fid, zona_id from near join e using (zona_id) where (a.y > y) <> (b.y > y) and x < a.x + (y - a.y) * (b.x - a.x) / (b.y - a.y) group by fid, zona_id having count(*) % 2 = 1
    """,
}
