"""Derived inputs of the spatial, grid and graph queries: one SQL text for Spark and for the SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from silvara.sources import table

VIEWS = {
    # Trees as points of a 10 x 10 km square; the key columns together tell rows apart.
    "puntos": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, lower(p_name) as especie,
               case l_returnflag when 'A' then 'APROVECHABLE' when 'R' then 'Extraible' else 'SEMILLERO' end as categoria,
               l_linestatus as parcela,
               ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 1000000) / cast(100 as double) as x,
               ((l_suppkey * 15485863 + l_orderkey * 32452843 + l_partkey * 13) % 1000000) / cast(100 as double) as y,
               cast(l_quantity * 2 + 10 as bigint) as dap_cm, cast(6 + l_suppkey % 20 as bigint) as hc_m
        from lineitem join part on l_partkey = p_partkey""",
    "patios": """
        select s_suppkey + 1 as patio_id,
               ((s_suppkey * 7919 + s_nationkey * 104729) % 1000000) / cast(100 as double) as px,
               ((s_suppkey * 6007 + s_nationkey * 611953) % 1000000) / cast(100 as double) as py
        from supplier""",
    # A stream network shaped as a binary heap: a segment flows into the one of half its number.
    "tramos": """
        select s_suppkey + 1 as sid, cast(floor((s_suppkey + 1) / 2) as bigint) as down_sid,
               (((s_suppkey + 1) * 7919) % 10000) * cast(1 as double) as x1, (((s_suppkey + 1) * 6007) % 10000) * cast(1 as double) as y1,
               ((cast(floor((s_suppkey + 1) / 2) as bigint) * 7919) % 10000) * cast(1 as double) as x2,
               ((cast(floor((s_suppkey + 1) / 2) as bigint) * 6007) % 10000) * cast(1 as double) as y2
        from supplier""",
    # A valley of 64 x 64 cells of 30 m.
    "dem": """
        select cast(floor(id / 64) as bigint) as r, cast(id % 64 as bigint) as c,
               cast(100 + 2 * abs(id % 64 - 32) + (64 - floor(id / 64)) as double) as z
        from range(4096) t(id)""",
    # The same with single cells that are 9 m too deep.
    "hoyos": """
        select cast(floor(id / 64) as bigint) as r, cast(id % 64 as bigint) as c,
               cast(100 + 2 * abs(id % 64 - 32) + (64 - floor(id / 64)) as double)
               - case when (floor(id / 64) * 7 + id % 64 * 3) % 23 = 0 and floor(id / 64) between 2 and 61 and id % 64 between 2 and 61 then cast(9 as double) else cast(0 as double) end as z
        from range(4096) t(id)""",
    # Squares of 1.4 km with gaps between.
    "cuadros": """
        select cast(n_nationkey as bigint) as zona_id, (n_nationkey % 5) * 2000 + cast(300.25 as double) as x0, floor(n_nationkey / 5) * 2000 + cast(300.25 as double) as y0, cast(1400 as double) as lado
        from nation""",
    # Places in degrees, west and east, north and south, with the code of a coordinate system.
    "lugares": """
        select s_suppkey + 1 as id, cast(s_suppkey * 37 % 358 as double) - cast(179 as double) + cast(0.123456 as double) as lon, cast(s_suppkey * 53 % 160 as double) - cast(80 as double) + cast(0.654321 as double) as lat,
               case s_suppkey % 6 when 0 then 4326 when 1 then 32719 when 2 then 3857 when 3 then 32618 when 4 then 0
                    else 32000 + case when s_suppkey * 53 % 160 - 80 < 0 then 700 else 600 end + cast(floor((s_suppkey * 37 % 358 - 179 + 0.123456 + 180) / 6) as int) + 1 end as codigo
        from supplier""",
    # Thematic rules, good and bad; values are parted by |.
    "reglas": """
        select * from (values (1, 'zonas', 'clase', 'humedal|ladera', 'IMPEDIMENTO_FISICO', cast(0.85 as double)), (2, 'zonas', 'clase', 'comunidad', 'VETO_LEGAL', cast(1 as double)),
            (3, '', 'clase', 'faja', 'VETO_LEGAL', cast(1 as double)), (4, 'zonas', '', 'faja', 'OTRO', cast(1.5 as double)), (5, 'zonas', 'clase', 'O''Higgins|Aguajal alto', 'PREFERENCIA', cast(0.35 as double)), (6, 'zonas', 'clase', cast(null as varchar(10)), 'VETO_LEGAL', cast(1 as double))) t(regla, capa, campo, valores, rol, peso)""",
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A derived input over the tables of a data folder."""
    text = VIEWS[name]
    tables = [t for t in ("lineitem", "part", "supplier", "nation") if re.search(rf"\b(from|join) {t}\b", text)]
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, d, t) for t in tables})


def ctes(*names: str) -> str:
    """``with`` clause that defines the views for the SQL twin."""
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
