"""Line networks: streams as lines, orientation, checks and summaries, ridges, and lines cut at regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.operators import flow, spatial
from silvara.runtime import cut


def stream_lines(drains: DataFrame, streams: DataFrame, cell: float) -> DataFrame:
    """The stream cells as noded lines: r0, c0, r1, c1 (first and last cell, both nodes), celdas (steps), largo (metres).

    Nodes are springs, confluences and ends; exactly one line leaves a node, so its first cell names it, and the line it flows into starts at its last cell.
    Cells between nodes have one inflow: pointers upstream are doubled until they reach their line's first cell.
    """
    s = streams.select("r", "c").distinct()
    to = s.select(F.col("r").alias("nr"), F.col("c").alias("nc"))
    steps = cut(drains.join(s, ["r", "c"], "left_semi").join(to, ["nr", "nc"], "left_semi").select("r", "c", "nr", "nc"))
    fed = steps.groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.count("*").alias("k"), F.first("r").alias("ur"), F.first("c").alias("uc"))
    cells = s.join(fed, ["r", "c"], "left").join(steps.select("r", "c", F.lit(True).alias("_on")), ["r", "c"], "left")
    node = F.coalesce(F.col("k"), F.lit(0)) != 1
    cells = cut(cells.select("r", "c", (node | F.col("_on").isNull()).alias("nodo"), F.when(~node & F.col("_on"), F.col("ur")).alias("nr"), F.when(~node & F.col("_on"), F.col("uc")).alias("nc")))
    nodes = cells.where("nodo").select("r", "c")
    first = flow.outlets(cells.select("r", "c", "nr", "nc"), nodes)
    length = cell * F.hypot((F.col("nr") - F.col("r")).cast("double"), (F.col("nc") - F.col("c")).cast("double"))
    last = nodes.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(True).alias("_end"))
    j = steps.join(first, ["r", "c"]).join(last, ["nr", "nc"], "left")
    g = j.groupBy(F.col("er").alias("r0"), F.col("ec").alias("c0")).agg(F.max(F.when(F.col("_end"), F.struct("nr", "nc"))).alias("e"), F.count("*").alias("celdas"), F.sum(length).alias("largo"))
    return g.select("r0", "c0", F.col("e.nr").alias("r1"), F.col("e.nc").alias("c1"), "celdas", F.bround("largo", 4).alias("largo"))


def long_enough(lines: DataFrame, parts: str, least: float) -> DataFrame:
    """One row a part of multi-part lines (``parts``, an array of arrays of points), with parte (from 0), linea and largo; parts of fewer than two points or shorter than ``least`` go."""
    from silvara.operators.routing import length

    each = lines.select(*[c for c in lines.columns if c != parts], F.posexplode(parts).alias("parte", "linea")).where(F.size("linea") >= 2)
    return each.withColumn("largo", length(F.col("linea"))).where(F.col("largo") >= least)


def downhill(segments: DataFrame, dem: DataFrame, cell: float) -> DataFrame:
    """H4: ``segments`` (x1, y1, x2, y2) turned so that they fall, with girado and sin_z: a segment is turned if its end lies higher than its start, and kept if the DEM has no height for one of both."""
    z = dem.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.when(~F.isnan("z"), F.col("z")).alias("_z"))

    def sampled(df: DataFrame, n: int) -> DataFrame:
        at = (F.floor(F.col(f"y{n}") / cell) == F.col("_r")) & (F.floor(F.col(f"x{n}") / cell) == F.col("_c"))
        return df.join(z, at, "left").withColumnRenamed("_z", f"_z{n}").drop("_r", "_c")

    j = sampled(sampled(segments, 1), 2)
    turn = F.coalesce(F.col("_z2") > F.col("_z1"), F.lit(False))
    ends = {f"{v}{n}": F.when(turn, F.col(f"{v}{3 - n}")).otherwise(F.col(f"{v}{n}")) for v in "xy" for n in (1, 2)}
    kept = [F.col(c) if c not in ends else ends[c].alias(c) for c in segments.columns]
    return j.select(*kept, turn.alias("girado"), (F.col("_z1").isNull() | F.col("_z2").isNull()).alias("sin_z"))


def checked(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """H5: diagnostics of a network with avisos: no confluence at all, confluences for fewer than 5 % of the segments, more components than 10 and a quarter of the segments. ``nodes`` has componente."""
    parts = nodes.agg(F.countDistinct("componente").alias("componentes"))
    d = flow.diagnostics(segments).join(parts)  # one row each
    few = F.when(F.col("confluencias") == 0, "sin confluencias").when(F.col("confluencias") < 0.05 * F.col("tramos"), "pocas confluencias")
    many = F.when(F.col("componentes") > F.greatest(F.lit(10), 0.25 * F.col("tramos")), "red fragmentada")
    return d.withColumn("avisos", F.array_compact(F.array(few, many)))


def summary(segments: DataFrame, order: str, length: Column) -> DataFrame:
    """Segments and length in metres of each order and of all (order null), and the share of the length in ten-thousandths."""
    g = segments.select(F.col(order).alias("orden"), length.alias("l")).rollup("orden").agg(F.grouping("orden").alias("g"), F.count("*").alias("tramos"), F.sum("l").alias("l"))
    whole = segments.agg(F.sum(length).alias("_all"))
    return g.join(whole).select("orden", (F.col("g") == 1).alias("todo"), "tramos", F.bround("l", 2).alias("largo"), F.floor(F.col("l") * 10000 / F.col("_all") + 0.5).alias("parte"))


def ridge_cells(dem: DataFrame, cell: float, least_cells: int, most_relief: float = 120.0) -> DataFrame:
    """Cells of ridges: where much would drain if the terrain were upside down. None if the relief exceeds ``most_relief``, as ridges then say nothing about passability."""
    relief = dem.where(~F.isnan("z")).agg((F.max("z") - F.min("z")).alias("_h"))
    turned = dem.select("r", "c", (-F.col("z")).alias("z"))
    gathered = flow.accumulation(flow.drainage(turned, cell)).where(F.col("acumulacion") >= least_cells)
    return gathered.join(relief).where(F.col("_h") <= most_relief).select("r", "c", "acumulacion")


def _inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of points."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((a["y"] > py) != (b["y"] > py)) & (px < a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, i: acc != crosses(i))


def ring_sides(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """Sides of rings as segments: ``key``, lado, x1, y1, x2, y2."""
    e = regions.select(key, F.posexplode(ring).alias("lado", "_a"), F.col(ring).alias("_p"))
    b = F.get("_p", (F.col("lado") + 1) % F.size("_p"))
    return e.select(key, "lado", F.col("_a.x").alias("x1"), F.col("_a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def clipped(segments: DataFrame, key: str, regions: DataFrame, region: str, ring: str, side: float = 500.0, outside: bool = False) -> DataFrame:
    """Parts of segments (x1, y1, x2, y2) inside each region, or with ``outside`` outside those that they meet: ``key``, ``region``, parte, x1, y1, x2, y2, largo.

    A segment is cut where it meets a side; the parts whose middle lies inside (outside) stay. Segments and regions meet in cells: by the sides, and by the
    start of a segment that lies wholly inside. Extra columns go.
    """
    sides = ring_sides(regions.withColumnRenamed(region, "_k"), "_k", ring)
    sides = cut(sides.withColumn("_s", F.struct("_k", "lado")))
    met = spatial.crossing_pairs(segments, sides, key, "_s", side)
    ax, ay, bx, by = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1"), F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    t = F.try_divide((F.col("bx1") - F.col("ax1")) * by - (F.col("by1") - F.col("ay1")) * bx, ax * by - ay * bx)
    cuts = met.groupBy(key, F.col("_s._k").alias("_k")).agg(F.collect_set(F.when(t.between(0.0, 1.0), t)).alias("_t"))  # as many as a ring's sides
    boxes = regions.select(F.col(region).alias("_k"), F.array_min(F.transform(ring, lambda p: p["x"])).alias("_x0"), F.array_max(F.transform(ring, lambda p: p["x"])).alias("_x1"), F.array_min(F.transform(ring, lambda p: p["y"])).alias("_y0"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("_y1"))
    box = spatial._reach(boxes, F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1"), side).select("_k", "_gx", "_gy", "_x0", "_x1", "_y0", "_y1")
    start = spatial._own(segments.select(key, "x1", "y1"), "x1", "y1", side).join(box, ["_gx", "_gy"]).where(F.col("x1").between(F.col("_x0"), F.col("_x1")) & F.col("y1").between(F.col("_y0"), F.col("_y1")))
    pairs = cuts.unionByName(start.select(key, "_k", F.array().cast("array<double>").alias("_t"))).groupBy(key, "_k").agg(F.flatten(F.collect_list("_t")).alias("_t"))
    j = pairs.join(segments.select(key, "x1", "y1", "x2", "y2"), key).join(regions.select(F.col(region).alias("_k"), F.col(ring).alias("_p")), "_k")
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), "_t")))
    j = j.withColumn("_t", ts).select("*", F.explode(F.sequence(F.lit(0), F.size("_t") - 2)).alias("parte"))
    a, b = F.get("_t", F.col("parte")), F.get("_t", F.col("parte") + 1)
    at = lambda u: (F.col("x1") + u * (F.col("x2") - F.col("x1")), F.col("y1") + u * (F.col("y2") - F.col("y1")))
    (px, py), (qx, qy), middle = at(a), at(b), at((a + b) / 2)
    within = _inside(*middle, F.col("_p"))
    parts = j.where(~within if outside else within).select(key, F.col("_k").alias(region), "parte", px.alias("x1"), py.alias("y1"), qx.alias("x2"), qy.alias("y2"))
    return parts.withColumn("largo", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
