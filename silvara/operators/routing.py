"""Ways over a grid: neighbourhoods, graded edges, least cost, and the shaping of lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.runtime import cut, drop


def neighbourhood(order: int) -> list[tuple[int, int]]:
    """G1: offsets without a common divisor up to ``order`` cells: 8, 16, 32 and 48 for orders 1 to 4."""
    return [(r, c) for r in range(-order, order + 1) for c in range(-order, order + 1) if math.gcd(r, c) == 1]


def edges(cells: DataFrame, cell: float, order: int) -> DataFrame:
    """R, c, r2, c2, dist, grade (signed percent) between cells that both exist. ``cells`` has r, c, z, costo."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(math.hypot(a, b) * cell).alias("d")) for a, b in neighbourhood(order)])
    out = cells.select("r", "c", F.col("z").alias("z1"), F.col("costo").alias("k1"), F.explode(offsets).alias("o")).select("r", "c", "z1", "k1", (F.col("r") + F.col("o.a")).alias("r2"), (F.col("c") + F.col("o.b")).alias("c2"), F.col("o.d").alias("dist"))
    to = cells.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2"), F.col("costo").alias("k2"))
    return out.join(to, ["r2", "c2"]).select("r", "c", "r2", "c2", "dist", "k1", "k2", (100 * (F.col("z2") - F.col("z1")) / F.col("dist")).alias("grade"))


def weight(adverse: float = 4.0, favourable: float = 8.0, w: float = 1.0, beyond: float = 1.5, steep: float = 50.0) -> Column:
    """Mean cost times length times 1 + w (grade / limit)^2; routes are built from the exit, so a rise here is a fall for the load. Times ``steep`` above ``beyond`` limits."""
    g = -F.col("grade")
    limit = F.when(g > 0, adverse).otherwise(favourable)
    s = F.abs(g) / limit
    return (F.col("k1") + F.col("k2")) / 2 * F.col("dist") * (1 + w * s * s) * F.when(s > beyond, steep).otherwise(1.0)


def least_costs(graph: DataFrame, sources: DataFrame) -> DataFrame:
    """Least cost of reaching each cell from any source, and the cell before it (pr, pc; null at sources).

    ``graph`` has r, c, r2, c2, w. Only cells that improved pass on in a round; rounds end when none does.
    Weights below zero are refused, as ways over them need not end.
    """
    state = cut(sources.select("r", "c", F.lit(0.0).alias("costo"), F.lit(None).cast("long").alias("pr"), F.lit(None).cast("long").alias("pc"), F.lit(True).alias("new")))
    links = cut(graph.select("r", "c", "r2", "c2", "w"))
    if links.where("w < 0").limit(1).count():
        raise ValueError("a weight is below zero")
    pick = lambda c: F.when(F.col("new"), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    while state.where("new").limit(1).count():
        front = state.where("new").drop("new")
        reached = front.join(links, ["r", "c"]).groupBy(F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.min(F.struct((F.col("costo") + F.col("w")).alias("costo"), F.col("r").alias("pr"), F.col("c").alias("pc"))).alias("n"))
        j = state.drop("new").join(reached, ["r", "c"], "full_outer").withColumn("new", F.coalesce(F.col("n.costo") < F.col("costo"), F.col("costo").isNull()))
        before = state
        state = cut(j.select("r", "c", pick("costo"), pick("pr"), pick("pc"), "new"))
        drop(before)
    drop(links)
    return state.drop("new")


def _cut_corners(line: Column) -> Column:
    def at(i: Column, t: float) -> Column:
        a, b = F.get(line, i), F.get(line, i + 1)
        return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))

    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: F.array(at(i, 0.25), at(i, 0.75))))
    return F.when(F.size(line) < 3, line).otherwise(F.concat(F.slice(line, 1, 1), inner, F.slice(line, -1, 1)))


def chaikin(line: Column, rounds: int = 1) -> Column:
    """Corners cut at a quarter and three quarters of each side; the ends stay."""
    for _ in range(rounds):
        line = _cut_corners(line)
    return line


def length(line: Column) -> Column:
    """Length of a line of points."""
    return F.when(F.size(line) < 2, 0.0).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), F.lit(0.0), lambda acc, i: acc + F.hypot(F.get(line, i + 1)["x"] - F.get(line, i)["x"], F.get(line, i + 1)["y"] - F.get(line, i)["y"]))
    )


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker; both ends stay."""
    keep = {0, len(points) - 1}
    work = [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        span = math.hypot(x1 - x0, y1 - y0)
        far, at = -1.0, a
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / span if span else math.hypot(x - x0, y - y0)
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            work += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)] if points else []


def without_spikes(points: list[tuple[float, float]], turn: float = 110.0, side: float = 75.0) -> list[tuple[float, float]]:
    """Vertices that turn by more than ``turn`` degrees beside a side shorter than ``side``, or repeat their neighbour, go one at a time until none is left."""
    line = list(points)
    i = 1
    while i < len(line) - 1:
        (ax, ay), (bx, by), (cx, cy) = line[i - 1 : i + 2]
        u, v = math.hypot(bx - ax, by - ay), math.hypot(cx - bx, cy - by)
        angle = 180.0 if not u or not v else math.degrees(math.acos(max(-1.0, min(1.0, ((bx - ax) * (cx - bx) + (by - ay) * (cy - by)) / (u * v)))))
        if not u or not v or (angle > turn and min(u, v) < side):
            del line[i]
            i = max(1, i - 1)
        else:
            i += 1
    return line
