"""Road networks: routes on a cost grid joined one after the other to what is already built, their measures and totals.

Growth is one order of decisions, as each route makes ground cheap for those after it: one task grows one plan, and plans go side by side. Costs, heights and destinations
come from DataFrame plans, and what is measured on the routes is joined and aggregated as such.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvara.operators.routing import neighbourhood, simplify, without_spikes
from silvara.runtime import ship

# Widths of the kinds of road in metres, work by order of the stream crossed.
WIDTHS = {"principal": 6.0, "secundaria": 4.0}
#: Cost of a cell on an existing road, on a new one, and the halo's discount.
EXISTING, OPENED, HALO = 0.0005, 0.001, 0.4
#: Metres within which a secondary destination counts as served, and metres over the limit that a route may have.
SERVED, EXCEPTION = 500.0, 150.0


class Terrain:
    """A grid of costs and heights as arrays, from the first row and column on; cells that are missing or no number cannot be passed."""

    def __init__(self, cells: pd.DataFrame, cell: float, order: int = 3, adverse: float = 4.0, favourable: float = 8.0, weight: float = 1.0, beyond: float = 1.5, steep: float = 50.0):
        self.r0, self.c0 = int(cells["r"].min()), int(cells["c"].min())
        shape = int(cells["r"].max()) - self.r0 + 1, int(cells["c"].max()) - self.c0 + 1
        self.z, self.cost = np.full(shape, np.nan), np.full(shape, np.nan)
        i, j = (cells["r"] - self.r0).to_numpy(dtype=np.int64), (cells["c"] - self.c0).to_numpy(dtype=np.int64)
        self.z[i, j], self.cost[i, j] = cells["z"], cells["costo"]
        self.open = ~np.isnan(self.z) & ~np.isnan(self.cost)
        self.cell, self.limits, self.weight, self.beyond, self.steep = cell, (adverse, favourable), weight, beyond, steep
        self.offsets = [(a, b, math.hypot(a, b) * cell) for a, b in neighbourhood(order)]

    def at(self, x: float, y: float) -> tuple[int, int] | None:
        """Place of a position in the arrays, none beyond the grid or where nothing passes. Downward also west and south of the grid."""
        p = math.floor(y / self.cell) - self.r0, math.floor(x / self.cell) - self.c0
        return p if 0 <= p[0] < self.z.shape[0] and 0 <= p[1] < self.z.shape[1] and self.open[p] else None

    def centre(self, p: tuple[int, int]) -> tuple[float, float]:
        return (p[1] + self.c0 + 0.5) * self.cell, (p[0] + self.r0 + 0.5) * self.cell

    def step(self, p: tuple[int, int], q: tuple[int, int], far: float) -> float:
        """Weight of going from p to q, as the loaded way comes back."""
        g = -100 * (self.z[q] - self.z[p]) / far
        s = abs(g) / self.limits[0 if g > 0 else 1]
        return (self.cost[p] + self.cost[q]) / 2 * far * (1 + self.weight * s * s) * (self.steep if s > self.beyond else 1.0)

    def route(self, network: set[tuple[int, int]], target: tuple[int, int]) -> tuple[float, list[tuple[int, int]]] | None:
        """Cheapest way from any cell of the network to the target: its cost and cells, network first. None if there is none."""
        best = {p: 0.0 for p in network}
        before: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(0.0, p) for p in sorted(network)]
        done: set[tuple[int, int]] = set()
        while heap:
            d, p = heapq.heappop(heap)
            if p in done:
                continue
            done.add(p)
            if p == target:
                way = [p]
                while way[-1] in before:
                    way.append(before[way[-1]])
                return d, way[::-1]
            for a, b, far in self.offsets:
                q = p[0] + a, p[1] + b
                if 0 <= q[0] < self.z.shape[0] and 0 <= q[1] < self.z.shape[1] and self.open[q] and q not in done:
                    n = d + self.step(p, q, far)
                    if n < best.get(q, math.inf):
                        best[q], before[q] = n, p
                        heapq.heappush(heap, (n, q))
        return None

    def mark(self, points: list[tuple[int, int]], width: float, factor: float) -> None:
        """Cells of a road and around it become cheap: at most ``factor`` on it, and a halo three times as wide at HALO of what it was, at each vertex anew."""
        radius = max(2, round(width / max(1.0, self.cell) / 2))
        for i, j in points:
            core = self.cost[max(0, i - radius) : i + radius + 1, max(0, j - radius) : j + radius + 1]
            np.minimum(core, factor, out=core)
            halo = self.cost[max(0, i - 3 * radius) : i + 3 * radius + 1, max(0, j - 3 * radius) : j + 3 * radius + 1]
            np.multiply(halo, HALO, out=halo, where=halo > factor)

    def measured(self, way: list[tuple[int, int]]) -> dict[str, float]:
        """Length, highest and mean grade (percent, without sign), rise, steps over the larger limit, and whether those exceed EXCEPTION metres."""
        far = [math.hypot(b[0] - a[0], b[1] - a[1]) * self.cell for a, b in zip(way, way[1:])]
        grades = [abs(100 * (self.z[b] - self.z[a]) / d) for a, b, d in zip(way, way[1:], far)]
        over = sum(g > max(self.limits) for g in grades)
        return {
            "largo": sum(far), "rasante_max": max(grades, default=0.0), "rasante_media": float(np.mean(grades)) if grades else 0.0, "desnivel": float(self.z[way[-1]] - self.z[way[0]]),
            "sobre_limite": over, "excede": over * self.cell > EXCEPTION,
        }


def _apart(points: list[tuple[float, float]], x: float, y: float) -> float:
    """Distance of a position from a line."""
    a, b = np.array(points[:-1]), np.array(points[1:])
    d = b - a
    t = np.clip((([x, y] - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
    return float(np.sqrt((((a + t[:, None] * d) - [x, y]) ** 2).sum(1)).min())


def refined(points: list[tuple[float, float]], tolerance: float = 45.0, rounds: int = 2) -> list[tuple[float, float]]:
    """A route without spikes, simplified, with its corners cut."""
    line = simplify(without_spikes(points), tolerance)
    for _ in range(rounds):
        if len(line) > 2:
            inner = [(ax + (bx - ax) * t, ay + (by - ay) * t) for (ax, ay), (bx, by) in zip(line, line[1:]) for t in (0.25, 0.75)]
            line = [line[0], *inner, line[-1]]
    return line


ROUTES = "plan long, via long, destino long, jerarquia string, estado string, volumen double, costo double, largo double, rasante_max double, rasante_media double, desnivel double, sobre_limite long, excede boolean, linea array<struct<x:double,y:double>>"


def grow_network(cells: DataFrame, destinations: DataFrame, exits: DataFrame, existing: DataFrame, cell: float, served: float = SERVED, order: int = 3) -> DataFrame:
    """The road network of each plan, one row a destination: estado 'trazada', 'servida', 'fuera' or 'inalcanzable', and a row 'existente' for each road that is there.

    ``cells`` has plan, r, c, z, costo; ``destinations`` plan, destino, jerarquia, x, y, volumen; ``exits`` plan, x, y ((0, 0) is undefined, S10); ``existing`` plan, via, linea. Principal
    destinations come before secondary ones, larger volumes first, then by number. A secondary one within ``served`` metres of a traced or existing road is served by it. Each route
    starts anywhere on the network so far. A plan without exit and roads traces nothing: its destinations are 'inalcanzable'. Lengths are those of the
    cells' ways; lines are refined. All cells of a plan are in one task.
    """
    tagged = [
        cells.select("plan", F.lit("c").alias("k"), F.col("r").cast("long").alias("i"), F.col("c").cast("long").alias("j"), F.col("z").cast("double").alias("a"), F.col("costo").cast("double").alias("b"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("l")),
        destinations.select("plan", F.lit("d"), F.col("destino").cast("long"), F.lit(None).cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("volumen").cast("double"), "jerarquia", F.lit(None)),
        exits.where("not (x = 0 and y = 0)").select("plan", F.lit("s"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), F.lit(None), F.lit(None), F.lit(None)),
        existing.where(F.size("linea") >= 2).select("plan", F.lit("e"), F.col("via").cast("long"), F.lit(None).cast("long"), F.lit(None), F.lit(None), F.lit(None), F.lit(None), "linea"),
    ]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.union(more)

    names = [c.split()[0] for c in ROUTES.split(", ")]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = int(pdf["plan"].iloc[0])
        ground = pdf[pdf["k"] == "c"]
        out: list[dict] = []
        goals = pdf[pdf["k"] == "d"].assign(late=lambda d: d["t"] != "principal").sort_values(["late", "v", "i"], ascending=[True, False, True])
        if not len(ground):
            return pd.DataFrame([{"plan": plan, "destino": int(g.i), "jerarquia": g.t, "estado": "inalcanzable", "volumen": g.v} for g in goals.itertuples()], columns=names)
        land = Terrain(ground.rename(columns={"i": "r", "j": "c", "a": "z", "b": "costo"})[["r", "c", "z", "costo"]], cell, order)
        network = {p for s in pdf[pdf["k"] == "s"].itertuples() if (p := land.at(s.a, s.b))}
        lines: list[list[tuple[float, float]]] = []
        for e in pdf[pdf["k"] == "e"].sort_values("i").itertuples():
            line = [(p["x"], p["y"]) for p in e.l]
            on = [p for x, y in line if (p := land.at(x, y))]
            land.mark(on, WIDTHS["principal"], EXISTING)
            network.update(on)
            lines.append(line)
            out.append({"plan": plan, "via": int(e.i), "jerarquia": "principal", "estado": "existente", "largo": sum(math.dist(a, b) for a, b in zip(line, line[1:])), "linea": [{"x": x, "y": y} for x, y in line]})
        for g in goals.itertuples():
            row = {"plan": plan, "destino": int(g.i), "jerarquia": g.t, "volumen": g.v}
            if g.t != "principal" and any(_apart(line, g.a, g.b) <= served for line in lines):
                out.append(row | {"estado": "servida"})
                continue
            target = land.at(g.a, g.b)
            found = land.route(network, target) if target and network else None
            if not found or len(found[1]) < 2:
                out.append(row | {"estado": "fuera" if target is None else "servida" if found else "inalcanzable"})
                continue
            total, way = found
            line = refined([land.centre(p) for p in way])
            lines.append(line)
            out.append(row | land.measured(way) | {"estado": "trazada", "costo": total, "linea": [{"x": x, "y": y} for x, y in line]})
            land.mark(way, WIDTHS.get(g.t, WIDTHS["secundaria"]), OPENED)
            network.update(way)
        made = pd.DataFrame([{c: row.get(c) for c in names} for row in out], columns=names)
        return made.astype({"via": "Int64", "destino": "Int64", "sobre_limite": "Int64", "excede": "boolean"})

    return ship(rows).groupBy("plan").applyInPandas(lambda pdf: grow(pdf), ROUTES)


def road_totals(roads: DataFrame, hectares: float, widths: dict[str, float] = WIDTHS) -> DataFrame:
    """Traced roads by kind and in all (jerarquia null): vias, largo (m), hectareas that they take, densidad (m/ha)."""
    wide = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in widths.items() for x in (F.lit(k), F.lit(v))]), "jerarquia"), F.lit(widths["secundaria"]))
    t = roads.where("estado = 'trazada'").select("jerarquia", "largo", (F.col("largo") * wide / 10000.0).alias("ha"))
    g = t.rollup("jerarquia").agg(F.grouping("jerarquia").alias("g"), F.count("*").alias("vias"), F.sum("largo").alias("l"), F.sum("ha").alias("h"))
    return g.select("jerarquia", (F.col("g") == 1).alias("todo"), "vias", F.bround("l", 2).alias("largo"), F.bround("h", 4).alias("hectareas"), F.bround(F.col("l") / hectares, 4).alias("densidad"))


def road_findings(roads: DataFrame, crossings: DataFrame, hectares: float) -> DataFrame:
    """One row: largo, densidad, cruces by work (alcantarilla up to order 2, pontón at 3, puente above), volumen_atrapado, and avisos: density over 20 m/ha, three bridges or more, volume that no road reaches."""
    t = roads.agg(
        F.coalesce(F.sum(F.when(F.col("estado") == "trazada", F.col("largo"))), F.lit(0.0)).alias("l"),
        F.coalesce(F.sum(F.when(F.col("estado").isin("fuera", "inalcanzable"), F.col("volumen"))), F.lit(0.0)).alias("v"),
    )
    k = crossings.agg(F.count_if(F.col("orden") <= 2).alias("alcantarillas"), F.count_if(F.col("orden") == 3).alias("pontones"), F.count_if(F.col("orden") > 3).alias("puentes"))
    told = F.array_compact(F.array(F.when(F.col("l") / hectares > 20, "densidad"), F.when(F.col("puentes") >= 3, "puentes"), F.when(F.col("v") > 0, "volumen atrapado")))
    return t.join(k).select(F.bround("l", 2).alias("largo"), F.bround(F.col("l") / hectares, 4).alias("densidad"), "alcantarillas", "pontones", "puentes", F.bround("v", 4).alias("volumen_atrapado"), F.array_join(told, "; ").alias("avisos"))
