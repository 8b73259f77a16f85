"""Joins of points, segments and rings by grid cells: one side is laid into the cells that it reaches, the other into its own, and the exact test follows an equality of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.operators.proximity import located, points_in_regions
from silvara.runtime import cut, drop, ship, small


#: Metres by which a cell must lie inside a strip to be taken as a whole, more than any rounding of coordinates on Earth.
SAFE = 1e-3
#: Rows of segments in cells, of some 90 bytes each, up to which they go to all executors.
BOX_ROWS = 600_000


def _cell(v: Column, side: float) -> Column:
    return F.floor(v / side).cast("long")


def _reach(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, side: float) -> DataFrame:
    """``df`` once for each cell of a box."""
    return df.withColumn("_gx", F.explode(F.sequence(_cell(x0, side), _cell(x1, side)))).withColumn("_gy", F.explode(F.sequence(_cell(y0, side), _cell(y1, side))))


def _own(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return df.withColumns({"_gx": _cell(F.col(x), side), "_gy": _cell(F.col(y), side)})


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def rounded(v: Column, places: int = 4) -> Column:
    """``bround`` of a number, the same in every case: by whole multiples unless it lies by a tie or is large, as decimals take most of the time of many pairs."""
    t = v * 10.0**places
    whole = F.rint(t)
    plain = (F.abs(t) < 1e12) & (F.abs(F.abs(t - whole) - 0.5) > 1e-3)
    return F.when(plain, whole / 10.0**places + 0.0).otherwise(F.bround(v, places))


def within(points: DataFrame, sites: DataFrame, radius: float, x: str = "x", y: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """Points and sites at most ``radius`` apart, with ``d2``. The sites go into the cells that they reach, and these to all executors while they are few, so that points keep their partitions and no pair is sorted.

    Both numbers of a cell are one key; cells of one key that are not one lie too far apart to hold a pair.
    """
    reach = _reach(sites, F.col(px) - radius, F.col(px) + radius, F.col(py) - radius, F.col(py) + radius, radius)
    one = F.shiftleft("_gx", 32).bitwiseXOR(F.col("_gy"))
    j = _own(points, x, y, radius).withColumn("_g", one).drop("_gx", "_gy").join(small(reach.withColumn("_g", one).drop("_gx", "_gy"), BOX_ROWS), "_g").drop("_g")
    return j.withColumn("d2", squared(F.col(x), F.col(y), F.col(px), F.col(py))).where(F.col("d2") <= radius * radius)


def _placed(x: str, y: str) -> Column:
    """Whether both coordinates are there and numbers."""
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))


def nearest(points: DataFrame, sites: DataFrame, key: str, site: str, most_sites: int = 50_000) -> DataFrame:
    """Nearest site of each point, the smaller id on a tie. ``points`` has key, x, y; ``sites`` has site, px, py. Points and sites without a place take no part.

    Up to ``most_sites`` go to all executors, where each batch of points is compared with them as arrays. More are met in cells, by radii that double until every point has met one.
    """
    real = points.where(_placed("x", "y")).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    there = sites.where(_placed("px", "py")).select(site, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    rows = there.limit(most_sites + 1).collect()
    if len(rows) > most_sites:
        return _nearest_in_cells(real, there, key, site)
    rows.sort()
    ids, sx, sy = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)
    step = max(1, 4_000_000 // max(1, len(rows)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), step):
                c = b.iloc[at : at + step]
                dx, dy = c["x"].to_numpy()[:, None] - sx, c["y"].to_numpy()[:, None] - sy
                d2 = dx * dx + dy * dy
                best = d2.argmin(1)
                yield pd.DataFrame({key: c[key].to_numpy(), site: [ids[i] for i in best], "d2": d2[np.arange(len(c)), best]})

    kinds = f"{key} {points.schema[key].dataType.simpleString()}, {site} {sites.schema[site].dataType.simpleString()}, d2 double"
    return ship(real if rows else real.limit(0)).mapInPandas(find, kinds)


def _nearest_in_cells(points: DataFrame, sites: DataFrame, key: str, site: str) -> DataFrame:
    """``nearest`` for any number of sites."""
    return points.join(_nearest_places(points, sites, site), ["x", "y"]).select(key, site, "d2")


def _nearest_places(points: DataFrame, sites: DataFrame, site: str) -> DataFrame:
    """x, y, site, d2 of the different places of points. What lies within a radius is known whole, so the nearest within it is the nearest; the first radius holds about one site."""
    sites = cut(sites)
    box = sites.agg(F.count("*").alias("n"), (F.max("px") - F.min("px")).alias("w"), (F.max("py") - F.min("py")).alias("h")).first()
    if not box.n:
        return sites.limit(0).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), site, F.lit(0.0).alias("d2"))
    radius = max(1e-3, (max(box.w, 1e-6) * max(box.h, 1e-6) / box.n) ** 0.5)
    # Points at one place have one nearest site, so places are searched for once.
    rest, found = cut(points.select("x", "y").distinct()), []
    while rest.limit(1).count():
        met = within(rest, sites, radius).groupBy("x", "y").agg(F.min(F.struct("d2", site)).alias("_b"))
        met = cut(met.select("x", "y", f"_b.{site}", "_b.d2"))
        found.append(met)
        before = rest
        rest = cut(rest.join(met, ["x", "y"], "left_anti"))
        drop(before)
        radius *= 2
    return reduce(DataFrame.unionByName, found) if found else sites.limit(0).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), site, F.lit(0.0).alias("d2"))


class Index:
    """Sites laid into square cells, row by row, so that the sites of neighbouring cells of a row lie side by side."""

    def __init__(self, ids: np.ndarray, sx: np.ndarray, sy: np.ndarray, radius: float):
        self.x0, self.y0, self.radius = sx.min(), sy.min(), radius
        w, h = float(np.ptp(sx)), float(np.ptp(sy))
        # About one site a cell, no more than four cells a site along a narrow strip, and few cells to the radius.
        self.side = max((w * h / len(sx)) ** 0.5, max(w, h) / (4 * len(sx)), radius / 64, 1e-3)
        self.nx, self.ny = int(w // self.side) + 1, int(h // self.side) + 1
        cell = ((sy - self.y0) // self.side).astype(np.int64) * self.nx + ((sx - self.x0) // self.side).astype(np.int64)
        order = np.lexsort((ids, cell))
        self.ids, self.sx, self.sy = ids[order], sx[order], sy[order]
        self.starts = np.searchsorted(cell[order], np.arange(self.nx * self.ny + 1))

    def _ranges(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the sites up to ``k`` cells away, for each point and row of cells."""
        cx = np.clip(np.nan_to_num((x - self.x0) // self.side), -k - 1, self.nx + k).astype(np.int64)
        cy = np.clip(np.nan_to_num((y - self.y0) // self.side), -k - 1, self.ny + k).astype(np.int64)
        rows = cy[:, None] + np.arange(-k, k + 1)
        first, last = np.clip(cx - k, 0, self.nx)[:, None], np.clip(cx + k + 1, 0, self.nx)[:, None]
        real = (rows >= 0) & (rows < self.ny)
        base = np.where(real, rows, 0) * self.nx
        lo = self.starts[base + first]
        return lo, np.where(real, self.starts[base + last] - lo, 0)

    @staticmethod
    def _flat(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point and site of each pair that ranges stand for, point by point."""
        each, flat = n.sum(1), n.ravel()
        p = np.repeat(np.arange(len(each)), each)
        return p, np.repeat(lo.ravel() - np.cumsum(flat) + flat, flat) + np.arange(len(p))

    def within(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point, site and squared distance of all pairs within the radius, point by point. Points are real."""
        p, s = self._flat(*self._ranges(x, y, int(self.radius // self.side) + 1))
        dx, dy = x[p] - self.sx[s], y[p] - self.sy[s]
        d2 = dx * dx + dy * dy
        near = d2 <= self.radius * self.radius
        return p[near], s[near], d2[near]

    def _met(self, x: np.ndarray, y: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = n.sum(1)
        p, s = self._flat(lo, n)
        best, d2 = np.full(len(x), -1), np.full(len(x), np.inf)
        if len(p):
            dx, dy = x[p] - self.sx[s], y[p] - self.sy[s]
            d = dx * dx + dy * dy
            some = each > 0
            d2[some] = np.minimum.reduceat(d, (np.cumsum(each) - each)[some])
            tied = np.flatnonzero(d == d2[p])
            tied = tied[np.lexsort((self.ids[s[tied]], p[tied]))]
            tied = tied[np.r_[True, np.diff(p[tied]) > 0]]
            best[p[tied]] = s[tied]
        return best, d2

    def nearest(self, x: np.ndarray, y: np.ndarray, pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest site of each point (-1 for none within the radius), the smaller id on a tie, and squared distance."""
        best, d2 = np.full(len(x), -1), np.full(len(x), np.inf)
        rest, k = np.flatnonzero(np.isfinite(x) & np.isfinite(y)), 1
        while len(rest):
            for part in np.array_split(rest, 1 + len(rest) * (2 * k + 1) // pairs):
                lo, n = self._ranges(x[part], y[part], k)
                for cut_ in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(n.sum(1)) // pairs)) + 1):
                    best[part[cut_]], d2[part[cut_]] = self._met(x[part[cut_]], y[part[cut_]], lo[cut_], n[cut_])
            known = k * self.side * (1 - 1e-9)  # what lies nearer has been met
            rest = rest[d2[rest] > known * known] if known <= self.radius else rest[:0]
            k *= 2
        best[~(d2 <= self.radius * self.radius)] = -1
        return best, d2

    def first(self, x: np.ndarray, y: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest site of each point within the radius that ``fits`` (of points and places), -1 for none, and distance; the smaller id on a tie. Points are real."""
        best, far = np.full(len(x), -1), np.full(len(x), np.inf)
        rest, k = np.arange(len(x)), 1
        while len(rest):
            for part in np.array_split(rest, 1 + len(rest) * (2 * k + 1) * (2 * k + 1) // pairs):
                lo, n = self._ranges(x[part], y[part], k)
                p, s = self._flat(lo, n)
                dx, dy = x[part][p] - self.sx[s], y[part][p] - self.sy[s]
                d2 = dx * dx + dy * dy
                real = np.flatnonzero((d2 <= self.radius * self.radius) & fits(part[p], s))
                p, s, d = p[real], s[real], np.sqrt(d2[real])
                least = np.full(len(part), np.inf)
                heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else p
                if len(p):
                    least[p[heads]] = np.minimum.reduceat(d, heads)
                tied = np.flatnonzero(d == least[p])
                tied = tied[np.lexsort((self.ids[s[tied]], p[tied]))]
                tied = tied[np.r_[True, p[tied][1:] != p[tied][:-1]]] if len(tied) else tied
                best[part[p[tied]]], far[part] = s[tied], least
            known = k * self.side * (1 - 1e-9)
            rest = rest[far[rest] > known] if known <= self.radius else rest[:0]
            k *= 2
        return best, far


def with_nearest(points: DataFrame, sites: DataFrame, site: str, radius: float, most_sites: int = 1_000_000) -> DataFrame:
    """``points`` (x, y) with site, px, py and d2 of the nearest site at most ``radius`` away, the smaller number on a tie; null where there is none. ``sites`` has site (a whole number), px, py.

    Up to ``most_sites`` (24 MB) go to all executors, where each batch of points looks into the cells around it: no row is shuffled and no pair is kept. More are met in cells.
    """
    there = sites.where(_placed("px", "py")).select(F.col(site).cast("long").alias(site), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    probe = there.limit(most_sites + 1).toPandas()
    if len(probe) > most_sites:
        where = points.where(_placed("x", "y")).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        places = _nearest_places(where, there, site).where(F.col("d2") <= radius * radius).join(there, site)
        places = places.groupBy("x", "y", site, "d2").agg(F.min(F.struct("px", "py")).alias("_p")).select(F.col("x").alias("_x"), F.col("y").alias("_y"), site, "_p.px", "_p.py", "d2")
        return points.join(places, (points["x"] == F.col("_x")) & (points["y"] == F.col("_y")), "left").drop("_x", "_y")
    if not len(probe):
        return points.withColumns({site: F.lit(None).cast("long"), **{c: F.lit(None).cast("double") for c in ("px", "py", "d2")}})
    known = points.sparkSession.sparkContext.broadcast(tuple(probe[c].to_numpy() for c in (site, "px", "py")))

    @F.pandas_udf(f"struct<{site}:long,px:double,py:double,d2:double>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(*known.value, radius)
        for x, y in batches:
            best, d2 = index.nearest(x.to_numpy(dtype=float), y.to_numpy(dtype=float))
            yield pd.DataFrame({site: index.ids[best], "px": index.sx[best], "py": index.sy[best], "d2": np.where(best >= 0, d2, np.nan)})

    met = ship(points).withColumn("_n", find(F.col("x").cast("double"), F.col("y").cast("double")))
    return met.select("*", *[F.when(F.col("_n.d2") <= radius * radius, F.col(f"_n.{c}")).alias(c) for c in (site, "px", "py", "d2")]).drop("_n")


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / F.when(length2 > 0, length2).otherwise(1.0)).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return squared(px, py, x1 + t * dx, y1 + t * dy)


def strip_class(points: DataFrame, segments: DataFrame, key: list[str], width: str, side: float = 200.0) -> DataFrame:
    """Widest strip along a segment that each point lies in: ``key``, width. Widest-first difference of buffers gives the same classes.

    A long segment is laid into the cells of its line only, as far as its own strip reaches. A strip that holds all four corners of a cell holds the cell, so a cell whose widest such strip is
    known keeps only the segments of wider ones. What is left is broadcast while it is small, so that points keep their partitions.
    """
    names = ("x1", "y1", "x2", "y2")
    wide = F.col(width).cast("double")
    spread = segments.select(*names, width).repartition(8 * points.sparkSession.sparkContext.defaultParallelism)  # few rows, many cells
    cells = cut(segment_cells(spread, side, F.col(width)))
    farthest = F.greatest(*[segment_distance2((F.col("_gx") + i) * side, (F.col("_gy") + j) * side, *map(F.col, names)) for i in (0, 1) for j in (0, 1)])
    held = (wide > SAFE) & (farthest <= (wide - SAFE) * (wide - SAFE))
    sure = cut(cells.where(held).groupBy("_gx", "_gy").agg(F.max(width).alias("_sure")))
    rest = cells.join(small(sure), ["_gx", "_gy"], "left").where(F.col("_sure").isNull() | (F.col(width) > F.col("_sure"))).drop("_sure")
    known = cut(rest.unionByName(sure.withColumnRenamed("_sure", width), allowMissingColumns=True))
    j = _own(points.select(*key, "x", "y"), "x", "y", side).join(small(known), ["_gx", "_gy"])
    near = F.col("x1").isNull() | (segment_distance2(F.col("x"), F.col("y"), *map(F.col, names)) <= F.col(width) * F.col(width))
    return j.where(near).groupBy(*key).agg(F.max(width).alias(width))


def segment_cells(segments: DataFrame, side: float, margin: float | Column = 0.0) -> DataFrame:
    """``segments`` once for each cell within ``margin`` of their line: column by column of cells, the rows that the line spans there."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    s = segments.withColumn("_gx", F.explode(F.sequence(_cell(F.least(x1, x2) - margin, side), _cell(F.greatest(x1, x2) + margin, side))))
    dx = x2 - x1

    def at(x: Column) -> Column:
        t = F.when(dx != 0, (x - x1) / F.when(dx != 0, dx).otherwise(1.0)).otherwise(0.0)
        return y1 + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (y2 - y1)

    a, b = at(F.col("_gx") * side - margin), at((F.col("_gx") + 1) * side + margin)
    flat = dx == 0
    low, high = F.when(flat, F.least(y1, y2)).otherwise(F.least(a, b)), F.when(flat, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    return s.withColumn("_gy", F.explode(F.sequence(_cell(low - margin, side), _cell(high + margin, side))))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _on(cx: Column, cy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a point in line with a segment lies between its ends."""
    return cx.between(F.least(ax, bx), F.greatest(ax, bx)) & cy.between(F.least(ay, by), F.greatest(ay, by))


def _box_cells(segments: DataFrame, levels: list[int], side: float, margin: float = 1e-6) -> DataFrame:
    """``segments`` (with _l, their level) once for each cell of their box, at their own level (_k = _l) and at each coarser one: _h, _k, _gx, _gy, and _cx, _cy, the first cell of the box."""
    s = segments.withColumn("_k", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("_l"))))
    edge = lambda f, u, v, by: F.floor((f(F.col(u), F.col(v)) + by) / (side * F.pow(F.lit(2.0), F.col("_k")))).cast("long")
    s = s.withColumns({"_cx": edge(F.least, "x1", "x2", -margin), "_cy": edge(F.least, "y1", "y2", -margin)})
    s = s.withColumn("_gx", F.explode(F.sequence("_cx", edge(F.greatest, "x1", "x2", margin)))).withColumn("_gy", F.explode(F.sequence("_cy", edge(F.greatest, "y1", "y2", margin))))
    return s.withColumn("_h", F.xxhash64("_k", "_gx", "_gy"))


def crossing_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, side: float = 500.0, proper: bool = False, once: bool = False, places: bool = True, meet: bool = False) -> DataFrame:
    """Pairs of segments that meet, be it in an end or along a stretch; ``proper``: only those that cross in a point inside both. Each segment has a key and x1, y1, x2, y2.

    ``once``: only pairs with the smaller key in ``a``, for a table met with itself; ``places``: with the ends of both; ``meet``: instead of them with este and norte, where they meet. A segment's level is that of the cells, doubling from ``side``, that its box fits in, so it lies in four of
    them at most. Two segments are compared in the cells of the longer one and, of those in common, in the first only: no pair comes twice and none has to be kept to know that.
    """
    names = ("x1", "y1", "x2", "y2")
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    level = F.when(extent > side, F.ceil(F.log2(extent / side))).otherwise(0).cast("int")
    whole = [df.where(_placed("x1", "y1") & _placed("x2", "y2")).select(key, *names, level.alias("_l")) for df, key in ((a, key_a), (b, key_b))]
    levels = sorted(r[0] for r in whole[0].select("_l").union(whole[1].select("_l")).distinct().collect())
    if not levels:
        levels = [0]
    cells = [_box_cells(df, levels, side).select("_h", key, *[F.col(c).cast("double").alias(f"{n}{c}") for c in names], *[F.col(c).alias(f"{n}{c}") for c in ("_l", "_k", "_gx", "_gy", "_cx", "_cy")]) for df, key, n in ((whole[0], key_a, "a"), (whole[1], key_b, "b"))]
    p = [F.col(c) for c in ("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2")]
    turns = [_turn(*p[:4], *p[4:6]), _turn(*p[:4], *p[6:]), _turn(*p[4:], *p[:2]), _turn(*p[4:], *p[2:4])]
    cross = (turns[0] * turns[1] < 0) & (turns[2] * turns[3] < 0)
    if not proper:
        for turn, end, line in zip(turns, (p[4:6], p[6:], p[:2], p[2:4]), (p[:4], p[:4], p[4:], p[4:])):
            cross = cross | ((turn == 0) & _on(*end, *line))
    here = (F.col("a_k") == F.col("b_k")) & (F.col("a_gx") == F.col("b_gx")) & (F.col("a_gy") == F.col("b_gy"))
    here = here & (F.col("a_gx") == F.greatest("a_cx", "b_cx")) & (F.col("a_gy") == F.greatest("a_cy", "b_cy"))
    if once:
        here = (F.col(key_a) < F.col(key_b)) & here
    kept = [key_a, key_b, *(("este", "norte") if meet else [f"{n}{c}" for n in "ab" for c in names if places])]
    tasks = 8 * a.sparkSession.sparkContext.defaultParallelism
    numbers = all(df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") for df, key in ((a, key_a), (b, key_b)))
    out = []
    for left, right in ((cells[0].where("a_l = a_k"), cells[1]), (cells[0].where("a_l < a_k"), cells[1].where("b_l = b_k"))):
        known = right.where(F.col(key_b).isNotNull()).limit(BOX_ROWS + 1).toArrow() if numbers else None
        if known is not None and len(known) <= BOX_ROWS:
            out.append(_met_in_boxes(left.where(F.col(key_a).isNotNull()).repartition(tasks), known, key_a, key_b, kept, proper, once, b.schema[key_b].dataType.simpleString()))
        else:
            met = left.join(small(right), "_h").where(here & cross)
            out.append((met.withColumns(dict(zip(("este", "norte"), _meeting()))) if meet else met).select(*kept))
    return out[0].unionByName(out[1])


def _met_in_boxes(left: DataFrame, right: pa.Table, key_a: str, key_b: str, kept: list[str], proper: bool, once: bool, kind_b: str) -> DataFrame:
    """``kept`` of the pairs of ``crossing_pairs`` with the segments of ``right``, which go to all executors; the same conditions, a segment against all of its cell at a time.

    The segments of a cell are parted by whether it is the first of their box across and up: a cell is the first in common if it is so for either, so only the parts that hold for a segment are compared with it, and no pair twice.
    """
    r = {c: right.column(c).to_numpy() for c in right.column_names}
    r["_c"] = (r["b_cx"] == r["b_gx"]) + 2 * (r["b_cy"] == r["b_gy"])
    order = np.lexsort((r[key_b], r["_c"], r["_h"]))
    names = [f"{n}{c}" for n in "ab" for c in ("x1", "y1", "x2", "y2")]
    cell = ("b_k", "b_gx", "b_gy")
    r = {c: r[c][order] for c in ("_h", "_c", key_b, *names[4:], *cell)}
    hashes, first, which = np.unique(r["_h"], return_index=True, return_inverse=True)
    counts = np.bincount(4 * which + r["_c"], minlength=4 * len(hashes)).reshape(-1, 4)
    bounds = np.column_stack([first, first[:, None] + counts.cumsum(1)])
    same = r["_h"][1:] == r["_h"][:-1]
    mixed = bool(np.any(same & np.any([r[c][1:] != r[c][:-1] for c in cell], axis=0)))  # cells that share a hash
    del r["_c"], r["_h"]
    sent = left.sparkSession.sparkContext.broadcast((r, hashes, bounds))
    meet = "este" in kept

    def on(cx, cy, ax, ay, bx, by):  # noqa: ANN001, ANN202
        return (cx >= np.minimum(ax, bx)) & (cx <= np.maximum(ax, bx)) & (cy >= np.minimum(ay, by)) & (cy <= np.maximum(ay, by))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, hashes, bounds = sent.value
        bx1, by1, bx2, by2 = (r[c] for c in names[4:])
        keys = r[key_b]
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            parts, ends, held = [], [], 0
            at = np.searchsorted(hashes, columns["_h"])
            there = np.flatnonzero((hashes[np.minimum(at, len(hashes) - 1)] == columns["_h"]) if len(hashes) else np.zeros(len(at), dtype=bool))
            need = (columns["a_cx"] != columns["a_gx"]) + 2 * (columns["a_cy"] != columns["a_gy"])
            for i in there:
                edges = bounds[at[i]]
                own = [columns[c][i] for c in ("a_k", "a_gx", "a_gy")]
                if not mixed and any(r[c][edges[0]] != v for c, v in zip(cell, own)):
                    continue
                ax1, ay1, ax2, ay2 = (float(columns[c][i]) for c in names[:4])
                dx, dy = ax2 - ax1, ay2 - ay1
                for c in range(4):
                    if c & need[i] != need[i] or edges[c] == edges[c + 1]:
                        continue
                    s, e = edges[c], edges[c + 1]
                    if once:
                        s += np.searchsorted(keys[s:e], columns[key_a][i], "right")
                    for x in range(s, e, 16_384):
                        y = min(x + 16_384, e)
                        side1 = _side(dx, dy, ax1, ay1, bx1[x:y], by1[x:y])
                        side1 *= _side(dx, dy, ax1, ay1, bx2[x:y], by2[x:y])
                        j = np.flatnonzero(side1 <= 0)  # those with an end on either side or on the line
                        if not len(j):
                            continue
                        side1 = side1[j]
                        j += x
                        q = bx1[j], by1[j], bx2[j], by2[j]
                        ex, ey = q[2] - q[0], q[3] - q[1]
                        side2 = (ex * (ay1 - q[1]) - ey * (ax1 - q[0])) * (ex * (ay2 - q[1]) - ey * (ax2 - q[0]))
                        cross = (side1 < 0) & (side2 < 0)
                        zero = (side1 == 0) | (side2 == 0)  # ends on lines, or too small a product
                        if mixed:
                            here = np.all([r[c][j] == v for c, v in zip(cell, own)], axis=0)
                            cross &= here
                            zero &= here
                        parts.append((i, j[cross]))
                        ends.append((i, j[zero]))
                        held += len(parts[-1][1]) + len(ends[-1][1])
                        if held >= 50_000:
                            yield taken(columns, r, parts, ends)
                            parts, ends, held = [], [], 0
            if held:
                yield taken(columns, r, parts, ends)

    def touching(p: list, q: list) -> np.ndarray:
        """Which segments of two lists meet, by the sign of each turn."""
        turns = [_turned(*p, *q[:2]), _turned(*p, *q[2:]), _turned(*q, *p[:2]), _turned(*q, *p[2:])]
        cross = (turns[0] * turns[1] < 0) & (turns[2] * turns[3] < 0)
        if not proper:
            for t, end, line in zip(turns, (q[:2], q[2:], p[:2], p[2:]), (p, p, q, q)):
                cross |= (t == 0) & on(*end, *line)
        return cross

    def flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat([i for i, _ in parts], [len(j) for _, j in parts]), np.concatenate([j for _, j in parts])

    def taken(columns: dict, r: dict, parts: list, ends: list) -> pa.RecordBatch:
        """A batch of the pairs that cross, and of those that need their ends looked at and meet."""
        i, j = flat(ends)
        met = touching([columns[c][i] for c in names[:4]], [r[c][j] for c in names[4:]])
        i, j = (np.concatenate(x) for x in zip(flat(parts), (i[met], j[met])))
        wanted = {c: columns[c][i] if c in columns else r[c][j] for c in kept[:2] + (names if meet else kept[2:])}
        if meet:
            wanted["este"], wanted["norte"] = _where_they_meet(*(wanted[c] for c in names))
        return pa.RecordBatch.from_arrays([pa.array(wanted[c]) for c in kept], names=kept)

    kinds = {key_a: left.schema[key_a].dataType.simpleString(), key_b: kind_b}
    return ship(left).mapInArrow(find, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in kept))


def _side(dx: float, dy: float, ax: float, ay: float, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """On which side points lie of a line through a point; the same numbers as in ``_turn``."""
    up = cy - ay
    up *= dx
    across = cx - ax
    across *= dy
    up -= across
    return up


def _turned(ax, ay, bx, by, cx, cy):  # noqa: ANN001, ANN202
    """``_turn`` of arrays."""
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _meeting() -> list[Column]:
    """Where the segments of a pair meet; of a stretch in common the middle."""
    x1, y1, x2, y2, x3, y3, x4, y4 = (F.col(c) for c in ("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2"))
    t = F.try_divide((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4), (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4))
    ends = [F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y2), (x3, y3), (x4, y4))]
    low, high = F.greatest(F.least(*ends[:2]), F.least(*ends[2:])), F.least(F.greatest(*ends[:2]), F.greatest(*ends[2:]))
    return [F.coalesce(u + t * (v - u), (low[c] + high[c]) / 2) for u, v, c in ((x1, x2, "x"), (y1, y2, "y"))]


def _where_they_meet(x1, y1, x2, y2, x3, y3, x4, y4):  # noqa: ANN001, ANN202
    """``_meeting`` of arrays: the same steps in the same order, so the same numbers."""
    bx, by = x3 - x4, y3 - y4
    across = (x1 - x2) * by - (y1 - y2) * bx
    along = across == 0
    t = ((x1 - x3) * by - (y1 - y3) * bx) / np.where(along, 1.0, across)
    este, norte = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    k = np.flatnonzero(along)
    if len(k):
        ends = [(x[k], y[k]) for x, y in ((x1, y1), (x2, y2), (x3, y3), (x4, y4))]

        def ordered(p, q):  # noqa: ANN001, ANN202
            less = (p[0] < q[0]) | ((p[0] == q[0]) & (p[1] <= q[1]))
            return [np.where(less, u, v) for u, v in zip(p, q)], [np.where(less, v, u) for u, v in zip(p, q)]

        (low_a, high_a), (low_b, high_b) = ordered(*ends[:2]), ordered(*ends[2:])
        low, high = ordered(low_a, low_b)[1], ordered(high_a, high_b)[0]
        este[k], norte[k] = (low[0] + high[0]) / 2, (low[1] + high[1]) / 2
    return este, norte


def crossing_points(pairs: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Where the segments of ``crossing_pairs`` meet, be it told by ``meet`` or by the ends of both."""
    este, norte = (F.col("este"), F.col("norte")) if "este" in pairs.columns else _meeting()
    return pairs.select(key_a, key_b, rounded(este).alias("este"), rounded(norte).alias("norte"))


def weighted_centers(df: DataFrame, group: str, x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted mean position of each group, from whole-number coordinates and weights, null without weight."""
    g = df.groupBy(group).agg(F.sum(w).alias("peso"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"))
    return g.select(group, "peso", F.bround(F.try_divide("sx", "peso"), 4).alias("cx"), F.bround(F.try_divide("sy", "peso"), 4).alias("cy"))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def snap_to_ring(sites: DataFrame, key: str, free: Column, step: float = 25.0, rings: int = 8) -> DataFrame:
    """Y2: first place that ``free`` accepts: the site itself, else on rings of max(8, 8 k) places from 0 degrees, ring by ring. Null if none.

    ``free`` is a condition on columns qx, qy. The candidates are a fixed table of offsets and each site has as many, so nothing is paired with other sites.
    """
    spots = F.flatten(F.array(F.array(F.struct(F.lit(0).alias("ring"), F.lit(0).alias("i"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"))), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rings)), lambda k: F.transform(F.sequence(F.lit(0), 8 * k - 1), lambda i: F.struct(k.alias("ring"), i.alias("i"), (F.cos(i / (8 * k) * 2 * 3.141592653589793) * k * step).alias("ox"), (F.sin(i / (8 * k) * 2 * 3.141592653589793) * k * step).alias("oy")))))))
    tried = sites.withColumn("_o", F.explode(spots)).withColumns({"qx": F.col("px") + F.col("_o.ox"), "qy": F.col("py") + F.col("_o.oy")})
    best = tried.groupBy(key).agg(F.min(F.when(free, F.struct("_o.ring", "_o.i", "qx", "qy"))).alias("b"))
    return best.select(key, F.col("b.ring").alias("anillo"), F.col("b.i").alias("i"), F.bround("b.qx", 4).alias("qx"), F.bround("b.qy", 4).alias("qy"))


def hectares(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """``key`` and hectareas of each ring, by the sum over its sides from its first corner; a ring of fewer than three corners has none."""
    p = F.col(ring)
    a, b = lambda i: F.get(p, i), lambda i: F.get(p, (i + 1) % F.size(p))
    f = F.get(p, F.lit(0))
    part = lambda i: (a(i)["x"] - f["x"]) * (b(i)["y"] - f["y"]) - (b(i)["x"] - f["x"]) * (a(i)["y"] - f["y"])
    twice = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + part(i))
    return regions.where(F.size(p) >= 3).select(key, F.bround(F.abs(twice) / 2 / 10000, 4).alias("hectareas"))


def outside(points: DataFrame, key: str, regions: DataFrame) -> DataFrame:
    """``key`` of the points (x, y) that lie in no region (zona_id, ring). A point without a place lies in none."""
    ids = points.select(F.col(key).alias("_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    hit = points_in_regions(located(ids, "_id"), regions).select(F.col("id_a").alias(key)).distinct()
    return points.select(key).join(hit, key, "left_anti")


def crossing_counts(lines: DataFrame, barriers: DataFrame, key: str, barrier: str, side: float = 500.0) -> DataFrame:
    """Of each line (x1, y1, x2, y2) the barriers that it meets, touching included; a barrier of several parts counts by its parts. Lines that meet none have 0."""
    met = crossing_pairs(lines, barriers, key, barrier, side).groupBy(key).agg(F.count("*").alias("cruces"))
    return lines.select(key).join(met, key, "left").select(key, F.coalesce("cruces", F.lit(0)).alias("cruces"))
