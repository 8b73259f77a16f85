"""Problem 3: points near other points and regions containing points, by ranges of space-filling-curve cells.

Coordinates become integers (half centimetres), so every refinement is exact. A cell's code interleaves the bits of its column and
row. A disc is covered by ranges of the codes of the cells that it touches; a region by a quadtree: squares of cells wholly inside,
as large as they fit, and the smallest cells along its rim. Ranges are cut at blocks of codes, so that the range join is an equality of blocks with a
bound on codes, which Spark sorts, splits when skewed and spills; large squares have large blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.runtime import cut, ship

#: Integer units per metre.
UNITS = 200
#: A block of the pair join holds 2 ** PAIR_BITS cells.
PAIR_BITS = 2
#: A block of the region join holds 2 ** bits cells: of each tier of squares.
TIER_BITS = (6, 14, 22, 30, 38, 46)
#: Regions that a task covers.
TASK_REGIONS = 500
#: Levels of squares beyond a block that are cut into its blocks before the next tier takes them.
SPARE = 2
#: No position on Earth is further from the origin in metres; cells are so large that codes reach as far.
FARTHEST = 4.0e7
#: Cells lie within 2 ** 23 of the origin, so that a code has 48 bits.
_OFFSET = 1 << 23


def _spread_byte(v: int) -> int:
    return sum((v >> i & 1) << 2 * i for i in range(8))


SPREAD = [_spread_byte(v) for v in range(256)]


def _spread(v: Column) -> Column:
    """The low 24 bits of a whole number, spread to the even bits of the result: one table look-up a byte."""
    table = F.lit(SPREAD).cast("array<long>")
    parts = [F.shiftleft(F.get(table, F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)).cast("int")), 16 * i) for i in range(3)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def z_code(column: Column, row: Column) -> Column:
    """Code of a cell on the Z-order curve."""
    return _spread(column.cast("long") + _OFFSET).bitwiseOR(F.shiftleft(_spread(row.cast("long") + _OFFSET), 1))


def z_codes(column: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The same code for arrays."""
    table = np.array(SPREAD, dtype=np.int64)

    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64) + _OFFSET
        return table[v & 255] | table[v >> 8 & 255] << 16 | table[v >> 16 & 255] << 32

    return spread(column) | spread(row) << 1


def _whole(v: Column) -> Column:
    """Nearest whole number; cheaper than a decimal rounding."""
    return F.floor(v + 0.5)


def located(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """id, px, py in integer units of the rows with a position: no null, NaN or infinite coordinate or one beyond FARTHEST, and not (0,0), which means undefined."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    real = ~F.isnan(cx) & ~F.isnan(cy) & (F.abs(cx) <= FARTHEST) & (F.abs(cy) <= FARTHEST) & ~((cx == 0) & (cy == 0))
    return df.where(F.coalesce(real, F.lit(False))).select(F.col(key).alias("id"), _whole(cx * UNITS).alias("px"), _whole(cy * UNITS).alias("py"))


def _cell(v: Column, side: int) -> Column:
    return F.floor(v / F.lit(side).cast("double"))


def _side(metres: float) -> int:
    """Side of a cell in integer units, at least so large that codes reach FARTHEST."""
    return max(int(round(metres * UNITS)), int(FARTHEST * UNITS) // _OFFSET + 2)


def pairs_within(points: DataFrame, distance_m: float) -> DataFrame:
    """Pairs of points at most ``distance_m`` apart, borders included: id_a < id_b.

    ``points`` as given by ``located``; ids are unique. A cell is as wide as a disc, so that a disc touches two columns and two rows at most; its cells within one block are a range of
    codes. Each pair is found once, at the cell of its smaller id: that point offers its own code, the other the ranges of its disc. Points at one
    place are pairs like any other; an empty input gives no pairs.
    """
    radius = int(round(distance_m * UNITS))
    side = _side(2 * radius / UNITS)
    own = points.select(z_code(_cell(F.col("px"), side), _cell(F.col("py"), side)).alias("code"), F.col("id").alias("id_a"), F.col("px").alias("ax"), F.col("py").alias("ay"))
    edge = {f"_{c}{n}": _cell(F.col(p) + (radius if n else -radius), side) for c, p in (("c", "px"), ("r", "py")) for n in (0, 1)}
    wide = 2 ** (PAIR_BITS // 2)
    discs = points.select(F.col("id").alias("id_b"), F.col("px").alias("bx"), F.col("py").alias("by"), *[v.alias(n) for n, v in edge.items()])
    for c in ("c", "r"):
        discs = discs.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(F.col(f"_{c}0") / wide), F.floor(F.col(f"_{c}1") / wide))))
    first = [F.greatest(F.col(f"_{c}0"), F.col(f"_b{c}") * wide) for c in ("c", "r")]
    last = [F.least(F.col(f"_{c}1"), F.col(f"_b{c}") * wide + (wide - 1)) for c in ("c", "r")]
    ranges = discs.select("id_b", "bx", "by", z_code(*first).alias("lo"), z_code(*last).alias("hi"))
    held = (F.col("code") >= F.col("lo")) & (F.col("code") <= F.col("hi"))
    near = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) <= radius * radius
    return own.join(ranges, (F.shiftright("code", PAIR_BITS) == F.shiftright("lo", PAIR_BITS)) & held & (F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b")


def _squares(ring: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(level, columns, rows, inside) of the squares that cover a ring, level by level from the largest: those wholly inside, and cells of level 0 that an edge may touch."""
    x0, y0 = ring[:, 0], ring[:, 1]
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    span = max(int(np.ptp(x0)), int(np.ptp(y0)), 1)
    level = max(0, (span // side).bit_length() - 1)
    wide = side << level
    columns, rows = (g.ravel() for g in np.meshgrid(np.arange(x0.min() // wide, x0.max() // wide + 1), np.arange(y0.min() // wide, y0.max() // wide + 1)))
    while len(columns):
        wide = side << level
        cx, cy = columns[:, None] * wide, rows[:, None] * wide
        # An edge misses a square if their boxes are apart, or all corners lie on one side of its line. Borders count as touching.
        apart = (np.minimum(x0, x1) > cx + wide) | (np.maximum(x0, x1) < cx) | (np.minimum(y0, y1) > cy + wide) | (np.maximum(y0, y1) < cy)
        turns = np.stack([(x1 - x0) * (cy + b * wide - y0) - (y1 - y0) * (cx + a * wide - x0) for a in (0, 1) for b in (0, 1)])
        touched = (~(apart | (turns > 0).all(0) | (turns < 0).all(0))).any(1)
        px, py = cx + wide / 2, cy + wide / 2
        crossing = (y0 > py) != (y1 > py)
        tall = np.where(y1 == y0, 1, y1 - y0)
        inside = (crossing & (px < x0 + (py - y0) * (x1 - x0) / tall)).sum(1) % 2 == 1
        whole = ~touched & inside
        if whole.any():
            yield level, columns[whole], rows[whole], True
        columns, rows = columns[touched], rows[touched]
        if level == 0:
            if len(columns):
                yield 0, columns, rows, False
            return
        level -= 1
        columns, rows = (np.repeat(2 * columns, 4) + np.tile([0, 1, 0, 1], len(columns)), np.repeat(2 * rows, 4) + np.tile([0, 0, 1, 1], len(rows)))


def _merged(lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, those that adjoin within a block made one."""
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    new = np.concatenate([[True], (lo[1:] != hi[:-1] + 1) | (lo[1:] >> bits != lo[:-1] >> bits)])
    starts = np.flatnonzero(new)
    return lo[starts], hi[np.append(starts[1:], len(lo)) - 1]


def _cover(ring: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(tier, lo, hi, inside) code ranges that cover a ring; inside ranges need no refinement. No range passes a block of its tier."""
    inner: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for level, columns, rows, inside in _squares(ring, side):
        if not inside:
            codes = z_codes(columns, rows)
            yield 0, *_merged(codes, codes, TIER_BITS[0]), False
            continue
        tier = next(t for t, bits in enumerate(TIER_BITS) if 2 * level <= bits + 2 * SPARE)
        lo = z_codes(columns << level, rows << level)
        extra = max(0, 2 * level - TIER_BITS[tier])
        step = 1 << 2 * level - extra
        lo = (lo[:, None] + np.arange(1 << extra) * step).ravel()
        inner.setdefault(tier, []).append((lo, lo + step - 1))
    for tier, parts in inner.items():
        yield tier, *_merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), TIER_BITS[tier]), True


def _unspread(code: np.ndarray) -> np.ndarray:
    """The even bits of codes, put together."""
    out = np.zeros_like(code)
    for i in range(24):
        out |= (code >> 2 * i & 1) << i
    return out


def region_ranges(regions: DataFrame, key: str, ring: str, cell_m: float) -> DataFrame:
    """Code ranges that cover each region: id, tier, lo, hi, and the edges (x0, y0, x1, y1, null where the range lies wholly inside) that decide about points in it.

    A ring of fewer than three different corners, or null, covers nothing. Corners that are null or no numbers are left out. A range along the rim has
    only the edges that a ray to greater x from its box can meet.
    """
    side = _side(cell_m)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key_, xs, ys in zip(batch["id"], batch["xs"], batch["ys"]):
                a = np.column_stack([np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)])
                a = np.rint(a[np.isfinite(a).all(axis=1)] * UNITS).astype(np.int64)
                if len(a) and (a[0] == a[-1]).all():
                    a = a[:-1]
                if len(np.unique(a, axis=0)) < 3:
                    continue
                edges = np.column_stack([a, np.roll(a, -1, axis=0)])
                for tier, lo, hi, inside in _cover(a, side):
                    if inside:
                        out += [(key_, tier, x, y, None, None, None, None) for x, y in zip(lo.tolist(), hi.tolist())]
                        continue
                    # The box of a range: that of the square of cells that it lies in.
                    level = np.array([((x ^ y).bit_length() + 1) // 2 for x, y in zip(lo.tolist(), hi.tolist())])
                    base = lo >> 2 * level << 2 * level
                    left, low = ((_unspread(base >> k) - _OFFSET) * side for k in (0, 1))
                    top = low + (side << level)
                    use = (edges[:, [1, 3]].min(1) <= top[:, None]) & (edges[:, [1, 3]].max(1) >= low[:, None]) & (edges[:, [0, 2]].max(1) >= left[:, None])
                    for x, y, u in zip(lo.tolist(), hi.tolist(), use):
                        e = edges[u]
                        out.append((key_, tier, x, y, e[:, 0], e[:, 1], e[:, 2], e[:, 3]))
            if out:
                yield pd.DataFrame(out, columns=["id", "tier", "lo", "hi", "x0", "y0", "x1", "y1"])

    src = regions.where(F.col(ring).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(ring, lambda p: p["x"]).alias("xs"), F.transform(ring, lambda p: p["y"]).alias("ys"))
    # Rings are little data and much work, so they are spread by number.
    spread = src.repartition(src.count() // TASK_REGIONS + src.sparkSession.sparkContext.defaultParallelism)
    return ship(spread).mapInPandas(cover, "id long, tier int, lo long, hi long, x0 array<long>, y0 array<long>, x1 array<long>, y1 array<long>")


def odd_crossings(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Even-odd rule in exact integers over edges given as four arrays: a point is inside if a ray to greater x crosses an odd number of edges.

    An edge takes its lower end and not its upper one; a point on an edge counts by the same rule.
    """

    def crosses(i: Column) -> Column:
        ax, ay, bx, by = (F.get(c, i) for c in (x0, y0, x1, y1))
        left = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
        return ((ay > py) != (by > py)) & F.when(by > ay, left < 0).otherwise(left > 0)

    none = F.size(x0) == 0
    return ~none & F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(x0) - 1, F.lit(0))), F.lit(False), lambda acc, i: acc != crosses(i))


def inside_ring(px: Column, py: Column, rx: Column, ry: Column) -> Column:
    """Even-odd rule in exact integers: a point is inside if a ray to greater x crosses an odd number of edges.

    An edge takes its lower end and not its upper one; a point on an edge counts by the same rule.
    """
    n = F.size(rx)
    edges = F.sequence(F.lit(0), n - 1)

    def crosses(i: Column) -> Column:
        x0, y0 = F.get(rx, i), F.get(ry, i)
        j = F.when(i == n - 1, F.lit(0)).otherwise(i + 1)
        x1, y1 = F.get(rx, j), F.get(ry, j)
        left = (px - x0) * (y1 - y0) - (py - y0) * (x1 - x0)
        return ((y0 > py) != (y1 > py)) & F.when(y1 > y0, left < 0).otherwise(left > 0)

    return F.aggregate(edges, F.lit(False), lambda acc, i: acc != crosses(i))


def points_in_regions(points: DataFrame, regions: DataFrame, key: str = "zona_id", ring: str = "ring", cell_m: float = 8.0) -> DataFrame:
    """The regions that each point lies in: id_a the point, id_b the region.

    Regions may overlap, be open or closed, turn either way and be concave. A point in several regions gives several rows. The points meet the ranges once for each tier of
    squares that the regions need: a second one only where some region is half a kilometre wide and more.
    """
    side = _side(cell_m)
    at = points.select(F.col("id").alias("id_a"), "px", "py", z_code(_cell(F.col("px"), side), _cell(F.col("py"), side)).alias("code"))
    ranges = cut(region_ranges(regions, key, ring, cell_m).withColumnRenamed("id", "id_b"))
    exact = F.col("x0").isNull() | odd_crossings(*[F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")])
    parts = []
    for tier in sorted(r.tier for r in ranges.select("tier").distinct().collect()) or [0]:
        bits = TIER_BITS[tier]
        held = (F.shiftright("code", bits) == F.shiftright("lo", bits)) & (F.col("code") >= F.col("lo")) & (F.col("code") <= F.col("hi"))
        parts.append(at.join(ranges.where(F.col("tier") == tier).drop("tier"), held).where(exact).select("id_a", "id_b"))
    return reduce(DataFrame.unionByName, parts)
