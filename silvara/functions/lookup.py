"""Look-ups in small ordered tables and positions on map grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_lookup(value: Column, table: dict[int, float], above: float | None = None) -> Column:
    """Entry of the largest key up to the value; below the table its first entry, beyond its last key ``above`` if given. Null gives null."""
    keys = sorted(table)
    out = F.when(value.isNull(), None)
    if above is not None:
        out = out.when(value > keys[-1], float(above))
    for k in reversed(keys):
        out = out.when(value >= k, float(table[k]))
    return out.otherwise(float(table[keys[0]]))


def utm_zone(lon: Column) -> Column:
    """Zone of a longitude in degrees, within 1 to 60."""
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Code of a position's zone, north or south."""
    return F.lit(32000) + F.when(lat < 0, 700).otherwise(600) + utm_zone(lon)


def threshold_cells(hectares: float, cell: float) -> int:
    """Cells that a catchment of so many hectares holds, at least 1."""
    return max(1, round(hectares * 10000 / (cell * cell)))


def width_table(rows: list[tuple[str, str]]) -> dict[int, float]:
    """Widths by order from typed rows (order, width); points or commas mark decimals, rows that hold no two numbers are passed over, the later of two equal orders counts."""
    out = {}
    for order, width in rows:
        try:
            out[int(str(order).strip())] = float(str(width).strip().replace(",", "."))
        except ValueError:
            continue
    return out


def scenario_numbers(text: str, default: tuple[int, ...] = (1, 2, 3)) -> tuple[int, ...]:
    """Numbers of centres from a typed list parted by commas or semicolons: whole numbers from 1, in order, each once; ``default`` if there is none."""
    parts = (p.strip() for p in (text or "").replace(";", ",").split(","))
    return tuple(sorted({int(p) for p in parts if p.isdecimal() and int(p) >= 1})) or default


def exit_point(x: float | None, y: float | None) -> tuple[float, float] | None:
    """The point where roads leave; (0, 0) and a missing coordinate are undefined."""
    return None if x is None or y is None or (x, y) == (0, 0) or x != x or y != y else (float(x), float(y))
