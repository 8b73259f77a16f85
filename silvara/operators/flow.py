"""Water on grids and networks: drainage, accumulation, height above drainage, stream orders. Loops write each round to the shared folder and stop when nothing changes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.operators.raster import RING, around, laid, neighbours, tiled
from silvara.runtime import cut, drop


def drainage(dem: DataFrame, cell: float) -> DataFrame:
    """H1: the neighbour that each cell drains to by steepest descent (nr, nc; null in pits and flats); the first of the ring on a tie."""
    n = neighbours(dem, "z", RING)
    far = [cell * (2**0.5 if dr and dc else 1.0) for dr, dc in RING]
    drop = [F.when(F.get("n", F.lit(k)).isNotNull(), (F.col("z") - F.get("n", F.lit(k))) / far[k]) for k in range(8)]
    best = F.greatest(*[F.struct(F.coalesce(d, F.lit(-1e300)).alias("d"), F.lit(-k).alias("k")) for k, d in enumerate(drop)])
    step = [F.get(F.array(*[F.lit(o[i]) for o in RING]), -best["k"]) for i in (0, 1)]
    falls = best["d"] > 0
    return n.select("r", "c", F.when(falls, F.col("r") + step[0]).cast("long").alias("nr"), F.when(falls, F.col("c") + step[1]).cast("long").alias("nc"))


#: Label of the water that leaves the grid.
OUT = -1


def fill_depressions(dem: DataFrame, tile: int = 512) -> DataFrame:
    """H1: no cell lower than its way out, by priority flood. Water leaves where one of a cell's eight neighbours is missing or has no height.

    Each tile of at most tile x tile cells is flooded alone, from its outlets and the cells beside other tiles, and labelled by the seed that each cell drains to.
    The spill heights between labels, within tiles and across, give each label's level; a cell lies at its own or its label's level, whichever is higher.
    """

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j = laid(pdf, tile)
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - 1, int(pdf["_tc"].iloc[0]) * tile - 1
        lone = np.zeros(z.shape, dtype=bool)
        lone[1:-1, 1:-1] = np.any([np.isnan(around(z, *o)) for o in RING], axis=0)
        beside = np.zeros(z.shape, dtype=bool)
        beside[[1, -2], 1:-1] = beside[1:-1, [1, -2]] = True
        own = ~np.isnan(z)
        own[[0, -1]] = own[:, [0, -1]] = False
        out, label = np.full(z.shape, np.nan), np.zeros(z.shape, dtype=np.int64)
        known = np.zeros(z.shape, dtype=bool)
        ocean = own & lone
        label[ocean], known[ocean] = OUT, True
        seeds = own & (lone | beside)
        out[seeds] = z[seeds]
        heap = [(z[a, b], a, b) for a, b in np.argwhere(seeds).tolist()]
        heapq.heapify(heap)
        while heap:
            v, a, b = heapq.heappop(heap)
            if not known[a, b]:
                label[a, b], known[a, b] = (r0 + a + 2**30 << 31) + (c0 + b + 2**30), True
            for di, dj in RING:
                m, n = a + di, b + dj
                if own[m, n] and not known[m, n]:
                    label[m, n], known[m, n] = label[a, b], True
                    if out[m, n] != out[m, n]:
                        out[m, n] = max(z[m, n], v)
                        heapq.heappush(heap, (out[m, n], m, n))
                    else:  # a seed that lies in the heap already, no lower than v
                        out[m, n] = max(out[m, n], v)
        mine = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
        i, j = i[mine], j[mine]
        return pdf.loc[mine, ["r", "c"]].assign(z=out[i, j], label=label[i, j])

    def spills(pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j = laid(pdf, tile)
        label = np.zeros(z.shape, dtype=np.int64)
        label[i, j] = pdf["label"]
        parts = []
        for o in RING:
            a, b, w = label[1:-1, 1:-1], around(label, *o), np.maximum(z[1:-1, 1:-1], around(z, *o))
            way = (a != b) & ~np.isnan(w)
            parts.append(pd.DataFrame({"a": a[way], "b": b[way], "w": w[way]}))
        return pd.concat(parts).groupby(["a", "b"], as_index=False).min()

    tiles = tiled(dem.select("r", "c", F.col("z").cast("double").alias("z")), tile).groupBy("_tr", "_tc")
    filled = cut(tiles.applyInPandas(lambda pdf: flood(pdf), "r long, c long, z double, label long"))
    ways = tiled(filled, tile).groupBy("_tr", "_tc").applyInPandas(lambda pdf: spills(pdf), "a long, b long, w double")
    level = _spill_levels(ways.groupBy("a", "b").agg(F.min("w").alias("w")))
    return filled.join(level, "label", "left").select("r", "c", F.when(~F.isnan("z"), F.greatest("z", "level")).alias("z"))


def _spill_levels(ways: DataFrame) -> DataFrame:
    """Lowest level at which each label's water reaches OUT, over ways (a, b, w) that go both ways.

    In a round each label joins the one beyond its lowest way, so the labels halve at least. Ways fall along such a chain: the first is its highest.
    """
    ways = cut(ways)
    level = cut(ways.where(F.col("a") != OUT).select(F.col("a").alias("label"), F.col("a").alias("at"), F.lit(None).cast("double").alias("level")).distinct())
    while True:
        # Equal heights are told apart by the pair, so that chains end in two labels that choose each other, or in OUT.
        pick = ways.where(F.col("a") != OUT).groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("m"))
        pick = cut(pick.select("a", F.when(F.col("m.x") == F.col("a"), F.col("m.y")).otherwise(F.col("m.x")).alias("to"), F.col("m.w").alias("w")))
        if not pick.limit(1).count():
            return level.select("label", "level")
        back = pick.select(F.col("a").alias("to"), F.col("to").alias("_back"))
        ends = pick.join(back, "to", "left").select("a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to"), "w")
        ends = _followed(ends)
        level = cut(
            level.join(ends.withColumnRenamed("a", "at"), "at", "left").select(
                "label", F.coalesce("to", "at").alias("at"), F.when(F.col("to") != F.col("at"), F.greatest("level", "w")).otherwise(F.col("level")).alias("level")
            )
        )
        for side in ("a", "b"):
            ways = ways.join(ends.select(F.col("a").alias(side), F.col("to").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        ways = cut(ways.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")))


def _followed(ends: DataFrame) -> DataFrame:
    """Pointers a -> to, doubled until none moves; those that end point at themselves or at what is no ``a``."""
    while True:
        jump = ends.select(F.col("a").alias("to"), F.col("to").alias("_far"))
        nxt = cut(ends.join(jump, "to", "left").select("a", F.coalesce("_far", "to").alias("to"), *[c for c in ends.columns if c not in ("a", "to")], (F.col("_far") != F.col("to")).alias("_moved")))
        ends = nxt.drop("_moved")
        if not nxt.where("_moved").limit(1).count():
            return ends


def resolve_flats(dem: DataFrame, drains: DataFrame, tile: int = 512) -> DataFrame:
    """``drains`` (r, c, nr, nc) with a way out for the cells of flats: towards the nearest cell of the flat that has one, first of the ring on a tie.

    A flat's ways start at its cells that drain, or at the rim of the grid, where water leaves. Tiles settle what they can reach; what crosses their
    borders goes on in the next round, until nothing changes. Pits of a DEM that is not filled have no way out and keep nulls.
    """
    cells = dem.select("r", "c", F.when(~F.isnan("z"), F.col("z")).cast("double").alias("z")).join(drains, ["r", "c"], "left")

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j = laid(pdf, tile)
        rim = np.zeros(z.shape, dtype=bool)
        rim[1:-1, 1:-1] = np.any([np.isnan(around(z, *o)) for o in RING], axis=0)
        mine = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
        return pdf.loc[mine, ["r", "c", "z", "nr", "nc"]].assign(known=(pdf.loc[mine, "nr"].notna() | (rim[i[mine], j[mine]] & pdf.loc[mine, "z"].notna())), new=False)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        z, i, j = laid(pdf, tile)
        known = np.zeros(z.shape, dtype=bool)
        known[i, j] = pdf["known"]
        to = np.full((*z.shape, 2), -1, dtype=np.int64)
        grown = np.zeros(z.shape, dtype=bool)
        inside = np.zeros(z.shape, dtype=bool)
        inside[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
        front = known & ~np.isnan(z)
        while front.any():
            fresh = np.zeros(z.shape, dtype=bool)
            for k in range(len(RING)):
                di, dj = RING[k]
                beside = np.zeros(z.shape, dtype=bool)
                beside[1:-1, 1:-1] = around(front, di, dj) & (around(z, di, dj) == z[1:-1, 1:-1])
                take = beside & inside & ~known & ~fresh
                to[take] = (di, dj)
                fresh |= take
            known |= fresh
            grown |= fresh
            front = fresh
        mine = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
        own = pdf.loc[mine].copy()
        i, j = i[mine], j[mine]
        new = grown[i, j]
        own["nr"] = own["nr"].astype(float).where(~new, own["r"] + to[i, j, 0])
        own["nc"] = own["nc"].astype(float).where(~new, own["c"] + to[i, j, 1])
        return own[["r", "c", "z", "nr", "nc"]].assign(known=known[i, j], new=new)

    shape = "r long, c long, z double, nr double, nc double, known boolean, new boolean"
    state = cut(tiled(cells, tile).groupBy("_tr", "_tc").applyInPandas(lambda pdf: start(pdf), shape))
    while True:
        before = state
        state = cut(tiled(state.drop("new"), tile).groupBy("_tr", "_tc").applyInPandas(lambda pdf: grow(pdf), shape))
        drop(before)
        if not state.where("new").limit(1).count():
            return state.select("r", "c", F.col("nr").cast("long").alias("nr"), F.col("nc").cast("long").alias("nc"))


def outlets(drains: DataFrame, streams: DataFrame) -> DataFrame:
    """The stream cell, pit or rim cell (er, ec) that each cell's water reaches: pointers are doubled until none moves, in as many rounds as the logarithm of the longest way. Drains that run in a circle are refused."""
    s = streams.select("r", "c").distinct().withColumn("_s", F.lit(True))
    fixed = F.col("_s").isNotNull() | F.col("nr").isNull()
    ptr = cut(drains.join(s, ["r", "c"], "left").select("r", "c", F.when(fixed, F.col("r")).otherwise(F.col("nr")).alias("er"), F.when(fixed, F.col("c")).otherwise(F.col("nc")).alias("ec")))
    for _ in range(ptr.count().bit_length() + 1):
        step = ptr.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("er").alias("_er"), F.col("ec").alias("_ec"))
        j = ptr.join(step, (F.col("er") == F.col("_r")) & (F.col("ec") == F.col("_c")), "left")
        before = ptr
        nxt = cut(j.select("r", "c", F.coalesce("_er", "er").alias("er"), F.coalesce("_ec", "ec").alias("ec"), ((F.col("_er") != F.col("er")) | (F.col("_ec") != F.col("ec"))).alias("moved")))
        drop(before)
        moved = nxt.where("moved").limit(1).count()
        ptr = nxt.drop("moved")
        ptr._silvara_path = nxt._silvara_path
        if not moved:
            return ptr
    raise ValueError("the drains run in a circle")


def height_above_drainage(dem: DataFrame, drains: DataFrame, streams: DataFrame) -> DataFrame:
    """Height of each cell above the stream cell that its water reaches, at least 0; null if it reaches none."""
    end = outlets(drains, streams)
    low = dem.join(streams.select("r", "c").distinct(), ["r", "c"], "left_semi").select(F.col("r").alias("er"), F.col("c").alias("ec"), F.col("z").alias("_z"))
    j = end.join(low, ["er", "ec"], "left").join(dem, ["r", "c"])
    return j.select("r", "c", F.bround(F.greatest(F.col("z") - F.col("_z"), F.lit(0.0)), 6).alias("hand"))


def accumulation(drains: DataFrame) -> DataFrame:
    """H1: cells that drain through each cell, itself included. Sums travel along doubled pointers, so the rounds are as few as the logarithm of the longest way. Drains that run in a circle are refused."""
    state = cut(drains.select("r", "c", F.lit(1).cast("long").alias("a"), F.col("nr").alias("pr"), F.col("nc").alias("pc")))
    for _ in range(state.count().bit_length() + 1):
        if not state.where("pr is not null").limit(1).count():
            return state.select("r", "c", F.col("a").alias("acumulacion"))
        sent = state.where("pr is not null").groupBy(F.col("pr").alias("r"), F.col("pc").alias("c")).agg(F.sum("a").alias("_s"))
        jump = state.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("pr").alias("_pr"), F.col("pc").alias("_pc"))
        before = state
        state = cut(state.join(sent, ["r", "c"], "left").join(jump, ["pr", "pc"], "left").select("r", "c", (F.col("a") + F.coalesce("_s", F.lit(0))).alias("a"), F.col("_pr").alias("pr"), F.col("_pc").alias("pc")))
        drop(before)
    raise ValueError("the drains run in a circle")


def _jumps(ptr: DataFrame, most: int) -> list[DataFrame]:
    """Pointers (sid, to) over 1, 2, 4, ... steps, until all have ended or ``most`` doublings are made."""
    jumps = [ptr]
    while len(jumps) <= most and jumps[-1].where("to is not null").limit(1).count():
        far = jumps[-1].select(F.col("sid").alias("to"), F.col("to").alias("_far"))
        jumps.append(cut(jumps[-1].join(far, "to", "left").select("sid", F.col("_far").alias("to"))))
    return jumps


def stream_orders(segments: DataFrame) -> DataFrame:
    """H6, H7: Strahler and Shreve order of each segment (sid flows into down_sid). Rounds are few: pointers double, however long the ways are.

    Shreve sums the leaves along the doubled pointers. A segment is of Strahler order k + 1 or more if two of order k or more flow into it, or if it lies below such a one.
    Segments on a cycle keep null orders. A segment flows into one other at most.
    """
    links = cut(segments.select("sid", "down_sid"))
    n = links.count()
    if links.select("sid").distinct().count() != n:
        raise ValueError("a segment is listed more than once")
    ids = links.select(F.col("sid").alias("down_sid"), F.lit(True).alias("_there"))
    ptr = cut(links.join(ids, "down_sid", "left").select("sid", F.when(F.col("_there"), F.col("down_sid")).alias("to")))
    jumps = _jumps(ptr, n.bit_length())
    # After more steps than there are segments, what is still reached lies on cycles, and all of a cycle is.
    ring = cut(jumps[-1].where("to is not null").select(F.col("to").alias("sid")).distinct())
    if ring.limit(1).count():
        on = ring.select(F.col("sid").alias("to"), F.lit(True).alias("_on"))
        ptr = cut(ptr.join(ring, "sid", "left_anti").join(on, "to", "left").select("sid", F.when(F.col("_on").isNull(), F.col("to")).alias("to")))
        jumps = _jumps(ptr, n.bit_length())
    moves = [j.where("to is not null") for j in jumps[:-1]]
    inflow = ptr.where("to is not null").select(F.col("to").alias("sid")).distinct().withColumn("_fed", F.lit(True))
    state = cut(ptr.join(inflow, "sid", "left").select("sid", F.when(F.col("_fed"), 0).otherwise(1).cast("long").alias("shreve")))
    for move in moves:
        sent = state.join(move, "sid").groupBy(F.col("to").alias("sid")).agg(F.sum("shreve").alias("_s"))
        state = cut(state.join(sent, "sid", "left").select("sid", (F.col("shreve") + F.coalesce("_s", F.lit(0))).alias("shreve")))
    level = ptr.select("sid")
    levels = level.withColumn("k", F.lit(1).cast("long"))
    k = 1
    while moves:
        k += 1
        level = level.join(moves[0], "sid").groupBy(F.col("to").alias("sid")).agg(F.count("*").alias("k")).where("k > 1").select("sid")
        for move in moves:
            level = level.join(move, "sid", "left").select(F.explode(F.array("sid", "to")).alias("sid")).where("sid is not null").distinct()
        level = cut(level)
        if not level.limit(1).count():
            break
        levels = levels.unionByName(level.withColumn("k", F.lit(k).cast("long")))
    strahler = levels.groupBy("sid").agg(F.max("k").alias("strahler"))
    return links.select("sid").join(strahler, "sid", "left").join(state, "sid", "left")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node number of each node's connected component: labels spread along edges and jump to their label's label."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    while True:  # labels only fall, so it ends
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("_l")), "v").groupBy("u").agg(F.min("_l").alias("_n"))
        low = label.join(near, "u", "left").select("u", F.col("l").alias("old"), F.least("l", F.coalesce("_n", "l")).alias("l"))
        jump = label.select(F.col("u").alias("l"), F.col("l").alias("_j"))
        nxt = cut(low.join(jump, "l", "left").select("u", "old", F.least("l", F.coalesce("_j", "l")).alias("l")))
        label = nxt.drop("old")
        if not nxt.where("old <> l").limit(1).count():
            break
    return label.select(F.col("u").alias("nodo"), F.col("l").alias("componente"))


def node_key(v: Column, tolerance: float) -> Column:
    """Place of an end point on the snapping grid, halves to even."""
    return F.bround(v / tolerance).cast("long")


def diagnostics(segments: DataFrame) -> DataFrame:
    """Segments, end nodes, confluences (two or more flow in), outlets and sources of a network."""
    down = segments.groupBy("down_sid").agg(F.count("*").alias("k"))
    ids = segments.select("sid")
    return segments.agg(F.count("*").alias("tramos")).join(down.agg(F.count_if(F.col("k") >= 2).alias("confluencias"))).join(
        segments.join(ids.withColumnRenamed("sid", "down_sid"), "down_sid", "left_anti").agg(F.count("*").alias("salidas"))
    ).join(ids.join(segments.select(F.col("down_sid").alias("sid")), "sid", "left_anti").agg(F.count("*").alias("cabeceras")))
