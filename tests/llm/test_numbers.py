"""Top N, percentiles and the boosted trees."""

import random

import numpy as np
from pyspark.sql import functions as F

from silvara.llm import quantiles, topn
from silvara.llm.boosting import Boosted


def test_top_n_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 3.5, None, float("nan")]), i, "x") for i in range(3000)]
    rows += [(9, "z", 1.0, 5000 + i, "x") for i in range(2)]
    df = spark.createDataFrame(rows, "g long, h string, v double, k long, _bound string").repartition(7)
    got = {(r.g, r.h, r.puesto, r.k) for r in topn.top_n(df, ["g", "h"], "v", "k", 3).collect()}
    want = set()
    groups = {}
    for g, h, v, k, _ in rows:
        if v is not None and v == v:
            groups.setdefault((g, h), []).append((-v, k))
    for (g, h), vs in groups.items():
        want |= {(g, h, n, k) for n, (_, k) in enumerate(sorted(vs)[:3], 1)}
    assert got == want
    assert topn.top_n(df.limit(0), ["g", "h"], "v", "k", 3).count() == 0


def test_spread_groups_are_exact(spark):
    rng = random.Random(2)
    rows = []
    for g in range(60):
        for _ in range(rng.choice([39, 40, 41, 200, 3000])):
            rows.append((g, round(rng.lognormvariate(0, 1.08), 1) + 0.1))
    rows += [(100, None)] * 50 + [(101, float("nan"))] * 50 + [(102, 1.0)] * 80
    rows += [(None, v) for v in [1.0] * 36 + [4.0] * 9]  # 45 values, the 41st of which is exactly four times the 23rd
    df = spark.createDataFrame(rows, "g long, v double")
    want = {None}
    for g in range(60):
        v = sorted(x for k, x in rows if k == g)
        if len(v) >= 40 and v[-(-9 * len(v) // 10) - 1] >= 4.0 * v[-(-len(v) // 2) - 1]:
            want.add(g)
    assert 5 < len(want) < 55
    assert {r.g for r in quantiles.spread_groups(df, ["g"], "v", F.lit(4.0)).collect()} == want
    assert quantiles.spread_groups(df.limit(0), ["g"], "v", F.lit(4.0)).count() == 0


def test_sketches_merge(spark):
    df = spark.range(100_000).select((F.col("id") % 4).alias("day"), F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    days = quantiles.sketches(df, ["g", "day"], "v")
    merged = quantiles.merge_sketches(days, ["g"]).select("n", quantiles.at_rank(F.col("sketch"), 0.9).alias("p")).collect()[0]
    assert merged.n == 100_000 and abs(merged.p - 90_000) < 100_000 * quantiles.RANK_ERROR


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = np.where(x[:, 0] > 0, 2.0, 1.0) + (x[:, 1] > 1)
    x[::50, 2] = np.nan
    m = Boosted(trees=60, depth=3).fit(x[:600], y[:600])
    assert np.abs(m.predict(x[600:]) - y[600:]).mean() < 0.1
    assert Boosted(trees=3).fit(np.zeros((4, 2)), np.ones(4)).predict(np.zeros((1, 2)))[0] == 1.0


def test_selection_in_slices(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SLICE", 50)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.random() * 100, 7.0])) for g in (1, None) for _ in range(4000)] + [(3, 2.5)] * 500
    df = spark.createDataFrame(rows, "g long, v double")
    ranks = {1: 1333, None: 4000, 3: 250}
    wanted = spark.createDataFrame([(g, w, r, 0.0, 100.0, 4000) for g, r in ranks.items() for w in ("low",)], "g long, which string, rank long, lo double, hi double, inside long")
    got = {r.g: r._x for r in quantiles._selected(df, wanted, ["g"], "v").collect()}
    assert got == {g: sorted(v for k, v in rows if k == g)[r - 1] for g, r in ranks.items()}
