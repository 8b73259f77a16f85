"""Problem 6: percentiles per group by mergeable sketches, with brackets that a count proves.

The sketches are hierarchies of randomised compactors that sort and keep alternate values, as Spark aggregates them in the JVM;
those of partitions, days or files merge level by level. A sketch answers a rank within RANK_ERROR of the rows at its size with a
probability of 99 %, so two answers bracket a percentile. Where a decision is wanted and not an estimate, the brackets are counted, and
groups that they leave open are decided by selection within them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvara.runtime import cut, drop, small

#: Size of a sketch's compactors, and the rank error allowed for it: twice the error of a single rank at this size, at 99 %.
COMPACTOR, RANK_ERROR = 400, 0.018
#: Values of a bracket up to which they are ordered at once, and the parts that a larger bracket is cut into.
SLICE, BINS = 20_000, 256


def sketches(df: DataFrame, groups: list[str], value: str, k: int = COMPACTOR) -> DataFrame:
    """``groups``, ``n`` and ``sketch`` (binary) of the values of each group; null and NaN values are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*groups).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value), F.lit(k)).alias("sketch"))


def merge_sketches(df: DataFrame, groups: list[str], k: int = COMPACTOR) -> DataFrame:
    """Sketches of coarser groups, or of several days, from finer ones."""
    return df.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(F.col("sketch"), F.lit(k)).alias("sketch"))


def at_rank(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(q, 0.0), 1.0)))


def percentiles(df: DataFrame, groups: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """``groups``, ``n`` and p<q> for each q in percent, approximate within RANK_ERROR of rank."""
    return sketches(df, groups, value).select(*groups, "n", *[at_rank(F.col("sketch"), q).alias(f"p{round(q * 100)}") for q in qs])


def _joined(left: DataFrame, right: DataFrame, groups: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Join on the groups, where null equals null; the groups come from the left."""
    other = right.withColumnsRenamed({g: f"_r_{g}" for g in groups})
    match = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in groups] + ([] if also is None else [also]))
    return left.join(other, match, how).drop(*[f"_r_{g}" for g in groups])


def _rank(q: float) -> Column:
    """Place of a percentile among n values, from 1."""
    return F.ceil(F.col("n") * F.lit(q).cast("decimal(6,4)"))


def _selected(rows: DataFrame, wanted: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The value at a rank of each group: ``groups``, which, _x. ``wanted`` has groups, which, rank (from 1 within the bracket), lo, hi and inside (values in the bracket).

    Brackets of more than SLICE values are cut into BINS equal parts, whose values are counted in each partition before they are shuffled; the part
    that holds the rank is the next bracket. So no task orders more than SLICE different values of a group, however large it is.
    """
    wanted = cut(wanted)
    v = F.col(value)
    while True:
        # A bracket of one value, or narrower than numbers can part, needs no more cutting: its values collapse into one count.
        wide = wanted.where((F.col("inside") > SLICE) & ((F.col("hi") - F.col("lo")) / BINS > F.abs("hi") * 1e-14))
        if not wide.limit(1).count():
            break
        j = _joined(rows, small(wide), groups).where(v.between(F.col("lo"), F.col("hi")))
        step = (F.col("hi") - F.col("lo")) / BINS
        part = F.least(F.floor((v - F.col("lo")) / step), F.lit(BINS - 1))
        counted = j.groupBy(*groups, "which", "rank", part.alias("_p")).agg(F.count("*").alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        run = counted.withColumn("_to", F.sum("_c").over(Window.partitionBy(*groups, "which").orderBy("_p")))
        near = run.where((F.col("_to") >= F.col("rank")) & (F.col("_to") - F.col("_c") < F.col("rank")))
        narrowed = near.select(*groups, "which", (F.col("rank") - (F.col("_to") - F.col("_c"))).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_c").alias("inside"))
        old, wanted = wanted, cut(_joined(wanted, wide.select(*groups, "which").withColumnRenamed("which", "_w"), groups, "left", (F.col("which") == F.col("_w"))).where("_w is null").drop("_w").unionByName(narrowed))
        drop(old)
    j = _joined(rows, small(wanted), groups).where(v.between(F.col("lo"), F.col("hi")))
    counted = j.groupBy(*groups, "which", "rank", v.alias("_v")).agg(F.count("*").alias("_c"))
    run = counted.withColumn("_to", F.sum("_c").over(Window.partitionBy(*groups, "which").orderBy("_v")))
    return run.where((F.col("_to") >= F.col("rank")) & (F.col("_to") - F.col("_c") < F.col("rank"))).select(*groups, "which", F.col("_v").alias("_x"))


def spread_groups(df: DataFrame, groups: list[str], value: str, threshold: Column, least: int = 40, low: float = 0.5, high: float = 0.9) -> DataFrame:
    """Groups of at least ``least`` values whose ``high`` percentile is at least ``threshold`` (of the group's columns) times the ``low`` one.

    Percentile q of n values is the ceil(q*n)-th smallest. Values must be above 0; null and NaN are left out; null groups are groups. The sketch brackets both percentiles;
    a count of the values below and within the brackets proves them. Groups that proven brackets cannot decide, and those whose bracket the count
    refutes, are decided by selection, so the result holds no chance.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, value)
    n, s, v = F.col("n"), F.col("sketch"), F.col(value)
    slack = RANK_ERROR + 1 / least  # one row more or less of the smallest group
    brackets = cut(
        sketches(rows, groups, value).where(n >= least).select(
            *groups, "n", threshold.alias("_t"), at_rank(s, 0.0).alias("_min"), at_rank(s, 1.0).alias("_max"),
            at_rank(s, low - slack).alias("_a0"), at_rank(s, low + slack).alias("_a1"), at_rank(s, high - slack).alias("_b0"), at_rank(s, high + slack).alias("_b1"),
        )
    )
    below = [F.count_if(v < F.col("_a0")).alias("_la"), F.count_if(v <= F.col("_a1")).alias("_ha"), F.count_if(v < F.col("_b0")).alias("_lb"), F.count_if(v <= F.col("_b1")).alias("_hb")]
    kept = ["n", "_t", "_min", "_max", "_a0", "_a1", "_b0", "_b1"]
    counted = _joined(rows, small(brackets), groups).groupBy(*groups, *kept).agg(*below)
    ra, rb = _rank(low), _rank(high)
    a_holds, b_holds = (F.col("_la") < ra) & (ra <= F.col("_ha")), (F.col("_lb") < rb) & (rb <= F.col("_hb"))
    sure = a_holds & b_holds & (F.col("_b0") >= F.col("_t") * F.col("_a1"))
    never = a_holds & b_holds & (F.col("_b1") < F.col("_t") * F.col("_a0"))
    side = lambda which, holds, rank, lo, hi, under, upto: F.struct(
        F.lit(which).alias("which"), F.when(holds, rank - F.col(under)).otherwise(rank).alias("rank"), F.when(holds, F.col(lo)).otherwise(F.col("_min")).alias("lo"),
        F.when(holds, F.col(hi)).otherwise(F.col("_max")).alias("hi"), F.when(holds, F.col(upto) - F.col(under)).otherwise(F.col("n")).alias("inside"),
    )
    judged = cut(counted.select(*groups, "n", "_t", sure.alias("_sure"), never.alias("_never"), F.array(side("low", a_holds, ra, "_a0", "_a1", "_la", "_ha"), side("high", b_holds, rb, "_b0", "_b1", "_lb", "_hb")).alias("_w")))
    doubt = judged.where(~F.col("_sure") & ~F.col("_never"))
    exact = _selected(rows, doubt.select(*groups, F.explode("_w").alias("_x")).select(*groups, "_x.*"), groups, value)
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("_x")))
    both = exact.groupBy(*groups).agg(at("low").alias("_low"), at("high").alias("_high"))
    found = _joined(both, doubt.select(*groups, "_t"), groups).where(F.col("_high") >= F.col("_t") * F.col("_low")).select(*groups)
    return judged.where("_sure").select(*groups).unionByName(found)
