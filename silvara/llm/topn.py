"""Problem 5: the N highest-scoring rows of every group, by bounds from partitions.

Each partition sorts its rows by group and score and keeps its own best N of each group. The N-th of them is a bound that the group's N-th best
overall reaches or exceeds; the highest bound of each group is joined back, rows below it are dropped, and only the survivors are ranked.
A group of any size thus sends at most N rows from each partition, and those below the bound send none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvara.runtime import cut, ship, small


def _ranks(keys: pd.DataFrame, last: tuple | None, held: int) -> np.ndarray:
    """Place of each row within its group, from 0, for rows that come group by group; ``last`` and ``held`` are the group before and its rows so far."""
    new = np.zeros(len(keys), dtype=bool)
    for c in keys.columns:
        v, before = keys[c], keys[c].shift()
        new |= ((v != before) & ~(v.isna() & before.isna())).to_numpy()
    new[0] = last is None or any(not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in zip(last, keys.iloc[0]))
    at = np.arange(len(keys))
    begin = np.maximum.accumulate(np.where(new, at, -1))
    return np.where(begin >= 0, at - begin, at + held)


def top_n(df: DataFrame, groups: list[str], score: str, tie: str, n: int, rank: str = "puesto") -> DataFrame:
    """``groups``, ``rank`` (1 to n) and ``tie`` of the n rows with the largest ``score`` of each group; smaller ``tie`` first among equal scores.

    ``tie`` is a unique whole number, so the order is one. Rows whose score is null or NaN have no rank; null groups are groups. Groups of fewer
    rows give all of them, an empty table none. Other columns are dropped.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*groups, F.col(score).cast("double").alias("_score"), F.col(tie).cast("long").alias("_tie"))
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first ``n`` rows of each group of a sorted partition, and whether a row is the n-th. Only one group's place is kept between batches."""
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(groups).to_pandas(integer_object_nulls=True)
            place = _ranks(keys, last, held)
            last, held = tuple(keys.iloc[-1]), int(place[-1]) + 1
            kept = pa.array(np.flatnonzero(place < n))
            yield pa.RecordBatch.from_arrays([*batch.take(kept).columns, pa.array(place[place < n] == n - 1)], names=[*batch.schema.names, "_nth"])

    order = rows.sortWithinPartitions(*groups, F.desc("_score"), "_tie")
    best = cut(ship(order).mapInArrow(local, f"{kinds}, _score double, _tie bigint, _nth boolean"))
    bounds = best.where("_nth").groupBy(*groups).agg(F.max("_score").alias("_least")).withColumnsRenamed({g: f"_b_{g}" for g in groups})
    match = reduce(lambda a, b: a & b, [best[g].eqNullSafe(bounds[f"_b_{g}"]) for g in groups])
    survivors = best.join(small(bounds), match, "left").where(F.col("_least").isNull() | (F.col("_score") >= F.col("_least")))
    ranked = survivors.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_score"), "_tie")))
    return ranked.where(F.col(rank) <= n).select(*groups, F.col(rank).cast("int").alias(rank), F.col("_tie").alias(tie))
