"""The census checks as a running aggregation over arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.operators.census import real, thousandths


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_at_once: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_checks(rows: DataFrame, late: str = "180 days", window: str = "7 days") -> DataFrame:
    """Counts of each week of registration, with rows accepted up to ``late`` behind the newest; state of older weeks is dropped."""
    dap, height = real("dap_m"), real("altura_m")
    keyed = rows.where("registrado_ts is not null").withWatermark("registrado_ts", late)
    g = keyed.groupBy(F.window("registrado_ts", window).alias("w")).agg(F.count("*").alias("total"), F.count_if(dap.isNull()).alias("dap_invalido"), F.count_if(height.isNull()).alias("altura_invalida"), F.sum(thousandths(real("volumen_m3"))).alias("volumen_milesimas"))
    return g.select(F.col("w.start").alias("desde"), "total", "dap_invalido", "altura_invalida", "volumen_milesimas")
