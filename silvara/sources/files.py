"""Readers of loose text inputs and of files' identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvara.functions.text import as_float, normalize_species, strip
from silvara.runtime import cut, small


def reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """Especie, dmc_cm of a text table with ``;``, ``,`` or tab between fields, the one most frequent in its first line. Rows without a number, such as a header, are left out."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0].value if first else ""
    mark = max(";\t,", key=head.count)
    rows = spark.read.csv(path, sep=mark, header=False, schema="a string, b string", encoding="UTF-8")
    clean = rows.select(F.regexp_replace(strip("a"), "^﻿", "").alias("especie"), as_float("b").alias("dmc_cm"))
    return clean.where("especie <> '' and dmc_cm is not null")


def merge_reference(found: DataFrame, existing: DataFrame, order: str | None = None) -> DataFrame:
    """Species of a table, first spelling (by ``order``, else the first in order of letters) of each comparable name, with the values that the existing list has."""
    first = F.min_by(strip("especie"), order) if order else F.min(strip("especie"))
    first = found.where(normalize_species("especie") != "").groupBy(normalize_species("especie").alias("k")).agg(first.alias("especie"))
    return first.join(existing.select(normalize_species("especie").alias("k"), "dmc_cm").dropDuplicates(["k"]), "k", "left").select("especie", "dmc_cm")


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """S3: cells (r, c, v) of ESRI ASCII grids, one line a row of cells, without no-data cells; ``grid`` holds corner, cell size and columns.

    Files are read line by line in blocks: a line's row is its place within its block and the lines in the blocks before, so no grid is held whole.
    """
    text = spark.read.text(path).select(F.trim("value").alias("_l"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    named = F.col("_l").rlike("^[A-Za-z_]+\\s")
    key, held = F.lower(F.regexp_extract("_l", r"^(\S+)", 1)), F.regexp_extract("_l", r"^\S+\s+(\S+)", 1).try_cast("double")
    head = text.where(named).groupBy(F.col("_f").alias("_hf")).agg(*[F.max(F.when(key == k, held)).alias(f"_{k}") for k in ("ncols", "xllcorner", "yllcorner", "cellsize", "nodata_value")])
    lines = cut(text.where(~named & (F.col("_l") != "")))
    counts = lines.groupBy(F.col("_f").alias("_cf"), F.col("_b").alias("_cb")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("_cf").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = lines.withColumn("_p", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1)
    j = placed.join(small(head), F.col("_f") == F.col("_hf")).join(small(before), (F.col("_f") == F.col("_cf")) & (F.col("_b") == F.col("_cb")))  # a header a file
    grid = F.struct(F.col("_xllcorner").alias("x0"), F.col("_yllcorner").alias("y0"), F.col("_cellsize").alias("cell"), F.col("_ncols").cast("long").alias("ncols"))
    cells = j.select(grid.alias("grid"), (F.col("_base") + F.col("_p")).alias("r"), "_nodata_value", F.posexplode(F.split("_l", r"\s+")).alias("c", "_t"))
    out = cells.select("grid", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("_t").try_cast("double").alias("v"), "_nodata_value")
    return out.where("v is not null and (_nodata_value is null or v <> _nodata_value)").drop("_nodata_value")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and SHA-256 of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha"), F.sha2("content", 256).alias("sha256"))
