"""Queries of the text and algorithm problems over the tables of a data folder, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.llm import gazetteer, leakage, lexicon, lookalike, quantiles, reading, topn
from silvara.runtime import small
from silvara.sources import table

USABLE_VOLUME = "not isnan(volumen_m3) and volumen_m3 > 0 and volumen_m3 <= 200"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Trees whose species looks like an entry of the list yet is made of other characters."""
    return lookalike.disguised_names(table(spark, d, "tree"), "fid", "especie", table(spark, d, "dmc"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every species text in its one form."""
    return lookalike.canonicalize(table(spark, d, "tree").select("fid", "especie"), "especie", table(spark, d, "dmc"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Trees whose species is an entry of the list, character for character."""
    return table(spark, d, "tree").join(small(table(spark, d, "dmc").select("especie")), "especie", "left_semi")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The 3 largest usable volumes of each census and species."""
    rows = _listed(spark, d).where(USABLE_VOLUME)
    return topn.top_n(rows, ["censo_id", "especie"], "volumen_m3", "fid", 3)


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """censo_id, especie, campo, valor: usable volumes, and diameters above 0 as stored."""
    values = F.array(
        F.struct(F.lit("volumen_m3").alias("campo"), F.expr(f"case when {USABLE_VOLUME} then volumen_m3 end").alias("valor")),
        F.struct(F.lit("dap_m").alias("campo"), F.expr("case when not isnan(dap_m) and dap_m > 0 then dap_m end").alias("valor")),
    )
    return _listed(spark, d).select("censo_id", "especie", F.explode(values).alias("_x")).select("censo_id", "especie", "_x.campo", "_x.valor").where(F.col("valor").isNotNull())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a wide upper half."""
    threshold = F.when(F.col("campo") == "volumen_m3", 4.0).otherwise(2.0)
    return quantiles.spread_groups(_measurements(spark, d), ["censo_id", "especie", "campo"], "valor", threshold)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of every group by sketch."""
    return quantiles.percentiles(_measurements(spark, d), ["censo_id", "especie", "campo"], "valor", (0.5, 0.9, 0.99))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reported species text with the entry it stands for, -1 if none."""
    entries = table(spark, d, "validation_report").select("lote_id", F.explode("especies_sin_dmc").alias("entrada"))
    mapped = gazetteer.map_names(entries, "entrada", table(spark, d, "dmc"), table(spark, d, "tree").select("especie"))
    return mapped.select("lote_id", "entrada", "especie_id")


def p7_trees(spark: SparkSession, d: str) -> DataFrame:
    """Every tree with the entry its species text stands for, -1 if none."""
    trees = table(spark, d, "tree").select("fid", "especie")
    return gazetteer.map_names(trees, "especie", table(spark, d, "dmc"), trees).select("fid", "especie_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return lexicon.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that speak 20 or more consecutive words of test items."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("tipo = 'literal'").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every unlabelled document that speaks enough."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "doc_labels"))


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_percentiles": p6_percentiles,
    "p7_found": p7_found,
    "p7_trees": p7_trees,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

SQL = {
    "p5_found": f"""
        select censo_id, especie, cast(puesto as int) as puesto, fid from (
            select censo_id, especie, fid, row_number() over (partition by censo_id, especie order by volumen_m3 desc, fid) as puesto
            from tree where especie in (select especie from dmc) and {USABLE_VOLUME}) where puesto <= 3
    """,
    "p6_found": f"""
        with v as (
            select censo_id, especie, 'volumen_m3' as campo, volumen_m3 as x from tree where especie in (select especie from dmc) and {USABLE_VOLUME}
            union all
            select censo_id, especie, 'dap_m', dap_m from tree where especie in (select especie from dmc) and not isnan(dap_m) and dap_m > 0),
        r as (select *, row_number() over (partition by censo_id, especie, campo order by x) as r, count(*) over (partition by censo_id, especie, campo) as n from v)
        select censo_id, especie, campo from r where n >= 40 group by censo_id, especie, campo, n
        having max(case when r = (9 * n + 9) // 10 then x end) >= case campo when 'volumen_m3' then 4.0 else 2.0 end * max(case when r = (n + 1) // 2 then x end)
    """,
}
