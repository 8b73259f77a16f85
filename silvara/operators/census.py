"""Cleaning, checks and tables of a tree census. Sums run over thousandths as whole numbers, so that results do not depend on the order of addition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvara.functions.text import as_float, as_text, normalize_field, normalize_species, strip
from silvara.runtime import small

#: Plausible diameters and heights in metres; 0 is not flagged.
DAP_RANGE, HEIGHT_RANGE = (0.05, 3.5), (1.0, 45.0)


def real(c: str) -> Column:
    """A measurement, null where it is missing, NaN or not above 0."""
    return F.when(~F.isnan(c) & (F.col(c) > 0), F.col(c))


def thousandths(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5)


def normalized(tree: DataFrame) -> DataFrame:
    """Comparable texts of each tree; a missing code falls back on the row's number."""
    return tree.select(
        "fid",
        F.coalesce(F.when(as_text("codigo") != "", as_text("codigo")), F.col("fid").cast("string")).alias("codigo"),
        normalize_species("especie").alias("especie_norm"),
        F.upper(as_text("categoria")).alias("categoria"),
        F.coalesce(normalize_field("parcela"), F.lit("")).alias("parcela"),
    )


def numbers(dirty: DataFrame) -> DataFrame:
    """Numbers of a census' text columns."""
    return dirty.select("fid", as_float("dap_txt").alias("dap"), as_float("hc_txt").alias("hc"))


def row_checks(tree: DataFrame) -> DataFrame:
    """First reason why a row is refused ('' if none), and range flags of the measurements that are there."""
    dap, height = real("dap_m"), real("altura_m")
    reason = F.when(dap.isNull(), "dap").when(height.isNull(), "altura").otherwise("")
    return tree.select(
        "fid",
        reason.alias("rechazo"),
        F.coalesce(~dap.between(*DAP_RANGE), F.lit(False)).alias("dap_fuera"),
        F.coalesce(~height.between(*HEIGHT_RANGE), F.lit(False)).alias("altura_fuera"),
    )


def basal(dap_m: Column) -> Column:
    return F.lit(math.pi / 4) * dap_m * dap_m


def volumes(tree: DataFrame, config: DataFrame) -> DataFrame:
    """Volume by diameter, height and the census' form factor, and the factor that the stored volume implies, to 4 decimals."""
    t = tree.select("fid", "censo_id", real("dap_m").alias("d"), real("altura_m").alias("h"), real("volumen_m3").alias("v"))
    j = t.join(config.select("censo_id", "form_factor"), "censo_id", "left").where("d is not null and h is not null")
    solid = basal(F.col("d")) * F.col("h")
    return j.select("fid", F.bround(solid * F.col("form_factor"), 4).alias("volumen_calc"), F.bround(F.col("v") / solid, 4).alias("factor"))


def form_factor_mode(tree: DataFrame, config: DataFrame) -> DataFrame:
    """A4: of each census the most frequent implied factor (to 2 decimals; the smaller on a tie), its count, and whether it has at least max(3, half) of them."""
    t = tree.select("censo_id", real("dap_m").alias("d"), real("altura_m").alias("h"), real("volumen_m3").alias("v"))
    f = t.select("censo_id", F.floor(F.col("v") / (basal(F.col("d")) * F.col("h")) * 100 + 0.5).alias("factor_100")).where("factor_100 is not null")
    counts = f.groupBy("censo_id", "factor_100").agg(F.count("*").alias("n"))
    best = counts.groupBy("censo_id").agg(F.max(F.struct("n", (-F.col("factor_100")).alias("k"))).alias("b"), F.sum("n").alias("total"))
    n = F.col("b.n")
    return best.select("censo_id", (-F.col("b.k")).alias("factor_100"), n.alias("n"), (F.col("total") - n).alias("incoherentes"), (n >= F.greatest(F.lit(3), F.floor(F.col("total") / 2))).alias("aceptado"))


def validation(tree: DataFrame) -> DataFrame:
    """A1, A2: one row of counters over the whole table, in one pass."""
    dap, height, volume = real("dap_m"), real("altura_m"), real("volumen_m3")
    place = F.coalesce(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & ~((F.col("x") == 0) & (F.col("y") == 0)), F.lit(False))
    return tree.agg(
        F.count("*").alias("total"),
        F.count_if(~place).alias("sin_posicion"),
        F.count_if(dap.isNull()).alias("dap_invalido"),
        F.count_if(height.isNull()).alias("altura_invalida"),
        F.count_if(volume.isNull()).alias("volumen_cero"),
        F.count_if(dap.isNotNull() & height.isNotNull() & volume.isNotNull()).alias("validos"),
        F.count_if(F.col("aprovechable")).alias("aprovechables"),
        F.count_if(~dap.between(*DAP_RANGE)).alias("dap_fuera"),
        F.count_if(~height.between(*HEIGHT_RANGE)).alias("altura_fuera"),
        F.countDistinct(F.when(normalize_species("especie") != "", normalize_species("especie"))).alias("especies"),
        F.sum(thousandths(volume)).alias("volumen_milesimas"),
        F.min(dap).alias("dap_min"),
        F.max(dap).alias("dap_max"),
        F.min(height).alias("altura_min"),
        F.max(height).alias("altura_max"),
    )


def spelling_variants(tree: DataFrame) -> DataFrame:
    """A3: names of which there is more than one spelling, and how many."""
    s = tree.select(normalize_species("especie").alias("especie_norm"), strip("especie").alias("s")).where("especie_norm <> ''")
    return s.groupBy("especie_norm").agg(F.countDistinct("s").alias("grafias"), F.min("s").alias("primera"), F.max("s").alias("ultima")).where("grafias > 1")


def middle_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """Of each group the value at place n div 2 (from 0) in order, by counts of values, so that no group is gathered row by row."""
    counts = df.where(F.col(value) > 0).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    run = counts.withColumn("to", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = F.floor(F.col("n") / 2)
    return run.where((F.col("to") > at) & (F.col("to") - F.col("c") <= at)).select(group, F.col(value).alias("mediana"), "n")


def suggested_mode(dirty: DataFrame, config: DataFrame) -> DataFrame:
    """Measuring mode that a census' readings suggest: a field name that starts with 'cap', else the middle reading below 10, above 150 or between."""
    mid = middle_value(dirty.select("censo_id", as_float("dap_txt").alias("dap")), "censo_id", "dap")
    m, name = F.col("mediana"), normalize_field("field_dap")
    mode = F.when(name.startswith("cap"), "CAP_CM").when(m < 10, "DAP_M").when(m > 150, "CAP_CM").when(m.isNotNull(), "DAP_CM").when(name.endswith("_cm"), "DAP_CM").otherwise("DAP_M")
    return config.join(mid, "censo_id", "left").select("censo_id", mode.alias("modo"))


def species_lookup(tree: DataFrame, dmc: DataFrame) -> DataFrame:
    """Rows and volume of each listed species, found by comparable name; unlisted rows under id -1."""
    listed = dmc.select(normalize_species("especie").alias("k"), "especie_id")
    t = tree.select(normalize_species("especie").alias("k"), real("volumen_m3").alias("v"))
    j = t.join(small(listed), "k", "left")
    return j.groupBy(F.coalesce("especie_id", F.lit(-1)).alias("especie_id")).agg(F.count("*").alias("n"), F.coalesce(F.sum(thousandths(F.col("v"))), F.lit(0)).alias("volumen_milesimas"))


def diameter_class(dap_m: Column) -> Column:
    """P20: label of a 10 cm class, '' without a diameter."""
    low = (F.floor(F.floor(dap_m * 1000 + 0.5) / 100) * 10).cast("int")
    return F.when(dap_m.isNotNull(), F.concat(low, F.lit(" - "), low + 10)).otherwise("")


def species_summary(tree: DataFrame) -> DataFrame:
    """Rows, shares, volume and diameters of each species, and a TOTAL row."""
    t = tree.where("aprovechable").select(normalize_species("especie").alias("especie"), thousandths(real("volumen_m3")).alias("v"), thousandths(real("dap_m")).alias("d"))
    g = t.rollup("especie").agg(F.grouping("especie").alias("g"), F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("vol"), F.min("d").alias("dap_min_mm"), F.max("d").alias("dap_max_mm"))
    total = Window.partitionBy("g")
    return g.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("especie")).alias("especie"),
        "n",
        F.floor(F.col("n") * 1000000 / F.sum("n").over(total)).alias("n_ppm"),
        F.col("vol").alias("volumen_milesimas"),
        F.floor(F.col("vol") * 1000000 / F.greatest(F.sum("vol").over(total), F.lit(1))).alias("volumen_ppm"),
        "dap_min_mm",
        "dap_max_mm",
    )


#: Lower ends of the diameter classes that become columns, in cm.
CLASSES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90)


def diameter_distribution(tree: DataFrame) -> DataFrame:
    """Species by diameter class, with a total row and column; 100 cm and more, and no diameter, in columns of their own."""
    low = F.floor(F.floor(real("dap_m") * 1000 + 0.5) / 100) * 10
    name = F.when(low.isNull(), "sin_dato").when(low >= 100, "d100").otherwise(F.concat(F.lit("d"), low.cast("string")))
    t = tree.select(normalize_species("especie").alias("especie"), name.alias("clase"))
    columns = [f"d{c}" for c in CLASSES] + ["d100", "sin_dato"]
    wide = t.groupBy("especie").pivot("clase", columns).count().na.fill(0)
    total = wide.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).select(F.lit("TOTAL").alias("especie"), *columns)
    both = wide.unionByName(total)
    return both.withColumn("total", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))


def seed_trees(tree: DataFrame) -> DataFrame:
    """Seed trees against harvestable ones by species, with a TOTAL row."""
    seed = F.upper(F.coalesce("categoria", F.lit(""))).startswith("SEM")
    t = tree.select(normalize_species("especie").alias("especie"), seed.alias("s"), (~seed & F.col("aprovechable")).alias("h"), thousandths(real("volumen_m3")).alias("v"))
    g = t.rollup("especie").agg(F.grouping("especie").alias("g"), F.count_if("s").alias("semilleros"), F.count_if("h").alias("aprovechables"), F.coalesce(F.sum(F.when(F.col("s"), F.col("v"))), F.lit(0)).alias("volumen_semilleros"))
    both = F.col("semilleros") + F.col("aprovechables")
    return g.where(both > 0).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("especie")).alias("especie"), "semilleros", "aprovechables", F.floor(F.col("semilleros") * 10000 / both).alias("semilleros_pct_100"), "volumen_semilleros")


def leading_species(tree: DataFrame, n: int = 3) -> DataFrame:
    """A10: of each census the ``n`` species of largest volume, as text."""
    v = tree.groupBy("censo_id", normalize_species("especie").alias("especie")).agg(F.coalesce(F.sum(thousandths(real("volumen_m3"))), F.lit(0)).alias("v"))
    rank = F.row_number().over(Window.partitionBy("censo_id").orderBy(F.desc("v"), "especie"))
    top = v.withColumn("k", rank).where(F.col("k") <= n)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "especie"))), lambda s: s["especie"]), ", ")
    return top.groupBy("censo_id").agg(text.alias("principales"), F.sum("v").alias("volumen_milesimas"))


def exclusion_reasons(tree: DataFrame, strip_trees: DataFrame | None = None) -> DataFrame:
    """Trees that are left out, and all reasons that hold. ``strip_trees`` lists the fid of trees in a riparian strip."""
    seed = F.upper(F.coalesce("categoria", F.lit(""))).startswith("SEM")
    in_strip = F.lit(False)
    if strip_trees is not None:
        tree = tree.join(strip_trees.select("fid", F.lit(True).alias("_strip")).distinct(), "fid", "left")
        in_strip = F.col("_strip").isNotNull()
    reasons = F.concat_ws("; ", F.when(F.col("bajo_dmc"), "bajo DMC"), F.when(seed, "semillero"), F.when(in_strip, "faja"), F.when(~F.col("aprovechable") & ~seed, "categoria"))
    return tree.select("fid", reasons.alias("motivo")).where("motivo <> ''")


def register(tree: DataFrame) -> DataFrame:
    """Harvestable trees with printable measurements."""
    return tree.where("aprovechable").select("fid", normalize_species("especie").alias("especie"), thousandths(real("dap_m")).alias("dap_mm"), diameter_class(real("dap_m")).alias("clase"), thousandths(real("volumen_m3")).alias("volumen_milesimas"))


def unique_values(df: DataFrame, column: str, most: int = 500) -> DataFrame:
    """Distinct trimmed values in order, ``most`` of them; the limit is the operator's."""
    v = strip(column)
    return df.select(v.alias("valor")).where("valor <> ''").distinct().orderBy("valor").limit(most)


def class_breaks(df: DataFrame, value: Column, shares: tuple[float, ...]) -> DataFrame:
    """Break values of a map legend, linear between neighbouring values."""
    return df.select(value.alias("v")).where("v is not null").agg(*[F.bround(F.percentile("v", F.lit(q)), 6).alias(f"p{round(q * 100)}") for q in shares])


# Names that a field of each role may have, in the order in which they are looked for.
FIELD_NAMES = {
    "id": "id_arbol n_arbol narbol cod_arbol codigo n no nro num id",
    "especie": "especie nom_cient nombre_cientifico nom_comun cod_especi cod_especie sp",
    "categoria": "tipo categoria cat condicion clase aprovecham",
    "dap": "dap dap_m dap_cm d_a_p diametro diam df cap cap_cm",
    "altura": "hc h_com hcom altura_comercial alt_com alt_comerc altura h",
    "volumen": "vol3 volumen vol vol_m3 volumen_m3 vol_com vol_total",
    "parcela": "bq bloque faja parcela pca sector est_ est",
}


def field_roles(fields: DataFrame, name: str = "campo") -> DataFrame:
    """Rol, campo: the field of each role, null where none fits. ``fields`` lists names with their place (``orden``); comparable names count, the first field wins where two are alike, and the first alias that a field has."""
    aliases = F.array(*[F.struct(F.lit(r).alias("rol"), F.lit(a).alias("k"), F.lit(i).alias("i")) for r, names in FIELD_NAMES.items() for i, a in enumerate(names.split())])
    wanted = fields.sparkSession.range(1).select(F.explode(aliases).alias("a")).select("a.*")
    own = fields.groupBy(normalize_field(name).alias("k")).agg(F.min_by(name, "orden").alias("campo"))
    return wanted.join(own, "k", "left").groupBy("rol").agg(F.min_by("campo", F.when(F.col("campo").isNotNull(), F.col("i"))).alias("campo"))


def to_metres(reading: Column, mode: Column) -> Column:
    """Diameter in metres of a reading by its mode: metres, centimetres, or centimetres around; null for other modes."""
    return F.when(mode == "DAP_M", reading).when(mode == "DAP_CM", reading / 100).when(mode == "CAP_CM", reading / math.pi / 100)


def diameters_by_mode(dirty: DataFrame, config: DataFrame) -> DataFrame:
    """Fid, dap_m (6 decimals) of each reading by the mode that its census declares."""
    modes = config.groupBy("censo_id").agg(F.min("diameter_mode").alias("_mode"))
    j = dirty.select("fid", "censo_id", as_float("dap_txt").alias("_v")).join(small(modes), "censo_id", "left")
    return j.select("fid", F.bround(to_metres(F.col("_v"), F.col("_mode")), 6).alias("dap_m"))


def load_checks(tree: DataFrame, config: DataFrame) -> DataFrame:
    """First reason why a row is refused, by its census: where volumes are computed (no volume field) diameter and then height must be there, else only the volume. '' if none."""
    modes = config.groupBy("censo_id").agg(F.max(F.col("field_volumen").isNotNull()).alias("_field"))
    j = tree.select("fid", "censo_id", real("dap_m").alias("d"), real("altura_m").alias("h"), real("volumen_m3").alias("v")).join(small(modes), "censo_id", "left")
    computed = F.when(F.col("d").isNull(), "dap").when(F.col("h").isNull(), "altura").otherwise("")
    return j.select("fid", F.when(F.coalesce(F.col("_field"), F.lit(False)), F.when(F.col("v").isNull(), "volumen").otherwise("")).otherwise(computed).alias("rechazo"))


def joined_spellings(tree: DataFrame) -> DataFrame:
    """A3: names of which there is more than one spelling: the spellings in order, joined."""
    s = tree.select(normalize_species("especie").alias("especie_norm"), strip("especie").alias("s")).where("especie_norm <> ''").distinct()
    return s.groupBy("especie_norm").agg(F.array_join(F.array_sort(F.collect_list("s")), " / ").alias("grafias"), F.count("*").alias("n")).where("n > 1")


def implied_factor_mode(tree: DataFrame) -> DataFrame:
    """A4: of each census the most frequent implied factor to 4 decimals, the first seen (by fid) on a tie, its count and how many differ."""
    t = tree.select("censo_id", "fid", real("dap_m").alias("d"), real("altura_m").alias("h"), real("volumen_m3").alias("v"))
    f = t.select("censo_id", "fid", F.floor(F.col("v") / (basal(F.col("d")) * F.col("h")) * 10000 + 0.5).alias("k")).where("k is not null")
    counts = f.groupBy("censo_id", "k").agg(F.count("*").alias("n"), F.min("fid").alias("first"))
    best = counts.groupBy("censo_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "k")).alias("b"), F.sum("n").alias("total"))
    return best.select("censo_id", F.col("b.k").alias("factor_10000"), F.col("b.n").alias("n"), (F.col("total") - F.col("b.n")).alias("incoherentes"))


def under_limit(tree: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` spellings with most trees under their limit: n and volume; the spelling first in order on a tie. The limit is the operator's."""
    t = tree.where("bajo_dmc").select(strip("especie").alias("especie"), thousandths(real("volumen_m3")).alias("v"))
    g = t.groupBy(F.coalesce("especie", F.lit("")).alias("especie")).agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("volumen_milesimas"))
    return g.orderBy(F.desc("n"), "especie").limit(top)


def species_means(tree: DataFrame, hectares: int) -> DataFrame:
    """Of each species of harvestable trees, under its first spelling by fid, mean volume and trees and volume a hectare, as whole numbers (thousandths, ten-thousandths), with a TOTAL row."""
    t = tree.where("aprovechable").select("fid", normalize_species("especie").alias("k"), strip("especie").alias("s"), thousandths(real("volumen_m3")).alias("v"))
    g = t.rollup("k").agg(F.grouping("k").alias("g"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("fid"))).alias("s"), F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    label = F.when(F.col("g") == 1, "TOTAL").when(F.col("k") == "", "sin especie").otherwise(F.col("s"))
    return g.select(F.col("k").alias("clave"), label.alias("especie"), "n", F.floor(F.col("v") / F.col("n")).alias("volumen_medio"), F.floor(F.col("n") * 10000 / hectares).alias("n_ha_10000"), F.floor(F.col("v") * 10 / hectares).alias("volumen_ha_10000"))


def diameter_classes(tree: DataFrame) -> DataFrame:
    """Harvestable trees of every species and every 10 cm class (inferior, cm; null without a diameter), with the totals of species, of classes and of all ('TOTAL'; todas)."""
    low = F.floor(F.floor(real("dap_m") * 1000 + 0.5) / 100) * 10
    t = tree.where("aprovechable").select(normalize_species("especie").alias("k"), low.alias("inferior"), thousandths(real("volumen_m3")).alias("v"))
    g = t.cube("k", "inferior").agg(F.grouping("k").alias("a"), F.grouping("inferior").alias("b"), F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("volumen_milesimas"))
    return g.select(F.when(F.col("a") == 1, "TOTAL").otherwise(F.col("k")).alias("especie"), "inferior", (F.col("b") == 1).alias("todas"), "n", "volumen_milesimas")


def equal_breaks(df: DataFrame, value: Column, classes: int = 4) -> DataFrame:
    """The ends of ``classes`` classes of equal width; one unit wide in all if all values are alike."""
    g = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    top = F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a") + 1)
    return g.select(*[F.bround(F.col("a") + (top - F.col("a")) * i / classes, 6).alias(f"corte{i}") for i in range(classes + 1)])


def limit_breaks(df: DataFrame, value: Column, limit: float) -> DataFrame:
    """Breaks around a limit: none, half of it, 85 %, itself, 125 %, and the largest value, at least half beyond."""
    g = df.agg(F.max(value).alias("m"))
    return g.select(*[F.bround(F.lit(limit * k), 6).alias(n) for n, k in (("corte0", 0.0), ("corte1", 0.5), ("corte2", 0.85), ("corte3", 1.0), ("corte4", 1.25))], F.bround(F.greatest(F.coalesce("m", F.lit(0.0)).cast("double"), F.lit(limit * 1.5)), 6).alias("corte5"))


def selected(tree: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of which the key is selected, each once however often it is; null keys are never selected."""
    return tree.join(chosen.select(key).distinct(), key, "left_semi")
