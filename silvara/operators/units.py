"""Problem 4: diameters recorded in different units, brought to metres of diameter.

Sources are the unlabelled readings of each census. The same trees link them to metres: by the diameter that a tree's
volume, height and form factor imply, and by labelled readings of the same tree in another delivery. Each link gives a robust
scale and offset, which snap to known conversions and to none. Scales are then propagated through the graph of sources and the species that they share: each round the
sources resolved so far tell the sizes of species, these the scales of further sources, until no source changes.
Single readings that leave their source's unit by a power of ten are found against the same links.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.runtime import cut, drop, small

# Reading per metre of diameter.
CONVERSIONS = {
    "m": 1.0,
    "cm": 100.0,
    "mm": 1000.0,
    "in": 1000 / 25.4,
    "circ_m": math.pi,
    "circ_cm": 100 * math.pi,
    "circ_mm": 1000 * math.pi,
    "circ_in": 1000 / 25.4 * math.pi,
}
#: Natural-log distance within which a scale is taken for a known conversion: of a source's links by trees, and by species.
SNAP_SOURCE, SNAP_SPECIES = 0.05, 0.25
#: Links that a scale needs: by volumes, by labels, by trees of common species; and a scale together with an offset.
LEAST_LINKS, LEAST_LABELS, LEAST_TREES, LEAST_AFFINE = 5, 3, 5, 20
#: Offsets in metres up to which they are taken for none.
NO_OFFSET = 0.01
#: Real diameters in metres.
LEAST, MOST = 0.05, 3.5


def _looked_up(key: Column, values: dict[str, Column]) -> Column:
    """The value of a key, null if it has none. The key is written once, not in a branch for each value, so that expressions of expressions stay short."""
    return F.try_element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v)]), key)


def conversion(unit: Column) -> Column:
    """Reading per metre of diameter of a unit's name."""
    return _looked_up(unit, {k: F.lit(v) for k, v in CONVERSIONS.items()})


def nearest(ratio: Column, within: float, names: tuple[str, ...] = tuple(CONVERSIONS)) -> Column:
    """Name of the known conversion nearest to a ratio in logarithm, null if none lies within the distance."""
    far = F.least(*[F.struct(F.abs(F.log(ratio / CONVERSIONS[n])).alias("d"), F.lit(n).alias("n")) for n in names])
    return F.when((ratio > 0) & (far["d"] <= within), far["n"])


def with_reading(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what a reading's text holds: v, its number (null unless there is exactly one), exact, the same as a decimal, dec, its decimals, and unit, null if untold.

    Points and commas are decimal marks; '1,234.5' holds two and is no number. A circumference without a unit is in centimetres.
    """
    df = df.withColumn("_s", F.lower(F.trim(text))).withColumn("_n", F.regexp_replace(F.regexp_extract("_s", r"^[^\d−-]*(\d+(?:[.,]\d+)?)\D*$", 1), ",", "."))
    df = df.withColumn("v", F.col("_n").try_cast("double")).where(F.col("v") > 0)
    df = df.withColumn("_rest", F.trim(F.translate("_s", "0123456789", " ")))
    rest = F.col("_rest")
    told_by = rest.rlike("[^., ]")
    length = (
        F.when(rest.rlike(r"\bmm\b|mil[ií]metro"), "mm")
        .when(rest.rlike(r"\bcms?\b|cent[ií]metro"), "cm")
        .when(rest.rlike(r"\bin\b|pulg|inch|\"|''|″"), "in")
        .when(rest.rlike(r"\bmt?s?\b|metro"), "m")
    )
    around = rest.rlike(r"\bcap\b|circ|per[ií]m|contorno|\bc\s*=|c_a_p")
    df = df.withColumn("_l", F.when(told_by, length)).withColumn("unit", F.when(told_by & around, F.concat(F.lit("circ_"), F.coalesce("_l", F.lit("cm")))).otherwise(F.col("_l")))
    point = F.locate(".", F.col("_n"))
    return df.withColumns({"exact": F.col("_n").try_cast("decimal(18,6)"), "dec": F.when(point > 0, F.length("_n") - point).otherwise(0)}).drop("_s", "_n", "_rest", "_l")


def told(field: Column, mode: Column, remark: Column) -> Column:
    """The unit that a census tells: by its remark, else its field's name, else its declared mode; centimetres if all are silent."""
    words = [F.lower(F.coalesce(remark, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(field, F.lit("")), "_", " "))]

    def of(s: Column) -> Column:
        around = s.rlike(r"\bcap\b|\bc a p\b|circ|per[ií]m|contorno")
        length = F.when(s.rlike(r"\bmm\b|mil[ií]metro"), "mm").when(s.rlike(r"pulg|inch"), "in").when(s.rlike(r"\bcm\b|cent[ií]metro"), "cm").when(s.rlike(r"\ben m\b|\bm\b|\bmetros\b|\[m\]"), "m")
        silent = s.rlike("sin cinta diam")
        length = F.when(silent, F.regexp_extract(s, "(cm|mm)", 1)).otherwise(length)
        length = F.when(length != "", length)
        return F.when(around, F.concat(F.lit("circ_"), F.coalesce(length, F.lit("cm")))).otherwise(length)

    declared = F.when(mode == "DAP_M", "m").when(mode == "CAP_CM", "circ_cm").otherwise("cm")
    return F.coalesce(of(words[0]), of(words[1]), declared)


def _readings(tree: DataFrame, dirty: DataFrame, config: DataFrame) -> DataFrame:
    """Readings above 0 with what links them: implied is the diameter in metres by volume, height and form factor."""
    cc = config.select(F.col("censo_id").alias("_cc"), "form_factor")
    t = tree.select("fid", F.col("censo_id").alias("censo_id"), "codigo", "especie", "dap_m", "altura_m", "volumen_m3")
    d = with_reading(dirty.select(F.col("fid").alias("_fid"), "dap_txt"), "dap_txt")
    rows = t.join(d, F.col("fid") == F.col("_fid")).join(small(cc), F.col("censo_id") == F.col("_cc"), "left")
    ok = (F.col("altura_m") > 0) & (F.col("altura_m") <= 45) & (F.col("volumen_m3") > 0) & (F.col("volumen_m3") <= 200) & (F.col("form_factor") > 0)
    implied = F.sqrt(F.col("volumen_m3") / (F.lit(math.pi / 4) * F.col("altura_m") * F.col("form_factor")))
    return rows.select("fid", "censo_id", "codigo", "especie", "dap_m", "v", "exact", "dec", "unit", F.when(ok, implied).alias("implied"))


_SIXTHS = (1 / 6, 0.5, 5 / 6)


def _link(v: Column, metres: Column, tag: str) -> list[Column]:
    """Aggregates of readings ``v`` linked to ``metres`` (null where there is no link): links, the median ratio, and sixths of both sides."""
    linked = metres.isNotNull()
    return [
        F.count(metres).alias(f"_n{tag}"),
        F.percentile_approx(v / metres, F.lit(0.5), F.lit(2000)).alias(f"_s{tag}"),
        F.percentile_approx(F.when(linked, v), F.array(*map(F.lit, _SIXTHS)), F.lit(2000)).alias(f"_v{tag}"),
        F.percentile_approx(metres, F.array(*map(F.lit, _SIXTHS)), F.lit(2000)).alias(f"_m{tag}"),
    ]


def _with_snapped(df: DataFrame, tag: str, least: int, name: str) -> DataFrame:
    """``df`` with ``name``: unit, scale, offset_m and links of a link's aggregates, null where nothing snaps.

    The median ratio is taken if it is a known conversion. Else the readings may have an offset: as trees keep their order, the sixths of both sides
    belong together, and give a slope that outliers of up to a sixth on either end do not touch; the offset is what the medians then differ by.
    Each step is a column of its own, as one expression of all would hold the slope some hundred times.
    """
    n, ratio, v, m = (F.col(f"_{c}{tag}") for c in "nsvm")
    slope = F.try_divide(F.get(v, F.lit(2)) - F.get(v, F.lit(0)), F.get(m, F.lit(2)) - F.get(m, F.lit(0)))
    df = df.withColumns({"_plain": nearest(ratio, SNAP_SOURCE), "_slope": slope})
    df = df.withColumn("_sloped", nearest(F.col("_slope"), SNAP_SOURCE))
    df = df.withColumn("_offset", F.get(v, F.lit(1)) / conversion(F.col("_sloped")) - F.get(m, F.lit(1)))
    fit = lambda unit, scale, off: F.struct(F.col(unit).alias("unit"), scale.alias("scale"), off.alias("offset_m"), n.alias("links"))
    one = F.when((n >= least) & F.col("_plain").isNotNull(), fit("_plain", ratio, F.lit(0.0)))
    one = one.when((n >= LEAST_AFFINE) & F.col("_sloped").isNotNull() & (F.abs("_offset") > NO_OFFSET), fit("_sloped", F.col("_slope"), F.col("_offset")))
    return df.withColumn(name, one)


def source_graph(readings: DataFrame, config: DataFrame) -> DataFrame:
    """One row per census: unit of its unlabelled readings, and by which link it was found (via).

    Columns: censo_id, unit, scale (reading per metre), offset_m (metres that its readings exceed the diameter by), links, via, tenths (whether most readings have decimals). Medians are approximate
    percentiles, which merge across partitions, so no census is gathered. The labels of one tree are put together before they
    meet its readings, so that a code repeated for many rows gives each of them one link.
    """
    plain = readings.where(F.col("unit").isNull())
    told_by = config.select("censo_id", told(F.col("field_dap"), F.col("diameter_mode"), F.col("observacion")).alias("told")).groupBy("censo_id").agg(F.min("told").alias("told"))
    # Link 1: the same tree's implied diameter.
    implied = plain.groupBy("censo_id").agg(*_link(F.col("v"), F.col("implied"), "1"), (F.avg((F.col("dec") > 0).cast("int")) >= 0.5).alias("tenths"))
    first = cut(_with_snapped(implied, "1", LEAST_LINKS, "_a").select("censo_id", "_a", "tenths"))
    # Link 2: labelled readings of the same tree in other deliveries, for the sources that link 1 leaves open.
    open_ = small(first.where(F.col("_a").isNull()).select("censo_id"))
    coded = readings.where(F.col("codigo").isNotNull()).join(open_, "censo_id", "left_semi")
    trees = coded.where(F.col("unit").isNotNull()).groupBy("censo_id", "codigo").agg(F.percentile_approx(F.col("v") / conversion(F.col("unit")), F.lit(0.5), F.lit(100)).alias("_d"))
    labelled = coded.where(F.col("unit").isNull()).join(trees, ["censo_id", "codigo"]).groupBy("censo_id").agg(*_link(F.col("v"), F.col("_d"), "2"))
    second = _with_snapped(labelled, "2", LEAST_LABELS, "_b").select("censo_id", "_b")
    found = F.coalesce("_a", "_b")
    state = cut(
        first.join(second, "censo_id", "left").join(told_by, "censo_id", "left").select(
            "censo_id", "tenths", F.coalesce("told", F.lit("cm")).alias("told"), found["unit"].alias("unit"), found["scale"].alias("scale"), found["offset_m"].alias("offset_m"), found["links"].alias("links"),
            F.when(F.col("_a").isNotNull(), "volumen").when(F.col("_b").isNotNull(), "rotulo").alias("via"),
        )
    )
    # Link 3: sizes of species that sources share, passed on round by round.
    sizes = cut(plain.where(F.col("especie").isNotNull()).groupBy("censo_id", "especie").agg(F.percentile_approx("v", F.lit(0.5), F.lit(1000)).alias("size"), F.count("*").alias("trees")))
    while True:
        known = state.where(F.col("unit").isNotNull()).select("censo_id", conversion(F.col("unit")).alias("_k"), F.coalesce("offset_m", F.lit(0.0)).alias("_o"))
        metres = sizes.join(known, "censo_id").groupBy("especie").agg((F.sum((F.col("size") / F.col("_k") - F.col("_o")) * F.col("trees")) / F.sum("trees")).alias("_d")).where("_d > 0")
        passed = (
            sizes.join(state.where(F.col("unit").isNull()).select("censo_id"), "censo_id", "left_semi").join(metres, "especie")
            .groupBy("censo_id").agg(F.expr("percentile(size / _d, 0.5, trees)").alias("_scale"), F.sum("trees").alias("_links"))
        )
        # Telling counts where it agrees with the sizes.
        agrees = F.abs(F.log(F.col("_scale") / conversion(F.col("told")))) <= 2 * SNAP_SPECIES
        by_sizes = F.when(F.col("_links") >= LEAST_TREES, nearest(F.col("_scale"), SNAP_SPECIES))
        new = F.col("_new")
        before = state
        met = state.join(passed, "censo_id", "left").withColumn("_agrees", agrees)
        met = met.withColumn("_unit", F.when(F.col("_agrees"), F.col("told")).otherwise(by_sizes)).withColumn("_new", F.col("unit").isNull() & F.col("_unit").isNotNull())
        state = cut(
            met.select(
                "censo_id", "tenths", "told", F.coalesce("unit", "_unit").alias("unit"), F.coalesce("scale", F.when(new, F.col("_scale"))).alias("scale"), F.coalesce("offset_m", F.when(new, F.lit(0.0))).alias("offset_m"),
                F.coalesce("links", F.when(new, F.col("_links"))).alias("links"), F.coalesce("via", F.when(new, F.when(F.col("_agrees"), "declarado").otherwise("especie"))).alias("via"), "_new",
            )
        )
        drop(before)
        if not state.where("_new").limit(1).count():
            break
    # What no link reaches is as it is told.
    return state.select("censo_id", F.coalesce("unit", "told").alias("unit"), "scale", F.coalesce("offset_m", F.lit(0.0)).alias("offset_m"), "links", F.coalesce("via", F.lit("declarado")).alias("via"), "tenths")


def diameters(tree: DataFrame, dirty: DataFrame, config: DataFrame) -> DataFrame:
    """Every reading above 0 as a diameter: fid, censo_id, dap_m (as stored), dap_mm (double), dap_redondo (long, half up), unidad, via.

    A unit in the text counts first, then the unit of the reading's source. A single unlabelled reading that lies a factor of 5 or
    more from its tree's linked diameter takes the millimetres, centimetres or metres that fit; one without a linked
    diameter does so if its own unit gives no real diameter, or if it is a whole number of 175 or more where its source records tenths of centimetres.
    Readings that are null, no number, zero or negative give no row, nor do those whose ``fid`` has no tree; empty tables give none.
    Extra columns are ignored.
    """
    rows = cut(_readings(tree, dirty, config))
    sources = cut(source_graph(rows, config)).select(F.col("censo_id").alias("_s"), F.col("unit").alias("_su"), F.col("offset_m").alias("_off"), "via", "tenths")
    joined = rows.join(small(sources), F.col("censo_id").eqNullSafe(F.col("_s")), "left").withColumns({"_k": conversion(F.coalesce("_su", F.lit("cm"))), "_off": F.coalesce("_off", F.lit(0.0))})
    d = F.col("v") / F.col("_k") - F.col("_off")
    whole_number = F.coalesce((F.col("dec") == 0) & (F.col("_su") == "cm") & F.col("tenths") & (F.col("v") >= 175), F.lit(False))
    odd = (d < LEAST) | (d > MOST) | whole_number
    doubtful = F.col("unit").isNull() & F.col("implied").isNull() & odd & F.col("codigo").isNotNull()
    flagged = joined.withColumn("_doubt", F.coalesce(doubtful, F.lit(False)))
    # Linked diameters of the same tree, only for doubtful readings without one of their own; other rows of those trees are few.
    need = cut(flagged.where("_doubt").select("censo_id", "codigo").distinct())
    offer = flagged.where(~F.col("_doubt")).join(small(need), ["censo_id", "codigo"], "left_semi")
    own = F.when(F.col("unit").isNotNull(), F.col("v") / conversion(F.col("unit"))).otherwise(d)
    peers = offer.groupBy(F.col("censo_id").alias("_pc"), F.col("codigo").alias("_pt")).agg(F.percentile_approx(F.coalesce("implied", own), F.lit(0.5), F.lit(100)).alias("_peer"))
    linked = flagged.join(small(cut(peers)), F.col("_doubt") & (F.col("censo_id") == F.col("_pc")) & (F.col("codigo") == F.col("_pt")), "left").withColumn("_ref", F.coalesce("implied", "_peer"))
    lengths = ("m", "cm", "mm")
    off = F.abs(F.log(d / F.col("_ref")))
    by_ref = F.when((off > math.log(5)) | (d <= 0), nearest(F.col("v") / F.col("_ref"), 0.5, lengths))
    fits = {n: (F.col("v") / CONVERSIONS[n] >= LEAST) & (F.col("v") / CONVERSIONS[n] <= MOST) for n in lengths}
    by_size = F.when((d < LEAST) | (d > MOST), F.when(fits["m"], "m").when(fits["cm"] & (F.col("dec") > 0), "cm").when(fits["mm"], "mm").when(fits["cm"], "cm")).when(whole_number, "mm")
    single = F.when(F.col("_ref").isNotNull(), by_ref).otherwise(by_size)
    unit = F.coalesce("unit", single, "_su", F.lit("cm"))
    # The source's offset belongs to readings in its unit; straight lengths without one are multiplied as decimals, so that halves are exact.
    shift = F.when(F.col("unit").isNull() & single.isNull(), F.col("_off")).otherwise(0.0)
    linked = linked.withColumns({"_u": unit, "_shift": shift})
    per = _looked_up(F.col("_u"), {k: F.lit(v).cast("decimal(8,2)") for k, v in {"mm": "1", "cm": "10", "m": "1000", "in": "25.4"}.items()})
    exact = F.when(F.col("_shift") == 0, F.col("exact") * per)
    loose = (F.col("v") / conversion(F.col("_u")) - F.col("_shift")) * 1000
    return linked.select("fid", "censo_id", "dap_m", F.coalesce(exact.cast("double"), loose).alias("dap_mm"), F.coalesce(F.round(exact, 0).cast("long"), F.floor(loose + 0.5)).alias("dap_redondo"), F.col("_u").alias("unidad"), "via")


def wrong_units(tree: DataFrame, dirty: DataFrame, config: DataFrame, tolerance_mm: float = 2.0) -> DataFrame:
    """Trees whose stored diameter is off by its unit: fid, dap_mm. A null, NaN, zero or negative ``dap_m`` is no reading and no case."""
    stored = F.col("dap_m")
    return diameters(tree, dirty, config).where(~F.isnan(stored) & (stored > 0) & (F.abs(stored * 1000 - F.col("dap_mm")) > tolerance_mm)).select("fid", F.col("dap_redondo").alias("dap_mm"))
