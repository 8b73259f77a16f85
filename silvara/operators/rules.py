"""Thematic rules: which classes of which layer restrict the work, in which role."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvara.functions.text import as_col, strip
from silvara.runtime import small

# Words that tell a wetland, and a protected place; field names that tell a class; roles of a rule.
WETLAND = ("aguajal", "aguaje", "mauritia", "pantano", "panta", "humedal", "inundable", "inundacion", "hidromorf", "palmera", "palmar", "renacal", "tahuampa", "varzea", "bajial", "cocha")
PROTECTED = ("proteccion", "conservacion", "intangible", "area natural protegida", "anp", "reserva", "santuario", "parque nacional", "servidumbre", "no aprovechable")
ROLES = ("VETO_LEGAL", "IMPEDIMENTO_FISICO", "PREFERENCIA")
CLASS_HINTS = ("ecosistema", "nom_eco", "clase", "cobertura", "cob_veg", "categoria", "zona", "zee", "descripcion", "leyenda", "tipo", "uso")

# Letters of the extended Latin blocks whose decomposition is one plain letter and its marks.
_PAIRS = [(chr(c), base) for c in range(0xC0, 0x250) if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))) == 1 and base != chr(c)]
MARKED, UNMARKED = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def plain(c: Column | str) -> Column:
    """Small letters without accents and outer white space, in the JVM. Marks that stand alone go; null stays null."""
    return F.regexp_replace(F.translate(F.lower(strip(as_col(c).cast("string"))), MARKED, UNMARKED), r"\p{Mn}", "")


def mentions(c: Column | str, words: tuple[str, ...]) -> Column:
    """Whether the plain text holds any of the words; null gives false."""
    text = plain(c)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def class_field(fields: dict[str, str], hints: tuple[str, ...] = CLASS_HINTS) -> str | None:
    """The field that holds a layer's class: the first hint that a name contains, else the first text field. ``fields`` maps names to Spark's type names."""
    plain_names = {"".join(x for x in unicodedata.normalize("NFKD", n.strip().lower()) if not unicodedata.combining(x)): n for n in fields}
    told = next((n for h in hints for p, n in plain_names.items() if h in p), None)
    return told or next((n for n, kind in fields.items() if kind == "string"), None)


def judged(rules: DataFrame) -> DataFrame:
    """``rules`` (regla, capa, campo, valores, rol, peso) with problemas (array, empty for a rule that may be used), humedal (a usable rule of which a value tells a wetland) and filtro (its condition as text)."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    no_values = F.coalesce(F.size("valores") == 0, F.lit(True)) | F.col("valores").isNull()
    found = [
        F.when(empty("capa"), "capa"),
        F.when(empty("campo"), "campo"),
        F.when(no_values, "valores"),
        F.when(~F.coalesce(F.col("rol").isin(*ROLES), F.lit(False)), "rol"),
        F.when(~F.coalesce(F.col("peso").between(0.0, 1.0) & ~F.isnan("peso"), F.lit(False)), "peso"),
    ]
    quoted = F.array_join(F.transform("valores", lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))), ",")
    text = F.when(~empty("campo") & ~no_values, F.concat(F.lit('"'), F.col("campo"), F.lit('" IN ('), quoted, F.lit(")")))
    out = rules.withColumn("problemas", F.array_compact(F.array(*found)))
    wet = (F.size("problemas") == 0) & F.coalesce(F.exists("valores", lambda v: mentions(v, WETLAND)), F.lit(False))
    return out.withColumns({"humedal": wet, "filtro": text})


def chosen(features: DataFrame, key: str, value: str, rules: DataFrame) -> DataFrame:
    """Features that usable rules select by their class: ``key``, regla, rol, peso. Equality is exact; null classes are never selected."""
    usable = judged(rules).where(F.size("problemas") == 0).select("regla", "rol", "peso", F.explode(F.array_distinct("valores")).alias("_v"))
    return features.select(key, F.col(value).alias("_v")).join(small(usable), "_v").select(key, "regla", "rol", "peso")
