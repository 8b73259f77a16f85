"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented vowels and n-tilde with the plain letters they stand for.
ACCENTED = "áéíóúÁÉÍÓÚ"
PLAIN = "aeiouaeiou"
# Texts that stand for a missing number or text.
NULL_NUMBERS = ("", "NULL", "NONE", "NA", "-")
NULL_TEXTS = ("NULL", "NONE")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space on both ends."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def normalize_field(c: Column | str) -> Column:
    """Comparable form of a field name; n-tilde stays. Null stays null."""
    s = F.lower(strip(c))
    s = F.regexp_replace(F.translate(s, ACCENTED, PLAIN), "[º°ª#]", "")
    s = F.regexp_replace(s, r"[ \-./]", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")


def normalize_species(c: Column | str) -> Column:
    """Comparable form of a species name; null and blank give ''."""
    s = F.translate(F.lower(strip(c)), ACCENTED + "ñÑ", PLAIN + "nn")
    return F.coalesce(F.regexp_replace(s, r"\s+", " "), F.lit(""))


def as_float(c: Column | str) -> Column:
    """Number written as text, point or comma; missing tokens, NaN and unparsable texts give null."""
    s = strip(as_col(c).cast("string"))
    plain = F.regexp_replace(s, ",", ".")
    ok = ~F.upper(s).isin(*NULL_NUMBERS) & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(ok, plain.try_cast("double"))


def as_text(c: Column | str) -> Column:
    """P5: text without outer white space; null and missing tokens give ''."""
    s = strip(as_col(c).cast("string"))
    return F.coalesce(F.when(~F.upper(s).isin(*NULL_TEXTS), s), F.lit(""))
