"""Problem 2: visually identical text with different characters, brought to one form.

A text is normalised for compatibility (width and style), characters that show nothing are deleted, and each remaining character opens
its look-alikes as states of a lattice. Viterbi search finds the reading whose character trigrams score best under a model
of the canonical names, where staying in one script costs nothing and changing it does.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from silvara.runtime import cut, ship, small

# Letters of other scripts with the Latin letters that look like them, small and capital.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "υ": "u", "ρ": "p", "κ": "k", "γ": "y", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ѵ": "v", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮮ": "L", "Ꮲ": "P", "Ꭱ": "R", "Ꭲ": "T", "Ꮓ": "Z",
}
# Strokes that stand for a small l, or for an i (by its capital).
STROKES = {"ӏ": ("i",), "Ι": ("l",), "І": ("l",), "ǀ": ("l", "i"), "∣": ("l", "i"), "ⅼ": ("l",)}
#: Categories of characters that show nothing: format, control and unassigned ones, and variation selectors.
IGNORABLE = ("Cf", "Cc", "Cn")
#: Cost of a look-alike state beside the character itself, and of a change of script between neighbours, in natural logarithms.
SWAP_COST, SCRIPT_COST = 0.1, 2.0


def visible(text: str) -> str:
    """Compatibility form without characters that show nothing; every white space is a plain space, accents are composed."""
    out = []
    for ch in unicodedata.normalize("NFD", text):
        if ch.isspace():
            out.append(" ")
        elif unicodedata.category(ch) not in IGNORABLE and not "︀" <= ch <= "️":
            out.append(ch)
    return unicodedata.normalize("NFKC", "".join(out))


def plain_form(text: str) -> str:
    """What a comparison forgives: letter case, and plain spaces at the ends or repeated."""
    return " ".join(x for x in text.lower().split(" ") if x)


def script(ch: str) -> str:
    """Script of a letter by its name's first word; other characters belong to any."""
    return unicodedata.name(ch, "?").split(" ")[0] if ch.isalpha() else ""


@dataclass
class NameModel:
    """Character trigrams of the canonical names, with add-one smoothing over pairs."""

    tri: dict[str, float]
    floor: float

    @classmethod
    def of(cls, tri: Counter[str]) -> NameModel:
        """The model of counted trigrams."""
        pair: Counter[str] = Counter()
        for t, n in tri.items():
            pair[t[:2]] += n
        size = len({t[2] for t in tri}) + 2
        return cls({t: math.log((n + 1) / (pair[t[:2]] + size)) for t, n in tri.items()}, math.log(1 / (size + 10)))

    @classmethod
    def fit(cls, names: list[str]) -> NameModel:
        tri: Counter[str] = Counter()
        for name in names:
            s = "^^" + plain_form(unicodedata.normalize("NFC", name)) + "$"
            tri.update(s[i - 2 : i + 1] for i in range(2, len(s)))
        return cls.of(tri)

    def score(self, a: str, b: str, c: str) -> float:
        return self.tri.get(a + b + c, self.floor)


def clusters(text: str) -> list[str]:
    """A text's letters, each with the marks that follow it."""
    out: list[str] = []
    for ch in text:
        if out and unicodedata.category(ch) == "Mn":
            out[-1] += ch
        else:
            out.append(ch)
    return out


def look_alike(base: str) -> str | None:
    """The Latin letter that a letter looks like: by the table, or, of the Latin small capitals, by its name."""
    named = unicodedata.name(base, "")
    return LOOKALIKES.get(base) or (named[-1] if named.startswith("LATIN LETTER SMALL CAPITAL ") and len(named) == 28 else None)


def strokes(word: list[str]) -> list[tuple[str, ...]]:
    """Of each letter of a word (with its marks), the other small letters that its shape stands for. A capital I is a small l's stroke, which may
    stand for one unless the rest of the word is in capitals; a small l is a capital I's stroke, which may stand for one where a capital can: first in a word, or in a word of capitals."""
    out = []
    for i, c in enumerate(word):
        rest = [x for k, x in enumerate(word) if k != i and x[0].isalpha() and x[0] not in "Il"]
        capitals = bool(rest) and all(x[0].isupper() for x in rest)
        if c == "I":
            out.append(() if capitals else ("l",))
        elif c == "l":
            out.append(("i",) if capitals or i == 0 else ())
        else:
            out.append(STROKES.get(c[0], ()))
    return out


def states(cluster: str, twins: tuple[str, ...] = ()) -> list[tuple[str, str, float]]:
    """(small letter, script, cost) of the readings of one letter with its marks; ``twins`` are further letters."""
    base, *marks = unicodedata.normalize("NFD", cluster)
    found = {unicodedata.normalize("NFC", cluster.lower()): (script(base), 0.0)}
    for like in (look_alike(base), *twins):
        if like:
            found.setdefault(unicodedata.normalize("NFC", like.lower() + "".join(marks)), ("LATIN", SWAP_COST))
    return [(letter, s, cost) for letter, (s, cost) in found.items()]


def read(text: str, model: NameModel, twins: bool = True) -> str:
    """Best reading of a text: Viterbi over pairs of neighbouring states. Without ``twins`` a Latin letter only reads as itself."""
    best: dict[tuple[str, str], tuple[float, str, str]] = {("^", "^"): (0.0, "", "")}
    letters = clusters(plain_form_keep_case(text))
    other: list[tuple[str, ...]] = []
    for spaced, run in groupby(letters, key=lambda c: c == " "):
        part = list(run)
        other += [()] * len(part) if spaced or not twins else strokes(part)
    for ch, more in zip(letters, other):
        nxt: dict[tuple[str, str], tuple[float, str, str]] = {}
        for letter, own, cost in states(ch, more):
            for (a, b), (total, last, so_far) in best.items():
                change = SCRIPT_COST if own and last and own != last else 0.0
                score = total + model.score(a, b, letter) - cost - change
                if (b, letter) not in nxt or score > nxt[b, letter][0]:
                    nxt[b, letter] = (score, own or last, so_far + letter)
        best = nxt
    return max(((t + model.score(a, b, "$"), s) for (a, b), (t, _, s) in best.items()), default=(0, ""))[1]


def plain_form_keep_case(text: str) -> str:
    return " ".join(x for x in text.split(" ") if x)


class Reader:
    """Three readings of a text under a model of names: as it shows, by look-alikes of other scripts, and by strokes of I and l as well. The second is its form if none is a name."""

    def __init__(self, model: NameModel):
        self.model = model
        self.cache: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> tuple[str, ...]:
        found = self.cache.get(text)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            shown = visible(text)
            found = self.cache[text] = (plain_form(shown), read(shown, self.model, twins=False), read(shown, self.model))
        return found


class Canonical:
    """Reads texts and finds the canonical names they look like, in a list that is at hand, or in a part of one with the ``model`` of all."""

    def __init__(self, names: dict[str, int], model: NameModel | None = None):
        self.names = {plain_form(unicodedata.normalize("NFC", n)): i for n, i in names.items()}
        self.own = defaultdict(set)
        for n, i in names.items():
            self.own[i].add(plain_form(n))
        self.reader = Reader(model or NameModel.fit(list(names)))

    def __call__(self, text: str) -> tuple[str, int]:
        """One form of a text, and the id of the name it is or -1."""
        forms = self.reader(text)
        return next(((f, self.names[f]) for f in forms if f in self.names), (forms[1], -1))

    def disguised(self, text: str) -> int:
        """Id of the name that a text looks like while made of other characters, else -1."""
        found = self(text)[1]
        return -1 if found >= 0 and plain_form(text) in self.own[found] else found


def name_model(names: DataFrame) -> NameModel:
    """The model of a list of names (column n): trigrams are counted where the names lie, so that only as many rows as there are different ones come back."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tri: Counter[str] = Counter()
            for n in b["n"]:
                s = "^^" + plain_form(unicodedata.normalize("NFC", n)) + "$"
                tri.update(s[i - 2 : i + 1] for i in range(2, len(s)))
            yield pd.DataFrame({"t": list(tri), "c": list(tri.values())}, columns=["t", "c"]).astype({"c": "int64"})

    counted = ship(names.where(F.col("n").isNotNull())).mapInPandas(parts, "t string, c long").groupBy("t").agg(F.sum("c").alias("c")).collect()
    return NameModel.of(Counter({r.t: r.c for r in counted}))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda n: None if n is None else plain_form(unicodedata.normalize("NFC", n)))


@F.pandas_udf(StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda n: None if n is None else plain_form(n))


def _listed(reference: DataFrame, key: str, name: str) -> DataFrame:
    """id, own (a name's plain form) and f (the same composed); one row a composed form."""
    rows = ship(reference).where(F.col(name).isNotNull()).select(F.col(key).cast("int").alias("id"), _plain(F.col(name)).alias("own"), _composed(F.col(name)).alias("f"))
    return rows.groupBy("f").agg(F.min(F.struct("id", "own")).alias("_x")).select("f", "_x.id", "_x.own")


#: Characters that no letter of another kind looks like: of basic Latin all, of the rest the composed letters of Spanish and Portuguese.
SAFE = r"^[ -~áéíóúüñãõçâêôàÁÉÍÓÚÜÑÃÕÇÂÊÔÀ]*$"


def _matched(odd: DataFrame, listed: DataFrame, reader_of: NameModel) -> DataFrame:
    """``odd`` (with a text t) with forma, id and own of the first of its readings that is listed; id null if none is."""

    @F.pandas_udf("array<string>")
    def readings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(reader_of)
        for s in batches:
            yield s.map(lambda t: list(reader(t)))

    out = odd.withColumn("_r", readings(F.col("t")))
    names = small(listed)
    found = []
    for i in range(3):
        out = out.join(names.select(*[F.col(c).alias(f"_{c}{i}") for c in ("f", "id", "own")]), F.get("_r", F.lit(i)) == F.col(f"_f{i}"), "left")
        found.append(F.when(F.col(f"_f{i}").isNotNull(), F.struct(F.col(f"_f{i}").alias("f"), F.col(f"_id{i}").alias("id"), F.col(f"_own{i}").alias("own"))))
    first = F.coalesce(*found)
    out = out.withColumn("_x", first).withColumns({"_forma": F.coalesce("_x.f", F.get("_r", F.lit(1))), "_id": F.col("_x.id"), "_own": F.col("_x.own")})
    return out.drop("_x", *[f"_{c}{i}" for c in ("f", "id", "own") for i in range(3)])


def _suspicious(text: Column, listed: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with t, _plainly (lower case, spaces set right, by the JVM) and _sure, the listed id of a text that is a name as it stands; null if it must be read."""
    plain = F.trim(F.regexp_replace(F.lower(text), " +", " "))
    names = small(listed).select(F.col("own").alias("_n"), F.col("id").alias("_ni"))
    j = df.withColumns({"t": text, "_plainly": plain}).join(names, (F.col("_plainly") == F.col("_n")) & F.col("t").rlike(SAFE), "left")
    return j.withColumnRenamed("_ni", "_sure").drop("_n")


def canonicalize(df: DataFrame, column: str, reference: DataFrame, key: str = "especie_id", name: str = "especie") -> DataFrame:
    """``df`` with ``forma`` (the one consistent form of a text) and ``forma_id`` (the reference entry it is, -1 if none).

    Null texts give null and -1; empty texts '' and -1. Texts that are a name as they stand are settled in the JVM; all others go through the lattice,
    each kind once a worker. The list is joined, and broadcast only while it is small; the model holds its trigrams and no names.
    Existing columns of these names are replaced.
    """
    listed = cut(_listed(reference, key, name))
    model = name_model(listed.select(F.col("f").alias("n")))
    j = _suspicious(F.col(column), listed, ship(df.drop("forma", "forma_id")))
    plain = j.where(F.col("_sure").isNotNull() | F.col("t").isNull()).withColumns({"forma": F.col("_plainly"), "forma_id": F.coalesce("_sure", F.lit(-1))})
    rest = _matched(j.where(F.col("_sure").isNull() & F.col("t").isNotNull()), listed, model)
    rest = rest.withColumns({"forma": F.col("_forma"), "forma_id": F.coalesce("_id", F.lit(-1))})
    wanted = [*[c for c in df.columns if c not in ("forma", "forma_id")], "forma", "forma_id"]
    return plain.select(*wanted).unionByName(rest.select(*wanted))


def disguised_names(df: DataFrame, row_id: str, column: str, reference: DataFrame, key: str = "especie_id", name: str = "especie") -> DataFrame:
    """Rows whose text looks like a reference entry yet holds other characters: row_id, key.

    Letter case and plain spaces at the ends or repeated are forgiven; a decomposed accent, a letter of another width, style or
    script, a capital I for a small l or the reverse, an invisible character or another space is a disguise. Digits are no letters and never stand
    for one. Null and empty texts are no cases. Only texts that are a name as they stand are passed over unread.
    """
    listed = cut(_listed(reference, key, name))
    model = name_model(listed.select(F.col("f").alias("n")))
    j = _suspicious(F.col("t"), listed, ship(df.select(F.col(row_id).alias("_row"), F.col(column).alias("t"))))
    read_ = _matched(j.where(F.col("_sure").isNull() & F.col("t").isNotNull()), listed, model)
    return read_.where(F.col("_id").isNotNull() & (_plain(F.col("t")) != F.col("_own"))).select(F.col("_row").alias(row_id), F.col("_id").alias(key))
