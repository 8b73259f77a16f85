"""Problem 7: freely typed names mapped to a reference list, misses reported.

The reference's symmetric-delete dictionary (every name with up to DEPTH letters left out) goes to all executors: it grows with the
reference list and not with the data, and a list beyond BLOCK_NAMES is searched block by block, with the same results: blocks share the model, the words
and the annotations of the whole list, and what they find is judged together as one dictionary would. Each different text is resolved once: brought to one form (look-alike letters,
spacing, annotations), then looked up by its own deletions; candidates are ranked by a weighted Damerau-Levenshtein cost,
ties by how often the reference name occurs in the data. Words that annotate names are learned from what is left beside exact names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvara.llm.lookalike import Canonical, NameModel, name_model, plain_form, visible
from silvara.runtime import cut, ship, small

#: Names of a dictionary; a longer reference list is split into blocks of about as many.
BLOCK_NAMES = 100_000
#: Texts of a resolving task.
TASK_TEXTS = 5_000
#: Entries beside which a word must have been left over to count as an annotation.
NOTE_ENTRIES = 3
#: Edit cost allowed by length of the squeezed text: (least length, cost).
ALLOWED = ((12, 3.4), (8, 3.0), (7, 2.4), (5, 2.0), (4, 1.2))
#: Letters left out at most when the dictionary is built; long texts get the deeper one.
DEPTH, DEEP = 2, 3
# Digits typed for letters, letters that sound alike, and rows of the keyboard.
DIGITS = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SOUNDS = ("bv", "sz", "cs", "cz", "ck", "kq", "cq", "iy", "gj", "jh", "nm", "uw", "xs", "ou", "ei")
KEYS = ("qwertyuiop", "asdfghjklñ", "zxcvbnm")
# What sets an annotation apart, and words that say tree or an uncertain name.
NOTES = r"\([^)]*\)|\[[^\]]*\]|;.*$| - .*$"
NOTE_WORDS = frozenset("arbol arb sp spp cf aff ind indet".split())


def fold(text: str) -> str:
    """Small letters without accents; ñ counts as n."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def squeeze(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text)


def _near_keys() -> set[frozenset[str]]:
    near = set()
    for i, row in enumerate(KEYS):
        for j, ch in enumerate(row):
            near.update(frozenset((ch, o)) for o in row[j + 1 : j + 2])
            if i + 1 < len(KEYS):
                near.update(frozenset((ch, o)) for o in KEYS[i + 1][max(0, j - 1) : j + 1])
    return near


CHEAP = {frozenset(p): 0.6 for p in SOUNDS} | {p: 0.8 for p in _near_keys()} | {frozenset((d, c)): 0.3 for d, cs in DIGITS.items() for c in cs}


def cost(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein cost (restricted), at least ``most`` + 1 if it exceeds ``most``.

    A substitution costs less for a digit's letter, letters that sound alike and neighbouring keys; a doubled letter costs a half; swapping two neighbours 0.8.
    """
    if abs(len(a) - len(b)) > 2 * most:
        return most + 1
    before: list[float] = []
    row = [0.0]
    for j in range(1, len(b) + 1):
        row.append(row[-1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        drop = 0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0
        new = [row[0] + drop]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            add = 0.5 if j > 1 and y == b[j - 2] else 1.0
            best = min(row[j - 1] + (0.0 if x == y else CHEAP.get(frozenset((x, y)), 1.0)), row[j] + drop, new[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            new.append(best)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def deletions(s: str, depth: int) -> set[str]:
    """``s`` with up to ``depth`` letters left out."""
    return {"".join(c for i, c in enumerate(s) if i not in out) for d in range(min(depth, max(0, len(s) - 2)) + 1) for out in map(set, combinations(range(len(s)), d))}


class Gazetteer:
    """Finds the entry of a reference list that a typed text stands for. ``notes`` are words that annotate names; a block of a longer list has its ``model`` and ``words``."""

    def __init__(self, names: dict[str, int], frequency: dict[int, int], notes: frozenset[str] = NOTE_WORDS, model: NameModel | None = None, words: frozenset[str] | None = None):
        names = dict(sorted(names.items(), key=lambda x: (-x[1], x[0])))  # of names of one form the smallest id stays
        self.canonical = Canonical(names, model)
        self.frequency, self.notes = frequency, notes
        self.words = {i: fold(n).split() for n, i in names.items()}
        self.form = {i: squeeze(fold(n)) for n, i in names.items()}
        self.known_words = {w for ws in self.words.values() for w in ws} if words is None else words
        self.exact: dict[str, list[int]] = defaultdict(list)
        self.bag: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, f in sorted(self.form.items()):
            self.exact[f].append(i)
            self.bag[tuple(sorted(self.words[i]))].append(i)
        self.sorted_forms = sorted((f, i) for i, f in self.form.items())
        self.first_words = sorted((ws[0], i) for i, ws in self.words.items() if len(ws) > 1)
        self.index: dict[int, dict[str, list[int]]] = {}
        for depth in (DEPTH, DEEP):
            index: dict[str, list[int]] = defaultdict(list)
            for i, f in self.form.items():
                for x in deletions(f, depth):
                    index[x].append(i)
            self.index[depth] = dict(index)
        self.longest = max((len(f) for f in self.form.values()), default=0)

    @cached_property
    def word_index(self) -> dict[str, set[str]]:
        index: dict[str, set[str]] = defaultdict(set)
        for w in self.known_words:
            for x in deletions(w, 1):
                index[x].add(w)
        return index

    def __call__(self, text: str | None) -> tuple[int, float]:
        """Id of the entry and the cost at which it was found; -1 and null cost if none. Null, empty and wordless texts have none."""
        if text is None:
            return -1, float("nan")
        for stage in self.stages(text):
            found = [x for _, near in stage for x in near]
            if found and (min(found)[0] < SURE or (len(found) == 1 and found[0][0] < 2 * SURE)):
                total, _, best = min(found)
                return best, round(total % SURE, 3)
        return -1, float("nan")

    def stages(self, text: str) -> Iterator[list[tuple[int, list[tuple[float, int, int]]]]]:
        """Candidates (cost, less frequency, id) stage by stage, the first stage that holds one deciding. A stage has searches, each with its depth: of a search in
        several blocks only the least depth that found something counts. Candidates of a shortened name have SURE added and decide only if there is one;
        with SURE added twice not even then."""
        form, found = self.canonical(text)
        yield [(self.canonical.reader(text).index(form), [(0.0, 0, found)] if found >= 0 else [])]
        typed = fold(form)
        kept = re.sub(NOTES, " ", typed)
        kept = kept if squeeze(kept) else typed
        words = [w for w in re.split(r"[^a-z0-9.]+", kept) if w.strip(".")]
        plain = self._without_notes(words, self.known_words)
        bare = self._without_notes(words, set())
        readable = [ws for ws in (words, plain, bare) if re.search("[a-z]", " ".join(ws))]
        for orders in self._tried(readable):
            exact = [(0.3 * (n > 0), -self.frequency.get(i, 0), i) for n, order in enumerate(orders) for i in self.exact.get("".join(order), ())]
            yield [(0, exact + [(0.3, -self.frequency.get(i, 0), i) for i in self.bag.get(tuple(sorted(orders[0])), ())])]
        dotted = [w.endswith(".") for w in plain]
        yield [(0, self.shortened([w.replace(".", "") for w in plain], dotted))]
        for orders in self._tried(readable[1:]):
            yield [*[self._near("".join(order), 0.3 * (n > 0)) for n, order in enumerate(orders)], (0, self.word_by_word(orders[0]))]

    def _tried(self, readings: list[list[str]]) -> Iterator[list[tuple[str, ...]]]:
        """Orders of the words of each reading, without points; equal readings once."""
        for k, ws in enumerate(readings):
            if ws not in readings[:k]:
                yield self._orders([w.replace(".", "") for w in ws])

    def _without_notes(self, words: list[str], keep: set[str]) -> list[str]:
        """``words`` without numbers and annotations at the ends; words in ``keep`` stay."""
        out = list(words)
        note = lambda w: w.strip(".").isdigit() or (w.strip(".") in self.notes and w.strip(".") not in keep)
        while len(out) > 1 and note(out[-1]):
            out.pop()
        while len(out) > 1 and note(out[0]):
            out.pop(0)
        return out

    @staticmethod
    def _orders(words: list[str]) -> list[tuple[str, ...]]:
        """Orders of the words that are tried, their own first: all of up to three words; of more their rotations, as word_by_word knows no order."""
        own = tuple(words)
        if len(words) <= 3:
            return [own, *[p for p in permutations(words) if p != own]]
        return [own[k:] + own[:k] for k in range(len(own))]

    def close(self, s: str, extra: float) -> list[tuple[float, int, int]]:
        """Entries within the allowed cost of a squeezed text."""
        return self._near(s, extra)[1]

    def _near(self, s: str, extra: float) -> tuple[int, list[tuple[float, int, int]]]:
        """The letters left out at most when something was found, and what ``close`` gives."""
        if len(s) > self.longest + 2 * ALLOWED[0][1]:  # no entry lies so near, as a letter costs a half at least
            return DEEP, []
        most = allowed(len(s))
        # A short text may be what is left of a longer name, so the longer of both tells what is allowed.
        for depth in (DEPTH, DEEP) if most > 2 else (DEPTH,):
            near = {i for x in deletions(s, depth) for i in self.index[depth].get(x, ())}
            bound = {i: allowed(max(len(s), len(self.form[i]))) for i in near}
            found = [(c + extra, -self.frequency.get(i, 0), i) for c, i in ((cost(s, self.form[i], bound[i]), i) for i in near) if c + extra <= bound[i]]
            if found:
                return depth, found
        return DEEP, []

    def word_by_word(self, words: tuple[str, ...]) -> list[tuple[float, int, int]]:
        """The entry of four words or more whose words are the typed ones, each set right alone, in any order."""
        if len(words) < 4:
            return []
        total, right = 0.0, []
        for w in words:
            near = {x for d in deletions(w, 1) for x in self.word_index.get(d, ())}
            c, best = min(((cost(w, x, 1.2), x) for x in near), default=(9.0, w))
            total += min(c, 9.0)
            right.append(best)
        return [] if total > ALLOWED[0][1] else [(total + 0.3, -self.frequency.get(i, 0), i) for i in self.bag.get(tuple(sorted(right)), ())]

    def shortened(self, words: list[str], dotted: list[bool]) -> list[tuple[float, int, int]]:
        """Entries of which the text is a cut-off beginning, word by word or as a whole."""
        s = "".join(words)
        fits = set()
        if len(s) >= 6:
            k = bisect_left(self.sorted_forms, (s, -(1 << 62)))
            while k < len(self.sorted_forms) and self.sorted_forms[k][0].startswith(s):
                fits.add(self.sorted_forms[k][1])
                k += 1
        if len(words) > 1 and any(dotted):
            k = bisect_left(self.first_words, (words[0], -(1 << 62)))
            while k < len(self.first_words) and self.first_words[k][0].startswith(words[0]):
                i = self.first_words[k][1]
                if len(words) == len(self.words[i]) and all(o.startswith(w) for w, o in zip(words, self.words[i])):
                    fits.add(i)
                k += 1
        return [(SURE + 0.5 if any(dotted) or 2 * len(s) >= len(self.form[i]) else 2 * SURE, -self.frequency.get(i, 0), i) for i in sorted(fits)]

    def left_over(self, text: str) -> list[tuple[str, int]]:
        """Words of three letters or more beside an exact name at the beginning or end of a text, that no name holds, with the name's id; shorter ones may be the beginning of a second word."""
        for part, rest in splits(text):
            if part in self.exact:
                return [(w, self.exact[part][0]) for w in rest if w not in self.known_words]
        return []


#: Added to the cost of a shortened name, so that it is known as such.
SURE = 100.0


def allowed(letters: int) -> float:
    """Edit cost allowed for a squeezed text of so many letters."""
    return next((c for least, c in ALLOWED if letters >= least), 0.0)


def splits(text: str, most: int | None = None) -> Iterator[tuple[str, list[str]]]:
    """Ways to take a text for a name (squeezed, of at most ``most`` letters) at its beginning or end, longer ones first, each with the other words of three letters or more."""
    words = re.findall(r"[a-z0-9]+", fold(plain_form(visible(text))))
    for n in range(len(words) - 1, 0, -1):
        if most is None or sum(map(len, words[:n])) <= most or sum(map(len, words[-n:])) <= most:
            for part, rest in ((words[:n], words[n:]), (words[-n:], words[:-n])):
                if most is None or sum(map(len, part)) <= most:
                    yield "".join(part), [w for w in rest if len(w) > 2 and not w.isdigit()]


def _words(listed: DataFrame) -> frozenset[str]:
    """The different words of all names (column n); only these come to the driver."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": sorted({w for n in b["n"] for w in fold(n).split()})}, columns=["w"])

    return frozenset(r.w for r in ship(listed.select("n")).mapInPandas(parts, "w string").distinct().collect())


def learned_notes(texts: DataFrame, names: dict[str, int] | DataFrame) -> frozenset[str]:
    """Words that annotate names: left over beside at least NOTE_ENTRIES different entries. ``texts`` has a column t, a table of names n and id; texts meet names in a join, for lists of any length."""
    listed = texts.sparkSession.createDataFrame(list(names.items()), "n string, id int") if isinstance(names, dict) else names
    known = _words(listed)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"form": [squeeze(fold(n)) for n in b["n"]], "i": b["id"]})

    named = ship(listed.select("n", "id")).mapInPandas(forms, "form string, i int").groupBy("form").agg(F.min("i").alias("i"))
    longest = named.agg(F.max(F.length("form"))).first()[0] or 0

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, k, part, [w for w in words if w not in known]) for t in b["t"] for k, (part, words) in enumerate(splits(t, longest))]
            yield pd.DataFrame(rows, columns=["t", "k", "form", "w"])

    beside = ship(texts.select("t")).mapInPandas(rest, "t string, k int, form string, w array<string>").join(small(named), "form")
    first = beside.groupBy("t").agg(F.min(F.struct("k", "i", "w")).alias("x")).select("x.i", F.explode("x.w").alias("w"))
    seen = first.groupBy("w").agg(F.countDistinct("i").alias("n")).where(F.col("n") >= NOTE_ENTRIES)
    return NOTE_WORDS | {r.w for r in seen.collect()}


def _in_blocks(texts: DataFrame, listed: DataFrame, blocks: int, notes: frozenset[str]) -> DataFrame:
    """t, id, costo for a list of several dictionaries: each group of texts meets each block of names, whose candidates are then judged together.

    Names of one id share a block. Of each search the least depth that found something in any block counts, as in one dictionary.
    """
    model, words = name_model(listed), _words(listed)
    n = texts.count()
    groups = max(1, n // TASK_TEXTS)
    many = texts.select("t", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("t"), F.lit(groups)).alias("g"))
    parts = listed.select("id", "n", "c", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("g"))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("n")
        gazetteer = Gazetteer(dict(zip(right["n"], right["id"])), dict(zip(right["id"], right["c"])), notes, model, words)
        rows = [(t, k, o, d, *x) for t in left["t"] for k, stage in enumerate(gazetteer.stages(t)) for o, (d, near) in enumerate(stage) for x in sorted(near)[:2]]
        return pd.DataFrame(rows, columns=["t", "k", "o", "d", "c", "f", "i"])

    found = ship(many).groupBy("b", "g").cogroup(parts.groupBy("b", "g")).applyInPandas(lambda x, y: find(x, y), "t string, k int, o int, d int, c double, f long, i int")
    search = found.groupBy("t", "k", "o").agg(F.count("*").alias("m"), F.min(F.struct("d", "c", "f", "i")).alias("x"))
    search = search.where((F.col("x.c") < SURE) | ((F.col("m") == 1) & (F.col("x.c") < 2 * SURE)))
    best = search.groupBy("t").agg(F.min(F.struct("k", F.struct("x.c", "x.f", "x.i").alias("x"))).alias("s"))
    return texts.join(best, "t", "left").select("t", F.coalesce("s.x.i", F.lit(-1)).alias("id"), F.round(F.pmod("s.x.c", F.lit(SURE)), 3).alias("costo"))


def map_names(df: DataFrame, column: str, reference: DataFrame, seen: DataFrame | None = None, key: str = "especie_id", name: str = "especie") -> DataFrame:
    """``df`` with ``key`` (the entry that ``column`` stands for, -1 if none) and ``costo`` (0 for the entry itself, null if none).

    ``seen`` holds data with a column ``name``; how often a name occurs there settles ties, then the smaller id does. Each different text is resolved
    once and joined back. Null, empty and wordless texts have no entry. Columns of these names in ``df`` are replaced.
    """
    listed = reference.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.min(F.col(key).cast("int")).alias("id"))
    if seen is None:
        listed = cut(listed.withColumn("c", F.lit(0).cast("long")))
    else:
        counts = seen.select(F.col(name).alias("n")).join(small(listed.select("n")), "n", "left_semi").groupBy("n").agg(F.count("*").alias("c"))
        listed = cut(listed.join(counts, "n", "left").withColumn("c", F.coalesce("c", F.lit(0))))
    total = listed.count()
    spark = df.sparkSession
    texts = cut(df.select(F.col(column).alias("t")).where(F.col(column).isNotNull()).distinct())
    texts = texts.repartition(texts.count() // TASK_TEXTS + spark.sparkContext.defaultParallelism)
    notes = learned_notes(texts, listed)
    if total <= BLOCK_NAMES:
        rows = sorted(listed.collect())
        names, frequency = {r.n: r.id for r in rows}, {r.id: r.c for r in rows}

        @F.pandas_udf("struct<id:int,costo:double>")
        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            gazetteer = Gazetteer(names, frequency, notes)
            for s in batches:
                yield pd.DataFrame([gazetteer(t) for t in s], columns=["id", "costo"])

        found = ship(texts).withColumn("_g", look_up(F.col("t"))).select("t", "_g.id", F.when(~F.isnan("_g.costo"), F.col("_g.costo")).alias("costo"))
    else:
        found = _in_blocks(texts, listed, -(-total // BLOCK_NAMES), notes)
    found = cut(found).select(F.col("t").alias("_t"), F.col("id").alias("_id"), F.col("costo").alias("_costo"))
    kept = [c for c in df.columns if c not in (key, "costo")]
    j = df.join(small(found), F.col(column) == F.col("_t"), "left")
    return j.select(*kept, F.coalesce("_id", F.lit(-1)).alias(key), F.col("_costo").alias("costo"))
