"""Problem 10: reading level of documents by gradient-boosted regression trees.

Features describe the distributions of word lengths, vocabulary, sentences and cohesion of what a document speaks. The trees are fitted on a
bounded sample of labelled documents, their scores calibrated to grades by cuts that are fitted on held-out scores, and the calibrated
predictions cross-validated by source: whole sources are held out. Every document is scored where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvara.llm import speech
from silvara.llm.boosting import Boosted
from silvara.runtime import hashed_sample, ship, small

#: Labelled documents, about, that the model is fitted on, chosen by hashed id.
FIT_DOCS = 6_000
#: Documents with at most so many spoken words have no level.
LEAST_WORDS = 40
SENTENCES = re.compile(r"[.!?…]+")
# Frequent short words of the languages, and words that tie clauses together.
FUNCTION = frozenset(b"el la los las un una de del en y a que se con por para su al es lo the of and to in is it that with for on at by an as be this o os as um uma do da no na e em com para ao".split())
TIES = frozenset(b"porque aunque mientras cuando pero si como pues donde mediante durante segun sobre because although while when but if unless whereas since until after before through despite embora enquanto quando mas se como pois conforme durante mediante obstante sin embargo however therefore consequently thus portanto entretanto contudo".split())
LENGTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16)
NAMES = tuple(
    ["words", "mean_length", "sd_length", "q50", "q75", "q90", "q97", "content_mean"]
    + [f"over_{n}" for n in LENGTHS]
    + ["types", "types_100", "hapax", "function", "ties", "ties_sentence", "sentence_mean", "sentence_sd", "sentence_max", "commas", "marks", "overlap", "repeat", "long_types", "syllables"]
)


def features(text: str | None) -> list[float] | None:
    """Features of a document's speech, null if it speaks LEAST_WORDS words or fewer."""
    said = speech.spoken(text)
    folded = speech.fold(said)
    ws = folded.translate(speech.PARTS).split()
    n = len(ws)
    if n <= LEAST_WORDS:
        return None
    size = np.fromiter(map(len, ws), dtype=np.int64, count=n)
    hist = np.bincount(size, minlength=64)
    over = 1 - hist.cumsum() / n
    mean = size.mean()
    q = np.searchsorted(hist.cumsum() / n, (0.5, 0.75, 0.9, 0.97))
    bag: dict[bytes, int] = {}
    for w in ws:
        bag[w] = bag.get(w, 0) + 1
    kinds = np.fromiter(map(len, bag), dtype=np.int64, count=len(bag))
    function = sum(c for w, c in bag.items() if w in FUNCTION)
    ties = sum(c for w, c in bag.items() if w in TIES)
    content = size[size > 3]
    sentences = [len(s.translate(speech.PARTS).split()) for s in re.split(rb"[.!?]+", folded)]
    long = np.array([x for x in sentences if x > 0] or [n])
    vowels = sum(map(folded.count, (b"a", b"e", b"i", b"o", b"u")))
    half = n // 2
    a, b = {w for w in ws[:half] if len(w) > 3}, {w for w in ws[half:] if len(w) > 3}
    return [
        n, mean, size.std(), *q.tolist(), content.mean() if len(content) else 0.0,
        *[over[k] for k in LENGTHS],
        len(bag) / n, len(set(ws[:100])) / min(n, 100), sum(c == 1 for c in bag.values()) / n, function / n, ties / n, ties / len(long),
        long.mean(), long.std(), long.max(), folded.count(b",") / n, len(long) / n, len(a & b) / max(1, len(a | b)), max(bag.values()) / n, (kinds > 8).mean(), vowels / n,
    ]


def feature_table(df: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``also`` and ``x`` (array of double) of every document with more than LEAST_WORDS spoken words."""
    kept = [key, *also]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(len(kept)).to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) if f is not None], type=pa.int64())
            x = pa.array([f for f in found if f is not None], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(kept))], x], names=[*kept, "x"])

    return ship(df.select(*kept, text)).mapInArrow(run, schema)


@dataclass
class GradeModel:
    """Boosted score and the cuts between grades."""

    boosted: Boosted
    cuts: np.ndarray
    grades: np.ndarray
    accuracy: dict[str, float]
    bias: dict[str, float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.grades[np.searchsorted(self.cuts, self.boosted.predict(x), side="right")]


def best_cuts(score: np.ndarray, y: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Cut between each two neighbouring grades that misplaces fewest of their scores."""
    cuts = []
    for a, b in zip(grades[:-1], grades[1:]):
        pair = (y == a) | (y == b)
        s, up = score[pair], y[pair] == b
        order = np.argsort(s, kind="stable")
        s, up = s[order], up[order]
        wrong = np.append(0, up.cumsum()) + np.append(0, (~up)[::-1].cumsum())[::-1]
        k = np.flatnonzero(wrong == wrong.min())
        k = int(k[len(k) // 2])
        cuts.append((s[k - 1] + s[k]) / 2 if 0 < k < len(s) else (a + b) / 2)
    return np.maximum.accumulate(np.array(cuts))


def source_folds(source: np.ndarray, folds: int) -> np.ndarray:
    """A fold of each row: whole sources together, the largest first to the emptiest fold. With a single source the rows take turns, as nothing else can be held out."""
    names, counts = np.unique(source, return_counts=True)
    if len(names) < 2:
        return np.arange(len(source)) % folds
    load, of = np.zeros(min(folds, len(names))), {}
    for k in np.argsort(-counts, kind="stable"):
        of[names[k]] = int(load.argmin())
        load[of[names[k]]] += counts[k]
    return np.array([of[s] for s in source.tolist()])


def _held_out(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's score by trees that saw no row of its fold."""
    held = np.full(len(y), y.mean())
    for k in np.unique(fold):
        if (fold != k).any():
            held[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return held


def fit(x: np.ndarray, y: np.ndarray, source: np.ndarray, folds: int = 5) -> GradeModel:
    """Fit on all rows, with cuts between grades that are calibrated on held-out scores of mixed folds.

    The predictions are cross-validated by source: a source is scored by trees that saw none of its rows, and graded by cuts calibrated on
    the others. ``accuracy`` and ``bias`` (mean score less grade) tell that of all and of each source, ``accuracy['mixed']`` that of the mixed folds.
    """
    grades = np.unique(y)
    graded = lambda cuts, score: grades[np.searchsorted(cuts, score, side="right")]
    mixed = _held_out(x, y, np.arange(len(y)) % folds)
    cuts = best_cuts(mixed, y, grades)
    fold = source_folds(source, folds)
    held = _held_out(x, y, fold)
    given = np.full(len(y), np.nan)
    for k in np.unique(fold):
        rest = fold != k
        given[~rest] = graded(best_cuts(mixed[rest], y[rest], grades) if rest.any() else cuts, held[~rest])
    parts = {"held_out": np.ones(len(y), dtype=bool)} | {f"source:{s}": source == s for s in np.unique(source)}
    accuracy = {k: float((given == y)[m].mean()) for k, m in parts.items()} | {"mixed": float((graded(cuts, mixed) == y).mean())}
    return GradeModel(Boosted().fit(x, y), cuts, grades, accuracy, {k: float((held - y)[m].mean()) for k, m in parts.items()})


def fit_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", level: str = "nivel", docs_at_most: int = FIT_DOCS) -> GradeModel | None:
    """The model of the labelled documents; null if there are none. About ``docs_at_most`` labelled documents reach the driver, as feature rows."""
    chosen = hashed_sample(labels.where(F.col(level).isNotNull()), key, docs_at_most).select(key, level)
    source = F.coalesce(F.col("source").cast("string"), F.lit("?")) if "source" in docs.columns else F.lit("?")
    marked = docs.select(key, "text", source.alias("_source")).join(small(chosen), key)
    rows = feature_table(marked, key=key, also=(level, "_source")).orderBy(F.xxhash64(key)).toPandas()
    if not len(rows):
        return None
    return fit(np.array(rows["x"].tolist()), rows[level].to_numpy().astype(float), rows["_source"].to_numpy().astype(str))


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", level: str = "nivel") -> DataFrame:
    """``key`` and ``level`` of every document with more than LEAST_WORDS spoken words that has no label.

    Null, empty and nearly speechless texts have no level. Without any label there is no model and no row. Null keys match no label. Documents are
    scored where they lie, and only keys and levels meet the labels: no text is shuffled, and nothing that grows is broadcast.
    """
    model = fit_levels(docs, labels, key, level)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {level} int"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            x = np.array([found[i] for i in keep]).reshape(len(keep), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, type=pa.int64())), pa.array(model.predict(x).astype(np.int32))], names=[key, level])

    scored = ship(docs.select(key, "text")).mapInArrow(run, schema)
    return scored.join(labels.select(key).hint("merge"), key, "left_anti")
