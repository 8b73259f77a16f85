"""Problem 9: passages of held-out test items found in a corpus by latent semantic retrieval.

Documents become the numbers of their spoken words in the items' vocabulary, misread words set right by skeletons of look-alike letters and a
symmetric-delete dictionary. Passages of PASSAGE words are weighted by TF-IDF, whose document frequencies are counted over the whole corpus, and folded
into a latent space that a distributed randomised SVD of passages gives. The space leaves out the leading directions, which tell language and level
apart but not passages, and evens out the rest. Passages of documents and items meet in buckets of random hyperplanes; pairs of high cosine are
candidates, and only their longest common subsequence and the runs within it, or for paraphrases the item's answer words, make a link.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvara.llm import speech
from silvara.runtime import cut, hashed_sample, ship

#: Words of a passage, and step between the passages of a document, which divides it. A shared run of PASSAGE + DOC_STEP - 1 words holds a whole passage of the document,
#: which meets its twin in the item, as those start at every word.
PASSAGE, DOC_STEP = 15, 5
#: Consecutive words that link a document with an item.
RUN = 20
#: Leading directions left out, directions kept, and the power of the singular value that evens them out.
SKIPPED, KEPT, EVEN = 24, 96, 1.0
#: Tables of random hyperplanes, and hyperplanes of a table.
TABLES, PLANES = 10, 16
#: Cosine from which two passages that met are candidates.
CLOSE = 0.75
#: Documents, about, whose passages fit the SVD, chosen by hashed id. All documents are searched.
FIT_DOCS = 3_000
#: Items searched for at once; more are searched for in blocks of about as many.
BLOCK_ITEMS = 20_000
#: Documents of a search task.
TASK_DOCS = 4_000
#: Words of a close passage in its longest common subsequence with the item from which a candidate is followed, and diagonals of most common words that are.
FOLLOWED, DIAGONALS = 12, 3
#: Share of an item's words that a paraphrase has in a common subsequence; answer words of an item, and their share that a paraphrase must hold.
PARAPHRASED, ANSWER, ANSWERED = 0.6, 6, 0.8
#: Misread words in a row that do not break a run if the words on both sides agree.
FORGIVEN = 2


def skeleton(w: bytes) -> bytes:
    """A word with letters that are misread for each other made one."""
    return w.replace(b"rn", b"m").replace(b"li", b"h").translate(LIKE)


# Letters that misreading confuses.
LIKE = bytes.maketrans(b"0l1ceftbhsz5", b"oiieeffhhsss")


class Vocabulary:
    """Numbers of the items' words. A word that the items lack may be a misread one: of the same skeleton, or one slip away (two if it is long).

    A word of the items has its number, a misread one -2 - its number, and any other -1.
    """

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.index: dict[bytes, list[int]] = defaultdict(list)
        self.skeletons: dict[bytes, list[int]] = defaultdict(list)
        for w, i in self.number.items():
            self.skeletons[skeleton(w)].append(i)
            for d in self._deletions(w):
                self.index[d].append(i)
        self.words = words
        self.longest = max(map(len, words), default=0)
        self.known = dict(self.number)

    @staticmethod
    def _deletions(w: bytes) -> set[bytes]:
        depth = 0 if len(w) < 3 else 1 if len(w) < 7 else 2
        return {bytes(c for i, c in enumerate(w) if i not in out) for d in range(depth + 1) for out in map(set, combinations(range(len(w)), d))}

    def misread(self, w: bytes) -> int:
        if len(w) > self.longest + 2:
            return -1
        same = self.skeletons.get(skeleton(w), ())
        if len(w) > 2 and same:
            return -2 - min(same, key=lambda i: (slips(w, self.words[i]), i))
        best, found = 99, -1
        for d in self._deletions(w):
            for i in self.index.get(d, ()):
                n = slips(w, self.words[i])
                if n < best:
                    best, found = n, i
        return -2 - found if best <= (1 if len(w) < 7 else 2) else -1

    def __call__(self, words: list[bytes]) -> list[int]:
        known = self.known
        out = []
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) > 500_000:
                    self.known = known = dict(self.number)
                n = known[w] = self.misread(w)
            out.append(n)
        return out


def slips(a: bytes, b: bytes) -> int:
    """Edit distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def guessed(codes: np.ndarray) -> np.ndarray:
    """Numbers of the words that codes stand for, -1 where there is none."""
    return np.where(codes < -1, -2 - codes, codes)


def _unit(v: np.ndarray) -> np.ndarray:
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-6)
    return v


def every_passage(items: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, item) of the passages of items, which start at every word. ``weights`` has a last row of zeros for unknown words."""
    parts, owner = [np.zeros((0, weights.shape[1]), dtype=np.float32)], [np.zeros(0, dtype=np.int64)]
    for i, n in enumerate(items):
        if len(n) >= PASSAGE:
            parts.append(weights[np.lib.stride_tricks.sliding_window_view(n, PASSAGE)].sum(1))
            owner.append(np.full(len(parts[-1]), i))
    return _unit(np.concatenate(parts)), np.concatenate(owner)


def passages(texts: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, words, text, start) of the passages of texts, which start at every DOC_STEP-th word; sums of DOC_STEP words serve all passages that hold them."""
    steps = PASSAGE // DOC_STEP
    blocks = np.array([len(t) // DOC_STEP for t in texts], dtype=np.int64)
    words = np.concatenate([*[t[: n * DOC_STEP] for t, n in zip(texts, blocks)], np.zeros(0, dtype=np.int64)])
    sums = weights[words].reshape(-1, DOC_STEP, weights.shape[1]).sum(1)
    owner = np.repeat(np.arange(len(texts)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.flatnonzero(within <= np.repeat(blocks, blocks) - steps)
    v = sum((sums[first + k] for k in range(1, steps)), sums[first])
    return _unit(v), words[first[:, None] * DOC_STEP + np.arange(PASSAGE)], owner[first], within[first] * DOC_STEP


def common_words(text: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of a text and an item of ``size`` words, whose places of each word are the bits of ``masks``."""
    full = (1 << size) - 1
    row = full
    for w in text:
        m = masks.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def stretches(text: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """Stretches of an item (first word, word after the last) that a text speaks along a diagonal. Up to FORGIVEN misread words in a row do not
    end one if the words on both sides agree; a misread word agrees with the word it is taken for."""
    lo, hi = max(0, diagonal), min(len(text), len(item) + diagonal)
    if hi <= lo:
        return []
    a, b = text[lo:hi], item[lo - diagonal : hi - diagonal]
    same = guessed(a) == b
    unsure = a < 0
    whole = same.copy()
    for gap in range(1, FORGIVEN + 1):
        if len(same) >= gap + 2:
            inner = np.ones(len(same) - gap - 1, dtype=bool)
            for k in range(1, gap + 1):
                inner &= unsure[k : len(same) - gap - 1 + k]
            ok = np.flatnonzero(inner & same[: -gap - 1] & same[gap + 1 :])
            for k in range(1, gap + 1):
                whole[ok + k] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], whole.astype(np.int8), [0]])))
    return [(int(x) + lo - diagonal, int(y) + lo - diagonal) for x, y in zip(edges[::2], edges[1::2])]


def shared_run(text: np.ndarray, item: np.ndarray, diagonals: list[int]) -> int:
    """Longest run of an item's words that a text speaks along one diagonal, or along several in turn if what the text puts between holds no readable word."""
    parts: list[tuple[int, int, int]] = []
    best = 0
    for d in diagonals:
        mine = stretches(text, item, d)
        parts += [(x, y, d) for x, y in mine]
        best = max([best, *(y - x for x, y in mine)])
        if best >= RUN:
            return best
    parts.sort()
    if best + sum(sorted(y - x for x, y, _ in parts)[-4:-1]) < RUN or len(parts) < 2:
        return best
    # Only where the text puts in unread words can stretches of two diagonals be one run.
    reach: list[int] = []
    for n, (x, y, d) in enumerate(parts):
        run = y - x
        for (px, py, pd), so_far in zip(parts[:n], reach):
            between = text[py + pd : x + d]
            if 0 <= x - py <= FORGIVEN and d > pd and len(between) and (between == -1).all():
                run = max(run, so_far + y - py)
        reach.append(run)
    return max([best, *reach])


class Searcher:
    """Links texts with items."""

    def __init__(self, items: list[tuple[int, list[int]]], weights: np.ndarray, rarity: np.ndarray, seed: int = 11):
        self.keys = [k for k, _ in items]
        self.own = [np.array(n, dtype=np.int64) for _, n in items]
        self.vectors, self.owner = every_passage(self.own, weights)
        self.weights = weights
        # Which words each item holds, as one sorted list.
        self.held = np.unique(np.concatenate([*[i * len(weights) + n for i, n in enumerate(self.own)], np.zeros(0, dtype=np.int64)]))
        self.planes = np.random.default_rng(seed).standard_normal((weights.shape[1], TABLES * PLANES)).astype(np.float32)
        codes = self._codes(self.vectors)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)
        self.masks, self.answers = [], []
        for n in self.own:
            masks: dict[int, int] = {}
            for i, w in enumerate(n.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            self.answers.append(sorted(masks, key=lambda w: (-rarity[w], w))[:ANSWER])

    def _codes(self, v: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        side = (v @ self.planes > 0).reshape(len(v), TABLES, PLANES)
        return (side @ (1 << np.arange(PLANES))).astype(np.int32)

    def _met(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of passages (of the texts, of the items) that share a bucket, each once."""
        codes = self._codes(v)
        found = []
        for t in range(TABLES):
            lo = np.searchsorted(self.sorted[:, t], codes[:, t], side="left")
            n = np.searchsorted(self.sorted[:, t], codes[:, t], side="right") - lo
            mine = np.repeat(np.arange(len(v)), n)
            place = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(mine * len(self.vectors) + self.order[place, t])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.vectors)))

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first and last start of its close passages in the text, highest cosine)."""
        v, core, owner, at = passages([guessed(t) for t in texts], self.weights)
        if not len(v) or not len(self.vectors):
            return []
        a, b = self._met(v)
        cosine = np.einsum("ij,ij->i", v[a], self.vectors[b])
        near = cosine >= CLOSE
        a, b, cosine = a[near], self.owner[b[near]], cosine[near]
        # One row a passage and item, with the highest cosine.
        order = np.lexsort((-cosine, b, a))
        a, b, cosine = a[order], b[order], cosine[order]
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        a, b, cosine = a[once], b[once], cosine[once]
        # No more words can be in common than the item holds at all.
        wanted = b[:, None] * len(self.weights) + core[a]
        most = ((self.held[np.minimum(np.searchsorted(self.held, wanted), len(self.held) - 1)] == wanted) & (core[a] >= 0)).sum(1)
        a, b, cosine = a[most >= FOLLOWED], b[most >= FOLLOWED], cosine[most >= FOLLOWED]
        found: dict[tuple[int, int], list] = {}
        for t, i, p, c, ws in zip(owner[a].tolist(), b.tolist(), at[a].tolist(), cosine.tolist(), core[a].tolist()):
            if common_words(ws, self.masks[i], len(self.own[i])) < FOLLOWED:
                continue
            spans = found.setdefault((t, i), [])
            if spans and p - spans[-1][1] <= PASSAGE + len(self.own[i]):
                spans[-1][1], spans[-1][2] = p, max(spans[-1][2], c)
            else:
                spans.append([p, p, c])
        return [(t, i, *s) for (t, i), spans in found.items() for s in spans]

    def __call__(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float, str]]:
        """(text, item key, run, longest common subsequence, cosine, kind) of the links of some texts."""
        best: dict[tuple[int, int], tuple] = {}
        for t, i, p, q, c in self.candidates(texts):
            item = self.own[i]
            lo = max(0, p - len(item))
            part = texts[t][lo : q + PASSAGE + len(item)]
            words = guessed(part)
            told_by = words.tolist()
            # Diagonals that hold enough of the common words.
            x, y = np.nonzero(words[:, None] == item)
            n = np.bincount(x - y + len(item))
            held = np.flatnonzero(n >= RUN // 4)
            held = held[np.argsort(-n[held], kind="stable")][:DIAGONALS]
            run = shared_run(part, item, (held - len(item)).tolist()) if n[held].sum() >= FOLLOWED else 0
            kind = "literal" if run >= RUN else ""
            if not kind:
                said = set(told_by)
                if sum(w in said for w in self.answers[i]) < ANSWERED * len(self.answers[i]) or len(said & self.masks[i].keys()) < PARAPHRASED * len(self.masks[i]):
                    continue
            common = common_words(told_by, self.masks[i], len(item))
            if not kind and common >= PARAPHRASED * len(item):
                kind = "parafrasis"
            if kind and (run, common) > best.get((t, i), ((-1, -1),))[0]:
                best[t, i] = ((run, common), c, kind)
        return [(t, self.keys[i], run, common, c, kind) for (t, i), ((run, common), c, kind) in best.items()]


def _numbered(docs: DataFrame, words: list[bytes], key: str, text: str) -> DataFrame:
    """``key`` and ``n``: codes of each document's spoken words."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        for batch in batches:
            lists = [vocabulary(speech.words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, type=pa.list_(pa.int32()))], names=[key, "n"])

    return ship(docs.select(key, text)).mapInArrow(run, schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of some texts end to end, and where each text ends."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))


def document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each word occurs, over all of them. Each partition sends one row a word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            w, owner = guessed(flat), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            total += np.bincount(np.unique((owner * size + w)[w >= 0]) % size, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["w", "c"])

    df = np.zeros(size)
    for w, c in table.select("n").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c")).collect():
        df[w] = c
    return df


def _sparse(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, weights) of the passages of some texts that follow each other, one row a passage: TF-IDF of length 1, repeated words adding up."""
    flat, ends = _flat(lists)
    w = guessed(flat)
    at = np.concatenate([np.arange(a, b - PASSAGE + 1, PASSAGE) for a, b in zip(ends[:-1], ends[1:])] or [np.zeros(0, dtype=np.int64)])
    rows = w[at[:, None] + np.arange(PASSAGE)]
    part = np.where(rows < 0, 0.0, idf[rows])
    norm = np.sqrt((part[:, :, None] * part[:, None, :] * (rows[:, :, None] == rows[:, None, :])).sum((1, 2)))
    return np.where(rows < 0, 0, rows), part / np.maximum(norm, 1e-9)[:, None]


def _products(rows: DataFrame, idf: np.ndarray, right: np.ndarray, gram: bool) -> np.ndarray:
    """Sum over partitions of A'(A right), or with ``gram`` of (A right)'(A right), where A holds the TF-IDF passages of ``rows`` and is kept sparse.

    One matrix as small as ``right`` comes from each partition; ``rows`` is bounded, so their number is.
    """
    size, width = right.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width if gram else size, width))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                words, part = _sparse(batch.column(0).slice(a, 64), idf)
                image = np.einsum("ij,ijk->ik", part, right[words])
                if gram:
                    total += image.T @ image
                else:
                    flat, order = words.ravel(), np.argsort(words.ravel(), kind="stable")
                    own, first = np.unique(flat[order], return_index=True)
                    back = (part[:, :, None] * image[:, None, :]).reshape(-1, width)[order]
                    if len(own):
                        total[own] += np.add.reduceat(back, first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    parts = rows.mapInArrow(run, "m binary").collect()
    return sum((np.frombuffer(p.m).reshape(-1, width) for p in parts), np.zeros((width if gram else size, width)))


def latent_weights(rows: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Latent vector of each word by a randomised SVD of the passages of ``rows`` (column n): a random range, one power step, and a small eigenproblem."""
    size = len(idf)
    width = min(size, SKIPPED + KEPT + 16)
    q = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(2):
        q = np.linalg.qr(_products(rows, idf, q, False))[0]
    values, vectors = np.linalg.eigh(_products(rows, idf, q, True))
    order = np.argsort(-values)
    skip = SKIPPED if width > SKIPPED + 8 else 0
    order = order[skip : skip + KEPT]
    scale = np.maximum(values[order], 1e-9 * max(values.max(), 1e-9)) ** (-EVEN / 2)
    return (idf[:, None] * (q @ vectors[:, order]) * scale).astype(np.float32)


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Documents that speak passages of items: ``key``, ``item_key``, ``tipo``, ``palabras`` (the longest run), ``comunes`` (the longest common subsequence) and ``coseno`` (of the closest passages).

    ``tipo`` is 'literal' for at least RUN consecutive words of the item, else 'parafrasis' for a common subsequence of PARAPHRASED of its words that
    holds its answer: ANSWERED of its ANSWER rarest words. Case, punctuation, accents, cue layout, labels, tags, sounds, adverts, wrong encodings and misread characters do not break a
    run. Null, empty and shorter texts have no links, on either side; without items or documents there are none. Rows are linked each by its own ``key``, equal texts alike. Extra columns are ignored.
    Items beyond BLOCK_ITEMS are searched for in blocks, each against all documents.
    """
    items = items.where(F.col(text).isNotNull()).select(item_key, text)
    blocks = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    found = [_block(docs, items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b) if blocks > 1 else items, key, item_key, text) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str) -> DataFrame:
    """``leaked_items`` of one block of items, which is bounded and goes to all executors."""
    spark = docs.sparkSession
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, tipo string, palabras int, comunes int, coseno double"
    said = [(r[0], speech.plain_words(r[1])) for r in items.collect()]
    said = [(k, w) for k, w in said if len(w) >= RUN]
    if not said:
        return spark.createDataFrame([], schema)
    words = sorted({w for _, ws in said for w in ws})
    size = len(words)
    number = {w: i for i, w in enumerate(words)}
    tasks = max(docs.count() // TASK_DOCS, 1) + spark.sparkContext.defaultParallelism
    table = cut(_numbered(docs, words, key, text).repartition(tasks))
    df = document_frequencies(table, size)
    idf = np.log((max(df.max(), 1) + 1) / (df + 1)) + 1.0
    sample = hashed_sample(table, key, FIT_DOCS).select("n").unionByName(spark.createDataFrame([([number[w] for w in ws],) for _, ws in said], "n array<int>")).repartition(8)
    latent = latent_weights(cut(sample), idf)
    weights = np.vstack([latent, np.zeros((1, latent.shape[1]), dtype=np.float32)])
    coded = [(k, [number[w] for w in ws]) for k, ws in said]
    kinds = pa.schema([pa.field(key, pa.int64()), pa.field(item_key, pa.int64()), pa.field("tipo", pa.string()), pa.field("palabras", pa.int32()), pa.field("comunes", pa.int32()), pa.field("coseno", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(coded, weights, idf)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            flat, ends = _flat(batch.column(1))
            for a in range(0, len(keys), 64):
                texts = [flat[ends[i] : ends[i + 1]] for i in range(a, min(a + 64, len(keys)))]
                found = searcher(texts)
                if found:
                    rows = [(keys[a + t], k, kind, r, m, c) for t, k, r, m, c, kind in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return ship(table).mapInArrow(run, schema)
