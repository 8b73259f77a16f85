"""Problem 8: a corpus encoded with a public byte-level BPE vocabulary through a minimal acyclic transducer.

Frequent words with their ids are compiled into an automaton that shares beginnings and endings. Its arcs carry numbers whose sum along a
word is the word's place in the table of ids. The arrays are written to one file, which goes to every executor and is
memory-mapped there. A batch of documents is cut into words and walked through the automaton as whole arrays; words
that it lacks are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import json
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvara.runtime import ensure_checkpoint_dir, hashed_sample, ship

#: The lexicon is built from the words of about LEXICON_DOCS documents, chosen by hashed id; it only sets the speed, as other words are merged exactly.
LEXICON_DOCS = 2_000
#: Most frequent words kept in the lexicon.
LEXICON_WORDS = 60_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# What the vocabulary's pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a public vocabulary's file: in ``folder`` or with the installed public tokenizers."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of least rank is merged, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        pairs = [(ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
        rank, _ = min(pairs)
        if rank == 1 << 60:
            break
        merged, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get(parts[i] + parts[i + 1]) == rank:
                merged.append(parts[i] + parts[i + 1])
                i += 2
            else:
                merged.append(parts[i])
                i += 1
        parts = merged
    return [ranks[p] for p in parts]


def long_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long words: a heap of pairs, so that the time grows as n log n."""
    import heapq

    n = len(word)
    after, before, start = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(n + 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if i < n and alive[i] else n
        if j >= n or not alive[i] or end[j] != stop:
            continue
        end[i] = stop
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[start[a] : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


def character_classes() -> np.ndarray:
    """Class of every code point as the pattern's engine sees it."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, code in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = np.frombuffer("".join(regex.findall(pattern, points)).encode("utf-32-le"), dtype=np.uint32)
        out[found] = code
    return out


def split_words(cp: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the words of texts laid end to end; ``first`` marks the first character of each text.

    The pattern's rules on arrays: a run of one class is a word, with a plain space before it; of a run of white space all but the last
    character are a word, and the last one too unless it is a plain space that the next word takes; white space at a text's end is one word;
    an apostrophe at the start of a word takes its suffix.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    k = cls[cp]
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(k[1:], k[:-1], out=change[1:])
    change |= first
    space = k == SPACE
    last_of_run = np.empty(n, dtype=bool)  # the next character starts another run or text
    last_of_run[:-1] = change[1:]
    last_of_run[-1] = True
    text_end = np.empty(n, dtype=bool)
    text_end[:-1] = first[1:]
    text_end[-1] = True
    tail = space & last_of_run & ~text_end  # last white space before a word
    start = change | tail
    taken = tail & (cp == 32)
    after = np.flatnonzero(taken) + 1
    start[after] = False  # the word starts at its space
    # Suffixes.
    at = np.flatnonzero((cp == 39) & start)
    at = at[at + 1 < n]
    if len(at):
        at = at[(k[at + 1] == LETTER) & ~first[at + 1]]
        for p in at.tolist():
            if not start[p]:
                continue
            for suffix in SUFFIXES:
                stop = p + 1 + len(suffix)
                if stop <= n and cp[p + 1 : stop].tolist() == [ord(c) for c in suffix] and not first[p + 1 : stop].any():
                    start[p + 1 : stop] = False
                    if stop < n and not start[stop]:
                        start[stop] = True
                    break
    return np.flatnonzero(start)


class Builder:
    """Minimal acyclic automaton of words given in order; equal endings are kept once."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.final: list[bool] = [False]
        self.register: dict[tuple, int] = {}
        self.open: list[tuple[int, int, int]] = []  # (parent, symbol, child) along the last word
        self.last: tuple[int, ...] = ()

    def add(self, word: tuple[int, ...]) -> None:
        common = 0
        while common < min(len(word), len(self.last)) and word[common] == self.last[common]:
            common += 1
        self._close(common)
        state = self.open[-1][2] if self.open else 0
        for symbol in word[common:]:
            self.arcs.append({})
            self.final.append(False)
            child = len(self.arcs) - 1
            self.arcs[state][symbol] = child
            self.open.append((state, symbol, child))
            state = child
        self.final[state] = True
        self.last = word

    def _close(self, keep: int) -> None:
        while len(self.open) > keep:
            parent, symbol, child = self.open.pop()
            key = (self.final[child], tuple(sorted(self.arcs[child].items())))
            twin = self.register.setdefault(key, child)
            if twin != child:
                self.arcs[parent][symbol] = twin

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next, number, final): tables over states and symbols; next is 0 where there is no arc."""
        self._close(0)
        order = [0]
        place = {0: 1}  # state 0 of the tables is the dead one
        for state in order:
            for child in self.arcs[state].values():
                if child not in place:
                    place[child] = len(order) + 1
                    order.append(child)
        symbols = 1 + max((s for state in order for s in self.arcs[state]), default=0)
        nxt, number = np.zeros((len(order) + 1, symbols), dtype=np.int32), np.zeros((len(order) + 1, symbols), dtype=np.int32)
        words = np.zeros(len(order) + 1, dtype=np.int64)
        depth_first: list[int] = []
        seen: set[int] = set()
        stack: list[tuple[int, bool]] = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                depth_first.append(state)
            elif state not in seen:
                seen.add(state)
                stack.append((state, True))
                stack.extend((c, False) for c in self.arcs[state].values() if c not in seen)
        for state in depth_first:  # children first
            total = int(self.final[state])
            for symbol in sorted(self.arcs[state]):
                child = self.arcs[state][symbol]
                nxt[place[state], symbol] = place[child]
                number[place[state], symbol] = total
                total += words[place[child]]
            words[place[state]] = total
        final = np.zeros(len(order) + 1, dtype=bool)
        for state in order:
            final[place[state]] = self.final[state]
        return nxt, number, final


def compile_lexicon(counts: Counter[str], ranks: dict[bytes, int], words: int, folder: str) -> str:
    """Compile the most frequent words and write the arrays into one file in ``folder``."""
    chosen = sorted(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words] if w)
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for w in chosen for c in w}))}
    symbol = np.zeros(0x110000, dtype=np.int32)
    for c, i in alphabet.items():
        symbol[ord(c)] = i
    coded = sorted((tuple(alphabet[c] for c in w), w) for w in chosen)
    builder = Builder()
    ids: list[int] = []
    offsets = [0]
    for key, w in coded:
        builder.add(key)
        ids.extend(merge(w.encode(), ranks))
        offsets.append(len(ids))
    nxt, number, final = builder.finish()
    parts = {"next": nxt, "number": number, "final": final, "symbol": symbol, "ids": np.array(ids, dtype=np.int32), "offsets": np.array(offsets, dtype=np.int64), "classes": character_classes()}
    path = f"{folder}/{Path(folder).name}.lexicon"
    write_arrays(path, parts)
    return path


def write_arrays(path: str, parts: dict[str, np.ndarray]) -> None:
    """Arrays in one file: a line that says where each lies, then their bytes, each at a multiple of 64."""
    at, head = 0, {}
    for name, a in parts.items():
        head[name] = (a.dtype.str, list(a.shape), at)
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line = line.ljust(-(-(len(line) + 1) // 64) * 64 - 1) + b"\n"
    with open(path, "wb") as out:
        out.write(line)
        for a in parts.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 64))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, memory-mapped."""
    with open(path, "rb") as file:
        line = file.readline()
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    out = {}
    for name, (kind, shape, at) in json.loads(line).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[len(line) + at : len(line) + at + size].view(kind).reshape(shape)
    return out


class Encoder:
    """Encodes batches with a memory-mapped lexicon."""

    def __init__(self, path: str, ranks_path: str):
        arrays = map_arrays(path)
        self.next, self.number, self.final, self.symbol = arrays["next"], arrays["number"], arrays["final"], arrays["symbol"]
        self.ids, self.offsets, self.classes = arrays["ids"], arrays["offsets"], arrays["classes"]
        self.cells, self.adds, self.width = self.next.reshape(-1), self.number.reshape(-1), self.next.shape[1]
        self.ranks_path, self.ranks, self.cache = ranks_path, None, {}

    def unseen(self, word: str) -> list[int]:
        if word not in self.cache:
            if self.ranks is None:
                self.ranks = read_ranks(self.ranks_path)
            if len(self.cache) > 200_000:
                self.cache.clear()
            raw = word.encode()
            self.cache[word] = (merge if len(raw) < 200 else long_merge)(raw, self.ranks)
        return self.cache[word]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end)."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(cp) + 1, dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        starts = split_words(cp, self.classes, first[:-1])
        ends = np.append(starts[1:], len(cp))[: len(starts)]
        symbols = self.symbol[cp]
        state = np.ones(len(starts), dtype=np.int64)
        place = np.zeros(len(starts), dtype=np.int64)
        walking, at = np.arange(len(starts)), starts.copy()
        stop, here, total = ends, state.copy(), place.copy()
        while len(walking):
            cell = here * self.width + symbols[at]
            total = total + self.adds[cell]
            here = self.cells[cell].astype(np.int64)
            at = at + 1
            done = (at == stop) | (here == 0)
            if done.any():
                state[walking[done]], place[walking[done]] = here[done], total[done]
                go = ~done
                walking, at, stop, here, total = walking[go], at[go], stop[go], here[go], total[go]
        known = self.final[state] & (state > 0)
        sizes = np.where(known, self.offsets[place + known] - self.offsets[place], 0)
        strange = np.flatnonzero(~known)
        merged: list[list[int]] = []
        if len(strange):
            merged = [self.unseen(joined[a:b]) for a, b in zip(starts[strange].tolist(), ends[strange].tolist())]
            sizes[strange] = [len(m) for m in merged]
        stops = np.cumsum(sizes)
        out = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.int32)
        begin = stops - sizes
        width = int(sizes[known].max()) if known.any() else 0
        for j in range(width):
            has = np.flatnonzero(known & (sizes > j))
            out[begin[has] + j] = self.ids[self.offsets[place[has]] + j]
        for i, m in zip(begin[strange].tolist(), merged):
            out[i : i + len(m)] = m
        bounds = np.searchsorted(starts, np.cumsum(lengths))
        text_ends = np.append(0, stops)[bounds]
        return out, text_ends


def fit_lexicon(df: DataFrame, text: str, key: str, ranks: dict[bytes, int], docs: int = LEXICON_DOCS, words: int = LEXICON_WORDS) -> str:
    """Compile the lexicon from a hashed sample of documents and send it to all executors; returns its name there."""
    cls = character_classes()
    counts: Counter[str] = Counter()
    chosen = hashed_sample(df.where(F.col(text).isNotNull()), key, docs).select(text)
    for (t,) in chosen.collect():  # about ``docs`` rows, which a parameter bounds
        cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(cp), dtype=bool)
        first[:1] = True
        starts = split_words(cp, cls, first)
        counts.update(t[a:b] for a, b in zip(starts.tolist(), np.append(starts[1:], len(cp)).tolist()))
    spark = df.sparkSession
    with tempfile.TemporaryDirectory(prefix="silvara-lexicon-") as folder:  # on the driver, until the file is in the shared folder
        built = Path(compile_lexicon(counts, ranks, words, folder))
        name = f"silvara-{uuid.uuid4().hex}-{built.name}"
        jvm = spark._jvm.org.apache.hadoop.fs
        shared = jvm.Path(f"{ensure_checkpoint_dir(spark)}/{name}")
        files = shared.getFileSystem(spark._jsc.hadoopConfiguration())
        files.copyFromLocalFile(True, jvm.Path(f"file://{built}"), shared)
    spark.sparkContext.addFile(files.makeQualified(shared).toString())
    return name


def encode_corpus(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document by a byte-level BPE vocabulary: ``key`` and ``ids`` (array of int), without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list. Texts are encoded whole, whatever their
    length. ``vocabulary`` is the path of a file of ranks, by default byte_bpe_50k's; it must be present on the executors.
    Rows with equal keys are encoded each; extra columns are dropped.
    """
    ranks_path = vocabulary or vocabulary_path()
    name = fit_lexicon(df, text, key, read_ranks(ranks_path))
    key_type = pa.int64() if df.schema[key].dataType.typeName() in ("long", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(name), ranks_path)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                ids, ends = encoder(texts[a : a + 256])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(a, 256) if key_type is None else keys.slice(a, 256).cast(key_type), lists], names=[key, "ids"])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>"
    return ship(df.select(key, text)).mapInArrow(run, schema)


def token_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """The vocabulary as a table: id and its bytes."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(vocabulary or vocabulary_path()).items()], "id int, bytes binary")
