"""Corpus encoding, spoken words, leaked passages and reading levels."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from silvara.llm import leakage, lexicon, reading, speech

RANKS = lexicon.read_ranks(lexicon.vocabulary_path())
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    from collections import Counter

    path = lexicon.compile_lexicon(Counter([" the", "the", "thes", " casa", "casas", "0", ":", "\n", " 12"]), RANKS, 100, str(tmp_path_factory.mktemp("lex")))
    return lexicon.Encoder(path, lexicon.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'strevlmd \n\t\xa0é1２!.漢😀　<|>", max_size=40), min_size=1, max_size=5))
def test_encoding_equals_the_public_library(encoder, texts):
    ids, ends = encoder(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [PUBLIC.encode_ordinary(t) for t in texts]


def test_encoding_of_odd_texts(spark):
    texts = ["<|endoftext|> la casa's", None, "", " \n ", "x" * 30_000, "¡Ñandú! 12:30", "¡Ñandú! 12:30"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in lexicon.encode_corpus(df).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert PUBLIC.decode(got[5]) == texts[5]
    assert lexicon.encode_corpus(df.limit(0)).count() == 0


def test_endings_are_shared():
    b = lexicon.Builder()
    for w in ("aing", "bing", "cing"):
        b.add(tuple(map(ord, w)))
    nxt, number, final = b.finish()
    assert len(nxt) == 6 and final.sum() == 1  # the dead state, the root and one path of endings
    assert [number[1, ord(c)] for c in "abc"] == [0, 1, 2]


SUBTITLE = """﻿1\r
00:00:01,000 --> 00:00:02,000\r
<i>MONTU: La cancion</i> (risas)\r
del rÃ­o.\r
\r
2\r
00:00:03.000 -->00:00:04.000\r
Traducido por el equipo X\r
- ¿Qué? [puerta] A las 7:45.\r
Visita www.x.example ya\r
♪ la la ♪ {\\an8}Fin\r
"""


def test_spoken_words():
    assert [w.decode() for w in speech.words(SUBTITLE)] == "la cancion del rio que a las 7 45 fin".split()
    assert speech.words(None) == speech.words("") == speech.words("1\n00:00:01,000 --> 00:00:02,000\n\n") == []
    assert speech.mend_encoding("canciÃ³n caciÃ\x83Â³n") == "canción cación"
    assert speech.fold("m?sica r�o árbol?") == b"m9sica r9o arbol?"


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijlmnoprstuv") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    items = [(i, sentences(rng, words, 60)) for i in range(20)] + [(90, None), (91, "corto"), (92, "")]
    text = dict(items)
    part = lambda i, a, n: " ".join(text[i].split()[a : a + n])
    filler = lambda n: sentences(rng, words, n)
    misread = part(3, 10, 24).split()
    misread[5] = misread[5][:-1] + "0"
    misread[15] = misread[15][1:]
    docs = [(1, f"{filler(50)} {part(0, 5, 20)} {filler(50)}"), (2, f"{filler(40)} {part(1, 0, 19)} {filler(40)}"), (3, f"{filler(30)}\n1\n00:00:01,000 --> 00:00:02,000\nMONTU: {part(2, 30, 12)}\n(risas)\n<i>{part(2, 42, 12).upper()}</i>!"), (4, f"{filler(33)} {' '.join(misread)} {filler(21)}"),
            (5, None), (6, ""), (7, part(4, 0, 60)), (8, part(4, 0, 60)), (9, f"{part(5, 40, 20)} {part(6, 0, 25)}"), (10, " ".join(reversed(part(7, 0, 40).split())))]
    docs += [(100 + i, filler(200)) for i in range(60)] + [(500, filler(30_000) + " " + part(8, 0, 30))]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, suite string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, e).where("tipo = 'literal'").collect()}
    assert got == {(1, 0), (3, 2), (4, 3), (7, 4), (8, 4), (9, 5), (9, 6), (500, 8)}
    assert leakage.leaked_items(d.limit(0), e).count() == 0 == leakage.leaked_items(d, e.limit(0)).count()


def test_shared_run_forgives_misread_words():
    item = np.arange(25)
    a = np.array([70, *range(25)])
    assert leakage.shared_run(a, item, [1]) == 25
    a[[10, 11]] = -1
    assert leakage.shared_run(a, item, [1]) == 25
    a[10] = -2 - 60  # taken for another word
    assert leakage.shared_run(a, item, [1]) == 25
    a[12] = -1  # a third in a row
    assert leakage.shared_run(a, item, [1]) < 20
    a[[10, 11, 12]] = 9, 99, 11  # read, and another
    assert leakage.shared_run(a, item, [1]) < 20
    put_in = np.array([*range(12), -1, *range(12, 25)])
    assert leakage.shared_run(put_in, item, [0, 1]) == 25
    put_in[12] = 77
    assert leakage.shared_run(put_in, item, [0, 1]) == 13


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 9, 40).tolist(), rng.integers(0, 9, 25).tolist()
        table = np.zeros((41, 26), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks = {w: sum(1 << k for k, y in enumerate(b) if y == w) for w in b}
        assert leakage.common_words(a, masks, 25) == table[-1, -1]


def test_misread_words():
    v = leakage.Vocabulary([b"mar", b"feliz", b"niebla", b"tronco"])
    assert v([b"mar", b"rnar", b"fehz", b"nieb1a", b"trouco", b"otro", b""]) == [0, -2, -3, -4, -5, -1, -1]


def test_paraphrases_need_the_answer_and_items_come_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijlmnoprstuv") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    text = {i: sentences(rng, words, 40).split() for i in range(12)}
    near = [w for k, w in enumerate(text[3]) if k % 10 != 9]  # runs of nine words of the item
    loose = [w if k % 2 else rng.choice(words) for k, w in enumerate(text[5])]
    docs = [(1, " ".join([*sentences(rng, words, 30).split(), *near])), (2, " ".join(loose)), (3, " ".join(text[7][5:26]))] + [(10 + i, sentences(rng, words, 150)) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in text.items()], "item_id long, text string")
    want = {(1, 3, "parafrasis"), (3, 7, "literal")}
    assert {(r.doc_id, r.item_id, r.tipo) for r in leakage.leaked_items(d, e).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 5)
    assert {(r.doc_id, r.item_id, r.tipo) for r in leakage.leaked_items(d, e).collect()} == want


def test_speech_ends_notes_at_their_mark_and_drops_whole_adverts_only():
    say = lambda t: b" ".join(speech.words(t)).decode()
    assert say("(risas " + "muy largas " * 20 + ") hola") == "hola" and say("(abierto\n\nsigue) aqui") == "abierto sigue aqui"
    assert say("la cancion 555-123 del rio") == "la cancion del rio" and say("Llama al 555-123!") == "" and say("-= foo.example =-") == ""
    assert say("dur!ng g@to, @hora e|") == "during gato ahora el"


def test_levels_on_held_out_documents(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    docs, labels = pd.read_parquet(f"{big}/documents.parquet"), pd.read_parquet(f"{big}/doc_labels.parquet")
    known = docs.merge(labels, on="doc_id")
    held = known.iloc[::3]
    fit = spark.createDataFrame(labels[~labels.doc_id.isin(held.doc_id)])
    few = docs[docs.doc_id.isin(known.doc_id)][["doc_id", "text", "source"]].copy()
    few.loc[len(docs)] = [10**6, None, None]
    few.loc[len(docs) + 1] = [10**6 + 1, "pocas palabras", "x"]
    few["doc_id"] = few["doc_id"].astype("int64")
    d = spark.createDataFrame(few, "doc_id long, text string, source string")
    got = {r.doc_id: r.nivel for r in reading.reading_levels(d, fit).collect()}
    want = dict(zip(held.doc_id, held.nivel))
    assert set(got) == set(want)
    assert sum(got[k] == v for k, v in want.items()) >= 0.9 * len(want)
    assert reading.reading_levels(d, fit.limit(0)).count() == 0


def test_folds_hold_out_whole_sources():
    source = np.array(["a"] * 50 + ["b"] * 30 + ["c"] * 20 + ["d"] * 5)
    fold = reading.source_folds(source, 3)
    assert len(set(fold)) == 3 and all(len(set(fold[source == s])) == 1 for s in "abcd")
    assert set(reading.source_folds(np.array(["a"] * 7), 5)) == {0, 1, 2, 3, 4}
    seen = []

    class Spy(reading.Boosted):
        def fit(self, x, y):
            seen.append(set(x[:, 1].tolist()))
            return super().fit(x, y)

    rng = np.random.default_rng(1)
    y = rng.integers(1, 4, 105).astype(float)
    x = np.column_stack([y + rng.normal(0, 0.1, 105), fold])
    before, reading.Boosted = reading.Boosted, Spy
    try:
        m = reading.fit(x, y, source, folds=3)
    finally:
        reading.Boosted = before
    assert [s for s in seen if len(s) == 2] == [{1, 2}, {0, 2}, {0, 1}] and seen[-1] == {0, 1, 2}  # trees of a fold saw none of its sources
    assert m.accuracy["held_out"] > 0.9 < m.accuracy["mixed"] and set(m.bias) == {"held_out", "source:a", "source:b", "source:c", "source:d"}
