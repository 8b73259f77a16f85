"""Look-alike forms and the gazetteer."""

import pytest

from silvara.llm import gazetteer, lookalike

NAMES = {"palo cenizo": 1, "palo tizón": 2, "cedrán rojo": 3, "cedrán blanco": 4, "murapé": 9, "murapé amarillo": 10, "sacuriña": 18, "quinaruma": 6, "leche muerta": 58, "lupuna": 20, "ishpingo": 21}

DISGUISED = {
    "Ｍｕｒａｐé": 9, "раlо сеnіzо": 1, "sacuriña": 18, "palo\xa0cenizo": 1, "palo ceni​zo": 1, " MURАPÉ  ": 9, "𝗆urapé": 9, "quinaruma ": 6, "LΕCΗΕ ΜUΕRΤΑ": 58, "Mur\u0430\u0440\u0435\u0301": 9, "pa\xadlo  cenizo": 1, "Iupuna": 20, "PALO CENlZO": 1, "lshpingo": 21, "ᴍᴜʀᴀᴘé": 9,
}
PLAIN = ["palo cenizo", "  Palo   CENIZO ", "murape", "murаpe", "palocenizo", "pa1o cenizo", "palo_cenizo", "", " ", "QUINARUMA", "​", "ced\xa0rán rojo", "palo cenizo 2​", "palo cenlzo", "ISHPINGO", "LUPUNA", "IUPUNA", "lUPUNA", "Lupuna", None]


def test_disguises():
    can = lookalike.Canonical(NAMES)
    assert {t: can.disguised(t) for t in DISGUISED} == DISGUISED
    assert {t: can.disguised(t) for t in PLAIN if t is not None} == {t: -1 for t in PLAIN if t is not None}


def test_disguised_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([*DISGUISED, *PLAIN, *DISGUISED])]
    df = spark.createDataFrame(rows, "fid long, especie string, especie_id string")
    dmc = spark.createDataFrame([(i, n) for n, i in NAMES.items()], "especie_id int, especie string")
    got = {(r.fid, r.especie_id) for r in lookalike.disguised_names(df, "fid", "especie", dmc).collect()}
    assert got == {(i, DISGUISED[t]) for i, t, _ in rows if t in DISGUISED}
    forms = {r.fid: (r.forma, r.forma_id) for r in lookalike.canonicalize(df.drop("especie_id"), "especie", dmc).collect()}
    assert len(forms) == len(rows) and forms[0] == ("murapé", 9) and forms[len(DISGUISED)] == ("palo cenizo", 1)
    assert lookalike.disguised_names(df.limit(0), "fid", "especie", dmc).count() == 0 == lookalike.disguised_names(df, "fid", "especie", dmc.limit(0)).count()


@pytest.mark.parametrize(
    "typed, wanted",
    [("palo cenizo", 1), ("Cenizo palo", 1), ("rojo, cedrán", 3), ("pslo cneizo", 1), ("PALO IÓZN", 2), ("palotizon", 2), ("murapé ama", 10), ("cedr. rojo", 3), ("kinaruma", 6), ("quinarurna", 6), ("sacurina; doble fuste", 18),
     ("palo tizón (joven)", 2), ("* murapé", 9), ("árbol quinaruma", 6), ("Quinaruma, picado", 6), ("p4lo c3nizo", 1), ("рalo cenizо 2", 1), ("cedrán", -1), ("palo", -1), ("blanco", -1), ("gonfrío", -1), ("Mrpé", 9), ("No Identificado", -1), ("???", -1), ("", -1), ("sp 3", -1), ("x" * 5000, -1)],
)
def test_gazetteer(typed, wanted):
    assert gazetteer.Gazetteer(NAMES, {1: 5}, gazetteer.NOTE_WORDS | {"picado", "joven"})(typed)[0] == wanted


def test_cost_is_weighted_and_bounded():
    assert gazetteer.cost("abc", "acb", 3) == 0.8 and gazetteer.cost("aa", "a", 3) == 0.5 and gazetteer.cost("palo", "pa1o", 3) == 0.3
    assert gazetteer.cost("abcdef", "uvwxyz", 2.0) == 3.0


def test_near_entries_equal_brute_force():
    """The dictionary finds every entry that a scan of the whole list finds, when an edit costs one and two letters differ at most."""
    g = gazetteer.Gazetteer(NAMES, {})
    for typed in ("palocenzo", "cedranbanco", "murpeamarilo", "sacurnia", "lecemuerta", "quinarma", "lupna", "ishpingoo", "cedranblancorojo"):
        most = {i: gazetteer.allowed(max(len(typed), len(f))) for i, f in g.form.items()}
        scan = {(gazetteer.cost(typed, f, most[i]), i) for i, f in g.form.items() if gazetteer.cost(typed, f, most[i]) <= min(most[i], 2.0)}
        assert scan == {(c, i) for c, _, i in g.close(typed, 0.0) if c <= 2.0}, typed


def test_annotations_are_learned_and_never_part_of_a_name():
    g = gazetteer.Gazetteer(NAMES | {"palo viejo": 30, "jebe hueco": 31}, {}, gazetteer.NOTE_WORDS | {"joven", "hueco", "viejo"})
    assert g("pallo viejo")[0] == 30 and g("jebe hueco")[0] == 31 and g("murapé hueco")[0] == 9 and g("palo viejo joven")[0] == 30
    assert set(g.left_over("Murapé torcido")) == {("torcido", 9)} and g.left_over("murapé viejo") == [] == g.left_over("nada")
    assert gazetteer.Gazetteer({"uno dos tres cuatro": 1}, {})("quatro tres dos uno")[0] == 1


def test_notes_from_texts(spark):
    texts = spark.createDataFrame([(f"{n} rajado",) for n in list(NAMES)[:4]] + [("murapé extra",)], "t string")
    assert gazetteer.learned_notes(texts, NAMES) - gazetteer.NOTE_WORDS == {"rajado"}


def test_long_lists_go_in_blocks(spark, monkeypatch):
    typed = ["Cenizo palo", "pslo cneizo", "murapé ama", "cedr. rojo", "cedrán", "x", "LΕCΗΕ ΜUΕRΤΑ", "quinarurna", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "k long, t string")
    dmc = spark.createDataFrame([(i, n) for n, i in NAMES.items()], "especie_id int, especie string")
    whole = {r.k: r.especie_id for r in gazetteer.map_names(df, "t", dmc, dmc).collect()}
    monkeypatch.setattr(gazetteer, "BLOCK_NAMES", 4)
    assert {r.k: r.especie_id for r in gazetteer.map_names(df, "t", dmc, dmc).collect()} == whole
    assert whole == {0: 1, 1: 1, 2: 10, 3: 3, 4: -1, 5: -1, 6: 58, 7: 6, 8: -1}


def test_mapped_rows(spark):
    df = spark.createDataFrame([(1, "Palo Cenizo?", 0.0), (1, "Palo Cenizo?", 0.0), (2, None, 1.0)], "lote_id long, entrada string, costo double")
    dmc = spark.createDataFrame([(i, n) for n, i in NAMES.items()], "especie_id int, especie string")
    out = gazetteer.map_names(df, "entrada", dmc, dmc).orderBy("lote_id").collect()
    assert [(r.lote_id, r.especie_id, r.costo) for r in out] == [(1, 1, 0.0), (1, 1, 0.0), (2, -1, None)]
    assert gazetteer.map_names(df, "entrada", dmc.limit(0)).where("especie_id = -1").count() == 3


def test_results_do_not_depend_on_the_number_of_blocks(spark, monkeypatch):
    """learned words, the words of all names, entries of one form, depths and shortened names count as in one dictionary, whatever the blocks."""
    names = NAMES | {"uno dos tres cuatro": 70, "quina ruma": 71, "cenizo palo": 72, "Lupuna": 73, "cinco seis siete ocho": 74, "palo viejo": 75, "ruma": 76, "ruma blanca": 77, "quinarumo": 78}
    typed = [f"{n} rajado" for n in names] + ["pslo cneizo rajado", "rajado murape", "quatro tres dos uno", "quinaruma", "QUINA RUMA", "quinarum", "quinarumb viejo", "palo cenizo", "cenizo, palo", "lupuna", "lupana", "murap", "murapé a", "ruma bl", "sacuri", "cedrán", "pallo viejo", "cedranblancorojo", "рalo cenizо", "ocho siete sies cinco", "sp 3", "", "1 2"]
    df = spark.createDataFrame(list(enumerate(typed)), "k long, t string")
    dmc = spark.createDataFrame([(i, n) for n, i in names.items()], "especie_id int, especie string")
    seen = spark.createDataFrame([("cenizo palo",)] * 3 + [("quina ruma",)] * 2, "especie string")
    got = []
    for most in (100_000, 7, 3, 1):
        monkeypatch.setattr(gazetteer, "BLOCK_NAMES", most)
        got.append({typed[r.k]: (r.especie_id, r.costo) for r in gazetteer.map_names(df, "t", dmc, seen).collect()})
    assert got[1] == got[0] and got[2] == got[0] and got[3] == got[0]
    assert got[0]["pslo cneizo rajado"][0] in (1, 72) and got[0]["rajado murape"][0] == 9
