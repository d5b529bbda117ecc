import pytest

from rankloom.llm.mapping import Vocabulary, edits, fold, map_fields, map_values

TERMS = [(1, "North Tessaly", ["NT"]), (2, "South Tessaly", ["ST"]), (3, "Velmontane", ["VE"]), (4, "Isle of Brannoc", ["IB"]), (5, "Warehouse Freight Handling", []), (6, "Warehouse Research and Testing", None), (7, "Brindle Ledger", ["BRLE"]), (8, "Brindle", [])]


@pytest.mark.parametrize(
    "value, want",
    [
        ("velmontane", 3), ("Velmontáne (HQ)", 3), ("State of Velmontane", 3), ("V.E.", 3), ("(VE)", 3), ("Veulmontaine", 3), ("s tessaly", 2), ("NorthTesasly", 1), ("Tessaly, North", 1), ("of Brannoc, Isle", 4),
        ("Whse Freight Hdlg", 5), ("Warehouse Rsrch & Testing", 6), ("brindle ledger 8.6", 7), ("BRLE.", 7), ("brindle", 8), ("Kingsmouth", 0), ("Tessaly", 0), ("", 0), ("??", 0), ("zone 4", 0),
    ],
)
def test_values(value, want):
    assert Vocabulary(TERMS).find(value) == want


def test_edits_against_plain_distance():
    import itertools

    for a, b in itertools.product(("abcd", "acbd", "abd", "", "xabcd", "dcba"), repeat=2):
        assert edits(a, b, 9) == edits(b, a, 9) and (edits(a, b, 9) == 0) == (a == b)
    assert edits("abcd", "acbd", 3) == 1 and edits("abc", "xyz", 1) == 2
    assert fold("  Straße & Öl_Fund ") == "strasse and ol fund"


def test_longest_mention_wins():
    v = Vocabulary(TERMS)
    assert v.mention("the brindle ledger of brindle") == 7
    assert v.mention("ve are here") == 0  # a short alias among other words is no mention


def test_cases(spark):
    terms = spark.createDataFrame([(1, "a", "Velmontane", ["VE", None]), (2, "a", None, ["X"]), (3, None, "Y", []), (9, "a", "velmontane", None)], "term_id long, kind string, term string, aliases array<string>")
    schema = "field string, kind string, record_id long, raw_value string, term_id long, term string"
    rows = [("f", "a", 1, "velmontane ", 0, ""), ("f", "a", 1, "velmontane ", 0, ""), ("f", "a", 2, "Velmontane", 0, ""), ("f", "a", 3, None, 0, ""), ("f", "a", 4, " n/a", 0, ""), ("f", "b", 5, "thing", 0, ""), ("f", "a", 6, "x" * 100_000, 0, ""), ("f", "a", 7, "word " * 4000 + "velmontane", 0, "")]
    got = {(r.record_id, r.term_id) for r in map_fields(spark.createDataFrame(rows, schema), terms).collect()}
    assert got == {(1, 1), (5, 0), (6, 0), (7, 1)}
    assert map_fields(spark.createDataFrame([], schema), terms).count() == 0
    assert map_values(spark.createDataFrame(rows, schema), terms.limit(0)).where("term_id <> 0").count() == 0


def test_held_out_accuracy(spark, data):
    """Where a row's canonical industry is known and nothing had to be resolved, changed spellings have to find it."""
    from rankloom.sources.tables import load

    terms = [(r.term_id, r.term, list(r.aliases or [])) for r in load(spark, data, "canonical_term").where("kind = 'industry'").collect()]
    v = Vocabulary(terms)
    for i, t, _ in terms:
        w = t.split()
        for changed in (t.upper(), "".join(w), t + " sector", ", ".join([" ".join(w[1:]), w[0]]), t[:3] + t[4:], t[:2] + "x" + t[2:]):
            assert v.find(changed) == i, changed


def test_abbreviations_that_share_few_letters_and_long_values():
    v = Vocabulary([(1, "Telecommunications", []), (2, "Warehousing", []), (3, "Velmontane", [])])
    assert v.find("tlcmns") == 1 and v.find("tlcmns services") == 1 and v.find("qlcmns") == 0
    assert v.find("Veulmontaine" + " hosted" * 1000) == 3 and v.find("Veulmontaine" + " hosted" * 1000 + " elsewhere") == 0
