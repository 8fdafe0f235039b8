"""Problem 5: the splitter against hand-made fields, delimiters and broken rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators.multivalue import FIT, delimiter_scores, learned_strokes, pieces, split_values

COLUMNS = "entry_id bigint, dictionary string, gloss string, gloss_secondary string, value_no string"


@pytest.mark.parametrize(
    "field, values",
    [
        ("shadow; river bend", ["shadow", "river bend"]), ("shadow;; river bend;", ["shadow", "river bend"]), ("huso|umbral", ["huso", "umbral"]), ("a b // c d // e f", ["a b", "c d", "e f"]),
        ("threshold\tfootprint", ["threshold", "footprint"]), ("дань\nпорог", ["дань", "порог"]), ("1) huso; 2) umbral", ["huso", "umbral"]), ("(1) huso (2) umbral", ["huso", "umbral"]), ("a) tonnerre b) querelle c) seuil", ["tonnerre", "querelle", "seuil"]),
        ("1. hunting dog\n2. feast", ["hunting dog", "feast"]), ('["a dog", "a cat, esp. small"]', ["a dog", "a cat, esp. small"]), ('"tribute (arch., poet.)"; "cooking pot"', ["tribute (arch., poet.)", "cooking pot"]),
        ('"""snowdrift,"" for drying fish";"willow branch"', ['"snowdrift," for drying fish', "willow branch"]), ('"small crab; for carrying water"', ["small crab; for carrying water"]), ("tribute, esp. for children", ["tribute, esp. for children"]),
        ("seuil, tribut (vx, poét.)", ["seuil", "tribut (vx, poét.)"]), ("donner à qn/qc", ["donner à qn/qc"]), ("1/2 load of hay", ["1/2 load of hay"]), ("quarrel/hunting dog", ["quarrel", "hunting dog"]), ("blind alley; feast / salmon roe", ["blind alley", "feast", "salmon roe"]),
        ('huso,"jdm/etw nachgeben",umbral', ["huso", "jdm/etw nachgeben", "umbral"]), ("dan; dan", ["dan", "dan"]), ("", []), ("   ", []), (";;;", []),
    ],
)
def test_fields(field, values):
    assert pieces(field) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdefg ", min_size=2, max_size=12).map(str.strip).filter(lambda x: len(x) > 2 and "  " not in x), min_size=2, max_size=6), st.sampled_from(["; ", ";", " | ", "|", "\t", "\n", " • ", " // "]))
def test_round_trip(values, delim):
    assert pieces(delim.join(values)) == values


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert all(p.strip() == p and p for p in pieces(text))


def test_rows(spark):
    rows = [(1, "D", "a dog; a cat", None, "x"), (1, "D", "a dog; a cat", None, "x"), (2, "D", None, "", "x"), (3, "D", "one", "two|two", "x"), (4, None, "x y; z w", None, None)]
    got = {tuple(r) for r in split_values(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(1, "gloss", 1, "a dog"), (1, "gloss", 2, "a cat"), (3, "gloss_secondary", 1, "two"), (3, "gloss_secondary", 2, "two"), (4, "gloss", 1, "x y"), (4, "gloss", 2, "z w")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert split_values(empty).count() == 0
    assert delimiter_scores(empty).count() == 0


def test_long_and_learned(spark):
    rows = [(k, "D", "give to xx/yy", None, "") for k in range(20)] + [(100, "D", "; ".join(f"word {k}" for k in range(30_000)), None, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert [r[0] for r in learned_strokes(df).collect()] == ["xx/yy"]
    got = split_values(df)
    assert got.count() == 30_000 and got.where("entry_id = 100").selectExpr("max(value_no)").first()[0] == 30_000


def test_scores(spark):
    df = spark.createDataFrame([(k, "D", "a dog; a cat" if k % 2 else "a dog", None, "") for k in range(10)], COLUMNS)
    best = delimiter_scores(df).orderBy("score", ascending=False).first()
    assert (best["delim"], best["cut_values"]) == (";", 5)


def test_filter_passes_all_that_splits(spark):
    held = ["a. house b. hut", "(a. house b. hut", "a. house b. hut", "a.\u001chouse b.\u001chut", "1. house 2. hut", "١. house ٢. hut", "a) house b) hut", "(1) house (2) hut", "house, hut", "house / hut", "house;hut", '["house", "hut"]', "дом、изба"]
    rows = [(i, "D", v, None, None) for i, v in enumerate(held)] + [(99, "D", "Mr. Hut", None, None)]
    want = {(i, k + 1, x) for i, v in enumerate(held) if len(got := pieces(v)) > 1 for k, x in enumerate(got)}
    assert {(r["entry_id"], r["value_no"], r["item"]) for r in split_values(spark.createDataFrame(rows, COLUMNS)).collect()} == want and {(0, 1, "house"), (0, 2, "hut")} < want


def test_the_source_decides(spark):
    """A candidate that doesn't delimit its source's values isn't cut; without scores nothing is."""
    assert pieces("a dog; a cat", {}) == ["a dog; a cat"]
    assert pieces("a dog; a cat | x", {"|": 0.5}) == ["a dog; a cat", "x"]
    assert pieces("red, blue/green hat", {",": 0.1, "/": 0.6}) == ["red, blue", "green hat"] and pieces("red, blue/green hat", {",": 0.6, "/": 0.1}) == ["red", "blue/green hat"]
    # in D strokes stand before odd pieces and in odd numbers, in E they delimit
    rows = [(k, "D", "a dog" + "/- ;" * (k % 9 * 3 + 1), None, "") for k in range(40)] + [(100 + k, "E", "a dog/a cat", None, "") for k in range(9)]
    fit = {(r["source"], r["delim"]): r["fit"] for r in delimiter_scores(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert fit["E", "/"] == 1 and fit["D", "/"] < FIT


def test_beyond_the_bound_gives_the_same(spark):
    rows = [(k, "DE"[k % 2], ["a dog; a cat", "give to xx/yy", "one, two", "p q | r s"][k % 4], "u v/w x" if k % 3 else None, "") for k in range(60)] + [(70, None, "x y; z w", None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, split_values(df, bound=0).collect())) == sorted(map(tuple, split_values(df).collect())) != []
