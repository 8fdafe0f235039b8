"""Labels carried through edits, tagged output, annotation tasks and dictionary metadata; functions for SQL."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions.registry import register
from lexforge.operators import labels


def test_carried():
    assert labels.carried("abc", "abc", list("xyz")) == (list("xyz"), 0.0)
    assert labels.carried("abc", "aXbc", list("xyz"))[0] == ["x", "x", "y", "z"]
    assert labels.carried("abc", "ac", list("xyz"))[0] == ["x", "z"]
    assert labels.carried("", "ab", []) == (["space", "space"], 2.0)


def test_parse_tagged():
    text, got = labels.parse_tagged("<L>ab <M>c</M></L> <b>d</b>", ["L", "M"])
    assert text == "ab c <b>d</b>" and got[:4] == ["L", "L", "L", "M"] and got[-1] == "other"


def test_recovered(spark):
    text = "word one two three " * 6
    rows = [(1, text, f"<L>{text}</L>", ["L"]), (2, text, f"<L>{text[:-3]}Xe </L>", ["L"]), (3, text, "<L>nothing like it</L>", ["L"]), (4, "", None, None)]
    df = spark.createDataFrame(rows, "id int, text string, tagged string, langs array<string>")
    got = {r["id"]: r["r"] for r in df.select("id", labels.recovered(F.col("text"), F.col("tagged"), F.col("langs")).alias("r")).collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["exact", "projected", "rejected", "exact"]
    assert got[1]["labels"][:5] == ["L", "L", "L", "L", "space"] and got[3]["labels"] is None


def test_round_trip_and_tampering(spark):
    df = spark.createDataFrame([(1, "ab cd", ["x", "x", "space", "y", "y"]), (2, "", [])], "id int, text string, languages array<string>")
    assert [(r["id"], r["same"], r["fault"]) for r in labels.round_trip(df, ["id"]).orderBy("id").collect()] == [(1, True, None), (2, True, None)]
    task = '{"data":{"text":"ab cd"},"predictions":[{"result":[{"type":"labels","value":{"start":0,"end":2,"text":"ab","labels":["x"]}}]}],"annotations":[{"updated_at":"2","result":[{"type":"labels","value":{"start":0,"end":2,"text":"zz","labels":["y"]}}]}]}'
    r = labels.spans_of_task(spark.createDataFrame([(1, task)], "id int, task string"), "task", ["id"]).first()
    assert r["fault"] == "tampered" and r["labels"] == ["y", "y", "space", "space", "space"]


def test_metadata(spark):
    configs = spark.createDataFrame([("F", "Old Orvani", ["English", "French"]), ("G", "Tesmek", ["German"])], "folder string, source string, targets array<string>")
    rows = spark.createDataFrame([(1, "orvani", ["french", "english"]), (2, "old orvani", ["English", "French"]), (3, "tesmek", ["Spanish"])], "row_no int, source string, targets array<string>")
    got = {r["folder"]: r["metadata"] for r in labels.match_metadata(configs, rows).collect()}
    assert got["F"]["row_no"] == 2 and got["G"] is None
    name = spark.createDataFrame([("Old-Orvani-French-English",), ("Tesmek",)], "n string").select(labels.folder_name(F.col("n"), ["French", "English"]).alias("r"))
    assert [(r["r"]["source"], r["r"]["targets"]) for r in name.collect()] == [("Old-Orvani", ["French", "English"]), ("Tesmek", [])]


def test_registered(spark):
    register(spark)
    assert spark.sql("select grapheme_len('e\u0301x') as n").first()[0] == 2
    assert spark.sql("select nfc('e\u0301') as s").first()[0] == "é"
    assert spark.sql("select value_similarity('abcd', 'abce') as s").first()[0] == pytest.approx(0.75)
    rows = spark.sql(r"select * from parse_mdf('\\lx a\n\\ge b\n\n\\lx c')").collect()
    assert [(r["record_index"], r["marker"], r["value"]) for r in rows] == [(0, "lx", "a"), (0, "ge", "b"), (1, "lx", "c")]
