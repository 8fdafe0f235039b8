"""The engine's own operators: hand-derived goldens and metamorphic properties."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexforge.functions import edit, ocr, scripts, text
from lexforge.operators import align, incremental, labels, layout, mdf, metrics, provenance, reports, spans, verify
from lexforge.plans import catalog
from lexforge.sources import files
from lexforge.streaming import events


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.strip_tags, 'a <b>x</b> <a href="q">y', 'a x <a href="q">y'), (text.collapse, "  a   b\n", "a b"), (text.line_text, "a , b ( c )", "a, b( c)"), (text.clean_text, "é <i>x</i> !", "é x!"), (text.homoglyphs, " Bəp,P ", "вәр;p"),
        (text.field_value, " A <b>x</b>, y ", "a x; y"), (text.projection_value, "Bp, Q", "bp; q"), (text.scoring_value, "ab, c.", "abc"), (text.casefold_letters, "Straße İΣ1", "strasse i̇σ1"), (ocr.apostrophes, "l’eau", "l'eau"),
        (ocr.dashes, "a – b", "a - b"), (ocr.dashes, "FOO — 12 — BAR", "FOO — 12 — BAR"), (text.mdf_value, "<b>a</b> b. !? ", "a b"), (text.strip_fence, "```text\n\\lx a\n```", "\\lx a"), (ocr.emphasis, "**a** *b* 2*3*4", "<b>a</b> <i>b</i> 2<i>3</i>4"),
        (ocr.known_tags, "<strong>a</strong><em>b</em><u>c</u><N>", "<b>a</b><i>b</i>c<N>"), (ocr.stray_angles, "<b>a</b> < c >", "<b>a</b>  c "), (ocr.strip_noise, "\\textbf{a} &amp;amp; $x$ \\overline{\\text {q}}_{2} \\alphabeta z", "<b>a</b> &amp; x q2  z"), (text.cuneiform_spacing, "\U00012000 \U00012001 a", "\U00012000\U00012001 a"),
        (text.extra_column, "plural_form", "Plural_Form"), (text.head_norm, "— Ａ", "- a"), (text.strip_marks, "é̂x", "ex"), (text.language_key, "Français ", "fr"), (ocr.recognised_line, "�", ""), (ocr.recognised_line, "<b></b> x’s", " x's"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("value, want", [("(2)", 2), ("iv", 4), ("X.", 10), ("0", None), ("XI", None), ("", None), ("a", None), (None, None)])
def test_entry_number(spark, value, want):
    assert one(spark, value, text.entry_number) == want


def test_page_specs(spark):
    assert one(spark, "97-99, 179", text.pages_of_spec) == [97, 98, 99, 179]
    for bad in ("0", "5-3", "x"):
        with pytest.raises(Exception, match="bad page spec"):
            one(spark, bad, text.pages_of_spec)


@pytest.mark.parametrize("value, junk", [("", True), ("a word", False), ("\\ \\", True), ("aaaaaaaaaaaaaaa", True), ("1" * 79 + " a", True), ("12" * 45, True), ("一二三四五六七八九十" * 9, True), ("abc " * 60, True), ("The quick brown fox " * 8, False)])
def test_junk(spark, value, junk):
    assert one(spark, value, text.is_junk_line) is junk


def test_graphemes_and_distance(spark):
    family = "é👨‍👩‍👧x"
    assert one(spark, family, lambda c: F.size(text.graphemes(c))) == 3
    df = spark.createDataFrame([("kitten " + family, "sitting é👨‍👩‍👧y"), ("", ""), ("abc", "")], "a string, b string")
    got = [r[0] for r in df.select(text.nfc("a").alias("a"), text.nfc("b").alias("b")).select(edit.grapheme_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [4, 0, 3]
    assert df.select(edit.grapheme_ned(F.col("a"), F.col("b"))).collect()[1][0] == 0


def test_native_distance_against_python(spark):
    random.seed(3)
    rows = [("".join(random.choice("abcé ") for _ in range(random.randrange(20))), "".join(random.choice("abcé ") for _ in range(random.randrange(20)))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(edit.grapheme_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [align.levenshtein(list(a), list(b)) for a, b in rows]
    assert all(align.levenshtein(list(a), list(b)) == align.levenshtein(list(b), list(a)) for a, b in rows)


def test_windows_and_order(spark):
    df = spark.createDataFrame([("bcd", "abXcde"), ("long", "x")], "s string, t string")
    got = [r[0] for r in df.select(edit.window_ned(F.col("s"), F.col("t"))).collect()]
    assert got[0] == pytest.approx(1 / 3) and got[1] is None
    assert one(spark, [0, 1, 2], edit.order_distance, "array<int>") == 0
    assert one(spark, [1, 0, 2], edit.order_distance, "array<int>") == pytest.approx(2 / 3)


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        c = rng.random((n, m))
        r, k = align.assignment(c)
        small = c if n <= m else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert c[r, k].sum() == pytest.approx(best)


def test_match_page():
    gold = ["the first line", "a second line of text", "third"]
    assert [(g, p) for g, p, _ in align.match_page(gold, gold)] == [([0], [0]), ([1], [1]), ([2], [2])]
    got = align.match_page(gold, ["the first line", "a second line", "of text", "third"])
    assert ([1], [1, 2], 0.0) in got
    assert align.match_page([], ["a"]) == [([], [0], 1.0)] and align.match_page(["a"], []) == [([0], [], 1.0)] and align.match_page([], []) == []
    assert {(tuple(g), tuple(p)) for g, p, e in align.match_page(["abc", "xyzzy"], ["abc"])} == {((0,), (0,)), ((1,), ())}


def test_reading_quality_follows_the_alignment(spark, tmp_path):
    page = ["bako small house", "divo red fish", "lumi old river", "sarto cold wind"]
    pages = [(1, "D/page_1", "D", "\n".join(page)), (2, "D/page_2", None, "alone")]
    spark.createDataFrame(pages, "stage1_id bigint, page_id string, dictionary string, text string").write.parquet(f"{tmp_path}/stage1_projections.parquet")
    read = [(1, "D/page_9", "page_1", "\n".join(["A running head", "", *page])), (2, "D/page_9", "page_2", " ")]
    spark.createDataFrame(read, "neighbor_id bigint, page_id string, stem string, transcript string").write.parquet(f"{tmp_path}/neighbor_pages.parquet")
    rows = {r["dictionary"]: r for r in catalog.reading_quality(spark, str(tmp_path)).collect()}
    assert (rows["D"]["pairs"], rows["D"]["edits"], rows["D"]["gold_len"], rows["D"]["text_edit"]) == (5, 14, sum(map(len, page)), 0.2)
    assert (rows[None]["pairs"], rows[None]["gcer"]) == (1, 1.0) and rows["__aggregate__"]["pairs"] == 6


def test_whole_tables_against_brute_force(spark, tmp_path):
    values = ["Bap, pə", "\u041a\u043e\u0442, \u0434\u043e\u043c", " e\u0301te\u0301 <B>x</B>  y ", "\u039b\u03cc\u03b3\u03bf\u03c2", "", None]
    rows = [(i, m, v) for i, (m, v) in enumerate(itertools.product(("lx", "cf", "ge"), values))]
    spark.createDataFrame(rows, "line_id bigint, marker string, value string").write.parquet(f"{tmp_path}/field_lines.parquet")
    folded = {i: (v or "").translate(str.maketrans("Bpə", "\u0412\u0440\u04d9")).strip().lower().replace(",", ";") for i, _, v in rows}
    assert dict(map(tuple, catalog.homoglyph_values(spark, str(tmp_path)).collect())) == folded
    norm = {i: re.sub(r"\s+", " ", re.sub("</?[bi]>", "", unicodedata.normalize("NFC", v or "").strip().lower().replace(",", ";"))).strip() for i, _, v in rows}
    assert dict(map(tuple, catalog.projection_values(spark, str(tmp_path)).collect())) == norm

    docs = [(1, "abc"), (2, "e\u0301\u0085\u0080x"), (3, "\u0091\u0301\U0001f469\u200d\U0001f33e"), (4, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, catalog.grapheme_lengths(spark, str(tmp_path)).collect())) == {i: len(regex.findall(r"\X", t)) for i, t in docs}

    gold, pred = ["bako house", "", "d\u00edvo"], ["di\u0301vo", "bakoo  house", "\u0434\u0438\u0432\u043e"]
    spark.createDataFrame([(1, "D/page_1", "\n".join(gold)), (2, "D/page_2", "alone")], "stage1_id bigint, page_id string, text string").write.parquet(f"{tmp_path}/stage1_projections.parquet")
    spark.createDataFrame([(1, "D/page_9", "page_1", "\n".join(pred))], "neighbor_id bigint, page_id string, stem string, transcript string").write.parquet(f"{tmp_path}/neighbor_pages.parquet")
    got = {(r["page_id"], r["gold_idx"], r["pred_idx"]): r["ned"] for r in catalog.cost_matrix(spark, str(tmp_path)).collect()}
    assert got == {("D/page_1", i, k): align.ned(" ".join(p.split()), g) for i, g in enumerate(gold) if g for k, p in enumerate(pred)}


def test_greedy_join(spark):
    gold = spark.createDataFrame([("p", 0, "abcd"), ("p", 1, "abce"), ("q", 0, "")], "page string, k int, v string")
    pred = spark.createDataFrame([("p", 0, "abce"), ("p", 1, "zzzzzzzzzzzz"), ("q", 0, "")], "page string, k int, v string")
    got = {(r["page"], r["gold_idx"], r["pred_idx"], r["status"]) for r in align.greedy_join(gold, pred, ["page"], "k", "v").collect()}
    assert got == {("p", 1, 0, "matched"), ("p", 0, None, "missing"), ("p", None, 1, "extra"), ("q", 0, 0, "matched")}


def test_tagged_words(spark):
    got = one(spark, "</i>a <b>b <i>c</b> d</i> e", lambda c: align.tagged_words(c))
    assert [(w["word"], w["tags"]) for w in got] == [("a", []), ("b", ["b"]), ("c", ["b", "i"]), ("d", ["i"]), ("e", [])]
    df = spark.createDataFrame([("D", "<b>x</b> y z", "<b>x y</b> z"), ("D", None, None)], "d string, gold string, pred string")
    got = {r["tag"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.tag_confusion(df, ["d"]).collect()}
    assert got["b"] == (1, 1, 0) and got["i"] == (0, 0, 0)


def test_text_quality(spark):
    df = spark.createDataFrame([("a", "abcd ef", "abcx ef"), ("a", "", ""), ("b", "xy", "")], "k string, gold string, pred string")
    got = {r["k"]: r for r in metrics.text_quality(metrics.pair_counts(df), ["k"], total="all").collect()}
    assert got["a"]["gcer"] == pytest.approx(1 / 7) and got["a"]["text_edit"] == pytest.approx(1 / 14) and got["a"]["wer"] == pytest.approx(0.5)
    assert got["all"]["edits"] == 3 and got["all"]["gold_len"] == 9
    same = metrics.text_quality(metrics.pair_counts(df.select("k", "gold", F.col("gold").alias("pred"))), ["k"]).agg(F.sum("edits")).first()[0]
    assert same == 0


def test_language_edits_move_one_bucket(spark):
    labels = ["x"] * 3 + ["y"] * 3
    df = spark.createDataFrame([("d", "abcdef", "abcdeX", labels), ("d", "abcdef", "abcdefgh", labels), ("d", "abcdef", "abcdef", labels)], "d string, gold string, pred string, languages array<string>")
    got = {r["language"]: (r["edits"], r["gold_len"]) for r in metrics.per_language(df, ["d"]).collect()}
    assert got == {"x": (0, 9), "y": (3, 9)}


def test_baseline(spark):
    new = spark.createDataFrame([("a", "0.5"), ("b", "x"), ("c", "1")], "p string, m string")
    base = spark.createDataFrame([("a", "0.4"), ("b", "1")], "p string, m string")
    assert {r["p"]: r["m_delta"] for r in metrics.baseline_delta(new, base, ["p"], ["m"]).collect()} == {"a": 0.1, "b": None, "c": None}


MDF = "\\lx a\n\\ge x\n\n\n  \\lx b \n\\ps\nplain\n\\ge y z\n\\bad"


def test_parse_mdf(spark):
    df = spark.createDataFrame([("p", MDF), ("q", ""), ("r", None)], "page string, mdf_text string")
    got = [tuple(r)[1:] for r in mdf.parse_mdf(df, ["page"]).orderBy("page", "line_index").collect()]
    assert got == [(0, 0, 0, "lx", "a"), (0, 1, 1, "ge", "x"), (1, 0, 2, "lx", "b"), (1, 1, 3, "ge", "y z")]
    again = mdf.write_records(mdf.parse_mdf(df, ["page"]), ["page"]).first()["mdf_text"]
    assert again == "\\lx a\n\\ge x\n\n\\lx b\n\\ge y z"


def test_compare_blocks(spark):
    mk = lambda t: mdf.blocks(spark.createDataFrame([("p", t)], "page string, t string"), ["page"], "t")
    r = mdf.compare_blocks(mk("\\lx a\n\\ge x\n\n\\lx a\n\\ge x\n\n\\lx c"), mk("\\lx a\n\\gn x\n\n\\lx d"), ["page"]).first()
    assert (r["matched"], r["missing"], r["extra"], r["headword_precision"]) == (2, 1, 1, 0.5)


ENTRY = "p string, o int, entry_type string, headword string, homonym_number int, sense_number int, parent_lexeme string, gloss string, gloss_secondary string, pos string, phonetic string, cross_references array<string>, examples array<string>, example_glosses array<string>"


def test_entries(spark):
    rows = [("p", 1, "sense", "", None, None, None, "g", None, None, None, None, None, None), ("p", 2, "main", "a", 2, 1, "x", "one; two.", None, "n.", None, ["b"], ["e."], ["t."]), ("p", 3, "subentry", "c", 1, None, "a", "", "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, ENTRY)
    assert {(r["o"], r["rule"]) for r in mdf.entry_issues(df, ["p"], "o").collect()} == {(1, "child_before_main"), (1, "child_without_parent"), (1, "sense_without_number"), (2, "main_with_parent"), (3, "no_gloss")}
    fixed = {r["o"]: (r["homonym_number"], r["sense_number"], r["parent_lexeme"]) for r in mdf.valid_entry(df).collect()}
    assert fixed == {1: (None, None, None), 2: (2, None, None), 3: (None, None, "a")}
    out = {r["o"]: r["mdf"] for r in mdf.entry_lines(mdf.valid_entry(df), ["o"]).collect()}
    assert out[2] == "\\lx a\n\\hm 2\n\\ps n.\n\\ge one\n\\ge two\n\\cf b\n\\xv e.\n\\xe t."


def test_spans(spark):
    labels = ["a", "a", "space", "b", "a"]
    got = one(spark, labels, spans.spans_of_labels, "array<string>")
    assert [(s["start"], s["end"], s["language"]) for s in got] == [(0, 2, "a"), (2, 3, "space"), (3, 4, "b"), (4, 5, "a")]
    assert one(spark, labels, lambda c: spans.char_labels(spans.spans_of_labels(c)), "array<string>") == labels
    assert one(spark, [], spans.spans_of_labels, "array<string>") == []
    assert one(spark, ["b", "a", "space"], spans.majority, "array<string>") == "a"
    assert one(spark, ["b", "a"], lambda c: spans.majority(c, F.lit("b")), "array<string>") == "b"
    df = spark.createDataFrame([(1, 2, 4, "x"), (1, 6, 7, "y")], "id int, start int, end int, language string")
    assert {tuple(r)[1:] for r in spans.filled(df, ["id"]).collect()} == {(0, 2, "space"), (2, 4, "x"), (4, 6, "space"), (6, 7, "y")}
    maps = [("abc", [(0, 3, "x")]), ("abc", [(0, 1, "x"), (2, 3, "y")]), ("abc", [(0, 2, "x"), (1, 3, "y")]), ("abc", [(0, 2, "x")]), ("", [(0, 1, "x")]), ("", []), ("ab", [(0, 5, "x")]), ("ab", [(0, 0, "x")])]
    got = [r["fault"] for r in spans.span_faults(spark.createDataFrame(maps, f"text string, spans {spans.SPAN}")).collect()]
    assert got == [None, "gap", "overlap", "short", "spans_without_text", None, "long", "empty_span"]


def test_scripts(spark):
    label = lambda c: scripts.token_script(F.transform(F.split(c, ""), scripts.base_script))
    for word, want in (("abc", "latin"), ("ɲa", "ipa"), ("λόγος", "greek"), ("ӈа", "cyrillic_ext"), ("é", "latin_ext"), ("12.", None), ("дa", "latin")):
        assert one(spark, word, label) == want


def test_layout(spark):
    rows = [("p", k, x, y, x + 0.4, y + 0.05, t, c) for k, (x, y, t, c) in enumerate([(0.5, 0.3, "right", "text"), (0.05, 0.5, "left low", "text"), (0.05, 0.3, "left", None), (0.1, 0.95, "7", None), (0.1, 0.02, "HEAD", "page_header"), (0.1, 0.5, "pic", "image")])]
    df = spark.createDataFrame(rows, "page string, k int, x0 double, y0 double, x1 double, y1 double, text string, category string")
    assert [r["line"] for r in layout.transcript(df, ["page"], "k").orderBy("line_idx").collect()] == ["HEAD", "left", "left low", "right", "7"]
    cols = spark.createDataFrame([("p", 0, "header", "", "HDR"), ("p", 1, "right", "1", "r1"), ("p", 2, "left", "2", "l2"), ("p", 3, "left", "1", "l1"), ("p", 4, "footer", "", "F")], "page string, row_idx int, column_id string, line_number string, text string")
    assert [r["line"] for r in layout.flatten(cols, ["page"]).orderBy("line_idx").collect()] == ["HDR", "l1", "l2", "r1", "F"]
    assert [r["line"] for r in layout.flatten(cols, ["page"], row_major=True).orderBy("line_idx").collect()] == ["HDR", "l1", "r1", "l2", "F"]


def test_provenance():
    t = provenance.folded("The cat, sat on the mat. 12 cats")
    assert provenance.locate("cat; sat", t, 0) == ("exact", [(4, 12)]) or provenance.locate("cat, sat", t, 0)[0] == "exact"
    assert provenance.locate("catsat", t, 0)[0] == "compact"
    assert provenance.locate("sat mat", t, 0)[0] == "token" and provenance.locate("sat dog", t, 0)[0] == "partial" and provenance.locate("dog", t, 0)[0] == "unmapped"
    assert provenance.repair_value("Commisaires du roi", "les Commissaires du roi", 0)[:2] == ("approximate-token", "Commissaires du roi")
    assert provenance.repair_value("a", "a b", 0)[0] == "too_few_lexical_chars"
    assert provenance.repair_value("zzzz qqqq", "alpha beta", 0)[0] == "no_source_span"


def test_verify(spark):
    assert verify.apply_patches("a b\nc", [{"current_text": "b", "expected_text": "x", "line_index": 0}]) == ("a x\nc", 1)
    assert verify.apply_patches("a\nb\nc", [{"current_text": "a", "expected_text": "", "line_index": 0}, {"current_text": "c", "expected_text": "d", "line_index": 1}])[0] == "b\nd"
    assert verify.apply_patches("a a", [{"suggested_fix": "change 'a' to 'b'"}]) == ("a a", 0)
    assert verify.patch_of({"suggested_fix": "colour -> color"}) == ("colour", "color")
    issue = [{"type": "t", "evidence": "e"}]
    assert verify.outcome([{"decision": "retry", "confidence": 0.9, "issues": issue}, {"decision": "retry", "confidence": 0.9, "issues": issue}])["outcome"] == "repeated"
    assert verify.outcome([{"decision": "retry", "confidence": 0.2, "issues": issue}])["outcome"] == "low_confidence"
    assert verify.outcome([{"decision": "retry", "confidence": 0.9, "issues": []}])["outcome"] == "vague"
    assert verify.outcome([{"decision": "accept"}]) == {"outcome": "accepted", "attempts": 1}


def test_incremental(spark):
    t = spark.createDataFrame([("en", "p1", "s1"), ("en", "p2", "s2"), ("fr", "p3", "s3")], "language string, page string, stamp string")
    c = spark.createDataFrame([("en", "p1", "s1", 13), ("en", "p2", "old", 13), ("fr", "p3", "s3", 13)], "language string, page string, stamp string, version int")
    left = lambda **k: sorted(r["page"] for r in incremental.to_compute(t, c, ["language", "page"], ["stamp"], 13, **k).collect())
    assert left() == ["p2"] and left(overwrite=["fr"]) == ["p2", "p3"]
    assert incremental.valid_cache(t, c, ["language", "page"], ["stamp"], 13).count() == 2
    a = spark.createDataFrame([("x",), ("y",)], "m string")
    b = spark.createDataFrame([(1,), (2,)], "n int")
    names = {r["name"] for r in incremental.sweep([a, b], "{m}-{n}", spark.createDataFrame([("x", 2)], "m string, n int")).collect()}
    assert names == {"x-1", "y-1", "y-2"}
    with pytest.raises(ValueError):
        incremental.sweep([a, b], "{m}", most=3)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    got = [(r["file"][-5:], r["line_idx"], r["line"]) for r in files.flat_lines(files.whole_text(spark, str(tmp_path), "*.txt").select("file", "value")).orderBy("file", "line_idx").collect()]
    assert got == [("a.txt", 0, "x"), ("a.txt", 1, ""), ("a.txt", 2, "y")]
    tsv = spark.createDataFrame([("f", "column_id\tline_number\ttext\nleft\t1\t\"a \"\"b\"\"\"\nright\t\tc")], "file string, value string")
    assert [tuple(r)[2:] for r in files.column_tsv(tsv).orderBy("row_idx").collect()] == [("left", "1", 'a "b"'), ("right", "", "c")]
    with pytest.raises(Exception, match="column_id"):
        files.column_tsv(spark.createDataFrame([("f", "a\tb\n1\t2")], "file string, value string")).collect()
    js = spark.createDataFrame([("f", '[{"bbox":[0,0,1,1],"type":"text","content":" a "},{"bbox":[0,0],"type":"text","content":"b"},{"bbox":[0,0,1,1],"type":"figure","content":"c"}]')], "file string, value string")
    assert [r["text"] for r in files.mineru_blocks(js).collect()] == ["a"]
    pd_ = spark.createDataFrame([("f", '{"width":100,"height":200,"parsing_res_list":[{"block_bbox":[10,20,50,100],"block_label":"text","block_content":"a"}]}')], "file string, value string")
    r = files.paddle_blocks(pd_).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (0.1, 0.1, 0.5, 0.5)
    mp = spark.createDataFrame([("f", '{"pages":[{"page_width":10,"page_height":10,"lines":[{"cnt":[[1,2],[5,4]],"text":"","text_display":"z"},{"cnt":[[1,1]],"text":"q"}]}]}')], "file string, value string")
    assert [(r["x0"], r["y1"], r["text"]) for r in files.mathpix_blocks(mp).orderBy("block_no").collect()] == [(0.1, 0.4, "z"), (0.0, 0.01, "q")]
    names = spark.createDataFrame([("p", "x.md"), ("p", "a.tsv"), ("q", "a.tsv")], "page string, name string")
    assert {tuple(r) for r in files.backend_of(names).collect()} == {("p", "markdown"), ("q", "tsv")}


def test_status_machine():
    assert events.next_status("queued", "starting") == "starting" and events.next_status("completed", "running") == "completed"


def test_stream_state(spark, tmp_path):
    spark.createDataFrame([("r", 1, "starting"), ("r", 2, "running"), ("r", 3, "completed"), ("s", 1, "running")], "run_id string, sequence long, status string").write.parquet(str(tmp_path / "in"))
    src = events.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = events.run_status(src).writeStream.outputMode("update").format("memory").queryName("run_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["run_id"]: r["status"] for r in spark.table("run_states").collect()}
    assert got == {"r": "completed", "s": "queued"}


def distance(a, b):
    """Edit distance of two sequences by the table of all prefixes."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cost_matrix_against_brute_force(spark):
    gold, pred = ["abc  d", "е́жик", "", "x"], ["abd d", "ежик", "y"]
    side = lambda lines: spark.createDataFrame([("p", k, x) for k, x in enumerate(lines)] + [("q", 0, "same")], "page string, line_idx int, line string")
    got = {(r["page"], r["gold_idx"], r["pred_idx"]): r["ned"] for r in align.cost_matrix(side(gold), side(pred), ["page"]).collect()}
    cut = lambda s: regex.findall(r"\X", " ".join(s.split()))
    want = {("p", i, j): distance(cut(g), cut(p)) / max(len(cut(g)), len(cut(p)), 1) for i, g in enumerate(gold) for j, p in enumerate(pred)} | {("q", 0, 0): 0.0}
    assert got == pytest.approx(want)


def test_cost_matrix_figures_pairs_side_by_side(spark):
    """More pairs than one block holds, lines beyond a machine word; no distance is interpreted token by token."""
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abе ́") for _ in range(rng.choice((3, 9, 70))))
    gold, pred = [line() for _ in range(301)], [line() for _ in range(80)]
    side = lambda lines: spark.createDataFrame([("p", 2, k, x) for k, x in enumerate(lines)] + [("p", 3, 0, None), (None, 2, 0, "same")], "page string, part int, line_idx int, line string")
    df = align.cost_matrix(side(gold), side(pred), ["page", "part"])
    assert "array_position" not in df._jdf.queryExecution().toString()
    got = {tuple(r)[:4]: r["ned"] for r in df.collect()}
    flat = lambda s: " ".join(s.split())
    assert len(gold) * len(pred) > align.SIDE_BY_SIDE and got.pop(("p", 3, 0, 0), 0) is None
    assert got == pytest.approx({("p", 2, i, j): align.ned(flat(p), flat(g)) for i, g in enumerate(gold) for j, p in enumerate(pred)})


def test_distances_of_many_distinct_tokens(spark):
    rng = random.Random(5)
    a = [f"t{k}" for k in range(9000)]
    b = a[:4000] + ["x", "y"] + a[4010:8990] + a[8995:]
    df = spark.createDataFrame([(a, b), ([], a[:3]), (None, a)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(edit.token_distance(F.col("a"), F.col("b"))).collect()][:2] == [15, 3]
    for _ in range(5):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = spark.createDataFrame([(x, y)], "a array<string>, b array<string>").select(edit.token_distance(F.col("a"), F.col("b"))).first()[0]
        assert got == distance(x, y)


def test_recognised_text(spark):
    text = "```markdown\n# ONE ## two\n| a | **b** |\n|---|---|\n\n![x](y)\n$$x^2$$ tail\nHathiTrust page\n12\n- item • two\n[link](u) \\textbf{bold} \\foo{in}\n```\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, value string")
    got = [r["line"] for r in ocr.markdown_lines(docs, ["k"]).orderBy("k", "line_idx").collect()]
    assert got == ["ONE", "two", "a", "<b>b</b>", "tail", "item two", "link <b>bold</b> in"]
    assert ocr.without_noise(None) is None and ocr.without_noise("\\text{a}_{2} x<i>{3}</i> [Unreadable]") == "a2 "


def test_pages_evaluated(spark):
    schema = "page string, record_index int, line_in_record int, marker string, value string"
    gold = spark.createDataFrame([("p", 0, 0, "lx", "lemma"), ("p", 0, 1, "gn", "gloss one"), ("p", 0, 2, "nt", "note"), ("p", 1, 0, "lx", "other"), ("p", 1, 1, "ge", "second"), ("q", 0, 0, "lx", "alone")], schema)
    pred = spark.createDataFrame([("p", 0, 0, "lx", "other"), ("p", 0, 1, "ge", "second"), ("p", 1, 0, "lx", "lemna"), ("p", 1, 1, "ge", "gloss one"), ("p", 1, 2, "ps", "n.")], schema)
    records, lines = align.record_lines(gold, pred, ["page"])
    got = {r["page"]: r.asDict() for r in mdf.page_evaluation(records, lines, ["page"]).collect()}
    p = got["p"]
    assert (p["record_tp"], p["record_fp"], p["record_fn"]) == (2, 0, 0) and p["read_order_edit"] == 1.0
    assert (p["marker_tp"], p["marker_fp"], p["marker_fn"]) == (3, 2, 2)  # gn read as ge, an extra ps, a missing nt
    assert (p["headword_edits"], p["headword_gold_len"], p["gloss_edits"]) == (1, 10, 0)
    assert (got["q"]["record_fn"], got["q"]["read_order_edit"], got["q"]["marker_tp"]) == (1, 1.0, 0)
    wrong = metrics.marker_confusion(lines.where("status = 'matched'"), ["page"], F.col("gold_marker"), F.col("pred_marker"), mdf.marker_class(F.col("gold_marker")) == mdf.marker_class(F.col("pred_marker"))).collect()
    assert [(r["gold_marker"], r["pred_marker"], r["n"]) for r in wrong] == [("gn", "ge", 1)]


def test_read_orders(spark):
    pairs = spark.createDataFrame([("p", [0], [1]), ("p", [1, 2], [0]), ("p", [], [2]), ("p", [3], [])], "page string, gold_idx array<int>, pred_idx array<int>")
    n = spark.createDataFrame([("p", 4), ("q", 2), ("r", 0)], "page string, n_gold int")
    got = {r[0]: r[1] for r in reports.read_order_aligned(pairs, ["page"], n).collect()}
    assert got == {"p": pytest.approx(distance([0, 1, 2, 3], [1, 2, 0]) / 4), "q": 1.0, "r": 0.0}
    df = spark.createDataFrame([(["one two", "", "THREE", "four"], ["three", "one two three", "x"]), ([], ["a"])], "g array<string>, p array<string>")
    assert [r[0] for r in df.select(reports.read_order_collapsed(F.col("g"), F.col("p"))).collect()] == [0.5, 0.0]


def test_word_edits_by_language(spark):
    df = spark.createDataFrame([("p", "a b c", "a x c d", ["E", "F", "F"]), ("p", "", "new", []), ("p", None, None, None)], "page string, gold string, pred string, languages array<string>")
    got = {r["language"]: (r["word_edits"], r["gold_words"]) for r in metrics.per_language_words(df, ["page"]).collect()}
    assert got == {"E": (0, 1), "F": (2, 2), "other": (1, 0)}


def test_normal_labels(spark):
    df = spark.createDataFrame([("  A,  b ", list("12345678"))], "t string, l array<string>")
    r = df.select(labels.normal_carrying(F.col("t"), F.col("l")).alias("r")).first()["r"]
    assert (r["text"], r["labels"]) == ("a; b", ["3", "4", "5", "7"])
    r = spark.createDataFrame([("Straße", list("123456"))], "t string, l array<string>").select(labels.casefold_carrying(F.col("t"), F.col("l")).alias("r")).first()["r"]
    assert (r["text"], "".join(r["labels"])) == ("strasse", "1234556")


def test_cache_of_other_versions(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "page string, n int")
    at = f"file://{tmp_path}/cache"
    assert incremental.load_cache(spark, at, 3, df.schema).count() == 0
    incremental.save_cache(df, at, 3)
    assert incremental.load_cache(spark, at, 3, df.schema).collect() == df.collect() and incremental.load_cache(spark, at, 4, df.schema).count() == 0


def test_pages_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b/page_1", 0, "x"), ("a b/page_1", 1, "y"), ("c", 0, "")], "page string, line_idx int, line string")
    files.write_flat(rows, f"file://{tmp_path}/flat")
    assert (tmp_path / "flat/a b/page_1_stage1_flat.txt").read_text() == "x\ny\n" and (tmp_path / "flat/c_stage1_flat.txt").read_text() == ""
    files.write_records_out(spark.createDataFrame([("p", "\\lx a")], "page_id string, mdf_text string"), rows, f"file://{tmp_path}/out")
    assert (tmp_path / "out/records/p.mdf").read_text() == "\\lx a\n"
    files.write_report(rows, f"file://{tmp_path}/report", rows)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report/csv").count() == 3


def test_merges_of_lines():
    gold = ["the first line of the page", "short", "another line that was printed"]
    assert align.match_page(gold, ["the first", "line of the page", "short", "another line", "that was printed"]) == [([0], [0, 1], 0.0), ([1], [2], 0.0), ([2], [3, 4], 0.0)]
    # a gold line inside a prediction, and predictions alone
    got = align.match_page(["abcdefgh", "ijklmnop", "tail"], ["abcdefgh ijklmnop", "qqqqqqqqqqqq", "zzzzzzzzz", "tail"])
    assert ([2], [3], 0.0) in got and sorted(p for _, ps, _ in got for p in ps) == [0, 1, 2, 3] and any(g == [0, 1] and p == [0] for g, p, _ in got)
    assert align.match_page([], ["a", "b"]) == [([], [0, 1], 1.0)] and align.match_page(["abc"], ["xyz"]) == [([0], [0], 1.0)]
    assert align.settled([((0, 1), 0.5), ((1, 2), 0.1), ((3,), 0.2), ((3,), 0.1)]) == [(1, 2), (3,)]
    rng = random.Random(9)
    for _ in range(60):  # every line of both sides comes out once
        g, p = (["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))).strip() or "a" for _ in range(rng.randrange(7))] for _ in range(2))
        got = align.match_page(g, p)
        assert sorted(x for a, _, _ in got for x in a) == list(range(len(g)))
        assert set(x for _, b, _ in got for x in b) == set(range(len(p)))


def test_windows_against_brute_force():
    rng = random.Random(12)
    for _ in range(400):
        part, whole = ("".join(rng.choice("abcde\u0301"[: rng.choice((3, 5, 6))]) for _ in range(rng.randrange(n))) for n in (9, 18))
        want = min((align.ned(part, whole[i : i + len(part)]) for i in range(len(whole) - len(part) + 1)), default=None) if part else None
        for limit in (0.4, 0.6):
            got = align.window_ned(part, whole, {}, limit)
            assert got == want if want is None or want <= limit else got > limit


def test_distances_side_by_side():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcde\u0301 ") for _ in range(rng.choice((0, 1, 5, 30, 62, 63, 64, 90))))
    pairs = [(word(), word()) for _ in range(400)] + [("same", "same"), ("", "")]
    assert align.ned_many(pairs).tolist() == [align.ned(a, b) for a, b in pairs]
    assert align.ned_many([]).tolist() == []
