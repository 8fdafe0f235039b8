"""Operators for training text: brute force, round trips, held-out accuracy, and broken input."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import language, leakage, mixing, quality, scan, spelling, truncation

COMMON = quality.Tokens(frozenset("the of and a in to is it that was for on are as with his they at be this".split()))
PROSE = "It was a cold day in the village and they went to the river with the boat. The old man said that it was time to go. "
TEXTS = st.text(st.sampled_from("ab the of\n \t|;,.=—1<td>é̃"), max_size=400)


# quality (8)


def whole_figures(text):
    """Line by line over the whole text, without chunks or states."""
    acc, seen = [0] * (10 + quality.N), set()
    for line in text.split("\n"):
        if line and (v := quality.count(line, COMMON, seen)[0])[quality.T]:
            quality.put(acc, v, line.lstrip(), line.rstrip())
    return quality.derive(acc, seen)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_chunks_give_the_same_figures(text, size):
    parts = [quality.scan(text[i : i + size], COMMON) for i in range(0, len(text), size)] or [quality.scan("", COMMON)]
    while len(parts) > 1:
        parts = [quality.merge(*parts[i : i + 2], COMMON) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert quality.finish(quality.unpack(quality.pack(parts[0])), COMMON) == whole_figures(text)


@pytest.mark.parametrize(
    "text, shape",
    [
        (PROSE, "prose"), (PROSE.replace(". ", ".\n"), "prose"), ("\n".join(["dinain", "denai", "kvurnais", "mikeren", "redai"] * 3), "list"), ("birch, empty shell, kokim, rami, smoke hole, cooking pot, wet clay, beeswax, lullaby", "list"),
        ("| a | n. | dog | 1 |\n| b | n. | cat | 2 |\n| c | v. | run | 3 |", "table"), ("x\tn.\tdog\t12\ny\tv.\tcat\t13", "table"), ("<tr><td>a</td><td>b</td></tr>", "table"), ("lx=a ps=n. ge=dog\nlx=b ps=v. ge=cat", "table"), ("a;n.;dog;5\nb;v.;cat;6", "table"),
        ("the dog barks. " * 40, "junk"), ("Ð¡ÑÐ°ÑÑÑ Ð¾Ð±ÑÑÐ²Ð°ÐµÑÑÑ", "junk"), ("#,|/I#``l I;#\\//`=~|\\.° #.§;~`+I|.\n`1I.#^|§ ^*_§=^", "junk"), ("th ~n~xf pe.,,z.l1.v .,kw tp~g ~lm,cm an ad1j1m; ; rf~w aah ;v,1lh~w,ld | oz,g", "junk"), ("", "prose"),
    ],
)
def test_shapes(text, shape):
    assert quality.figures(text, COMMON)["shape"] == shape


@pytest.mark.parametrize("text", ["QUJD/" * 600 + " tail.\n" + "b" * 5000, "ab\n" + "х" * 3000 + ", " + "y;z" * 1500 + "\nthe end.", "a" * 2500, "!" * 2200 + "x one\n", "\n".join("w%d" % k for k in range(5000))])
@pytest.mark.parametrize("size", [700, 4000])
def test_long_tokens_are_counted_whole(text, size):
    parts = [quality.unpack(quality.pack(quality.scan(text[i : i + size], COMMON))) for i in range(0, len(text), size)]
    state = parts[0]
    for part in parts[1:]:
        state = quality.merge(state, part, COMMON)
    got = quality.finish(state, COMMON)
    assert got == whole_figures(text) == quality.figures(text, COMMON)
    assert (got["tokens"], got["distinct_words"]) == (len(text.split()), len(set(text.split())))


@pytest.mark.parametrize("text", ["x" * 70000 + " the end is near.", "天地玄黄。" * 20000, "well-" * 40000 + "known", "a b\n" + "q" * 200_000 + " c"])
def test_huge_tokens_on_any_chunking(text):
    assert quality.figures(text, COMMON) == quality.figures(text, COMMON, 1000) == quality.figures(text, COMMON, 65_536) == whole_figures(text)


def test_quality_table(spark):
    docs = [(1, PROSE * 50, "x"), (1, PROSE * 50, "x"), (2, None, "x"), (3, "", "x"), (4, "\n".join("word%d" % k for k in range(4000)), "x"), (5, PROSE * 300 + "\n" + "z" * 3000, "x"), (5, PROSE * 300 + "\n" + "z" * 3000, "x"), (None, "one two", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, shape string")
    words = spark.createDataFrame([("en", w) for w in COMMON.common] + [(None, None)], "lang string, word string")
    want = {i: whole_figures(t or "") for i, t, _ in docs}
    for chunk, spread in ((quality.CHUNK, quality.SPREAD), (500, 2000), (333, 10)):
        rows = [r.asDict() for r in quality.text_quality(df, words, chunk, spread).collect()]
        assert len(rows) == 6 and {r.pop("doc_id"): r for r in rows} == want
    assert want[2]["words"] == 0 and want[2]["shape"] == "prose"
    assert quality.text_quality(df.limit(0), words).count() == 0


# spelling (4)


@pytest.mark.parametrize(
    "text, plain",
    [
        ("plain", "plain"), ("fоіn", "foin"), ("засyxa", "засуха"), ("été", "été"), ("ｗｉｄｅ", "wide"), ("a b", "a b"), ("sa​k⁠lat", "saklat"), ("ﬁn", "fin"), ("ɲʊθɛβ", "ɲʊθɛβ"), ("ɛ̃", "ɛ̃"), ("ξoπα", "ξοπα"),
        ("x²", "x²"), ("q’éx — «a»", "q’éx — «a»"), ("broken­\nword", "broken­\nword"), ("bro­ken", "broken"), ("ӱ", "ӱ"), ("", ""),
    ],
)
def test_plain(text, plain):
    assert spelling.plain(text)[0] == plain


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_plain_is_stable(text):
    once = spelling.plain(text)[0]
    assert spelling.plain(once)[0] == once


def test_skeleton_groups(spark):
    rows = spark.createDataFrame([(1, "D", "котёл корова"), (2, "D", "кoтёл"), (3, "D", None), (4, "D", "")], "row_id bigint, dictionary string, text string")
    got = spelling.look_alike_groups(rows).collect()
    assert [(r["forms"], r["occurrences"]) for r in got] == [(2, 2)]
    names = spark.createDataFrame([("D", "Orvani-Latin", ["French-Latin"])], "dictionary string, source_label string, target_labels array<string>")
    r = {x["row_id"]: (x["plain"], x["differs"]) for x in spelling.respelled(rows.unionByName(spark.createDataFrame([(5, "D", "ν.tr.")], rows.schema)), names).collect()}
    assert r[2] == ("котёл", True) and r[5] == ("v.tr.", True) and r[1][1] is False and 3 not in r


def test_words_in_look_alikes_follow_their_group(spark):
    lines = [(i, "D", "ссора и мир") for i in range(60)] + [(120, "D", "ccopa"), (122, "D", "о"), (123, "D", "o"), (124, "E", "ccopa"), (125, None, "ccopa")]
    lines += [(200 + i, "D", "asap api") for i in range(12)] + [(250, "D", "аѕар")]
    lines += [(300 + i, "D", "e") for i in range(12)] + [(350, "D", "ёлка"), (351, "D", "её")]
    names = spark.createDataFrame([("D", "Orvani-Cyrillic", ["Indonesian-Latin"]), ("E", "Tesmek-Latin", ["English-Latin"])], "dictionary string, source_label string, target_labels array<string>")
    tables = {
        "dictionaries": names, "field_lines": spark.createDataFrame(lines, "line_id bigint, dictionary string, value string"),
        "mdf_value_projections": spark.createDataFrame([(1, "D", "ccopa"), (1, "D", "ccopa"), (2, "D", None)], "value_id bigint, dictionary string, normalized_value string"),
        "stage1_projections": spark.createDataFrame([(1, "D", "мир\nccopa 2"), (2, "E", "fоіn")], "stage1_id bigint, dictionary string, text string"),
    }
    got = sorted(map(tuple, spelling.spelling_found(tables).collect()))
    assert got == [("field_lines", 120), ("field_lines", 250), ("mdf_value_projections", 1), ("stage1_projections", 1), ("stage1_projections", 2)]


# scans (3)

WORDS = scan.Words({w: 50 for w in "the wooden ladle grand-mère arc-en-ciel village broken paddle depuis winter kept for musim котёл медный children".split()})


@pytest.mark.parametrize("read, printed", [("villagc", "village"), ("vvinter", "winter"), ("depiiis", "depuis"), ("ladlc", "ladle"), ("chi1dren", "children"), ("когёл", "котёл"), ("rnusim", "musim"), ("zebra", ""), ("village", "")])
def test_misread(read, printed):
    assert WORDS.printed(read) == printed


def test_lines():
    text = "Kamus Orvani   12\nthe wooden la-\ndle kept for vvinter. arc-\nen-ciel depuis\n- 12 -\n\nmópo — mupo\nthe vi=\nllage"
    rows = {(n, k) for n, k, _, _ in scan.analyse(text, "Kamus Orvani", 12, WORDS)[0]}
    assert rows == {(1, "header"), (2, "hyphen"), (3, "misread"), (5, "page_number"), (7, "header"), (8, "hyphen")}
    body = scan.analyse(text, "Kamus Orvani", 12, WORDS, True)[1]
    assert body[1][2].startswith("dle kept for winter")
    assert scan.analyse("", "", None, WORDS) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_any_scan(text):
    rows, body = scan.analyse(text, "Kamus Orvani", 3, WORDS, True)
    n = text.count("\n") + 1
    assert all(1 <= r[0] <= n for r in rows) and all(1 <= b[0] <= n for b in body)


def test_masked_lines_that_return_are_heads(spark):
    """Heads without title or guide words are told by their return on pages; a line of one page isn't."""
    text = lambda k: f"Letter section  {k}\n{'abcdefghij'[k] * 3} wooden ladle was kept for\nwinter. the village\nof the village {'abcdefghij'[k] * 2}.\n- {k} -"
    pages = [(k, f"D/page_{k}", "D", text(k)) for k in range(10)] + [(3, "D/page_3", "D", text(3)), (20, "E/page_1", "E", text(1)), (21, None, None, "x"), (22, "D/page_40", "D", "")]
    t = {
        "stage1_projections": spark.createDataFrame(pages, "stage1_id bigint, page_id string, dictionary string, text string"), "neighbor_pages": spark.createDataFrame([(1, "D/page_2", "page_1", text(1)), (2, None, None, None)], "neighbor_id bigint, page_id string, stem string, transcript string"),
        "layout_blocks": spark.createDataFrame([(1, "D/page_1", "Letter section 12")], "block_row_id bigint, page_id string, text string"), "dictionaries": spark.createDataFrame([("D", "Kamus Orvani")], "dictionary string, title string"),
        "field_lines": spark.createDataFrame([(1, "D", "ge", "wooden ladle")], "line_id bigint, dictionary string, marker string, value string"),
    }
    heads = [tuple(r) for r in scan.returning_heads(t).collect()]
    assert heads == [("D", scan.masked("Letter section 5"), 10, 11)]
    rows = {tuple(r)[:4] for r in scan.noise_found(t).collect()}
    assert {("stage1_projections", k, 1, "header") for k in range(10)} | {("neighbor_pages", 1, 1, "header"), ("layout_blocks", 1, 1, "header")} == {r for r in rows if r[3] == "header"}
    assert scan.noise_found({k: v.limit(0) for k, v in t.items()}).count() == 0


def test_rare_words_and_long_page_numbers(spark):
    """A target word is known by its places, whatever share of all words they are; a word cut off at the end of a page is none; page numbers have any length."""
    rows = [(f"D/page_{k // 40}", k % 40, 0, "ge", "wooden ladle; kept") for k in range(150_000)]
    rows += [(f"D/page_{k}", 50, 0, "ge", "Türschwelle" if k % 2 else "ｂａｒｎａｃｌｅ") for k in range(8)]
    rows += [(f"D/page_{k}", 90, k % 2, "ge", "near the barnac" + ("..." if k > 30 else "")) for k in range(60)] + [("D/page_1", 90, 1, "ge", "near the barnac")] * 9
    lines = spark.createDataFrame(rows, "page_id string, record_index int, line_index int, marker string, value string")
    got = scan.vocabulary(lines.repartition(8))
    assert got["türschwelle"] == got["barnacle"] == 4 and "barnac" not in got and {"wooden", "ladle", "kept"} <= set(got)
    words = scan.Words(got)
    pages = [(scan.analyse(f"{no}\nthe wooden barnaclc was\nkept.", "", page, words)[0]) for no, page in (("— 123456 —", 123456), ("p. l04512", 104512), ("[l5l]", 7000151))]
    assert [{r[:2] for r in rows} for rows in pages] == [{(1, "page_number"), (2, "misread")}] * 3


# truncation (2)


def test_cut_texts(spark):
    body = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} the ladle of the village." for k in range(40))
    rec = "\n\n".join(f"\\lx head{chr(97 + k)}x\n\\ps n.\n\\ge wooden ladle {chr(97 + k)}q\n\\dt 0{k % 9 + 1}/Mar/2001" for k in range(24))
    pages = [(1, "D/page_1", "D", "f", rec), (2, "D/page_2", "D", "f", rec[:-6]), (2, "D/page_2", "D", "f", rec[:-6]), (3, "D/page_3", "D", "f", None), (4, "D/page_4", "D", "f", rec + "\n\n\\lx")]
    texts = [(1, "D/page_1", "D", "f", body), (2, "D/page_2", "D", "f", body[:500]), (3, "D/page_3", "D", "f", body[:300] + "[...]"), (4, "D/page_4", "D", "f", ""), (5, "D/page_5", "D", "f", body[:400])]
    near = [(k, f"D/page_{k + 1}", "previous", f"page_{k}", body.replace(" the ", "\nthe ")) for k in (1, 2)] + [(9, "D/page_9", "next", None, None)]
    t = {
        "dictionary_pages": spark.createDataFrame(pages, "page_key bigint, page_id string, dictionary string, source_file string, mdf_text string"), "stage1_projections": spark.createDataFrame(texts, "stage1_id bigint, page_id string, dictionary string, source_file string, text string"),
        "neighbor_pages": spark.createDataFrame(near, "neighbor_id bigint, page_id string, side string, stem string, transcript string"), "dictionaries": spark.createDataFrame([("D", "Kamus D")], "dictionary string, title string"),
    }
    got = {tuple(r) for r in truncation.truncated_found(t).collect()}
    assert got == {("dictionary_pages", 2), ("dictionary_pages", 4), ("stage1_projections", 2), ("stage1_projections", 3), ("stage1_projections", 5)}
    cause = {tuple(r[:2]): r["cause"] for r in truncation.cut_texts(t).collect()}
    assert cause["stage1_projections", 2] == "copy" and cause["dictionary_pages", 1] is None
    empty = {k: v.limit(0) for k, v in t.items()}
    assert truncation.truncated_found(empty).count() == 0


def test_windows_meet_copies():
    rng = random.Random(3)
    some = lambda: truncation.letters("".join(rng.choice("abdefgihkmrstvw") for _ in range(2000)))
    text = some()
    h, p = truncation.windows(text)
    assert p[0] == 0 and len(h) == len(p) > 8 and (np.diff(p) > 0).all()
    for k in p.tolist():  # a window's hash depends on its letters alone
        assert truncation.windows(text[k : k + truncation.PREFIX])[0][0] == h[p.tolist().index(k)]
    a, b = truncation.windows(text[:900]), truncation.windows(np.append(np.array([120, 121], np.uint32), text))
    last = slice(-truncation.TAIL, None)
    assert truncation.goes_on(900, a[0][last].tolist(), a[1][last].tolist(), len(text) + 2, b[0].tolist(), b[1].tolist()) == len(text) - 900
    other = truncation.windows(some())
    assert truncation.goes_on(900, a[0][last].tolist(), a[1][last].tolist(), 1500, other[0].tolist(), other[1].tolist()) is None
    assert len(truncation.windows(truncation.letters("short"))[0]) == len(truncation.windows(truncation.letters(""))[0]) == 0
    assert truncation.letters("The mo-\nrn clock 12.").tolist() == truncation.letters("the momclock").tolist() != []


def test_copies_elsewhere_and_hot_starts(spark):
    """A longer copy counts under any page and source; a window that many texts start with is met by page."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ka to mi re su vel dor nin gar pek".split()) for _ in range(3))
    front = " ".join(word() for _ in range(60))
    bodies = [front + " " + " ".join(word() for _ in range(200)) + "." for _ in range(40)]
    alone = " ".join(word() for _ in range(200)) + "."
    texts = [(k, f"D/page_{k}", "D", "f", b if k % 4 else b[:900] + ".") for k, b in enumerate(bodies)] + [(90, "D/page_90", "D", "f", alone[:700] + "."), (91, "E/page_2", "E", "g", alone), (92, None, None, None, alone)]
    near = [(k, f"D/page_{k + 1}", "previous", f"page_{k}", b) for k, b in enumerate(bodies)]
    t = {
        "dictionary_pages": spark.createDataFrame([], "page_key bigint, page_id string, dictionary string, source_file string, mdf_text string"), "stage1_projections": spark.createDataFrame(texts, "stage1_id bigint, page_id string, dictionary string, source_file string, text string"),
        "neighbor_pages": spark.createDataFrame(near, "neighbor_id bigint, page_id string, side string, stem string, transcript string"), "dictionaries": spark.createDataFrame([("D", "Kamus D")], "dictionary string, title string"),
    }
    want = {k for k in range(0, 40, 4)} | {90}
    for hot in (truncation.HOT, 10):
        got = {r["row_id"]: r["cause"] for r in truncation.cut_texts(t, hot).where("cut").collect()}
        assert got == {k: "copy" for k in want}

def test_copies_of_hot_starts_under_other_pages(spark):
    """A start that many texts have doesn't hide the longer copy of a text under another page."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ka to mi re su vel dor nin gar pek".split()) for _ in range(3))
    front = " ".join(word() for _ in range(60))
    bodies = [front + " " + " ".join(word() for _ in range(200)) + "." for _ in range(30)]
    texts = [(k, f"D/page_{k}", "D", "f", b[:900] + ".") for k, b in enumerate(bodies)] + [(100 + k, f"E/page_{k}", "E", "g", b) for k, b in enumerate(bodies[:-5])]
    t = {
        "dictionary_pages": spark.createDataFrame([], "page_key bigint, page_id string, dictionary string, source_file string, mdf_text string"), "stage1_projections": spark.createDataFrame(texts, "stage1_id bigint, page_id string, dictionary string, source_file string, text string"),
        "neighbor_pages": spark.createDataFrame([], "neighbor_id bigint, page_id string, side string, stem string, transcript string"), "dictionaries": spark.createDataFrame([("D", "Kamus D")], "dictionary string, title string"),
    }
    values = truncation.texts(t)
    for hot in (truncation.HOT, 10):
        assert {r["row_id"] for r in truncation.cut_texts(t, hot).where("cause = 'copy'").collect()} == set(range(25))
    every, met = ({tuple(r) for r in truncation.pairs(values, h).collect()} for h in (10**9, 10))
    assert met < every and {(1, k, 1, 100 + k) for k in range(25)} <= met


# languages (1)


def test_codes():
    assert [language.code_of(x) for x in ("en", "EN-gb", "eng", "fr_CA", "xx", "", None, "und", "Deutsch")] == ["en", "en", "en", "fr", "", "", "", "", "de"]


def test_classifier_holds_out():
    rng = random.Random(4)
    say = {"x": "ka to mi re su".split(), "y": "bren dolf grum tark vist".split(), "z": "élou nié prâ sué toî".split()}
    texts, labels = [], []
    for k in range(240):
        name = "xyz"[k % 3]
        texts.append(" ".join("".join(rng.choice(say[name]) for _ in range(rng.randrange(1, 4))) for _ in range(5)))
        labels.append(name)
    m = language.fit(texts[:120], labels[:120])
    words = [language.LETTERS.findall(t) for t in texts[120:]]
    m.learn({w for ws in words for w in ws})
    got = [m.labels[k] for k in m.sums(words).argmax(1)]
    assert np.mean([a == b for a, b in zip(got, labels[120:])]) > 0.97


def test_runs_of_sentences():
    found = lambda *c: {x for x, _ in language.languages_in([(k, 0.9) for k in c])}
    assert found("en", "en", "fr", "en") == {"en"} and found("en", "fr", "fr") == {"fr"} and found("de") == {"de"} and found() == set() and found("", "en", "en") == {"en"}
    assert language.path([[1.0, 0.0], [0.4, 0.5], [1.0, 0.0]], [False] * 3, [False] * 3) == [0, 0, 0]


def test_sentence_spans_are_the_sentences():
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choice(["one two three. ", "Yes. ", "four five six seven!\n", " ", "a b c? "]) for _ in range(rng.randrange(8)))
        spans = language.sentence_spans(t)
        words = lambda x: language.LETTERS.findall(x)  # noqa: E731  the marks between sentences stand in the spans
        assert [words(t[a:b]) for a, b in spans] == [words(x) for x in language.sentences(t)]
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert language.runs([(0, 3, "", 0.0), (3, 5, "en", 0.8), (6, 7, "", 0.0), (7, 9, "fr", 0.6), (9, 12, "fr", 0.8)]) == [(0, 7, "en", 0.8), (7, 12, "fr", pytest.approx(0.7))]


# leakage (6)


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(2)
    for n, size in ((1, 3), (50, 3), (2000, 5), (3000, 40)):
        seq = rng.integers(1, size, n)
        fm = leakage.FMIndex(seq, size)
        phrases = rng.integers(1, size, (40, 3))
        lo, hi = fm.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(n - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(fm.locate(np.arange(a, b)).tolist() if b > a else []) == want


def noisy(words, rng, rate=1 / 14):
    out = []
    for k, w in enumerate(words):
        r = rng.random()
        if r < rate and k % 9 == 4:
            out += rng.choice([[], [w, "zzz"], [w[::-1] + "q"]])
        else:
            out.append(w)
    return out


def test_leaks_are_found_and_others_not(spark):
    rng = random.Random(5)
    head = lambda: "".join(rng.choice("ka to mi re su vel dor nin".split()) for _ in range(3))
    build = lambda: f"The plural of {head()} is {head()}, and both forms were recorded in {head().title()} during {rng.randrange(1850, 1999)}. The entry for {head()} begins on page {rng.randrange(900)}, just below the drawing of a {head()}."
    items = [(k, build() + " " + build()) for k in range(60)]
    docs, want = [], set()
    for k in range(200):
        words = (build() + " " + build()).split()
        if k % 4 == 0:
            i, text = items[k % 60]
            w = text.split()
            a = rng.randrange(0, len(w) - 30)
            words[10:10] = [x.upper() if rng.random() < 0.3 else x.strip(",.") for x in noisy(w[a : a + 30], rng)]
            want.add((k, i))
        elif k % 4 == 1:  # shorter than a passage
            w = items[k % 60][1].split()
            words[10:10] = w[5:17]
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame(items + [(99, None), (98, "short one")], "item_id bigint, text string")
    got = {tuple(r) for r in leakage.leaks_found(df, ev).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    spans = leakage.removal_spans(df, ev).collect()
    assert spans and all(r["last_word"] - r["first_word"] >= 15 for r in spans)
    whole = {tuple(r) for r in leakage.passages(df, ev).collect()}
    assert {tuple(r) for r in leakage.passages(df, ev, shard_words=70).collect()} >= whole
    assert {tuple(r) for r in leakage.passages(df, ev, block=15).collect()} == whole
    assert leakage.leaks_found(df.limit(0), ev).count() == 0 and leakage.leaks_found(df, ev.limit(0)).count() == 0


def test_items_without_rare_words_are_found(spark):
    """Copies of an item under many ids, and items of few words that all share: whole passages are found, shorter ones aren't."""
    rng = random.Random(11)
    words = [f"w{chr(97 + k % 20)}{chr(97 + k // 20)}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(120)]
    items = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone") for k in range(50)]
    docs = [(k, "xx " * 7 + " ".join(texts[k].split()[k % 25 : k % 25 + 22]).upper() + " yy" * 5) for k in range(0, 100, 3)]
    docs += [(500, "a b " + items[-1][1] + " c"), (501, " ".join(texts[7].split()[3:22])), (502, " ".join(rng.choice(words) for _ in range(400)))]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leakage.leaks_found(df, ev).collect()}
    assert got == {(k, k) for k in range(0, 100, 3)} | {(500, 1000 + k) for k in range(50)}


# mixing (7)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_knapsack_against_brute_force(items, goal):
    lengths, counts = np.array([a for a, _ in items]), np.array([b for _, b in items])
    reach = {0}
    for n, c in items:
        reach = {s + n * k for s in reach for k in range(c + 1)}
    got = mixing.knapsack(lengths, counts, goal)
    assert (got >= 0).all() and (got <= counts).all() and int((got * lengths).sum()) == max(s for s in reach if s <= goal)


def test_fill_large():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(20, 3000, 900))
    counts = rng.integers(1, 400, len(lengths))
    goal = int((lengths * counts).sum() * 0.37)
    got = mixing.fill(lengths, counts, goal)
    assert (got <= counts).all() and int((got * lengths).sum()) == goal


def test_mix(spark):
    docs = [(k, "word " * (k % 7 + 3), "a" if k % 3 else "b", "clash") for k in range(300)] + [(1, "word " * 4, "a", ""), (900, None, "a", ""), (901, "x y", None, ""), (902, "x y", "untargeted", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, times string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("none", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, targets)
    rows = mix.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) and {r["source"] for r in rows} == {"a", "b"}
    most = {"a": 1, "b": 2}
    assert all(1 <= r["times"] <= most[r["source"]] for r in rows)
    got = {r["source"]: r["reached_share"] for r in shares.collect() if r["source"]}
    assert got["a"] == pytest.approx(0.625, abs=0.01) and got["b"] == pytest.approx(0.375, abs=0.01) and got["none"] == 0
    again = {r["doc_id"]: r["times"] for r in mixing.mixed(df, targets)[0].collect()}
    assert again == {r["doc_id"]: r["times"] for r in rows}
    assert mixing.mixed(df.limit(0), targets)[0].count() == 0


def test_normal_forms_of_the_table():
    assert all(unicodedata.normalize("NFC", c) == c for c in spelling.PROTOTYPE)
    assert F is not None
