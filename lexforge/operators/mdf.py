"""Marker-based lexicon records (`\\marker value` lines, records between blank lines): parsing, writing, checking, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions.text import end_punctuation, mdf_value, normalise_marker, split_gloss, strip

LINE = r"^\\([A-Za-z0-9_-]+)(?U)\s+(.*)$"


def parse_mdf(pages: DataFrame, keys: list[str], text: str = "mdf_text") -> DataFrame:
    """keys, record_index, line_in_record, line_index, marker, value.

    A blank line ends a record; lines that are no `\\marker value` after stripping are skipped, so a marker without a
    value is dropped; line_index counts the kept lines of the page from 0. All windows share the page keys: one shuffle.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: strip(x)),
        lambda x: (x == "") | x.rlike(LINE),
    )
    numbered = pages.select(*keys, F.posexplode(lines).alias("_pos", "_line"))
    by = W.partitionBy(*keys).orderBy("_pos")
    numbered = numbered.withColumn("_block", F.sum((F.col("_line") == "").cast("int")).over(by)).where(F.col("_line") != "")
    out = numbered.withColumn("record_index", (F.dense_rank().over(W.partitionBy(*keys).orderBy("_block")) - 1).cast("int"))
    return out.select(
        *keys, "record_index", (F.row_number().over(W.partitionBy(*keys, "_block").orderBy("_pos")) - 1).cast("int").alias("line_in_record"), (F.row_number().over(by) - 1).cast("int").alias("line_index"),
        F.regexp_extract("_line", LINE, 1).alias("marker"), strip(F.regexp_extract("_line", LINE, 2)).alias("value"),
    )


def records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, record_index, headword, fingerprint (markers and values in order), n_lines."""
    item = lambda x: F.concat_ws(" ", x["marker"], x["value"])
    rows = F.array_sort(F.collect_list(F.struct("line_in_record", "marker", "value")))
    g = lines.groupBy(*keys, "record_index").agg(rows.alias("_l"))
    return g.select(*keys, "record_index", F.get(F.filter("_l", lambda x: x["marker"] == "lx"), F.lit(0))["value"].alias("headword"), F.array_join(F.transform("_l", item), "\n").alias("fingerprint"), F.size("_l").alias("n_lines"))


def write_records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mdf_text: records joined by a blank line, lines in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("line_in_record", "marker", "value"))), lambda x: F.concat(F.lit("\\"), x["marker"], F.lit(" "), x["value"]))
    recs = lines.groupBy(*keys, "record_index").agg(F.array_join(line, "\n").alias("_t"))
    return recs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_index", "_t"))), lambda x: x["_t"]), "\n\n").alias("mdf_text"))


def propagate_blocks(entries: DataFrame, page: list[str], order: str) -> DataFrame:
    """Adds main_headword (of the last main entry so far, with its homonym number) and record_no; entries before the first main one get 0."""
    by = W.partitionBy(*page).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    main = F.col("entry_type") == "main"
    name = F.concat_ws(":", "headword", F.col("homonym_number").cast("string"))
    return entries.withColumn("main_headword", F.last(F.when(main, name), ignorenulls=True).over(by)).withColumn("record_no", F.sum(main.cast("int")).over(by))


def valid_entry(entries: DataFrame) -> DataFrame:
    """Homonym numbers only on main entries, sense numbers only on senses, parents only on children; numbers below 1 are null."""
    number = lambda c: F.when(F.col(c) >= 1, F.col(c))
    return entries.withColumns({
        "homonym_number": F.when(F.col("entry_type") == "main", number("homonym_number")), "sense_number": F.when(F.col("entry_type") == "sense", number("sense_number")),
        "parent_lexeme": F.when(F.col("entry_type") != "main", F.nullif(F.col("parent_lexeme"), F.lit(""))),
    })


def entry_issues(entries: DataFrame, page: list[str], order: str) -> DataFrame:
    """One row an issue: page, order, severity, rule."""
    e = propagate_blocks(entries, page, order)
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    kind = F.col("entry_type")
    examples, translations = F.size(F.coalesce("examples", F.array())), F.size(F.coalesce("example_glosses", F.array()))
    rules = (
        ("error", "no_headword", blank("headword") & (kind != "sense")), ("error", "child_before_main", (kind != "main") & F.col("main_headword").isNull()), ("error", "child_without_parent", (kind != "main") & blank("parent_lexeme")),
        ("warning", "main_with_parent", (kind == "main") & ~blank("parent_lexeme")), ("warning", "sense_without_number", (kind == "sense") & F.col("sense_number").isNull()), ("warning", "no_gloss", blank("gloss") & blank("gloss_secondary")),
        ("warning", "examples_unpaired", (examples > 0) & (translations > 0) & (examples != translations)), ("error", "unknown_type", ~kind.isin("main", "subentry", "sense")),
    )
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, test in rules]))
    return e.select(*page, order, F.explode(found).alias("i")).select(*page, order, "i.severity", "i.rule")


def entry_lines(entries: DataFrame, keys: list[str], gloss_marker: str = "ge", second_marker: str = "gn") -> DataFrame:
    """keys, mdf: an entry's lines in the order headword, homonym, part of speech, phonetic, glosses, references, examples with translations."""
    line = lambda m, c: F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit(f"\\{m} "), end_punctuation(strip(c))))
    many = lambda m, arr: F.transform(arr, lambda x: F.concat(F.lit(f"\\{m} "), mdf_value(strip(x))))
    head = F.when(F.col("entry_type") == "subentry", "\\se ").when(F.col("entry_type") == "sense", "\\sn ").otherwise("\\lx ")
    name = F.when(F.col("entry_type") == "sense", F.coalesce(F.col("sense_number").cast("string"), F.lit("1"))).otherwise(F.col("headword"))
    pairs = F.flatten(F.transform(F.arrays_zip(F.coalesce("examples", F.array()).alias("a"), F.coalesce("example_glosses", F.array()).alias("b")), lambda p: F.array_compact(F.array(F.when(p["a"].isNotNull(), F.concat(F.lit("\\xv "), strip(p["a"]))), F.when(p["b"].isNotNull(), F.concat(F.lit("\\xe "), strip(p["b"])))))))
    glosses = lambda c, m: F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(many(m, split_gloss(F.col(c))))
    parts = F.concat(
        F.array_compact(F.array(F.concat(head, name), line("hm", F.when(F.col("homonym_number") >= 1, F.col("homonym_number").cast("string"))), F.when(F.coalesce("pos", F.lit("")) != "", F.concat(F.lit("\\ps "), strip(F.col("pos")))), F.when(F.coalesce("phonetic", F.lit("")) != "", F.concat(F.lit("\\ph "), strip(F.col("phonetic")))))),
        glosses("gloss", gloss_marker), glosses("gloss_secondary", second_marker), F.transform(F.coalesce("cross_references", F.array()), lambda x: F.concat(F.lit("\\cf "), strip(x))), pairs,
    )
    return entries.select(*keys, F.array_join(parts, "\n").alias("mdf"))


def blocks(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, block_no, block, headword: blocks between blank lines with markers made comparable; empty ones are dropped."""
    b = texts.select(*keys, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("block_no", "block")).withColumn("block", strip(F.col("block"))).where("block <> ''")
    lines = F.transform(F.split("block", "\n"), lambda x: F.concat(F.lit("\\"), normalise_marker(F.regexp_extract(strip(x), r"^\\(\w+)", 1)), F.lit(" "), strip(F.regexp_replace(strip(x), r"^\\\w+\s*", ""))))
    return b.select(*keys, "block_no", F.array_join(lines, "\n").alias("block"), F.regexp_extract("block", r"(?m)^\\lx\s+(.+)$", 1).alias("headword"))


def compare_blocks(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched (gold blocks that stand in pred), missing, extra, headword precision and recall; repeated blocks count each time."""
    mark = lambda df, name: df.select(*keys, "block").distinct().withColumn(name, F.lit(True))
    g = gold.join(mark(pred, "hit"), [*keys, "block"], "left").groupBy(*keys).agg(F.count_if(F.col("hit")).alias("matched"), F.count_if(F.col("hit").isNull()).alias("missing"), F.collect_set("headword").alias("_gh"))
    p = pred.join(mark(gold, "hit"), [*keys, "block"], "left").groupBy(*keys).agg(F.count_if(F.col("hit").isNull()).alias("extra"), F.collect_set("headword").alias("_ph"))
    both = g.join(p, keys, "full")
    common = F.size(F.array_intersect(F.coalesce("_gh", F.array()), F.coalesce("_ph", F.array())))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(*keys, zero("matched").alias("matched"), zero("missing").alias("missing"), zero("extra").alias("extra"), F.coalesce(common / F.nullif(F.size(F.coalesce("_ph", F.array())), F.lit(0)), F.lit(0.0)).alias("headword_precision"), F.coalesce(common / F.nullif(F.size(F.coalesce("_gh", F.array())), F.lit(0)), F.lit(0.0)).alias("headword_recall"))


#: Markers that stand for each other in scoring, and the roles of markers.
EQUIVALENT = (("gn", "dn"), ("de", "ge"))
STRUCTURAL = ("sn", "hm", "ps", "dt", "ph")
SOURCE_MARKERS = ("lx", "se", "xv", "cf", "va")
GLOSS_MARKERS = ("ge", "gn", "gr", "gv", "de", "dn", "xe", "xn", "xr")


def marker_class(c: Column) -> Column:
    """The first marker of its class, so that equivalent markers compare equal."""
    out = c
    for group in EQUIVALENT:
        out = F.when(c.isin(*group), F.lit(group[0])).otherwise(out)
    return out


def role_bucket(marker: Column, language: Column) -> Column:
    """source[:language] or target[:language]; null for structural markers."""
    role = F.when(marker.isin(*SOURCE_MARKERS), "source").when(marker.isin(*GLOSS_MARKERS), "target").when(marker.isin(*STRUCTURAL), F.lit(None).cast("string")).when(language.isNotNull(), "target")
    return F.when(role.isNotNull(), F.concat_ws(":", role, language))


def gloss_markers(dictionaries: DataFrame) -> DataFrame:
    """dictionary, marker, language, place: English takes ge, the others gn, gr, gv, then g and a number, in their order."""
    t = dictionaries.select("dictionary", F.posexplode("target_languages").alias("place", "language"))
    other = F.sum((F.col("language") != "English").cast("int")).over(W.partitionBy("dictionary").orderBy("place"))
    marker = F.when(F.col("language") == "English", "ge").when(F.col("_n") == 1, "gn").when(F.col("_n") == 2, "gr").when(F.col("_n") == 3, "gv").otherwise(F.concat(F.lit("g"), (F.col("_n") + 2).cast("string")))
    return t.withColumn("_n", other).select("dictionary", marker.alias("marker"), "language", "place")


def cheatsheet_issues(markers: DataFrame, column: str = "marker") -> DataFrame:
    """marker, issue: invalid or repeated markers of a sheet, compared without backslash and case."""
    m = markers.select(F.lower(F.regexp_replace(strip(F.col(column)), r"^\\+", "")).alias("marker"))
    bad = m.where(~F.col("marker").rlike("^[a-z][a-z0-9_-]*$")).select("marker", F.lit("invalid").alias("issue"))
    return bad.unionByName(m.groupBy("marker").count().where("count > 1").select("marker", F.lit("repeated").alias("issue")))


def page_evaluation(records: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of each page: record and marker counts (tp, fp, fn), read order of records, and edits of all values, headwords and glosses.

    records, lines: those of align.record_lines. A matched line with another marker counts as wrong and as missing.
    Values are compared as field values, in graphemes and words.
    """
    from lexforge.functions.text import field_value
    from lexforge.operators.metrics import pair_counts
    from lexforge.operators.reports import read_order_records

    status = F.col("status")
    r = records.groupBy(*keys).agg(F.count_if(status == "matched").alias("record_tp"), F.count_if(status == "extra").alias("record_fp"), F.count_if(status == "missing").alias("record_fn"))
    inside = lines.where("gold_record is not null and pred_record is not null")
    same = marker_class(F.col("gold_marker")) == marker_class(F.col("pred_marker"))
    hit = status == "matched"
    gold = F.col("gold_marker")
    c = pair_counts(inside.withColumns({"gold": F.when(hit, field_value(F.col("gold_value"))), "pred": F.when(hit, field_value(F.col("pred_value")))}))
    kinds = (("field", F.lit(True)), ("headword", gold.isin(*HEADWORDS)), ("gloss", gold.isin(*GLOSSES)))
    sums = [F.coalesce(F.sum(F.when(hit & test, F.col(k))), F.lit(0)).alias(f"{name}_{k}") for name, test in kinds for k in ("edits", "gold_len", "word_edits", "gold_words")]
    m = c.groupBy(*keys).agg(F.count_if(hit & same).alias("marker_tp"), F.count_if((hit & ~same) | (status == "extra")).alias("marker_fp"), F.count_if((hit & ~same) | (status == "missing")).alias("marker_fn"), *sums)
    order = read_order_records(records.where(hit), keys, r.select(*keys, (F.col("record_tp") + F.col("record_fn")).alias("n_gold")))
    zero = [f.name for f in m.schema.fields if f.name not in keys]
    return r.join(m, keys, "left").na.fill(0, zero).join(order, keys)


#: Markers of headwords and of glosses in page figures.
HEADWORDS = ("lx", "se")
GLOSSES = ("ge", "gn", "gr", "gv", "de", "dn")
