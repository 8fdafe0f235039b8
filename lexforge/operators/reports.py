"""Figures of pages and their reports: qualities of aligned lines, read order, aggregates, rounded rows, nested and text forms.

Counts are summed first and ratios derived from the sums; every report is one aggregation over the page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.edit import token_distance
from lexforge.functions.text import let
from lexforge.operators.metrics import pair_counts, ratio

ALL = "__aggregate__"
#: Places that reports round to: shares of characters and words, shares of tags.
FINE, COARSE = 6, 4


def character_quality(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred", edit: str = "edit") -> DataFrame:
    """by, matched, missing, extra, edits, gold_len, word_edits, gold_words, gcer, wer, text_edit of each page's aligned lines.

    text_edit is the mean of the alignment's own edit shares, over all pairs.
    """
    side = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    g = pair_counts(pairs, gold, pred).groupBy(*by).agg(
        F.count_if(side(gold) & side(pred)).alias("matched"), F.count_if(side(gold) & ~side(pred)).alias("missing"), F.count_if(~side(gold) & side(pred)).alias("extra"),
        F.sum("edits").alias("edits"), F.sum("gold_len").alias("gold_len"), F.sum("word_edits").alias("word_edits"), F.sum("gold_words").alias("gold_words"), F.avg(edit).alias("text_edit"),
    )
    return g.withColumns({"gcer": ratio(F.col("edits"), F.col("gold_len")), "wer": ratio(F.col("word_edits"), F.col("gold_words"))})


def order_share(found: Column, n_gold: Column) -> Column:
    """Edit share between the gold order 0..n-1 and gold places in the order in which they were read."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    every = F.when(n_gold > 0, F.sequence(F.lit(0), n_gold - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n_gold > 0, token_distance(text(every), text(found)) / F.greatest(F.size(found), n_gold, F.lit(1))).otherwise(F.lit(0.0))


def read_order_aligned(pairs: DataFrame, by: list[str], n_gold: DataFrame, gold_idx: str = "gold_idx", pred_idx: str = "pred_idx") -> DataFrame:
    """by, read_order_edit of line alignments (arrays of places): pairs in predicted order, a pair's gold lines from its first to its last.

    n_gold: by, n_gold.
    """
    both = pairs.where((F.size(gold_idx) > 0) & (F.size(pred_idx) > 0))
    item = F.struct(F.array_min(pred_idx).alias("p"), F.array_min(gold_idx).alias("a"), F.array_max(gold_idx).alias("b"))
    seq = F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.sequence(x["a"], x["b"])))
    got = both.groupBy(*by).agg(seq.alias("_seq"))
    return n_gold.join(got, by, "left").select(*by, order_share(F.coalesce("_seq", F.array().cast("array<int>")), F.col("n_gold").cast("int")).alias("read_order_edit"))


def read_order_records(matched: DataFrame, by: list[str], n_gold: DataFrame, gold_idx: str = "gold_idx", pred_idx: str = "pred_idx") -> DataFrame:
    """by, read_order_edit of matched records: gold places in predicted order."""
    pairs = matched.where(f"{gold_idx} is not null and {pred_idx} is not null").select(*by, F.array(gold_idx).alias("gold_idx"), F.array(pred_idx).alias("pred_idx"))
    return read_order_aligned(pairs, by, n_gold)


def read_order_collapsed(gold_lines: Column, pred_lines: Column) -> Column:
    """Edit share of gold lines that are met one after another in the joined prediction (exactly, else in small letters), against all of them.

    Both are arrays of cleaned lines; lines met are in gold order by construction, so the distance is the number of those that aren't.
    """

    def step(hay: Column, low: Column):  # noqa: ANN202
        def run(acc: Column, line: Column) -> Column:
            at = F.position(line, hay, acc["start"])
            at = F.when(at > 0, at).otherwise(F.position(F.lower(line), low, acc["start"]))
            hit = (line != "") & (at > 0)
            return F.struct(F.when(hit, at + F.length(line)).otherwise(acc["start"]).cast("int").alias("start"), (acc["met"] + hit.cast("int")).cast("int").alias("met"))

        return run

    hay = F.array_join(F.filter(pred_lines, lambda x: x != ""), " ")
    zero = F.struct(F.lit(1).alias("start"), F.lit(0).alias("met"))
    met = let(F.struct(hay.alias("h"), F.lower(hay).alias("l"), gold_lines.alias("g")), lambda p: F.aggregate(p["g"], zero, step(p["h"], p["l"]), lambda a: a["met"]))
    n = F.size(gold_lines)
    return F.when(n > 0, (n - met) / n).otherwise(F.lit(0.0))


def cleaned_lines(c: Column) -> Column:
    """A text's lines, cleaned as a whole and split again (the normal form isn't available inside lambdas)."""
    from lexforge.functions.text import CLOSERS, nfc, strip_tags

    parts = F.split(nfc(strip_tags(c)), "\n")
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", ""), rf"\s+([{CLOSERS}])", "$1"))


def spans_of(pages: DataFrame) -> Column:
    return F.col("matched") + F.col("missing") + F.col("extra")


def merge_quality(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, pages, edits, gold_len, word_edits, gold_words, gcer, wer, text_edit: sums over pages; text_edit is weighted by their aligned spans."""
    n = spans_of(pages)
    g = pages.groupBy(*by).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("edits", "gold_len", "word_edits", "gold_words")], F.sum(F.col("text_edit") * n).alias("_t"), F.sum(n).alias("_n"))
    return g.withColumns({"gcer": ratio(F.col("edits"), F.col("gold_len")), "wer": ratio(F.col("word_edits"), F.col("gold_words")), "text_edit": ratio(F.col("_t"), F.col("_n"))}).drop("_t", "_n")


def prf_columns(name: str, tp: Column, fp: Column, fn: Column, places: int = COARSE) -> dict[str, Column]:
    """name_precision, name_recall, name_f1, rounded; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {f"{name}_precision": F.round(p, places), f"{name}_recall": F.round(r, places), f"{name}_f1": F.round(ratio(2 * p * r, p + r), places)}


def first_aggregate(pages: DataFrame, by: list[str]) -> DataFrame:
    """Transcription report: by, pages, text_edit, gcer, wer, precision, recall and F1 of bold, italic and both pooled, read_order_edit (plain mean)."""
    n = spans_of(pages)
    tags = [f"{t}_{k}" for t in ("bold", "italic") for k in ("tp", "fp", "fn")]
    g = pages.groupBy(*by).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("edits", "gold_len", "word_edits", "gold_words", *tags)], F.sum(F.col("text_edit") * n).alias("_t"), F.sum(n).alias("_n"), F.avg("read_order_edit").alias("_o"))
    c = F.col
    pooled = [c(f"bold_{k}") + c(f"italic_{k}") for k in ("tp", "fp", "fn")]
    out = {"text_edit": F.round(ratio(c("_t"), c("_n")), FINE), "gcer": F.round(ratio(c("edits"), c("gold_len")), FINE), "wer": F.round(ratio(c("word_edits"), c("gold_words")), FINE)}
    for t in ("bold", "italic"):
        out |= prf_columns(t, *[c(f"{t}_{k}") for k in ("tp", "fp", "fn")])
    out |= prf_columns("typography", *pooled) | {"read_order_edit": F.round("_o", FINE)}
    return g.select(*by, "pages", *[x.alias(k) for k, x in out.items()])


def second_aggregate(pages: DataFrame, by: list[str]) -> DataFrame:
    """Record report: by, pages, record_accuracy (recall), fields_f1, read_order_edit, and error shares of all values, headwords and glosses."""
    parts = ("field", "headword", "gloss")
    sums = [f"{a}_{k}" for a in ("record", "marker") for k in ("tp", "fp", "fn")] + [f"{p}_{k}" for p in parts for k in ("edits", "gold_len", "word_edits", "gold_words")]
    g = pages.groupBy(*by).agg(F.count("*").alias("pages"), *[F.sum(s).alias(s) for s in sums], F.avg("read_order_edit").alias("_o"))
    c = F.col
    p, r = ratio(c("marker_tp"), c("marker_tp") + c("marker_fp")), ratio(c("marker_tp"), c("marker_tp") + c("marker_fn"))
    out = {"record_accuracy": ratio(c("record_tp"), c("record_tp") + c("record_fn")), "fields_f1": ratio(2 * p * r, p + r), "read_order_edit": c("_o")}
    for x in parts:
        out |= {f"{x}_gcer": ratio(c(f"{x}_edits"), c(f"{x}_gold_len")), f"{x}_wer": ratio(c(f"{x}_word_edits"), c(f"{x}_gold_words"))}
    return g.select(*by, "pages", *[F.round(x, FINE).alias(k) for k, x in out.items()])


def detail_rows(pages: DataFrame, experiment: str, page: str, sums: list[str], means: list[str]) -> DataFrame:
    """experiment, page, sums, means: a row a page, and one for each experiment of more than one page (page ALL)."""
    g = pages.groupingSets([[experiment, page], [experiment]], experiment, page).agg(*[F.sum(c).alias(c) for c in sums], *[F.round(F.avg(c), FINE).alias(c) for c in means], F.count_distinct(page).alias("_n"), F.grouping_id().alias("_g"))
    return g.where("_g = 0 or _n > 1").select(experiment, F.when(F.col("_g") > 0, ALL).otherwise(F.col(page)).alias(page), *sums, *means)


def language_report(rows: DataFrame, by: list[str], language: str = "language", reserved: tuple[str, ...] = ("space", "meta")) -> DataFrame:
    """by, language, edits, gold_len, pred_len, word_edits, gold_words, gcer, wer, text_edit, and a row ALL a group with the blended totals of its languages.

    Reserved labels are dropped before the totals; text_edit is edits over the longer side.
    """
    kept = rows.where(~F.col(language).isin(*reserved))
    sums = ("edits", "gold_len", "pred_len", "word_edits", "gold_words")
    g = kept.groupingSets([[*by, language], by], *by, language).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(language).alias("_g"))
    g = g.withColumn(language, F.when(F.col("_g") == 1, ALL).otherwise(F.col(language))).drop("_g")
    return g.withColumns({"gcer": ratio(F.col("edits"), F.col("gold_len")), "wer": ratio(F.col("word_edits"), F.col("gold_words")), "text_edit": F.col("edits") / F.greatest("gold_len", "pred_len", F.lit(1))})


def nested(rows: DataFrame, keys: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """keys, report: JSON with one object a group of columns."""
    return rows.select(*keys, F.to_json(F.struct(*[F.struct(*cols).alias(name) for name, cols in groups.items()])).alias("report"))


def text_lines(rows: DataFrame, keys: list[str], columns: list[str], places: int = COARSE) -> DataFrame:
    """keys, line: a row's figures as `name=value` in fixed places."""
    return rows.select(*keys, F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), F.format_string(f"%.{places}f", F.col(c).cast("double"))) for c in columns]).alias("line"))


def fold_labels(rows: DataFrame, key: str, order: list[str], column: str, most: int) -> DataFrame:
    """key, samples: the first `most` distinct values of a column in order, taken in two steps so that no group is collected whole."""
    from pyspark.sql import Window as W

    first = rows.groupBy(key, column).agg(F.min(F.struct(*order)).alias("_o"))
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_o", column))).where(F.col("_k") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", column))), lambda x: x[column]).alias("samples"))


def grounding(values: DataFrame, texts: DataFrame, key: str, value: str, text: str, most: int = 20) -> DataFrame:
    """key, value_tokens, missing_tokens, text_tokens (distinct), samples: how far a page's values are grounded in its transcript.

    Tokens are runs of letters and digits in small letters; a value's token is missing if the transcript hasn't it anywhere.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1)
    v = values.select(key, F.explode(tokens(F.col(value))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    t = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).distinct().withColumn("here", F.lit(True))
    g = v.join(t, [key, "token"], "left").groupBy(key).agg(F.sum("n").alias("value_tokens"), F.coalesce(F.sum(F.when(F.col("here").isNull(), F.col("n"))), F.lit(0)).alias("missing_tokens"))
    size = t.groupBy(key).agg(F.count("*").alias("text_tokens"))
    gone = v.join(t, [key, "token"], "left_anti")
    return g.join(size, key, "left").join(fold_labels(gone, key, ["token"], "token", most), key, "left").select(key, "value_tokens", "missing_tokens", F.coalesce("text_tokens", F.lit(0)).alias("text_tokens"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def recovery(gold: DataFrame, before: DataFrame, after: DataFrame, key: str, head: str) -> DataFrame:
    """key, gold_heads, recall_before, recall_after, recovered, lost: headwords of a page found before and after a repair, as sets."""
    sets = lambda df, name: df.where(F.col(head).isNotNull() & (F.col(head) != "")).groupBy(key).agg(F.collect_set(head).alias(name))  # noqa: E731  one page's headwords
    both = sets(gold, "g").join(sets(before, "b"), key, "left").join(sets(after, "a"), key, "left")
    none = F.array().cast("array<string>")
    g, b, a = F.col("g"), F.coalesce("b", none), F.coalesce("a", none)
    hit = lambda x: F.size(F.array_intersect(g, x))
    return both.select(key, F.size(g).alias("gold_heads"), ratio(hit(b), F.size(g)).alias("recall_before"), ratio(hit(a), F.size(g)).alias("recall_after"), F.size(F.array_except(F.array_intersect(g, a), b)).alias("recovered"), F.size(F.array_except(F.array_intersect(g, b), a)).alias("lost"))


def heads_in_text(heads: DataFrame, texts: DataFrame, key: str, head: str, text: str) -> DataFrame:
    """key, head of those that stand in their page's text as whole words, in small letters."""
    both = heads.select(key, F.lower(head).alias(head)).where(F.col(head) != "").distinct().join(texts.select(key, F.lower(text).alias("_t")), key)
    return both.where(F.expr(f"regexp_like(_t, concat('(?<![\\\\p{{L}}\\\\p{{N}}_])\\\\Q', {head}, '\\\\E(?![\\\\p{{L}}\\\\p{{N}}_])'))")).select(key, head).distinct()


