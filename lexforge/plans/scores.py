"""Queries of figures and reports. Aggregations are shown on the star schema's tables as well, where SQL can follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions import edit, text
from lexforge.operators import align, mdf, metrics, reports
from lexforge.plans.catalog import once, pages, query, reading_pairs, readings
from lexforge.session import read_table

SPACES = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"

# pages of readings


def page_quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.character_quality(reading_pairs(spark, sf_dir), ["page_id", "dictionary"])


@query("page_quality")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character quality of each page's second reading over its line alignment."""
    return page_quality_of(spark, sf_dir)


@query("merged_quality")
def merged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merge_quality(page_quality_of(spark, sf_dir), ["dictionary"])


@query("reading_order")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read order of each page's second reading by its line alignment."""
    both = pages(spark, sf_dir).select("page_id", "text").join(readings(spark, sf_dir), "page_id")
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), text.collapse), lambda x: x != "")
    sides = both.select("page_id", lines("text").alias("gold"), lines("transcript").alias("pred"))
    return reports.read_order_aligned(align.match_pages(sides, ["page_id"]), ["page_id"], sides.select("page_id", F.size("gold").alias("n_gold")))


NEAT = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace({{0}}, '</?[a-zA-Z][a-zA-Z0-9]*>', '', 'g')), '{SPACES.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'), '^ +| +$', '', 'g'), ' +([,.:;!?''\"()\\[\\]])', '\\1', 'g')"
N_SQL = "with n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), r as (select split_part(page_id, '/', 1) || '/' || stem as page_id, min_by(transcript, neighbor_id) as transcript from n group by 1), p as (select page_id, text, transcript from (select distinct stage1_id, page_id, text from stage1_projections where text is not null) s join r using (page_id))"


def neat(c: str) -> str:
    return NEAT.format(c)


@query("collapsed_order", N_SQL.replace("with n", "with recursive n") + f", l as (select page_id, list_transform(string_split(text, chr(10)), lambda x: {neat('x')}) as g, array_to_string(list_filter(list_transform(string_split(transcript, chr(10)), lambda x: {neat('x')}), lambda x: x <> ''), ' ') as h from p), w as (select page_id, g, h, 1 as k, 0 as start, 0 as met from l union all select page_id, g, h, k + 1, case when hit then spot - 1 + length(line) else start end, met + case when hit then 1 else 0 end from (select *, line <> '' and spot > 0 as hit from (select *, case when a > 0 then a + start else case when b > 0 then b + start else 0 end end as spot from (select *, g[k] as line, instr(substr(h, start + 1), g[k]) as a, instr(substr(lower(h), start + 1), lower(g[k])) as b from w where k <= len(g))))) select page_id, (len(g) - met) / len(g) as read_order_edit from w where k = len(g) + 1")
def collapsed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read order of each page's second reading by anchors in its joined text."""
    both = pages(spark, sf_dir).select("page_id", "text").join(readings(spark, sf_dir), "page_id")
    return both.select("page_id", reports.read_order_collapsed(reports.cleaned_lines(F.col("text")), reports.cleaned_lines(F.col("transcript"))).alias("read_order_edit"))


@query("language_words", "with v as (select distinct value_id, dictionary, value, normalized_value, primary_language from mdf_value_projections where value is not null and normalized_value is not null and primary_language is not null) select dictionary, primary_language as language, cast(sum(len(list_filter(regexp_split_to_array(value, '" + SPACES + "+'), lambda x: x <> ''))) as bigint) as gold_words from v where primary_language not in ('space', 'meta') group by 1, 2 having gold_words > 0")
def language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold words by language of the values' word alignment."""
    return metrics.per_language_words(language_values(spark, sf_dir), ["dictionary"]).select("dictionary", "language", "gold_words")


def language_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null and normalized_value is not null and primary_language is not null")
    return v.select("dictionary", F.col("value").alias("gold"), F.col("normalized_value").alias("pred"), F.transform(edit.words(F.col("value")), lambda _: F.col("primary_language")).alias("languages"))


@query("language_word_errors")
def language_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edits of values by the language of their words: stored value against its normal form."""
    return metrics.per_language_words(language_values(spark, sf_dir), ["dictionary"])


# record pages


def record_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(record matches of stored pages and their field lines, line matches inside matched records)."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null").select("page_id", "mdf_text")
    gold = mdf.parse_mdf(p, ["page_id"])
    pred = once(spark, sf_dir, "field_lines", "line_id").select("page_id", "record_index", F.row_number().over(W.partitionBy("page_id", "record_index").orderBy("line_index", "line_id")).alias("line_in_record"), "marker", "value").withColumn("line_in_record", F.col("line_in_record") - 1)
    return align.record_lines(gold, pred, ["page_id"])


@query("record_lines")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of matched records, matched one to one; missing and extra lines alone."""
    return record_pairs(spark, sf_dir)[1].select("page_id", "gold_record", "gold_line", "pred_record", "pred_line", "similarity", "status")


@query("page_records")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of each page's field lines against its stored records."""
    return reports_of_pages(spark, sf_dir)


def reports_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.page_evaluation(*record_pairs(spark, sf_dir), ["page_id"])


@query("record_report")
def record_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate of the page evaluations by dictionary."""
    return reports.second_aggregate(reports_of_pages(spark, sf_dir).withColumn("dictionary", F.substring_index("page_id", "/", 1)), ["dictionary"])


@query("marker_confusions")
def marker_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = record_pairs(spark, sf_dir)[1].where("status = 'matched'").withColumn("dictionary", F.substring_index("page_id", "/", 1))
    return metrics.marker_confusion(lines, ["dictionary"], F.col("gold_marker"), F.col("pred_marker"), mdf.marker_class(F.col("gold_marker")) == mdf.marker_class(F.col("pred_marker")))


# aggregations on page tables that SQL can build

#: Orders as pages: their lines' figures stand for those of a page.
PAGE_TABLE = "(select l_orderkey as page, l_returnflag as experiment, l_linestatus as language, l_linenumber % 3 as matched, l_linenumber % 2 as missing, 1 as extra, cast(l_quantity as bigint) as edits, cast(floor(l_extendedprice) as bigint) as gold_len, l_linenumber as word_edits, cast(l_quantity as bigint) + 3 as gold_words, l_discount as text_edit, l_tax as read_order_edit, l_linenumber as bold_tp, l_linenumber % 2 as bold_fp, l_linenumber % 3 as bold_fn, l_linenumber % 4 as italic_tp, l_linenumber % 5 as italic_fp, 1 as italic_fn from lineitem) pages"


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lexforge_lineitem")
    return spark.sql("select * from " + PAGE_TABLE.replace("from lineitem", "from _lexforge_lineitem"))


def over(a: str, b: str) -> str:
    return f"coalesce(cast(({a}) as double) / nullif({b}, 0), 0)"


SPANS = "matched + missing + extra"
SUMS = "cast(sum(edits) as bigint) as edits, cast(sum(gold_len) as bigint) as gold_len, cast(sum(word_edits) as bigint) as word_edits, cast(sum(gold_words) as bigint) as gold_words"


@query("quality_merge", f"select experiment, language, count(*) as pages, {SUMS}, {over('sum(edits)', 'sum(gold_len)')} as gcer, {over('sum(word_edits)', 'sum(gold_words)')} as wer, {over(f'sum(text_edit * ({SPANS}))', f'sum({SPANS})')} as text_edit from {PAGE_TABLE} group by experiment, language")
def quality_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merge_quality(page_table(spark, sf_dir), ["experiment", "language"])


def prf_sql(name: str, tp: str, fp: str, fn: str) -> str:
    p, r = over(f"sum({tp})", f"sum({tp} + {fp})"), over(f"sum({tp})", f"sum({tp} + {fn})")
    return f"round({p}, 4) as {name}_precision, round({r}, 4) as {name}_recall, round({over(f'2 * {p} * {r}', f'{p} + {r}')}, 4) as {name}_f1"


@query("transcription_report", f"select experiment, count(*) as pages, round({over(f'sum(text_edit * ({SPANS}))', f'sum({SPANS})')}, 6) as text_edit, round({over('sum(edits)', 'sum(gold_len)')}, 6) as gcer, round({over('sum(word_edits)', 'sum(gold_words)')}, 6) as wer, {prf_sql('bold', 'bold_tp', 'bold_fp', 'bold_fn')}, {prf_sql('italic', 'italic_tp', 'italic_fp', 'italic_fn')}, {prf_sql('typography', '(bold_tp + italic_tp)', '(bold_fp + italic_fp)', '(bold_fn + italic_fn)')}, round(avg(read_order_edit), 6) as read_order_edit from {PAGE_TABLE} group by experiment")
def transcription_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_aggregate(page_table(spark, sf_dir), ["experiment"])


@query("summary_by_language", f"select experiment, language, count(*) as page_count, round({over('sum(edits)', 'sum(gold_len)')}, 6) as gcer from {PAGE_TABLE} group by experiment, language")
def summary_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_aggregate(page_table(spark, sf_dir), ["experiment", "language"]).select("experiment", "language", F.col("pages").alias("page_count"), "gcer")


RECORDS = PAGE_TABLE.replace(") pages", "").replace("(select", "(select l_linenumber as record_tp, 1 as record_fp, l_linenumber % 3 as record_fn, l_linenumber as marker_tp, l_linenumber % 4 as marker_fp, 2 as marker_fn, " + ", ".join(f"{e} as {p}_{k}" for p in ("field", "headword", "gloss") for k, e in (("edits", "l_linenumber"), ("gold_len", "cast(l_quantity as bigint)"), ("word_edits", f"l_linenumber % {len(p)}"), ("gold_words", "7"))) + ",", 1) + ") pages"


def quality_sql(p: str) -> str:
    return f"round({over(f'sum({p}_edits)', f'sum({p}_gold_len)')}, 6) as {p}_gcer, round({over(f'sum({p}_word_edits)', f'sum({p}_gold_words)')}, 6) as {p}_wer"


MP, MR = over("sum(marker_tp)", "sum(marker_tp + marker_fp)"), over("sum(marker_tp)", "sum(marker_tp + marker_fn)")


@query("record_aggregate", f"select experiment, count(*) as pages, round({over('sum(record_tp)', 'sum(record_tp + record_fn)')}, 6) as record_accuracy, round({over(f'2 * {MP} * {MR}', f'{MP} + {MR}')}, 6) as fields_f1, round(avg(read_order_edit), 6) as read_order_edit, {', '.join(map(quality_sql, ('field', 'headword', 'gloss')))} from {RECORDS} group by experiment")
def record_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_table(spark, sf_dir)
    return reports.second_aggregate(spark.sql("select * from " + RECORDS.replace("from lineitem", "from _lexforge_lineitem")), ["experiment"])


@query("detail_report", f"select experiment, page, edits, gold_len, text_edit from (select experiment, case when grouping(page) = 1 then '__aggregate__' else cast(page as varchar) end as page, cast(sum(edits) as bigint) as edits, cast(sum(gold_len) as bigint) as gold_len, round(avg(text_edit), 6) as text_edit, count(distinct page) as n, grouping(page) as g from {PAGE_TABLE} group by grouping sets ((experiment, page), (experiment))) where g = 0 or n > 1")
def detail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detail_rows(page_table(spark, sf_dir).withColumn("page", F.col("page").cast("string")), "experiment", "page", ["edits", "gold_len"], ["text_edit"])


LANGUAGE_TABLE = "(select l_returnflag as experiment, l_suppkey as page, case l_linenumber when 1 then 'space' when 2 then 'meta' else 'l' || l_linenumber end as language, l_linenumber as edits, cast(l_quantity as bigint) as gold_len, l_linenumber + 20 as pred_len, 1 as word_edits, 4 as gold_words from lineitem) rows_of"


@query("language_script_report", f"select experiment, page, case when grouping(language) = 1 then '__aggregate__' else language end as language, {SUMS}, cast(sum(pred_len) as bigint) as pred_len, {over('sum(edits)', 'sum(gold_len)')} as gcer, {over('sum(word_edits)', 'sum(gold_words)')} as wer, cast(sum(edits) as double) / greatest(sum(gold_len), sum(pred_len), 1) as text_edit from {LANGUAGE_TABLE} where language not in ('space', 'meta') group by grouping sets ((experiment, page, language), (experiment, page))")
def language_script_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each page with the blended totals that leave reserved labels out."""
    page_table(spark, sf_dir)
    return reports.language_report(spark.sql("select * from " + LANGUAGE_TABLE.replace("from lineitem", "from _lexforge_lineitem")), ["experiment", "page"])


@query("language_script_summary", f"select experiment, language, {SUMS}, cast(sum(pred_len) as bigint) as pred_len, {over('sum(edits)', 'sum(gold_len)')} as gcer, {over('sum(word_edits)', 'sum(gold_words)')} as wer, cast(sum(edits) as double) / greatest(sum(gold_len), sum(pred_len), 1) as text_edit from {LANGUAGE_TABLE} where language not in ('space', 'meta') group by experiment, language")
def language_script_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_table(spark, sf_dir)
    rows = spark.sql("select * from " + LANGUAGE_TABLE.replace("from lineitem", "from _lexforge_lineitem"))
    return reports.language_report(rows, ["experiment"]).where(F.col("language") != reports.ALL)


@query("nested_reports", f"select experiment, '{{\"counts\":{{\"pages\":' || count(*) || ',\"edits\":' || cast(sum(edits) as bigint) || '}},\"length\":{{\"gold_len\":' || cast(sum(gold_len) as bigint) || '}}}}' as report from {PAGE_TABLE} group by experiment")
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = reports.merge_quality(page_table(spark, sf_dir), ["experiment"])
    return reports.nested(merged, ["experiment"], {"counts": ["pages", "edits"], "length": ["gold_len"]})


@query("report_lines", f"select experiment, printf('edits=%.4f  gold_len=%.4f', cast(sum(edits) as double), cast(sum(gold_len) as double)) as line from {PAGE_TABLE} group by experiment")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_lines(reports.merge_quality(page_table(spark, sf_dir), ["experiment"]), ["experiment"], ["edits", "gold_len"])


# grounding and recovery

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+')"
GROUND = f"v as (select page_id, token, count(*) as n from (select page_id, unnest({TOKENS.format('value')}) as token from (select distinct line_id, page_id, value from field_lines)) group by 1, 2), t as (select distinct page_id, unnest({TOKENS.format('text')}) as token from stage1_projections where text is not null)"


@query("grounding", f"with {GROUND}, j as (select v.page_id, v.token, v.n, t.token is null as gone from v left join t using (page_id, token)), s as (select page_id, count(*) as text_tokens from t group by 1) select page_id, cast(sum(n) as bigint) as value_tokens, cast(coalesce(sum(n) filter (where gone), 0) as bigint) as missing_tokens, coalesce(any_value(text_tokens), 0) as text_tokens, coalesce(list_slice(list(token order by token collate c) filter (where gone), 1, 20), []) as samples from j left join s using (page_id) group by page_id".replace(" collate c", ""))
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's values are grounded in its printed text."""
    v = once(spark, sf_dir, "field_lines", "line_id").select("page_id", "value")
    return reports.grounding(v, pages(spark, sf_dir).select("page_id", "text"), "page_id", "value", "text")


HEADS = "select distinct page_id, value as head from field_lines where marker = 'lx'"


@query("head_recovery", "with g as (select page_id, list(distinct headword) as g from dictionary_entries where headword <> '' group by 1), b as (select page_id, list(distinct value) as b from field_lines where marker = 'lx' and value <> '' group by 1), a as (select page_id, list(distinct normalized_value) as a from mdf_value_projections where marker = 'lx' and normalized_value <> '' group by 1), j as (select page_id, g, coalesce(b, []) as b, coalesce(a, []) as a from g left join b using (page_id) left join a using (page_id)) select page_id, cast(len(g) as int) as gold_heads, len(list_intersect(g, b)) / len(g) as recall_before, len(list_intersect(g, a)) / len(g) as recall_after, cast(len(list_filter(list_intersect(g, a), lambda x: not list_contains(b, x))) as int) as recovered, cast(len(list_filter(list_intersect(g, b), lambda x: not list_contains(a, x))) as int) as lost from j")
def head_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries' headwords found among the stored lines, and among their normal forms."""
    gold = read_table(spark, sf_dir, "dictionary_entries").select("page_id", F.col("headword").alias("head"))
    lines = read_table(spark, sf_dir, "field_lines").where("marker = 'lx'").select("page_id", F.col("value").alias("head"))
    after = read_table(spark, sf_dir, "mdf_value_projections").where("marker = 'lx'").select("page_id", F.col("normalized_value").alias("head"))
    return reports.recovery(gold, lines, after, "page_id", "head")


@query("heads_in_text", f"with h as (select distinct page_id, lower(value) as head from field_lines where marker = 'lx' and value <> ''), t as (select distinct stage1_id, page_id, text from stage1_projections where text is not null) select distinct page_id, head from h join t using (page_id) where regexp_matches(' ' || lower(text) || ' ', '[^\\p{{L}}\\p{{N}}_]' || regexp_escape(head) || '[^\\p{{L}}\\p{{N}}_]')")
def heads_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords that their page's printed text holds as whole words."""
    h = read_table(spark, sf_dir, "field_lines").where("marker = 'lx'").select("page_id", F.col("value").alias("head"))
    return reports.heads_in_text(h, pages(spark, sf_dir).select("page_id", "text"), "page_id", "head", "text")
