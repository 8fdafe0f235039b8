"""Queries of the text functions: normal forms, typography, Markdown, keys. Registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import edit, ocr, text
from lexforge.operators import labels
from lexforge.plans.catalog import once, pages, query
from lexforge.session import read_table

S = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
LINES = "(select distinct line_id, marker, value from field_lines)"


def lines_of(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").select("line_id", *cols)


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def folded(c: str) -> str:
    """Case folding of the letters that occur."""
    return f"replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"


def collapsed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{S}+', ' ', 'g'), '^ +| +$', '', 'g')"


#: The homoglyphs of field values.
FOLDED = "lower(translate(nfc_normalize(value), 'Bpə', 'Врә'))"


@query("scoring_values", f"select line_id, regexp_replace(replace({FOLDED}, ',', ';'), '{S}|\\p{{P}}|</?[bi]>', '', 'g') as scored from {LINES} where value is not null")
def scoring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").where("value is not null").select("line_id", text.scoring_value(F.col("value")).alias("scored"))


@query("field_values", f"select line_id, {collapsed(f"replace({FOLDED}, chr(44), chr(59))")} as folded from {LINES} where value is not null")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").where("value is not null").select("line_id", text.field_value(F.col("value")).alias("folded"))


@query("noise_free_values", f"select line_id, regexp_replace(value, '{S}|\\p{{P}}', '', 'g') as letters, regexp_replace(value, '\\p{{P}}', '', 'g') as words from {LINES}")
def noise_free_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of character and of word scoring."""
    return lines_of(spark, sf_dir, "value").select("line_id", text.without_noise(F.col("value")).alias("letters"), text.without_noise(F.col("value"), spaces=False).alias("words"))


@query("markup_keys", f"select line_id, regexp_replace({folded('nfc_normalize(value)')}, '[,.:;!?''\"()\\[\\]]', '', 'g') as key from {LINES} where value is not null")
def markup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").where("value is not null").select("line_id", text.markup_word_key(F.col("value")).alias("key"))


@query("dash_forms", f"select line_id, case when regexp_matches(value, '^\\s*\\S.*[-‐‑‒–—―−]\\s*\\d+\\s*[-‐‑‒–—―−]\\s+\\S') then regexp_replace(value, '[-‐‑‒–—―−]', '—', 'g') else regexp_replace(value, '[‐‑‒–—―−]', '-', 'g') end as dashed, regexp_replace(value, '[‘’‚‛′‹›]', '''', 'g') as quoted from {LINES}")
def dash_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").select("line_id", ocr.dashes(F.col("value")).alias("dashed"), ocr.apostrophes(F.col("value")).alias("quoted"))


PAGES = "(select distinct stage1_id, text from stage1_projections where text is not null)"
PAGE_LINES = f"(select stage1_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from {PAGES})"


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("stage1_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("k", F.col("k").cast("bigint"))


TAGGED = "'<strong>' || value || '</strong> <EM>' || line_id || '</EM><u>x</u> <n> 2 < 3 > 1'"


@query("known_tags", f"select line_id, '<b>' || value || '</b> <i>' || line_id || '</i>x <N> 2  3  1' as tagged from {LINES}")
def known_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put into foreign tags with stray brackets, and the tags of the dictionary that come out."""
    return lines_of(spark, sf_dir, "value").select("line_id", ocr.stray_angles(ocr.known_tags(F.expr(TAGGED))).alias("tagged"))


@query("emphasis_tags", f"select line_id, '<b>' || value || '</b> <b>x</b> <i>' || line_id || '</i> <i>y</i>' as tagged from {LINES}")
def emphasis_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in Markdown's emphasis, as tags."""
    return lines_of(spark, sf_dir, "value").select("line_id", ocr.emphasis(F.expr("'**' || value || '** __x__ *' || line_id || '* _y_'")).alias("tagged"))


#: A value as the substitutions leave it, and as a line's typography does.
BARE = "regexp_replace(value, '[⁰-₟ʰ-˿]+', '', 'g')"
TYPED = f"nfc_normalize(regexp_replace(case when regexp_matches({BARE}, '^\\s*\\S.*[-‐‑‒–—―−]\\s*\\d+\\s*[-‐‑‒–—―−]\\s+\\S') then regexp_replace({BARE}, '[-‐‑‒–—―−]', '—', 'g') else regexp_replace({BARE}, '[‐‑‒–—―−]', '-', 'g') end, '[‘’‚‛′‹›]', chr(39), 'g'))"


@query("noise_free_lines", f"select line_id, '<b>' || {BARE} || '</b> wide ' || line_id || ' plain alpha  a b  end' as cleaned from {LINES}")
def noise_free_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the noise of recognisers, and what the substitutions leave of them."""
    noisy = F.concat(F.lit(r"\textbf{"), "value", F.lit(r"} $\mathrm{wide}$ \overline{"), F.col("line_id").cast("string"), F.lit(r"} \text {plain} \alpha \complement x<i>{12}</i> a<br/>b 卍卍卍☐ [Unreadable]end"))
    return lines_of(spark, sf_dir, "value").select("line_id", ocr.strip_noise(noisy).alias("cleaned"))


@query("cuneiform_lines", "select l_orderkey, l_linenumber, repeat(chr(73728), l_linenumber) || ' a ' || chr(74000) || chr(74751) as signs from lineitem")
def cuneiform_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces between cuneiform signs go, those before other letters stay."""
    signs = F.concat(F.expr("trim(repeat('\U00012000 ', l_linenumber))"), F.lit(" a \U00012110   \U000123ff"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.cuneiform_spacing(signs).alias("signs"))


@query("stripped_marks", f"select line_id, strip_accents(value) as bare from {LINES}")
def stripped_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").select("line_id", text.strip_marks(F.col("value")).alias("bare"))


@query("mdf_values", f"select line_id, regexp_replace(regexp_replace(value, '(?i)</?[bi]>', '', 'g'), '([.!?]|{S})+$', '') as value, case marker when 'ge' then 'gn' when 'de' then 'un' else marker end as marker from {LINES} where value is not null")
def mdf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "marker", "value").where("value is not null").select("line_id", text.mdf_value(F.col("value")).alias("value"), text.normalise_marker(F.col("marker")).alias("marker"))


@query("fenced_outputs", f"select page_key, {trimmed('mdf_text')} as mdf_text from (select distinct page_key, mdf_text from dictionary_pages where mdf_text is not null)")
def fenced_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record pages as a model would fence them, taken out of their fence."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null")
    fenced = F.concat(F.lit("\n```mdf\n"), text.strip(F.col("mdf_text")), F.lit("\n```\n"))
    return p.select("page_key", text.strip_fence(fenced).alias("mdf_text"))


@query("cleaned_mdf", f"select page_key, string_agg(case when regexp_matches(line, '^\\\\[A-Za-z0-9_-]+ ') then regexp_extract(line, '^(\\\\[A-Za-z0-9_-]+ )', 1) || regexp_replace(regexp_replace(line, '^\\\\[A-Za-z0-9_-]+ ', ''), '([.!?]|{S})+$', '') else line end, chr(10) order by k) as mdf_text from (select page_key, unnest(string_split(mdf_text, chr(10))) as line, unnest(range(len(string_split(mdf_text, chr(10))))) as k from (select distinct page_key, mdf_text from dictionary_pages where mdf_text is not null)) group by page_key")
def cleaned_mdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's value cleaned, the text joined again."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null")
    return p.select("page_key", text.mdf_text(F.col("mdf_text")).alias("mdf_text"))


@query("title_columns", "select distinct marker, 'Extra_' || upper(marker[1]) || marker[2:] || '_Value' as column_name from field_lines")
def title_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "field_lines").select("marker").distinct()
    return m.select("marker", text.extra_column(F.concat(F.lit("extra_"), "marker", F.lit("_value"))).alias("column_name"))


@query("folder_tokens", "select dictionary, replace(trim(source_language), '/', '_') || '-' || array_to_string(list_transform(target_languages, lambda x: replace(trim(x), '/', '_')), '-') as folder from dictionaries")
def folder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "dictionaries")
    return d.select("dictionary", F.concat_ws("-", text.folder_token(F.col("source_language")), F.array_join(F.transform("target_languages", text.folder_token), "-")).alias("folder"))


@query("markdown_lines", f"with v as (select page_id, line_id, {trimmed(f"regexp_replace(value, '{S}{{2,}}', ' ', 'g')")} as value from (select distinct page_id, line_id, value from field_lines)), l as (select page_id, line_id, 0 as j, {TYPED} as line from v where not regexp_matches(value, '^[0-9]{{1,4}}$') union all select page_id, line_id, 1, 'cell ' || line_id from v union all select page_id, line_id, 2, '<b>bold</b> link' from v) select page_id, cast(row_number() over (partition by page_id order by line_id, j) - 1 as int) as line_idx, line from l where line <> ''")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each page written as Markdown (headers, table rows, notices, images, page numbers), read back as plain lines."""
    md = F.concat(F.lit("### "), "value", F.lit("\n|---|:---:|\n| cell "), F.col("line_id").cast("string"), F.lit(" | **bold** [link](http://x) |\n12\n![img](x.png)\nGenerated at University of X\n##\n<div class='a'>\n"))
    rows = lines_of(spark, sf_dir, "page_id", md.alias("md"))
    docs = rows.groupBy("page_id").agg(F.concat(F.lit("```markdown\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "md"))), lambda x: x["md"]), ""), F.lit("```\n")).alias("value"))
    return ocr.markdown_lines(docs, ["page_id"])


@query("audit_examples")
def audit_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern, hits, examples: lines that hold each pattern of the noise audit, with the two first of them, the commonest first."""
    hits = page_rows(spark, sf_dir).where("trim(line) <> ''").select("stage1_id", "k", "line", F.explode(ocr.audit_hits(F.col("line"))).alias("pattern"))
    two = lambda a: F.slice(F.array_sort(a), 1, 2)
    part = hits.groupBy("pattern", F.pmod(F.col("stage1_id"), F.lit(64)).alias("salt")).agg(F.count("*").alias("hits"), F.min_by("line", F.struct("stage1_id", "k")).alias("first"), F.min(F.struct("stage1_id", "k", F.left("line", F.lit(80)).alias("line"))).alias("x"))
    return part.groupBy("pattern").agg(F.sum("hits").alias("hits"), F.transform(two(F.collect_list("x")), lambda x: x["line"]).alias("examples")).orderBy(F.desc("hits"), "pattern")


@query("natural_order", "select distinct page_id, list_transform(regexp_extract_all(page_id, '\\d+|\\D+'), lambda x: case when regexp_matches(x, '^\\d') then lpad(x, 12, '0') else lower(x) end) as key from dictionary_pages")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys that order digits inside names by number."""
    p = read_table(spark, sf_dir, "dictionary_pages").select("page_id").distinct()
    return p.select("page_id", text.natural_key(F.col("page_id")).alias("key"))


VALUES = "(select distinct value_id, value, primary_language from mdf_value_projections where value is not null and primary_language is not null)"


def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value_id, value, languages: values with a label a character."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null and primary_language is not null")
    return v.select("value_id", "value", F.array_repeat("primary_language", F.length("value")).alias("languages"))


@query("casefold_labels", f"select value_id, folded, list_transform(range(length(folded)), lambda i: primary_language) as languages from (select *, {folded('value')} as folded from {VALUES})")
def casefold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case folding with a label a character carried along."""
    got = labels.casefold_carrying(F.col("value"), F.col("languages"))
    return labelled_values(spark, sf_dir).select("value_id", got.alias("x")).select("value_id", F.col("x.text").alias("folded"), F.col("x.labels").alias("languages"))


@query("normal_labels", f"select value_id, folded, list_transform(range(length(folded)), lambda i: primary_language) as languages from (select *, replace({collapsed('lower(value)')}, ',', ';') as folded from {VALUES})")
def normal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of values with a label a character carried along."""
    got = labels.normal_carrying(F.col("value"), F.col("languages"))
    return labelled_values(spark, sf_dir).select("value_id", got.alias("x")).select("value_id", F.col("x.text").alias("folded"), F.col("x.labels").alias("languages"))


@query("grapheme_labels", f"select value_id, list_transform(range(length_grapheme(value)), lambda i: primary_language) as languages from {VALUES}")
def grapheme_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = labels.grapheme_labels(text.graphemes(F.col("value")), F.col("languages"))
    return labelled_values(spark, sf_dir).select("value_id", got.alias("languages"))


@query("word_counts", f"select distinct line_id, len(list_filter(regexp_split_to_array(value, '{S}+'), lambda x: x <> '')) as words from field_lines where value is not null")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "value").where("value is not null").select("line_id", F.size(edit.words(F.col("value"))).cast("bigint").alias("words"))
