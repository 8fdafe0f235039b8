"""Queries of the engine's own operators, by name, with the SQL that gives the same rows where there is one.

Page texts of the driver's tables stand in for files: `stage1_projections` is the gold reading of a page, the
neighbouring pages' transcripts are the second one. Delivered-again rows are dropped by id before anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions import edit, ocr, scripts, text
from lexforge.operators import align, incremental, labels, layout, mdf, metrics, multivalue, provenance, spans, verify
from lexforge.session import read_table
from lexforge.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def once(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return read_table(spark, sf_dir, table).dropDuplicates([key])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "stage1_projections", "stage1_id").where("text is not null")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, transcript: the least neighbour row's reading of each page."""
    n = once(spark, sf_dir, "neighbor_pages", "neighbor_id").where("transcript is not null and transcript <> ''")
    key = F.concat_ws("/", F.substring_index("page_id", "/", 1), "stem")
    return n.groupBy(key.alias("page_id")).agg(F.min_by("transcript", "neighbor_id").alias("transcript"))


def page_lines(df: DataFrame, body: str) -> DataFrame:
    """page_id, line_idx, line: a page's lines that aren't blank, with their place in it."""
    return df.select("page_id", F.posexplode(F.split(body, "\n")).alias("line_idx", "line")).where("trim(line) <> ''")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.split_values(read_table(spark, sf_dir, "dictionary_entries"))


DELIMITERS = ", ".join(f"'{d}'" for d in multivalue.CANDIDATES).replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '")


@query("p5_delimiters", f"with e as (select distinct entry_id, dictionary as source, gloss, gloss_secondary from dictionary_entries), v as (select source, 'gloss' as field_name, gloss as value from e union all select source, 'gloss_secondary', gloss_secondary from e), w as (select * from v where value is not null and trim(value) <> ''), x as (select source, field_name, delim, len(parts) - 1 as cuts, len(list_filter(parts, lambda p: regexp_matches(trim(p), '^[\"«„“(¿¡]?[\\p{{L}}\\p{{N}}]'))) as good from (select source, field_name, delim, string_split(value, delim) as parts from w, (select unnest([{DELIMITERS}]) as delim) where contains(value, delim))), g as (select source, field_name, delim, count(*) as cut_values, avg(cuts) as m, stddev_pop(cuts) as sd, sum(good) as good, sum(cuts + 1) as parts from x group by all), n as (select source, field_name, count(*) as values from w group by all), f as (select g.source, g.field_name, delim, values, cut_values, 1 / (1 + sd / m) * good / parts as fit from g join n on g.source is not distinct from n.source and g.field_name = n.field_name) select *, cut_values / values * fit as score from f")
def p5_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.delimiter_scores(once(spark, sf_dir, "dictionary_entries", "entry_id"))


# text scalars

NEAT = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\s+([,.:;!?''\"()\[\]])', '\1', 'g')"


@query("strip_tags", r"select doc_id, regexp_replace(text, '</?[a-zA-Z][a-zA-Z0-9]*>', '', 'g') as stripped from documents")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.strip_tags(F.col("text")).alias("stripped"))


@query("clean_values", "select line_id, regexp_replace(trim(regexp_replace(nfc_normalize(regexp_replace(value, '</?[a-zA-Z][a-zA-Z0-9]*>', '', 'g')), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')), ' +([,.:;!?''\"()\\[\\]])', '\\1', 'g') as cleaned from (select distinct line_id, value from field_lines)")
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").select("line_id", text.clean_text(F.col("value")).alias("cleaned"))


@query("projection_values", "select line_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(nfc_normalize(value)), ',', ';'), '</?[bi]>', '', 'g'), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'), '^ +| +$', '', 'g') as value_norm from (select distinct line_id, value from field_lines)")
def projection_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").select("line_id", text.projection_value(F.col("value")).alias("value_norm"))


@query("homoglyph_values", "select line_id, replace(lower(regexp_replace(translate(value, 'Bpə', 'Врә'), '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g')), ',', ';') as folded from (select distinct line_id, value from field_lines)")
def homoglyph_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").select("line_id", text.homoglyphs(F.col("value")).alias("folded"))


@query("gloss_pieces", "with e as (select distinct entry_id, gloss from dictionary_entries where gloss is not null and gloss <> ''), p as (select entry_id, list_filter(list_transform(string_split(gloss, ';'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') as parts, gloss from e) select entry_id, unnest(case when len(parts) > 0 then parts else [gloss] end) as piece from p")
def gloss_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = once(spark, sf_dir, "dictionary_entries", "entry_id").where("gloss is not null and gloss <> ''")
    return e.select("entry_id", F.explode(text.split_gloss(F.col("gloss"))).alias("piece"))


@query("value_hashes", "select distinct line_id, sha256(value) as sha from field_lines where value is not null")
def value_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").where("value is not null").select("line_id", F.sha2(F.encode("value", "UTF-8"), 256).alias("sha"))


@query("entry_numbers", "select distinct entry_id, case when homonym_number >= 1 then homonym_number end as number from dictionary_entries")
def entry_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = once(spark, sf_dir, "dictionary_entries", "entry_id")
    return e.select("entry_id", text.entry_number(F.concat(F.lit("("), F.col("homonym_number").cast("string"), F.lit(")"))).alias("number"))


@query("language_keys", "select dictionary, case lower(source_language) when 'english' then 'en' else regexp_replace(lower(source_language), '[^a-z0-9]+', '', 'g') end as source_key, list_transform(target_languages, lambda x: case lower(x) when 'english' then 'en' when 'french' then 'fr' when 'german' then 'de' when 'spanish' then 'es' when 'russian' then 'ru' when 'indonesian' then 'id' end) as target_keys from dictionaries")
def language_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "dictionaries")
    return d.select("dictionary", text.language_key(F.col("source_language")).alias("source_key"), F.transform("target_languages", lambda x: text.language_key(x)).alias("target_keys"))


@query("page_order", "select page_id, row_number() over (partition by dictionary order by cast(regexp_extract(page_id, 'page_(\\d+)', 1) as int), page_id) as place from (select distinct dictionary, page_id from dictionary_pages)")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", "page_id").distinct()
    return p.select("page_id", F.row_number().over(W.partitionBy("dictionary").orderBy(text.page_sort_key(F.substring_index("page_id", "/", -1)), "page_id")).cast("bigint").alias("place"))


@query("page_specs", "select dictionary, unnest(range(lo, hi + 1)) as page from (select dictionary, min(page_number) as lo, max(page_number) as hi from dictionary_pages group by dictionary)")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "dictionary_pages").groupBy("dictionary").agg(F.min("page_number").alias("lo"), F.max("page_number").alias("hi"))
    return p.select("dictionary", F.explode(text.pages_of_spec(F.concat_ws("-", "lo", "hi"))).alias("page")).select("dictionary", F.col("page").cast("bigint").alias("page"))


@query("letter_ratios", "select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', '', 'g')), 1) as latin from documents")
def letter_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.letter_ratios(F.col("text"))["latin"].alias("latin"))


@query("typography")
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages(spark, sf_dir).select("stage1_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("stage1_id", "line_no", ocr.renewed_line(F.col("line")).alias("normal"))


# characters and scripts


@query("grapheme_lengths", "select doc_id, length_grapheme(regexp_replace(text, '[\\x{80}-\\x{9f}]', chr(10), 'g')) as n from documents")
def grapheme_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(text.graphemes(F.col("text"))).cast("bigint").alias("n"))


def _script_case(c: str) -> str:
    tests = " ".join("when " + " or ".join(f"unicode({c}) between {lo} and {hi}" for lo, hi in ranges) + f" then '{name}'" for name, ranges in scripts.RANGES)
    return f"case when regexp_matches({c}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]$') then 'space' when regexp_matches({c}, '^[\\p{{P}}\\p{{S}}]$') then 'punct' when regexp_matches({c}, '^\\p{{N}}$') then 'digit' when regexp_matches({c}, '^\\p{{M}}$') then 'mark' {tests} else 'other' end"


@query("script_counts", f"with c as (select unnest(string_split(value, '')) as ch from (select distinct line_id, value from field_lines)) select {_script_case('ch')} as script, count(*) as n from c where ch <> '' group by 1")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # characters are counted first, so that each distinct one is classified once
    c = once(spark, sf_dir, "field_lines", "line_id").select(F.explode(F.split("value", "")).alias("ch")).where("ch <> ''").groupBy("ch").count()
    return c.groupBy(scripts.base_script(F.col("ch")).alias("script")).agg(F.sum("count").alias("n"))


@query("token_scripts")
def token_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = once(spark, sf_dir, "field_lines", "line_id").select("line_id", F.posexplode(edit.words(F.col("value"))).alias("k", "word"))
    kinds = w.select("word").distinct().select("word", scripts.token_script(F.transform(F.split("word", ""), scripts.base_script)).alias("script"))
    by = W.partitionBy("line_id").orderBy("k")
    return w.join(kinds, "word").select("line_id", "k", "word", F.last("script", ignorenulls=True).over(by).alias("script"))


@query("lexical_runs", "select line_id, len(regexp_extract_all(value, '[\\p{L}\\p{N}\\p{M}]+')) as runs from (select distinct line_id, value from field_lines)")
def lexical_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").select("line_id", F.size(text.lexical_runs(F.col("value"))).cast("bigint").alias("runs"))


SPAN_SQL = "with s as (select distinct stage1_id, text, languages from stage1_projections where languages is not null and len(languages) > 0), c as (select stage1_id, unnest(languages) as language, unnest(range(len(languages))) as k from s), n as (select *, case when language is distinct from lag(language) over (partition by stage1_id order by k) then 1 else 0 end as new from c), i as (select *, sum(new) over (partition by stage1_id order by k) as island from n) select stage1_id, min(k) as start_at, max(k) + 1 as end_at, language from i group by stage1_id, island, language"


@query("label_spans", SPAN_SQL)
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(spark, sf_dir, "stage1_projections", "stage1_id").where("languages is not null and size(languages) > 0")
    s = p.select("stage1_id", F.explode(spans.spans_of_labels(F.col("languages"))).alias("s"))
    return s.select("stage1_id", F.col("s.start").cast("bigint").alias("start_at"), F.col("s.end").cast("bigint").alias("end_at"), "s.language")


@query("canonical_spans", SPAN_SQL)
def canonical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(spark, sf_dir, "stage1_projections", "stage1_id").where("languages is not null and size(languages) > 0")
    s = p.select("stage1_id", F.posexplode("languages").alias("start", "language")).select("stage1_id", "start", (F.col("start") + 1).alias("end"), "language", F.lit(None).cast("string").alias("role"))
    return spans.canonical(s, ["stage1_id"]).select("stage1_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "language")


@query("span_faults", "select distinct stage1_id, case when len(languages) < length(text) then 'short' when len(languages) > length(text) then 'long' end as fault from stage1_projections where languages is not null and len(languages) > 0")
def span_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(spark, sf_dir, "stage1_projections", "stage1_id").where("languages is not null and size(languages) > 0").withColumn("spans", spans.spans_of_labels(F.col("languages")))
    return spans.span_faults(p).select("stage1_id", "fault")


@query("label_totals", "with s as (select distinct stage1_id, text, languages from stage1_projections where text <> '' and len(languages) = length(text)), c as (select stage1_id, unnest(string_split(text, '')) as ch, unnest(languages) as language from s) select stage1_id, language, count(*) as n from c where language is not null and language not in ('space', 'meta') and not regexp_matches(ch, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85\\p{P}]$') group by stage1_id, language")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(spark, sf_dir, "stage1_projections", "stage1_id").where("text <> '' and size(languages) = length(text)")
    return spans.label_counts(p, ["stage1_id"])


@query("primary_labels", "with s as (select distinct stage1_id, text, languages from stage1_projections where text <> '' and len(languages) = length(text)), c as (select stage1_id, unnest(string_split(text, '')) as ch, unnest(languages) as language from s), n as (select stage1_id, language, count(*) as n from c where language is not null and language not in ('space', 'meta') and not regexp_matches(ch, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85\\p{P}]$') group by stage1_id, language) select stage1_id, language from n qualify row_number() over (partition by stage1_id order by n desc, language) = 1")
def primary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.primary(label_totals(spark, sf_dir), ["stage1_id"])


WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


@query("word_labels", f"with p as (select stage1_id, languages, regexp_extract_all(text, '{WS}+|[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+') as x from (select distinct stage1_id, text, languages from stage1_projections where text is not null and len(languages) > 0)), q as (select stage1_id, languages, unnest(x) as word, unnest(list_transform(range(len(x)), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda y: length(y))), 0))) as start from p), w as (select stage1_id, row_number() over (partition by stage1_id order by start) - 1 as word_no, word, start, languages from q where not regexp_matches(word, '^{WS}')), l as (select stage1_id, word_no, word, start, unnest(languages[start + 1:start + length(word)]) as l from w union all select stage1_id, word_no, word, start, null from w), c as (select stage1_id, word_no, word, start, l, count(*) as n from l where l is distinct from 'space' group by all) select stage1_id, cast(word_no as int) as word_no, word, cast(start as int) as start, min_by(l, struct_pack(a := -n, b := l)) filter (where l is not null) as language from c group by stage1_id, word_no, word, start")
def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.word_labels(pages(spark, sf_dir).where("size(languages) > 0"), ["stage1_id"])


@query("task_round_trip", "select distinct stage1_id, true as same, cast(null as varchar) as fault from stage1_projections where text is not null and len(languages) = length(text)")
def task_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps sent through annotation tasks and back."""
    p = pages(spark, sf_dir).where("size(languages) = length(text)")
    return labels.round_trip(p, ["stage1_id"])


@query("folder_names", "select dictionary, source_language as source, target_languages as targets from dictionaries")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "dictionaries")
    return d.select("dictionary", labels.folder_name(F.col("dictionary"), ["English", "French", "German", "Spanish", "Russian", "Indonesian"]).alias("r")).select("dictionary", "r.*")


@query("projected_labels")
def projected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values' labels carried to their normal form."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null and normalized_value is not null and primary_language is not null")
    return v.select("value_id", labels.projected(F.col("value"), F.col("normalized_value"), F.array_repeat("primary_language", F.length("value"))).alias("languages"))


# predicates

#: The patterns of the audit that RE2 can't say, otherwise.
OTHERWISE = {"stray_lt": r"regexp_matches(regexp_replace(line, '(?i)</?(b|i)\b|</?N>', '', 'g'), '<')", "char_repeat": "list_any_value(list_filter(range(greatest(length(line) - 10, 1)), lambda i: line[i + 1] <> '' and line[i + 1:i + 12] = repeat(line[i + 1], 12))) is not null"}


@query("noise_audit", "with l as (select stage1_id, unnest(string_split(text, chr(10))) as line from (select distinct stage1_id, text from stage1_projections)) select pattern, hits from (" + " union all ".join(f"select '{n}' as pattern, count(*) as hits from l where " + OTHERWISE.get(n, f"regexp_matches(line, '{p}')") for n, p in ocr.AUDIT) + ") where hits > 0")
def noise_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.explode(ocr.audit_hits(F.col("line"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("hits"))


@query("junk_lines", "with l as (select distinct d.doc_id, unnest(string_split(d.text, chr(10))) as line, unnest(range(len(string_split(d.text, chr(10))))) as line_no from documents d), t as (select doc_id, line_no, regexp_replace(line, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g') as t from l) select doc_id, line_no from t where t = '' or contains(t, '�') or regexp_matches(t, '^[\\\\\\s]+$') or (length(t) >= 80 and length(regexp_replace(t, '[^0-9]', '', 'g')) >= 0.85 * length(regexp_replace(t, '[\\s\\p{Z}]', '', 'g'))) or (length(t) > 200 and len(list_distinct(string_split(t, ''))) <= 8) or (length(t) >= 80 and length(regexp_replace(t, '[^一-鿿]', '', 'g')) >= 0.55 * length(t) and length(regexp_replace(t, '[^A-Za-z]', '', 'g')) <= 0.15 * length(t)) or list_any_value(list_filter(range(greatest(length(t) - 10, 1)), lambda i: t[i + 1] <> '' and t[i + 1:i + 12] = repeat(t[i + 1], 12))) is not null")
def junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(text.is_junk_line(F.col("line"))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"))


# records

PARSED = "with p as (select distinct page_key, mdf_text from dictionary_pages where mdf_text is not null), l as (select page_key, unnest(string_split(mdf_text, chr(10))) as raw, unnest(range(len(string_split(mdf_text, chr(10))))) as pos from p), s as (select page_key, pos, regexp_replace(raw, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as line from l), k as (select page_key, pos, line, sum(case when line = '' then 1 else 0 end) over (partition by page_key order by pos) as blk from s where line = '' or regexp_matches(line, '^\\\\[A-Za-z0-9_-]+[\\s\\p{Z}]+.*$')), f as (select * from k where line <> ''), mdf as (select page_key, cast(dense_rank() over (partition by page_key order by blk) - 1 as int) as record_index, cast(row_number() over (partition by page_key, blk order by pos) - 1 as int) as line_in_record, cast(row_number() over (partition by page_key order by pos) - 1 as int) as line_index, regexp_extract(line, '^\\\\([A-Za-z0-9_-]+)', 1) as marker, regexp_replace(regexp_replace(line, '^\\\\[A-Za-z0-9_-]+[\\s\\p{Z}]+', ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as value from f) "


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.parse_mdf(once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null"), ["page_key"])


@query("mdf_lines", PARSED + "select * from mdf")
def mdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir)


@query("mdf_records", PARSED + "select page_key, record_index, min_by(value, line_in_record) filter (where marker = 'lx') as headword, count(*) as n_lines, string_agg(marker || ' ' || value, chr(10) order by line_in_record) as fingerprint from mdf group by page_key, record_index")
def mdf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.records(parsed(spark, sf_dir), ["page_key"]).select("page_key", "record_index", "headword", F.col("n_lines").cast("bigint").alias("n_lines"), "fingerprint")


@query("mdf_round_trip", PARSED + ", r as (select page_key, record_index, string_agg(chr(92) || marker || ' ' || value, chr(10) order by line_in_record) as t from mdf group by page_key, record_index) select page_key, string_agg(t, chr(10) || chr(10) order by record_index) as mdf_text from r group by page_key")
def mdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.write_records(parsed(spark, sf_dir), ["page_key"])


@query("marker_roles", "select distinct line_id, case when marker in ('lx', 'se', 'xv', 'cf', 'va') then 'source' when marker in ('ge', 'gn', 'gr', 'gv', 'de', 'dn', 'xe', 'xn', 'xr') then 'target' when marker in ('sn', 'hm', 'ps', 'dt', 'ph') then null end as role, case when marker in ('de', 'ge') then 'de' when marker in ('gn', 'dn') then 'gn' else marker end as marker_class from field_lines")
def marker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = once(spark, sf_dir, "field_lines", "line_id")
    return f.select("line_id", mdf.role_bucket(F.col("marker"), F.lit(None).cast("string")).alias("role"), mdf.marker_class(F.col("marker")).alias("marker_class"))


@query("gloss_markers", "select dictionary, unnest(gloss_markers) as marker, unnest(target_languages) as language from dictionaries")
def gloss_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.gloss_markers(read_table(spark, sf_dir, "dictionaries")).select("dictionary", "marker", "language")


@query("block_propagation", "with e as (select distinct entry_id, page_id, entry_type, headword, homonym_number from dictionary_entries) select entry_id, last_value(case when entry_type = 'main' then concat_ws(':', headword, cast(homonym_number as varchar)) end ignore nulls) over w as main_headword, cast(sum(case when entry_type = 'main' then 1 else 0 end) over w as bigint) as record_no from e window w as (partition by page_id order by entry_id rows unbounded preceding)")
def block_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = once(spark, sf_dir, "dictionary_entries", "entry_id")
    return mdf.propagate_blocks(e, ["page_id"], "entry_id").select("entry_id", "main_headword", F.col("record_no").cast("bigint").alias("record_no"))


@query("entry_issues")
def entry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.entry_issues(once(spark, sf_dir, "dictionary_entries", "entry_id"), ["page_id"], "entry_id")


@query("entry_export")
def entry_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.entry_lines(mdf.valid_entry(once(spark, sf_dir, "dictionary_entries", "entry_id")), ["entry_id"])


@query("block_comparison")
def block_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages against the pages written again from their field lines."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key")
    lines = once(spark, sf_dir, "field_lines", "line_id").withColumn("line_in_record", F.col("line_index"))
    again = mdf.write_records(lines, ["page_id"])
    return mdf.compare_blocks(mdf.blocks(p, ["page_id"], "mdf_text"), mdf.blocks(again, ["page_id"], "mdf_text"), ["page_id"])


# joins and matching


@query("page_pairs", "with n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), r as (select split_part(page_id, '/', 1) || '/' || stem as page_id, min_by(transcript, neighbor_id) as transcript from n group by 1) select p.page_id, length(p.text) as gold_chars, length(r.transcript) as pred_chars from (select distinct stage1_id, page_id, text from stage1_projections where text is not null) p join r using (page_id)")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pages(spark, sf_dir).join(readings(spark, sf_dir), "page_id")
    return g.select("page_id", F.length("text").cast("bigint").alias("gold_chars"), F.length("transcript").cast("bigint").alias("pred_chars"))


@query("unread_pages", "select distinct page_id from stage1_projections where text is not null and page_id not in (select split_part(page_id, '/', 1) || '/' || stem from neighbor_pages where transcript is not null and transcript <> '')")
def unread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id").join(readings(spark, sf_dir), "page_id", "left_anti").distinct()


@query("preferred_texts", "with n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), r as (select split_part(page_id, '/', 1) || '/' || stem as page_id, min_by(transcript, neighbor_id) as body from n group by 1) select page_id, length(body) as chars, 'reading' as origin from r union all select page_id, length(text), 'page' from (select distinct page_id, text from stage1_projections where text is not null) s where page_id not in (select page_id from r)")
def preferred_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = readings(spark, sf_dir).select("page_id", F.length("transcript").cast("bigint").alias("chars"), F.lit("reading").alias("origin"))
    second = pages(spark, sf_dir).select("page_id", F.length("text").cast("bigint").alias("chars"), F.lit("page").alias("origin"))
    return incremental.prefer(first, second, ["page_id"])


@query("cost_matrix")
def cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a page's first reading against every line of its second one."""
    return align.cost_matrix(page_lines(pages(spark, sf_dir), "text"), page_lines(readings(spark, sf_dir), "transcript"), ["page_id"])


@query("line_alignment")
def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quick matching of both readings' lines, page by page."""
    return align.match_lines(page_lines(pages(spark, sf_dir), "text"), page_lines(readings(spark, sf_dir), "transcript"), ["page_id"])


@query("record_matching")
def record_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one join of the records of a page's stored text and of its field lines."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null").select("page_id", "mdf_text")
    gold = mdf.records(mdf.parse_mdf(p, ["page_id"]), ["page_id"])
    pred = mdf.records(once(spark, sf_dir, "field_lines", "line_id").withColumn("line_in_record", F.col("line_index")), ["page_id"])
    return align.greedy_join(gold, pred, ["page_id"], "record_index", "fingerprint")


@query("value_provenance")
def value_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = once(spark, sf_dir, "field_lines", "line_id").withColumn("line_index", F.row_number().over(W.partitionBy("page_id").orderBy("record_index", "line_index", "line_id")) - 1)
    return provenance.project(lines.select("page_id", "line_index", "marker", "value"), pages(spark, sf_dir), ["page_id"])


@query("lexical_repair")
def lexical_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = once(spark, sf_dir, "field_lines", "line_id").withColumn("line_index", F.row_number().over(W.partitionBy("page_id").orderBy("record_index", "line_index", "line_id")) - 1)
    return provenance.repair(lines.select("page_id", "line_index", "marker", "value"), pages(spark, sf_dir), ["page_id"])


# aggregates and reports


def reading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, dictionary, gold, pred, edit: the lines of both readings, white space collapsed and blank lines left out, as paired by align.match_pages."""
    both = pages(spark, sf_dir).select("page_id", "dictionary", "text").join(readings(spark, sf_dir), "page_id")
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), text.collapse), lambda x: x != "")
    pairs = align.match_pages(both.select("page_id", "dictionary", lines("text").alias("gold"), lines("transcript").alias("pred")), ["page_id", "dictionary"])
    return pairs.select("page_id", "dictionary", F.col("gold_text").alias("gold"), F.col("pred_text").alias("pred"), "edit")


@query("reading_quality")
def reading_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the second reading over the pairs of the line alignment (align.match_pages, as in line_alignment): lines
    of one side only count with an empty other side, and text_edit is the mean of the alignment's own edit shares."""
    counted = metrics.pair_counts(reading_pairs(spark, sf_dir)).withColumn("ned", F.col("edit"))
    return metrics.text_quality(counted, ["dictionary"], total="__aggregate__")


@query("name_quality", "with p as (select c_mktsegment as segment, c_name as gold, s_name as pred from customer join supplier on c_custkey = s_suppkey), e as (select segment, levenshtein(gold, pred) as edits, length(gold) as gold_len, greatest(length(gold), length(pred), 1) as longest, case when gold = pred then 0 else 1 end as word_edits from p) select coalesce(segment, '__aggregate__') as segment, count(*) as pairs, cast(sum(edits) as bigint) as edits, cast(sum(gold_len) as bigint) as gold_len, sum(edits) / sum(gold_len) as gcer from e group by grouping sets ((segment), ())")
def name_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    p = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("gold"), F.col("s_name").alias("pred"))
    return metrics.text_quality(metrics.pair_counts(p), ["segment"], total="__aggregate__").select("segment", "pairs", "edits", "gold_len", "gcer")


@query("collapsed_quality")
def collapsed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair a page: all lines joined, then cleaned; words compared."""
    side = lambda df, t: df.select("page_id", F.posexplode(F.split(t, "\n")).alias("line_idx", "line"))
    g = align.collapsed_pages(side(pages(spark, sf_dir), "text"), ["page_id"], "line_idx", "line", "gold")
    p = align.collapsed_pages(side(readings(spark, sf_dir), "transcript"), ["page_id"], "line_idx", "line", "pred")
    both = g.join(p, "page_id")
    return both.select("page_id", edit.word_distance(F.col("gold"), F.col("pred")).alias("word_edits"), F.size(edit.words(F.col("gold"))).alias("gold_words"))


@query("language_errors")
def language_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of values by the language of their characters: stored value against its normal form."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null and normalized_value is not null and primary_language is not null")
    pairs = v.select("dictionary", F.lower("value").alias("gold"), F.col("normalized_value").alias("pred"), F.array_repeat("primary_language", F.length("value")).alias("languages"))
    return metrics.per_language(pairs, ["dictionary"])


@query("label_prf", "with v as (select distinct value_id, dictionary, status, span_start from mdf_value_projections), c as (select dictionary, count(*) filter (where status = 'exact' and span_start is not null) as tp, count(*) filter (where status <> 'exact' and span_start is not null) as fp, count(*) filter (where status = 'exact' and span_start is null) as fn from v group by dictionary), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c) select dictionary, tp, fp, fn, p as precision, r as recall, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from r")
def label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = once(spark, sf_dir, "mdf_value_projections", "value_id")
    exact, placed = F.col("status") == "exact", F.col("span_start").isNotNull()
    return metrics.prf(v.groupBy("dictionary").agg(F.count_if(exact & placed).alias("tp"), F.count_if(~exact & placed).alias("fp"), F.count_if(exact & ~placed).alias("fn")))


@query("source_report", "select coalesce(source, case when grouping(source) = 1 then '__aggregate__' end) as source, coalesce(lang, case when grouping(lang) = 1 then '__aggregate__' end) as lang, count(*) as docs, cast(sum(n_chars) as bigint) as chars, grouping_id(source, lang) as level from documents group by grouping sets ((source, lang), (source), ())")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    g = d.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("bigint").alias("level"), F.grouping("source").alias("_s"), F.grouping("lang").alias("_l"))
    all_ = F.lit("__aggregate__")
    return g.select(F.when(F.col("_s") == 1, all_).otherwise(F.col("source")).alias("source"), F.when(F.col("_l") == 1, all_).otherwise(F.col("lang")).alias("lang"), "docs", "chars", "level")


@query("status_counts", "select status, count(distinct value_id) as n from mdf_value_projections group by status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "mdf_value_projections", "value_id").groupBy("status").agg(F.count("*").alias("n"))


@query("baseline_delta", "with n as (select source, avg(n_chars) as chars, count(*) as docs from documents where source is not null group by source), b as (select source, avg(n_chars) as chars, count(*) as docs from documents where source is not null and lang = 'en' group by source) select n.source, n.chars, round(n.chars - b.chars, 6) as chars_delta, n.docs, round(cast(n.docs as double) - b.docs, 6) as docs_delta from n left join b using (source)")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where("source is not null")
    agg = lambda x: x.groupBy("source").agg(F.avg("n_chars").alias("chars"), F.count("*").alias("docs"))
    return metrics.baseline_delta(agg(d), agg(d.where("lang = 'en'")), ["source"], ["chars", "docs"])


@query("status_pivot", "with v as (select distinct value_id, dictionary, status from mdf_value_projections) select dictionary, nullif(count(*) filter (where status = 'exact'), 0) as exact, nullif(count(*) filter (where status = 'compact'), 0) as compact, nullif(count(*) filter (where status = 'token'), 0) as token, nullif(count(*) filter (where status = 'unmapped'), 0) as unmapped from v group by dictionary")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = once(spark, sf_dir, "mdf_value_projections", "value_id").groupBy("dictionary", "status").agg(F.count("*").alias("n"))
    return metrics.pivot_buckets(n, ["dictionary"], "status", ["exact", "compact", "token", "unmapped"], "n")


@query("usage_rollup", "select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, sum(value) as value from events group by event_type")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "value")
    return metrics.usage_totals(e, ["event_type"], ["k", "value"])


@query("tag_confusion")
def tag_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold headwords of entries against a prediction that also marks their parts of speech."""
    e = once(spark, sf_dir, "dictionary_entries", "entry_id").where("gloss is not null and headword is not null")
    p = e.select("dictionary", F.concat_ws(" ", F.concat(F.lit("<b>"), "headword", F.lit("</b>")), F.concat(F.lit("<i>"), "pos", F.lit("</i>")), "gloss").alias("gold"), F.concat_ws(" ", F.concat(F.lit("<b>"), "headword"), F.concat("pos", F.lit("</b>")), "gloss").alias("pred"))
    return metrics.prf(metrics.tag_confusion(p, ["dictionary"]))


# windows, order and top-k


@query("neighbour_pages", "select page_id, lag(page_id) over w as previous_page_id, lead(page_id) over w as next_page_id from (select distinct dictionary, page_id, page_number from dictionary_pages) window w as (partition by dictionary order by page_number)")
def neighbour_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", "page_id").distinct()
    return layout.neighbours(p, ["dictionary"], text.page_sort_key(F.substring_index("page_id", "/", -1)), ["page_id"]).drop("dictionary")


@query("block_columns", "with b as (select distinct block_row_id, page_id, x0, x1 from layout_blocks where x0 is not null and x1 is not null), c as (select *, (x0 + x1) / 2 as x from b), g as (select *, x - lag(x) over (partition by page_id order by x, block_row_id) as gap, max(x) over (partition by page_id) - min(x) over (partition by page_id) as spread from c), r as (select *, row_number() over (partition by page_id order by gap desc nulls last, x desc, block_row_id desc) as k from g) select block_row_id, cast(sum(case when gap >= 0.08 and k <= 2 and spread >= 0.12 then 1 else 0 end) over (partition by page_id order by x, block_row_id) as int) as column_no from r")
def block_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = once(spark, sf_dir, "layout_blocks", "block_row_id").where("x0 is not null and x1 is not null")
    return layout.columns(b, ["page_id"], "block_row_id").select("block_row_id", "column_no")


@query("layout_transcripts")
def layout_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = once(spark, sf_dir, "layout_blocks", "block_row_id").where("text is not null and text <> '' and y0 is not null and x0 is not null and x1 is not null")
    return layout.transcript(b, ["page_id"], "block_row_id")


@query("flat_rows", "with b as (select distinct block_row_id, page_id, block_no, x0, text from layout_blocks where text is not null and x0 is not null), r as (select page_id, case when x0 < 0.5 then 0 else 2 end as rank, block_no, block_row_id, text from b) select page_id, cast(row_number() over (partition by page_id order by rank, block_no, block_row_id) - 1 as int) as line_idx, text as line from r")
def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = once(spark, sf_dir, "layout_blocks", "block_row_id").where("text is not null and x0 is not null")
    rows = b.select("page_id", F.when(F.col("x0") < 0.5, "left").otherwise("right").alias("column_id"), F.col("block_no").cast("string").alias("line_number"), "text", F.col("block_row_id").alias("row_idx"))
    return layout.flatten(rows, ["page_id"])


@query("read_order")
def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's stored block order is from the order of its columns."""
    b = once(spark, sf_dir, "layout_blocks", "block_row_id").where("x0 is not null and x1 is not null and y0 is not null")
    placed = layout.columns(b, ["page_id"], "block_row_id").withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy("column_no", "y0", "block_row_id")))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_row_id", "place"))), lambda x: x["place"])
    return placed.groupBy("page_id").agg(seq.alias("s")).select("page_id", edit.order_distance(F.col("s")).alias("order_edit"))


@query("latest_events", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


@query("report_samples", "with v as (select distinct value_id, dictionary, value from mdf_value_projections where status = 'unmapped') select dictionary, value_id, value, row_number() over (partition by dictionary order by value_id) as sample_no from v qualify sample_no <= 8")
def report_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("status = 'unmapped'").select("dictionary", "value_id", "value")
    return metrics.samples(v, ["dictionary"], [F.col("value_id")], 8).withColumn("sample_no", F.col("sample_no").cast("bigint"))


# expansion, increments, streams


@query("sweep_runs", "select r_name as region, n as size, 'run_' || r_name || '_' || n as name from region, (values (1), (2), (4)) s(n) where not (r_name = 'ASIA' and n = 4)")
def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    sizes = spark.createDataFrame([(1,), (2,), (4,)], "size int")
    return incremental.sweep([regions, sizes], "run_{region}_{size}", spark.createDataFrame([("ASIA", 4)], "region string, size int"))


@query("to_compute", "with t as (select distinct page_id, dictionary, sha256(mdf_text) as stamp from dictionary_pages where mdf_text is not null), c as (select * from t where cast(regexp_extract(page_id, '(\\d+)$', 1) as int) % 2 = 0 and dictionary <> 'Chevrin-French') select page_id, dictionary, stamp from t where page_id not in (select page_id from c)")
def to_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with no valid cached result; even pages are cached, and one dictionary is to be done again."""
    p = once(spark, sf_dir, "dictionary_pages", "page_key").where("mdf_text is not null").select("page_id", "dictionary", F.sha2(F.encode("mdf_text", "UTF-8"), 256).alias("stamp"))
    cache = p.where(F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") % 2 == 0).withColumn("version", F.lit(13))
    return incremental.to_compute(p, cache, ["page_id"], ["stamp"], 13, ["Chevrin-French"], "dictionary").select("page_id", "dictionary", "stamp")


@query("sync_status", "with a as (select page_id, regexp_replace(text, '\\n+$', '') as t from (select distinct stage1_id, page_id, text from stage1_projections where text is not null)), n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), b as (select split_part(page_id, '/', 1) || '/' || stem as page_id, regexp_replace(min_by(transcript, neighbor_id), '\\n+$', '') as t from n group by 1) select page_id, case when a.t is null then 'new' when b.t is null then 'gone' when a.t = b.t then 'unchanged' else 'changed' end as status from a full join b using (page_id)")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sync_status(pages(spark, sf_dir), readings(spark, sf_dir).withColumnRenamed("transcript", "text"), ["page_id"], "text")


@query("status_changes", "with o as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) select user_id, event_id, event_type, previous from o where previous is distinct from event_type")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return stream.status_changes(e, "user_id", "o", "event_type").select("user_id", "event_id", "event_type", "previous")


@query("stream_windows", "select date_trunc('day', ts) as day, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from the event stream, run to completion over the files at hand."""
    import uuid

    from lexforge.session import checkpoint_dir

    schema = read_table(spark, sf_dir, "events").schema
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    got = stream.windowed(stream.read_events(spark, sf_dir, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "value", "3650 days")
    name = f"windows_{uuid.uuid4().hex}"
    q = got.select(F.col("window.start").alias("day"), "event_type", "n", "total").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("verdict_replay", "with e as (select user_id, event_type as t, row_number() over (partition by user_id order by event_id) as k from events where user_id is not null), p as (select *, lag(t) over (partition by user_id order by k) as before from e), f as (select user_id, min(k) as k from p where k <= 3 and (t in ('purchase', 'error') or t = before) group by 1), n as (select user_id, least(count(*), 3) as n from e group by 1) select n.user_id as run_id, case when f.k is null then 'max_attempts' when p.t = 'purchase' then 'accepted' when p.t = 'error' then 'rejected' else 'repeated' end as outcome, cast(coalesce(f.k, n) as int) as attempts from n left join f using (user_id) left join p on p.user_id = f.user_id and p.k = f.k")
def verdict_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded loop replayed over recorded events: purchases accept, errors reject, the rest retry."""
    e = read_table(spark, sf_dir, "events").where("user_id is not null")
    kinds = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("retry")
    issue = F.array(F.struct(F.col("event_type").alias("type"), F.lit("seen").alias("evidence"), F.lit("change 'a' to 'b'").alias("suggested_fix"), F.lit(None).cast("string").alias("current_text"), F.lit(None).cast("string").alias("expected_text"), F.lit(None).cast("int").alias("line_index")))
    return verify.replay(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt"), kinds.alias("decision"), F.lit(0.9).alias("confidence"), issue.alias("issues")))
