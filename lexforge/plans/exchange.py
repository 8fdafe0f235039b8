"""Queries of sources, sinks, discovery, configurations, annotation tasks and decisions.

Files that the driver's tables lack are written from them: recognisers' JSON, column tables, tasks, listings. Real files
go to the session's shared folder and are read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import scripts, text
from lexforge.operators import align, exchange, incremental, labels, mdf, metrics, spans
from lexforge.plans.catalog import once, pages, query, readings
from lexforge.session import checkpoint_dir, read_table
from lexforge.sources import files
from lexforge.streaming import events as stream

S = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
TRIM = f"regexp_replace(text, '^{S}+|{S}+$', '', 'g')"
BLOCKS = "(select distinct block_row_id, page_id, block_no, x0, y0, x1, y1, text, category from layout_blocks where text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null)"


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "layout_blocks", "block_row_id").where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def page_json(rows: DataFrame, item: dict, whole: str | None = None) -> DataFrame:
    """page_id, value: a page's blocks as a JSON list in block order, or inside the object `whole` (a format with %s)."""
    each = F.array_sort(F.collect_list(F.struct("block_no", "block_row_id", F.to_json(F.struct(*[x.alias(k) for k, x in item.items()])).alias("j"))))
    joined = F.concat(F.lit("["), F.array_join(F.transform(each, lambda x: x["j"]), ","), F.lit("]"))
    return rows.groupBy("page_id").agg((joined if whole is None else F.format_string(whole, joined)).alias("value"))


PLACED = f"select page_id, row_number() over (partition by page_id order by block_no, block_row_id) - 1 as block_no, x0, y0, x1, y1, text, category from {BLOCKS}"


@query("list_blocks", f"select page_id, cast(block_no as int) as block_no, x0, y0, x1, y1, {TRIM} as text, coalesce(category, 'text') as category from ({PLACED}) where {TRIM} <> '' and lower(coalesce(category, '')) not in ('figure', 'image', 'seal', 'chart', 'picture', 'table_caption_image')")
def list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as a recogniser's list of boxes from 0 to 1, read back."""
    box = F.array("x0", "y0", "x1", "y1")
    return files.mineru_blocks(page_json(blocks(spark, sf_dir), {"bbox": box, "type": F.col("category"), "content": F.col("text")}))


@query("pixel_blocks", f"select page_id, cast(block_no as int) as block_no, x0 * 2000 / 2000 as x0, y0 * 3000 / 3000 as y0, x1 * 2000 / 2000 as x1, y1 * 3000 / 3000 as y1, {TRIM} as text, coalesce(category, 'text') as category from ({PLACED}) where {TRIM} <> '' and lower(coalesce(category, '')) not in ('figure', 'image', 'seal', 'chart', 'picture', 'table_caption_image')")
def pixel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written with pixel boxes, scaled back by the page's size."""
    b = blocks(spark, sf_dir)
    box = F.array(F.col("x0") * 2000, F.col("y0") * 3000, F.col("x1") * 2000, F.col("y1") * 3000)
    return files.paddle_blocks(page_json(b, {"block_bbox": box, "block_label": F.col("category"), "block_content": F.col("text")}, '{"width": 2000, "height": 3000, "parsing_res_list": %s}'))


@query("contour_blocks", f"select page_id, 0 as page_no, cast(block_no as int) as block_no, x0 * 100 / 100 as x0, y0 * 100 / 100 as y0, x1 * 100 / 100 as x1, y1 * 100 / 100 as y1, {TRIM} as text, 'text' as category from ({PLACED}) where {TRIM} <> ''")
def contour_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as contours with the text under its second key, read back as boxes."""
    x0, y0, x1, y1 = (F.col(c) * 100 for c in ("x0", "y0", "x1", "y1"))
    cnt = F.array(F.array(x0, y1), F.array(x1, y1), F.array(x1, y0), F.array(x0, y0))
    return files.mathpix_blocks(page_json(blocks(spark, sf_dir), {"cnt": cnt, "text": F.lit(" "), "text_display": F.col("text")}, '{"pages": [{"page_width": 100, "page_height": 100, "lines": %s}]}'))


SECTION = "case when y0 < 0.08 then 'header' when y0 > 0.92 then 'footer' when x0 < 0.5 then 'left' else 'right' end"
SECTION_LINES = f"(select page_id, sec, rank, row_number() over (partition by page_id, sec order by block_no, block_row_id, j) as n, {TRIM} as text from (select page_id, block_no, block_row_id, sec, case sec when 'header' then 0 when 'left' then 1 when 'right' then 2 else 3 end as rank, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as j from (select *, {SECTION} as sec from {BLOCKS})) where {TRIM} <> '')"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, header, left, right, footer: block texts joined by section."""
    b = blocks(spark, sf_dir).withColumn("sec", F.expr(SECTION))
    joined = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sec") == s, F.struct("block_no", "block_row_id", "text")))), lambda x: x["text"]), "\n").alias(s)
    return b.groupBy("page_id").agg(*map(joined, ("header", "left", "right", "footer"))).withColumns({"single": F.lit(None).cast("string"), "middle": F.lit("")})


ROWS_SQL = f"select page_id, cast(row_number() over (partition by page_id order by rank, n) - 1 as int) as row_idx, sec as column_id, case when sec in ('left', 'right') then cast(n as varchar) else '' end as line_number, text from {SECTION_LINES}"


@query("section_rows", ROWS_SQL)
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section texts as numbered rows of a page table."""
    return exchange.section_rows(sections(spark, sf_dir), ["page_id"])


@query("column_tables", ROWS_SQL)
def column_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page tables written as text and read back."""
    tables = exchange.table_text(exchange.section_rows(sections(spark, sf_dir), ["page_id"]), ["page_id"])
    return files.column_tsv(tables)


@query("table_files", ROWS_SQL.replace("select page_id, cast", "select page_id, cast"))
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page tables as one file a page in the shared folder, read back by path."""
    tables = exchange.table_text(exchange.section_rows(sections(spark, sf_dir), ["page_id"]), ["page_id"])
    at = folder(spark, "tables")
    files.write_pages(tables.select(F.concat("page_id", F.lit("_stage1.tsv")).alias("name"), "value"), at)
    back = files.whole_text(spark, at, "*_stage1.tsv")
    page = F.regexp_extract(F.url_decode("file"), r"([^/]+/page_[^/]+)_stage1\.tsv$", 1)
    return files.column_tsv(back.select(page.alias("page_id"), "value"))


@query("flat_files", "select page_id, cast(k as int) as line_idx, line from (select page_id, unnest(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) as line, unnest(range(len(string_split(regexp_replace(text, '\\n+$', ''), chr(10))))) as k from (select distinct stage1_id, page_id, text from stage1_projections where text <> ''))")
def flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as one flat file a page in the shared folder, read back as lines; a final newline is no line."""
    at = folder(spark, "flat")
    files.write_pages(pages(spark, sf_dir).where("text <> ''").select(F.concat("page_id", F.lit("_stage1_flat.txt")).alias("name"), F.concat(F.regexp_replace("text", r"\n+$", ""), F.lit("\n")).alias("value")), at)
    back = files.whole_text(spark, at, "*_flat.txt")
    return files.flat_lines(back.select(F.regexp_extract(F.url_decode("file"), r"([^/]+/page_[^/]+)_stage1_flat\.txt$", 1).alias("page_id"), "value"))


FLAT_OR_TABLE = f"with n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), r as (select split_part(page_id, '/', 1) || '/' || stem as page_id, min_by(transcript, neighbor_id) as transcript from n group by 1), t as (select page_id, string_agg(text, chr(10) order by rank, n) as body from {SECTION_LINES} group by 1)"


@query("preferred_transcripts", FLAT_OR_TABLE + " select page_id, transcript as body, 0 as origin from r union all select page_id, body, 1 from t where page_id not in (select page_id from r)")
def preferred_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's flat transcript, else its column table's lines."""
    rows = exchange.section_rows(sections(spark, sf_dir), ["page_id"])
    table = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return exchange.resolved(readings(spark, sf_dir).withColumnRenamed("transcript", "body"), [table], ["page_id"])


LISTS = ("cross_references", "examples", "example_glosses")


@query("entry_tables", "select entry_id, coalesce(headword, '') as headword, coalesce(gloss, '') as gloss, coalesce(cast(sense_number as varchar), '') as sense_number, " + ", ".join(f"array_to_string(list_filter(coalesce({c}, []), lambda x: x is not null and x <> ''), ' | ') as {c}" for c in LISTS) + " from (select distinct entry_id, headword, gloss, sense_number, cross_references, examples, example_glosses from dictionary_entries)")
def entry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.entry_table(once(spark, sf_dir, "dictionary_entries", "entry_id"), ["entry_id"], ["headword", "gloss", "sense_number"], list(LISTS))


@query("entry_json", "select distinct entry_id, headword, gloss from dictionary_entries")
def entry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as JSON in the shared folder and read back."""
    at = folder(spark, "entries")
    files.write_json(once(spark, sf_dir, "dictionary_entries", "entry_id").select("entry_id", "headword", "gloss"), at)
    return spark.read.schema("entry_id bigint, headword string, gloss string").json(at)


@query("extra_columns", "with e as (select event_id, unnest(json_keys(props)) as key from events) select key, row_number() over (order by min(event_id), key) as place from e group by key")
def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' properties as columns, in the order of their first appearance."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("extra"))
    return exchange.extra_keys(e, "extra", "event_id").withColumn("place", F.col("place").cast("bigint"))


@query("projection_files", "select distinct page_id, value_id, primary_language as language from mdf_value_projections where primary_language is not null and primary_language <> ''")
def projection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection JSON of each page: the language of its lines, blank ones dropped."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id")
    fields = F.array_sort(F.collect_list(F.struct(F.col("value_id").alias("line_index"), F.col("primary_language"))))
    docs = v.groupBy("page_id").agg(F.to_json(F.struct(fields.alias("fields"))).alias("value"))
    return files.projection_languages(docs).select("page_id", F.col("line_index").alias("value_id"), "language")


@query("projection_export", "with v as (select distinct value_id, page_id, value, span_start, span_end from mdf_value_projections) select page_id, coalesce(string_agg(span_start || ':' || span_end, ';' order by value_id) filter (where span_start is not null and span_end is not null), '') as ranges, sha256(coalesce(string_agg(coalesce(value, ''), chr(10) order by value_id), '')) as sha from v group by page_id")
def projection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's ranges as `s:e;s:e` and the hash of its values."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id")
    rows = F.array_sort(F.collect_list(F.struct("value_id", "value", "span_start", "span_end")))
    g = v.groupBy("page_id").agg(rows.alias("r"))
    placed = F.filter("r", lambda x: x["span_start"].isNotNull() & x["span_end"].isNotNull())
    ranges = F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["span_start"].cast("string"), x["span_end"].cast("string"))), ";")
    return g.select("page_id", ranges.alias("ranges"), F.sha2(F.encode(F.array_join(F.transform("r", lambda x: F.coalesce(x["value"], F.lit(""))), "\n"), "UTF-8"), 256).alias("sha"))


SPAN_SQL = "with s as (select distinct page_id, text, languages from stage1_projections where text <> '' and languages is not null and len(languages) > 0), c as (select page_id, unnest(languages) as language, unnest(range(len(languages))) as k from s), n as (select *, case when language is distinct from lag(language) over (partition by page_id order by k) then 1 else 0 end as new from c), i as (select *, sum(new) over (partition by page_id order by k) as island from n) select page_id, cast(min(k) as int) as start_at, cast(max(k) + 1 as int) as end_at, language from i group by page_id, island, language"


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).where("text <> '' and languages is not null and size(languages) > 0")
    return p.select("page_id", "dictionary", "text", spans.spans_of_labels(F.col("languages")).alias("spans"))


@query("span_map_files", SPAN_SQL)
def span_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span maps as one JSON file a page, read back."""
    at = folder(spark, "maps")
    number = F.regexp_extract("page_id", r"(\d+)$", 1).cast("int")
    body = F.to_json(F.struct(F.col("page_id").alias("dictionary"), number.alias("page"), F.sha2(F.encode("text", "UTF-8"), 256).alias("source_text_sha"), F.lit("v1").alias("rule_set"), F.lit("script").alias("labeled_via"), "spans"))
    files.write_pages(maps(spark, sf_dir).select(F.concat("page_id", F.lit("_lang.json")).alias("name"), body.alias("value")), at)
    s = files.span_maps(spark, at).select(F.col("dictionary").alias("page_id"), F.explode("spans").alias("s"))
    return s.select("page_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.language")


@query("span_map_sync", "with s as (select distinct page_id, text, languages, row_number() over (order by page_id) as n from (select distinct page_id, text, languages from stage1_projections where text <> '' and len(languages) > 0)) select page_id, case when cast(regexp_extract(page_id, '(\\d+)$', 1) as int) % 3 = 0 then 'new' when cast(regexp_extract(page_id, '(\\d+)$', 1) as int) % 3 = 1 then 'updated' else 'unchanged' end as status from s")
def span_map_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span maps against those stored before: a third is new, a third had other labels; only these are written."""
    now = maps(spark, sf_dir).select("page_id", "spans")
    number = F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") % 3
    stored = now.where(number > 0).withColumn("spans", F.when(number == 1, F.slice("spans", 1, 0)).otherwise(F.col("spans")))
    return incremental.synced(stored, now, ["page_id"], "spans", folder(spark, "synced")).select("page_id", "status")


@query("config_flags", "select event_id, event_id % 2 = 0 as alphabet_used, false as hint_used from events")
def config_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of run configurations; one of them unreadable."""
    e = read_table(spark, sf_dir, "events")
    return files.run_flags(e.select("event_id", F.concat(F.lit('{"alphabet": {"used": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit('}, "ocr_hint": {"used": "?"}}')).alias("value")))


@query("usage_files", "select 'runs/' || event_id || '/' || event_id || '_usage.json' as file, event_id as prompt_tokens, cast(null as bigint) as completion_tokens, event_id + 7 as total_tokens, value as cost, cast(null as double) as elapsed_seconds from events where event_id % 2 = 0")
def usage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of files named after their folder; others don't count."""
    e = read_table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_id").cast("string"), F.lit("_usage.json"))).otherwise("guide_usage.json")
    body = F.to_json(F.struct(F.col("event_id").alias("prompt_tokens"), (F.col("event_id") + 7).alias("total_tokens"), F.col("value").alias("cost")))
    return files.usage_rows(e.select(F.concat_ws("/", F.lit("runs"), F.col("event_id").cast("string"), name).alias("file"), body.alias("value")))


@query("metadata_files", "select dictionary, trim(title) as title, source_language, '' as layout_kind from dictionaries")
def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as CSV with spaces and nulls, read back trimmed and without nulls."""
    at = folder(spark, "metadata")
    d = read_table(spark, sf_dir, "dictionaries")
    files.write_csv(d.select("dictionary", F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"), "source_language", F.lit(None).cast("string").alias("layout_kind")), at)
    return files.metadata_csv(spark, at)


@query("tsv_files", "select dictionary, title, source_language from dictionaries")
def tsv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "tsv")
    files.write_tsv(read_table(spark, sf_dir, "dictionaries").select("dictionary", "title", "source_language"), at)
    return files.generic_tsv(spark, at)


@query("gold_pages", "select distinct page_id, cast(regexp_replace(split_part(page_id, '/', 2), '\\D', '', 'g') as bigint) as page_number from dictionary_pages")
def gold_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "dictionary_pages").select("page_id").distinct()
    return p.select("page_id", exchange.page_number(F.element_at(F.split("page_id", "/"), -1)).alias("page_number"))


@query("held_dictionaries", "select dictionary from dictionaries where dictionary in (select dictionary from dictionary_pages)")
def held_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries with a page or more."""
    return read_table(spark, sf_dir, "dictionaries").select("dictionary").join(read_table(spark, sf_dir, "dictionary_pages").select("dictionary"), "dictionary", "left_semi")


NAMES = ("output.mmd", "output.txt", "result.json", "output.md", "content.json", "page_res.json", "lines.json", "page.tsv")
#: Listings: orders are pages, each of their lines a file.
FILES = "(select cast(l_orderkey as varchar) as page, " + "case l_linenumber " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(NAMES)) + " end as name, cast(l_quantity as bigint) % 3 as size, case when l_linenumber % 2 = 0 then cast(l_orderkey as varchar) else l_orderkey || '/child' end as folder, l_partkey from lineitem where l_orderkey is not null) files"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lexforge_lines")
    return spark.sql("select * from " + FILES.replace("from lineitem", "from _lexforge_lines").replace("varchar", "string"))


@query("markdown_artifacts", f"select page, name, folder from (select *, row_number() over (partition by page order by case name when 'output.md' then 0 when 'output.txt' then 2 when 'output.mmd' then 4 end, name) as k from {FILES} where size > 0 and name in ('output.md', 'output.txt', 'output.mmd')) where k = 1")
def markdown_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown result of each page, among files that aren't empty."""
    return exchange.artifact(listing(spark, sf_dir).where("size > 0").select("page", "name", "folder", "size").distinct()).select("page", "name", "folder")


@query("page_backends", f"select page, case when bool_or(regexp_matches(name, '(?i)\\.(md|mmd)$')) then 'markdown' when bool_or(regexp_matches(name, 'content(_list)?\\.json$')) then 'mineru' when bool_or(regexp_matches(name, '_res\\.json$')) then 'paddle' when bool_or(regexp_matches(name, 'lines\\.json$|\\.docx$')) then 'mathpix' when bool_or(regexp_matches(name, '^result\\.json$|^output\\.txt$')) then 'glm' when bool_or(regexp_matches(name, '\\.tsv$')) then 'tsv' end as backend from {FILES} group by page")
def page_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.backend_of(listing(spark, sf_dir))


@query("block_results", f"select page, folder, name from (select *, row_number() over (partition by page order by case when folder = page then 0 else 1 end, folder, name) as k from (select distinct page, folder, name from {FILES} where name in ('content.json', 'page_res.json'))) where k = 1")
def block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block results in a page's own folder, else in its first child folder."""
    return exchange.block_files(listing(spark, sf_dir).select("page", "folder", "name").distinct(), "page", "folder", "name")


@query("text_pages", f"select page, min_by(t, struct_pack(a := rank, b := t)) as text from (select page, case name when 'result.json' then 'json ' || l_partkey else 'plain ' || l_partkey end as t, case name when 'result.json' then 0 else 1 end as rank from {FILES} where name in ('result.json', 'output.txt')) group by page")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of result.json, else of output.txt."""
    body = F.when(F.col("name") == "result.json", F.concat(F.lit('{"text": "json '), F.col("l_partkey").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit("plain "), F.col("l_partkey").cast("string")))
    return exchange.text_page(listing(spark, sf_dir).withColumn("value", body), "page", "name", "value")


@query("complete_pages", f"select page, bool_or((regexp_matches(name, '\\.(md|mmd|txt)$') and size > 0) or (regexp_matches(name, '_res\\.json$') and size > 1)) as complete from {FILES} where name is not null group by page")
def complete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a text that isn't blank or a result with blocks."""
    body = F.when(F.col("name").rlike("json$"), F.concat(F.lit('{"parsing_res_list": ['), F.when(F.col("size") > 1, "{}").otherwise(""), F.lit("]}"))).otherwise(F.when(F.col("size") > 0, "text").otherwise(" \n"))
    return exchange.complete(listing(spark, sf_dir).where("name is not null").withColumn("value", body), "page", "name", "value")


@query("experiment_faults", "with f as (select l_orderkey as page, min(cast(l_quantity as bigint)) % 4 as size, min(l_returnflag) as config from lineitem group by 1), u as (select max_by(config, struct_pack(n := n, c := config)) as usual from (select config, count(*) as n from f group by config)), e as (select o_orderkey + o_orderkey % 2 * 1000000 as page from orders) select page, case when size is null then 'missing' when size = 0 then 'empty' when config <> usual then 'other_config' end as fault from e left join f using (page), u where size is null or size = 0 or config <> usual")
def experiment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages expected of an experiment whose files are missing, empty or made under another configuration."""
    f = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg((F.min(F.round("l_quantity").cast("bigint")) % 4).alias("size"), F.min("l_returnflag").alias("config"))
    e = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") + F.col("o_orderkey") % 2 * 1000000).alias("page"))
    return exchange.experiment_faults(e, f, "page", "size", "config")


@query("move_plan", "select distinct 'old/' || page_id || '/lang.json' as source, 'new/' || page_id || '/lang.json' as target from stage1_projections where page_id not in (select split_part(page_id, '/', 1) || '/' || stem from neighbor_pages where transcript is not null and transcript <> '')")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to be moved to another root, but for pages that are there."""
    f = read_table(spark, sf_dir, "stage1_projections").select(F.concat(F.lit("old/"), "page_id", F.lit("/lang.json")).alias("source")).distinct()
    there = readings(spark, sf_dir).select(F.concat(F.lit("new/"), "page_id").alias("page"))
    return exchange.move_plan(f, there, "source", "old/", "new/")


@query("output_names", "select distinct page_id, split_part(page_id, '/', 2) || '_stage1.tsv' as table_name, split_part(page_id, '/', 2) || '_stage1_flat.txt' as flat, split_part(page_id, '/', 2) || '_stage1_GOLD.tsv' as gold_table, split_part(page_id, '/', 2) || '_stage1_GOLD_flat.txt' as gold_flat, split_part(page_id, '/', 1) as language from stage1_projections")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of pages, and the language that a sample's path names."""
    p = read_table(spark, sf_dir, "stage1_projections").select("page_id").distinct()
    return p.select("page_id", exchange.output_names(F.element_at(F.split("page_id", "/"), -1)).alias("n"), exchange.path_language(F.concat(F.lit("data/samples/"), "page_id")).alias("language")).select("page_id", F.col("n.table").alias("table_name"), "n.flat", "n.gold_table", "n.gold_flat", "language")


# configurations


@query("layouts", "select dictionary, case when dictionary = 'Chevrin-French' then 'column_trilingual' when len(target_languages) >= 2 then 'inline_trilingual' else 'inline_bilingual' end as layout, source_language as source, target_languages as targets, coalesce(a, '') as archive from dictionaries left join (select dictionary, min(source_file) as a from dictionary_pages group by 1) using (dictionary)")
def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of dictionaries with the archive of their metadata."""
    meta = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", F.col("source_file").alias("archive"))
    return exchange.configs(read_table(spark, sf_dir, "dictionaries"), meta, {"Chevrin-French": "column_trilingual"})


@query("csv_targets", "select dictionary, list_filter(list_transform(regexp_split_to_array(array_to_string(target_languages, ' / ') || ', ,' || source_language, '[,/]'), lambda x: trim(x)), lambda x: x <> '') as names from dictionaries")
def csv_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "dictionaries")
    return d.select("dictionary", exchange.csv_targets(F.concat(F.array_join("target_languages", " / "), F.lit(", ,"), "source_language")).alias("names"))


@query("page_stems", "select dictionary, ['page_' || lo] || list_transform(range(lo, hi + 1), lambda x: 'page_' || x) as stems from (select dictionary, min(page_number) as lo, max(page_number) as hi from dictionary_pages group by 1)")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "dictionary_pages").groupBy("dictionary").agg(F.min("page_number").alias("lo"), F.max("page_number").alias("hi"))
    return p.select("dictionary", exchange.page_stems(F.concat(F.lit("page_"), F.col("lo").cast("string"), F.lit(", "), F.concat_ws("-", "lo", "hi"))).alias("stems"))


def _named(part: str) -> str:
    return f"list_filter(target_languages, lambda x: contains(lower(x), '{part}'))[1]"


GN = f"coalesce({_named('chinese')}, {_named('russian')}, {_named('turkish')}, case when len(target_languages) > 1 then {_named('hindi')} end)"
SOLE = "case when len(target_languages) = 1 then target_languages[1] end"
MARKER_RULES = [(m, "source_language") for m in exchange.SOURCE_ROLE] + [(m, _named("english")) for m in ("ge", "de", "ue", "xe")] + [(m, _named("french")) for m in ("gr", "xr")] + [("gn", GN), ("xn", _named("chinese")), ("un", f"case when {_named('chinese')} is null then {_named('russian')} end")]
MARKER_SQL = "select dictionary, marker, language from (" + " union all ".join(f"select dictionary, '{m}' as marker, {f'coalesce({x}, {SOLE})' if m in exchange.TARGET_ROLE else x} as language from dictionaries" for m, x in MARKER_RULES) + ") where language is not null"


@query("marker_languages", MARKER_SQL)
def marker_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.marker_languages(read_table(spark, sf_dir, "dictionaries"))


KEY = "case lower(language) " + " ".join(f"when '{k}' then '{v}'" for k, v in text.LANGUAGE_CODES.items()) + " else regexp_replace(lower(language), '[^a-z0-9]+', '', 'g') end"


@query("line_roles", f"with m as ({MARKER_SQL}), f as (select distinct line_id, dictionary, marker from field_lines) select line_id, case when marker in {exchange.NO_ROLE} then null when marker in {exchange.SOURCE_ROLE} then concat_ws(':', 'source', {KEY}) when marker in {exchange.TARGET_ROLE} then concat_ws(':', 'target', {KEY}) end as role from f left join m using (dictionary, marker)")
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of field lines under their dictionary's marker languages."""
    d = read_table(spark, sf_dir, "dictionaries")
    f = once(spark, sf_dir, "field_lines", "line_id").join(exchange.marker_languages(d), ["dictionary", "marker"], "left").join(d.select("dictionary", "source_language"), "dictionary", "left")
    return f.select("line_id", exchange.role_of(F.col("marker"), F.col("language"), F.col("source_language")).alias("role"))


@query("attached_scripts", "with f as (select distinct line_id, page_id, record_index, line_index, value from field_lines), v as (select distinct value_id, page_id, record_index, line_index, primary_language, normalized_value from mdf_value_projections where primary_language <> '' and primary_language <> 'meta') select line_id, primary_language as language from f join v using (page_id, record_index, line_index) where value <> '' or normalized_value <> ''")
def attached_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field lines with the language of their projected value."""
    f = once(spark, sf_dir, "field_lines", "line_id").select("line_id", "page_id", "record_index", "line_index", F.col("value").alias("gold"))
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").select("page_id", "record_index", "line_index", F.col("primary_language").alias("language"), F.col("normalized_value").alias("pred"))
    return exchange.scripts_attached(f, v, ["page_id", "record_index", "line_index"], "gold", "pred").select("line_id", "language")


@query("read_configs", "select dictionary, case when dictionary < 'K' then 'own' else 'made' end as from_where from dictionaries")
def read_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by precedence: a dictionary's own, else the one made from its row."""
    d = read_table(spark, sf_dir, "dictionaries").select("dictionary")
    own = d.where("dictionary < 'K'").withColumn("from_where", F.lit("own"))
    return exchange.resolved(own, [d.withColumn("from_where", F.lit("made"))], ["dictionary"]).select("dictionary", "from_where")


# annotation


@query("task_columns", "select event_id as task, case when event_id % 3 = 0 then 'prefill' else 'annotation' end as origin, 'single' as column_id, case when event_id % 3 = 0 then 'given' else 'late ' || event_type end as text from events")
def task_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of tasks by column: of the newest annotation, else what they were given."""
    e = read_table(spark, sf_dir, "events")
    note = lambda stamp, x: F.struct(F.lit(stamp).alias("stamp"), F.create_map(F.lit("single"), x).alias("columns"))
    notes = F.array(note("2024-01-02", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("late "), "event_type"))), note("2024-01-01", F.lit("early")))
    return exchange.latest_texts(e.select(F.col("event_id").alias("task"), notes.alias("annotations"), F.create_map(F.lit("single"), F.lit("given")).alias("data")), "task")


@query("submitted_tasks", "select event_id, event_id % 4 = 1 as submitted from events")
def submitted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    notes = F.when(F.col("event_id") % 4 == 1, F.array(F.struct("event_type"))).when(F.col("event_id") % 4 == 2, F.array().cast("array<struct<event_type:string>>"))
    return e.select("event_id", exchange.submitted(notes).alias("submitted"))


@query("layout_votes", f"with s as (select distinct page_id, {SECTION} as sec from {BLOCKS}), v as (select split_part(page_id, '/', 1) as dictionary, page_id, 'two_col' as vote from s where sec in ('left', 'right') group by 1, 2), n as (select dictionary, vote, count(*) as n, min(page_id) as f from v group by 1, 2) select dictionary, min_by(vote, struct_pack(a := -n, b := f)) as layout from n group by 1")
def layout_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout that most pages of a dictionary show."""
    b = blocks(spark, sf_dir).select(F.substring_index("page_id", "/", 1).alias("dictionary"), "page_id", F.expr(SECTION).alias("column_id"))
    return exchange.layout_votes(b, "dictionary", "page_id")


@query("legends", "select dictionary, 'src' as code, 'Own name' as language from dictionaries union all select dictionary, 't' || k as code, target_languages[k] as language from dictionaries, range(1, 9) r(k) where k <= len(target_languages)")
def legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legends of model outputs, with an override."""
    d = read_table(spark, sf_dir, "dictionaries")
    lines = F.array_join(F.transform("target_languages", lambda x, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit(" =  "), x, F.lit(" "))), "\n")
    out = F.concat(F.lit("LANGUAGES:\nsrc = "), "source_language", F.lit("\n"), lines, F.lit("\nno legend line\nTAGGED:\n<src>a</src> x = y\n"))
    m = exchange.overridden(exchange.legend(out), F.create_map(F.lit("src"), F.lit("Own name")))
    return d.select("dictionary", F.explode(m).alias("code", "language"))


@query("residual_runs", "with w as (select line_id, unnest(list_filter(regexp_split_to_array(value, '" + S + "+'), lambda x: x <> '')) as w, unnest(range(len(list_filter(regexp_split_to_array(value, '" + S + "+'), lambda x: x <> '')))) as k from (select distinct line_id, value from field_lines)), f as (select *, length(w) <= 4 as s from w), r as (select *, sum(case when s and not coalesce(p, false) then 1 else 0 end) over (partition by line_id order by k) as run_no from (select *, lag(s) over (partition by line_id order by k) as p from f)) select line_id, cast(run_no as bigint) as run_no, string_agg(w, ' ' order by k) as text from r where s group by line_id, run_no")
def residual_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive short words of values as runs."""
    w = once(spark, sf_dir, "field_lines", "line_id").select("line_id", F.posexplode(F.filter(F.split("value", r"(?U)\s+"), lambda x: x != "")).alias("k", "w"))
    return exchange.islands_of(w.withColumn("s", F.length("w") <= 4), ["line_id"], "k", "s", "w")


# decisions

ISSUE = "case event_id % 5 when 0 then 'wrong_page' when 1 then 'typo' else 'vague' end"


@query("settled_verdicts", "select event_id, case when d = 'reject' and lost then 'recover' when d = 'retry' and (lost or (not concrete and whole)) then 'recover' else d end as decision from (select event_id, case event_id % 3 when 0 then 'accept' when 1 then 'retry' else 'reject' end as d, event_id % 5 = 0 or event_id % 7 = 0 as lost, event_id % 5 = 1 or event_id % 7 = 3 as concrete, event_id % 11 = 0 as whole from events)")
def settled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with refusals of a lost page and vague whole-page requests turned into recoveries."""
    e = read_table(spark, sf_dir, "events")
    c = F.col("event_id")
    evidence = F.when(c % 7 == 0, "This is a different page.").otherwise("")
    issue = F.struct(F.expr(ISSUE).alias("type"), evidence.alias("evidence"), F.lit("").alias("suggested_fix"), F.when(c % 5 == 1, "a").otherwise("").alias("current_text"), F.when(c % 5 == 1, "b").alias("expected_text"), F.lit(None).cast("int").alias("line_index"))
    more = F.struct(F.lit("x").alias("type"), F.when(c % 7 == 3, "seen").otherwise("").alias("evidence"), F.when(c % 7 == 3, "fix").otherwise("").alias("suggested_fix"), F.lit("").alias("current_text"), F.lit("q").alias("expected_text"), F.lit(None).cast("int").alias("line_index"))
    decision = F.when(c % 3 == 0, "accept").when(c % 3 == 1, "retry").otherwise("reject")
    return e.select("event_id", exchange.settled(decision, F.when(c % 11 == 0, "Read the WHOLE PAGE again").otherwise(""), F.array(issue, more)).alias("decision"))


@query("edge_texts", f"select stage1_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{S}+$', '')), chr(10)), '^{S}+|{S}+$', '', 'g') as edged from (select distinct stage1_id, text from stage1_projections where text is not null)")
def edge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as compared for changes."""
    return pages(spark, sf_dir).select("stage1_id", exchange.edge_text(F.col("text")).alias("edged"))


@query("display_texts", f"select line_id, regexp_replace(regexp_replace(nfc_normalize(value), '{S}+', ' ', 'g'), '^ +| +$', '', 'g') as shown from (select distinct line_id, value from field_lines)")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = once(spark, sf_dir, "field_lines", "line_id")
    return v.select("line_id", exchange.display_text(F.concat(F.lit("<b>"), "value", F.lit("</b> "))).alias("shown"))


@query("lexical_bounds", "select value_id, cast(s - length(regexp_extract(left(value, s), '([\\p{L}\\p{N}\\p{M}]*)$', 1)) as int) as start_at, cast(e + length(regexp_extract(substr(value, e + 1), '^([\\p{L}\\p{N}\\p{M}]*)', 1)) as int) as end_at from (select *, length(value) // 3 as s, length(value) // 2 as e from (select distinct value_id, value from mdf_value_projections where value is not null))")
def lexical_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans inside values, grown to whole words."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null")
    n = F.length("value")
    b = exchange.lexical_bounds(F.col("value"), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"))
    return v.select("value_id", b.alias("b")).select("value_id", F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"))


@query("labels_kept", f"select value_id, kept, list_transform(range(length(kept)), lambda i: primary_language) as languages from (select *, regexp_replace(value, '{S}|\\p{{P}}', '', 'g') as kept from (select distinct value_id, value, primary_language from mdf_value_projections where value is not null and primary_language is not null))")
def labels_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without white space and punctuation, their labels in step."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("value is not null and primary_language is not null")
    k = exchange.kept_with_labels(F.col("value"), F.array_repeat("primary_language", F.length("value")))
    return v.select("value_id", k.alias("k")).select("value_id", F.col("k.text").alias("kept"), F.col("k.labels").alias("languages"))


@query("block_lines", f"select block_row_id, list_filter(list_transform(string_split('cell a' || chr(10) || text, chr(10)), lambda x: regexp_replace(x, '^{S}+|{S}+$', '', 'g')), lambda x: x <> '') as lines from {BLOCKS}")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks behind a row of an HTML table, as lines."""
    b = blocks(spark, sf_dir)
    return b.select("block_row_id", exchange.block_lines(F.concat(F.lit("<TABLE><tr><td>cell a</td></tr>"), "text")).alias("lines"))


@query("table_columns", f"select page_id, cast(row_number() over (partition by page_id order by c, block_no, block_row_id, j) - 1 as int) as line_idx, {TRIM} as line from (select page_id, block_no, block_row_id, block_no % 2 as c, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as j from {BLOCKS}) where {TRIM} <> ''")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as cells of a table of two columns, read column by column."""
    b = blocks(spark, sf_dir).select("page_id", (F.col("block_no") % 2).alias("column_no"), F.struct("block_no", "block_row_id").alias("row_no"), "text")
    return exchange.table_columns(b, ["page_id"])


@query("flat_entries", f"select page_id, cast(row_number() over (partition by page_id order by entry_id) - 1 as int) as line_idx, regexp_replace(concat_ws(' ', case when entry_type = 'subentry' then nullif('—' || coalesce(nullif(h, ''), nullif(p, ''), ''), '—') else nullif(h, '') end, nullif(o, '') || '.', nullif(g, '')), '^{S}+|{S}+$', '', 'g') as line from (select entry_id, page_id, lower(entry_type) as entry_type, trim(coalesce(headword, '')) as h, trim(coalesce(parent_lexeme, '')) as p, trim(coalesce(pos, '')) as o, trim(coalesce(gloss, '')) as g from (select distinct entry_id, page_id, entry_type, headword, parent_lexeme, pos, gloss from dictionary_entries where coalesce(headword, '') <> '' or coalesce(gloss, '') <> ''))")
def flat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.flat_entries(once(spark, sf_dir, "dictionary_entries", "entry_id"), ["page_id"], "entry_id")


# increments, choice and streams


@query("cached_metrics", "select page_id, sha256(text) as stamp, length(text) as chars from (select distinct stage1_id, page_id, text from stage1_projections where text is not null)")
def cached_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page metrics saved in the shared folder and loaded under the same version; another version loads nothing."""
    p = pages(spark, sf_dir).select("page_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("stamp"), F.length("text").cast("bigint").alias("chars"))
    at = folder(spark, "cache")
    incremental.save_cache(p, at, 13)
    other = incremental.load_cache(spark, at, 12, p.schema)
    return incremental.load_cache(spark, at, 13, p.schema).unionByName(other)


@query("picked_pages", "with p as (select distinct dictionary, page_id, page_number, mdf_text is not null as gold from dictionary_pages), r as (select distinct split_part(page_id, '/', 1) || '/' || stem as page_id from neighbor_pages where transcript <> '') select dictionary, page_id from (select p.*, row_number() over (partition by dictionary order by case when gold then 0 else 1 end, case when r.page_id is not null then 0 else 1 end, page_number, p.page_id) as k from p left join r on p.page_id = r.page_id) where k = 1")
def picked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a dictionary: with records, then with a transcript, then the lowest."""
    p = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", "page_id", "page_number", F.col("mdf_text").isNotNull().alias("gold")).distinct()
    p = p.join(readings(spark, sf_dir).select("page_id", F.lit(True).alias("read")), "page_id", "left")
    order = F.struct((~F.col("gold")).cast("int"), F.col("read").isNull().cast("int"), F.col("page_number"), F.col("page_id"))
    return p.groupBy("dictionary").agg(F.min_by("page_id", order).alias("page_id"))


@query("newest_runs", "select user_id, event_id, ts from events order by ts desc, event_id desc limit 50")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's newest runs."""
    return read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("most_common", "select marker, count(distinct line_id) as n from field_lines group by marker order by n desc, marker")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "field_lines", "line_id").groupBy("marker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "marker")


@query("best_candidates", "with v as (select distinct value_id, page_id, marker, span_start, span_end from mdf_value_projections where span_start is not null and span_end is not null) select page_id, marker, max_by(value_id, struct_pack(a := span_end - span_start, b := -value_id)) as value_id from v group by 1, 2")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the widest span of each page and marker, the first in a tie."""
    v = once(spark, sf_dir, "mdf_value_projections", "value_id").where("span_start is not null and span_end is not null")
    return v.groupBy("page_id", "marker").agg(F.max_by("value_id", F.struct(F.col("span_end") - F.col("span_start"), -F.col("value_id"))).alias("value_id"))


@query("experiment_names", "select name from (select lower(event_type) as name from events union select lower(o_orderpriority) from orders) where name not in ('click') and contains(name, 'e')")
def experiment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both sources, less excluded ones, that hold a part."""
    a = read_table(spark, sf_dir, "events").select(F.lower("event_type").alias("name"))
    b = read_table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("name"))
    return a.union(b).distinct().where(~F.col("name").isin("click")).where(F.contains("name", F.lit("e")))


@query("label_sets", "with l as (select stage1_id, unnest(languages) as l from (select distinct stage1_id, languages from stage1_projections where len(languages) > 0)), v as (select distinct stage1_id, l from l where l is not null) select stage1_id, list_sort(list(l)) as labels from v group by stage1_id")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "stage1_projections", "stage1_id").where("size(languages) > 0").select("stage1_id", F.array_sort(F.array_distinct(F.array_compact("languages"))).alias("labels"))


@query("sync_summary", "with a as (select page_id, regexp_replace(text, '\\n+$', '') as t from (select distinct stage1_id, page_id, text from stage1_projections where text is not null)), n as (select distinct neighbor_id, page_id, stem, transcript from neighbor_pages where transcript is not null and transcript <> ''), b as (select split_part(page_id, '/', 1) || '/' || stem as page_id, regexp_replace(min_by(transcript, neighbor_id), '\\n+$', '') as t from n group by 1), s as (select page_id, case when a.t is null then 'new' when b.t is null then 'gone' when a.t = b.t then 'unchanged' else 'changed' end as status from a full join b using (page_id)) select split_part(page_id, '/', 1) as dictionary, status, count(*) as pages from s group by 1, 2")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages by dictionary."""
    s = incremental.sync_status(pages(spark, sf_dir), readings(spark, sf_dir).withColumnRenamed("transcript", "text"), ["page_id"], "text")
    return s.groupBy(F.substring_index("page_id", "/", 1).alias("dictionary"), "status").agg(F.count("*").alias("pages"))


@query("appended_events", "select user_id as run_id, event_id as sequence, event_type from events")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream appended to a store in the shared folder, each (run, sequence) once, then read."""
    schema = read_table(spark, sf_dir, "events").schema
    e = stream.read_events(spark, sf_dir, schema, glob="events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    at = folder(spark, "events")
    stream.append(e, at, f"{at}-state").awaitTermination()
    return spark.read.parquet(at).select("run_id", "sequence", "event_type")


@query("script_pages", "select distinct line_id, len(regexp_extract_all(value, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+')) as tokens from field_lines")
def script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values labelled by script, one label a character, and the number of their tokens from those labels."""
    w = once(spark, sf_dir, "field_lines", "line_id").select("line_id", scripts.char_scripts(F.col("value")).alias("s"))
    starts = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (F.get("s", i - 1) != "space") & ((i == 1) | (F.get("s", i - 2) == "space")))
    return w.select("line_id", F.when(F.size("s") > 0, F.size(starts)).otherwise(0).cast("bigint").alias("tokens"))


@query("hinted_runs", "select o_orderkey, o_orderpriority, bool_or(coalesce(o_orderstatus = 'F', false)) over (partition by o_orderpriority) as any_hint from orders")
def hinted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with whether any page of their experiment used the hint."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("hint_used"))
    return labels.hinted(o, "o_orderpriority").select("o_orderkey", "o_orderpriority", "any_hint")


@query("pruned_cache", "select distinct page_id from dictionary_pages where page_id in (select page_id from stage1_projections where text is not null)")
def pruned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages whose task is still there."""
    return incremental.pruned(read_table(spark, sf_dir, "dictionary_pages").select("page_id").distinct(), pages(spark, sf_dir), ["page_id"])


@query("usage_by_type", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as total from events group by 1")
def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("n", F.lit(1).cast("bigint")).withColumnRenamed("event_id", "total")
    return metrics.usage_totals(e, ["event_type"], ["n", "total"])


@query("single_rows", "select page_id, 'single' as column_id, cast(k + 1 as varchar) as line_number, line as text from (select page_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from (select distinct stage1_id, page_id, text from stage1_projections where text is not null))")
def single_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts' lines as rows of one column."""
    return pages(spark, sf_dir).select("page_id", F.inline(exchange.single_rows(F.split("text", "\n"))))


@query("language_configs", "select dictionary, case when len(target_languages) >= 2 then 'inline_trilingual' end as layout, source_language as source, list_transform(target_languages, lambda x: x) as targets, 'left' as column_id from dictionaries")
def language_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations written as YAML and loaded."""
    d = read_table(spark, sf_dir, "dictionaries")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    targets = F.array_join(F.transform("target_languages", lambda x: F.concat(F.lit("  - language: "), quoted(x), F.lit("\n    column_id: left\n"))), "")
    layout = F.when(F.size("target_languages") >= 2, "layout: inline_trilingual\n").otherwise("")
    body = F.concat(layout, F.lit("source: "), quoted(F.col("source_language")), F.lit("\ntargets:\n"), targets)
    c = files.languages_configs(d.select("dictionary", body.alias("value")))
    return c.select("dictionary", "layout", F.col("source.language").alias("source"), F.transform("targets", lambda t: t["language"]).alias("targets"), F.get("targets", F.lit(0))["column_id"].alias("column_id"))


@query("hint_lookup", "with h as (select page_id, min(source_file) as hint from dictionary_pages group by 1) select s.page_id, h.hint from (select distinct page_id from stage1_projections) s left join h on s.page_id = h.page_id and cast(regexp_extract(s.page_id, '(\\d+)$', 1) as int) % 2 = 0")
def hint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the hint file of their stem, where there is one."""
    even = F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") % 2 == 0
    hints = read_table(spark, sf_dir, "dictionary_pages").where(even).groupBy("page_id").agg(F.min("source_file").alias("hint"))
    return read_table(spark, sf_dir, "stage1_projections").select("page_id").distinct().join(hints, "page_id", "left")


@query("sample_pages", "select dictionary, page_id, cast(place as int) as place from (select dictionary, 'page_' || n as stem, place from (select dictionary, unnest([hi, lo]) as n, unnest([0, 1]) as place from (select dictionary, max(page_number) as hi, min(page_number) as lo from dictionary_pages group by 1))) join (select distinct dictionary, page_id from dictionary_pages) using (dictionary) where split_part(page_id, '/', 2) = stem")
def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pages (the last, then the first of each dictionary) in the order of the request."""
    p = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", "page_id", "page_number").distinct()
    asked = p.groupBy("dictionary").agg(F.concat_ws(", ", F.max("page_number"), F.min("page_number")).alias("spec"))
    return exchange.requested(asked.select("dictionary", F.posexplode(exchange.page_stems(F.col("spec"))).alias("place", "stem")), p.select("dictionary", "page_id", F.element_at(F.split("page_id", "/"), -1).alias("stem")), "dictionary").select("dictionary", "page_id", "place")


@query("limited_pages", "select dictionary, page_id from (select dictionary, page_id, row_number() over (partition by dictionary order by page_number, page_id) as k from (select distinct dictionary, page_id, page_number from dictionary_pages)) where k <= 3")
def limited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run limit as a feature: the first three pages of each dictionary."""
    p = read_table(spark, sf_dir, "dictionary_pages").select("dictionary", "page_id", "page_number").distinct()
    return metrics.samples(p, ["dictionary"], [F.col("page_number"), F.col("page_id")], 3).select("dictionary", "page_id")


@query("coerced_entries", "select distinct entry_id, lower(trim(entry_type)) as entry_type, cast(case when homonym_number >= 1 then homonym_number end as int) as homonym_number, coalesce(examples, []) as examples from dictionary_entries")
def coerced_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from JSON objects of strings, in the types of the entry table."""
    e = once(spark, sf_dir, "dictionary_entries", "entry_id")
    loose = F.to_json(F.struct(F.concat(F.lit(" "), F.upper("entry_type")).alias("entry_type"), F.col("homonym_number").cast("string").alias("homonym_number"), "examples"))
    return exchange.coerced(e.select("entry_id", loose.alias("value")), ["entry_id"])


@query("map_sources", SPAN_SQL.replace("select page_id, cast(min(k) as int) as start_at, cast(max(k) + 1 as int) as end_at, language from i group by page_id, island, language", "select page_id, page_id || '/' || split_part(page_id, '/', 2) || '_lang.json' as path, min_by(language, k) filter (where language not in ('space', 'meta')) as source from i group by page_id"))
def map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each page's span map, and its first label that isn't reserved."""
    path = F.concat("page_id", F.lit("/"), F.element_at(F.split("page_id", "/"), -1), F.lit("_lang.json"))
    return maps(spark, sf_dir).select("page_id", path.alias("path"), F.get(F.filter("spans", lambda s: ~s["language"].isin("space", "meta")), F.lit(0))["language"].alias("source"))


@query("tagged_words", "select line_id, cast(k as int) as word_no, w as word, case when k = 0 then ['b'] else [] end as tags from (select line_id, unnest(l) as w, unnest(range(len(l))) as k from (select line_id, list_filter(regexp_split_to_array(value, '" + S + "+'), lambda x: x <> '') as l from (select distinct line_id, value from field_lines)))")
def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of values whose first word is bold, with the tags open at them."""
    v = once(spark, sf_dir, "field_lines", "line_id")
    neat = text.collapse(F.col("value"))
    marked = F.concat(F.lit("</i><b>"), F.substring_index(neat, " ", 1), F.lit("</b>"), F.expr("substr(_n, length(substring_index(_n, ' ', 1)) + 1)"))
    w = v.withColumn("_n", neat).select("line_id", F.posexplode(align.tagged_words(marked)).alias("word_no", "w"))
    return w.select("line_id", "word_no", "w.word", "w.tags")


@query("marker_sheet", "with m as (select lower(regexp_replace(trim(marker), '^\\\\+', '')) as marker from (select case when line_id % 5 = 0 then '\\' || upper(marker) when line_id % 997 = 0 then marker || '!' else marker end as marker from (select distinct line_id, marker from field_lines))) select distinct marker, 'invalid' as issue from m where not regexp_matches(marker, '^[a-z][a-z0-9_-]*$') union all select marker, 'repeated' from m group by marker having count(*) > 1")
def marker_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a sheet of markers: invalid and repeated ones."""
    c = F.col("line_id")
    f = once(spark, sf_dir, "field_lines", "line_id").select(F.when(c % 5 == 0, F.concat(F.lit("\\"), F.upper("marker"))).when(c % 997 == 0, F.concat("marker", F.lit("!"))).otherwise(F.col("marker")).alias("marker"))
    return mdf.cheatsheet_issues(f).distinct()


@query("script_spans")
def script_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values labelled by script, as canonical spans with the labels of annotation."""
    v = once(spark, sf_dir, "field_lines", "line_id").where("length(value) > 0").select("line_id", scripts.char_scripts(F.col("value")).alias("l"))
    s = v.select("line_id", F.explode(spans.spans_of_labels(F.col("l"))).alias("s"))
    return s.select("line_id", "s.start", "s.end", scripts.bucket_label(F.col("s.language")).alias("language"))


@query("artifact_lines", "with t as (select distinct page_id, text from (select distinct stage1_id, page_id, text from stage1_projections where text <> '')), g as (select page_id, cast(k as int) as line_idx, line from (select page_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from t where cast(regexp_extract(page_id, '(\\d+)$', 1) as int) % 2 = 0)), s as (select page_id, cast(row_number() over (partition by page_id order by rank, n) - 1 as int) as line_idx, text as line from " + SECTION_LINES + " where page_id in (select page_id from t where cast(regexp_extract(page_id, '(\\d+)$', 1) as int) % 2 = 1)) select * from g union all select * from s")
def artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two recognisers, plain texts and column tables, each read by its own adapter."""
    even = F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") % 2 == 0
    p = pages(spark, sf_dir).where("text <> ''")
    plain = p.where(even).select(F.col("page_id").alias("page"), F.lit("glm").alias("backend"), F.col("text").alias("value"))
    tables = exchange.table_text(exchange.section_rows(sections(spark, sf_dir), ["page_id"]), ["page_id"]).join(p.where(~even).select("page_id"), "page_id", "left_semi")
    both = plain.unionByName(tables.select(F.col("page_id").alias("page"), F.lit("tsv").alias("backend"), "value"))
    return files.artifact_lines(both).withColumnRenamed("page", "page_id")
