"""Exchange with files and annotation tools: column tables, entry tables, file discovery, configurations, plans and decisions.

Listings, configurations and tasks are DataFrames (a row a file, dictionary or task); nothing walks folders on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions.text import collapse, language_key, nfc, pages_of_spec, strip, strip_tags

#: Columns of a page table in their order, and those whose lines are numbered.
SECTIONS = ("header", "single", "left", "middle", "right", "footer")
NUMBERED = ("single", "left", "middle", "right")
#: Issue types and phrases that tell a page that isn't the one asked for, and requests to read it all again.
LOST_PAGE_TYPES = ("wrong_page", "page_mismatch", "wrong_page_content", "hallucinated_page", "catastrophic_mismatch", "wrong_content")
LOST_PAGE = ("wrong page", "different page", "page mismatch", "entirely different page", "not this page")
WHOLE_PAGE = ("complete pass", "full page", "entire page", "from scratch", "re-transcribe", "retranscribe", "whole page", "fresh transcription")
#: Markers by role.
SOURCE_ROLE = ("lx", "lc", "va", "se", "pl", "ph", "ps")
TARGET_ROLE = ("gn", "ge", "gr", "de", "ue", "un", "xn", "xr", "xe")
NO_ROLE = ("sn", "hm", "np", "nt", "cf", "dc")


def filled_lines(c: Column) -> Column:
    """A text's lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")


def section_rows(pages: DataFrame, keys: list[str], sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """keys, row_idx, column_id, line_number, text of pages with one text column a section: filled lines in section order, numbers in the body only."""

    def rows(s: str) -> Column:
        number = lambda i: (i + 1).cast("string") if s in NUMBERED else F.lit("")
        return F.transform(filled_lines(F.col(s)), lambda x, i: F.struct(F.lit(s).alias("column_id"), number(i).alias("line_number"), x.alias("text")))

    parts = F.array(*map(rows, sections))
    return pages.select(*keys, F.posexplode(F.flatten(parts)).alias("row_idx", "r")).select(*keys, "row_idx", "r.*")


def table_text(rows: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """keys, value: a page's rows as the text of a column table, with its header."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "column_id", "line_number", "text"))), lambda r: F.concat_ws("\t", r["column_id"], r["line_number"], r["text"]))
    return rows.groupBy(*keys).agg(F.concat(F.lit("column_id\tline_number\ttext\n"), F.array_join(line, "\n")).alias("value"))


def single_rows(lines: Column) -> Column:
    """Lines as rows of one column, numbered from 1 as strings."""
    return F.transform(lines, lambda x, i: F.struct(F.lit("single").alias("column_id"), (i + 1).cast("string").alias("line_number"), x.alias("text")))


def joined_list(c: Column) -> Column:
    """Items of a list that aren't empty, joined by ` | `; null gives an empty string."""
    return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), " | ")


def entry_table(entries: DataFrame, keys: list[str], scalars: list[str], lists: list[str]) -> DataFrame:
    """Entries as rows of strings: scalars with nulls as empty strings, lists joined."""
    return entries.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scalars], *[joined_list(F.col(c)).alias(c) for c in lists])


def extra_keys(entries: DataFrame, extra: str, order: str, known: tuple[str, ...] = ()) -> DataFrame:
    """key, place: keys of a map column in the order of their first appearance, those of canonical columns left out."""
    k = entries.select(order, F.posexplode(F.map_keys(extra)).alias("_j", "key")).where((F.col("key") != "") & ~F.initcap(F.translate("key", "_", " ")).isin(*[x.replace("_", " ") for x in known]))
    first = k.groupBy("key").agg(F.min(F.struct(order, "_j")).alias("_o"))
    return first.select("key", F.row_number().over(W.orderBy("_o")).alias("place"))  # one row a column of the table


# files


def page_number(stem: Column) -> Column:
    """All digits of a stem as one number."""
    return F.nullif(F.regexp_replace(stem, r"\D", ""), F.lit("")).try_cast("bigint")


def first_by(files: DataFrame, group: list[str], candidates: list[Column], order: list[str]) -> DataFrame:
    """The file of each group that meets the first of the candidate tests; files that meet none don't count."""
    rank = F.coalesce(*[F.when(test, F.lit(k)) for k, test in enumerate(candidates)])
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    return ranked.groupBy(*group).agg(F.min_by(F.struct(*files.columns), F.struct("_rank", *order)).alias("r")).select("r.*")


def artifact(files: DataFrame, page: str = "page", name: str = "name", size: str = "size") -> DataFrame:
    """The Markdown result of each page by preference, among files that aren't empty."""
    stem = F.element_at(F.split(page, "/"), -1)
    names = [F.col(name) == "output.md", F.col(name) == F.concat(stem, F.lit(".md")), F.col(name) == "output.txt", F.col(name) == F.concat(stem, F.lit(".mmd")), F.col(name) == "output.mmd"]
    return first_by(files.where(F.col(size) > 0), [page], names, [name])


def block_files(files: DataFrame, page: str, folder: str, name: str) -> DataFrame:
    """The block result of each page: in its own folder, else in the first of its child folders."""
    hit = F.col(name).rlike(r"(^|_)content(_list)?\.json$|_res\.json$")
    return first_by(files, [page], [hit & (F.col(folder) == F.col(page)), hit], [folder, name])


def text_page(files: DataFrame, page: str, name: str, value: str) -> DataFrame:
    """page, text: the `text` of result.json, else output.txt; of several the least."""
    f = files.where(F.col(name).isin("result.json", "output.txt"))
    text = F.when(F.col(name) == "result.json", F.get_json_object(value, "$.text")).otherwise(F.col(value))
    return f.withColumn("_t", text).where("_t is not null").groupBy(page).agg(F.min_by("_t", F.struct((F.col(name) != "result.json").cast("int"), "_t")).alias("text"))


def complete(files: DataFrame, page: str, name: str, value: str) -> DataFrame:
    """page, complete: whether a page has a text that isn't blank or a JSON result with blocks."""
    text = F.col(name).rlike(r"\.(md|mmd|txt)$") & (strip(F.col(value)) != "")
    blocks = F.col(name).rlike(r"_res\.json$") & F.coalesce(F.json_array_length(F.get_json_object(value, "$.parsing_res_list")) > 0, F.lit(False))
    return files.groupBy(page).agg(F.bool_or(text | blocks).alias("complete"))


def experiment_faults(expected: DataFrame, files: DataFrame, page: str, size: str, config: str) -> DataFrame:
    """page, fault: expected pages without a file, with an empty one, or made under another configuration than most pages."""
    f = expected.join(files, page, "left")
    usual = files.groupBy(config).agg(F.count("*").alias("_n")).agg(F.max_by(config, F.struct("_n", config)).alias("_usual"))
    fault = F.when(F.col(size).isNull(), "missing").when(F.col(size) == 0, "empty").when(F.col(config) != F.col("_usual"), "other_config")
    return f.crossJoin(F.broadcast(usual)).select(page, fault.alias("fault")).where("fault is not null")  # one row


def move_plan(files: DataFrame, existing: DataFrame, source: str, old: str, new: str) -> DataFrame:
    """source, target of files to be moved between two roots, without those whose target page exists."""
    plan = files.where(F.startswith(F.col(source), F.lit(old))).select(source, F.concat(F.lit(new), F.expr(f"substr({source}, {len(old) + 1})")).alias("target"))
    page = F.regexp_extract("target", r"^(.*)/[^/]+$", 1)
    return plan.withColumn("page", page).join(existing.select("page"), "page", "left_anti").select(source, "target")


def output_names(stem: Column) -> Column:
    """Struct of a page's file names: column table, flat, and their gold forms."""
    name = lambda tail: F.concat(stem, F.lit(tail))
    return F.struct(name("_stage1.tsv").alias("table"), name("_stage1_flat.txt").alias("flat"), name("_stage1_GOLD.tsv").alias("gold_table"), name("_stage1_GOLD_flat.txt").alias("gold_flat"))


def path_language(path: Column, after: str = "samples") -> Column:
    """The component after `after` in a path, null if there is none."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){after}/([^/]+)", 1), F.lit(""))


def resolved(first: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows by preference: of each later source those whose keys no earlier one has, with `origin` (0 for the first)."""
    ranked = reduce(lambda a, b: a.unionByName(b), [df.withColumn("origin", F.lit(k)) for k, df in enumerate([first, *others])])
    cols = [c for c in ranked.columns if c not in keys]
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*cols), "origin").alias("r")).select(*keys, "r.*")


# configurations


def layout_of(name: Column, targets: Column, overrides: dict[str, str] | None = None) -> Column:
    """A dictionary's layout: what is laid down for it, else by the number of its target languages."""
    own = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in (overrides or {}).items()], F.lit(None).cast("string"))
    return F.coalesce(own, F.when(F.size(targets) >= 2, "inline_trilingual").otherwise("inline_bilingual"))


def csv_targets(c: Column) -> Column:
    """Names between commas or strokes, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,/]"), strip), lambda x: x != "")


def configs(dictionaries: DataFrame, metadata: DataFrame | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """dictionary, layout, source, targets, archive: the configuration of each dictionary, with the archive of its metadata row."""
    d = dictionaries.select("dictionary", layout_of(F.col("dictionary"), F.col("target_languages"), overrides).alias("layout"), F.col("source_language").alias("source"), F.col("target_languages").alias("targets"))
    if metadata is None:
        return d.withColumn("archive", F.lit(""))
    m = metadata.groupBy("dictionary").agg(F.min("archive").alias("archive"))
    return d.join(m, "dictionary", "left").withColumn("archive", F.coalesce("archive", F.lit("")))


def page_stems(c: Column) -> Column:
    """Stems of page lists such as `page_50, 1-4`: stems stay, numbers and ranges give page_N."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.when(x.rlike(r"^page_\d+(_p\d+)?$"), F.array(x)).otherwise(F.transform(pages_of_spec(F.when(x.rlike(r"^page_\d+(_p\d+)?$"), "1").otherwise(x)), lambda n: F.concat(F.lit("page_"), n.cast("string"))))))


def marker_languages(dictionaries: DataFrame) -> DataFrame:
    """dictionary, marker, language: markers of source words go with the source language; English takes ge, de, ue and xe, French gr and xr,
    Chinese gn and xn, else Russian gn and un, else Turkish gn; a dictionary's only target language takes every other gloss marker."""
    d = dictionaries.select("dictionary", F.col("source_language").alias("_s"), F.col("target_languages").alias("_t"))
    named = lambda part: F.get(F.filter("_t", lambda x: F.contains(F.lower(x), F.lit(part))), F.lit(0))
    gn = F.coalesce(named("chinese"), named("russian"), named("turkish"), F.when(F.size("_t") > 1, named("hindi")))
    rules = [(m, F.col("_s")) for m in SOURCE_ROLE] + [(m, named("english")) for m in ("ge", "de", "ue", "xe")] + [(m, named("french")) for m in ("gr", "xr")]
    rules += [("gn", gn), ("xn", named("chinese")), ("un", F.when(named("chinese").isNull(), named("russian")))]
    sole = F.when(F.size("_t") == 1, F.get("_t", F.lit(0)))
    rows = F.array(*[F.struct(F.lit(m).alias("marker"), (F.coalesce(x, sole) if m in TARGET_ROLE else x).alias("language")) for m, x in rules])
    return d.select("dictionary", F.explode(rows).alias("r")).select("dictionary", "r.*").where("language is not null")


def role_of(marker: Column, language: Column, source: Column) -> Column:
    """source[:key] or target[:key] of a marker under its dictionary's marker languages; null for markers without a role."""
    key = F.replace(language_key(language), F.lit("_"), F.lit(""))
    role = F.when(marker.isin(*NO_ROLE), F.lit(None).cast("string")).when(marker.isin(*SOURCE_ROLE), "source").when(marker.isin(*TARGET_ROLE), "target").when(language.isNull(), F.lit(None).cast("string")).when(language == source, "source").otherwise("target")
    return F.when(role.isNotNull(), F.concat_ws(":", role, key))


def scripts_attached(lines: DataFrame, labels: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """Lines with the language of their gold line (keys: page and line): null and meta languages, and pairs with nothing to score, are left out."""
    both = lines.join(labels.where("language is not null and language <> '' and language <> 'meta'"), keys)
    return both.where((F.col(gold) != "") | (F.col(pred) != ""))


# annotation


def latest_texts(tasks: DataFrame, key: str, prefill: bool = True) -> DataFrame:
    """key, column_id, text, origin (annotation, prefill): a task's texts by column: of its newest annotation, else those it was given.

    tasks: key, annotations array<struct<stamp, columns map>>, data map.
    """
    newest = F.get(F.array_sort("annotations", lambda a, b: F.when(a["stamp"] > b["stamp"], -1).when(a["stamp"] < b["stamp"], 1).otherwise(0)), F.lit(0))["columns"]
    has = lambda m: F.coalesce(F.exists(F.map_values(m), lambda x: strip(x) != ""), F.lit(False))
    t = tasks.select(key, newest.alias("a"), F.col("data").alias("d"))
    chosen = F.when(has(F.col("a")), F.struct(F.lit("annotation").alias("origin"), F.col("a").alias("m")))
    if prefill:
        chosen = F.coalesce(chosen, F.when(has(F.col("d")), F.struct(F.lit("prefill").alias("origin"), F.col("d").alias("m"))))
    return t.select(key, chosen.alias("c")).where("c is not null").select(key, "c.origin", F.explode("c.m").alias("column_id", "text"))


def submitted(annotations: Column) -> Column:
    """Whether any annotation is there."""
    return F.coalesce(F.exists(annotations, lambda a: a.isNotNull()), F.lit(False))


def layout_votes(rows: DataFrame, group: str, page: str, column: str = "column_id") -> DataFrame:
    """group, layout: each page votes by its columns (middle: three_col, left or right: two_col, single); the most votes win, the first page's in a tie."""
    has = lambda *c: F.bool_or(F.col(column).isin(*c))
    v = rows.groupBy(group, page).agg(F.when(has("middle", "center"), "three_col").when(has("left", "right"), "two_col").when(has("single"), "single").alias("vote")).where("vote is not null")
    n = v.groupBy(group, "vote").agg(F.count("*").alias("n"), F.min(page).alias("first"))
    return n.groupBy(group).agg(F.min_by("vote", F.struct(-F.col("n"), F.col("first"))).alias("layout"))


def legend(c: Column) -> Column:
    """Map of codes to languages of a model's legend: lines `code = Name` before the tagged text."""
    block = F.regexp_replace(F.regexp_replace(c, r"(?s)(?im)^[ \t]*TAGGED:.*$", ""), r"(?im)^[ \t]*LANGUAGES:[ \t]*\r?\n?", "")
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*[a-z][\w-]{1,15}\s*=\s*\S"))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?i)^\s*([a-z][\w-]{1,15})\s*=", 1)).alias("k"), strip(F.regexp_extract(x, r"=\s*(.+?)\s*$", 1)).alias("v"))
    return F.map_from_entries(F.transform(lines, pair))


def overridden(codes: Column, overrides: Column) -> Column:
    """A legend with overrides (codes in small letters) put over it."""
    keep = F.map_filter(codes, lambda k, _: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(keep, overrides)


def islands_of(flags: DataFrame, keys: list[str], order: str, flag: str, token: str) -> DataFrame:
    """keys, run_no, text: consecutive flagged tokens joined by a space."""
    by = W.partitionBy(*keys).orderBy(order)
    f = flags.withColumn("_new", (F.col(flag) & ~F.coalesce(F.lag(flag).over(by), F.lit(False))).cast("int")).withColumn("run_no", F.sum("_new").over(by)).where(flag)
    return f.groupBy(*keys, "run_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token]), " ").alias("text"))


# decisions


def concrete(issues: Column) -> Column:
    """Whether an issue names what to change: evidence with a fix, a current text with what is expected, or a line with either."""
    full = lambda x: strip(F.coalesce(x, F.lit(""))) != ""

    def one(i: Column) -> Column:
        span = full(i["current_text"]) & i["expected_text"].isNotNull()
        return full(i["evidence"]) & full(i["suggested_fix"]) | span | i["line_index"].isNotNull() & (full(i["evidence"]) | span)

    return F.coalesce(F.exists(issues, one), F.lit(False))


def lost_page(issues: Column) -> Column:
    """Whether an issue tells that the text is another page's."""
    says = lambda x: F.exists(F.array(*map(F.lit, LOST_PAGE)), lambda p: F.contains(F.lower(F.coalesce(x, F.lit(""))), p))
    return F.coalesce(F.exists(issues, lambda i: F.lower(i["type"]).isin(*LOST_PAGE_TYPES) | says(i["evidence"])), F.lit(False))


def whole_page(decision: Column, instruction: Column, issues: Column) -> Column:
    """Whether a retry asks for the page to be read anew: it says so, or most of its issues name no text."""
    says = F.exists(F.array(*map(F.lit, WHOLE_PAGE)), lambda p: F.contains(F.lower(F.coalesce(instruction, F.lit(""))), p))
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    vague = F.size(F.filter(issues, lambda i: blank(i["current_text"]) & blank(i["expected_text"])))
    most = F.greatest(F.lit(2), F.floor(F.size(issues) / 2).cast("int") + 1)
    return (decision == "retry") & (says | (F.size(issues) > 0) & (vague >= most))


def settled(decision: Column, instruction: Column, issues: Column) -> Column:
    """A verdict with refusals of a lost page, and vague requests for the whole page, turned into `recover`."""
    lost = lost_page(issues)
    again = lost | ~concrete(issues) & whole_page(decision, instruction, issues)
    return F.when((decision == "reject") & lost, "recover").when((decision == "retry") & again, "recover").otherwise(decision)


def edge_text(c: Column) -> Column:
    """A text for telling whether it changed: lines without white space at their ends, and the whole trimmed."""
    return strip(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))


def display_text(c: Column) -> Column:
    """A text as shown beside a repair: composed, without tags, white space collapsed, case kept."""
    return collapse(nfc(strip_tags(c)))


def lexical_bounds(text: Column, start: Column, end: Column) -> Column:
    """Struct (start, end) of a span grown over the letters and digits on both sides."""
    left = F.length(F.regexp_extract(F.left(text, start), r"([\p{L}\p{N}\p{M}]*)$", 1))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([\p{L}\p{N}\p{M}]*)", 1))
    return F.struct((start - left).cast("int").alias("start"), (end + right).cast("int").alias("end"))


def kept_with_labels(text: Column, labels: Column) -> Column:
    """Struct (text, labels) of a text without white space and punctuation, labels kept in step."""
    z = F.filter(F.arrays_zip(F.split(text, "").alias("c"), labels.alias("l")), lambda x: ~x["c"].rlike(r"(?U)^[\s\p{P}]$"))
    return F.struct(F.array_join(F.transform(z, lambda x: x["c"]), "").alias("text"), F.transform(z, lambda x: x["l"]).alias("labels"))


def block_lines(c: Column) -> Column:
    """A block's lines: rows of an HTML table on lines of their own, tags dropped, trimmed, empty ones left out."""
    table = F.regexp_replace(F.regexp_replace(c, r"(?i)</tr\s*>", "\n"), "<[^>]+>", " ")
    return filled_lines(F.when(c.rlike(r"(?i)<table\b"), table).otherwise(c))


def table_columns(cells: DataFrame, keys: list[str], row: str = "row_no", column: str = "column_no", text: str = "text") -> DataFrame:
    """keys, line_idx, line: a table's cells column by column, each from top to bottom; lines inside a cell apart, empty ones left out."""
    x = cells.select(*keys, column, row, F.posexplode(filled_lines(F.col(text))).alias("_j", "line"))
    return x.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy(column, row, "_j")) - 1).cast("int").alias("line_idx"), "line")


def flat_entries(entries: DataFrame, page: list[str], order: str) -> DataFrame:
    """page, line_idx, line: entries as lines of a printed page: subentries after a dash, part of speech with a full stop, then the gloss."""
    e = entries.where("coalesce(headword, '') <> '' or coalesce(gloss, '') <> ''")
    full = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    head = F.when(F.lower("entry_type") == "subentry", F.concat(F.lit("—"), F.coalesce(full("headword"), full("parent_lexeme"), F.lit("")))).otherwise(full("headword"))
    line = strip(F.concat_ws(" ", F.nullif(head, F.lit("—")), F.concat(full("pos"), F.lit(".")), full("gloss")))
    return e.select(*page, (F.row_number().over(W.partitionBy(*page).orderBy(order)) - 1).cast("int").alias("line_idx"), line.alias("line"))


def heads_of_flat(lines: Column) -> Column:
    """Headwords of flat lines: each line's first word without its dash, in small letters."""
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.lower(F.regexp_extract(strip(x), r"^—?(\S+)", 1))), lambda x: x != ""))


def requested(asked: DataFrame, pages: DataFrame, group: str, stem: str = "stem") -> DataFrame:
    """pages of requested stems with the place of the request; a stem that isn't there raises."""
    got = asked.join(pages.withColumn("_there", F.lit(True)), [group, stem], "left")
    ok = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no such page: "), F.col(stem))).cast("boolean"))
    return got.where(ok).drop("_there")


def coerced(texts: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """keys, entry_type, homonym_number, examples of entries given as JSON objects of strings; wrong numbers are null, missing lists empty."""
    e = texts.select(*keys, F.from_json(text, "entry_type string, homonym_number string, examples array<string>").alias("e"))
    n = F.col("e.homonym_number").try_cast("int")
    return e.select(*keys, F.lower(strip(F.col("e.entry_type"))).alias("entry_type"), F.when(n >= 1, n).alias("homonym_number"), F.coalesce("e.examples", F.array().cast("array<string>")).alias("examples"))
