"""Scans of dictionary files: transcripts, lexicon records, recognised layouts, span maps and run metadata.

Text files are read whole, so that the order of lines is a column and never implicit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.text import SPLIT_LINES, strip


def whole_text(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file, value, modified, size of each text file."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


def split_lines(c: Column) -> Column:
    """Lines as a reader of text files gives them: no empty line after a final break, none at all for an empty text."""
    parts = F.split(c, SPLIT_LINES)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def flat_lines(texts: DataFrame, text: str = "value") -> DataFrame:
    """Other columns, line_idx (from 0), line; blank lines are kept."""
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(split_lines(F.col(text))).alias("line_idx", "line"))


def column_tsv(texts: DataFrame, text: str = "value") -> DataFrame:
    """Rows of column TSV texts: row_idx, column_id, line_number, text. A text whose header lacks column_id raises."""
    lines = flat_lines(texts, text)
    keys = [c for c in texts.columns if c != text]
    cells = F.transform(F.split("line", "\t"), lambda x: F.replace(F.regexp_replace(x, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    head = lines.where("line_idx = 0").select(*keys, cells.alias("head"))
    head = head.withColumn("ok", F.when(F.array_contains("head", "column_id"), True).otherwise(F.raise_error(F.lit("no column_id in the header")).cast("boolean"))).where("ok").drop("ok")
    rows = lines.where("line_idx > 0").select(*keys, "line_idx", cells.alias("cells"))
    at = lambda name: F.get("cells", F.array_position("head", name).cast("int") - 1)
    joined = rows.join(head, keys) if keys else rows.crossJoin(F.broadcast(head))
    return joined.select(*keys, (F.col("line_idx") - 1).alias("row_idx"), *[F.when(F.array_contains("head", n), F.coalesce(at(n), F.lit(""))).alias(n) for n in ("column_id", "line_number", "text")])


def page_keys(c: Column) -> list[Column]:
    """language, experiment, page of a prediction path `.../<language>/<stage>/<experiment>/<page>/<file>`."""
    part = lambda k: F.element_at(F.split(c, "/"), k)
    return [part(-5).alias("language"), part(-3).alias("experiment"), part(-2).alias("page")]


BOX = T.ArrayType(T.DoubleType())
MINERU = T.ArrayType(T.StructType([T.StructField("bbox", BOX), T.StructField("type", T.StringType()), T.StructField("content", T.StringType())]))
PADDLE = T.StructType([
    T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("parsing_res_list", T.ArrayType(T.StructType([T.StructField("block_bbox", BOX), T.StructField("block_label", T.StringType()), T.StructField("block_content", T.StringType())]))),
])
MATHPIX = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([
    T.StructField("page_width", T.DoubleType()), T.StructField("page_height", T.DoubleType()),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("cnt", T.ArrayType(BOX)), T.StructField("text", T.StringType()), T.StructField("text_display", T.StringType()), T.StructField("type", T.StringType())]))),
])))])
#: Block types without text.
FIGURES = ("figure", "image", "seal", "chart", "picture", "table_caption_image")


def first_filled(*cols: Column) -> Column:
    """The first column that isn't blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def block(x0: Column, y0: Column, x1: Column, y1: Column, text: Column, category: Column) -> list[Column]:
    return [x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), strip(text).alias("text"), F.coalesce(category, F.lit("text")).alias("category")]


def mineru_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Blocks of a list of {bbox, type, content} with boxes from 0 to 1; figures, short boxes and empty texts are left out."""
    keys = [c for c in texts.columns if c != text]
    b = texts.select(*keys, F.posexplode(F.from_json(text, MINERU)).alias("block_no", "b"))
    b = b.where(F.size("b.bbox") >= 4).where(~F.lower(F.coalesce("b.type", F.lit(""))).isin(*FIGURES))
    return b.select(*keys, "block_no", *block(*[F.get("b.bbox", F.lit(k)) for k in range(4)], F.col("b.content"), F.col("b.type"))).where("text <> ''")


def paddle_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Blocks with pixel boxes, scaled by the page's width and height."""
    keys = [c for c in texts.columns if c != text]
    p = texts.select(*keys, F.from_json(text, PADDLE).alias("p"))
    b = p.select(*keys, F.greatest("p.width", F.lit(1.0)).alias("w"), F.greatest("p.height", F.lit(1.0)).alias("h"), F.posexplode("p.parsing_res_list").alias("block_no", "b"))
    b = b.where(F.size("b.block_bbox") >= 4).where(~F.lower(F.coalesce("b.block_label", F.lit(""))).isin(*FIGURES))
    at = lambda k: F.get("b.block_bbox", F.lit(k)) / F.col("w" if k % 2 == 0 else "h")
    return b.select(*keys, "block_no", *block(at(0), at(1), at(2), at(3), F.col("b.block_content"), F.col("b.block_label"))).where("text <> ''")


def mathpix_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Blocks from the lines' contours: least and greatest x and y, scaled; contours of fewer than two points give (0, 0, 1, 0.01)."""
    keys = [c for c in texts.columns if c != text]
    pages = texts.select(*keys, F.posexplode(F.from_json(text, MATHPIX)["pages"]).alias("page_no", "p"))
    b = pages.select(*keys, "page_no", F.greatest("p.page_width", F.lit(1.0)).alias("w"), F.greatest("p.page_height", F.lit(1.0)).alias("h"), F.posexplode("p.lines").alias("block_no", "b"))
    few = F.coalesce(F.size("b.cnt"), F.lit(0)) < 2
    xs, ys = F.transform("b.cnt", lambda p: F.get(p, F.lit(0))), F.transform("b.cnt", lambda p: F.get(p, F.lit(1)))
    box = [F.when(few, 0.0).otherwise(F.array_min(xs) / F.col("w")), F.when(few, 0.0).otherwise(F.array_min(ys) / F.col("h")), F.when(few, 1.0).otherwise(F.array_max(xs) / F.col("w")), F.when(few, 0.01).otherwise(F.array_max(ys) / F.col("h"))]
    return b.select(*keys, "page_no", "block_no", *block(*box, first_filled(F.col("b.text"), F.col("b.text_display")), F.col("b.type"))).where("text <> ''")


#: Markdown results by preference.
MARKDOWN_NAMES = ("output.md", "{stem}.md", "output.txt", "{stem}.mmd", "output.mmd")


def pick_first(files: DataFrame, group: list[str], priority: Column, order: str) -> DataFrame:
    """The one row of each group with the least priority; nulls are no candidates."""
    ranked = files.withColumn("_p", priority).where("_p is not null")
    return ranked.groupBy(*group).agg(F.min_by(F.struct(*files.columns), F.struct("_p", order)).alias("r")).select("r.*")


def markdown_priority(name: Column, stem: Column) -> Column:
    return F.coalesce(*[F.when(name == F.replace(F.lit(n), F.lit("{stem}"), stem), F.lit(k)) for k, n in enumerate(MARKDOWN_NAMES)])


def backend_of(files: DataFrame, page: str = "page", name: str = "name") -> DataFrame:
    """page, backend: the recogniser whose files a page folder holds, by preference."""
    has = lambda rx: F.bool_or(F.col(name).rlike(rx))
    order = (("markdown", r"(?i)\.(md|mmd)$"), ("mineru", r"content(_list)?\.json$"), ("paddle", r"_res\.json$"), ("mathpix", r"lines\.json$|\.docx$"), ("glm", r"^result\.json$|^output\.txt$"), ("tsv", r"\.tsv$"))
    g = files.groupBy(page).agg(*[has(rx).alias(b) for b, rx in order])
    return g.select(page, F.coalesce(*[F.when(F.col(b), F.lit(b)) for b, _ in order]).alias("backend"))


SPAN_MAP = T.StructType([
    T.StructField("dictionary", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("source_text_sha", T.StringType()), T.StructField("rule_set", T.StringType()), T.StructField("labeled_via", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("role", T.StringType())]))),
])


def span_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPAN_MAP).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_lang.json").json(path)


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.select(*[strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in df.columns])


def generic_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("multiLine", True).csv(path)


def run_flags(texts: DataFrame, text: str = "value") -> DataFrame:
    """alphabet_used, hint_used of run configurations; false where missing or unreadable."""
    keys = [c for c in texts.columns if c != text]
    flag = lambda p: F.coalesce(F.get_json_object(text, p).try_cast("boolean"), F.lit(False))
    return texts.select(*keys, flag("$.alphabet.used").alias("alphabet_used"), flag("$.ocr_hint.used").alias("hint_used"))


def usage_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """file, tokens, cost and seconds of usage files named after their folder; guides and run totals aside."""
    parts = F.split("file", "/")
    own = F.element_at(parts, -1) == F.concat(F.element_at(parts, -2), F.lit("_usage.json"))
    num = lambda p, t: F.get_json_object(text, p).try_cast(t)
    return texts.where(own).dropDuplicates(["file"]).select("file", num("$.prompt_tokens", "bigint").alias("prompt_tokens"), num("$.completion_tokens", "bigint").alias("completion_tokens"), num("$.total_tokens", "bigint").alias("total_tokens"), num("$.cost", "double").alias("cost"), num("$.elapsed_seconds", "double").alias("elapsed_seconds"))


# sinks


def write_flat(lines: DataFrame, path: str, page: str = "page", tail: str = "_stage1_flat.txt") -> None:
    """One text file a page: lines joined in order, a final newline if there are any; overwrites."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), "\n")
    pages = lines.groupBy(page).agg(text.alias("_t"))
    write_pages(pages.select(F.concat(page, F.lit(tail)).alias("name"), F.when(F.col("_t") != "", F.concat("_t", F.lit("\n"))).otherwise("").alias("value")), path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, lines: DataFrame | None = None) -> None:
    """A report as JSON and CSV under one folder, and its text lines if they are given."""
    write_json(rows, f"{path}/json")
    write_csv(rows, f"{path}/csv")
    if lines is not None:
        lines.select("line").write.mode("overwrite").text(f"{path}/text")


def write_records_out(blocks: DataFrame, comparison: DataFrame, path: str) -> None:
    """Record texts of pages (page_id, mdf_text) as one file a page, and the comparison with gold as JSON."""
    write_pages(blocks.select(F.concat("page_id", F.lit(".mdf")).alias("name"), F.concat("mdf_text", F.lit("\n")).alias("value")), f"{path}/records")
    write_json(comparison, f"{path}/comparison")


def write_pages(texts: DataFrame, path: str) -> None:
    """One text file a row (name, value) under a folder that all executors share; a task that is run again writes the same file.

    Through the Hadoop file system where the folder's scheme has one that pyarrow knows, so nothing passes the driver.
    """
    from pyspark import TaskContext

    def write(rows) -> None:  # noqa: ANN001
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        made: set[str] = set()
        tag = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        for r in rows:
            at = f"{base}/{r['name']}"
            folder, _, name = at.rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/.{name}.{tag}") as f:
                f.write((r["value"] or "").encode())
            system.move(f"{folder}/.{name}.{tag}", at)

    texts.select("name", "value").foreachPartition(write)


PROJECTION = T.StructType([T.StructField("fields", T.ArrayType(T.StructType([T.StructField("line_index", T.LongType()), T.StructField("primary_language", T.StringType())])))])


def projection_languages(texts: DataFrame, text: str = "value") -> DataFrame:
    """Other columns, line_index, language of projection JSON texts; lines without a language are dropped."""
    keys = [c for c in texts.columns if c != text]
    f = texts.select(*keys, F.explode(F.from_json(text, PROJECTION)["fields"]).alias("f"))
    return f.select(*keys, F.col("f.line_index").alias("line_index"), F.col("f.primary_language").alias("language")).where("trim(language) <> ''")


W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs of a word-processor file that aren't blank; where it has tables, their cells column by column instead."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{W_NS}t"))
    out: list[str] = []
    for table in body.iter(f"{W_NS}tbl"):
        cells = [["\n".join(map(text, c.iter(f"{W_NS}p"))) for c in r.iter(f"{W_NS}tc")] for r in table.iter(f"{W_NS}tr")]
        out += [x for k in range(max(map(len, cells), default=0)) for r in cells if k < len(r) for x in r[k].split("\n")]
    out = out or [text(p) for p in body.iter(f"{W_NS}p")]
    return [x.strip() for x in out if x.strip()]


def docx_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, line_idx, line of word-processor files; unreadable ones give no lines."""
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(file, k, x) for k, x in enumerate(docx_lines(content))]
                except Exception:  # noqa: BLE001  any broken archive or markup
                    continue
            yield pd.DataFrame(rows, columns=["file", "line_idx", "line"])

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return read.select("path", "content").mapInPandas(run, "file string, line_idx int, line string")


def languages_config(value: str) -> dict:
    """A dictionary's configuration from YAML (or JSON): layout, source {language, column_id}, targets of the same form. What is missing is null, a wrong form raises."""
    import yaml

    got = yaml.safe_load(value) or {}
    one = lambda x: {"language": str(x["language"]), "column_id": x.get("column_id")} if isinstance(x, dict) else {"language": str(x), "column_id": None}
    if not isinstance(got, dict) or "source" not in got:
        raise ValueError("a configuration needs a source language")
    return {"layout": got.get("layout"), "source": one(got["source"]), "targets": [one(t) for t in got.get("targets") or []]}


def languages_configs(texts: DataFrame, text: str = "value") -> DataFrame:
    """Other columns, layout, source, targets of configuration texts (YAML); one row a dictionary."""
    item = T.StructType([T.StructField("language", T.StringType()), T.StructField("column_id", T.StringType())])
    kind = T.StructType([T.StructField("layout", T.StringType()), T.StructField("source", item), T.StructField("targets", T.ArrayType(item))])

    @F.pandas_udf(kind)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([languages_config(x) for x in s], columns=["layout", "source", "targets"])

    keys = [c for c in texts.columns if c != text]
    return texts.select(*keys, parsed(text).alias("c")).select(*keys, "c.*")


def artifact_lines(pages: DataFrame, page: str = "page", backend: str = "backend", text: str = "value") -> DataFrame:
    """page, line_idx, line of recognisers' results, each read by its own adapter: Markdown, the three JSON layouts, plain text and column tables."""
    from lexforge.functions.ocr import markdown_lines
    from lexforge.operators.layout import flatten, transcript

    of = lambda *names: pages.where(F.col(backend).isin(*names)).select(page, text)
    out = markdown_lines(of("markdown"), [page], text).select(page, "line_idx", "line")
    for name, adapter in (("mineru", mineru_blocks), ("paddle", paddle_blocks), ("mathpix", mathpix_blocks)):
        out = out.unionByName(transcript(adapter(of(name), text), [page], "block_no").select(page, "line_idx", "line"))
    out = out.unionByName(flat_lines(of("glm"), text).select(page, "line_idx", "line"))
    return out.unionByName(flatten(column_tsv(of("tsv"), text), [page]).select(page, "line_idx", "line"))
