"""Reading order: recognised blocks to header, body columns and footer; column tables to flat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions.text import strip

#: Where heads end and feet begin, the least spread of columns, the least gap between two, and how many cuts there may be.
HEAD_BELOW, FOOT_FROM, SPREAD, GAP, CUTS = 0.12, 0.85, 0.12, 0.08, 2
SKIPPED = ("image", "figure", "picture", "chart", "seal", "formula")
HEADS = ("header", "page_header", "page-header", "running_head")
FEET = ("footer", "page_footer", "page-footer", "page_number", "footnote")


def section(category: Column, y0: Column) -> Column:
    """header, body, footer or skip, by category first and height on the page then."""
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(c.isin(*SKIPPED), "skip").when(c.isin(*HEADS), "header").when(c.isin(*FEET), "footer").when(c.isin("text", "list", "paragraph", "table", "title"), "body").when(y0 >= FOOT_FROM, "footer").when(y0 <= HEAD_BELOW, "header").otherwise("body")


def columns(blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """Adds column_no (from 0) to body blocks: cuts at the largest gaps between sorted centres, by windows alone."""
    x = blocks.withColumn("_x", (F.col("x0") + F.col("x1")) / 2)
    by = W.partitionBy(*page).orderBy("_x", key)
    x = x.withColumn("_gap", F.col("_x") - F.lag("_x").over(by)).withColumn("_spread", F.max("_x").over(W.partitionBy(*page)) - F.min("_x").over(W.partitionBy(*page)))
    rank = F.row_number().over(W.partitionBy(*page).orderBy(F.col("_gap").desc_nulls_last(), F.col("_x").desc(), F.col(key).desc()))
    cut = (F.col("_gap") >= GAP) & (rank <= CUTS) & (F.col("_spread") >= SPREAD)
    x = x.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return x.withColumn("column_no", F.sum("_cut").over(by).cast("int")).drop("_x", "_gap", "_spread", "_cut")


def transcript(blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """page, line_idx, section, column_no, line: header and footer by height, body by column and height; empty lines are dropped."""
    b = blocks.withColumn("section", section(F.col("category"), F.col("y0"))).where("section <> 'skip'")
    body = columns(b.where("section = 'body'"), page, key)
    rest = b.where("section <> 'body'").withColumn("column_no", F.lit(0))
    text = F.when(F.col("text").rlike("(?i)</?t[rdh]"), F.regexp_replace(F.regexp_replace("text", "(?i)</tr>", "\n"), "<[^>]+>", " ")).otherwise(F.col("text"))
    rank = F.when(F.col("section") == "header", 0).when(F.col("section") == "body", 1).otherwise(2)
    lines = body.unionByName(rest).select(*page, "section", "column_no", rank.alias("_s"), "y0", "x0", key, F.posexplode(F.split(text, "\n")).alias("_k", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    by = W.partitionBy(*page).orderBy("_s", "column_no", "y0", "x0", key, "_k")
    return lines.withColumn("line_idx", (F.row_number().over(by) - 1).cast("int")).select(*page, "line_idx", "section", "column_no", "line")


#: The rank of a column of a transcript table.
RANKS = {"left": 0, "center": 1, "middle": 1, "right": 2, "single": 3}


def line_number(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(0))


def header_text(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, "<[^>]+>", "")))


def flatten(rows: DataFrame, page: list[str], row_major: bool = False, headings: tuple = ("english.", "circassian.", "turkish.")) -> DataFrame:
    """page, line_idx, line of column tables (column_id, line_number, text, row_idx): header in file order, body by column or by row, footer.

    By row, a column's lines are counted from its heading line, so that lines beside each other share an offset.
    """
    rank = F.when(F.col("column_id") == "header", -1).when(F.col("column_id") == "footer", 1000)
    for name, k in RANKS.items():
        rank = rank.when(F.col("column_id") == name, k)
    r = rows.withColumn("_rank", rank.otherwise(99)).withColumn("_no", line_number(F.col("line_number")))
    if row_major:
        top = F.min(F.when(header_text(F.col("text")).isin(*headings), F.col("_no"))).over(W.partitionBy(*page, "column_id"))
        body = F.col("_rank").between(0, 99)
        order = [F.when(body, F.lit(0)).otherwise(F.col("_rank")), F.when(body, F.col("_no") - F.coalesce(top, F.lit(0))), F.col("_rank"), F.col("_no"), F.col("row_idx")]
    else:
        order = [F.col("_rank"), F.when(F.col("_rank").between(0, 99), F.col("_no")), F.col("row_idx")]
    r = r.select(*page, "text", *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    by = W.partitionBy(*page).orderBy(*[f"_o{k}" for k in range(len(order))])
    return r.withColumn("line_idx", (F.row_number().over(by) - 1).cast("int")).select(*page, "line_idx", F.col("text").alias("line"))


def neighbours(pages: DataFrame, book: list[str], sort_key: Column, columns_: list[str]) -> DataFrame:
    """Adds previous_ and next_ of the named columns, in page order."""
    p = pages.withColumn("_k", sort_key)
    by = W.partitionBy(*book).orderBy("_k")
    return p.select(*pages.columns, *[f.alias(f"{side}_{c}") for c in columns_ for side, f in (("previous", F.lag(c).over(by)), ("next", F.lead(c).over(by)))])


def buckets(rows: DataFrame, page: list[str]) -> DataFrame:
    """page, and one array of lines for each column of a transcript table; center counts as middle."""
    col = F.when(F.col("column_id") == "center", "middle").otherwise(F.col("column_id"))
    g = rows.groupBy(*page, col.alias("column_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda x: x["text"]).alias("lines"))
    return g.groupBy(*page).pivot("column_id", ["header", "single", "left", "middle", "right", "footer"]).agg(F.first("lines"))
