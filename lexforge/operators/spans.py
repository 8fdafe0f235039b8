"""Labelled spans over the code points of a text: islands of labels, canonical form, gaps, checks, projection to characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPAN = "array<struct<start:int,end:int,language:string>>"


def spans_of_labels(labels: Column) -> Column:
    """Runs of equal labels of an array (one label a code point) as spans [start, end), in one pass over the array."""
    n = F.size(labels)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(at, lambda i: (i == 1) | (F.get(labels, i - 1) != F.get(labels, i - 2)))
    ends = F.concat(F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda s: s - 1), F.array(n))
    return F.when(n > 0, F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct((z["s"] - 1).alias("start"), z["e"].alias("end"), F.get(labels, z["s"] - 1).alias("language")))).otherwise(F.array().cast(SPAN))


def islands(points: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """keys, start, end, label: gaps and islands over rows, one shuffle on the keys."""
    by = W.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.lag(label).over(by) != F.col(label)) | (F.lag(order).over(by) != F.col(order) - 1), F.lit(True)).cast("int")
    g = points.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by))
    return g.groupBy(*keys, "_island", label).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_island")


def canonical(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent spans of one language and role merged: keys, start, end, language, role."""
    by = W.partitionBy(*keys).orderBy("start")
    same = (F.lag("end").over(by) == F.col("start")) & (F.lag("language").over(by) == F.col("language")) & F.lag("role").over(by).eqNullSafe(F.col("role"))
    g = spans.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_island", F.sum("_new").over(by))
    return g.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("language").alias("language"), F.first("role").alias("role")).drop("_island")


def filled(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with `space` spans put into the gaps between them; overlapping spans raise."""
    by = W.partitionBy(*keys).orderBy("start")
    before = F.coalesce(F.lag("end").over(by), F.lit(0))
    checked = F.when(before > F.col("start"), F.raise_error(F.lit("overlapping spans")).cast("int")).otherwise(before)
    s = spans.withColumn("_before", checked)
    gaps = s.where(F.col("_before") < F.col("start")).select(*keys, F.col("_before").alias("start"), F.col("start").alias("end"), F.lit("space").alias("language"))
    return s.select(*keys, "start", "end", "language").unionByName(gaps)


def span_faults(maps: DataFrame, text: str = "text", spans: str = "spans", sha: str | None = None) -> DataFrame:
    """Adds `fault` (null for a sound map): empty_span, gap, overlap, short, long, spans_without_text, sha."""
    s, n = F.col(spans), F.length(text)
    pair = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("a"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b"))
    fault = (
        F.when((n == 0) & (F.size(s) > 0), "spans_without_text").when(F.exists(s, lambda x: x["end"] <= x["start"]), "empty_span")
        .when((F.size(s) > 0) & (s[0]["start"] > 0) | F.exists(pair, lambda p: p["a"]["end"] < p["b"]["start"]), "gap").when(F.exists(pair, lambda p: p["a"]["end"] > p["b"]["start"]), "overlap")
        .when((n > 0) & (F.coalesce(F.element_at(s, -1)["end"], F.lit(0)) < n), "short").when(F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)) > n, "long")
    )
    if sha:
        fault = F.coalesce(fault, F.when(F.col(sha) != F.sha2(F.encode(F.col(text), "UTF-8"), 256), "sha"))
    return maps.withColumn("fault", fault)


def char_labels(spans: Column) -> Column:
    """One label a code point."""
    return F.flatten(F.transform(spans, lambda s: F.array_repeat(s["language"], s["end"] - s["start"])))


def majority(labels: Column, source: Column | None = None) -> Column:
    """The commonest label but `space`; a tie goes to the source language, else to the first by name; null if there is none."""
    kept = F.filter(labels, lambda x: x != "space")
    kinds = F.array_distinct(kept)
    best = F.array_sort(F.transform(kinds, lambda k: F.struct((-F.size(F.filter(kept, lambda x: x == k))).alias("n"), (F.lit(0) if source is None else F.when(k == source, 0).otherwise(1)).alias("s"), k.alias("k"))))
    return F.get(best, F.lit(0))["k"]


def word_labels(labelled: DataFrame, keys: list[str], text: str = "text", labels: str = "languages") -> DataFrame:
    """keys, word_no, word, start, language: the majority label of each printed word.

    Words are placed and labelled inside the row; only they leave it.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)(\s+|\S+)"), 1)
    ends = F.aggregate("_p", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    placed = F.filter(F.arrays_zip(F.col("_p").alias("word"), F.slice("_e", 1, F.size("_p")).alias("start")), lambda x: ~x["word"].rlike(r"(?U)^\s"))
    word = lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), majority(F.slice(F.col(labels), x["start"] + 1, F.length(x["word"]))).alias("language"))
    rows = labelled.where(F.length(text) > 0).withColumn("_p", pieces).withColumn("_e", ends)
    return rows.select(*keys, F.posexplode(F.transform(placed, word)).alias("word_no", "_w")).select(*keys, "word_no", "_w.word", "_w.start", "_w.language")


def label_counts(labelled: DataFrame, keys: list[str], text: str = "text", labels: str = "languages") -> DataFrame:
    """keys, language, n: letters and digits under each label; space, meta, white space and punctuation don't count."""
    z = labelled.select(*keys, F.explode(F.arrays_zip(F.split(text, "").alias("c"), F.col(labels).alias("l"))).alias("z")).select(*keys, F.col("z.c").alias("c"), F.col("z.l").alias("language"))
    return z.where("language is not null and language not in ('space', 'meta')").where(~F.col("c").rlike(r"(?U)^[\s\p{P}]$")).groupBy(*keys, "language").agg(F.count("*").alias("n"))


def primary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language: the label with the highest count, the first by name in a tie."""
    return counts.groupBy(*keys).agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))
