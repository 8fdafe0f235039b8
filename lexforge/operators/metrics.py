"""Quality figures: counts are summed first, ratios derived from the sums."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.edit import grapheme_distance, graphemes, word_distance, words
from lexforge.operators.align import tagged_words, word_pairs


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")


def pair_counts(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds edits, gold_len, pred_len (graphemes), ned, word_edits, gold_words."""
    g, p = F.col(gold), F.col(pred)
    longest = F.greatest(F.size(graphemes(g)), F.size(graphemes(p)), F.lit(1))
    return pairs.withColumns({"edits": grapheme_distance(g, p).cast("bigint"), "gold_len": F.size(graphemes(g)).cast("bigint"), "pred_len": F.size(graphemes(p)).cast("bigint"), "word_edits": word_distance(g, p).cast("bigint"), "gold_words": F.size(words(g)).cast("bigint")}).withColumn("ned", F.col("edits") / longest)


def text_quality(counted: DataFrame, by: list[str], total: str | None = None) -> DataFrame:
    """by, pairs, edits, gold_len, gcer, text_edit, wer; with `total`, a row for all of them too (its label in the first column of by)."""
    sums = [F.count("*").alias("pairs"), F.sum("edits").alias("edits"), F.sum("gold_len").alias("gold_len"), F.avg("ned").alias("text_edit"), F.sum("word_edits").alias("word_edits"), F.sum("gold_words").alias("gold_words")]
    if total:
        g = counted.groupingSets([by, []], *by).agg(*sums, F.grouping_id().alias("_g"))
        g = g.withColumn(by[0], F.when(F.col("_g") > 0, total).otherwise(F.col(by[0]))).drop("_g")
    else:
        g = counted.groupBy(*by).agg(*sums)
    return g.select(*by, "pairs", "edits", "gold_len", ratio(F.col("edits"), F.col("gold_len")).alias("gcer"), "text_edit", ratio(F.col("word_edits"), F.col("gold_words")).alias("wer"))


def prf(counted: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def tag_confusion(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred", tags: tuple = ("b", "i")) -> DataFrame:
    """by, tag, tp, fp, fn over aligned words of marked-up lines."""
    w = pairs.select(*by, F.explode(word_pairs(tagged_words(gold), tagged_words(pred))).alias("w"))
    has = lambda side, t: F.coalesce(F.array_contains(F.col(f"w.{side}.tags"), t), F.lit(False))
    each = F.array(*[F.struct(F.lit(t).alias("tag"), has("gold", t).alias("g"), has("pred", t).alias("p")) for t in tags])
    x = w.select(*by, F.explode(each).alias("x")).select(*by, "x.*")
    return x.groupBy(*by, "tag").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))


def marker_confusion(matched: DataFrame, by: list[str], gold: Column, pred: Column, same: Column) -> DataFrame:
    """by, gold, pred, n of matched lines whose markers aren't equivalent."""
    return matched.where(~same).groupBy(*by, gold.alias("gold_marker"), pred.alias("pred_marker")).agg(F.count("*").alias("n"))


def baseline_delta(new: DataFrame, base: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, and for each metric its new value and its difference from the baseline (six places); null without a number on both sides."""
    b = base.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return new.join(b, keys, "left").select(*keys, *[x for m in metrics for x in (F.col(m), F.round(number(m) - number(f"_{m}"), 6).alias(f"{m}_delta"))])


def pivot_buckets(rows: DataFrame, keys: list[str], bucket: str, values: list[str], metric: str) -> DataFrame:
    """One column a bucket, of a list of buckets given beforehand."""
    return rows.groupBy(*keys).pivot(bucket, values).agg(F.first(metric))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("edits", T.LongType()), T.StructField("gold", T.LongType())])))
def language_edits(gold: pd.Series, pred: pd.Series, labels: pd.Series) -> pd.Series:
    """Edits by language: a deleted or replaced character counts for its own label, an inserted one for the gold character before it."""

    def one(g: str | None, p: str | None, lab: list | None) -> list[dict]:
        g, p = g or "", p or ""
        lab = list(lab) if lab is not None else []
        lab = (lab + ["other"] * len(g))[: len(g)]
        out: dict[str, list[int]] = {}
        for x in lab:
            out.setdefault(x, [0, 0])[1] += 1
        for op, a, b, c, d in difflib.SequenceMatcher(None, g, p, False).get_opcodes():
            if op == "equal":
                continue
            for k in range(a, b):
                out[lab[k]][0] += 1
            more = (d - c) - (b - a)
            if more > 0:
                at = lab[b - 1] if b else (lab[0] if lab else "other")
                out.setdefault(at, [0, 0])[0] += more
        return [{"language": k, "edits": e, "gold": n} for k, (e, n) in out.items()]

    return pd.Series([one(a, b, c) for a, b, c in zip(gold, pred, labels)])


def per_language(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred", labels: str = "languages", reserved: tuple = ("space", "meta")) -> DataFrame:
    """by, language, edits, gold_len, error: pooled over pairs, reserved labels left out."""
    e = pairs.select(*by, F.explode(language_edits(gold, pred, labels)).alias("e")).select(*by, "e.*").where(~F.col("language").isin(*reserved))
    return e.groupBy(*by, "language").agg(F.sum("edits").alias("edits"), F.sum("gold").alias("gold_len")).withColumn("error", ratio(F.col("edits"), F.greatest(F.col("gold_len"), F.lit(1))))


def usage_totals(usage: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sums that stay null where no row has a value."""
    return usage.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def samples(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, the report's samples."""
    from pyspark.sql import Window as W

    return rows.withColumn("sample_no", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("sample_no") <= most)


WORD_EDITS = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("word_edits", T.LongType()), T.StructField("gold_words", T.LongType())]))


@F.pandas_udf(WORD_EDITS)
def language_word_edits(gold: pd.Series, pred: pd.Series, labels: pd.Series) -> pd.Series:
    """Word edits by language: a changed or dropped word counts for its own label, an added one for the gold word before it (the first one's at the start)."""

    def one(g: str | None, p: str | None, lab: list | None) -> list[dict]:
        a, b = (g or "").split(), (p or "").split()
        lab = (list(lab if lab is not None else []) + ["other"] * len(a))[: len(a)]
        out: dict[str, list[int]] = {}
        for x in lab:
            out.setdefault(x, [0, 0])[1] += 1
        if a != b:
            for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, False).get_opcodes():
                if op == "equal":
                    continue
                for w in range(i, j):
                    out[lab[w]][0] += 1
                if (m - k) > (j - i):
                    at = lab[j - 1] if j else lab[0] if lab else "other"
                    out.setdefault(at, [0, 0])[0] += (m - k) - (j - i)
        return [{"language": x, "word_edits": e, "gold_words": n} for x, (e, n) in out.items()]

    return pd.Series([one(x, y, z) for x, y, z in zip(gold, pred, labels)])


def per_language_words(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred", labels: str = "languages", reserved: tuple = ("space", "meta")) -> DataFrame:
    """by, language, word_edits, gold_words, wer: pooled over pairs whose labels are one a gold word."""
    e = pairs.select(*by, F.explode(language_word_edits(gold, pred, labels)).alias("e")).select(*by, "e.*").where(~F.col("language").isin(*reserved))
    return e.groupBy(*by, "language").agg(F.sum("word_edits").alias("word_edits"), F.sum("gold_words").alias("gold_words")).withColumn("wer", ratio(F.col("word_edits"), F.col("gold_words")))
