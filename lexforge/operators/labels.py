"""Labels carried between versions of a text, recovered from tagged model output, and exchanged with annotation tasks."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.spans import spans_of_labels

#: Share of characters in which tagged output may differ from the text it labels.
DRIFT = 0.02
#: Markup that is content of a text and no language tag.
MARKUP = frozenset({"b", "i", "N", "u", "sup", "sub"})


def carried(old: str, new: str, labels: list[str]) -> tuple[list[str], float]:
    """(labels of `new` by the edit script from `old`, share of characters that differ). Replaced characters keep their place's label, inserted ones take the one before, deleted ones fall away."""
    out: list[str] = []
    changed = 0
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, False).get_opcodes():
        if op == "equal":
            out += labels[a:b]
            continue
        changed += max(b - a, d - c)
        have = labels[a:b]
        last = out[-1] if out else (labels[a] if a < len(labels) else "space")
        out += [have[k] if k < len(have) else (have[-1] if have else last) for k in range(d - c)]
    return out, changed / max(1, len(old))


def parse_tagged(tagged: str, languages: list[str]) -> tuple[str, list[str]]:
    """(text, one label a code point) of output with <Language>...</Language> tags, which may nest; markup tags are content."""
    known = {x: x for x in languages}
    text, labels, stack = [], [], []
    for part in re.split(r"(</?[A-Za-z][\w-]*>)", tagged):
        m = re.fullmatch(r"<(/?)([A-Za-z][\w-]*)>", part)
        if m and m[2] in known and m[2] not in MARKUP:
            if not m[1]:
                stack.append(m[2])
            elif m[2] in stack:
                while stack and stack.pop() != m[2]:
                    pass
            continue
        text.append(part)
        labels += [stack[-1] if stack else "other"] * len(part)
    return "".join(text), labels


RECOVERED = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("status", T.StringType()), T.StructField("drift", T.DoubleType())])


def recovered(text: Column, tagged: Column, languages: Column) -> Column:
    """Struct (labels, status, drift): exact, projected, or rejected beyond DRIFT (no labels then); white space is always `space`."""

    @F.pandas_udf(RECOVERED)
    def run(texts: pd.Series, outs: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, o, ls in zip(texts, outs, langs):
            t = t or ""
            got, labels = parse_tagged(o or "", list(ls) if ls is not None else [])
            drift, status = 0.0, "exact"
            if got != t:
                labels, drift = carried(got, t, labels)
                status = "projected" if drift <= DRIFT else "rejected"
            rows.append((None if status == "rejected" else ["space" if c.isspace() else x for c, x in zip(t, labels)], status, drift))
        return pd.DataFrame(rows, columns=["labels", "status", "drift"])

    return run(text, tagged, languages)


def projected(old: Column, new: Column, labels: Column) -> Column:
    """Labels of `old` carried to `new`."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(a: pd.Series, b: pd.Series, ls: pd.Series) -> pd.Series:
        return pd.Series([carried(x or "", y or "", list(z) if z is not None else [])[0] for x, y, z in zip(a, b, ls)])

    return run(old, new, labels)


REGION = "struct<type:string,value:struct<start:int,end:int,text:string,labels:array<string>>>"
TASK = f"struct<data:struct<text:string>,predictions:array<struct<result:array<{REGION}>>>,annotations:array<struct<result:array<{REGION}>,updated_at:string>>>"


def task_of(text: Column, spans: Column) -> Column:
    """JSON of an annotation task with the spans as predictions; `space` spans are left out."""
    regions = F.transform(F.filter(spans, lambda s: s["language"] != "space"), lambda s: F.struct(F.lit("labels").alias("type"), F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), F.array(s["language"]).alias("labels")).alias("value")))
    return F.to_json(F.struct(F.struct(text.alias("text")).alias("data"), F.array(F.struct(regions.alias("result"))).alias("predictions")))


def spans_of_task(tasks: DataFrame, task: str, keys: list[str]) -> DataFrame:
    """keys, text, labels, fault: a task's spans as one label a code point; annotations go before predictions.

    A region whose text isn't that slice of the task's text, white space at its ends aside, is a fault.
    """
    t = tasks.select(*keys, F.from_json(task, TASK).alias("t"))
    latest = F.array_sort("t.annotations", lambda a, b: F.when(a["updated_at"] > b["updated_at"], -1).when(a["updated_at"] < b["updated_at"], 1).otherwise(0))
    result = F.coalesce(F.get(latest, F.lit(0))["result"], F.get("t.predictions", F.lit(0))["result"])
    regions = F.filter(F.coalesce(result, F.array().cast(f"array<{REGION}>")), lambda r: r["type"] == "labels")
    x = t.select(*keys, F.col("t.data.text").alias("text"), regions.alias("regions"))
    bad = F.exists("regions", lambda r: F.trim(F.substring(F.col("text"), r["value"]["start"] + 1, r["value"]["end"] - r["value"]["start"])) != F.trim(r["value"]["text"]))
    # labels run by run: each region fills what is open from its start to its end, `space` fills the gaps
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("labels"))

    def fill(acc: Column, r: Column) -> Column:
        v = r["value"]
        start, end = F.greatest(v["start"], acc["at"]), F.least(v["end"], F.length("text"))
        gap, name = F.array_repeat(F.lit("space"), F.greatest(start - acc["at"], F.lit(0))), F.coalesce(F.get(v["labels"], F.lit(0)), F.lit("space"))
        return F.when(end > start, F.struct(end.alias("at"), F.concat(acc["labels"], gap, F.array_repeat(name, end - start)).alias("labels"))).otherwise(acc)

    in_order = F.array_sort("regions", lambda p, q: F.when(p["value"]["start"] < q["value"]["start"], -1).when(p["value"]["start"] > q["value"]["start"], 1).otherwise(0))
    label = F.aggregate(in_order, zero, fill, lambda a: F.concat(a["labels"], F.array_repeat(F.lit("space"), F.length("text") - a["at"])))
    return x.select(*keys, "text", F.when(F.length("text") > 0, label).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(bad, "tampered").alias("fault"))


def round_trip(maps: DataFrame, keys: list[str], text: str = "text", labels: str = "languages") -> DataFrame:
    """keys, same: whether labels come back from a task as they went in."""
    tasks = maps.select(*keys, F.col(labels).alias("_l"), task_of(F.col(text), spans_of_labels(F.col(labels))).alias("_task"))
    back = spans_of_task(tasks, "_task", keys)
    return tasks.select(*keys, "_l").join(back, keys).select(*keys, (F.col("labels") == F.col("_l")).alias("same"), "fault")


def match_metadata(configs: DataFrame, metadata: DataFrame) -> DataFrame:
    """configs (folder, source, targets) with the first metadata row (row_no, source, targets) whose target set is the same and whose source is equal, or contained either way.

    The target set is an equi-join key, so only rows of equal targets meet.
    """
    key = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.lower(F.trim(x)))), "|")
    c = configs.withColumn("_t", key(F.col("targets"))).withColumn("_s", F.lower(F.trim("source")))
    m = metadata.select("row_no", F.lower(F.trim("source")).alias("_m"), key(F.col("targets")).alias("_t"), F.struct("*").alias("_row"))
    both = c.join(m, "_t").where((F.col("_s") == F.col("_m")) | F.col("_s").contains(F.col("_m")) | F.col("_m").contains(F.col("_s")))
    best = both.groupBy("folder").agg(F.min_by("_row", F.struct((F.col("_s") != F.col("_m")).cast("int"), "row_no")).alias("metadata"))
    return configs.join(best, "folder", "left")


def folder_name(name: Column, targets: list[str]) -> Column:
    """Struct (source, targets) of `Source-Target-Target`: known target names are peeled from the right, the longest first."""
    names = "|".join(re.escape(t) for t in sorted(targets, key=len, reverse=True))
    tail = F.regexp_extract(name, rf"((?:-(?:{names}))+)$", 1)
    return F.struct(F.left(name, F.length(name) - F.length(tail)).alias("source"), F.when(tail == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(tail, F.lit(f"-({names})"), 1)).alias("targets"))


def hinted(results: DataFrame, experiment: str = "experiment", flag: str = "hint_used") -> DataFrame:
    """Adds any_hint: whether any of an experiment's pages used the hint."""
    any_ = results.groupBy(experiment).agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias("any_hint"))
    return results.join(any_, experiment)


CARRIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))])


def casefold_carrying(text: Column, labels: Column) -> Column:
    """Struct (text, labels) of a text with its letters folded; a letter that folds to several passes its label to each."""

    @F.pandas_udf(CARRIED)
    def run(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ls in zip(texts, marks):
            parts = [c.casefold() if c.isalpha() else c for c in t or ""]
            ls = list(ls) if ls is not None else []
            rows.append(("".join(parts), [x for p, x in zip(parts, ls) for _ in p]))
        return pd.DataFrame(rows, columns=["text", "labels"])

    return run(text, labels)


def normal_carrying(text: Column, labels: Column) -> Column:
    """Struct (text, labels) in small letters, commas as semicolons, white space collapsed and trimmed, each kept character with its label.

    In built-in expressions: characters and labels are filtered side by side; of a run of white space the first stays.
    """
    chars = F.split(F.translate(F.lower(text), ",", ";"), "")
    pairs = F.transform(F.arrays_zip(chars.alias("c"), labels.alias("l")), lambda z: F.struct(F.when(z["c"].rlike(r"(?U)^\s$"), " ").otherwise(z["c"]).alias("c"), z["l"].alias("l")))
    kept = F.filter(pairs, lambda z, i: (z["c"] != " ") | (i > 0) & (F.get(pairs, i - 1)["c"] != " "))
    kept = F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["c"] == " "), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    return F.struct(F.array_join(F.transform(kept, lambda z: z["c"]), "").alias("text"), F.transform(kept, lambda z: z["l"]).alias("labels"))


def grapheme_labels(graphemes: Column, labels: Column) -> Column:
    """The label of each grapheme's first code point."""
    ends = F.aggregate(graphemes, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + F.length(g))))
    return F.transform(F.slice(ends, 1, F.size(graphemes)), lambda i: F.get(labels, i))
