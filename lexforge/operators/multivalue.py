"""Problem 5: several values packed in one field.

Delimiters are inferred for each source (dictionary and field): every candidate is scored on how many values it
cuts (support), on how alike the piece counts are (consistency) and on how regular the pieces are (a piece starts
with a letter or digit). A candidate whose consistency x regularity reaches FIT delimits the source's values; values
are cut at these delimiters alone, and of a comma and a stroke at the one of the better score where both would do.
Brackets, quotes, additions ("esp. ...") and strokes in abbreviations and fractions are never cut.

Defined results: null and empty fields, and fields of one value, give no rows; pieces that are empty after
trimming are skipped and not counted; repeated pieces are kept; a row delivered again gives its rows once;
columns other than those named are ignored.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that open an addition to the gloss before them.
ADDITIONS = ("esp.", "especially", "bes.", "besonders", "surtout", "spéc.", "особ.", "особенно", "khususnya", "especialmente", "usu.", "e.g.", "i.e.", "z.B.", "p.ex.", "p.ej.", "т.е.", "mis.")
#: Strokes that join short forms and don't separate values; a source's own are learned besides.
STROKES = frozenset({"qn/qc", "jdm/etw", "jmd/etw", "and/or", "sso/sst", "alg./algo", "кому/чему-либо", "и/или", "et/ou", "und/oder", "y/o", "dan/atau", "sb/sth", "s.o./s.th."})
#: Candidates by strength; a comma or a stroke yields to any other.
CANDIDATES = (";;", "//", ";", "|", "¦", "•", "·", "\t", "\n", "、", " / ", "/", ",")
WEAK = (" / ", "/", ",")
#: Consistency x regularity from which a candidate delimits a source's values.
FIT = 0.25
OPEN, SHUT = "([{«„“‹", ")]}»“”›"
ENUM = re.compile(r"(?:(?<=\s)|^|(?<=[;,.\n]))\(?(?P<n>\d{1,2}|[a-z])(?P<t>[).])\s+(?=\S)")
ADDITION = re.compile(r"\s*(?:" + "|".join(map(re.escape, ADDITIONS)) + r")(?=\s|$)", re.I)
QUOTES = {'"': '"', "«": "»", "„": "“", "“": "”", "‘": "’", "'": "'"}
HELD = re.compile(r"[\"(\[{«„‹]")
TOKEN_LEFT, TOKEN_RIGHT = re.compile(r"\S+$"), re.compile(r"^\S+")


def masked(s: str) -> list[bool]:
    """True for each character inside brackets or quotes; empty if there are none."""
    if not HELD.search(s):
        return []
    out, depth, quote = [], 0, ""
    for i, c in enumerate(s):
        if quote:
            out.append(True)
            if c == quote:
                quote = ""
            continue
        if c == '"' and (i == 0 or not s[i - 1].isalnum()) and '"' in s[i + 1 :]:
            quote = '"'
        elif c in "«„‹" and QUOTES.get(c, "›") in s[i + 1 :]:
            quote = QUOTES.get(c, "›")
        elif c in "([{" and SHUT[OPEN.index(c)] in s[i + 1 :]:
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
            out.append(True)
            continue
        out.append(bool(depth or quote))
    return out


def unquote(s: str) -> str:
    """Trimmed, without quotes that enclose the whole piece; doubled quotes read as one."""
    s = s.strip()
    while len(s) >= 2 and s[0] in QUOTES and s[-1] == QUOTES[s[0]] and s[0] != "'":
        inner = s[1:-1]
        if s[0] == '"':
            if re.search(r'(?<!")(?:"")*"(?!")', inner):
                break
            s = inner.replace('""', '"').strip()
            break
        if s[0] in inner or s[-1] in inner:
            break
        s = inner.strip()
    return s


def is_stroke(s: str, i: int, learned: frozenset) -> bool:
    """The stroke at i joins numbers or short forms."""
    if i == 0 or i + 1 >= len(s) or s[i - 1].isspace() or s[i + 1].isspace():
        return False
    left, right = TOKEN_LEFT.search(s[:i]).group(), TOKEN_RIGHT.search(s[i + 1 :]).group()
    pair = f"{left.lstrip('(').lower()}/{right.rstrip('.,;:)').lower()}"
    return pair in STROKES or pair in learned or (left[-1].isdigit() and right[0].isdigit()) or right.startswith("-") or pair.rstrip(".") in STROKES


def cut(s: str, delim: str, learned: frozenset = frozenset(), mask: list[bool] | None = None) -> list[str]:
    """Pieces between the delimiter's places that are in no bracket or quotation and join no addition, number or abbreviation."""
    at = s.find(delim)
    if at < 0:
        return [s]
    mask = masked(s) if mask is None else mask
    out, start, n = [], 0, len(delim)
    while at >= 0:
        if mask and mask[at]:
            pass
        elif delim == "," and (ADDITION.match(s, at + 1) or (s[at - 1 : at].isdigit() and s[at + 1 : at + 2].isdigit())):
            pass
        elif delim == "/" and (is_stroke(s, at, learned) or s.startswith("//", at)):
            pass
        else:
            out.append(s[start:at])
            start = at + n
            at = s.find(delim, start)
            continue
        at = s.find(delim, at + 1)
    return [*out, s[start:]]


def enumerated(s: str) -> list[str] | None:
    """Pieces of an enumeration 1) 2), (1) (2), 1. 2., a) b), if its marks run on from the first."""
    marks = [m for m in ENUM.finditer(s)]
    if not marks or s[: marks[0].start()].strip():
        return None
    style, want, keep = (marks[0]["n"].isdigit(), marks[0]["t"]), None, []
    for m in marks:
        k = int(m["n"]) if m["n"].isdigit() else ord(m["n"]) - 96
        if (m["n"].isdigit(), m["t"]) == style and (want is None and k == 1 or k == want):
            keep.append(m)
            want = k + 1
    if not keep:
        return None
    ends = [m.start() for m in keep[1:]] + [len(s)]
    return [s[m.end() : e].strip().rstrip(";,").strip() if i < len(keep) - 1 else s[m.end() : e].strip() for i, (m, e) in enumerate(zip(keep, ends))]


def pieces(value: str, scores: dict[str, float] | None = None, learned: frozenset = frozenset()) -> list[str]:
    """The values in a field, in order, cleaned; one piece if the field holds one.

    scores: those of the source's delimiters; no other candidate is cut. None: every candidate delimits, all alike.
    """
    if scores is None:
        scores = dict.fromkeys(CANDIDATES, 1.0)
    s = value.strip()
    if not s:
        return []
    if s[0] == "[" and s[-1] == "]":
        try:
            got = json.loads(s)
            if isinstance(got, list):
                return [x for x in (str(y).strip() for y in got if y is not None) if x]
        except ValueError:
            inner = s[1:-1]
            if not re.fullmatch(r"\[[^\[\]]*\]", s) or not any(d in inner for d in CANDIDATES):
                inner = ""
            if inner:
                return pieces(inner, scores, learned)
    got = enumerated(s)
    if got and len(got) > 1:
        return [x for x in map(unquote, got) if x]
    if got:
        s = got[0]
    # quoted pieces: a field in the manner of CSV
    if s.count('"') >= 2:
        for d in (";", ",", "|", "\t"):
            if d in scores and re.search(f'(?:^|{re.escape(d)})\\s*"', s) and re.search(f'"\\s*(?:$|{re.escape(d)})', s) and d in s:
                try:
                    row = next(csv.reader(io.StringIO(s, newline=""), delimiter=d, skipinitialspace=True, strict=True))
                except (csv.Error, StopIteration):
                    continue
                if len(row) > 1 and all('"' not in x or '""' in s for x in row):
                    out = []
                    for raw, x in zip(quoted_fields(s, d), row):
                        x = x.strip()
                        if raw.lstrip()[:1] != '"' and ADDITION.match(x) and out:
                            out[-1] += f"{d} {x}"
                        elif x:
                            out.append(x)
                    if d == "," and any(x.count(";") for x in quoted_fields(s, d) if not x.strip().startswith('"')):
                        continue
                    return out
    mask = masked(s)
    best = [d for d in CANDIDATES if d not in WEAK and d in scores and d in s and len(cut(s, d, learned, mask)) > 1]
    if ";;" in best and ";" in best:
        best.remove(";")
    out = [s]
    for d in best:
        out = [y for x in out for y in cut(x, d, learned)]
    # a stroke with spaces separates beside other delimiters; a bare stroke or a comma only where nothing else does
    if " / " in scores:
        out = [y for x in out for y in cut(x, " / ", learned)]
    if len(out) == 1:
        weak = [(d, p) for d in ("/", ",") if d in scores and len(p := [x for x in cut(s, d, learned, mask) if x.strip()]) > 1 and regular(p) > 0.5]
        if weak:
            out = max(weak, key=lambda x: (regular(x[1]), scores[x[0]]))[1]
    return [x for x in (unquote(y.strip().strip(";|¦•")) for y in out) if x and any(c.isalnum() for c in x)]


def quoted_fields(s: str, d: str) -> list[str]:
    out, start, q = [], 0, False
    for i, c in enumerate(s):
        if c == '"':
            q = not q
        elif c == d and not q:
            out.append(s[start:i])
            start = i + 1
    return [*out, s[start:]]


def regular(parts: list[str]) -> float:
    """Share of pieces that look like a value: a letter, digit, quote or bracket first, and a letter inside."""
    ok = sum(1 for p in parts if (t := p.strip()) and (t[0].isalnum() or t[0] in "\"«„“(¿¡") and any(c.isalpha() for c in t))
    return ok / max(1, len(parts))


def delimiter_scores(entries: DataFrame) -> DataFrame:
    """source, field_name, delim, values, cut_values, fit, score of every candidate that cuts a value.

    fit: consistency of the piece counts x regularity of the pieces; score: support x fit.

    In built-in expressions, pre-aggregated by source before the shuffle, so a source's share of the rows doesn't matter.
    """
    values = packed_fields(entries)

    def candidate(d: str):  # noqa: ANN202
        parts = F.split("value", re.escape(d))
        good = F.size(F.filter(parts, lambda p: F.trim(p).rlike(r"^[\"«„“(¿¡]?[\p{L}\p{N}]")))
        return F.when(F.instr("value", d) > 0, F.struct(F.lit(d).alias("delim"), (F.size(parts) - 1).alias("cuts"), good.alias("good")))

    each = values.select("source", "field_name", F.explode(F.array_compact(F.array(*map(candidate, CANDIDATES)))).alias("c")).select("source", "field_name", "c.*")
    got = each.groupBy("source", "field_name", "delim").agg(F.count("*").alias("cut_values"), F.avg("cuts").alias("mean_cuts"), F.stddev_pop("cuts").alias("sd"), F.sum("good").alias("good"), F.sum(F.col("cuts") + 1).alias("parts"))
    all_ = values.groupBy("source", "field_name").agg(F.count("*").alias("values")).withColumnsRenamed({"source": "_s", "field_name": "_f"})
    both = got.join(all_, got["source"].eqNullSafe(all_["_s"]) & (got["field_name"] == all_["_f"]))
    fit = F.lit(1.0) / (F.lit(1.0) + F.col("sd") / F.col("mean_cuts")) * F.col("good") / F.col("parts")
    return both.select("source", "field_name", "delim", "values", "cut_values", fit.alias("fit"), (F.col("cut_values") / F.col("values") * fit).alias("score"))


def packed_fields(entries: DataFrame) -> DataFrame:
    """entry_id, source (dictionary), field_name, value: one row a field that isn't null or empty."""
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("gloss", "gloss_secondary")])
    return entries.select("entry_id", F.col("dictionary").alias("source"), F.explode(fields).alias("f")).select("entry_id", "source", "f.*").where("value is not null and trim(value) <> ''")


STROKE = r"([\p{L}.]+/[\p{L}\-.]+)"


def learned_strokes(entries: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """pair: token pairs around a bare stroke that hardly occur apart: abbreviations such as qn/qc. Values between delimiters vary, abbreviations don't.

    Counted over all values; only pairs seen `least` times that make up `share` of either token's strokes are kept.
    """
    pairs = packed_fields(entries).where(F.contains("value", F.lit("/"))).select(F.explode(F.regexp_extract_all("value", F.lit(STROKE), 1)).alias("pair")).groupBy(F.lower("pair").alias("pair")).count()
    pairs = pairs.withColumn("l", F.substring_index("pair", "/", 1)).withColumn("r", F.substring_index("pair", "/", -1))
    left, right = pairs.groupBy("l").agg(F.sum("count").alias("nl")), pairs.groupBy("r").agg(F.sum("count").alias("nr"))
    return pairs.where(F.col("count") >= least).join(left, "l").join(right, "r").where((F.col("count") >= share * F.col("nl")) & (F.col("count") >= share * F.col("nr"))).select("pair")


#: What a field of several values holds, of all forms that pieces() splits (numbers and letters as in ENUM).
MAY_HOLD = r"(?U)[;|¦•·\t\n、/,)\]]|\d\.|(?:^|[\s\x1c-\x1f;,.(])[a-z]\.[\s\x1c-\x1f]"
OUT = pa.schema([("entry_id", pa.int64()), ("field_name", pa.string()), ("value_no", pa.int32()), ("item", pa.string())])


def split_values(entries: DataFrame, bound: int = 200_000) -> DataFrame:
    """entry_id, field_name, value_no (from 1), item for every field of at least two values.

    The scores and the learned abbreviations are sent to the executors where there are at most `bound` of each; where
    there are more, they are joined to the fields they apply to.
    """
    entries = entries.select(F.col("entry_id").cast("bigint"), "dictionary", "gloss", "gloss_secondary").dropDuplicates(["entry_id"])
    # a field without any candidate, mark of enumeration or list bracket holds one value
    packed = packed_fields(entries).where(F.col("value").rlike(MAY_HOLD)).withColumns({"scores": F.lit(None).cast("map<string,double>"), "strokes": F.lit(None).cast("array<string>")})
    scores = delimiter_scores(entries).where(F.col("fit") >= FIT).select("source", "field_name", "delim", "score")
    strokes = learned_strokes(entries)
    rows, pairs = scores.limit(bound + 1).collect(), strokes.limit(bound + 1).collect()
    table: dict[tuple, dict[str, float]] | None = {}
    if len(rows) > bound:
        table = None
        maps = scores.groupBy(F.col("source").alias("_s"), F.col("field_name").alias("_f")).agg(F.map_from_entries(F.collect_list(F.struct("delim", "score"))).alias("m"))  # one entry a candidate
        packed = packed.join(maps, packed["source"].eqNullSafe(maps["_s"]) & (packed["field_name"] == maps["_f"]), "left").withColumn("scores", F.col("m")).drop("_s", "_f", "m")
    else:
        for r in rows:
            table.setdefault((r["source"], r["field_name"]), {})[r["delim"]] = r["score"]
    learned = None
    if len(pairs) > bound:
        held = packed.select("entry_id", "field_name", F.explode(F.regexp_extract_all("value", F.lit(STROKE), 1)).alias("pair")).withColumn("pair", F.lower("pair")).join(strokes, "pair")
        held = held.groupBy("entry_id", "field_name").agg(F.collect_set("pair").alias("held"))
        packed = packed.join(held, ["entry_id", "field_name"], "left").withColumn("strokes", F.coalesce("held", "strokes"))
    else:
        learned = frozenset(r[0].rstrip(".,;:)") for r in pairs)
    shared = entries.sparkSession.sparkContext.broadcast((table, learned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, learned = shared.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, source, field, value, own, held in zip(*(c.to_pylist() for c in b.columns)):
                marks = learned if learned is not None else frozenset(x.rstrip(".,;:)") for x in held or ())
                got = pieces(value, table.get((source, field), {}) if table is not None else dict(own or ()), marks)
                if len(got) > 1:
                    for k, item in enumerate(got, 1):
                        for col, x in zip(out, (i, field, k, item)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, OUT)], schema=OUT)

    return packed.select("entry_id", "source", "field_name", "value", "scores", "strokes").mapInArrow(run, "entry_id bigint, field_name string, value_no int, item string")
