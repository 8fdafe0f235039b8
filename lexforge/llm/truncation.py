"""Problem 2: texts that were cut off before their end.

Self-join by prefix: every text is reduced to the skeleton of its letters (no running heads, page numbers, white
space; records in their printed order), and windows of PREFIX letters are hashed: the first one, and of the others
those whose hash ends in SAMPLED_BITS zeros, so that two readings of a page pick the same windows though misread
letters and line breaks differ. Texts of any table and page that share one of their first KEYS windows are a pair.
From the last window they share on, the shorter text is a strict prefix of the longer one if the latter goes on by
BEYOND letters or more: the shorter one was cut. No text is moved: pairs carry hashes and places only.

A window that more than HOT texts start with tells little; such texts meet by it together with each of the last TAIL
windows of the shorter text, one of which every copy that goes on must hold. No partner is dropped; texts that share their start and
their end as well are all compared, so a group of N of these gives N x N pairs.

Texts without a longer copy are judged by their own end, which is reported as such (`cause` of `cut_texts`): marks
of a cut, an unfinished date, sentence or record, a last line that never ends a record of its dictionary.

Defined results: null and empty texts are no cases; a row delivered again gives one result; a text without any
copy is judged by its own end; other columns are ignored; a null page meets copies by its windows alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.scan import MULTI, SINGLE, is_head, page_no, titles_of
from lexforge.llm.spelling import ODD, plain
from lexforge.session import checkpoint_dir

#: Letters of a window.
PREFIX = 48
#: One window in 2 ** SAMPLED_BITS is kept, by its hash.
SAMPLED_BITS = 6
#: Windows from the start of a text under which it is met.
KEYS = 6
#: Windows from the end of a text that are sought in a longer copy.
TAIL = 8
#: Letters by which a copy must go on; fewer may be noise at the end, for records homonym numbers and dates that are printed besides.
BEYOND, BEYOND_RECORDS = 3, 6
#: Letters by which the places of shared windows may drift apart (misread letters, a head that wasn't told).
DRIFT = 12
#: Texts that start with a window beyond which it is joined together with the page.
HOT = 64
MARKS = re.compile(r"(?:\[\s*\.\.\.\s*\]|\[…\]|\.\.\.|…|�+)\s*$")
FINAL = re.compile(r"[.!?…][\"»“”’)\]]*$")
DATE = re.compile(r"\d{1,2}/\w{3,}/\d{4}$")
LINE = re.compile(r"^\\(\w+)(?:[ \t]+(.*))?$")
UNPRINTED = frozenset({"ph", "hm", "dt"})
SENTENCES = frozenset({"xv", "xn", "xe", "xr", "nt"})


#: Code points below this are looked up; beyond it each is a letter of its own.
TABLE = 0x30000


@lru_cache(maxsize=1)
def tables_of_letters() -> tuple[np.ndarray, np.ndarray]:
    """(whether a code point is a letter, the prototype of a code point)."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(TABLE)), bool, TABLE)
    proto = np.arange(TABLE, dtype=np.uint32)
    for c, to in SINGLE.items():
        proto[c] = ord(to)
    return alpha, proto


def letters(s: str) -> np.ndarray:
    """The skeleton of the letters of a text, as code points."""
    if not s.isascii() and (ODD.search(s) or not unicodedata.is_normalized("NFC", s)):
        s = plain(s)[0]
    alpha, proto = tables_of_letters()
    codes = np.frombuffer(s.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = codes[alpha[np.minimum(codes, TABLE - 1)] | (codes >= TABLE)]
    s = codes.tobytes().decode("utf-32-le")
    for x, y in MULTI:
        s = s.replace(x, y)
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return np.where(codes < TABLE, proto[np.minimum(codes, TABLE - 1)], codes)


def body(text: str, title: str) -> np.ndarray:
    keep = []
    for x in text.split("\n"):
        if 0 < len(x) < 120 and x[-1] not in ".;," and is_head(x, title) or len(x) < 24 and page_no(x, None, True):
            continue
        keep.append(x)
    return letters(" ".join(keep))


def printed(mdf: str) -> np.ndarray:
    """The letters of the records' values in the order in which they are printed: references come last in a record."""
    out: list[str] = []
    refs: list[str] = []
    for x in MARKS.sub("", mdf).split("\n"):
        m, _, v = x[1:].replace("\t", " ").partition(" ") if x[:1] == "\\" else ("", "", "")
        if not m or m == "lx":
            out += refs
            refs = []
        if v and m not in UNPRINTED:
            (refs if m == "cf" else out).append(v)
    return letters(" ".join(out + refs))


MIX, SPIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
POWERS = [np.uint64(pow(0x100000001B3, 1 << k, 1 << 64)) for k in range(5)]


def windows(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's kept windows in order: the first one and those whose hash ends in zeros."""
    if len(s) < PREFIX:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = (s.astype(np.uint64) + SPIN) * MIX
    h ^= h >> np.uint64(29)
    for k in range(4):  # windows of 2, 4, 8, 16 letters from halves, of 48 from three of these
        n = 1 << k
        h = h[:-n] * POWERS[k] + h[n:]
    h = (h[:-32] * POWERS[4] + h[16:-16]) * POWERS[4] + h[32:]
    h ^= h >> np.uint64(32)
    h *= SPIN
    h ^= h >> np.uint64(29)
    kept = (h & np.uint64((1 << SAMPLED_BITS) - 1)) == 0
    kept[0] = True
    at = np.flatnonzero(kept)
    return h[at].view(np.int64), at.astype(np.int32)


def shared_end(n: int, hashes: list[int], places: list[int], copy_n: int, copy_hashes: list[int], copy_places: list[int]) -> tuple[int, int] | None:
    """(windows after the last one that both share, letters by which a copy goes on after a text's end, from that window); None if they don't share their ends.

    hashes, places: the last windows of the text. A window counts if it stands about as far from the start in both;
    half of them must, as sentences of one build share some windows.
    """
    where: dict[int, list[int]] = {}
    for h, p in zip(copy_hashes, copy_places):
        where.setdefault(h, []).append(p)
    rest, first, met, after = None, 0, 0, 0
    for k, (h, p) in enumerate(zip(reversed(hashes), reversed(places))):
        got = where.get(h)
        if got is None:
            continue
        q = min(got, key=lambda x: abs(x - p - first))
        if rest is None:
            if abs(q - p) > 60 + n // 8:
                continue
            rest, first, after = (copy_n - q) - (n - p), q - p, k
            met = 1
        elif abs(q - p - first) <= DRIFT:
            met += 1
    return (after, rest) if rest is not None and met >= min(2, len(hashes)) and 2 * met >= len(hashes) else None


def goes_on(*sides) -> int | None:  # noqa: ANN002
    """How many letters a copy goes on after a text's end (arguments of shared_end); None if they don't share their ends."""
    got = shared_end(*sides)
    return got and got[1]


def own_end(text: str) -> tuple[bool, bool]:
    """(cut by its own mark or end, sure) of a page text, without copies."""
    t = text.rstrip()
    if MARKS.search(t):
        return True, True
    last = t.rsplit("\n", 1)[-1]
    return not FINAL.search(last) and not (len(last) < 24 and page_no(last, None, True)), False


def parts_of(mdf: str) -> tuple[str, str, list[str]]:
    """(marker of the last line, its value, markers of the last record)."""
    lines = mdf.rstrip().split("\n")
    rec: list[str] = []
    for x in reversed(lines):
        if not x.strip():
            break
        if m := LINE.match(x):
            rec.append(m[1])
    m = LINE.match(lines[-1])
    return (m[1], (m[2] or "").strip(), rec) if m else ("", lines[-1], rec)


HABIT = pa.list_(pa.struct([("marker", pa.string()), ("n", pa.int32()), ("ends", pa.int32())]))
VALUE = pa.schema([("kind", pa.int32()), ("row_id", pa.int64()), ("page_id", pa.string()), ("dictionary", pa.string()), ("source_file", pa.string()), ("n", pa.int32()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("marker", pa.string()), ("last_value", pa.string()), ("cut_by_end", pa.bool_()), ("sure", pa.bool_()), ("habit", HABIT)])
VALUE_SQL = "kind int, row_id bigint, page_id string, dictionary string, source_file string, n int, hashes array<bigint>, places array<int>, marker string, last_value string, cut_by_end boolean, sure boolean, habit array<struct<marker:string,n:int,ends:int>>"
PIECES = re.compile(r"[;,|/]")
#: Markers whose values stand complete between separators.
WORDS = frozenset({"ge", "gn", "gr", "cf", "lx"})
#: Tables by kind; neighbouring pages' transcripts are copies only.
KINDS = ("dictionary_pages", "stage1_projections", "neighbor_pages")


def page_row(text: str) -> tuple:
    """(marker of the last line, the last of its values, surely cut by its own end, habits) of a record page."""
    lines = text.rstrip().split("\n")
    marker, value, rec = parts_of(text)
    sure = bool(MARKS.search(text)) or not marker or not value or marker == "dt" and not DATE.search(value) or marker in SENTENCES and not FINAL.search(value) or marker == "xv" or not {"ge", "gn", "gr"} & set(rec)
    habit: dict[str, list[int]] = {}
    for k, x in enumerate(lines[:-1]):
        if x[:1] != "\\":
            continue
        h = habit.setdefault(x[1:].partition(" ")[0], [0, 0])
        h[0] += 1
        h[1] += not lines[k + 1].strip()
    last = PIECES.split(value.lower())[-1].strip() if marker in WORDS else ""
    return marker, last, sure, [{"marker": m, "n": n, "ends": e} for m, (n, e) in habit.items()]


def texts(tables: dict[str, DataFrame]) -> DataFrame:
    """VALUE_SQL: the windows and the own end of every text of the three tables, analysed once."""
    titles = tables["dictionaries"].sparkSession.sparkContext.broadcast(titles_of(tables["dictionaries"]))
    cols = ("kind", "row_id", "page_id", "dictionary", "source_file", "text")
    pages = tables["dictionary_pages"].selectExpr("0 as kind", "page_key as row_id", "page_id", "dictionary", "source_file", "mdf_text as text")
    firsts = tables["stage1_projections"].selectExpr("1 as kind", "stage1_id as row_id", "page_id", "dictionary", "source_file", "text")
    others = tables["neighbor_pages"].selectExpr("2 as kind", "neighbor_id as row_id", "concat(substring_index(page_id, '/', 1), '/', stem) as page_id", "substring_index(page_id, '/', 1) as dictionary", "cast(null as string) as source_file", "transcript as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in VALUE]
            for kind, row, page, name, file, text in zip(*(c.to_pylist() for c in b.columns)):
                marker, last, cut, sure, habit = "", "", False, False, []
                if kind == 0:
                    s = printed(text)
                    marker, last, sure, habit = page_row(text)
                    cut = sure
                else:
                    s = body(MARKS.sub("", text), titles.value.get(name, ""))
                    if kind == 1:
                        cut, sure = own_end(text)
                hashes, places = windows(s)
                for col, x in zip(out, (kind, row, page, name, file, len(s), hashes, places, marker, last, cut, sure, habit)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, VALUE)], schema=VALUE)

    every = pages.unionByName(firsts).unionByName(others).select(*cols).where("text is not null and trim(text) <> ''")
    return every.withColumn("row_id", F.col("row_id").cast("bigint")).mapInArrow(run, VALUE_SQL)


def pairs(values: DataFrame, hot: int = HOT) -> DataFrame:
    """kind, row_id, copy_kind, copy_id: records and first readings with the texts that share one of their first windows, each pair once.

    Texts are met under each window; where more than `hot` do, under the window and each of the last windows of the shorter one.
    `goes_on` needs one of these in the copy, so no pair that it would accept is left out, whatever page the copy is of.
    """
    keys = values.select("kind", "row_id", F.explode(F.array_distinct(F.slice("hashes", 1, KEYS))).alias("h"))
    many = keys.groupBy("h").agg(F.count("*").alias("held")).where(F.col("held") > hot).select("h")
    few = keys.join(many, "h", "left_anti")
    # texts of hot windows only: their windows are looked up again
    held = keys.join(many, "h").groupBy("kind", "row_id").agg(F.collect_set("h").alias("starts"))
    held = held.join(values.select("kind", "row_id", "hashes").dropDuplicates(["kind", "row_id"]), ["kind", "row_id"])
    under = lambda hashes: held.select("kind", "row_id", "starts", F.explode(F.array_distinct(hashes)).alias("w")).select("kind", "row_id", "w", F.explode("starts").alias("h")).select("kind", "row_id", F.xxhash64("h", "w").alias("h"))
    as_copy = lambda df: df.withColumnsRenamed({"kind": "copy_kind", "row_id": "copy_id"})
    met = few.where("kind < 2").join(as_copy(few), "h").unionByName(under(last_of("hashes")).where("kind < 2").join(as_copy(under(F.col("hashes"))), "h"))
    return met.where("not (kind = copy_kind and row_id = copy_id)").select("kind", "row_id", "copy_kind", "copy_id").distinct()


def last_of(c: str):  # noqa: ANN201
    """The last TAIL items of an array column."""
    return F.expr(f"slice({c}, greatest(1, size({c}) - {TAIL - 1}), {TAIL})")


def run_out(values: DataFrame, hot: int = HOT) -> DataFrame:
    """kind, row_id, rest: letters by which the copies of a text go on after its end (shorter ones are none).

    Of a text's copies those that share the latest of its windows count, as others may only have its start; of these the least.
    """
    schema = pa.schema([("kind", pa.int32()), ("row_id", pa.int64()), ("rest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for kind, row, *sides in zip(*(c.to_pylist() for c in b.columns)):
                got = shared_end(*sides)
                if got is not None and got[1] > -BEYOND_RECORDS:
                    for col, x in zip(out, (kind, row, (got[0] << 40) + got[1])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ends = values.where("kind < 2").select("kind", "row_id", "n", last_of("hashes").alias("hashes"), last_of("places").alias("places"))
    copies = values.select(F.col("kind").alias("copy_kind"), F.col("row_id").alias("copy_id"), F.col("n").alias("copy_n"), F.col("hashes").alias("copy_hashes"), F.col("places").alias("copy_places"))
    both = pairs(values, hot).join(ends, ["kind", "row_id"]).join(copies, ["copy_kind", "copy_id"])
    both = both.select("kind", "row_id", "n", "hashes", "places", "copy_n", "copy_hashes", "copy_places")
    best = both.mapInArrow(run, "kind int, row_id bigint, rest bigint").groupBy("kind", "row_id").agg(F.min("rest").alias("rest"))
    return best.withColumn("rest", (F.pmod(F.col("rest") + BEYOND_RECORDS, F.lit(1 << 40)) - BEYOND_RECORDS).cast("int"))


def never_ending(values: DataFrame, least: int = 20, share: float = 0.01) -> DataFrame:
    """dictionary, marker: lines that hardly ever end a record of their dictionary, by all lines but the last of each page."""
    h = values.where("kind = 0").select("row_id", "dictionary", "habit").dropDuplicates(["row_id"]).select("dictionary", F.explode("habit").alias("h")).select("dictionary", "h.*")
    return h.groupBy("dictionary", "marker").agg(F.sum("n").alias("n"), F.sum("ends").alias("e")).where((F.col("n") >= least) & (F.col("e") < share * F.col("n"))).select("dictionary", "marker")


def cut_values(pages: DataFrame, alone: DataFrame) -> DataFrame:
    """row_id of record pages in `alone` (row_id, last_value) whose last value is a strict prefix of longer values and never stands complete itself.

    Values are met by a fixed-length prefix of 24, 12, 6 or 3 letters, the longest that the last value has; each distinct value once.
    """
    sizes = (24, 12, 6, 3)
    line = F.regexp_extract_all("mdf_text", F.lit(r"\\(?:" + "|".join(sorted(WORDS)) + r")[ \t]+(.*)\n"), 1)
    value = pages.where("mdf_text is not null").select(F.explode(line).alias("v")).distinct().select(F.explode(F.split(F.lower("v"), "[;,|/]")).alias("v"))
    value = value.select(F.trim("v").alias("v")).where("length(v) > 2").distinct()
    last = alone.where("length(last_value) > 2").select("row_id", F.col("last_value").alias("f"))
    size = F.coalesce(*[F.when(F.length("f") >= k, F.lit(k)) for k in sizes])
    ask = last.select("f").distinct().withColumn("k", size).withColumn("head", F.expr("left(f, k)"))
    known = value.select("v", F.explode(F.array_compact(F.array(*[F.when(F.length("v") >= k, F.struct(F.lit(k).alias("k"), F.left("v", F.lit(k)).alias("head"))) for k in sizes]))).alias("p")).select("v", "p.k", "p.head")
    each = ask.join(known, ["k", "head"]).groupBy("f").agg(F.max((F.col("v") == F.col("f")).cast("int")).alias("same"), F.max((F.startswith(F.col("v"), F.col("f")) & (F.length("v") > F.length("f"))).cast("int")).alias("longer"))
    return last.join(each.where("same = 0 and longer = 1").select("f"), "f").select("row_id")


def cut_texts(tables: dict[str, DataFrame], hot: int = HOT) -> DataFrame:
    """table_name, row_id, source_file, cut, cause for every text of the first two tables (one row an id).

    cause: `copy` (a longer copy goes on), `value` (its last value is a strict prefix of
    longer values and no value itself), `end` (its own end is that of a cut text), `habit` (its last line never ends a record), null if it is whole.
    """
    checkpoint_dir(tables["dictionary_pages"].sparkSession)
    # read more than once below; written to the shared folder, so that texts are analysed once
    values = texts(tables).checkpoint()
    rest = run_out(values, hot).checkpoint()
    never = never_ending(values).withColumn("never", F.lit(True))
    small = values.where("kind < 2").select("kind", "row_id", "dictionary", "source_file", "marker", "last_value", "cut_by_end", "sure").dropDuplicates(["kind", "row_id"])
    small = small.join(rest, ["kind", "row_id"], "left")
    short = cut_values(tables["dictionary_pages"], small.where("kind = 0 and rest is null and not sure")).select(F.lit(0).alias("kind"), "row_id", F.lit(True).alias("short"))
    got = small.join(short, ["kind", "row_id"], "left").join(never, ["dictionary", "marker"], "left")
    page = F.col("kind") == 0
    cause = (
        F.when(F.col("rest") >= F.when(page, BEYOND_RECORDS).otherwise(BEYOND), "copy")
        .when(F.col("short"), "value")
        .when(F.coalesce("sure", F.lit(False)), "end")
        .when(page & F.coalesce("never", F.lit(False)), "habit")
        .when(~page & F.col("rest").isNull() & F.col("cut_by_end"), "end")
    )
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return got.select(name.alias("table_name"), "row_id", "source_file", cause.isNotNull().alias("cut"), cause.alias("cause"))


def truncated_found(tables: dict[str, DataFrame]) -> DataFrame:
    """p2_found: table_name, row_id."""
    return cut_texts(tables).where("cut").select("table_name", "row_id")


def truncation_shares(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, source_file, texts, cut_texts, by_copy (those cut by a longer copy), cut_share: how often each source truncates."""
    got = cut_texts(tables).groupBy("table_name", "source_file").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("cause") == "copy").alias("by_copy"))
    return got.withColumn("cut_share", F.col("cut_texts") / F.col("texts"))
