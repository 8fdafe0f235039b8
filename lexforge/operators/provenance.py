"""Where a record's values stand in a page's transcript, and repair of values from it.

Values are sought in order with a cursor that never goes back, so a page is one fold: a grouped map over pages.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.session import spread

RUN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
STRUCTURAL = re.compile(r"^[0-9ivxlcdmIVXLCDM.() -]+$")


def folded(s: str) -> str:
    """Small letters of the same length as the text, commas as semicolons."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s).replace(",", ";")


def is_noise(c: str) -> bool:
    return c.isspace() or unicodedata.category(c)[0] == "P"


def compact(s: str) -> tuple[str, list[int]]:
    at = [k for k, c in enumerate(s) if not is_noise(c)]
    return "".join(s[k] for k in at), at


def locate(value: str, text: str, cursor: int, packed: tuple[str, list[int]] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """(exact, compact, token, partial or unmapped; ranges of the text). From the cursor first, then from the start."""
    v = folded(" ".join(value.split()))
    if not v:
        return "unmapped", []
    for start in (cursor, 0):
        k = text.find(v, start)
        if k >= 0:
            return "exact", [(k, k + len(v))]
    small, at = packed or compact(text)
    cv = compact(v)[0]
    if cv:
        first = next((i for i, k in enumerate(at) if k >= cursor), len(at))
        for start in (first, 0):
            k = small.find(cv, start)
            if k >= 0:
                return "compact", [(at[k], at[k + len(cv) - 1] + 1)]
    tokens, ranges, k = RUN.findall(v), [], cursor
    for t in tokens:
        m = re.compile(rf"(?<!\w){re.escape(t)}(?!\w)").search(text, k)
        if m:
            ranges.append(m.span())
            k = m.end()
    if tokens and len(ranges) == len(tokens):
        return "token", ranges
    return ("partial", ranges) if ranges else ("unmapped", [])


def label_counts(ranges: list[tuple[int, int]], text: str, labels: list) -> Counter:
    return Counter(labels[k] for a, b in ranges for k in range(a, min(b, len(labels))) if labels[k] not in ("space", "meta", None) and not is_noise(text[k]))


VALUES = "line_index int, status string, span_start int, span_end int, primary_language string, counts array<struct<language:string,n:int>>"


def project(lines: DataFrame, texts: DataFrame, keys: list[str], text: str = "text", labels: str = "languages") -> DataFrame:
    """keys and VALUES: every value of the pages' records held against the transcript."""
    rows = F.array_sort(F.collect_list(F.struct("line_index", "marker", "value")))
    pages = lines.groupBy(*keys).agg(rows.alias("rows")).join(texts.select(*keys, F.col(text).alias("text"), F.col(labels).alias("labels")), keys)
    schema = T.StructType([f for f in pages.schema.fields if f.name in keys] + T.StructType.fromDDL(VALUES).fields)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t = folded(r.text or "")
                packed = compact(t)
                lab = list(r.labels) if r.labels is not None else []
                cursor = 0
                for x in r.rows:
                    key = [getattr(r, k) for k in keys]
                    if x["marker"] in ("sn", "hm", "dt") and (x["marker"] != "sn" or STRUCTURAL.match(x["value"])):
                        out.append([*key, x["line_index"], "structural", None, None, "meta", []])
                        continue
                    status, ranges = locate(x["value"], t, cursor, packed)
                    n = label_counts(ranges, t, lab)
                    best = min(n, key=lambda k: (-n[k], k)) if n else "meta"
                    one = status in ("exact", "compact")
                    out.append([*key, x["line_index"], status, ranges[0][0] if one else None, ranges[-1][1] if one else None, best, [{"language": k, "n": c} for k, c in sorted(n.items())]])
                    if one or status == "token":
                        cursor = max(cursor, ranges[-1][1])
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return spread(pages, *keys).mapInPandas(run, schema)


#: Fixed values of a repair: least letters, least share of tokens found, greatest span against the value, least likeness of a changed run.
LETTERS, COVERED, LONGER, LIKE = 3, 0.8, 1.5, 0.5


def repair_value(value: str, text: str, cursor: int) -> tuple[str, str, int]:
    """(status or reason of refusal, repaired value, new cursor): letters are taken from the transcript, the value's punctuation stays."""
    plain = unicodedata.normalize("NFC", value)
    runs = [(m.start(), m.end()) for m in RUN.finditer(plain)]
    if sum(b - a for a, b in runs) < LETTERS:
        return "too_few_lexical_chars", value, cursor
    low = folded(text)
    status, ranges = locate(plain, low, cursor)
    if status in ("exact", "compact") and ranges[0][0] >= cursor:
        a, b = ranges[0]
    else:
        words = [plain[a:b].casefold() for a, b in runs]
        there = [m for m in RUN.finditer(text, cursor)]
        best: list[tuple[float, int, int]] = []
        n = len(words)
        forms = [m[0].casefold() for m in there]
        spare = int(n * (1 - COVERED) + 1e-9)
        known: dict[tuple[str, str], float] = {}
        for k in range(len(there) - n + 1):
            total, missed = 0.0, 0
            for w, f in zip(words, forms[k : k + n]):
                x = 1.0 if w == f else known.get((w, f))
                if x is None:
                    m = difflib.SequenceMatcher(None, w, f)
                    x = known[w, f] = m.ratio() if m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE else 0.0
                total += x
                missed += x < LIKE
                if missed > spare:
                    break
            else:
                best.append((total / n, there[k].start(), there[k + n - 1].end()))
        if not best:
            return "no_source_span", value, cursor
        best.sort(reverse=True)
        if len(best) > 1 and best[0][0] - best[1][0] < 1e-9 and text[best[0][1] : best[0][2]] != text[best[1][1] : best[1][2]]:
            return "ambiguous", value, cursor
        _, a, b = best[0]
        status = "approximate-token"
        if b - a > LONGER * len(plain):
            return "span_too_long", value, cursor
    source = [m[0] for m in RUN.finditer(text[a:b])]
    if len(source) != len(runs):
        return "lexical_run_count_mismatch", value, max(cursor, b)
    out, at = [], 0
    for (s, e), new in zip(runs, source):
        old = plain[s:e]
        if old.casefold() != new.casefold() and difflib.SequenceMatcher(None, old.casefold(), new.casefold()).ratio() < LIKE:
            return "low_similarity", value, max(cursor, b)
        out += [plain[at:s], old if old.casefold() == new.casefold() else new]
        at = e
    return status, "".join([*out, plain[at:]]), max(cursor, b)


def repair(lines: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_index, status, value, repaired: the audit of every value that isn't structural."""
    rows = F.array_sort(F.collect_list(F.struct("line_index", "marker", "value")))
    pages = lines.where("marker not in ('hm', 'ps', 'dt', 'sn', 'ph')").groupBy(*keys).agg(rows.alias("rows")).join(texts.select(*keys, F.col(text).alias("text")), keys)
    schema = T.StructType([f for f in pages.schema.fields if f.name in keys] + T.StructType.fromDDL("line_index int, status string, value string, repaired string").fields)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shown = unicodedata.normalize("NFC", re.sub(r"</?[a-zA-Z][a-zA-Z0-9]*>", "", " ".join((r.text or "").split())))
                cursor = 0
                for x in r.rows:
                    status, new, cursor = repair_value(x["value"], shown, cursor)
                    out.append([*[getattr(r, k) for k in keys], x["line_index"], status, x["value"], new])
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return spread(pages, *keys).mapInPandas(run, schema)
