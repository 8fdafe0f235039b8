"""Problem 3: noise in text from scanned pages: running heads, page numbers, words broken over lines, misread characters.

The first and last lines of pages are masked (digits as #, confusable glyphs as one prototype) and counted by
dictionary: a masked line with a number or the title that returns on RETURNS of its pages or more is a running head
(`returning_heads`; headings of chapters return as well, without either), and so is a line close to the dictionary's title, which its heads print and which tells them where a dictionary has few
pages, or one that prints two guide words, which differ from page to page. Words are grouped by the skeleton of their
confusable glyphs; a word outside the vocabulary is misread if its group holds a known form of a target
language from which known confusions make it, if a neighbour is a word of a target language or a number, and if it
is no word of a source language. A line-end hyphen is noise unless the vocabulary has
the word with it. Paragraphs are reflowed over SQL windows.

Defined results: null and empty texts give no rows; blank lines count as lines; a row delivered again gives its
rows once; other columns are ignored; a text without a known dictionary is judged without a title.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.llm.spelling import plain
from lexforge.session import small_rows

#: Glyphs read for each other in print, as pairs (printed, read).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("a", "u"), ("u", "a"), ("a", "o"), ("i", "1"), ("i", "!"), ("i", "l"), ("l", "i"), ("l", "1"), ("l", "|"), ("l", "I"), ("i", "j"), ("t", "f"), ("f", "t"), ("o", "0"), ("s", "5"),
    ("h", "b"), ("b", "h"), ("b", "6"), ("b", "8"), ("g", "q"), ("g", "9"), ("q", "g"), ("n", "u"), ("u", "n"), ("v", "y"), ("z", "2"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("li", "h"), ("h", "li"), ("n", "ri"), ("ri", "n"), ("rn", "m"), ("cl", "d"),
    ("е", "с"), ("с", "е"), ("о", "0"), ("т", "г"), ("г", "т"), ("л", "п"), ("п", "л"), ("н", "п"), ("п", "н"), ("к", "н"), ("н", "к"), ("и", "н"), ("н", "и"), ("з", "3"), ("ы", "ьг"), ("ы", "ьі"), ("м", "ш"), ("ш", "щ"), ("щ", "ш"), ("ч", "4"), ("б", "6"), ("ю", "10"), ("и", "й"), ("ж", "м"),
)
PAIRS = frozenset(CONFUSIONS)
MULTI = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("ьг", "ы"), ("10", "ю"))
#: One prototype for each set of glyphs that the pairs connect.
SINGLE = str.maketrans({x: group[0] for group in ("aouny0сео", "ec", "il1!|ij", "tf", "s5", "hb68б", "gq9", "z2", "тг", "нлпкий", "з3", "мшщж", "ч4", "ю") for x in group})
BREAKS = "-‐¬=­"
BREAK_END = re.compile(rf"[^\W\d_][̀-ͯ]*[{BREAKS}]\s*$")
OUTER = ".,;:?\"“”„«»()[]—–-→*=¬‐­’'‘¿¡…"
NUMBER = re.compile(r"^\W*(?:(?:p|pp|pág|page|S|Seite|с|стр|hal|h)\.?\s*)?([\dOolIi|!SBZ]+|[ivxlc]+)\W*$")
GUIDES = re.compile(r"^\d?[^\W\d_]\S*\s+[–—-]\s+\d?[^\W\d_]\S*$")
#: Digits by the letters they are read as.
AS_DIGITS = str.maketrans("OolIi|!SBZ", "0011111582")
ELIDED = re.compile(r"^[a-zà-ÿ]{1,2}['’]")
ROMAN = re.compile(r"^\W*[ivxlc]+\W*$")
#: The end of a text that says it was cut off.
CUT_MARK = r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…|\x{FFFD})\s*$"
#: Stands after the last word of a value while words are counted.
END = "\u0002"
SPLITS = r"[\s.,;:?!\"“”„«»()\[\]¿¡\u00a0\u2007\u2009\u202f\u3000]+"


def skeletons(w: str) -> tuple[str, str]:
    """The two skeletons of a word: with glyph pairs read as one glyph first, and with single glyphs only."""
    a = w
    for x, y in MULTI:
        a = a.replace(x, y)
    return a.translate(SINGLE), w.translate(SINGLE)


def made_from(read: str, printed: str, most: int = 3) -> int:
    """How many confusions turn the printed word into the one read; 0 if none do, or more than `most`."""
    best = {0: 0}  # places in `read` reached so far, for each place in `printed`
    front = {(0, 0): 0}
    n, m = len(printed), len(read)
    done = None
    for i in range(n + 1):
        for j in range(m + 1):
            c = front.get((i, j))
            if c is None:
                continue
            if i == n and j == m:
                done = c
                continue
            if i < n and j < m and printed[i] == read[j]:
                k = (i + 1, j + 1)
                front[k] = min(front.get(k, 99), c)
            if c < most:
                for x in (1, 2):
                    for y in (1, 2):
                        if (printed[i : i + x], read[j : j + y]) in PAIRS:
                            k = (i + x, j + y)
                            front[k] = min(front.get(k, 99), c + 1)
    return done or 0


class Words:
    """The vocabulary of target languages: frequent forms with their counts, and their skeleton groups."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.groups: dict[str, list[str]] = {}
        for w in counts:
            for k in set(skeletons(w)):
                self.groups.setdefault(k, []).append(w)
        self.compound = {p for w in counts if "-" in w for p in [w[: i + 1] for i, c in enumerate(w) if c == "-"]}
        self.seen: dict[str, str] = {}
        self.looked: dict[str, tuple[str, bool]] = {}

    def printed(self, w: str) -> str:
        """The frequent form that w was read from, '' if w is none's misreading."""
        got = self.seen.get(w)
        if got is None:
            got, best = "", (99, 0)
            if len(w) > 1:
                for k in set(skeletons(w)):
                    for v in self.groups.get(k, ()):
                        if v != w and (c := made_from(w, v, 1 if len(v) < 5 else 3)) and (c, -self.counts[v]) < best:
                            got, best = v, (c, -self.counts[v])
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = got
        return got


    def look(self, token: str) -> tuple[str, bool]:
        """(word of a token in its plain spelling, whether it is in the vocabulary)."""
        got = self.looked.get(token)
        if got is None:
            w = strip(token).lower()
            if w not in self.counts and not w.isascii():
                w = strip(plain(token)[0]).lower()
            got = (w, w in self.counts)
            if len(self.looked) > 400_000:
                self.looked.clear()
            self.looked[token] = got
        return got

    def misread(self, w: str, token: str) -> str:
        """The form a token's word was read from, '' for none."""
        if ROMAN.match(w):
            return ""
        v = self.printed(w)
        if not v and token[-1] in "!|" and len(w) > 2:
            v = self.printed(w + token[-1])
        if not v and ("'" in w or "’" in w):
            head, _, rest = w.replace("’", "'").partition("'")
            if len(head) <= 2 and len(rest) > 1 and rest not in self.counts and (x := self.printed(rest)):
                v = f"{head}'{x}"
        return v


def strip(t: str) -> str:
    return t.strip(OUTER)


#: Share of a dictionary's pages, and number of them, on which a masked line returns to be a running head.
RETURNS, LEAST_PAGES = 0.05, 3
DIGITS = re.compile(r"\S*\d\S*")


def masked(line: str) -> str:
    """A line for counting running heads: small letters, what holds digits as #, confusable glyphs as their prototype."""
    return DIGITS.sub("#", " ".join(line.split()).lower()).translate(SINGLE)


def is_head(line: str, title: str) -> bool:
    s = line.strip()
    if not s or s[-1] in ".;,":
        return False
    spaces = s.count(" ")
    if 2 <= spaces <= 6 and ("—" in s or "–" in s or " - " in s) and GUIDES.match(s) and s[-1] not in ".,;:!?)":
        return True
    if not title or spaces > 10 or spaces + 1 < title.count(" ") or len(s) > 3 * len(title) + 30:
        return False
    if len(s.split()) > title.count(" ") + 5:
        return False
    t = re.sub(r"\[[^\]]{1,8}\]|^\W*\d+\W+|\W+\d+\W*$", " ", s)
    want = title.lower().split()
    full = " ".join(want)
    for u in (t, t.replace(",", " ")) if "," in t else (t,):  # a comma may be a misread space or letter
        words = u.split()
        if not len(want) <= len(words) <= len(want) + 2:
            continue
        for part in (words[: len(want)], words[-len(want) :]):
            have = " ".join(part).lower()
            if have == full or sum(map(str.__eq__, have[-3:], full[-3:])) + sum(map(str.__eq__, have[:3], full[:3])) > 1 and difflib.SequenceMatcher(None, have, full, False).ratio() >= 0.78:
                return True
    return False


def page_no(line: str, page: int | None, edge: bool) -> bool:
    m = NUMBER.match(line)
    if not m or line.strip().endswith(".") and line.strip()[:-1].isdigit():
        return False
    core = m[1]
    if core.isdigit():
        return True
    if any(c.isdigit() for c in core) and not core[0].isalpha() or len(core) > 1 and sum(c.isdigit() for c in core) * (9 if edge else 2) >= len(core):
        return True
    if page is not None and core.translate(AS_DIGITS) == str(page):
        return True
    if ROMAN.match(line):
        return edge
    return bool(re.match(r"^\W*[OolIi|!SBZ]{1,3}\W*$", line)) and edge and (page is None or len(core) == len(str(page)))


def analyse(text: str, title: str, page: int | None, words: Words, repair: bool = False, heads: frozenset = frozenset()) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, int, str]]]:
    """(noise rows: line_no, noise, word, printed form), (body lines, if they are to be repaired: line_no, 1 if broken at the end, text)."""
    lines = text.split("\n")
    rows: list[tuple[int, str, str, str]] = []
    filled = [k for k, x in enumerate(lines) if x.strip()]
    edges = {*filled[:1], *filled[-1:]}
    body: list[int] = []
    kinds: dict[int, str] = {}
    for k in filled:
        x = lines[k]
        if heads and x.rstrip()[-1] not in ".;,:!?" and masked(x) in heads or is_head(x, title):
            kinds[k] = "header"
        elif len(x) < 120:
            if len(x) < 24 and page_no(x, page, k in edges or kinds.get(k - 1) == "header" or k + 1 < len(lines) and is_head(lines[k + 1], title)):
                kinds[k] = "page_number"
        if k in kinds:
            rows.append((k + 1, kinds[k], "", ""))
        else:
            body.append(k)
    counts, look = words.counts, words.look
    toks: list[str] = []
    where: list[int] = []
    split: dict[int, tuple[int, int]] = {}  # of a token on two lines: the second line, the length of its first part
    broken: set[int] = set()
    carried = False
    for n, k in enumerate(body):
        parts = lines[k].split()
        if carried:
            parts = parts[1:]
        carried = False
        if not parts:
            continue
        last = parts[-1]
        if last[-1] in BREAKS and len(last) > 1 and BREAK_END.search(last):
            nxt = body[n + 1] if n + 1 < len(body) else None
            right = lines[nxt].split()[0] if nxt is not None else ""
            left = last[:-1]
            if right and right.lstrip("(«„“\"")[:1].isalpha():
                low, r = look(left)[0], look(right)[0]
                joined, hyphened = low + r, f"{low}-{r}"
                cut = lambda w: ELIDED.sub("", w)
                nj, nh = max(counts.get(joined, 0), counts.get(cut(joined), 0)), max(counts.get(hyphened, 0), counts.get(cut(hyphened), 0))
                if not nj and not nh:
                    nj, nh = bool(words.printed(joined)), bool(words.printed(hyphened) or words.printed(cut(hyphened)))
                if nh > nj or not nj and "-" in low and cut(low) + "-" in words.compound:
                    parts[-1], first = left + "-" + right, len(left) + 1
                else:
                    rows.append((k + 1, "hyphen", "", ""))
                    broken.add(k)
                    parts[-1], first = left + right, len(left)
                split[len(toks) + len(parts) - 1] = (nxt, first)
                carried = True
            elif right == "" and look(left)[0] + "-" not in words.compound:
                rows.append((k + 1, "hyphen", "", ""))
                broken.add(k)
        toks += parts
        where += [k] * len(parts)
    seen = [look(t) for t in toks]
    fixes: dict[int, list[tuple[str, str]]] = {}
    for i, (w, known) in enumerate(seen):
        if known or len(w) < 2:
            continue
        v = words.misread(w, toks[i])
        if not v:
            continue
        if not ("-" in v and len(v) > 6 or i and (seen[i - 1][1] and len(seen[i - 1][0]) > 1 or seen[i - 1][0].isdigit()) or i + 1 < len(seen) and (seen[i + 1][1] and len(seen[i + 1][0]) > 1 or seen[i + 1][0].isdigit())):
            continue
        k = where[i]
        if i in split:
            k2, first = split[i]
            off = next((p for p, (x, y) in enumerate(zip(w, v)) if x != y), len(w))
            k = k2 if off >= len(strip(toks[i][:first])) else k
        rows.append((k + 1, "misread", w, v))
        fixes.setdefault(k, []).append((w, v))
    if not repair:
        return rows, []
    out = []
    for k in body:
        t = lines[k] if lines[k].isascii() else plain(lines[k])[0]
        for w, v in fixes.get(k, ()):
            t = re.sub(re.escape(w), v, t, count=1, flags=re.I)
        out.append((k + 1, int(k in broken), t))
    return rows, out


def scanned(tables: dict[str, DataFrame], names: tuple[str, ...] = ("neighbor_pages", "stage1_projections", "layout_blocks")) -> DataFrame:
    """table_name, row_id, dictionary, page, text of the scanned texts; null and empty texts are left out."""
    name = F.substring_index("page_id", "/", 1).alias("dictionary")
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int").alias("page")
    parts = [("neighbor_pages", "neighbor_id", "transcript", "stem"), ("stage1_projections", "stage1_id", "text", "page_id"), ("layout_blocks", "block_row_id", "text", "page_id")]
    out = None
    for table, key, text, page in parts:
        if table not in names:
            continue
        df = tables[table].select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), name, number(page), F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out.where("text is not null and text <> ''")


def vocabulary(field_lines: DataFrame, samples: DataFrame | None = None, least: int = 4, bound: int = 1_000_000) -> dict[str, int]:
    """Words of target languages with their counts, in their plain spelling: those that stand `least` times in translations and notes, however large these are, and more there than in source text.

    The last line of a page may be cut off within a word. So words that stand mostly at the end of values must have `least` places besides the ends of pages' last lines.
    Words of at least two samples of target languages are added. Beyond `bound` words, which every executor must hold, it raises.
    """
    own = F.col("marker").isin("lx", "xv", "cf", "ph")
    lines = field_lines.where("value is not null and marker not in ('ps', 'hm', 'dt')")
    text = F.lower("value")
    text = F.when(F.substring(F.rtrim(text), -1, 1).isin(".", "…", "]", "\ufffd"), F.regexp_replace(text, CUT_MARK, "")).otherwise(text)
    text = F.concat(text, F.lit(END))
    words = (
        lines.select(own.alias("own"), F.explode(F.split(text, SPLITS)).alias("t"))
        .select("own", F.replace("t", F.lit(END), F.lit("")).alias("w"), F.endswith("t", F.lit(END)).alias("last"))
        .where("w <> ''")
        .groupBy("w")
        .agg(F.count_if(~F.col("own")).alias("n"), F.count_if("own").alias("s"), F.count_if(~F.col("own") & ~F.col("last")).alias("inside"))
    )
    kept = words.where((F.col("n") >= least) & (F.col("n") > 2 * F.col("s")) & ~F.col("w").rlike(r"^[\d/.]+$"))
    rows = kept.select("w", "n", "inside").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("vocabulary beyond its bound")
    at_ends = {r[0]: r[2] for r in rows if r[2] < least}
    if at_ends and {"page_id", "record_index", "line_index"} <= set(field_lines.columns):
        place = (F.col("record_index").cast("bigint") * 2**32 + F.col("line_index")).alias("place")
        pages = field_lines.groupBy("page_id").agg(F.max(place).alias("end"))
        asked = F.broadcast(field_lines.sparkSession.createDataFrame([(w,) for w in at_ends], "w string"))
        last = F.element_at(F.split(F.substring_index(text, " ", -1), SPLITS), -1)
        ends = lines.where(~own).select("page_id", place, last.alias("t")).select("page_id", "place", F.replace("t", F.lit(END), F.lit("")).alias("w")).join(asked, "w").join(pages, "page_id", "left")
        for w, n in ends.where(F.coalesce(F.col("place") < F.col("end"), F.lit(True))).groupBy("w").count().collect():
            at_ends[w] += n
        rows = [r for r in rows if at_ends.get(r[0], least) >= least]
    out: dict[str, int] = {}
    for w, n, _ in rows:
        if w := w if w.isascii() else plain(w)[0].lower():
            out[w] = out.get(w, 0) + n
    if samples is not None:
        seen: dict[str, int] = {}
        for r in small_rows(samples.where("lang not like 'qa_' and text is not null").select("text"), "language_samples"):
            for w in {strip(x).lower() for x in r[0].split()}:
                seen[w] = seen.get(w, 0) + 1
        out |= {w: n for w, n in seen.items() if n > 1 and w not in out and len(w) > 1 and not any(c.isdigit() for c in w)}
    return out


NOISE = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("line_no", pa.int32()), ("noise", pa.string()), ("word", pa.string()), ("printed", pa.string())])
NOISE_SQL = "table_name string, row_id bigint, line_no int, noise string, word string, printed string"


def titles_of(dictionaries: DataFrame) -> dict[str, str]:
    return {r[0]: r[1] or "" for r in small_rows(dictionaries.select("dictionary", "title"), "dictionaries")}


def returning_heads(tables: dict[str, DataFrame]) -> DataFrame:
    """dictionary, head (masked), pages, lines: masked first and last lines that return on enough pages of a dictionary.

    The two first and two last filled lines of each reading count, once a delivery; only these are moved.
    """
    keys, values = "".join(map(chr, SINGLE)), "".join(SINGLE.values())
    read = scanned({k: v for k, v in tables.items() if k != "layout_blocks"}, ("neighbor_pages", "stage1_projections")).where("dictionary is not null and page is not null")
    filled = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    edges = F.array_distinct(F.concat(F.slice("x", 1, 2), F.when(F.size("x") > 2, F.slice("x", -2, 2)).otherwise(F.array().cast("array<string>"))))
    lines = read.select("dictionary", "page", "table_name", "row_id", filled.alias("x")).where("size(x) > 0").select("dictionary", "page", "table_name", "row_id", F.explode(edges).alias("line"))
    lines = lines.where(~F.col("line").rlike(r"[.;,:!?]$"))
    mask = F.translate(F.regexp_replace(F.lower("line"), r"(?U)\S*\d\S*", "#"), keys, values)
    masks = lines.select("dictionary", "page", "table_name", "row_id", mask.alias("head")).where(F.col("head").rlike(r"\p{L}\p{L}")).distinct()
    counted = masks.groupBy("dictionary", "head", "page").count().groupBy("dictionary", "head").agg(F.count("*").alias("pages"), F.sum("count").alias("lines"))
    of = read.select("dictionary", "page").distinct().groupBy("dictionary").agg(F.count("*").alias("all_pages"))
    titles = tables["dictionaries"].groupBy("dictionary").agg(F.max(F.translate(F.lower("title"), keys, values)).alias("title"))
    often = counted.where(F.col("pages") >= LEAST_PAGES).join(of, "dictionary").where(F.col("pages") >= RETURNS * F.col("all_pages")).join(titles, "dictionary", "left")
    # chapters' headings return too; a running head prints a number or the title
    return often.where(F.contains("head", F.lit("#")) | F.coalesce(F.contains(F.col("head"), F.col("title")), F.lit(False))).select("dictionary", "head", "pages", "lines")


def heads_of(tables: dict[str, DataFrame]) -> dict[str, frozenset]:
    """Running heads by dictionary, for the executors. Their number is bounded: each page has four such lines a reading, and each head returns on RETURNS of the pages."""
    out: dict[str, set] = {}
    for r in small_rows(returning_heads(tables), "running heads", 200_000):
        out.setdefault(r["dictionary"], set()).add(r["head"])
    return {k: frozenset(v) for k, v in out.items()}


def shared_words(tables: dict[str, DataFrame]):  # noqa: ANN201
    """What every executor reads of the tables: vocabulary, titles and running heads, each of bounded size."""
    return tables["field_lines"].sparkSession.sparkContext.broadcast((vocabulary(tables["field_lines"], tables.get("language_samples")), titles_of(tables["dictionaries"]), heads_of(tables)))


def noise_candidates(tables: dict[str, DataFrame]) -> DataFrame:
    """NOISE_SQL: noise in every line, misread words not yet held against the source languages."""
    shared = shared_words(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, titles, heads = shared.value
        words = Words(counts)
        for b in batches:
            out: list[list] = [[] for _ in NOISE]
            for table, row, name, page, text in zip(*(c.to_pylist() for c in b.columns)):
                for line, noise, w, v in analyse(text, titles.get(name, ""), page, words, heads=heads.get(name, frozenset()))[0]:
                    for col, x in zip(out, (table, row, line, noise, w, v)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, NOISE)], schema=NOISE)

    return scanned(tables).mapInArrow(run, NOISE_SQL)


def source_words(field_lines: DataFrame) -> DataFrame:
    """Distinct words of source languages, as printed in headwords, examples and references."""
    return (
        field_lines.where("value is not null and marker in ('lx', 'xv', 'cf')")
        .select(F.explode(F.split(F.lower("value"), SPLITS)).alias("word"))
        .where("word <> ''")
        .distinct()
    )


def noise_found(tables: dict[str, DataFrame]) -> DataFrame:
    """p3_found: table_name, row_id, line_no, noise."""
    rows = noise_candidates(tables)
    # rows of other noise pass the anti join under a key of their own, so that they are spread and the scan runs once
    key = F.when(F.col("noise") == "misread", F.col("word")).otherwise(F.concat_ws(":", F.lit("\u0001"), "row_id", "line_no"))
    return rows.withColumn("word", key).join(source_words(tables["field_lines"]), "word", "left_anti").select("table_name", "row_id", "line_no", "noise").distinct()


def paragraphs(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_id, para_no (from 1), text: scanned texts repaired and reflowed.

    Heads and page numbers are left out, broken words joined, misread words set right; lines run on until a blank line.
    """
    shared = shared_words(tables)
    schema = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("line_no", pa.int32()), ("broken", pa.int32()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, titles, heads = shared.value
        words = Words(counts)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for table, row, name, page, text in zip(*(c.to_pylist() for c in b.columns)):
                for line, broken, t in analyse(text, titles.get(name, ""), page, words, True, heads.get(name, frozenset()))[1]:
                    t = t.rstrip()
                    for col, x in zip(out, (table, row, line, broken, t.rstrip(BREAKS) if broken else t)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    lines = scanned(tables).dropDuplicates(["table_name", "row_id"]).mapInArrow(run, "table_name string, row_id bigint, line_no int, broken int, line string")
    by = W.partitionBy("table_name", "row_id").orderBy("line_no")
    lines = lines.withColumn("opens", (F.col("line_no") - F.lag("line_no").over(by) > 1).cast("int")).withColumn("para_no", (F.sum(F.coalesce("opens", F.lit(0))).over(by) + 1).cast("int"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line", "broken"))), lambda x: F.concat(x["line"], F.when(x["broken"] == 1, "").otherwise(" ")))
    return lines.groupBy("table_name", "row_id", "para_no").agg(F.trim(F.array_join(joined, "")).alias("text"))
