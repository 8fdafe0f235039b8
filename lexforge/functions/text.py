"""Text normalisation as Column expressions; Python only where Spark has no Unicode normal forms or case folding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = r"</?[a-zA-Z][a-zA-Z0-9]*>"
SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"
#: What no space stands before, and what is left out of a markup word's key.
CLOSERS = r",.:;!?'\"()\[\]"
#: Line breaks of a text file.
SPLIT_LINES = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold_letters(s: pd.Series) -> pd.Series:
    """Case folding of letters alone (sharp s to ss, final sigma, dotted capital I)."""
    return s.map(lambda x: None if x is None else x.casefold() if x.isalpha() else "".join(c.casefold() if c.isalpha() else c for c in x))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def head_norm(s: pd.Series) -> pd.Series:
    """Compatibility form, small letters, dashes as hyphens, trimmed."""
    return s.map(lambda x: None if x is None else re.sub("[\u2010-\u2015\u2212]", "-", unicodedata.normalize("NFKC", x).lower()).strip())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: named in several places, or inside a lambda, Spark may compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def line_text(c: Column, composed: bool = False) -> Column:
    """Composed, white space collapsed, no space before closing marks. `composed` skips the normal form for text known to be in it."""
    c = c if composed else nfc(c)
    return F.regexp_replace(collapse(c), rf"\s+([{CLOSERS}])", "$1")


def clean_text(c: Column, composed: bool = False) -> Column:
    return line_text(strip_tags(c), composed)


def markup_word_key(c: Column) -> Column:
    return F.regexp_replace(casefold_letters(nfc(c)), rf"[{CLOSERS}]", "")


def homoglyphs(c: Column) -> Column:
    """Latin B, p and schwa as Cyrillic, then small letters, then commas as semicolons; null gives an empty string."""
    return F.replace(F.lower(strip(F.translate(F.coalesce(c, F.lit("")), "Bpə", "Врә"))), F.lit(","), F.lit(";"))


def field_value(c: Column, composed: bool = False) -> Column:
    c = strip(c) if composed else nfc(strip(c))
    return collapse(F.regexp_replace(homoglyphs(c), r"(?i)</?[bi]>", ""))


def projection_value(c: Column, composed: bool = False) -> Column:
    """As field_value, with homoglyphs left alone."""
    c = strip(c) if composed else nfc(strip(c))
    return collapse(F.regexp_replace(F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(","), F.lit(";")), r"(?i)</?[bi]>", ""))


def scoring_value(c: Column, composed: bool = False) -> Column:
    """A field value without white space and punctuation."""
    return F.regexp_replace(field_value(c, composed), r"(?U)[\s\p{P}]", "")


def without_noise(c: Column, spaces: bool = True) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\p{P}]" if spaces else r"\p{P}", "")


def cuneiform_spacing(c: Column) -> Column:
    return F.regexp_replace(c, r"([\x{12000}-\x{1247F}])\s+(?=[\x{12000}-\x{1247F}])", "$1")


def is_junk_line(c: Column) -> Column:
    """Blank, replacement characters, only backslashes, long digit runs, few distinct characters, one character twelve times over, or mostly CJK."""

    def of(t: Column) -> Column:
        n = F.greatest(F.length(F.regexp_replace(t, SPACE, "")), F.lit(1))
        share = lambda rx: F.length(F.regexp_replace(t, f"[^{rx}]", "")) / n
        return (
            (F.length(t) == 0) | t.contains("\ufffd") | t.rlike(r"^[\\\s]+$") | (F.length(t) >= 80) & (share("0-9") >= 0.85)
            | (F.length(t) > 200) & (F.size(F.array_distinct(F.split(t, ""))) <= 8) | (F.length(t) >= 12) & t.rlike(r"(.)\1{11}")
            | (F.length(t) >= 80) & (share("\u4e00-\u9fff") >= 0.55) & (share("A-Za-z") <= 0.15)
        )

    return let(strip(c), of)


def letter_ratios(c: Column) -> Column:
    t = F.regexp_replace(c, SPACE, "")
    n = F.greatest(F.length(t), F.lit(1))
    return F.struct((F.length(F.regexp_replace(t, "[^A-Za-z]", "")) / n).alias("latin"), (F.length(F.regexp_replace(t, "[^\u4e00-\u9fff]", "")) / n).alias("cjk"))


def split_gloss(c: Column) -> Column:
    """Pieces between semicolons, trimmed, empty ones dropped; the text itself if none is left."""
    parts = F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def end_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[.!?\s]+$", "")


def mdf_value(c: Column) -> Column:
    return end_punctuation(F.regexp_replace(c, r"(?i)</?[bi]>", ""))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```[\w-]*\s*\n", ""), r"\n?```\s*$", "")


def normalise_marker(c: Column) -> Column:
    return F.when(c == "ge", "gn").when(c == "de", "un").otherwise(c)


#: Roman numerals of entry numbers.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def entry_number(c: Column) -> Column:
    """Digits or Roman I to X, brackets aside; below 1 or anything else gives null."""
    t = F.upper(F.regexp_replace(strip(c), r"^[(\[{]+|[)\]}.]+$", ""))
    roman = F.coalesce(*[F.when(t == r, F.lit(k)) for k, r in enumerate(ROMAN, 1)])
    n = F.when(t.rlike(r"^\d{1,9}$"), t.cast("int")).otherwise(roman)
    return F.when(n >= 1, n)


#: Language names by their codes.
LANGUAGE_CODES = {"english": "en", "french": "fr", "francais": "fr", "german": "de", "deutsch": "de", "spanish": "es", "espanol": "es", "russian": "ru", "indonesian": "id", "portuguese": "pt", "turkish": "tr", "chinese": "zh"}


def language_key(c: Column, most: int = 24) -> Column:
    key = F.regexp_replace(F.translate(F.lower(strip(c)), "éèáíóúñçü", "eeaiouncu"), "[^a-z0-9]+", "")
    return F.left(F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])[key], key), F.lit(most))


def page_sort_key(c: Column) -> Column:
    """Struct that sorts page_N and page_N_pK by number, other stems after them by name."""
    n, k = F.regexp_extract(c, r"^page_(\d+)(?:_p(\d+))?$", 1), F.regexp_extract(c, r"^page_(\d+)(?:_p(\d+))?$", 2)
    hit = c.rlike(r"^page_\d+(?:_p\d+)?$")
    return F.struct((~hit).cast("int").alias("other"), F.when(hit, n.cast("int")).otherwise(0).alias("n"), F.when(hit & (k != ""), k.cast("int")).otherwise(0).alias("k"), c.alias("stem"))


def pages_of_spec(c: Column) -> Column:
    """`97-123, 179` as an array of page numbers; a descending range, a zero or anything else raises."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")

    def numbers(x: Column) -> Column:
        lo, hi = F.regexp_extract(x, r"^(\d+)\s*(?:-\s*(\d+))?$", 1).try_cast("int"), F.regexp_extract(x, r"^(\d+)\s*(?:-\s*(\d+))?$", 2).try_cast("int")
        top = F.coalesce(hi, lo)
        return F.when(x.rlike(r"^\d+\s*(-\s*\d+)?$") & (lo >= 1) & (top >= lo), F.sequence(lo, F.greatest(top, lo))).otherwise(F.raise_error(F.concat(F.lit("bad page spec: "), x)).cast("array<int>"))

    return F.flatten(F.transform(parts, numbers))


def extra_column(c: Column) -> Column:
    """snake_case key as a Title_Case column name."""
    return F.array_join(F.transform(F.split(c, "_"), F.initcap), "_")


def folder_token(c: Column) -> Column:
    return F.replace(strip(c), F.lit("/"), F.lit("_"))


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\X)"), 1)


def lexical_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1)


def occurrences(text: Column, part: Column) -> Column:
    """Times that `part` stands in the text without overlapping."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(F.lit(0)).cast("int")


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with `old` replaced if it stands there exactly once, else null."""
    return F.when(occurrences(text, old) == 1, F.replace(text, old, new))


def mdf_text(c: Column) -> Column:
    """Record text with every line's value cleaned (mdf_value); other lines stay."""
    line = r"^(\\[A-Za-z0-9_-]+ )(.*)$"
    clean = lambda x: F.when(x.rlike(line), F.concat(F.regexp_extract(x, line, 1), mdf_value(F.regexp_extract(x, line, 2)))).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n"), clean), "\n")


def natural_key(c: Column) -> Column:
    """Array of a name's runs of digits, padded, and of other characters, in small letters: sorts names as numbers read."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(F.lower(x)))
