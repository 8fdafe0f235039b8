"""Scripts of characters and tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts by code point ranges, in the order in which they are tried.
RANGES = (
    ("ipa", ((0x250, 0x2AF), (0x1D00, 0x1DBF), (0x2B0, 0x2FF))), ("cyrillic", ((0x400, 0x45F),)), ("cyrillic_ext", ((0x460, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("han", ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))), ("kana", ((0x3040, 0x30FF),)), ("hangul", ((0xAC00, 0xD7AF),)), ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("hebrew", ((0x590, 0x5FF),)), ("devanagari", ((0x900, 0x97F),)), ("armenian", ((0x530, 0x58F),)), ("georgian", ((0x10A0, 0x10FF),)), ("cuneiform", ((0x12000, 0x1247F),)),
    ("latin", ((0x41, 0x5A), (0x61, 0x7A))), ("latin_ext", ((0xC0, 0x24F), (0x1E00, 0x1EFF))),
)


def base_script(ch: Column) -> Column:
    """space, punct, digit, or the script of one character."""
    o = F.ascii(ch)
    out = F.when(ch.rlike(r"(?U)^\s$"), "space").when(ch.rlike(r"^[\p{P}\p{S}]$"), "punct").when(ch.rlike(r"^\p{N}$"), "digit").when(ch.rlike(r"^\p{M}$"), "mark")
    for name, ranges in RANGES:
        test = F.lit(False)
        for lo, hi in ranges:
            test = test | o.between(lo, hi)
        out = out.when(test, name)
    return out.otherwise("other")


def token_script(scripts: Column) -> Column:
    """Label of a token from the scripts of its characters: ipa before Cyrillic and Latin extensions, one script alone, else the first exotic one by name, else the commonest of Latin and Cyrillic; null without letters."""
    letters = F.filter(scripts, lambda s: ~s.isin("space", "punct", "digit", "mark"))
    kinds = F.array_sort(F.array_distinct(letters))
    exotic = F.filter(kinds, lambda s: ~s.isin("latin", "latin_ext", "cyrillic", "cyrillic_ext", "other"))
    count = lambda name: F.size(F.filter(letters, lambda s: s == name))
    return (
        F.when(F.size(letters) == 0, F.lit(None).cast("string"))
        .when(F.array_contains(kinds, "ipa"), "ipa").when(F.array_contains(kinds, "cyrillic_ext"), "cyrillic_ext").when(F.array_contains(kinds, "latin_ext"), "latin_ext")
        .when(F.size(kinds) == 1, kinds[0]).when(F.size(exotic) > 0, F.get(exotic, F.lit(0)))
        .otherwise(F.when(count("cyrillic") > count("latin"), "cyrillic").otherwise("latin"))
    )


def classify_token(scripts: Column, source: Column, targets: Column) -> Column:
    """source, target, residual or punct: by the scripts a token holds against those of the source and of the target languages."""
    letters = F.array_distinct(F.filter(scripts, lambda s: ~s.isin("space", "punct", "digit", "mark")))
    own = F.array_except(source, targets)
    other = F.array_except(targets, source)
    return F.when(F.size(letters) == 0, "punct").when(F.arrays_overlap(letters, own), "source").when(F.arrays_overlap(letters, other) & ~F.arrays_overlap(letters, source), "target").otherwise("residual")


@lru_cache(maxsize=100_000)
def script_of_char(ch: str) -> str:
    """base_script of one character."""
    kind = unicodedata.category(ch)[0]
    if ch.isspace():
        return "space"
    if kind in "PSNM":
        return {"P": "punct", "S": "punct", "N": "digit", "M": "mark"}[kind]
    return next((name for name, ranges in RANGES if any(lo <= ord(ch) <= hi for lo, hi in ranges)), "other")


@lru_cache(maxsize=100_000)
def script_of_token(token: str) -> str:
    """token_script of a token; `other` without letters."""
    letters = [s for s in map(script_of_char, token) if s not in ("space", "punct", "digit", "mark")]
    kinds = sorted(set(letters))
    if not kinds:
        return "other"
    for first in ("ipa", "cyrillic_ext", "latin_ext"):
        if first in kinds:
            return first
    exotic = [s for s in kinds if s not in ("latin", "cyrillic", "other")]
    return kinds[0] if len(kinds) == 1 else exotic[0] if exotic else "cyrillic" if letters.count("cyrillic") > letters.count("latin") else "latin"


@F.pandas_udf(T.ArrayType(T.StringType()))
def char_scripts(s: pd.Series) -> pd.Series:
    """One label a character: white space is `space`, every other character has the script of its token. Tokens are labelled once."""
    one = lambda x: None if x is None else ["space" if t.isspace() else script_of_token(t) for t in PARTS.findall(x) for _ in t]
    return s.map(one)


PARTS = re.compile(r"\s+|\S+")


#: Labels of annotation by script; any other script is `Other`.
BUCKETS = {"latin": "Latin", "cyrillic": "Cyrillic", "greek": "Greek", "ipa": "IPA", "digit": "Digits", "space": "space"}


def bucket_label(script: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(script) == k, F.lit(v)) for k, v in BUCKETS.items()], F.lit("Other"))
