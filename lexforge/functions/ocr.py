"""Clean-up of recognised text: noise substitutions in a fixed order, typography of lines, Markdown to plain lines.

The substitutions are a table; one vectorised function applies it, as rules that repeat until nothing changes have no
built-in expression. Everything else is Column expressions.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.text import cuneiform_spacing, is_junk_line, let, nfc, strip

ONCE, REPEAT = False, True


def command(m: re.Match) -> str:
    """The first filled group of a command's arguments, else the name of a short command."""
    return next((g for g in m.groups()[1:] if g), m[1] if len(m[1]) <= 6 else "")


#: Noise of recognised text in the order of its removal: pattern, what stands for it, whether repeated until nothing changes. The rules of one tuple repeat together.
NOISE_RULES = (
    ((r"(?i)<br\s*/?>", " "),), ((r"(?i)(?:x<i>\{\d+\}</i>\s*)+", ""),), ((r"(?i)<x\{[^>]*>", ""),),
    ((r"(?i)\\(?:mathbf|boldsymbol|textbf|bm)\{([^{}]*)\}", r"<b>\1</b>"), (r"(?i)\\(?:textit|mathit|emph|itshape)\{([^{}]*)\}", r"<i>\1</i>"), REPEAT),
    ((r"\\text\s*\{([^{}]*)\}", r"\1"),), ((r"\\mathrm\{([^{}]*)\}", r"\1"),), ((r"\\mathbb\{([^{}]*)\}", r"\1"),), ((r"\\overline\{([^{}]*)\}", r"\1"),), ((r"\\(?:complement|dashv|lrcorner|circledast|wedge)\b", ""),),
    ((r"\$(?!\$)(.{1,60}?)(?<!\$)\$(?!\$)", r"\1"), REPEAT), ((r"\\([a-zA-Z]+)(?:\{([^{}]*)\})?(?:_\{([^{}]*)\})?(?:\^\{([^{}]*)\})?", command), REPEAT),
    ((r"(?i)(?<=[a-zA-Z])wedge(?=[-<])|\bwedge\b", ""),), ((r"[_^]\{([^{}]*)\}", r"\1"),), ((r"(?i)[_^]\s*text\b", ""),), ((r"(?<![<{])\{([^{}]{1,200})\}(?![>}])", r"\1"), REPEAT),
    ((r"(?i)(?<![A-Za-z])text\s*\{([^{}]*)\}", r"\1"),), ((r"[_^]\{([^{}]*)\}", r"\1"),), ((r"(?i)[_^]\s*text\b", ""),), ((r"\\\(|\\\)|\\\[|\\\]", ""),),
    (("卍{3,}", " "),), ((r"☐\s*", ""),), (("[\u2070-\u209f\u02b0-\u02ff]+", ""),), ((r"(?i)\[Unreadable\]", ""),), (("\ufffd", ""),),
    ((r"(?i)\\?\{?\s*arrayl\s*|\s*\\\\\s*|\s*array\.?\s*", " "), REPEAT), ((r"\\+", ""),), ((r"[{}]", ""),), ((r" {3,}", "  "),),
)
COMPILED = tuple((tuple((re.compile(p), to) for p, to in (r for r in rules if isinstance(r, tuple))), rules[-1] is REPEAT) for rules in NOISE_RULES)
#: What a line must hold for any rule to apply.
MAY_BE_NOISE = re.compile("[\\\\<{}$&_^卍☐\u2070-\u209f\u02b0-\u02ff\ufffd\\[]|(?i:wedge|array)|   ")


def without_noise(s: str | None) -> str | None:
    if s is None or not MAY_BE_NOISE.search(s):
        return s
    s = html.unescape(s)
    for rules, repeat in COMPILED:
        while True:
            before = s
            for rx, to in rules:
                s = rx.sub(to, s)
            if not repeat or s == before:
                break
    return s


@F.pandas_udf(T.StringType())
def strip_noise(s: pd.Series) -> pd.Series:
    """NOISE_RULES in order, after character entities."""
    return s.map(without_noise)


#: Every dash, and the curly forms of the apostrophe.
DASHES, CURLY = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u2018\u2019\u201a\u201b\u2032\u2039\u203a"


def latex_delimiters(c: Column) -> Column:
    """Text between LaTeX delimiters, without them."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)\\\((.+?)\\\)", "$1"), r"(?s)\$(?!\$)(.+?)(?<!\$)\$(?!\$)", "$1"), r"(?s)\\\[(.+?)\\\]", "$1")


def emphasis(c: Column) -> Column:
    """Markdown's bold and italic as b and i; bold first."""
    for rx, tag in ((r"\*\*(.+?)\*\*", "b"), (r"__(.+?)__", "b"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "i"), (r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", "i")):
        c = F.regexp_replace(c, rx, f"<{tag}>$1</{tag}>")
    return c


def known_tags(c: Column) -> Column:
    """Tags without attributes: bold and italic ones as b and i, N in capitals, any other is dropped."""
    for rx, to in ((r"(?i)<(/?)(?:b|strong)>", "<$1b>"), (r"(?i)<(/?)(?:i|em)>", "<$1i>"), (r"(?i)<(/?)n>", "<$1N>")):
        c = F.regexp_replace(c, rx, to)
    return F.regexp_replace(c, r"</?(?!(?:b|i|N)>)[a-zA-Z][a-zA-Z0-9]*>", "")


def stray_angles(c: Column) -> Column:
    """Angle brackets that belong to no b, i or N tag are dropped."""
    return F.regexp_replace(c, r"<(?!/?(?:b|i|N)>)|(?<!<[biN]|</[biN])>", "")


def dashes(c: Column) -> Column:
    """In page heads (`X - 12 - Y`) every dash is an em dash, elsewhere a hyphen."""
    head = rf"^\s*\S.*[-{DASHES}]\s*\d+\s*[-{DASHES}]\s+\S"
    return let(c, lambda x: F.when(x.rlike(head), F.translate(x, "-" + DASHES, "\u2014" * 8)).otherwise(F.translate(x, DASHES, "-" * 7)))


def apostrophes(c: Column) -> Column:
    return F.translate(c, CURLY, "'" * 7)


def recognised_line(c: Column) -> Column:
    """A recognised line in the dictionary's typography; junk and lines with replacement characters give an empty string."""
    t = stray_angles(known_tags(emphasis(latex_delimiters(strip_noise(c)))))
    t = cuneiform_spacing(nfc(apostrophes(dashes(F.regexp_replace(t, "<b></b>|<i></i>", "")))))
    return F.when(c.contains("\ufffd"), "").otherwise(let(t, lambda x: F.when(is_junk_line(x), "").otherwise(x)))


def renewed_line(c: Column) -> Column:
    """recognised_line, or the composed line where that leaves nothing."""
    return F.coalesce(F.nullif(recognised_line(c), F.lit("")), cuneiform_spacing(nfc(strip(c))))


# Markdown

#: Phrases of digitisation notices.
BOILERPLATE = r"(?i)Generated at University|HathiTrust|hdl\.handle\.net|Public Domain, Google-digitized"
FENCE = r"(?i)^```(?:markdown|md)?\s*$"
#: What a Markdown line may hold besides text, in the order of its removal.
ARTIFACTS = (
    (r"(?s)\$\$.+?\$\$", ""), (r"(?i)</?(?:table|tr|td|th|tbody|thead|tfoot|div|span|br|p)\b[^>]*>", " "), (r"^\s*(?:#{1,6}\s+)+", ""), (r"^\s{0,12}[-*+•]\s+", ""), (r"\s*•\s*", " "),
    (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?i)<img\b[^>]*>", ""), (r"(?is)<div\b[^>]*>.*?</div>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?U)\s{2,}", " "),
)


def is_boilerplate(c: Column) -> Column:
    return c.rlike(BOILERPLATE)


def unfenced(lines: Column) -> Column:
    """Lines without one fence around them all."""
    first, last = strip(F.get(lines, F.lit(0))), strip(F.element_at(lines, -1))
    start = F.when(first.rlike(FENCE), 2).otherwise(1)
    n = F.size(lines) - start + 1 - F.when((F.size(lines) >= start) & last.rlike(r"^```\s*$"), 1).otherwise(0)
    return F.when(F.size(lines) > 0, F.slice(lines, start, F.greatest(n, F.lit(0)))).otherwise(lines)


def pipe_cells(c: Column) -> Column:
    """Cells of a pipe table's row, none for its rule; null for any other line."""
    t = strip(c)
    cells = F.filter(F.transform(F.split(F.regexp_extract(t, r"^\|(.+)\|$", 1), r"\|"), strip), lambda x: (x != "") & ~x.rlike("^:?-{3,}:?$"))
    return F.when(t.rlike(r"^\|(?:\s*:?-{3,}:?\s*\|)+$"), F.array().cast("array<string>")).when(t.rlike(r"^\|.+\|$"), cells)


def header_parts(c: Column) -> Column:
    """A line's parts between the header signs that run inside it."""
    parts = F.filter(F.transform(F.split(strip(c), r"\s*#{1,6}\s+"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.array(strip(c)))


def without_artifacts(c: Column) -> Column:
    """A line's text without Markdown's and HTML's signs; null for fences, empty headers, notices, lines of markup alone and page numbers."""
    t = strip(c)
    out = t
    for rx, to in ARTIFACTS:
        out = strip(F.regexp_replace(out, rx, to))
    gone = (t == "") | t.rlike(FENCE) | t.rlike(r"^#{1,6}\s*$") | is_boilerplate(t) | t.rlike(r"(?is)^\s*(?:<div\b|<img\b)")
    return F.when(~gone, let(out, lambda x: F.when((x != "") & ~x.rlike(r"^\d{1,4}$"), x)))


def markdown_lines(texts: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """keys, line_idx, line: recognised Markdown as plain lines: table cells and run-in headers on lines of their own, junk left out."""
    from pyspark.sql import Window as W

    from lexforge.sources.files import split_lines

    raw = texts.select(*keys, F.posexplode(unfenced(split_lines(F.col(text)))).alias("_k", "_raw")).where(~is_boilerplate(F.col("_raw")))
    parts = raw.select(*keys, "_k", F.posexplode(F.coalesce(pipe_cells(F.col("_raw")), header_parts(F.col("_raw")))).alias("_j", "_part"))
    lines = parts.withColumn("_part", without_artifacts(F.col("_part"))).where("_part is not null").withColumn("line", recognised_line(F.col("_part"))).where((F.col("line") != "") & ~F.col("line").rlike(r"^\$+\s*$"))
    return lines.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("_k", "_j")) - 1).cast("int").alias("line_idx"), "line")


#: Patterns of the noise audit.
AUDIT = (
    ("latex_cmd", r"\\[a-zA-Z]{2,}"), ("html_entity", r"&#\w+;|&[a-z]+;"), ("xi_garbage", r"(?i)x<i>\{\d+\}"), ("swastika", "卍{2,}"), ("stray_lt", r"(?i)<(?!(?:/?)(?:b|i)\b|/?N>)"), ("digit_run", r"^\d[\d\s]{79,}$"),
    ("greek_spam", "[\u03a5\u0393]{20,}"), ("char_repeat", r"(.)\1{11,}"), ("modifier", "[\u2070-\u209f]{5,}"), ("checkbox", "☐"), ("replacement", "\ufffd"), ("math_delim", r"\\\(|\\\)|\\\[|\\\]"),
)


def audit_hits(line: Column) -> Column:
    """Names of the audit's patterns that a line holds."""
    return F.array_compact(F.array(*[F.when(line.rlike(rx), F.lit(n)) for n, rx in AUDIT]))


