"""Problem 4: one plain spelling for text that looks the same but differs in its characters.

The skeleton of a word is: decompose, replace every character by the prototype of its look-alikes,
decompose again. Words with one skeleton look alike. The plain spelling of a text is: invisible characters
removed, wide forms and ligatures narrowed, every space an ordinary one, accents composed, and each word's
letters from one alphabet: the one most of its letters that have no look-alike belong to. A word written
wholly in letters that another alphabet shares is judged by the forms of its skeleton group: counted over the
dictionary's rows, an alphabet's form that is PREVAILS times as frequent as the word's own tells the alphabet
(`group_cases`); a word of an alphabet that the dictionary doesn't use is Latin; any other stays as it is.

Defined results: null and empty texts are no cases; raised digits, quotation marks and dashes stay; repeated
rows give one result; other columns are ignored; text in an alphabet outside the table keeps its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the Cyrillic and Greek alphabets by the Latin letter they look like.
LOOKALIKES = {
    "a": "аα", "b": "Ьь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "ə": "ә", "ɛ": "ε", "ʊ": "", "ɔ": "ͻ", "œ": "", "æ": "ӕ",
    "ö": "ӧ", "ä": "ӓ", "ë": "ё", "ï": "ї", "ü": "", "ÿ": "ӱ", "ӱ": "ӱ",
}
#: Pairs of the table that are told apart in print; they are look-alikes for the skeleton only, not for respelling.
FAINT = frozenset("Ььικυνωχγε")
#: Greek letters that are letters of the phonetic alphabet.
PHONETIC_GREEK = frozenset("θβχɸ")
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff"
WIDE = "\uff01-\uffee\ufb00-\ufb06"
ODD = re.compile(f"[{SPACES}{INVISIBLE}{WIDE}]")
END_SOFT = re.compile("\u00ad(?=\\s*(?:\n|$))")
HIDDEN = re.compile(f"[{INVISIBLE}]")
GAP = re.compile(f"[{SPACES}]")
WIDES = re.compile(f"[{WIDE}]")
PART = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
PROTOTYPE = {c: latin for latin, others in LOOKALIKES.items() for c in others}
#: Letters of the Cyrillic alphabets in use here that have a Latin look-alike.
CYRILLIC = frozenset("асеорхуАВСЕНКМОРТХ")
TO_CYRILLIC = {PROTOTYPE[c]: c for c in sorted(CYRILLIC, reverse=True)}
#: Letters that look-alikes have in common, without accents, and how many times as frequent a group's prevailing form is.
SHARED, PREVAILS = "".join(sorted({unicodedata.normalize("NFD", c)[0] for pair in PROTOTYPE.items() for c in pair if c})), 10
SHARED_WORD = re.compile(rf"(?<![^\W\d_])(?<![\u0300-\u036f])[{SHARED}][{SHARED}\u0300-\u036f]*(?![^\W\d_]|[\u0300-\u036f])")
#: Groups that a task counts before it passes them on.
HELD = 50_000
TO_GREEK = {latin: c for latin, others in LOOKALIKES.items() for c in others if "\u0370" <= c <= "\u03ff"}


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF or 0x250 <= o <= 0x2AF or 0x1D00 <= o <= 0x1DBF:
        return "L"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G"
    if 0x400 <= o <= 0x52F:
        return "C"
    return ""


def skeleton(s: str) -> str:
    """Decomposed, each character its prototype, decomposed again; case is kept."""
    d = unicodedata.normalize("NFD", HIDDEN.sub("", unicodedata.normalize("NFKC", s)))
    return unicodedata.normalize("NFD", "".join(PROTOTYPE.get(c, c) for c in d))


def respell(word: str, to: str) -> str | None:
    """The word with all look-alikes in alphabet `to` (L, C or G); None if some letter has none."""
    out = []
    for c in word:
        k = script(c)
        if k == to or not k or unicodedata.combining(c) or to == "L" and c in PHONETIC_GREEK:
            out.append(c)
            continue
        base = c if k == "L" else PROTOTYPE.get(c)
        got = base if to == "L" else (TO_CYRILLIC if to == "C" else TO_GREEK).get(base or "")
        if not got:
            return None
        out.append(got)
    return "".join(out)


@lru_cache(maxsize=200_000)
def plain_word(word: str) -> tuple[str, str]:
    """(plain spelling, doubt): doubt is the word's alphabet if another could have the same look throughout, else ''."""
    w = unicodedata.normalize("NFC", WIDES.sub(lambda m: unicodedata.normalize("NFKC", m[0]), HIDDEN.sub("", word)))
    kinds: dict[str, int] = {}
    firm: dict[str, int] = {}
    base = unicodedata.normalize("NFD", w)
    for c in base:
        k = script(c)
        if not k or unicodedata.combining(c):
            continue
        kinds[k] = kinds.get(k, 0) + 1
        if k == "L" and c not in TO_CYRILLIC and c not in TO_GREEK or k != "L" and (c not in PROTOTYPE):
            firm[k] = firm.get(k, 0) + 1
    if len(kinds) > 1 and set(kinds) == {"L", "G"} and all(c in PHONETIC_GREEK for c in w if script(c) == "G"):
        return w, ""
    if len(kinds) > 1:
        order = sorted(kinds, key=lambda k: (-(firm.get(k, 0) - (sum(c in PHONETIC_GREEK for c in w) if k == "G" else 0)), -kinds[k]))
        for k in order:
            got = respell(w, k)
            if got is not None:
                return unicodedata.normalize("NFC", got), ""
        return w, ""
    if len(kinds) == 1 and not firm:
        k = next(iter(kinds))
        return w, k
    return w, ""


def plain(text: str, scripts: str = "") -> tuple[str, list[tuple[str, str]]]:
    """(plain spelling of a text, its doubtful words with their alphabet). A soft hyphen at a line's end shows as a hyphen and stays."""
    if text.isascii():
        return text, []
    t = text
    if ODD.search(t):
        kept = END_SOFT.sub("\ue000", t)
        t = WIDES.sub(lambda m: unicodedata.normalize("NFKC", m[0]), GAP.sub(" ", HIDDEN.sub("", kept))).replace("\ue000", "\u00ad")
    if not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    doubts: list[tuple[str, str]] = []
    out, last = [], 0
    for m in PART.finditer(t):
        w = m[0]
        if w.isascii():
            continue
        p, doubt = plain_word(w)
        if doubt and doubt != "L":
            doubts.append((w, doubt))
        if p != w:
            out.append(t[last : m.start()])
            out.append(p)
            last = m.end()
    if out:
        t = "".join(out) + t[last:]
    return t, doubts


@lru_cache(maxsize=200_000)
def shared_word(word: str) -> tuple[str, str, str]:
    """(skeleton, alphabet, other alphabets it can be spelled in) of a decomposed word of shared letters; alphabet '' if it has several."""
    kinds = {k for c in word if not unicodedata.combining(c) and (k := script(c))}
    if len(kinds) != 1:
        return "", "", ""
    k = kinds.pop()
    return skeleton(word), k, "".join(to for to in "CGL" if to != k and respell(word, to))


def alphabets(dictionaries: DataFrame) -> dict[str, str]:
    """Alphabets (L, C, G) that a dictionary's languages are written in; the table is fixed in size, which is checked."""
    from lexforge.session import small_rows

    kinds = {"Latin": "L", "IPA": "L", "Cyrillic": "C", "Greek": "G"}
    out = {}
    for r in small_rows(dictionaries.select("dictionary", "source_label", "target_labels"), "dictionaries"):
        out[r[0]] = "".join(sorted({kinds.get((x or "").rpartition("-")[2], "") for x in [r[1], *(r[2] or [])]}))
    return out


def judged(text: str, allowed: str | None) -> tuple[str, bool]:
    """(plain spelling, whether the text differs from it). Words wholly in look-alikes of an alphabet the dictionary doesn't use are respelled in Latin."""
    p, doubts = plain(text)
    if allowed:
        for w, k in doubts:
            if k not in allowed and (got := respell(w, "L")) and got != w:
                p = p.replace(w, got)
    return p, p != text


def respelled(rows: DataFrame, dictionaries: DataFrame, only_cases: bool = False) -> DataFrame:
    """rows: row_id, dictionary, text -> row_id, plain, differs. only_cases leaves out texts that are plain already (and `plain`)."""
    allowed = rows.sparkSession.sparkContext.broadcast(alphabets(dictionaries))
    rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("dictionary").cast("string"), F.col("text").cast("string")).where("text is not null")
    if only_cases:
        rows = rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))  # an ASCII text is plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = allowed.value
        for b in batches:
            ids, names, texts = (c.to_pylist() for c in b.columns)
            got = [judged(t, by.get(d)) for d, t in zip(names, texts)]
            if only_cases:
                yield pa.RecordBatch.from_pydict({"row_id": pa.array([i for i, g in zip(ids, got) if g[1]], pa.int64())})
            else:
                yield pa.RecordBatch.from_pydict({"row_id": pa.array(ids, pa.int64()), "plain": pa.array([g[0] for g in got], pa.string()), "differs": pa.array([g[1] for g in got], pa.bool_())})

    return rows.mapInArrow(run, "row_id bigint" if only_cases else "row_id bigint, plain string, differs boolean")


def look_alike_groups(rows: DataFrame) -> DataFrame:
    """dictionary, skeleton, forms, occurrences, plain_form: words of rows (row_id, dictionary, text) that share a skeleton in more than one form.

    Words are counted before the shuffle on the skeleton, so a frequent word is one row a task.
    """

    @F.pandas_udf("string")
    def skeletons(s):  # noqa: ANN001, ANN202
        return s.map(skeleton)

    words = rows.where("text is not null").select("dictionary", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}­​-‏⁠﻿]+)"), 1)).alias("word"))
    forms = words.groupBy("dictionary", "word").count().withColumn("skeleton", skeletons("word"))
    return (
        forms.groupBy("dictionary", "skeleton")
        .agg(F.count("*").alias("forms"), F.sum("count").alias("occurrences"), F.max_by("word", F.struct("count", "word")).alias("plain_form"))
        .where("forms > 1")
    )


def spelling_sources(tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """(table name, row_id, dictionary, text) of the three texts of the problem."""
    return [
        ("field_lines", tables["field_lines"].selectExpr("line_id as row_id", "dictionary", "value as text")),
        ("mdf_value_projections", tables["mdf_value_projections"].selectExpr("value_id as row_id", "dictionary", "normalized_value as text")),
        ("stage1_projections", tables["stage1_projections"].selectExpr("stage1_id as row_id", "dictionary", "text")),
    ]


def group_cases(found: DataFrame) -> DataFrame:
    """table_name, row_id of the texts with a word whose skeleton group prevails in another alphabet that the word can be spelled in.

    found: word_rows. Forms are counted by dictionary and skeleton; a word is a case if the form that prevails is PREVAILS times as frequent.
    """
    forms = found.where("skeleton is not null").groupBy("dictionary", "skeleton", "kind").agg(F.sum("n").alias("n"))
    top = forms.groupBy("dictionary", "skeleton").agg(F.max_by("kind", F.struct("n", "kind")).alias("to"), F.max("n").alias("most"))
    odd = forms.join(top, ["dictionary", "skeleton"]).where((F.col("kind") != F.col("to")) & (F.col("most") >= PREVAILS * F.col("n"))).select("dictionary", "skeleton", "kind", "to")
    words = found.where("row_id is not null and skeleton is not null")
    return words.join(odd, ["dictionary", "skeleton", "kind"]).where("contains(others, to)").select("table_name", "row_id")


def word_rows(name: str, rows: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """table_name, row_id, dictionary, skeleton, kind, others, n: texts that differ from their plain spelling by their own letters
    (skeleton null), words of shared letters that another alphabet of the dictionary could spell, and counts of the other ones (row_id null)."""
    by = rows.sparkSession.sparkContext.broadcast(allowed)
    rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("dictionary").cast("string"), F.col("text").cast("string")).where("text is not null")
    # an ASCII text is plain by its letters, and by its groups too where its dictionary is in Latin alone
    several = [d for d, k in allowed.items() if d is not None and k not in ("", "L")]
    rows = rows.where(F.col("text").rlike(r"[^\x00-\x7f]") | F.coalesce(F.col("dictionary").isin(several), F.lit(False)))

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: pa.array(x, f.type) for f, x in zip(WORD_ROWS, zip(*out) if out else [[]] * len(WORD_ROWS))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for b in batches:
            out = []
            for i, d, t in zip(*(c.to_pylist() for c in b.columns)):
                used = by.value.get(d, "")
                p, differs = judged(t, used)
                if differs:
                    out.append((name, i, d, None, None, None, 1))
                if used in ("", "L"):
                    continue
                for w in set(SHARED_WORD.findall(p if p.isascii() else unicodedata.normalize("NFD", p))):
                    key, kind, others = shared_word(w)
                    if not kind:
                        continue
                    others = "".join(k for k in others if k in used)
                    if others:
                        out.append((name, i, d, key, kind, others, 1))
                    else:
                        held[d, key, kind] = held.get((d, key, kind), 0) + 1
            if len(held) > HELD:
                out += [(name, None, *k, "", n) for k, n in held.items()]
                held = {}
            yield batch(out)
        yield batch([(name, None, *k, "", n) for k, n in held.items()])

    return rows.mapInArrow(run, "table_name string, row_id bigint, dictionary string, skeleton string, kind string, others string, n bigint")


WORD_ROWS = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("dictionary", pa.string()), ("skeleton", pa.string()), ("kind", pa.string()), ("others", pa.string()), ("n", pa.int64())])


def spelling_found(tables: dict[str, DataFrame]) -> DataFrame:
    """p4_found: table_name, row_id of the texts that look like their plain spelling and differ from it, by their letters or by their words' groups."""
    from lexforge.session import checkpoint_dir

    allowed = alphabets(tables["dictionaries"])
    found = None
    for name, rows in spelling_sources(tables):
        got = word_rows(name, rows, allowed)
        found = got if found is None else found.unionByName(got)
    checkpoint_dir(found.sparkSession)
    found = found.checkpoint()  # read three times below; texts are analysed once
    return found.where("skeleton is null").select("table_name", "row_id").unionByName(group_cases(found)).distinct()
