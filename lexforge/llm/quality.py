"""Problem 8: per-document text statistics and the shape they show (prose, list, table or junk).

Every document is split into chunks of CHUNK code points. Each chunk yields an associative partial state: counts
over its complete lines, plus the unfinished line at either end (its counts, and the whole of the tokens that touch
the cut, however long: a token's figures need all of it). ``merge`` joins two neighbouring states and corrects the
word and the line on the border, so any tree of merges gives the state of the whole text. Neighbouring chunks are
merged where they are read; what a task holds of a document goes on as one state, and states that meet no neighbour
there are merged in order by document. Ratios and rules come from the final state only; there is no other path.

Defined results: null text counts as empty; an empty text has all counts 0 and shape ``junk`` is not
claimed for it (``prose``); repeated doc_ids give one row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import small_rows

#: Code points of a chunk.
CHUNK = 4_096
#: Code points beyond which a document's chunks are spread over tasks before they are counted.
SPREAD = 1_048_576
#: A token beyond this length is figured anew each time, and stands among the distinct ones by its digest.
TOKEN_KEPT = 1_024

WORD = re.compile(r"[^\W\d_]+(?:[’'\-\u0300-\u036f]+[^\W\d_]+)*")
CLEAN = re.compile(r"[^\w\s]*[^\W\d_][^\W\d_\u0300-\u036f]*(?:[’'\-/‐\u00ad\u2060\u200b-\u200f\ufeff\u0300-\u036f]+[^\W\d_]+)*[\u0300-\u036f]*[^\w\s]*|[^\w\s]{0,2}\d[\d.,:\-/–]*[^\w\s]{0,3}|[—–•*\-|→«»]")
MOJI = re.compile("[ÂÃÅÉÊÌÍÎÏÐÑ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
ENDS = re.compile(r"[.!?…][\"»“”’)\]]*$")
BULLET = re.compile(r"^\W{0,2}(?:[-–—•*·▪]|\(?\d{1,4}[.)]|[a-zA-Z][.)])\s")
CELL_JOIN = re.compile(r"[;,|\t](?=\S)")
LEFT = re.compile(r"\s*\S*(?:\s+\S+)?")
GAPS = re.compile(r"(?<=\S) {3,}(?=\S)|^ {3,}(?=\S)")
DECIMAL = re.compile(r"\d,\d")
PAIR = re.compile(r"^\w{1,8}=")
#: Counts of a line: tokens, letters, words, common words, clean tokens, commas and semicolons, cell joints, wide gaps,
#: pipes and tabs, cell tags, key=value tokens, sentence ends inside, numbers, mojibake pairs, symbols, characters, dashes between words, colons, tabs, bars between cells.
N = 20
FIELD, MASK = 24, (1 << 24) - 1
T, LET, WRD, COM, CLN, CMA, JNT, GAP, PIP, TAG, KEY, SEN, NUM, MOJ, SYM, CHR, DSH, COL, TAB, BAR = range(N)
KINDS = ("prose", "item", "table", "junk")


class Tokens(dict):
    """Counts of a token, N fields of FIELD bits in one integer, so that a piece's counts are one sum over its tokens."""

    def __init__(self, common: frozenset):
        self.common = common

    def __missing__(self, w: str) -> int:
        packed = sum(x << (FIELD * i) for i, x in enumerate(self.vector(w)))
        if len(w) <= TOKEN_KEPT:
            if len(self) > 200_000:
                self.clear()
            self[w] = packed
        return packed

    def vector(self, w: str) -> list[int]:
        v = [0] * N
        v[T] = 1
        low = w.lower()
        words = WORD.findall(low)
        v[WRD], v[LET] = len(words), sum(map(len, words))
        v[COM] = sum(1 for x in words if x in self.common)
        v[CLN] = int(w.isalpha() or bool(CLEAN.fullmatch(w)))
        v[KEY] = int("=" in w and bool(PAIR.match(w)))
        if len(w) > 3 and w.rstrip("\"»“”)]").endswith((".", "!", "?", "…")):
            v[SEN] = 1
        elif w[0].isdigit():
            v[NUM] = 1
        v[DSH] = int(w in "—–-")
        v[COL] = int(w[-1] == ":" and len(w) > 1)
        v[CMA] = w.count(",") + w.count(";")
        v[JNT] = len(CELL_JOIN.findall(w)) - len(DECIMAL.findall(w))
        v[PIP] = w.count("|")
        v[BAR] = int(v[PIP] > 0 and not w.strip("|-:"))
        v[TAG] = w.count("<td") + w.count("<tr")
        v[MOJ] = 0 if w.isascii() else len(MOJI.findall(w))
        v[CHR] = len(w)
        v[SYM] = len(w) - sum(map(str.isalnum, w))
        return v


def count(s: str, common: Tokens, bits: set) -> tuple[list[int], set]:
    """The counts of a piece of a line whose tokens are whole and keep the white space before them; adds the tokens to the set."""
    toks = s.split()
    if not toks:
        v = [0] * N
        v[PIP] = v[JNT] = v[TAB] = s.count("\t")
        return v, bits
    bits.update(toks)
    if len(s) <= MASK:
        total = sum(map(common.__getitem__, toks))
        v = [(total >> (FIELD * i)) & MASK for i in range(N)]
    else:  # counts beyond a field's bits
        v = [sum(x) for x in zip(*map(common.vector, toks))]
    if "\t" in s:
        tabs = s.count("\t")
        v[PIP] += tabs
        v[TAB] = tabs
        v[JNT] += tabs
    if "   " in s:
        v[GAP] = len(GAPS.findall(s))
    return v, bits


def add(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def last_token(s: str, least: int) -> int:
    """Where the white space before the last token begins, not before `least`."""
    parts = s[least:].rsplit(None, 1)
    return least + len(parts[0]) if len(parts) > 1 else least


def segment(s: str, common: Tokens, bits: set) -> tuple[list, set]:
    """[left, counts or None, right] of a piece without newline: left ends with the second token, right is the last token with the white space before it."""
    m = LEFT.match(s)
    cut = m.end()
    if cut == len(s):
        return [s, None, ""], bits
    k = last_token(s, cut)
    v, bits = count(s[cut:k], common, bits)
    return [s[:cut], v, s[k:]], bits


def joined(a: list, b: list, common: Tokens, bits: set) -> tuple[list, set]:
    if a[1] is None:
        if b[1] is None:
            return segment(a[0] + b[0], common, bits)
        left, bits = segment(a[0] + b[0], common, bits)
        if left[1] is None:
            return [left[0], b[1], b[2]], bits
        if not b[2].strip():
            return [left[0], left[1], left[2] + b[2]], bits
        # the left side now has a border of its own; its right end is followed by white space
        v, bits = count(left[2], common, bits)
        return [left[0], add(add(left[1], v), b[1]), b[2]], bits
    if b[1] is None or not b[2].strip():
        both = a[2] + b[0] + b[2]
        k = last_token(both, 0)
        v, bits = count(both[:k], common, bits)
        return [a[0], add(a[1], v), both[k:]], bits
    v, bits = count(a[2] + b[0], common, bits)
    return [a[0], add(add(a[1], v), b[1]), b[2]], bits


def line_kind(v: list[int], head: str, tail: str) -> int:
    """The kind (an index of KINDS) of a finished line from its counts, its first and its last characters."""
    n, w = v[T], v[WRD]
    chars = max(1, v[CHR])
    if v[TAG] or v[BAR] >= 2 and v[BAR] * 6 >= n or v[KEY] >= 2 or v[KEY] and v[KEY] >= n - 1:
        return 2
    if v[MOJ] * 2 > chars * 0.06:
        return 3
    if n >= 4 and v[CLN] < 0.6 * n and (v[JNT] < 2 or n > 4 + v[JNT] and not v[TAB]) or v[LET] < 0.3 * chars and v[NUM] * 3 < n and v[SYM] > 0.5 * chars and n > 1:
        return 3
    if v[TAB] or v[GAP] >= 1 and n <= 14 or v[JNT] >= 2 and v[JNT] * 2 >= v[CMA] and n <= (30 if v[TAB] else 4 + v[JNT]):
        return 2
    share = v[COM] / max(1, w)
    if n >= 4 and v[NUM] * 2 >= n:
        return 1
    if v[CMA] * 3.6 >= n and n >= 8 and share < 0.22:
        return 1
    if 3 <= n <= 14 and v[SEN] <= 3 and share < 0.3:
        first = head.split()[:2]
        if len(first) == 2 and first[1][-1] == "." and len(first[1]) <= 7 and first[1][:-1].replace(".", "").isalpha() and first[0][-1] not in ".,;:!?":
            return 1
    short = n <= 3
    marked = bool(BULLET.match(head))
    ended = bool(ENDS.search(tail))
    if (v[DSH] or v[COL]) and n <= 14 and v[SEN] <= 1 and not marked and share < 0.5 and n - v[COM] <= 10:
        first = head.split()[:2]
        if len(first) == 2 and (first[1] in "—–-" or first[0][-1] == ":"):
            return 1
    if marked:
        if n <= 10 and not (v[SEN] and n >= 7 and share > 0.2):
            return 1
    if short:
        return 1
    if n <= 9 and share <= 0.15 and (not ended or v[SEN] > 1):
        return 1
    return 0


def put(acc: list[int], v: list[int], head: str, tail: str) -> None:
    k = line_kind(v, head, tail)
    acc[0] += 1
    acc[1] += bool(ENDS.search(tail))
    acc[2 + 2 * k] += 1
    acc[3 + 2 * k] += v[T]
    acc[10:] = map(int.__add__, acc[10:], v)


def close(acc: list[int], seg: list, common: Tokens, bits: set) -> set:
    """Adds a finished line to the document's counts; returns the words seen."""
    v, bits = count(seg[0], common, bits)
    head, tail = seg[0], seg[0]
    if seg[1] is not None:
        r, bits = count(seg[2], common, bits)
        v = add(add(v, seg[1]), r)
        head, tail = seg[0] + " x", (seg[2] if seg[2].strip() else seg[0])
    if v[T]:
        put(acc, v, head.lstrip(), tail.rstrip())
    return bits


def scan(text: str, common: Tokens) -> list:
    """The state of a text or chunk: [counts of closed lines, head, tail or None, words seen]. tail None: no newline inside."""
    acc, bits = [0] * (10 + N), set()
    lines = text.split("\n")
    head, bits = segment(lines[0], common, bits)
    if len(lines) == 1:
        return [acc, head, None, bits]
    for line in lines[1:-1]:
        if line and (v := count(line, common, bits)[0])[T]:
            put(acc, v, line.lstrip(), line.rstrip())
    tail, bits = segment(lines[-1], common, bits)
    return [acc, head, tail, bits]


def merge(a: list, b: list, common: Tokens) -> list:
    """The state of two neighbouring pieces; associative."""
    acc, bits = add(a[0], b[0]), a[3] | b[3]
    if a[2] is None:
        head, bits = joined(a[1], b[1], common, bits)
        return [acc, head, b[2], bits]
    mid, bits = joined(a[2], b[1], common, bits)
    if b[2] is None:
        return [acc, a[1], mid, bits]
    bits = close(acc, mid, common, bits)
    return [acc, a[1], b[2], bits]


def finish(state: list, common: Tokens) -> dict:
    """Figures and shape of a whole document."""
    acc, bits = list(state[0]), state[3]
    bits = close(acc, state[1], common, bits)
    if state[2] is not None:
        bits = close(acc, state[2], common, bits)
    return derive(acc, bits)


def derive(acc: list[int], bits: set) -> dict:
    c = acc[10:]
    kinds = {k: acc[3 + 2 * i] for i, k in enumerate(KINDS)}
    lines_of = {k: acc[2 + 2 * i] for i, k in enumerate(KINDS)}
    n, w, chars = c[T], c[WRD], max(1, c[CHR])
    distinct = len(places(bits))
    out = {
        "lines": acc[0], "words": w, "mean_word_length": c[LET] / max(1, w), "symbol_ratio": c[SYM] / chars,
        "line_end_ratio": acc[1] / max(1, acc[0]), "common_ratio": c[COM] / max(1, w), "distinct_words": distinct,
        "tokens": n, "shape": "prose",
    }
    stops, marks = c[SEN], c[CMA] + c[COL]
    if not n:
        pass
    elif n >= 8 and distinct < min(n / 3, max(4, 2.4 * n**0.5)):
        out["shape"] = "junk"
    elif c[MOJ] * 2 > 0.06 * chars or kinds["junk"] * 2 > n:
        out["shape"] = "junk"
    elif c[SYM] > 0.6 * chars and c[NUM] * 4 < n and not c[TAG] and c[PIP] < n:
        out["shape"] = "junk"
    elif n >= 20 and kinds["prose"] * 2 > n and not stops and marks * 50 < n and n > 11 * acc[0]:
        out["shape"] = "junk"
    elif kinds["prose"] * 2 < n:
        lists, tables = kinds["item"], kinds["table"]
        out["shape"] = "table" if tables >= lists else "list"
    return out


def places(tokens: set) -> set:
    """The distinct words of tokens: small letters, and a digest after a space for those beyond TOKEN_KEPT; what is in this form stays."""
    return {low if len(low := w.lower()) <= TOKEN_KEPT else " " + hashlib.blake2b(low.encode("utf-8", "replace"), digest_size=16).hexdigest() for w in tokens}


def pack(state: list) -> dict:
    seg = lambda s: None if s is None else {"left": s[0], "counts": s[1], "right": s[2]}
    return {"acc": state[0], "head": seg(state[1]), "tail": seg(state[2]), "map": sorted(places(state[3]))}


def unpack(row: dict) -> list:
    seg = lambda s: None if s is None else [s["left"], None if s["counts"] is None else list(s["counts"]), s["right"]]
    return [list(row["acc"]), seg(row["head"]), seg(row["tail"]), set(row["map"])]


def combined(states: list[list], common: Tokens) -> list:
    """The state of states in order, merged in pairs, so that what a border carries isn't copied once a chunk."""
    while len(states) > 1:
        states = [merge(*states[i : i + 2], common) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


def figures(text: str, common: Tokens, chunk: int = CHUNK) -> dict:
    """Figures and shape of a text, by the states of its chunks."""
    return finish(combined([scan(text[i : i + chunk], common) for i in range(0, len(text), chunk)] or [scan("", common)], common), common)


SEG = pa.struct([("left", pa.string()), ("counts", pa.list_(pa.int64())), ("right", pa.string())])
SEG_SQL = "struct<left:string,counts:array<bigint>,right:string>"
FIGURES = pa.schema(
    [("lines", pa.int64()), ("words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("line_end_ratio", pa.float64()), ("common_ratio", pa.float64()), ("distinct_words", pa.int64()), ("tokens", pa.int64()), ("shape", pa.string())]
)
STATE = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("last", pa.int64()), ("parts", pa.int64()), *FIGURES, ("acc", pa.list_(pa.int64())), ("head", SEG), ("tail", SEG), ("map", pa.list_(pa.string()))])
STATE_SQL = f"doc_id bigint, part bigint, last bigint, parts bigint, lines bigint, words bigint, mean_word_length double, symbol_ratio double, line_end_ratio double, common_ratio double, distinct_words bigint, tokens bigint, shape string, acc array<bigint>, head {SEG_SQL}, tail {SEG_SQL}, map array<string>"
NOTHING = dict.fromkeys(FIGURES.names) | {"acc": None, "head": None, "tail": None, "map": None}


def text_quality(docs: DataFrame, common_words: DataFrame, chunk: int = CHUNK, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures a document (FIGURES), and the shape they show.

    docs: id_col, text_col. common_words: a fixed table (word). Chunks of documents beyond `spread` code points are
    spread over all tasks; that decides where a chunk is counted, not how.
    """
    words = frozenset(r[0].lower() for r in small_rows(common_words.select("word").where("word is not null").distinct(), "common_words"))
    common = Tokens(words)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in rows], f.type) for f in STATE}, schema=STATE)

    def row(doc: int, part: int, last: int, parts: int, states: list[list]) -> dict:
        """A whole document's figures, or the state of chunks part to last."""
        state = combined(states, common)
        at = {"doc_id": doc, "part": part, "last": last, "parts": parts}
        return NOTHING | at | (finish(state, common) if part == 0 and last == parts - 1 else pack(state))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks to states; those that follow each other are merged."""
        for b in batches:
            out: list[dict] = []
            run: list = []  # document, first and last chunk, chunks of the document, states
            for doc, part, parts, text in zip(*(c.to_pylist() for c in b.columns)):
                state = scan(text, common)
                if run and run[0] == doc and run[2] == part - 1:
                    run[2] = part
                    run[4].append(state)
                    continue
                if run:
                    out.append(row(*run))
                run = [doc, part, part, parts, [state]]
            if run:
                out.append(row(*run))
            yield batch(out)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of documents and chunks: figures stay, states are merged. Another delivery of the same chunks is passed over."""
        done: object = NOTHING
        doc, upto, stack = done, 0, []  # stack: (number of chunks, state), the numbers falling, as in a binary counter
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                if r["doc_id"] != doc:
                    doc, upto, stack = r["doc_id"], 0, []
                if upto == r["parts"] or r["part"] != upto:
                    continue
                upto = r["last"] + 1
                if r["lines"] is not None:
                    out.append(r)
                    continue
                stack.append((upto - r["part"], unpack(r)))
                while len(stack) > 1 and (stack[-2][0] <= stack[-1][0] or upto == r["parts"]):
                    (m, x), (n, y) = stack[-2:]
                    stack[-2:] = [(m + n, merge(x, y, common))]
                if upto == r["parts"]:
                    out.append(NOTHING | {"doc_id": doc} | finish(stack[0][1], common))
                    stack = []
            yield batch([dict.fromkeys(STATE.names) | x for x in out])

    parts = f"greatest(1, ceil(length(text) / {chunk}))"
    big = chunk * 128
    short = docs.where(F.length("text") <= spread).selectExpr("doc_id", f"cast({parts} as bigint) as parts", f"posexplode(transform(sequence(0, cast({parts} - 1 as int)), i -> substring(text, cast(i * {chunk} + 1 as int), {chunk}))) as (q, text)").selectExpr("doc_id", "cast(q as bigint) as part", "parts", "text")
    long = (
        docs.where(F.length("text") > spread)
        .selectExpr("doc_id", f"cast({parts} as bigint) as parts", f"posexplode(transform(sequence(0, (length(text) - 1) div {big}), i -> substring(text, cast(i * {big} + 1 as int), {big}))) as (p, text)")
        .repartition("doc_id", "p")
        .selectExpr("doc_id", "p", "parts", f"posexplode(transform(sequence(0, (length(text) - 1) div {chunk}), i -> substring(text, cast(i * {chunk} + 1 as int), {chunk}))) as (q, text)")
        .selectExpr("doc_id", "cast(p * 128 + q as bigint) as part", "parts", "text")
    )
    states = short.unionByName(long).mapInArrow(counted, STATE_SQL)
    # of chunks delivered twice the longest run comes first; a run of the other delivery goes on where it ends
    ordered = states.repartition("doc_id").sortWithinPartitions("doc_id", "part", F.col("last").desc())
    return ordered.mapInArrow(merged, STATE_SQL).select("doc_id", *FIGURES.names)


def shapes_found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """p8_found: doc_id, shape of the documents that mostly aren't running prose."""
    return text_quality(docs, common_words).where("shape <> 'prose'").select("doc_id", "shape")
