"""Problem 6: passages of evaluation texts inside training documents.

Documents are read in shards of words; each shard gets an FM-index over its word symbols (suffix array, BWT, a
wavelet matrix for ranks, sampled suffix positions). Phrases of the items are searched backwards in all shards at
once; their occurrences are located from the sampled positions. Every passage of an item is covered by one of two
kinds of phrases: PHRASE words with a rare word, where a passage has two telling words (rare ones and numbers);
the passage itself, all LEAST words of it, where it hasn't. Where phrases with at least two telling words of an item
lie close together, the passage is aligned with the item exactly (a banded alignment), and what reaches LEAST
running words with few errors is a leak; a whole phrase of LEAST words is one as it stands. Spans are for removal.

A word is rare if few different items hold it (RARE of them, or one in RARE_SHARE), so that copies of an item
under other ids and larger collections change nothing.

Words are compared by the skeleton of their letters without case and punctuation, so spacing, case, punctuation and
character forms don't matter. Words outside the items' vocabulary are one symbol, as no phrase holds them.

Defined results: null and empty texts give nothing; a document given twice gives its rows once; items shorter than
LEAST words can't leak; other columns are ignored. Items are searched in blocks of BLOCK, each of which is sent to
the executors; every further block reads the documents once more.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.spelling import skeleton
from lexforge.session import small_rows

PHRASE = 4
#: A word is rare if no more different items than this hold it, or no more than one item in RARE_SHARE.
RARE, RARE_SHARE = 4, 80
#: Items that are searched at once.
BLOCK = 20_000
#: Running words of an item that make a passage.
LEAST = 20
#: Words of a shard.
SHARD = 600_000
#: Every so many text positions keep their suffix.
SAMPLED = 8
#: Score of an error in the alignment; a match scores 1.
ERROR = -4
BAND = 10
#: Share of the rare words and numbers of a passage that must be in the document.
KEPT = 0.6
#: Passages below SHORT words must keep more of them, as sentences of one build share their other words.
SHORT, KEPT_SHORT = 26, 0.7
#: Words of LEAST that may be garbled or dropped.
MISSED = 3
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"\S+")
OTHER = 1


def word_key(token: str) -> str:
    w = token if token.isascii() else skeleton(token)
    return OUTER.sub("", w.casefold())


class WaveletMatrix:
    """Ranks of symbols in a sequence; one bit plane with prefix counts for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            zeros = seq[bit == 0]
            self.zeros.append(len(zeros))
            seq = np.concatenate([zeros, seq[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place, less those of the symbol's start in the last plane."""
        start = np.zeros_like(at)
        for n, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[n], self.zeros[n]
            bit = (symbols >> level) & 1
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            start = np.where(bit == 1, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for n in range(self.bits):
            ones, zeros = self.ones[n], self.zeros[n]
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only groups that aren't told apart yet are sorted again. The last symbol must be the only 0."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    vals = seq[sa]
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(vals[1:], vals[:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while True:
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        open_ = np.flatnonzero(~(head & tail))
        if not len(open_):
            return sa
        at = sa[open_]
        first = rank[at]
        key = rank[np.minimum(at + h, n - 1)]
        order = np.lexsort((key, first))
        at, first, key = at[order], first[order], key[order]
        sa[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (key[1:] != key[:-1])
        head[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


class FMIndex:
    """Backward search over a sequence of word symbols; symbol 0 ends it."""

    def __init__(self, seq: np.ndarray, size: int):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n = len(seq)
        self.tree = WaveletMatrix(bwt, size)
        self.before = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=size), out=self.before[1:])
        kept = sa % SAMPLED == 0
        self.kept_before = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept_before[1:])
        self.positions = sa[kept].astype(np.int64)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase (rows of word symbols)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled suffix is met."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            kept = self.kept_before[rows + 1] > self.kept_before[rows]
            out[open_[kept]] = self.positions[self.kept_before[rows[kept]]] + steps
            open_, rows = open_[~kept], rows[~kept]
            if len(rows):
                c = self.tree.access(rows)
                rows = self.before[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """Different phrases of n words, and the items and places that each one stands at."""

    def __init__(self, found: dict[tuple, list[tuple[int, int]]], n: int):
        self.words = np.array(list(found), np.int64).reshape(-1, n)
        places = list(found.values())
        self.counts = np.array([len(x) for x in places], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.item = np.array([k for x in places for k, _ in x], np.int64)
        self.at = np.array([q for x in places for _, q in x], np.int64)

    def seeds(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every occurrence."""
        lo, hi = index.search(self.words)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return (np.zeros(0, np.int64),) * 3
        counts = (hi - lo)[hit]
        rows = np.repeat(lo[hit], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        at = index.locate(rows)
        which = np.repeat(hit, counts)
        many = self.counts[which]
        seed = np.repeat(np.arange(len(which)), many)
        flat = self.starts[which][seed] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        return at[seed], self.item[flat], self.at[flat]


class Items:
    """The items' words as symbols, their phrases, and where these stand.

    shared: words that are too frequent among the items to be rare.
    """

    def __init__(self, items: list[tuple[int, str]], shared: frozenset):
        self.ids = [i for i, _ in items]
        words = [[w for w in map(word_key, (t or "").split()) if w] for _, t in items]
        self.symbol: dict[str, int] = {}
        for ws in words:
            for w in ws:
                self.symbol.setdefault(w, len(self.symbol) + 2)
        self.size = len(self.symbol) + 2
        self.words = [np.array([self.symbol[w] for w in ws], np.int64) for ws in words]
        self.rare = np.zeros(self.size, bool)
        for w, x in self.symbol.items():
            self.rare[x] = w not in shared and not w.isdigit()
        #: Words that tell sentences of one build apart: rare ones and numbers.
        self.telling = self.rare.copy()
        for w, x in self.symbol.items():
            if any(c.isdigit() for c in w):
                self.telling[x] = True
        phrases: dict[tuple, list[tuple[int, int]]] = {}
        passages: dict[tuple, list[tuple[int, int]]] = {}
        for k, ws in enumerate(self.words):
            if len(ws) < LEAST:
                continue
            for p in range(len(ws) - PHRASE + 1):
                part = ws[p : p + PHRASE]
                if self.rare[part].any():
                    phrases.setdefault(tuple(part.tolist()), []).append((k, p))
            tell = np.cumsum(np.append(0, self.telling[ws]))
            for p in np.flatnonzero(tell[LEAST:] - tell[:-LEAST] < 2).tolist():
                passages.setdefault(tuple(ws[p : p + LEAST].tolist()), []).append((k, p))
        self.phrases = Phrases(phrases, PHRASE)
        self.passages = Phrases(passages, LEAST)
        self.cache: dict[str, int] = {}

    def promising(self, k: int, at: np.ndarray) -> bool:
        """Some LEAST words of the item have half of their telling words, two or more, in the seeds found at these places."""
        ws = self.words[k]
        found = np.zeros(len(ws), bool)
        for q in range(PHRASE):
            found[at + q] = True
        tell = self.telling[ws]
        have = np.cumsum(np.append(0, found & tell))
        all_ = np.cumsum(np.append(0, tell))
        n = min(LEAST, len(ws))
        h, t = have[n:] - have[:-n], all_[n:] - all_[:-n]
        return bool(((h >= 2) & (2 * h >= t)).any())

    def symbols(self, text: str) -> array:
        """A symbol for each word; a huge text is gone through token by token, without a list of all its tokens."""
        cache, out = self.cache, array("i")
        for t in text.split() if len(text) < 4_000_000 else (m[0] for m in TOKEN.finditer(text)):
            s = cache.get(t)
            if s is None:
                w = word_key(t)
                s = self.symbol.get(w, OTHER) if w else 0
                if len(cache) > 500_000:
                    cache.clear()
                cache[t] = s
            if s:
                out.append(s)
        return out


def aligned(item: list[int], doc: list[int], shift: int) -> tuple[int, int, int, int, int]:
    """(item words, errors, first item word, first and last document word) of the best passage: a local alignment within BAND of a diagonal."""
    n, m = len(item), len(doc)
    width = 2 * BAND + 1
    prev = [(0, 0, 0, 0)] * (width + 2)  # score, first item word, first document word, errors
    best = (0, 0, 0, 0, 0, 0)
    for i in range(n):
        a = item[i]
        base = i + shift - BAND
        row = [(0, 0, 0, 0)] * (width + 2)
        for b in range(width):
            j = base + b
            if j < 0 or j >= m:
                continue
            s, fi, fj, e = prev[b + 1]
            if s <= 0:
                s, fi, fj, e = 0, i, j, 0
            hit = a == doc[j] and a != OTHER
            top = (s + 1, fi, fj, e) if hit else (s + ERROR, fi, fj, e + 1)
            if not hit:
                up, left = prev[b + 2], row[b]
                if up[0] + ERROR > top[0]:
                    top = (up[0] + ERROR, up[1], up[2], up[3] + 1)
                if left[0] + ERROR > top[0]:
                    top = (left[0] + ERROR, left[1], left[2], left[3] + 1)
            if top[0] > 0:
                row[b + 1] = top
                if top[0] > best[0]:
                    best = (top[0], top[1], top[2], top[3], i, j)
        prev = row
    s, fi, fj, e, li, lj = best
    return (li - fi + 1 if s else 0, e, fi, fj, lj)


def near_enough(item: np.ndarray, doc: np.ndarray, shift: int) -> bool:
    """Some LEAST words of the item stand in the document, all but MISSED, each within three words of the diagonal. Any passage that is aligned with fewer errors does."""
    met = np.zeros(len(item), bool)
    for t in range(shift - 3, shift + 4):
        a, b = max(0, -t), min(len(item), len(doc) - t)
        if a < b:
            met[a:b] |= item[a:b] == doc[a + t : b + t]
    c = np.cumsum(np.append(0, met))
    return len(item) >= LEAST and bool((c[LEAST:] - c[:-LEAST] >= LEAST - MISSED).any())


def unbroken(item: np.ndarray, doc: np.ndarray, shift: int) -> int:
    """The most running words of the item that stand in the document as they are, within BAND of the diagonal."""
    most = 0
    for t in range(shift - BAND, shift + BAND + 1):
        a, b = max(0, -t), min(len(item), len(doc) - t)
        if b - a > most:
            other = np.flatnonzero(item[a:b] != doc[a + t : b + t])
            most = max(most, int(np.diff(np.concatenate([[-1], other, [b - a]])).max()) - 1)
    return most


def leaks(docs: list[tuple[int, array, int]], items: Items) -> list[tuple[int, int, int, int, int, int, float]]:
    """(document, item, item words, errors, first, last document word, share of telling words kept) of candidates in a shard of (document, symbols, words before them), aligned."""
    starts = np.cumsum([0] + [len(s) + 1 for _, s, _ in docs])
    seq = np.full(starts[-1], OTHER, np.int64)
    for (_, s, _), at in zip(docs, starts):
        seq[at : at + len(s)] = s
    if not len(seq) or not len(items.phrases.words) + len(items.passages.words):
        return []
    index = FMIndex(seq, items.size)

    def placed(phrases: Phrases) -> tuple:
        """Document, item, place in the item and shift between the two of every seed, in order."""
        at, item, p = phrases.seeds(index)
        d = np.searchsorted(starts, at, "right") - 1
        shift = at - starts[d] - p
        order = np.lexsort((p, shift, item, d))
        return d[order], item[order], p[order], shift[order]

    out = []
    # whole passages: those of one shift that overlap are one
    d, item, p, shift = placed(items.passages)
    if len(d):
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (p[1:] - p[:-1] > LEAST)
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), (np.append(first[1:], len(d)) - 1).tolist()):
            i, _, before = docs[d[a]]
            out.append((i, items.ids[item[a]], int(p[b] - p[a]) + LEAST, 0, before + int(p[a] + shift[a]), before + int(p[b] + shift[b]) + LEAST - 1, 1.0))
    d, item, p, shift = placed(items.phrases)
    if not len(d):
        return out
    # runs of seeds of a document and item whose shifts follow each other closely
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > 2)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d))
    done: dict[tuple[int, int], list[int]] = {}
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        k = int(item[a])
        if not items.promising(k, p[a:b]):
            continue
        key, s = (int(d[a]), k), int(np.median(shift[a:b]))
        if any(abs(s - t) <= BAND // 2 for t in done.get(key, ())):
            continue
        done.setdefault(key, []).append(s)
        if not near_enough(items.words[k], seq[starts[key[0]] : starts[key[0]] + len(docs[key[0]][1])], s):
            continue
        ws = items.words[k].tolist()
        words, errors, fi, fj, lj = aligned(ws, docs[key[0]][1], s)
        if words:
            telling = [w for w in ws[fi : fi + words] if items.telling[w]]
            there = set(docs[key[0]][1][fj : lj + 1])
            before = docs[key[0]][2]
            share = sum(w in there for w in telling) / max(1, len(telling))
            if share < KEPT_SHORT and unbroken(items.words[k], seq[starts[key[0]] : starts[key[0]] + len(docs[key[0]][1])], s) >= LEAST:
                share = 1.0  # a passage stands there word by word, whatever follows it
            out.append((docs[key[0]][0], items.ids[k], words, errors, before + fj, before + lj, share))
    return out


SPANS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("errors", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])
SPANS_SQL = "doc_id bigint, item_id bigint, item_words int, errors int, first_word int, last_word int"


def shared_words(items: DataFrame) -> frozenset:
    """Words that more than RARE different items hold, and more than one in RARE_SHARE: at most RARE_SHARE times the mean words of an item, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], []]
            for t in b.column(0).to_pylist():
                ws = [w for w in map(word_key, t.split()) if w]
                key = int.from_bytes(hashlib.blake2b(" ".join(ws).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                for w in set(ws):
                    out[0].append(key)
                    out[1].append(w)
            yield pa.RecordBatch.from_pydict({"item": pa.array(out[0], pa.int64()), "word": pa.array(out[1], pa.string())})

    held = items.select("text").mapInArrow(run, "item bigint, word string").distinct()
    most = max(RARE, held.select("item").distinct().count() // RARE_SHARE)
    return frozenset(r[0] for r in small_rows(held.groupBy("word").count().where(F.col("count") > most).select("word"), "shared words of eval_items", 1_000_000))


def passages(docs: DataFrame, eval_items: DataFrame, least: int = LEAST, shard_words: int = SHARD, block: int = BLOCK) -> DataFrame:
    """SPANS_SQL: every passage of at least `least` running words of an item, with the words of the document it spans."""
    items = eval_items.where("text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // block))
    shared = shared_words(items)
    found = None
    for k in range(blocks):
        rows = small_rows(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), "a block of eval_items", 4 * block)
        got = block_passages(docs, sorted(((r[0], r[1]) for r in rows), key=str), shared, least, shard_words)
        found = got if found is None else found.unionByName(got)
    return found


def block_passages(docs: DataFrame, rows: list[tuple[int, str]], shared: frozenset, least: int, shard_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((rows, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        shard: list[tuple[int, array, int]] = []
        words = 0
        overlap = 2 * max((len(w) for w in items.words), default=0) + 2 * BAND  # a longer document's parts share any passage at their border

        def done() -> pa.RecordBatch:
            got = [x[:6] for x in leaks(shard, items) if x[2] >= least and x[6] >= (KEPT if x[2] >= SHORT else KEPT_SHORT)]
            cols = list(zip(*got)) if got else [[] for _ in SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SPANS)], schema=SPANS)

        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                s = items.symbols(t)
                for a in range(0, max(1, len(s)), shard_words):
                    part = s[a : a + shard_words + overlap]
                    shard.append((i, part, a))
                    words += len(part) + 1
                    if words >= shard_words:
                        yield done()
                        shard, words = [], 0
        if shard:
            yield done()

    return docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SPANS_SQL)


def removal_spans(docs: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, first_word, last_word, items: overlapping passages of a document merged into spans for removal."""
    from pyspark.sql import Window as W

    by = W.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    spans = passages(docs, eval_items).distinct()
    reach = F.max("last_word").over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.coalesce((F.col("first_word") > reach + 1).cast("int"), F.lit(0))).withColumn("span", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")


def leaks_found(docs: DataFrame, eval_items: DataFrame) -> DataFrame:
    """p6_found: doc_id, item_id."""
    return passages(docs, eval_items).select("doc_id", "item_id").distinct()
