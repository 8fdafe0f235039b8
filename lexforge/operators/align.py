"""Alignment of gold and predicted lines: greedy one-to-one joins, optimal assignment with adjacent merges, typography of words.

The group of every grouped map is one page, so a task's memory is bounded by a page.
"""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from lexforge.functions.text import clean_text, collapse
from lexforge.session import checkpoint_dir, spread


def value_ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """Matching ratio of two values; two empty ones 1, one empty 0. Below `least` an upper bound of the ratio may stand for it."""
    a, b = a or "", b or ""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    m = difflib.SequenceMatcher(None, a, b)
    bound = m.quick_ratio() if least else 1.0
    return bound if bound < least else m.ratio()


def similarity(gold: Column, pred: Column, least: float = 0.0) -> Column:
    @F.pandas_udf(T.DoubleType())
    def ratios(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([value_ratio(a, b, least) for a, b in zip(g, p)], dtype="float64")

    return ratios(gold, pred)


def could_reach(a: Column, b: Column, least: float) -> Column:
    """A bound of the ratio by the lengths alone; pairs that fail it can't reach `least`."""
    la, lb = F.length(a), F.length(b)
    return (2 * F.least(la, lb) >= least * (la + lb)) | ((la == 0) & (lb == 0))


def greedy(candidates: DataFrame, keys: list[str], gold: str = "gold_idx", pred: str = "pred_idx", score: str = "similarity") -> DataFrame:
    """keys, gold, pred, score: pairs taken by falling score, then gold and pred place, each side once."""
    fields = [f for f in candidates.schema.fields if f.name in (*keys, gold, pred, score)]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        seen_g, seen_p, keep = set(), set(), []
        pdf = pdf.sort_values([score, gold, pred], ascending=[False, True, True])
        for i, g, p in zip(pdf.index, pdf[gold], pdf[pred]):
            if g not in seen_g and p not in seen_p:
                seen_g.add(g)
                seen_p.add(p)
                keep.append(i)
        return pdf.loc[keep]

    return candidates.select(*[f.name for f in fields]).groupBy(*keys).applyInPandas(pick, T.StructType(fields))


def greedy_join(gold: DataFrame, pred: DataFrame, keys: list[str], place: str, value: str, least: float = 0.6) -> DataFrame:
    """keys, gold_idx, pred_idx, similarity, status: matched pairs of `least` similarity or more, and the missing and extra rows.

    The candidates are an equi-join on the keys; lengths that can't reach the threshold are left out before any ratio is computed.
    """
    g = gold.select(*keys, F.col(place).cast("int").alias("gold_idx"), F.col(value).alias("gold_value"))
    p = pred.select(*keys, F.col(place).cast("int").alias("pred_idx"), F.col(value).alias("pred_value"))
    # both sides are read several times below; what led to them is computed once
    checkpoint_dir(gold.sparkSession)
    g, p = g.checkpoint(), p.checkpoint()
    # equal values come first in the greedy order, the first of each side with the first of the other: an equi-join on their rank
    nth = lambda df, v, k: df.withColumn("_v", F.coalesce(v, F.lit(""))).withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_v").orderBy(k)))
    equal = nth(g, "gold_value", "gold_idx").join(nth(p, "pred_value", "pred_idx"), [*keys, "_v", "_n"]).select(*keys, "gold_idx", "pred_idx", F.lit(1.0).alias("similarity"))
    rest_g, rest_p = g.join(equal.select(*keys, "gold_idx"), [*keys, "gold_idx"], "left_anti"), p.join(equal.select(*keys, "pred_idx"), [*keys, "pred_idx"], "left_anti")
    pairs = spread(rest_g.join(rest_p, keys).where(could_reach(F.col("gold_value"), F.col("pred_value"), least)), *keys, "gold_idx")
    pairs = pairs.withColumn("similarity", similarity(F.col("gold_value"), F.col("pred_value"), least)).where(F.col("similarity") >= least)
    near = greedy(pairs.select(*keys, "gold_idx", "pred_idx", "similarity"), keys).select(*keys, "gold_idx", "pred_idx", "similarity", F.lit("matched").alias("status"))
    got = equal.withColumn("status", F.lit("matched")).unionByName(near)
    none = lambda t: F.lit(None).cast(t)
    # one more aggregation gives the sides that stay alone, so that the matching isn't computed again for them
    sides = (
        got.select(*keys, "gold_idx", "pred_idx", "similarity", "status")
        .unionByName(g.select(*keys, "gold_idx", none("int").alias("pred_idx"), none("double").alias("similarity"), F.lit("missing").alias("status")))
        .unionByName(p.select(*keys, none("int").alias("gold_idx"), "pred_idx", none("double").alias("similarity"), F.lit("extra").alias("status")))
    )
    hit_g = F.max(F.when(F.col("status") == "matched", 1).otherwise(0)).over(W.partitionBy(*keys, "gold_idx"))
    hit_p = F.max(F.when(F.col("status") == "matched", 1).otherwise(0)).over(W.partitionBy(*keys, "pred_idx"))
    marked = sides.withColumn("_g", hit_g).withColumn("_p", hit_p)
    return marked.where("status = 'matched' or (status = 'missing' and _g = 0) or (status = 'extra' and _p = 0)").drop("_g", "_p")


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment (shortest augmenting paths with potentials)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist, prev, done = c[i] - u[i] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            j = int(open_.argmin())
            least = open_[j]
            done[j] = True
            if row_of[j] < 0:
                break
            k = row_of[j]
            way = least + c[k] - u[k] - v
            better = ~done & (way < dist)
            dist[better] = way[better]
            prev[better] = j
        seen = np.flatnonzero(done & (np.arange(m) != j))
        u[i] += least
        u[row_of[seen]] += least - dist[seen]
        v[seen] -= least - dist[seen]
        while prev[j] >= 0:
            row_of[j] = row_of[prev[j]]
            j = prev[j]
        row_of[j] = i
    cols = np.flatnonzero(row_of >= 0)
    rows = row_of[cols]
    order = np.argsort(cols if flip else rows)
    return (cols[order], rows[order]) if flip else (rows[order], cols[order])


def levenshtein(a: list, b: list) -> int:
    """Distance by bit vectors: one integer holds a column of the table, a few operations a token of b."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(d | up)), up & d
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 & full) | (full & ~(d | plus)), plus & d
    return score


class Clusters(dict):
    """Grapheme clusters of lines, kept."""

    def __missing__(self, s: str) -> list:
        got = list(s) if s.isascii() else regex.findall(r"\X", s)
        if len(self) > 50_000:
            self.clear()
        self[s] = got
        return got


CLUSTERS = Clusters()


def ned(a: str, b: str) -> float:
    if a == b:
        return 0.0
    ga, gb = CLUSTERS[a], CLUSTERS[b]
    return levenshtein(ga, gb) / max(len(ga), len(gb), 1)


def ned_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """ned of each pair; those whose shorter side fits a machine word are figured side by side, a step a grapheme."""
    out = np.zeros(len(pairs))
    symbols: dict = {}
    patterns: dict[str, int] = {}
    coded: dict[str, np.ndarray] = {}
    of, texts, at = [], [], []
    for k, (x, y) in enumerate(pairs):
        if x == y:
            continue
        a, b = CLUSTERS[x], CLUSTERS[y]
        if len(a) > len(b):
            a, b, x, y = b, a, y, x
        if not a or len(a) > 63:
            out[k] = ned(x, y)
            continue
        of.append(patterns.setdefault(x, len(patterns)))
        if y not in coded:
            coded[y] = np.array([symbols.setdefault(c, len(symbols) + 1) for c in b])
        texts.append(coded[y])
        at.append(k)
    if not at:
        return out
    bits = np.zeros((len(patterns), len(symbols) + 1), np.uint64)
    for p, n in patterns.items():
        for k, c in enumerate(CLUSTERS[p]):
            if c in symbols:
                bits[n, symbols[c]] |= np.uint64(1 << k)
    of = np.array(of)
    sizes = np.array([len(CLUSTERS[p]) for p in patterns], np.uint64)[of]
    lengths = np.array([len(t) for t in texts])
    padded = np.zeros((int(lengths.max()), len(texts)), np.int64)
    for k, t in enumerate(texts):
        padded[: len(t), k] = t
    one = np.uint64(1)
    full, top = (one << sizes) - one, sizes - one
    up, down, score = full.copy(), np.zeros_like(full), sizes.astype(np.int64)
    for j, row in enumerate(padded):
        eq = bits[of, row]
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(d | up)), up & d
        step = ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
        score += step * (j < lengths)
        plus = (plus << one | one) & full
        up, down = (minus << one & full) | (full & ~(d | plus)), plus & d
    out[at] = score / np.maximum(lengths, 1)
    return out


#: A pair is masked below SURE, may be merged up to FUZZY, is kept up to REJECT; a merge holds at most WINDOW lines.
SURE, FUZZY, MANY, REJECT, WINDOW = 0.25, 0.6, 0.4, 0.7, 160


def end_scores(part: str, whole: str) -> list[int]:
    """For each place in `whole` the least distance of `part` to any stretch that ends there, by the bit vectors of levenshtein."""
    at: dict = {}
    for k, x in enumerate(part):
        at[x] = at.get(x, 0) | 1 << k
    full, top = (1 << len(part)) - 1, 1 << (len(part) - 1)
    up, down, score, out = full, 0, len(part), []
    for y in whole:
        eq = at.get(y, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(d | up)), up & d
        score += bool(plus & top) - bool(minus & top)
        out.append(score)
        plus = plus << 1 & full
        up, down = (minus << 1 & full) | (full & ~(d | plus)), plus & d
    return out


def window_ned(part: str, whole: str, kept: dict, limit: float = FUZZY) -> float | None:
    """The least distance share of `part` to any window of its length in `whole`; None if there is no such window. Beyond `limit` some value beyond it.

    Windows are tried by the least distance that a stretch with their end can have, until none can be better.
    """
    n = len(part)
    if not n or len(whole) < n:
        return None
    key = (part, whole, limit)
    if key not in kept:
        if part in whole:
            kept[key] = 0.0
        elif len(CLUSTERS[part]) != n or len(CLUSTERS[whole]) != len(whole):
            kept[key] = min(ned(part, whole[i : i + n]) for i in range(len(whole) - n + 1))
        else:
            best = float("inf")
            for score, i in sorted((x, i) for i, x in enumerate(end_scores(part, whole)[n - 1 :])):
                if score >= best * n or score > limit * n:
                    best = min(best, max(score / n, limit + 1e-9)) if score > limit * n else best
                    break
                best = min(best, ned(part, whole[i : i + n]))
            kept[key] = best
    return kept[key]


def widest(gold: str, pred: list[str], start: int, closed: np.ndarray, kept: dict, fit: float, second: float | None) -> tuple[int, ...]:
    """The run of predicted lines from `start` that together fit a gold line: no line makes the fit worse, each is found in the gold line, and the run stops once it is longer.

    fit, second: edit shares of the first line alone and with the next one.
    """
    part, text = [start], pred[start]
    found = -1.0  # the worst fit of a line so far; not figured before a second line is tried
    while len(part) < WINDOW and (e := part[-1] + 1) < len(pred) and not closed[e]:
        longer = f"{text} {pred[e]}"
        d = ned(longer, gold) if len(part) > 1 else second
        if d > fit:
            break
        found = window_ned(text, gold, kept) if found == -1.0 else found
        if found is None or found > FUZZY or (last := window_ned(pred[e], gold, kept)) is None or last >= FUZZY:
            break
        part.append(e)
        text, fit, found = longer, d, max(found, last)
        if len(text) > len(gold):
            break
    return tuple(part)


def settled(runs: list[tuple[tuple[int, ...], float]]) -> list[tuple[int, ...]]:
    """Runs that don't overlap: of every chain of overlapping ones, the choice with the least mean cost."""
    chains: list[list[tuple[tuple[int, ...], float]]] = []
    for run, cost in sorted(runs, key=lambda x: x[0][0]):
        if chains and any(set(run) & set(r) for r, _ in chains[-1]):
            chains[-1].append((run, cost))
        else:
            chains.append([(run, cost)])
    out: list[tuple[int, ...]] = []
    for chain in chains:
        choices: list[dict[tuple[int, ...], float]] = []
        for run, cost in chain:
            placed = False
            for c in choices:
                if run in c:
                    c[run] = min(c[run], cost)
                    placed = True
                elif not any(set(run) & set(r) for r in c):
                    c[run] = cost
                    placed = True
            if not placed:
                choices.append({run: cost})
        out += min(choices, key=lambda c: sum(c.values()) / len(c))
    return out


def match_page(gold: list[str], pred: list[str]) -> list[tuple[list[int], list[int], float]]:
    """(gold places, predicted places, edit share) of a page: full on both sides, unmatched ones with an empty other side and edit 1.

    Lines that fit none surely may be merged with their neighbours (`widest`, `settled`); merged lines and gold lines are
    assigned at least cost and poor pairs rejected. A gold line left over joins the first predicted line that
    holds it (`MANY`); what still remains is assigned at edit 1, and predicted lines without a gold line come out
    together. Several gold lines of one prediction are joined without a space to be scored.
    """
    if not gold:
        return [([], list(range(len(pred))), 1.0)] if pred else []
    if not pred:
        return [([k], [], 1.0) for k in range(len(gold))]
    if len(gold) == len(pred) == 1:
        return [([0], [0], ned(pred[0], gold[0]))]
    cost = ned_many([(p, g) for g in gold for p in pred]).reshape(len(gold), len(pred))
    sure_g, sure_p = (cost < SURE).any(1), (cost < SURE).any(0)
    kept: dict = {}
    runs = []
    open_g, open_p = np.flatnonzero(~sure_g).tolist(), np.flatnonzero(~sure_p).tolist()
    twos = [(g, s) for g in open_g for s in open_p if s + 1 < len(pred) and not sure_p[s + 1]]
    second = dict(zip(twos, ned_many([(f"{pred[s]} {pred[s + 1]}", gold[g]) for g, s in twos]).tolist()))
    for g in open_g:
        tried = [widest(gold[g], pred, s, sure_p, kept, cost[g, s], second.get((g, s))) for s in open_p]
        costs = [cost[g, r[0]] if len(r) == 1 else ned(" ".join(pred[p] for p in r), gold[g]) for r in tried]
        if tried:
            k = int(np.argmin(costs))
            runs.append((tried[k], float(costs[k])))
    inside = {p: r for r in settled(runs) for p in r}
    units: list[tuple[int, ...]] = []
    while (k := units[-1][-1] + 1 if units else 0) < len(pred):
        units.append(inside.get(k, (k,)))
    texts = [" ".join(pred[p] for p in u) for u in units]
    full = cost[:, [u[0] for u in units]]
    for c, (u, t) in enumerate(zip(units, texts)):
        if len(u) > 1:
            full[:, c] = ned_many([(t, g) for g in gold])
    rows, cols = assignment(full)
    pairs: dict[tuple[int, ...], list[int]] = {units[c]: [int(r)] for r, c in zip(rows, cols) if full[r, c] <= REJECT}
    free = [g for g in range(len(gold)) if not any(g in x for x in pairs.values())]
    for p, line in enumerate(pred):  # gold lines held by a predicted line
        held = [g for g in free if (d := window_ned(gold[g], line, kept, MANY)) is not None and d < MANY]
        if held:
            pairs[(p,)] = sorted([*pairs.get((p,), []), *held])
            free = [g for g in free if g not in held]
    edit = lambda u, held: ned(" ".join(pred[p] for p in u), "".join(gold[g] for g in held))
    out = [(held, list(u), edit(u, held)) for u, held in pairs.items()]
    used = {p for u in pairs for p in u}
    left = [p for p in range(len(pred)) if p not in used]
    if free and left:
        rows, cols = assignment(cost[np.ix_(free, left)])
        out += [([free[r]], [left[c]], 1.0) for r, c in zip(rows, cols)]
        free, left = [g for k, g in enumerate(free) if k not in set(rows.tolist())], [p for k, p in enumerate(left) if k not in set(cols.tolist())]
    out += [([g], [], 1.0) for g in free]
    if left:
        out.append(([], left, 1.0))
    return sorted(out, key=lambda x: (not x[1], x[1][:1], not x[0], x[0][:1]))


def match_lines(gold: DataFrame, pred: DataFrame, keys: list[str], place: str = "line_idx", text: str = "line") -> DataFrame:
    """keys, gold_idx, pred_idx (arrays of places), gold_text, pred_text, edit: the alignment of each page."""
    side = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]).alias(name))
    return match_pages(side(gold, "gold").join(side(pred, "pred"), keys, "full"), keys)


def match_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """match_lines of pages that hold both sides as arrays of lines (keys, gold, pred; null is no line); keys may be null."""
    names = [f.name for f in pages.schema.fields if f.name in keys]
    schema = T.StructType([f for f in pages.schema.fields if f.name in keys] + [T.StructField("gold_idx", T.ArrayType(T.IntegerType())), T.StructField("pred_idx", T.ArrayType(T.IntegerType())), T.StructField("gold_text", T.StringType()), T.StructField("pred_text", T.StringType()), T.StructField("edit", T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g, p = [list(x) if x is not None else [] for x in (r.gold, r.pred)]
                for gi, pi, e in match_page(g, p):
                    rows.append([getattr(r, n) for n in names] + [gi, pi, " ".join(g[k] for k in gi), " ".join(p[k] for k in pi), e])
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return spread(pages, *keys).mapInPandas(run, schema)


def collapsed_pages(lines: DataFrame, keys: list[str], place: str, text: str, name: str, composed: bool = False) -> DataFrame:
    """keys, name: a page's lines joined by spaces and cleaned after joining."""
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), lambda x: x != ""), " ")
    return lines.groupBy(*keys).agg(joined.alias("_t")).select(*keys, clean_text(F.col("_t"), composed).alias(name))


WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
TAGGED = T.ArrayType(WORD)


def words_of_tagged(x: str | None) -> list[dict]:
    """Words of a marked-up line with the tags open at them; a closing tag without an opening one is ignored."""
    depth: dict[str, int] = {}
    out, word, tags = [], "", set()
    for part in TAG_SPLIT.split(x or ""):
        m = TAG_NAME.fullmatch(part)
        if m:
            depth[m[2]] = max(0, depth.get(m[2], 0) + (-1 if m[1] else 1))
            continue
        for c in part:
            if c.isspace():
                if word:
                    out.append({"word": word, "tags": sorted(tags)})
                word, tags = "", set()
            else:
                word += c
                tags |= {t for t, n in depth.items() if n > 0}
    if word:
        out.append({"word": word, "tags": sorted(tags)})
    return out


TAG_SPLIT, TAG_NAME = re.compile(r"(</?[a-zA-Z][a-zA-Z0-9]*>)"), re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")


@F.pandas_udf(TAGGED)
def tagged_words(s: pd.Series) -> pd.Series:
    """words_of_tagged of each line."""
    return s.map(words_of_tagged)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("gold", WORD), T.StructField("pred", WORD)])))
def word_pairs(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """Tagged words of two lines side by side: equal runs, replaced ones by place if they are half alike, the rest alone."""

    def one(g: list, p: list) -> list[dict]:
        g, p = list(g) if g is not None else [], list(p) if p is not None else []
        key = lambda x: x["word"].casefold().strip(",.:;!?'\"()[]")
        out = []
        for op, a, b, c, d in difflib.SequenceMatcher(None, [key(x) for x in g], [key(x) for x in p], False).get_opcodes():
            if op == "equal":
                out += [{"gold": x, "pred": y} for x, y in zip(g[a:b], p[c:d])]
                continue
            n = min(b - a, d - c)
            for x, y in zip(g[a : a + n], p[c : c + n]):
                if difflib.SequenceMatcher(None, key(x), key(y)).ratio() >= 0.5:
                    out.append({"gold": x, "pred": y})
                else:
                    out += [{"gold": x, "pred": None}, {"gold": None, "pred": y}]
            out += [{"gold": x, "pred": None} for x in g[a + n : b]] + [{"gold": None, "pred": y} for y in p[c + n : d]]
        return out

    return pd.Series([one(a, b) for a, b in zip(gold, pred)])


#: Pairs of lines that are figured side by side in `cost_matrix`.
SIDE_BY_SIDE = 20_000


def cost_matrix(gold: DataFrame, pred: DataFrame, keys: list[str], place: str = "line_idx", text: str = "line") -> DataFrame:
    """keys, gold_idx, pred_idx, ned: every pair of lines within a page, by an equi-join on the page.

    The lines of both sides meet as one row a page; distances are figured by `ned_many`, at most SIDE_BY_SIDE pairs at once.
    """
    side = lambda df, s: df.select(*keys, F.struct(F.col(place).alias("at"), collapse(F.col(text)).alias("line")).alias("x")).groupBy(*keys).agg(F.collect_list("x").alias(s))
    both = spread(side(gold, "_g").join(side(pred, "_p"), keys), *keys)
    kinds = [f for f in both.schema.fields if f.name in keys]
    schema = T.StructType(kinds + [T.StructField("gold_idx", gold.schema[place].dataType), T.StructField("pred_idx", pred.schema[place].dataType), T.StructField("ned", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k, (g, p) in enumerate(zip(b.column("_g").to_pylist(), b.column("_p").to_pylist())):
                known = [(x["at"], x["line"]) for x in p]
                step = max(1, SIDE_BY_SIDE // max(1, len(known)))
                for at in range(0, len(g), step):
                    part = [(x["at"], x["line"]) for x in g[at : at + step]]
                    n = len(part) * len(known)
                    found = [i for i, (_, x) in enumerate(part) if x is not None]
                    there = [i for i, (_, x) in enumerate(known) if x is not None]
                    neds = np.full((len(part), len(known)), np.nan)
                    if found and there:
                        neds[np.ix_(found, there)] = ned_many([(known[j][1], part[i][1]) for i in found for j in there]).reshape(len(found), len(there))
                    flat = neds.ravel()
                    key = [pa.array([b.column(f.name)[k].as_py()], arrow.field(f.name).type).take(pa.array(np.zeros(n, np.int32))) for f in kinds]
                    left, right = pa.array([x for x, _ in part], arrow.field("gold_idx").type), pa.array([x for x, _ in known], arrow.field("pred_idx").type)
                    row, col = np.divmod(np.arange(n, dtype=np.int32), len(known))
                    yield pa.RecordBatch.from_arrays([*key, left.take(pa.array(row)), right.take(pa.array(col)), pa.array(flat, pa.float64(), mask=np.isnan(flat))], schema=arrow)

    return both.mapInArrow(run, schema)


def record_lines(gold: DataFrame, pred: DataFrame, keys: list[str], record_least: float = 0.6, line_least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(records, lines) of two sets of record lines (keys, record_index, line_in_record, marker, value).

    records: greedy_join of the records' fingerprints. lines: keys, gold_record, gold_line, pred_record, pred_line,
    gold_marker, pred_marker, gold_value, pred_value, similarity, status: the lines of matched records, matched one to
    one by the ratio of their values; missing and extra lines of matched records, and all lines of records alone.
    """
    from lexforge.operators.mdf import records as record_rows

    checkpoint_dir(gold.sparkSession)
    gold, pred = gold.checkpoint(), pred.checkpoint()
    found = greedy_join(record_rows(gold, keys), record_rows(pred, keys), keys, "record_index", "fingerprint", record_least).checkpoint()
    cols = lambda df, side: df.select(*keys, F.col("record_index").alias(f"{side}_record"), F.col("line_in_record").cast("int").alias(f"{side}_line"), F.col("marker").alias(f"{side}_marker"), F.col("value").alias(f"{side}_value"))
    g, p = cols(gold, "gold"), cols(pred, "pred")
    matched = found.where("status = 'matched'").select(*keys, F.col("gold_idx").alias("gold_record"), F.col("pred_idx").alias("pred_record"))
    pair = [*keys, "gold_record", "pred_record"]
    gm, pm = g.join(matched, [*keys, "gold_record"], "left"), p.join(matched, [*keys, "pred_record"], "left")
    # a page's records are small: the lines of a pair are compared in one grouped row of arrays
    side = lambda df, s: df.where(f"{'pred' if s == 'gold' else 'gold'}_record is not null").groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct(f"{s}_line", f"{s}_marker", f"{s}_value"))).alias(s))
    both = spread(side(gm, "gold").join(side(pm, "pred"), pair, "full"), *pair)
    schema = T.StructType([f for f in both.schema.fields if f.name in pair] + [T.StructField(n, t) for n, t in (("gold_line", T.IntegerType()), ("pred_line", T.IntegerType()), ("gold_marker", T.StringType()), ("pred_marker", T.StringType()), ("gold_value", T.StringType()), ("pred_value", T.StringType()), ("similarity", T.DoubleType()), ("status", T.StringType()))])

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                key = [getattr(r, n) for n in [f.name for f in schema][: len(pair)]]
                a, b = [list(x) if x is not None else [] for x in (r.gold, r.pred)]
                for i, j, s in line_matches([x["gold_value"] for x in a], [x["pred_value"] for x in b], line_least):
                    x, y = a[i] if i is not None else None, b[j] if j is not None else None
                    rows.append([*key, x and x["gold_line"], y and y["pred_line"], x and x["gold_marker"], y and y["pred_marker"], x and x["gold_value"], y and y["pred_value"], s, "matched" if x and y else "missing" if x else "extra"])
            yield pd.DataFrame(rows, columns=[f.name for f in schema]).astype({"gold_line": "Int32", "pred_line": "Int32"})

    none = lambda t: F.lit(None).cast(t)
    lines = both.mapInPandas(run, schema)
    order = [*keys, "gold_record", "gold_line", "pred_record", "pred_line", "gold_marker", "pred_marker", "gold_value", "pred_value", "similarity", "status"]
    alone_g = gm.where("pred_record is null").withColumns({"pred_line": none("int"), "pred_marker": none("string"), "pred_value": none("string"), "similarity": none("double"), "status": F.lit("missing")})
    alone_p = pm.where("gold_record is null").withColumns({"gold_line": none("int"), "gold_marker": none("string"), "gold_value": none("string"), "similarity": none("double"), "status": F.lit("extra")})
    return found, lines.select(*order).unionByName(alone_g.select(*order)).unionByName(alone_p.select(*order))


def line_matches(gold: list[str], pred: list[str], least: float) -> list[tuple[int | None, int | None, float | None]]:
    """(gold place, predicted place, ratio) of values taken by falling ratio, then places, each once; the rest alone."""
    out, free_g, free_p = [], [], set(range(len(pred)))
    at: dict[str, list[int]] = {}
    for j, v in enumerate(pred):
        at.setdefault(v or "", []).append(j)
    for i, v in enumerate(gold):  # equal values are first in the greedy order
        js = at.get(v or "")
        if js:
            j = js.pop(0)
            free_p.discard(j)
            out.append((i, j, 1.0))
        else:
            free_g.append(i)
    left = sorted(free_p)
    scored = sorted((-s, i, j) for i in free_g for j in left if (s := value_ratio(gold[i], pred[j], least)) >= least)
    seen_g: set[int] = set()
    for s, i, j in scored:
        if i not in seen_g and j in free_p:
            seen_g.add(i)
            free_p.discard(j)
            out.append((i, j, -s))
    out += [(i, None, None) for i in free_g if i not in seen_g] + [(None, j, None) for j in sorted(free_p)]
    return sorted(out, key=lambda x: (x[0] is None, x[0], x[1]))
