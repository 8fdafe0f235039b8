"""Problem 1: the language, with a confidence, of documents, their sentences, values and words.

A string kernel compares texts by the character n-grams their words hold (a blended spectrum of 1 to 4 letters,
word borders marked, presence within a word). Landmarks drawn from the labelled samples span the feature space
(Nystroem); kernel ridge regression, one label against the rest, is solved on it. As the kernel is a product over
n-grams, a label's landmark weights fold into one weight an n-gram, so that texts are scored by batched products of
their n-gram rows with the weights. A word's row of scores is kept; sentences and values add up their words' rows.

The classifier is fitted on the language samples and on at most SAMPLE_VALUES values a label whose marker, label
and counts agree. Everything found is judged over all rows.

Defined results: null and empty texts are no cases; unknown or empty labels name no language; a row delivered
again gives its rows once; label arrays that are null or too short leave words without a label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import quality
from lexforge.llm.scan import is_head, page_no
from lexforge.llm.spelling import ODD, plain, plain_word
from lexforge.session import small_rows

NGRAMS = (1, 2, 3, 4)
#: Times that a word counts as an n-gram of its own.
WHOLE = 4
SPACE = 1 << 15
LANDMARKS = 600
RIDGE = 0.02
#: Values of a label that the classifier is fitted on at most, besides the language samples.
SAMPLE_VALUES = 60
#: What a value's sum of scores gains for the language of its marker.
PRIOR = 0.35
#: The codes and names by which a document's lang may name a language.
NAMES = {
    "en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french", "français", "francais"), "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol"), "ru": ("ru", "rus", "russian", "русский"), "id": ("id", "ind", "in", "indonesian", "bahasa"),
}
CODE = {n: c for c, names in NAMES.items() for n in names}
LETTERS = re.compile(r"[^\W\d_]+(?:[’'\-̀-ͯ]+[^\W\d_]+)*[̀-ͯ]*")
SENTENCE = re.compile(r"[.!?…][\"»“”’)\]]*\s+|\n\s*\n")
EDGE = ".,;:?!\"“”„«»()[]—–-→*…¿¡"
ROMANS = re.compile(r"[IVX]+")


def code_of(lang: str | None) -> str:
    """The two-letter code that a label names; '' if it names none."""
    return CODE.get(re.split(r"[-_ ]", (lang or "").strip().lower())[0], "")


def grams(word: str) -> list[int]:
    s = f"^{word}$"
    return [zlib.crc32(g.encode()) & (SPACE - 1) for g in {s[i : i + n] for n in NGRAMS for i in range(len(s) - n + 1)}] + [zlib.crc32(f"{k}{s}".encode()) & (SPACE - 1) for k in range(WHOLE)]


class Model:
    """Scores of words by label, kept in rows of one matrix; `weights` is n-grams x labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, most: int = 120_000):
        self.labels, self.weights, self.most = labels, weights, most
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(labels)), np.float32)

    def learn(self, words: set) -> None:
        """Scores the words not kept yet in one batched product."""
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        if len(self.rows) + len(new) > self.most:
            self.rows.clear()
            new = list(words)
        grown = [grams(w if w.isascii() else plain_word(w)[0]) for w in new]
        starts = np.cumsum([0] + [len(r) for r in grown[:-1]])
        flat = np.fromiter((i for r in grown for i in r), np.int64, sum(map(len, grown)))
        n = len(self.rows)
        if n + len(new) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros((max(len(self.matrix), n + len(new)), len(self.labels)), np.float32)])
        for a in range(0, len(new), 4096):  # in parts, as a word has some thirty rows of weights
            b = min(a + 4096, len(new))
            lo, hi = starts[a], starts[b] if b < len(new) else len(flat)
            self.matrix[n + a : n + b] = np.add.reduceat(self.weights[flat[lo:hi]], starts[a:b] - lo, axis=0) / np.sqrt([[len(r)] for r in grown[a:b]]).astype(np.float32)
        self.rows.update(zip(new, range(n, n + len(new))))

    def sums(self, texts: list[list[str]], table: np.ndarray | None = None) -> np.ndarray:
        """The sum of the rows of each list of words (zeros for an empty one); of `table`'s rows if that is given."""
        at = self.rows
        ids = np.fromiter((at[w] for t in texts for w in t), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        table = self.matrix if table is None else table
        out = np.zeros((len(texts), table.shape[1]), np.float32)
        if len(ids):
            starts = np.cumsum(sizes) - sizes
            full = sizes > 0
            out[full] = np.add.reduceat(table[ids], starts[full], axis=0)
        return out


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    docs = [np.array([i for w in LETTERS.findall(t.lower()) for i in grams(w)], np.int64) for t in texts]
    keep = [k for k, d in enumerate(docs) if len(d)]
    docs, labels = [docs[k] for k in keep], [labels[k] for k in keep]
    n = len(docs)
    marks: list[int] = []
    for name in names:  # landmarks: as many of each label
        own = [k for k in range(n) if labels[k] == name]
        marks += list(rng.permutation(own)[: max(1, LANDMARKS // len(names))])
    used = np.unique(np.concatenate(docs))
    place = np.full(SPACE, -1)
    place[used] = np.arange(len(used))

    def rows(ids, block):  # noqa: ANN001, ANN202
        x = np.zeros((len(ids), block[1] - block[0]), np.float32)
        for r, k in enumerate(ids):
            p = place[docs[k]]
            p = p[(p >= block[0]) & (p < block[1])] - block[0]
            np.add.at(x[r], p, 1.0)
        return x

    blocks = [(a, min(a + 4096, len(used))) for a in range(0, len(used), 4096)]
    cross, norms = np.zeros((n, len(marks)), np.float32), np.zeros(n, np.float32)
    for b in blocks:
        x = rows(range(n), b)
        norms += (x * x).sum(1)
        cross += x @ x[marks].T
    norms = np.sqrt(norms)
    cross /= norms[:, None] * norms[marks][None]
    inner = cross[marks].astype(np.float64)
    vals, vecs = np.linalg.eigh((inner + inner.T) / 2)
    good = vals > 1e-6 * vals[-1]
    half = vecs[:, good] / np.sqrt(vals[good])  # K_mm^(-1/2)
    phi = cross.astype(np.float64) @ half
    y = np.array([[1.0 if t == name else -1.0 / (len(names) - 1) for name in names] for t in labels])
    weight = 1.0 / np.array([labels.count(t) for t in labels])
    weight *= n / weight.sum()
    a = np.linalg.solve((phi * weight[:, None]).T @ phi + RIDGE * n / 10 * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
    on_marks = half @ a / norms[marks][:, None].astype(np.float64)
    weights = np.zeros((SPACE, len(names)), np.float32)
    for b in blocks:
        weights[used[b[0] : b[1]]] = (rows(marks, b).T @ on_marks).astype(np.float32)
    return Model(names, weights)


def markers_of(dictionaries: DataFrame) -> tuple[dict, dict]:
    """({dictionary: (source label, target labels, title)}, {(dictionary, marker): its label})."""
    langs, by_marker = {}, {}
    for r in small_rows(dictionaries.select("dictionary", "source_label", "target_labels", "gloss_markers", "title"), "dictionaries"):
        langs[r[0]] = (r[1], list(r[2] or []), r[4] or "")
        for m in ("lx", "xv", "cf", "ph"):
            by_marker[(r[0], m)] = r[1]
        for m, label in zip(r[3] or [], r[2] or []):
            by_marker[(r[0], m)] = label
            by_marker[(r[0], "x" + m[1:])] = label
    return langs, by_marker


def trained(tables: dict[str, DataFrame]) -> tuple[Model, dict, dict, dict]:
    """(model over labels, dictionaries, markers, {label: code}), fitted on the samples and a bounded number of values."""
    langs, by_marker = markers_of(tables["dictionaries"])
    samples = small_rows(tables["language_samples"].where("text is not null").select("text", "label", "lang"), "language_samples")
    texts, labels = [r[0] for r in samples], [r[1] for r in samples]
    if "mdf_value_projections" in tables:
        v = tables["mdf_value_projections"].where("value is not null and primary_language like '%-%' and marker in ('lx', 'ge', 'gn', 'gr', 'xv')").select("dictionary", "marker", "value", "primary_language", "value_id")
        # a bounded sample: one value by hash for each label, marker and slot, reduced before the shuffle
        few = v.groupBy("primary_language", "marker", F.pmod(F.xxhash64("value_id"), F.lit(SAMPLE_VALUES)).alias("slot")).agg(F.min_by(F.struct("dictionary", "value"), F.struct(F.xxhash64("value_id"), "value_id")).alias("x"))
        for r in small_rows(few.select("primary_language", "marker", "x.dictionary", "x.value"), "sample of values", 1_000_000):
            if by_marker.get((r[2], r[1])) == r[0]:
                texts.append(r[3])
                labels.append(r[0])
    return fit(texts, labels), langs, by_marker, {r[1]: r[2] for r in samples}


# documents


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of sentences, white space between them left out; pieces of fewer than three words join the next, the last one the sentence before."""
    cuts = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    held = None
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        if not piece.strip():
            continue
        start = held if held is not None else a + len(piece) - len(piece.lstrip())
        end = a + len(piece.rstrip())
        held = None
        if len(text[start:end].split()) < 3:
            held = start
            last = end
            continue
        out.append((start, end))
    if held is not None:
        out[-1:] = [(out[-1][0], last)] if out else [(held, last)]
    return out


def sentences(text: str) -> list[str]:
    """Sentences in order; pieces of fewer than three words join the next."""
    out, held = [], ""
    for s in SENTENCE.split(text):
        s = (held + " " + s).strip() if held else s.strip()
        held = ""
        if len(s.split()) < 3:
            held = s
            continue
        out.append(s)
    if held:
        if out:
            out[-1] += " " + held
        else:
            out = [held]
    return out


def judge_documents(texts: list[str], model: Model, targets: list[int], others: list[int], codes: list[str], common: dict) -> list[list[tuple[str, float]]]:
    """For each text the (code or '', confidence) of its sentences. Words of source languages don't count; common words count for theirs."""
    return judge_sentences([sentences(t) for t in texts], model, targets, others, codes, common)


def judge_sentences(sents: list[list[str]], model: Model, targets: list[int], others: list[int], codes: list[str], common: dict, least: int = 2) -> list[list[tuple[str, float]]]:
    """judge_documents of texts given as sentences; a sentence needs `least` words of a target language."""
    words = [[w.lower() for w in LETTERS.findall(s)] for ss in sents for s in ss]
    model.learn({w for ws in words for w in ws})
    n = len(model.rows)
    table = model.matrix[:n][:, targets].copy()
    table[table.max(1) <= model.matrix[:n][:, others].max(1)] = 0
    for w, k in common.items():
        at = model.rows.get(w)
        if at is not None:
            table[at] = 0
            table[at, k] = 1.0
    table = np.concatenate([table, (table != 0).any(1)[:, None]], 1)
    sums = model.sums(words, table)
    total, counted = sums[:, :-1], sums[:, -1]
    best = total.argmax(1)
    e = np.exp(2.0 * (total - total.max(1)[:, None]))
    sure = e.max(1) / e.sum(1)
    flat = [(codes[k], float(p)) if c >= least else ("", 0.0) for k, p, c in zip(best.tolist(), sure.tolist(), counted.tolist())]
    out, at = [], 0
    for ss in sents:
        out.append(flat[at : at + len(ss)])
        at += len(ss)
    return out


def languages_in(judged: list[tuple[str, float]], least: int = 2) -> list[tuple[str, float]]:
    """Languages of the whole text or of at least `least` successive sentences, with the mean confidence."""
    known = [(c, p) for c, p in judged if c]
    if not known:
        return []
    found: dict[str, list[float]] = {}
    if len({c for c, _ in known}) == 1:
        found[known[0][0]] = [p for _, p in known]
    run: list[tuple[str, float]] = []
    for c, p in [*known, ("", 0.0)]:
        if run and c != run[-1][0]:
            if len(run) >= least:
                found.setdefault(run[-1][0], []).extend(q for _, q in run)
            run = []
        run.append((c, p))
    return [(c, float(np.mean(ps))) for c, ps in found.items()]


LANG = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("lang_found", pa.string()), ("confidence", pa.float64()), ("named", pa.bool_())])
LANG_SQL = "table_name string, row_id bigint, lang_found string, confidence double, named boolean"


def emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in LANG]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, LANG)], schema=LANG)


def spoken(common_words: DataFrame) -> dict[str, set]:
    """{common word: its languages' codes}; the table is fixed in size, which is checked."""
    by: dict[str, set] = {}
    for c, w in small_rows(common_words.where("lang is not null and word is not null").select("lang", "word"), "common_words"):
        by.setdefault(w.lower(), set()).add(c)
    return by


def document_languages(docs: DataFrame, common_words: DataFrame, shared, unnamed_only: bool = False) -> DataFrame:  # noqa: ANN001
    """LANG_SQL: languages of each document of running prose, and whether its lang names them; with unnamed_only, those that it doesn't."""
    by = spoken(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, weights), _, _, codes_of = shared.value
        model = Model(labels, weights)
        targets = [k for k, x in enumerate(labels) if len(codes_of.get(x, "")) == 2]
        others = [k for k in range(len(labels)) if k not in targets]
        codes = [codes_of[labels[k]] for k in targets]
        common = {w: codes.index(next(iter(c))) for w, c in by.items() if len(c) == 1 and next(iter(c)) in codes and len(w) > 1}
        tokens = quality.Tokens(frozenset(by))
        for b in batches:
            rows = []
            ids, texts, langs_ = (c.to_pylist() for c in b.columns)
            neat = [t if t.isascii() or not ODD.search(t) else plain(t)[0] for t in texts]
            for i, text, lang, judged in zip(ids, texts, langs_, judge_documents(neat, model, targets, others, codes, common)):
                named = code_of(lang)
                found = [(c, p) for c, p in languages_in(judged) if not unnamed_only or c != named]
                # the shape is figured only for texts that could come out
                if found and quality.figures(text, tokens)["shape"] == "prose":
                    rows += [("documents", i, c, p, c == named) for c, p in found]
            yield emit(rows)

    return docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text", "lang").mapInArrow(run, LANG_SQL)


# values


def value_languages(values: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """LANG_SQL: the label of each value that is composed in a language, and whether its labels and counts name it."""
    rows = values.where("value is not null and marker not in ('ps', 'hm', 'dt')").select(F.col("value_id").cast("bigint"), "dictionary", "marker", "value", "primary_language", F.map_entries("language_counts").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, weights), langs, by_marker, codes_of = shared.value
        model = Model(labels, weights)
        at = {x: k for k, x in enumerate(labels)}
        kept: dict[tuple, np.ndarray] = {}

        def offset(name: str, marker: str) -> np.ndarray:
            """0 for the dictionary's labels, PRIOR for the marker's own, far below for others. Headwords and references are source words, notes aren't."""
            row = kept.get((name, marker))
            if row is None:
                source, targets, _ = langs.get(name, ("", [], ""))
                options = [at[x] for x in ([source] if marker in ("lx", "cf", "ph") else targets if marker == "nt" else [source, *targets]) if x in at]
                row = np.full(len(labels), -1e4 if options else 0.0, np.float32)
                row[options] = 0.0
                want = at.get(by_marker.get((name, marker), ""))
                if want in options:
                    row[want] = PRIOR
                kept[(name, marker)] = row
            return row

        for b in batches:
            ids, names, marks, texts, primaries, counts = (c.to_pylist() for c in b.columns)
            words = [[w.lower() for w in LETTERS.findall(t if t.isascii() or not ODD.search(t) else plain(t)[0])] for t in texts]
            model.learn({w for ws in words for w in ws})
            total = model.sums(words) + np.array([offset(name, m) for name, m in zip(names, marks)], np.float32).reshape(-1, len(labels))
            best = total.argmax(1)
            e = np.exp(3.0 * (total - total.max(1)[:, None]))
            sure = e.max(1) / e.sum(1)
            out = []
            for i, ws, k, p, primary, have in zip(ids, words, best.tolist(), sure.tolist(), primaries, counts):
                if ws:
                    label = labels[k]
                    have = {c["key"]: c["value"] or 0 for c in have or []}
                    out.append(("mdf_value_projections", i, label, p, primary == label and label in have and have[label] >= max(have.values())))
            yield emit(out)

    return rows.mapInArrow(run, LANG_SQL)


# pages


def judge_page(text: str, model: Model, options: list[int], title: str, common: dict | None = None) -> list[tuple[int, int, int, float]]:
    """(start, end, place in options, margin) of each printed word that is in a language; heads, page numbers and what has no language are left out.

    Words take the best run of languages through the page: their own scores, less a cost for each change of language.
    """
    found = []
    at = 0
    for line in text.split("\n"):
        s = line.strip()
        if s and not (len(line) < 120 and (is_head(s, title) or len(s) < 24 and page_no(s, None, True))):
            first = True
            for m in re.finditer(r"\S+", line):
                w = m[0]
                core = w.strip(EDGE)
                short = core.replace(".", "")
                if not core or not any(c.isalpha() for c in core) or ROMANS.fullmatch(core) or w[-1] == "." and len(found) and found[-1][4] and len(short) <= 6 and "." in w and not first:
                    # numbers, arrows, homonym numbers; a short form after an entry's head is its part of speech
                    pass
                else:
                    found.append([at + m.start(), at + m.end(), core.lower(), 0.0, first])
                    first = False
                    continue
                first = False
        at += len(line) + 1
    if not found:
        return []
    parts = [LETTERS.findall(f[2]) or [f[2]] for f in found]
    model.learn({x for p in parts for x in p})
    own = model.sums(parts)[:, options]
    if common:
        place = {c: k for k, c in enumerate(options)}
        for k, f in enumerate(found):
            c = place.get(common.get(f[2]))
            if c is not None:
                own[k, c] += 0.5
    for k, f in enumerate(found):
        if text[f[0] : f[0] + 2].strip("(«„“\"¿¡")[:1].isupper():
            own[k, 0] = min(own[k, 0], own[k].min())  # words of source languages are printed small; names stand in the text around them
    best = path(own.tolist(), [text[f[1] - 1] in ".;:»”\")]→,?!" for f in found], [f[4] for f in found])
    out = []
    for f, k, row in zip(found, best, own.tolist()):
        out.append((f[0], f[1], k, row[k] - max((x for j, x in enumerate(row) if j != k), default=0.0)))
    return out


#: Costs of a change of language between printed words: from or to the source language, after a mark that ends a phrase, within a phrase.
TO_SOURCE, AFTER_MARK, WITHIN = 0.2, 0.25, 0.8


def path(own: list[list[float]], marks: list[bool], firsts: list[bool]) -> list[int]:
    """The run of languages (0 is the source language) with the best sum of word scores less the costs of changes."""
    n = len(own[0])
    best = list(own[0])
    backs = []
    for i in range(1, len(own)):
        change = AFTER_MARK if marks[i - 1] else WITHIN
        back, now = [], []
        for k in range(n):
            top, at = best[k], k
            for j in range(n):
                if j != k:
                    v = best[j] - (TO_SOURCE if j == 0 or k == 0 else change)
                    if v > top:
                        top, at = v, j
            back.append(at)
            now.append(top + own[i][k])
        best = now
        backs.append(back)
    k = max(range(n), key=best.__getitem__)
    out = [k]
    for back in reversed(backs):
        k = back[k]
        out.append(k)
    return out[::-1]


#: Different words that must be wrongly labelled on a page: one or two may be words that languages share ("in").
KINDS = 3


def page_languages(pages: DataFrame, common_words: DataFrame, shared, least: int = 4) -> DataFrame:  # noqa: ANN001
    """LANG_SQL: languages of each page; named is false where at least `least` of its words, KINDS of them different, carry no label or one that isn't theirs."""
    by = spoken(common_words)
    rows = pages.where("text is not null and text <> ''").select(F.col("stage1_id").cast("bigint"), "dictionary", "text", "languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, weights), langs, _, codes_of = shared.value
        model = Model(labels, weights)
        at = {x: k for k, x in enumerate(labels)}
        by_code = {codes_of[x]: at[x] for x in labels if x in codes_of}
        common = {w: by_code[next(iter(c))] for w, c in by.items() if len(c) == 1 and len(w) > 1 and next(iter(c)) in by_code}
        for b in batches:
            out = []
            marks = b.column(3)
            for k, (i, name, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                source, targets, title = langs.get(name, ("", [], ""))
                options = [at[x] for x in [source, *targets] if x in at] or list(range(len(labels)))
                carried = marks[k].as_py() or []
                wrong: dict[int, int] = {}
                kinds: dict[int, set] = {}
                total: dict[int, list[float]] = {}
                for s, e, o, margin in judge_page(text, model, options, title, common):
                    label = labels[options[o]]
                    total.setdefault(o, []).append(margin)
                    got = carried[s:e]
                    have = max(set(got), key=got.count) if got else None
                    # against another label of the dictionary a word must be sure, most of all as a source word
                    if have != label and margin > (-0.05 if have not in (labels[x] for x in options) else 0.12 if o else 0.3):
                        wrong[o] = wrong.get(o, 0) + 1
                        kinds.setdefault(o, set()).add(text[s:e])
                for o, ms in total.items():
                    out.append(("stage1_projections", i, labels[options[o]], float(1 / (1 + np.exp(-4 * np.mean(ms)))), wrong.get(o, 0) < least or len(kinds[o]) < KINDS))
            yield emit(out)

    return rows.mapInArrow(run, LANG_SQL)


def languages(tables: dict[str, DataFrame], unnamed_only: bool = False) -> DataFrame:
    """LANG_SQL over documents, values and pages: every language found with its confidence, and whether the row names it."""
    spark = tables["documents"].sparkSession
    model, langs, by_marker, codes = trained(tables)
    shared = spark.sparkContext.broadcast(((model.labels, model.weights), langs, by_marker, codes))
    return (
        document_languages(tables["documents"], tables["common_words"], shared, unnamed_only)
        .unionByName(value_languages(tables["mdf_value_projections"], shared))
        .unionByName(page_languages(tables["stage1_projections"], tables["common_words"], shared))
    )


def languages_found(tables: dict[str, DataFrame]) -> DataFrame:
    """p1_found: table_name, row_id, lang_found of languages that the rows don't name."""
    return languages(tables, unnamed_only=True).where("not named").select("table_name", "row_id", "lang_found").distinct()


SEGMENT = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("segment_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())])
SEGMENT_SQL = "table_name string, row_id bigint, segment_no int, start_at int, end_at int, language string, confidence double"


def runs(parts: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """(start, end, language, mean confidence) of successive parts in one language; parts without one ('') go with the part before, the first with the one after."""
    out: list[list] = []
    for a, b, name, p in parts:
        if out and (name in ("", out[-1][2]) or not out[-1][2]):
            out[-1][1] = b
            out[-1][2] = out[-1][2] or name
            if name:
                out[-1][3].append(p)
        else:
            out.append([a, b, name, [p] if name else []])
    return [(a, b, name, float(np.mean(ps)) if ps else 0.0) for a, b, name, ps in out]


def segments(tables: dict[str, DataFrame]) -> DataFrame:
    """SEGMENT_SQL: every document, value and page as segments [start_at, end_at) of one language each, with a confidence.

    Documents are cut at sentences and named by code, pages at printed words and values as a whole by label. A
    document without a sentence of two known words is one segment in the language of its words; one without any
    known word has language null and confidence 0, as have pages without words. Empty texts give no row.
    """
    spark = tables["documents"].sparkSession
    model, langs, by_marker, codes_of = trained(tables)
    shared = spark.sparkContext.broadcast(((model.labels, model.weights), langs, by_marker, codes_of))
    by = spoken(tables["common_words"])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in SEGMENT]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SEGMENT)], schema=SEGMENT)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, weights), _, _, codes_of = shared.value
        model = Model(labels, weights)
        targets = [k for k, x in enumerate(labels) if len(codes_of.get(x, "")) == 2]
        others = [k for k in range(len(labels)) if k not in targets]
        codes = [codes_of[labels[k]] for k in targets]
        common = {w: codes.index(next(iter(c))) for w, c in by.items() if len(c) == 1 and next(iter(c)) in codes and len(w) > 1}
        neat = lambda t: t if t.isascii() or not ODD.search(t) else plain(t)[0]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            spans = [sentence_spans(t) for t in texts]
            judged = judge_sentences([[neat(t[a:e]) for a, e in ss] for t, ss in zip(texts, spans)], model, targets, others, codes, common)
            alone = [k for k, j in enumerate(judged) if not any(c for c, _ in j)]
            whole = dict(zip(alone, judge_sentences([[neat(texts[k])] for k in alone], model, targets, others, codes, common, 1))) if alone else {}
            rows = []
            for k, (i, t, ss, j) in enumerate(zip(ids, texts, spans, judged)):
                parts = [(0, len(t), *whole[k][0])] if k in whole else [(a, e, c, p) for (a, e), (c, p) in zip(ss, j)]
                rows += [("documents", i, n, a, e, c or None, p) for n, (a, e, c, p) in enumerate(runs(parts), 1)]
            yield batch(rows)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, weights), langs, _, codes_of = shared.value
        model = Model(labels, weights)
        at = {x: k for k, x in enumerate(labels)}
        by_code = {codes_of[x]: at[x] for x in labels if x in codes_of}
        common = {w: by_code[next(iter(c))] for w, c in by.items() if len(c) == 1 and len(w) > 1 and next(iter(c)) in by_code}
        for b in batches:
            rows = []
            for i, name, text in zip(*(c.to_pylist() for c in b.columns)):
                source, targets, title = langs.get(name, ("", [], ""))
                options = [at[x] for x in [source, *targets] if x in at] or list(range(len(labels)))
                found = [(a, e, labels[options[o]], float(1 / (1 + np.exp(-4 * m)))) for a, e, o, m in judge_page(text, model, options, title, common)]
                rows += [("stage1_projections", i, n, a, e, c or None, p) for n, (a, e, c, p) in enumerate(runs(found or [(0, len(text), "", 0.0)]), 1)]
            yield batch(rows)

    docs = tables["documents"].where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(documents, SEGMENT_SQL)
    printed = tables["stage1_projections"].where("text is not null and text <> ''").select(F.col("stage1_id").cast("bigint"), "dictionary", "text").mapInArrow(pages, SEGMENT_SQL)
    size = tables["mdf_value_projections"].select(F.col("value_id").cast("bigint").alias("row_id"), F.length("value").alias("end_at"))
    values = value_languages(tables["mdf_value_projections"], shared).join(size.dropDuplicates(["row_id"]), "row_id")
    values = values.select("table_name", "row_id", F.lit(1).alias("segment_no"), F.lit(0).alias("start_at"), "end_at", F.col("lang_found").alias("language"), "confidence")
    return docs.unionByName(printed).unionByName(values).dropDuplicates(["table_name", "row_id", "segment_no"])
