"""Problem 7: a training mix in which each source has its target share of the tokens.

Documents are counted by source and exact token length. A source's budget is its share of the mix; whole passes
over its documents come first, then for the rest the same part of every length, and the small remainder is
filled by bounded-knapsack dynamic programming over the lengths still to be had. How many documents of each
length are used once more is thus fixed; which ones is drawn by a seeded hash. Where few documents share a length
the parts round down, and the longest documents are topped up first, so the mix leans to them by up to that much.

Shares are those of the targeted sources that have documents, scaled to 1: a source without documents can't
contribute, and documents of sources without a target aren't used. The mix is as large as max_repeats allow for
all of these sources together, or `total` tokens if that is less.

Defined results: null or empty texts count 0 tokens and are never used; null sources have no target; a doc_id given
twice counts once; negative or null target shares count as 0; max_repeats below 1 leaves a source out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.session import small_rows

#: The folder of the public tokenizers and the vocabulary used; both are parameters of tokens_of.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Hash buckets within a source and length, so that no rank is taken over a whole source at once.
BUCKETS = 64
#: Largest remainder that the knapsack fills exactly; it is at least four times the longest document.
GAP = 40_000


def encoder(ranks: bytes, pattern: str):  # noqa: ANN201
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def tokens_of(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens. The vocabulary file is read on the driver and sent to the executors; its size is fixed."""
    import public_tokenizers

    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text")).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take, at most counts, so that their sum comes as near to goal as can be without passing it.

    Bounded knapsack: counts are split into powers of two, and for every reachable sum the first part that reaches it is kept.
    """
    parts: list[tuple[int, int, int]] = []
    for k in np.argsort(-lengths):
        left, size = int(min(counts[k], goal // max(1, lengths[k]))), 1
        while left > 0:
            take = min(size, left)
            parts.append((int(k), take, int(lengths[k]) * take))
            left -= take
            size *= 2
    came = np.full(goal + 1, -1, np.int32)
    came[0] = len(parts)
    for n, (_, _, w) in enumerate(parts):
        if w > goal:
            continue
        new = np.flatnonzero((came[: goal + 1 - w] >= 0) & (came[: goal + 1 - w] != n) & (came[w:] < 0))
        came[new + w] = n
        if came[goal] >= 0:
            break
    best = int(np.flatnonzero(came >= 0)[-1])
    out = np.zeros(len(lengths), np.int64)
    while best > 0:
        k, take, w = parts[came[best]]
        out[k] += take
        best -= w
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many documents of each length sum up to goal: the same part of every length, then the remainder by knapsack."""
    total = int((lengths * counts).sum())
    if goal <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if goal >= total:
        return counts.copy()
    gap = max(GAP // 4, 4 * int(lengths.max()))
    part = max(0.0, (goal - gap) / total)
    taken = np.floor(counts * part).astype(np.int64)
    # lengths with few documents round down; the longest are topped up while the remainder is large
    rest = goal - int((taken * lengths).sum())
    for k in np.argsort(-lengths):
        while rest > GAP + 4 * lengths.max() and taken[k] < counts[k]:
            more = min(int(counts[k] - taken[k]), int((rest - GAP) // lengths[k]))
            if more <= 0:
                break
            taken[k] += more
            rest -= more * int(lengths[k])
    return taken + knapsack(lengths, counts - taken, rest)


def budgets(counted: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """source, target_share, max_repeats, have, share (scaled to the sources that can be had), budget."""
    have = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("have"))
    t = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = t.join(have.where("have > 0"), "source")
    everything = W.partitionBy(F.lit(1))  # one row a target
    got = got.withColumn("share", F.col("target_share") / F.sum("target_share").over(everything))
    size = F.floor(F.min(F.col("have") * F.col("max_repeats") / F.col("share")).over(everything))
    size = F.least(size, F.lit(total)) if total is not None else size
    return got.withColumn("budget", F.floor(size * F.col("share") + F.lit(1e-6)).cast("bigint"))


PLAN_SQL = "source string, n_tokens bigint, passes bigint, extra bigint"


def plan(counted: DataFrame, budget: DataFrame) -> DataFrame:
    """PLAN_SQL: passes over all documents of a length, and how many of them are used once more.

    A group is the list of distinct lengths of one source, not its documents.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["n_tokens"].to_numpy()
        counts = table["docs"].to_numpy()
        goal, most = table["budget"][0].as_py(), table["max_repeats"][0].as_py()
        whole = int((lengths * counts).sum())
        passes = min(goal // whole, most)
        extra = fill(lengths, counts, goal - passes * whole) if passes < most else np.zeros(len(lengths), np.int64)
        return pa.table({"source": table["source"], "n_tokens": table["n_tokens"], "passes": pa.array(np.full(len(lengths), passes), pa.int64()), "extra": pa.array(extra, pa.int64())})

    return counted.join(F.broadcast(budget.select("source", "budget", "max_repeats")), "source").groupBy("source").applyInArrow(run, PLAN_SQL)


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix: doc_id, source, n_tokens, times (1 or more) of the chosen documents; shares: source, target_share, docs, tokens, reached_share, max_repeats).

    targets: a fixed table (source, target_share, max_repeats), whose size is checked.
    """
    spark = docs.sparkSession
    targets = spark.createDataFrame(small_rows(targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")), "mix_targets"), "source string, target_share double, max_repeats int")
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    every = tokens_of(docs).dropDuplicates(["doc_id"]).withColumn("h", hashed)
    # what every later step reads is three numbers a document; it is written once to the shared folder, so that texts are encoded once
    from lexforge.session import checkpoint_dir

    checkpoint_dir(spark)
    every = every.checkpoint()
    counted_docs = every.where("source is not null and n_tokens > 0")
    bucket = F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS))
    counted_docs = counted_docs.withColumn("bucket", bucket)
    in_bucket = counted_docs.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("docs"))
    counted = in_bucket.groupBy("source", "n_tokens").agg(F.sum("docs").alias("docs"))
    budget = budgets(counted, targets, total)
    planned = plan(counted, budget)
    before = F.coalesce(F.sum("docs").over(W.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = in_bucket.withColumn("before", before).join(planned, ["source", "n_tokens"]).select("source", "n_tokens", "bucket", "before", "docs", "passes", "extra")
    ranked = counted_docs.join(starts, ["source", "n_tokens", "bucket"])
    rank = F.row_number().over(W.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id"))
    mix = ranked.select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("before") + rank <= F.col("extra")).cast("bigint")).cast("int").alias("times")).where("times > 0")
    used = mix.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"))
    everything = W.partitionBy(F.lit(1))
    shares = (
        targets.join(used, "source", "left")
        .select("source", "target_share", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_times", F.lit(0)).alias("most_times"), "max_repeats")
        .withColumn("reached_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(everything), F.lit(0.0)))
    )
    return mix, shares
