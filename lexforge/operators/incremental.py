"""Incremental evaluation: what is cached and still valid, what is to be computed, what has changed; expansion of sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import small_rows


def valid_cache(tasks: DataFrame, cache: DataFrame, keys: list[str], stamps: list[str], version: int) -> DataFrame:
    """Cached rows of this version whose fingerprints all equal the task's."""
    c = cache.where(F.col("version") == version)
    on = [tasks[k].eqNullSafe(c[k]) for k in [*keys, *stamps]]
    return tasks.join(c, on, "inner").select(*[tasks[k] for k in [*keys, *stamps]], *[c[x] for x in c.columns if x not in (*keys, *stamps)])


def to_compute(tasks: DataFrame, cache: DataFrame, keys: list[str], stamps: list[str], version: int, overwrite: list[str] | None = None, language: str = "language") -> DataFrame:
    """Tasks without a valid cached row, and those of the languages to be overwritten."""
    c = cache.where(F.col("version") == version)
    if overwrite:
        c = c.where(~F.col(language).isin(*overwrite))
    return tasks.join(c.select(*keys, *stamps), [*keys, *stamps], "left_anti")


def pruned(cache: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    return cache.join(tasks.select(*keys), keys, "left_semi")


def sync_status(old: DataFrame, new: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, status: new, unchanged, changed or gone, texts compared without final newlines."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"\n+$", "")
    a, b = old.select(*keys, norm(F.col(text)).alias("_a")), new.select(*keys, norm(F.col(text)).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `first`, and those of `second` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def sweep(axes: list[DataFrame], name: str, exclude: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The product of configuration axes (each a small table of one column), less the excluded choices, with a name from a template of {axis}.

    A rule excludes where all its non-null columns agree. Repeated names, no run at all, more than `most` runs, and lists beyond the bound of a configuration raise.
    """
    spark = axes[0].sparkSession
    names = [a.columns[0] for a in axes]
    values = [[r[0] for r in small_rows(a, "an axis of the sweep")] for a in axes]
    size = reduce(lambda x, y: x * len(y), values, 1)
    if not size or most is not None and size > most:
        raise ValueError("no run" if not size else "too many runs")
    # the axes are a configuration's lists; their product is generated row by row from an index
    runs = spark.range(size)
    left = size
    for n, v in zip(names, values):
        left //= len(v)
        runs = runs.withColumn(n, F.get(F.array(*[F.lit(x) for x in v]), ((F.floor(F.col("id") / left)) % len(v)).cast("int")))
    if exclude is not None:
        exclude = spark.createDataFrame(small_rows(exclude, "exclusions of the sweep"), exclude.schema)
        hit = reduce(lambda x, y: x & y, [F.col(f"e.{n}").isNull() | (F.col(f"e.{n}") == F.col(f"r.{n}")) for n in names if n in exclude.columns])
        runs = runs.alias("r").join(F.broadcast(exclude.alias("e")), hit, "left_anti")
    title = F.lit(name)
    for n in names:
        title = F.replace(title, F.lit("{" + n + "}"), F.col(n).cast("string"))
    return runs.select(*names, title.alias("name"))


def save_cache(metrics: DataFrame, path: str, version: int) -> None:
    """Metrics with their version, over what was there."""
    metrics.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_cache(spark, path: str, version: int, schema) -> DataFrame:  # noqa: ANN001
    """Saved metrics of this version; nothing where the cache is missing, unreadable or of another version."""
    from pyspark.errors import AnalysisException

    try:
        saved = spark.read.parquet(path)
        if not {"version", *schema.names} <= set(saved.columns):
            raise ValueError
        return saved.where(F.col("version") == version).select(*schema.names)
    except (AnalysisException, ValueError):
        return spark.createDataFrame([], schema)


def synced(stored: DataFrame, now: DataFrame, keys: list[str], value: str, path: str, dry: bool = False) -> DataFrame:
    """now with status (new, unchanged, updated) against what is stored; rows that differ are written to path, none in a dry run."""
    old = stored.select(*keys, F.to_json(F.struct(value)).alias("_old"), F.lit(True).alias("_there"))
    same = F.col("_old").eqNullSafe(F.to_json(F.struct(value)))
    got = now.join(old, keys, "left").withColumn("status", F.when(F.col("_there").isNull(), "new").when(same, "unchanged").otherwise("updated")).drop("_old", "_there")
    if not dry:
        got.where("status <> 'unchanged'").write.mode("overwrite").parquet(path)
    return got
