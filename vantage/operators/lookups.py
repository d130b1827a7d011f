"""Joins by nearest time, with fallbacks, and with caches of judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_by_key_then_time(preds: DataFrame, truths: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Predictions (file, key, t, id) with a truth of their file: by key, else the nearest
    time within tolerance.  Times are put into buckets of the tolerance's width and a truth
    into three of them, so the nearest is found by an equi-join; of equally near truths
    the first in list order wins, of truths with one time the last row."""
    by_key = truths.groupBy("file", "key").agg(F.max_by(F.struct("pos", "t", "truth"), "pos").alias("m"))
    first = preds.join(by_key, ["file", "key"], "left")
    rest = first.filter("m is null").drop("m")
    width = max(tolerance, 1e-9)
    cell = lambda c: F.floor(F.col(c).cast("double") / width)
    times = truths.groupBy("file", "t").agg(F.max_by(F.struct("pos", "t", "truth"), "pos").alias("m"), F.min("pos").alias("first_pos"))
    spread = times.select("file", F.col("t").alias("tt"), "m", "first_pos", F.explode(F.sequence(cell("t") - 1, cell("t") + 1)).alias("cell"))
    near = rest.withColumn("cell", cell("t")).join(spread, ["file", "cell"]).withColumn("d", F.abs(F.col("t") - F.col("tt"))).filter(F.col("d") <= tolerance)
    best = near.groupBy("id").agg(F.min_by("m", F.struct("d", "first_pos")).alias("m"))
    second = rest.join(best, "id", "left")
    how = lambda name: F.when(F.col("m").isNotNull(), name)
    a = first.filter("m is not null").withColumn("how", F.lit("key"))
    return a.unionByName(second.withColumn("how", F.coalesce(how("time"), F.lit("none")))).select("id", "file", "how", F.col("m.truth").alias("truth"))


def with_fallback(samples: DataFrame, sources: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """value from the first source that has it, and source, its name (else ``none``)."""
    out = samples
    for name, table, keys in sources:
        out = out.join(table.select(*keys, F.col(value).alias(f"__{name}")), keys, "left")
    label = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), n) for n, _, _ in sources], F.lit("none"))
    got = F.coalesce(*[F.col(f"__{n}") for n, _, _ in sources])
    return out.withColumn(value, got).withColumn("source", label).drop(*[f"__{n}" for n, _, _ in sources])


def judge_key(response: str, options: str | None = None):
    """sha1 of the response and, if there are any, its numbered options."""
    parts = [F.coalesce(F.col(response), F.lit(""))]
    if options:
        parts.append(F.array_join(F.transform(options, lambda o, i: F.concat(i, F.lit(":"), o)), "\n"))
    return F.sha1(F.concat_ws("\n", *parts))


def judge_cache(unresolved: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers filled from the cache (judge_key, judged) and the distinct keys still to ask."""
    got = unresolved.join(cache, "judge_key", "left")
    ask = unresolved.join(cache, "judge_key", "left_anti").select("judge_key", "response").dropDuplicates(["judge_key"])
    return got, ask
