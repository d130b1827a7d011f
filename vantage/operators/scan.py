"""Prefix scans and order statistics over ordered tables of any length, block by block.

A table is cut into blocks of neighbouring rows by a range shuffle; blocks are summed up
side by side, the sums are scanned the same way (level by level while they are many), and
each block goes on from its start.  No task holds more than about a block of rows.
"""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about.
BLOCK = 65_536


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder of spark.checkpoint.dir and read from there.  A
    folder of its own is made up only where none is set and all runs on one machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, of which nulls are equal to each other."""
    other = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys] or [F.lit(True)]
    return a.join(other, on, how).drop(*[f"__b_{k}" for k in keys])


def blocks(table: DataFrame, order: list[str], block: int) -> tuple[DataFrame, int]:
    """table with __block, numbered in order, and how many blocks there are.  Rows that are
    equal in order share a block."""
    n = max(1, -(-table.count() // block))
    if n == 1:
        return table.withColumn("__block", F.lit(0)), 1
    return staged(table.repartitionByRange(n, *order).withColumn("__block", F.spark_partition_id())), n


def prefix_sums(table: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), out: str = "offset", block: int = BLOCK) -> DataFrame:
    """table with out, the sum of value over earlier rows of the same keys; 0 at the start.

    A row is told from others of its keys by order.  Null keys are keys like others and a
    null order comes first; null values count as 0.
    """
    keys = [*keys]
    cut, n = blocks(staged(table), [*keys, order], block)
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(table.schema[value].dataType)
    cut = cut.withColumn(out, F.coalesce(F.sum(value).over(inside), zero))
    if n == 1:
        return cut.drop("__block")
    sums = cut.groupBy(*keys, "__block").agg(F.coalesce(F.sum(value), zero).alias("__sum"))
    # keys within one block start at 0; of those in several there are fewer than two for each block
    several = cut.groupBy(*keys).agg(F.min("__block").alias("__lo"), F.max("__block").alias("__hi")).filter("__lo < __hi").select(*keys)
    sums = same(sums, several, keys, "left_semi") if keys else sums
    base = prefix_sums(sums.withColumnRenamed("__block", "__row"), "__sum", "__row", tuple(keys), "__base", block)
    base = base.select(*keys, F.col("__row").alias("__block"), F.col("__base").alias("__add"))
    return same(cut, base, [*keys, "__block"], "left").withColumn(out, F.col(out) + F.coalesce("__add", F.lit(0))).drop("__block", "__add")


def prefix_states(table: DataFrame, order: list[str], moves: str = "moves", first: str | None = None, out: str = "state", block: int = BLOCK) -> DataFrame:
    """table (order, moves) with out, the state before each row: a machine of n states
    starts in state 0 and a row takes it from state s to moves[s].  Rows for which first
    holds find it in state 0 again.

    The moves of a block's rows, one after another, are again one list of n states.
    """
    begins = F.coalesce(F.col(first), F.lit(False)) if first else F.lit(False)
    moves_ = F.when(begins, F.transform(moves, lambda _: F.get(moves, F.lit(0)))).otherwise(F.col(moves))
    rows = staged(table.select(*order, begins.alias("__first"), moves_.cast("array<int>").alias("__moves")))
    cut, n = blocks(rows, order, block)
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in order)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        own = None
        for f in in_order(pdf, order)["__moves"]:
            own = list(f) if own is None else [f[s] for s in own]
        return pd.DataFrame({"__block": [pdf["__block"].iloc[0]], "moves": [own]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf, order)
        at, states = int(pdf["__from"].iloc[0]), []
        for f, again in zip(pdf["__moves"], pdf["__first"], strict=True):
            states.append(0 if again else at)
            at = int(f[at])
        return pdf[order].assign(state=states)

    if n == 1:
        starts = cut.withColumn("__from", F.lit(0))
    else:
        whole = cut.groupBy("__block").applyInPandas(compose, "__block int, moves array<int>")
        whole = prefix_states(whole.withColumnRenamed("__block", "__row"), ["__row"], block=block)
        starts = cut.join(whole.select(F.col("__row").alias("__block"), F.col("state").alias("__from")), "__block")
    states = starts.groupBy("__block").applyInPandas(follow, f"{columns}, state int").withColumnRenamed("state", out)
    return same(table, states, order)


def in_order(pdf: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    return pdf.sort_values(order, na_position="first", kind="stable")


def medians(values: DataFrame, value: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, median) of value, exact: the mean of the two middle values of an even number.

    Equal values are counted first; counts by range of values tell which ranges hold the
    middle, and only these are looked into.  Null values don't count; keys without values
    give no row.
    """
    counted = staged(values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")))
    cut, _ = blocks(counted, [*keys, value], block)
    ranges = cut.groupBy(*keys, "__block").agg(F.sum("__n").alias("__n"))
    total = ranges.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    ranges = prefix_sums(ranges.withColumnRenamed("__block", "__row"), "__n", "__row", tuple(keys), "__base", block).withColumnRenamed("__row", "__block")
    ranges = same(ranges, total, keys)
    low, high = F.expr("(__total - 1) div 2"), F.expr("__total div 2")
    middle = ranges.filter((F.col("__base") <= high) & (F.col("__base") + F.col("__n") > low)).drop("__n")
    near = same(cut, middle, [*keys, "__block"])
    before = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__at", F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    holds = lambda rank: F.max(F.when((F.col("__at") <= rank) & (F.col("__at") + F.col("__n") > rank), F.col(value)))
    return near.groupBy(*keys).agg((0.5 * holds(low) + 0.5 * holds(high)).alias("median"))


def long_rows(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Long rows (keys, name, value) of several columns of numbers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(*keys, F.explode(pairs).alias("__x")).select(*keys, "__x.name", "__x.value")
