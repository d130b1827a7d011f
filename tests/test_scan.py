"""Scans over blocks of four rows against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.test_operators import sequential
from vantage.operators import queryset, scan, score


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_prefix_sums(spark, keys):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]) if keys else "a", i, r.choice([1, 2, 5, None])) for i in range(90)] + ([(f"one{i}", 0, 3) for i in range(30)] if keys else [])
    df = spark.createDataFrame(rows, "k string, i int, n long").repartition(5)
    got = {(x.k, x.i): x.offset for x in scan.prefix_sums(df, "n", "i", keys, block=4).collect()}
    assert got == {(k, i): sum(m or 0 for j, x, m in rows if j == k and x < i) for k, i, _ in rows}
    assert scan.prefix_sums(df.limit(0), "n", "i", keys, block=4).collect() == []


def test_prefix_states(spark):
    r = random.Random(4)
    rows = [(f"f{i:03}", [r.randrange(3) for _ in range(3)], i % 17 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "file string, moves array<int>, again boolean").repartition(6)
    for first in (None, "again"):
        at, want = 0, {}
        for f, m, again in rows:
            want[f] = at = 0 if first and again else at
            at = m[at]
        assert {x.file: x.state for x in scan.prefix_states(df, ["file"], first=first, block=4).collect()} == want
    assert scan.prefix_states(df.limit(0), ["file"], block=4).collect() == []


def test_medians(spark):
    r = random.Random(5)
    kinds = {"few": lambda: r.choice([0.0, 0.5, 1.0]), "many": r.random, "one": lambda: -0.25}
    rows = [(k, v()) for k, v in kinds.items() for _ in range(r.randint(40, 60))] + [("even", 1.0), ("even", 4.0), ("none", None), (None, 7.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {x.k: x["median"] for x in scan.medians(df, "v", ["k"], block=4).collect()}
    assert got == {k: statistics.median(v for j, v in rows if j == k) for k in {k for k, v in rows if v is not None}}
    assert got == {x.k: x.m for x in df.filter("v is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert [x["median"] for x in scan.medians(df, "v", [], block=4).collect()] == [statistics.median(v for _, v in rows if v is not None)]


def test_thinning_by_blocks_and_streams(spark):
    r = random.Random(6)
    rows = [(s, f, i, float(r.randrange(3))) for s in ("open", "mcq") for f in range(60) for i in range(r.randrange(1, 7))]
    df = spark.createDataFrame(rows, "stream string, file long, rank long, t_eval double").repartition(5)
    got = sorted((x.stream, x.file, x.rank) for x in queryset.thin_exact(df, stream=("stream",), block=4).collect())
    want = [(s, f, i) for s in ("mcq", "open") for f, i in sequential([x[1:] for x in rows if x[0] == s])]
    assert got == want
    whole = df.filter("stream = 'open'").drop("stream")
    assert sorted((x.file, x.rank) for x in queryset.thin_exact(whole, block=4).collect()) == sequential([x[1:] for x in rows if x[0] == "open"])
    plain = whole.withColumn("t_eval", F.col("rank").cast("double"))
    both = [sorted((x.file, x.rank) for x in f(plain, block=4).collect()) for f in (queryset.thin_exact, queryset.keep_k_of_n)]
    assert both[0] == both[1]


def test_cut_off_by_blocks(spark):
    rows = [(f, i) for f in range(50) for i in range(f % 5 + 1)]
    df = spark.createDataFrame(rows, "file long, pos long")
    got = sorted({x.file for x in queryset.target_cutoff(df, 70, block=4).collect()})
    sizes = [f % 5 + 1 for f in range(50)]
    assert got == [f for f in range(50) if sum(sizes[:f]) < 70]


@pytest.mark.parametrize("flat", ["drop", "zero"])
def test_trend_of_flat_groups(spark, flat):
    r = random.Random(7)
    rows = [("m", "f", str(i), True, True, True, *([0.5] * 3 if i % 4 == 0 else [r.choice([0.1, 0.4, 0.9]) for _ in range(3)])) for i in range(41)]
    df = spark.createDataFrame(rows, "model string, file string, anchor string, ok0 boolean, ok1 boolean, ok2 boolean, c0 double, c1 double, c2 double")
    got = score.confidence_trend(df, ["model"], flat, block=4).first()
    slopes, z = [], []
    for *_, a, b, c in rows:
        slopes.append((c - a) / 2)
        std = statistics.pstdev([a, b, c])
        z += [slopes[-1] / std] if std > 1e-12 else [0.0] * (flat == "zero")
    assert got["groups"] == 41
    for name, v in (("slope", slopes), ("zslope", z)):
        want = (statistics.mean(v), statistics.median(v), statistics.pstdev(v), sum(x < 0 for x in v) / len(v))
        assert [got[f"{name}_{s}"] for s in ("mean", "median", "std", "negative")] == pytest.approx(want)
