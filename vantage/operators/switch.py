"""Pairs of probes around a change of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_position(raw) -> Column:
    """Struct of mode (ratio or time), value and whether it was a bare number:
    ``r:0.25``, ``ratio:..``, ``0.3r``, ``t:2.0``, ``2s``; a bare number up to 1 is a ratio."""
    s = F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    n = F.regexp_extract(s, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")
    ratio = s.rlike(r"^(r|ratio)\s*:") | s.rlike(r"^[0-9.]+\s*r$")
    time = s.rlike(r"^(t|time)\s*:") | s.rlike(r"^[0-9.]+\s*s$")
    bare = ~ratio & ~time & n.isNotNull()
    return F.struct(F.when(ratio | (bare & (n <= 1)), "ratio").when(time | bare, "time").alias("mode"), n.alias("value"), bare.alias("heuristic"))


def with_bucket(samples: DataFrame, dt: float) -> DataFrame:
    """Add bucket: the time over dt, rounded half to even."""
    return samples.withColumn("bucket", F.rint(F.col("t").cast("double") / F.lit(float(dt if dt > 0 else 8.0))).cast("long"))


def neighbours(samples: DataFrame) -> DataFrame:
    """Segment samples with a gap sample in a neighbouring bucket of the file, and the other
    way round; other regions go."""
    s = samples.filter(F.col("region").isin("segment", "gap"))
    near = s.select("file", F.explode(F.array(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"), F.when(F.col("region") == "gap", "segment").otherwise("gap").alias("region")).distinct()
    return s.join(near, ["file", "bucket", "region"], "left_semi")


def adjacent_pairs(samples: DataFrame) -> DataFrame:
    """All pairs of a sample and one of the other region in the next bucket, by an equi-join
    on (file, bucket); a pair holds two structs a (first) and b."""
    body = [c for c in samples.columns if c not in ("file", "bucket")]
    a = samples.select("file", "bucket", F.struct(*body).alias("a"))
    b = samples.select("file", (F.col("bucket") - 1).alias("bucket"), F.struct(*body).alias("b"))
    return a.join(b, ["file", "bucket"]).filter(F.col("a.region") != F.col("b.region"))


def span(t: Column, start: Column, end: Column, dt: float, length: Column) -> Column:
    """Start and end, or t +- dt / 2 if either is missing; ordered and within [0, length]."""
    known = start.isNotNull() & end.isNotNull()
    s, e = F.when(known, start).otherwise(t - dt / 2), F.when(known, end).otherwise(t + dt / 2)
    fit = lambda x: F.least(F.greatest(x, F.lit(0.0)), length)
    return F.struct(fit(F.least(s, e)).alias("start"), fit(F.greatest(s, e)).alias("end"))


def place(sp: Column, mode: str, value: float, length: Column) -> Column:
    """A place in a span by ratio or by seconds from its start, within span and length."""
    at = sp["start"] + (sp["end"] - sp["start"]) * value if mode == "ratio" else sp["start"] + value
    return F.least(F.greatest(F.least(F.greatest(at, sp["start"]), sp["end"]), F.lit(0.0)), length)


def probes(pairs: DataFrame, mode: str, value: float, length: Column) -> DataFrame:
    """Two probes of each pair: the middle of the first span, then a place in the second.
    Needs a.span and b.span, a.pos and b.pos; idx counts from 0 in each file."""
    gap_first = F.col("a.region") == "gap"
    kind = F.when(gap_first, "gap_to_segment").otherwise("segment_to_gap")
    pair_id = F.format_string("%s|k%d|%d-%d", kind, F.col("bucket"), F.col("a.pos"), F.col("b.pos"))
    before = F.struct(F.lit(0).alias("side"), F.when(gap_first, "fixed_gap_mid").otherwise("fixed_segment_mid").alias("role"), F.col("a.region").alias("region"), place(F.col("a.span"), "ratio", 0.5, length).alias("t_probe"))
    after = F.struct(F.lit(1).alias("side"), F.when(gap_first, "scan_segment").otherwise("scan_gap").alias("role"), F.col("b.region").alias("region"), place(F.col("b.span"), mode, value, length).alias("t_probe"))
    out = pairs.select("file", "bucket", kind.alias("pair_type"), pair_id.alias("pair_id"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.explode(F.array(before, after)).alias("p")).select("*", "p.*").drop("p")
    order = Window.partitionBy("file").orderBy("bucket", "pair_type", "pos_a", "pos_b", "side")
    return out.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
