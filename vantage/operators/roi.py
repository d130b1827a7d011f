"""Regions of interest by frame: choose frames, join their rows, check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames_1fps(start: Column, end: Column, n: Column, most: int) -> Column:
    """Frame numbers floor(start)..floor(end) within 0..n-1, one at least, thinned evenly to
    at most most of them."""
    last = F.greatest(n.cast("int") - 1, F.lit(0))
    a = F.least(F.greatest(F.floor(start).cast("int"), F.lit(0)), last)
    b = F.greatest(F.least(F.floor(end).cast("int"), last), a)
    every = F.sequence(a, b)
    size = F.size(every)
    some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(every, (F.floor(i * size / most) + 1).cast("int")))
    return F.when(size <= most, every).otherwise(F.array_distinct(some))


#: Neighbouring frames of a video whose rows are packed together.
FRAMES = 64


def packed(rows: DataFrame, keys: list[str], size: int = FRAMES) -> DataFrame:
    """(keys, block, frames): rows of size neighbouring frames as a map from the frame's
    number to its row.  Of rows with one frame number the last line holds."""
    last = rows.groupBy(*keys, "frame_idx").agg(F.max_by(F.struct("coord", "boxes", "gaze"), "line_no").alias("row"))
    block = F.floor(F.col("frame_idx") / size).alias("block")
    return last.filter("frame_idx is not null").groupBy(*keys, block).agg(F.map_from_entries(F.collect_list(F.struct("frame_idx", "row"))).alias("packed"))


def roi_join(samples: DataFrame, rows: DataFrame, keys: list[str], radius: float = 0.12, gaze: dict | None = None, size: int = FRAMES) -> DataFrame:
    """Samples with rois, one struct per frame in frame order; a frame without a row gets
    empty boxes.  Of rows with one frame number the last line holds.  gaze overrides the
    circle: {"x", "y", "r"} in the frame's coordinates, its radius within 1e-6 and 0.5.

    Rows are packed by video and block of frames, so a sample joins the few blocks that its
    frames lie in and picks them there; a long video is many blocks, so none is hot.
    Neither the packed rows nor the regions are ever broadcast: Spark guesses their size
    from the compressed files, far too low, and they would have to pass through the driver.
    """
    block_of = lambda f: F.floor(f / size)
    wide = samples.select("sample_id", *keys, "frames", F.explode(F.array_distinct(F.transform("frames", block_of))).alias("block"))
    got = wide.join(packed(rows, keys, size).hint("merge"), [*keys, "block"], "left")

    def roi(at, frame, row):
        circle = F.struct(row["gaze"]["x"].alias("x"), row["gaze"]["y"].alias("y"), F.coalesce(row["gaze"]["r"], F.lit(radius)).alias("r"))
        if gaze:
            circle = F.struct(*[F.lit(float(gaze[c])).alias(c) for c in "xy"], F.lit(min(0.5, max(1e-6, float(gaze.get("r", radius))))).alias("r"))
        boxes = F.coalesce(row["boxes"], F.array().cast("array<array<double>>"))
        return F.struct(at.alias("at"), frame.alias("frame_idx"), F.coalesce(row["coord"], F.lit("norm")).alias("coord"), boxes.alias("boxes"), F.when(row["gaze"].isNotNull() | F.lit(bool(gaze)), circle).alias("gaze"))

    here = F.filter(F.transform("frames", lambda f, i: F.struct(i.alias("at"), f.alias("f"))), lambda x: block_of(x["f"]) == F.col("block"))
    part = F.transform(here, lambda x: roi(x["at"], x["f"], F.try_element_at("packed", x["f"])))
    rois = got.select("sample_id", part.alias("part")).groupBy("sample_id").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("rois"))
    return samples.join(rois.hint("merge"), "sample_id", "left")


def roi_violations(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows that are not normalised: another coordinate kind, boxes without four numbers, or
    numbers outside 0..1."""
    out = lambda v: (v < -eps) | (v > 1 + eps)
    fault = (
        F.when(F.coalesce("coord", F.lit("")) != "norm", "coord").when(F.exists("boxes", lambda b: F.size(b) != 4), "box_size")
        .when(F.exists(F.flatten("boxes"), out), "box_range").when(out(F.col("gaze.x")) | out(F.col("gaze.y")), "gaze_range")
    )
    return rows.withColumn("fault", fault).filter("fault is not null")


def first_existing(records: DataFrame, candidates: str, files: DataFrame, key: str) -> DataFrame:
    """The first candidate path that exists, else the first candidate."""
    wide = records.select(key, F.posexplode(candidates).alias("rank", "path"))
    hit = wide.join(files.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "rank").alias("hit"))
    return records.join(hit, key, "left").withColumn("resolved", F.coalesce("hit", F.element_at(candidates, 1))).drop("hit")
