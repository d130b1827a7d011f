"""Building question sets: filters, order, thinning, windows, options, prompts, memory.

Samples have file, pos (place in the file) and the columns an operator names.  Windows are
over one file; nothing is ordered over all samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from vantage.functions.parse import strip
from vantage.operators import scan


def reason_of(*names: Column) -> Column:
    return F.replace(F.lower(strip(F.coalesce(*names, F.lit("")))), F.lit(" "), F.lit(""))


def usable_now(samples: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Samples with a time and a valid annotation; rejected ones only for allowed reasons.
    Needs is_invalid_annotation, t_eval, is_rejected, reject_reason."""
    bad = F.coalesce("is_rejected", F.lit(False)) & ~reason_of(F.col("reject_reason")).isin(*allow)
    return samples.filter(~F.coalesce("is_invalid_annotation", F.lit(False)) & F.col("t_eval").isNotNull() & ~bad)


def usable_other(samples: DataFrame) -> DataFrame:
    """All rejected samples go."""
    return samples.filter(~F.coalesce("is_rejected", F.lit(False)) & F.col("t_eval").isNotNull())


def in_region(samples: DataFrame, region: str = "segment") -> DataFrame:
    """Samples of one region, written in any case or with blanks around; none has a null one."""
    return samples.filter(F.lower(strip(F.coalesce("region", F.lit("")))) == region)


def canonical_order(samples: DataFrame) -> DataFrame:
    """Add rank within the file by idx (missing last), time and position."""
    order = Window.partitionBy("file").orderBy(F.coalesce(F.col("idx").cast("double"), F.lit(1e9)), "t_eval", "pos")
    return samples.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def dedupe_by_time(samples: DataFrame, time: str = "t_eval") -> DataFrame:
    """The first sample at each time of a file."""
    first = Window.partitionBy("file", time).orderBy("rank")
    return samples.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def file_offsets(samples: DataFrame, stream: list[str], block: int = scan.BLOCK) -> DataFrame:
    """(stream, file, n, offset): samples of the stream in files before, in path order, by a
    prefix sum over blocks of files."""
    sizes = samples.groupBy(*stream, "file").agg(F.count(F.lit(1)).alias("n"))
    return scan.prefix_sums(sizes, "n", "file", tuple(stream), "offset", block)


def keep_k_of_n(samples: DataFrame, k: int = 2, n: int = 3, stream: tuple[str, ...] = (), block: int = scan.BLOCK) -> DataFrame:
    """Keep k of every n samples of a stream, counted across files in path order; for
    samples whose times within a file differ."""
    keys = [*stream]
    s = scan.same(samples, file_offsets(samples, keys, block).drop("n"), [*keys, "file"])
    order = Window.partitionBy(*keys, "file").orderBy("rank")
    s = s.withColumn("__at", F.col("offset") + F.row_number().over(order) - 1)
    return s.filter(F.pmod("__at", F.lit(n)) < k).drop("__at", "offset")


def thin_exact(samples: DataFrame, k: int = 2, n: int = 3, unit: str | None = None, stream: tuple[str, ...] = (), block: int = scan.BLOCK) -> DataFrame:
    """The same where times repeat: a time counts as used only if its unit was kept, so a
    later unit at a time that was dropped is tried again and moves the phase.

    A file is a function from the phase before it to the phase after it and the kept
    units.  Files are evaluated once, for all n phases side by side; the small functions,
    n numbers for each file, are composed in path order block by block, so no task holds a
    row of every file; the phase before a file picks its units.  A stream starts in
    phase 0.  A file's samples are read by one task.
    """
    key = unit or "rank"
    keys = [*stream, "file"]
    columns = samples.select(*keys, F.col(key).alias("unit"), "t_eval", "rank")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        units = pdf.sort_values("rank").drop_duplicates("unit")
        steps = list(zip(units["unit"].tolist(), pd.factorize(units["t_eval"])[0].tolist(), strict=True))
        moves, kept = [], []
        for phase in range(n):
            at, used, own = phase, set(), []
            for u, t in steps:
                if t in used:
                    continue
                if at < k:
                    used.add(t)
                    own.append(u)
                at = at + 1 if at + 1 < n else 0
            moves.append(at)
            kept.append(own)
        return pdf[keys].iloc[:1].assign(moves=[moves], kept=[kept])

    schema = StructType([*[columns.schema[c] for c in keys], StructField("moves", ArrayType(IntegerType())), StructField("kept", ArrayType(ArrayType(LongType())))])
    masks = scan.staged(columns.groupBy(*keys).applyInPandas(run, schema))
    moves = masks.select(*keys, "moves")
    if stream:
        starts = masks.groupBy(*stream).agg(F.min("file").alias("__start"))
        moves = scan.same(moves, starts, [*stream]).withColumn("first", F.col("file").eqNullSafe(F.col("__start"))).drop("__start")
    states = scan.prefix_states(moves, keys, first="first" if stream else None, out="phase", block=block).select(*keys, "phase")
    kept = scan.same(masks, states, keys).select(*keys, F.explode(F.get("kept", F.col("phase"))).alias(key))
    return scan.same(samples, kept, [*keys, key], "left_semi")


def anchor_islands(samples: DataFrame, anchors: tuple[str, ...] = ("anchor_idx",)) -> DataFrame:
    """Add unit: the number within the file of the run of neighbouring samples with one
    anchor (or, without an anchor, one idx), and unit_t, the time of its first row."""
    order = Window.partitionBy("file").orderBy("rank")
    own = F.coalesce(*[F.concat(F.lit("a"), F.col(a)) for a in anchors], F.concat(F.lit("i"), F.col("idx")), F.concat(F.lit("r"), F.col("rank")))
    s = samples.withColumn("__a", own)
    s = s.withColumn("__new", F.coalesce((F.col("__a") != F.lag("__a").over(order)).cast("int"), F.lit(0)))
    s = s.withColumn("unit", F.sum("__new").over(order)).drop("__a", "__new")
    return s.withColumn("unit_t", F.first("t_eval").over(Window.partitionBy("file", "unit").orderBy("rank")))


def target_cutoff(samples: DataFrame, target: int = 800, stream: tuple[str, ...] = (), block: int = scan.BLOCK) -> DataFrame:
    """Whole files of a stream up to and including the one that reaches the target."""
    keys = [*stream, "file"]
    files = file_offsets(samples, [*stream], block).filter(F.col("offset") < target).select(*keys)
    return scan.same(samples, files, keys, "left_semi")


def answerable(samples: DataFrame, every: bool = False) -> DataFrame:
    """Only predictable (NN) samples unless all states are asked for."""
    return samples if every else samples.filter(F.upper(F.trim("group_state")) == "NN")


def scheduled_time(samples: DataFrame, full: bool) -> DataFrame:
    """t_eval_rel within the clip; t_eval also moved by the interval's start in full mode."""
    move = F.coalesce("interval_start_sec", F.lit(0.0)) if full else F.lit(0.0)
    return samples.withColumns({"t_eval_rel": F.col("t_eval").cast("double"), "t_eval": F.col("t_eval").cast("double") + move})


def first_positive(*values: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v.cast("double")) for v in values])


def lag_of(step: Column, own: list[Column], lags: Column | None = None) -> Column:
    """First positive of the sample's own values, the list by step, 8 (step + 1), 8."""
    listed = [F.try_element_at(lags, step + 1)] if lags is not None else []
    return F.coalesce(first_positive(*own, *listed), F.when(step.isin(0, 1, 2), 8.0 * (step + 1)), F.lit(8.0))


def horizon_of(step: Column, own: list[Column], lists: list[Column], anchor: Column, t: Column) -> Column:
    listed = [F.try_element_at(x, step + 1) for x in lists]
    return F.coalesce(first_positive(*own, *listed, F.when(anchor > 0, anchor - t)), F.when(step.isin(0, 1, 2), 8.0 * (step + 1)), F.lit(8.0))


def lookback_window(t: Column, lookback: Column) -> Column:
    """[max(0, t - lookback), t]; 20 seconds by default."""
    return F.struct(F.greatest(F.lit(0.0), t - F.coalesce(lookback, F.lit(20.0))).alias("start"), t.alias("end"))


def evidence_window(t: Column, lag: Column, start: Column, end: Column, offset: Column) -> Column:
    """Ends at t; starts at the evidence if both its ends are known, else 2 s before t - lag."""
    begin = F.when(start.isNotNull() & end.isNotNull(), start + offset).otherwise(t - lag - 2.0)
    return F.struct(F.least(F.greatest(begin, F.lit(0.0)), t).alias("start"), t.alias("end"), (t - lag).alias("target"))


def context_window(t: Column, horizon: Column, grow: bool) -> Column:
    """20 seconds, or the horizon if that is longer, before t; target t + horizon."""
    span = F.greatest(F.lit(20.0), horizon) if grow else F.lit(20.0)
    return F.struct(F.greatest(F.lit(0.0), t - span).alias("start"), t.alias("end"), (t + horizon).alias("target"))


def online_window(t: Column, start: Column, end: Column, least: Column) -> Column:
    """The end never after t, the start within [0, end]; a window that is too short grows
    into the past only."""
    e = F.greatest(F.lit(0.0), F.least(F.coalesce(end, t), t))
    s = F.least(F.greatest(F.lit(0.0), F.coalesce(start, e - least)), e)
    return F.struct(F.when(e - s < least, F.greatest(F.lit(0.0), e - least)).otherwise(s).alias("start"), e.alias("end"))


def lookahead_violations(windows: DataFrame, end: str, t: str) -> DataFrame:
    """Must be empty: windows that end after the time of asking."""
    return windows.filter(F.col(end) > F.col(t) + 1e-9)


def attach_options(samples: DataFrame, options: DataFrame, keys: tuple[str, ...] = ("file", "key")) -> tuple[DataFrame, DataFrame]:
    """Samples with their four options, not shuffled anew, and the violations: samples
    without options, or with another number of them."""
    got = samples.join(options, list(keys), "left")
    fine = F.coalesce(F.size("options") == 4, F.lit(False))
    return got.filter(fine), got.filter(~fine).select(*keys, F.when(F.col("options").isNull(), "missing").otherwise("not_four").alias("fault"))


def render_prompts(samples: DataFrame, templates: DataFrame) -> DataFrame:
    """Fill the template of (task, flavor): times with one decimal, options A to D."""
    got = samples.join(templates, ["task", "flavor"])
    text = F.col("template")
    for name in ("t_eval", "window_start", "window_end"):
        if name in samples.columns:
            text = F.replace(text, F.lit("{" + name + "}"), F.format_string("%.1f", F.col(name).cast("double")))
    for i, x in enumerate("ABCD"):
        text = F.replace(text, F.lit("{" + x + "}"), F.element_at("options", i + 1))
    return got.withColumn("prompt", text).drop("template")


def memory_windows(t: Column, dense: float = 10.0, sparse: float = 30.0, lag: Column | None = None) -> Column:
    """Dense window before t and the sparse one before that."""
    end = F.greatest(F.lit(0.0), t.cast("double"))
    start = F.greatest(F.lit(0.0), end - dense)
    far = F.greatest(F.lit(0.0), start - sparse)
    note = F.when(lag > dense + sparse, "coverage_limited_long_lag") if lag is not None else F.lit(None).cast("string")
    return F.struct(start.alias("dense_start"), end.alias("dense_end"), far.alias("sparse_start"), start.alias("sparse_end"), F.lit(True).alias("no_lookahead"), note.alias("note"))


def keyframes(start: Column, end: Column, fps: float = 0.25) -> Column:
    """floor(length * fps) + 1 stamps from start, capped at end, without repeats."""
    n = F.floor(F.greatest(end - start, F.lit(0.0)) * fps).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.round(F.least(end, start + i / fps), 6)))


def segment_key(prefix: str, **fields: Column) -> Column:
    """Digest of named fields in order of name; nulls stay in it."""
    named = [F.coalesce(fields[k].cast("string"), F.lit("null")).alias(k) for k in sorted(fields)]
    return F.concat(F.lit(prefix + "_"), F.sha1(F.to_json(F.struct(*named))))


def caption_reuse(samples: DataFrame, captions: DataFrame, unknown: str = "(caption unavailable)") -> tuple[DataFrame, DataFrame]:
    """Samples with the caption of their segment, and the segments: uses and whether the
    caption is missing.  Many samples share a segment, so captions are joined to segments
    once."""
    uses = samples.groupBy("segment_key").agg(F.count(F.lit(1)).alias("uses"))
    segments = uses.join(captions, "segment_key", "left").withColumn("missing", F.col("caption").isNull())
    got = samples.join(segments.select("segment_key", F.coalesce("caption", F.lit(unknown)).alias("caption")), "segment_key", "left")
    return got, segments.drop("caption")
