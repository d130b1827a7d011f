"""The leaderboard: long metrics of all tasks, one wide row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators import score

#: Fixed column order of the table.
POSITIONS, GROUPS, STEPS = ("ss1", "ss2", "ss3"), ("predictable", "branch_only", "surprise_only", "branch_and_surprise"), (0, 1, 2)
COLUMNS = [
    "now_rec", "now_prec", "now_mcq_acc", *[f"{p}_{d}_{m}" for p in POSITIONS for m in ("acc", "conf") for d in ("fg2bg", "bg2fg")],
    *[f"sh_pred_{g}_{m}" for m in ("acc", "conf") for g in GROUPS],
    *[f"{t}_{s}_{m}" for t in ("ms_pred", "ms_rtrv") for m in ("acc", "conf") for s in ("step0", "step1", "step2", "multi_avg")], "sh_rtrv_acc",
]


def cells(joined: DataFrame, keys: list[str]) -> DataFrame:
    """What all metrics but the switch's need, in one pass over the joined samples: counts
    and sums by keys.  A sample without truth letter counts in no accuracy."""
    known, valid = F.col("truth") != "", F.coalesce("ans", F.lit("")) != ""
    yes, no, hit = F.col("true_state") == "INTERACTION", F.col("true_state") == "NO_INTERACTION", F.coalesce("state", F.lit("INVALID")) == "INTERACTION"
    return joined.groupBy(*keys).agg(
        F.count_if(known).alias("total"), F.count_if(known & valid & (F.col("ans") == F.col("truth"))).alias("correct"), F.sum("conf").alias("conf_sum"), F.count("conf").alias("conf_n"),
        F.count_if(yes & hit).alias("tp"), F.count_if(no & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"),
    )


def switch_metrics(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Success over valid pairs and confidence by position (a column) and direction."""
    got = score.switch_scores(score.switch_pairs(probes, [*keys, "position"]), [*keys, "position"]).filter("pair_type in ('segment_to_gap', 'gap_to_segment')")
    way = F.when(F.col("pair_type") == "segment_to_gap", "_fg2bg").otherwise("_bg2fg")
    a = got.select(*keys, F.concat("position", way, F.lit("_acc")).alias("metric"), F.col("rate_valid").alias("value"))
    return a.unionByName(got.select(*keys, F.concat("position", way, F.lit("_conf")).alias("metric"), F.col("conf").alias("value")))


def wide_row(cells: DataFrame, probes: DataFrame, keys: list[str], at: dict[str, Column]) -> DataFrame:
    """The row of all metrics in one aggregation of the cells and one of the probes.  at:
    which cells each block is from (now_state, now_mcq, sh_pred, sh_pred_conf, ms_pred,
    ms_pred_conf, ms_rtrv, ms_rtrv_conf, sh_rtrv)."""
    share = lambda part, whole, where: score.rate(F.sum(F.when(where, F.col(part))), F.sum(F.when(where, F.col(whole))))
    acc = lambda where: share("correct", "total", where)
    conf = lambda where: share("conf_sum", "conf_n", where)
    hits = lambda c: F.sum(F.when(at["now_state"], F.col(c)))
    out = {"now_rec": score.rate(hits("tp"), hits("tp") + hits("fn")), "now_prec": score.rate(hits("tp"), hits("tp") + hits("fp")), "now_mcq_acc": acc(at["now_mcq"]), "sh_rtrv_acc": acc(at["sh_rtrv"])}
    for way, kind, block in ((acc, "acc", ""), (conf, "conf", "_conf")):
        out |= {f"sh_pred_{g}_{kind}": way(at[f"sh_pred{block}"] & (F.col("grp") == g)) for g in GROUPS}
        out |= {f"{t}_step{s}_{kind}": way(at[f"{t}{block}"] & (F.col("step") == s)) for t in ("ms_pred", "ms_rtrv") for s in STEPS}
    row = cells.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()])
    mean = lambda t, kind: F.array_compact(F.array(*[F.col(f"{t}_step{s}_{kind}") for s in STEPS]))
    row = row.withColumns({f"{t}_multi_avg_{k}": F.try_divide(F.aggregate(mean(t, k), F.lit(0.0), lambda a, x: a + x), F.size(mean(t, k))) for t in ("ms_pred", "ms_rtrv") for k in ("acc", "conf")})
    switch = switch_metrics(probes, keys).groupBy(*keys).pivot("metric", [c for c in COLUMNS if c.startswith("ss")]).agg(F.first("value", ignorenulls=True))
    return row.join(switch, keys, "left").select(*keys, *COLUMNS)


def derived_row(spark, sf_dir) -> DataFrame:
    """The row of each model over the derived tables: the event type's tasks share the samples."""
    from vantage.plans import scoring

    keys = ["model"]
    c = cells(scoring.joined(spark, sf_dir, "grp", "step", "region"), [*keys, "region", "grp", "step"])
    probes = scoring.probes(spark, sf_dir).withColumn("position", F.concat(F.lit("ss"), F.col("file") % 3 + 1))
    all_, gap, other = F.lit(True), F.col("region") == "gap", F.col("region") == "other"
    at = {"now_state": all_, "now_mcq": F.col("region") == "segment", "sh_pred": all_, "sh_pred_conf": all_, "ms_pred": gap, "ms_pred_conf": gap, "ms_rtrv": other, "ms_rtrv_conf": other, "sh_rtrv": all_}
    row = wide_row(c, probes, keys, at)
    return row.select(*keys, *[F.round(x, 6).alias(x) for x in COLUMNS])
