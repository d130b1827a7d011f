"""Scoring: joins of question sets with predictions, and the metrics over them.

Contracts.  A question set has file, key, pos and the truth columns an operator names;
predictions have model, file, key, pos and what was parsed from their text.  Parse before
joining, so that only scalars are shuffled; the join, its de-duplication and the first
aggregation share the hash of (model, file, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import scan


def last_per_key(preds: DataFrame, keys=("model", "file", "key")) -> DataFrame:
    """Of predictions with one key the last by file order and position."""
    names = [c for c in preds.columns if c not in keys]
    order = [F.col(c) for c in ("pred_file", "pos") if c in preds.columns]
    best = F.max_by(F.struct(*names), F.struct(*order)) if order else F.first(F.struct(*names))
    return preds.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def first_file(preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of the first prediction file, by path, of each (model, question set),
    and the files left out."""
    files = preds.select("model", "file", "pred_file").distinct()
    files = files.withColumn("rank", F.row_number().over(Window.partitionBy("model", "file").orderBy("pred_file")))
    kept = preds.join(files.filter("rank = 1").drop("rank"), ["model", "file", "pred_file"], "left_semi")
    return kept, files.filter("rank > 1").drop("rank")


def official_join(questions: DataFrame, preds: DataFrame) -> DataFrame:
    """Every sample of each question set that a model's predictions name, with the
    prediction or nulls: a missing answer stays in the denominator."""
    named = preds.select("model", "file").distinct()
    wanted = questions.join(named, "file")
    own = last_per_key(preds).drop("pos", "pred_file").withColumn("answered", F.lit(True))
    clash = [c for c in own.columns if c in questions.columns and c not in ("file", "key")]
    own = own.withColumnsRenamed({c: f"pred_{c}" for c in clash})
    return wanted.join(own, ["model", "file", "key"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def legacy_join(preds: DataFrame, questions: DataFrame) -> DataFrame:
    """Every prediction with its sample or nulls; matched tells which."""
    q = questions.drop("pos").withColumn("matched", F.lit(True))
    return preds.join(q, ["file", "key"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def grouping(df: DataFrame, keys: list[str], bucket: str, *aggs: Column) -> DataFrame:
    """Aggregates by keys and bucket, and over all buckets (bucket ``all``), in one pass."""
    sets = [[*map(F.col, keys), F.col(bucket)], [*map(F.col, keys)]]
    out = df.groupingSets(sets, *keys, bucket).agg(F.grouping(bucket).alias("__all"), *aggs)
    return out.withColumn(bucket, F.when(F.col("__all") == 1, "all").otherwise(F.col(bucket).cast("string"))).drop("__all")


def mcq_accuracy(joined: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Totals and accuracy by bucket and overall; samples without truth letter are left
    out and counted.  Needs truth and ans."""
    known = F.col("truth") != ""
    valid = known & (F.coalesce("ans", F.lit("")) != "")
    right = valid & (F.col("ans") == F.col("truth"))
    out = grouping(
        joined, keys, bucket, F.count_if(known).alias("total"), F.count_if(valid).alias("valid"), F.count_if(right).alias("correct"), F.count_if(~known).alias("no_truth")
    )
    return out.select(
        *keys, bucket, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), "correct",
        rate(F.col("correct"), F.col("total")).alias("accuracy"), rate(F.col("correct"), F.col("valid")).alias("accuracy_valid"), "no_truth",
    )


def state_scores(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, recall, precision and accuracy; an invalid or missing prediction
    counts as not positive; unknown truths are left out and counted."""
    gt, ps = F.col("true_state"), F.coalesce("state", F.lit("INVALID"))
    yes, no = gt == "INTERACTION", gt == "NO_INTERACTION"
    hit = ps == "INTERACTION"
    valid = (yes | no) & ps.isin("INTERACTION", "NO_INTERACTION")
    out = joined.groupBy(*keys).agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(no & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(no & (ps == "NO_INTERACTION")).alias("tn"),
        F.count_if(yes | no).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~(yes | no)).alias("unknown_truth"),
    )
    return out.select("*", rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp") + F.col("tn"), F.col("total")).alias("accuracy"))


def confidence_by_bucket(joined: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Mean and count of confidences, and a histogram of their sources, over all samples.
    The samples are read once; the rest works on a row for each bucket and source."""
    named = joined.withColumn("source", F.coalesce("source", F.lit("missing_prediction")))
    small = named.groupBy(*keys, "source", bucket).agg(F.sum("conf").alias("s"), F.count("conf").alias("c"), F.count(F.lit(1)).alias("n"))
    parts = grouping(small, [*keys, "source"], bucket, F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    sources = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
    out = parts.groupBy(*keys, bucket).agg(F.sum("s").alias("s"), F.sum("c").alias("conf_n"), F.sum("n").alias("total"), sources.alias("sources"))
    return out.select(*keys, bucket, rate(F.col("s"), F.col("conf_n")).alias("conf_mean"), "conf_n", "total", "sources")


def switch_pairs(probes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair: last probe of either role, first non-blank type, success."""
    at = F.col("pos")
    got = probes.groupBy(*keys, "file", "pair_id").agg(
        F.max_by(F.struct("true_state", "state", "conf"), F.when(F.col("side") == "before", at)).alias("before"),
        F.max_by(F.struct("true_state", "state", "conf"), F.when(F.col("side") == "after", at)).alias("after"),
        F.min_by("pair_type", F.when(F.coalesce("pair_type", F.lit("")) != "", at)).alias("pair_type"),
    )
    ok = lambda c: F.coalesce(F.col(f"{c}.state").isin("INTERACTION", "NO_INTERACTION"), F.lit(False))
    missing = F.col("before").isNull() | F.col("after").isNull()
    invalid = ~missing & ~(ok("before") & ok("after"))
    hit = ~missing & ~invalid & (F.col("before.state") == F.col("before.true_state")) & (F.col("after.state") == F.col("after.true_state"))
    return got.select(*keys, "file", "pair_id", F.coalesce("pair_type", F.lit("unknown")).alias("pair_type"), missing.alias("missing_role"), invalid.alias("invalid_probe"), F.coalesce(hit, F.lit(False)).alias("success"), F.col("before.conf").alias("before_conf"), F.col("after.conf").alias("after_conf"))


def switch_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """By direction: totals, success over valid and over all, mean confidence of the probe
    after the switch on successes."""
    out = pairs.groupBy(*keys, "pair_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("missing_role").alias("missing"), F.count_if("invalid_probe").alias("invalid"),
        F.count_if(~F.col("missing_role") & ~F.col("invalid_probe")).alias("valid"), F.count_if("success").alias("success"),
        F.avg(F.when(F.col("success"), F.col("after_conf"))).alias("conf"),
    )
    return out.withColumns({"rate_valid": rate(F.col("success"), F.col("valid")), "rate_total": rate(F.col("success"), F.col("total"))})


def switch_point_types(probes: DataFrame, keys: list[str]) -> DataFrame:
    """By point type (pair type and side): probes, mean confidence, accuracy of valid ones."""
    valid = F.col("state").isin("INTERACTION", "NO_INTERACTION")
    return probes.groupBy(*keys, "pair_type", "side").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.avg("conf").alias("conf"),
        rate(F.count_if(valid & (F.col("state") == F.col("true_state"))), F.count_if(valid)).alias("accuracy_valid"),
    )


def switch_confusion(probes: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Confusion counts of probes by bucket and overall, over those only whose truth and
    prediction are both states: tp, fp, fn, tn, valid and accuracy.  Others are counted in
    left_out; a bucket that has none but such has accuracy null."""
    yes, no = "INTERACTION", "NO_INTERACTION"
    cell = lambda t, s: F.count_if((F.col("true_state") == t) & (F.col("state") == s))
    cells = {"tp": cell(yes, yes), "fp": cell(no, yes), "fn": cell(yes, no), "tn": cell(no, no)}
    out = grouping(probes, keys, bucket, *[c.alias(n) for n, c in cells.items()], F.count(F.lit(1)).alias("total"))
    out = out.withColumn("valid", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return out.select(*keys, bucket, *cells, "valid", (F.col("total") - F.col("valid")).alias("left_out"), rate(F.col("tp") + F.col("tn"), F.col("valid")).alias("accuracy"))


def switch_success_confidence(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """By point type (pair type and side): mean confidence of the probes of pairs that were
    told right, and how many have one."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_conf").alias("conf")) for s in ("before", "after")]))
    points = pairs.filter("success").select(*keys, "pair_type", sides.alias("p")).select(*keys, "pair_type", "p.*")
    return points.groupBy(*keys, "pair_type", "side").agg(F.avg("conf").alias("conf"), F.count("conf").alias("conf_n"))


def stated_confidence(joined: DataFrame, keys: list[str], stated: str = "stated", picked: str = "picked") -> DataFrame:
    """Mean stated confidence over answers whose option has a source, over those that took
    a strong distractor (prev or future), and over the others."""
    strong = F.col(picked).isin("prev", "future")
    cases = {"mapped": F.col(picked).isNotNull(), "strong": strong, "not_strong": ~strong}
    return joined.groupBy(*keys).agg(*[F.avg(F.when(c, F.col(stated))).alias(n) for n, c in cases.items()])


def source_stats(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Where chosen options come from: gt, prev, future or absurd.  Only valid answers with
    four non-blank sources are mapped; strong distractors are prev and future."""
    index = lambda c: F.try_element_at(F.col("sources"), F.ascii(F.col(c)) - 64)
    full = (F.size("sources") == 4) & F.forall("sources", lambda s: F.trim(s) != "")
    mapped = joined.filter((F.col("ans") != "") & (F.col("truth") != "")).filter(full).withColumn("picked", index("ans")).withColumn("true_source", index("truth"))
    wrong = F.col("ans") != F.col("truth")
    strong = F.col("picked").isin("prev", "future")
    out = mapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mapped"), F.count_if(wrong).alias("wrong"), *[F.count_if(F.col("picked") == s).alias(f"selected_{s}") for s in ("gt", "prev", "future", "absurd")],
        *[F.count_if(wrong & (F.col("picked") == s)).alias(f"wrong_{s}") for s in ("gt", "prev", "future", "absurd")],
        F.count_if(F.col("true_source") == "gt").alias("truth_gt"), F.count_if(strong).alias("strong"), F.count_if(strong & wrong).alias("strong_wrong"),
    )
    return out.withColumns({
        "strong_rate": rate(F.col("strong"), F.col("mapped")), "strong_given_wrong": rate(F.col("strong_wrong"), F.col("wrong")),
        "strong_given_wrong_legacy": F.coalesce(rate(F.col("strong_wrong"), F.col("wrong")), F.lit(0.0)),
    })


def confidence_by_outcome(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and count of confidence over valid, correct and wrong answers."""
    valid = (F.col("ans") != "") & (F.col("truth") != "")
    cases = {"valid": valid, "correct": valid & (F.col("ans") == F.col("truth")), "wrong": valid & (F.col("ans") != F.col("truth"))}
    aggs = [a for n, c in cases.items() for a in (F.avg(F.when(c, F.col("conf"))).alias(f"conf_{n}"), F.count(F.when(c, F.col("conf"))).alias(f"n_{n}"))]
    return joined.groupBy(*keys).agg(*aggs)


def overlapping_groups(joined: DataFrame) -> DataFrame:
    """Each sample in its own state, in ALL, and in UNP if it is NP, PN or PP."""
    s = F.upper(F.trim("group_state"))
    return joined.withColumn("group", F.explode(F.array_compact(F.array(s, F.lit("ALL"), F.when(s.isin("NP", "PN", "PP"), "UNP")))))


def step_groups(joined: DataFrame, keys: list[str]) -> DataFrame:
    """One row per anchor group with the last answer of each step: ok0..2, c0..2."""
    right = (F.col("ans") == F.col("truth")) & (F.col("truth") != "")
    aggs = []
    for s in (0, 1, 2):
        last = F.max_by(F.struct(F.coalesce(right, F.lit(False)).alias("ok"), F.col("conf").alias("c")), F.when(F.col("step") == s, F.col("pos")))
        aggs.append(last.alias(f"s{s}"))
    out = joined.groupBy(*keys, "file", "anchor").agg(*aggs)
    return out.select(*keys, "file", "anchor", *[F.coalesce(F.col(f"s{s}.ok"), F.lit(False)).alias(f"ok{s}") for s in (0, 1, 2)], *[F.col(f"s{s}.c").alias(f"c{s}") for s in (0, 1, 2)])


def complete(groups: DataFrame) -> DataFrame:
    return groups.filter("ok0 and ok1 and ok2 and c0 is not null and c1 is not null and c2 is not null")


def monotonic_confidence(groups: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Over groups right at all steps: how often confidence falls from step to step."""
    a, b = F.col("c0") >= F.col("c1") - tolerance, F.col("c1") >= F.col("c2") - tolerance
    out = complete(groups).groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.count_if(a).alias("n01"), F.count_if(b).alias("n12"), F.count_if(a & b).alias("n012"))
    return out.withColumns({f"frac_{n}": rate(F.col(n), F.col("groups")) for n in ("n01", "n12", "n012")})


def confidence_trend(groups: DataFrame, keys: list[str], flat: str = "drop", block: int = scan.BLOCK) -> DataFrame:
    """Slope of confidence over steps 1, 2, 3 and of its z-score: mean, median, population
    deviation, share below 0.  Groups without variance have no z-slope (flat='drop') or
    the z-slope 0 (flat='zero').  Medians are selected block by block, so no buffer grows
    with the groups; the rest are sums."""
    mean = (F.col("c0") + F.col("c1") + F.col("c2")) / 3
    std = F.sqrt((F.pow(F.col("c0") - mean, F.lit(2)) + F.pow(F.col("c1") - mean, F.lit(2)) + F.pow(F.col("c2") - mean, F.lit(2))) / 3)
    slope = (F.col("c2") - F.col("c0")) / 2
    z = F.when(std > 1e-12, slope / std).otherwise(F.lit(0.0) if flat == "zero" else F.lit(None))
    got = scan.staged(complete(groups).withColumns({"slope": slope, "zslope": z}).select(*keys, "slope", "zslope"))
    aggs = [F.count(F.lit(1)).alias("groups")]
    for c in ("slope", "zslope"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.avg((F.col(c) < 0).cast("double")).alias(f"{c}_negative")]
    names = ["slope", "zslope"]
    middle = scan.medians(scan.long_rows(got, names, keys), "value", [*keys, "name"], block)
    middle = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{c}_median") for c in names])
    return scan.same(got.groupBy(*keys).agg(*aggs), middle, keys, "left")


def confusion(joined: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Counts of truth by prediction, one column for each prediction."""
    return joined.filter(F.col("true_state").isin(*labels)).groupBy(*keys, "true_state").pivot("state", labels).count().fillna(0, labels)


def open_ended(joined: DataFrame, keys: list[str], with_state: bool = True) -> DataFrame:
    """Verb, noun and pair hits over samples with an interaction: a wrong state is wrong,
    and given the right state.  Without states (with_state=False) every sample counts and
    only its words decide."""
    seen = F.col("true_state") == "INTERACTION" if with_state else F.lit(True)
    state = seen & (F.col("state") == "INTERACTION") if with_state else F.lit(True)
    out = joined.groupBy(*keys).agg(
        F.count_if(seen).alias("total"), F.count_if(state).alias("state_right"),
        *[F.count_if(state & c).alias(n) for n, c in (("verb", F.col("verb_ok")), ("noun", F.col("noun_ok")), ("pair", F.col("verb_ok") & F.col("noun_ok")))],
        F.count_if(seen & F.col("pred_verb").isNull()).alias("verb_missing"), F.count_if(seen & F.col("pred_noun").isNull()).alias("noun_missing"),
    )
    new = {f"{n}_acc": rate(F.col(n), F.col("total")) for n in ("verb", "noun", "pair")} | {f"{n}_acc_given_state": rate(F.col(n), F.col("state_right")) for n in ("verb", "noun", "pair")}
    return out.withColumns(new)


def observed_steps(samples: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    return samples.filter(F.col(seconds).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(seconds)).alias("values"))


def first_k(df: DataFrame, cell: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each cell."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")
