"""The leaderboard from a folder of prediction files and folders of question sets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import parse, tokens
from vantage.operators import scan, score
from vantage.plans import main_table
from vantage.sources import files

#: Folders of the tasks below the prediction folder, and those of the three
#: positions, which hold the time of the probe, below that of the switch.
FOLDERS = {
    "now_state": "now_narration/cand_state", "now_mcq": "now_narration/cand_mcq", "sh_pred": "sh_pred/cand_full", "sh_pred_conf": "sh_pred/cand_conf", "ms_pred": "ms_pred/cand",
    "ms_pred_conf": "ms_pred/cand_conf", "ms_rtrv": "ms_rtrv/cand", "ms_rtrv_conf": "ms_rtrv/cand_conf", "sh_rtrv": "sh_rtrv/cand",
}
SWITCH = "now_state_switch/cand_state"
TIMES = {"ss1": "1.0", "ss2": "2.0", "ss3": "4.0"}


def local(path: Column) -> Column:
    """A file's path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def part_of(path: Column, positions: dict[str, str] | None = None) -> Column:
    """Which part of the table a prediction file is for, null if none; positions name the
    folders of ss1 to ss3 where they don't follow from the times."""
    below = lambda folder: F.contains(path, F.lit(f"/{folder}/"))
    cases = [(below(folder), part) for part, folder in FOLDERS.items()]
    for part, time in TIMES.items():
        own = (positions or {}).get(part)
        forms = {f"t_{time}".replace(".", dot) for dot in "._p"}
        for name in [own] if own else sorted({f"{head}{form}" for form in forms for head in ("sspos_", "")}):
            cases.append((below(f"{SWITCH}/{name}"), part))
    return F.coalesce(*[F.when(c, part) for c, part in cases])


def answers(preds: DataFrame, *more: str) -> DataFrame:
    """model, part, pred_file, pos, key, ans, state, conf, source of samples, and more columns."""
    probe = "diagnostics.prompt_and_encoding_debug"
    clean = F.coalesce(F.col("clean_response"), F.col("clean"))
    chosen = [F.col(f"{probe}.{c}") for c in ("cand_conf_final_letter", "chosen_by_p_cond", "cand_conf_probe.chosen_by_p_cond")]
    preds = preds.withColumn("ans", parse.answer("parsed", ("response_text", clean), chosen, "gen_tokens"))
    switch = F.col("part").startswith("ss")
    own = ["model", "split", "part", "pred_file", "pos", "key", "ans", *more]
    return preds.select(
        *own, parse.predicted_state("response_text", clean)["state"].alias("state"), parse.choice_confidence(F.col(f"{probe}.cand_conf_probe.p_cond"), "ans", "gen_token_probs").alias("cc"),
        F.when(switch, tokens.state_probability(F.col("gen_tokens"), F.col("gen_token_probs"))).alias("state_conf"),
    ).select(*own, "state", F.when(switch, F.col("state_conf")).otherwise(F.col("cc.conf")).alias("conf"), F.col("cc.source").alias("source"))


def truths(samples: DataFrame) -> DataFrame:
    """file, key, pos and what the metrics compare with."""
    role = F.lower(parse.strip(F.coalesce("state_switch_role", F.lit(""))))
    kind = F.lower(parse.strip(F.coalesce("state_switch_pair_type", F.lit(""))))
    before = {"segment_to_gap": "fixed_segment_mid", "gap_to_segment": "fixed_gap_mid"}
    after = {"segment_to_gap": "scan_gap", "gap_to_segment": "scan_segment"}
    is_ = lambda roles: reduce(lambda a, b: a | b, [(kind == k) & (role == v) for k, v in roles.items()])
    flag = F.lower(F.col("visible_interaction"))
    return samples.select(
        "file", "key", "pos", parse.truth_letter(("mcq.answer", "mcq.ans", "mcq.answer_idx"), ("answer", "ans", "answer_idx")).alias("truth"),
        parse.true_state("region", F.when(flag.isin("true", "1"), 1).when(flag.isNotNull(), 0), F.coalesce(parse.blank_to_null(F.col("state")), F.col("gt_state"))).alias("true_state"),
        parse.group_of("state").alias("grp"), parse.step_of("step_idx", "lead_sec").alias("lead_step"), parse.step_of("step_idx", "lag_sec").alias("lag_step"),
        F.col("state_switch_pair_id").alias("pair_id"), kind.alias("pair_type"), F.when(is_(before), "before").when(is_(after), "after").alias("side"),
    )


def place_of(path: Column, root: str, layout: str) -> dict[str, Column]:
    """The fields of a layout such as ``{model}/{split}``, from a path below root."""
    below = F.split(F.substr(path, F.lit(len(root) + 2)), "/")
    return {name.strip("{}"): F.get(below, F.lit(i)) for i, name in enumerate(layout.strip("/").split("/")) if name.startswith("{")}


def whole_root(spark: SparkSession, root: str) -> str:
    """A folder as its files' paths begin, without the scheme of local files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub("^file:/+", "/", system.makeQualified(folder).toUri().toString())


def leaderboards(
    spark: SparkSession, pred_root: str, roots: list[str], models: list[str] | None = None, splits: list[str] | None = None, layout: str = "{model}/{split}", maps: list[tuple[str, str]] = (),
    positions: dict[str, str] | None = None, allow_missing_confidence: bool = False, allow_missing: bool = False, labels: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table, warnings) of all models and splits in one call: a row of model, split and the
    40 metrics for each, and warnings by model and split.

    Prediction files lie below pred_root in folders by layout, then by task.  Models and
    splits that are not asked for, and files of no part, are left out by their paths, so
    they are never opened.  Every other prediction file is read once: what is parsed from
    its samples, and the references in it, are staged as scalars.  A question file is read
    only if a reference leads to it.

    Of several files of one model, split and part for one question set the first by path
    counts, the others are warned of, as are references that lead nowhere and question
    files that can't be read.  A sample without an answer stays in the denominator.  A part
    without files is an error; one of confidences is a warning instead if
    allow_missing_confidence, and any is if allow_missing: its metrics are null.
    labels: model and split where the layout doesn't name them.
    """

    top = whole_root(spark, pred_root)

    def place(path: Column) -> dict[str, Column]:
        found = place_of(local(path), top, layout) if layout else {}
        return {c: F.lit((labels or {})[c]) if c in (labels or {}) else found[c] for c in ("model", "split")}

    def wanted(path: Column) -> Column:
        own, ok = place(path), part_of(local(path), positions).isNotNull()
        for c, only in (("model", models), ("split", splits)):
            ok = ok & own[c].isin(*only) if only is not None else ok
        return ok

    texts = files.prediction_texts(spark, pred_root, wanted).withColumns(place(F.col("pred_file"))).withColumn("pred_file", local(F.col("pred_file")))
    texts = texts.withColumns({"part": part_of(F.col("pred_file"), positions), "candidates": files.reference_candidates(F.col("value"))})
    once = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("candidates"))
    rows = files.prediction_rows(texts, "model", "split", "part", "candidates").withColumn("candidates", once)
    rows = scan.staged(answers(rows, "candidates"))

    refs = rows.filter("candidates is not null").select(F.col("pred_file").alias("ref_id"), "candidates")
    listing = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select(local(F.col("path")).alias("path")) for r in roots])
    found, lost = files.resolve_references(refs, listing.distinct(), [str(r).rstrip("/") for r in roots], maps)
    own = rows.drop("candidates").join(found.select(F.col("ref_id").alias("pred_file"), F.col("path").alias("file")), "pred_file")
    # one run: a model, split and part, which share no prediction
    run = F.struct("model", "split", "part")
    kept, again = score.first_file(own.withColumn("model", run).drop("split", "part"))
    have = {tuple(r) for r in kept.select("model.*").distinct().collect()}  # twelve for each model and split at most
    parts = [*FOLDERS, *TIMES]
    runs = {r[:2] for r in have} | ({(labels["model"], labels["split"])} if labels and len(labels) == 2 else set())
    absent = [(*r, p) for r in sorted(runs) for p in parts if (*r, p) not in have]
    must = [] if allow_missing else [x for x in absent if not (x[2].endswith("_conf") and allow_missing_confidence)]
    if must or not runs:
        raise ValueError(f"no prediction files for {', '.join(x[2] if labels else '/'.join(x) for x in must) or 'any part'}")

    used = kept.select("file").distinct()
    # as many paths as the listing, which the driver holds anyway, has question sets in use
    samples, bad = files.read_interval_json(spark, [r.file for r in used.collect()])
    samples = samples.withColumn("file", local(F.col("file"))).dropDuplicates(["file", "pos"])
    j = score.official_join(truths(samples), kept).withColumnRenamed("model", "run").select("run.*", "*").drop("run")
    j = j.withColumn("step", F.when(F.col("part").startswith("ms_pred"), F.col("lead_step")).otherwise(F.col("lag_step")))
    keys = ["model", "split"]
    cells = main_table.cells(j.filter(~F.col("part").startswith("ss")), [*keys, "part", "grp", "step"])
    probes = j.filter(F.col("part").startswith("ss") & F.col("side").isNotNull()).withColumn("position", F.col("part"))
    table = main_table.wide_row(cells, probes, keys, {part: F.col("part") == part for part in FOLDERS})

    say = lambda df, what, c: df.select("model", "split", F.lit(what).alias("warning"), F.col(c).alias("file"))
    where = rows.select("model", "split", F.col("pred_file").alias("ref_id")).distinct()
    unread = kept.select("model.model", "model.split", "file").distinct().join(bad.select(local(F.col("file")).alias("file")), "file", "left_semi")
    warnings = [
        say(again.select("model.model", "model.split", "pred_file"), "question set already answered by an earlier file", "pred_file"), say(lost.join(where, "ref_id"), "question set not found", "ref_id"),
        say(unread, "question set not readable", "file"),
        spark.createDataFrame([(m, s, "no confidence files" if p.endswith("_conf") else "no files", p) for m, s, p in absent], "model string, split string, warning string, file string"),
    ]
    return table, reduce(DataFrame.unionByName, warnings)


def leaderboard(spark: SparkSession, pred_root: str, roots: list[str], model: str, split: str = "val", maps: list[tuple[str, str]] = (), positions: dict[str, str] | None = None, allow_missing_confidence: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, warnings) of one model, whose task folders lie in pred_root itself: see
    leaderboards."""
    return leaderboards(spark, pred_root, roots, layout="", maps=maps, positions=positions, allow_missing_confidence=allow_missing_confidence, labels={"model": model, "split": split})
