"""The published golden row of 42 columns, from question sets and predictions set out by hand."""

import json
import math
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.test_operators import files_read

from vantage.functions import parse, tokens
from vantage.operators import score
from vantage.plans import leaderboard, main_table
from vantage.sources import files

KEYS = ["model"]
GOLDEN = dict(
    now_rec=0.5, now_prec=0.5, now_mcq_acc=0.5, ss1_fg2bg_acc=1.0, ss1_bg2fg_acc=0.0, ss1_fg2bg_conf=0.71, ss1_bg2fg_conf=None, ss2_fg2bg_acc=1.0, ss2_bg2fg_acc=0.0, ss2_fg2bg_conf=0.72,
    ss2_bg2fg_conf=None, ss3_fg2bg_acc=1.0, ss3_bg2fg_acc=0.0, ss3_fg2bg_conf=0.73, ss3_bg2fg_conf=None, sh_pred_predictable_acc=1.0, sh_pred_branch_only_acc=0.0, sh_pred_surprise_only_acc=0.0,
    sh_pred_branch_and_surprise_acc=1.0, sh_pred_predictable_conf=0.8, sh_pred_branch_only_conf=0.4, sh_pred_surprise_only_conf=None, sh_pred_branch_and_surprise_conf=0.9, ms_pred_step0_acc=1.0,
    ms_pred_step1_acc=0.0, ms_pred_step2_acc=0.0, ms_pred_multi_avg_acc=1 / 3, ms_pred_step0_conf=0.75, ms_pred_step1_conf=0.6, ms_pred_step2_conf=0.2, ms_pred_multi_avg_conf=1.55 / 3, ms_rtrv_step0_acc=0.0,
    ms_rtrv_step1_acc=1.0, ms_rtrv_step2_acc=1.0, ms_rtrv_multi_avg_acc=2 / 3, ms_rtrv_step0_conf=0.6, ms_rtrv_step1_conf=0.7, ms_rtrv_step2_conf=0.65, ms_rtrv_multi_avg_conf=0.65, sh_rtrv_acc=0.5,
)


def questions(spark, rows, columns):
    return spark.createDataFrame([("f", f"i:{i}", i, *r) for i, r in enumerate(rows)], f"file string, key string, pos long, {columns}")


def answers(spark, rows):
    """rows: idx -> (text, probabilities of A to D or None)."""
    data = [("m", "f", "p.json", i, f"i:{i}", t, dict(zip("ABCD", p)) if p else None) for i, (t, p) in rows.items()]
    df = spark.createDataFrame(data, "model string, file string, pred_file string, pos long, key string, response_text string, p_cond map<string,double>")
    df = df.withColumn("ans", parse.answer()).withColumn("st", parse.predicted_state("response_text")).withColumn("cc", parse.choice_confidence("p_cond", "ans"))
    return df.select("model", "file", "pred_file", "pos", "key", "ans", F.col("st.state").alias("state"), F.col("cc.conf").alias("conf"), F.col("cc.source").alias("source"))


def mcq(spark, letters, said, column="step int", values=None):
    q = questions(spark, [(x, v) for x, v in zip(letters, values or [None] * len(letters))], f"truth string, {column}")
    return score.official_join(q, answers(spark, said))


def part(joined, name):
    """The joined samples with all columns that a cell may be cut by."""
    for c in ("truth", "true_state", "grp"):
        joined = joined if c in joined.columns else joined.withColumn(c, F.lit(""))
    joined = joined if "step" in joined.columns else joined.withColumn("step", F.lit(None).cast("int"))
    return joined.select("model", F.lit(name).alias("part"), "truth", "true_state", "ans", "state", "conf", "grp", "step")


def test_golden_row(spark):
    yes, no = "<NOW><STATE>INTERACTION</STATE></NOW>", "<NOW><STATE>NO_INTERACTION</STATE></NOW>"
    q = questions(spark, [("segment",), ("gap",), ("segment",)], "region string").withColumn("true_state", parse.true_state("region"))
    parts = [part(score.official_join(q, answers(spark, {0: (yes, None), 1: (yes, None)})), "now_state")]
    parts.append(part(mcq(spark, "AB", {0: ("<NOW><ANS>A</ANS></NOW>", None), 1: ("<NOW><ANS>C</ANS></NOW>", None)}), "now_mcq"))

    pair, probes = [("segment", "segment_to_gap", "before", "x"), ("gap", "segment_to_gap", "after", "x"), ("gap", "gap_to_segment", "before", "y"), ("segment", "gap_to_segment", "after", "y")], []
    for i, base in ((1, 0.01), (2, 0.02), (3, 0.03)):
        q = questions(spark, pair, "region string, pair_type string, side string, pair_id string").withColumn("true_state", parse.true_state("region"))
        p = answers(spark, {0: (yes, None), 1: (no, None), 2: (no, None), 3: (no, None)}).drop("conf")
        toks = F.array(F.lit("<STATE>"), F.when(F.col("pos") == 0, "INTERACTION").otherwise("NO_INTERACTION"), F.lit("</STATE>"))
        probs = F.array(F.lit(0.99), F.lit(0.8 + base) - F.col("pos") * 0.1, F.lit(0.99))
        p = p.withColumn("conf", tokens.state_probability(toks, probs))
        probes.append(score.official_join(q, p).withColumn("position", F.lit(f"ss{i}")))

    said = {0: ("A", (0.8, 0.1, 0.05, 0.05)), 1: ("C", (0.2, 0.3, 0.4, 0.1)), 3: ("D", (0.02, 0.03, 0.05, 0.9))}
    grp = mcq(spark, "ABCD", said, "st string", ["NN", "PN", "NP", "PP"]).withColumn("grp", parse.group_of("st"))
    parts += [part(grp, "sh_pred"), part(grp, "sh_pred_conf")]
    acc = {"ms_pred": {0: ("<FUTURE><ANS>A</ANS></FUTURE>", None), 1: ("<FUTURE><ANS>D</ANS></FUTURE>", None)}, "ms_rtrv": {0: ("D", None), 1: ("B", None), 2: ("C", None)}}
    conf = {
        "ms_pred": {0: ("A", (0.75, 0.1, 0.1, 0.05)), 1: ("D", (0.1, 0.2, 0.1, 0.6)), 2: ("C", (0.3, 0.3, 0.2, 0.2))},
        "ms_rtrv": {0: ("D", (0.2, 0.1, 0.1, 0.6)), 1: ("B", (0.1, 0.7, 0.1, 0.1)), 2: ("C", (0.1, 0.1, 0.65, 0.15))},
    }
    for task in ("ms_pred", "ms_rtrv"):
        parts += [part(mcq(spark, "ABC", said[task], values=[0, 1, 2]), name) for said, name in ((acc, task), (conf, f"{task}_conf"))]
    parts.append(part(mcq(spark, "AB", {0: ("<PAST><ANS>A</ANS></PAST>", None), 1: ("<PAST><ANS>C</ANS></PAST>", None)}), "sh_rtrv"))

    names = ("now_state", "now_mcq", "sh_pred", "sh_pred_conf", "ms_pred", "ms_pred_conf", "ms_rtrv", "ms_rtrv_conf", "sh_rtrv")
    cells = main_table.cells(reduce(DataFrame.unionByName, parts), [*KEYS, "part", "grp", "step"])
    row = main_table.wide_row(cells, reduce(DataFrame.unionByName, probes), KEYS, {n: F.col("part") == n for n in names}).first().asDict()
    assert len(main_table.COLUMNS) == len(GOLDEN) == 40
    check(row, GOLDEN)


def check(row, want):
    for name, value in want.items():
        assert (row[name] is None) if value is None else math.isclose(row[name], value, abs_tol=1e-9), (name, row[name], value)


def test_missing_answers_stay_wrong(spark):
    j = mcq(spark, "AB", {0: ("A", None)})
    got = score.mcq_accuracy(j, KEYS, "step").filter("step = 'all'").first()
    assert (got.total, got.valid, got.correct, got.accuracy, got.accuracy_valid) == (2, 1, 1, 0.5, 1.0)


def test_last_duplicate_and_first_file_count(spark):
    p = answers(spark, {0: ("A", None)}).unionByName(answers(spark, {0: ("B", None)}).withColumn("pos", F.lit(5).cast("long")))
    assert score.last_per_key(p).first().ans == "B"
    kept, left = score.first_file(p.unionByName(p.withColumn("pred_file", F.lit("q.json"))))
    assert kept.count() == 2 and [r.pred_file for r in left.collect()] == ["q.json"]


def test_zero_denominators_are_null(spark):
    j = mcq(spark, "A", {0: ("A or B", None)})
    got = score.mcq_accuracy(j, KEYS, "step").filter("step = 'all'").first()
    assert got.accuracy == 0.0 and got.accuracy_valid is None


def write_files(tmp_path, at="", wrong=False):
    """The golden row's prediction files below pred/at and its question sets, by hand; a
    second file for a question set, an unknown reference and keys by sample_id are among
    them.  wrong: the first task's answers are all of the other state."""

    def put(path, obj):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(obj))

    letters = lambda s, **more: [{"idx": i, "mcq": {"answer": x}} | {k: v[i] for k, v in more.items()} for i, x in enumerate(s)]
    pair = [("segment", "segment_to_gap", "fixed_segment_mid", "x"), ("gap", "segment_to_gap", "scan_gap", "x"), ("gap", "gap_to_segment", "fixed_gap_mid", "y"), ("segment", "gap_to_segment", "scan_segment", "y")]
    sets = {
        "state": [{"sample_id": "a", "region": "segment"}, {"id": 7, "region": "gap"}, {"region": "segment"}], "mcq": [{"idx": 0, "ans": "A"}, {"idx": 1.0, "mcq": {"answer_idx": 1}}],
        "switch": [{"idx": i, "region": r, "state_switch_pair_type": t, "state_switch_role": o, "state_switch_pair_id": p} for i, (r, t, o, p) in enumerate(pair)],
        "sh_pred": letters("ABCD", state=["NN", "PN", "NP", "PP"]), "ms_pred": letters("ABC", lead_sec=[8, 16, 24]), "ms_rtrv": letters("ABC", step_idx=[0, 1, 2]), "sh_rtrv": letters("AB"),
    }
    for name, samples in sets.items():
        put(f"sets/{name}.json", {"task": name, "samples": samples})

    def predict(folder, name, rows, file="p.json"):
        put(f"pred/{at}{folder}/{file}", {"source_queryset": f"old/place/{name}.json", "samples": rows})

    tag = lambda s: {"response_text": f"<NOW><STATE>{s}</STATE></NOW>"}
    seen = "NO_INTERACTION" if wrong else "INTERACTION"
    say = lambda said: [{"idx": i, "response_text": f"<ANS>{x}</ANS>", "parsed": {"ans": x}} for i, x in said.items()]
    probe = lambda said: [{"idx": i, "response_text": x, "diagnostics": {"prompt_and_encoding_debug": {"cand_conf_probe": {"ok": True, "p_cond": dict(zip("ABCD", p))}}}} for i, (x, p) in said.items()]
    predict("now_narration/cand_state", "state", [{"sample_id": "a", **tag(seen)}, {"id": 7, **tag(seen)}])
    predict("now_narration/cand_mcq", "mcq", say({0: "A", 1: "C"}))
    predict("now_narration/cand_mcq", "mcq", say({0: "B", 1: "B"}), "q.json")
    predict("now_narration/cand_mcq", "nowhere", say({0: "B"}), "r.json")
    for i, name in enumerate(("sspos_t_1_0", "t_2.0", "sspos_t_4p0")):
        rows = [{"idx": k, **tag(s), "gen_tokens": ["<STATE>", s, "</STATE>"], "gen_token_probs": [0.99, 0.81 + 0.01 * i - 0.1 * k, 0.99]} for k, s in enumerate(["INTERACTION", "NO_INTERACTION", "NO_INTERACTION", "NO_INTERACTION"])]
        predict(f"now_state_switch/cand_state/{name}", "switch", rows)
    predict("sh_pred/cand_full", "sh_pred", say({0: "A", 1: "C", 3: "D"}))
    predict("ms_pred/cand", "ms_pred", say({0: "A", 1: "D"}))
    predict("ms_rtrv/cand", "ms_rtrv", say({0: "D", 1: "B", 2: "C"}))
    predict("sh_rtrv/cand", "sh_rtrv", say({0: "A", 1: "C"}))
    predict("sh_pred/cand_conf", "sh_pred", probe({0: ("A", (0.8, 0.1, 0.05, 0.05)), 1: ("C", (0.2, 0.3, 0.4, 0.1)), 3: ("D", (0.02, 0.03, 0.05, 0.9))}))
    predict("ms_pred/cand_conf", "ms_pred", probe({0: ("A", (0.75, 0.1, 0.1, 0.05)), 1: ("D", (0.1, 0.2, 0.1, 0.6)), 2: ("C", (0.3, 0.3, 0.2, 0.2))}))
    predict("ms_rtrv/cand_conf", "ms_rtrv", probe({0: ("D", (0.2, 0.1, 0.1, 0.6)), 1: ("B", (0.1, 0.7, 0.1, 0.1)), 2: ("C", (0.1, 0.1, 0.65, 0.15))}))


def test_leaderboard_from_files(spark, tmp_path):
    write_files(tmp_path)
    args = (spark, str(tmp_path / "pred"), [str(tmp_path / "sets")], "synthetic", "val")
    table, warnings = leaderboard.leaderboard(*args)
    row = table.first().asDict()
    assert len(row) == 42 and (row["model"], row["split"]) == ("synthetic", "val")
    check(row, GOLDEN)
    assert sorted((r.warning.split()[-1], r.file.rsplit("/", 1)[1]) for r in warnings.collect()) == [("file", "q.json"), ("found", "r.json")]
    for f in (tmp_path / "pred/sh_pred/cand_conf").iterdir():
        f.unlink()
    with pytest.raises(ValueError, match="sh_pred_conf"):
        leaderboard.leaderboard(*args)
    table, warnings = leaderboard.leaderboard(*args, allow_missing_confidence=True)
    assert table.first().sh_pred_predictable_conf is None and warnings.filter("file = 'sh_pred_conf'").count() == 1


def test_leaderboard_of_all_models(spark, tmp_path):
    """Rows of several models and splits from one call; what is not asked for is not read."""
    for at, wrong in (("m1/val/", False), ("m1/train/", True), ("m2/val/", True), ("m3/val/", False)):
        write_files(tmp_path, at, wrong)
    for f in (tmp_path / "pred/m2/val/ms_pred/cand").iterdir():
        f.unlink()
    (tmp_path / "pred/m1/val/other").mkdir()
    (tmp_path / "pred/m1/val/other/p.json").write_text("{}")
    (tmp_path / "sets/unused.json").write_text("no json")
    args = (spark, str(tmp_path / "pred"), [str(tmp_path / "sets")])
    with pytest.raises(ValueError, match="m2/val/ms_pred"):
        leaderboard.leaderboards(*args)
    table, warnings = leaderboard.leaderboards(*args, allow_missing=True)
    rows = {(r.model, r.split): r.asDict() for r in table.collect()}
    assert sorted(rows) == [("m1", "train"), ("m1", "val"), ("m2", "val"), ("m3", "val")]
    check(rows["m1", "val"], GOLDEN)
    check(rows["m3", "val"], GOLDEN)
    check(rows["m1", "train"], GOLDEN | {"now_rec": 0.0, "now_prec": None})
    check(rows["m2", "val"], GOLDEN | {"now_rec": 0.0, "now_prec": None} | {c: None for c in GOLDEN if c.startswith("ms_pred") and c.endswith("acc")})
    said = [(r.model, r.split, r.warning, r.file.rsplit("/", 1)[-1]) for r in warnings.collect()]
    assert ("m2", "val", "no files", "ms_pred") in said and len(said) == 1 + 2 * 4
    only, _ = leaderboard.leaderboards(*args, models=["m1", "m3"], splits=["val"], layout="/{model}/{split}/")
    assert sorted((r.model, r.split) for r in only.collect()) == [("m1", "val"), ("m3", "val")]
    few = files.prediction_texts(spark, args[1], lambda p: F.contains(p, F.lit("/m3/")) & leaderboard.part_of(p).isNotNull())
    assert files_read(few) == 14 and files_read(files.prediction_texts(spark, args[1])) == 3 * 14 + 13 + 1
