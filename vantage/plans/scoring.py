"""Queries of the scoring side, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import parse
from vantage.operators import score
from vantage.plans import derived


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with answer, state and confidence; the text is dropped before any join."""
    p = derived.predictions(spark, sf_dir)
    p = p.withColumn("ans", parse.answer()).withColumn("st", parse.predicted_state("response_text")).withColumn("cc", parse.choice_confidence("p_cond", "ans"))
    return p.select("model", "file", "pred_file", "pos", "key", "ans", F.col("st.state").alias("state"), F.col("st.method").alias("method"), F.col("cc.conf").alias("conf"), F.col("cc.source").alias("source"))


def joined(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Official join with the columns asked for, and true_state and grp."""
    q = derived.samples(spark, sf_dir).withColumn("true_state", parse.true_state("region")).withColumn("grp", parse.group_of("group_state"))
    return score.official_join(q.select("file", "key", "pos", "truth", "true_state", *columns), parsed(spark, sf_dir))


def score_accuracy(spark, sf_dir):
    return score.mcq_accuracy(joined(spark, sf_dir, "grp"), ["model"], "grp")


def score_accuracy_by_step(spark, sf_dir):
    return score.mcq_accuracy(joined(spark, sf_dir, "step"), ["model"], "step")


def state_scores(spark, sf_dir):
    return score.state_scores(joined(spark, sf_dir), ["model"])


def confidence_by_bucket(spark, sf_dir):
    out = score.confidence_by_bucket(joined(spark, sf_dir, "grp"), ["model"], "grp")
    return out.select("model", "grp", F.round("conf_mean", 6).alias("conf_mean"), "conf_n", "total", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("sources"))


def probes(spark, sf_dir):
    """Neighbouring samples 2i, 2i+1 of a file as the two probes of a pair."""
    j = joined(spark, sf_dir, "region")
    pair = F.expr("pos div 2")
    return j.filter("region <> 'other'").withColumns({
        "pair_id": F.concat(F.col("file"), F.lit("#"), pair), "side": F.when(F.col("pos") % 2 == 0, "before").otherwise("after"),
        "pair_type": F.when(F.col("pos") % 2 == 0, F.when(F.col("region") == "segment", "segment_to_gap").otherwise("gap_to_segment")),
    })


def switch_pairs(spark, sf_dir):
    out = score.switch_scores(score.switch_pairs(probes(spark, sf_dir), ["model"]), ["model"])
    return out.withColumn("conf", F.round("conf", 6))


def switch_point_types(spark, sf_dir):
    p = probes(spark, sf_dir).withColumn("pair_type", F.coalesce("pair_type", F.lit("after")))
    return score.switch_point_types(p, ["model"]).withColumn("conf", F.round("conf", 6))


def switch_confusion(spark, sf_dir):
    """Probes by place; each third file's probes lie at another place of the pair."""
    p = probes(spark, sf_dir).withColumn("place", F.concat(F.lit("p"), F.col("file") % 3))
    return score.switch_confusion(p, ["model"], "place")


def switch_success_confidence(spark, sf_dir):
    out = score.switch_success_confidence(score.switch_pairs(probes(spark, sf_dir), ["model"]), ["model"])
    return out.withColumn("conf", F.round("conf", 6))


def first_file(spark, sf_dir):
    """Every fifth question set was answered a second time, all with A, in a later file; in
    every tenth the later run's path comes first, so it is the one that counts."""
    p = parsed(spark, sf_dir)
    again = p.filter("file % 5 = 0").withColumns({"pred_file": F.when(F.col("file") % 10 == 0, F.concat(F.lit("a/"), "pred_file")).otherwise(F.concat("pred_file", F.lit(".again"))), "ans": F.lit("A")})
    kept, left_out = score.first_file(p.unionByName(again))
    q = derived.samples(spark, sf_dir).select("file", "key", "pos", "truth")
    got = score.official_join(q, kept).groupBy("model").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ans") == F.col("truth")).alias("correct"))
    return got.join(left_out.groupBy("model").agg(F.count(F.lit(1)).alias("left_out"), F.max("pred_file").alias("last_left_out")), "model", "left")


def source_stats(spark, sf_dir):
    return score.source_stats(joined(spark, sf_dir, "sources", "grp"), ["model", "grp"])


def confidence_by_outcome(spark, sf_dir):
    out = score.confidence_by_outcome(joined(spark, sf_dir, "step"), ["model", "step"])
    return out.withColumns({c: F.round(c, 6) for c in ("conf_valid", "conf_correct", "conf_wrong")})


def overlapping_groups(spark, sf_dir):
    j = score.overlapping_groups(joined(spark, sf_dir, "group_state"))
    return score.mcq_accuracy(j, ["model"], "group").filter("`group` <> 'all'")


def groups(spark, sf_dir):
    return score.step_groups(joined(spark, sf_dir, "step", "anchor"), ["model"])


def monotonic_confidence(spark, sf_dir):
    return score.monotonic_confidence(groups(spark, sf_dir), ["model"])


def confidence_trend(spark, sf_dir):
    out = score.confidence_trend(groups(spark, sf_dir), ["model"])
    return out.select("model", "groups", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def confidence_trend_flat(spark, sf_dir):
    """Groups without variance count as flat; the confidences are cut to fifths, so many are."""
    g = groups(spark, sf_dir).withColumns({c: F.floor(F.col(c) * 5) / 5 for c in ("c0", "c1", "c2")})
    out = score.confidence_trend(g, ["model"], flat="zero")
    return out.select("model", "groups", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def confusion_matrix(spark, sf_dir):
    return score.confusion(joined(spark, sf_dir).filter("state in ('INTERACTION', 'NO_INTERACTION')"), ["model"], ["INTERACTION", "NO_INTERACTION"])


def observed_steps(spark, sf_dir):
    s = derived.samples(spark, sf_dir).withColumn("lead_sec", (F.col("k") % 4 + 1) * 8)
    return score.observed_steps(s, ["step"], "lead_sec").select("step", F.array_join("values", ";").alias("observed"))


def first_correct(spark, sf_dir):
    right = joined(spark, sf_dir).filter("ans = truth and true_state <> 'UNKNOWN'")
    return score.first_k(right, ["model", "true_state"], ["file", "pos"], 5).select("model", "true_state", "file", "key")


def legacy_join(spark, sf_dir):
    """Predictions whose sample is not in the question set (every seventh) count as unmatched."""
    q = derived.samples(spark, sf_dir).filter("event_id % 7 <> 0").select("file", "key", "pos", "truth")
    j = score.legacy_join(parsed(spark, sf_dir).select("model", "file", "key", "ans"), q)
    return j.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if(F.coalesce(F.col("ans") == F.col("truth"), F.lit(False))).alias("correct"))


def answer_modes(spark, sf_dir):
    """Letters that the official and the legacy rules read from the same texts."""
    p = derived.predictions(spark, sf_dir).select("response_text")
    official, legacy, short = parse.answer(), parse.answer(mode="legacy"), parse.letter("response_text", "legacy")
    return p.groupBy(official.alias("official"), legacy.alias("legacy"), short.alias("first_letter")).agg(F.count(F.lit(1)).alias("n"))


def main_table(spark, sf_dir):
    from vantage.plans import main_table as plan

    return plan.derived_row(spark, sf_dir)


J = "WITH " + derived.SQL
BUCKET = """SELECT model, {bucket} AS {name}, count(*) AS total, count(*) FILTER (ans <> '') AS valid, count(*) FILTER (ans = '') AS invalid, count(*) FILTER (ans = truth) AS correct,
  count(*) FILTER (ans = truth) / count(*) AS accuracy, count(*) FILTER (ans = truth) / nullif(count(*) FILTER (ans <> ''), 0) AS accuracy_valid, 0::BIGINT AS no_truth FROM {source} GROUP BY model{extra}"""
GRP = "CASE group_state WHEN 'NN' THEN 'predictable' WHEN 'PN' THEN 'branch_only' WHEN 'NP' THEN 'surprise_only' WHEN 'PP' THEN 'branch_and_surprise' ELSE 'unknown' END"
P = """, b AS (SELECT model, file, pos // 2 AS p, state, true_state, conf, answered, region, pos % 2 AS side FROM x WHERE region <> 'other'),
q AS (SELECT model, file, p, max(CASE WHEN side = 0 THEN state END) AS s0, max(CASE WHEN side = 1 THEN state END) AS s1, max(CASE WHEN side = 0 THEN true_state END) AS t0, max(CASE WHEN side = 1 THEN true_state END) AS t1,
  max(CASE WHEN side = 1 THEN conf END) AS c1, max(CASE WHEN side = 0 THEN region END) AS r0 FROM b GROUP BY 1, 2, 3),
w AS (SELECT *, CASE r0 WHEN 'segment' THEN 'segment_to_gap' WHEN 'gap' THEN 'gap_to_segment' ELSE 'unknown' END AS pair_type, s0 IS NULL OR s1 IS NULL AS miss,
  s0 IS NOT NULL AND s1 IS NOT NULL AND (s0 = 'INVALID' OR s1 = 'INVALID') AS inv, coalesce(s0 = t0 AND s1 = t1 AND s0 <> 'INVALID' AND s1 <> 'INVALID', false) AS ok FROM q)"""
G = """, g AS (SELECT model, file, anchor, bool_or(step = 0 AND ans = truth) AS ok0, bool_or(step = 1 AND ans = truth) AS ok1, bool_or(step = 2 AND ans = truth) AS ok2,
  max(CASE WHEN step = 0 THEN conf END) AS c0, max(CASE WHEN step = 1 THEN conf END) AS c1, max(CASE WHEN step = 2 THEN conf END) AS c2 FROM x GROUP BY 1, 2, 3),
h AS (SELECT *, (c2 - c0) / 2 AS sl, sqrt((pow(c0 - (c0 + c1 + c2) / 3, 2) + pow(c1 - (c0 + c1 + c2) / 3, 2) + pow(c2 - (c0 + c1 + c2) / 3, 2)) / 3) AS sd FROM g WHERE ok0 AND ok1 AND ok2)"""

QUERIES = {
    f.__name__: f
    for f in (score_accuracy, score_accuracy_by_step, state_scores, confidence_by_bucket, switch_pairs, switch_point_types, switch_confusion, switch_success_confidence, first_file, source_stats, confidence_by_outcome, overlapping_groups,
              monotonic_confidence, confidence_trend, confidence_trend_flat, confusion_matrix, observed_steps, first_correct, legacy_join, answer_modes, main_table)
}

_ROT = "['gt', 'prev', 'future', 'absurd'][(((ascii({c}) - 65 - event_id) % 4 + 4) % 4 + 1)::INT]"



def main_table_sql() -> str:
    """The wide row as one aggregate a column."""
    acc = lambda where: f"count(*) FILTER (ans = truth AND {where}) / nullif(count(*) FILTER ({where}), 0)"
    conf = lambda where: f"avg(conf) FILTER ({where})"
    cols = {"now_rec": "count(*) FILTER (true_state = 'INTERACTION' AND state = 'INTERACTION') / nullif(count(*) FILTER (true_state = 'INTERACTION'), 0)",
            "now_prec": "count(*) FILTER (true_state = 'INTERACTION' AND state = 'INTERACTION') / nullif(count(*) FILTER (true_state <> 'UNKNOWN' AND state = 'INTERACTION'), 0)",
            "now_mcq_acc": acc("region = 'segment'"), "sh_rtrv_acc": acc("true")}
    for state, group in parse.GROUPS.items():
        cols |= {f"sh_pred_{group}_acc": acc(f"group_state = '{state}'"), f"sh_pred_{group}_conf": conf(f"group_state = '{state}'")}
    for task, region in (("ms_pred", "gap"), ("ms_rtrv", "other")):
        for kind, way in (("acc", acc), ("conf", conf)):
            each = [way(f"region = '{region}' AND step = {i}") for i in range(3)]
            cols |= {f"{task}_step{i}_{kind}": e for i, e in enumerate(each)}
            cols[f"{task}_multi_avg_{kind}"] = f"list_avg([{', '.join(each)}])"
    pairs = {}
    for i in (1, 2, 3):
        for kind, short in (("segment_to_gap", "fg2bg"), ("gap_to_segment", "bg2fg")):
            where = f"file % 3 + 1 = {i} AND pair_type = '{kind}'"
            pairs |= {f"ss{i}_{short}_acc": f"count(*) FILTER (ok AND {where}) / nullif(count(*) FILTER (NOT miss AND NOT inv AND {where}), 0)", f"ss{i}_{short}_conf": f"avg(c1) FILTER (ok AND {where})"}
    pick = lambda c: ", ".join(f"round({v}, 6) AS {k}" for k, v in c.items())
    return J + P + f", m1 AS (SELECT model, {pick(cols)} FROM x GROUP BY model), m2 AS (SELECT model, {pick(pairs)} FROM w GROUP BY model) SELECT m1.*, m2.* EXCLUDE (model) FROM m1 JOIN m2 USING (model)"


ORACLE = {
    "main_table": main_table_sql(),
    "score_accuracy": J + BUCKET.format(bucket=GRP, name="grp", source="x", extra=", 2") + " UNION ALL " + BUCKET.format(bucket="'all'", name="grp", source="x", extra=""),
    "score_accuracy_by_step": J + BUCKET.format(bucket="step::VARCHAR", name="step", source="x", extra=", 2") + " UNION ALL " + BUCKET.format(bucket="'all'", name="step", source="x", extra=""),
    "state_scores": J + """, n AS (SELECT model, count(*) FILTER (true_state = 'INTERACTION' AND state = 'INTERACTION') AS tp, count(*) FILTER (true_state = 'NO_INTERACTION' AND state = 'INTERACTION') AS fp,
        count(*) FILTER (true_state = 'INTERACTION' AND state <> 'INTERACTION') AS fn, count(*) FILTER (true_state = 'NO_INTERACTION' AND state = 'NO_INTERACTION') AS tn,
        count(*) FILTER (true_state <> 'UNKNOWN') AS total, count(*) FILTER (true_state <> 'UNKNOWN' AND state <> 'INVALID') AS valid, count(*) FILTER (true_state = 'UNKNOWN') AS unknown_truth FROM x GROUP BY model)
        SELECT *, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, (tp + tn) / nullif(total, 0) AS accuracy FROM n""",
    "confidence_by_bucket": J + f""", z AS (SELECT *, {GRP} AS grp, CASE WHEN NOT answered THEN 'missing_prediction' WHEN kk = 8 THEN 'cand_conf_p_cond_max' ELSE 'cand_conf_p_cond_pred' END AS src FROM x),
        zz AS (SELECT model, grp, conf, src FROM z UNION ALL SELECT model, 'all', conf, src FROM z),
        k1 AS (SELECT model, grp, round(avg(conf), 6) AS conf_mean, count(conf) AS conf_n, count(*) AS total FROM zz GROUP BY 1, 2),
        k2 AS (SELECT model, grp, src, count(*) AS n FROM zz GROUP BY 1, 2, 3)
        SELECT k1.*, (SELECT string_agg(src || '=' || n, ';' ORDER BY src) FROM k2 WHERE k2.model = k1.model AND k2.grp = k1.grp) AS sources FROM k1""",
    "switch_pairs": J + P + """ SELECT model, pair_type, count(*) AS total, count(*) FILTER (miss) AS missing, count(*) FILTER (inv) AS invalid, count(*) FILTER (NOT miss AND NOT inv) AS valid,
        count(*) FILTER (ok) AS success, round(avg(CASE WHEN ok THEN c1 END), 6) AS conf, count(*) FILTER (ok) / nullif(count(*) FILTER (NOT miss AND NOT inv), 0) AS rate_valid, count(*) FILTER (ok) / count(*) AS rate_total
        FROM w GROUP BY 1, 2""",
    "switch_point_types": J + P + """, v AS (SELECT *, CASE WHEN side = 1 THEN 'after' WHEN region = 'segment' THEN 'segment_to_gap' ELSE 'gap_to_segment' END AS pair_type FROM b)
        SELECT model, pair_type, CASE side WHEN 0 THEN 'before' ELSE 'after' END AS side, count(*) AS total, count(*) FILTER (state <> 'INVALID') AS valid, round(avg(conf), 6) AS conf,
        count(*) FILTER (state <> 'INVALID' AND state = true_state) / nullif(count(*) FILTER (state <> 'INVALID'), 0) AS accuracy_valid FROM v GROUP BY 1, 2, 3""",
    "switch_confusion": J + P + """, v AS (SELECT *, 'p' || file % 3 AS place FROM b UNION ALL SELECT *, 'all' FROM b),
        n AS (SELECT model, place, count(*) FILTER (true_state = 'INTERACTION' AND state = 'INTERACTION') AS tp, count(*) FILTER (true_state = 'NO_INTERACTION' AND state = 'INTERACTION') AS fp,
        count(*) FILTER (true_state = 'INTERACTION' AND state = 'NO_INTERACTION') AS fn, count(*) FILTER (true_state = 'NO_INTERACTION' AND state = 'NO_INTERACTION') AS tn, count(*) AS total FROM v GROUP BY 1, 2)
        SELECT model, place, tp, fp, fn, tn, tp + fp + fn + tn AS valid, total - (tp + fp + fn + tn) AS left_out, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM n""",
    "switch_success_confidence": J + P + """, c AS (SELECT model, file, p, max(CASE WHEN side = 0 THEN conf END) AS c0 FROM b GROUP BY 1, 2, 3),
        d AS (SELECT w.model, w.pair_type, c.c0, w.c1 FROM w JOIN c USING (model, file, p) WHERE w.ok),
        v AS (SELECT model, pair_type, 'before' AS side, c0 AS conf FROM d UNION ALL SELECT model, pair_type, 'after', c1 FROM d)
        SELECT model, pair_type, side, round(avg(conf), 6) AS conf, count(conf) AS conf_n FROM v GROUP BY 1, 2, 3""",
    "first_file": J + """, f AS (SELECT model, file, min(pos) FILTER (answered) AS any_answer FROM x GROUP BY 1, 2),
        z AS (SELECT x.model, CASE WHEN NOT answered THEN '' WHEN file % 10 = 0 THEN 'A' ELSE ans END AS ans, truth FROM x JOIN f USING (model, file) WHERE any_answer IS NOT NULL),
        n AS (SELECT model, count(*) AS total, count(*) FILTER (ans = truth) AS correct FROM z GROUP BY 1),
        l AS (SELECT model, count(*) AS left_out, max('pred/' || model || '/' || file || CASE WHEN file % 10 = 0 THEN '.json' ELSE '.json.again' END) AS last_left_out FROM f WHERE file % 5 = 0 AND any_answer IS NOT NULL GROUP BY 1)
        SELECT n.*, l.* EXCLUDE (model) FROM n LEFT JOIN l USING (model)""",
    "source_stats": J + f""", z AS (SELECT *, {GRP} AS grp, {_ROT.format(c='ans')} AS src FROM x WHERE ans <> ''),
        n AS (SELECT model, grp, count(*) AS mapped, count(*) FILTER (ans <> truth) AS wrong, """ + ", ".join(f"count(*) FILTER (src = '{s}') AS selected_{s}, count(*) FILTER (src = '{s}' AND ans <> truth) AS wrong_{s}" for s in ("gt", "prev", "future", "absurd")) + """,
        count(*) AS truth_gt, count(*) FILTER (src IN ('prev', 'future')) AS strong, count(*) FILTER (src IN ('prev', 'future') AND ans <> truth) AS strong_wrong FROM z GROUP BY 1, 2)
        SELECT *, strong / mapped AS strong_rate, strong_wrong / nullif(wrong, 0) AS strong_given_wrong, coalesce(strong_wrong / nullif(wrong, 0), 0) AS strong_given_wrong_legacy FROM n""",
    "confidence_by_outcome": J + """ SELECT model, step, round(avg(conf) FILTER (ans <> ''), 6) AS conf_valid, count(conf) FILTER (ans <> '') AS n_valid, round(avg(conf) FILTER (ans = truth), 6) AS conf_correct, count(conf) FILTER (ans = truth) AS n_correct,
        round(avg(conf) FILTER (ans <> '' AND ans <> truth), 6) AS conf_wrong, count(conf) FILTER (ans <> '' AND ans <> truth) AS n_wrong FROM x GROUP BY 1, 2""",
    "overlapping_groups": J + """, z AS (SELECT *, group_state AS g FROM x UNION ALL SELECT *, 'ALL' FROM x UNION ALL SELECT *, 'UNP' FROM x WHERE group_state IN ('NP', 'PN', 'PP')) """ + BUCKET.format(bucket="g", name='"group"', source="z", extra=", 2"),
    "monotonic_confidence": J + G + """ SELECT model, count(*) AS "groups", count(*) FILTER (c0 >= c1 - 1e-6) AS n01, count(*) FILTER (c1 >= c2 - 1e-6) AS n12, count(*) FILTER (c0 >= c1 - 1e-6 AND c1 >= c2 - 1e-6) AS n012,
        count(*) FILTER (c0 >= c1 - 1e-6) / count(*) AS frac_n01, count(*) FILTER (c1 >= c2 - 1e-6) / count(*) AS frac_n12, count(*) FILTER (c0 >= c1 - 1e-6 AND c1 >= c2 - 1e-6) / count(*) AS frac_n012 FROM h GROUP BY 1""",
    "confidence_trend": J + G + """, z AS (SELECT model, sl AS slope, CASE WHEN sd > 1e-12 THEN sl / sd END AS zslope FROM h)
        SELECT model, count(*) AS "groups", """ + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std, round(avg(({c} < 0)::INT), 6) AS {c}_negative" for c in ("slope", "zslope")) + " FROM z GROUP BY 1",
    "confidence_trend_flat": J + G + """, q AS (SELECT model, floor(c0 * 5) / 5 AS c0, floor(c1 * 5) / 5 AS c1, floor(c2 * 5) / 5 AS c2 FROM g WHERE ok0 AND ok1 AND ok2 AND c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL),
        w AS (SELECT model, (c2 - c0) / 2 AS slope, sqrt((pow(c0 - (c0 + c1 + c2) / 3, 2) + pow(c1 - (c0 + c1 + c2) / 3, 2) + pow(c2 - (c0 + c1 + c2) / 3, 2)) / 3) AS sd FROM q),
        z AS (SELECT model, slope, CASE WHEN sd > 1e-12 THEN slope / sd ELSE 0 END AS zslope FROM w)
        SELECT model, count(*) AS "groups", """ + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std, round(avg(({c} < 0)::INT), 6) AS {c}_negative" for c in ("slope", "zslope")) + " FROM z GROUP BY 1",
    "confusion_matrix": J + """ SELECT model, true_state, count(*) FILTER (state = 'INTERACTION') AS "INTERACTION", count(*) FILTER (state = 'NO_INTERACTION') AS "NO_INTERACTION" FROM x WHERE true_state <> 'UNKNOWN' AND state <> 'INVALID' GROUP BY 1, 2""",
    "observed_steps": J + """, z AS (SELECT DISTINCT step, (k % 4 + 1) * 8 AS v FROM s) SELECT step, string_agg(v::VARCHAR, ';' ORDER BY v) AS observed FROM z GROUP BY 1""",
    "first_correct": J + """ SELECT model, true_state, file, key FROM x WHERE ans = truth AND true_state <> 'UNKNOWN' QUALIFY row_number() OVER (PARTITION BY model, true_state ORDER BY file, pos) <= 5""",
    "legacy_join": J + """ SELECT model, count(*) AS total, count(*) FILTER (event_id % 7 = 0) AS unmatched, count(*) FILTER (event_id % 7 <> 0 AND ans = truth) AS correct FROM x WHERE answered GROUP BY 1""",
    "answer_modes": J + """, z AS (SELECT CASE WHEN kk = 8 THEN '' ELSE ans END AS official, CASE WHEN kk = 8 THEN '' ELSE ans END AS legacy, CASE WHEN kk = 8 THEN 'A' WHEN form IN (0, 1) THEN 'A' ELSE ans END AS first_letter FROM x WHERE answered)
        SELECT official, legacy, first_letter, count(*) AS n FROM z GROUP BY 1, 2, 3""",
}
