"""Queries of the building side: question sets, pairs, lookups, taxonomy, regions,
manifests, sources; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions import parse, tokens
from vantage.operators import lookups, manifest, queryset, roi, score, switch, taxonomy
from vantage.plans import derived
from vantage.sources import files

#: Fixed template texts are parameters; this one shows all places that can be filled.
TEMPLATE = "At {t_eval}s, seen {window_start}-{window_end}s: A. {A} B. {B} C. {C} D. {D}"
DAY = 86_400


def raw(spark, sf_dir) -> DataFrame:
    """Samples as an annotation tool leaves them: rejected, invalid and unordered ones."""
    s = derived.samples(spark, sf_dir)
    return s.withColumns({
        "idx": F.when(F.col("k") != 7, F.col("pos")), "t_eval": F.when(F.col("k") != 11, F.col("t").cast("double")), "is_rejected": F.col("k") % 5 == 0, "is_invalid_annotation": F.col("k") % 17 == 0,
        "reject_reason": F.when(F.col("k") % 10 == 0, " No Hand ").otherwise("blur"), "interval_start_sec": F.col("file") * 10.0,
    })


def ordered(spark, sf_dir) -> DataFrame:
    """Samples with whole-day times, which repeat, in canonical order."""
    s = derived.samples(spark, sf_dir).withColumns({"idx": F.col("pos"), "t_eval": F.expr(f"t div {DAY}").cast("double")})
    return queryset.canonical_order(s)


def usable_samples(spark, sf_dir):
    now = queryset.usable_now(raw(spark, sf_dir), ("nohand",)).select("event_id", F.lit("now").alias("rule"))
    return now.unionAll(queryset.usable_other(raw(spark, sf_dir)).select("event_id", F.lit("other"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def canonical_order(spark, sf_dir):
    return queryset.canonical_order(raw(spark, sf_dir).filter("t_eval is not null")).select("event_id", "rank")


def dedupe_by_time(spark, sf_dir):
    return queryset.dedupe_by_time(ordered(spark, sf_dir)).select("file", "event_id")


def keep_k_of_n(spark, sf_dir):
    s = queryset.dedupe_by_time(ordered(spark, sf_dir))
    return queryset.keep_k_of_n(queryset.canonical_order(s.drop("rank")), stream=("region",)).select("region", "event_id")


def thin_exact(spark, sf_dir):
    return queryset.thin_exact(ordered(spark, sf_dir)).select("file", "event_id")


def anchor_islands(spark, sf_dir):
    s = ordered(spark, sf_dir).withColumn("anchor_idx", F.col("k") % 3)
    return queryset.anchor_islands(s).select("event_id", "unit", "unit_t")


def target_cutoff(spark, sf_dir):
    return queryset.target_cutoff(ordered(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def answerable(spark, sf_dir):
    s = derived.samples(spark, sf_dir)
    kept = queryset.answerable(s).groupBy("file").agg(F.count(F.lit(1)).alias("kept"))
    return s.groupBy("file").agg(F.count(F.lit(1)).alias("total")).join(kept, "file", "left").select("file", "total", F.coalesce("kept", F.lit(0)).alias("kept"))


def scheduled_time(spark, sf_dir):
    s = queryset.in_region(raw(spark, sf_dir).filter("t_eval is not null"))
    return queryset.scheduled_time(s, True).select("event_id", "t_eval", "t_eval_rel")


def windows(spark, sf_dir):
    """All evidence and context windows of the samples, on a clock that restarts each hour."""
    s = derived.samples(spark, sf_dir).withColumn("te", (F.col("t") % 3600).cast("double"))
    step, k = F.col("step"), F.col("k")
    lag = queryset.lag_of(step, [F.when(k % 4 == 0, k.cast("double"))], F.when(k % 4 == 1, F.array(F.lit(5.0), F.lit(0.0))))
    horizon = queryset.horizon_of(step, [F.when(k % 6 == 0, k.cast("double"))], [F.when(k % 6 == 1, F.array(F.lit(9.0), F.lit(18.0), F.lit(27.0)))], F.when(k % 6 == 2, F.col("te") + k - 50), F.col("te"))
    s = s.withColumns({"lag": lag, "horizon": horizon})
    start = F.when(k % 2 == 0, F.col("te") - k)
    w = s.select(
        "event_id", "te", "lag", "horizon", queryset.lookback_window(F.col("te"), F.when(k % 3 == 0, k.cast("double"))).alias("look"),
        queryset.evidence_window(F.col("te"), F.col("lag"), start, F.col("te") + 1, F.lit(3.0)).alias("ev"), queryset.context_window(F.col("te"), F.col("horizon"), True).alias("ctx"),
        queryset.online_window(F.col("te"), F.col("te") - 1, F.col("te") + k - 50, F.lit(4.0)).alias("on"),
    )
    return w.select("event_id", "lag", "horizon", F.col("look.start").alias("look_start"), F.col("ev.start").alias("ev_start"), F.col("ev.target").alias("ev_target"), F.col("ctx.start").alias("ctx_start"), F.col("ctx.target").alias("ctx_target"), F.col("on.start").alias("on_start"), F.col("on.end").alias("on_end"))


def options(spark, sf_dir) -> DataFrame:
    """Four options for each of ten parts in turn; every thirteenth set has only three."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    sets = p.groupBy((F.expr("p_partkey div 4")).alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    names = F.transform("x", lambda x: F.concat(F.lit("YOU take "), x["p_name"]))
    return sets.select("set_id", F.when(F.col("set_id") % 13 == 0, F.slice(names, 1, 3)).otherwise(names).alias("options"))


def attach_options(spark, sf_dir):
    s = derived.samples(spark, sf_dir).withColumn("set_id", F.col("event_id") % 600)
    good, bad = queryset.attach_options(s, options(spark, sf_dir), ("set_id",))
    g = good.groupBy(F.lit("fine").alias("fault")).agg(F.count(F.lit(1)).alias("n"))
    return g.unionAll(bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n")))


def render_prompts(spark, sf_dir):
    s = derived.samples(spark, sf_dir).withColumns({"set_id": F.col("event_id") % 400, "task": F.lit("sh_pred"), "flavor": F.when(F.col("k") % 2 == 0, "cand").otherwise("open")})
    s = s.withColumns({"t_eval": F.col("t") % 3600, "window_end": F.col("t") % 3600, "window_start": F.greatest(F.col("t") % 3600 - 20, F.lit(0))})
    good, _ = queryset.attach_options(s, options(spark, sf_dir), ("set_id",))
    t = spark.range(1).select(F.lit("sh_pred").alias("task"), F.lit("cand").alias("flavor"), F.lit(TEMPLATE).alias("template"))
    return queryset.render_prompts(good, t).select("event_id", "prompt")


def memory_windows(spark, sf_dir):
    s = derived.samples(spark, sf_dir).withColumn("te", F.col("t") % 120)
    s = s.withColumn("m", queryset.memory_windows(F.col("te"), lag=F.col("k")))
    s = s.withColumn("frames", queryset.keyframes(F.col("m.sparse_start"), F.col("m.sparse_end")))
    return s.select("event_id", F.col("m.dense_start").alias("dense_start"), F.col("m.sparse_start").alias("sparse_start"), F.col("m.note").alias("note"), F.size("frames").cast("long").alias("n_frames"), F.element_at("frames", -1).alias("last_frame"))


def caption_reuse(spark, sf_dir):
    s = derived.samples(spark, sf_dir).withColumn("segment_key", queryset.segment_key("seg", video=F.col("file"), day=F.expr(f"t div {DAY}")))
    c = s.filter("k % 2 = 0").select("segment_key", F.lit("seen").alias("caption")).distinct()
    got, segments = queryset.caption_reuse(s.select("event_id", "segment_key"), c)
    return got.join(segments, "segment_key").groupBy("caption", "missing").agg(F.count(F.lit(1)).alias("samples"), F.max("uses").alias("max_uses"))


def probe_pairs(spark, sf_dir):
    s = switch.with_bucket(derived.samples(spark, sf_dir), derived.STEP)
    near = switch.neighbours(s)
    length = F.lit(1e12)
    near = near.withColumn("span", switch.span(F.col("t").cast("double"), F.when(F.col("k") % 3 > 0, (F.col("t") - 100).cast("double")), (F.col("t") + 60).cast("double"), 40.0, length))
    pairs = switch.adjacent_pairs(near.select("file", "bucket", "region", "pos", "span"))
    return switch.probes(pairs, "ratio", 0.25, length).select("file", "idx", "pair_id", "role", "t_probe")


def neighbour_counts(spark, sf_dir):
    s = switch.with_bucket(derived.samples(spark, sf_dir), derived.STEP)
    kept = switch.neighbours(s).groupBy("region").agg(F.count(F.lit(1)).alias("kept"))
    return s.groupBy("region").agg(F.count(F.lit(1)).alias("total")).join(kept, "region", "left").select("region", "total", F.coalesce("kept", F.lit(0)).alias("kept"))


def positions(spark, sf_dir):
    p = derived.samples(spark, sf_dir).select("event_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("r:", "ratio:", "t:", "")]), (F.col("k") % 4 + 1).cast("int")), F.format_string("0.%02d", F.col("k"))).alias("raw"))
    return p.select("event_id", switch.parse_position("raw").alias("p")).select("event_id", "p.*")


def match_nearest(spark, sf_dir):
    """Predictions of which a third lost their key and have times some hours off."""
    s = derived.samples(spark, sf_dir)
    truths = s.select("file", "key", "pos", "t", "truth")
    k = F.col("event_id") % 6
    preds = s.select("file", F.when(k < 4, F.col("key")).otherwise("s:lost").alias("key"), F.when(k < 4, F.col("t")).otherwise(F.col("t") + (F.col("event_id") % 7 - 3) * 9000).alias("t"), F.col("event_id").alias("id"))
    got = lookups.match_by_key_then_time(preds, truths, 20_000)
    return got.groupBy("how", F.coalesce("truth", F.lit("-")).alias("truth")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def option_fallback(spark, sf_dir):
    s = derived.samples(spark, sf_dir).select("event_id", "k", "file")
    a = s.filter("k % 3 = 0").select("event_id", F.lit("own").alias("letter"))
    b = s.filter("k % 2 = 0").select("event_id", F.lit("param").alias("letter"))
    c = s.filter("file % 2 = 0").select("file", F.lit("index").alias("letter")).distinct()
    got = lookups.with_fallback(s, [("queryset", a, ["event_id"]), ("params", b, ["event_id"]), ("triplet", c, ["file"])], "letter")
    return got.groupBy("source", "letter").agg(F.count(F.lit(1)).alias("n"))


def judge_cache(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("text").alias("response")).withColumn("judge_key", lookups.judge_key("response"))
    cache = c.filter("conv_id % 2 = 0").select("judge_key", F.substr("judge_key", F.lit(1), F.lit(1)).alias("judged")).dropDuplicates(["judge_key"])
    got, ask = lookups.judge_cache(c, cache)
    hits = got.groupBy(F.coalesce("judged", F.lit("?")).alias("judged")).agg(F.count(F.lit(1)).alias("n"))
    return hits.unionAll(ask.agg(F.lit("to_ask"), F.count(F.lit(1))))


def terms(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(F.col("p_partkey").alias("term_id"), F.concat(base, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("_("), F.lower("p_type"), F.lit(",_"), F.split("p_name", " ")[1], F.lit(")"))).when(F.col("p_size") % 3 == 1, "_(note)").otherwise("")).alias("term"))


def taxonomy_variants(spark, sf_dir):
    return taxonomy.variants(terms(spark, sf_dir)).select("variant", "term_id")


VERBS = ("take", "hold", "wash", "put")


def narrations(spark, sf_dir) -> DataFrame:
    """Narrations of seven kinds: the noun after or before the verb, in the plural, without
    the verb, not in the taxonomy, or none."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    pick = lambda *forms: F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_size") % 7 + 1).cast("int"))
    text = pick("C holding %ss", "C C looks at the %s", "washed three cups with %s", "C C puts all the spoons into a drawer", "C C takes the %s from a box", "#C the %s was washed", "C C walks away")
    verb = pick("hold_(support,_grip)", "put", "wash", "put", "take", "wash", "put")
    return p.select(F.col("p_partkey").alias("narr_id"), F.replace(text, F.lit("%s"), F.col("p_name")).alias("text"), verb.alias("verb"))


def narration_nouns(spark, sf_dir):
    """Vocabularies are the words of the taxonomy's variants and of the verbs' variants."""
    nouns, told = taxonomy.variants(terms(spark, sf_dir)), narrations(spark, sf_dir)
    noun_words = nouns.select(F.explode("tokens").alias("word")).distinct()
    verb_words = told.select("verb").distinct().select(F.explode(taxonomy.variants_of("verb")).alias("v")).select(F.explode(F.split("v", "_")).alias("word")).distinct()
    got = taxonomy.narration_nouns(told, nouns, noun_words, verb_words)
    return got.select("narr_id", "how", F.coalesce(F.col("term_id").cast("string"), "phrase").alias("noun"))


def worded(spark, sf_dir):
    """Verb and noun answers written from the truth, some of them wrong or missing."""
    from vantage.plans import scoring

    j = scoring.joined(spark, sf_dir, "event_id")
    vocab = F.array(*[F.lit(v) for v in VERBS])
    k = F.col("event_id") % 5
    j = j.withColumn("pred_verb", F.when(F.col("answered"), F.when(k == 0, "put").when(k == 1, "holds").otherwise("holding"))).withColumn("pred_noun", F.when(F.col("answered") & (k != 3), F.when(k == 2, "cups").otherwise("ring")))
    gold = F.array(F.lit("hold"), F.lit("grip"))
    j = j.withColumn("verb_ok", F.coalesce(taxonomy.verb_match("pred_verb", gold, vocab), F.lit(False)))
    j = j.withColumn("noun_ok", F.coalesce(taxonomy.noun_match("pred_noun", F.array(F.lit("ring"), F.lit("band")), F.array(F.lit("ring"), F.lit("cup"))), F.lit(False)))
    return j


def open_ended(spark, sf_dir):
    return score.open_ended(worded(spark, sf_dir), ["model"])


def roi_frames(spark, sf_dir):
    s = derived.samples(spark, sf_dir).select("event_id", F.col("file").alias("video"), "k")
    s = s.withColumn("frames", roi.frames_1fps((F.col("k") / 2.0), F.col("k") + 0.5, F.lit(90), 8)).withColumnRenamed("event_id", "sample_id")
    rows = derived.samples(spark, sf_dir).filter("pos < 90").select(F.col("file").alias("video"), F.col("pos").alias("frame_idx"), F.lit("norm").alias("coord"), F.col("event_id").alias("line_no"),
        F.array(F.array(*[F.lit(x) for x in (0.1, 0.1, 0.2, 0.2)])).alias("boxes"), F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("double").alias("r")).alias("gaze"))
    got = roi.roi_join(s, rows, ["video"])
    return got.select(F.col("sample_id").alias("event_id"), F.size("frames").cast("long").alias("n_frames"), F.element_at("frames", -1).cast("long").alias("last_frame"), F.size(F.filter("rois", lambda r: F.size(r["boxes"]) > 0)).cast("long").alias("with_boxes"))


def roi_boxes(spark, sf_dir):
    """Boxes that differ by frame, some frames written twice, and a circle that is overridden."""
    s = derived.samples(spark, sf_dir).select("event_id", F.col("file").alias("video"), "k")
    s = s.withColumn("frames", roi.frames_1fps((F.col("k") / 2.0), F.col("k") + 0.5, F.lit(90), 8)).withColumnRenamed("event_id", "sample_id")
    have = derived.samples(spark, sf_dir).filter("pos < 90").select(F.col("file").alias("video"), F.col("pos").alias("frame_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line_no"))
    x = (F.col("frame_idx") * 2 + F.col("line_no")) / 200.0
    rows = have.filter("line_no = 0 or frame_idx % 5 = 0").withColumns({
        "coord": F.lit("norm"), "boxes": F.array(F.array(x, F.lit(0.1), F.lit(0.2), F.lit(0.2))), "gaze": F.struct(x.alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("double").alias("r")),
    })
    xs = F.transform(F.filter("rois", lambda r: F.size(r["boxes"]) > 0), lambda r: F.element_at(F.element_at(r["boxes"], 1), 1))
    own = roi.roi_join(s, rows, ["video"]).select("sample_id", F.aggregate(xs, F.lit(0.0), lambda a, v: a + v).alias("x_sum"), F.try_element_at(xs, F.lit(-1)).alias("x_last"), F.try_element_at("rois", F.lit(1))["gaze"]["r"].alias("radius"))
    fixed = roi.roi_join(s, rows, ["video"], gaze={"x": 0.25, "y": 0.75, "r": 0.9}).select("sample_id", F.element_at("rois", -1)["gaze"].alias("g"))
    return own.join(fixed.hint("merge"), "sample_id").select(F.col("sample_id").alias("event_id"), F.round("x_sum", 6).alias("x_sum"), "x_last", "radius", F.col("g.x").alias("gaze_x"), F.col("g.r").alias("gaze_r"))


def open_ended_words(spark, sf_dir):
    """Verb and noun answers without states: only the words decide, over all samples."""
    return score.open_ended(worded(spark, sf_dir), ["model"], with_state=False)


def roi_violations(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).select("event_id", F.when(F.col("k") % 10 == 0, "pixel").otherwise("norm").alias("coord"), F.array(F.when(F.col("k") % 10 == 1, F.array(F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.when(F.col("k") % 10 == 2, 1.5).otherwise(1.0)))).alias("boxes"),
        F.struct(F.when(F.col("k") % 10 == 3, -0.1).otherwise(0.5).alias("x"), F.lit(1.0).alias("y")).alias("gaze"))
    return roi.roi_violations(rows).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def roi_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    name = lambda s: F.concat(F.lit(f"{s}/"), F.col("page_id"), F.lit(".jsonl"))
    r = p.withColumn("candidates", F.array(name("a"), name("b"), name("c")))
    have = p.filter("page_id % 3 = 1").select(name("b").alias("path")).unionAll(p.filter("page_id % 2 = 1").select(name("c").alias("path")))
    return roi.first_existing(r, "candidates", have, "page_id").select("page_id", "resolved")


def token_evidence(spark, sf_dir):
    """Generated tokens spelled from the predictions in five ways: tags cut in two, words of
    an option, two letters in the tag, nothing of use, a letter at the head."""
    p = derived.predictions(spark, sf_dir)
    state, tagged, guessed = F.coalesce(parse.tag_value("response_text", "STATE"), F.lit("")), parse.tag_value("response_text", "ANS"), parse.guess("response_text", "legacy")
    p = p.withColumns({"said": F.coalesce(tagged, guessed), "state": state, "tagged": tagged, "guessed": guessed})
    verbs = ("take", "hold", "put", "wash")
    verb = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in zip("ABCD", verbs, strict=True) for x in pair]), F.col("said")), F.lit("look"))
    lit = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    ways = [
        lit("<NOW>", "<", "STATE>", " ", F.col("state"), "</STATE", ">", "<ANS>", F.col("said"), "</ANS>"), lit("I", verb), lit("<ANS>", "A", "B", "</ANS>"), lit("hello"), lit(F.col("said"), ".", "<NOW>"),
    ]
    toks = F.coalesce(*[F.when(F.col("event_id") % 5 == i, w) for i, w in enumerate(ways)])
    p = p.withColumn("toks", toks).withColumn("probs", F.transform(F.sequence(F.lit(1), F.size("toks")), lambda i: i / 10.0))
    o = F.array(*[F.struct(F.lit(v).alias("verb"), F.array(F.lit(n)).alias("noun")) for v, n in zip(verbs, ("ring", "bolt", "cup", "plate"), strict=True)])
    p = p.withColumn("e", tokens.token_evidence(F.col("toks"), F.col("probs"), o))
    p = p.withColumn("c", tokens.cascade(F.col("e"), F.col("tagged"), F.col("guessed")))
    return p.groupBy("model", F.col("c.ans").alias("ans"), F.col("c.method").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e.state_prob"), 6).alias("state_prob"), F.round(F.avg("c.conf"), 6).alias("conf"))


def choice_distribution(spark, sf_dir):
    s = derived.samples(spark, sf_dir).select("event_id", "k")
    m = F.array(*[x.cast("double") for x in (F.col("event_id") % 7 + 1, F.col("event_id") % 5 + 1, F.col("event_id") % 3 + 1, F.col("k") % 11 + 1)])
    s = s.withColumn("d", parse.choice_distribution(m)).withColumn("l", parse.sequence_logprob(F.transform(m, lambda x: -x)))
    return s.select("event_id", F.col("d.mass").alias("mass"), F.col("d.best").alias("best"), F.round("d.entropy", 6).alias("entropy"), F.col("l.sum").alias("logp"), F.col("l.mean").alias("mean_logp"))


def tags(spark, sf_dir):
    p = derived.predictions(spark, sf_dir).withColumn("text", F.concat("response_text", F.lit("\n< conf >"), F.format_string("%d.5", F.col("event_id") % 2), F.lit("</CONF>")))
    m = parse.tag_map("text")
    return p.groupBy(parse.tag_value("text", "state").alias("state"), parse.stated_confidence("text").alias("conf"), F.try_element_at(m, F.lit("ANS")).alias("ans"), parse.tag_block("text").isNotNull().alias("block")).agg(F.count(F.lit(1)).alias("n"))


def response_audit(spark, sf_dir):
    """Answers written out with all tags, some of them with one thing wrong."""
    p = derived.predictions(spark, sf_dir).withColumn("ans", parse.answer()).filter("ans <> ''")
    prompt = F.lit("A. YOU take ring\nB. YOU hold bolt\nC. YOU put cup\nD. YOU none none")
    # one prompt for all samples here: its options are read once and sent along as one row
    one = spark.range(1).select(parse.options_of_prompt(prompt).alias("o"))
    p = p.crossJoin(F.broadcast(one)).withColumn("own", F.element_at("o", F.col("ans")))
    c = F.col("event_id") % 6
    desc = F.when(F.col("ans") == "D", "YOU do nothing").otherwise(F.concat(F.lit("you "), F.col("own.verb"), F.lit("  "), F.col("own.noun"), F.lit(".")))
    full = F.concat(
        F.lit("<NOW><STATE>"), F.when(c == 3, "maybe").otherwise("Interaction"), F.lit("</STATE><ANS>"), F.col("ans"), F.lit("</ANS><VERB>"), F.when(c == 1, "eat").otherwise(F.col("own.verb")), F.lit("</VERB><NOUN>"),
        F.col("own.noun"), F.lit("</NOUN><DESC>"), F.when(c == 2, "YOU sleep").otherwise(desc), F.lit("</DESC>"), F.when(c == 4, "").otherwise("<CONF>0.5</CONF>"), F.lit("</NOW>"))
    p = p.withColumn("body", F.when(c == 5, F.col("response_text")).otherwise(full))
    p = p.withColumn("fault", parse.response_fault("now_full", True, "body", "o")).withColumn("fix", parse.coerce_tags("body", "o", "fault"))
    return p.groupBy("model", F.coalesce("fault", F.lit("none")).alias("fault"), F.col("fix.changed").alias("changed"), F.coalesce("fix.why", F.lit("-")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


def audit_kinds(spark, sf_dir):
    """Which tags prompts about the present ask for."""
    asks = ["<NOW><STATE></STATE>< conf ></CONF></NOW>", "<now><ANS></ANS><VERB></VERB><CONF></CONF></now>", "<STATE> <CONF>", "<NOW><STATE></STATE><VERB></VERB><CONF></CONF></NOW>"]
    s = derived.samples(spark, sf_dir).withColumn("ask", F.get(F.array(*map(F.lit, asks)), (F.col("k") % 4).cast("int")))
    return s.groupBy(parse.now_schema(F.col("ask")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def coerced(spark, sf_dir):
    """Broken answers made whole: by their letter, by the words of an option, by the option
    without interaction, or by the first one where the prompt has no such option."""
    s = derived.samples(spark, sf_dir).select("event_id", "k")
    verbs, nouns = ("take", "hold", "put", "wash"), ("small_ring", "bolt_(steel)", "cup", "plate")
    lines = lambda last: "\n".join(f"{x}. YOU {v} {n}" for x, v, n in zip("ABCD", [*verbs[:3], last[0]], [*nouns[:3], last[1]], strict=True))
    asked = F.when(F.col("k") % 2 == 0, lines(("none", "none"))).otherwise(lines((verbs[3], nouns[3])))
    said = ("<ANS>b</ANS> or so", "they hold a steel bolt", "a small ring, take it", "put the cup, then hold the bolt", "nothing to see", "")
    s = s.withColumns({"asked": asked, "said": F.get(F.array(*map(F.lit, said)), (F.col("event_id") % 6).cast("int"))})
    s = s.withColumn("o", parse.options_of_prompt("asked")).withColumn("fault", parse.response_fault("now_action_mcq", True, "said", "o"))
    s = s.withColumn("fix", parse.coerce_tags("said", "o", "fault"))
    return s.groupBy("said", F.col("fix.text").alias("line"), F.col("fix.why").alias("why"), "fault").agg(F.count(F.lit(1)).alias("n"))


def truth_letters(spark, sf_dir):
    """True letters from the options' answer, their index, the sample's own answer or index;
    some indexes are out of range and some answers no letter, so the next source counts."""
    s = derived.samples(spark, sf_dir).select("event_id", "k", "truth")
    c, other = F.col("k") % 7, F.col("event_id") % 4
    s = s.withColumns({
        "m_ans": F.when(c == 0, F.concat(F.lit(" "), F.lower("truth"), F.lit(" "))).when(c == 3, "none"), "m_idx": F.when(c == 1, other).when(c == 4, F.lit(4)),
        "ans": F.when(c.isin(2, 4), F.col("truth")), "idx": F.when(c == 3, other).when(c == 5, F.lit(-1)),
    })
    return s.groupBy(parse.truth_letter(("m_ans", None, "m_idx"), ("ans", None, "idx")).alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def lead_steps(spark, sf_dir):
    """Steps by number, else by seconds near 8, 16 or 24."""
    s = derived.samples(spark, sf_dir).withColumns({"own": F.when(F.col("k") % 3 == 0, F.col("k") % 5), "sec": F.when(F.col("k") % 4 > 0, F.col("k") % 4 * 8 + (F.col("event_id") % 3) * 0.0009)})
    return s.groupBy(parse.step_of("own", "sec").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def option_words(spark, sf_dir):
    return terms(spark, sf_dir).select("term_id", parse.option_words(F.concat(F.lit("YOU Take_up "), F.col("term"))).alias("o")).select("term_id", F.col("o.verb").alias("verb"), F.array_join("o.noun", " ").alias("noun"))


def stated_confidence_by_source(spark, sf_dir):
    from vantage.plans import scoring

    j = scoring.joined(spark, sf_dir, "sources", "event_id").filter("ans <> ''").withColumn("picked", F.try_element_at("sources", F.ascii("ans") - 64))
    j = j.withColumn("stated", parse.stated_confidence(F.concat(F.lit("<CONF>"), (F.col("event_id") % 3 / 2.0).cast("string"), F.lit("</CONF>"))))
    out = score.stated_confidence(j, ["model"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def manifest_rows(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    path = F.concat(F.lit("/home/u/"), F.col("page_id"))
    payload = F.to_json(F.struct(
        F.lit("d").alias("dataset"), path.alias("secret_top"), F.struct(F.lit("c").alias("clip_id"), path.alias("owner"), F.when(F.col("page_id") % 2 == 0, path).otherwise("val").alias("split")).alias("video_metadata"),
        F.struct(path.alias("mcp_path"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/data/x/"), F.col("page_id"))).otherwise(F.col("url")).alias("note")).alias("params"),
        F.struct(F.array(F.col("url"), F.when(F.col("page_id") % 4 == 0, "see /home/me").otherwise("fine")).alias("links")).alias("sample")))
    return p.select("page_id", F.concat(F.lit("t"), F.col("page_id") % 3).alias("task"), payload.alias("payload"), F.when(F.col("page_id") % 5 > 0, "target").alias("target_text"), F.when(F.col("page_id") % 7 > 0, "ask").otherwise(" \t").alias("prompt"))


def sanitize_manifest(spark, sf_dir):
    s = manifest.sanitize(manifest_rows(spark, sf_dir), "payload", "task", requires_roi=True)
    field = lambda p: F.get_json_object("clean", p)
    return s.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.sum("removed").alias("removed"), F.count_if(F.size("left") > 0).alias("suspicious"), F.count_if(field("$.sft_task") == F.col("task")).alias("named"),
        F.count(field("$.video_metadata.split")).alias("splits"), F.count(field("$.params.note")).alias("notes"), F.count(field("$.secret_top")).alias("secrets"), F.count(field("$.assets.roi_cache_layout_hint")).alias("hints"))


def usable_manifest(spark, sf_dir):
    u = manifest.usable(manifest_rows(spark, sf_dir))
    path = manifest.clip_path("clips/", F.concat(F.lit("v "), F.col("page_id")), F.col("page_id") / 8.0, F.col("page_id") / 8.0 + 1)
    return u.select("page_id", path.alias("clip"))


def run_log(spark, sf_dir):
    s = derived.samples(spark, sf_dir).select(F.col("region").alias("task"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.lit("cand").alias("flavor"), F.when(F.col("k") < 80, "processed").when(F.col("k") < 95, "skipped").otherwise("failed").alias("status"), F.col("k").cast("double").alias("elapsed_sec"))
    return files.run_log_summary(s)


def pending_work(spark, sf_dir):
    s = derived.samples(spark, sf_dir).select("file", "key")
    done = derived.predictions(spark, sf_dir).filter("model = 'm0'").select("file", "key")
    return files.pending_work(s, done, ["file", "key"]).groupBy("file").agg(F.count(F.lit(1)).alias("pending"))


def index_by_triplet(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("out/model__v"), F.col("page_id") % 50, F.lit("__"), F.col("page_id") % 7, F.lit("__c"), F.col("page_id") % 3, F.lit(".json")).alias("path"), F.col("page_id"))
    p = p.withColumn("path", F.concat(F.lit("d"), F.col("page_id") % 10, F.lit("/"), F.col("path")))
    return files.index_by_triplet(p, "path").select("video_uid", "clip_id", "clip_uid", "path")


def resolve_references(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    listing = p.filter("page_id % 4 <> 3").select(F.concat(F.when(F.col("page_id") % 4 == 0, "new/").when(F.col("page_id") % 4 == 1, "alt/").otherwise("old/"), F.col("page_id"), F.when(F.col("page_id") % 4 == 2, ".jsonl").otherwise(".json")).alias("path"))
    refs = p.select(F.col("page_id").alias("ref_id"), F.array(F.concat(F.lit("/mnt/"), F.col("page_id"), F.lit(".json"))).alias("candidates"))
    got, lost = files.resolve_references(refs, listing, ["new/", "alt/", "old/"], [("/mnt/", "new/")])
    return got.select("ref_id", "path", "strategy").unionAll(lost.select("ref_id", F.lit(None).cast("string"), F.lit("unresolved")))


def normalized_predictions(spark, sf_dir):
    p = derived.predictions(spark, sf_dir).withColumns({"parsed": F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("Answer"), F.lit("c"))), "video_uid": F.concat(F.lit("v"), F.col("file"))})
    return files.normalized(p).groupBy("model", F.col("prediction").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))


B = "WITH " + derived.SQL
O = ", o AS (SELECT *, pos AS rank, t // 86400 AS d FROM s)"  # noqa: E741
_NAMES = "SELECT p_partkey AS id, lower(replace(p_name, ' ', '_')) AS base, lower(p_type) AS ty, split_part(p_name, ' ', 2) AS w2, p_size FROM part"

QUERIES = {
    f.__name__: f
    for f in (usable_samples, canonical_order, dedupe_by_time, keep_k_of_n, thin_exact, anchor_islands, target_cutoff, answerable, scheduled_time, windows, attach_options, render_prompts, memory_windows,
              caption_reuse, probe_pairs, neighbour_counts, positions, match_nearest, option_fallback, judge_cache, taxonomy_variants, narration_nouns, open_ended, open_ended_words, roi_frames, roi_boxes, roi_violations, roi_paths, token_evidence,
              choice_distribution, tags, response_audit, audit_kinds, coerced, truth_letters, lead_steps, option_words, stated_confidence_by_source, sanitize_manifest, usable_manifest, run_log, pending_work, index_by_triplet, resolve_references, normalized_predictions)
}

_LAG = "CASE WHEN k % 4 = 0 AND k > 0 THEN k::DOUBLE WHEN k % 4 = 1 AND step = 0 THEN 5.0 ELSE 8.0 * (step + 1) END"
_HOR = "CASE WHEN k % 6 = 0 AND k > 0 THEN k::DOUBLE WHEN k % 6 = 1 THEN 9.0 * (step + 1) WHEN k % 6 = 2 AND te + k - 50 > 0 AND k > 50 THEN (k - 50)::DOUBLE ELSE 8.0 * (step + 1) END"

_listed = lambda words: ", ".join(f"'{w}'" for w in words)

ORACLE = {
    "thin_exact": """WITH RECURSIVE """ + derived.SQL.strip() + f""", o AS (SELECT row_number() OVER (ORDER BY file, pos) AS i, file, event_id, t // {DAY} AS d FROM s),
        r AS (SELECT 0::BIGINT AS i, -1::BIGINT AS file, -1::BIGINT AS event_id, []::BIGINT[] AS used, 0::BIGINT AS phase, false AS kept
          UNION ALL SELECT z.i, z.file, z.event_id, CASE WHEN z.kept THEN list_append(z.own, z.d) ELSE z.own END, CASE WHEN z.again THEN z.phase ELSE (z.phase + 1) % 3 END, z.kept
          FROM (SELECT y.*, NOT y.again AND y.phase < 2 AS kept FROM (SELECT x.*, list_contains(x.own, x.d) AS again FROM (
            SELECT o.i, o.file, o.event_id, o.d, r.phase, CASE WHEN o.file = r.file THEN r.used ELSE []::BIGINT[] END AS own FROM r JOIN o ON o.i = r.i + 1) x) y) z)
        SELECT file, event_id FROM r WHERE kept""",
    "usable_samples": B + """ SELECT 'now' AS rule, count(*) AS n, sum(event_id)::BIGINT AS ids FROM s WHERE k % 17 <> 0 AND k <> 11 AND (k % 5 <> 0 OR k % 10 = 0) UNION ALL
        SELECT 'other', count(*), sum(event_id)::BIGINT FROM s WHERE k % 5 <> 0 AND k <> 11""",
    "canonical_order": B + " SELECT event_id, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN k <> 7 THEN pos ELSE 1e9 END, t, pos) - 1 AS rank FROM s WHERE k <> 11",
    "dedupe_by_time": B + O + " SELECT file, event_id FROM o QUALIFY row_number() OVER (PARTITION BY file, d ORDER BY rank) = 1",
    "keep_k_of_n": B + O + """, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file, d ORDER BY rank) = 1)
        SELECT region, event_id FROM f QUALIFY (row_number() OVER (PARTITION BY region ORDER BY file, rank) - 1) % 3 < 2""",
    "anchor_islands": B + O + """, i AS (SELECT *, CASE WHEN k % 3 <> lag(k % 3) OVER (PARTITION BY file ORDER BY rank) THEN 1 ELSE 0 END AS n FROM o),
        u AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY rank) AS unit FROM i)
        SELECT event_id, unit::BIGINT AS unit, first_value(d) OVER (PARTITION BY file, unit ORDER BY rank)::DOUBLE AS unit_t FROM u""",
    "target_cutoff": B + ", f AS (SELECT file, count(*) AS n FROM s GROUP BY 1) SELECT file, n FROM f QUALIFY coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 800",
    "answerable": B + " SELECT file, count(*) AS total, count(*) FILTER (group_state = 'NN') AS kept FROM s GROUP BY 1",
    "scheduled_time": B + " SELECT event_id, t::DOUBLE + file * 10.0 AS t_eval, t::DOUBLE AS t_eval_rel FROM s WHERE k <> 11 AND region = 'segment'",
    "windows": B + f""", z AS (SELECT *, (t % 3600)::DOUBLE AS te FROM s), q AS (SELECT *, {_LAG} AS lag, {_HOR} AS horizon FROM z),
        r AS (SELECT *, greatest(0, least(te + k - 50, te)) AS oe FROM q), v AS (SELECT *, least(greatest(0, te - 1), oe) AS os FROM r)
        SELECT event_id, lag, horizon, greatest(0, te - CASE WHEN k % 3 = 0 THEN k ELSE 20 END)::DOUBLE AS look_start, least(greatest(CASE WHEN k % 2 = 0 THEN te - k + 3 ELSE te - lag - 2 END, 0), te)::DOUBLE AS ev_start, te - lag AS ev_target,
        greatest(0, te - greatest(20, horizon))::DOUBLE AS ctx_start, te + horizon AS ctx_target, CASE WHEN oe - os < 4 THEN greatest(0, oe - 4) ELSE os END::DOUBLE AS on_start, oe::DOUBLE AS on_end FROM v""",
    "attach_options": B + """, c AS (SELECT p_partkey // 4 AS set_id, count(*) AS n FROM part GROUP BY 1), g AS (SELECT CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n <> 4 OR c.set_id % 13 = 0 THEN 'not_four' ELSE 'fine' END AS fault
        FROM s LEFT JOIN c ON c.set_id = s.event_id % 600) SELECT fault, count(*) AS n FROM g GROUP BY 1""",
    "render_prompts": B + """, c AS (SELECT p_partkey // 4 AS set_id, list('YOU take ' || p_name ORDER BY p_partkey) AS o FROM part GROUP BY 1)
        SELECT event_id, 'At ' || (t % 3600) || '.0s, seen ' || greatest(t % 3600 - 20, 0) || '.0-' || (t % 3600) || '.0s: A. ' || o[1] || ' B. ' || o[2] || ' C. ' || o[3] || ' D. ' || o[4] AS prompt
        FROM s JOIN c ON c.set_id = s.event_id % 400 WHERE k % 2 = 0 AND c.set_id % 13 <> 0 AND len(o) = 4""",
    "memory_windows": B + """, m AS (SELECT event_id, k, greatest(0, t % 120 - 10) AS ds, greatest(0, greatest(0, t % 120 - 10) - 30) AS ss FROM s)
        SELECT event_id, ds::DOUBLE AS dense_start, ss::DOUBLE AS sparse_start, CASE WHEN k > 40 THEN 'coverage_limited_long_lag' END AS note, (ds - ss) // 4 + 1 AS n_frames, (ss + (ds - ss) // 4 * 4)::DOUBLE AS last_frame FROM m""",
    "caption_reuse": B + """, g AS (SELECT file, t // 86400 AS d, count(*) AS uses, bool_or(k % 2 = 0) AS seen FROM s GROUP BY 1, 2)
        SELECT CASE WHEN seen THEN 'seen' ELSE '(caption unavailable)' END AS caption, NOT seen AS missing, sum(uses)::BIGINT AS samples, max(uses) AS max_uses FROM g GROUP BY 1, 2""",
    "probe_pairs": B + """, b AS (SELECT *, round_even(t / 43200, 0)::BIGINT AS bucket, CASE WHEN k % 3 > 0 THEN greatest(t - 100, 0) ELSE greatest(t - 20, 0) END::DOUBLE AS ss, CASE WHEN k % 3 > 0 THEN t + 60 ELSE t + 20 END::DOUBLE AS se FROM s WHERE region <> 'other'),
        p AS (SELECT a.file, a.bucket, CASE a.region WHEN 'gap' THEN 'gap_to_segment' ELSE 'segment_to_gap' END AS pt, a.pos AS pa, b.pos AS pb, a.region AS ra, (a.ss + (a.se - a.ss) * 0.5) AS ta, (b.ss + (b.se - b.ss) * 0.25) AS tb
              FROM b a JOIN b ON a.file = b.file AND b.bucket = a.bucket + 1 AND a.region <> b.region),
        w AS (SELECT *, 0 AS side, CASE ra WHEN 'gap' THEN 'fixed_gap_mid' ELSE 'fixed_segment_mid' END AS role, ta AS t_probe FROM p UNION ALL SELECT *, 1, CASE ra WHEN 'gap' THEN 'scan_segment' ELSE 'scan_gap' END, tb FROM p)
        SELECT file, row_number() OVER (PARTITION BY file ORDER BY bucket, pt, pa, pb, side) - 1 AS idx, pt || '|k' || bucket || '|' || pa || '-' || pb AS pair_id, role, t_probe FROM w""",
    "neighbour_counts": B + """, b AS (SELECT *, round_even(t / 43200, 0)::BIGINT AS bucket FROM s)
        SELECT region, count(*) AS total, count(*) FILTER (region <> 'other' AND EXISTS (SELECT 1 FROM b o WHERE o.file = b.file AND abs(o.bucket - b.bucket) = 1 AND o.region <> b.region AND o.region <> 'other')) AS kept FROM b GROUP BY 1""",
    "positions": B + " SELECT event_id, CASE WHEN k % 4 = 2 THEN 'time' ELSE 'ratio' END AS mode, k / 100 AS value, k % 4 = 3 AS heuristic FROM s",
    "match_nearest": B + """, p AS (SELECT event_id, file, CASE WHEN event_id % 6 < 4 THEN t ELSE t + (event_id % 7 - 3) * 9000 END AS t, event_id % 6 < 4 AS by_key, truth FROM s),
        u AS (SELECT file, t, max_by(truth, pos) AS truth, min(pos) AS first_pos FROM s GROUP BY 1, 2),
        m AS (SELECT p.event_id, u.truth FROM p JOIN u ON u.file = p.file AND abs(u.t - p.t) <= 20000 WHERE NOT p.by_key QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(u.t - p.t), u.first_pos) = 1),
        h AS (SELECT p.event_id, CASE WHEN by_key THEN 'key' WHEN m.truth IS NOT NULL THEN 'time' ELSE 'none' END AS how, CASE WHEN by_key THEN p.truth ELSE coalesce(m.truth, '-') END AS truth FROM p LEFT JOIN m USING (event_id))
        SELECT how, truth, count(*) AS n, sum(event_id)::BIGINT AS ids FROM h GROUP BY 1, 2""",
    "option_fallback": B + """, z AS (SELECT CASE WHEN k % 3 = 0 THEN 'queryset' WHEN k % 2 = 0 THEN 'params' WHEN file % 2 = 0 THEN 'triplet' ELSE 'none' END AS source FROM s)
        SELECT source, CASE source WHEN 'queryset' THEN 'own' WHEN 'params' THEN 'param' WHEN 'triplet' THEN 'index' END AS letter, count(*) AS n FROM z GROUP BY 1, 2""",
    "judge_cache": """WITH c AS (SELECT conv_id, sha1(coalesce(text, '')) AS h FROM conversations), a AS (SELECT DISTINCT h FROM c WHERE conv_id % 2 = 0)
        SELECT coalesce(substr(a.h, 1, 1), '?') AS judged, count(*) AS n FROM c LEFT JOIN a USING (h) GROUP BY 1 UNION ALL SELECT 'to_ask', count(DISTINCT h) FROM c WHERE h NOT IN (SELECT h FROM a)""",
    "taxonomy_variants": f"""WITH n AS ({_NAMES}), v AS (SELECT id, base AS v FROM n UNION ALL SELECT id, ty FROM n WHERE p_size % 3 = 0 UNION ALL SELECT id, lower(w2) FROM n WHERE p_size % 3 = 0)
        SELECT replace(v, ' ', '_') AS variant, min(id) AS term_id FROM v GROUP BY 1""",
    "narration_nouns": f"""WITH n AS ({_NAMES}), a AS (SELECT id, base AS v FROM n UNION ALL SELECT id, ty FROM n WHERE p_size % 3 = 0 UNION ALL SELECT id, lower(w2) FROM n WHERE p_size % 3 = 0),
        va AS (SELECT replace(v, ' ', '_') AS variant, min(id) AS term_id FROM a GROUP BY 1), nw AS (SELECT DISTINCT unnest(string_split(variant, '_')) AS x FROM va),
        vw AS (SELECT unnest(['take', 'hold', 'support', 'grip', 'put', 'wash']) AS x),
        t AS (SELECT p_partkey AS id, ['hold', 'put', 'wash', 'put', 'take', 'wash', 'put'][p_size % 7 + 1] AS verb, string_split(lower(['holding ' || p_name || 's', 'looks at the ' || p_name, 'washed three cups with ' || p_name,
          'puts all the spoons into a drawer', 'takes the ' || p_name || ' from a box', 'the ' || p_name || ' was washed', 'walks away'][p_size % 7 + 1]), ' ') AS said,
          p_size % 7 IN (0, 5) AS one FROM part),
        w AS (SELECT id, verb, CASE WHEN one THEN list_prepend('c', said) ELSE said END AS w FROM t), r AS (SELECT id, verb, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
        u AS (SELECT DISTINCT x FROM r), st AS (SELECT x, CASE WHEN x IN (FROM vw) THEN x WHEN x LIKE '%ing' AND length(x) > 5 AND x[:-4] IN (FROM vw) THEN x[:-4] WHEN x LIKE '%ed' AND length(x) > 3 AND x[:-3] IN (FROM vw) THEN x[:-3]
          WHEN x LIKE '%es' AND length(x) > 3 AND x[:-3] IN (FROM vw) THEN x[:-3] WHEN x LIKE '%s' AND length(x) > 2 AND x[:-2] IN (FROM vw) THEN x[:-2] ELSE x END AS stem,
          CASE WHEN x NOT IN (FROM nw) AND x LIKE '%s' AND length(x) > 3 AND x[:-2] IN (FROM nw) THEN x[:-2] ELSE x END AS sing FROM u),
        m AS (SELECT r.*, stem, sing, min(CASE WHEN stem = verb THEN i END) OVER (PARTITION BY id) AS p FROM r JOIN st USING (x)), l AS (SELECT id, any_value(p) AS p, list(sing ORDER BY i) AS w FROM m GROUP BY 1),
        s AS (SELECT id, p, w, unnest(range(1, len(w) + 1)) AS i FROM l), g AS (SELECT id, p, i, k, array_to_string(w[i:i + k - 1], '_') AS variant FROM s, range(1, 5) z(k) WHERE i + k - 1 <= len(w)),
        o AS (SELECT id, term_id FROM g JOIN va USING (variant) WHERE p IS NULL OR i > p OR i + k <= p
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN p IS NULL OR i > p THEN 0 ELSE 1 END, CASE WHEN p IS NULL THEN 0 ELSE abs(i - p) END, -k, i) = 1),
        d AS (SELECT *, coalesce(bool_and(x IN ({_listed(taxonomy.DETERMINERS)})) OVER (PARTITION BY id ORDER BY i), false) AS lead FROM m WHERE i > p),
        e AS (SELECT *, bool_or(NOT lead AND x IN ({_listed(taxonomy.PREPOSITIONS)})) OVER (PARTITION BY id ORDER BY i) AS stop FROM d), h AS (SELECT id, string_agg(x, '_' ORDER BY i) AS phrase FROM e WHERE NOT lead AND NOT stop GROUP BY 1)
        SELECT l.id AS narr_id, CASE WHEN term_id IS NOT NULL THEN 'taxonomy_match' WHEN phrase IS NOT NULL THEN 'heuristic_after_verb' ELSE 'none' END AS how, coalesce(term_id::VARCHAR, phrase, 'none') AS noun
        FROM l LEFT JOIN o USING (id) LEFT JOIN h USING (id)""",
    "open_ended": B + """, z AS (SELECT *, event_id % 5 AS q, answered AND event_id % 5 <> 0 AS vok, answered AND event_id % 5 NOT IN (2, 3) AS nok, true_state = 'INTERACTION' AS seen FROM x),
        n AS (SELECT model, count(*) FILTER (seen) AS total, count(*) FILTER (seen AND state = 'INTERACTION' AND answered) AS state_right, count(*) FILTER (seen AND state = 'INTERACTION' AND vok) AS verb,
        count(*) FILTER (seen AND state = 'INTERACTION' AND nok) AS noun, count(*) FILTER (seen AND state = 'INTERACTION' AND vok AND nok) AS pair, count(*) FILTER (seen AND NOT answered) AS verb_missing,
        count(*) FILTER (seen AND (NOT answered OR q = 3)) AS noun_missing FROM z GROUP BY 1)
        SELECT *, verb / total AS verb_acc, noun / total AS noun_acc, pair / total AS pair_acc, verb / nullif(state_right, 0) AS verb_acc_given_state, noun / nullif(state_right, 0) AS noun_acc_given_state, pair / nullif(state_right, 0) AS pair_acc_given_state FROM n""",
    "roi_frames": B + """, f AS (SELECT event_id, file, least(k // 2, 89) AS a, least(k, 89) AS b FROM s), g AS (SELECT *, greatest(b, a) - a + 1 AS n FROM f),
        h AS (SELECT event_id, file, CASE WHEN n <= 8 THEN range(a, greatest(b, a) + 1) ELSE list_transform(range(8), lambda i: a + i * n // 8) END AS fr FROM g),
        c AS (SELECT file, count(*) AS m FROM s WHERE pos < 90 GROUP BY 1)
        SELECT event_id, len(fr) AS n_frames, fr[-1] AS last_frame, len(list_filter(fr, lambda i: i < c.m)) AS with_boxes FROM h JOIN c USING (file)""",
    "open_ended_words": B + """, z AS (SELECT *, event_id % 5 AS q, answered AND event_id % 5 <> 0 AS vok, answered AND event_id % 5 NOT IN (2, 3) AS nok FROM x),
        n AS (SELECT model, count(*) AS total, count(*) AS state_right, count(*) FILTER (vok) AS verb, count(*) FILTER (nok) AS noun, count(*) FILTER (vok AND nok) AS pair, count(*) FILTER (NOT answered) AS verb_missing,
        count(*) FILTER (NOT answered OR q = 3) AS noun_missing FROM z GROUP BY 1)
        SELECT *, verb / total AS verb_acc, noun / total AS noun_acc, pair / total AS pair_acc, verb / state_right AS verb_acc_given_state, noun / state_right AS noun_acc_given_state, pair / state_right AS pair_acc_given_state FROM n""",
    "roi_boxes": B + """, f AS (SELECT event_id, file, least(k // 2, 89) AS a, least(k, 89) AS b FROM s), g AS (SELECT *, greatest(b, a) - a + 1 AS n FROM f),
        h AS (SELECT event_id, file, CASE WHEN n <= 8 THEN range(a, greatest(b, a) + 1) ELSE list_transform(range(8), lambda i: a + i * n // 8) END AS fr FROM g),
        c AS (SELECT file, count(*) AS m FROM s WHERE pos < 90 GROUP BY 1),
        v AS (SELECT event_id, fr, m, list_transform(list_filter(fr, lambda i: i < m), lambda i: (i * 2 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) / 200.0) AS xs FROM h JOIN c USING (file))
        SELECT event_id, round(coalesce(list_sum(xs), 0), 6) AS x_sum, xs[-1] AS x_last, CASE WHEN fr[1] < m THEN 0.12::DOUBLE END AS radius, 0.25::DOUBLE AS gaze_x, 0.5::DOUBLE AS gaze_r FROM v""",
    "audit_kinds": B + """, z AS (SELECT ['now_state_only', 'now_action_mcq', 'now_full', 'now_full'][(k % 4 + 1)::INT] AS kind FROM s) SELECT kind, count(*) AS n FROM z GROUP BY 1""",
    "roi_violations": B + """, z AS (SELECT CASE k % 10 WHEN 0 THEN 'coord' WHEN 1 THEN 'box_size' WHEN 2 THEN 'box_range' WHEN 3 THEN 'gaze_range' END AS fault FROM s) SELECT fault, count(*) AS n FROM z WHERE fault IS NOT NULL GROUP BY 1""",
    "roi_paths": "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'b/' WHEN page_id % 2 = 1 THEN 'c/' ELSE 'a/' END || page_id || '.jsonl' AS resolved FROM pages",
    "token_evidence": B + """, z AS (SELECT model, ans, event_id % 5 AS way, form = 0 AND kk <> 8 AS has_tag, CASE WHEN form = 0 AND kk <> 8 THEN 'tag' ELSE 'clean' END AS text FROM x WHERE answered),
        m AS (SELECT *, CASE WHEN way = 2 THEN CASE WHEN ans = '' THEN 'token_multi' ELSE 'token_multi+' || text END WHEN ans = '' THEN 'none' WHEN way = 0 THEN 'token_ans_span' WHEN way = 1 THEN 'token_verbnoun_or'
          WHEN way = 3 THEN text ELSE 'token_prefix' END AS method, CASE WHEN ans = '' THEN NULL WHEN way = 0 THEN 0.9 WHEN way = 1 THEN 0.2 WHEN way = 4 THEN 0.1 END::DOUBLE AS conf FROM z)
        SELECT model, ans, method, count(*) AS n, round(avg(CASE WHEN way = 0 AND has_tag THEN 0.5::DOUBLE END), 6) AS state_prob, round(avg(conf), 6) AS conf FROM m GROUP BY 1, 2, 3""",
    "choice_distribution": B + """, m AS (SELECT event_id, [event_id % 7 + 1, event_id % 5 + 1, event_id % 3 + 1, k % 11 + 1]::DOUBLE[] AS m FROM s), p AS (SELECT *, list_sum(m) AS mass FROM m)
        SELECT event_id, mass, substr('ABCD', list_position(m, list_max(m))::INT, 1) AS best, round(list_sum(list_transform(m, lambda v: -(v / mass) * ln(v / mass + 1e-12))), 6) AS entropy, -mass AS logp, -mass / 4 AS mean_logp FROM p""",
    "tags": B + """ SELECT CASE WHEN form = 0 AND kk <> 8 THEN CASE state WHEN 'INTERACTION' THEN 'interaction' ELSE 'no interaction' END END AS state, least(event_id % 2 + 0.5, 1.0)::DOUBLE AS conf,
        CASE WHEN form = 0 AND kk <> 8 THEN ans END AS ans, form = 0 AND kk <> 8 AS block, count(*) AS n FROM x WHERE answered GROUP BY 1, 2, 3, 4""",
    "response_audit": B + """, z AS (SELECT model, CASE event_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'verb_noun_not_copied_from_parsed_options' WHEN 2 THEN 'desc_not_matching_option' WHEN 3 THEN 'state_not_in_enum'
        WHEN 4 THEN 'missing_subtags_now' ELSE CASE WHEN form = 0 THEN 'missing_subtags_now' ELSE 'missing_close_now' END END AS fault FROM x WHERE ans <> '')
        SELECT model, fault, fault <> 'none' AS changed, CASE WHEN fault = 'none' THEN '-' ELSE 'letter' END AS why, count(*) AS n FROM z GROUP BY 1, 2, 3, 4""",
    "coerced": B + """, z AS (SELECT ['<ANS>b</ANS> or so', 'they hold a steel bolt', 'a small ring, take it', 'put the cup, then hold the bolt', 'nothing to see', ''][(event_id % 6 + 1)::INT] AS said,
        CASE event_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN 'A' ELSE CASE WHEN k % 2 = 0 THEN 'D' ELSE 'A' END END AS pick,
        CASE WHEN event_id % 6 = 0 THEN 'letter' WHEN event_id % 6 <= 2 THEN 'words' WHEN k % 2 = 0 THEN 'none_option' ELSE 'first' END AS why FROM s)
        SELECT said, '<ANS>' || pick || '</ANS><VERB>' || CASE pick WHEN 'A' THEN 'take' WHEN 'B' THEN 'hold' ELSE 'none' END || '</VERB><NOUN>' || CASE pick WHEN 'A' THEN 'small ring' WHEN 'B' THEN 'bolt' ELSE 'none' END || '</NOUN>' AS line,
        why, CASE said WHEN '' THEN 'empty' ELSE 'missing_close_now' END AS fault, count(*) AS n FROM z GROUP BY 1, 2, 3, 4""",
    "truth_letters": B + """, z AS (SELECT event_id, CASE WHEN k % 7 <= 4 THEN truth ELSE '' END AS letter FROM s) SELECT letter, count(*) AS n, sum(event_id)::BIGINT AS ids FROM z GROUP BY 1""",
    "lead_steps": B + """, z AS (SELECT event_id, CASE WHEN k % 3 = 0 AND k % 5 < 3 THEN (k % 5)::INT WHEN k % 4 > 0 AND event_id % 3 < 2 THEN (k % 4 - 1)::INT END AS step FROM s)
        SELECT step, count(*) AS n, sum(event_id)::BIGINT AS ids FROM z GROUP BY 1""",
    "option_words": f"SELECT id AS term_id, 'take' AS verb, replace(base, '_', ' ') AS noun FROM ({_NAMES})",
    "stated_confidence_by_source": B + """, z AS (SELECT model, event_id % 3 / 2 AS c, ((ascii(ans) - 65 - event_id) % 4 + 4) % 4 IN (1, 2) AS strong FROM x WHERE ans <> ''),
        y2 AS (SELECT model, least(c, 1.0) AS c, strong FROM z) SELECT model, round(avg(c), 6) AS mapped, round(avg(c) FILTER (strong), 6) AS strong, round(avg(c) FILTER (NOT strong), 6) AS not_strong FROM y2 GROUP BY 1""",
    "sanitize_manifest": """SELECT 't' || page_id % 3 AS task, count(*) AS n, sum(1 + (page_id % 2 = 0)::INT + (page_id % 3 = 0)::INT + (page_id % 4 = 0)::INT)::BIGINT AS removed, 0::BIGINT AS suspicious, count(*) AS named,
        count(*) FILTER (page_id % 2 = 1) AS splits, count(*) FILTER (page_id % 3 > 0) AS notes, 0::BIGINT AS secrets, count(*) AS hints FROM pages GROUP BY 1""",
    "usable_manifest": "SELECT page_id, 'clips/v_' || page_id || '__' || printf('%.3f', page_id / 8) || '_' || printf('%.3f', page_id / 8 + 1) || '.mp4' AS clip FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0",
    "run_log": B + """ SELECT region AS task, 'cand' AS flavor, 'm' || event_id % 3 AS model, CASE WHEN k < 80 THEN 'processed' WHEN k < 95 THEN 'skipped' ELSE 'failed' END AS status, count(*) AS n, sum(k)::DOUBLE AS seconds, sum(k) / count(*) AS mean_seconds FROM s GROUP BY 1, 2, 3, 4""",
    "pending_work": B + " SELECT file, count(*) AS pending FROM s WHERE k % 10 = 9 GROUP BY 1",
    "index_by_triplet": """WITH p AS (SELECT 'v' || page_id % 50 AS video_uid, (page_id % 7)::VARCHAR AS clip_id, 'c' || page_id % 3 AS clip_uid, 'd' || page_id % 10 || '/out/model__v' || page_id % 50 || '__' || page_id % 7 || '__c' || page_id % 3 || '.json' AS path FROM pages)
        SELECT video_uid, clip_id, clip_uid, max(path) AS path FROM p GROUP BY 1, 2, 3""",
    "resolve_references": """SELECT page_id AS ref_id, CASE page_id % 4 WHEN 0 THEN 'new/' || page_id || '.json' WHEN 1 THEN 'alt/' || page_id || '.json' WHEN 2 THEN 'old/' || page_id || '.jsonl' END AS path,
        ['path', 'base_name', 'stem', 'unresolved'][(page_id % 4 + 1)::INT] AS strategy FROM pages""",
    "normalized_predictions": B + """, z AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'C' WHEN kk = 8 THEN 'A' ELSE ans END AS value FROM x WHERE answered)
        SELECT model, value, count(*) AS n, min('v' || file || '__idx' || pos) AS first_id FROM z GROUP BY 1, 2""",
}
