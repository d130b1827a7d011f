import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vantage.functions import parse
from vantage.operators import lookups, manifest, queryset, roi, score, switch, taxonomy
from vantage.sources import files, sinks


def sequential(rows, k=2, n=3):
    """Plain thinning: rows (file, rank, t) in order; a time is used only if kept."""
    phase, kept, used, last = 0, [], set(), None
    for f, r, t in sorted(rows):
        if f != last:
            used, last = set(), f
        if t in used:
            continue
        if phase % n < k:
            used.add(t)
            kept.append((f, r))
        phase = (phase + 1) % n
    return kept


def test_thinning_equals_a_sequential_scan(spark):
    rng = random.Random(5)
    rows = [(f, r, float(rng.randrange(4))) for f in range(30) for r in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "file long, rank long, t_eval double")
    got = sorted((r.file, r.rank) for r in queryset.thin_exact(df).collect())
    assert got == sequential(rows)


def test_keep_k_of_n_is_the_same_without_repeats(spark):
    rows = [(f, r, float(r)) for f in range(7) for r in range(f + 1)]
    df = spark.createDataFrame(rows, "file long, rank long, t_eval double")
    assert sorted((r.file, r.rank) for r in queryset.keep_k_of_n(df).collect()) == sequential(rows)


def test_no_window_looks_ahead(spark):
    df = spark.range(200).select((F.col("id") % 37).cast("double").alias("t"), (F.col("id") % 11 - 5).cast("double").alias("d"))
    w = df.select("t", queryset.online_window(F.col("t"), F.col("t") + F.col("d"), F.col("t") + F.col("d") * 2, F.lit(4.0)).alias("w")).select("t", "w.*")
    assert queryset.lookahead_violations(w, "end", "t").count() == 0
    assert w.filter("start < 0 or start > end").count() == 0


def test_half_even_buckets_and_positions(spark):
    df = spark.createDataFrame([("f", 4.0), ("f", 12.0), ("f", 20.0)], "file string, t double")
    assert [r.bucket for r in switch.with_bucket(df, 0).collect()] == [0, 2, 2]
    p = spark.createDataFrame([("r:0.25",), ("2s",), ("0.3r",), ("0.5",), ("3",), ("x",)], "x string").select(switch.parse_position("x").alias("p")).select("p.*").collect()
    assert [(r["mode"], r["value"]) for r in p] == [("ratio", 0.25), ("time", 2.0), ("ratio", 0.3), ("ratio", 0.5), ("time", 3.0), (None, None)]


def test_keyframes(spark):
    got = spark.range(1).select(queryset.keyframes(F.lit(0.0), F.lit(9.0)).alias("k")).first().k
    assert got == [0.0, 4.0, 8.0]


def test_nearest_time(spark):
    t = spark.createDataFrame([("f", "i:0", 0, 1.0, "A"), ("f", "i:1", 1, 3.0, "B"), ("f", "i:2", 2, 3.0, "C")], "file string, key string, pos long, t double, truth string")
    p = spark.createDataFrame([("f", "i:0", 9.0, 1), ("f", "x", 3.0, 2), ("f", "x", 2.0, 3), ("f", "y", 2.4, 4), ("f", "z", 7.0, 5)], "file string, key string, t double, id long")
    got = {r.id: (r.how, r.truth) for r in lookups.match_by_key_then_time(p, t, 1.0).collect()}
    assert got == {1: ("key", "A"), 2: ("time", "C"), 3: ("time", "A"), 4: ("time", "C"), 5: ("none", None)}


def vocabulary(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def narration(text, verb, groups, nouns, verbs):
    """Plain reading of the narration rules for one text."""
    import re

    w = re.findall("[a-z0-9]+", text.lower())
    w = w[2:] if w[:2] == ["c", "c"] else w
    stem = lambda t: next((s for s in [t, *[t[: -len(e)] for e, m in (("ing", 5), ("ed", 3), ("es", 3), ("s", 2)) if t.endswith(e) and len(t) > m]] if s in verbs), t)
    cut = lambda t: t[:-1] if t not in nouns and t.endswith("s") and len(t) > 3 and t[:-1] in nouns else t
    v = verb.split("(")[0].strip("_").split("_")
    at = next((i for i in range(len(w) - len(v) + 1) if [stem(x) for x in w[i : i + len(v)]] == v), None)
    n = [cut(x) for x in w]
    occ = [(i, k, groups["_".join(n[i : i + k])]) for i in range(len(n)) for k in range(1, 5) if i + k <= len(n) and "_".join(n[i : i + k]) in groups]
    if at is not None:
        occ = [o for o in occ if o[0] >= at + len(v) or o[0] + o[1] <= at]
        after = [o for o in occ if o[0] >= at + len(v)]
        occ = sorted(after, key=lambda o: (o[0] - at - len(v), -o[1], o[0])) or sorted(occ, key=lambda o: (abs(o[0] - at), -o[1], o[0]))
    else:
        occ = sorted(occ, key=lambda o: (-o[1], o[0]))
    if occ:
        return str(occ[0][2])
    if at is None:
        return "none"
    rest = w[at + len(v) :]
    while rest and rest[0] in taxonomy.DETERMINERS:
        rest = rest[1:]
    end = next((i for i, x in enumerate(rest) if x in taxonomy.PREPOSITIONS), len(rest))
    return "_".join(rest[:end]) or "none"


def test_narration_nouns_equal_a_plain_reading(spark):
    rng = random.Random(2)
    words = "c the a small ring rings bolt takes holding wash washed cup cups from with box red of thing".split()
    groups = {"ring": 0, "small_ring": 1, "cup": 2, "red_box": 3}
    nouns, verbs = ["ring", "small", "cup", "red", "box"], ["take", "hold", "wash"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 8))), rng.choice(["take", "hold_(grip,_have)", "wash", "put_down"])) for i in range(300)]
    table = spark.createDataFrame([(k, v) for k, v in groups.items()], "variant string, term_id long")
    got = taxonomy.narration_nouns(spark.createDataFrame(rows, "narr_id long, text string, verb string"), table, vocabulary(spark, nouns), vocabulary(spark, verbs))
    got = {r.narr_id: str(r.term_id) if r.term_id is not None else r.phrase for r in got.collect()}
    assert got == {i: narration(t, v, groups, nouns, verbs) for i, t, v in rows}


def test_forms_that_several_words_could_own(spark):
    """Each of all short words, stemmed by the column rule and by the table of forms."""
    from itertools import product

    verbs = ["as", "ass", "pass", "passe", "us", "use", "see", "seed", "sing", "ring", "s"]
    made = sorted({v + e for v in verbs for e in ("", "s", "es", "ed", "ing", "d", "ses")} | {"".join(x) for x in product("aesd", repeat=4)})
    known = taxonomy.forms(vocabulary(spark, verbs), taxonomy.VERB_ENDS)
    lit = F.array(*[F.lit(v) for v in verbs])
    got = vocabulary(spark, made).select("word", taxonomy.stem_verb(F.col("word"), lit).alias("stem"), taxonomy.singular(F.col("word"), lit).alias("one"))
    got = got.join(known.select(F.col("form").alias("word"), F.col("word").alias("owner")), "word", "left")
    got = got.join(taxonomy.forms(vocabulary(spark, verbs), taxonomy.NOUN_ENDS).select(F.col("form").alias("word"), F.col("word").alias("single")), "word", "left").collect()
    assert len(got) == len(made) and all((r.owner or r.word) == r.stem and (r.single or r.word) == r.one for r in got)


def test_narrations_with_nulls_and_no_words(spark):
    rows = [(1, None, "take"), (2, "ring", None), (3, "", "take"), (4, "take", "take"), (5, "take", "")]
    table = spark.createDataFrame([("ring", 7)], "variant string, term_id long")
    for given in (rows, []):
        got = taxonomy.narration_nouns(spark.createDataFrame(given, "narr_id long, text string, verb string"), table, vocabulary(spark, ["ring"]), vocabulary(spark, ["take"])).collect()
        assert {r.narr_id: (r.how, r.term_id, r.phrase) for r in got} == {i: ("taxonomy_match", 7, None) if i == 2 else ("none", None, "none") for i, _, _ in given}


def test_narrations_are_read_whole(spark):
    text = "c c " + "thing " * 10_500 + "ring"
    table = spark.createDataFrame([("ring", 7)], "variant string, term_id long")
    rows = [(1, text, "put"), (2, "take " + "the " * 10_500 + "lid", "take")]
    got = taxonomy.narration_nouns(spark.createDataFrame(rows, "narr_id long, text string, verb string"), table, vocabulary(spark, ["ring"]), vocabulary(spark, ["take", "put"])).collect()
    assert {r.narr_id: (r.how, r.term_id, r.phrase) for r in got} == {1: ("taxonomy_match", 7, None), 2: ("heuristic_after_verb", None, "lid")}


def test_narrations_meet_all_terms(spark, tmp_path):
    from vantage.plans import building

    parts = [(i, f"name{i} thing{i}", 4, "X") for i in (1, 39, 40, 41, 90)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.narr_id: r.noun for r in building.narration_nouns(spark, str(tmp_path)).collect()}
    assert got[40] == "40" and got[90] == "90"


@pytest.mark.parametrize("most", [100_000, 0])
def test_narrations_never_pass_through_the_driver(spark, tmp_path, monkeypatch, most):
    """Only a side that is counted to be small is broadcast, with the same result as without."""
    from vantage.plans import building

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(taxonomy, "SMALL_ROWS", most)
    df = building.narration_nouns(spark, d)
    sides = re.findall(r"\w+Join \[(\w+)#[^\]]*\], \[[^\]]*\], \w+, (Build\w+)", df._jdf.queryExecution().executedPlan().toString())
    assert sides == ([("verb", "BuildRight"), ("said", "BuildRight"), ("verb", "BuildRight")] if most else [])
    told, verbs = building.narrations(spark, d).collect(), {"take", "hold", "wash", "put", "support", "grip"}
    groups = {r.variant: r.term_id for r in building.taxonomy_variants(spark, d).collect()}
    nouns = {w for v in groups for w in v.split("_")}
    assert {r.narr_id: r.noun for r in df.collect()} == {r.narr_id: narration(r.text, r.verb, groups, nouns, verbs) for r in told}


def test_taxonomy_variants(spark):
    df = spark.createDataFrame([("pepper_(vegetable)_(capsicum,_pepper)",), ("pen_(marker,_pen)",), ("",)], "t string")
    assert [r[0] for r in df.select(taxonomy.variants_of("t")).collect()] == [["pepper", "capsicum"], ["pen", "marker"], []]


def test_matches(spark):
    v = F.array(F.lit("hold"), F.lit("take"))
    row = spark.range(1).select(
        taxonomy.verb_match(F.lit("Holding"), F.array(F.lit("hold")), v).alias("a"), taxonomy.noun_match(F.lit("rings"), F.array(F.lit("ring")), F.array(F.lit("ring"))).alias("b"),
        taxonomy.noun_match(F.lit("No"), F.array(F.lit("none")), F.array(F.lit("x"))).alias("c"), taxonomy.noun_match(F.lit(None).cast("string"), F.array(F.lit("x")), F.array(F.lit("x"))).alias("d"),
    ).first()
    assert tuple(row) == (True, True, True, False)


def test_frames(spark):
    f = lambda a, b, n, m: spark.range(1).select(roi.frames_1fps(F.lit(float(a)), F.lit(float(b)), F.lit(n), m).alias("f")).first().f
    assert f(2, 5.9, 100, 8) == [2, 3, 4, 5] and f(0, 9, 100, 4) == [0, 2, 5, 7] and f(50, 60, 10, 4) == [9]


def test_region_rows_by_block(spark):
    r = random.Random(2)
    rows = [(v, f, line, "norm", [[f / 100, r.random(), 0.5, 0.5]], None if f % 7 == 0 else (0.1, f / 100, None)) for v in "ab" for line, f in enumerate(r.choices(range(30), k=45))]
    df = spark.createDataFrame(rows, "video string, frame_idx int, line_no int, coord string, boxes array<array<double>>, gaze struct<x:double,y:double,r:double>")
    picks = [(i, r.choice(["a", "b", "c", None]), sorted(r.sample(range(34), r.randint(0, 6)))) for i in range(40)]
    s = spark.createDataFrame(picks, "sample_id int, video string, frames array<int>")
    last = {(x[0], x[1]): x for x in rows}
    for gaze in (None, {"x": 0.2, "y": 0.3, "r": 7}):
        got = {x.sample_id: x.rois for x in roi.roi_join(s, df, ["video"], gaze=gaze, size=4).collect()}
        for i, v, frames in picks:
            want = []
            for at, f in enumerate(frames):
                x = last.get((v, f))
                circle = (0.2, 0.3, 0.5) if gaze else (x[5][0], x[5][1], 0.12) if x and x[5] else None
                want.append((at, f, "norm", x[4] if x else [], circle))
            assert [(y.at, y.frame_idx, y.coord, y.boxes, tuple(y.gaze) if y.gaze else None) for y in got[i] or []] == want


def joins(df):
    """Names of the joins that Spark planned."""
    return re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString())


def test_region_rows_never_pass_through_the_driver(spark):
    """However small Spark takes the tables for: their files say little of their size."""
    from vantage.plans import building

    kinds = joins(building.roi_frames(spark, "/root/testdata/sf0.001"))
    assert kinds and set(kinds) == {"SortMergeJoin"}


def test_region_boxes_never_pass_through_the_driver(spark):
    from vantage.plans import building

    kinds = joins(building.roi_boxes(spark, "/root/testdata/sf0.001"))
    assert kinds and set(kinds) == {"SortMergeJoin"}


def test_manifest_scrub(spark):
    payload = {"assets": {"interval_clip_path": "/home/x", "a": ["/data/y", "z"]}, "keep": 1}
    row = manifest.sanitize(spark.createDataFrame([("t", json.dumps(payload))], "task string, payload string")).first()
    assert json.loads(row.clean) == {"assets": {"a": ["z"]}, "keep": 1} and (row.removed, row.left) == (2, [])
    assert manifest.private_paths(payload) == ["$.assets.interval_clip_path", "$.assets.a[0]"]


def test_files(spark, tmp_path):
    d = tmp_path / "pred"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"source_queryset": "q", "samples": [{"idx": 0, "response_text": "A"}, {"idx": "0", "response_text": "B"}]}))
    (d / "summary.json").write_text("{}")
    rows = files.read_predictions(spark, str(d)).collect()
    assert [(r.pos, r.key, r.response_text) for r in rows] == [(0, "i:0", "A"), (1, "s:0", "B")]
    q = tmp_path / "q"
    q.mkdir()
    (q / "one.jsonl").write_text("﻿" + json.dumps({"task": "t", "samples": [{"idx": 3, "region": "gap"}]}, indent=1))
    (q / "two.jsonl").write_text('{"a": 1}\n{"a": 2}')
    good, bad = files.read_interval_json(spark, str(q))
    assert [(r.key, r.region) for r in good.collect()] == [("i:3", "gap")] and bad.count() == 1


def test_roi_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"frame_idx": 4, "coord": "norm", "left_box": [0, 0, 1, 1]}\n\n{"frame_idx": 5}\n')
    (tmp_path / "b.json").write_text('{"frames": [{"frame_idx": 7, "hand_boxes": [[0, 0, 0.5, 0.5]]}]}')
    (tmp_path / "c.json").write_text('{"3": {"coord": "norm", "gaze": {"x": 0.5, "y": 0.5}}}')
    got = {r.frame_idx: (len(r.boxes), r.gaze and r.gaze.x) for r in files.read_roi(spark, str(tmp_path)).collect()}
    assert got == {4: (1, None), 5: (0, None), 7: (1, None), 3: (0, 0.5)}


def test_reference_candidates(spark):
    text = json.dumps({"params": {"x": ["a/derived_1.json"], "my_queryset": "q.json"}, "video_metadata": {"queryset_path": "v.json"}, "source_queryset": "s.json", "other": "no"})
    df = spark.createDataFrame([(text,), ("bad",), (None,)], "t string")
    assert [r.c for r in df.select(files.reference_candidates(F.col("t")).alias("c")).collect()] == [["s.json", "v.json", "a/derived_1.json", "q.json"], [], []]


def files_read(df):
    """How many files the scans of a query opened."""
    df.collect()

    def leaves(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return leaves(plan.plan())
        below = [x for i in range(plan.children().size()) for x in leaves(plan.children().apply(i))]
        return below or [plan]

    found = [x.metrics().get("numFiles") for x in leaves(df._jdf.queryExecution().executedPlan())]
    return sum(m.get().value() for m in found if m.isDefined())


def test_splits(spark, tmp_path):
    for name, samples in (("train/a/x.json", [{"idx": 0}]), ("val/y.json", [{"idx": 1}, {"idx": 2}]), ("val/empty.jsonl", []), ("val/notes.txt", []), ("test/z.json", [{"idx": 3}])):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"task": "t", "samples": samples}))
    listed = lambda split: sorted((r.split, r.path.rsplit("/", 1)[1]) for r in files.question_files(spark, str(tmp_path), split).collect())
    assert listed("val") == [("val", "empty.jsonl"), ("val", "y.json")] and listed("all") == [("train", "x.json"), *listed("val")]
    keys = lambda split: sorted((r.split, r.key) for r in files.read_split(spark, str(tmp_path), split)[0].collect())
    assert keys("train") == [("train", "i:0")] and keys("all") == [("train", "i:0"), ("val", "i:1"), ("val", "i:2")]
    assert files_read(files.read_split(spark, str(tmp_path), "train")[0]) == 1
    assert files.read_split(spark, str(tmp_path / "train"), "val")[0].collect() == []
    with pytest.raises(ValueError):
        files.read_split(spark, str(tmp_path), "test")


def test_json_lines_are_numbered_across_splits(spark, tmp_path):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = [json.dumps({"a": i, "b": "x" * (i % 40)}) if i % 9 else "  " for i in range(200)]
        (tmp_path / "in").mkdir()
        (tmp_path / "in/one.jsonl").write_text("\n".join(lines))
        (tmp_path / "in/two.jsonl").write_text('{"a": 7}\n')
        assert files.numbered_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 10
        got = files.read_jsonl(spark, str(tmp_path / "in"), "a long, b string").collect()
        assert sorted((r.line_no, r.a) for r in got if r.file.endswith("one.jsonl")) == [(i + 1, i) for i in range(200) if i % 9]
        assert [(r.line_no, r.a, r.b) for r in got if r.file.endswith("two.jsonl")] == [(1, 7, None)]
        lines[150] = '{"a": 1'
        (tmp_path / "in/one.jsonl").write_text("\n".join(lines))
        loose = files.read_jsonl(spark, str(tmp_path / "in"), "a long, b string", strict=False)
        assert [(r.line_no, r._corrupt_record) for r in loose.filter("_corrupt_record is not null").collect()] == [(151, '{"a": 1')]
        with pytest.raises(Exception, match="one.jsonl, line 151"):
            files.read_jsonl(spark, str(tmp_path / "in"), "a long, b string").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", (1.5, [1, 2]), None)], "name string, m struct<x:double,y:array<int>>, z double")
    flat = sinks.flatten(df)
    assert flat.columns == ["name", "m_x", "m_y", "z"] and flat.first().m_y == "1;2"
    assert [r.line for r in sinks.markdown(flat).collect()][2] == "| a\\|b | 1.500000 | 1;2 |  |"
    sinks.write_results(df, flat, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 1


def test_manifests_fail_on_what_is_left(spark):
    import pytest

    rows = spark.createDataFrame([("t", '{"sample": {"note": "fine"}, "target_text": "x"}'), ("t", "{broken"), ("t", "[1]")], "task string, payload string")
    got = [(r.fault, r.clean is None) for r in manifest.sanitize(rows, "payload", "task").collect()]
    assert got == [(None, False), ("not JSON", True), ("not an object", True)]
    fine = manifest.sanitize(rows.limit(1), "payload", "task")
    assert manifest.require_clean(fine, "task").count() == 1
    with pytest.raises(ValueError, match="not JSON"):
        manifest.require_clean(manifest.sanitize(rows, "payload", "task"), "task")
    left = fine.withColumn("left", F.array(F.lit("$.sample.note")))
    with pytest.raises(ValueError, match="sample.note"):
        manifest.require_clean(left, "task")
    assert manifest.require_usable(rows.limit(1)).count() == 1
    for bad in (rows, rows.limit(0)):
        with pytest.raises(ValueError):
            manifest.require_usable(bad)


def test_segment_keys_sort_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, None)], "a int, b string")
    one, two = queryset.segment_key("s", a=F.col("a"), b=F.col("b")), queryset.segment_key("s", b=F.col("b"), a=F.col("a"))
    got = df.select(one.alias("one"), two.alias("two")).collect()
    assert all(r.one == r.two for r in got) and got[0].one != got[1].one


def test_truth_letters_by_source(spark):
    rows = [("", "b", None, "A", None, None), (None, None, 2, "A", None, None), (None, None, 9, None, "d", 0), (None, None, None, None, None, 1), (None,) * 6]
    df = spark.createDataFrame(rows, "m string, ma string, mi int, s string, sa string, si int")
    assert [r.x for r in df.select(parse.truth_letter(("m", "ma", "mi"), ("s", "sa", "si")).alias("x")).collect()] == ["B", "C", "D", "B", ""]


def test_normalised_columns(spark):
    p = spark.createDataFrame([("v", 0, "B", {"Answer": "c", "CONF": "0.5"}, "f.json"), (None, 3, "ANS: D", None, "f.json")], "video_uid string, pos long, response_text string, parsed map<string,string>, pred_file string")
    rows = files.normalized(p, task="t", model="m").collect()
    assert len(rows[0]) == 12 and (rows[0].sample_id, rows[0].prediction, rows[0].confidence, rows[0].task) == ("v__idx0", "C", "0.5", "t") and rows[1].prediction == "D" and rows[1].source_file == "f.json"


PROBES = "model string, file string, place string, pair_id string, side string, pair_type string, pos long, true_state string, state string, conf double"


def test_switch_probes_with_missing_invalid_and_repeated_ones(spark):
    yes, no = "INTERACTION", "NO_INTERACTION"
    rows = [
        ("m", "f", "a", "p1", "before", "segment_to_gap", 0, yes, yes, 0.2), ("m", "f", "a", "p1", "after", None, 1, no, no, 0.4),
        ("m", "f", "a", "p2", "before", "segment_to_gap", 2, yes, no, 0.9), ("m", "f", "a", "p2", "after", " ", 3, no, no, 0.9),
        ("m", "f", "b", "p3", "before", "gap_to_segment", 4, no, "INVALID", 0.9), ("m", "f", "b", "p3", "after", None, 5, yes, None, None),
        ("m", "f", "b", "p4", "before", "gap_to_segment", 6, "UNKNOWN", yes, 0.9), ("m", "f", "a", "p1", "before", "x", 7, yes, yes, 0.6),
    ]
    p = spark.createDataFrame(rows, PROBES)
    got = {r.place: tuple(r[1:]) for r in score.switch_confusion(p, ["model"], "place").drop("model").select("place", "tp", "fp", "fn", "tn", "valid", "left_out", "accuracy").collect()}
    assert got == {"a": (2, 0, 1, 2, 5, 0, 0.8), "b": (0, 0, 0, 0, 0, 3, None), "all": (2, 0, 1, 2, 5, 3, 0.8)}
    pairs = score.switch_pairs(p, ["model"])
    ok = {(r.pair_type, r.side): (r.conf, r.conf_n) for r in score.switch_success_confidence(pairs, ["model"]).collect()}
    assert ok == {("segment_to_gap", "before"): (0.6, 1), ("segment_to_gap", "after"): (0.4, 1)}  # the later probe of a role counts
    assert score.switch_success_confidence(pairs.limit(0), ["model"]).count() == score.switch_confusion(p.filter("model is null"), ["model"], "place").count() == 0


def test_stated_confidence_and_regions(spark):
    rows = [("m", "gt", 0.5), ("m", "prev", 1.0), ("m", "future", None), ("m", None, 0.1), ("n", None, 0.3), (None, "absurd", 0.25)]
    df = spark.createDataFrame(rows, "model string, picked string, stated double")
    got = {r.model: tuple(r[1:]) for r in score.stated_confidence(df, ["model"]).collect()}
    assert got == {"m": (0.75, 1.0, 0.5), "n": (None, None, None), None: (0.25, None, 0.25)}
    r = spark.createDataFrame([(1, " Segment"), (2, "gap"), (3, None), (4, "segment")], "id long, region string")
    assert [x.id for x in queryset.in_region(r).orderBy("id").collect()] == [1, 4]
    assert [x.id for x in queryset.in_region(r, "gap").collect()] == [2]


def test_payloads_nested_very_deep_are_faults(spark):
    deep = lambda n: '{"sample":' + '{"a":[' * n + '"/home/x"' + "]}" * n + "}"
    rows = spark.createDataFrame([(1, deep(20), "t"), (2, deep(50_000), "t"), (3, "", "t"), (4, None, "t"), (5, "[]", "t")], "id int, payload string, task string")
    got = {r.id: r for r in manifest.sanitize(rows, "payload", "task").collect()}
    assert [got[i].fault for i in range(1, 6)] == [None, "nested too deep", None, None, "not an object"]
    assert got[1].removed == 1 and got[1].left == [] and got[2].clean is None
    assert manifest.sanitize(rows.limit(0), "payload", "task").count() == 0
