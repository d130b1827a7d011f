"""Prediction, question and log files as tables, and the lookups between them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions.parse import blank_to_null, found_letter, strip, tag_value
from vantage.operators import scan

#: File names that lie among predictions and are none.
NOT_PREDICTIONS = re.compile(r"(?i)manifest|summary|details|teacher_cache|metrics")
JSON_NAME = r"\.jsonl?$"

PREDICTION_SCHEMA = """source_queryset string, task string, video_uid string, model_name string, params string, video_metadata struct<queryset_path:string>,
samples array<struct<idx:variant, sample_id:variant, id:variant, video_uid:string, confidence:string, t_eval:double, prompt:string, response_text:string, clean_response:string, clean:string, raw_response:string, raw:string, parsed:map<string,string>, gen_tokens:array<string>, gen_token_probs:array<double>,
sent_logp:double, mean_logp:double, latency_sec:double, diagnostics:struct<prompt_and_encoding_debug:struct<cand_conf_final_letter:string, chosen_by_p_cond:string,
cand_conf_probe:struct<ok:boolean, p_raw:map<string,double>, p_cond:map<string,double>, chosen_by_p_cond:string>>>>>"""

SAMPLE_SCHEMA = """idx variant, sample_id variant, id variant, answer string, ans string, answer_idx int, visible_interaction string, gt_state string, t_eval double, region string, state string, step_idx int, lead_sec double, lag_sec double, is_rejected boolean, reject_reason string, is_invalid_annotation boolean,
gt_segment_start double, gt_segment_end double, anchor_idx string, state_switch_pair_type string, state_switch_role string, state_switch_pair_id string,
mcq struct<answer:string, ans:string, answer_idx:int, options:array<string>, option_sources:array<string>>"""


def prediction_texts(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(pred_file, value) of the prediction files below root, each read whole.  keep is a
    condition on the path; it and the rule on names are checked against the listing, so no
    other file is opened."""
    path = F.col("_metadata.file_path")
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    wanted = name.rlike(JSON_NAME) & ~name.rlike(NOT_PREDICTIONS.pattern)
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return texts.filter(wanted & keep(path) if keep else wanted).select(path.alias("pred_file"), "value")


def prediction_rows(texts: DataFrame, *more: str) -> DataFrame:
    """One row per sample of each text, with pos, key and the columns named by more."""
    kind = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in re.split(r', *(?=[a-z_]+ )', PREDICTION_SCHEMA.replace(chr(10), ' ')))}>"
    df = texts.withColumn("__o", F.from_json(F.regexp_replace("value", "^\ufeff", ""), kind))
    top = ["pred_file", *more, *[F.col(f"__o.{c}").alias(c) for c in ("source_queryset", "task", "model_name", "video_metadata")], F.col("__o.video_uid").alias("__video")]
    rows = df.select(*top, F.posexplode_outer("__o.samples").alias("pos", "s"))
    rows = rows.select(*[c for c in rows.columns if c not in ("pos", "s")], F.col("pos").cast("long").alias("pos"), "s.*")
    return rows.withColumn("video_uid", F.coalesce("video_uid", "__video")).drop("__video").withColumn("key", sample_key(F.col("idx"), F.col("pos"), F.col("sample_id"), F.col("id")))


def read_predictions(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per sample of every prediction file below root, with pred_file and pos."""
    return prediction_rows(prediction_texts(spark, root, keep))


#: The folders that each split stands for.
SPLITS = {"train": ["train"], "val": ["val"], "all": ["train", "val"]}


def split_folders(spark: SparkSession, root: str, split: str) -> dict[str, str]:
    """The folders below root that hold a split's files, by name; one that lacks is left out."""
    if split not in SPLITS:
        raise ValueError(f"no such split: {split}")
    out = {}
    for name in SPLITS[split]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{str(root).rstrip('/')}/{name}")
        if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            out[name] = folder.toString()
    return out


def question_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(path, split, length) of the question files of a split below root: only the split's
    folders are listed, and no file is opened."""
    out = [spark.createDataFrame([], "path string, split string, length long")]
    for name, folder in split_folders(spark, root, split).items():
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        out.append(found.filter(F.lower("path").rlike(JSON_NAME)).select("path", F.lit(name).alias("split"), "length"))
    return reduce(DataFrame.unionByName, out)


def read_split(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(samples, bad files) of a split's question files, with split; intervals that hold no
    sample give no row, and other splits' files are not opened."""
    read = {name: read_interval_json(spark, folder) for name, folder in split_folders(spark, root, split).items()} or {split: read_interval_json(spark, [])}
    parts = [[df.withColumn("split", F.lit(name)) for df in pair] for name, pair in read.items()]
    samples, bad = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    return samples, bad.filter(F.lower("file").rlike(JSON_NAME))


def read_interval_json(spark: SparkSession, root: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, bad files) of files that hold one object, also as a list of one or with a
    byte order mark.  A file with several records, or none, is bad.  root: folders, or
    single files."""
    if root:
        raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    else:
        raw = spark.createDataFrame([], "value string, file string")
    body = strip(F.regexp_replace("value", "^﻿", ""))
    # within brackets several records that follow one another are no JSON
    v = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    there = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    shape = F.schema_of_variant(v)
    one = F.when(shape.startswith("ARRAY<OBJECT") & ~there("$[1]"), body).when(shape.startswith("ARRAY<ARRAY<OBJECT") & ~there("$[1]") & ~there("$[0][1]"), F.try_variant_get(v, "$[0][0]", "string"))
    got = raw.select("file", one.alias("one"))
    parsed = F.from_json("one", f"task string, video_uid string, samples array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in SAMPLE_SCHEMA.replace(chr(10), ' ').split(', ') if x)}>>")
    fine = got.filter("one is not null").withColumn("o", parsed)
    rows = fine.select("file", "o.task", "o.video_uid", F.posexplode("o.samples").alias("pos", "s")).select("file", "task", "video_uid", F.col("pos").cast("long").alias("pos"), "s.*")
    return rows.withColumn("key", sample_key(F.col("idx"), F.col("pos"), F.col("sample_id"), F.col("id"))), got.filter("one is null").select("file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of all lines below path, from 1 in each file.

    Large files are read in splits by different tasks: lines are numbered within a split
    and moved on by the lines of the splits before it, whose counts are one row for each.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = scan.prefix_sums(splits, "n", "start", ("file",), "__before").drop("n")
    return lines.join(before, ["file", "start"]).select("file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Lines of JSON with file and line_no; blank lines are left out.  A line that is no
    JSON object of the schema ends the read with an error that names file and line; if not
    strict, it is kept whole in _corrupt_record."""
    lines = numbered_lines(spark, path).filter(strip("value") != "")
    parsed = lines.withColumn("__o", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = parsed.select("file", "line_no", "__o.*")
    if not strict:
        return rows
    where = F.concat(F.lit("bad JSON in "), F.col("file"), F.lit(", line "), F.col("line_no"))
    return rows.withColumn("line_no", F.when(F.col("_corrupt_record").isNull(), F.col("line_no")).otherwise(F.raise_error(where).cast("long"))).drop("_corrupt_record")


ROI_SCHEMA = "frame_idx int, coord string, hand_boxes array<array<double>>, left_box array<double>, right_box array<double>, gaze struct<x:double,y:double,r:double,conf:double>"


def read_roi(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, frame columns, boxes) of region files: JSON lines, or one JSON object
    that is {"frames": [...]} or maps frame numbers to rows."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), strip("value").alias("body"))
    struct = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in re.split(r', (?=[a-z_]+ )', ROI_SCHEMA))}>"
    v = F.try_parse_json("body")
    lined = raw.filter(F.contains("file", F.lit(".jsonl")))
    a = lined.select("file", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line")).filter(strip("line") != "").select("file", "line_no", F.from_json("line", struct).alias("r"))
    whole = raw.filter(~F.contains("file", F.lit(".jsonl"))).withColumn("listed", F.try_variant_get(v, "$.frames", f"array<{struct}>"))
    b = whole.filter("listed is not null").select("file", F.posexplode("listed").alias("line_no", "r"))
    mapped = whole.filter("listed is null").select("file", F.explode(F.from_json("body", f"map<string,{struct}>")).alias("k", "r"))
    c = mapped.select("file", F.col("k").try_cast("int").alias("line_no"), F.struct(F.coalesce("r.frame_idx", F.col("k").try_cast("int")).alias("frame_idx"), *[f"r.{n}" for n in ("coord", "hand_boxes", "left_box", "right_box", "gaze")]).alias("r"))
    rows = a.unionByName(b).unionByName(c).select("file", "line_no", "r.*")
    sides = F.array_compact(F.array("left_box", "right_box"))
    return rows.withColumn("boxes", F.concat(F.coalesce("hand_boxes", F.array().cast("array<array<double>>")), sides))


def reference_candidates(text: Column) -> Column:
    """Strings by which a prediction file (JSON text) may name its question set, in order:
    source_queryset, video_metadata.queryset_path, then any nested string whose key or
    value holds ``queryset`` or whose value holds ``derived_``."""

    def walk(value, key: str = ""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, str(k))
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, key)
        elif isinstance(value, str) and ("queryset" in key.lower() or "queryset" in value.lower() or "derived_" in value):
            yield value

    def find(one) -> list[str]:
        try:
            obj = json.loads(one)
        except (TypeError, ValueError):
            return []
        meta = obj.get("video_metadata") if isinstance(obj, dict) else None
        first = [obj.get("source_queryset"), meta.get("queryset_path") if isinstance(meta, dict) else None] if isinstance(obj, dict) else []
        return list(dict.fromkeys([x for x in first if isinstance(x, str) and x] + list(walk(obj))))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(text)


def sample_key(idx: Column, pos: Column, *others: Column) -> Column:
    """Key of a sample from its idx, a variant: i:n for whole numbers, s:text for text, so
    that 0 and "0" differ; without an idx from the first of the others that is neither
    blank nor 0, else the position."""

    def keyed(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        return F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit("s:"), text)).otherwise(F.concat(F.lit("i:"), F.regexp_replace(text, r"\.0+$", "")))

    own = lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), keyed(v))
    more = [F.nullif(F.nullif(own(v), F.lit("s:")), F.lit("i:0")) for v in others]
    return F.coalesce(own(idx), *more, F.concat(F.lit("i:"), pos.cast("string")))


def run_log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("task", "flavor", "model", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_sec").alias("seconds"), F.avg("elapsed_sec").alias("mean_seconds"))


def pending_work(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no output yet."""
    return wanted.join(done, keys, "left_anti")


def index_by_triplet(files: DataFrame, path: str, content: tuple[str, str, str] | None = None) -> DataFrame:
    """(video_uid, clip_id, clip_uid) -> path from content columns, else from the name, cut
    at double underscores, of which the last three count; the later path wins."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl?$", "")
    parts = F.split(stem, "__")
    named = [F.try_element_at(parts, F.lit(-i)) for i in (3, 2, 1)]
    cols = [F.coalesce(blank_to_null(F.col(c)), n) for c, n in zip(content, named, strict=True)] if content else named
    keys = ["video_uid", "clip_id", "clip_uid"]
    wide = files.select(F.col(path).alias("path"), *[c.alias(k) for c, k in zip(cols, keys, strict=True)])
    return wide.groupBy(*keys).agg(F.max("path").alias("path"))


def resolve_references(refs: DataFrame, listing: DataFrame, roots: list[str], maps: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """Files that references (ref_id, candidates) mean: a candidate's own path after the
    first matching path map, else a file of its name under the roots in order, else one of
    its stem with .json or .jsonl.  First hit by candidate, way, root and path.  Returns
    (ref_id, path, strategy) and the unresolved references."""
    c = refs.select("ref_id", F.posexplode("candidates").alias("crank", "candidate"))
    mapped = reduce(lambda acc, m: F.when(F.col("candidate").startswith(m[0]), F.concat(F.lit(m[1]), F.substr("candidate", F.lit(len(m[0]) + 1)))).otherwise(acc), reversed(list(maps)), F.col("candidate"))
    c = c.withColumn("full", mapped)
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    stem = lambda p: F.regexp_replace(name(p), r"\.jsonl?$", "")
    root = reduce(lambda acc, r: F.when(F.col("path").startswith(r[1]), r[0]).otherwise(acc), reversed(list(enumerate(roots))), F.lit(len(roots)))
    files = listing.select("path", root.alias("root")).withColumns({"name": name("path"), "stem": stem("path")})
    ways = [
        c.join(files, c["full"] == files["path"]).withColumn("way", F.lit(0)),
        c.withColumn("cn", name("full")).join(files.filter(F.col("root") < len(roots)), F.col("cn") == F.col("name")).drop("cn").withColumn("way", F.lit(1)),
        c.withColumn("cs", stem("full")).join(files.filter(F.col("root") < len(roots)).withColumnRenamed("stem", "fs"), F.col("cs") == F.col("fs")).withColumnRenamed("fs", "stem").drop("cs").withColumn("way", F.lit(2)),
    ]
    hits = reduce(DataFrame.unionByName, ways)
    best = hits.groupBy("ref_id").agg(F.min(F.struct("crank", "way", "root", "path")).alias("b"))
    label = F.element_at(F.array(F.lit("path"), F.lit("base_name"), F.lit("stem")), F.col("b.way") + 1)
    got = best.select("ref_id", F.col("b.path").alias("path"), label.alias("strategy"))
    return got, refs.join(got, "ref_id", "left_anti")


def normalized(preds: DataFrame, **constants: str) -> DataFrame:
    """Per-sample rows of twelve columns: sample_id (its own sample_id or id, else video
    and index), video_uid, task, task_type, model, prediction, prediction_text (the parsed
    answer, names in any case, else the letter of the text by tag, ``ANS:``, alone or the
    first that stands as a word, else the text), raw_response, parsed, confidence (its own,
    else the parsed one), source_file and metadata (JSON).  constants fill columns such as
    task, task_type, model and flavor.  Columns that preds lacks count as null."""
    has = lambda c, kind="string": F.col(c) if c in preds.columns else F.lit(None).cast(kind)
    parsed = F.coalesce(has("parsed", "map<string,string>"), F.create_map().cast("map<string,string>"))
    field = lambda *names: F.try_element_at(F.map_values(F.map_filter(parsed, lambda k, v: F.lower(k).isin(*names))), F.lit(1))
    t = F.coalesce(has("response_text"), F.lit(""))
    first = F.regexp_extract(F.upper(F.regexp_replace(t, "<[^>]*>", " ")), r"\b([A-D])\b", 1)
    text = F.coalesce(found_letter(tag_value(t, "ANS")), blank_to_null(F.upper(F.regexp_extract(t, r"(?i)\bANS\s*:\s*([A-D])\b", 1))), blank_to_null(first))
    value = F.coalesce(found_letter(field("ans", "answer")), text, t)
    plain = lambda c: blank_to_null(F.try_variant_get(F.col(c), "$", "string")) if c in preds.columns else F.lit(None).cast("string")
    video = F.coalesce(has("video_uid"), F.lit(""))
    index = F.coalesce(plain("idx").try_cast("double").cast("long"), F.col("pos"))
    one = lambda c: F.lit(constants[c]) if c in constants else has(c)
    meta = F.to_json(F.struct(one("flavor").alias("flavor"), has("source_queryset").alias("source_queryset"), has("t_eval", "double").alias("t_eval"), has("latency_sec", "double").alias("latency_sec")))
    return preds.select(
        F.coalesce(plain("sample_id"), plain("id"), F.concat(video, F.lit("__idx"), index)).alias("sample_id"), video.alias("video_uid"), one("task").alias("task"), F.coalesce(one("task_type"), F.lit("mcq")).alias("task_type"),
        F.coalesce(one("model"), has("model_name")).alias("model"), value.alias("prediction"), value.alias("prediction_text"), F.coalesce(has("raw_response"), has("raw"), has("response_text")).alias("raw_response"),
        parsed.alias("parsed"), F.coalesce(has("confidence"), field("conf", "confidence")).alias("confidence"), has("pred_file").alias("source_file"), meta.alias("metadata"),
    )
