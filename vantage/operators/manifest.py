"""Training manifests: private paths out, usable rows, asset paths."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.parse import strip

#: Fixed values of the manifest format.
PRIVATE = ("/home/", "/data/")
DROPPED_KEYS = (
    "interval_clip_path", "roi_cache_path", "full_interval_file", "mcp_path", "mcp_file", "source_gt", "source_gt_path", "source_effective_queryset", "matched_full_interval",
)
METADATA_KEYS = ("interval_start_sec", "interval_end_sec", "duration_sec", "split", "clip_uid", "clip_id", "interval_len_sec", "fps", "width", "height")
TOP_KEYS = ("dataset", "video_uid", "task", "target_text")
ROI_HINT = "{roi_cache_root}/{video_uid}__{clip_id}__{clip_uid}.roi_cache_merged_fps1.jsonl"


def private(value) -> bool:
    return isinstance(value, str) and any(p in value for p in PRIVATE)


def scrub(value):
    """(value without dropped keys and private strings, how many were removed)."""
    if isinstance(value, dict):
        got = {k: (None, 1) if k.lower() in DROPPED_KEYS or private(v) else scrub(v) for k, v in value.items()}
        return {k: v for k, (v, _) in got.items() if k.lower() not in DROPPED_KEYS and not private(value[k])}, sum(n for _, n in got.values())
    if isinstance(value, list):
        got = [(None, 1) if private(v) else scrub(v) for v in value]
        return [v for (v, _), old in zip(got, value, strict=True) if not private(old)], sum(n for _, n in got)
    return value, 0


def record(rec: dict, task: str, requires_roi: bool) -> tuple[dict, int]:
    """The published form of one manifest row, and how many private fields it lost."""
    meta = rec.get("video_metadata")
    part = {k: rec[k] for k in TOP_KEYS if k in rec}
    part["video_metadata"] = {k: meta[k] for k in METADATA_KEYS if k in meta} if isinstance(meta, dict) else {}
    part |= {k: rec.get(k, {}) for k in ("params", "sample")}
    out, removed = scrub(part)
    for k in ("params", "sample"):
        if not isinstance(out.get(k), dict):
            out[k] = {}
    assets = {"video_source": "ego4d", "requires_ego4d_video": True, "requires_roi_cache": requires_roi}
    if requires_roi:
        assets["roi_cache_layout_hint"] = ROI_HINT
    return out | {"sft_task": task, "assets": assets}, removed


def private_paths(value, path: str = "$") -> list[str]:
    """JSON paths of strings that hold private paths."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in private_paths(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in private_paths(v, f"{path}[{i}]")]
    return [path] if private(value) else []


def sanitize(rows: DataFrame, payload: str = "payload", task: str | None = None, requires_roi: bool = False) -> DataFrame:
    """Add clean (JSON), removed (private fields gone), left (JSON paths that are still
    private; empty unless scrubbing missed some) and fault (why a payload is no manifest
    row, as it is no JSON, no object, or nested beyond what Python's parser follows, about a
    thousand levels; it then has no clean form).  With a task column the payload is a manifest row and
    becomes its published form; else any JSON is scrubbed.  Row by row, in Arrow batches."""

    def one(text, name) -> tuple:
        try:
            value = json.loads(text) if text else {}
            if task and not isinstance(value, dict):
                return None, 0, [], "not an object"
            value, n = record(value, name, requires_roi) if task else scrub(value)
            return json.dumps(value, sort_keys=True, ensure_ascii=False), n, private_paths(value), None
        except ValueError:
            return None, 0, [], "not JSON"
        except RecursionError:
            return None, 0, [], "nested too deep"

    def run(batches):
        for pdf in batches:
            names = pdf[task] if task else [None] * len(pdf)
            out = [one(text, name) for text, name in zip(pdf[payload], names, strict=True)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["clean", "removed", "left", "fault"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, clean string, removed long, left array<string>, fault string")


def suspicious(sanitized: DataFrame, task: str, rows: int = 10, paths: int = 10) -> tuple[DataFrame, DataFrame]:
    """First rows that still hold private paths, with their first paths; counts by task."""
    bad = sanitized.filter(F.size("left") > 0)
    return bad.withColumn("left", F.slice("left", 1, paths)).limit(rows), sanitized.groupBy(task).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("left") > 0).alias("suspicious"))


def require_clean(sanitized: DataFrame, task: str) -> DataFrame:
    """The sanitized rows; an error with the first examples if private paths are left or
    payloads are no manifest rows."""
    first, _ = suspicious(sanitized, task)
    found = [f"{r[task]}: {', '.join(r.left)}" for r in first.collect()]  # at most ten
    found += [f"{r[task]}: {r.fault}" for r in sanitized.filter("fault is not null").limit(10).collect()]
    if found:
        raise ValueError("private paths or broken rows remain: " + "; ".join(found))
    return sanitized


def require_usable(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """All rows; an error if there are none or one lacks sample (an object) or target_text."""
    v = F.try_parse_json(payload)
    has = F.try_variant_get(v, "$.target_text", "variant").isNotNull() & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.sample", "variant")).startswith("OBJECT"), F.lit(False))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(has, F.lit(False))).alias("bad")).first()
    if n.bad or not n.n:
        raise ValueError(f"{n.bad} of {n.n} manifest rows lack sample or target_text" if n.n else "the manifest would be empty")
    return rows


def usable(rows: DataFrame, target: str = "target_text", prompt: str = "prompt") -> DataFrame:
    """Rows with a non-empty target and a prompt that is not blank."""
    return rows.filter((F.coalesce(target, F.lit("")) != "") & (strip(F.coalesce(prompt, F.lit(""))) != ""))


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "_")


def clip_path(root: str, video: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), safe_stem(video), F.lit("__"), F.format_string("%.3f", start), F.lit("_"), F.format_string("%.3f", end), F.lit(".mp4"))
