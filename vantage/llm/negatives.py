"""Hard negatives by exact integer products in a residue number system."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.common import small_batches, stage, tidy

#: Primes below 256, largest first; nine of them span more than 2^64.
PRIMES = [p for p in range(255, 190, -1) if all(p % q for q in range(2, 16))]
#: Residues are at most 125 away from 0, so a float32 sum of so many products stays below 2^24 and is exact.
SLICE = 1024
#: Rows that share a tile; a product of two tiles has 8 MB in float32.
ANCHOR_TILE, ROW_TILE = 1024, 2048
#: Scores lie between -2^62 and 2^62, so these are lower and higher than all.
NONE, LIMIT = -(1 << 62) - 1, float(1 << 62)
TILE = "tile string, dim int, n int, norm double, labels array<bigint>, ids binary, own binary, uids binary, asks binary, matrix binary, width int"


def residue_product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """a @ b.T of whole numbers, exact, for results within +-bound (below 2^62).

    Both matrices are taken modulo several primes to residues around 0 and multiplied in
    float32, in slices whose sums stay exact.  The results' residues are put together by
    Chinese remaindering in mixed radix with digits around 0: the sum of digits times
    products of primes is the signed result itself, so sums may wrap on their way.
    """
    out, span, digits = None, 1, []
    for k, p in enumerate(PRIMES):
        r = np.zeros((len(a), len(b)), np.int32)
        ap, bp = near(a, p).astype(np.float32), near(b, p).astype(np.float32)
        for s in range(0, a.shape[1], SLICE):
            r += (ap[:, s : s + SLICE] @ bp[:, s : s + SLICE].T).astype(np.int32) % p
        for q, d in zip(PRIMES[:k], digits, strict=True):  # (r - d) / q modulo p, digit by digit
            r = (r - d) % p * pow(q, -1, p) % p
        r %= p
        r -= np.where(r > p // 2, p, 0).astype(np.int32)
        digits.append(r)
        part = r.astype(np.int64) * np.int64(wrap(span))
        out = part if out is None else out + part
        span *= p
        if span > 2 * bound + 1:
            return out
    raise ValueError("results beyond 2^62")


def near(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, around 0."""
    r = x % p
    return r - p * (r > p // 2)


def wrap(x: int) -> int:
    """x in 64 bits, signed."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k places of highest score, the first of equal ones: indices and
    scores.  ids ascend, so equal scores come by id.  scores is changed."""
    rows = np.arange(len(scores))
    at, top = np.zeros((len(scores), k), np.int64), np.full((len(scores), k), NONE, np.int64)
    for i in range(min(k, scores.shape[1])):
        j = scores.argmax(1)
        at[:, i], top[:, i] = j, scores[rows, j]
        scores[rows, j] = NONE
    return ids[at] if len(ids) else at, top


def merged(ids_a: np.ndarray, top_a: np.ndarray, ids_b: np.ndarray, top_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better ones of two rankings, as long as they are."""
    ids, top = np.concatenate([ids_a, ids_b], -1), np.concatenate([top_a, top_b], -1)
    order = np.lexsort((ids, -top), axis=-1)[..., : ids_a.shape[-1]]
    return np.take_along_axis(ids, order, -1), np.take_along_axis(top, order, -1)


class Packer:
    """Gathers rows of one length each into tiles of at most size rows, sorted by id, as
    whole numbers in as few bytes as they need."""

    def __init__(self, size: int):
        from pyspark import TaskContext

        self.size, self.part, self.made, self.waiting = size, TaskContext.get().partitionId(), 0, {}

    def add(self, dim: int, ids, own, uids, asks, q) -> None:
        self.waiting.setdefault(dim, []).append((ids, own, uids, asks, q))

    def take(self, all_: bool = False):
        """Full tiles; all of them at the end, or where many lengths keep many rows waiting."""
        held = {d: sum(len(x[0]) for x in w) for d, w in self.waiting.items()}
        all_ = all_ or sum(held.values()) > 8 * self.size
        out = []
        for dim in [d for d, n in held.items() if all_ or n >= self.size]:
            columns = [np.concatenate(x) for x in zip(*self.waiting.pop(dim), strict=True)]
            start = 0
            while (left := len(columns[0]) - start) and (all_ or left >= self.size):
                tile = [c[start : start + self.size] for c in columns]
                start += len(tile[0])
                order = np.argsort(tile[0], kind="stable")
                ids, own, uids, asks, q = (c[order] for c in tile)
                most = np.abs(q).max(initial=0)
                width = next(w for w in (1, 2, 4) if most < 1 << (8 * w - 1))
                self.made += 1
                out.append({
                    "tile": f"{self.part}-{self.made}", "dim": dim, "n": len(ids), "norm": float((q * q).sum(1).max(initial=0)), "labels": np.unique(own).tolist(), "ids": ids.tobytes(),
                    "own": own.tobytes(), "uids": uids.tobytes(), "asks": asks.tobytes(), "matrix": q.astype(f"i{width}").tobytes(), "width": width,
                })
            if left:
                self.waiting[dim] = [tuple(c[start:] for c in columns)]
        if out:
            kinds = [("tile", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("norm", pa.float64()), ("labels", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("ids", "own", "uids", "asks", "matrix")], ("width", pa.int32())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


def tiles(rows: DataFrame, size: int = ROW_TILE) -> DataFrame:
    """rows (id, label, asks, v) in tiles, each partition for itself.  Rows with null or
    non-finite components, or longer than a 64-bit score allows, are left out."""

    @tidy
    def run(batches):
        packer, seen = Packer(size), 0
        for batch in batches:
            v, n = batch.column("v"), batch.num_rows
            ids, own, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "asks"))
            uids = (np.int64(packer.part) << 40) + seen + np.arange(n)
            seen += n
            offsets = v.offsets.to_numpy() if n else np.zeros(1, np.int32)
            lengths, flat = np.diff(offsets), v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(256 * flat[offsets[at][:, None] + np.arange(dim)]) if dim else np.zeros((len(at), 0))
                    good = np.isfinite(q).all(1) & ((q * q).sum(1) < LIMIT)
                if good.any():
                    at = at[good]
                    packer.add(dim, ids[at], own[at], uids[at], asks[at].astype(bool), q[good])
            yield from packer.take()
        yield from packer.take(True)

    return rows.mapInArrow(run, TILE)


def asking(rows: DataFrame, size: int = ANCHOR_TILE) -> DataFrame:
    """Tiles of the anchors among the rows of tiles."""

    @tidy
    def run(batches):
        packer = Packer(size)
        for batch in batches:
            for r in batch.to_pylist():
                some = np.frombuffer(r["asks"], bool)
                if some.any():
                    q = np.frombuffer(r["matrix"], f"i{r['width']}").reshape(r["n"], r["dim"])[some].astype(np.float64)
                    packer.add(r["dim"], *[np.frombuffer(r[c], np.int64)[some] for c in ("ids", "own", "uids")], some[some], q)
            yield from packer.take()
        yield from packer.take(True)

    return rows.mapInArrow(run, TILE)


def opened(r: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, row numbers and matrix of a tile."""
    ids, own, uids = (np.frombuffer(r[f"{side}_{c}"], np.int64) for c in ("ids", "own", "uids"))
    return ids, own, uids, np.frombuffer(r[f"{side}_matrix"], f"i{r[f'{side}_width']}").reshape(len(ids), r["dim"]).astype(np.float64)


def meet(pairs: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of tiles with their contents.  An anchor tile meets the rows of a band in one
    place, so it is sent once to each band, and bands keep its pairs apart."""
    own = ["n", "ids", "own", "uids", "matrix", "width"]
    r = pairs.join(rows.select(F.col("tile").alias("r_tile"), *[F.col(c).alias(f"r_{c}") for c in own]), "r_tile")
    more = [c for c in ("lo", "hi") if c in anchors.columns]
    a = pairs.select("a_tile", "band").distinct().join(anchors.select(F.col("tile").alias("a_tile"), *[F.col(c).alias(f"a_{c}") for c in [*own, *more]]), "a_tile")
    return r.join(a, ["a_tile", "band"]).drop("r_tile", "band")


def ranked_rows(met: DataFrame, k: int, windows: int, bound: float) -> DataFrame:
    """(a_tile, at, win, anchor, id, score): of each anchor (row at of its tile) the k best
    other rows of its label, or, with windows > 0, the k best rows of other labels in each
    of its score windows; the best of each task."""
    w = windows or 1

    @tidy
    def run(batches):
        state: dict[str, list] = {}

        def flush():
            for tile, (anchors, ids, top) in state.items():
                keep = top > NONE
                at, win, _ = np.nonzero(keep)
                yield pa.RecordBatch.from_pydict({"a_tile": pa.array([tile] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "win": pa.array(win, pa.int32()), "anchor": anchors[at], "id": ids[keep], "score": top[keep]})
            state.clear()

        for batch in batches:
            for r in batch.to_pylist():
                tile = r["a_tile"]
                a_ids, a_own, a_uid, a = opened(r, "a")
                b_ids, b_own, b_uid, b = opened(r, "r")
                if tile not in state and len(state) >= 32:
                    yield from flush()
                s = residue_product(a, b, bound)
                same = a_own[:, None] == b_own[None, :]
                ids, top = np.zeros((len(a), w, k), np.int64), np.full((len(a), w, k), NONE, np.int64)
                if windows:
                    s[same] = NONE
                    lo, hi = (np.frombuffer(r[c], np.int64).reshape(len(a), w) for c in ("a_lo", "a_hi"))
                    for i in range(w):
                        some = np.flatnonzero(lo[:, i] <= hi[:, i])
                        own = s[some]
                        own[(own < lo[some, i, None]) | (own > hi[some, i, None])] = NONE
                        ids[some, i], top[some, i] = best(own, b_ids, k)
                else:
                    s[~same] = NONE
                    _, i, j = np.intersect1d(a_uid, b_uid, return_indices=True)
                    s[i, j] = NONE  # an anchor is no partner of its own
                    ids[:, 0], top[:, 0] = best(s, b_ids, k)
                if tile in state:
                    ids, top = merged(*state[tile][1:], ids, top)
                state[tile] = [a_ids, ids, top]
        yield from flush()

    return met.mapInArrow(run, "a_tile string, at int, win int, anchor bigint, id bigint, score bigint")


def mine(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Hard negatives of every row for which asks holds (an anchor): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(256 x); a score is the inner product of these whole
    numbers.  Higher scores come first, equal ones by smaller id.  An anchor's positives
    are its first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels are returned whose scores lie between low and
    high hundredths of the positive's.  An anchor without positives gives no rows, and so
    does a positive without rows in its window (always so below 0).

    The method: rows are packed in tiles in order of label and the anchors in tiles of
    their own; a pair of tiles is multiplied at once in a residue number system.  The
    first pass multiplies pairs of tiles that share a label and finds the positives, the
    second all pairs and selects in each positive's window.  Every anchor meets every
    row, tile by tile, spread over bands of row tiles; a task keeps only the best.

    Rows with a null id, label or vector, a null or non-finite component, or a sum of
    squares of 2^62 or more (scores would not fit 64 bits) take no part.  Vectors of
    different lengths have no score.  Rows that repeat an id are rows of their own: each
    asks and is found for itself.  An empty table gives no rows; other columns are ignored.
    """
    small_batches(rows.sparkSession)
    known = rows.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector}`").alias("v"))
    known = known.filter("id is not null and label is not null and v is not null")
    parts = max(1, known.count() // (4 * ROW_TILE))
    every = stage(tiles(known.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")), "neg-rows")
    anchors = stage(asking(every), "neg-anchors")
    size = every.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).first()
    bands, bound = max(1, -(-size["n"] // 4)), (size["norm"] or 0.0) * (1 + 1e-9) + 1
    # names of tiles only: which anchor tiles meet which row tiles
    r = every.select(F.col("tile").alias("r_tile"), "dim", "labels", F.pmod(F.xxhash64("tile"), F.lit(bands)).cast("int").alias("band"))
    a = anchors.select(F.col("tile").alias("a_tile"), "dim", "labels", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    alike = r.withColumn("label", F.explode("labels")).drop("labels").join(a.withColumn("label", F.explode("labels")).drop("labels"), ["dim", "band", "label"])
    near_ = meet(alike.select("a_tile", "r_tile", "dim", "band").distinct(), anchors, every)
    own = ranked_rows(near_, positives, 0, bound)
    order = [F.col("score").desc(), F.col("id")]
    first = own.withColumn("win", (F.row_number().over(Window.partitionBy("a_tile", "at").orderBy(*order)) - 1).cast("int")).filter(F.col("win") < positives)
    first = stage(first, "neg-positives")

    low_, high_ = F.expr(f"ceil(cast(score as decimal(38)) * {low} / 100)"), F.expr(f"floor(cast(score as decimal(38)) * {high} / 100)")
    bounds = first.withColumns({"lo": low_.cast("long"), "hi": high_.cast("long")}).join(anchors.select(F.col("tile").alias("a_tile"), "n"), "a_tile")

    def blobs(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.ones((int(pdf["n"].iloc[0]), positives), np.int64), np.zeros((int(pdf["n"].iloc[0]), positives), np.int64)
        lo[pdf["at"], pdf["win"]], hi[pdf["at"], pdf["win"]] = pdf["lo"], pdf["hi"]
        return pd.DataFrame({"tile": [pdf["a_tile"].iloc[0]], "lo": [lo.tobytes()], "hi": [hi.tobytes()]})

    # at most ANCHOR_TILE * positives rows for each tile
    windows = bounds.groupBy("a_tile").applyInPandas(blobs, "tile string, lo binary, hi binary")
    all_ = r.drop("labels").join(a.drop("labels"), ["dim", "band"]).select("a_tile", "r_tile", "dim", "band")
    far = ranked_rows(meet(all_, stage(anchors.join(windows, "tile"), "neg-windows"), every), negatives, positives, bound)
    hard = far.withColumn("rank", F.row_number().over(Window.partitionBy("a_tile", "at", "win").orderBy(*order))).filter(F.col("rank") <= negatives)
    hard = hard.select("a_tile", "at", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = first.join(hard, ["a_tile", "at", "win"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("rank").cast("int"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
