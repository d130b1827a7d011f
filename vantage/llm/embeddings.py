"""Embedding near-dedup: a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stage
from vantage.llm.components import components

#: Least cosine of a link; trees; vectors that the forest is fitted on, at most.
LINK, TREES, SAMPLE, SEED = 0.95, 8, 8192, 41
#: Vectors that a leaf aims at; half-width of the spill at a split, in units of the
#: projection of a unit vector; rows on either side of a comparison task, at most.
LEAF, SPILL, TILE = 512, 0.02, 1024
#: Members that a split of a large leaf is fitted on, about, and the depth of a split.
FIT, DEPTH = 512, 3
#: Sample members that make a ball, and the most balls there are.
DENSE, BALLS = 16, 512
#: Rows of a side that is broadcast, at most, each some 100 bytes.
SMALL = 100_000
#: Two unit vectors within half the link angle of one point have at least the link's cosine.
CORE = float(np.cos(np.arccos(LINK) / 2)) + 1e-9


class Forest:
    """Trees as arrays of nodes, and balls, fitted on a sample of unit vectors."""

    def __init__(self, x: np.ndarray, total: int):
        self.dim = x.shape[1] if len(x) else 0
        self.centres = self.find_balls(x)
        rng = np.random.default_rng(SEED)
        self.trees, self.leaves = [], 0
        target = max(8, LEAF * len(x) // max(1, total))  # sample members of a leaf
        for _ in range(TREES):
            self.trees.append(self.grow(x, np.arange(len(x)), rng, target))

    def find_balls(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, self.dim))
        count = np.concatenate([(x[s : s + 1024] @ x.T >= LINK).sum(1) for s in range(0, len(x), 1024)])
        free, out = np.ones(len(x), bool), []
        for i in np.lexsort((np.arange(len(x)), -count)):
            if len(out) == BALLS or count[i] < DENSE:
                break
            if not free[i]:
                continue
            near = x @ x[i] >= LINK
            centre = x[near].mean(0)
            centre /= np.linalg.norm(centre)
            inside = x @ centre >= CORE
            if (inside & free).sum() >= DENSE:
                out.append(centre)
                free &= ~inside
            free[i] = False
        return np.array(out) if out else np.zeros((0, x.shape[1]))

    def grow(self, x, rows, rng, target):
        """Nodes (direction, cut, left, right, leaf number): splits along random
        directions, at the place of fewest members near it among middle fractiles."""
        nodes: list = []

        def split(rows, depth):
            at = len(nodes)
            nodes.append(None)
            best = None
            if len(rows) > target and depth < 40:
                for _ in range(4):
                    direction = rng.normal(size=self.dim)
                    direction /= np.linalg.norm(direction)
                    p = np.sort(x[rows] @ direction)
                    cuts = p[(np.linspace(0.3, 0.7, 21) * (len(p) - 1)).astype(int)]
                    crowd = np.searchsorted(p, cuts + SPILL) - np.searchsorted(p, cuts - SPILL)
                    j = int(crowd.argmin())
                    if best is None or crowd[j] < best[0]:
                        best = (int(crowd[j]), direction, float(cuts[j]))
            if best is None or best[0] > 0.7 * len(rows):  # small, or too dense to split
                nodes[at] = (None, 0.0, -1, -1, self.leaves)
                self.leaves += 1
                return at
            p = x[rows] @ best[1]
            left = split(rows[p <= best[2] + SPILL], depth + 1)
            right = split(rows[p > best[2] - SPILL], depth + 1)
            nodes[at] = (best[1], best[2], left, right, -1)
            return at

        split(rows, 0)
        return nodes

    def route(self, x: np.ndarray) -> list[list[int]]:
        """Leaves of each vector, of all trees, in order."""
        out: list[list[int]] = [[] for _ in x]
        for nodes in self.trees:
            work = [(0, np.arange(len(x)))]
            while work:
                at, rows = work.pop()
                direction, cut, left, right, leaf = nodes[at]
                if direction is None:
                    for r in rows.tolist():
                        out[r].append(leaf)
                    continue
                p = x[rows] @ direction
                work += [(left, rows[p <= cut + SPILL]), (right, rows[p > cut - SPILL])]
        return [sorted(r) for r in out]

    def ball(self, x: np.ndarray) -> np.ndarray:
        """The first ball that holds each vector, else -1."""
        if not len(self.centres):
            return np.full(len(x), -1, np.int64)
        inside = x @ self.centres.T >= CORE
        return np.where(inside.any(1), inside.argmax(1), -1)


@functools.lru_cache(4096)
def direction(seed: int, dim: int) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=dim)
    return x / np.linalg.norm(x)


def subtree(x: np.ndarray, seed: int, target: int) -> list[tuple[int, float, int]]:
    """Splits of a leaf from a sample of its members: (seed of the direction, cut, place) by
    place in a binary heap, of DEPTH levels at most; none where members lie too dense."""
    out, work = [], [(1, np.arange(len(x)))]
    while work:
        at, rows = work.pop()
        if at >= 1 << DEPTH or len(rows) <= target:
            continue
        best = None
        for k in range(4):
            own = xxhash.xxh64_intdigest(f"{seed}:{at}:{k}") >> 1
            p = np.sort(x[rows] @ direction(own, x.shape[1]))
            cuts = p[(np.linspace(0.3, 0.7, 21) * (len(p) - 1)).astype(int)]
            crowd = np.searchsorted(p, cuts + SPILL) - np.searchsorted(p, cuts - SPILL)
            j = int(crowd.argmin())
            if best is None or crowd[j] < best[0]:
                best = (int(crowd[j]), own, float(cuts[j]))
        if best[0] > 0.25 * len(rows):  # then a side would keep nearly all
            continue
        out.append((best[1], best[2], at))
        p = x[rows] @ direction(best[1], x.shape[1])
        work += [(2 * at, rows[p <= best[2] + SPILL]), (2 * at + 1, rows[p > best[2] - SPILL])]
    return out


def refined(at_leaf: DataFrame, limit: int) -> DataFrame:
    """(rep, ball, leaf) of at_leaf (rep, ball, dim, v, leaf) with every leaf over limit rows
    split, level by level, until none is larger or its members lie too dense.  A leaf's splits
    are fitted in a task of their own on about FIT of its members and joined to its rows as
    seeds and cuts, so neither the driver nor a task holds more, and work grows with the rows.
    Only rows of large leaves are read with their vectors."""
    done = None
    while True:
        sizes = stage(at_leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "emb-large")
        small = at_leaf.select("rep", "ball", "leaf")
        if not (many := sizes.count()):
            return small if done is None else done.unionByName(small)
        side = F.broadcast(sizes) if many <= SMALL else sizes.hint("merge")
        small = small.join(side, "leaf", "left_anti").select("rep", "ball", "leaf")
        done = small if done is None else done.unionByName(small)
        large = at_leaf.join(side, "leaf")
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "leaf", "rep"), 11) / F.lit(float(1 << 53))
        some = large.filter(draw * F.col("n") < FIT).select("leaf", "n", "dim", "v")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            leaf, n = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
            splits = subtree(opened(pdf), leaf, max(8, LEAF * len(pdf) // n))
            return pd.DataFrame({"leaf": [leaf], "seeds": [[s for s, _, _ in splits]], "cuts": [[c for _, c, _ in splits]], "places": [[p for _, _, p in splits]]})

        def route(batches):
            for pdf in batches:
                for leaf, part in pdf.groupby("leaf", sort=False):
                    x, splits = opened(part), {p: (s, c) for s, c, p in zip(part["seeds"].iloc[0], part["cuts"].iloc[0], part["places"].iloc[0], strict=True)}
                    work = [(1, np.arange(len(part)))]
                    while work:
                        at, rows = work.pop()
                        if at not in splits:
                            out = part.iloc[rows][["rep", "ball", "dim", "v"]].copy()
                            out["leaf"] = xxhash.xxh64_intdigest(f"{leaf}:{at}") >> 1
                            yield out
                            continue
                        seed, cut = splits[at]
                        p = x[rows] @ direction(int(seed), x.shape[1])
                        work += [(2 * at, rows[p <= cut + SPILL]), (2 * at + 1, rows[p > cut - SPILL])]

        splits = stage(some.groupBy("leaf").applyInPandas(fit, "leaf long, seeds array<long>, cuts array<double>, places array<int>"), "emb-splits")
        whole = large.drop("n").join(splits.hint("merge"), "leaf", "left")  # so rows of a leaf come one after another
        dense = whole.filter("seeds is null or size(seeds) = 0").select("rep", "ball", "leaf")
        done = done.unionByName(stage(dense, "emb-dense"))
        at_leaf = stage(whole.filter("size(seeds) > 0").mapInPandas(route, "rep long, ball int, dim int, v binary, leaf long"), "emb-leaves")


def unit(column) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def opened(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors of rows of one length dim, whose components are the bytes in v."""
    dim = int(pdf["dim"].iloc[0])
    kind = np.float32 if len(pdf["v"].iloc[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(pdf["v"]), kind).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a task: for each vector the number of its links
    counted here and the smallest vector of its component here.

    A link is counted in the first leaf that both vectors are in; vectors of one ball are
    linked anyway and left out."""
    x, side, ball = opened(pdf), pdf["side"].to_numpy(), pdf["ball"].to_numpy()
    rep, mult, leaf = pdf["rep"].to_numpy(), pdf["mult"].to_numpy(), int(pdf["leaf"].iloc[0])
    alone = (side == 2).all()  # one tile with itself
    a = np.flatnonzero(side != 1)
    b = np.flatnonzero(side != 0) if alone else np.flatnonzero(side == 1)
    links = np.zeros(len(pdf), np.int64)
    ones, others = [], []
    for s in range(0, len(a), 256):
        right = b[s:] if alone else b
        i, j = np.nonzero(x[a[s : s + 256]] @ x[right].T >= LINK)
        i, j = a[s + i], right[j]
        keep = (i < j) if alone else np.ones(len(i), bool)
        keep &= (ball[i] != ball[j]) | (ball[i] < 0)
        ones.append(i[keep])
        others.append(j[keep])
    i, j = (np.concatenate(ones), np.concatenate(others)) if ones else (np.zeros(0, int), np.zeros(0, int))
    if len(i):
        first = first_here(pdf["member"].to_numpy(), i, j, leaf)
        i, j = i[first], j[first]
    np.add.at(links, i, mult[j])
    np.add.at(links, j, mult[i])
    low = rep.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(links)
    return pd.DataFrame({"rep": rep[some], "links": links[some], "low": low[some]})


def compared(batches):
    """compare for every task (leaf, low, high) of rows in the tasks' order.  A task's rows may go on
    in the next batches; only those of the last task wait for them."""
    rest: list = []
    for pdf in batches:
        key = pdf[["leaf", "low", "high"]].to_numpy()
        ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
        if rest and len(pdf) and (rest[0][["leaf", "low", "high"]].iloc[0].to_numpy() != key[0]).any():
            yield compare(pd.concat(rest, ignore_index=True))
            rest = []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            part = pdf.iloc[start:end]
            if end == len(pdf):
                rest += [part] if end > start else []
            else:
                yield compare(pd.concat([*rest, part], ignore_index=True) if rest else part)
                rest = []
    if rest:
        yield compare(pd.concat(rest, ignore_index=True))


def first_here(member: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int, width: int = 4096) -> np.ndarray:
    """Whether no smaller leaf than this holds both vectors of each pair i, j; member: the
    leaves of each vector as bytes.  A vector is a row of bits, one for each smaller leaf
    that several vectors here are in."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = [np.frombuffer(member[k], np.int64) for k in used.tolist()]
    row, flat = np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate(own)
    row, flat = row[flat < leaf], flat[flat < leaf]
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count[col] > 1
    row, col = row[several], np.unique(col[several], return_inverse=True)[1]
    one, other, met = at[: len(i)], at[len(i) :], np.zeros(len(i), bool)
    for start in range(0, int(col.max(initial=-1)) + 1, width):
        here = (col >= start) & (col < start + width)
        bits = np.zeros((len(own), width), bool)
        bits[row[here], col[here] - start] = True
        bits = np.packbits(bits[:, : int(col.max()) + 1 - start], axis=1)
        for t in range(0, len(i), 20_000):
            met[t : t + 20_000] |= (bits[one[t : t + 20_000]] & bits[other[t : t + 20_000]]).any(1)
    return ~met


def near_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null vec_id (their component is null, kept false);
    vectors of different lengths don't link.  Equal vectors form a class that is compared
    once.  For each length a forest is fitted, in a task of its own, on a sample of its
    classes (drawn by hash, SAMPLE expected, all if fewer); the driver passes on the trees,
    and holds no vectors.  Every class goes down all trees, into both sides of a split near its cut, and is compared
    with all others of its leaves in double precision.  Leaves over TILE rows are split
    further, level by level, until their members lie too dense; those that stay larger are
    compared tile by tile in tasks of their own, so no leaf is cut short.  Vectors and lists of
    leaves travel as bytes, and only leaves that are dealt in tiles pass through Python on
    their way to the comparison.  Balls are places where
    the sample is dense: two vectors within half the link angle of the centre have the
    link's cosine for certain, so members of one ball aren't compared with one another and
    a huge group takes no quadratic work.  Links found give components.  Rows that repeat
    a vec_id are one node.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    raw = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(raw, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(raw, lambda e: e != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)).alias("fine"))
    classes = rows.filter("fine").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = stage(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.xxhash64("embedding")), "emb-classes")
    sizes = stage(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("total")), "emb-sizes")  # written, so Spark knows how small it is
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "embedding"), 11) / F.lit(float(1 << 53))
    some = classes.join(sizes, "dim").filter(draw * F.col("total") < SAMPLE).select("dim", "total", "rep", "embedding")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "forest": [pickle.dumps(Forest(unit(pdf["embedding"]), int(pdf["total"].iloc[0])))]})

    forests: dict[int, Forest] = {}
    leaves = balls = 0
    for r in sorted(some.groupBy("dim").applyInPandas(fit, "dim int, forest binary").collect(), key=lambda r: r["dim"]):  # one for each length
        forests[r["dim"]] = f = pickle.loads(r["forest"])
        f.base, f.first_ball = leaves, balls
        leaves, balls = leaves + f.leaves, balls + len(f.centres)
    shared = spark.sparkContext.broadcast(forests)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def route(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                forest, x = shared.value[dim], unit(part["embedding"])
                leaves = [[forest.base + n for n in r] for r in forest.route(x)]
                ball = forest.ball(x)
                raw = np.array(part["embedding"].tolist(), kind)
                yield pd.DataFrame({"rep": part["rep"], "mult": part["mult"], "dim": dim, "v": [r.tobytes() for r in raw], "leaves": leaves, "ball": np.where(ball >= 0, ball + forest.first_ball, -1)})

    routed = classes.select("rep", "mult", "embedding").mapInPandas(route, "rep long, mult long, dim int, v binary, leaves array<long>, ball int")
    routed = stage(routed, "emb-routed")
    at_leaf = refined(routed.select("rep", "ball", "dim", "v", F.explode("leaves").alias("leaf")), TILE)
    leaves = at_leaf.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # a few for each tree
    # leaves that are still over TILE, by balls: (ball, tiles of it, first tile)
    counts = at_leaf.groupBy("leaf", "ball").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.groupBy("leaf").agg(F.sum("n").alias("all_n"), F.array_sort(F.collect_list(F.struct("ball", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))).alias("units")).filter(F.col("all_n") > TILE)
    plan = stage(plan.select("leaf", "units"), "emb-plan")
    units = plan.agg(F.sum(F.size("units"))).first()[0] or 0

    def listed(batches):
        """The leaves of each vector as bytes too."""
        for pdf in batches:
            pdf["member"] = [np.asarray(x, np.int64).tobytes() for x in pdf["leaves"]]
            yield pdf

    at_leaf = routed.drop("leaves").join(leaves.hint("merge"), "rep").mapInPandas(listed, "rep long, mult long, dim int, v binary, ball int, leaves array<long>, member binary")
    at_leaf = at_leaf.withColumn("leaf", F.explode("leaves")).drop("leaves")
    side = F.broadcast(plan) if units <= SMALL else plan.hint("merge")

    def deal(batches):
        """Each row once for every comparison task of its tile."""
        for pdf in batches:
            index, lows, highs, side = [], [], [], []
            for i, (ball, rep, units) in enumerate(zip(pdf["ball"].tolist(), pdf["rep"].tolist(), pdf["units"], strict=True)):
                tiles = [(u["ball"], u["tiles"]) for u in units]
                first = dict(zip((b for b, _ in tiles), np.cumsum([0, *(k for _, k in tiles)]).tolist(), strict=False))
                mine = first[ball] + xxhash.xxh64_intdigest(rep.to_bytes(8, "little", signed=True)) % dict(tiles)[ball]
                for b, k in tiles:
                    for other in range(first[b], first[b] + k):
                        if b == ball >= 0:
                            continue
                        low, high = min(mine, other), max(mine, other)
                        index.append(i), lows.append(low), highs.append(high), side.append(2 if low == high else int(mine == high))
            out = pdf.iloc[index].drop(columns="units")
            out["low"], out["high"], out["side"] = lows, highs, side
            yield out

    # most leaves are one task, which needs no dealing
    dealt = at_leaf.withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(2)})
    if units:
        tiled = at_leaf.join(side, "leaf").select(*at_leaf.columns, "units").mapInPandas(deal, "rep long, mult long, dim int, v binary, ball int, member binary, leaf long, low int, high int, side int")
        dealt = dealt.join(side, "leaf", "left_anti").unionByName(tiled)
    task = ["leaf", "low", "high"]
    found = stage(dealt.repartition(*task).sortWithinPartitions(*task).mapInPandas(compared, "rep long, links long, low long"), "emb-found")
    balls = stage(routed.filter("ball >= 0").groupBy("ball").agg(F.sum("mult").alias("all_mult"), F.min("rep").alias("low")), "emb-balls")
    in_ball = routed.filter("ball >= 0").select("rep", "mult", "ball").join(F.broadcast(balls), "ball")
    links = found.select("rep", "links").unionAll(in_ball.select("rep", (F.col("all_mult") - F.col("mult")).alias("links")))
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionAll(in_ball.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    at = components(edges)
    known = classes.join(links, "rep", "left").join(at, classes["rep"] == at["node"], "left")
    known = known.select(F.col("embedding").alias("v"), "cid", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    # rows without a usable vector are dealt by their ids, so null vectors don't meet in one task
    rows = rows.withColumn("key", F.when(F.col("fine"), F.xxhash64("embedding")).otherwise(F.xxhash64("vec_id")))
    out = rows.join(known, (F.col("key") == F.col("cid")) & (F.col("embedding") == F.col("v")), "left")
    own = F.when(F.col("fine"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("fine"), F.col("links")).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
