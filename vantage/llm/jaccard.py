"""N-gram Jaccard join: a grouped prefix join over word shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.common import Vocabulary, chunks, null_ids, ragged, small_batches, stage, tidy, whole_ids, words
from vantage.llm.components import components

#: Buckets of the shingle counts that put frequent shingles last; a fixed size, broadcast.
COUNT_BITS = 18
#: Ids that the texts' reading is filtered by in a broadcast; more go through a join.
BROADCAST_IDS = 2_000_000
#: Shared shingles before a set's own that show whether two sets have met already.
BEFORE = 4
#: Linear rounds after the first, at most, about how many members of a main component are drawn
#: in each for a shingle, and the least groups of such a shingle: of fewer all pairs are few.
ROUNDS, DRAWN, LARGE = 2, 32, 256
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles (64 bits) of texts; keeps hashes of words met before."""

    def __init__(self, size: int):
        self.size, self.vocabulary, self.hashes = size, Vocabulary(), np.zeros(0, np.uint64)

    def sets(self, texts: list) -> list[np.ndarray]:
        tokens = [words(t) for t in texts]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids, found, fresh = self.vocabulary.number([w for t in tokens for w in t])
        new = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        self.hashes = new if fresh else np.concatenate([self.hashes, new])
        h = self.hashes[ids]
        count = np.where(lengths >= self.size, lengths - self.size + 1, 0)
        start = np.cumsum(lengths) - lengths
        at = ragged(start, count)
        s = np.full(len(at), self.size, np.uint64)
        for j in range(self.size):
            s = mix((s + h[at + j]) * _M1)
        ends = np.cumsum(count)
        out = [np.unique(x) for x in np.split(s, ends[:-1])] if len(ends) else []
        for i in np.flatnonzero((lengths > 0) & (lengths < self.size)):
            short = np.full(1, lengths[i], np.uint64)
            for j in range(lengths[i]):
                short = mix((short + h[start[i] + j : start[i] + j + 1]) * _M1)
            out[i] = short
        return out


def needed(n, percent: int):
    """Least overlap of a set of n with any set similar to it."""
    return -(-n * percent // 100)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of set members by their low bits: differing bits of two are at most as many
    as the members in which the sets differ."""
    bits = 1 << int(np.clip(int(len(s) - 1).bit_length(), 10, 14))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes) -> np.ndarray:
    """A bitmap brought to 256 bits, as four longs; it bounds differences as well."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > 32:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64)


def bits_apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' sets have a shingle in each bucket, over all documents."""

    def run(batches):
        shingler, total = Shingler(size), np.zeros(1 << COUNT_BITS, np.int64)
        for pdf in batches:
            for a, b in chunks(pdf):
                for s in shingler.sets(pdf["text"].iloc[a:b].tolist()):
                    np.add.at(total, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    got = docs.select("text").mapInPandas(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = got.toPandas()  # at most 2 ** COUNT_BITS rows
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[got["bucket"]] = got["n"]
    return out


def signatures(docs: DataFrame, size: int, percent: int, count: np.ndarray) -> DataFrame:
    """doc_id, n (set size), k1, k2 (identity of the set), prefix, bits."""
    shared = docs.sparkSession.sparkContext.broadcast(count)

    def run(batches):
        shingler, count = Shingler(size), shared.value
        for pdf in batches:
            rows = []
            for a, b in chunks(pdf):
                for i, none, s in zip(pdf["doc_id"].iloc[a:b], pdf["no_id"].iloc[a:b], shingler.sets(pdf["text"].iloc[a:b].tolist()), strict=True):
                    n = len(s)
                    length = n - needed(n, percent) + 1 if n else 0
                    order = np.lexsort((s, count[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[:length]
                    k1, k2 = mix(s).sum(dtype=np.uint64), mix(s ^ _M1).sum(dtype=np.uint64)
                    bits = bitmap(s) if n else b""
                    rows.append((i, none, n, k1.astype(np.int64), k2.astype(np.int64), s[order].view(np.int64), bits, folded(bits)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n", "k1", "k2", "prefix", "bits", "short"])

    out = whole_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, no_id boolean, n long, k1 long, k2 long, prefix array<long>, bits binary, short array<long>")
    return null_ids(out)


def may_link(nx, ny, i, j, percent: int):
    """Whether sets of sizes nx, ny that first meet at prefix positions i, j can link."""
    best = F.least(nx - i, ny - j)
    return best * (100 + percent) >= (nx + ny) * percent


def within_short(n, i, percent: int):
    """Whether position i is in the short prefix of a set of size n: of two sets that link,
    the one that is not larger shares a shingle of its short prefix with the prefix of the
    other (with its short prefix, if both have one size)."""
    return i <= n - F.ceil(n * (2 * percent) / F.lit(100 + percent))


def may_link_within(n, percent: int):
    """Whether two different sets of one size n can link: at best they differ in one member."""
    return (n - 1) * 100 >= (n + 1) * percent


def prune(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps don't rule out a link."""
    left = meta.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = meta.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    wide = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for pdf in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(pdf["ba"], pdf["bb"], strict=True)], np.int64)
            both = (pdf["na"] + pdf["nb"]).to_numpy()
            yield pdf[["a", "b"]][apart * (100 + percent) <= both * (100 - percent)]

    return stage(wide.mapInPandas(tidy(run), "a long, b long"), "jac-pruned")


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of doc_ids with 100 * intersection >= percent * union, by exact sets."""
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "jac-wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def make(batches):
        shingler = Shingler(size)
        for pdf in batches:
            for a, b in chunks(pdf):
                part = pdf.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"], "members": [s.tobytes() for s in shingler.sets(part["text"].tolist())]})

    sets = stage(texts.mapInPandas(tidy(make), "doc_id long, members binary"), "jac-sets")
    sets = sets.groupBy("doc_id").agg(F.min("members").alias("members"))
    wide = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("sa")), "a")
    wide = wide.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("sb")), "b")

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pdf[["a", "b"]][np.array(keep, bool)]

    return stage(wide.mapInPandas(tidy(run), "a long, b long"), "jac-links")


def differ(percent: int):
    """Whether the short bitmaps w0 .. w3 of x and y allow a link; groups with several members have none."""
    apart = sum((F.bit_count(F.col(f"w{i}_x").bitwiseXOR(F.col(f"w{i}_y"))) for i in range(1, 4)), F.bit_count(F.col("w0_x").bitwiseXOR(F.col("w0_y"))))
    return F.coalesce(apart, F.lit(0)) * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)


def standing(met: DataFrame, here: DataFrame, percent: int) -> DataFrame:
    """Members of shingles that lie in more than one component: token, gid, n, pos, comp, short, main (the
    component with most groups at the shingle; mains: how many; all: of all), lead (smallest rep of gid in comp), members, l0 .. l3 (lead's bitmap)."""
    part = here.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "short")).alias("lead"))
    part = part.select("gid", "comp", "members", F.col("lead.rep").alias("lead"), *[F.col("lead.short")[i].alias(f"l{i}") for i in range(4)])
    spread = met.join(part, "gid").withColumn("short", within_short(F.col("n"), F.col("pos"), percent))
    by = spread.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("short").alias("short"))
    by = by.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all"), F.max("short").alias("some")).filter("comps > 1 and some")
    return spread.join(by.select("token", "all", F.col("most.comp").alias("main"), F.col("most.c").alias("mains")), "token")


def approaches(spread: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b) of leads: of every group outside its shingle's main component with a few members of that
    component, drawn anew for each shingle, so a group that links with many of it meets one that it links with."""
    side = lambda x: ["token", *[F.col(c).alias(f"{c}_{x}") for c in ("lead", "n", "pos")], *[F.col(f"l{i}").alias(f"w{i}_{x}") for i in range(4)]]
    spread = spread.filter(F.col("all") >= LARGE)
    every = F.ceil(F.col("mains") / F.lit(DRAWN))
    x, y = spread.filter("comp <> main").select(*side("x")), spread.filter("comp = main").filter(F.pmod(F.xxhash64(F.lit(seed), "token", "gid"), every) == 0).select(*side("y"))
    near = may_link(F.col("n_x"), F.col("n_y"), F.col("pos_x"), F.col("pos_y"), percent) & differ(percent)
    pairs = x.join(y, (x["token"] == y["token"]) & near)
    return pairs.select(F.least("lead_x", "lead_y").alias("a"), F.greatest("lead_x", "lead_y").alias("b")).distinct()


def merged(here: DataFrame, links: DataFrame) -> DataFrame:
    """here with components (smallest rep) put together that links connect."""
    ends = links.join(here.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(here.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
    at = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    at = at.withColumnRenamed("component", "to")
    return stage(here.join(at, here["comp"] == at["node"], "left").withColumn("comp", F.coalesce("to", "comp")).select(here.columns), "jac-here")


def meetings(spread: DataFrame, percent: int) -> DataFrame:
    """Pairs (gid_x, comp_x, gid_y, comp_y) of different components that meet at a shingle
    and may link.  Two sets that meet at a shingle also pass at each earlier one that they
    share; so a pair counts at the first, as far as the last BEFORE shingles show it."""
    side = lambda x: [F.col("token"), F.col("band"), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "gid", "n", "pos", "short", "before", "w0", "w1", "w2", "w3")]]
    least, other = spread.filter("short").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") + 2))), spread
    near = may_link(F.col("n_x"), F.col("n_y"), F.col("pos_x"), F.col("pos_y"), percent) & differ(percent)
    near &= (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & F.col("short_y"))
    near &= (F.col("comp_x") != F.col("comp_y")) & ~F.arrays_overlap("before_x", "before_y")

    def meet(x, y):
        x, y = x.select(*side("x")), y.select(*side("y"))
        return x.join(y, (x["token"] == y["token"]) & (x["band"] == y["band"]) & near).select("gid_x", "comp_x", "gid_y", "comp_y")

    main, rest = "comp = main", "comp <> main"
    return meet(least.filter(rest), other.filter(rest)).unionAll(meet(least.filter(rest), other.filter(main))).unionAll(meet(least.filter(main), other.filter(rest)))


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, rep, component_id) and verified links (a, b)
    between class representatives, whose components are those of all links.

    Documents with one and the same shingle set form a class, represented by its
    smallest doc_id.  Shingles are ordered rarest first; two sets that link share one of
    their first n - ceil(n * percent / 100) + 1 shingles.  Classes with equal prefix and
    size form a group; groups meet by shingles of their prefixes, pairs of groups are
    filtered by size and position, expanded to members, filtered by bitmaps and verified
    with exact sets.  First every member is compared with its group's leader and every
    leader with two pivots of each shingle and size range, and what is left outside the
    main component of a frequent shingle with drawn members of it, which takes linearly many
    pairs; then, exhaustively, with all others that are not in its component yet: of the
    members that meet at a shingle those outside its main component are joined with one
    another and with that component, the one that is not larger by its short prefix only
    and within bands of like sizes; members of one group meet at its first shingle.  So no
    link that decides a component is lost, large groups don't emit all pairs, and texts
    that share a template meet only where they are alike enough to link.

    Null and empty texts have no shingles and are components of their own.  Rows
    that repeat a doc_id with one text give repeated rows; with differing texts they are
    one node, and the set whose bytes come first decides the links of that doc_id.  Rows
    with a null doc_id keep a null component and link with nothing.  Texts of any length
    are read whole; other columns are ignored.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sign = stage(signatures(docs, size, percent, counts(docs, size)), "jac-sign")
    classes = sign.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    classes = stage(classes.withColumn("g", F.xxhash64("prefix")), "jac-classes")
    groups = classes.groupBy("g", "n").agg(F.min("rep").alias("gid"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("classes"))
    reps = stage(classes.join(groups.select("g", "n", "gid"), ["g", "n"]).select("rep", "n", "bits", "short", "gid"), "jac-reps")
    met = groups.select("gid", "n", "classes", F.posexplode("prefix").alias("pos", "token"))
    # members of one group meet at its first shingle, also if no other group has it
    within = (F.col("pos") == 0) & (F.col("classes") > 2) & may_link_within(F.col("n"), percent)
    shared = met.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max(within).alias("within")).filter("c > 1 or within").select("token")
    met = stage(met.join(shared, "token").drop("classes"), "jac-met")

    # linear rounds: leaders of groups, and two pivots for each shingle and size range
    run = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) / 2)).cast("int")
    ranged = met.withColumn("range", run)
    pivot = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "gid").alias("h"), F.col("gid").alias("pid"), F.col("n").alias("pn"), F.col("pos").alias("ppos")))
    pivots = ranged.groupBy("token", "range").agg(F.array_distinct(F.array(pivot(1), pivot(2))).alias("p"))
    pivots = pivots.select("token", F.explode(F.array("range", F.col("range") + 1)).alias("range"), F.explode("p").alias("p")).select("token", "range", "p.pid", "p.pn", "p.ppos")
    star = ranged.join(pivots, ["token", "range"]).filter(F.col("gid") != F.col("pid")).filter(may_link(F.col("n"), F.col("pn"), F.col("pos"), F.col("ppos"), percent))
    star = star.select(F.least("gid", "pid").alias("a"), F.greatest("gid", "pid").alias("b"))
    leaders = reps.filter("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    links = verify(prune(star.unionAll(leaders).distinct(), reps, percent), docs, size, percent)
    at = components(links)

    # what is left: pairs of groups in different components that meet
    here = stage(reps.join(at, reps["rep"] == at["node"], "left").select("rep", "n", "gid", "short", F.coalesce("component", "rep").alias("comp")), "jac-here")
    for seed in range(ROUNDS):
        closer = prune(approaches(standing(met, here, percent), percent, seed), reps, percent)
        if not closer.limit(1).count():
            break
        more = verify(closer, docs, size, percent)
        if not more.limit(1).count():
            break
        links, here = links.unionAll(more), merged(here, more)
    spread = standing(met, here, percent).select("token", "gid", "n", "pos", "comp", "short", "main", *[F.when(F.col("members") == 1, F.col(f"l{i}")).alias(f"w{i}") for i in range(4)])
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) - 1e-9).cast("int")
    before = F.collect_list("token").over(Window.partitionBy("gid", "comp").orderBy("pos").rowsBetween(-BEFORE, -1))
    spread = stage(spread.withColumns({"band": band, "before": before}), "jac-spread")
    groups2 = meetings(spread, percent)
    groups2 = groups2.select(F.col("gid_x").alias("gx"), F.col("comp_x").alias("cx"), F.col("gid_y").alias("gy"), F.col("comp_y").alias("cy"))
    groups2 = stage(groups2.distinct(), "jac-groups")
    pairs = groups2.join(here.select(F.col("gid").alias("gx"), F.col("comp").alias("cx"), F.col("rep").alias("x")), ["gx", "cx"])
    pairs = pairs.join(here.select(F.col("gid").alias("gy"), F.col("comp").alias("cy"), F.col("rep").alias("y")), ["gy", "cy"])
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = verify(prune(pairs, reps, percent), docs, size, percent)
    links = links.unionAll(more)
    at = merged(here, more).select(F.col("rep").alias("node"), F.col("comp").alias("component"))

    member = sign.join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"], "left")
    member = member.join(at, member["rep"] == at["node"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), own.alias("component_id")), links
