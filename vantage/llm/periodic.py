"""Runs of repeated word sequences, by a suffix automaton with link-cut access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from vantage.llm.common import Vocabulary, aside, small_batches, tidy

#: A run is at least so many words and so many periods long.
LEAST, PERIODS = 24, 3
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of words: suffix link and length of each state, and the state
    of each prefix."""
    link, length, step, of = [-1], [0], [{}], []
    last = 0
    for c in words:
        new = len(link)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:  # a state for the shorter ones of q's words
                copy = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        of.append(new)
        last = new
    return link, length, of


def squares(words: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in words.

    The tree of suffix links is kept as a link-cut forest: a preferred path holds the
    states whose words last ended at one place, so its splay tree has one colour, kept at
    its root.  Appending word i accesses its prefix's state: the path to the root falls
    into segments of one colour e each.  The longest word of a segment, of length n, ended
    at e and ends at i again, with no later end between; with p = i - e <= n that is a
    square of the smallest period p, and it begins at i - n - p + 1 and not before.
    The run ends with the last i that shows the same start and period.
    """
    link, length, of = suffix_links(words)
    up, colour = link, [-1] * len(link)
    left, right = [-1] * len(link), [-1] * len(link)
    ends: dict[tuple[int, int], int] = {}

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p] = b
            right[x] = p
        else:
            b = left[x]
            right[p] = b
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    for i, node in enumerate(of):
        below, v = -1, node
        while v >= 0:
            while True:  # splay v to the root of its path's tree
                p = up[v]
                if p < 0 or (left[p] != v and right[p] != v):
                    break
                g = up[p]
                if g < 0 or (left[g] != p and right[g] != p):
                    colour[v] = colour[p]
                    rotate(v, p)
                    break
                h = up[g]
                if h < 0 or (left[h] != g and right[h] != g):
                    colour[v] = colour[g]
                rotate(*((p, g) if (left[g] == p) == (left[p] == v) else (v, p)))
                rotate(v, up[v])
            e = colour[v]
            if e >= 0:
                p, n = i - e, length[v]
                if n + p >= least and n + p >= periods * p:
                    ends[i - n - p + 1, p] = i
            deeper = right[v]
            if deeper >= 0:
                colour[deeper] = e
            right[v] = below
            below, v = v, up[v]
        colour[below] = i
    return [(s, t - s + 1, p) for (s, p), t in ends.items()]


def window_of(least: int, periods: int) -> int:
    """The longest window that occurs twice in a run wherever it stands in it: in a run of
    n words and period p a copy stands p before or after if 2 p <= n - window + 1."""
    return min(n + 1 - 2 * (n // periods) for n in range(least, least + 2 * periods))


def stretches(ids: np.ndarray, owner: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Ranges of ids, each within one document, that may hold runs.

    Every word of a run lies in a window of some words that occurs twice in the run; so
    words whose windows all occur once in their document are in no run.  Equal hashes of
    different windows only add to the ranges.
    """
    w = window_of(least, periods)
    m = len(ids) - w + 1
    if m <= 0:
        return []
    with np.errstate(over="ignore"):
        h = owner[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(w):
            h = (h ^ (ids[k : k + m].astype(np.uint64) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    inside = owner[:m] == owner[w - 1 :]
    s = np.sort(h[inside])
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return []
    again = again[np.r_[True, again[1:] != again[:-1]]]
    at = np.minimum(np.searchsorted(again, h), len(again) - 1)
    hit = inside & (again[at] == h)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:m] += hit
    edge[w : w + m] -= hit
    covered = np.cumsum(edge[:-1]) > 0
    start = covered.copy()
    start[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """docs with rep_words (number of words), rep_runs (start, length and period of every
    run, by start, then period) and rep_text (the text without what runs repeat: each
    word that a run holds after its first period goes; words joined by one blank).

    A run is a stretch of words with smallest period p, at least ``least`` words and
    ``periods`` periods long, that neither neighbouring word extends.  Words are what
    stands between ASCII blanks.  Every text is read whole by one task; batches hold 32 MB
    or one text.  No shuffle.  The automaton reads every stretch of a text whose windows
    of a few words recur in it; no other word can be part of a run.

    Null and empty texts have no words, no runs and an empty rep_text.  Repeated rows are
    handled one by one; other columns, null or of any name, stay.  An empty table gives
    no rows.
    """
    own, back = aside(docs, "rep_words", "rep_runs", "rep_text")
    text = {v: k for k, v in back.items()}.get(text, text)
    at = own.columns.index(text)
    small_batches(docs.sparkSession)

    @tidy
    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            bodies = batch.column("__body").to_pylist()
            done: list[tuple[int, list, bytes]] = []
            for start, stop in parts(bodies):
                split = [(b or b"").split() for b in bodies[start:stop]]
                done += work(split, vocabulary)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], ARROW_RUNS), pa.array([d[2] for d in done], pa.binary())],
                names=[*batch.schema.names[:-1], "rep_words", "rep_runs", "rep_text"],
            )

    def parts(bodies: list, size: int = 1 << 20):
        """Ranges of texts of about size bytes each."""
        start, sum_ = 0, 0
        for i, b in enumerate(bodies):
            sum_ += len(b or b"")
            if sum_ >= size:
                yield start, i + 1
                start, sum_ = i + 1, 0
        if start < len(bodies):
            yield start, len(bodies)

    def work(split: list[list[bytes]], vocabulary: Vocabulary) -> list[tuple[int, list, bytes]]:
        lengths = np.array([len(s) for s in split], np.int64)
        ids, _, _ = vocabulary.number([w for s in split for w in s])
        first = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(split)), lengths)
        runs: list[list] = [[] for _ in split]
        for begin, end in stretches(ids, owner, least, periods):
            d = int(owner[begin])
            move = begin - int(first[d])
            runs[d] += [(s + move, n, p) for s, n, p in squares(ids[begin:end].tolist(), least, periods)]
        out = []
        for words, found in zip(split, runs, strict=True):
            found.sort(key=lambda r: (r[0], r[2]))
            out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(collapse(words, found))))
        return out

    schema = StructType([*own.schema.fields, StructField("rep_words", LongType()), StructField("rep_runs", ArrayType(RUN)), StructField("rep_text", BinaryType())])
    body = own.withColumn("__body", F.col(f"`{own.columns[at]}`").cast("binary"))
    got = body.mapInArrow(run, schema)
    return got.withColumn("rep_text", F.col("rep_text").cast("string")).withColumnsRenamed(back)


def greatest_run(runs: Column) -> Column:
    """Of runs in order the first of greatest exact length by period; null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | more(a, r), r).otherwise(a))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one in ten texts repeats a part of itself from some word on:
    with h = crc32 of the decimal doc_id and g = h div 10, if h ends in 0, each word i >= a
    becomes word a + (i - a) % p; a = g % n, p = 1 + (n - a) div (3 + g % 8).  Rows without
    a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", (F.coalesce(h, F.lit(1)) % 10 == 0).alias("some"), F.floor(h / 10).alias("g"))
    some = some.withColumn("w", F.when(F.col("some"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.expr("cast(a as int)") + ((i - F.col("a")) % F.col("p")).cast("int"))))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
