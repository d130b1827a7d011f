"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from vantage.llm.common import Vocabulary, add_up, chunks, small_batches, stage, tidy, words

SEED = 77
#: Rounds of raking at most; it ends when every marginal is within CLOSE of its target.
ROUNDS, CLOSE = 100, 1e-9
#: Each marginal's default target: its share of tokens to this power, normalised.
TEMPER = 0.8
#: Topics, buckets that words are counted in, and rounds of fitting topics.
TOPICS, BUCKETS, TOPIC_ROUNDS = 12, 256, 10
#: Cells (source x language x topic) up to which the fit runs in numpy on the driver;
#: a larger table is raked with DataFrame joins, by the same steps.
DRIVER_CELLS = 200_000
DIMS = ("m_source", "m_lang", "m_topic")


def counted(docs: DataFrame) -> DataFrame:
    """docs with m_tokens (words of the text) and m_vector (words by hashed bucket)."""
    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("m_tokens", LongType()), StructField("m_vector", BinaryType())])

    def run(batches):
        vocabulary, bucket = Vocabulary(), np.zeros(0, np.int64)
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column("text").to_pylist()})
            count, vectors = [], []
            for a, b in chunks(texts):
                tokens = [words(t) for t in texts["text"].iloc[a:b]]
                n = np.fromiter(map(len, tokens), np.int64, len(tokens))
                at, found, fresh = vocabulary.number([w for t in tokens for w in t])
                new = np.fromiter((zlib.crc32(w) % BUCKETS for w in found), np.int64, len(found))
                bucket = new if fresh else np.concatenate([bucket, new])
                cells = np.bincount(np.repeat(np.arange(len(tokens)), n) * BUCKETS + bucket[at], minlength=len(tokens) * BUCKETS)
                count.append(n)
                vectors += [x.tobytes() for x in cells.astype(np.uint32).reshape(-1, BUCKETS)]
            count = np.concatenate(count) if count else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count), pa.array(vectors, pa.binary())], [*batch.schema.names, "m_tokens", "m_vector"])

    return docs.mapInArrow(tidy(run), schema)


def nearest(theta: np.ndarray, vectors) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest topic of each vector (-1 without words), and the vectors' counts."""
    x = np.frombuffer(b"".join(vectors), np.uint32).reshape(-1, BUCKETS).astype(np.float64)
    return np.where(x.any(1), (x @ np.log(theta).T).argmax(1), -1), x


def topics(rows: DataFrame, seed: int = SEED) -> np.ndarray:
    """Word distributions [TOPICS, BUCKETS] of a mixture of topics, fitted to the vectors of
    all documents: each round every document goes to its likeliest topic, and topics take
    the words of theirs.  Sums are of whole numbers, so they don't depend on the order."""
    theta = np.ones((1, BUCKETS)) / BUCKETS
    rng = np.random.default_rng(seed)
    vectors = rows.select("m_vector")
    for r in range(TOPIC_ROUNDS + 1):

        def run(batches, theta=theta):
            out = np.zeros((len(theta), BUCKETS))
            for pdf in batches:
                for s in range(0, len(pdf), 1000):
                    at, x = nearest(theta, pdf["m_vector"].iloc[s : s + 1000])
                    for k in range(len(theta)):
                        out[k] += x[at == k].sum(0)
            yield pd.DataFrame({"part": [out.tobytes()]})

        sums = add_up(vectors.mapInPandas(tidy(run), "part binary"), theta.size).reshape(theta.shape)
        if r == 0:  # topics start as the whole, each with a seeded slant
            theta = (sums + 1) * np.exp(rng.normal(0, 0.5, (TOPICS, BUCKETS)))
        else:  # a topic without documents keeps its words
            theta = np.where(sums.any(1)[:, None], sums + 1, theta)
        theta = theta / theta.sum(1, keepdims=True)
    return theta


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with the three marginal keys and m_tokens (words of the text)."""
    rows = stage(counted(docs), "mix-counted")
    theta = topics(rows, seed)
    schema = StructType([*rows.schema.fields, StructField("m_topic", StringType())])

    def run(batches):
        for batch in batches:
            at, _ = nearest(theta, batch.column("m_vector").to_pylist()) if len(batch) else (np.zeros(0, int), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f"t{k}" if k >= 0 else "none" for k in at.tolist()], pa.string())], [*batch.schema.names, "m_topic"])

    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return rows.mapInArrow(tidy(run), schema).withColumns({"m_source": key("source"), "m_lang": key("lang")}).drop("m_vector")


def targets(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """For each dimension a table (key, target), targets adding to 1."""
    out = {}
    for d in DIMS:
        t = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("raw"))
        total = t.agg(F.sum("raw").alias("all_raw"))
        out[d] = t.crossJoin(F.broadcast(total)).select(d, (F.col("raw") / F.col("all_raw")).alias("target"))
    return out


def whole(cells: DataFrame, goal: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Targets for the keys that the cells have, adding to 1: a key without a target gets
    0, a target without cells has no effect."""
    out = {}
    for d in DIMS:
        t = cells.select(d).distinct().join(goal[d].groupBy(d).agg(F.max("target").alias("target")), d, "left")
        t = t.select(d, F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0)).cast("double").alias("target"))
        total = t.agg(F.sum("target").alias("all_target"))
        out[d] = stage(t.crossJoin(F.broadcast(total)).select(d, F.coalesce(F.try_divide("target", "all_target"), F.lit(0.0)).alias("target")), f"goal-{d}")
    return out


def rake_driver(cells: DataFrame, goal: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Weights by numpy; only for tables of at most DRIVER_CELLS cells, checked by rake()."""
    pdf = cells.toPandas().sort_values(list(DIMS)).reset_index(drop=True)
    w = pdf.tokens.to_numpy(float)
    w /= max(w.sum(), 1e-300)
    codes, want = {}, {}
    for d in DIMS:
        t = goal[d].toPandas().sort_values(d)
        place = {k: i for i, k in enumerate(t[d])}
        codes[d], want[d] = pdf[d].map(place).to_numpy(int), t.target.to_numpy(float)
    for _ in range(rounds):
        gap = 0.0
        for d in DIMS:
            have = np.bincount(codes[d], w, len(want[d])).astype(float)
            gap = max(gap, float(np.abs(have - want[d]).max(initial=0)))
            w = w * np.divide(want[d], have, out=np.zeros_like(have), where=have > 0)[codes[d]]
        if gap < CLOSE:
            break
    pdf["weight"] = w
    return cells.sparkSession.createDataFrame(pdf[[*DIMS, "tokens", "weight"]], cells.select(*DIMS, "tokens").schema.add("weight", "double"))


def rake_frame(cells: DataFrame, goal: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same weights by joins; the table is written anew each round to cut the lineage."""
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    now = cells.crossJoin(F.broadcast(total)).select(*DIMS, "tokens", (F.col("tokens") / F.col("all_tokens")).alias("weight"), F.lit(1.0).alias("gap"))
    for r in range(rounds):
        now = now.withColumn("gap", F.lit(0.0))
        for d in DIMS:
            have = now.groupBy(d).agg(F.sum("weight").alias("have"))
            step = have.join(goal[d], d).select(d, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("step"), F.abs(F.col("have") - F.col("target")).alias("off"))
            now = now.join(step, d).select(*DIMS, "tokens", (F.col("weight") * F.col("step")).alias("weight"), F.greatest("gap", "off").alias("gap"))
        now = stage(now, f"rake-{r}")
        if (now.agg(F.max("gap")).first()[0] or 0.0) < CLOSE:
            break
    return now.drop("gap")


def rake(cells: DataFrame, goal: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Weights whose sums over each source, language and topic meet the targets."""
    cells = cells.filter(F.col("tokens") > 0)
    goal = whole(cells, goal or targets(cells))
    small = cells.limit(driver_cells + 1).count() <= driver_cells
    return (rake_driver if small else rake_frame)(cells, goal, rounds)


def gaps(weights: DataFrame, goal: dict[str, DataFrame]) -> DataFrame:
    """dim, key, target and have (the weights' share): how near the fit came, as targets
    that contradict one another can't all be met."""
    parts = []
    for d in DIMS:
        have = weights.groupBy(F.col(d).alias("key")).agg(F.sum("weight").alias("have"))
        parts.append(goal[d].withColumnRenamed(d, "key").join(have, "key", "full").select(F.lit(d).alias("dim"), "key", "target", "have"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix(docs: DataFrame, goal: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: int = SEED, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """docs with m_source, m_lang, m_topic, m_tokens, m_weight (of the cell), m_prob, m_kept.

    Topics are learned from the words of all documents (a mixture of TOPICS distributions
    over BUCKETS word buckets).  Token weights of the cells (source, language, topic) are
    raked until every marginal meets its target; a document's probability is proportional
    to weight over tokens of its cell, scaled so that the largest is 1: no document is
    repeated, and expected sampled tokens have the target marginals.  A document is kept
    when a seeded hash of its doc_id falls below its probability, so rows of one doc_id in
    one cell are kept or dropped together; a row without a doc_id is drawn by its text.  Sums are
    taken with partial aggregation, so a hot source is no hot task.

    goal has a table (key, target) for each dimension; targets are scaled to add to 1 over
    the keys that occur.  A key without a target gets weight 0; a target without documents
    has no effect; gaps() tells how near the fit came.  Null source or language is a value
    of its own.  Documents without words have the topic none, carry no tokens, and have
    weight 0, probability 0 and are not kept.  Texts of any length are counted whole.
    Columns of docs named like the new ones are replaced.  An empty table gives no rows.
    """
    rows = keyed(docs.drop(*DIMS, "m_tokens", "m_vector", "m_weight", "m_prob", "m_kept"), seed)
    cells = stage(rows.groupBy(*DIMS).agg(F.sum("m_tokens").alias("tokens")), "mix-cells")
    weights = stage(rake(cells, goal, rounds, driver_cells).withColumn("rate", F.col("weight") / F.col("tokens")), "mix-weights")
    top = weights.agg(F.max("rate").alias("top_rate"))
    small = weights.limit(driver_cells + 1).count() <= driver_cells
    # ten digits: the two ways of fitting agree in them, so they keep the same documents
    prob = F.round(F.coalesce(F.try_divide("rate", "top_rate"), F.lit(0.0)), 10)
    rates = weights.crossJoin(F.broadcast(top)).select(*DIMS, F.round("weight", 12).alias("m_weight"), prob.alias("m_prob"))
    out = rows.join(F.broadcast(rates) if small else rates, list(DIMS), "left")
    out = out.withColumns({c: F.coalesce(F.when(F.col("m_tokens") > 0, F.col(c)), F.lit(0.0)) for c in ("m_weight", "m_prob")})
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    draw = F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53))
    return out.withColumn("m_kept", draw < F.col("m_prob"))
