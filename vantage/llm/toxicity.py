"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from vantage.llm.common import Vocabulary, chunks, ragged, small_batches, tidy

#: Labelled documents that training takes at most, of either label, by hash of the id.
MAX_POSITIVE, MAX_NEGATIVE = 1000, 3000
#: Bytes of texts of either label that training takes at most, and of one text.
MAX_BYTES, MAX_TEXT = 12 << 20, 2 << 20
#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 24, 12
HIDDEN, EMBED, BUCKETS = 8, 5, 2048
GRAMS = 1 << 18
SEED = 5
_STRIP = re.compile(r"[\W\d_]+")
_GRAM_SIZES = (3, 4, 5)


def clean(word: bytes) -> bytes:
    """Letters of a word, in lower case."""
    return _STRIP.sub("", word.decode("utf-8", "surrogatepass").lower()).encode("utf-8", "surrogatepass")


def grams(forms: list[bytes], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (bytes, with a mark before and after) of all forms, and how
    many each has; some forms at a time, to bound memory."""
    if len(forms) > part:
        parts = [grams(forms[s : s + part], part) for s in range(0, len(forms), part)]
        return np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    raw = [b"^" + f + b"$" for f in forms]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    owner, got = [], []
    for n in _GRAM_SIZES:
        count = np.maximum(size - n + 1, 0)
        at = ragged(start, count)
        h = np.full(len(at), 1469598103934665603 + n, np.uint64)
        for j in range(n):
            h = (h ^ data[at + j]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        got.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18))
        owner.append(np.repeat(np.arange(len(raw)), count))
    owner, got = np.concatenate(owner), np.concatenate(got).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return got[order], np.bincount(owner, minlength=len(raw))


def log_odds(c1, c0, n1, n0):
    """Log ratio of document shares, drawn to 0 for what is rare; 0 below 3 documents."""
    n = n1 + n0
    out = np.log((c1 + n1 / n) / n1) - np.log((c0 + n0 / n) / n0)
    return np.where(c1 + c0 >= 3, np.clip(out, -6, 6), 0.0)


class Model:
    """Word statistics of the training sample and the network's weights."""

    def __init__(self, word_odds: dict[bytes, float], gram_odds: np.ndarray, net: dict[str, np.ndarray], scale: tuple[float, float]):
        self.word_odds, self.gram_odds, self.net, self.scale = word_odds, gram_odds.astype(np.float32), net, scale

    def inputs(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word and character inputs of each form, and its embedding bucket."""
        return features(forms, np.array([self.word_odds.get(f, 0.0) for f in forms]), self.gram_odds)


def features(forms: list[bytes], odds: np.ndarray, gram_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not forms:
        return np.zeros((0, 3), np.float32), np.zeros(0, np.int64)
    if len(forms) > 20_000:
        parts = [features(forms[s : s + 20_000], odds[s : s + 20_000], gram_odds) for s in range(0, len(forms), 20_000)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([b for _, b in parts])
    g, count = grams(forms)
    value = gram_odds[g]
    start = np.cumsum(count) - count
    value = np.append(value, 0.0)
    high = np.where(count > 0, np.maximum.reduceat(value, start), 0.0)
    mean = np.where(count > 0, np.add.reduceat(value, start) / np.maximum(count, 1), 0.0)
    bucket = np.fromiter((zlib.crc32(f) % BUCKETS for f in forms), np.int64, len(forms))
    return np.stack([odds, high, mean], 1).astype(np.float32) / 3, bucket


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many words: each window's document, start word and length.
    Every word is in a window; an empty document has one empty window."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, first + np.repeat(np.cumsum(lengths) - lengths, count), np.clip(lengths[doc] - first, 0, WINDOW)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_net(rng) -> dict[str, np.ndarray]:
    h, d = HIDDEN, 3 + EMBED
    n = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2] if len(s) > 1 else 1), s).astype(np.float32)
    return {
        "E": 0.1 * n(BUCKETS, EMBED) * np.sqrt(BUCKETS).astype(np.float32) * 0.3, "W": n(2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32),
        "U": n(2, h, 3 * h) * 0.5, "a": n(2 * h, 1)[:, 0] * 0.3, "o": n(2 * h, 1)[:, 0], "c": np.full(1, -1.0, np.float32),
    }


def forward(net, xw, mask, keep=None):
    """Logits of windows. xw(t) -> [2, n, 3h] input parts at step t of either direction;
    mask [n, WINDOW] is 1 on words. keep collects what the backward pass needs."""
    n, h = len(mask), HIDDEN
    state = np.zeros((2, n, h), np.float32)
    outs = np.zeros((WINDOW, 2, n, h), np.float32)
    for t in range(WINDOW):
        x, u = xw(t), np.matmul(state, net["U"])
        m = np.stack([mask[:, t], mask[:, WINDOW - 1 - t]])[:, :, None]
        g = x[:, :, : 2 * h] + u[:, :, : 2 * h]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :, :h], g[:, :, h:]
        c = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
        new = (state + z * (c - state)) * m
        if keep is not None:
            keep.append((state, u[:, :, 2 * h :], z, r, c, m))
        state = new
        outs[t, 0] = new[0]
        outs[WINDOW - 1 - t, 1] = new[1]
    seq = np.concatenate([outs[:, 0], outs[:, 1]], 2)  # [WINDOW, n, 2h]
    att = seq @ net["a"] + (mask.T - 1) * 1e4
    att -= att.max(0)
    att = np.exp(att)
    att /= att.sum(0)
    pooled = np.einsum("tn,tnk->nk", att, seq)
    logit = pooled @ net["o"] + net["c"][0]
    if keep is not None:
        keep.append((seq, att, pooled))
    return logit


def gradients(net, x, buckets, mask, y, weight):
    """Loss gradient of all weights for windows x [n, WINDOW, 3], buckets [n, WINDOW]."""
    h = HIDDEN
    full = np.concatenate([x, net["E"][buckets]], 2)  # [n, W, d]
    parts = np.einsum("nwd,kde->wkne", full, net["W"]) + net["b"]
    both = np.stack([parts[:, 0], parts[::-1, 1]], 1)
    keep: list = []
    logit = forward(net, lambda t: both[t], mask, keep)
    p = sigmoid(logit)
    dl = ((p - y) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
    seq, att, pooled = keep.pop()
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["o"], grad["c"] = pooled.T @ dl, dl.sum(keepdims=True)
    dp = dl[:, None] * net["o"]
    ds = att[:, :, None] * dp
    da = np.einsum("nk,tnk->tn", dp, seq)
    da = att * (da - (att * da).sum(0))
    grad["a"] = np.einsum("tn,tnk->k", da, seq)
    ds = ds + da[:, :, None] * net["a"]
    dh = np.zeros((2, len(x), h), np.float32)
    dboth = np.zeros_like(both)
    for t in range(WINDOW - 1, -1, -1):
        state, uc, z, r, c, m = keep[t]
        d = (dh + np.stack([ds[t, :, :h], ds[WINDOW - 1 - t, :, h:]])) * m
        dz, dc = d * (c - state) * z * (1 - z), d * z * (1 - c * c)
        dr = dc * uc * r * (1 - r)
        dx = np.concatenate([dz, dr, dc], 2)
        du = np.concatenate([dz, dr, dc * r], 2)
        grad["U"] += np.einsum("knh,kng->khg", state, du)
        dh = d * (1 - z) + np.matmul(du, net["U"].transpose(0, 2, 1))
        dboth[t] = dx
    parts = np.stack([dboth[:, 0], dboth[::-1, 1]], 1)  # [W, 2, n, 3h]
    grad["b"] = parts.sum((0, 2))[:, None, :]
    grad["W"] = np.einsum("nwd,wkne->kde", full, parts)
    de = np.einsum("wkne,kde->nwd", parts, net["W"][:, 3:])
    np.add.at(grad["E"], buckets.ravel(), de.reshape(-1, EMBED))
    return grad, logit


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 2, epochs: int = 4) -> Model:
    """Learn from labelled texts.  A text is toxic if one of its windows is: each round
    takes the highest window of every text, and random ones of texts that are not."""
    rng = np.random.default_rng(SEED)
    labels = np.asarray(labels, np.int64)
    vocabulary = Vocabulary(1 << 60)
    lengths, ids, found = np.zeros(len(texts), np.int64), [], []
    for i, t in enumerate(texts):
        tokens = (t or "").encode("utf-8", "surrogatepass").split()
        lengths[i] = len(tokens)
        at, new, _ = vocabulary.number(tokens)
        ids.append(at.astype(np.int32))
        found += new
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    forms = [clean(w) for w in found]
    form_ids, distinct, _ = Vocabulary(1 << 60).number(forms)
    ids = (form_ids[ids] if len(ids) else ids).astype(np.int32)
    del found, forms, form_ids, vocabulary
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    pair = np.unique(owner * max(1, len(distinct)) + ids)
    doc, form = pair // max(1, len(distinct)), (pair % max(1, len(distinct))).astype(np.int32)
    del owner, pair
    c1 = np.bincount(form, labels[doc], max(1, len(distinct)))
    c0 = np.bincount(form, 1 - labels[doc], max(1, len(distinct)))
    g, count = grams(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    start = np.cumsum(count) - count
    g1, g0 = np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)
    for own_forms, y in zip(np.split(form, np.flatnonzero(np.diff(doc)) + 1), labels[np.unique(doc)], strict=True) if len(form) else ():
        (g1 if y else g0)[np.unique(g[ragged(start[own_forms], count[own_forms])])] += 1
    odds = dict(zip(distinct, log_odds(c1[: len(distinct)], c0[: len(distinct)], n1, n0), strict=True))
    odds.pop(b"", None)
    odds = {f: float(o) for f, o in odds.items() if o}  # others count as 0
    gram_odds = log_odds(g1, g0, n1, n0)
    # what a document itself adds to the statistics is taken out of its own inputs
    own = []
    for y in (0, 1):
        o = log_odds(np.maximum(c1 - y, 0), np.maximum(c0 - (1 - y), 0), max(1, n1 - y), max(1, n0 - 1 + y))[: len(distinct)]
        o = np.where(np.array([len(f) > 0 for f in distinct], bool), o, 0) if distinct else o
        own.append(features(distinct, o, log_odds(np.maximum(g1 - y, 0), np.maximum(g0 - 1 + y, 0), max(1, n1 - y), max(1, n0 - 1 + y))))
    net = start_net(rng)
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        net["o"][:] = 0
        return Model({}, np.zeros(GRAMS), net, (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    wdoc, wstart, wlen = windows_of(lengths)
    offsets = np.arange(WINDOW)
    wids = ids[np.minimum(wstart[:, None] + offsets, max(0, len(ids) - 1))]
    wmask = (offsets < wlen[:, None]).astype(np.float32)
    del g, start, count, doc, form
    wy = labels[wdoc]
    x_of = lambda w: np.where(wy[w][:, None, None] == 1, own[1][0][wids[w]], own[0][0][wids[w]])
    parts = [np.arange(s, min(s + 4096, len(wdoc))) for s in range(0, len(wdoc), 4096)]
    hot = np.concatenate([(x_of(w)[:, :, :2].max(2) * wmask[w]).max(1) for w in parts])  # first guess of a text's highest window
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    score = hot
    for _ in range(rounds):
        order = np.lexsort((score, wdoc))
        top = order[np.append(wdoc[order][1:] != wdoc[order][:-1], True)]
        other = np.flatnonzero(wy == 0)
        take = np.concatenate([top, rng.choice(other, min(len(other), len(top)), replace=False)])
        weight = np.where(wy[take] == 1, 0.5 / max(1, (wy[take] == 1).sum()), 0.5 / max(1, (wy[take] == 0).sum())) * len(take)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(take)), max(1, len(take) // 256)):
                w = take[part]
                grad, _ = gradients(net, x_of(w), own[0][1][wids[w]], wmask[w], wy[w], weight[part])
                step += 1
                for k, gk in grad.items():
                    m, v = adam[k]
                    m += 0.1 * (gk - m)
                    v += 0.01 * (gk * gk - v)
                    net[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        score = np.concatenate([score_own(net, own, wids[w], wmask[w], wy[w]) for w in parts])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, wdoc, score)
    # a, b of sigmoid(a * highest logit + b): Newton steps of a slightly damped logistic fit
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * best + b)
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * best * best).sum() + 1e-2, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hess, np.array([((labels - p) * best).sum() - 1e-2 * (a - 1), (labels - p).sum()]))
        a, b = a + np.clip(move[0], -0.5, 0.5), b + np.clip(move[1], -0.5, 0.5)
    return Model(odds, gram_odds, net, (float(a), float(b)))


def tables(net, x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Input parts of either direction for each form: [2, forms, 3h]."""
    return (np.matmul(np.concatenate([x, net["E"][bucket]], 1).astype(np.float32), net["W"]) + net["b"]).astype(np.float32)


def score_windows(net, table, ids, mask):
    return forward(net, lambda t: np.stack([table[0][ids[:, t]], table[1][ids[:, WINDOW - 1 - t]]]), mask)


def score_own(net, own, ids, mask, y):
    """The same for training windows, whose inputs leave out their own document; tables hold
    the forms of these windows only."""
    some, at = np.unique(ids, return_inverse=True)
    by_label = [tables(net, x[some], bucket[some]) for x, bucket in own]
    out, at = np.zeros(len(y), np.float32), at.reshape(ids.shape)
    for k in (0, 1):
        rows = np.flatnonzero(y == k)
        if len(rows):
            out[rows] = score_windows(net, by_label[k], at[rows], mask[rows])
    return out


def scorer(model: Model):
    """Function of a list of texts giving the score of each, by its highest window."""
    vocabulary, hold = Vocabulary(120_000), {"table": np.zeros((2, 0, 3 * HIDDEN), np.float32)}

    def score(texts: list) -> np.ndarray:
        tokens = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids, found, fresh = vocabulary.number([w for t in tokens for w in t])
        if found:
            new = tables(model.net, *model.inputs([clean(w) for w in found]))
            hold["table"] = new if fresh else np.concatenate([hold["table"], new], 1)
        ids = np.append(ids, 0)
        table = hold["table"] if hold["table"].shape[1] else np.zeros((2, 1, 3 * HIDDEN), np.float32)
        doc, start, size = windows_of(lengths)
        best = np.full(len(texts), -np.inf)
        offsets = np.arange(WINDOW)
        for s in range(0, len(doc), 4096):
            w = ids[np.minimum(start[s : s + 4096, None] + offsets, len(ids) - 1)]
            mask = (offsets < size[s : s + 4096, None]).astype(np.float32)
            np.maximum.at(best, doc[s : s + 4096], score_windows(model.net, table, w, mask))
        return sigmoid(model.scale[0] * best + model.scale[1])

    return score


def fold(column, n: int):
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """A model trained, in one task, on at most MAX_POSITIVE + MAX_NEGATIVE labelled texts
    of at most MAX_BYTES for either label, outside the held-out fold."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold("doc_id", 5) != 0).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    ids = known.filter("toxic = 1").orderBy("h", "doc_id").limit(MAX_POSITIVE).unionAll(known.filter("toxic = 0").orderBy("h", "doc_id").limit(MAX_NEGATIVE))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    texts = texts.withColumn("size", size).filter(F.col("size") <= MAX_TEXT)
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("h", "doc_id", "size"))
    texts = texts.withColumn("so_far", so_far).filter(F.col("so_far") <= MAX_BYTES).select("h", "doc_id", "toxic", "text")

    def run(batches):
        pdf = pd.concat([pd.DataFrame({"h": [], "doc_id": [], "toxic": [], "text": []}), *batches])
        pdf = pdf.sort_values(["h", "doc_id", "text"], na_position="first").drop_duplicates("doc_id")
        texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy(np.int64)
        del pdf
        yield pd.DataFrame({"model": [pickle.dumps(train(texts, toxic))]})

    row = texts.repartition(1).mapInPandas(tidy(run), "model binary").first()  # none for an empty table
    return bytes(row["model"]) if row else pickle.dumps(train([], np.zeros(0, np.int64)))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of docs with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    The network reads word and character inputs of windows of WINDOW words, STRIDE apart,
    over the whole text; the highest window decides.  It learns from a bounded sample
    (MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES; none over MAX_TEXT) of labelled texts outside
    the held-out fold; labels, language, source and id are no inputs.  Null and empty texts get the score of an
    empty window; a null doc_id is not held out; labels that are null or not 0 or 1 are
    ignored, of several for a document the highest holds.  Without both labels in the
    sample every score is the share of toxic ones.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("tox_score", "tox_held_out", "tox_predicted")
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        score = scorer(pickle.loads(model.value))
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column("text").to_pylist()})
            out = np.zeros(len(texts))
            for a, b in chunks(texts):
                out[a:b] = score(texts["text"].iloc[a:b].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "tox_score"])

    out = docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("tox_score", DoubleType())]))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.withColumn("tox_held_out", held).withColumn("tox_predicted", F.when(F.col("tox_score") >= 0.5, 1).otherwise(0))
