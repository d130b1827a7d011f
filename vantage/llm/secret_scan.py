"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from vantage.llm.common import chunks, small_batches, stage, tidy

#: Documents that labelled findings are taken from, by hash, and findings, at most; bytes
#: of those documents and of one of them, at most.
MAX_DOCS, MAX_FINDINGS, MAX_BYTES, MAX_TEXT = 3000, 4000, 24 << 20, 2 << 20
#: The dictionary: words with at least 1 / COMMON of all words (so at most COMMON words).
COMMON = 1 << 17
TREES, DEPTH, LEAF, SEED = 40, 8, 2, 11
MASK = "[SECRET]"
#: Runs of 12 or more token characters with a digit, or of 16 or more capitals.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z+/_\-]*+[0-9][A-Za-z0-9+/_\-]*+={0,2}|(?<![A-Za-z0-9+/_\-])[A-Z]{16,}+(?![A-Za-z0-9+/_\-])")
LEAST = 12
_BEFORE = re.compile(r"([^\s\"'=:]*)[\s\"']*([=:]?)[\s\"']*$")
_NEXT = re.compile(r"[\s\"']*(\S{0,40})")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Kinds of characters: digit, capital, small letter, other.
_KIND = np.array([0 if chr(i).isdigit() else 1 if chr(i).isupper() else 2 if chr(i).islower() else 3 for i in range(128)], np.uint8)
_HEX = np.array([chr(i) in "0123456789abcdefABCDEF" for i in range(128)])
#: Words whose assigned value a labelling rule takes for a secret.
KEYWORDS = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "auth")
FEATURES = ("length", "transitions", "digits", "capitals", "hex", "entropy", "bigrams", "coverage", "assigned", "quoted", "before", "after", "path")


def candidates(text: str):
    """(start, end, value, word before, whether assigned, whether quoted, word after)."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < LEAST:
            continue
        value = m.group()
        word, sign = _BEFORE.search(text[max(0, a - 40) : a]).groups()
        yield a, b, value, word.lower(), bool(sign), text[a - 1 : a] in "\"'" and a > 0, _NEXT.match(text, b).group(1).lower()


def rule_label(value: str, before: str, assigned: bool) -> int | None:
    """Labels of findings for training: 1 for known key formats and values assigned to a
    credential word, 0 for plain numbers and plain words, None where no rule speaks."""
    if re.fullmatch(r"(AKIA|ASIA)[A-Z0-9]{16}", value) or re.fullmatch(r"gh[pousr]_[A-Za-z0-9]{36}", value):
        return 1
    if assigned and before.endswith(KEYWORDS) and re.search(r"\d", value) and re.search(r"[A-Za-z]", value):
        return 1
    if re.fullmatch(r"[0-9\-/_+]+", value) or re.fullmatch(r"[A-Za-z\-/_+]+", value):
        return 0
    return None


class Knowledge:
    """Statistics behind the features: dictionary, letter pairs of prose, odds of words and
    paths.  pairs [128, 128] counts neighbouring characters of all words."""

    def __init__(self, dictionary: set[str], pairs: np.ndarray):
        self.dictionary = dictionary
        #: lengths of words, longest first, by their first three letters
        self.lengths: dict[str, list[int]] = {}
        for head, n in sorted({(w[:3], len(w)) for w in dictionary}, key=lambda x: (x[0], -x[1])):
            self.lengths.setdefault(head, []).append(n)
        self.pairs = np.log((pairs + 0.5) / (pairs.sum() + 1)).astype(np.float32)
        self.odds: dict[tuple[str, str], tuple[int, int]] = {}
        self.totals = (1, 1)

    def learn(self, found: list[tuple], labels: list[int]) -> None:
        for f, y in zip(found, labels, strict=True):
            for k in (("before", f[3]), ("after", f[6]), ("path", f[7])):
                n0, n1 = self.odds.get(k, (0, 0))
                self.odds[k] = (n0 + (y == 0), n1 + (y == 1))
        self.totals = (labels.count(0) + 1, labels.count(1) + 1)

    def odd(self, k: tuple[str, str], own: int | None) -> float:
        n0, n1 = self.odds.get(k, (0, 0))
        n0, n1 = n0 - (own == 0), n1 - (own == 1)  # without the finding itself
        t = sum(self.totals)
        return float(np.log((n1 + self.totals[1] / t) / self.totals[1]) - np.log((n0 + self.totals[0] / t) / self.totals[0]))

    def coverage(self, value: str) -> float:
        """The share of characters in dictionary words of any length, taken from the left,
        the longest word at each place first."""
        low, covered, i = value.lower(), 0, 0
        while i < len(low):
            n = next((n for n in self.lengths.get(low[i : i + 3], ()) if i + n <= len(low) and low[i : i + n] in self.dictionary), 0)
            covered += n
            i += n or 1
        return covered / max(1, len(low))

    def features(self, f: tuple, own: int | None = None) -> list[float]:
        _, _, value, before, assigned, quoted, after, path = f
        n = len(value)
        raw = np.frombuffer(value.encode("ascii"), np.uint8)
        low = np.frombuffer(value.lower().encode("ascii"), np.uint8)
        kinds = _KIND[raw]
        counts = np.bincount(raw)
        counts = counts[counts > 0] / n
        return [
            n, np.count_nonzero(kinds[1:] != kinds[:-1]) / n, np.count_nonzero(kinds == 0) / n, np.count_nonzero(kinds == 1) / n,
            float(_HEX[raw].all()), float(-(counts * np.log2(counts)).sum()),
            float(self.pairs[low[:-1], low[1:]].sum(dtype=np.float64)) / max(1, n - 1), self.coverage(value),
            float(assigned), float(quoted), self.odd(("before", before), own), self.odd(("after", after), own),
            self.odd(("path", path), own),
        ]


class Forest:
    """Random forest of Gini trees in numpy; deterministic for given rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.trees = [self.grow(x, y, rng) for _ in range(TREES)] if len(y) and y.min() != y.max() else []
        self.share = float(y.mean()) if len(y) else 0.0

    def grow(self, x, y, rng):
        # the same number of rows of either label in each tree, as labels may be uneven
        ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        k = max(1, min(len(y) // 2, 1000))
        rows = np.concatenate([rng.choice(ones, k), rng.choice(zeros, k)])
        nodes: list[list] = []

        def split(rows, depth):
            at = len(nodes)
            share = y[rows].mean()
            nodes.append([-1, 0.0, -1, -1, share])
            if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
                return at
            best = (share * (1 - share) * len(rows) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 0.5)), replace=False):
                v = x[rows, f]
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 15))):
                    left = v <= cut
                    a, b = left.sum(), (~left).sum()
                    if a < LEAF or b < LEAF:
                        continue
                    p, q = y[rows[left]].mean(), y[rows[~left]].mean()
                    cost = p * (1 - p) * a + q * (1 - q) * b
                    if cost < best[0]:
                        best = (cost, int(f), float(cut))
            if best[1] is None:
                return at
            left = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = split(rows[left], depth + 1)
            nodes[at][3] = split(rows[~left], depth + 1)
            return at

        split(rows, 0)
        t = np.array(nodes)
        return t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.share)
        out = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                go = feature[at] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(go, np.where(low, left[at], right[at]), at)
            out += share[at]
        return out / len(self.trees)


class Scanner:
    def __init__(self, knowledge: Knowledge, forest: Forest):
        self.knowledge, self.forest = knowledge, forest

    def scan(self, texts: list, paths: list) -> list[list[tuple[int, int, float]]]:
        """(start, end, probability) of every candidate of every text."""
        found, owner = [], []
        for i, (t, p) in enumerate(zip(texts, paths, strict=True)):
            for c in candidates(t or ""):
                found.append((*c, p or ""))
                owner.append(i)
        out: list[list] = [[] for _ in texts]
        for s in range(0, len(found), 5000):
            part = found[s : s + 5000]
            prob = self.forest.predict(np.array([self.knowledge.features(f) for f in part]))
            for i, f, p in zip(owner[s : s + 5000], part, prob.tolist(), strict=True):
                out[i].append((f[0], f[1], p))
        return out


def train(know: Knowledge, texts: list[str], paths: list[str], given: list[dict[int, int] | None]) -> Scanner:
    """given: of each text the labels by start, or None where rules label its findings."""
    found, y = [], []
    for t, p, own in zip(texts, paths, given, strict=True):
        for c in candidates(t):
            label = rule_label(c[2], c[3], c[4]) if own is None else own.get(c[0])
            if label is not None and len(y) < MAX_FINDINGS:
                found.append((*c, p))
                y.append(label)
    know.learn(found, y)
    x = np.array([know.features(f, own) for f, own in zip(found, y, strict=True)]) if found else np.zeros((0, len(FEATURES)))
    return Scanner(know, Forest(x, np.array(y)))


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, n) over all documents: runs of three or more letters, in lower case."""

    def run(batches):
        seen: Counter = Counter()

        def frame():
            out = pd.DataFrame({"word": pd.Series(list(seen.keys()), dtype=object), "n": list(seen.values())})
            seen.clear()
            return out

        for pdf in batches:
            for a, b in chunks(pdf):
                for t in pdf["text"].iloc[a:b]:
                    seen.update(_LETTERS.findall((t or "").lower()))
                if len(seen) > flush:
                    yield frame()
        yield frame()

    return docs.select("text").mapInPandas(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def knowledge(docs: DataFrame) -> Knowledge:
    """Dictionary and letter pairs, counted over all documents."""
    counts = stage(word_counts(docs), "sec-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counts.filter(F.col("n") * F.lit(COMMON) >= F.lit(total)).select("word").toPandas()

    def run(batches):
        out = np.zeros(128 * 128, np.int64)
        for pdf in batches:
            pdf = pdf[pdf["word"].map(str.isascii)]
            size = pdf["word"].map(len).to_numpy(np.int64)
            raw = np.frombuffer("".join(pdf["word"]).encode(), np.uint8).astype(np.int64)
            inside = np.ones(len(raw), bool)
            inside[np.cumsum(size) - 1] = False  # the last of a word has none after it
            at = np.flatnonzero(inside)
            np.add.at(out, raw[at] * 128 + raw[at + 1], np.repeat(pdf["n"].to_numpy(np.int64), size)[at])
        some = np.flatnonzero(out)
        yield pd.DataFrame({"pair": some, "n": out[some]})

    got = counts.mapInPandas(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most 128 * 128 rows
    pairs = np.zeros(128 * 128, np.int64)
    pairs[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return Knowledge(set(common["word"]), pairs.reshape(128, 128))


def fit(docs: DataFrame, path: str, findings: DataFrame | None) -> bytes:
    """A scanner trained in one task from at most MAX_DOCS documents: those with labelled
    findings; or without such, to be labelled by rules, a third each of those with a run
    of capitals, with digits in a longer run, and with neither."""
    spark = docs.sparkSession
    know = spark.sparkContext.broadcast(pickle.dumps(knowledge(docs)))
    body = F.coalesce(F.col("text"), F.lit(""))
    kind = F.when(body.rlike("[A-Z]{16}"), "capitals").when(body.rlike(r"[0-9][A-Za-z0-9+/_\-]{5}"), "digits").otherwise("neither")
    if findings is None:
        kinds, rows = ("capitals", "digits", "neither"), docs.select("doc_id", kind.alias("kind"), F.octet_length(body).cast("long").alias("size"))
    else:
        labelled = findings.filter("label in (0, 1)").groupBy("doc_id").agg(F.collect_set(F.struct("start", "label")).alias("given"))
        kinds, rows = ("labelled",), docs.join(labelled.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("labelled").alias("kind"), F.octet_length(body).cast("long").alias("size"))
    rows = stage(rows.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).filter(F.col("size") <= MAX_TEXT), "sec-sizes")
    ids = None
    for k in kinds:
        some = rows.filter(F.col("kind") == k).orderBy("h", "doc_id", "size").limit(MAX_DOCS // len(kinds))
        some = some.withColumn("so_far", F.sum("size").over(Window.partitionBy("kind").orderBy("h", "doc_id", "size"))).filter(F.col("so_far") <= MAX_BYTES // len(kinds))
        ids = some.select("doc_id") if ids is None else ids.unionAll(some.select("doc_id"))
    texts = docs.join(F.broadcast(ids.distinct()), "doc_id").select("doc_id", body.alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    texts = texts.filter(F.octet_length("text") <= MAX_TEXT)
    if findings is not None:
        texts = texts.join(labelled, "doc_id")
    given = [] if findings is None else ["given"]

    def run(batches):
        pdf = pd.concat([pd.DataFrame({c: [] for c in ["doc_id", "text", "path", *given]}), *batches])
        pdf = pdf.sort_values(["doc_id", "text", "path"]).drop_duplicates(["doc_id", "text", "path"])
        own = [{r["start"]: r["label"] for r in rows} for rows in pdf["given"]] if given else [None] * len(pdf)
        yield pd.DataFrame({"model": [pickle.dumps(train(pickle.loads(know.value), pdf["text"].tolist(), pdf["path"].tolist(), own))]})

    row = texts.repartition(1).mapInPandas(tidy(run), "model binary").first()  # none for an empty table
    return bytes(row["model"]) if row else pickle.dumps(train(pickle.loads(know.value), [], [], []))


def scan(docs: DataFrame, path: str = "source", threshold: float = 0.5, findings: DataFrame | None = None) -> DataFrame:
    """docs with sec_findings (start, length, probability of every candidate, in code
    points), sec_secrets (those at or above threshold) and sec_text, the text with the
    secrets masked.

    Whole texts are scanned; each candidate, as a whole, is judged by length, character
    transitions, dictionary coverage (words of any length), path (the odds of its labels) and
    neighbouring words, of which the 40 nearest characters are read.  Candidates are runs of
    12 or more token characters that hold a digit, or of 16 or more capitals: a password of
    letters alone is none.  Dictionary and letter pairs are counted over all documents.  The forest learns from labelled findings: those
    of findings (doc_id, start, label 0 or 1), or, where no such table is given, those that
    rules label; of a bounded sample (MAX_DOCS, MAX_FINDINGS, MAX_BYTES; texts of at most
    MAX_TEXT bytes).  A null text stays null with no findings; a null path is empty; a null
    doc_id is scanned like any other; repeated rows give repeated results; without findings
    of both labels the probability is the share of secrets among the labelled ones (0 if
    there are none).  Columns of docs named like the three new ones are replaced.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("sec_findings", "sec_secrets", "sec_text")
    model = spark.sparkContext.broadcast(fit(docs, path, findings))
    finding = StructType([StructField("start", LongType()), StructField("length", IntegerType()), StructField("probability", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField("sec_findings", ArrayType(finding)), StructField("sec_secrets", IntegerType()), StructField("sec_text", StringType())])

    def run(batches):
        scanner = pickle.loads(model.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scanner.scan(texts, [None if p is None else str(p) for p in batch.column(path).to_pylist()])
            masked = []
            for t, f in zip(texts, found, strict=True):
                parts, at = [], 0
                for a, b, p in f:
                    if p >= threshold:
                        parts += [t[at:a], MASK]
                        at = b
                masked.append("".join([*parts, t[at:]]) if parts else t)
            new = [
                pa.array([[{"start": a, "length": b - a, "probability": p} for a, b, p in f] for f in found], kind),
                pa.array([sum(p >= threshold for _, _, p in f) for f in found], pa.int32()), pa.array(masked, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "sec_findings", "sec_secrets", "sec_text"])

    return docs.mapInArrow(tidy(run), schema)
