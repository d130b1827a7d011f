"""Every operator on null ids, repeated rows, very long and empty texts, and extra columns
whose names its own work uses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text import prose
from vantage.llm import chat, embeddings, jaccard, lm, media, mixing, pieces, secret_scan, sharding, toxicity

CLASH = ("sec_text", "sec_findings", "tox_score", "m_prob", "m_topic", "m_vector", "component_id", "rep", "score", "ids", "row", "key", "h", "frac", "rank", "slot", "n_tokens", "feature", "label", "part", "variant", "no_id", "held_out", "topic")
LONG = "ab1234567890cd; \n" * 40_000 + "word " * 60_000  # 980,000 characters


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    texts = [prose(rng, 20) for _ in range(24)] + [None, "", " \n", LONG, "same text here now", "same text here now", "no id at all", "no id at all"]
    ids = [*range(28), 28, 28, None, None]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(24)] + [(None, 1, 1), (28, 0, 0), (28, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, m: secret_scan.scan(d), "op2": lambda d, m: lm.rate(d), "op3": lambda d, m: pieces.encode(d), "op5": lambda d, m: toxicity.rate(d, m), "op6": lambda d, m: sharding.interleave(d),
    "op7": lambda d, m: media.media(d), "op8": lambda d, m: jaccard.join(d)[0], "op10": lambda d, m: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, table, marks, name):
    out = OPERATORS[name](table, marks)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(rows) == 32 and ids.count(None) == 2 and ids.count(28) == 2 and sorted(i for i in ids if i is not None) == sorted([*range(28), 28, 28])
    skip = {"slot", "shard"}
    value = lambda r: tuple(str(r[c]) for c in out.columns if c not in skip)
    assert len({value(r) for r in rows if r.doc_id == 28}) == 1  # equal rows, equal results
    if name != "op6":
        assert len({value(r) for r in rows if r.doc_id is None}) == 1
    own = {"op1": "tox_score", "op5": "m_prob", "op10": "sec_text"}.get(name)
    if own:  # operators that hand rows on keep the caller's columns
        assert {r[own] for r in rows} == {f"own {own}"}
    long = next(r for r in rows if r.doc_id == 27)
    if name == "op1":
        assert len(long.sec_findings) == 40_000
    if name == "op2":
        assert long.n_tokens == 100_001 and np.isfinite(long.score)
    if name == "op3":
        assert long.lossless and all(r.lossless for r in rows)
    if name == "op5":
        assert all(0 <= r.tox_score <= 1 for r in rows)
    if name == "op6":
        assert long["size"] == len(LONG) + 8
    if name == "op7":
        assert long.n_bytes == len(LONG) and long.payload_bytes % 192 == 0 and "|" in long.feature
    if name == "op8":
        assert {r.component_id for r in rows if r.doc_id == 28} == {28} and {r.component_id for r in rows if r.doc_id is None} == {None}
    if name == "op10":
        assert long.m_tokens == 100_000 and {r.m_topic for r in rows if r.doc_id in (24, 25, 26)} == {"none"}


def test_hard_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("leaf", "ball", "rep", "task")})
    got = embeddings.near_dedup(df).collect()
    assert sorted((r.vec_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]


def test_hard_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 300_000), (None, 0, "user", "q"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("formatted", "layout", "turns", "loss_spans")})
    done = chat.format_conversations(df).select("conv_id", chat.parse(F.col("formatted")).alias("back")).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.back] for r in done}
    assert got[1] == [("user", "hi"), ("user", "hi"), ("assistant", "x" * 300_000)] and got[None] == [("user", "q")] and len(got[2]) == 1
