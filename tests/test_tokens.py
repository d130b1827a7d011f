"""Token evidence against a plain reading, on tokens cut at any place."""

import random

from pyspark.sql import functions as F

from tests.plain_tokens import evidence
from vantage.functions import tokens

OPTIONS = [("take", ["red", "cup"]), ("put", ["bolt"]), ("wash", ["plate"]), ("hold", ["ring"])]
KIND = "id int, toks array<string>, probs array<double>, options array<struct<verb:string,noun:array<string>>>"


def cases():
    r = random.Random(8)
    pieces = ["<NOW>", "<STATE>", "INTERACTION", "</STATE>", "<ANS>", "A", "b", "</ANS>", " C ", "Dog", "ĠTake", "▁cup", "red", "bolt", "wash", "plate", "Ċ", "<", "ans>", "</ans", ">", "<an", "state", "</", "é", ".", "7", " d"]
    for i in range(700):
        if i % 2:
            text = "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
            cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(r.randint(0, 9)))})
            toks = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            toks = [r.choice(pieces) for _ in range(r.randint(0, 14))]
        probs = [r.random() for _ in toks] + ([0.5] if i % 31 == 0 else [])
        options = r.choice([None, [], OPTIONS, OPTIONS[:2], OPTIONS[:3] + [("take", ["ring"])], [("", []), ("put", []), ("x", ["red"])]])
        yield i, toks, probs, options
    yield 900, None, [0.1], OPTIONS
    yield 901, ["A"], None, OPTIONS


def test_evidence_equals_a_plain_reading(spark):
    rows = list(cases())
    df = spark.createDataFrame(rows, KIND).select("id", tokens.token_evidence(F.col("toks"), F.col("probs"), F.col("options")).alias("e"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {x.id: tuple(x.e) for x in df.collect()}
    for i, toks, probs, options in rows:
        named = None if options is None else [{"verb": v, "noun": n} for v, n in options]
        assert got[i] == evidence(toks, probs, named), (toks, options)
    assert {x[3] for x in got.values()} >= {"token_ans_span", "token_multi", "token_prefix", "token_none"} and {x[6] for x in got.values()} >= {"token_verbnoun_and", "token_verbnoun_or", "token_verbnoun_ambiguous"}
