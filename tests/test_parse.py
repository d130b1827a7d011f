import re

import pytest
from pyspark.sql import functions as F

from vantage.functions import parse, tokens


def value(spark, expr, **columns):
    names = {"x": "", **columns}
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in names.items()])
    return df.select(expr.alias("out")).first().out


@pytest.mark.parametrize("text,official,legacy", [
    ("<ANS>B</ANS>", "B", "B"), ("<ans> b </ans>", "B", "B"), ("A or B", "", ""), ("Answer: C", "C", "C"), ("A. yes\nB. no", "", ""), ("take a cup", "A", ""), ("D) because", "D", "D"),
    ("", "", ""), ("nothing", "", ""), ("option = d", "D", "D"), ("<NOW>B", "B", "B"),
])
def test_answers(spark, text, official, legacy):
    assert value(spark, parse.answer(), response_text=text) == official
    assert value(spark, parse.answer(mode="legacy"), response_text=text) == legacy


def test_first_letter_rule_reads_tags_too(spark):
    assert value(spark, parse.letter("x", "legacy"), x="<ANS>D") == "A"
    assert value(spark, parse.letter("x"), x="A B") == ""


@pytest.mark.parametrize("text,state,method", [
    ("<STATE>no interaction</STATE>", "NO_INTERACTION", "tag"), ("<STATE>maybe</STATE> interaction", "INTERACTION", "clean_interaction"), ("no_interaction", "NO_INTERACTION", "clean_no_interaction"),
    ("interaction, no interaction", "INVALID", "clean_ambiguous"), ("?", "INVALID", "clean_none"), ("<STATE>1</STATE>", "INTERACTION", "tag"), (None, "INVALID", "missing_prediction"),
])
def test_states(spark, text, state, method):
    got = value(spark, parse.predicted_state("t"), t=text)
    assert (got.state, got.method) == (state, method)


def test_tags(spark):
    assert value(spark, parse.tag_value("x", "A"), x="<a>\n 1 </ A >") == "1"
    assert value(spark, parse.tag_value("x", "A"), x="<A></A>") == ""
    assert value(spark, parse.tag_value("x", "A"), x="none") is None
    assert value(spark, parse.tag_map("x"), x="<A>1</A><b>2</b><A>3</A>") == {"A": "1", "B": "2"}
    assert value(spark, parse.stated_confidence("x"), x="<CONF>1.5</CONF>") == 1.0
    assert value(spark, parse.stated_confidence("x"), x="<CONF>high</CONF>") is None


def test_steps_and_groups(spark):
    df = spark.createDataFrame([(None, 16.0005), (2, None), (7, 8.01), (None, None)], "s int, sec double")
    assert [r[0] for r in df.select(parse.step_of("s", "sec")).collect()] == [1, 2, None, None]
    assert value(spark, parse.group_of("x"), x=" np ") == "surprise_only"
    assert value(spark, parse.group_of("x"), x="?") == "unknown"


def test_options(spark):
    got = value(spark, parse.options_of_prompt("x"), x="Choose:\nA. YOU take_up small_(tiny) ring\n B) YOU none none")
    assert got["A"].verb == "take" and got["A"].noun == "small" and got["B"].noun == "none"
    o = F.array(F.lit("YOU take ring"), F.lit("YOU hold bolt"))
    assert value(spark, parse.option_match("x", o), x="they hold a bolt").letter == "B"
    assert value(spark, parse.option_match("x", o), x="take ring hold bolt").multi


def test_distribution(spark):
    d = value(spark, parse.choice_distribution(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(0.0))))
    assert d.mass == 5.0 and d.best == "B" and abs(d.p[1] - 0.4) < 1e-12
    assert value(spark, parse.choice_distribution(F.array(F.lit(0.0), F.lit(0.0)))).best is None


def test_token_spans(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    t = ["<", "STATE", ">", " no", "inter", "</", "STATE", ">"]
    assert tuple(value(spark, tokens.tag_span(lit(t), "STATE"))) == (3, 5)
    assert value(spark, tokens.tag_span(lit(["<STATE>", "x"]), "STATE")) is None
    assert tuple(value(spark, tokens.token_answer(lit(["B", "<X>"]), lit([0.4, 0.1])))) == ("B", 0.4, "token_prefix")
    assert value(spark, tokens.token_answer(lit(["<ANS>", "A", "C", "</ANS>"]), lit([0.1] * 4))).method == "token_multi"
    o = F.array(*[F.struct(F.lit(v).alias("verb"), lit([n]).alias("noun")) for v, n in [("take", "ring"), ("take", "bolt"), ("put", "cup"), ("wash", "cup")]])
    assert tuple(value(spark, tokens.token_options(lit(["take", " bolt"]), lit([0.2, 0.4]), o))) == ("B", pytest.approx(0.3), "token_verbnoun_and")
    none = F.array().cast("array<double>")
    assert value(spark, tokens.token_evidence(lit(["a"]), none, o)).ans_method == "token_none"


def test_cascade_keeps_trying_after_several_letters(spark):
    ev = tokens.token_evidence(F.array(F.lit("A"), F.lit("B")), F.array(F.lit(0.5), F.lit(0.5)), F.lit(None).cast("array<struct<verb:string,noun:array<string>>>"))
    got = value(spark, tokens.cascade(ev, F.lit(""), F.lit("C")))
    assert (got.ans, got.method) == ("C", "token_multi+clean")


def test_fixed_lists_are_plain():
    assert parse.GROUPS["PP"] == "branch_and_surprise" and re.fullmatch("[A-D]{4}", parse.LETTERS)
