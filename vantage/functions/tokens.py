"""Evidence in generated tokens: tag spans split over tokens, letters, verbs and nouns.

Tokens stay arrays; all of it is array expressions, with nothing run in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(low: Column, high: Column, holds: Callable[[Column], Column]) -> Column:
    """The first index from low to below high for which holds, else null."""
    return F.when(low < high, F.get(F.filter(F.sequence(low, high - 1), holds), F.lit(0)))


def plain(token: Column) -> Column:
    """A token without the marks that tokenizers put for blanks and line breaks."""
    for mark, meant in (("Ġ", " "), ("▁", " "), ("Ċ", "\n")):
        token = F.replace(token, F.lit(mark), F.lit(meant))
    return token


def mark_length(up: Column, i: Column, start: str, tag: str) -> Column:
    """How many tokens from i on hold <tag> or </tag>, which may be cut into up to three;
    null if they don't."""
    one, two, three = (F.coalesce(F.get(up, i + k), F.lit("")) for k in range(3))
    has = lambda token, part: F.contains(token, F.lit(part))
    more = lambda k: i + k < F.size(up)
    out = F.when(has(one, f"{start}{tag}>"), 1).when(more(2) & has(one, start) & has(two, tag) & has(three, ">"), 3)
    if start == "<":
        out = out.when(more(1) & has(one, start) & has(two, tag) & has(two, ">"), 2)
    return out.when(more(1) & has(one, start + tag) & has(two, ">"), 2)


def tag_span(up: Column, tag: str) -> Column:
    """Struct of begin and end, the range of tokens (in upper case) within the first
    <tag> .. </tag>; null without one."""
    first = first_of(F.lit(0), F.size(up), lambda i: mark_length(up, i, "<", tag).isNotNull())

    def rest(at: Column) -> Column:
        begin = at + mark_length(up, at, "<", tag)
        end = let(begin, lambda b: F.struct(b.alias("begin"), first_of(b, F.size(up), lambda j: mark_length(up, j, "</", tag).isNotNull()).alias("end")))
        return F.when(at.isNotNull(), end)

    return let(let(first, rest), lambda s: F.when(s["end"].isNotNull(), s))


def usable(tokens: Column, probs: Column) -> Column:
    return (F.size(tokens) > 0) & (F.size(tokens) == F.size(probs))


def within(span: Column, i: Column) -> Column:
    return (i >= span["begin"]) & (i < span["end"])


def state_of(up: Column, probs: Column) -> Column:
    return let(tag_span(up, "STATE"), lambda s: F.get(probs, first_of(s["begin"], s["end"], lambda i: F.get(up, i).rlike(r"[\p{L}\p{N}]"))))


def state_probability(tokens: Column, probs: Column) -> Column:
    """The probability of the first token with a letter or digit in the STATE span."""
    return F.when(usable(tokens, probs), let(F.transform(tokens, lambda t: F.upper(plain(t))), lambda up: state_of(up, probs)))


def one_letter(hits: Column, probs: Column, method: str, otherwise: Column) -> Column:
    """Struct of ans, prob, method from hits (letter, at): one letter, several, or none."""
    answer = lambda a, p, m: F.struct(a.alias("ans"), p.cast("double").alias("prob"), F.lit(m).alias("method"))
    kinds = F.size(F.array_distinct(F.transform(hits, lambda h: h["letter"])))
    first = F.get(hits, F.lit(0))
    return F.when(kinds == 1, answer(first["letter"], F.get(probs, first["at"]), method)).when(kinds > 1, answer(F.lit(""), F.lit(None), "token_multi")).otherwise(otherwise)


def token_answer(up: Column, probs: Column) -> Column:
    """One letter in the ANS span, else at the head before the first ``<``."""

    def hits(pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
        letters = F.transform(up, lambda t, i: F.struct(F.when(keep(i), F.regexp_extract(t, pattern, group)).alias("letter"), i.alias("at")))
        return F.filter(letters, lambda h: F.coalesce(h["letter"], F.lit("")) != "")

    none = F.struct(F.lit("").alias("ans"), F.lit(None).cast("double").alias("prob"), F.lit("token_none").alias("method"))
    head = F.coalesce(first_of(F.lit(0), F.size(up), lambda i: F.contains(F.get(up, i), F.lit("<"))), F.size(up))
    prefix = let(let(head, lambda n: hits(r"(?U)^\s*([A-D])\b", 1, lambda i: i < n)), lambda h: one_letter(h, probs, "token_prefix", none))
    spanned = let(tag_span(up, "ANS"), lambda s: F.when(s.isNotNull(), hits("[A-D]", 0, lambda i: within(s, i))))
    return let(spanned, lambda h: F.when(h.isNull(), prefix).otherwise(one_letter(h, probs, "token_ans_span", prefix)))


def token_options(tokens: Column, probs: Column, options: Column) -> Column:
    """The option whose verb and noun words are among the tokens: both are asked for where
    options share a verb or noun, else either; confidence is the mean over first hits."""
    answer = lambda a, p, m: F.struct(a.alias("ans"), p.cast("double").alias("prob"), F.lit(m).alias("method"))
    none, blank = F.lit(None), F.lit("")
    verbs, nouns = F.transform(options, lambda o: o["verb"]), F.transform(options, lambda o: F.array_join(o["noun"], " "))
    shared = (F.size(F.array_distinct(verbs)) < F.size(options)) | (F.size(F.array_distinct(nouns)) < F.size(options))

    def choose(words: Column) -> Column:
        known = F.transform(words, lambda w: w["word"])
        there = lambda w: F.coalesce(F.array_contains(known, w), F.lit(False))
        verb = lambda o: (F.coalesce(o["verb"], blank) != "") & there(o["verb"])
        noun = lambda o: (F.size(o["noun"]) > 0) & F.forall(o["noun"], there)
        fits = F.transform(F.slice(options, 1, 4), lambda o, i: F.when(F.when(shared, verb(o) & noun(o)).otherwise(verb(o) | noun(o)), i))
        prob = lambda w: F.get(probs, F.get(words, (F.array_position(known, w) - 1).cast("int"))["at"])

        def one(hits: Column) -> Column:
            o = F.get(options, F.get(hits, F.lit(0)))
            own = F.filter(F.concat(F.filter(F.array(o["verb"]), lambda v: F.coalesce(v, blank) != ""), o["noun"]), there)
            mean = F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, w: s + prob(w)), F.size(own))
            letter = F.substr(F.lit("ABCD"), F.get(hits, F.lit(0)) + 1, F.lit(1))
            found = F.when(shared, answer(letter, mean, "token_verbnoun_and")).otherwise(answer(letter, mean, "token_verbnoun_or"))
            return F.when(F.size(hits) == 1, found).otherwise(answer(blank, none, "token_verbnoun_ambiguous"))

        return let(F.filter(fits, lambda i: i.isNotNull()), one)

    words = F.flatten(F.transform(tokens, lambda t, i: F.transform(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.struct(w.alias("word"), i.alias("at")))))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, let(words, choose)).otherwise(answer(blank, none, "token_verbnoun_no_options"))


def token_evidence(tokens: Column, probs: Column, options: Column) -> Column:
    """Struct of the state's probability, the answer letter and the option by its words;
    without tokens, or with another number of probabilities, there is none.  The struct is
    the value of one expression, so its fields are not worked out again for each use."""

    def row(state: Column, a: Column, v: Column) -> Column:
        fields = [state.cast("double").alias("state_prob")]
        for x, head in ((a, "ans"), (v, "vn")):
            fields += [x["ans"].alias(head), x["prob"].alias(f"{head}_prob"), x["method"].alias(f"{head}_method")]
        return F.struct(*fields)

    def of(read: Column, up: Column) -> Column:
        return let(token_answer(up, probs), lambda a: let(token_options(read, probs, options), lambda v: row(state_of(up, probs), a, v)))

    nothing = lambda m: F.struct(F.lit("").alias("ans"), F.lit(None).cast("double").alias("prob"), F.lit(m).alias("method"))
    none = row(F.lit(None), nothing("token_none"), nothing("token_verbnoun_none"))
    found = let(F.transform(tokens, plain), lambda read: let(F.transform(read, F.upper), lambda up: of(read, up)))
    return F.when(usable(tokens, probs), found).otherwise(none)


def cascade(ev: Column, tagged: Column, guessed: Column, judged: Column | None = None) -> Column:
    """Struct of answer, method and confidence: token letter, token words, tag, guess, then
    judge.  After several token letters the text is still tried, and the method says so."""
    multi = ev["ans_method"] == "token_multi"
    name = lambda m: F.when(multi, F.concat(F.lit("token_multi+"), F.lit(m))).otherwise(F.lit(m))
    text = [(tagged, "tag"), (guessed, "clean")] + ([(judged, "judge")] if judged is not None else [])
    ans = F.when(ev["ans"] != "", ev["ans"]).when(~multi & (ev["vn"] != ""), ev["vn"])
    how = F.when(ev["ans"] != "", ev["ans_method"]).when(~multi & (ev["vn"] != ""), ev["vn_method"])
    conf = F.when(ev["ans"] != "", ev["ans_prob"]).when(~multi & (ev["vn"] != ""), ev["vn_prob"])
    for c, m in text:
        ans, how = ans.when(F.coalesce(c, F.lit("")) != "", c), how.when(F.coalesce(c, F.lit("")) != "", name(m))
    return F.struct(ans.otherwise("").alias("ans"), how.otherwise(F.when(multi, "token_multi").otherwise("none")).alias("method"), conf.alias("conf"))
