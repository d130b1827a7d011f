"""Column expressions that read model text: tags, letters, states, confidences, options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the answer format.
LETTERS = "ABCD"
GROUPS = {"NN": "predictable", "PN": "branch_only", "NP": "surprise_only", "PP": "branch_and_surprise"}
STEP_SECONDS = (8.0, 16.0, 24.0)
STATES = ("INTERACTION", "NO_INTERACTION")


def lit_or_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(lit_or_col(c), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def tag_value(text, tag: str) -> Column:
    """What the first <tag>..</tag> holds, stripped; null where there is no such tag."""
    rx = rf"(?is)<\s*{tag}\s*>(.*?)<\s*/\s*{tag}\s*>"
    return strip(F.try_element_at(F.regexp_extract_all(lit_or_col(text), F.lit(rx), F.lit(1)), F.lit(1)))


def tag_block(text, tags=("NOW", "PAST", "FUTURE")) -> Column:
    """The first of the blocks that the text holds, tags included, blanks squeezed."""
    rx = rf"(?is)<\s*({'|'.join(tags)})\s*>.*?<\s*/\s*\1\s*>"
    first = F.try_element_at(F.regexp_extract_all(lit_or_col(text), F.lit(rx), F.lit(0)), F.lit(1))
    return strip(F.regexp_replace(first, r"(?U)\s+", " "))


def tag_map(text) -> Column:
    """All innermost tags of the text, in capitals, with their values; the first wins."""
    rx = r"(?is)<\s*([A-Za-z]+)\s*>([^<]*)<\s*/\s*\1\s*>"
    t = lit_or_col(text)
    names = F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), F.upper)
    values = F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(2)), strip)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    keep = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(keep)


def one_of(hits: Column) -> Column:
    """The one distinct element, else null."""
    return let(F.array_distinct(hits), lambda d: F.when(F.size(d) == 1, F.try_element_at(d, F.lit(1))))


def found_letter(value, mode: str = "official") -> Column:
    """letter(), or null where there is none."""
    s = F.upper(strip(lit_or_col(value).cast("string")))
    if mode == "legacy":
        return let(F.regexp_extract(s, "[A-D]", 0), lambda x: F.when(x != "", x))
    return let(s, lambda x: F.when(x.isin(*LETTERS), x).otherwise(one_of(F.regexp_extract_all(x, F.lit(r"(?U)\b([A-D])\b"), F.lit(1)))))


def letter(value, mode: str = "official") -> Column:
    """Answer letter of a short value.  official: the value is a letter, or exactly one
    distinct letter stands in it as a word; legacy: the first of A-D anywhere."""
    return F.coalesce(found_letter(value, mode), F.lit(""))


def found_guess(text, mode: str = "official") -> Column:
    """guess(), or null where there is none."""
    flag = "(?i)" if mode == "official" else ""

    def read(t):
        find = lambda rx: F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), F.upper)
        hits = F.concat(
            find(flag + r"(?:^|\n)\s*([A-D])\s*[\.\)]\s*"),
            find(r"(?i)\b(?:CHOOSE|ANSWER|ANS|OPTION)\s*[:=\-]?\s*([A-D])\b"),
            find(flag + r"(?U)\b([A-D])\b"),
        )
        starters = F.array_distinct(find(flag + r"(?:^|\n)\s*([A-D])\s*[\.\)\|]\s*"))
        return F.when(F.size(starters) < 2, one_of(hits))

    return let(F.regexp_replace(F.coalesce(lit_or_col(text), F.lit("")), "<[^>]*>", " "), read)


def guess(text, mode: str = "official") -> Column:
    """Answer letter of free text without tags: all of line starters, letters after words
    such as ANSWER and letters that stand alone must agree.  official: letters of either
    case count; legacy: capitals, but for those after such words."""
    return F.coalesce(found_guess(text, mode), F.lit(""))


def answer(parsed=None, texts=("response_text",), chosen=(), tokens=None, mode: str = "official") -> Column:
    """Predicted letter: parsed fields, then letters chosen by the probe, then for each
    text its ANS tag and a guess, then the same of the first twenty tokens."""
    steps = []
    if parsed is not None:
        steps += [found_letter(F.try_element_at(lit_or_col(parsed), F.lit(k)), mode) for k in ("ans", "answer", "ANS", "ANSWER")]
    steps += [found_letter(c, mode) for c in chosen]
    bodies = [lit_or_col(t) for t in texts]
    if tokens is not None:
        bodies.append(F.array_join(F.slice(lit_or_col(tokens), 1, 20), " "))
    for t in bodies:
        steps += [found_letter(tag_value(t, "ANS"), mode), found_guess(t, mode)]
    return F.coalesce(*steps, F.lit(""))


def truth_letter(*sources: tuple) -> Column:
    """True letter: for each source (answer, ans, index; None where it lacks one) in turn
    the letter of its answer, else of its ans, else of its index 0 to 3."""
    steps = []
    for answer_col, ans_col, index_col in sources:
        steps += [found_letter(c) for c in (answer_col, ans_col) if c is not None]
        if index_col is not None:
            i = lit_or_col(index_col).try_cast("int")
            steps.append(F.when(i.between(0, 3), F.substr(F.lit(LETTERS), i + 1, F.lit(1))))
    return F.coalesce(*steps, F.lit(""))


def state_of(value) -> Column:
    """INTERACTION, NO_INTERACTION or UNKNOWN of a short value."""
    return let(F.replace(F.lower(strip(F.coalesce(lit_or_col(value).cast("string"), F.lit("")))), F.lit(" "), F.lit("_")), lambda s: (
        F.when(s == "", "UNKNOWN").when(F.contains(s, F.lit("no_interaction")), "NO_INTERACTION").when(F.contains(s, F.lit("interaction")), "INTERACTION")
        .when(s.isin("no", "none", "null", "0"), "NO_INTERACTION").when(s.isin("yes", "1"), "INTERACTION").otherwise("UNKNOWN")
    ))


def predicted_state(response, clean=None, official: bool = True) -> Column:
    """Struct of state and method: the STATE tag (of the response; official also of the
    clean text), else the clean text if it names exactly one state.  Without response and
    clean text the method is missing_prediction."""
    r = F.coalesce(lit_or_col(response), F.lit(""))
    c = r if clean is None else F.coalesce(blank_to_null(lit_or_col(clean)), r)
    tag = tag_value(r, "STATE")
    raw = F.coalesce(blank_to_null(tag), tag_value(c, "STATE")) if official and clean is not None else tag
    absent = lit_or_col(response).isNull() & (F.lit(True) if clean is None else lit_or_col(clean).isNull())

    def read(x):
        no, yes = x["c"].rlike(r"(?i)\bno[_ ]interaction\b"), x["c"].rlike(r"(?i)(?<!no[_ ])\binteraction\b")
        own = F.struct(F.when(no & yes, "INVALID").when(no, "NO_INTERACTION").when(yes, "INTERACTION").otherwise("INVALID").alias("state"), F.when(x["absent"], "missing_prediction").when(no & yes, "clean_ambiguous").when(no, "clean_no_interaction").when(yes, "clean_interaction").otherwise("clean_none").alias("method"))
        return F.when(x["tagged"].isin(*STATES), F.struct(x["tagged"].alias("state"), F.lit("tag").alias("method"))).otherwise(own)

    return let(F.struct(c.alias("c"), state_of(raw).alias("tagged"), absent.alias("absent")), read)


def true_state(region, visible=None, raw=None) -> Column:
    """State from the region, else from a flag, else from text, else UNKNOWN."""
    r = F.lower(strip(F.coalesce(lit_or_col(region), F.lit(""))))
    out = F.when(r == "segment", "INTERACTION").when(r == "gap", "NO_INTERACTION")
    if visible is not None:
        v = lit_or_col(visible).cast("int")
        out = out.when(v.isNotNull(), F.when(v == 1, "INTERACTION").otherwise("NO_INTERACTION"))
    return out.otherwise(state_of(raw) if raw is not None else F.lit("UNKNOWN"))


def step_of(step, seconds=None, tolerance: float = 1e-3) -> Column:
    """Step 0 to 2, else by a lead or lag near 8, 16 or 24 seconds."""
    s = F.when(lit_or_col(step).isin(0, 1, 2), lit_or_col(step).cast("int"))
    if seconds is None:
        return s
    sec = lit_or_col(seconds).cast("double")
    near = F.coalesce(*[F.when(F.abs(sec - v) < tolerance, i) for i, v in enumerate(STEP_SECONDS)])
    return F.coalesce(s, near)


def group_of(state) -> Column:
    s = F.upper(strip(F.coalesce(lit_or_col(state), F.lit(""))))
    return F.coalesce(*[F.when(s == k, v) for k, v in GROUPS.items()], F.lit("unknown"))


def stated_confidence(text) -> Column:
    """Number in the CONF tag, clamped; null if there is none."""
    v = tag_value(text, "CONF").try_cast("double")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def choice_confidence(p_cond, chosen, token_probs=None, official: bool = True) -> Column:
    """Struct of conf and source: probability of the chosen letter, else the largest
    (official), else that of the first token."""
    p, a = lit_or_col(p_cond), blank_to_null(lit_or_col(chosen))
    fit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    own = F.when(a.isNotNull(), fit(F.try_element_at(p, a)))
    top = fit(F.array_max(F.map_values(p))) if official else F.lit(None).cast("double")
    first = fit(F.try_element_at(lit_or_col(token_probs), F.lit(1))) if token_probs is not None else F.lit(None).cast("double")
    source = F.when(own.isNotNull(), "cand_conf_p_cond_pred").when(top.isNotNull(), "cand_conf_p_cond_max").when(first.isNotNull(), "gen_token_prob0").otherwise("none")
    return F.struct(F.coalesce(own, top, first).alias("conf"), source.alias("source"))


def choice_distribution(masses) -> Column:
    """Of an array of option masses: total, conditional probabilities, first largest (as a
    letter) and entropy -sum p ln(p + 1e-12)."""
    m = lit_or_col(masses)
    total = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(m, lambda x: F.when(total > 0, x / total))
    best = F.array_position(p, F.array_max(p)).cast("int")
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-12)))
    return F.struct(total.alias("mass"), p.alias("p"), F.substr(F.lit(LETTERS), best, F.lit(1)).alias("best"), entropy.alias("entropy"))


def sequence_logprob(logprobs) -> Column:
    """Of an array of token log probabilities: probabilities, sum and mean over usable ones."""
    use = F.filter(lit_or_col(logprobs), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(use, F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.transform(use, F.exp).alias("probs"), F.when(F.size(use) > 0, total).alias("sum"), F.try_divide(total, F.size(use)).alias("mean"))


def option_words(option) -> Column:
    """Struct of verb and noun words of an option such as ``YOU take small_(tiny) ring``."""
    clean = lambda c: F.regexp_extract_all(F.replace(F.regexp_replace(F.lower(c), r"\(.*", ""), F.lit("_"), F.lit(" ")), F.lit("([a-z0-9]+)"), F.lit(1))

    def read(s):
        verb = F.coalesce(F.try_element_at(clean(F.regexp_extract(s, r"^(\S+)", 1)), F.lit(1)), F.lit(""))
        noun = let(clean(F.regexp_extract(s, r"(?s)^\S+\s+(.*)$", 1)), lambda n: F.when(F.try_element_at(n, F.lit(1)).isin("none", "null"), F.array(F.lit("none"))).otherwise(n))
        return F.struct(verb.alias("verb"), noun.alias("noun"))

    return let(F.regexp_replace(strip(F.coalesce(lit_or_col(option), F.lit(""))), r"(?i)^YOU\s+", ""), read)


def option_match(text, options) -> Column:
    """Struct of letter and multi: the only option whose verb and noun words are all among
    the words of the text; multi if words point to two or more options."""
    words = F.regexp_extract_all(F.lower(lit_or_col(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    among = lambda x, w: (F.size(x["noun"]) > 0) & F.forall(x["noun"], lambda n: F.array_contains(w, n))

    def read(v):
        whole = F.filter(F.transform(v["o"], lambda x, i: F.struct(i.alias("i"), (F.array_contains(v["words"], x["verb"]) & among(x, v["words"])).alias("hit"))), lambda x: x["hit"])
        signal = F.size(F.filter(v["o"], lambda x: among(x, v["words"])))
        return let(whole, lambda h: F.struct(F.when(F.size(h) == 1, F.substr(F.lit(LETTERS), F.try_element_at(h, F.lit(1))["i"] + 1, F.lit(1))).otherwise("").alias("letter"), ((F.size(h) > 1) | ((F.size(h) == 0) & (signal > 1))).alias("multi")))

    return let(F.struct(words.alias("words"), F.transform(lit_or_col(options), option_words).alias("o")), read)


def options_of_prompt(prompt) -> Column:
    """Map of letter -> struct(raw, verb, noun) from lines such as ``A. YOU take ring``."""
    rx = r"(?im)^\s*([A-D])\s*[\.\)]\s*(.+?)\s*$"
    t = lit_or_col(prompt)
    names, raw = F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), F.upper), F.regexp_extract_all(t, F.lit(rx), F.lit(2))
    first = let(F.struct(names.alias("k"), raw.alias("v")), lambda x: F.filter(F.arrays_zip(x["k"], x["v"]), lambda p, i: F.array_position(x["k"], p["k"]) == i + 1))
    own = lambda v: let(option_words(v), lambda o: F.struct(v.alias("raw"), o["verb"].alias("verb"), F.array_join(o["noun"], " ").alias("noun")))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"].alias("k"), own(p["v"]).alias("v"))))


#: Fixed values of the audit: tags by kind of answer, placeholders that prompts hold.
AUDIT_TAGS = {
    "pred": ("VERB", "NOUN", "DESC", "CONF"), "past": ("VERB", "NOUN", "DESC", "CONF"), "now_full": ("STATE", "VERB", "NOUN", "DESC", "CONF"),
    "now_state_only": ("STATE", "CONF"), "now_action_mcq": ("ANS", "VERB", "NOUN", "CONF"),
}
AUDIT_ROOTS = {"pred": "future", "past": "past", "now_full": "now", "now_state_only": "now", "now_action_mcq": "now"}
PLACEHOLDERS = ("verb_here", "noun_here_or_none", "short_concise_sentence", "state_here", "desc_here", "conf_here", "ans_here", "choice_here")


def now_schema(prompt) -> Column:
    """Which tags a prompt about the present asks for."""
    p = F.upper(F.coalesce(lit_or_col(prompt), F.lit("")))
    has = lambda t: p.rlike(rf"<\s*{t}\s*>")
    root = F.contains(p, F.lit("<NOW>")) | F.contains(p, F.lit("</NOW>"))
    mcq = has("ANS") & (has("VERB") | has("NOUN")) & has("CONF") & ~has("STATE")
    state = has("STATE") & has("CONF") & ~has("VERB") & ~has("NOUN") & ~has("DESC")
    return F.when(~root, "now_full").when(mcq, "now_action_mcq").when(state, "now_state_only").otherwise("now_full")


def response_fault(schema, candidates, text, options, subkind=None) -> Column:
    """First reason why a response is not well formed, null if it is.

    schema: pred, past, now_full, now_state_only or now_action_mcq, or a column of these;
    candidates: whether the answer is one of options (map of letter -> struct with verb,
    noun), as a truth value or column; subkind: names such as ms_pred_cand with rules of
    their own.  Where schema or candidates is one value, only its rules are built."""
    fixed = schema if isinstance(schema, str) and schema in AUDIT_TAGS else None
    kinds = [fixed] if fixed else list(AUDIT_TAGS)
    schema, candidates = F.lit(fixed) if fixed else lit_or_col(schema), F.lit(candidates) if isinstance(candidates, bool) else lit_or_col(candidates)
    t = strip(F.coalesce(lit_or_col(text), F.lit("")))
    sub = F.coalesce(lit_or_col(subkind), F.lit("")) if subkind is not None else F.lit("")
    held = {tag: F.coalesce(tag_value(t, tag), F.lit("")).alias(tag.lower()) for tag in ("STATE", "ANS", "VERB", "NOUN", "DESC")}
    all_tags = sorted({tag for kind in kinds for tag in AUDIT_TAGS[kind]} | {"ANS"})
    both = lambda x, tag: F.contains(x["up"], F.lit(f"<{tag}>")) & F.contains(x["up"], F.lit(f"</{tag}>"))

    def fault(x):
        """From the text, its tags' values and the option that its answer names."""
        kind, cand, own, ans = x["kind"], x["cand"], x["own"], F.upper(x["ans"])
        out = F.when(x["t"] == "", "empty").when(x["t"].rlike(r"(?i)<(NOW|PAST|FUTURE)>\s*\[[^\]]+\]\s*</\1>"), "bracket_numbers_inside_root")
        for name in kinds:
            root, mine, tags = AUDIT_ROOTS[name], F.lit(True) if fixed else kind == name, AUDIT_TAGS[name]
            lacking = F.arrays_overlap(x["lacking"], F.array(*map(F.lit, tags)))
            if not name.startswith("now"):
                lacking = lacking | (cand & F.array_contains(x["lacking"], "ANS"))
            out = out.when(mine & ~F.contains(x["up"], F.lit(f"</{root.upper()}>")), f"missing_close_{root}").when(mine & lacking, f"missing_subtags_{root}")
        state = kind.isin("now_full", "now_state_only")
        calm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r"\.+$", ""))
        nothing = (F.lower(own["verb"]) == "none") | (F.lower(own["noun"]) == "none")
        wanted = F.when(nothing, "YOU do nothing").otherwise(F.concat(F.lit("YOU "), own["verb"], F.lit(" "), own["noun"]))
        described = cand & (kind != "now_action_mcq")
        if {"now_full", "now_state_only"} & set(kinds):
            out = out.when(state & (x["state"] == ""), "missing_state_value").when(state & ~F.upper(x["state"]).isin(*STATES), "state_not_in_enum")
        out = out.when((x["sub"] == "ms_rtrv_open") & x["t"].rlike(r"[\[\]]"), "ms_rtrv_open_contains_brackets")
        out = out.when(cand & F.lower(x["t"]).rlike("|".join(PLACEHOLDERS)), "contains_placeholders").when(cand & (ans == ""), "missing_ans")
        out = out.when(cand & ~ans.rlike("^[A-D]"), "bad_ans_letter").when(cand & own.isNull(), "ans_not_in_options")
        out = out.when(cand & ((x["verb"] != strip(own["verb"])) | (x["noun"] != strip(own["noun"]))), "verb_noun_not_copied_from_parsed_options")
        out = out.when(described & (x["desc"] == ""), "missing_desc").when(described & (calm(x["desc"]) != calm(wanted)), "desc_not_matching_option")
        return out.when((x["sub"] == "ms_pred_cand") & x["desc"].rlike("[<>]"), "desc_contains_tags")

    seen = F.struct(t.alias("t"), F.upper(t).alias("up"), schema.alias("kind"), candidates.alias("cand"), sub.alias("sub"), *held.values())
    names = [*("t", "up", "kind", "cand", "sub"), *(tag.lower() for tag in held)]

    def add(x):
        own = F.try_element_at(lit_or_col(options), F.upper(F.substr(x["ans"], F.lit(1), F.lit(1))))
        lacking = F.array_compact(F.array(*[F.when(~both(x, tag), tag) for tag in all_tags]))
        return let(F.struct(*[x[n].alias(n) for n in names], own.alias("own"), lacking.alias("lacking")), fault)

    return let(seen, add)


def coerce_tags(text, options, fault) -> Column:
    """Struct of text, changed and why: a malformed multi-step answer rewritten as a tagged
    line, by its letter, else by an option's words, else the option without interaction,
    else the first.  It invents answers: keep it out of scoring."""
    t, o = F.coalesce(lit_or_col(text), F.lit("")), lit_or_col(options)
    raws = F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda k: F.try_element_at(o, k)["raw"])
    none = F.filter(F.map_keys(o), lambda k: F.lower(F.element_at(o, k)["raw"]).rlike(r"\bnone\b|no[_ ]interaction"))
    by_letter = F.coalesce(found_letter(tag_value(t, "ANS")), found_guess(t, "legacy"))
    by_words = let(option_match(t, raws)["letter"], lambda x: F.when(x != "", x))
    ways = [(by_letter, "letter"), (by_words, "words"), (F.try_element_at(none, F.lit(1)), "none_option"), (F.lit("A"), "first")]
    named = lambda why: lambda x: F.when(x.isNotNull(), F.struct(x.alias("pick"), F.lit(why).alias("why")))
    pick = F.coalesce(*[let(way, named(why)) for way, why in ways])

    def rewrite(p):
        own = F.try_element_at(o, p["pick"])
        line = F.concat(F.lit("<ANS>"), p["pick"], F.lit("</ANS><VERB>"), F.coalesce(own["verb"], F.lit("")), F.lit("</VERB><NOUN>"), F.coalesce(own["noun"], F.lit("")), F.lit("</NOUN>"))
        return F.struct(line.alias("text"), F.lit(True).alias("changed"), p["why"].alias("why"))

    fine = F.struct(t.alias("text"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("why"))
    return F.when(lit_or_col(fault).isNotNull(), let(pick, rewrite)).otherwise(fine)
