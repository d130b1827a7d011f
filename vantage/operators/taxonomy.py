"""Taxonomy terms and narrations: variants, the noun that is meant, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed word lists of the narration rules.
DETERMINERS = (
    "the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "some", "any", "each", "every", "either",
    "neither", "few", "several", "many", "much", "no", "one", "two", "three", "four", "five", "both", "all",
)
PREPOSITIONS = (
    "to", "with", "in", "on", "at", "from", "into", "onto", "over", "under", "about", "for", "of", "off", "up", "down", "across", "through", "around",
    "between", "during", "before", "after", "without", "within", "by", "as",
)


def words(c) -> Column:
    """Tokens [a-z0-9]+ of the text in lower case, underscores as blanks."""
    t = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(t, F.lit(""))), F.lit("_"), F.lit(" ")), F.lit("([a-z0-9]+)"), F.lit(1))


def bare(c: Column) -> Column:
    """Without blanks and underscores at the ends."""
    return F.trim(F.regexp_replace(F.trim(c), "^_+|_+$", ""))


def base_of(term) -> Column:
    """What stands before the first bracket."""
    t = F.lower(F.trim(F.col(term) if isinstance(term, str) else term))
    return bare(F.substring_index(t, "(", 1))


def variants_of(term) -> Column:
    """The base and, of every bracket that holds a comma, the parts; a bracket without one
    is a note."""
    t = F.lower(F.trim(F.coalesce(F.col(term) if isinstance(term, str) else term, F.lit(""))))
    lists = F.filter(F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda g: F.contains(g, F.lit(",")))
    parts = F.flatten(F.transform(lists, lambda g: F.transform(F.split(g, ","), bare)))
    return F.filter(F.array_distinct(F.concat(F.array(base_of(t)), parts)), lambda v: v != "")


def variants(terms: DataFrame) -> DataFrame:
    """(variant, tokens, term_id): the first term that has a variant owns it."""
    wide = terms.select("term_id", F.explode(variants_of("term")).alias("v")).withColumn("tokens", words("v")).filter(F.size("tokens") > 0)
    return wide.select(F.array_join("tokens", "_").alias("variant"), "term_id").groupBy("variant").agg(F.min("term_id").alias("term_id")).withColumn("tokens", F.split("variant", "_"))


def has(vocab: Column, word: Column) -> Column:
    return F.array_contains(vocab, word)


def stem_verb(word: Column, vocab: Column) -> Column:
    """The word, or without ing, ed, es or s if that is in the vocabulary."""
    cut = lambda end, least: F.when(F.endswith(word, F.lit(end)) & (F.length(word) > least) & has(vocab, F.substr(word, F.lit(1), F.length(word) - len(end))), F.substr(word, F.lit(1), F.length(word) - len(end)))
    return F.when(has(vocab, word), word).otherwise(F.coalesce(cut("ing", 5), cut("ed", 3), cut("es", 3), cut("s", 2), word))


def singular(word: Column, vocab: Column) -> Column:
    short = F.substr(word, F.lit(1), F.length(word) - 1)
    return F.when(~has(vocab, word) & F.endswith(word, F.lit("s")) & (F.length(word) > 3) & has(vocab, short), short).otherwise(word)


#: Rows and bytes of text of a side that is broadcast, at most.
SMALL_ROWS, SMALL_BYTES = 100_000, 4 << 20


def measured(side: DataFrame, *texts: Column) -> DataFrame:
    """The side of a join, to be broadcast if it is counted to be small, else to be
    shuffled.  Spark itself goes by the compressed files and would broadcast the other side."""
    n = side.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum((F.octet_length(t) for t in texts), F.lit(0))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(side) if n["rows"] <= SMALL_ROWS and n["bytes"] <= SMALL_BYTES else side.hint("merge")


def forms(vocab: DataFrame, ends: dict[str, int]) -> DataFrame:
    """(form, word): the word of the vocabulary (word) that a form of it stands for.  A form
    is the word itself or the word with an end, if it is longer than the number of the end;
    of several words the one with the first end in ``ends`` owns the form, itself before all."""
    cut = F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("end"), F.lit(0).alias("least")), *[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end"), F.lit(n).alias("least")) for i, (e, n) in enumerate(ends.items(), 1)])
    f = vocab.select("word").filter("word <> ''").distinct().select("word", F.explode(cut).alias("e")).select("word", "e.rank", "e.least", F.concat("word", "e.end").alias("form"))
    return f.filter(F.length("form") > F.col("least")).groupBy("form").agg(F.min_by("word", "rank").alias("word"))


def spoken(keyed: DataFrame, key: str, tokens: str, known: DataFrame) -> DataFrame:
    """(key, forms): for each token of the distinct keys the words that stand for it, by
    ``forms``.  A token that is no form at all stands for itself, a form of another word for nothing."""
    t = keyed.select(key, F.posexplode(tokens).alias("i", "word"))
    own = known.select(F.col("form").alias("word"), F.col("word").alias("owner"))
    t = t.join(own.hint("merge"), "word", "left").join(known.groupBy("word").agg(F.sort_array(F.collect_list("form")).alias("all")).hint("merge"), "word", "left")
    said = F.when(F.col("owner").isNull(), F.array("word")).when(F.col("owner") == F.col("word"), F.col("all")).otherwise(F.array().cast("array<string>"))
    return t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", said.alias("said")))).alias("f")).select(key, F.col("f.said").alias("forms"))


VERB_ENDS = {"ing": 5, "ed": 3, "es": 3, "s": 2}
NOUN_ENDS = {"s": 3}


def narration_nouns(narrations: DataFrame, nouns: DataFrame, noun_words: DataFrame, verb_words: DataFrame, longest: int = 4) -> DataFrame:
    """(narr_id, how, term_id, phrase) of each distinct narration (narr_id, text, verb).

    The verb's place is its first occurrence, words stemmed.  All n-grams, plurals cut, are
    joined with the variants of nouns; those that overlap the verb go; the nearest after
    the verb wins, then the longest, then the leftmost; without any after it the nearest
    to it; without a verb the longest.  Else the words after the verb up to a preposition,
    determiners skipped; else ``none``.

    Vocabularies are tables (word) of any size.  Narrations aren't stemmed word by word:
    variants and verbs are written out in all forms that stand for them, so the words of a
    text are joined as they are.  A null text has no words, a null verb no place.

    Verbs and variants are broadcast only if they are counted to be small; nothing that
    has a row for each narration or n-gram ever is."""
    w = words("text")
    w = F.when((F.try_element_at(w, F.lit(1)) == "c") & (F.try_element_at(w, F.lit(2)) == "c"), F.slice(w, F.lit(3), F.size(w))).otherwise(w)
    verbs = narrations.select("verb").filter("verb is not null").distinct().withColumn("vseq", F.filter(F.split(base_of("verb"), "_"), lambda x: x != ""))
    verbs = spoken(verbs, "verb", "vseq", forms(verb_words, VERB_ENDS)).withColumnRenamed("forms", "vseq")
    verbs = measured(verbs, F.col("verb"), F.array_join(F.flatten("vseq"), "_"))
    n = narrations.select("narr_id", w.alias("w"), "verb").join(verbs, "verb", "left").withColumn("vseq", F.coalesce("vseq", F.array().cast("array<array<string>>")))
    here = lambda i: F.forall(F.sequence(F.lit(0), F.size("vseq") - 1), lambda j: F.coalesce(F.array_contains(F.get("vseq", j), F.get("w", i + j)), F.lit(False)))
    places = F.when((F.size("vseq") > 0) & (F.size("w") >= F.size("vseq")), F.filter(F.sequence(F.lit(0), F.size("w") - F.size("vseq")), here))
    n = n.withColumn("vpos", F.try_element_at(places, F.lit(1))).withColumn("vlen", F.when(F.col("vpos").isNotNull(), F.size("vseq")).otherwise(0))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct((i - 1).alias("s"), k.alias("len"), F.array_join(F.slice("w", i, k), "_").alias("said")))))
    spans = F.filter(spans, lambda x: x["s"] + x["len"] <= F.size("w"))
    grams = n.select("narr_id", "vpos", "vlen", F.explode(spans).alias("x")).select("narr_id", "vpos", "vlen", "x.*")
    grams = grams.filter(F.col("vpos").isNull() | (F.col("s") >= F.col("vpos") + F.col("vlen")) | (F.col("s") + F.col("len") <= F.col("vpos")))
    named = nouns.select("variant", "term_id", F.split("variant", "_").alias("tokens")).filter(F.size("tokens") <= longest)
    said = spoken(named, "variant", "tokens", forms(noun_words, NOUN_ENDS))
    whole = F.aggregate("forms", F.array(F.lit("")), lambda got, f: F.flatten(F.transform(got, lambda a: F.transform(f, lambda x: F.when(a == "", x).otherwise(F.concat(a, F.lit("_"), x))))))
    said = said.select("variant", F.explode(whole).alias("said")).join(named.select("variant", "term_id").hint("merge"), "variant").select("said", "term_id")
    occ = grams.join(measured(said, F.col("said")), "said")
    end = F.col("vpos") + F.col("vlen")
    after = F.when(F.col("vpos").isNull(), 0).when(F.col("s") >= end, 0).otherwise(1)
    far = F.when(F.col("vpos").isNull(), 0).when(F.col("s") >= end, F.col("s") - end).otherwise(F.abs(F.col("s") - F.col("vpos")))
    best = occ.groupBy("narr_id").agg(F.min_by("term_id", F.struct(after.alias("a"), far.alias("d"), (-F.col("len")).alias("l"), F.col("s").alias("s"))).alias("term_id"))
    rest = F.slice("w", F.col("vpos") + F.col("vlen") + 1, F.size("w"))
    isin = lambda x, words_: x.isin(*words_)
    skip = F.aggregate(rest, F.struct(F.lit(True).alias("lead"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("got")), lambda a, x: F.struct(
        (a["lead"] & isin(x, DETERMINERS)).alias("lead"), (a["stop"] | (~(a["lead"] & isin(x, DETERMINERS)) & isin(x, PREPOSITIONS))).alias("stop"),
        F.when((a["lead"] & isin(x, DETERMINERS)) | a["stop"] | isin(x, PREPOSITIONS), a["got"]).otherwise(F.array_append(a["got"], x)).alias("got")))
    phrase = F.when(F.col("vpos").isNotNull(), F.nullif(F.array_join(skip["got"], "_"), F.lit("")))
    out = n.select("narr_id", phrase.alias("ph")).join(best.hint("merge"), "narr_id", "left")
    how = F.when(F.col("term_id").isNotNull(), "taxonomy_match").when(F.col("ph").isNotNull(), "heuristic_after_verb").otherwise("none")
    return out.select("narr_id", how.alias("how"), "term_id", F.when(F.col("term_id").isNull(), F.coalesce("ph", F.lit("none"))).alias("phrase"))


def verb_match(pred, candidates, vocab: Column) -> Column:
    """Whether the stemmed verb is one of the candidates (variants joined by underscores)."""
    p = F.array_join(F.transform(words(pred), lambda x: stem_verb(x, vocab)), "_")
    return (p != "") & F.array_contains(candidates, p)


def noun_match(pred, candidates, vocab: Column) -> Column:
    """Whether the noun, plurals cut, is a candidate; none, no and null match only none."""
    p = F.col(pred) if isinstance(pred, str) else pred
    s = F.array_join(F.transform(words(p), lambda x: singular(x, vocab)), "_")
    nothing = F.lower(F.trim(F.coalesce(p, F.lit("")))).isin("none", "no", "null")
    return F.when(nothing, F.array_contains(candidates, F.lit("none"))).otherwise((s != "") & F.array_contains(candidates, s))
