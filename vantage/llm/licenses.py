"""License scans by a positional index of rare tokens, in built-in functions only."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import aside

#: Everything in ASCII but digits and letters separates words; all other characters are parts of words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Plain mentions and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, words of a notice, and the phrases in it that must stand in a text.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "this work is dedicated to the public domain under the creative commons cc0 1 0 universal license", ["creative commons cc0"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["is free software", "gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "copy of this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Of a notice's words that a file has, so many of highest IDF are looked up.
RAREST = 4


@dataclass
class Template:
    """A notice: its words, the places that must hold certain words, its words by place."""

    label: str
    words: list[str]
    must: list[tuple[int, str]]

    @classmethod
    def of(cls, label: str, text: str, phrases: list[str]) -> Template:
        words, must = text.split(), {}
        for phrase in phrases:
            own = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            must |= {at + i: w for i, w in enumerate(own)}
        return cls(label, words, sorted(must.items()))

    @property
    def places(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            out.setdefault(w, []).append(i)
        return out


def words_of(text: Column) -> Column:
    """Words in lower case.  Two characters beyond ASCII have ASCII letters as their lower
    case; another one stands in for them, as only A-Z change here."""
    body = F.coalesce(text, F.lit(""))
    for c in ("\u0130", "\u212a"):
        body = F.replace(body, F.lit(c), F.lit("ß"))
    return F.array_remove(F.split(F.lower(body), SEPARATOR), "")


def literal(items, kind: str) -> Column:
    return F.array(*map(F.lit, items)).cast(f"array<{kind}>")


def all_in(words, present: Column) -> Column:
    own = sorted(set(words))
    return F.size(F.array_intersect(present, literal(own, "string"))) == len(own)


def inverse_frequencies(tokens: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each word of the notices stands; a row for each
    of these words at most comes to the driver."""
    total = tokens.count()
    found = tokens.select(F.explode("__present").alias("w")).groupBy("w").count().collect()
    return total, dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in found}


def scan(docs: DataFrame, templates: list | None = None, phrases: dict[str, str] | None = None, text: str = "text", rarest: int = RAREST) -> DataFrame:
    """docs with lic_words (number of words), lic_base (places of plain mentions: label and
    start), lic_found (places of notices: label, start, share of its IDF) and lic_score.

    A first pass counts, over all documents, in how many each word of the notices stands.
    In the second, no row leaves its place and nothing is shuffled.  A notice is looked
    for only in files that have all words of its mandatory phrases.  Of its words in the
    file, the ``rarest`` of highest IDF (ties: first in the alphabet) are looked up: a
    word at place i of the file and at j of the notice says that the notice begins at
    i - j, and places that two of the words agree on are candidates.  Those whose
    mandatory phrases stand at their relative places are found.

    lic_score: the greatest share of a notice's IDF that stands at its place in the file;
    half of it where phrases lack, and 0.5 at least where a plain mention stands.

    Null and empty texts have no words, no labels and the score 0.  Repeated rows are
    scanned one by one; other columns, null or of any name, stay as they are.  Texts are
    read whole.  An empty table gives no rows.
    """
    known = [Template.of(*t) for t in (TEMPLATES if templates is None else templates)]
    phrases = PHRASES if phrases is None else phrases
    own, back = aside(docs, "lic_words", "lic_base", "lic_found", "lic_score")
    vocabulary = sorted({w for t in known for w in t.words} | {w for p in phrases for w in p.split()})

    def tokens(df: DataFrame, column: str) -> DataFrame:
        got = df.withColumn("__words", words_of(F.col(column)))
        return got.withColumn("__present", F.array_distinct(F.filter("__words", lambda w: w.isin(*vocabulary))))

    total, df = inverse_frequencies(tokens(docs.select(F.col(f"`{text}`").alias("text")), "text").select("__present"), vocabulary)
    idf = {w: math.log1p(total / (1 + n)) for w, n in df.items()}
    rows = tokens(own, {v: k for k, v in back.items()}.get(text, text))

    # which notices and mentions are possible at all, then the places of their words
    might = [all_in([w for _, w in t.must], F.col("__present")) for t in known]
    said = [all_in(p.split(), F.col("__present")) for p in phrases]
    rows = rows.withColumn("__may", F.array(*might)).withColumn("__said", F.array(*said))
    some = F.exists("__may", lambda x: x) | F.exists("__said", lambda x: x)
    marks = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("at"), w.alias("w")))), lambda x: x.isNotNull())
    rows = rows.withColumn("__marks", F.when(some, marks))

    empty = F.expr("cast(array() as array<struct<label: string, start: bigint>>)")
    base = [F.when(F.get("__said", n), mentions(phrase, label)) for n, (phrase, label) in enumerate(phrases.items())]
    base = F.concat(empty, *[F.coalesce(b, empty) for b in base])
    offsets = {f"__o{n}": F.when(F.get("__may", n), beginnings(t, df, rarest)) for n, t in enumerate(known)}
    rows = rows.withColumns({"__base": base} | offsets)
    found = [F.when(F.col(f"__o{n}").isNotNull(), candidates(t, F.col(f"__o{n}"), idf, rarest)) for n, t in enumerate(known)]
    none = F.expr("cast(array() as array<struct<label: string, start: bigint, share: double, stands: boolean>>)")
    rows = rows.withColumn("__all", F.array_sort(F.concat(none, *[F.coalesce(f, none) for f in found])))
    shares = F.transform("__all", lambda p: F.when(p["stands"], p["share"]).otherwise(p["share"] / 2))
    done = rows.withColumns({
        "lic_words": F.size("__words").cast("long"),
        "lic_base": F.array_sort("__base"),
        "lic_found": F.transform(F.filter("__all", lambda p: p["stands"]), lambda p: F.struct(p["label"], p["start"], p["share"])),
        "lic_score": F.greatest(F.coalesce(F.array_max(shares), F.lit(0.0)), F.when(F.size("__base") > 0, 0.5).otherwise(0.0)),
    })
    return done.select(*[F.col(f"`{c}`") for c in own.columns], "lic_words", "lic_base", "lic_found", "lic_score").withColumnsRenamed(back)


def stands_at(place: Column, words: list[tuple[int, str]]) -> Column:
    """Whether the file has these words at their places after place."""
    out = F.lit(True)
    for k, w in words:
        out = out & F.coalesce(F.get("__words", place + k) == w, F.lit(False))
    return out


def mentions(phrase: str, label: str) -> Column:
    """Places where a phrase's words stand one after another."""
    first, *rest = phrase.split()
    whole = F.filter("__marks", lambda m: (m["w"] == first) & stands_at(m["at"], list(enumerate(rest, 1))))
    return F.transform(whole, lambda m: F.struct(F.lit(label).alias("label"), m["at"].cast("long").alias("start")))


def beginnings(t: Template, df: dict[str, int], rarest: int) -> Column:
    """For each of the notice's rarest words that the file has, where the notice would begin."""
    by_rarity = literal(sorted(t.places, key=lambda w: (df[w], w)), "string")
    anchors = F.slice(F.filter(by_rarity, lambda w: F.array_contains("__present", w)), 1, rarest)
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(j).alias("j")) for w, places in t.places.items() for j in places])

    def of(anchor: Column) -> Column:
        own = F.filter(postings, lambda p: p["w"] == anchor)
        return F.flatten(F.transform(F.filter("__marks", lambda m: m["w"] == anchor), lambda m: F.transform(own, lambda p: m["at"] - p["j"])))

    return F.transform(anchors, of)


def candidates(t: Template, offsets: Column, idf: dict[str, float], rarest: int) -> Column:
    """Places on which two of the looked-up words agree: label, start, the share of the
    notice's IDF that stands there, and whether its mandatory phrases do."""
    at = lambda k: F.coalesce(F.get(offsets, F.lit(k)), F.expr("cast(array() as array<int>)"))
    agreed = F.array_distinct(F.concat(*[F.array_intersect(at(a), at(b)) for a, b in itertools.combinations(range(rarest), 2)]))
    weight = sum(idf[w] for w in t.words) or 1.0
    listed = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(idf[w] / weight).alias("x")) for j, w in enumerate(t.words)])

    def place(o: Column) -> Column:
        share = F.aggregate(listed, F.lit(0.0), lambda s, p: s + F.when(F.get("__words", o + p["j"]) == p["w"], p["x"]).otherwise(0.0))
        return F.struct(F.lit(t.label).alias("label"), o.cast("long").alias("start"), F.least(share, F.lit(1.0)).alias("share"), stands_at(o, t.must).alias("stands"))

    return F.transform(agreed, place)


def labels(places: Column) -> Column:
    """The distinct labels of places, in order."""
    return F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
