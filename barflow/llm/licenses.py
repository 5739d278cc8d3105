"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

Places of fixed phrases come first (base). Beyond them, texts are cut into overlapping blocks of words, and a block is joined with a template
when it holds at least a given part of the template's words (containment). Words are ordered by how many documents have them, rarest first;
only a template's first words in that order can make a pair (prefix), and a pair whose block is too short (length), or has too few words left
after the place of the match (position), goes before it is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

#: What is a word, with letters in either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates: label and text. A long notice is given in parts of at most STRIDE words, so that each lies within a block.
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the Apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the GNU general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license"),
    ("lgpl", "under the terms of the GNU lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the GNU Affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the Mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under CC BY 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under CC BY SA 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "dedicated to the public domain under CC0 1 0 universal"),
)
#: Words from one block's begin to the next, and in a block: any STRIDE words in a row lie within one.
STRIDE, LENGTH = 32, 64
#: Distinct words of all templates at most: they are literals of the plan, and their counts come to the driver.
MOST_WORDS = 20_000


def lowered(text: Column) -> Column:
    """text in lower case, as far as words of templates can tell: the one other sign whose lower case is a letter of theirs (the kelvin
    sign) stays another sign."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("Ω")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _plain(text: str) -> list[str]:
    """The words of a template or phrase, which are in ASCII."""
    return text.lower().split()


def _literal(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def phrase_places(words: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """Where phrases begin (words from 0), with their labels, in order."""
    every = []
    for phrase, label in phrases:
        parts = _plain(phrase)
        rest = lambda i, parts=parts: F.coalesce(F.get(words, i + len(parts) - 1) == parts[-1], F.lit(False))

        def whole(w: Column, i: Column, parts: list[str] = parts, rest=rest) -> Column:
            same = (w == parts[0]) & rest(i)
            for k, p in enumerate(parts[1:-1], 1):
                same &= F.get(words, i + k) == p
            return same

        def places(parts: list[str] = parts, label: str = label, whole=whole) -> Column:
            marks = F.transform(words, lambda w, i: F.when(whole(w, i), F.struct(i.alias("start"), F.lit(label).alias("label"))))
            return F.filter(marks, lambda m: m.isNotNull())

        none = F.array().cast("array<struct<start:int,label:string>>")
        every.append(F.when(F.array_contains(words, parts[-1]), places()).otherwise(none))
    return F.array_sort(F.concat(*every))


class Templates:
    """The templates' words in the global order, with how many of them a block must have and which of them can make a pair."""

    def __init__(self, templates: tuple[tuple[str, str], ...], order: list[str], least: tuple[int, int]):
        place = {w: k for k, w in enumerate(order)}
        self.order, self.all = order, []
        for label, text in templates:
            words = sorted(set(_plain(text)), key=place.__getitem__)
            need = max(1, -(-least[0] * len(words) // least[1]))
            self.all.append((label, words, need, words[: len(words) - need + 1]))
        #: For each template those that say more: all of its words and others.
        self.above = [[k for k, (_, more, *_) in enumerate(self.all) if set(words) < set(more)] for _, words, *_ in self.all]

    def column(self) -> Column:
        """An array of structs, a constant of the plan."""
        number = lambda ks: F.array(*map(F.lit, ks)).cast("array<int>")
        return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), _literal(words).alias("words"), F.lit(need).alias("need"), _literal(prefix).alias("prefix"), number(self.above[k]).alias("above")) for k, (label, words, need, prefix) in enumerate(self.all)))

    def prefixes(self) -> Column:
        return _literal(sorted({w for *_, prefix in self.all for w in prefix}))


def last_block(n_words: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(n_words / STRIDE).cast("int") - 2)


def block_pairs(words: Column, t: Templates) -> Column:
    """(label, block, containment, less) of each pair of a block and a template that has enough words in common, in order of blocks. less: whether a
    template that says more is in the same block."""
    known, first = t.column(), t.prefixes()

    def pairs_of(hit: Column) -> Column:
        """Pairs that a word of a prefix makes: its one or two blocks with the templates that have it in front, as one number each."""
        fit = F.filter(known, lambda x: F.array_contains(x["prefix"], hit["word"]))
        at = F.floor(hit["at"] / STRIDE).cast("int")
        blocks = F.filter(F.array(at - 1, at), lambda b: (b >= 0) & (b <= hit["last"]))
        return F.flatten(F.transform(blocks, lambda b: F.transform(fit, lambda x: b.cast("long") * len(t.all) + x["k"])))

    def judged(pair: Column) -> Column:
        block = F.floor(pair / len(t.all)).cast("int")
        x = F.element_at(known, F.pmod(pair, F.lit(len(t.all))).cast("int") + 1)
        # the block's words that any template has, in the global order
        own = F.array_intersect(_literal(t.order), F.slice(words, block * STRIDE + 1, F.lit(LENGTH)))
        return let(F.struct(block.alias("block"), x.alias("x"), own.alias("own")), verified)

    def verified(c: Column) -> Column:
        t_words, own, need = c["x"]["words"], c["own"], c["x"]["need"]

        def by_place(match: Column) -> Column:
            left = 1 + F.least(F.size(t_words) - F.array_position(t_words, match), F.size(own) - F.array_position(own, match))
            common = F.size(F.array_intersect(t_words, own))
            pair = lambda n: F.when(n >= need, F.struct(c["x"]["label"].alias("label"), c["block"].alias("block"), (n / F.size(t_words)).alias("containment"), c["x"]["k"].alias("k"), c["x"]["above"].alias("above")))
            return F.when(left >= need, let(common, pair))

        common_first = F.get(F.filter(c["x"]["prefix"], lambda w: F.array_contains(own, w)), F.lit(0))
        return F.when(F.size(own) >= need, let(common_first, by_place))

    def join() -> Column:
        marks = F.transform(words, lambda w, i: F.when(F.array_contains(first, w), F.struct(w.alias("word"), i.alias("at"), last_block(F.size(words)).alias("last"))))
        pairs = F.array_distinct(F.flatten(F.transform(F.filter(marks, lambda m: m.isNotNull()), pairs_of)))
        return let(F.filter(F.transform(F.array_sort(pairs), judged), lambda p: p.isNotNull()), compared)

    def compared(found: Column) -> Column:
        # a block's pairs lie side by side, at most one a template
        near = lambda i: F.slice(found, F.greatest(i + 2 - len(t.all), F.lit(1)), F.lit(2 * len(t.all)))
        less = lambda p, i: F.exists(near(i), lambda o: (o["block"] == p["block"]) & F.array_contains(p["above"], o["k"]))
        return F.transform(found, lambda p, i: F.struct(p["label"].alias("label"), p["block"].alias("block"), p["containment"].alias("containment"), less(p, i).alias("less")))

    none = F.array().cast("array<struct<label:string,block:int,containment:double,less:boolean>>")
    return F.when(F.arrays_overlap(words, first), join()).otherwise(none)


def by_frequency(texts: DataFrame, text_col: str, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """The templates' words, those that the fewest documents have first. Only these words are counted, so at most MOST_WORDS rows come back."""
    known = sorted({w for _, text in templates for w in _plain(text)})
    if len(known) > MOST_WORDS:
        raise ValueError(f"the templates have {len(known)} distinct words, {MOST_WORDS} are the most")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = texts.select(F.explode(F.array_intersect(_literal(known), words_of(text))).alias("word")).groupBy("word").count().collect()
    count = {r["word"]: r["count"] for r in rows}
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, least: tuple[int, int] = (9, 10)) -> DataFrame:
    """id_col, n_words, places (start and label of each phrase) and blocks (label, block, containment and less of each pair) of each row of df.

    Words are runs of ASCII letters and digits and of all other signs beyond ASCII, in lower case. A block is LENGTH words, the next one begins
    STRIDE words later, and the last one holds the text's end. A block and a template make a pair if the block has at least least[0] / least[1] of
    the template's distinct words; all such pairs are given, as comparing each with each would give them. `less` marks those whose template's
    words are all in another template's that has a pair with the block too: it says nothing more. Null texts count as empty
    and have none, as have texts without words. Null ids, and rows that repeat an id, are rows as any; an empty table gives no rows; columns of df
    that are not named are not read. Templates and phrases are in ASCII, and constants of the plan.

    Two scans: one counts in how many documents each word of a template is, the other joins within each row. No shuffle but that of the counts (a row
    a word and task), no Python on the executors; a row's work grows with its words.
    """
    t = Templates(templates, by_frequency(df, text_col, templates), least)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases).alias("places"), block_pairs(w, t).alias("blocks")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), found.alias("found"))
    return rows.select(F.col("id").alias(id_col), "found.*")


def labels_of(places: Column, blocks: Column | None = None) -> Column:
    """The distinct labels, sorted: those of phrases, and of pairs that no other outdoes."""
    known = F.transform(places, lambda p: p["label"])
    if blocks is not None:
        known = F.concat(known, F.transform(F.filter(blocks, lambda b: ~b["less"]), lambda b: b["label"]))
    return F.array_sort(F.array_distinct(known))
