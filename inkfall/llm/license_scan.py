"""License scans by an exact set-similarity join [native].

The text is read once: of every word that a template or phrase holds, its place and token number are kept.
A text block is a run of as many consecutive words as the template has, wherever lines end. The templates'
tokens are ordered by how many documents of the corpus hold them, rarest first. A block that contains a share tau of a template's n tokens must hold one of the first
n - ceil(tau n) + 1 of them: an index from these tokens to the templates finds the candidates (prefix
filter). The document must have ceil(tau n) words (length filter), and of the tokens from the common one on in
the order enough must stand within a block's reach (positional filter). Only then are the blocks about that
place held against the template. Templates are a bounded literal in the plan, so the join needs no shuffle;
the one shuffle counts a few hundred tokens over the corpus.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfall.llm.common import pick, table, written
from inkfall.llm.url_filter import LOWER, UPPER

WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase: label, as the contract of op3 states them.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: short notices and opening sentences of well-known licenses.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License",),
}
TAU = 0.8


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _lowered(text: Column) -> Column:
    """In lower case as far as A-Z go in words of ASCII, which are all that is compared.

    Lower-casing all letters moves no word's edge; of them only the Kelvin sign would become a letter of ASCII.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


class _Tokens:
    """Numbers of a bounded vocabulary; a hit is a word's place times a power of two, plus its token's number.

    Short words have the lowest numbers: they are the most frequent and found first.
    """

    def __init__(self, words: set[str]):
        self.words = sorted(words, key=lambda w: (len(w), w))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.bits = max(1, len(self.words).bit_length())

    def hits(self, words: Column) -> Column:
        listed = F.array(*map(F.lit, self.words))
        hit = lambda w, i: F.when(w.isin(self.words), F.shiftleft(i.cast("long"), self.bits) + F.array_position(listed, w) - 1)
        return F.filter(F.transform(words, hit), lambda h: h.isNotNull())

    def at(self, hit: Column) -> Column:
        return F.shiftright(hit, self.bits)

    def token(self, hit: Column) -> Column:
        return hit.bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))


def _phrase_starts(hits: Column, tokens: _Tokens, phrase: list[str]) -> Column:
    """The places where a phrase's words stand consecutively."""
    numbers = [tokens.number[w] for w in phrase]

    def start(h, i):
        stands = tokens.token(h) == numbers[0]
        for k, n in enumerate(numbers[1:], 1):
            stands = stands & (F.get(hits, i + k) == h + ((k << tokens.bits) + n - numbers[0]))
        return F.when(stands, tokens.at(h))

    return F.filter(F.transform(hits, start), lambda x: x.isNotNull())


def _index(tokens: _Tokens, ordered: list[list[str]], widths: list[int], tau: float) -> dict[int, list[Column]]:
    """{prefix token: its templates}, each with its place in the list, its tokens from that one on, how many it has and needs, and a block's words."""
    out: dict[int, list[Column]] = {}
    for k, (words, width) in enumerate(zip(ordered, widths, strict=True)):
        need = math.ceil(tau * len(words) - 1e-9)
        for i, w in enumerate(words[: len(words) - need + 1]):
            rest = F.array(*[F.lit(tokens.number[x]).cast("long") for x in words[i:]])
            out.setdefault(tokens.number[w], []).append(F.struct(F.lit(k).alias("k"), rest.alias("rest"), F.lit(len(words)).alias("n"), F.lit(need).alias("need"), F.lit(width).alias("width")))
    return out


def _matches(hits: Column, n_words: Column, tokens: _Tokens, index: dict[int, list[Column]]) -> Column:
    """(template, share of its tokens) of the candidates that some block confirms."""
    by_token = F.create_map(*[x for t, found in index.items() for x in (F.lit(t).cast("long"), F.array(*found))])
    distinct = lambda hs: F.size(F.array_distinct(F.transform(hs, tokens.token)))

    def confirmed(h, i):
        def by_template(c):
            within = lambda x: (F.abs(tokens.at(x) - tokens.at(h)) < c["width"]) & F.array_contains(c["rest"], tokens.token(x))
            near = F.filter(F.slice(hits, F.greatest(i + 2 - c["width"], F.lit(1)), c["width"] * 2 - 1), within)

            def best(near):
                # a block may as well start at the first of the template's tokens that it holds
                starts = F.filter(near, lambda x: tokens.at(x) <= tokens.at(h))
                held = F.transform(starts, lambda s: distinct(F.filter(near, lambda x: (x >= s) & (tokens.at(x) < tokens.at(s) + c["width"]))))
                return F.when(distinct(near) >= c["need"], F.array_max(held))

            count = F.get(F.transform(F.array(near), best), F.lit(0))
            found = F.transform(F.array(count), lambda m: F.when(m >= c["need"], F.struct(c["k"].alias("k"), (m / c["n"].cast("double")).alias("share"))))
            return F.when(n_words >= c["need"], F.get(found, F.lit(0)))

        return F.when(tokens.token(h).isin(list(index)), F.transform(F.element_at(by_token, tokens.token(h)), by_template))

    per_hit = F.filter(F.transform(hits, confirmed), lambda x: x.isNotNull())
    return F.filter(F.flatten(per_hit), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, phrases: dict = PHRASES, templates: dict = TEMPLATES, tau: float = TAU) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    Null and empty texts have no words, places or labels and score 0. Repeated rows are scanned each, columns
    with clashing names are no matter, and an empty table gives an empty result. The score is 1 where a base
    phrase stands, else the largest share of a template's distinct tokens in a block, if that reaches tau, else
    0. Labels that several templates give stand once.
    """
    listed = [(label, _words(t)) for label, texts in sorted(templates.items()) for t in texts]
    tokens = _Tokens({w for _, ws in listed for w in ws} | {w for p in phrases for w in p.split()})
    rows = pick(docs, "doc_id", "text").select("doc_id", F.array_remove(F.split(_lowered(F.col("text")), GAP), "").alias("words"))
    rows = written(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), tokens.hits(F.col("words")).alias("hits")), "hits")

    # at most a row per token of the vocabulary
    seen = {r.token: r.n for r in rows.select(F.explode(F.array_distinct(F.transform("hits", tokens.token))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = lambda w: (seen.get(tokens.number[w], 0), w)
    index = _index(tokens, [sorted(set(ws), key=rank) for _, ws in listed], [len(ws) for _, ws in listed], tau)

    starts = F.array(*[_phrase_starts(F.col("hits"), tokens, p.split()) for p in phrases])
    found = _matches(F.col("hits"), F.col("n_words"), tokens, index) if index else F.array().cast("array<struct<k:int,share:double>>")
    rows = rows.select("doc_id", "n_words", starts.alias("starts"), found.alias("found"))
    rows = rows.withColumn("flat", F.flatten("starts"))
    base = F.filter(F.array(*[F.when(F.size(F.get("starts", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]), lambda x: x.isNotNull())
    more = F.transform("found", lambda x: F.get(F.array(*[F.lit(label) for label, _ in listed]), x["k"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("flat").cast("long").alias("n_base"),
        F.array_min("flat").alias("first_word"),
        F.array_max("flat").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("flat") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    spots = ", ".join(f"list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {j + 1}] = {chr(39)}{w}{chr(39)}' for j, w in enumerate(p.split()))})" for p in PHRASES)
    listed = [(label, _words(t)) for label, texts in sorted(TEMPLATES.items()) for t in texts]

    def share(words: list[str]) -> str:
        held, width, n = quoted(dict.fromkeys(words)), len(words), len(set(words))
        blocks = f"list_transform(list_filter(range(len(words)), lambda i: list_contains({held}, words[i + 1])), lambda i: len(list_intersect({held}, words[i + 1:i + {width}])))"
        return f"CASE WHEN len(list_intersect({held}, words)) >= {TAU} * {n} - 1e-9 THEN list_max({blocks}) / {n}.0 END"

    best = ", ".join(share(ws) for _, ws in listed)
    base = ", ".join(f"CASE WHEN len(starts[{i + 1}]) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    more = ", ".join(f"CASE WHEN best[{i + 1}] >= {TAU} - 1e-9 THEN '{label}' END" for i, (label, _) in enumerate(listed))
    return f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, {word}) AS words FROM l),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, [{spots}] AS starts, [{best}] AS best FROM w),
f AS (SELECT *, flatten(starts) AS flat, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{more}], lambda x: x IS NOT NULL) AS more FROM s)
SELECT doc_id, n_words, len(flat)::BIGINT AS n_base, list_min(flat)::BIGINT AS first_word, list_max(flat)::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
    CASE WHEN len(flat) > 0 THEN 1.0 WHEN list_max(best) >= {TAU} - 1e-9 THEN list_max(best) ELSE 0.0 END::DOUBLE AS score
FROM f"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _sql()}
