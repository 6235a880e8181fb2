"""Licence scans by a positional index of rare tokens, in DataFrame operations only.

Every licence template, a whole licence text or the notice that points to one, is a word sequence with a mandatory key phrase. Document frequencies of
all words of the templates are counted over all documents. The index holds postings (template, place) of each template's rarest words and of its
key phrase. Of a file the words in the index are ranked by inverse document frequency, and the highest ones (and the key phrases' rarest) are looked up: a hit at
place p of a word posted at place q stands for the template at p - q. Postings are intersected by that relative position: a template is a candidate where its key phrase's
rarest word and another one agree. Then the key phrase is verified word by word, and the template's score is the share of the weight of all its words
that stand where it has them; ``ENOUGH`` of it makes a label. No candidate is lost: where a key phrase stands, all its words were looked up.

Base phrases are found by their rarest word, and verified word by word too. Texts are read twice: for the frequencies, and for the scan, which goes beyond a
look for the key phrases' rarest words in the texts that have one.

Defined results: a null text is empty and has no words, labels or places, score 0; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Fixed texts: whole licences, in lower-case words.
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any
special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
connection with the use or performance of this software"""
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without
limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including
but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether
in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice
this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed"""
BOOST = """boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled
binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to
the public domain"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to
use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"""
# Further templates: label, words of the template, mandatory key phrase.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("artistic", "under the terms of the artistic license", "artistic license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "this software is released under the bsd license", "bsd license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under the creative commons attribution license", "creative commons attribution license"),
    ("cc0", "released into the public domain under cc0", "under cc0"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", ISC, "is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", MIT, "permission is hereby granted"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("proprietary", "this software is proprietary and confidential unauthorized copying is strictly prohibited", "proprietary and confidential"),
    ("bsd", BSD, "redistributions of source code must retain"),
    ("boost", BOOST, "boost software license"),
    ("unlicense", UNLICENSE, "free and unencumbered software"),
    ("zlib", ZLIB, "permission is granted to anyone"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "permission is granted to anyone"),
)
#: Share of a template's weight that has to meet at one place.
ENOUGH = 0.5
#: Least weight of a word, however common it is.
FLOOR = 0.01
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Rarest words of a template that are posted beside its key phrase, and of a file that are looked up beside the key phrases'.
POSTED, LOOKED_UP = 6, 12


def _lower(text: Column) -> Column:
    """A-Z lowered. ``lower`` does it too, but turns two other characters into ASCII letters; those that it changes otherwise stay outside of ASCII, where no phrase is."""
    text = F.coalesce(text, F.lit(""))
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("\u0130") | text.contains("\u212a"), exact).otherwise(F.lower(text))


def vocabulary() -> list[str]:
    texts = [p for p, _ in BASE] + [t for _, t, _ in TEMPLATES]
    return sorted({w for t in texts for w in t.split()})


def rarity(docs: DataFrame, text_col: str) -> dict[str, float]:
    """The inverse document frequency over all documents of each word of the templates."""
    known = F.array(*(F.lit(w) for w in vocabulary()))
    words = docs.select(F.array_intersect(F.regexp_extract_all(_lower(F.col(text_col)), F.lit(WORD), 0), known).alias("w"))
    counted = words.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in counted.collect()}  # as long as the vocabulary; the empty word counts documents
    return {w: max(math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)), FLOOR) for w in vocabulary()}


# What is done with a file's words ``w``, as SQL: Spark reads a text faster than thousands of calls. Words of the templates are of a-z and 0-9.


def _words(words) -> str:
    return f"array({', '.join(repr(w) for w in words)})"


def _rarest(words, idf: dict[str, float]) -> str:
    return max(sorted(set(words)), key=lambda w: idf[w])


def _base(phrase: str, idf: dict[str, float]) -> str:
    """All places where a phrase stands, found by its rarest word."""
    words = phrase.split()
    rare = _rarest(words, idf)
    k = words.index(rare)
    at = f"filter(transform(w, (x, i) -> IF(x = '{rare}' AND i >= {k} AND slice(w, greatest(i - {k - 1}, 1), {len(words)}) = {_words(words)}, CAST(i - {k} AS BIGINT), NULL)), p -> p IS NOT NULL)"
    return f"CASE WHEN array_contains(w, '{rare}') THEN {at} ELSE array() END"


def index(idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[int]]]:
    """(postings: (template, place) of each word; the templates of each word that is the rarest of their key phrases)."""
    postings: dict[str, list[tuple[int, int]]] = {}
    anchors: dict[str, list[int]] = {}
    for t, (_, text, key) in enumerate(TEMPLATES):
        words = text.split()
        posted = {*sorted(set(words), key=lambda w: (-idf[w], w))[:POSTED], *key.split()}
        for q, w in enumerate(words):
            if w in posted:
                postings.setdefault(w, []).append((t, q))
        anchors.setdefault(_rarest(key.split(), idf), []).append(t)
    return postings, anchors


def _candidates(idf: dict[str, float]) -> str:
    """Array of (t, at) where a template's key phrase may start: the rarest word of the key phrase and another posted word agree on where the template begins."""
    postings, anchors = index(idf)
    posts = "map(" + ", ".join(f"'{w}', array({', '.join(f'named_struct({chr(39)}t{chr(39)}, {t}, {chr(39)}q{chr(39)}, {q})' for t, q in at)})" for w, at in postings.items()) + ")"
    weights = "map(" + ", ".join(f"'{w}', {idf[w]!r}D" for w in postings) + ")"
    must = sorted({w for _, _, key in TEMPLATES for w in key.split()})
    ranked = f"slice(array_sort(array_intersect(w, {_words(postings)}), (a, b) -> CASE WHEN {weights}[a] > {weights}[b] THEN -1 WHEN {weights}[a] < {weights}[b] THEN 1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END), 1, {LOOKED_UP})"
    looked_up = f"array_union({ranked}, array_intersect(w, {_words(must)}))"
    hits = "filter(transform(w, (x, i) -> IF(array_contains(l, x), named_struct('x', x, 'i', i), NULL)), h -> h IS NOT NULL)"
    key_of = "map(" + ", ".join(f"'{w}', array({', '.join(map(str, ts))})" for w, ts in anchors.items()) + ")"
    votes = f"flatten(transform({hits}, h -> transform({posts}[h.x], p -> named_struct('t', p.t, 'at', h.i - p.q, 'x', h.x))))"
    # votes in order of (template, start): a start is kept when its second word votes, and an anchor is among its words
    grouped = ("aggregate(array_sort(v), named_struct('t', -1, 'at', -1, 'x', '', 'n', 0, 'key', false, 'out', CAST(array() AS ARRAY<STRUCT<t: INT, at: INT>>)), (a, y) -> "
               "named_struct('t', y.t, 'at', y.at, 'x', y.x, "
               "'n', IF(a.t = y.t AND a.at = y.at, a.n + IF(a.x = y.x, 0, 1), 1), "
               f"'key', (a.t = y.t AND a.at = y.at AND a.key) OR coalesce(array_contains(try_element_at({key_of}, y.x), y.t), false), "
               "'out', IF((IF(a.t = y.t AND a.at = y.at, a.n + IF(a.x = y.x, 0, 1), 1)) >= 2 AND ((a.t = y.t AND a.at = y.at AND a.key) OR "
               f"coalesce(array_contains(try_element_at({key_of}, y.x), y.t), false)), array_union(a.out, array(named_struct('t', y.t, 'at', y.at))), a.out))).out")
    chosen = f"transform(array({looked_up}), l -> transform(array({votes}), v -> {grouped})[0])[0]"
    return f"CASE WHEN arrays_overlap(w, {_words(anchors)}) THEN {chosen} ELSE CAST(array() AS ARRAY<STRUCT<t: INT, at: INT>>) END"


def _found(idf: dict[str, float]) -> str:
    """Array of (t, share) of the candidates whose key phrase stands where it must."""
    texts = [text.split() for _, text, _ in TEMPLATES]
    keys = [key.split() for _, _, key in TEMPLATES]
    offsets = [len(text[: text.index(key)].split()) for _, text, key in TEMPLATES]
    of = lambda values: f"array({', '.join(values)})"
    words, key = of(_words(x) for x in texts), of(_words(x) for x in keys)
    weights = of(of(f"{idf[w]!r}D" for w in x) for x in texts)
    offset, total = of(map(str, offsets)), of(f"{sum(idf[w] for w in x)!r}D" for x in texts)
    begin = f"c.at + {offset}[c.t]"
    verified = f"filter(c0, c -> {begin} >= 0 AND slice(w, greatest({begin}, 0) + 1, size({key}[c.t])) = {key}[c.t])"
    # a template may begin before the text does: its first words are missing then
    equal = f"transform({words}[c.t], (x, k) -> IF(c.at + k >= 0 AND get(w, c.at + k) = x, {weights}[c.t][k], 0D))"
    share = f"least(aggregate({equal}, 0D, (a, x) -> a + x) / {total}[c.t], 1D)"
    return f"transform({verified}, c -> named_struct('t', c.t, 'share', {share}))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base_places: all places of base phrases, base_labels, labels, score) for every row."""
    idf = rarity(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(_lower(F.col(text_col)), F.lit(WORD), 0).alias("w"))
    rows = rows.selectExpr("id", "size(w) AS n_words", "w", f"{_candidates(idf)} AS c0", *(f"{_base(p, idf)} AS b{k}" for k, (p, _) in enumerate(BASE)))
    rows = rows.selectExpr("id", "n_words", *(f"b{k}" for k in range(len(BASE))), f"CASE WHEN size(c0) > 0 THEN {_found(idf)} ELSE CAST(array() AS ARRAY<STRUCT<t: INT, share: DOUBLE>>) END AS found")
    every = f"concat({', '.join(f'b{k}' for k in range(len(BASE)))})"
    base = f"array({', '.join(f'IF(size(b{k}) > 0, {label!r}, NULL)' for k, (_, label) in enumerate(BASE))})"
    names = f"array({', '.join(repr(label) for label, _, _ in TEMPLATES)})"
    more = f"transform(filter(found, f -> f.share >= {ENOUGH}), f -> {names}[f.t])"
    joined = lambda labels: f"array_join(array_sort(array_distinct(array_compact({labels}))), ',')"
    return rows.selectExpr(
        "id", "CAST(n_words AS BIGINT) AS n_words", f"{every} AS base_places", f"{joined(base)} AS base_labels", f"{joined(f'concat({base}, {more})')} AS labels",
        f"greatest(IF(size({every}) > 0, 1D, 0D), coalesce(array_max(found.share), 0D)) AS score",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = scan(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").alias("first_word"), F.array_max("base_places").alias("last_word"), "base_labels", "labels",
        F.round("score", 6).alias("score"),
    )
