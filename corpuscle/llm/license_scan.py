"""License scans by an exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# License notices by label, as one writes them in a line and as they stand above a file's text. A window matches one if it holds THRESHOLD of its words.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
# Phrases that count wherever their words stand consecutively.
PHRASES = [("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved"))]
THRESHOLD = 0.85
#: Consecutive words of a text's window for each distinct word of a template.
SPREAD = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)


def words_of(text) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def token_order(docs: DataFrame, vocabulary: list[str], text_col: str) -> list[str]:
    """The templates' words, rarest first by the number of documents in ``docs`` that hold them; ties by word.

    Only these words can count towards a containment, so only they need an order. The
    result has a row for each word of the templates at most.
    """
    held = docs.select(F.explode(F.array_intersect(words_of(lowered(text_col)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_matches(
    docs: DataFrame, keys: list[str], text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Every (text window, template) with at least ``threshold`` of the template's distinct words in the window.

    Returns ``keys, block, label, template, containment``. A template's windows are all
    runs of ``SPREAD`` times its distinct words' number of consecutive words, wherever
    lines break. Words get a global order, rarest first. A template's prefix are its first
    ``size - need + 1`` words: a window that holds ``need`` of its words holds one of
    these. So every place of a prefix word is met, with the words around it, which hold
    all windows over it; the length filter asks for ``need`` words there, the positional
    filter that enough words of both follow the met pair in the order; what is left is
    counted exactly window by window. ``block`` is the met place, counted in words; a
    match comes once for each of these, with the best of its windows. Null, empty and
    wordless texts match nothing. ``templates`` are fixed and small, their index is a few
    literal rows.
    """
    sets = [(label, text, sorted(set(text.split()))) for label, text in templates]
    order = token_order(docs, sorted({w for _, _, ws in sets for w in ws}), text_col)
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, text, ws in sets:
        ranks, need = sorted(place[w] for w in ws), math.ceil(threshold * len(ws) - 1e-9)
        prefixes += [(r, j, label, text, ws, len(ranks), need, SPREAD * len(ranks)) for j, r in enumerate(ranks[: len(ranks) - need + 1])]
    spark = docs.sparkSession
    index = spark.createDataFrame(prefixes, "r int, j int, label string, template string, words array<string>, n int, need int, width int")
    rare = F.array(*[F.lit(order[r]) for r in sorted({p[0] for p in prefixes})])
    known = F.array(*map(F.lit, order))
    widest = SPREAD * max(len(ws) for _, _, ws in sets)
    texts = docs.select(*keys, words_of(lowered(text_col)).alias("_all")).filter(F.arrays_overlap("_all", rare))  # texts with a prefix word
    places = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda p: F.array_contains(rare, F.get("_all", p)))
    met = texts.select(*keys, F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), _around(F.col("_all"), p, F.lit(widest)).alias("near"), F.get("_all", p).alias("w")))).alias("_m"))
    met = met.select(*keys, F.col("_m.p").alias("block"), F.col("_m.near").alias("_near"), F.least("_m.p", F.lit(widest - 1)).alias("_at"), (F.array_position(known, F.col("_m.w")) - 1).cast("int").alias("_r"))
    met = met.join(F.broadcast(index), F.col("_r") == F.col("r"))
    met = met.withColumn("_near", _around(F.col("_near"), F.col("_at"), F.col("width"))).withColumn("_w", F.array_intersect(known, F.col("_near")))  # in the global order
    size, i = F.size("_w"), F.array_position("_w", F.element_at(known, F.col("_r") + 1)).cast("int") - 1
    met = met.filter(size >= F.col("need"))  # length
    # Positions: the met words before this pair in both lists bound what they share up to here.
    met = met.filter(F.least(i, F.col("j")) + F.least(size - i, F.col("n") - F.col("j")) >= F.col("need"))
    met = met.filter(F.size(F.array_intersect("_w", "words")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_near") - F.col("width") + 1, F.lit(1)))
    shared = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("_near", k, F.col("width")), F.col("words")))))
    found = met.withColumn("_shared", shared).filter(F.col("_shared") >= F.col("need"))
    return found.select(*keys, F.col("block").cast("long").alias("block"), "label", "template", (F.col("_shared") / F.col("n")).alias("containment"))


def _around(words: Column, place: Column, width: Column) -> Column:
    """The words of all windows of ``width`` words over ``place``."""
    first = F.greatest(place - width + 2, F.lit(1))
    return F.slice(words, first, place + width - first + 1)


def phrase_places(words: Column) -> Column:
    """Sorted struct<place, label> of every place where a phrase's words stand consecutively."""
    found = []
    empty = F.array().cast("array<struct<p:int,label:string>>")
    for label, phrase in PHRASES:
        has = _all([F.array_contains(words, w) for w in phrase])
        found.append(F.when(has, _places(words, label, phrase)).otherwise(empty))
    return F.array_sort(F.concat(*found))


def _places(words: Column, label: str, phrase: tuple[str, ...]) -> Column:
    here = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all([F.get(words, i + j) == F.lit(w) for j, w in enumerate(phrase)]))
    return F.transform(here, lambda i: F.struct(i.alias("p"), F.lit(label).alias("label")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """License labels of every document, by phrases and by template windows.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``,
    one row per input row. ``score`` is the best template containment found, 1.0 where a
    phrase stands, else 0.0. Null texts count as empty: no words, no labels, score 0.
    Rows may repeat, texts may be of any length; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    keyed = rows.withColumn("_x", F.xxhash64("_text"))
    base = keyed.select("_id", "_x", words_of(lowered("_text")).alias("_w")).select("_id", "_x", F.size("_w").cast("long").alias("n_words"), phrase_places(F.col("_w")).alias("_places"))
    matches = license_matches(keyed, ["_id", "_x"], "_text", threshold=threshold)
    matches = matches.groupBy("_id", "_x").agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
    found = matches.select(F.col("_id").alias("_mid"), F.col("_x").alias("_mx"), "_found", "_best")
    joined = base.join(found, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_x") == F.col("_mx")), "left")
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.get("_places", F.lit(0))["p"].cast("long").alias("first_word"),
        F.get("_places", F.size("_places") - 1)["p"].cast("long").alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base_labels, F.coalesce("_found", none)))).alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
