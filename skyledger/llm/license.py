"""License notices in texts, by an exact set-similarity join with templates; Spark expressions only.

Texts are cut into overlapping blocks, twice as long as the longest template, so that a notice lies
in one block whole even if its lines are wrapped. A block meets a template when it has at least
``threshold`` of the template's distinct words. Words are ordered by their frequency in the whole
corpus, rare first; a block can only meet a template if it has a word of the template's prefix, and
length and position cut pairs before they are verified on all words.

Notices of different licenses differ in a word or a number, so a set of words alone can't tell them
apart. A template therefore names the words that must stand in a row (its mark), and a block that
meets it is labelled only if it has them.

Defined results: a null or empty text has no words, no places and no labels; a text of any length is
read whole; every row has the labels of its own text, whatever its id, which may be null or stand in
other rows; templates that a block meets equally well all label it; extra columns, whatever their names,
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# Phrases that are counted, and public license notices.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Templates: label, mark, notice.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("cc-by-nc-4.0", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "waived all copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved", "all rights reserved"),
]


def lowered(text: Column) -> Column:
    """Letters beyond ASCII change too. They stay word characters, and none becomes a letter of a counted phrase, so counts and places are those of lower-casing A-Z."""
    return F.lower(text)


def listed(words: set[str] | list[str]) -> Column:
    return F.lit(sorted(words))


def places(phrase: str) -> Column:
    """Where in ``words`` a phrase starts, from 0; texts that lack one of its words (see ``known``) aren't searched."""
    own = phrase.split()
    here = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words") - len(own) + 1, F.lit(1))), lambda i: reduce(lambda x, y: x & y, (F.try_element_at("words", i + k).eqNullSafe(w) for k, w in enumerate(own))))
    return F.when(F.size(F.array_intersect("known", listed(own))) == len(set(own)), F.transform(here, lambda i: (i - 1).cast("long"))).otherwise(F.array().cast("array<long>"))


def needs(templates: list[tuple[str, str, str]], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, least number of them that a block must have) of every template."""
    sets = [(label, sorted(set(text.split()))) for label, _, text in templates]
    return [(label, own, math.ceil(threshold * len(own) - 1e-9)) for label, own in sets]


def read_once(rows: DataFrame, templates: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """(doc_id, n_words, one array of places per phrase, known, blocks) of rows (doc_id, low): all that is taken from whole texts.

    ``known`` has the distinct words of a text that templates or phrases have, ``blocks`` those of each
    block, and the marks in it. Texts too poor in a template's words for any template have no blocks.
    """
    limits = needs(templates, threshold)
    vocabulary = {w for _, own, _ in limits for w in own} | {w for p in PHRASES.values() for w in p.split()}
    step = max(len(text.split()) for *_, text in templates)
    words = rows.select("doc_id", F.array_remove(F.split("low", f"{SEPARATOR}+"), "").alias("words"))
    known = words.withColumn("known", F.array_intersect("words", listed(vocabulary)))
    rich = reduce(lambda x, y: x | y, (F.size(F.array_intersect("known", listed(own))) >= need for _, own, need in limits))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    cut = lambda s: F.slice("words", s + 1, F.lit(2 * step))
    said = lambda s: F.concat(F.lit(" "), F.array_join(cut(s), " "), F.lit(" "))
    marks = lambda s: F.filter(listed({mark for _, mark, _ in templates}), lambda m: F.contains(said(s), F.concat(F.lit(" "), m, F.lit(" "))))
    blocks = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.array_intersect(cut(s), listed(vocabulary)).alias("block"), marks(s).alias("marks")))
    return known.select("doc_id", F.size("words").cast("long").alias("n_words"), *(places(p).alias(k) for k, p in PHRASES.items()), "known", F.when(rich, blocks).alias("blocks"))


def matches(read: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, start, label, marked, containment) of every block of rows (key, known, blocks) that meets a template; start is in words."""
    # The templates' words alone, with their document frequencies, come to the driver: as many rows as the list has words.
    frequency = {r["word"]: r["n"] for r in read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    limits = needs(templates, threshold)
    order = sorted({w for _, own, _ in limits for w in own}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for k, (label, words, need) in enumerate(limits):
        own = sorted(words, key=rank.__getitem__)
        index += [(w, k, label, templates[k][1], pos, len(own), need, own) for pos, w in enumerate(own[: len(own) - need + 1])]
    prefix = read.sparkSession.createDataFrame(index, "word string, template int, label string, mark string, t_pos int, t_size int, need int, own array<string>")
    least = min(need for *_, need in limits)
    blocks = read.select(key, F.explode("blocks").alias("x")).select(key, "x.start", "x.marks", F.array_intersect(F.lit(order), F.col("x.block")).alias("block"))
    at = blocks.filter((F.size("block") >= least) & F.arrays_overlap("block", listed({w for w, *_ in index}))).select(key, "start", "marks", "block", F.posexplode("block").alias("b_pos", "word"))
    # The index has as many rows as the templates have prefix words.
    pairs = at.join(F.broadcast(prefix), "word").filter((F.size("block") >= F.col("need")) & (F.least(F.size("block") - F.col("b_pos"), F.col("t_size") - F.col("t_pos")) >= F.col("need")))
    shared = F.size(F.array_intersect("own", "block"))
    return pairs.filter(shared >= F.col("need")).select(key, "start", "label", F.expr("array_contains(marks, mark)").alias("marked"), (shared / F.col("t_size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 with a counted phrase) per row."""
    rows = common.texts(docs, id_col, text_col).select("doc_id", lowered(F.col("text")).alias("low"))
    # Texts are split once: what is kept of them is small.
    read = common.saved(read_once(rows, templates, threshold).withColumn("row", F.monotonically_increasing_id()), "license")
    more = matches(read, templates, threshold, "row").filter("marked").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = F.concat(*(F.col(f"`{k}`") for k in PHRASES))
    base = F.array_compact(F.array(*(F.when(F.size(F.col(f"`{k}`")) > 0, k) for k in PHRASES)))
    joined = read.select("row", "doc_id", "n_words", F.size(found).cast("long").alias("n_base"), F.array_min(found).alias("first_word"), F.array_max(found).alias("last_word"), base.alias("base")).join(more, "row", "left")
    sorted_ = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", sorted_(F.col("base")).alias("base_labels"),
        sorted_(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
