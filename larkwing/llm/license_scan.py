"""License scans as an exact set-similarity join of word blocks with license templates, in DataFrame operations only.

A text's words are cut into overlapping blocks, 64 words, one every 32, for templates of up to 33 words. Longer templates, whole
license texts too, have blocks twice, four times, ... as long, so that a block holds the template wherever it starts. A block
matches a template when it holds at least the threshold share of the template's distinct words (containment). Template words are ordered by their frequency in the
whole corpus, rarest first, and the join prunes with that order:

* prefix filter: of |T| words, ceil(threshold |T|) must be in the block, so one of the rarest |T| - need + 1 must be; blocks
  without such a word are never formed, and a text without one is not looked at again;
* length filter: a block needs at least `need` distinct template words;
* positional filter: what follows the first common prefix word, on both sides of the order, bounds the overlap.

Survivors are verified by the size of the intersection. Templates of base phrases need all their words; the places where the
phrase stands word by word are then read off inside the matched block. A place is counted in the block in whose first half
it starts, so each is counted once and a phrase across lines is found.

Everything but the frequency count (one pass, a row per template word) is local to a row: no shuffle, no group, hence no skew.

Defined cases: null or empty text and texts without words have no blocks (n_words 0, labels empty, score 0); repeated rows
each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Least distance of blocks, in words; a block is twice as long.
STEP = 32
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words, notices and whole texts of public licenses, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
]


def _split(text: str) -> list[str]:
    return [w for w in re.split(WORD_BREAK, text.lower()) if w]


def step_of(n_words: int) -> int:
    """The distance of the blocks for a template of n_words: a block of twice the length holds it wherever it starts."""
    step = STEP
    while n_words > step + 1:
        step *= 2
    return step


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates occurs in the corpus: one pass, one row per template word to the driver."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").count()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found.collect()}


def _strings(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches): matches has one struct for
    each block and template that meet the threshold (label, is_base, start word of the block, containment); score is the
    largest containment among them, else 0."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    items = [(label, True, _split(phrase)) for phrase, label in base.items()] + [(label, False, _split(text)) for label, text in templates]
    if any(not ws for *_, ws in items):
        raise ValueError("a template without words")
    vocabulary = sorted({w for *_, ws in items for w in ws})
    count = frequencies(docs, text_col, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count[w], w))
    rank = {w: i for i, w in enumerate(order)}

    literals, prefixes, known = defaultdict(list), defaultdict(set), defaultdict(set)  # by step
    for label, is_base, ws in items:
        tokens = sorted({rank[w] for w in ws})
        need = len(tokens) if is_base else max(1, math.ceil(threshold * len(tokens) - 1e-9))
        prefix = tokens[: len(tokens) - need + 1]
        step = step_of(len(ws))
        known[step] |= set(ws)
        prefixes[step] |= {order[r] for r in prefix}
        literals[step].append(F.struct(
            F.lit(label).alias("label"), F.lit(is_base).alias("is_base"), F.array(*map(F.lit, tokens)).alias("ranks"), F.array(*map(F.lit, prefix)).alias("prefix"),
            F.lit(need).alias("need"), _strings(ws if is_base else []).alias("phrase"),
        ))
    ranks = F.create_map(*(F.lit(x) for w in order for x in (w, rank[w])))
    out = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))

    def match(b: Column, step: int) -> Column:
        block = F.slice("ws", (b * step + 1).cast("int"), 2 * step)
        own = F.array_sort(F.filter(F.transform(F.array_distinct(F.filter(block, lambda w: w.isin(sorted(known[step])))), lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull()))

        def with_templates(own: Column) -> Column:
            def candidate(t: Column) -> Column:
                common = F.array_min(F.array_intersect(t["prefix"], own))
                left = F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], common), F.size(own) - F.array_position(own, common))
                return (F.size(own) >= t["need"]) & F.arrays_overlap(t["prefix"], own) & (left + 1 >= t["need"])

            def verified(t: Column) -> Column:
                overlap = F.size(F.array_intersect(t["ranks"], own))
                phrase = F.size(t["phrase"])
                starts = F.filter(
                    F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: (b * step + i).cast("int")),
                    lambda p: t["is_base"] & (F.slice("ws", p + 1, phrase) == t["phrase"]),
                )
                return F.struct(t["label"].alias("label"), t["is_base"].alias("is_base"), (b * step).cast("long").alias("start"), (overlap / F.size(t["ranks"])).alias("containment"), (overlap >= t["need"]).alias("ok"), F.when(t["is_base"], starts).alias("places"))

            return F.filter(F.transform(F.filter(F.array(*literals[step]), candidate), verified), lambda m: m["ok"] & (~m["is_base"] | (F.size(m["places"]) > 0)))

        return F.flatten(F.transform(F.array(own), with_templates))

    nothing = F.array().cast("array<struct<label:string,is_base:boolean,start:bigint,containment:double,ok:boolean,places:array<int>>>")
    def matches(step: int) -> Column:
        # words that are in some prefix: their places, and the blocks that hold them
        rare, at, blocks = sorted(prefixes[step]), f"at_{step}", f"blocks_{step}"
        nonlocal out
        places = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.get("ws", i).isin(rare))
        holding = F.transform(at, lambda p: F.array(F.greatest(F.floor(p / step) - 1, F.lit(0)), F.floor(p / step)))
        out = out.withColumn(at, F.when(F.arrays_overlap("ws", _strings(rare)), places))
        out = out.withColumn(blocks, F.when(F.col(at).isNotNull(), F.array_distinct(F.flatten(holding))))
        return F.coalesce(F.when(F.size(blocks) > 0, F.flatten(F.transform(blocks, lambda b: match(b, step)))), nothing)

    found = [matches(step) for step in sorted(prefixes)]
    out = out.withColumn("m", F.concat(*found) if found else nothing)
    base_places = F.flatten(F.transform(F.filter("m", lambda m: m["is_base"]), lambda m: m["places"]))
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return out.withColumn("places", base_places).select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.filter("m", lambda m: m["is_base"])).alias("base_labels"),
        joined(F.col("m")).alias("labels"),
        F.coalesce(F.array_max(F.transform("m", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
        F.transform("m", lambda m: F.struct(m["label"].alias("label"), m["is_base"].alias("is_base"), m["start"].alias("start"), m["containment"].alias("containment"))).alias("matches"),
    )
