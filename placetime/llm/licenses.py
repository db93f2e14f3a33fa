"""License scans: an exact set-similarity join of text blocks with license templates, DataFrame operations only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm.tables import Tables

#: Phrases that name a license, and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as their licenses recommend them (fixed values: public texts), by label.
TEMPLATES = {
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met"
    ),
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation"
    ),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the Software), to deal in the Software without restriction"
    ),
    "mit-short-notice": "This project is released under the terms of the MIT license, see the license file for details",
    "mpl-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
        " MPL was not distributed with this file, You can obtain one at"
    ),
    "warranty-disclaimer": (
        "The software is provided as is, without warranty of any kind, express or implied, including but not"
        " limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"
    ),
}

#: License texts (fixed values: public texts, without names and years), by label.
TEXTS = {
    "bsd-3-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. Neither the name of the copyright"
        " holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " The software is provided as is and the author disclaims all warranties with regard to this software"
        " including all implied warranties of merchantability and fitness. In no event shall the author be liable"
        " for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss"
        " of use, data or profits, whether in an action of contract, negligence or other tortious action, arising"
        " out of or in connection with the use or performance of this software."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. The Software is provided as is, without warranty of any kind, express"
        " or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose"
        " and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or"
        " other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection"
        " with the Software or the use or other dealings in the Software."
    ),
}

#: What stands between words, once A-Z are small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "array<struct<label: string, word: string, need: int, t_at: int, run: int, words: array<string>>>"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaced(text: Column) -> Column:
    """Words of a text in small letters, one blank before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), BETWEEN, " ")), F.lit(" "))


BASE_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def phrase_hits(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word and base_labels: where the phrases' words stand
    consecutively in the whole text.

    Only texts in which some phrase may stand are taken apart; one pass without a shuffle. A place is
    where a phrase begins, so phrases may overlap. Columns called like a result give way to it.
    """
    kept = [c for c in docs.columns if c not in BASE_COLUMNS]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    loose = "|".join(p.replace(" ", BETWEEN) for p in phrases)
    maybe = F.when(text.rlike(f"(?i)(?:{loose})"), F.split(F.trim(_spaced(text)), " "))
    marked = docs.select(row, F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n"), maybe.alias("words"))

    def places(phrase: str) -> Column:
        parts = phrase.split(" ")
        starts = F.sequence(F.lit(0), F.size("words") - len(parts))
        stands = lambda i: reduce(Column.__and__, [F.get("words", i + k) == part for k, part in enumerate(parts)])
        return F.when(F.size("words") >= len(parts), F.filter(starts, stands))

    none = F.array().cast("array<int>")
    each = F.array(*[F.coalesce(places(p), none) for p in phrases])
    marked = marked.withColumn("each", F.when(F.col("words").isNotNull(), each)).withColumn("places", F.flatten("each"))
    any_hit = F.coalesce(F.size("places") > 0, F.lit(False))
    labels = F.array(*[F.when(F.size(F.get("each", F.lit(k))) > 0, label) for k, label in enumerate(phrases.values())])
    results = F.struct(
        F.col("n").alias("n_words"),
        F.when(any_hit, F.size("places")).otherwise(0).cast("long").alias("n_base"),
        F.when(any_hit, F.array_min("places").cast("long")).alias("first_word"),
        F.when(any_hit, F.array_max("places").cast("long")).alias("last_word"),
        F.when(any_hit, F.array_sort(F.array_distinct(F.array_compact(labels)))).otherwise(F.array().cast("array<string>")).alias("base_labels"),
    )
    return marked.select("row", results.alias("results")).select("row.*", "results.*")


def template_matches(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: int = 80,
    key_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    block_end: str = "\n",
    across_lines: bool = False,
) -> DataFrame:
    """(keys, block, label, containment): every block of a text that holds at least `threshold` % of the
    different words of a template; blocks end at `block_end`.

    With `across_lines`, line ends don't matter: a template is looked for in every run of consecutive words
    of the whole text that is no longer than 5/4 of the template. Runs are taken in blocks of twice the longest
    run that overlap by half, so each run lies in one; containment is that of the block's best run.

    Words are ordered by the number of blocks (with `across_lines`: of texts) of the whole table that hold
    them, rare first. For a template of n words and an overlap of at least a, one of its first n - a + 1
    words must be among a block's first m - a + 1, where m of the block's words belong to any template;
    blocks and templates are joined on these prefixes, with m >= a (length) and with enough words left behind
    the place of the shared one (position). Each pair is joined on the first word it shares, so it is
    verified once. What is broadcast is made from the templates alone, a few words each.
    """
    spark = docs.sparkSession
    keys = list(key_cols)
    all_words = {label: [w for w in re.split(BETWEEN, notice.lower()) if w] for label, notice in templates.items()}
    known = {label: list(dict.fromkeys(notice)) for label, notice in all_words.items() if notice}
    if not known:
        return docs.select(*keys, F.lit(0).cast("long").alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    run_of = {label: 5 * len(all_words[label]) // 4 for label in known}
    longest = max(run_of.values())
    vocabulary = sorted({word for notice in known.values() for word in notice})
    least = {label: -(-threshold * len(notice) // 100) for label, notice in known.items()}

    def literal(words: Iterable[str]) -> Column:
        return F.from_json(F.lit(json.dumps(list(words))), "array<string>")

    words = F.split(F.trim(F.regexp_replace(F.lower(text_col if across_lines else "line"), BETWEEN, " ")), " ")
    if across_lines:
        whole = docs.select(*keys, F.lit(0).cast("long").alias("block"), words.alias("words_of_block"))
    else:
        lines = docs.select(*keys, F.posexplode(F.split(F.col(text_col), block_end)).alias("block", "line"))
        whole = lines.select(*keys, F.col("block").cast("long").alias("block"), words.alias("words_of_block"))
    holding = whole.select(F.explode(F.array_intersect(literal(vocabulary), F.col("words_of_block"))).alias("word"))
    counted = {r["word"]: r["n"] for r in holding.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda word: (counted.get(word, 0), word))
    place = {word: i for i, word in enumerate(ordered)}

    index, heads_of_any = [], set()
    for label, notice in known.items():
        rare_first, need = sorted(notice, key=place.get), least[label]
        for i in range(len(notice) - need + 1):
            index.append({"label": label, "word": rare_first[i], "need": need, "t_at": i, "run": run_of[label], "words": rare_first})
            heads_of_any.add(rare_first[i])
    indexed = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), INDEX)))

    blocks = whole
    if across_lines:
        last = F.floor(F.greatest(F.size("words_of_block") - longest, F.lit(0)) / longest).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words_of_block", k * longest + 1, 2 * longest))
        blocks = whole.select(*keys, F.posexplode(cut).alias("block", "words_of_block")).withColumn("block", F.col("block").cast("long"))
    # The intersection keeps the order of its first list, so a block's words come rare first.
    found = F.array_intersect(literal(ordered), F.col("words_of_block"))
    smallest = min(least.values())
    blocks = blocks.withColumn("found", found).withColumn("head", F.slice("found", F.lit(1), F.greatest(F.size("found") - smallest + 1, F.lit(0))))
    # A block's prefix goes on if it holds a word of any template's prefix, as others meet nothing in the join.
    blocks = blocks.filter(F.arrays_overlap("head", literal(sorted(heads_of_any))))
    heads = blocks.select(*keys, "block", "found", "words_of_block", F.posexplode("head").alias("b_at", "word"))
    m, n = F.size("found"), F.size("words")
    fits = (m >= F.col("need")) & (F.least(n - F.col("t_at"), m - F.col("b_at")) >= F.col("need"))
    pairs = heads.join(F.broadcast(indexed), "word").filter(fits)
    verified = pairs.withColumn("common", F.array_intersect("words", "found"))
    verified = verified.filter((F.element_at("common", 1) == F.col("word")) & (F.size("common") >= F.col("need")))
    held = F.size("common")
    if across_lines:
        begins = F.sequence(F.lit(1), F.greatest(F.size("words_of_block") - F.col("run"), F.lit(0)) + 1)
        held = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect("words", F.slice("words_of_block", i, F.col("run"))))))
    out = verified.withColumn("held", held).filter("held >= need")
    return Tables(spark, "licenses").settle(out.select(*keys, "block", "label", (F.col("held") / F.size("words")).alias("containment")))


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    across_lines: bool = False,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base counts the places of license phrases in the whole text (see `phrase_hits`); to its
    labels come those of the templates that some line of the text holds to `threshold` %, or with
    `across_lines` some run of words, whatever its line ends (see `template_matches`). The score is 1 with a phrase, else the greatest containment found, else 0.

    Null and empty texts have no words, no places and empty labels. Repeated rows give a row each,
    rows that share an id but not the text are told apart, and null ids are documents of their own.
    Other columns don't matter. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    base = phrase_hits(rows, phrases).drop("text")
    matches = template_matches(rows, templates, threshold, ("doc_id", "text_hash"), across_lines=across_lines)
    per_doc = matches.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )

