"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license text or notice; a text is cut into blocks that overlap by half, for each
template in the least of the lengths 48, 96, 192, .. words whose half holds the whole template, so that a notice that
stands in a text lies in some block whole.  A block matches when it holds at least ``THRESHOLD`` of the template's
words.  The match gets the template's label if its telling words stand together, no farther from the first of them than
the template is long, and no word that tells of another license stands there.

Words are ordered by the number of documents that hold them, rarest first.  A block that misses all of a template's
first m - o + 1 words (m its words, o the required overlap) can't reach o, so texts meet templates in an equi-join on
those words.  The length filter drops blocks of fewer than o distinct words, and the positional filter those in which
too few words come after the first shared one; what is left is counted exactly.  DataFrame functions only.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    """A text to look for: its label, its folded words, those that must all stand about the first of them, and those that
    must not."""

    label: str
    text: str
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()


# Fixed texts: public licenses and notices, in folded words.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache", "license", "2")),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license", ("apache", "license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether "
        "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage", ("redistributions", "retain"),
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution", "binary")),
    Template("agpl", "gnu affero general public license", ("affero", "gnu")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative", "commons", "attribution"), ("sharealike", "alike", "noncommercial", "commercial", "noderivatives", "noderivs", "derivatives")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc"), ("sa", "nd")),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative", "commons", "noncommercial"), ("sharealike", "alike", "noderivatives", "noderivs", "derivatives")),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc", "by", "nc", "nd")),
    Template("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("creative", "commons", "noncommercial", "noderivatives")),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc", "by", "nc", "sa")),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative", "commons", "noncommercial", "sharealike")),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc", "by", "nd"), ("nc",)),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative", "commons", "noderivatives"), ("noncommercial", "commercial")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa"), ("nc",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative", "commons", "sharealike"), ("noncommercial", "commercial")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived", "neighboring")),
    Template("epl-2.0", "licensed under the eclipse public license version 2 0", ("eclipse", "public")),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "public"), ("lesser", "affero")),
    Template(
        "gpl-terms",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful "
        "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license "
        "for more details", ("gnu", "redistribute"), ("lesser", "affero"),
    ),
    Template("gpl-terms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu", "redistribute"), ("lesser", "affero")),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies", ("fee", "permission", "appear"),
    ),
    Template("lgpl-notice", "this work is licensed under the gnu lesser general public license version 3", ("gnu", "lesser")),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software", ("sublicense", "charge"),
    ),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("charge", "obtaining")),
    Template("mit", "licensed under the mit license", ("mit", "license")),
    Template("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla", "public")),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
        "obtain one at http mozilla org mpl 2 0", ("mozilla", "public"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered", "domain"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered", "domain")),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
        "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions", ("alter", "freely", "restrictions"),
    ),
)
#: Half of the shortest blocks, in words.
STEP = 24
THRESHOLD = 0.8


def step_of(template: Template) -> int:
    """Half the length of the blocks in which a template is looked for: STEP x 2**k, not below its words."""
    step = STEP
    while step < len(template.text.split()):
        step *= 2
    return step


def folded_words(text: Column) -> Column:
    """The words of a text, in order: runs of digits, letters and non-ASCII characters with A-Z folded."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " "))
    return flat


def _count_spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def document_frequencies(flat: DataFrame, words: list[str]) -> dict[str, int]:
    """How many documents hold each of ``words``: one row a word reaches the driver."""
    held = flat.select(F.explode(F.array_intersect(F.split("flat", " "), _words(words))).alias("w"))
    got = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()} if words else {}
    return {w: got.get(w, 0) for w in words}


def _matches(texts: DataFrame, templates: tuple[Template, ...], rank: dict[str, int], threshold: float) -> DataFrame:
    """(row, template, label, share) for every block of ``texts`` (row, tokens) that matches a template; the label may be null."""
    made, leads = [], []
    for at, t in enumerate(templates):
        ranks = sorted({rank[w] for w in t.text.split()})
        need = max(1, ceil(threshold * len(ranks) - 1e-9))
        lead = ranks[: len(ranks) - need + 1]
        made.append((at, t.label, step_of(t), need, ranks, lead, list(t.needs), list(t.bars), len(t.text.split())))
        leads += [(at, r) for r in lead]
    spark = texts.sparkSession
    word = {r: w for w, r in rank.items()}
    table = spark.createDataFrame(made, "template int, label string, step int, need int, words array<int>, lead array<int>, needs array<string>, bars array<string>, reach int")
    prefixes = spark.createDataFrame([(word[r], r, at) for at, r in leads], "word string, word_rank int, template int").join(table, "template")

    vocabulary = _words(sorted(rank, key=rank.get))
    met = texts.select("row", "tokens", F.posexplode("tokens").alias("pos", "word")).join(checked_broadcast(prefixes), "word")
    start = F.explode(F.filter(F.array((F.floor(F.col("pos") / F.col("step")) - 1) * F.col("step"), F.floor(F.col("pos") / F.col("step")) * F.col("step")), lambda s: s >= 0)).alias("start")
    met = met.select("*", start).withColumn("block", F.slice("tokens", F.col("start").cast("int") + 1, 2 * F.col("step")))
    # The last block begins half a block or more before the end, unless it is the only one; each block is met once, at
    # the first place of the first prefix word that it holds.
    whole = (F.col("start") == 0) | (F.size("tokens") > F.col("start") + F.col("step"))
    first_place = F.array_position("block", F.col("word")) + F.col("start") - 1 == F.col("pos")
    known = F.array_sort(F.transform(F.array_intersect("block", vocabulary), lambda w: F.array_position(vocabulary, w).cast("int") - 1))
    met = met.filter(whole & first_place).withColumn("known", known).filter(F.size("known") >= F.col("need"))
    leading = F.array_min(F.array_intersect("lead", "known")) == F.col("word_rank")
    room = F.least(F.size("words") - F.array_position("words", F.col("word_rank")), F.size("known") - F.array_position("known", F.col("word_rank"))) + 1
    shared = F.size(F.array_intersect("words", "known"))
    met = met.filter(leading & (room >= F.col("need"))).withColumn("shared", shared).filter("shared >= need")
    # About some place of its first telling word all the others stand, and none that tells of another license.
    places = F.filter(F.sequence(F.lit(1), F.size("block")), lambda i: F.get("block", i - 1) == F.get("needs", F.lit(0)))
    around = lambda i: F.slice("block", F.greatest(F.lit(1), i - F.col("reach")), F.col("reach") + F.least(i, F.col("reach") + 1))
    told = (F.size("needs") == 0) | F.exists(places, lambda i: (F.size(F.array_except("needs", around(i))) == 0) & ~F.arrays_overlap("bars", around(i)))
    return met.select("row", "template", F.when(told, F.col("label")).alias("label"), (F.col("shared") / F.size("words")).alias("share"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    n_base counts the places where a phrase of ``PHRASES`` stands; first_word and last_word are the least and
    greatest start, in words from 0, or null.  ``labels`` adds the labels of the templates that some block of the text
    matches and that its telling words bear out, n_blocks counts matching (block, template) pairs, and score is 1 with a phrase, else the best share of a
    matched template, else 0.  A null text is empty.  Every input row gives one row, repeated and null ids included;
    other columns are not read; an empty table gives none.  Templates may be of any length.
    """
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), folded_words(F.col(text_col)).alias("flat"))
    vocabulary = sorted({w for t in templates for w in (*t.text.split(),)})
    frequency = document_frequencies(flat, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency[w], w)))}
    rare = set()
    for t in templates:
        words = sorted(set(t.text.split()), key=rank.get)
        rare.update(words[: len(words) - max(1, ceil(threshold * len(words) - 1e-9)) + 1])

    phrase = "(?: " + "| ".join(PHRASES) + ")(?= )"
    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    n_words = F.when(F.col("flat") == "", F.lit(0).cast("long")).otherwise(_count_spaces(F.col("flat")) + 1)
    rows = flat.withColumn("n_words", n_words)
    has = F.col("flat").rlike("(?:^| )(?:" + "|".join(PHRASES) + ")(?: |$)")
    rows = rows.withColumn("_places", F.when(has, F.regexp_extract_all(padded, F.lit(phrase), F.lit(0)))).withColumn("_gaps", F.when(has, F.split(padded, phrase, -1)))
    after = _count_spaces(F.element_at("_gaps", -1)) - 1
    first = _count_spaces(F.element_at("_gaps", 1))
    last = F.col("n_words") - after - _count_spaces(F.element_at("_places", -1))
    base = F.array_compact(F.array(*[F.when(F.array_contains("_places", " " + p), F.lit(label)) for p, label in PHRASES.items()]))
    tokens = F.split("flat", " ")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_base"),
        F.when(has, first).alias("first_word"), F.when(has, last).alias("last_word"), F.coalesce(F.when(has, base), F.array().cast("array<string>")).alias("base"),
        F.when(F.arrays_overlap(tokens, _words(sorted(rare))), tokens).alias("tokens"),
    )
    rows = stash(rows.withColumn("n_base", F.greatest(F.lit(0).cast("long"), "n_base")), "license-rows")
    found = _matches(rows.filter("tokens is not null").select("row", "tokens"), tuple(templates), rank, threshold)
    found = stash(found.groupBy("row").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("share").alias("best"), F.collect_set("label").alias("added")), "license-matches")
    rows = rows.drop("tokens").join(checked_broadcast(found), "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"),
    )
