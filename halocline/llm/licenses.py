"""Licence labels by diagonal voting; DataFrame functions only.

Every rolling 3-word hash of a text is joined to the places of the same words in licence templates. A match at word p of
the text and word q of a template votes for the diagonal p - q: a copied notice gives many votes on one diagonal, and a
word more or less moves the rest to a neighbouring one. Neighbouring diagonals are merged, and a merged span counts if
its distinct template places cover enough of the template and of the span. Matches are compared word by word, so a span
never rests on hashes alone. Notices of one family differ in a word or two: a span must hold the words that tell its
licence from the plainer one, and of spans that share most of their words only the best-covered licence stays (ties:
the longest template). Plain phrases are looked for besides, and labels of both are joined.

Templates are a fixed list, so their table is broadcast; the hashes are never shuffled, only matches and one row for
each document are.

Rules for odd input: a NULL text is an empty one, without words, labels or places, and score 0; repeated rows give one
result row each; an empty table gives an empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from halocline.llm.frames import lower_ascii, tune

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals this close are one span; a span must hold this share of the template's grams, and of its own.
NEAR, COVER, DENSE = 2, 0.6, 0.5
KEYS = ["id", "key"]

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GNU = [("gpl", "GNU General Public License", ""), ("gpl", "GNU GPL", ""), ("lgpl", "GNU Lesser General Public License", "lesser"), ("lgpl", "GNU Library General Public License", "library general"),
        ("lgpl", "GNU LGPL", "lgpl"), ("agpl", "GNU Affero General Public License", "affero"), ("agpl", "GNU AGPL", "agpl")]
_CC = [("cc-by", "Attribution", "by", ""), ("cc-by-nc", "Attribution-NonCommercial", "by-nc", "nc"), ("cc-by-sa", "Attribution-ShareAlike", "by-sa", "sa"),
       ("cc-by-nd", "Attribution-NoDerivatives", "by-nd", "nd"), ("cc-by-nd", "Attribution-NoDerivs", "by-nd", "nd"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "by-nc-sa", "nc sa"),
       ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "by-nc-nd", "nc nd"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivs", "by-nc-nd", "nc nd")]

#: Label, sentence of a common notice, and the words (up to GRAM in a row) that tell it from plainer ones of its family.
#: Sentences that several licences share word for word (such as "any later version") tell none and are not listed.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0", ""),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ""),
    ("apache", "See the License for the specific language governing permissions and limitations under the License", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ""),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ""),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ""),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ""),
    ("bsd", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage", ""),
    *((label, f"This work is licensed under a Creative Commons {name} 4.0 International License", " ".join(name.lower().split("-")[1:])) for label, name, _, _ in _CC),
    *((label, f"Licensed under CC {code.upper()} 4.0", tell) for label, code, tell in sorted({(x[0], *x[2:]) for x in _CC})),
    *((label, f"To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/", tell) for label, code, tell in sorted({(x[0], *x[2:]) for x in _CC})),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ""),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3", "lesser"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3", "affero"),
    *((label, f"This {'library' if label == 'lgpl' else 'program'} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation", tell) for label, name, tell in _GNU),
    *((label, f"This {'library' if label == 'lgpl' else 'program'} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details", tell) for label, name, tell in _GNU),
    *((label, f"You should have received a copy of the {name} along with this {'library' if label == 'lgpl' else 'program'}", tell) for label, name, tell in _GNU),
    ("mit", "Released under the MIT License", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ""),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", ""),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ""),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ""),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, ...]]) -> DataFrame:
    """template, label, place, size (grams of the template), gram (its words), tell (2: holds the telling words, 1: there are none, 0: it lacks them) and hash."""
    rows = []
    for t, (label, text, *tells) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        grams = [" ".join(words[i: i + GRAM]) for i in range(len(words) - GRAM + 1)]
        tell = f" {' '.join(tells)} "
        rows += [(t, label, i, len(grams), g, 1 if not tell.strip() else 2 if tell in f" {g} " else 0) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, place int, size int, gram string, tell int").withColumn("hash", F.xxhash64(*(F.split("gram", " ")[i] for i in range(GRAM))))


def _places(words: Column, n: Column, phrase: str) -> Column:
    """Places at which the phrase's words stand in a row; only looked for in texts that hold the words."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == p)
        return F.coalesce(out, F.lit(False))

    none = F.expr("cast(array() as array<int>)")
    return F.when(F.contains("line", F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), n.cast("int") - 1), here)).otherwise(none)


def _best(spans: Column) -> Column:
    """Spans in order of rank become those that share half of the shorter one's words with no better span of another label; by label and place."""

    def rival(k: Column, s: Column) -> Column:
        both = F.least(k["last"], s["last"]) - F.greatest(k["first"], s["first"]) + 1
        return (k["label"] != s["label"]) & (2 * both >= F.least(k["last"] - k["first"], s["last"] - s["first"]) + 1)

    none = F.filter(spans, lambda s: F.lit(False))
    stay = F.aggregate(spans, none, lambda held, s: F.when(F.exists(held, lambda k: rival(k, s)), held).otherwise(F.concat(held, F.array(s))))
    return F.array_sort(F.transform(stay, lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["last"].alias("last"), (-s["rank"]).alias("share"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first and last word, share) of each text."""
    spark = tune(docs.sparkSession)
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
            .withColumns({"n": F.size("words").cast("long"), "line": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))}))
    found = {label: _places(F.col("words"), F.col("n"), phrase) for phrase, label in PHRASES.items()}
    rows = rows.withColumns({f"at_{i}": c for i, c in enumerate(found.values())}).drop("line")
    at = F.concat(*(f"at_{i}" for i in range(len(found))))
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(found))))
    gram = F.transform("words", lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, GRAM))))
    rows = rows.select("id", "key", "words", "n", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
                       F.array_max(at).cast("long").alias("last_word"), base.alias("base"), F.concat(F.array(F.lit(0).cast("long")), gram).alias("grams"))
    # the first element stands for the document itself; "outer" keeps Spark from testing the array's size before it, which would take words again
    votes = (rows.select(*[c for c in rows.columns if c != "grams"], F.posexplode_outer("grams").alias("p", "hash"))
             .join(F.broadcast(template_grams(spark, templates or TEMPLATES)), "hash", "left")
             .filter((F.col("p") == 0) | (F.array_join(F.slice("words", F.col("p"), F.lit(GRAM)), " ") == F.col("gram"))))
    own = F.col("p") == 0
    votes = votes.select(*KEYS, *(F.when(own, F.col(c)).alias(c) for c in ("n", "n_base", "first_word", "last_word", "base")),
                         *(F.when(~own, F.col(c)).alias(c) for c in ("template", "label", "place", "size", "tell")), F.when(~own, F.col("p") - 1).alias("at"))
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    in_order = Window.partitionBy(*KEYS, "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_order) > NEAR).cast("int"), F.lit(0)))
    votes = votes.withColumn("span", F.sum("new").over(in_order.rangeBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy(*KEYS, "template", "label", "span", "size", "n", "n_base", "first_word", "last_word", "base").agg(
        F.count("*").alias("copies"), F.size(F.collect_set("place")).alias("held"), F.max("tell").alias("told"), F.min("at").cast("int").alias("low"), (F.max("at") + GRAM - 1).cast("int").alias("high"))
    share = F.col("held") / F.col("size")
    good = (F.col("told") > 0) & (share >= COVER) & (F.col("held") >= DENSE * (F.col("high") - F.col("low") - GRAM + 2))
    span = F.when(F.col("n").isNull() & good, F.struct((-share).alias("rank"), (-F.col("size")).alias("size"), F.col("low").alias("first"), "label", F.col("high").alias("last")))
    out = spans.groupBy(KEYS).agg(F.max("n").alias("n_words"), F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
                                  F.max("base").alias("base"), F.max(F.when(F.col("n").isNotNull(), F.col("copies"))).alias("copies"), _best(F.array_sort(F.collect_list(span))).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return (out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
            .drop("_"))
