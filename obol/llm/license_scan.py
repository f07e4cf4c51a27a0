"""Licence scans: sentences to known licence-sentence ids, id sequences to ordered licence rules.

SQL functions only.  Texts are cut at line breaks and at a full stop, question
or exclamation mark or semicolon before white space; words are normalised to
lower-case letters and digits.  A known sentence begins and ends at a cut; in
between, line breaks (with comment signs, and empty lines: the Apache header
has one before its address) count as spaces, other cuts do not.  Where several
known sentences begin, the longest is found.  The ids found in a document, in
order, form a sequence that each rule's ordered ids must occur in without a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: known licence sentences (id, sentence), public licence wording.
SENTENCES = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "Released under the MIT License."),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (6, "you may not use this file except in compliance with the License."),
    (7, "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    (9, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (10, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (11, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    (12, "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (13, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (14, "SPDX-License-Identifier: MIT"),
    (15, "SPDX-License-Identifier: Apache-2.0"),
    (16, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (17, "SPDX-License-Identifier: BSD-3-Clause"),
    (18, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
# FIXED VALUES: rules (rule, licence, ordered sentence ids); the first rule that matches at a place names it.
RULES = [
    (1, "Apache-2.0", [5, 6, 7]),
    (2, "GPL-3.0-or-later", [10, 11, 12]),
    (3, "MIT", [8, 9]),
    (4, "Apache-2.0", [1]),
    (5, "MIT", [2]),
    (6, "GPL-3.0-only", [3]),
    (7, "CC-BY-NC-4.0", [4]),
    (8, "BSD", [13]),
    (9, "MIT", [14]),
    (10, "Apache-2.0", [15]),
    (11, "GPL-3.0-or-later", [16]),
    (12, "BSD-3-Clause", [17]),
    (13, "CC-BY-4.0", [18]),
]
BREAK = r"[\n\r]+|[.;!?][ \t]+"
#: Signs of a cut that is no line break, in normalised texts; a text's own are spaces.
STOP = "\u0001"


def normalised(text: Column) -> Column:
    """Words with single spaces, ``STOP`` for a sentence end and a newline for each line end."""
    lines = F.regexp_replace(F.translate(F.lower(text), STOP, " "), r"\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?md)^[^a-z0-9\n]*(?:(?:rem|dnl)[ \t]+)?", "")  # comment signs
    cut = F.regexp_replace(lines, r"[.;!?](?:[ \t]+|(?=\n)|\z)", STOP)
    return F.regexp_replace(F.regexp_replace(cut, f"[^a-z0-9\n{STOP}]+", " "), f" ?([\n{STOP}]) ?", "$1")


def known_sentences(spark: SparkSession) -> DataFrame:
    """The fixed sentences: id, sentence."""
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("sentence")) for i, s in SENTENCES))
    return spark.range(1).select(F.inline(rows))


def licence_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules: rule, license, ids."""
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.array(*map(F.lit, seq)).alias("ids")) for r, lic, seq in RULES))
    return spark.range(1).select(F.inline(rows))


def _prepared(sentences: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: pattern of all known sentences, pattern of a word of each, ids by words, rules by number."""
    form = F.trim(F.regexp_replace(normalised(F.col("sentence").cast("string")), f"[\n{STOP}]+$", ""))
    words = F.trim(F.regexp_replace(form, f"[ \n{STOP}]+", " "))
    rarest = F.element_at(F.array_sort(F.transform(F.split("words", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    # between two words any line ends; a sentence end only where the known sentence has one
    pattern = F.replace(F.replace(F.regexp_replace(form, "\n", " "), F.lit(" "), F.lit("[ \n]+")), F.lit(STOP), F.lit(f"[ \n{STOP}]+"))
    per = sentences.select(F.col("id").cast("int").alias("id"), words.alias("words"), pattern.alias("pattern")).where("words <> ''") \
        .groupBy("words").agg(F.min("id").alias("id"), F.min("pattern").alias("pattern")).withColumn("seed", rarest)
    held = F.sort_array(F.collect_list(F.struct(F.length("words").alias("n"), "words", "id", "pattern")), asc=False)
    one = per.agg(held.alias("held"), F.array_join(F.sort_array(F.collect_set("seed")), "|").alias("seeds"))
    seq = F.concat(F.lit(","), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(","))
    ruled = rules.select(F.struct(F.col("rule").cast("int").alias("rule"), F.col("license").cast("string").alias("license"), seq.alias("seq")).alias("r")) \
        .agg(F.sort_array(F.collect_list("r")).alias("known_rules"))
    cut = f"[\n{STOP}]"
    return one.select(
        F.concat(F.lit(f"(?<={cut})(?:"), F.array_join(F.transform("held", lambda x: x["pattern"]), "|"), F.lit(f")(?={cut})")).alias("pattern"),
        "seeds", F.map_from_entries(F.transform("held", lambda x: F.struct(x["words"], x["id"]))).alias("ids")).crossJoin(ruled)


def scan(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids (in order), rules, licenses for every row of ``docs``.

    ``sentences`` (id > 0, sentence) and ``rules`` (rule, license, ids) are
    small tables, by default the fixed ones; of equal sentences the smallest id
    counts.  Neighbouring known sentences need no other known one between them;
    unknown words in between end a sequence.  Null and empty texts have none;
    repeated rows are scanned each; an empty table gives none; other columns
    are not read.
    """
    spark = docs.sparkSession
    known = _prepared(known_sentences(spark) if sentences is None else sentences, licence_rules(spark) if rules is None else rules)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .crossJoin(F.broadcast(known))
    # sentences of a row stay in its own array: no shuffle, whatever the text's length
    hinted = (F.col("seeds") != "") & F.rlike(F.lower("text"), F.col("seeds"))
    framed = F.concat(F.lit(STOP), F.trim(normalised(F.col("text"))), F.lit(STOP))
    # odd parts are known sentences, even ones what lies between: 0 if that holds words
    parts = F.split(F.regexp_replace(framed, F.col("pattern"), F.lit("#$0#")), "#")
    mark = lambda x, i: F.when(i % 2 == 1, F.try_element_at("ids", F.regexp_replace(x, f"[ \n{STOP}]+", " "))).when(x.rlike("[a-z0-9]"), 0)
    marked = F.filter(F.transform(parts, mark), lambda m: m.isNotNull())
    found = keyed.withColumn("marks", F.when(hinted, marked).otherwise(F.array().cast("array<int>"))) \
        .withColumn("line", F.concat(F.lit(","), F.array_join("marks", ","), F.lit(",")))
    return found.withColumn("hits", F.filter("known_rules", lambda x: F.contains(F.col("line"), x["seq"]))).select(
        "doc_id", F.size(F.filter("marks", lambda i: i > 0)).cast("long").alias("n_known"),
        F.array_join(F.filter("marks", lambda i: i > 0), ",").alias("sentence_ids"),
        F.array_join(F.transform("hits", lambda x: x["rule"]), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["license"]))), ",").alias("licenses"))
